"""Quality classifier: support vectors on n-grams scaled by naive Bayes ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, uniform
from .labels import held_out, training_rows

#: Hashed n-grams; the fitted model is one number for each.
DIMENSIONS = 1 << 18
#: The most n-grams, of all drawn documents together, that a fit takes to the driver.
MOST_NGRAMS = 1 << 25
#: Added to every count of the log-count ratios.
SMOOTHING = 1.0

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_LETTER_RUN = re.compile(r"[^\W\d_]+")
_DIGIT_RUN = re.compile(r"\d+")


def _shape(word: str) -> str:
    """A token's form: runs of letters by case, runs of digits, other signs as they are."""

    def letters(m: re.Match) -> str:
        run = m.group()
        return "A" if run.isupper() and len(run) > 1 else "C" if run[0].isupper() else "a"

    return _DIGIT_RUN.sub("9", _LETTER_RUN.sub(letters, word))[:16]


def ngrams(text: str | None) -> np.ndarray:
    """Distinct hashed n-grams of a whole text, up to three tokens long.

    The tokens of an n-gram are forms, with ``=`` for a token that repeats the one
    before it; words themselves count as one-grams in lower case.
    """
    forms: dict[str, str] = {}
    seen: set[tuple[str, str, str]] = set()
    before, first, second = None, "", ""
    for word in _TOKEN.findall(text or ""):
        if word == before:
            form = "="
        elif (form := forms.get(word)) is None:
            form = forms[word] = _shape(word)
        before = word
        seen.add((first, second, form))
        first, second = second, form
    grams = {" ".join(gram[i:]).lstrip() for gram in seen for i in range(3)}  # shorter ones end the longer
    digest = xxhash.xxh32_intdigest
    ids = {digest(gram) % DIMENSIONS for gram in grams}
    ids.update(digest("w:" + word.lower()) % DIMENSIONS for word in forms)
    return np.fromiter(ids, np.int32, len(ids))


@dataclass
class Model:
    """Score = 1 / (1 + exp(-(slope * margin))), margin = bias + sum of weights of n-grams."""

    weights: np.ndarray
    bias: float
    slope: float

    def score(self, text: str | None) -> float:
        ids = ngrams(text)
        margin = self.bias + (float(self.weights[ids].sum()) / max(1.0, len(ids)) ** 0.5)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin, -40, 40))))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 30, tolerance: float = 1e-3, seed: int = 3) -> Model:
    """Log-count ratios, then the hinge loss by dual coordinate descent.

    Each n-gram's indicator is multiplied by its log-count ratio; a row is scaled by
    the root of its number of n-grams, so that length alone says little.  Classes weigh
    alike.  Without rows of both classes the score is the share of label 1.
    """
    positive = labels == 1
    if not len(rows) or positive.all() or not positive.any():
        share = (positive.sum() + 1) / (len(rows) + 2)
        return Model(np.zeros(DIMENSIONS, np.float32), float(np.log(share / (1 - share))), 1.0)
    counts = np.full((2, DIMENSIONS), SMOOTHING)
    for ids, one in zip(rows, positive, strict=True):
        counts[int(one), ids] += 1
    present = (counts.sum(0) > 2 * SMOOTHING)
    ratio = np.log(counts[1] / (positive.sum() + 2 * SMOOTHING)) - np.log(counts[0] / ((~positive).sum() + 2 * SMOOTHING))
    ratio[~present] = 0
    sign = np.where(positive, 1.0, -1.0)
    most = cost * np.where(positive, len(rows) / (2 * positive.sum()), len(rows) / (2 * (~positive).sum()))
    values = [ratio[ids] / max(1.0, len(ids)) ** 0.5 for ids in rows]
    square = np.array([float(v @ v) + 1.0 for v in values])
    weights, bias, dual = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            ids, v = rows[i], values[i]
            gradient = sign[i] * (float(weights[ids] @ v) + bias) - 1
            new = min(max(dual[i] - gradient / square[i], 0.0), most[i])
            if change := new - dual[i]:
                dual[i] = new
                weights[ids] += change * sign[i] * v
                bias += change * sign[i]
                moved = max(moved, abs(change))
        if moved < tolerance:
            break
    return Model((weights * ratio).astype(np.float32), float(bias), 2.0)


def learn_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded draw of labelled documents; n-grams are made in the tasks.

    Where the drawn documents hold more than ``MOST_NGRAMS`` n-grams, fewer are drawn.

    Edge cases: null texts have no n-grams; labels that are null or neither 0 nor 1, and
    those of unknown, null or held-out identifiers, teach nothing; an identifier that
    repeats teaches with each of its texts; without labels of both kinds the model is the
    share of label 1.
    """

    @F.pandas_udf("array<int>")
    def grams(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([ngrams(t) for t in batch])

    drawn = training_rows(docs, labels, label_col, id_col, text_col)
    rows = saved(drawn.select(grams("text").alias("ids"), "label", F.xxhash64("text").alias("draw")))
    total = rows.agg(F.sum(F.size("ids"))).head()[0] or 0
    if total > MOST_NGRAMS:
        rows = rows.where(uniform(F.xxhash64("draw")) < 0.9 * MOST_NGRAMS / total)
    table = rows.select("ids", "label").toArrow()
    order = sorted(range(table.num_rows), key=lambda i: (table["label"][i].as_py(), table["ids"][i].values.to_numpy().tobytes()))
    rows = [table["ids"][i].values.to_numpy() for i in order]
    return fit(rows, np.array([table["label"][i].as_py() for i in order], np.int64))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Score every whole text where it lies.

    Returns identifier, ``held_out``, ``score`` and ``predicted``.

    Edge cases: null texts count as empty and get the score of no n-grams, the bias;
    null identifiers are not held out; repeated rows score alike; an empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.score(t) for t in batch], dtype="float64")

    return scored(docs, score(docs[text_col]), id_col, threshold)


def scored(docs: DataFrame, score: Column, id_col: str, threshold: float) -> DataFrame:
    return docs.select(docs[id_col], held_out(docs[id_col]).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
