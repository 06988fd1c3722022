"""Language of texts: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, spread, uniform

#: Hashed subwords and the length of their embeddings.
BUCKETS, WIDTH = 1 << 15, 16
#: Longest subwords in characters, the ends of the word among them; words themselves count too.
LONGEST = 4
#: Bounds of the fit alone: documents of each language and of all, languages, subwords of all
#: documents together (one has at most ``BUCKETS`` of them); words of a document's excerpt.
MOST_OF_A_LANGUAGE, MOST_DOCUMENTS, MOST_LANGUAGES, MOST_SUBWORDS = 500, 4_000, 256, 1 << 25
EXCERPT = 8
#: Share of rightly named calibration texts that the threshold lets pass.
ACCEPTED = 0.995

#: A run of more letters counts as several words, so that blocks of words stay small.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,4095}")
_BLOCK = 1 << 16
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def held_out(ident: Column) -> Column:
    """Whether a row may not be learnt from: crc32 of the identifier modulo 4 is 2."""
    return F.coalesce(F.crc32(F.encode(ident.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> Counter:
    """Lower-case runs of letters (with marks) of a whole text and their counts."""
    return Counter(_WORD.findall((text or "").lower()))


def subwords(words: Counter) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed pieces of every ``<word>``, the words themselves, and how often each occurs."""
    block, size = [], 0
    for word in words:
        block.append(word)
        size += len(word)
        if size >= _BLOCK:
            yield from _pieces(block, words)
            block, size = [], 0
    if block:
        yield from _pieces(block, words)


def _pieces(block: list[str], words: Counter) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    points = np.frombuffer(f"<{'><'.join(block)}>".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.flatnonzero(points == ord("<"))
    word = np.repeat(np.arange(len(first)), np.diff(first, append=len(points)))
    times = np.array([words[w] for w in block], np.float64)
    rolling = np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        rolling = rolling[: len(points) - n + 1] * _FACTOR + points[n - 1 :]
        inside = word[: len(rolling)] == word[n - 1 :]
        yield _bucket(rolling[inside], n), times[word[: len(rolling)][inside]]
    place = np.arange(len(points)) - first[word]
    powers = np.cumprod(np.full(place.max() + 1, _FACTOR))
    yield _bucket(np.add.reduceat(points * powers[place], first), 0), times


def _bucket(values: np.ndarray, kind: int) -> np.ndarray:
    values = (values + np.uint64(kind)) * _MIX
    values = (values ^ (values >> np.uint64(29))) * _FACTOR
    return (values >> np.uint64(32)).astype(np.int64) % BUCKETS


def counts_of(words: Counter) -> np.ndarray:
    """How often the words hold each hashed subword."""
    counts = np.zeros(BUCKETS)
    for ids, times in subwords(words):
        counts += np.bincount(ids, times, BUCKETS)
    return counts


def bag(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed subwords and their counts."""
    counts = counts_of(words)
    ids = np.flatnonzero(counts)
    return ids.astype(np.int32), counts[ids].astype(np.float32)


@dataclass
class Model:
    """``logits``: each subword's share of every language's logit, embeddings times weights;
    a text's logits are their average over all its subwords, plus ``bias``.  ``heat`` divides
    them, so that scores are as often right as they say; below ``threshold`` a name is doubtful."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    heat: float = 1.0
    threshold: float = 0.0

    def scores(self, words: Counter) -> np.ndarray:
        counts = counts_of(words)
        return softmax((counts @ self.logits / max(1.0, counts.sum()) + self.bias) / self.heat)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its score; ``und`` and 0 for texts without letters."""
        words = words_of(text)
        if not words or not self.languages:
            return "und", 0.0
        scores = self.scores(words)
        best = int(scores.argmax())
        return self.languages[best], float(scores[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 5) -> Model:
    """Stochastic gradient descent on the cross-entropy; languages weigh alike.

    A text's step on its embeddings is divided by the sum of squared shares of its subwords,
    so that one text moves its average as far as any other, however long it is.
    """
    rng = np.random.default_rng(seed)
    n = len(languages)
    embeddings, weights, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.3, (WIDTH, n)), np.zeros(n)
    share = 1 / np.maximum(1, np.bincount(labels, minlength=n))
    share /= share.max()
    steps, done = epochs * max(1, len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, counts = bags[i]
            part = counts / counts.sum()
            hidden = part @ embeddings[ids]
            error = softmax(hidden @ weights + bias)
            error[labels[i]] -= 1
            step = rate * (1 - done / steps) * share[labels[i]]
            back = weights @ error
            weights -= step * np.outer(hidden, error)
            bias -= 0.1 * step * error
            embeddings[ids] -= np.outer(part * (step / 2 / (part @ part)), back)
            done += 1
    return Model(languages, embeddings @ weights, bias)


def calibrated(model: Model, scored: list[np.ndarray], labels: np.ndarray) -> Model:
    """Set ``heat`` to the least cross-entropy on texts that were not fitted, by a search over
    powers, and ``threshold`` so that ``ACCEPTED`` of those rightly named pass."""
    if not scored:
        return model
    z = np.array(scored)
    heats = 2.0 ** np.arange(-6, 6.25, 0.25)

    def loss(heat: float) -> float:
        return float(np.mean([-np.log(max(softmax(row / heat)[label], 1e-12)) for row, label in zip(z, labels, strict=True)]))

    model.heat = min(heats, key=loss)
    best = np.array([softmax(row / model.heat) for row in z])
    right = np.sort(best.max(1)[best.argmax(1) == labels])
    model.threshold = float(right[int(len(right) * (1 - ACCEPTED))]) if len(right) else 1.0
    return model


def training_rows(docs: DataFrame, lang_col: str, id_col: str, text_col: str) -> DataFrame:
    """About ``MOST_OF_A_LANGUAGE`` documents of each of the commonest languages, drawn by hash
    before any text is read: ``text``, ``lang`` and ``check`` (a fifth, for calibration)."""
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    sizes = known.groupBy(F.col(lang_col).alias("__lang")).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "__lang").limit(MOST_LANGUAGES)
    drawn = F.xxhash64(id_col, text_col, F.lit("language"))
    sizes = saved(sizes)
    chance = F.lit(min(MOST_OF_A_LANGUAGE, MOST_DOCUMENTS / max(1, sizes.count()))) / F.col("__n")
    at = uniform(F.xxhash64(spread(F.col(id_col)), F.lit("draw")))
    picked = known.join(F.broadcast(sizes), F.col(lang_col) == F.col("__lang")).where(at < chance)
    return picked.select(F.col(text_col).alias("text"), F.col("__lang").cast("string").alias("lang"), (F.pmod(drawn, F.lit(5)) == 0).alias("check"), drawn.alias("drawn"))


def learn_languages(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded draw of documents outside the held-out quarter.

    Subwords are counted in the tasks, over whole texts; each document teaches once whole and
    once by an excerpt of ``EXCERPT`` neighbouring words at a place drawn by hash, so that
    short texts are known too.  A fifth of the draw is kept for calibration.

    Edge cases: null languages and texts without letters teach nothing; null identifiers are
    not held out; rows alike are drawn or left together; without languages nothing is ever named.
    """

    @F.pandas_udf("whole_ids array<int>, whole_counts array<float>, part_ids array<int>, part_counts array<float>")
    def bags(texts: pd.Series, drawn: pd.Series) -> pd.DataFrame:
        rows = []
        for text, at in zip(texts, drawn, strict=True):
            words = _WORD.findall((text or "").lower())
            place = int(at) % max(1, len(words) - EXCERPT + 1)
            rows.append([*bag(Counter(words)), *bag(Counter(words[place : place + EXCERPT]))])
        return pd.DataFrame(rows, columns=["whole_ids", "whole_counts", "part_ids", "part_counts"])

    counted = training_rows(docs, lang_col, id_col, text_col).select("lang", "check", "drawn", bags("text", "drawn").alias("b"))
    found = sorted(_bounded(counted), key=lambda r: (r["lang"], r["drawn"], r["b"]["whole_ids"].tobytes()))
    found = [r for r in found if len(r["b"]["whole_ids"])]
    languages = sorted({r["lang"] for r in found})
    place = {lang: i for i, lang in enumerate(languages)}
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))

    def both(rows: list[dict]) -> tuple[list, np.ndarray]:
        made = [(r["b"][f"{kind}_ids"], r["b"][f"{kind}_counts"]) for r in rows for kind in ("whole", "part")]
        return made, np.repeat([place[r["lang"]] for r in rows], 2)

    fitted = [r for r in found if not r["check"]] or found
    model = fit(*both(fitted), languages)
    checks, labels = both([r for r in found if r["check"]])
    return calibrated(model, [(counts @ model.logits[ids]) / counts.sum() + model.bias for ids, counts in checks], labels)


def _bounded(counted: DataFrame) -> list[dict]:
    """The draw's rows on the driver, no more of them than hold ``MOST_SUBWORDS`` subwords."""
    size = F.size("b.whole_ids") + F.size("b.part_ids")
    total = counted.agg(F.sum(size)).head()[0] or 0
    if total > MOST_SUBWORDS:
        counted = counted.where(uniform(F.xxhash64("drawn")) < 0.9 * MOST_SUBWORDS / total)
    table = counted.select("lang", "check", "drawn", "b.*").toArrow()
    names = ["whole_ids", "whole_counts", "part_ids", "part_counts"]
    return [{"lang": table["lang"][i].as_py(), "check": table["check"][i].as_py(), "drawn": table["drawn"][i].as_py(), "b": {c: table[c][i].values.to_numpy() for c in names}} for i in range(table.num_rows)]


def name_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Name the language of every whole text where it lies.

    Returns identifier, ``held_out``, ``lang_pred``, ``score`` (calibrated chance that it is
    right) and ``accepted``, false where the score is below the calibrated threshold.

    Edge cases: null texts and texts without a letter are ``und`` with score 0 and not
    accepted; null identifiers are not held out; repeated rows are named alike; an empty table
    gives an empty result; a model without languages names nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def named(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=["lang", "score"])

    rows = docs.select(docs[id_col], held_out(docs[id_col]).alias("held_out"), named(docs[text_col]).alias("__named"))
    out = rows.select(id_col, "held_out", F.col("__named.lang").alias("lang_pred"), F.col("__named.score").alias("score"))
    return out.withColumn("accepted", (F.col("lang_pred") != "und") & (F.col("score") >= model.threshold))
