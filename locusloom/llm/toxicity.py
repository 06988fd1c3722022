"""Toxicity by a weighted grammar of composed finite-state transducers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .labels import training_rows
from .quality import scored

# --- Words of the grammar, by class. ---
INSULTS = """
    idiot idiots moron morons imbecile imbeciles stupid dumb dumbass fool fools clown clowns scum scumbag scumbags trash
    garbage loser losers pathetic disgusting worthless useless ugly filthy vermin parasite parasites pig pigs rat rats
    bastard bastards bitch bitches asshole assholes jerk jerks creep creeps coward cowards degenerate degenerates
    retard retarded freak freaks subhuman cretin cretins halfwit nitwit dimwit lowlife repulsive despicable vile
    brainless spineless
    idioten dummkopf trottel arschloch abschaum versager widerlich ekelhaft wertlos
    imbéciles crétin crétins connard connards ordure salaud salauds dégoûtant
    estúpido estúpidos imbécil inútil basura asqueroso escoria idiota idiotas
""".split()
THREATS = """
    kill hurt destroy murder stab shoot strangle beat burn punish crush maim
    töten umbringen verletzen schlagen verprügeln vernichten tuer frapper blesser détruire étrangler matar golpear herir destruir apuñalar
""".split()
TARGETS = """
    you u your yours yourself yourselves they them their these those him her his
    du dich dir ihr euch deine dein tu toi vous te ton ta tú ti usted ustedes vosotros
""".split()
SELVES = "i we ich wir je nous yo nosotros".split()
FUTURES = "will gonna going shall must werde werden muss vais allons dois voy vamos debo".split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't didn't won't ain't nicht nie kein keine keinen pas jamais nunca".split()
REPORTS = """
    said says say called calls call wrote writes shouted claimed claims quoted quote accused calling saying
    sagte sagt nannte nennt schrieb behauptete dit disait appelle écrit dijo dice llamó llama escribió
""".split()
FILLERS = """
    a an the so such very really just too as like to be been of and or but ever being all some absolute total complete
    ein eine einen der die das sehr und un une le la les très et una el los las muy y
""".split()
COPULAS = "are is am was were be re s m r bist ist seid sind es est êtes sont eres son sois".split()

_CLASSES = {
    **dict.fromkeys(FILLERS, "fill"), **dict.fromkeys(COPULAS, "be"), **dict.fromkeys(TARGETS, "target"), **dict.fromkeys(SELVES, "self"),
    **dict.fromkeys(FUTURES, "future"), **dict.fromkeys(NEGATIONS, "neg"), **dict.fromkeys(REPORTS, "report"), "ll": "future",
    **dict.fromkeys(THREATS, "threat"), **dict.fromkeys(INSULTS, "insult"),
}
SYMBOLS = ("other", "fill", "be", "target", "self", "future", "neg", "report", "quote", "insult", "threat", "end")
#: What a clause can match, each with the weight that holds before any label is seen; that of
#: a target comes on top of the insult's.
PRIOR = {"insult": 1.3, "insult_at_target": 0.6, "threat": 2.0, "denied": -0.2, "reported": 0.1, "stem": 1.5}
PRIOR_BIAS = -3.0
#: Bounds of fitted weights: a denial never speaks for toxicity, a report little.
BOUNDS = {"insult": (0, 9), "insult_at_target": (0, 9), "threat": (0, 9), "denied": (-4, 0), "reported": (-4, 0.2), "stem": (0, 9)}
#: Characters of the stretches in which learnt stems are counted, and the least chance of one there.
STRETCHES = (500, 2_000, 8_000, 32_000, 1 << 40)
LEAST_CHANCE = 1e-6
#: A language with a tenth of the text has up to ten times the mean chance of its stems.  Which
#: of these factors holds is found by cross-validation within the rows that are learnt from.
RARE_LANGUAGE = (1, 3, 10, 30)
FOLDS = 3
#: A whole threat ("I will hurt you") is decisive where no clean row that is learnt from has one.
DECISIVE = 0.8

# --- Stems that the labels teach. ---
#: Letters of a stem, the forms in which it must occur, and how many are learnt at most.
STEM_LETTERS = range(4, 8)
STEM_FORMS = 5
MOST_STEMS = 200
#: Chance of a stem without meaning among all candidates.
STEM_CHANCE = 0.01
#: Stems with their words that a task holds before it passes their counts on.
HELD_PREFIXES = 100_000

_SIGN = re.compile(r"[^\W\d_]+(?:n't)?|[.!?;:,\n]+|[\"“”„«»]")
_END = frozenset(".!?;:,\n")


@dataclass(frozen=True)
class Transducer:
    """A deterministic letter transducer: ``step[(state, symbol)] = (state, output)``.

    A missing symbol leads back to the start and passes unchanged.
    """

    step: dict[tuple[str, str], tuple[str, str]]
    start: str = "start"

    def move(self, state: str, symbol: str) -> tuple[str, str]:
        return self.step.get((state, symbol), (self.start, symbol))


def compose(first: Transducer, second: Transducer, symbols: tuple[str, ...]) -> Transducer:
    """What ``second`` makes of ``first``'s output, as one transducer over reachable pairs."""
    start = f"{first.start}|{second.start}"
    step, seen, open_ = {}, {(first.start, second.start)}, [(first.start, second.start)]
    while open_:
        a, b = open_.pop()
        for symbol in symbols:
            a2, middle = first.move(a, symbol)
            b2, out = second.move(b, middle)
            step[(f"{a}|{b}", symbol)] = (f"{a2}|{b2}", out)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                open_.append((a2, b2))
    return Transducer(step, start)


def layers() -> list[Transducer]:
    """Negation, reported speech, threats, and insults with their targets."""
    neutral = ("fill", "be", "target", "future")
    # A negation reaches over fillers to the insult or threat that it denies.
    negation = {("start", "neg"): ("neg", "neg"), ("neg", "neg"): ("neg", "neg"), ("neg", "insult"): ("start", "denied"), ("neg", "threat"): ("start", "denied")}
    negation |= {("neg", s): ("neg", s) for s in neutral}
    # After a verb of saying, or inside an opened quotation, words are another's.
    report = {("start", "report"): ("said", "report"), ("said", "report"): ("said", "report"), ("said", "quote"): ("said", "quote")}
    report |= {("said", s): ("said", s) for s in (*neutral, "self")}
    report |= {("said", "insult"): ("said", "reported"), ("said", "threat"): ("said", "reported")}
    # A threat needs someone who will do it to someone: "I will hurt you", "ich werde dich töten".
    threat = {("start", "self"): ("self", "self"), ("self", "self"): ("self", "self"), ("self", "future"): ("will", "future"), ("will", "threat"): ("act", "threat")}
    threat |= {(state, s): (state, s) for state in ("self", "will", "act") for s in ("fill", "be")}
    threat |= {("will", "future"): ("will", "future"), ("act", "target"): ("start", "threatened")}
    threat |= {("will", "target"): ("aimed", "target"), ("aimed", "threat"): ("start", "threatened")}
    threat |= {("aimed", s): ("aimed", s) for s in ("fill", "be", "target")}
    # An insult right after or before its target weighs more.
    insult = {("start", "target"): ("target", "target"), ("target", "target"): ("target", "target"), ("target", "insult"): ("start", "insult_at_target")}
    insult |= {("target", s): ("target", s) for s in ("fill", "be")}
    return [Transducer(step) for step in (negation, report, threat, insult)]


def grammar() -> Transducer:
    """All layers as one machine: each reads what the one before it writes."""
    machine, *rest = layers()
    for layer in rest:
        machine = compose(machine, layer, SYMBOLS)
    return machine


#: What the last layer writes, as the pattern that is scored.
_PATTERNS = {"insult": "insult", "insult_at_target": "insult_at_target", "threatened": "threat", "denied": "denied", "reported": "reported"}


class Matcher:
    """The composed machine over the tokens of a text."""

    def __init__(self, disarmed: frozenset[str] = frozenset(), stems: tuple[str, ...] = ()):
        self.classes = {w: c for w, c in _CLASSES.items() if w not in disarmed}
        self.stems = stems
        self.machine = grammar()
        words = sorted((w for w, c in self.classes.items() if c in ("insult", "threat")), key=len, reverse=True)
        learnt = "".join(f"|{re.escape(stem)}[^\\W\\d_]*" for stem in sorted(stems, key=len, reverse=True))
        self.trigger = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(map(re.escape, words))}{learnt})(?![^\W\d_])")

    def matches(self, text: str | None) -> Iterator[tuple[str, int]]:
        """Patterns that match in the clauses of a whole text, with their places.

        Clauses without an insult or a verb of threat cannot match, so only clauses
        around such words are walked.  A word with a learnt stem is an insult of the corpus:
        denied or reported it counts as any other.
        """
        low = (text or "").lower()
        done = 0
        for hit in self.trigger.finditer(low):
            if hit.start() < done:
                continue
            at = max(low.rfind(end, done, hit.start()) for end in _END) + 1
            at = max(at, done)
            state = self.machine.start
            for token in _SIGN.finditer(low, at):
                word = token.group()
                done = token.end()
                if word[0] in _END:
                    if token.start() > hit.start():
                        break
                    state = self.machine.start
                    continue
                symbol = "quote" if len(word) == 1 and not word.isalpha() else self.classes.get(word, "other")
                stem = symbol == "other" and word.startswith(self.stems)
                state, out = self.machine.move(state, "insult" if stem else symbol)
                if pattern := _PATTERNS.get(out):
                    yield "stem" if stem and pattern.startswith("insult") else pattern, token.start()
            else:
                done = len(low)

    def match(self, text: str | None) -> Counter:
        return Counter(pattern for pattern, _ in self.matches(text))

    def counts(self, text: str | None) -> list[float]:
        """Matches by pattern, stems in the densest stretch of each of ``STRETCHES``, and the length."""
        found, places = Counter(), []
        for pattern, at in self.matches(text):
            found[pattern] += 1
            if pattern == "stem":
                places.append(at)
        found["insult"] += found["insult_at_target"]
        size = len(text or "")
        return [*(float(found[p]) for p in PRIOR), *(float(densest(places, min(s, size))) for s in STRETCHES), float(size)]

    def armed_words(self, text: str | None) -> list[str]:
        return sorted(set(self.trigger.findall((text or "").lower())))


def densest(places: list[int], size: int) -> int:
    """The most of these ascending places in any stretch of ``size`` characters."""
    most = first = 0
    for last, at in enumerate(places):
        while at - places[first] >= size and first < last:
            first += 1
        most = max(most, last - first + 1)
    return most


@dataclass
class Model:
    """Score = logistic of bias + weights x features."""

    weights: np.ndarray = field(default_factory=lambda: np.array(list(PRIOR.values())))
    bias: float = PRIOR_BIAS
    disarmed: frozenset[str] = frozenset()
    stems: tuple[str, ...] = ()
    #: Matches of stems that a character of clean text has by chance.
    chance: float = LEAST_CHANCE
    rare: float = 1.0

    def matcher(self) -> Matcher:
        return Matcher(self.disarmed, self.stems)

    def score(self, matcher: Matcher, text: str | None) -> float:
        z = self.bias + float(self.weights @ features(np.array([matcher.counts(text)]), self.chance * self.rare)[0])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def features(counts: np.ndarray, chance: float) -> np.ndarray:
    """log(1 + 9 matches), since one says most; for stems log(1 + surprise) of the most
    surprising stretch.

    The surprise of n stems in a stretch is Chernoff's bound on the logarithm of their
    chance, less that of the number of such stretches in the text.  A few insults close
    together so weigh as much in a long text as in a short one, and the same number strewn
    over it weighs little.
    """
    patterns = counts[:, : len(PRIOR)]
    size = counts[:, -1:]
    hits = counts[:, len(PRIOR) : -1]
    stretch = np.minimum(np.array(STRETCHES, float)[None, :], np.maximum(size, 1))
    mean = np.maximum(chance, LEAST_CHANCE) * stretch
    more = np.maximum(hits, mean)
    surprise = more * np.log(more / mean) - more + mean - np.log(np.maximum(size, 1) / stretch)
    x = np.log1p(9 * patterns)
    x[:, -1] = np.log1p(np.maximum(surprise, 0).max(1))  # "stem" is the last pattern
    return x


def prefixes(text: str | None) -> list[str]:
    """Distinct stems of a text's words, each with a bar and the word."""
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    return [f"{word[:n]}|{word}" for word in words for n in STEM_LETTERS if len(word) > n]


def learn_stems(rows: DataFrame, known: Matcher) -> tuple[str, ...]:
    """Stems that mark toxic documents in which the grammar's own words do not occur.

    Insults of the corpus are told from its other words by their labels: a stem counts if
    it occurs in several forms (which one text and its copies do not show) and, by a
    Chernoff bound over all candidates, not by chance in toxic documents.  Counting is a
    grouping of the drawn documents; few stems pass.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}
        totals = [0, 0]
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                if known.armed_words(text):
                    continue
                totals = [totals[0] + label, totals[1] + 1]
                for p in prefixes(text):
                    pos, n = seen.get(p, (0, 0))
                    seen[p] = [pos + label, n + 1]
                if len(seen) > HELD_PREFIXES:
                    yield frame(seen)
                    seen = {}
        yield frame(seen | {"": totals})

    def frame(seen: dict[str, list[int]]) -> pd.DataFrame:
        return pd.DataFrame([(p, *c) for p, c in seen.items()], columns=["p", "pos", "n"])

    by_form = saved(rows.mapInPandas(count, "p string, pos long, n long").groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")))
    toxic, total = by_form.where("p = ''").agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not toxic or toxic == total:
        return ()
    stem = F.substring_index("p", "|", 1)
    seen = by_form.where("p != ''").groupBy(stem.alias("stem")).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.count_if(F.col("pos") > 0).alias("forms"))
    share, rate = F.col("pos") / F.col("n"), toxic / total
    candidates = seen.where(F.col("forms") >= STEM_FORMS)
    bound = float(np.log(max(1, candidates.count()) / STEM_CHANCE))
    gain = F.col("n") * (share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    strong = candidates.where((share >= 0.8) & (gain >= bound)).select("stem", gain.alias("gain"))
    chosen: list[str] = []
    for row in strong.orderBy(F.desc("gain"), "stem").limit(20 * MOST_STEMS).collect():
        if not any(row["stem"].startswith(c) or c.startswith(row["stem"]) for c in chosen) and len(chosen) < MOST_STEMS:
            chosen.append(row["stem"])
    return tuple(sorted(chosen))


def fit(features: np.ndarray, labels: np.ndarray, pull: float = 0.05, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method, pulled towards the prior weights and held in ``BOUNDS``.

    Without rows the prior stays.  The pull is that of ``pull`` rows per class and
    weight; it holds the weights of patterns that the labels do not show.
    """
    prior = np.array([*PRIOR.values(), PRIOR_BIAS])
    low, high = (np.array([*(BOUNDS[p][side] for p in PRIOR), (-40, 40)[side]], float) for side in (0, 1))
    x = np.hstack([features, np.ones((len(features), 1))])
    beta = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - labels) + pull * (beta - prior)
        hessian = (x.T * (p * (1 - p))) @ x + pull * np.eye(len(beta))
        # A weight at its bound stays there while the gradient points outwards.
        free = ~(((beta <= low) & (gradient > 0)) | ((beta >= high) & (gradient < 0)))
        move = np.zeros(len(beta))
        move[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
        before = beta
        beta = np.clip(beta - move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12)), low, high)
        if np.abs(beta - before).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def learn_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit the weights of the patterns on a bounded draw of labelled documents.

    Stems that mark toxic documents are learnt first and count as insults of the corpus.
    A word of the grammar that is seen in at least five clean documents and is no
    likelier in toxic ones is disarmed: in this corpus it is no insult.

    Edge cases: null texts match nothing; labels that are null or neither 0 nor 1, and those
    of unknown, null or held-out identifiers, teach nothing; an identifier that repeats
    teaches with each of its texts; without labels of both kinds the prior weights stay.
    """

    drawn = saved(training_rows(docs, labels, label_col, id_col, text_col))
    stems = learn_stems(drawn, Matcher())

    @F.pandas_udf("counts array<double>, words array<string>")
    def matched(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher, plain = Matcher(stems=stems), Matcher()
        for batch in texts:
            yield pd.DataFrame({"counts": [matcher.counts(t) for t in batch], "words": [plain.armed_words(t) for t in batch]})

    rows = drawn.select(matched("text").alias("m"), "label").select("m.counts", "m.words", "label").collect()
    toxic = sum(r["label"] for r in rows)
    seen = [Counter(w for r in rows if r["label"] == k for w in r["words"]) for k in (0, 1)]
    tame = {w for w, n in seen[0].items() if n >= 5 and seen[1][w] / max(1, toxic) <= n / max(1, len(rows) - toxic)}
    model = Model(disarmed=frozenset(tame), stems=stems)
    # The counts of documents that hold a tame word change; those rows stay out of the fit.
    rows = [r for r in rows if not tame & set(r["words"])]
    if rows and 0 < sum(r["label"] for r in rows) < len(rows):
        x = np.array(sorted((*r["counts"], r["label"]) for r in rows))
        clean, stem = x[x[:, -1] == 0], list(PRIOR).index("stem")
        model.chance = max(LEAST_CHANCE, float(clean[:, stem].sum() / max(1.0, clean[:, -2].sum())))
        model.rare = best_rarity(x[:, :-1], x[:, -1], model.chance)
        model.weights, model.bias = fit(features(x[:, :-1], model.chance * model.rare), x[:, -1])
        threat = list(PRIOR).index("threat")
        if not clean[:, threat].any():
            needed = (np.log(DECISIVE / (1 - DECISIVE)) - model.bias) / np.log(10)
            model.weights[threat] = max(model.weights[threat], needed)
    return model


def best_rarity(counts: np.ndarray, labels: np.ndarray, chance: float) -> float:
    """The factor of ``RARE_LANGUAGE`` with the least cross-entropy on rows left out of the fit,
    by ``FOLDS`` folds dealt by the rows' own order; of equals the least."""
    fold = np.arange(len(labels)) % FOLDS

    def loss(rare: float) -> float:
        x, total = features(counts, chance * rare), 0.0
        for k in range(FOLDS):
            weights, bias = fit(x[fold != k], labels[fold != k])
            z = np.clip(x[fold == k] @ weights + bias, -40, 40)
            total += float(np.logaddexp(0, np.where(labels[fold == k] == 1, -z, z)).sum())
        return round(total, 6)

    return float(min(RARE_LANGUAGE, key=lambda rare: (loss(rare), rare)))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Score every whole text where it lies.

    Method: words become symbols (insult, threat, target, negation, verb of saying and
    so on); transducers for negation, reported speech, threats and insults at a target
    are composed into one machine, which walks every clause that could match.  Matches
    are counted by pattern and weighed: a denied or reported insult weighs little, a
    threat or an insult at its target more.

    Returns identifier, ``held_out``, ``score`` and ``predicted``.

    Edge cases: null and empty texts match nothing and score the bias; null
    identifiers are not held out; repeated rows score alike; an empty table gives an
    empty result.
    """
    return scored(docs, toxicity(docs, model, text_col), id_col, threshold)


def toxicity(docs: DataFrame, model: Model, text_col: str = "text"):
    """The score as a column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = shared.value.matcher()
        for batch in texts:
            yield pd.Series([shared.value.score(matcher, t) for t in batch], dtype="float64")

    return score(docs[text_col])


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text_col: str = "text", **columns) -> DataFrame:
    """The documents that score below the threshold, with the columns they came with.

    Edge cases: those of :func:`learn_toxicity` and :func:`score_toxicity`; null and empty
    texts stay, unless the labels make an empty text toxic; repeated rows stay or go together.
    """
    model = learn_toxicity(docs, labels, text_col=text_col, **columns)
    return docs.where(toxicity(docs, model, text_col) < threshold)
