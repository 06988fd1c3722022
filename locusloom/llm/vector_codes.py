"""Vector code compression: codebooks of vector parts by Lloyd rounds with grouped lower bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_SENT, drop_saved, saved

#: Components become ``floor(SCALE * x)``; beyond ``LARGEST`` they saturate, so that the squared
#: distance of parts of up to 512 components is exact in 64-bit floats and integers alike.
SCALE, LARGEST = 1024, 1 << 20
#: Groups of entries for each part; a vector keeps one lower bound for each.
GROUPS = 16
#: Vectors whose distances are held at once.
CHUNK = 4096
#: Copies of the error totals where one label may hold many rows.
SALTS = 32


@dataclass
class Books:
    """``entries`` (parts x entries x components, integers), the ``group`` of every entry, how far
    each group's entries moved at most since the last round (``drift``), None at first."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray | None = None


def kept_vectors(rows: DataFrame, vec_col: str, parts: int) -> DataFrame:
    """Rows with usable vectors and ``vec``, their integer components, padded with zeros to
    the longest length that ``parts`` divides."""
    x = F.col(vec_col).cast("array<double>")
    usable = F.col(vec_col).isNotNull() & F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), v * SCALE))).cast("int"))
    kept = rows.where(usable)
    longest = max(1, kept.agg(F.max(F.size(vec_col))).head()[0] or 0)
    width = -(-longest // parts) * parts
    return kept.withColumn("vec", F.concat(whole, F.array_repeat(F.lit(0), F.lit(width) - F.size(vec_col))))


def grouped(entries: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """Deal one part's entries into groups of near ones, by a few Lloyd rounds of their own."""
    points = entries.astype(np.float64)
    centres = points[np.linspace(0, len(points) - 1, min(groups, len(points))).astype(int)]
    for _ in range(rounds):
        near = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([points[near == g].mean(0) if (near == g).any() else c for g, c in enumerate(centres)])
    return near


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; exact while they stay below 2**53."""
    a, b = x.astype(np.float64), entries.astype(np.float64)
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def _exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x.astype(np.int64) - entries.astype(np.int64)) ** 2).sum(-1)


def assign(x: np.ndarray, entries: np.ndarray, group: np.ndarray, code: np.ndarray | None, bound: np.ndarray | None, drift: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of one part for a chunk of vectors: codes, errors, bounds, distances made.

    ``bound[i, g]`` is at most the distance from vector i to any entry of group g but its own.
    Less the group's drift it still holds; a group is scanned for those vectors only whose
    bound is not above the distance to their own entry.  Candidates that floats do not tell
    apart are compared in integers, ties to the lower index.
    """
    n, groups = len(x), int(group.max()) + 1
    made = 0
    if code is None:
        code, own = np.full(n, -1), np.full(n, np.inf)
        bound = np.zeros((n, groups))
    else:
        own = _exact(x, entries[code]).astype(np.float64)
        bound = np.maximum(bound.astype(np.float64) - drift, 0)
        made += n
    best, best_code = own, code.copy()
    for g in range(groups):
        members = np.flatnonzero(group == g)
        asks = np.flatnonzero(bound[:, g] <= np.sqrt(best) * (1 + 1e-9))
        if not len(asks) or not len(members):
            continue
        found = _distances(x[asks], entries[members])
        made += found.size
        slack = 1e-12 * (found.max(1) + 1)
        least = found.min(1)
        # Integers decide where several entries come within the rounding of floats.
        close = found <= least[:, None] + slack[:, None]
        at = close.argmax(1)
        tied = np.flatnonzero(close.sum(1) > 1)
        for some in np.array_split(tied, -(-len(tied) // 256)) if len(tied) else ():
            at[some] = np.where(close[some], _exact(x[asks[some], None], entries[members]), np.iinfo(np.int64).max).argmin(1)
        chosen = members[at]
        exact = _exact(x[asks], entries[chosen]).astype(np.float64)
        better = (exact < best[asks]) | ((exact == best[asks]) & (chosen < best_code[asks]))
        # The bound of a scanned group leaves out its nearest entry for now.
        rest = found.copy()
        rest[np.arange(len(asks)), at] = np.inf
        bound[asks, g] = np.sqrt(rest.min(1))
        lost = ~better & (chosen != best_code[asks])
        bound[asks[lost], g] = np.minimum(bound[asks[lost], g], np.sqrt(exact[lost]))
        # Whoever was best before bounds its own group from now on.
        moved = asks[better & (best_code[asks] >= 0)]
        before = group[best_code[moved]]
        bound[moved, before] = np.minimum(bound[moved, before], np.sqrt(best[moved]))
        best[asks[better]], best_code[asks[better]] = exact[better], chosen[better]
    return best_code, best.astype(np.int64), bound * (1 - 1e-9), made


def assign_all(rows: DataFrame, books: Books) -> DataFrame:
    """Every row with its ``codes``, their ``errors`` and the ``bounds`` for the next round.

    ``rows`` has ``row`` (carried along) and ``vec``, after the first round also what the
    last one made.  ``made`` counts distances computed, of those that a full scan makes.
    """
    sent = rows.sparkSession.sparkContext.broadcast(books)
    seen = "codes" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        parts, _, width = now.entries.shape
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(start, CHUNK)
                n = piece.num_rows
                x = piece["vec"].flatten().to_numpy().reshape(n, parts, width)
                codes = piece["codes"].flatten().to_numpy().reshape(n, parts) if seen else None
                bounds = piece["bounds"].flatten().to_numpy().reshape(n, parts, -1) if seen else None
                done = [assign(x[:, p], now.entries[p], now.group[p], codes[:, p] if seen else None, _own(bounds, now, p), now.drift[p][: _count(now, p)] if seen else None) for p in range(parts)]
                most = max(_count(now, p) for p in range(parts))
                low = np.stack([np.pad(b, ((0, 0), (0, most - b.shape[1]))) for _, _, b, _ in done], 1)
                low = np.nextafter(low.astype(np.float32), np.float32(-np.inf))
                made = np.zeros(n, np.int64)
                made[0] = sum(d[3] for d in done)
                columns = [piece["row"], piece["vec"], _lists(np.stack([d[0] for d in done], 1).astype(np.int32)), _lists(np.stack([d[1] for d in done], 1)), _lists(low.reshape(n, -1)), pa.array(made)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "vec", "codes", "errors", "bounds", "made"])

    kind = rows.schema["row"].dataType.simpleString()
    wanted = ["row", "vec", *(["codes", "bounds"] if seen else [])]
    return rows.select(*wanted).mapInArrow(run, f"row {kind}, vec array<int>, codes array<int>, errors array<long>, bounds array<float>, made long")


def _count(books: Books, part: int) -> int:
    return int(books.group[part].max()) + 1


def _own(bounds: np.ndarray | None, books: Books, part: int) -> np.ndarray | None:
    return None if bounds is None else bounds[:, part, : _count(books, part)]


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(values.reshape(-1)))


def _sums(assigned: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Componentwise sums and counts of every entry's parts.  Tasks add up first: what they
    send, and what reaches the driver, is one row an entry."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in batches:
            x = batch["vec"].flatten().to_numpy().reshape(batch.num_rows, parts, width)
            codes = batch["codes"].flatten().to_numpy().reshape(batch.num_rows, parts)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], x[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), _lists(sums[part, entry])], ["part", "entry", "n", "sums"])

    each = assigned.select("vec", "codes").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    wide = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
    for r in wide.collect():
        sums[r["part"], r["entry"]], counts[r["part"], r["entry"]] = r["sums"], r["n"]
    return sums, counts


def _moved(books: Books, sums: np.ndarray, counts: np.ndarray) -> Books:
    """Entries at the floor of their parts' means; unused ones stay."""
    used = counts > 0
    entries = np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], books.entries)
    steps = np.sqrt(((entries - books.entries).astype(np.float64) ** 2).sum(2)) * (1 + 1e-9)
    drift = np.zeros((len(entries), int(books.group.max()) + 1))
    for p, of in enumerate(books.group):
        np.maximum.at(drift[p], of, steps[p])
    return Books(entries, books.group, drift)


@dataclass
class Compressed:
    """``rows``: ``row``, ``codes`` (an index for each part) and ``error``; the final ``entries``
    (parts x entries x components); ``scanned``, the share of distances computed, by round."""

    rows: DataFrame
    entries: np.ndarray
    scanned: list[float]

    def sha256(self) -> str:
        """Of all components' decimals, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def compress_vectors(rows: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> Compressed:
    """Replace each of a vector's ``parts`` by the index of the nearest entry of its codebook.

    Method: Lloyd rounds with the bounds of Ding et al. (2015).  A codebook's entries are
    dealt into ``GROUPS`` groups once.  Every vector keeps its code and one lower bound for
    each group; when entries move, a group's bound falls by its largest move, and only groups
    whose bound no longer clears the distance to the vector's own entry are scanned.  Errors,
    sums and ties are integers.  Vectors and bounds stay where they lie, written after each
    round; codebooks (``parts x entries`` rows, whatever the input) are broadcast.

    A column ``row`` of the result is a struct of all columns of the input but the vector.

    Edge cases: vectors that are null or hold null or non-finite components are left out;
    shorter ones are padded with zeros to the longest, empty ones are all zeros; components
    beyond ``LARGEST`` / ``SCALE`` = 1,024 saturate; null identifiers come last when codebooks
    begin, rows alike in identifier go by their components, and each has a code; fewer rows
    than entries make smaller codebooks; without rows there are no codes and no entries.
    """
    others = [F.col(f"`{c}`") for c in rows.columns if c != vec_col]
    whole = saved(kept_vectors(rows.select(*others, vec_col), vec_col, parts).select(F.struct(*others).alias("row"), "vec"))
    first = whole.orderBy(F.col(f"row.`{id_col}`").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    if not first:
        return Compressed(whole.select("row", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64), [])
    start = np.array([r["vec"] for r in first], np.int64)
    start = start.reshape(len(start), parts, -1).transpose(1, 0, 2)
    books = Books(start, np.array([grouped(e) for e in start]))
    now, scanned, total = whole, [], whole.count() * parts * len(first)
    for turn in range(rounds + 1):
        after = saved(assign_all(now, books))
        drop_saved(now)
        now = after
        scanned.append((now.agg(F.sum("made")).head()[0]) / total)
        if turn < rounds:
            books = _moved(books, *_sums(now, books.entries.shape))
    error = F.aggregate("errors", F.lit(0).cast("long"), lambda a, e: a + e)
    return Compressed(now.select("row", "codes", error.alias("error")), books.entries, scanned)


def with_totals(rows: DataFrame, label: Column, value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over rows of one label, nulls together.

    Totals are summed before they travel.  A small table of them is broadcast; else each total
    has ``SALTS`` copies, so that a label with a third of all rows is many tasks' work.
    """
    marked = rows.withColumn("__label", label)
    totals = saved(marked.groupBy("__label").agg(F.sum(value).alias(name)).withColumnRenamed("__label", "__of"))
    if totals.count() <= MOST_SENT:
        return marked.join(F.broadcast(totals), F.col("__label").eqNullSafe(F.col("__of"))).drop("__label", "__of")
    totals = totals.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    marked = marked.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    met = F.col("__label").eqNullSafe(F.col("__of")) & (F.col("__salt") == F.col("__copy"))
    return marked.join(totals, met).drop("__label", "__of", "__salt", "__copy")
