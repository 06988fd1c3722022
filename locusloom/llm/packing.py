"""Packing token sequences into windows through a hierarchy of length tiers."""

from __future__ import annotations

import bisect
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, shuffle_partitions, uniform
from .tokens import Encoder, _Cache, in_worker, read_vocabulary

#: The most pieces of one length in one slice of the ranking; fewer where tasks are many.
SLICE_ROWS = 50_000
#: Sequences of one step group at full window; shorter tiers take as many more, so tokens are alike.
STEP_SEQUENCES = 64
#: The largest layout that is broadcast; a larger one is joined by length.
MOST_SLOTS = 100_000
#: The shortest context size that tiers halve down to.
LEAST_TIER = 256


@dataclass(frozen=True)
class Slot:
    """Pieces ``lo <= rank < hi`` of one length: ``each`` to a sequence of size ``tier``, from ``sequence`` on."""

    length: int
    lo: int
    hi: int
    each: int
    sequence: int
    offset: int
    tier: int


def tiers_of(window: int) -> list[int]:
    """Context sizes from ``window`` down, each half of the one before."""
    sizes = [window]
    while sizes[-1] % 2 == 0 and sizes[-1] // 2 >= LEAST_TIER:
        sizes.append(sizes[-1] // 2)
    return sizes


def plan_windows(counts: dict[int, int], window: int) -> tuple[list[Slot], int]:
    """Lay out windows for so many pieces of each length.

    A piece is routed to the shortest of :func:`tiers_of` that holds it.  Each tier,
    longest first, puts its pieces, longest first, in the smallest fitting gap that
    sequences opened so far have left, those of longer tiers too, and opens sequences
    of its own size for the rest.  A sequence of a shorter tier that has not become
    full is dissolved at the end: its pieces fill gaps of windows and new windows, so
    only windows are padded.  All is arithmetic on whole groups of alike
    sequences: work and result depend on the number of lengths, ``window`` at most,
    not on the number of pieces.  Sequences are numbered by tier, then by fullness.
    """
    groups: dict[int, list[tuple[int, tuple[tuple[int, int], ...], int]]] = {}  # gap -> [(tier, contents, windows)]
    gaps: list[int] = []

    def add(tier: int, gap: int, contents: tuple, windows: int) -> None:
        if windows:
            if gap not in groups:
                bisect.insort(gaps, gap)
                groups[gap] = []
            groups[gap].append((tier, contents, windows))

    def place(tier: int, length: int, left: int) -> None:
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = tier // length
                add(tier, tier - each * length, ((length, each),), left // each)
                rest = left % each
                add(tier, tier - rest * length, ((length, rest),), 1 if rest else 0)
                return
            gap = gaps[at]
            size, contents, windows = groups[gap].pop()
            if not groups[gap]:
                del groups[gap], gaps[at]
            each = min(gap // length, max(1, left // windows))
            used = min(windows, left // each)
            add(size, gap, contents, windows - used)
            add(size, gap - each * length, (*contents, (length, each)), used)
            left -= used * each

    tiers = tiers_of(window)
    for tier, below in zip(tiers, [*tiers[1:], 0], strict=True):
        for length in range(tier, below, -1):
            if counts.get(length):
                place(tier, length, counts[length])

    # Shorter tiers keep their full sequences; what the others hold goes into windows.
    back: dict[int, int] = {}
    for gap in list(gaps):
        for tier, contents, windows in groups[gap]:
            if gap and tier < window:
                for length, each in contents:
                    back[length] = back.get(length, 0) + each * windows
        groups[gap] = [group for group in groups[gap] if not gap or group[0] == window]
        if not groups[gap]:
            del groups[gap]
            gaps.remove(gap)
    for length in sorted(back, reverse=True):
        place(window, length, back[length])

    slots, ranks, sequence = [], dict.fromkeys(counts, 0), 0
    laid = [(-tier, gap, contents, windows) for gap in sorted(groups) for tier, contents, windows in groups[gap]]
    for tier, _, contents, windows in sorted(laid, key=lambda group: group[:2]):
        offset = 0
        for length, each in contents:
            lo = ranks[length]
            ranks[length] = hi = lo + each * windows
            slots.append(Slot(length, lo, hi, each, sequence, offset, -tier))
            offset += each * length
        sequence += windows
    return slots, sequence


def tier_steps(slots: list[Slot], sequences: int, window: int) -> dict[int, tuple[int, int, int]]:
    """By tier: its first sequence, its first step group and its number of step groups."""
    firsts: dict[int, int] = {}
    for slot in slots:
        firsts[slot.tier] = min(slot.sequence, firsts.get(slot.tier, slot.sequence))
    order, steps, out = sorted(firsts, reverse=True), 0, {}
    for tier, end in zip(order, [*[firsts[t] for t in order[1:]], sequences], strict=False):
        own = -(-(end - firsts[tier]) * tier // (STEP_SEQUENCES * window))
        out[tier] = (firsts[tier], steps, own)
        steps += own
    return out


def token_pieces(docs: DataFrame, vocabulary_path: str, window: int, end_id: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """Encode every document and cut it into full windows and one remainder."""
    shared, name = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path)), uuid.uuid4().hex
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    )
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            own = Encoder(shared.value)
            return own, _Cache(lambda p: np.array(own.merge(p), "<u4").tobytes(), {})

        own, ids_of = in_worker(name, make)
        for batch in batches:
            rows, starts, lengths, sums, totals, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                pieces = own.pieces(text or "")
                ids = np.array(own.whole(text), "<u4").tobytes() if pieces is None else b"".join(map(ids_of.__getitem__, pieces))
                ids += end
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    rows.append(row)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    totals.append(len(ids) // 4)
                    if with_ids:
                        kept.append(part)
            numbers = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *numbers, *([pa.array(kept, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, vocabulary_path: str, window: int = 2048, end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document's tokens into sequences of ``window`` tokens at most.

    Method: documents are encoded where they lie.  One longer than the window gives
    full windows and a remainder; a shorter one stays whole.  The counts of pieces by
    length (``window`` rows at most) are laid out by :func:`plan_windows`: each piece
    is routed to a context size, gaps of longer tiers are filled from shorter ones.  Each piece then finds its
    place from its rank among the pieces of its length: ranks are prefix sums over
    slices of a hash, with as many slices as a length has pieces, because most pieces
    of long documents have the one length ``window``.  Sequences of a tier are numbered
    from the fullest to the least full and dealt in turn to the step groups of that tier,
    each of about ``STEP_SEQUENCES`` windows' tokens, so a step has one context size.

    Returns one row per piece: identifier, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``, ``step``, ``tier`` (the size of the
    sequence) and, unless ``with_ids`` is
    off, ``ids`` (little-endian unsigned 32-bit).

    Edge cases: a null text is empty and has the end id alone; rows that repeat an
    identifier are packed each for itself; null identifiers are carried along; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    # The place of a piece spreads those that agree in identifier and ids, or have no identifier.
    pieces = saved(token_pieces(docs, vocabulary_path, window, end_id, with_ids, id_col, text_col).withColumn("place", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, sequences = plan_windows(counts, window)
    rows = max(500, min(SLICE_ROWS, sum(counts.values()) // (4 * shuffle_partitions(spark))))
    per_length = spark.createDataFrame([(n, max(1, -(-c // rows))) for n, c in counts.items()], "length long, slices long")
    of_tier = tier_steps(slots, sequences, window)
    layout = spark.createDataFrame(
        [(s.length, s.lo, s.hi, s.each, s.sequence, s.offset, s.tier, *of_tier[s.tier]) for s in slots],
        "length long, lo long, hi long, each long, sequence long, first long, tier long, tier_sequence long, tier_step long, steps long",
    )
    layout = layout.withColumnRenamed("length", "of")
    layout = F.broadcast(layout) if len(slots) <= MOST_SLOTS else layout

    hashed = F.xxhash64("id", "start", "ids_crc32", "place")
    sliced = pieces.join(F.broadcast(per_length), "length").withColumn("slice", F.floor(uniform(hashed) * F.col("slices")))
    before = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy("length").orderBy("slice")
    before = before.select("length", "slice", (F.sum("n").over(in_order) - F.col("n")).alias("earlier"))
    within = Window.partitionBy("length", "slice").orderBy(hashed, "id", "start", "ids_crc32", "place")
    ranked = sliced.withColumn("nth", F.row_number().over(within) - 1).join(before, ["length", "slice"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    place = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    found = ranked.join(layout, (F.col("length") == F.col("of")) & place)
    nth = F.col("rank") - F.col("lo")
    sequence = F.col("sequence") + F.floor(nth / F.col("each"))
    return found.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        sequence.cast("long").alias("sequence_id"),
        (F.col("first") + (nth % F.col("each")) * F.col("length")).alias("offset"),
        (F.col("tier_step") + (sequence - F.col("tier_sequence")) % F.col("steps")).cast("long").alias("step"), "tier",
        *(["ids"] if with_ids else []),
    )


def padding_by_tier(packed: DataFrame, window: int = 2048) -> DataFrame:
    """Sequences, tokens and share of padding of each tier of a packing.

    A sequence is padded to ``window`` unless its tokens are a power of two.
    """
    filled = packed.groupBy("tier", "sequence_id").agg(F.sum("length").alias("tokens"))
    whole = F.bit_count(F.col("tokens")) == 1
    size = F.when(whole, F.col("tokens")).otherwise(F.lit(window))
    sums = filled.groupBy("tier").agg(F.count(F.lit(1)).alias("sequences"), F.sum("tokens").alias("tokens"), F.sum(size).alias("size"))
    return sums.select("tier", "sequences", "tokens", (1 - F.col("tokens") / F.col("size")).alias("padding"))
