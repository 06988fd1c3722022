"""Near copies by shared word shingles: min-hash bands, sketches, exact Jaccard check, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_SENT, drop_saved, keep_one, row_order, saved
from .components import components
from .simhash import _LOWER, SEED, fingerprint, fingerprint_links

#: Pairs at Jaccard 0.8 share a band with probability 1 - (1 - 0.8**7)**32 = 0.9995, those at
#: 0.4 with 0.05.
BANDS, ROWS = 32, 7
#: A sketch has four bits of every min-hash, sixteen to a number.
SKETCH = BANDS * ROWS // 16
#: Deviations below the expected agreement at which a sketch still passes (chance to lose a
#: pair at the similarity: 0.0003).
SLACK = 3.4
#: Shingles that are hashed at once, which bounds a task's memory for any text.
CHUNK = 1 << 8
#: Texts whose sets a task holds at once.
SET_ROWS = 256
#: Buckets of more nodes than this have a leader.
CROWD = 8

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; fewer words make one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    total, digest, join = max(1, len(words) - width + 1), xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((digest(join(words[i : i + width]), SEED) for i in range(total)), np.uint64, total))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of ``BANDS * ROWS`` hashes over a set; the greatest number if empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        np.minimum(least, (shingles[at : at + CHUNK, None] * _FACTORS + _SHIFTS).min(0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band of min-hashes."""
    # The band's number is the seed, so one key names band and bits.
    return np.array([xxhash.xxh64_intdigest(bits.tobytes(), band) for band, bits in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """The last four bits of every min-hash, sixteen to a signed 64-bit number."""
    shifts = np.arange(0, 64, 4, dtype=np.uint64)
    return ((least & np.uint64(15)).reshape(SKETCH, 16) << shifts).sum(1, dtype=np.uint64).view(np.int64)


def _marks(text: Column, width: int) -> Column:
    """``node`` (digest of the text's set), ``n`` (its size), ``bands`` and ``sketch``; sets are not kept."""

    def mark(text: str | None) -> tuple:
        found = shingle_set(text, width)
        least = min_hashes(found)
        return hashlib.md5(found.tobytes()).digest(), len(found), band_keys(least), sketch(least)

    @F.pandas_udf("node binary, n int, bands array<long>, sketch array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([mark(t) for t in batch], columns=["node", "n", "bands", "sketch"])

    return of(text)


def _sketches_agree(a: str, b: str, similarity: float) -> Column:
    """Whether two sketches agree as often as all but a few of sets at the similarity do.

    Unlike min-hashes agree in four bits once in 16 times.  Columns and bit operations only.
    """
    total, chance = BANDS * ROWS, similarity + (1 - similarity) / 16
    most = int(total * (1 - chance) + SLACK * (total * chance * (1 - chance)) ** 0.5)
    low = F.lit(0x1111111111111111)
    differ = F.lit(0)
    for i in range(SKETCH):
        bits = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        differ = differ + F.bit_count(bits.bitwiseOR(F.shiftrightunsigned(bits, 2)).bitwiseAND(low))
    return differ <= most


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """``node`` and ``set`` (hashes as signed numbers), few texts at a time."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SET_ROWS):
                part = batch.slice(at, SET_ROWS)
                sets = [shingle_set(t, width).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, np.concatenate(sets))], ["node", "set"])

    return texts.select("node", "text").mapInArrow(make, "node binary, set array<long>")


def _alike(a: str, b: str, similarity: float) -> Column:
    """Whether two sets of these sizes can reach the similarity at all."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have at least this Jaccard similarity."""
    a, b = sets.select(F.col("node").alias("a"), F.col("set").alias("of_a")), sets.select(F.col("node").alias("b"), F.col("set").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    met = pairs.join(a, "a").join(b, "b")
    return met.where(both >= similarity * (F.size("of_a") + F.size("of_b") - both) - 1e-9).select("a", "b")


def shingle_links(sides: DataFrame, sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Links of nodes that share a band and reach the similarity, as far as components need them.

    ``sides`` has ``node``, ``n`` (its set's size), ``bands``, ``sketch`` and ``bits`` (the key
    of one of its bands) with ``many``, the nodes that have it; ``sets`` has ``node`` and ``set``.  In buckets of more than ``CROWD``
    nodes every node is first held against the one whose buckets are fullest, as the centre of
    a group of copies is; those alike link to it.  Afterwards only pairs that these links do
    not connect are compared, in the first band they share, and only those whose sketches
    agree: all that is decided inside the join, so a group costs rows for its members and for
    pairs near the similarity, not for its pairs, and no link between others is left out.
    """
    crowds = sides.groupBy("node").agg(F.sum("many").alias("around"))
    led = saved(sides.where(F.col("many") > CROWD).select("bits", "node", "n", "sketch").join(crowds, "node"))
    leads = led.groupBy("bits").agg(F.max(F.struct("around", "node", "n", "sketch")).alias("lead"))
    asked = led.join(leads, "bits").where((F.col("node") != F.col("lead.node")) & _alike("n", "lead.n", similarity))
    asked = asked.select("*", F.col("lead.sketch").alias("lead_sketch")).where(_sketches_agree("sketch", "lead_sketch", similarity))
    near = saved(_verified(asked.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct(), sets, similarity))
    follows = components(near).withColumnRenamed("component", "leader")
    all_led = saved(sides.join(follows, "node", "left").select("node", "n", "bits", "bands", "sketch", F.coalesce("leader", "node").alias("leader")))
    mixed = all_led.groupBy("bits").agg(F.min("leader").alias("first"), F.max("leader").alias("last")).where("first != last").select("bits")
    rest = saved(all_led.join(mixed, "bits"))
    drop_saved(all_led)
    a, b = (rest.select(*[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "leader", "bands", "sketch")], "bits") for side in "ab")
    other = (F.col("a_node") < F.col("b_node")) & (F.col("a_leader") != F.col("b_leader")) & _alike("a_n", "b_n", similarity)
    once = F.col("bits") == F.array_intersect("a_bands", "b_bands")[0]
    pairs = a.join(b, "bits").where(other & _sketches_agree("a_sketch", "b_sketch", similarity) & once).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return saved(near.union(_verified(pairs, sets, similarity)))


def drop_shingle_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, distance: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group whose word-shingle sets are alike, with the columns it came with.

    Method: every text gives the set of its lower-case ``width``-word shingles, and of its
    min-hashes ``BANDS`` band keys and a sketch.  Texts with one set are one node.  Nodes that
    share a band, and whose sketches agree, are compared by the exact Jaccard similarity of
    their sets (of 64-bit hashes), those that reach ``similarity`` are linked, and of each
    component the row with the smallest identifier stays.  Texts travel only for nodes that
    share a band.  With ``distance``, texts whose fingerprints (see :mod:`.simhash`) differ in
    so many bits or fewer are linked as well, in the same graph.

    Edge cases: texts without words are left as they are, unless ``distance`` links them to
    each other; a text shorter than a shingle is one shingle; a null identifier comes after
    all others; of rows alike in identifier and text any one stays; an empty table gives an
    empty result.
    """
    same = F.xxhash64(docs[text_col])
    text = docs[text_col]
    row = [docs[id_col].alias("id"), same.alias("same"), _marks(text, width).alias("m"), (F.lit(0).cast("long") if distance is None else fingerprint(text)).alias("print")]
    marks = saved(docs.select(*row).select("id", "same", "m.*", "print").where(F.lit(distance is not None) | (F.col("n") > 0)))
    nodes = saved(marks.where("n > 0").groupBy("node").agg(F.min(row_order()).alias("lowest"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("print").alias("rep"), F.max("print").alias("last")))
    keys = nodes.select("node", F.explode("bands").alias("bits"))
    shared = keys.groupBy("bits").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    sides = saved(keys.join(shared, "bits").join(nodes.select("node", "n", "bands", "sketch"), "node"))
    wanted = sides.select("node").distinct().join(nodes, "node").select("node", F.col("lowest.id").alias("__id"), F.col("lowest.same").alias("__same"))
    wanted = saved(wanted)
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    found = texts.join(wanted, texts["id"].eqNullSafe(wanted["__id"]) & (F.xxhash64("text") == wanted["__same"]))
    sets = saved(_sets(found.select("node", "text").dropDuplicates(["node"]), width))
    links = shingle_links(sides, sets, similarity)
    if distance is None:
        vertex, of = "node", links
    else:
        # Prints are the vertices: a node stands at its least print, its other prints link to that.
        at = nodes.select("node", "rep")
        a, b = (at.select(F.col("node").alias(c), F.col("rep").alias(f"{c}_at")) for c in "ab")
        several = marks.join(nodes.where("rep != last").select("node", "rep"), "node").select("print", "rep").distinct()
        vertex, of = "print", links.join(a, "a").join(b, "b").select("a_at", "b_at").union(several).union(fingerprint_links(marks.select("print").distinct(), distance))
    groups = components(of)
    lowest = marks.groupBy(F.col(vertex).alias("vertex")).agg(F.min(row_order()).alias("lowest"))
    named = lowest.join(groups, lowest["vertex"] == groups["node"], "left").select("vertex", "lowest", F.coalesce("component", "vertex").alias("component"))
    kept = named.groupBy("component").agg(F.min("lowest").alias("kept"))
    kept = named.join(kept, "component").select("vertex", "kept")
    out = keep_one(docs, marks.join(kept, marks[vertex] == kept["vertex"]).select("id", "same", "kept"), id_col, text_col)
    for table in (marks, nodes, sides, sets):
        drop_saved(table)
    return out
