"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_one, row_order, saved
from .components import components

SEED = 42
BITS = 64
#: Shingles whose bits are counted at once, which bounds a task's memory for any text.
CHUNK = 1 << 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)  # its own bits have the majority
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(words[i:] for i in range(width)), strict=False)
    ones, total = np.zeros(BITS, np.int64), len(words) - width + 1
    for at in range(0, total, CHUNK):
        n = min(CHUNK, total - at)
        hashes = np.fromiter((digest(join(next(shingles)), SEED) for _ in range(n)), np.uint64, n)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(n, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprint(text: Column, width: int = 3) -> Column:
    """The fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            values = np.array([fingerprint_of(t, width) for t in batch], np.uint64)
            yield pd.Series(values.view(np.int64))

    return of(text)


def block_masks(distance: int = 3, blocks: int = 5) -> list[int]:
    """Masks of ``blocks - distance`` blocks, as signed numbers.

    Bits that differ touch ``distance`` blocks at most, so close fingerprints agree in
    all bits of at least one mask.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    whole = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(whole, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def fingerprint_links(prints: DataFrame, distance: int = 3, blocks: int = 5) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints with ``distance`` differing bits or fewer.

    ``prints`` holds each fingerprint once, in column ``print``.  Each gets a row for
    every mask; rows join on mask and masked bits.  A pair that agrees in several masks
    is returned by the first of them only.  Some 26 bits agree in a bucket with the
    default 10 masks, so buckets stay small up to tens of millions of fingerprints;
    more blocks make them smaller still.  Spark splits a bucket that outgrows a task.
    """
    masks = block_masks(distance, blocks)
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("print").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])
    sides = prints.select("print", F.explode(keys).alias("key")).select("print", "key.mask", "key.bits")
    a, b = sides.alias("a"), sides.alias("b")
    differ = F.col("a.print").bitwiseXOR(F.col("b.print"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("mask", "bits")])
    close = (F.col("a.print") < F.col("b.print")) & (F.bit_count(differ) <= distance) & (first == F.col("a.mask"))
    return a.join(b, same & close).select(F.col("a.print").alias("a"), F.col("b.print").alias("b"))


def _marked(docs: DataFrame, width: int, distance: int, blocks: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Every row's ``id``, ``same`` and ``print``; and ``component`` and ``kept`` of every print."""
    marked = saved(docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("same"), fingerprint(docs[text_col], width).alias("print")))
    nodes = saved(marked.groupBy("print").agg(F.min(row_order()).alias("lowest")))
    found = components(fingerprint_links(nodes.select("print"), distance, blocks))
    named = nodes.join(found, nodes["print"] == found["node"], "left").select("print", "lowest", F.coalesce("component", "print").alias("component"))
    kept = named.groupBy("component").agg(F.min("lowest").alias("kept"))
    return marked, named.join(kept, "component").select("print", "component", "kept")


def simhash_groups(docs: DataFrame, width: int = 3, distance: int = 3, blocks: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every document and name the group of near copies it belongs to.

    Method: fingerprints over word shingles are made where the texts lie; only
    identifiers and fingerprints travel.  Documents with one fingerprint are one node,
    so a group of exact copies, however large, costs one row.  Nodes that share a
    pigeonhole block are joined, checked by Hamming distance, and linked nodes get the
    smallest identifier that links lead to.

    Returns one row per input row: identifier, ``print`` (signed 64-bit), ``component_id``
    and ``component`` (the smallest fingerprint of the group).

    Edge cases: null texts and texts without words have fingerprint zero and link like
    any other; fewer words than a shingle count as one shingle; null identifiers never
    are a component's name unless it has no other; repeated rows each get a row; an
    empty table gives an empty result.
    """
    marked, group_of = _marked(docs, width, distance, blocks, id_col, text_col)
    return marked.join(group_of, "print").select(F.col("id").alias(id_col), "print", F.col("kept.id").alias("component_id"), "component")


def drop_near_copies(docs: DataFrame, width: int = 3, distance: int = 3, blocks: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, that with the smallest identifier, with the columns it came with.

    Edge cases: those of :func:`simhash_groups`; texts without words are near copies of each
    other; of rows that repeat the kept identifier the one with the smallest hash of its text
    stays, and of rows that repeat its text too, any one.
    """
    marked, group_of = _marked(docs, width, distance, blocks, id_col, text_col)
    return keep_one(docs, marked.join(group_of.select("print", "kept"), "print"), id_col, text_col)
