"""Sequence and quality functions, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASES, _PAIRED = "ACGTUacgtu", "TGCAAtgcaa"


def complement(seq: Column) -> Column:
    return F.translate(seq, _BASES, _PAIRED)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two sequences of one length differ; null for other lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    return F.when(F.length(a) == F.length(b), F.size(F.filter(pairs, lambda d: d)))


def qualities(text: Column, offset: int = 33) -> Column:
    """Quality scores of a FASTQ line: characters above ``offset``, or numbers with spaces."""
    numbers = F.transform(F.split(F.trim(text), r"\s+"), lambda q: q.cast("int"))
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)
    return F.when(text.rlike(r"^\s*-?\d+(\s+-?\d+)+\s*$"), numbers).otherwise(chars)


def quality_passes(scores: Column, rules: str) -> Column:
    """Whether scores meet all rules ``mean:0-24:20,min:0-4:15`` (kind:first-last:least).

    Positions count from 0 and both ends are included.
    """
    passes = F.lit(True)
    for rule in rules.split(","):
        kind, span, least = rule.split(":")
        first, last = (int(x) for x in span.split("-"))
        part = F.slice(scores, first + 1, last - first + 1)
        if kind == "min":
            value = F.array_min(part)
        elif kind == "mean":
            value = F.try_divide(F.aggregate(part, F.lit(0), lambda s, x: s + x).cast("double"), F.size(part))
        else:
            raise ValueError(f"unknown rule {rule!r}")
        passes = passes & F.coalesce(value >= float(least), F.lit(False))
    return passes


def not_acgt(seq: Column) -> Column:
    """Number of characters other than the four bases."""
    return F.length(F.regexp_replace(seq, "[ACGTacgt]", ""))
