"""Joins, filters and one-row-per-key selection over plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _key(df: DataFrame, column: str, ignore_case: bool) -> Column:
    return F.upper(df[column].cast("string")) if ignore_case else df[column].cast("string")


def lookup_join(
    probe: DataFrame,
    build: DataFrame,
    probe_key: str,
    build_key: str,
    ignore_case: bool = False,
    outer: bool = False,
    no_match: str | None = None,
    single_line: bool = False,
    first_only: bool = False,
    delimiter: str = "||",
    order: Sequence[str] = (),
) -> DataFrame:
    """Look up every probe row in ``build``; build columns come as ``build_...``.

    All matching rows are returned; with ``first_only`` the first in ``order`` (of build
    columns), with ``single_line`` one row whose build columns are joined by
    ``delimiter`` in ``order``, empty ones skipped.  ``outer`` keeps probe rows without
    a match, with ``no_match`` as text in the build columns.
    """
    named = build.select(_key(build, build_key, ignore_case).alias("_key"), *[F.col(c).alias(f"build_{c}") for c in build.columns])
    ordered = [f"build_{c}" for c in (order or build.columns)]
    columns = [f"build_{c}" for c in build.columns]
    if single_line:
        rows = F.sort_array(F.collect_list(F.struct(*ordered, *[c for c in columns if c not in ordered])))

        def joined(c: str) -> Column:
            texts = F.filter(F.transform(F.col("_rows"), lambda r: r[c].cast("string")), lambda t: t.isNotNull() & (t != ""))
            return F.array_join(texts, delimiter).alias(c)

        named = named.groupBy("_key").agg(rows.alias("_rows"), F.min(f"build_{build_key}").alias("_name"))
        named = named.select("_key", *[F.col("_name").alias(c) if c == f"build_{build_key}" else joined(c) for c in columns])
    elif first_only:
        named = named.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(*ordered))).where("_nth = 1").drop("_nth")
    out = probe.join(named, _key(probe, probe_key, ignore_case) == named["_key"], "left" if outer else "inner")
    if outer and no_match is not None:
        missing = F.col("_key").isNull()
        out = out.select(*probe.columns, *[F.when(missing, F.lit(no_match)).otherwise(F.col(c).cast("string")).alias(c) for c in columns])
        return out
    return out.drop("_key")


def matching_rows(rows: DataFrame, keys: DataFrame, row_key: str, other_key: str, keep: bool = True, ignore_case: bool = False) -> DataFrame:
    """Rows whose key is among ``keys`` (``keep``), or is not."""
    other = keys.select(_key(keys, other_key, ignore_case).alias("_other"))
    return rows.join(other, _key(rows, row_key, ignore_case) == other["_other"], "left_semi" if keep else "left_anti")


def left_per_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """A left row for every match on the right, left columns alone."""
    other = right.select(right[right_key].alias("_other"))
    return left.join(other, left[left_key] == other["_other"]).select(*left.columns)


def checked_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join one to one on ``key``; a row without exactly one partner raises."""
    counts = (
        left.groupBy(key).agg(F.count(F.lit(1)).alias("l"))
        .join(right.groupBy(key).agg(F.count(F.lit(1)).alias("r")), key, "full")
        .where("not (l <=> 1L and r <=> 1L)").limit(1).collect()
    )
    if counts:
        raise ValueError(f"{key} = {counts[0][key]!r} does not match one to one")
    return left.join(right, key)


#: Criteria that choose a row: the order of preference by the value column.
_CHOICES = {
    "max_num": lambda v: F.desc(v.cast("double")),
    "min_num": lambda v: F.asc(v.cast("double")),
    "max_num_abs": lambda v: F.desc(F.abs(v.cast("double"))),
    "min_num_abs": lambda v: F.asc(F.abs(v.cast("double"))),
    "max_text": lambda v: F.desc(v.cast("string")),
    "min_text": lambda v: F.asc(v.cast("string")),
}


def unique_rows(df: DataFrame, key: str, value: str, criterion: str = "random", order: Sequence[str] = (), seed: int = 1, na: str = "NA", extra: bool = True, by_key: bool = False) -> DataFrame:
    """One row for each key.

    ``max_num`` and the like choose a row by the value; ties go to the first in
    ``order``.  ``random`` chooses by a hash of the row.  ``sum``, ``mean`` and ``count``
    put that number in place of the value in the first row.  ``rowsum`` and ``rowmean``
    aggregate every other column, skipping ``na``; a mean of nothing is null.  Without
    ``extra`` only key and value are returned; ``by_key`` sorts the rows by key.
    """
    if not extra or by_key:
        out = unique_rows(df, key, value, criterion, order, seed, na)
        out = out if extra else out.select(*dict.fromkeys([key, value]))
        return out.orderBy(key) if by_key else out
    ties = [F.col(c) for c in (order or df.columns)]
    group = Window.partitionBy(key)
    if criterion in ("rowsum", "rowmean"):
        how = F.sum if criterion == "rowsum" else F.avg
        number = lambda c: F.expr(f"try_cast(nullif(cast(`{c}` as string), '{na}') as double)")
        numbers = [how(number(c)) for c in df.columns if c != key]
        if criterion == "rowsum":
            numbers = [F.coalesce(n, F.lit(0.0)) for n in numbers]
        return df.groupBy(key).agg(*[n.alias(c) for n, c in zip(numbers, [c for c in df.columns if c != key], strict=True)])
    if criterion == "random":
        preferred = [F.xxhash64(*df.columns, F.lit(seed))]
    elif criterion in _CHOICES:
        preferred = [_CHOICES[criterion](F.col(value))]
    elif criterion in ("sum", "mean", "count"):
        preferred = []
    else:
        raise ValueError(f"unknown criterion {criterion!r}")
    out = df.withColumn("_nth", F.row_number().over(group.orderBy(*preferred, *ties)))
    if not preferred:
        how = {"sum": F.sum, "mean": F.avg, "count": F.count}[criterion]
        out = out.withColumn(value, how(F.col(value)).over(group))
    return out.where("_nth = 1").drop("_nth")


def duplicate_names(df: DataFrame, name: str = "name", order: Sequence[str] = ()) -> DataFrame:
    """Mark names that repeat: ``copies``, ``nth`` from 0, and ``unique_name`` (``name@nth``)."""
    group = Window.partitionBy(name)
    nth = F.row_number().over(group.orderBy(*[F.col(c) for c in (order or df.columns)])) - 1
    out = df.withColumn("copies", F.count(F.lit(1)).over(group)).withColumn("nth", nth)
    return out.withColumn("unique_name", F.when(F.col("copies") > 1, F.concat(name, F.lit("@"), F.col("nth").cast("string"))).otherwise(F.col(name)))

