"""Repair of conversations' structure: cheapest edits to a role grammar, by recursive DuckDB queries in batches."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import MOST_SENT, saved

#: Rows and bytes of a batch, and of a conversation that is repaired within one; longer
#: conversations are cut into parts of ``PART_ROWS`` rows.
BATCH_ROWS, BATCH_BYTES = 1 << 13, 32 << 20
LONG_ROWS, LONG_BYTES = 1 << 10, 16 << 20
PART_ROWS = 1 << 8

_BLANK = r"^[\x20\x09-\x0D]*\z"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"

#: Grammar ``(s?(ua)+)?``: states 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
#: ``moves`` are the cheapest ways past one turn: up to two insertions, then its own edit.
_GRAMMAR = """
grammar(state, initial, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
states(state) AS (VALUES (0), (1), (2), (3)),
given(initial) AS (VALUES ('s'), ('u'), ('a'), ('-')),
kinds(kind, more) AS (VALUES ('good', 0), ('truncated', 3)),
inserted AS (SELECT state, next, 3 AS cost, 'I' AS audit FROM grammar WHERE initial IN ('u', 'a')),
gap AS (SELECT state, state AS next, 0 AS cost, '' AS audit FROM states
        UNION ALL SELECT * FROM inserted
        UNION ALL SELECT a.state, b.next, 6, 'II' FROM inserted a JOIN inserted b ON a.next = b.state),
edit AS (SELECT kind, initial, state, state AS next, 4 AS cost, 'D' AS audit
         FROM states, given, (SELECT kind FROM kinds UNION ALL SELECT 'gone') AS k
         UNION ALL SELECT kind, initial, state, next, more, 'K' FROM grammar, kinds
         UNION ALL SELECT kind, given.initial, state, next, 3 + more, 'R' FROM grammar, kinds, given WHERE grammar.initial IN ('u', 'a')),
moves AS MATERIALIZED (
  SELECT kind, initial, gap.state, edit.next, min(gap.cost + edit.cost) AS cost,
         arg_min(gap.audit || edit.audit, (gap.cost + edit.cost, gap.audit || edit.audit)) AS audit
  FROM gap JOIN edit ON gap.next = edit.state GROUP BY ALL)"""

#: Each recursion takes one turn of every conversation and keeps the cheapest way to each state.
_WALK = """
numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST, part) AS conv,
         row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text) AS n,
         CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS initial
  FROM turns),
placed AS MATERIALIZED (
  SELECT *,
         CASE WHEN fault = 'blank' THEN 'blank'
              WHEN coalesce(again, row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1) THEN 'duplicate'
              ELSE fault END AS first_fault
  FROM numbered),
steps AS MATERIALIZED (
  SELECT conv, n, initial, CASE WHEN first_fault IS NULL THEN 'good' WHEN first_fault = 'truncated' THEN 'truncated' ELSE 'gone' END AS kind FROM placed),
walk AS (
  SELECT DISTINCT conv, e.state AS entry, e.state AS state, 0::BIGINT AS n, 0::BIGINT AS cost, '' AS audit
  FROM steps, states e WHERE e.state = 0 OR {every_entry}
  UNION ALL
  SELECT conv, entry, next AS state, n, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit
  FROM (SELECT w.conv, w.entry, m.next, s.n, w.cost + m.cost AS cost, w.audit || m.audit AS audit
        FROM walk w JOIN steps s ON s.conv = w.conv AND s.n = w.n + 1
                    JOIN moves m ON m.kind = s.kind AND m.initial = s.initial AND m.state = w.state)
  GROUP BY conv, entry, next, n),
sizes AS (SELECT conv, max(n) AS n FROM steps GROUP BY conv),
ended AS (SELECT walk.* FROM walk JOIN sizes USING (conv, n))"""

WHOLE_SQL = f"""
WITH RECURSIVE {_GRAMMAR}, {_WALK.format(every_entry="false")},
best AS (
  SELECT conv, min(e.cost + gap.cost) AS cost, arg_min(e.audit || gap.audit, (e.cost + gap.cost, e.audit || gap.audit)) AS audit
  FROM ended e JOIN gap ON gap.state = e.state AND gap.next IN (0, 3) GROUP BY conv),
letters AS (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS pos FROM best),
edits AS (
  SELECT conv, pos, substr(audit, pos, 1) AS edit, length(replace(substr(audit, 1, pos), 'I', '')) AS n,
         (length(replace(substr(audit, 1, pos), 'D', '')) - length(replace(audit, 'D', ''))) % 2 != 0 AS asks
  FROM letters),
repaired AS (
  SELECT e.conv, list(struct_pack(edit := edit,
           role := CASE WHEN edit IN ('K', 'D') THEN role WHEN asks THEN 'user' ELSE 'assistant' END,
           text := CASE WHEN edit = 'I' THEN '' ELSE text END) ORDER BY pos) AS turns
  FROM edits e LEFT JOIN placed p ON p.conv = e.conv AND p.n = e.n AND e.edit != 'I' GROUP BY e.conv),
pairs AS (SELECT conv, initial || lead(initial) OVER (PARTITION BY conv ORDER BY n) AS pair FROM placed),
wrong AS (SELECT conv, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv),
faults AS (
  SELECT conv, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (first_fault = 'blank') AS blank, count(*) FILTER (first_fault = 'duplicate') AS duplicate,
         count(*) FILTER (first_fault = 'truncated') AS truncated
  FROM placed GROUP BY conv)
SELECT conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, cost::BIGINT AS cost, audit, turns
FROM faults JOIN wrong USING (conv) JOIN best USING (conv) LEFT JOIN repaired USING (conv)
"""

_PART_SQL = f"""
WITH RECURSIVE {_GRAMMAR}, {_WALK.format(every_entry="true")},
names AS (SELECT DISTINCT conv, conv_id, part FROM placed)
SELECT conv_id, part, entry, state, cost, audit FROM ended JOIN names USING (conv)
"""

_TURNS = "array<struct<edit: string, role: string, text: string>>"
_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damage(turns: DataFrame, key: Column) -> DataFrame:
    """Turns with faults that ``key`` (a hash of the turn) decides, of twenty kinds five are faults.

    0 drops the turn, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the
    user's.  Null roles and texts are one space.  Other columns go.
    """
    kind = F.pmod(key, F.lit(20))
    role = F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("__copy")).drop("__copy")


@dataclass
class Repaired:
    """``report``: a row for every conversation with its faults, cost, audit and, unless it is
    long, its ``turns`` in order, deleted ones (edit ``D``) among them; ``long`` has the turns
    of long conversations, a row each, or is None without any."""

    report: DataFrame
    long: DataFrame | None

    def turns(self) -> DataFrame:
        """Every turn of every repaired conversation: ``conv_id``, ``at``, ``edit``, ``role``, ``text``."""
        near = self.report.select("conv_id", F.posexplode("turns").alias("at", "t")).select("conv_id", F.col("at").cast("long").alias("at"), "t.*")
        return near.union(self.long) if self.long is not None else near

    def digests(self) -> DataFrame:
        """``report`` without turns, with ``repaired_sha256`` of the remaining turns' ``role:text`` lines."""
        lines = F.transform(F.filter("turns", lambda t: t["edit"] != "D"), lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
        names = [c for c in self.report.columns if c != "turns"]
        if self.long is None:
            return self.report.select(*names, F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
        near = self.report.where(F.col("turns").isNotNull()).select(*names, F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
        far = self.report.where(F.col("turns").isNull()).select(*names)
        hashed = _streamed(self.long, "at", _digest, f"conv_id {_type(self.long)}, repaired_sha256 string")
        return near.union(_by_name(far, hashed, "left").select(*names, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))))


def _type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _batches(rows: DataFrame, sql: str, schema: str, count: int, size: int) -> DataFrame:
    """Run the query on hash-partitioned batches of whole conversations, or parts of them."""
    batches = max(1, math.ceil(count / BATCH_ROWS), math.ceil(size / BATCH_BYTES))

    def run(batch: pa.Table) -> pa.Table:
        with duckdb.connect(config={"threads": 1}) as connection:
            connection.register("turns", batch)
            return connection.sql(sql).to_arrow_table().cast(arrow)

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return rows.groupBy(F.pmod(F.xxhash64("conv_id", "part"), F.lit(batches)).alias("batch")).applyInArrow(run, schema)


def _streamed(rows: DataFrame, order: str, work: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``work`` on the rows of each conversation in order, in memory for a few rows only."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in work(row for batch in batches for row in batch.to_pylist()):
            out.append(row)
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, schema)


def _digest(rows: Iterator[dict]) -> Iterator[dict]:
    for conv, turns in groupby(rows, key=lambda r: r["conv_id"]):
        lines, between = hashlib.sha256(), b""
        for t in turns:
            if t["edit"] != "D":
                lines.update(between + f"{t['role']}:{t['text']}".encode("utf-8", "surrogatepass"))
                between = b"\n"
        yield {"conv_id": conv, "repaired_sha256": lines.hexdigest()}


def _apply(rows: Iterator[dict]) -> Iterator[dict]:
    """Edits of long conversations; the first row of each brings its audit."""
    audit, at, left = "", 0, 0
    for row in rows:
        if row["audit"] is not None:
            audit, at, left = row["audit"], 0, len(row["audit"]) - row["audit"].count("D")
            own = None
        else:
            own = row
        while at < len(audit) and (own is not None or audit[at] == "I"):
            edit = audit[at]
            role = own["role"] if edit in "KD" else ("assistant", "user")[left % 2 == 0]
            yield {"conv_id": row["conv_id"], "at": at, "edit": edit, "role": role, "text": "" if edit == "I" else own["text"]}
            at, left = at + 1, left - (edit != "D")
            if edit != "I":
                own = None


def _by_name(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the conversation, null with null."""
    return rows.join(other.withColumnRenamed("conv_id", "__name"), F.col("conv_id").eqNullSafe(F.col("__name")), how).drop("__name")


def _long_rows(rows: DataFrame) -> DataFrame:
    """Turns of long conversations in parts of bounded size, with ``again`` for duplicates.

    Equal turns are one row with a count until they are dealt out, and the first of a role and
    text is found by a minimum, so neither a text nor a turn that repeats gathers in a task.
    """
    known = ["conv_id", "turn", "role", "text"]
    distinct = rows.groupBy(*known).agg(F.count(F.lit(1)).alias("m"))
    turn = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    first = distinct.groupBy("conv_id", "role", "text").agg(F.min(turn).alias("least")).select("conv_id", F.col("least.turn").alias("turn"), "role", "text", F.lit(0).alias("m"), F.lit(1).alias("first"))
    marked = distinct.select(*known, "m", F.lit(0).alias("first")).union(first).groupBy(*known).agg(F.sum("m").alias("m"), F.max("first").alias("first"))
    thousands = marked.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / 1024).cast("int"))))
    each = thousands.withColumn("i", F.explode(F.sequence(F.lit(0), F.least(F.lit(1023), F.col("m") - 1 - F.col("k") * 1024).cast("int"))))
    each = each.withColumn("copy", F.col("i") + F.col("k") * 1024).select(*known, "copy", (~((F.col("first") == 1) & (F.col("copy") == 0))).alias("again"))
    order = ["conv_id", "turn", "role", "text", "copy"]
    return each.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())


def _chained(paths: DataFrame) -> DataFrame:
    """Cheapest way through every conversation from its parts' ways, neighbours first, in a tree."""
    parts = paths.select("conv_id", "part").distinct()
    at = parts.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("part")) - 1)
    at = at.withColumnRenamed("part", "__part")
    now = saved(_by_name(paths, at).where("part = __part").select("conv_id", "at", "entry", "state", "cost", "audit"))
    for _ in range(max(1, (now.agg(F.max("at")).head()[0] or 0)).bit_length()):
        a = now.where("at % 2 = 0").alias("a")
        b = now.where("at % 2 = 1").alias("b")
        met = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.at") + 1 == F.col("b.at")) & (F.col("a.state") == F.col("b.entry"))
        way = F.struct((F.col("a.cost") + F.col("b.cost")).alias("cost"), F.concat("a.audit", "b.audit").alias("audit"))
        both = a.join(b, met).groupBy(F.col("a.conv_id").alias("conv_id"), F.col("a.at").alias("at"), F.col("a.entry").alias("entry"), F.col("b.state").alias("state")).agg(F.min(way).alias("way"))
        last = now.groupBy("conv_id").agg(F.max("at").alias("last")).where("last % 2 = 0").alias("l")
        alone = a.join(last, F.col("a.conv_id").eqNullSafe(F.col("l.conv_id")) & (F.col("a.at") == F.col("l.last"))).select("a.conv_id", "a.at", "a.entry", "a.state", "a.cost", "a.audit")
        now = saved(both.select("conv_id", "at", "entry", "state", "way.*").union(alone).withColumn("at", F.expr("cast(at div 2 as int)")))
    # What may follow the last turn: an answer after a question, both after a system turn.
    ending = F.when(F.col("state").isin(0, 3), "").when(F.col("state") == 2, "I").otherwise("II")
    way = F.struct((F.col("cost") + 3 * F.length(ending)).alias("cost"), F.concat("audit", ending).alias("audit"))
    return now.where("entry = 0").groupBy("conv_id").agg(F.min(way).alias("way")).select("conv_id", "way.*")


def _seams(rows: DataFrame) -> DataFrame:
    """Pairs of neighbouring roles that are not legal, within parts and between them."""
    inside = Window.partitionBy("conv_id", "part").orderBy("place")
    pair = F.concat(F.lag("initial").over(inside), "initial")
    within = rows.select("conv_id", pair.alias("pair"))
    ends = rows.groupBy("conv_id", "part").agg(F.min_by("initial", "place").alias("first"), F.max_by("initial", "place").alias("last"))
    between = ends.select("conv_id", F.concat(F.lag("last").over(Window.partitionBy("conv_id").orderBy("part")), "first").alias("pair"))
    return within.union(between).groupBy("conv_id").agg(F.count(F.when(~F.col("pair").isin("su", "ua", "au"), 1)).alias("illegal"))


def _repair_long(rows: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = saved(_long_rows(rows))
    first = F.substring("role", 1, 1)
    shown = rows.withColumn("part", F.shiftright("place", PART_ROWS.bit_length() - 1)).withColumn("initial", F.when(first.isin("s", "u", "a"), first).otherwise("-"))
    kind = _fault("text")
    # A part's turns are in order already: their place stands for turn and text.
    light = shown.select("conv_id", "part", F.col("place").alias("turn"), "role", F.lit("").alias("text"), kind.alias("fault"), "again")
    count = rows.count()
    paths = saved(_batches(light, _PART_SQL, f"conv_id {_type(rows)}, part long, entry int, state int, cost long, audit string", count, 0))
    best = saved(_chained(paths))
    own = F.when(kind == "blank", "blank").when(F.col("again"), "duplicate").otherwise(kind)
    faults = rows.select("conv_id", own.alias("own")).groupBy("conv_id").agg(*[F.count(F.when(F.col("own") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])

    report = _by_name(_by_name(_by_name(best, faults), _seams(shown)), gaps)
    heads = best.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    all_rows = heads.union(rows.select("conv_id", "place", "role", "text", F.lit(None).cast("string")))
    turns = _streamed(all_rows, "place", _apply, f"conv_id {_type(rows)}, at long, edit string, role string, text string")
    return report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.lit(None).cast(_TURNS).alias("turns")), turns


def _fault(text: str) -> Column:
    return F.when(F.col(text).rlike(_BLANK), "blank").when(~F.col(text).rlike(_ENDED), "truncated")


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """The cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

    Method: conversations are dealt by hash into batches of bounded size.  In each batch one
    recursive DuckDB query takes a turn of every conversation at a time and keeps, for each
    state of the grammar, the least cost and of equal ones the least audit: K keeps, R gives
    the other role, D deletes, I inserts an empty turn.  Blank and duplicate turns must go;
    truncated ones that stay cost 3.  A conversation of more than ``LONG_ROWS`` turns or
    ``LONG_BYTES`` is cut into parts, each solved from every state it may begin in; parts are
    joined in a tree, so no task holds such a conversation; only its audit is one value.

    Edge cases: null roles and texts are one space; null conversations are one; null turns
    come first; turns alike in number go by role, then text; a repeated row is a duplicate;
    an empty table gives an empty result.  Roles of one initial are one role to the grammar.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"))
    size = F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes")
    numbers = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("rows"), size)
    sizes = saved(numbers.groupBy("conv_id").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")))
    is_long = (F.col("rows") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)
    total, size, longs = sizes.agg(F.sum("rows"), F.sum("bytes"), F.count(F.when(is_long, 1))).head()
    near = rows
    if longs:
        named = sizes.where(is_long)
        named = F.broadcast(named) if longs <= MOST_SENT else named
        near = _by_name(rows, named.select("conv_id"), "left_anti")
    near = near.select("conv_id", F.lit(0).cast("long").alias("part"), "turn", "role", "text", _fault("text").alias("fault"), F.lit(None).cast("boolean").alias("again"))
    report = saved(_batches(near, WHOLE_SQL, f"conv_id {_type(rows)}, {_COUNTS}, turns {_TURNS}", total or 0, size or 0))
    if not longs:
        return Repaired(report, None)
    more, long = _repair_long(_by_name(rows, named.select("conv_id"), "left_semi"), sizes.select("conv_id", "gaps"))
    return Repaired(report.union(saved(more)), saved(long))
