"""Near-duplicate vectors by collision counts over many sorted one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_SENT, drop_saved, saved
from .components import components

#: Of each set of base directions a vector combines those in whose tail it lies furthest out,
#: and of the combined lines of a family it keeps those in whose tail it lies furthest out.
BASES, TAIL = 6, 8
#: Dimensions of the space of lines at least.
LEAST_DIM = 32
#: Half-width of the window around a vector's own projected value.
WINDOW = 1.0
#: Entries of one line that one task compares with each other; a fuller line is cut.
CELL = 2048
#: A line with more entries than this is crowded: dense groups on it become balls.
CROWD = 12
#: Pairs at exactly the threshold that calibrate families and count.
CALIBRATION = 1024
MOST_FAMILIES = 24
#: Cosines are compared to angles with this much room for rounding.
_ROOM = 1e-9
_BLOCK = 1 << 17
#: Rounds in which balls are made; each leaves a tenth fewer pairs, so fewer are needed.
_MOST_ROUNDS = 1024


def directions(dim: int, lines: int, family: int, side: int) -> np.ndarray:
    """Base directions of length one, a row for each."""
    drawn = np.random.Generator(np.random.Philox(key=[7919, 2 * family + side])).standard_normal((lines, dim))
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


def line_count(vectors: int) -> int:
    """Base directions of one set: their signed sums are some 16 lines for every vector."""
    lines = 64
    while lines < 2 * vectors**0.5 and lines < 1 << 16:
        lines *= 2
    return lines


def tails(units: np.ndarray, lines: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``TAIL`` lines of a family in whose tail each vector lies furthest out, and its values.

    A line runs along the sum of one signed direction of a first set and one of a second, so
    that ``lines`` directions in each make (2 * lines)^2 lines; a vector's are chosen from
    the sums of its ``BASES`` outermost directions in each set.  Values are projections on
    the line, of deviation one for random vectors.  Shorter vectors lie in a space of
    ``LEAST_DIM`` dimensions, where their tails stay wide however many the lines.  Shapes:
    vectors x TAIL.
    """
    units = np.pad(units, ((0, 0), (0, max(0, LEAST_DIM - units.shape[1]))))
    dim = units.shape[1]
    sides = [directions(dim, lines, family, side) for side in (0, 1)]
    where, value = np.empty((len(units), TAIL), np.int64), np.empty((len(units), TAIL), np.float32)
    step = max(16, (1 << 22) // max(lines, BASES * dim))
    for at in range(0, len(units), step):
        part, found = units[at : at + step], []
        for base in sides:
            v = part @ base.T
            out = np.argpartition(-np.abs(v), BASES, axis=1)[:, :BASES]
            v = np.take_along_axis(v, out, 1)
            found.append((2 * out + (v < 0), np.abs(v), base[out] * np.sign(v)[:, :, None]))
        (i, vi, a), (j, vj, b) = found
        size = np.sqrt(np.maximum(2 + 2 * np.einsum("nid,njd->nij", a, b), 1e-12) / dim)
        total = ((vi[:, :, None] + vj[:, None, :]) / size).reshape(len(part), -1)
        line = (i[:, :, None].astype(np.int64) * (2 * lines) + j[:, None, :]).reshape(len(part), -1)
        top = np.argpartition(-total, TAIL, axis=1)[:, :TAIL]
        where[at : at + step], value[at : at + step] = np.take_along_axis(line, top, 1), np.take_along_axis(total, top, 1)
    return where, value


def calibrate(dim: int, threshold: float, lines: int, recall: float, seed: int = 1) -> tuple[int, int]:
    """Families and least collision count that keep ``recall`` of pairs at the threshold.

    Directions have no preferred orientation, so how often a pair collides depends on its
    cosine and dimension alone: pairs drawn at exactly the threshold, the hardest that must
    be found, speak for all.  Raises where ``MOST_FAMILIES`` do not reach the recall.
    """
    rng = np.random.default_rng(seed)
    one, other = rng.standard_normal((2, CALIBRATION, dim))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (other * one).sum(1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    pair = np.concatenate([one, threshold * one + math.sqrt(1 - threshold**2) * other])
    counts = np.zeros(CALIBRATION, int)
    for family in range(MOST_FAMILIES):
        where, value = tails(pair, lines, family)
        (a, b), (va, vb) = np.split(where, 2), np.split(value, 2)
        same = (a[:, :, None] == b[:, None, :]) & (np.abs(va[:, :, None] - vb[:, None, :]) <= WINDOW)
        counts += same.any(2).sum(1)
        reached = [k for k in range(2, TAIL * MOST_FAMILIES) if (counts >= k).mean() >= recall]
        if reached:
            return family + 1, max(reached)
    raise ValueError(f"{MOST_FAMILIES} families do not find {recall} of the pairs at cosine {threshold} in {dim} dimensions")


def _plan(nodes: DataFrame, threshold: float, recall: float) -> dict[int, tuple[int, int, int]]:
    """By dimension: lines, families and least count.  A row for each dimension of the table."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(dim, line_count(n), *calibrate(dim, threshold, line_count(n), recall)) for dim, n in zip(batch["dim"], batch["n"], strict=True)]
            yield pd.DataFrame(rows, columns=["dim", "lines", "families", "least"])

    # In one dimension vectors are equal or opposite.
    dims = nodes.groupBy(F.size("unit").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where("dim > 1")
    return {r["dim"]: (r["lines"], r["families"], r["least"]) for r in dims.mapInPandas(fit, "dim int, lines int, families int, least int").collect()}


def _units(vectors: DataFrame) -> DataFrame:
    """``id`` and ``unit``: the vector over its length in double precision, null if it has none.

    It is divided by its largest element first, so that squares cannot overflow; a row's
    result depends on its own elements alone, so equal vectors have equal units.
    """

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for batch in batches:
            column = batch.column(1)
            dims = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(column.offsets.to_numpy()))
            flat, starts = column.values.to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy()[:-1]
            unit = np.empty(len(dims), object)
            for dim in np.unique(dims[dims > 0]):
                rows = np.flatnonzero(dims == dim)
                v = flat[starts[rows][:, None] + np.arange(dim)]  # a null element is NaN here
                most = np.abs(v).max(1)
                good = np.isfinite(most) & (most > 0)
                v = v[good] / most[good][:, None]
                for row, own in zip(rows[good], v / np.sqrt((v * v).sum(1))[:, None], strict=True):
                    unit[row] = own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(unit, kind)], ["id", "unit"])

    ident = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(scale, f"id {ident}, unit array<double>")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _posts(nodes: DataFrame, plan: dict[int, tuple[int, int, int]]) -> DataFrame:
    """A row for each vector and line in whose tail it is kept: ``key``, ``value``, ``node``."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            starts, node = np.concatenate([[0], np.cumsum(dims)]), batch.column(0).to_numpy()
            for dim in np.unique(dims):
                if dim not in plan:
                    continue
                rows = np.flatnonzero(dims == dim)
                units = flat[starts[rows][:, None] + np.arange(dim)]
                lines, families, _ = plan[dim]
                for family in range(families):
                    where, value = tails(units, lines, family)
                    # dimension, family and the line in one number; lines < 2^17, squared < 2^34
                    key = where | np.int64(family) << 34 | np.int64(dim) << 40
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(value.ravel()), pa.array(np.repeat(node[rows], TAIL))], ["key", "value", "node"])

    return nodes.select("node", "unit").mapInArrow(post, "key long, value float, node long")


def _balls(nodes: DataFrame, posts: DataFrame, threshold: float) -> DataFrame | None:
    """Dense groups: ``node``, ``ball``, ``cosine`` to the ball's centre, and ``centre``.

    On every crowded line vectors are held against the line's least node, and each follows
    the least of those it is linked to, which follows another in turn; those that end at one
    node form a group.  Its members within half the threshold's angle of the group's mean
    direction are a ball: by the triangle inequality all of them are linked with each other,
    whatever their number, so no pair inside a ball is ever made.  Rounds go on with the
    other vectors while crowded lines hold more pairs than there are posts, and a tenth
    fewer each time.  None where no line is crowded.
    """
    half, balls, most, before, rounds = math.cos(math.acos(threshold) / 2) + _ROOM, None, posts.count(), None, 0
    own, leads = nodes.select("node", "unit"), nodes.select(F.col("node").alias("lead"), F.col("unit").alias("lead_unit"))
    while True:
        crowds = saved(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).where(F.col("n") > CROWD))
        pairs = crowds.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
        if pairs <= most or before is not None and 10 * pairs > 9 * before or rounds == _MOST_ROUNDS:
            drop_saved(crowds)
            return balls
        before = pairs
        asked = posts.join(crowds.select("key", "lead"), "key").where("node != lead").select("node", "lead").distinct()
        near = asked.join(own, "node").join(leads, "lead").where(_dot("unit", "lead_unit") >= threshold)
        follows = saved(near.groupBy("node").agg(F.min("lead").alias("lead")).where("lead < node"))
        heads = follows.select(F.col("node").alias("lead"), F.col("lead").alias("next"))
        groups = follows
        for _ in range(3):
            groups = groups.join(heads, "lead", "left").select("node", F.coalesce("next", "lead").alias("lead"))
        groups = saved(groups.union(groups.select(F.col("lead").alias("node"), "lead").distinct()).groupBy("node").agg(F.min("lead").alias("lead")))
        units = groups.join(own, "node")
        mean = units.groupBy("lead").agg(Summarizer.mean(array_to_vector("unit")).alias("m")).select(F.col("lead").alias("id"), vector_to_array("m").alias("m"))
        centres = _units(mean).select(F.col("id").alias("lead"), F.col("unit").alias("centre"))
        held = units.join(centres, "lead").withColumn("cosine", _dot("unit", "centre")).where(F.col("cosine") >= half)
        # A lead that stays outside its own ball may lead another one later.
        found = saved(held.select("node", (-1 - F.col("lead") * _MOST_ROUNDS - rounds).alias("ball"), "cosine", "centre"))
        rounds += 1
        for table in (crowds, follows, groups):
            drop_saved(table)
        balls = found if balls is None else balls.union(found)
        posts = posts.join(found, "node", "left_anti")


def _collisions(entries: DataFrame, plan: dict[int, tuple[int, int, int]]) -> DataFrame:
    """Pairs whose windows meet on as many lines as the calibration asks for.

    ``entries``: ``key``, ``entity`` and the range ``lo`` to ``hi`` of its values on the
    line.  Each line is sorted by value, and from each entry the window around it is
    scanned upwards.  A line with more than ``CELL`` entries is cut into chunks, and each
    pair of chunks is compared on its own, so no task holds more than two chunks.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Columns that end where a line ends."""
        held: list[np.ndarray] | None = None
        for batch in batches:
            own = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1]))
            if len(change):
                yield tuple(x[: change[-1] + 1] for x in held)
                held = [x[change[-1] + 1 :] for x in held]
        if held is not None and len(held[0]):
            yield tuple(held)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, low, high, chunk, lo, hi, entity in lines(batches):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            line = np.cumsum(new) - 1
            # One ascending axis for all lines: entries of a line follow each other, sorted by lo.
            width = float(hi.max() - lo.min()) + 2 * WINDOW + 1
            axis = line * width + (lo - lo.min())
            upto = np.searchsorted(axis, line * width + (hi - lo.min()) + WINDOW, "right")
            count = upto - np.arange(len(key)) - 1
            for part in np.array_split(np.arange(len(key)), count.sum() // _BLOCK + 1):
                n = count[part]
                a = np.repeat(part, n)
                b = a + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                keep = ((low[a] == high[a]) | (chunk[a] != chunk[b])) & (entity[a] != entity[b])
                a, b = a[keep], b[keep]
                least = np.array([plan[d][2] for d in (key[a] >> 40)], np.int32)
                p, q = entity[a], entity[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(least)], ["a", "b", "least"])

    full = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    full = saved(full.select("key", F.ceil(F.col("n") / CELL).cast("int").alias("chunks")))
    none = F.lit(0).cast("int")
    if full.isEmpty():
        cells = entries.select("key", none.alias("low"), none.alias("high"), none.alias("chunk"), "lo", "hi", "entity")
    else:
        chunked = entries.join(full, "key", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("entity"), F.col("chunks")).cast("int"), none))
        others = F.explode(F.sequence(none, F.coalesce(F.col("chunks"), F.lit(1)) - 1)).alias("other")
        cells = chunked.select("key", "chunk", "lo", "hi", "entity", others).select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "lo", "hi", "entity")
    dealt = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "lo")
    met = dealt.mapInArrow(find, "a long, b long, least int").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least"))
    return met.where("n >= least").select("a", "b")


def embedding_links(nodes: DataFrame, threshold: float, recall: float = 0.997) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Links of distinct vectors, with dense groups as balls.

    ``nodes``: ``node`` (long, unique), ``unit`` (array<double> of length one), ``copies``.
    Method: every vector is projected on many lines and kept on those in whose tail it lies
    furthest out.  Each line is sorted by value; vectors within a window around another's
    value collide with it there.  Collisions are counted by pair over all lines, and pairs
    that reach the calibrated count are verified by cosine in double precision.  Lines grow
    in number with the vectors, which holds the expected length of a tail constant.
    :func:`_balls` stand for dense groups: against a ball the triangle inequality decides at
    once for all its members, or the members are verified one by one.

    Returns ``members`` (``node``, ``entity``: a ball or the node itself), ``of_entity``
    (``entity``, ``n``: copies that each of its members is linked to, in a ball its own
    too), ``of_node`` (``node``, ``n``: copies linked to it besides) and ``links`` (``a``,
    ``b``: linked entities).
    """
    plan = _plan(nodes, threshold, recall)
    posts = saved(_posts(nodes, plan))
    balls = _balls(nodes, posts, threshold)
    plain = nodes.select("node", F.col("node").alias("entity"), F.lit(1.0).alias("cosine"), F.col("unit").alias("centre"), "unit", "copies")
    if balls is None:
        members = plain
    else:
        inside = balls.join(nodes, "node").select("node", F.col("ball").alias("entity"), "cosine", "centre", "unit", "copies")
        members = saved(plain.join(balls, "node", "left_anti").union(inside))
    entries = posts.join(members.select("node", "entity"), "node").groupBy("key", "entity").agg(F.min("value").alias("lo"), F.max("value").alias("hi")) if balls is not None else posts.select("key", F.col("value").alias("lo"), F.col("value").alias("hi"), F.col("node").alias("entity"))
    pairs = _collisions(entries, plan)
    # Angles between a ball's centre and its outermost member; a vector of its own has none.
    angle = lambda c: F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))
    if balls is None:
        entities = members.select("entity", "centre", F.lit(0.0).alias("radius"), "copies")
    else:
        grouped = inside.groupBy("entity").agg(F.any_value("centre").alias("centre"), (angle(F.min("cosine")) + _ROOM).alias("radius"), F.sum("copies").alias("copies"))
        entities = saved(members.where("entity >= 0").select("entity", "centre", F.lit(0.0).alias("radius"), "copies").union(grouped))
    sides = [entities.select(*[F.col(c).alias(f"{s}_{c}") for c in entities.columns]) for s in "ab"]
    met = pairs.join(sides[0], F.col("a") == F.col("a_entity")).join(sides[1], F.col("b") == F.col("b_entity"))
    limit, reach, apart = math.acos(threshold), F.col("a_radius") + F.col("b_radius"), F.col("cosine")
    met = met.withColumn("cosine", _dot("a_centre", "b_centre"))
    every = F.when(reach == 0, apart >= threshold).otherwise(angle(apart) + reach <= limit)
    some = (reach > 0) & ~every & (angle(apart) - reach <= limit)
    judged = saved(met.where(every | some).select("a", "b", "a_copies", "b_copies", every.alias("every")))
    sure = judged.where("every")
    of_entity = sure.select(F.col("a").alias("entity"), F.col("b_copies").alias("n")).union(sure.select("b", "a_copies"))
    links, of_node = sure.select("a", "b"), nodes.select("node", F.lit(0).cast("long").alias("n")).limit(0)
    if balls is not None:
        of_entity = of_entity.union(entities.where("entity < 0").select("entity", F.col("copies") - 1))
        left, right = (members.select(F.col("entity").alias(s), F.col("node").alias(f"{s}_node"), F.col("unit").alias(f"{s}_unit"), F.col("copies").alias(f"{s}_copies")) for s in "ab")
        single = judged.where("not every").select("a", "b").join(left, "a").join(right, "b").where(_dot("a_unit", "b_unit") >= threshold)
        ends = F.explode(F.array(F.struct(F.col("a_node").alias("node"), F.col("b_copies").alias("n")), F.struct(F.col("b_node").alias("node"), F.col("a_copies").alias("n")))).alias("end")
        of_node = saved(single.select(ends).groupBy("end.node").agg(F.sum("end.n").alias("n")))
        links = links.union(single.select("a", "b").distinct())
    of_entity = saved(of_entity.groupBy("entity").agg(F.sum("n").alias("n")))
    links = saved(links)
    drop_saved(posts)
    return members.select("node", "entity"), of_entity, of_node, links


def embedding_groups(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Near-duplicate groups of vectors.

    Vectors of one direction are one node with a number of copies, so a vector that fills a
    third of the table costs one row; nodes are linked by :func:`embedding_links`.

    Returns one row per input row: identifier, ``n_links`` (other rows linked directly,
    copies included), ``component_id`` (smallest identifier reachable) and ``kept``.

    Edge cases: null, all-zero and empty vectors, and vectors with null or non-finite
    elements, link with nothing and are their own component; vectors of different
    lengths do not link; null identifiers never name a component that has another; rows
    that repeat a vector link with each other; rows that repeat an identifier with other
    vectors are each judged by their own vector; a recall that cannot be reached raises;
    an empty table gives an empty result.
    """
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = saved(_units(rows).withColumn("mix", F.xxhash64("unit")))
    good = rows.where("unit is not null")
    nodes = good.groupBy("mix", "unit").agg(F.min("id").alias("lowest"), F.count(F.lit(1)).alias("copies"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()))  # written once, so the numbers stay
    members, of_entity, of_node, links = embedding_links(nodes.select("node", "unit", "copies"), threshold)
    placed = saved(nodes.select("node", "mix", "lowest", "copies").join(members, "node"))
    entities = placed.groupBy("entity").agg(F.min("lowest").alias("lowest")).join(of_entity, "entity", "left")
    named = entities.join(components(links).withColumnRenamed("node", "entity"), "entity", "left").withColumn("component", F.coalesce("component", "entity"))
    lowest = named.groupBy("component").agg(F.min("lowest").alias("component_id"))
    named = saved(named.join(lowest, "component").select("entity", F.coalesce("n", F.lit(0)).alias("n"), "component_id"))
    # A ball's row is looked up by all its members, a node's own by itself alone.
    balls = named.where("entity < 0")
    balls = F.broadcast(balls) if balls.count() <= MOST_SENT else balls
    judged = placed.where("entity < 0").join(balls, "entity").union(placed.where("entity >= 0").join(named.where("entity >= 0"), "entity"))
    judged = judged.join(of_node.withColumnRenamed("n", "more"), "node", "left")
    own = F.when(F.col("entity") < 0, 0).otherwise(F.col("copies") - 1)  # a ball's number holds those of its members
    links_of = F.col("n") + F.coalesce("more", F.lit(0)) + own
    of_row = nodes.select("mix", "unit", "node").join(judged.select("node", links_of.alias("n_links"), "component_id"), "node").drop("node")
    linked = good.select("id", "mix", "unit").join(of_row, ["mix", "unit"]).select("id", "n_links", "component_id")
    alone = rows.where("unit is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
