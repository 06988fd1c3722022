"""Mixing sources to target weights by random keys and exact prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, shuffle_partitions, words_in

#: Weights of the sources in code-point order, repeating, null last.
WEIGHTS = (5, 2, 1)
#: A source is repeated this often at most.
MOST_EPOCHS = 3
#: The most documents of one source in one slice of the prefix sums; fewer where tasks are many.
SLICE_ROWS = 50_000

_KEY_BITS = 60


def random_key(ident: Column, text: Column, seed: str) -> Column:
    """A 60-bit key from the MD5 of a seed and the identifier, or without one a hash of the
    text: random order, same on every run."""
    named = F.when(ident.isNull(), F.concat(F.lit(":"), F.xxhash64(text).cast("string"))).otherwise(ident.cast("string"))
    digest = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), named), "UTF-8"))
    return F.conv(F.substring(digest, 1, _KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """Share all words among the sources by weight, none above ``epochs`` times its size.

    ``sizes`` has ``source`` and ``source_size``, a row for each source.  Resharing
    the excess until nothing is above ends where every source gets weight x level or
    its cap; with sources in order of cap / weight the capped ones come first, and
    the level is (all words - caps so far) / (weights left) at the first that is not.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    ranked = Window.orderBy("ratio", "nth")
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(w) for w in weights])
    return (
        sizes.withColumn("nth", F.row_number().over(named) - 1)
        .withColumn("weight", F.get(cycle, F.col("nth") % len(weights)))
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("rank", F.row_number().over(ranked))
        .withColumn("spent", F.sum("cap").over(ranked) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(everything) - F.sum("weight").over(ranked) + F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("spent")) / F.col("left"))
        .withColumn("free", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(everything))
        .select(
            "source", "source_size",
            F.when(F.col("free").isNull() | (F.col("rank") < F.col("free.rank")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("free.level")).alias("target"),
        )
    )


def _plan(facts: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """By source ``name``: ``source_size``, ``target``, ``whole`` epochs and where the last one
    ends.  ``facts``: ``source``, ``name``, ``size``, ``key``, ``tie``, ``place``.

    ``cut`` has the ``key`` at which it ends.  Where several rows have that key, ``tie`` is the
    hash of the text among them at which it ends, and where rows agree in both, ``place`` is
    that of the row.  ``left`` words are taken at the key, text hash or row that is named last,
    which ``copies`` rows have.
    """
    rows_of_slice = max(500, min(SLICE_ROWS, facts.count() // (4 * shuffle_partitions(facts.sparkSession))))
    by_source = facts.groupBy("source", "name").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = saved(
        targets(by_source.select("source", "source_size"), weights, epochs)
        .withColumn("name", _name())
        .drop("source")
        .join(by_source.select("name", "n"), "name")
        .withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("source_size"))
    )
    cuts = _cut(facts.select("name", "size", "key"), plan.select("name", F.col("rest").alias("left")), rows_of_slice)
    cuts = saved(cuts.select("name", F.struct("key", F.lit(None).cast("long").alias("tie"), F.lit(None).cast("long").alias("place"), "left", "copies", F.lit(0).cast("long").alias("taken")).alias("cut")))
    if not cuts.where("cut.copies > 1").isEmpty():
        cuts = _finer(facts, cuts, rows_of_slice)
    return _small(plan.select("name", "source_size", "target", "whole").join(cuts, "name", "left"))


def _cut(rows: DataFrame, budgets: DataFrame, rows_of_slice: int) -> DataFrame:
    """The key at which rows in order of key hold more words than ``left``: ``name``, ``key``,
    the words ``left`` there and the ``copies`` that have it.

    A source of many rows has many slices of the key's range.  Their sums are scanned, and
    only the slice in which the budget ends is sorted.
    """
    sizes = rows.groupBy("name").agg(F.ceil(F.count(F.lit(1)) / rows_of_slice).alias("slices"))
    asked = _small(budgets.join(sizes, "name"))
    sliced = rows.join(asked, "name").withColumn("slice", F.floor(F.col("key") / F.lit(float(1 << _KEY_BITS)) * F.col("slices")))
    in_order = Window.partitionBy("name").orderBy("slice")
    sums = sliced.groupBy("name", "slice", "left").agg(F.sum("size").alias("words")).withColumn("before", F.sum("words").over(in_order) - F.col("words"))
    last = sums.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words"))).select("name", "slice", "before")
    last = _small(last)  # a row for each source, so the documents stay where they are
    by_key = Window.partitionBy("name").orderBy("key")
    return (
        sliced.join(last, ["name", "slice"])
        .groupBy("name", "key", "left", "before")
        .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("copies"))
        .withColumn("upto", F.col("before") + F.sum("words").over(by_key))
        .where(F.col("upto") > F.col("left"))
        .groupBy("name")
        .agg(F.min_by(F.struct("key", (F.col("left") - F.col("upto") + F.col("words")).alias("left"), "copies"), "key").alias("c"))
        .select("name", "c.*")
    )


def _finer(facts: DataFrame, cuts: DataFrame, rows_of_slice: int) -> DataFrame:
    """Cuts at one row each, where a key, or a key and a text, has several."""
    several, one = cuts.where("cut.copies > 1"), cuts.where("cut.copies = 1")
    at_key = facts.join(_small(several), "name").where(F.col("key") == F.col("cut.key"))
    ties = _cut(at_key.select("name", "size", F.col("tie").alias("key")), several.select("name", "cut.left"), rows_of_slice).withColumnRenamed("key", "tie")
    ties = saved(several.select("name", F.col("cut.key").alias("key")).join(ties, "name"))
    # Rows alike in key and text are of one size: so many of them whole, by place, then one in part.
    alike = at_key.drop("cut", "key", "source").withColumnRenamed("tie", "_tie").join(_small(ties.where("copies > 1")), "name").where("_tie = tie")
    parts = alike.groupBy("name", F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("left").alias("left"))
    parts = parts.withColumn("wanted", F.expr("left div size")).withColumn("first", F.sum("n").over(Window.partitionBy("name").orderBy("part")) - F.col("n"))
    part = parts.where((F.col("first") <= F.col("wanted")) & (F.col("wanted") < F.col("first") + F.col("n"))).select("name", "part", "wanted", "first")
    ranked = alike.withColumn("part", F.shiftright("place", 33)).join(_small(part), ["name", "part"]).withColumn("nth", F.col("first") + F.row_number().over(Window.partitionBy("name", "part").orderBy("place")) - 1)
    places = ranked.where("nth = wanted").select("name", "place", F.col("wanted").alias("taken"), (F.col("left") - F.col("wanted") * F.col("size")).alias("left_there"))
    named = ties.join(places, "name", "left")
    cut = F.struct("key", "tie", "place", F.coalesce("left_there", "left").alias("left"), "copies", F.coalesce("taken", F.lit(0)).alias("taken"))
    return saved(one.union(named.select("name", cut.alias("cut"))))


def _name() -> Column:
    """'s' before a source's name: null differs from every name and joins as a plain equality."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _keys(ident: Column, text: Column, seed: str) -> tuple[Column, Column]:
    return random_key(ident, text, seed).alias("key"), F.shiftrightunsigned(F.xxhash64(text), 64 - _KEY_BITS).alias("tie")


def _facts(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """What the mix asks of each document, and ``doc``, its columns but the text."""
    rest = F.struct(*[docs[c] for c in docs.columns if c != text_col])
    key, tie = _keys(docs[id_col], docs[text_col], seed)
    facts = docs.select(rest.alias("doc"), docs[source_col].alias("source"), words_in(docs[text_col]).alias("size"), key, tie, F.monotonically_increasing_id().alias("place"))
    return saved(facts.withColumn("name", _name()))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = MOST_EPOCHS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Say how many words of each document the mix takes.

    Method: each document gets a random key from its identifier.  Within a source,
    slices of the key's range hold ``SLICE_ROWS`` documents at most, so a source
    with a third of all rows has as many more slices.  Sums per slice, their prefix
    sums, and a sort of the one slice in which the budget ends give the exact key of
    the cut.  Whole epochs repeat every document; the documents before the cut come
    once more, and the one at the cut gives only the words still missing, so the
    words taken are the target but for rounding.  Whether a document is taken then
    depends on its own key and its source's cut alone: texts are read once and never
    shuffled.

    Returns one row per input row: ``doc`` (struct of the input's columns but the text),
    ``size`` (words), ``source_size``, ``target`` (double, of the source) and ``taken`` (long).

    Edge cases: null texts have no words; null is a source of its own, last in
    order; rows without an identifier go by their text; rows that repeat an identifier go
    by a hash of their text, and of rows alike in both it is open which are taken; a source
    without words gets nothing; an empty table gives an empty result.
    """
    facts = _facts(docs, seed, id_col, text_col, source_col)
    at, before = _at_cut(F.col("place"))
    more = F.when(before, F.col("size")).when(at, F.least(F.col("size"), F.col("cut.left"))).otherwise(0)
    return facts.join(_plan(facts, weights, epochs), "name").select("doc", "size", "source_size", "target", (F.col("whole") * F.col("size") + more).cast("long").alias("taken"))


def _at_cut(place: Column | None) -> tuple[Column, Column]:
    """Whether a row is the one at its source's cut, and whether it comes before."""
    same, tied = F.col("key") == F.col("cut.key"), F.col("cut.tie").isNull() | (F.col("tie") == F.col("cut.tie"))
    at, before = same & tied, (F.col("key") < F.col("cut.key")) | (same & (F.col("tie") < F.col("cut.tie")))
    if place is not None:
        here = F.col("cut.place").isNull() | (place == F.col("cut.place"))
        at, before = at & here, before | (at & (place < F.col("cut.place")))
    return F.coalesce(at, F.lit(False)), F.coalesce(before, F.lit(False))


def _small(plan: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast the table of sources only where its counted rows are few."""
    plan = saved(plan)
    return F.broadcast(plan) if plan.count() <= most else plan


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = MOST_EPOCHS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their columns.

    A document taken 2.4 times comes twice whole and once with the first 40 % of its
    words; that last piece exists for at most one document of each source.

    Edge cases: those of :func:`mix_sources`; documents without words are not taken.
    """
    plan = _plan(_facts(docs, seed, id_col, text_col, source_col), weights, epochs)
    key, tie = _keys(docs[id_col], docs[text_col], seed)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[source_col].alias("source"), key, tie)
    placed = rows.withColumn("name", _name()).join(plan, "name")
    text = F.col(f"doc.`{text_col}`")
    at, before = _at_cut(None)
    # Rows alike in identifier and text at a cut are taken together, below.
    several = at & (F.coalesce(F.col("cut.copies"), F.lit(1)) > 1) & F.col("cut.place").isNotNull()
    cut = at & ~several
    times = F.col("whole") + before.cast("long")
    # CASE counts the words of the documents at a cut alone.
    left = F.when(cut, F.least(words_in(text), F.col("cut.left"))).otherwise(0)
    part = F.when(cut & (left == words_in(text)), F.lit(None).cast("long")).otherwise(left)
    pieces = F.concat(F.array_repeat(F.lit(None).cast("long"), times.cast("int")), F.when(left > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    copies = placed.where(F.coalesce(text.rlike(WORD), F.lit(False))).select("doc", F.explode(pieces).alias("words"))
    if not plan.where("cut.place IS NOT NULL").isEmpty():
        # Of n rows alike so many whole ones, and the words left of one more, as the plan says by place.
        alike = placed.where(several & F.coalesce(text.rlike(WORD), F.lit(False))).groupBy("name").agg(F.first("doc").alias("doc"), F.first("cut.taken").alias("taken"), F.first("cut.left").alias("left"))
        wholes = alike.where("taken > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / 1024).cast("int"))))
        wholes = wholes.select("doc", F.explode(F.array_repeat(F.lit(None).cast("long"), F.least(F.lit(1024), F.col("taken") - F.col("k") * 1024).cast("int"))).alias("words"))
        copies = copies.union(wholes).union(alike.where("left > 0").select("doc", "left"))
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    shown = F.when(F.col("words").isNull(), text).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), ""))
    return copies.select(*[shown.alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns])
