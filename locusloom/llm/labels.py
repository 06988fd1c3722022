"""Labelled rows to learn from, and the split that holds rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most labelled rows that a model is fitted on.
MOST_LABELLED = 10_000


def held_out(ident: Column) -> Column:
    """Whether a row's label may not be learnt: crc32 of the identifier modulo 3 is 1."""
    return F.coalesce(F.crc32(F.encode(ident.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, most: int = MOST_LABELLED) -> DataFrame:
    """At most ``most`` labelled documents outside the held-out third: ``text``, ``label``.

    The labels are drawn by a hash of the identifier before any text is read.
    """
    ident, label = labels[id_col], labels[label_col]
    usable = labels.where(ident.isNotNull() & label.isin(0, 1) & ~held_out(ident)).select(ident.alias("__label_id"), label.cast("int").alias("label"))
    drawn = usable.orderBy(F.xxhash64("__label_id", F.lit("labelled")), "__label_id").limit(most)
    texts = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("text"))
    return texts.join(F.broadcast(drawn), texts["__id"] == drawn["__label_id"]).select("text", "label")
