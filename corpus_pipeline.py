"""The corpus pipeline: toxicity, exact and near copies, source mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result to the shared folder and reads it back as the next stage's documents, so a lost
executor costs at most the stage that was running.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from locusloom.llm.common import saved
from locusloom.llm.exact_dedup import drop_copies
from locusloom.llm.mixing import mixed
from locusloom.llm.packing import pack_documents
from locusloom.llm.shingle_dedup import drop_shingle_copies
from locusloom.llm.toxicity import drop_toxic

VOCABULARY = "byte_bpe_50k.json"
#: Rows and bytes that Spark hands to a Python worker at once: with texts of any length these
#: bound the memory of workers and of the buffers towards them.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def _bounded(spark: SparkSession) -> None:
    for name, value in ARROW.items():
        spark.conf.set(name, value)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go.  Null and empty texts have no insults and stay."""
    _bounded(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the one with the smallest identifier stays, null last;
    a null text is an empty one."""
    return drop_copies(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fingerprints within 3 bits are close to exact copies; at a Jaccard similarity of 0.8
    some 10 of 64 bits differ, so the rest is found by shared five-word shingles.  Both kinds
    of links are one graph, whose groups keep one document each."""
    _bounded(spark)
    return drop_shingle_copies(docs, width=5, similarity=0.8, distance=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are not taken."""
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, a null text having its end id alone."""
    _bounded(spark)
    return pack_documents(docs, public_tokenizers.path(VOCABULARY), with_ids=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", keep_one_copy),
    ("simhash near-dedup", keep_one_near_copy),
    ("source mixing", mix),
    ("packing", pack),
]

#: Learnt weights, fingerprints and tokens are beyond SQL; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages leave of ``documents``.

    Edge cases: those of the stages; null identifiers are carried along and null sources are
    one source; extra columns reach the last stage; an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
