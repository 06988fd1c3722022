"""The registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from locusloom.plans import catalogue
from locusloom.streaming.flows import hopping_counts

SF = "/root/testdata/sf0.001"
#: One query of each family; the driver runs all of them.
SOME = [
    "interval_overlap", "overlap_nonredundant", "overlap_anti", "overlap_spliced", "region_count_weighted", "region_peak_signal", "cluster_gap25_weighted", "uniq_maxScore",
    "coverage_exact", "window_hopping", "collapse_5p_barcode", "mutation_summary", "allele_pivot", "monotone_fdr", "union_transcripts", "annotate_region_summary", "sam_mutations",
]


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(round(x, 6) if isinstance(x, float) else None if x is None or x != x else str(x) if isinstance(x, str) else float(x) for x in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    rows = entry_module.entry(spark)
    assert rows.count() > 0 and "n" in rows.columns


def test_streaming_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    time = next(c for c, kind in events.dtypes if kind.startswith("timestamp"))
    key = next(c for c, kind in events.dtypes if kind == "string")
    slim = events.select(F.col(time).cast("timestamp").alias(time), key)
    slim.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = hopping_counts(spark.readStream.schema(slim.schema).parquet(str(tmp_path / "in")), time, "10 minutes", "5 minutes", "100 days", [key])
    query = stream.writeStream.format("memory").queryName("hops").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    batch = hopping_counts(slim, time, "10 minutes", "5 minutes", "100 days", [key])
    assert sorted(map(str, spark.table("hops").collect())) == sorted(map(str, batch.collect()))
