"""Queries that once read a part of their tables run over whole inputs."""

import pytest

from locusloom.plans import catalogue
from test_catalogue import SF, canonical, duck  # noqa: F401

READS = ["seq_dedup_fasta", "seq_dedup_fastq", "barcode_strip", "index_filter", "max_n_filter", "quality_filter", "revcomp", "hamming", "qualities"]

TABLES = ["annotate_region", "annotate_region_summary", "lookup_outer_text", "monotone_fdr"]


@pytest.mark.parametrize("name", READS + TABLES)
def test_whole_query_equals_sql(spark, duck, name):  # noqa: F811
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert canonical(got) == canonical(want)


def test_reads_are_whole_texts(spark):
    docs = {f"q{r.doc_id}": r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = catalogue.queries()["revcomp"](spark, SF).collect()
    assert {r.id: len(r.seq) for r in rows} == {i: sum(c.isascii() and c.isalpha() for c in t.lower()) for i, t in docs.items()}
    assert len(catalogue.queries()["hamming"](spark, SF).collect()) == len(docs)


def test_all_genes_and_mutations_take_part(spark):
    views = catalogue._views(spark, SF)
    assert catalogue._sets(views)["genic"].count() == views["genes"].count()
    found = catalogue.queries()["lookup_outer_text"](spark, SF)
    assert found.where("build_mtype != 'none'").count() == views["mutations"].count() < found.count()
    assert all("% 3" not in catalogue._QUERIES[n][1] and "% 2 = 0" not in catalogue._QUERIES["lookup_outer_text"][1] for n in TABLES)
