import re

import corpus_pipeline
import pytest
from hard_rows import HARD, SF
from locusloom.llm import queries, toxicity
from locusloom.llm.simhash import fingerprint_of
from pyspark.sql import functions as F


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        steps[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == columns
    assert list(steps) == ["toxicity", "exact dedup", "simhash near-dedup", "source mixing", "packing"]
    before, after = steps["toxicity"]
    labelled = spark.read.parquet(f"{SF}/labels.parquet")
    labels = {r.doc_id: r.toxic for r in labelled.collect()}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    model = toxicity.learn_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labelled)
    plain, learnt = toxicity.Matcher(), model.matcher()
    assert gone == {r.doc_id for r in before if model.score(learnt, r.text) >= 0.7}
    # What goes holds a word of the grammar or a learnt stem, and is not labelled clean.
    assert gone and all(learnt.match(r.text) for r in before if r.doc_id in gone)
    assert not any(labels.get(i) == 0 for i in gone)
    assert not any(labels.get(r.doc_id) and plain.match(r.text)["insult"] > 1 for r in after)
    before, after = steps["exact dedup"]
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    assert len(after) == len({normal(r.text) for r in before}) == len({normal(r.text) for r in after})
    before, after = steps["simhash near-dedup"]
    prints = [fingerprint_of(r.text) for r in after]
    assert all(bin(a ^ b).count("1") > 3 for i, a in enumerate(prints) for b in prints[i + 1 :])
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    before, after = steps["source mixing"]
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(after) - words(before)) <= 20
    packed = steps["packing"][1]
    assert {r.doc_id for r in packed} == {r.doc_id for r in after}


def test_every_number_is_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.fixture
def hard_folder(spark, hard, tmp_path):
    labels = spark.createDataFrame([(1, 0), (9, 1), (8, 0), (None, 1), (10, None), (77, 1)], "doc_id long, toxic int")
    labels.withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_on_hard_rows(spark, hard, hard_folder):
    hard.write.parquet(f"{hard_folder}/documents.parquet")
    docs = spark.read.parquet(f"{hard_folder}/documents.parquet")
    left = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left[-1], hard_folder)
        assert out.columns == docs.columns, name
        left.append(spark.createDataFrame(out.collect(), docs.schema))
    ids = [sorted(str(r.doc_id) for r in df.collect()) for df in left]
    assert len(ids[0]) == len(HARD)
    assert ids[1] == sorted(str(r[0]) for r in HARD if r[0] != 9)
    # 1 stays for 5 and 7 once; 2 for the nameless row without a text; 3 (empty) equals 2, 4 (blank) is one space.
    assert ids[2] == sorted(["1", "2", "4", "6", "7", "8", "10", "None"])
    # Texts without words are alike.
    assert ids[3] == sorted(["1", "2", "6", "7", "8", "10", "None"])
    assert set(ids[4]) <= set(ids[3])
    packed = corpus_pipeline.STAGES[-1][1](spark, left[-1], hard_folder).collect()
    assert {str(r.doc_id) for r in packed} == set(ids[4])
    assert {str(r.doc_id) for r in corpus_pipeline.run(spark, hard_folder).collect()} == set(ids[4])


def test_run_on_an_empty_table(spark, hard, hard_folder):
    hard.limit(0).write.parquet(f"{hard_folder}/documents.parquet")
    out = corpus_pipeline.run(spark, hard_folder)
    assert out.count() == 0 and "sequence_id" in out.columns
