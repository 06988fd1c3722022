import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusloom.llm import language_id
from locusloom.llm.language_id import bag, fit, learn_languages, name_languages, words_of
from locusloom.llm.queries import op13_language_id

MASK = (1 << 64) - 1
FACTOR, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def plain_bucket(value, kind):
    value = (value + kind) * MIX & MASK
    value = (value ^ (value >> 29)) * FACTOR & MASK
    return (value >> 32) % language_id.BUCKETS


def plain_bag(words):
    """Subwords one at a time, in integers of any size."""
    counts = Counter()
    for word, times in words.items():
        points = [ord(c) for c in f"<{word}>"]
        for n in range(1, language_id.LONGEST + 1):
            for i in range(len(points) - n + 1):
                rolling = 0
                for c in points[i : i + n]:
                    rolling = (rolling * FACTOR + c) & MASK
                counts[plain_bucket(rolling, n)] += times
        whole, power = 0, 1
        for c in points:
            power = power * FACTOR & MASK
            whole = (whole + c * power) & MASK
        counts[plain_bucket(whole, 0)] += times
    return counts


@pytest.mark.parametrize("text", ["", "a", "Ein Wort, zwei Wörter; ein 1 漢字 \U00010400x", "été " * 50 + "x" * 5000, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(3000))])
def test_subwords_equal_a_plain_count(text, monkeypatch):
    monkeypatch.setattr(language_id, "_BLOCK", 1000)
    ids, counts = bag(words_of(text))
    assert dict(zip(ids.tolist(), counts.tolist(), strict=True)) == plain_bag(words_of(text))


def test_words_are_runs_of_letters_with_marks():
    assert words_of("Don't STOP ½ 3x éa _b") == Counter({"don": 1, "t": 1, "stop": 1, "x": 1, "éa": 1, "b": 1})
    assert sum(len(w) * n for w, n in words_of("y" * 20_000).items()) == 20_000


def test_fit_follows_the_gradient_of_the_loss():
    """One step on one text lowers its loss, and two languages of different letters part."""
    bags = [bag(words_of(t)) for t in ["abc abd", "xyz xyw", "bcd abc", "zyx wxy"]]
    model = fit(bags, np.array([0, 1, 0, 1]), ["p", "q"], epochs=20)
    assert [model.predict(t)[0] for t in ("abcd", "wxyz")] == ["p", "q"]


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    found = op13_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(found) == 1000
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    held = [r for r in found if r["held_out"] and r["lang_pred"] != "und"]
    for lang in {r["lang"] for r in held}:
        mine = [r for r in held if r["lang"] == lang]
        assert sum(r["lang_pred"] == lang for r in mine) >= 0.97 * len(mine)
    # Scores are calibrated: what passes the threshold is nearly always right.
    passed = [r for r in held if r["accepted"]]
    assert len(passed) >= 0.95 * len(held) and sum(r["lang_pred"] == r["lang"] for r in passed) >= 0.99 * len(passed)


def test_held_out_labels_and_other_columns_teach_nothing(spark, documents):
    changed = documents.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    one, two = learn_languages(documents), learn_languages(changed)
    assert one.languages == two.languages and "zz" not in two.languages and np.allclose(one.logits, two.logits)


def test_unknown_writing_is_named_with_doubt(spark, documents):
    model = learn_languages(documents)
    rows = spark.createDataFrame([(1, "ლე ქართ ნიკა მო"), (2, "qqq xkcd")], "doc_id long, text string")
    known = name_languages(documents, model).agg(F.avg("score")).head()[0]
    assert all(r["score"] < known for r in name_languages(rows, model).collect())


def test_hard_empty_and_clashing(spark, hard, documents):
    model = learn_languages(documents)
    found = name_languages(hard.withColumn("accepted", F.lit("x")).withColumn("check", F.lit(1)), model)
    rows = found.collect()
    assert len(rows) == 13 and found.columns == ["doc_id", "held_out", "lang_pred", "score", "accepted"]
    assert sum(r["lang_pred"] == "und" and r["score"] == 0 and not r["accepted"] for r in rows) == 4
    assert len({(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] == 7}) == 1
    learn_languages(hard.withColumn("check", F.lit(1)).withColumn("drawn", F.lit(1)))
    empty = documents.limit(0)
    nothing = learn_languages(empty)
    assert nothing.languages == [] and name_languages(empty, nothing).count() == 0
    assert {r["lang_pred"] for r in name_languages(hard, nothing).collect()} == {"und"}
