import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from locusloom.llm import exact_dedup, mixing, sharding, splitters

from hard_rows import HARD, SCHEMA


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[normal(text)].append(i)
    out = []
    for text, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = known[0] if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(map(str, out))


def check_dedup(df, rows):
    got = exact_dedup.exact_dedup(df).select("doc.doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == brute_dedup(rows)
    assert set(Counter(r.text_sha256 for r in got if r.kept).values()) <= {1}
    assert {r.text_sha256 for r in got if r.kept} == {r.text_sha256 for r in got}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_dedup_of_hard_rows(hard):
    check_dedup(hard, HARD)


def test_dedup_of_documents(documents):
    check_dedup(documents, [tuple(r) for r in documents.collect()])


def test_dedup_cuts_a_hot_text(spark):
    rows = [(i, "hot   text" if i % 3 else f"text {i}") for i in range(3000)]
    check_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows)
    nobody = [(None, "same")] * 900 + [(i, f"t{i}") for i in range(50)]
    check_dedup(spark.createDataFrame(nobody, "doc_id long, text string"), nobody)


def test_hot_text_without_identifiers_is_cut(spark):
    rows = [(None, "same  text") if i % 2 else (i, f"text {i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = exact_dedup.exact_dedup(df)
    kept = out.where("kept").select("doc.text", "group_size").collect()
    assert len(kept) == 2001 and [r.group_size for r in kept if r.text.startswith("same")] == [2000]
    check_shards(df, rows, "bytes", 6)


def test_drop_copies_keeps_columns(hard):
    kept = exact_dedup.drop_copies(hard)
    assert kept.columns == hard.columns and kept.count() == len({normal(r[1]) for r in HARD})


def test_range_is_a_binary_search(spark):
    bounds = [3, 7, 7, 20]
    df = spark.range(25).select("id", splitters.range_of(F.col("id"), bounds, "bigint").alias("r"))
    assert all(r.r == sum(b <= r.id for b in bounds) for r in df.collect())
    assert splitters.quantiles([5, 1, 9, 3], 2) == [5] and splitters.quantiles([], 4) == []


def check_shards(df, rows, law, shards):
    got = sharding.shard_documents(df, shards, law).collect()
    assert len(got) == len(rows)
    want = sorted(str((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for i, t, *_ in rows)
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r)
    for s, own in slots.items():
        assert 0 <= s < shards and sorted(r.slot for r in own) == list(range(len(own)))
    if law == "rows":
        counts = [len(slots.get(s, ())) for s in range(shards)]
        assert max(counts) - min(counts) <= 1
    else:
        total, largest = sum(r.size for r in got), max((r.size for r in got), default=0)
        for s in range(shards):
            own = sum(r.size for r in slots.get(s, ()))
            assert abs(own - total / shards) <= largest + 0.02 * total / shards
    return got


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(documents, hard, law):
    rows = [tuple(r) for r in documents.collect()]
    first = check_shards(documents, rows, law, 5)
    again = check_shards(documents.repartition(7), rows, law, 5)
    place = lambda got: {r.doc_id: (r.shard, r.slot) for r in got}
    assert place(first) == place(again)
    check_shards(hard, HARD, law, 3)
    check_shards(hard.limit(0), [], law, 3)


def test_shards_split_a_hot_text_and_keep_small_groups(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i // 2}") for i in range(6000)]
    got = check_shards(spark.createDataFrame(rows, "doc_id long, text string"), rows, "bytes", 8)
    text = dict(rows)
    shards = defaultdict(set)
    for r in got:
        shards[text[r.doc_id]].add(r.shard)
    assert len(shards["hot text"]) > 1
    assert all(len(s) == 1 for t, s in shards.items() if t != "hot text")
    with pytest.raises(ValueError):
        sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), law="key")


def brute_targets(sizes):
    """Reshare the excess until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        over = sum(weight[s] for s in free)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / over for s in names}
        above = {s for s in free if target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


def check_mix(df, rows):
    got = mixing.mix_sources(df).select("doc.doc_id", "doc.source", "size", "source_size", "target", "taken").collect()
    sizes = defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    return taken, want


def test_mix_meets_targets(documents):
    rows = [tuple(r) for r in documents.collect()]
    taken, want = check_mix(documents, rows)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = {str(r) for r in mixing.mix_sources(documents.repartition(5)).select("doc.doc_id", "taken").collect()}
    assert again == {str(r) for r in mixing.mix_sources(documents).select("doc.doc_id", "taken").collect()}


def test_mix_of_hard_rows(spark, hard):
    taken, want = check_mix(hard, HARD)
    assert all(abs(taken[s] - want[s]) <= 2 for s in want)
    assert mixing.mix_sources(hard.limit(0)).count() == 0
    assert mixing.mix_sources(spark.createDataFrame([(1, None, "", "a")], SCHEMA)).first().taken == 0


def test_mixed_documents_carry_the_words(spark):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(20)), "en", "abc"[i % 3]) for i in range(30)] + [(99, "a  b\tc", "en", "d")]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = {r.doc_id: r.taken for r in mixing.mix_sources(df).select("doc.doc_id", "taken").collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert dict((i, t) for i, t, *_ in rows)[r.doc_id].startswith(r.text)
    assert {k: v for k, v in plan.items() if v} == dict(words)


@pytest.mark.parametrize("ids", ["one", "null", "third", "alike"])
def test_mix_meets_targets_where_identifiers_repeat(spark, monkeypatch, ids):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 500)
    rows = [(i, " ".join(f"w{i % 7}_{j}" for j in range(1 + i * 37 % 90)), "en", "abc"[i % 3]) for i in range(600)]
    rows = [({"one": 7, "null": None, "third": None if i % 3 == 0 else i // 5, "alike": 1}[ids], "same words in all of them" if ids == "alike" else text, lang, source) for i, text, lang, source in rows]
    rows += [(7, "x", "en", "d"), (7, "y " * 99, "en", "d")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    taken, want = check_mix(df, rows)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    words = Counter()
    for r in mixing.mixed(df).collect():
        words[r.source] += len(r.text.split())
    assert dict(words) == {s: n for s, n in taken.items() if n}
