import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hard_rows import HARD
from locusloom.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = tokens.Encoder(tokens.read_vocabulary(PATH))


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("ab '.\n\t é½漢<|endoftext|>s19ŉǅ\u00a0\x1c"))), max_size=60))
def test_pieces_equal_the_library(text):
    pieces = ENCODER.pieces(text)
    got = ENCODER.whole(text) if pieces is None else [i for p in pieces for i in ENCODER.merge(p)]
    assert got == library_ids(text)


@pytest.mark.parametrize("text", ["“It’s” — 5 € …", "漢字かな交じり文。", "Привет, мир! Ελληνικά", "a🙂b 👩‍👩‍👧 ok", "x\u00a0y\u2003z \u3000", "١٢٣ ²³½ Ⅷ", "e\u0301 ñ", "𝔸𝕓𝟙 𐍈", "don’t can't"])
def test_text_of_any_script_goes_through_the_lookup(text):
    pieces = ENCODER.pieces(text)
    assert pieces is not None and "".join(pieces) == text
    assert [i for p in pieces for i in ENCODER.merge(p)] == library_ids(text)


def test_classes_of_all_assigned_characters_equal_the_library():
    known = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(known), 16_384):
        text = "".join(f"a{c}1{c}!{c}\n" for c in known[at : at + 16_384] if tokens._settled(c))
        want = [text[s:e] for _, (s, e) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]
        assert tokens.split_text(text) == want
    assert tokens.split_text("a\u0378") is None and tokens.split_text("a\x1cb") is None


def test_pilot_with_null_identifiers_is_a_share(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    found = tokens.frequent_pieces(docs, tokens.read_vocabulary(PATH), "text", pilot=100)
    assert 20 < len(found) < 1000


def test_other_vocabularies_use_the_library():
    other = tokens.Encoder(tokens.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    assert other.pieces("some words") is None


def test_counts(documents, hard):
    for df, rows in ((documents, [tuple(r) for r in documents.collect()]), (hard, HARD)):
        got = tokens.count_tokens(df, PATH).collect()
        want = sorted(str((r[0], len((r[1] or "").encode()), len(library_ids(r[1])))) for r in rows)
        assert sorted(str((r.doc_id, r.n_bytes, r.n_tokens)) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.count_tokens(hard.limit(0), PATH).count() == 0


def test_cache_starts_again_when_full(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    cache = tokens._Cache(len, {"table": 5})
    assert [cache[w] for w in ("a", "bb", "ccc", "dddd", "a", "table")] == [1, 2, 3, 4, 1, 5]
    assert len(cache) <= 5


def check_packing(df, rows, window):
    got = packing.pack_documents(df, PATH, window=window).collect()
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append(library_ids(r[1]) + [1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        # Rows that repeat an identifier repeat its pieces.
        copies = len(ids[i])
        bytes_ = [np.array(x, "<u4").tobytes() for x in ids[i]]
        assert sorted(r.ids for r in own) == sorted(b[at : at + 4 * window] for b in bytes_ for at in range(0, len(b), 4 * window))
        if copies == 1:
            whole = b"".join(r.ids for r in sorted(own, key=lambda r: r.start))
            assert whole == bytes_[0] and all(r.doc_tokens == len(ids[i][0]) for r in own)
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
        total += at
    return padding / max(1, total), sequences


def test_packing_of_documents(documents):
    waste, sequences = check_packing(documents, [tuple(r) for r in documents.collect()], 2048)
    assert waste < 0.03
    steps = defaultdict(int)
    for own in sequences.values():
        steps[own[0].step] += sum(r.length for r in own)


def test_packing_of_hard_rows(hard):
    check_packing(hard, HARD, 64)
    assert packing.pack_documents(hard.limit(0), PATH).count() == 0


def test_large_layouts_are_joined(documents, monkeypatch):
    monkeypatch.setattr(packing, "MOST_SLOTS", 0)
    check_packing(documents, [tuple(r) for r in documents.collect()], 128)


def test_padding_by_tier_adds_up(documents):
    packed = packing.pack_documents(documents, PATH, with_ids=False)
    rows = packing.padding_by_tier(packed).collect()
    assert sum(r.tokens for r in rows) == packed.agg(F.sum("length")).first()[0]
    assert sum(r.sequences for r in rows) == packed.select("sequence_id").distinct().count()
    assert all(r.padding == 0 for r in rows if r.tier < 2048) and all(0 <= r.padding < 0.05 for r in rows)


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    window = rng.choice([16, 64, 256])
    counts = {n: rng.randrange(1, 4000) for n in rng.sample(range(1, window + 1), rng.randrange(1, window))}
    slots, sequences = packing.plan_windows(counts, window)
    filled, ranks = defaultdict(list), defaultdict(list)
    for s in slots:
        ranks[s.length].append((s.lo, s.hi))
        for rank in range(s.lo, s.hi):
            q, j = divmod(rank - s.lo, s.each)
            filled[s.sequence + q].append((s.offset + j * s.length, s.length))
    for n, own in ranks.items():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == counts[n] and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    assert set(filled) == set(range(sequences))
    for own in filled.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= window
    # No two windows could be one.
    total = sum(n * c for n, c in counts.items())
    assert sequences <= 2 * total / window + 1


def test_long_pretokens_are_not_kept():
    cache = tokens._Cache(len, {})
    assert cache["x" * 10_000] == 10_000 and not cache
    assert cache["x" * tokens.CACHE_LENGTH] == tokens.CACHE_LENGTH and len(cache) == 1


def test_a_third_without_identifiers_and_long_words(spark):
    """Rows without an identifier, or with one text in common, spread over slices as others do."""
    rows = [(None if i % 3 == 0 else i, "one and the same" if i % 2 else "z" * 10_000 + f" {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_packing(df, rows, 64)
    wants = sorted(str((i, len(library_ids(t)))) for i, t in rows)
    assert sorted(str((r.doc_id, r.n_tokens)) for r in tokens.count_tokens(df, PATH).collect()) == wants


def test_slices_of_a_length_are_even(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 500)
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    seen = {}
    real = packing.uniform
    monkeypatch.setattr(packing, "uniform", lambda key: seen.setdefault("slice", real(key)))
    packed = packing.pack_documents(df, PATH, with_ids=False)
    assert packed.count() == 4000
    assert "place" in str(seen["slice"])
