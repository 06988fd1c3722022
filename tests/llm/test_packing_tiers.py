from collections import defaultdict

import public_tokenizers
from hard_rows import SF
from locusloom.llm import packing


def test_pieces_are_routed_to_their_tier():
    slots, sequences = packing.plan_windows({1500: 1, 548: 1, 600: 1, 424: 1, 128: 2, 200: 1}, 2048)
    assert packing.tiers_of(2048) == [2048, 1024, 512, 256]
    pieces = defaultdict(int)
    for s in slots:
        pieces[s.tier, s.length] += s.hi - s.lo
    # The long window's gap takes 548, a full 1,024 and a full 256 stay; 200 would leave its own part empty.
    assert dict(pieces) == {(2048, 1500): 1, (2048, 548): 1, (1024, 600): 1, (1024, 424): 1, (256, 128): 2, (2048, 200): 1}
    assert sequences == 4
    assert packing.tier_steps(slots, sequences, 2048) == {2048: (0, 0, 1), 1024: (2, 1, 1), 256: (3, 2, 1)}


def test_steps_hold_one_tier_each(spark, monkeypatch):
    monkeypatch.setattr(packing, "STEP_SEQUENCES", 4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).collect()
    tiers, tokens, size, steps = defaultdict(set), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        tiers[r.step].add(r.tier)
        tokens[r.sequence_id] += r.length
        size[r.sequence_id] = r.tier
        steps[r.step] += r.length
    assert all(len(own) == 1 for own in tiers.values())
    assert {t for own in tiers.values() for t in own} > {2048}
    assert all(n <= size[s] for s, n in tokens.items())
    assert max(steps.values()) <= 4 * 2048
    print("padding", 1 - sum(tokens.values()) / sum(size.values()))
