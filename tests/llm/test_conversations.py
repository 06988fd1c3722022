import hashlib
import random
import re
import zlib
from functools import cache

import duckdb
import pytest

from locusloom.llm import conversations
from locusloom.llm.conversations import repair_conversations
from locusloom.llm.queries import op11_conversation_repair, oracle_sql

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        turns = out.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        names = (" " if v is None else v for v in (conv, turn))
        kind = zlib.crc32(":".join(map(str, names)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        turns += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def repaired(turns):
    """Counts, least cost and audit by recursion over suffixes, and the lines that remain."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    seen, faults = set(), []
    for _, role, text in turns:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if blank else "duplicate" if (role, text) in seen else None if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated")
        seen.add((role, text))

    @cache
    def best(i, state, inserts):
        ways = []
        if i == len(turns):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            _, role, text = turns[i]
            cost, audit, lines = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit, lines))
            if faults[i] in (None, "truncated"):
                for name, letter in [(role, "K"), ("user", "R"), ("assistant", "R")]:
                    to = NEXT.get((state, name[:1]))
                    if to:
                        cost, audit, lines = best(i + 1, to, 0)
                        ways.append((cost + 3 * (letter == "R") + 3 * (faults[i] == "truncated"), letter + audit, (f"{name}:{text}", *lines)))
        if inserts < 3:
            for name in ("user", "assistant"):
                to = NEXT.get((state, name[0]))
                if to:
                    cost, audit, lines = best(i, to, inserts + 1)
                    ways.append((cost + 3, "I" + audit, (f"{name}:", *lines)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    numbers = [t for t, *_ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
ROLES = ["user", "assistant", "system", "tool", None, "", "s", "ux"]
TEXTS = ["Yes.", "No", "Why? ", "", " \n", None, "a. ", "Yes.", "ok!\t", "b"]


def rows_of(seed, conversations=60, longest=12):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        conv = None if conv == 7 else conv
        rows += [(conv, rng.choice([None, *range(i, i + 3)]), rng.choice(ROLES), rng.choice(TEXTS)) for i in range(rng.randrange(longest))]
    return rows


def of_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    found = op11_conversation_repair(spark, str(tmp_path)).collect()
    assert len(found) == len({r[0] for r in rows})
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found}


def same(found, rows):
    for conv, turns in damaged(rows).items():
        assert (conv, *found[conv]) == (conv, *repaired(turns)), turns


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, tmp_path, seed):
    rows = rows_of(seed)
    same(of_query(spark, rows, tmp_path), rows)


def test_long_conversations_are_solved_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "LONG_ROWS", 5)
    monkeypatch.setattr(conversations, "PART_ROWS", 4)
    rows = rows_of(3, 12, 40) + [(3, 5, "user", "again and again")] * 30
    same(of_query(spark, rows, tmp_path), rows)
    monkeypatch.setattr(conversations, "BATCH_ROWS", 3)
    monkeypatch.setattr(conversations, "LONG_ROWS", 100)
    same(of_query(spark, rows, tmp_path), rows)


def test_turns_in_order_with_their_edits(spark, monkeypatch):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", "Yes"), (2, 0, "assistant", " ")]
    expected = [(1, 0, "D", "user", "Hi."), (1, 1, "K", "user", "There."), (1, 2, "K", "assistant", "Yes"), (2, 0, "D", "assistant", " ")]
    # Deleting (4) and inserting (3) compete: an inserted answer is cheaper than a deletion.
    expected = [(1, 0, "K", "user", "Hi."), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "There."), (1, 3, "K", "assistant", "Yes"), (2, 0, "D", "assistant", " ")]
    for most in (1024, 1):
        monkeypatch.setattr(conversations, "LONG_ROWS", most)
        turns = repair_conversations(spark.createDataFrame(rows, SCHEMA)).turns()
        assert sorted(map(tuple, turns.collect())) == expected


def test_empty_table_and_clashing_names(spark, tmp_path):
    assert of_query(spark, [], tmp_path) == {}
    wide = spark.createDataFrame([(1, 0, "user", "Hi.", 1, 2)], SCHEMA + ", part int, audit int").withColumnRenamed("text", "body")
    found = repair_conversations(wide, text_col="body").report.collect()
    assert [(r["conv_id"], r["cost"], r["audit"]) for r in found] == [(1, 3, "KI")]


def test_query_equals_sql(spark, tmp_path):
    """On a given table and on hard rows; the SQL takes the whole table as one batch."""
    rows = rows_of(5, 40, 10)
    of_query(spark, rows, tmp_path)
    for folder, glob in (("/root/testdata/sf0.001", "conversations.parquet"), (str(tmp_path), "conversations.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/{glob}'")
        expected = con.execute(oracle_sql()["op11_conversation_repair"]).fetchall()
        found = op11_conversation_repair(spark, folder).select("conv_id", *COLUMNS).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected)) and len(expected) > 5
