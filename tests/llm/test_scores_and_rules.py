import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from hard_rows import SF
from locusloom.llm import queries, quality, toxicity, url_filter


def brute_rule(host, path, rules):
    best = None
    for verdict, h, p in rules:
        fits = (host == h or host.endswith("." + h)) and path.startswith(p)
        if fits and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return best


RULES = [*queries.RULES, ("block", "a.b", ""), ("allow", "a.b", "/x/y"), ("block", "a.b", "/x/yz"), ("allow", "w.a.b", "/"), ("block", "com", "")]


@pytest.mark.parametrize("rules", [queries.RULES, RULES])
def test_trie_equals_all_rules(spark, rules):
    urls = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    urls += ["http://A.B/x/yz?q", "http://a.b/x/y", "http://w.a.b/x/y/z#t", "http://w.a.b", "http://ab/x", "https://x.com", "http://EXAMPLE.net/en/", "http://example.net/en", "http://net", "http://net/", "no url", "", None, "http://", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "page_id long, url string, host int, rule int")
    got = url_filter.filter_urls(df, rules).select("page.page_id", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = url_filter.split_url(urls[r.page_id])
        want = brute_rule(host, path, rules)
        assert (r.host, r.path) == (host, path)
        assert (r.verdict, r.rule) == (want or ("allow", None))
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_long_urls_cost_no_more_than_their_length():
    trie = url_filter.RuleTrie([*RULES, ("block", "a.net", "/" + "y" * 50)])
    took = []
    for n in (1 << 20, 1 << 22):
        began = time.perf_counter()
        for url in (f"http://a.net/{'x' * n}", f"http://a.net/{'/' * (n // 4)}", f"http://{'a.' * (n // 4)}net/"):
            assert trie.judge(*url_filter.split_url(url)) == ("block", "net/")
        took.append(time.perf_counter() - began)
    assert took[1] < 2 + 16 * took[0]


def test_sql_splits_odd_urls_alike():
    urls = ["a:://b/c", "://", "x://y:8/z:://q?r", "http:///p", "::://H.NET/a#b", "a:b:c", "a://b\nc/d\ne", None, ""]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": range(len(urls)), "url": urls}))
    got = {r[0]: r[1:3] for r in con.sql(queries.OP1_SQL).fetchall()}
    assert got == {i: url_filter.split_url(u) for i, u in enumerate(urls)}


def test_url_parts_and_bad_rules():
    assert url_filter.split_url("HTTP://Exa.MPLE/P?q#f") == ("exa.mple", "/P")
    assert url_filter.split_url("x://h?a/b") == ("h", "")
    assert url_filter.split_url("mailto:x") == ("", "")
    with pytest.raises(ValueError):
        url_filter.RuleTrie([("maybe", "x", "")])
    twice = url_filter.RuleTrie([("allow", "x", "/"), ("block", "x", "/")])
    assert twice.judge("x", "/") == ("block", "x/")


def split(spark, name, label, least):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = queries.queries()[name](spark, "/root/testdata/sf0.01")
    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out]
    right = sum(r.predicted == r[label] for r in own) / len(own)
    assert right >= least
    assert scored.count() == 1000
    return own


def test_quality_on_held_out_rows(spark):
    split(spark, "op6_quality", "quality", 0.97)


def test_toxicity_on_held_out_rows(spark):
    own = split(spark, "op9_toxicity", "toxic", 0.93)
    assert not any(r.predicted and not r.toxic for r in own)
    toxic = [r for r in own if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)


def test_hard_rows_get_scores(spark, hard):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for got in (
        quality.score_quality(hard, quality.learn_quality(hard, labels)),
        toxicity.score_toxicity(hard, toxicity.learn_toxicity(hard, labels)),
        quality.score_quality(hard, quality.learn_quality(hard, labels.limit(0))),
        toxicity.score_toxicity(hard, toxicity.learn_toxicity(hard, labels.limit(0))),
    ):
        rows = got.collect()
        assert len(rows) == hard.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(hard.limit(0), toxicity.Model()).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    from locusloom.llm.labels import training_rows

    texts = {r.text for r in training_rows(docs, labels, "quality", "doc_id", "text").collect()}
    assert texts == {f"w{i}" for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert training_rows(docs, labels, "quality", "doc_id", "text", most=5).count() == 5


def matches(text):
    return dict(toxicity.Matcher().match(text))


def test_grammar_reads_clauses():
    assert matches("you are an idiot") == {"insult_at_target": 1}
    assert matches("The idiot came. What a moron!") == {"insult": 2}
    assert matches("you are not an idiot") == {"denied": 1}
    assert matches("he said you are an idiot") == {"reported": 1}
    assert matches('she called him "a total idiot"') == {"reported": 1}
    assert matches("I will kill you") == {"threat": 1}
    assert matches("we are going to hurt them") == {"threat": 1}
    assert matches("I will not kill you") == {"denied": 1}
    assert matches("doctors kill bacteria") == {}
    assert matches("the idiotic trashcan") == {}
    assert matches("not today. idiot") == {"insult": 1}
    assert matches("MORON!! MORON### x%%%") == {"insult": 2}
    assert matches(None) == matches("") == {}


def brute_places(text, stems=()):
    """Every clause of a text through the four layers one after the other, uncomposed."""
    layers = toxicity.layers()
    for clause in re.finditer(r"[^.!?;:,\n]+", (text or "").lower()):
        states = ["start"] * len(layers)
        for token in re.finditer(r"[^\W\d_]+(?:n't)?|[\"“”„«»]", clause.group()):
            word = token.group()
            symbol = "quote" if word in set("\"“”„«»") else toxicity._CLASSES.get(word, "other")
            stem = symbol == "other" and any(word.startswith(x) for x in stems)
            out = "insult" if stem else symbol
            for i, layer in enumerate(layers):
                states[i], out = layer.step.get((states[i], out), (layer.start, out))
            name = {"insult": "insult", "insult_at_target": "insult_at_target", "threatened": "threat", "denied": "denied", "reported": "reported"}.get(out)
            if name:
                yield "stem" if stem and name.startswith("insult") else name, clause.start() + token.start()


def brute_matches(text, stems=()):
    return Counter(name for name, _ in brute_places(text, stems))


def brute_score(text, model):
    matched = list(brute_places(text, model.stems))
    found, places = Counter(name for name, _ in matched), [at for name, at in matched if name == "stem"]
    z, size = model.bias, max(1, len(text or ""))
    rate = max(model.rare * model.chance, toxicity.LEAST_CHANCE)
    for name, weight in zip(toxicity.PRIOR, model.weights, strict=True):
        if name != "stem":
            n = found[name] + (found["insult_at_target"] if name == "insult" else 0)
            z += weight * math.log(1 + 9 * n)
    best = 0.0
    for stretch in toxicity.STRETCHES:
        w = min(stretch, size)
        n = max((sum(a <= b < a + w for b in places) for a in places), default=0)
        if n > rate * w:
            best = max(best, n * math.log(n / (rate * w)) - n + rate * w - math.log(size / w))
    z += list(model.weights)[-1] * math.log(1 + best)
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def test_clauses_equal_brute_force():
    rng = random.Random(6)
    words = [*toxicity.TARGETS[:4], *toxicity.SELVES[:2], "will", "not", "isn't", "said", "called", "a", "the", "are", "kill", "hurt", "idiot", "moron", "zorqa", "zorqe", "table", "he", "töten", "ich", "werde", "dich", '"', "“"]
    for _ in range(3000):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", "", ".", ",", "!"]) for _ in range(rng.randrange(1, 14)))
        assert toxicity.Matcher(stems=("zorq",)).match(text) == brute_matches(text, ("zorq",)), text


def test_threats_and_denials_of_other_languages():
    assert matches("ich werde dich töten") == {"threat": 1}
    assert matches("je vais te tuer") == {"threat": 1}
    assert matches("voy a matar") == matches("ich werde töten") == {}
    assert matches("ihr seid idioten") == {"insult_at_target": 1}
    assert matches("du bist kein trottel") == {"denied": 1}
    assert matches("dijo imbécil") == {"reported": 1}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learn_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert not model.disarmed
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.queries()["op9_toxicity"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(brute_score(texts[r.doc_id], model), abs=1e-9) and r.predicted == (r.score >= 0.7)


def test_insults_in_a_long_text_weigh_as_in_a_short_one():
    model = toxicity.Model(np.array([2.3, 1.0, 2.0, 0.0, 0.1, 3.5]), -5.5, stems=("zorq",), chance=2e-5, rare=10)  # weights as labels give them
    rng = random.Random(2)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    clause = " zorqa filler zorqeb words zorqon zorqu. Zorqil zorqat. "
    m = model.matcher()
    short, long = filler(20) + clause + filler(20), filler(20_000) + clause + filler(20_000)
    strewn = "".join(filler(10_000) + f" zorq{x} " for x in ("a", "e", "i", "o", "u", "y")) + filler(10_000)
    assert model.score(m, short) > 0.7 and model.score(m, long) > 0.7 > model.score(m, strewn)
    assert toxicity.densest([0, 10, 11, 12, 500], 5) == 3 and toxicity.densest([], 5) == 0


def test_weights_stay_in_their_bounds():
    rng = np.random.default_rng(3)
    x = rng.poisson(0.5, (400, len(toxicity.PRIOR))).astype(float)
    y = (x[:, 3] + rng.normal(0, 0.5, 400) > 0.6).astype(float)  # as if denials marked toxic texts
    weights, _ = toxicity.fit(x, y)
    for (low, high), w in zip(toxicity.BOUNDS.values(), weights, strict=True):
        assert low <= w <= high
    assert weights[3] == 0


def brute_grams(text):
    """Hashed n-grams by their definition, one window after the other."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    forms = ["=" if i and w == words[i - 1] else quality._shape(w) for i, w in enumerate(words)]
    grams = {" ".join(forms[i : i + n]) for n in (1, 2, 3) for i in range(len(forms) - n + 1)}
    grams |= {"w:" + w.lower() for i, w in enumerate(words) if not i or w != words[i - 1]}
    return sorted({xxhash.xxh32_intdigest(g) % quality.DIMENSIONS for g in grams})


def test_ngrams_equal_brute_force(documents):
    for r in documents.collect():
        assert sorted(quality.ngrams(r.text).tolist()) == brute_grams(r.text)
    assert not len(quality.ngrams(None))


def test_fit_equals_a_plain_solver():
    """Ratios by counting, and the same objective by projected gradient on the whole dual."""
    rng = np.random.default_rng(5)
    topics = [rng.choice(400, 60, replace=False) for _ in range(2)]
    labels = np.array([i % 3 == 0 for i in range(90)], int)
    rows = [np.unique(np.concatenate([rng.choice(topics[k], 12), rng.choice(400, 8)])).astype(np.int32) for k in labels]
    model = quality.fit(rows, labels, epochs=3000, tolerance=1e-9)
    n1, n0 = labels.sum(), (1 - labels).sum()
    ratio = np.zeros(quality.DIMENSIONS)
    for gram in {int(g) for r in rows for g in r}:
        c1, c0 = (sum(gram in r for r, y in zip(rows, labels, strict=True) if y == k) + 1 for k in (1, 0))
        ratio[gram] = math.log(c1 / (n1 + 2)) - math.log(c0 / (n0 + 2))
    x = np.zeros((len(rows), 401))
    for i, r in enumerate(rows):
        x[i, r], x[i, 400] = ratio[r] / len(r) ** 0.5, 1  # the bias is one more feature
    sign = 2.0 * labels - 1
    most = np.where(labels == 1, len(rows) / (2 * n1), len(rows) / (2 * n0))
    q = (sign[:, None] * x) @ (sign[:, None] * x).T
    dual, step = np.zeros(len(rows)), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(60_000):
        dual = np.clip(dual - step * (q @ dual - 1), 0, most)
    w = (dual * sign) @ x
    primal = lambda w: w @ w / 2 + (most * np.maximum(0, 1 - sign * (x @ w))).sum()
    own = np.append(np.divide(model.weights[:400], ratio[:400], where=ratio[:400] != 0, out=np.zeros(400)), model.bias)
    assert primal(own) == pytest.approx(primal(w), rel=2e-3)
    margins = [float(w[:400] @ x[i, :400]) + w[400] for i in range(len(rows))]
    got = [model.bias + float(model.weights[r].sum()) / len(r) ** 0.5 for r in rows]
    assert got == pytest.approx(margins, abs=0.02)


def test_quality_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn_quality(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.queries()["op6_quality"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        grams = brute_grams(texts[r.doc_id])
        margin = model.bias + sum(float(model.weights[g]) for g in grams) / max(1, len(grams)) ** 0.5
        assert r.score == pytest.approx(1 / (1 + math.exp(-model.slope * margin)), abs=1e-5)
        assert r.predicted == (r.score >= 0.5)
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_composition_equals_running_in_turn():
    first = toxicity.Transducer({("start", "a"): ("one", "x"), ("one", "a"): ("start", "y")})
    second = toxicity.Transducer({("start", "x"): ("seen", "p"), ("seen", "y"): ("start", "q")})
    both = toxicity.compose(first, second, ("a", "b"))
    for word in ("aab", "abaa", "bbaaa"):
        s1 = s2 = "start"
        state, want, got = both.start, [], []
        for c in word:
            s1, m = first.move(s1, c)
            s2, o = second.move(s2, m)
            want.append(o)
            state, o = both.move(state, c)
            got.append(o)
        assert got == want


def test_tame_words_are_disarmed(spark):
    docs = spark.createDataFrame([(i, "the clown came" if i % 2 else "you moron, you moron") for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(0.5).alias("q"), (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.learn_toxicity(docs, labels)
    assert model.disarmed == {"clown"}
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert scores[0] > 0.7 > scores[1]


def test_stems_are_learnt_from_labels(spark):
    rng = random.Random(4)
    syllables = ["ba", "do", "ki", "lu", "ne", "po", "ra", "su"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(3))
    rows = []
    for i in range(900):
        words = [word() for _ in range(60)]
        if i % 8 == 0:
            words[7] = words[30] = "zorq" + word()
            words[50] = "zorq" + word()
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(docs, labels)
    assert model.stems == ("zorq",)
    assert all(r.predicted == (r.doc_id % 8 == 0) for r in toxicity.score_toxicity(docs, model).collect())


def test_copies_of_one_text_teach_no_stem(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    one = " ".join(word() for _ in range(200))
    rows = [(i, one if i % 8 == 0 else " ".join(word() for _ in range(60)), int(i % 8 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert toxicity.learn_toxicity(docs, labels).stems == ()


def test_ngrams_taken_to_the_driver_are_bounded(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    taken = []
    monkeypatch.setattr(quality, "fit", lambda rows, marks: taken.append(sum(map(len, rows))))
    quality.learn_quality(docs, labels)
    monkeypatch.setattr(quality, "MOST_NGRAMS", taken[0] // 2)
    quality.learn_quality(docs, labels)
    assert 0 < taken[1] <= taken[0] // 2


PLANTED = [
    ("threat", "Wait there. I will kill you tomorrow.", 1), ("threat", "ich werde dich töten", 1), ("insult", "Shut up, you are a pathetic idiot! You stupid loser, you are trash.", 1),
    ("denied", "You are not an idiot. You are not stupid, you are never pathetic! They are not clowns.", 0),
    ("reported", "My teacher said you are an idiot. She called them losers; he said you are stupid. He wrote you are trash.", 0), ("threatless", "The film will kill time; they shoot at noon.", 0),
]


def test_planted_clauses_and_their_layers(spark, tmp_path, monkeypatch):
    """Threats are caught, denials and reports left alone, in the query; without their layers they are not."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = spark.createDataFrame([(10_000_000 + i, text) for i, (_, text, _) in enumerate(PLANTED)], "doc_id long, text string")
    docs.select("doc_id", "text").union(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id - 10_000_000: r.predicted for r in queries.op9_toxicity(spark, str(tmp_path)).where("doc_id >= 10000000").collect()}
    assert [got[i] for i in range(len(PLANTED))] == [toxic for _, _, toxic in PLANTED]
    model = toxicity.learn_toxicity(docs, labels)
    negation, report, threat, insult = toxicity.layers()
    nothing = toxicity.Transducer({})
    for kind, layers in (("denied", [nothing, report, threat, insult]), ("reported", [negation, nothing, threat, insult]), ("threat", [negation, report, nothing, insult])):
        monkeypatch.setattr(toxicity, "layers", lambda layers=layers: layers)
        matcher = model.matcher()
        assert [model.score(matcher, text) >= 0.7 for name, text, toxic in PLANTED if name == kind] != [bool(toxic) for name, text, toxic in PLANTED if name == kind]


def test_rarity_is_chosen_within_the_rows_given():
    rng = np.random.default_rng(1)
    size = np.full(300, 2000.0)
    labels = (np.arange(300) % 2).astype(float)
    stems = np.where(labels == 1, rng.poisson(6, 300), rng.poisson(0.4, 300)).astype(float)
    counts = np.column_stack([np.zeros((300, 5)), stems, *([stems] * len(toxicity.STRETCHES)), size])
    assert toxicity.best_rarity(counts, labels, 2e-4) in toxicity.RARE_LANGUAGE
    assert toxicity.best_rarity(counts, labels, 2e-4) == toxicity.best_rarity(counts, labels, 2e-4)
