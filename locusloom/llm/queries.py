"""The registered queries of the numbered operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, embedding_dedup, exact_dedup, language_id, mixing, packing, quality, sharding, simhash, tokens, toxicity, url_filter, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, RULES).select("page.page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                 ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS v(verdict, rule_host, rule_path)),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM a),
m AS (
  SELECT page_id, arg_max(verdict, length(rule_host || rule_path)) AS verdict,
         arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m USING (page_id)
"""


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24, law="bytes")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc.doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || doc_id), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS nth FROM s),
w AS (SELECT *, [5, 2, 1][(nth % 3 + 1)::INT] AS weight, source_size * 3 AS cap FROM n),
r AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, nth) AS rank FROM w),
l AS (SELECT *, ((sum(source_size) OVER () - (sum(cap) OVER (ORDER BY rank) - cap))::DOUBLE
                 / (sum(weight) OVER () - sum(weight) OVER (ORDER BY rank) + weight)::DOUBLE) AS level FROM r),
f AS (SELECT min(rank) AS first FROM l WHERE level <= cap::DOUBLE / weight),
t AS (SELECT l.source, l.source_size,
             CASE WHEN f.first IS NULL OR l.rank < f.first THEN l.cap::DOUBLE
                  ELSE l.weight * (SELECT level FROM l AS k WHERE k.rank = f.first) END AS target
      FROM l CROSS JOIN f),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM b),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.budget - e.whole * e.source_size AS rest,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id) - d.size)::BIGINT AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM p
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, quality.learn_quality(docs, _table(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, _vocabulary(), with_ids=False)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc.doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, toxicity.learn_toxicity(docs, _table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, _vocabulary(), limit=512)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name = F.concat(F.coalesce(turns["conv_id"].cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turns["turn"].cast("string"), F.lit(" ")))
    found = conversations.repair_conversations(conversations.damage(turns, F.crc32(F.encode(name, "UTF-8")))).digests()
    every = turns.select("conv_id").distinct()
    counts = [F.coalesce(found[c], F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    texts = [F.coalesce(found["audit"], F.lit("")).alias("audit"), F.coalesce(found["repaired_sha256"], F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return every.join(found, every["conv_id"].eqNullSafe(found["conv_id"]), "left").select(every["conv_id"], *counts, *texts)


def _op11_sql() -> str:
    """The whole table as one batch; crc32 by its table of bytes."""
    body = conversations.WHOLE_SQL.strip().removeprefix("WITH RECURSIVE")
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS steps
  FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
named AS (SELECT *, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes FROM conversations),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind
  FROM named, crc),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM keyed),
turns AS (
  SELECT conv_id, 0 AS part, turn, role, text, NULL::BOOLEAN AS again,
         CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 'truncated' END AS fault
  FROM damaged),
report AS (WITH RECURSIVE {body}),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(list_transform(list_filter(r.turns, lambda t: t.edit != 'D'), lambda t: t.role || ':' || t.text), chr(10)), '')) AS repaired_sha256
FROM every e LEFT JOIN report r ON e.conv_id IS NOT DISTINCT FROM r.conv_id
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    summed = vector_codes.with_totals(found.rows, F.col("row.label"), F.col("error"), "label_error")
    return summed.select("row.vec_id", code.alias("code"), "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))


def _op12_sql() -> str:
    """Rounds written out, every distance computed."""
    text = """
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, list_transform(v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)], lambda c: c::DOUBLE) AS v FROM k, range(4) r(p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 256),
b0 AS MATERIALIZED (SELECT p, e, v FROM x JOIN f USING (vec_id)),"""
    for i in range(5):
        text += f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, x.p, arg_min(e, (list_inner_product(b.v, b.v) - 2 * list_inner_product(x.v, b.v), e)) AS e,
         (min(list_inner_product(x.v, x.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(x.v, b.v)))::BIGINT AS d
  FROM x JOIN b{i} b ON x.p = b.p GROUP BY vec_id, x.p),"""
        if i < 4:
            text += f"""
m{i} AS (SELECT p, e, i, floor(sum(c) / count(*)) AS c FROM (SELECT a.p, a.e, unnest(range(len(v))) AS i, unnest(v) AS c FROM a{i} a JOIN x USING (vec_id, p)) GROUP BY p, e, i),
n{i} AS (SELECT p, e, list(c ORDER BY i) AS v FROM m{i} GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{i} b LEFT JOIN n{i} n ON b.p = n.p AND b.e = n.e),"""
    return text + """
s AS (SELECT sha256(string_agg(list_aggregate(list_transform(v, lambda c: c::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY p, e)) AS books FROM b4),
c AS (SELECT vec_id, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, books AS codebooks_sha256
FROM c JOIN k USING (vec_id), s
"""


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.name_languages(docs, language_id.learn_languages(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_simhash": op3_simhash,
        "op4_sharding": op4_sharding,
        "op5_source_mixing": op5_source_mixing,
        "op6_quality": op6_quality,
        "op7_packing": op7_packing,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_token_counts": op10_token_counts,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_vector_codes": op12_vector_codes,
        "op13_language_id": op13_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op5_source_mixing": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op11_conversation_repair": _op11_sql(), "op12_vector_codes": _op12_sql()}
