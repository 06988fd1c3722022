"""The registered queries over the fixture tables, and the same in SQL.

The driver's tables are read as tags, regions, mutations and gene models; the SQL text of
these views runs on both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import hamming, qualities, reverse_complement
from ..model import packed, unpacked, with_defaults
from ..operators import cluster as C
from ..operators import collapse as K
from ..operators import coverage as V
from ..operators import fdr as R
from ..operators import genes as G
from ..operators import geometry as M
from ..operators import mutations as U
from ..operators import overlap as O
from ..operators import ranks as N
from ..operators import reads as S
from ..operators import rows as T
from ..operators.differential import differential
from ..operators.scan import numbered
from ..sources.alignments import mutations_of, novoalign_columns, parse_novoalign, parse_sam, sam_columns, sam_tags
from ..sources.bed import bed_lines
from . import alleles, annotate, cims, cits, peaks

TAGS = """
select concat('chr', l_suppkey % 5) as chrom,
       l_partkey*40 + l_linenumber*7 as chromStart,
       l_partkey*40 + l_linenumber*7 + 10 + cast(l_quantity as bigint) as chromEnd,
       concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice*100) as bigint)) as name,
       l_quantity as score,
       case when l_linestatus = 'O' then '+' else '-' end as strand,
       concat(substr('ACGT', cast(l_orderkey % 4 as int) + 1, 1), substr('ACGT', cast(l_suppkey % 4 as int) + 1, 1),
              substr('ACGT', cast(l_linenumber % 4 as int) + 1, 1)) as barcode
from lineitem
"""
REGIONS = """
select concat('chr', p_size % 5) as chrom, p_partkey*40 as chromStart, p_partkey*40 + 20 + p_size*4 as chromEnd,
       concat('r', p_partkey) as name, p_retailprice as score, case when p_partkey % 2 = 0 then '+' else '-' end as strand
from part
"""
MUTATIONS = """
select concat('chr', l_suppkey % 5) as chrom,
       l_partkey*40 + l_linenumber*7 + 1 + (l_orderkey % 10) as chromStart,
       l_partkey*40 + l_linenumber*7 + 2 + (l_orderkey % 10) as chromEnd,
       concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice*100) as bigint)) as name,
       1 + (l_orderkey % 10) as score,
       case when l_linestatus = 'O' then '+' else '-' end as strand,
       substr('ACGT', cast(l_orderkey % 4 as int) + 1, 1) as refBase,
       case l_returnflag when 'A' then '-' when 'R' then '+' else '>' end as mtype,
       substr('ACGT', cast((l_orderkey + 1 + l_suppkey % 3) % 4 as int) + 1, 1) as altBase
from lineitem where l_discount < 0.05
"""
#: Transcripts of three exons; two of each gene, some on different chromosomes.
GENES = """
select concat('chr', (p_partkey div 2) % 5 + case when p_partkey % 14 = 1 then 1 else 0 end) as chrom,
       p_partkey*40 as chromStart, p_partkey*40 + 190 + 2*p_size as chromEnd, concat('t', p_partkey) as name, p_retailprice as score,
       case when (p_partkey div 2) % 2 = 0 then '+' else '-' end as strand,
       p_partkey*40 + 5 as thickStart, p_partkey*40 + 180 + 2*p_size as thickEnd,
       30 + p_size % 7 as size1, 20 + p_size % 11 as size2, 30 as size3,
       0 as start1, 60 + p_size as start2, 160 + 2*p_size as start3, concat('g', p_partkey div 2) as gene
from part
"""
#: Reads with barcodes and qualities, made from whole texts; sequence and qualities differ in length.
READS = """
select concat('q', doc_id) as id,
       translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGNAC') as seq,
       regexp_replace(text, '[^!-~]', '', 'g') as qual
from documents
"""


def _views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    line, part, docs = table("lineitem"), table("part"), table("documents")
    bed = {"chromStart": "long", "chromEnd": "long", "score": "double"}

    def of(df: DataFrame, text: str) -> DataFrame:
        columns = text.strip()
        view = f"_v{abs(hash(columns)) % 10**9}"
        df.createOrReplaceTempView(view)
        out = spark.sql(columns.replace("from lineitem", f"from {view}").replace("from part", f"from {view}").replace("from documents", f"from {view}"))
        return out.withColumns({c: F.col(c).cast(k) for c, k in bed.items() if c in out.columns})

    genes = of(part, GENES)
    spliced = genes.withColumns(
        {
            "thickStart": F.col("thickStart").cast("long"), "thickEnd": F.col("thickEnd").cast("long"), "itemRgb": F.lit("0"), "blockCount": F.lit(3),
            "blockSizes": F.array(*[F.col(f"size{i}").cast("long") for i in (1, 2, 3)]), "blockStarts": F.array(*[F.col(f"start{i}").cast("long") for i in (1, 2, 3)]),
        }
    ).drop(*[f"{k}{i}" for k in ("size", "start") for i in (1, 2, 3)])
    return {
        "tags": of(line, TAGS), "regions": of(part, REGIONS), "mutations": of(line, MUTATIONS), "genes": spliced,
        "reads": of(docs, READS.replace(", 'g')", ")")), "part": part, "line": line, "table": table,
    }


def _sql(body: str) -> str:
    duck = GENES.replace("p_partkey div 2", "p_partkey // 2")
    return f"WITH tags AS ({TAGS}), regions AS ({REGIONS}), mutations AS ({MUTATIONS}), genes AS ({duck}), reads AS ({READS}) {body}"


Query = Callable[[dict[str, DataFrame]], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    _QUERIES[name] = (query, sql)


def _r(c: str, digits: int = 6) -> Column:
    return F.round(F.col(c), digits).alias(c)


# --- Overlap ---
_ON = "t.chrom = r.chrom AND t.chromStart < r.chromEnd AND r.chromStart < t.chromEnd"
_LEN = "least(t.chromEnd, r.chromEnd) - greatest(t.chromStart, r.chromStart)"


def _pair(df: DataFrame) -> DataFrame:
    return df.select("name", "region_name", "overlap", _r("fraction"))


_add("interval_overlap", lambda v: _pair(O.overlap_join(v["tags"], v["regions"])),
     f"SELECT t.name, r.name AS region_name, {_LEN} AS overlap, round(({_LEN})::DOUBLE / (t.chromEnd - t.chromStart), 6) AS fraction FROM tags t JOIN regions r ON {_ON}")
_add("interval_overlap_stranded", lambda v: _pair(O.overlap_join(v["tags"], v["regions"], stranded=True)),
     f"SELECT t.name, r.name AS region_name, {_LEN} AS overlap, round(({_LEN})::DOUBLE / (t.chromEnd - t.chromStart), 6) AS fraction FROM tags t JOIN regions r ON {_ON} AND t.strand = r.strand")
_add("overlap_fraction_region_denom", lambda v: _pair(O.overlap_join(v["tags"], v["regions"], denominator="region")),
     f"SELECT t.name, r.name AS region_name, {_LEN} AS overlap, round(({_LEN})::DOUBLE / (r.chromEnd - r.chromStart), 6) AS fraction FROM tags t JOIN regions r ON {_ON}")
_add("overlap_complete", lambda v: O.overlap_join(v["tags"], v["regions"], complete=True).select("name", "region_name"),
     "SELECT t.name, r.name AS region_name FROM tags t JOIN regions r ON t.chrom = r.chrom AND r.chromStart <= t.chromStart AND t.chromEnd <= r.chromEnd")
_add("overlap_nonredundant", lambda v: O.overlap_join(v["tags"], v["regions"], stranded=True, first_only=True).select("name", "region_name"),
     f"SELECT name, region_name FROM (SELECT t.name, r.name AS region_name, row_number() OVER (PARTITION BY t.name ORDER BY r.chromStart, r.chromEnd, r.name) AS n FROM tags t JOIN regions r ON {_ON} AND t.strand = r.strand) WHERE n = 1")
_add("overlap_extended", lambda v: O.overlap_join(v["tags"], v["regions"], ext5=5, ext3=12).select("name", "region_name", "chromStart", "chromEnd"),
     """SELECT t.name, r.name AS region_name, t.s AS chromStart, t.e AS chromEnd
        FROM (SELECT *, chromStart - CASE strand WHEN '+' THEN 5 ELSE 12 END AS s, chromEnd + CASE strand WHEN '+' THEN 12 ELSE 5 END AS e FROM tags) t
        JOIN regions r ON t.chrom = r.chrom AND t.s < r.chromEnd AND r.chromStart < t.e""")  # fmt: skip
_add("overlap_semi", lambda v: O.overlap_filter(v["tags"], v["regions"], key=["name"]).select("name"), f"SELECT name FROM tags t WHERE EXISTS (SELECT 1 FROM regions r WHERE {_ON})")
_add("overlap_anti", lambda v: O.overlap_filter(v["tags"], v["regions"], keep=False, key=["name"]).select("name"), f"SELECT name FROM tags t WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE {_ON})")
_add("region_count", lambda v: N.region_numbers(v["regions"], v["tags"]).select("name", "n"), f"SELECT r.name, count(t.name) AS n FROM regions r LEFT JOIN tags t ON {_ON} GROUP BY r.name")
_add("region_count_weighted", lambda v: O.region_counts(v["regions"], v["tags"]).select("name", _r("total", 2)), f"SELECT r.name, round(coalesce(sum(t.score), 0), 2)::DOUBLE AS total FROM regions r LEFT JOIN tags t ON {_ON} GROUP BY r.name")
_add("region_mean_score", lambda v: O.region_counts(v["regions"], v["tags"], stranded=True).select("name", _r("mean", 4)),
     f"SELECT r.name, round(coalesce(avg(t.score), 0), 4)::DOUBLE AS mean FROM regions r LEFT JOIN tags t ON {_ON} AND t.strand = r.strand GROUP BY r.name")
_add("region_rpkm", lambda v: N.region_rpkm(v["regions"], v["tags"]).select("name", _r("rpkm", 4)),
     f"SELECT r.name, round(count(t.name) * 1e9 / ((SELECT count(*) FROM tags) * (r.chromEnd - r.chromStart)), 4) AS rpkm FROM regions r LEFT JOIN tags t ON {_ON} GROUP BY r.name, r.chromStart, r.chromEnd")
_PEAK = "SELECT r.name, s.chromStart AS s, s.chromEnd AS e, s.score, max(s.score) OVER (PARTITION BY r.name) AS top FROM regions r JOIN tags s ON s.chrom = r.chrom AND s.chromStart < r.chromEnd AND r.chromStart < s.chromEnd"
_add("region_peak_signal", lambda v: O.region_peaks(v["regions"], v["tags"]).select("name", "peakScore", "peakStart", "peakEnd", "halfPeakStart", "halfPeakEnd"),
     f"""SELECT r.name, coalesce(max(p.top), -1e10)::DOUBLE AS peakScore, min(p.s) FILTER (p.score = p.top) AS peakStart, max(p.e) FILTER (p.score = p.top) AS peakEnd,
        min(p.s) FILTER (p.score > p.top / 2) AS halfPeakStart, max(p.e) FILTER (p.score > p.top / 2) AS halfPeakEnd FROM regions r LEFT JOIN ({_PEAK}) p ON p.name = r.name GROUP BY r.name""")  # fmt: skip

# --- Geometry ---
_bed = lambda df: df.select("name", "chrom", "chromStart", "chromEnd", "strand")


def _geo(plus: tuple[str, str], minus: tuple[str, str]) -> str:
    return f"""SELECT * FROM (SELECT name, chrom, CASE strand WHEN '+' THEN {plus[0]} ELSE {minus[0]} END AS chromStart,
        CASE strand WHEN '+' THEN {plus[1]} ELSE {minus[1]} END AS chromEnd, strand FROM tags) WHERE chromEnd > chromStart"""


_add("extend", lambda v: _bed(M.extend(v["tags"], -10, -15)), _geo(("chromStart - 10", "chromEnd - 15"), ("chromStart + 15", "chromEnd + 10")))
_add("flank_up", lambda v: _bed(M.flank_up(v["tags"], -10, -1)), _geo(("chromStart - 10", "chromStart"), ("chromEnd", "chromEnd + 10")))
_add("flank_down", lambda v: _bed(M.flank_down(v["tags"], 1, 20)), _geo(("chromEnd", "chromEnd + 20"), ("chromStart - 20", "chromStart")))
_add("clamp", lambda v: _bed(M.clamp(M.grow(v["tags"], 3000, 3000), v["tags"].groupBy("chrom").agg((F.max("chromEnd") - 100).alias("length")))),
     """SELECT name, chrom, greatest(least(greatest(s, 0), len - 1), 0) AS chromStart, greatest(least(greatest(e, 1), len), greatest(least(greatest(s, 0), len - 1), 0) + 1) AS chromEnd, strand
        FROM (SELECT name, t.chrom, chromStart - 3000 AS s, chromEnd + 3000 AS e, strand, len FROM tags t JOIN (SELECT chrom, max(chromEnd) - 100 AS len FROM tags GROUP BY chrom) USING (chrom))""")  # fmt: skip
_add("coloured", lambda v: M.coloured(v["regions"], "red").select("name", "itemRgb", "thickStart", "thickEnd"), "SELECT name, '255,0,0' AS itemRgb, chromStart AS thickStart, chromEnd AS thickEnd FROM regions")
_add("default_names", lambda v: with_defaults(v["regions"].select("chrom", "chromStart", "chromEnd")).select("chrom", "name", "score", "strand"),
     "SELECT chrom, concat(chrom, ':', chromStart + 1, '-', chromEnd) AS name, 0.0::DOUBLE AS score, '+' AS strand FROM regions")
_add("name_attributes", lambda v: v["regions"].select("name", packed(F.col("name"), k=F.length("name"), m=F.lit(3)).alias("packed")).withColumn("k", unpacked("k", "packed")),
     "SELECT name, concat(name, '[k=', length(name), '][m=3]') AS packed, cast(length(name) AS VARCHAR) AS k FROM regions")
_add("bed_text", lambda v: bed_lines(v["regions"].select("chrom", "chromStart", "chromEnd", "name", F.lit(1.5).alias("score"), "strand")),
     "SELECT concat_ws(chr(9), chrom, chromStart, chromEnd, name, '1.5', strand) AS value FROM regions")
_add("numbered_rows", lambda v: numbered(v["regions"]).select("name", "nth"), "SELECT name, row_number() OVER (ORDER BY chrom, chromStart, chromEnd, strand, name) AS nth FROM regions")


# --- Clusters ---
def _islands(keys: str, gap: str, source: str = "tags") -> str:
    return f"""x AS (SELECT *, CASE WHEN chromStart - max(chromEnd) OVER (PARTITION BY {keys} ORDER BY chromStart, chromEnd, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) {gap} THEN 0 ELSE 1 END AS f FROM {source}),
        y AS (SELECT *, sum(f) OVER (PARTITION BY {keys} ORDER BY chromStart, chromEnd, name ROWS UNBOUNDED PRECEDING) AS island FROM x)"""


def _cluster_sql(keys: str, gap: str, score: str) -> str:
    named = "concat(chrom, CASE strand WHEN '+' THEN '_f_c' ELSE '_r_c' END, {n})" if "strand" in keys else "concat(chrom, '_c', {n})"
    strand = "strand" if "strand" in keys else "'+'"
    number = f"row_number() OVER (PARTITION BY {keys} ORDER BY min(chromStart), max(chromEnd), island) - 1"
    return f", {_islands(keys, gap)} SELECT chrom, min(chromStart) AS chromStart, max(chromEnd) AS chromEnd, {named.format(n=number)} AS name, round({score}, 2)::DOUBLE AS score, {strand} AS strand FROM y GROUP BY {keys}, island"


_six = lambda df: df.select("chrom", "chromStart", "chromEnd", "name", _r("score", 2), "strand")
_add("cluster_gap0", lambda v: _six(C.cluster(v["tags"], 0, stranded=True)), _cluster_sql("chrom, strand", "<= 0", "count(*)"))
_add("cluster_gap25_weighted", lambda v: _six(C.cluster(v["tags"], 25, weight=F.col("score"))), _cluster_sql("chrom", "<= 25", "sum(score)"))
_add("cluster_sites", lambda v: C.site_counts(v["mutations"]), "SELECT chrom, chromStart, chromEnd, strand, count(*) AS m FROM mutations GROUP BY ALL")
_add("cluster_gap_neg1", lambda v: C.cluster(v["mutations"].withColumn("score", F.col("score").cast("double")), -1, stranded=True).select("chrom", "chromStart", "chromEnd", "strand", "n"),
     "SELECT chrom, chromStart, chromEnd, strand, count(*) AS n FROM mutations GROUP BY ALL")
_add("collapse_ends", lambda v: C.collapse_intervals(v["tags"], 1, stranded=True).select("name", "score"),
     "SELECT arg_min(name, name) AS name, count(*)::DOUBLE AS score FROM tags GROUP BY chrom, strand, chromStart, chromEnd")
_add("collapse_contained", lambda v: C.collapse_intervals(v["tags"], 2, stranded=True).select("name", "score"),
     """, x AS (SELECT *, CASE WHEN chromEnd <= max(chromEnd) OVER (PARTITION BY chrom, strand ORDER BY chromStart, chromEnd DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM tags),
        y AS (SELECT *, sum(f) OVER (PARTITION BY chrom, strand ORDER BY chromStart, chromEnd DESC, name ROWS UNBOUNDED PRECEDING) AS g FROM x),
        z AS (SELECT name, count(*) OVER (PARTITION BY chrom, strand, g) AS n, row_number() OVER (PARTITION BY chrom, strand, g ORDER BY chromEnd - chromStart DESC, name) AS k FROM y)
        SELECT name, n::DOUBLE AS score FROM z WHERE k = 1""")  # fmt: skip
_add("overlap_half_clusters", lambda v: C.overlap_clusters(v["tags"], 0.5, stranded=True).select("chrom", "strand", "chromStart", "chromEnd", "score"),
     """, x AS (SELECT *, lag(chromEnd) OVER w - chromStart AS o, least(chromEnd - chromStart, lag(chromEnd - chromStart) OVER w) AS z FROM tags WINDOW w AS (PARTITION BY chrom, strand ORDER BY chromStart, chromEnd, name, score)),
        y AS (SELECT *, sum(CASE WHEN o >= 0.5 * z THEN 0 ELSE 1 END) OVER (PARTITION BY chrom, strand ORDER BY chromStart, chromEnd, name, score ROWS UNBOUNDED PRECEDING) AS g FROM x)
        SELECT chrom, strand, min(chromStart) AS chromStart, max(chromEnd) AS chromEnd, count(*)::DOUBLE AS score FROM y GROUP BY chrom, strand, g""")  # fmt: skip


def _best(order: str, keys: str = "chrom, strand", gap: str = "< 5", having: str = "") -> str:
    return f", {_islands(keys, gap)} SELECT name FROM (SELECT name, row_number() OVER (PARTITION BY {keys}, island ORDER BY {order}, chromStart, name) AS k, count(*) OVER (PARTITION BY {keys}, island) AS n FROM y) WHERE k = 1 {having}"


for _crit, _order in (("maxScore", "score DESC"), ("minScore", "score"), ("maxLen", "chromEnd - chromStart DESC"), ("minLen", "chromEnd - chromStart")):
    _add(f"uniq_{_crit}", lambda v, c=_crit: C.best_per_island(v["tags"], c, 5, same_strand=True).select("name"), _best(_order))
_add("uniq_singleton", lambda v: C.best_per_island(v["tags"], "singleton", 5, same_strand=True).select("name"), _best("name", having="AND n = 1"))
_add("uniq_same_interval", lambda v: C.best_per_island(v["tags"], "maxScore", same_interval=True).select("name"),
     "SELECT name FROM (SELECT name, row_number() OVER (PARTITION BY chrom, chromStart, chromEnd ORDER BY score DESC, name) AS k FROM tags) WHERE k = 1")

# --- Coverage ---
def _coverage_sql(keys: str, weight: str) -> str:
    return f"""e AS (SELECT {keys}, pos, sum(d) AS d FROM (SELECT {keys}, chromStart AS pos, {weight} AS d FROM tags UNION ALL SELECT {keys}, chromEnd, -({weight}) FROM tags) GROUP BY {keys}, pos HAVING abs(sum(d)) > 1e-6),
        c AS (SELECT {keys}, pos AS chromStart, lead(pos) OVER (PARTITION BY {keys} ORDER BY pos) AS chromEnd, sum(d) OVER (PARTITION BY {keys} ORDER BY pos) AS score FROM e),
        cov AS (SELECT {keys}, chromStart, chromEnd, score FROM c WHERE score > 1e-6)"""


_add("coverage_exact", lambda v: V.exact_coverage(v["tags"], stranded=True), f", {_coverage_sql('chrom, strand', '1')} SELECT * REPLACE (score::DOUBLE AS score) FROM cov")
_add("coverage_weighted", lambda v: V.exact_coverage(v["tags"], weight=F.col("score")).withColumn("score", F.round("score", 2)), f", {_coverage_sql('chrom', 'score')} SELECT * REPLACE (round(score, 2)::DOUBLE AS score) FROM cov")
_add("coverage_rpkm", lambda v: V.normalised(V.exact_coverage(v["tags"]), v["tags"], "rpkm").withColumn("score", F.round("score", 4)),
     f", {_coverage_sql('chrom', '1')} SELECT * REPLACE (round(score * 1e9 / (SELECT sum(chromEnd - chromStart) FROM tags), 4)::DOUBLE AS score) FROM cov")
_LENGTHS = "l AS (SELECT chrom, max(chromEnd) AS length FROM tags GROUP BY chrom), g AS (SELECT chrom, unnest(range(0, length - 100 + 1, 20)) AS s FROM l)"
_lengths = lambda v: v["tags"].groupBy("chrom").agg(F.max("chromEnd").alias("length"))
_add("window_hopping", lambda v: V.hopping_windows(v["tags"], _lengths(v)).select("chrom", "chromStart", "name", "n", _r("mean", 4)),
     f", {_LENGTHS} SELECT g.chrom, s AS chromStart, concat('w', s // 20) AS name, count(t.name) AS n, round(coalesce(avg(score), 0), 4)::DOUBLE AS mean FROM g LEFT JOIN tags t ON t.chrom = g.chrom AND t.chromStart < s + 100 AND s < t.chromEnd GROUP BY g.chrom, s")
_add("window_hopping_nonzero", lambda v: V.hopping_windows(v["tags"], _lengths(v), stranded=True, nonzero=True).select("chrom", "strand", "chromStart", "n", _r("total", 2)),
     f", {_LENGTHS} SELECT g.chrom, t.strand, s AS chromStart, count(*) AS n, round(sum(score), 2)::DOUBLE AS total FROM g JOIN tags t ON t.chrom = g.chrom AND t.chromStart < s + 100 AND s < t.chromEnd GROUP BY g.chrom, t.strand, s")
_add("window_rpkm", lambda v: V.normalised(V.hopping_windows(v["tags"], _lengths(v), nonzero=True).withColumn("score", F.col("n")), v["tags"], "rpkm", window=100).select("chrom", "chromStart", _r("score", 4)),
     f", {_LENGTHS} SELECT g.chrom, s AS chromStart, round(count(*) * 1e9 / ((SELECT count(*) FROM tags) * 100), 4)::DOUBLE AS score FROM g JOIN tags t ON t.chrom = g.chrom AND t.chromStart < s + 100 AND s < t.chromEnd GROUP BY g.chrom, s")

# --- Rows ---
_key = lambda v: v["mutations"].select(F.lower("chrom").alias("chrom"), "name")
_add("lookup_inner", lambda v: T.lookup_join(v["tags"].select("name"), v["mutations"].select("name", "mtype"), "name", "name").select("name", "build_mtype"), "SELECT t.name, m.mtype AS build_mtype FROM tags t JOIN mutations m USING (name)")
_add("lookup_outer_text", lambda v: T.lookup_join(v["tags"].select("name"), v["mutations"].select("name", "mtype"), "name", "name", outer=True, no_match="none").select("name", "build_mtype"),
     "SELECT t.name, coalesce(m.mtype, 'none') AS build_mtype FROM tags t LEFT JOIN mutations m USING (name)")
_add("lookup_single_line", lambda v: T.lookup_join(v["regions"].select("name", "chrom", "chromStart"), v["mutations"].select("chrom", "chromStart", "name"), "chromStart", "chromStart", single_line=True, order=["name"]).select("name", "build_name"),
     "SELECT r.name, m.build_name FROM regions r JOIN (SELECT chromStart, string_agg(name, '||' ORDER BY name) AS build_name FROM mutations GROUP BY chromStart) m USING (chromStart)")
_add("lookup_first", lambda v: T.lookup_join(v["regions"].select("name", "chromStart"), v["mutations"].select("chromStart", "name"), "chromStart", "chromStart", first_only=True, order=["name"]).select("name", "build_name"),
     "SELECT r.name, m.build_name FROM regions r JOIN (SELECT chromStart, min(name) AS build_name FROM mutations GROUP BY chromStart) m USING (chromStart)")
_add("lookup_ignore_case", lambda v: T.lookup_join(v["regions"].select(F.upper("name").alias("name")), v["regions"].select("name", "score"), "name", "name", ignore_case=True).select("name", "build_score"), "SELECT upper(name) AS name, score AS build_score FROM regions")
_add("row_anti", lambda v: T.matching_rows(v["tags"], v["mutations"], "name", "name", keep=False).select("name"), "SELECT name FROM tags WHERE name NOT IN (SELECT name FROM mutations)")
_add("row_semi", lambda v: T.matching_rows(v["tags"], v["mutations"], "name", "name").select("name"), "SELECT name FROM tags WHERE name IN (SELECT name FROM mutations)")
_add("left_per_match", lambda v: T.left_per_match(v["regions"].select("name", "chromStart"), v["mutations"], "chromStart", "chromStart").select("name"), "SELECT r.name FROM regions r JOIN mutations m USING (chromStart)")
_add("checked_join", lambda v: T.checked_join(v["regions"].select("name", "score"), v["regions"].select("name", "chrom"), "name"), "SELECT name, score, chrom FROM regions")
_few = lambda v: v["tags"].select(F.concat("chrom", F.lit(":"), (F.col("chromStart") % 997).cast("string")).alias("key"), (F.col("score") - 25).alias("value"), "name")
_FEW = "f AS (SELECT concat(chrom, ':', chromStart % 997) AS key, score - 25 AS value, name FROM tags)"
for _crit, _order in (("max_num", "value DESC"), ("min_num", "value"), ("max_num_abs", "abs(value) DESC"), ("min_num_abs", "abs(value)")):
    _add(f"unique_rows_{_crit}", lambda v, c=_crit: T.unique_rows(_few(v), "key", "value", c, ["name"]).select("key", "name"), f", {_FEW} SELECT key, name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {_order}, name) AS k FROM f) WHERE k = 1")
for _crit, _order in (("max_text", "DESC"), ("min_text", "")):
    _add(f"unique_rows_{_crit}", lambda v, c=_crit: T.unique_rows(_few(v), "key", "name", c).select("key", "name"), f", {_FEW} SELECT key, {'max' if _order else 'min'}(name) AS name FROM f GROUP BY key")
for _crit, _how in (("sum", "sum"), ("mean", "avg"), ("count", "count")):
    _add(f"unique_rows_{_crit}", lambda v, c=_crit: T.unique_rows(_few(v), "key", "value", c, ["name"]).select("key", "name", F.round(F.col("value").cast("double"), 4).alias("value")), f", {_FEW} SELECT key, min(name) AS name, round({_how}(value), 4)::DOUBLE AS value FROM f GROUP BY key")
_marked = lambda v: _few(v).select("key", F.when(F.col("value") > 20, "NA").otherwise(F.col("value").cast("string")).alias("a"), F.col("value").alias("b"))
for _crit, _how in (("rowsum", "coalesce(sum({}), 0)"), ("rowmean", "avg({})")):
    _add(f"unique_rows_{_crit}", lambda v, c=_crit: T.unique_rows(_marked(v), "key", "a", c).select("key", _r("a", 4), _r("b", 4)),
         f", {_FEW} SELECT key, round({_how.format('CASE WHEN value > 20 THEN NULL ELSE value END')}, 4)::DOUBLE AS a, round({_how.format('value')}, 4)::DOUBLE AS b FROM f GROUP BY key")
_add("unique_rows_random", lambda v: T.unique_rows(_few(v), "key", "value").select("key"), f", {_FEW} SELECT DISTINCT key FROM f")
_add("duplicate_names", lambda v: T.duplicate_names(v["genes"].select("gene", "name"), "gene", ["name"]).select("name", "unique_name", "copies"),
     "SELECT name, CASE WHEN count(*) OVER (PARTITION BY gene) > 1 THEN concat(gene, '@', row_number() OVER (PARTITION BY gene ORDER BY name) - 1) ELSE gene END AS unique_name, count(*) OVER (PARTITION BY gene) AS copies FROM genes")
_ids = lambda v, k: v["mutations"].where(F.col("mtype") == k).select("chrom", "chromStart")
_add("id_set_union", lambda v: _ids(v, ">").union(_ids(v, "-")).distinct(), "SELECT DISTINCT chrom, chromStart FROM mutations WHERE mtype IN ('>', '-')")
_add("id_set_intersect", lambda v: _ids(v, ">").intersect(_ids(v, "-")), "SELECT chrom, chromStart FROM mutations WHERE mtype = '>' INTERSECT SELECT chrom, chromStart FROM mutations WHERE mtype = '-'")
_add("id_set_except", lambda v: _ids(v, ">").subtract(_ids(v, "-")), "SELECT chrom, chromStart FROM mutations WHERE mtype = '>' EXCEPT SELECT chrom, chromStart FROM mutations WHERE mtype = '-'")

# --- Reads ---
_FIVE = "CASE strand WHEN '+' THEN chromStart ELSE chromEnd - 1 END"
_add("collapse_5p", lambda v: K.collapse_5p(v["tags"]).select("name", "score"),
     f"SELECT name, n::DOUBLE AS score FROM (SELECT name, count(*) OVER (PARTITION BY chrom, strand, {_FIVE}) AS n, row_number() OVER (PARTITION BY chrom, strand, {_FIVE} ORDER BY chromEnd - chromStart DESC, name) AS k FROM tags) WHERE k = 1")
_add("collapse_5p_weighted", lambda v: K.collapse_5p(v["tags"], weight=True, keep_max_score=True).select("name", _r("score", 2)),
     f"SELECT name, round(n, 2)::DOUBLE AS score FROM (SELECT name, sum(score) OVER (PARTITION BY chrom, strand, {_FIVE}) AS n, row_number() OVER (PARTITION BY chrom, strand, {_FIVE} ORDER BY score DESC, chromEnd - chromStart DESC, name) AS k FROM tags) WHERE k = 1")
_add("collapse_5p_barcode", lambda v: K.collapse_barcodes(v["tags"]).select("name", "barcode", "score"),
     f"SELECT name, barcode, n::DOUBLE AS score FROM (SELECT name, barcode, count(*) OVER (PARTITION BY chrom, strand, {_FIVE}, barcode) AS n, row_number() OVER (PARTITION BY chrom, strand, {_FIVE}, barcode ORDER BY chromEnd - chromStart DESC, name) AS k FROM tags) WHERE k = 1")
_QUAL = "list_transform(string_split(qual, ''), lambda x: ascii(x) - 33)"
_add("seq_dedup_fasta", lambda v: S.collapse_fasta(v["reads"].select("id", "seq")).select("id", "seq"), "SELECT concat(min(id), '#', count(*)) AS id, seq FROM reads GROUP BY seq")
_add("seq_dedup_fastq", lambda v: S.collapse_fastq(v["reads"]).select("id", "seq", "qual"), "SELECT concat(min(id), '#', count(*)) AS id, seq, arg_min(qual, id) AS qual FROM reads GROUP BY seq")
_add("barcode_strip", lambda v: S.strip_barcode(v["reads"], 5, starts_with="a").select("id", "seq", "qual"),
     "SELECT concat(id, '#', substr(seq, 1, 5)) AS id, substr(seq, 6) AS seq, substr(qual, 6) AS qual FROM reads WHERE length(seq) > 5 AND substr(seq, 1, 1) = 'A'")
_add("index_filter", lambda v: S.filter_reads(v["reads"], index="2:gt").select("id"), "SELECT id FROM reads WHERE substr(seq, 3, 2) = 'GT'")
_add("max_n_filter", lambda v: S.filter_reads(v["reads"], max_n=0).select("id"), "SELECT id FROM reads WHERE regexp_replace(seq, '[ACGTacgt]', '', 'g') = ''")
_add("quality_filter", lambda v: S.filter_reads(v["reads"], quality="mean:0-9:60,min:0-4:11").select("id"), f"SELECT id FROM reads WHERE list_avg(list_slice({_QUAL}, 1, 10)) >= 60 AND list_min(list_slice({_QUAL}, 1, 5)) >= 11")
_add("revcomp", lambda v: v["reads"].select("id", reverse_complement(F.col("seq")).alias("seq")), "SELECT id, reverse(translate(seq, 'ACGTUacgtu', 'TGCAAtgcaa')) AS seq FROM reads")
_add("hamming", lambda v: v["reads"].select("id", hamming(F.col("seq"), F.reverse("seq")).alias("d")), "SELECT id, CASE WHEN seq = '' THEN 0 ELSE hamming(seq, reverse(seq)) END AS d FROM reads")
_add("qualities", lambda v: v["reads"].select("id", F.aggregate(qualities(F.col("qual")), F.lit(0), lambda s, x: s + x).alias("total")), f"SELECT id, CASE WHEN qual = '' THEN 0 ELSE list_sum({_QUAL})::INT END AS total FROM reads")

# --- Mutations ---
for _kind, _sign in (("del", "-"), ("ins", "+"), ("sub", ">")):
    _add(f"mutation_select_{_kind}", lambda v, k=_kind: U.select_mutations(v["mutations"], k).select("name"), f"SELECT name FROM mutations WHERE mtype = '{_sign}'")
_add("mutation_select_t2c", lambda v: U.select_mutations(v["mutations"], "sub", "t2c").select("name"),
     "SELECT name FROM mutations WHERE mtype = '>' AND CASE strand WHEN '+' THEN refBase = 'T' AND altBase = 'C' ELSE refBase = 'A' AND altBase = 'G' END")
_COMP = "CASE strand WHEN '+' THEN {0} ELSE translate({0}, 'ACGT', 'TGCA') END"
_add("mutation_summary", lambda v: U.mutation_summary(v["mutations"]),
     f"""SELECT CASE mtype WHEN '-' THEN 'deletion' WHEN '+' THEN 'insertion' ELSE 'substitution' END AS kind, 'all' AS change, count(*) AS n FROM mutations GROUP BY mtype
        UNION ALL SELECT 'substitution', concat({_COMP.format('refBase')}, '-', {_COMP.format('altBase')}), count(*) FROM mutations WHERE mtype = '>' GROUP BY 2""")  # fmt: skip
_add("split_deletions", lambda v: U.split_deletions(v["mutations"].where("mtype = '-'").withColumns({"refBase": F.concat("refBase", "altBase"), "offset": F.col("score").cast("long")})).select("name", "chromStart", "chromEnd", "offset", "refBase"),
     "SELECT name, chromStart + i AS chromStart, chromStart + i + 1 AS chromEnd, score + i AS \"offset\", substr(concat(refBase, altBase), (i + 1)::INT, 1) AS refBase FROM mutations, (SELECT unnest([0, 1]) AS i) WHERE mtype = '-'")
_add("position_histogram", lambda v: U.position_histogram(v["mutations"], "score").select(F.col("score").cast("long").alias("score"), "n"), "SELECT score::BIGINT AS score, count(*) AS n FROM mutations GROUP BY score")
_SITES = """s AS (SELECT chrom, chromStart, chromEnd, strand, count(*) AS m FROM mutations {} GROUP BY ALL),
     k AS (SELECT s.chrom, s.chromStart, s.chromEnd, s.strand, s.m, count(t.name) AS k FROM s LEFT JOIN tags t ON t.chrom = s.chrom AND t.strand = s.strand AND t.chromStart < s.chromEnd AND s.chromStart < t.chromEnd GROUP BY ALL)"""
_sites = lambda v: U.depth_at(C.site_counts(v["mutations"]), v["tags"])
_add("site_depth", _sites, f", {_SITES.format('')} SELECT * FROM k")
_add("allele_pivot", lambda v: alleles.site_alleles(v["tags"], v["mutations"]),
     f""", {_SITES.format("WHERE mtype = '>'")}, b AS (SELECT chrom, chromStart, chromEnd, strand, min(refBase) AS r0, list({_COMP.format('altBase')}) AS alts FROM mutations WHERE mtype = '>' GROUP BY ALL),
        c AS (SELECT k.chrom, k.chromStart, k.chromEnd, k.strand, k.k, CASE k.strand WHEN '+' THEN r0 ELSE translate(r0, 'ACGT', 'TGCA') END AS ref, alts, k.k - len(alts) AS rest FROM k JOIN b USING (chrom, chromStart, chromEnd, strand))
        SELECT chrom, chromStart, chromEnd, strand, k, ref, {', '.join(f"len(list_filter(alts, lambda b: b = '{x}')) + CASE ref WHEN '{x}' THEN rest ELSE 0 END AS {x}" for x in 'ACGT')} FROM c""")  # fmt: skip
_HIST = "h AS (SELECT k, m, count(*) AS sites FROM k GROUP BY ALL), hc AS (SELECT *, sum(sites) OVER (PARTITION BY k ORDER BY m DESC)::BIGINT AS sites_ge FROM h)"
_add("site_km_histogram", lambda v: R.site_histogram(_sites(v)), f", {_SITES.format('')}, {_HIST} SELECT * FROM hc")
#: Substitutions against deletions, each with all its sites.
_typed = lambda v, k: R.site_histogram(U.depth_at(C.site_counts(v["mutations"].where(F.col("mtype") == k)), v["tags"]))
_DELETIONS = _SITES.format("WHERE mtype = '-'").replace("s AS (", "s2 AS (", 1).replace("k AS (", "k2 AS (", 1).replace("FROM s LEFT JOIN", "FROM s2 s LEFT JOIN")
_add("monotone_fdr", lambda v: R.permutation_fdr(_typed(v, ">"), _typed(v, "-"), 2).select("k", "m", _r("fdr")),
     f""", {_SITES.format("WHERE mtype = '>'")}, {_HIST}, {_DELETIONS}, q AS (SELECT k, m, count(*) AS n FROM k2 GROUP BY ALL), qc AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY m DESC) AS c FROM q),
        f AS (SELECT hc.k, hc.m, CASE WHEN c IS NULL THEN 0 ELSE least(1.0, c / 2.0 / sites_ge) END AS fdr FROM hc LEFT JOIN qc USING (k, m))
        SELECT k, m, round(max(fdr) OVER (PARTITION BY m ORDER BY k ROWS UNBOUNDED PRECEDING), 6)::DOUBLE AS fdr FROM f""")  # fmt: skip

#: Deletions and insertions as two iterations, pooled before they are cumulated.
def _two_iterations(v: dict[str, DataFrame]) -> DataFrame:
    drawn = v["mutations"].where("mtype != '>'").withColumn("iteration", F.when(F.col("mtype") == "-", 0).otherwise(1))
    sites = U.depth_at(C.site_counts(drawn, ["iteration", "chrom", "chromStart", "chromEnd", "strand"]), v["tags"])
    return R.site_histogram(sites, ["iteration"])


_OTHERS = (
    _SITES.format("WHERE mtype != '>'").replace("s AS (SELECT chrom", "s2 AS (SELECT mtype, chrom", 1).replace("k AS (SELECT s.chrom", "k2 AS (SELECT s.mtype, s.chrom", 1).replace("FROM s LEFT JOIN", "FROM s2 s LEFT JOIN")
)
_add("pooled_fdr", lambda v: R.permutation_fdr(_typed(v, ">"), _two_iterations(v), 2).select("k", "m", _r("fdr")),
     f""", {_SITES.format("WHERE mtype = '>'")}, {_HIST}, {_OTHERS}, q AS (SELECT k, m, count(*) AS n FROM k2 GROUP BY ALL), qc AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY m DESC) AS c FROM q),
        f AS (SELECT hc.k, hc.m, CASE WHEN c IS NULL THEN 0 ELSE least(1.0, c / 2.0 / sites_ge) END AS fdr FROM hc LEFT JOIN qc USING (k, m))
        SELECT k, m, round(max(fdr) OVER (PARTITION BY m ORDER BY k ROWS UNBOUNDED PRECEDING), 6)::DOUBLE AS fdr FROM f""")  # fmt: skip

# --- Genes ---
_STRANDED = "CASE strand WHEN '+' THEN i ELSE {} - i END"
_EXON = "x AS (SELECT *, unnest([0, 1, 2]) AS i FROM genes), e AS (SELECT chrom, name, strand, thickStart, thickEnd, i, chromStart + [start1, start2, start3][i + 1] AS s, chromStart + [start1, start2, start3][i + 1] + [size1, size2, size3][i + 1] AS e FROM x)"
_exon = lambda df: df.select("name", "chrom", "chromStart", "chromEnd", "strand")
_add("exons", lambda v: _exon(G.exons(v["genes"])), f", {_EXON} SELECT concat(name, '_', {_STRANDED.format(2)}) AS name, chrom, s AS chromStart, e AS chromEnd, strand FROM e")
_add("exons_coding_partial", lambda v: _exon(G.exons(v["genes"], "coding", partial=True, which="terminal")),
     f", {_EXON} SELECT concat(name, '_', {_STRANDED.format(2)}) AS name, chrom, greatest(s, thickStart) AS chromStart, least(e, thickEnd) AS chromEnd, strand FROM e WHERE i != 1 AND e > thickStart AND s < thickEnd")
_add("exons_5utr", lambda v: _exon(G.exons(v["genes"], "5utr", partial=True, left=2)),
     f""", {_EXON} SELECT concat(name, '_', {_STRANDED.format(2)}) AS name, chrom, CASE strand WHEN '+' THEN s - 2 ELSE greatest(s, thickEnd) END AS chromStart, CASE strand WHEN '+' THEN least(e, thickStart) ELSE e + 2 END AS chromEnd, strand
        FROM e WHERE CASE strand WHEN '+' THEN s < thickStart ELSE e > thickEnd END""")  # fmt: skip
_INTRON = "x AS (SELECT *, unnest([0, 1]) AS i FROM genes), n AS (SELECT chrom, name, strand, i, chromStart + [start1, start2][i + 1] + [size1, size2][i + 1] AS s, chromStart + [start2, start3][i + 1] AS e FROM x)"
_add("introns", lambda v: _exon(G.introns(v["genes"])), f", {_INTRON} SELECT concat(name, '_', {_STRANDED.format(1)}) AS name, chrom, s AS chromStart, e AS chromEnd, strand FROM n")
_add("introns_long", lambda v: _exon(G.introns(v["genes"], left=1, right=3, lengths_are="long", length=70, numbered=False)),
     f", {_INTRON} SELECT name, chrom, s - CASE strand WHEN '+' THEN 1 ELSE 3 END AS chromStart, e + CASE strand WHEN '+' THEN 3 ELSE 1 END AS chromEnd, strand FROM n WHERE e - s >= 70")
_map = lambda v: v["genes"].select(F.col("name").alias("transcript"), "gene")
_UNION = f"""{_EXON.replace('SELECT chrom, name, strand', 'SELECT gene, chrom, name, strand').replace('x AS', 'w AS').replace('FROM x', 'FROM w')}, o AS (SELECT gene FROM genes GROUP BY gene HAVING count(DISTINCT chrom || strand) = 1),
     u AS (SELECT gene, chrom, strand, s AS chromStart, e AS chromEnd, name FROM e WHERE gene IN (SELECT gene FROM o))"""
_add("union_transcripts", lambda v: G.union_transcripts(v["genes"].drop("gene"), _map(v))[0].select("name", "chrom", "chromStart", "chromEnd", "blockCount", F.aggregate("blockSizes", F.lit(0).cast("long"), lambda n, s: n + s).alias("bases")),
     f""", {_UNION}, {_islands('gene', '<= 0', 'u')}, z AS (SELECT gene, chrom, island, min(chromStart) AS s, max(chromEnd) AS e FROM y GROUP BY ALL)
        SELECT gene AS name, chrom, min(s) AS chromStart, max(e) AS chromEnd, count(*)::INT AS blockCount, sum(e - s)::BIGINT AS bases FROM z GROUP BY gene, chrom""")  # fmt: skip
_add("inconsistent_transcripts", lambda v: G.union_transcripts(v["genes"].drop("gene"), _map(v))[1].select("name", "gene"), "SELECT name, gene FROM genes WHERE gene IN (SELECT gene FROM genes GROUP BY gene HAVING count(DISTINCT chrom || strand) > 1)")
_add("overlap_spliced", lambda v: O.overlap_join(v["genes"].drop("gene"), v["regions"]).select("name", "region_name", "overlap"),
     f""", {_EXON}, p AS (SELECT e.name, r.name AS region_name, sum(greatest(least(e.e, r.chromEnd) - greatest(e.s, r.chromStart), 0))::BIGINT AS overlap, bool_or(e.s < r.chromEnd AND r.chromStart < e.e) AS hit
        FROM e JOIN genes g ON g.name = e.name JOIN regions r ON r.chrom = g.chrom AND g.chromStart < r.chromEnd AND r.chromStart < g.chromEnd GROUP BY ALL) SELECT name, region_name, overlap FROM p WHERE hit""")  # fmt: skip

# --- Annotation ---
_GENE = f"h AS (SELECT DISTINCT t.name, g.gene FROM tags t JOIN genes g ON {_ON.replace('r.', 'g.')} AND NOT (t.chromStart >= g.chromEnd)), o AS (SELECT name, min(gene) AS gene FROM h GROUP BY name)"
_symbols = lambda v: v["genes"].select("gene").distinct().withColumn("symbol", F.concat(F.lit("S"), "gene"))
_add("annotate_gene", lambda v: annotate.annotate_gene(v["tags"].select("chrom", "chromStart", "chromEnd", "name", "strand"), v["genes"], _map(v), _symbols(v)).select("name", "gene", "symbol"),
     f", {_GENE} SELECT t.name, gene, 'S' || gene AS symbol FROM tags t LEFT JOIN o USING (name)")
_add("annotate_max_overlap", lambda v: annotate.annotate_best(v["tags"], v["regions"]).select("name", "feature"),
     f"SELECT t.name, o.feature FROM tags t LEFT JOIN (SELECT t.name, r.name AS feature, row_number() OVER (PARTITION BY t.name ORDER BY {_LEN} DESC, r.chromStart, r.name) AS k FROM tags t JOIN regions r ON {_ON}) o ON o.name = t.name AND k = 1")
for _way, _dir in (("max", "DESC"), ("min", "")):
    _add(f"annotate_{_way}_num", lambda v, w=_way: annotate.annotate_best(v["tags"], v["regions"], by="score", largest=w == "max").select("name", "feature"),
         f"SELECT t.name, o.feature FROM tags t LEFT JOIN (SELECT t.name, r.name AS feature, row_number() OVER (PARTITION BY t.name ORDER BY r.score {_dir}, r.chromStart, r.name) AS k FROM tags t JOIN regions r ON {_ON}) o ON o.name = t.name AND k = 1")
_add("annotate_all", lambda v: annotate.annotate_all(v["tags"], v["regions"], stranded=True).select("name", "feature"),
     f"SELECT t.name, string_agg(r.name, '||' ORDER BY r.chromStart, r.name) AS feature FROM tags t LEFT JOIN regions r ON {_ON} AND t.strand = r.strand GROUP BY t.name")


def _sets(v: dict[str, DataFrame]) -> dict[str, DataFrame]:
    genes = v["genes"]
    plain = genes.select("chrom", "chromStart", "chromEnd", "name", "score", "strand")
    part = lambda p: G.exons(genes, p, partial=True)
    return {"genic": plain, "exon": G.exons(genes), "5utr": part("5utr"), "3utr": part("3utr"), "cds": part("coding"), "upstream_10k": M.flank_up(plain, -300, -1), "downstream_10k": M.flank_down(plain, 1, 300)}


_FLAGS = f"""{_EXON}, gs AS (SELECT * FROM genes),
     sets AS (SELECT 'genic' AS kind, chrom, chromStart AS s, chromEnd AS e FROM gs UNION ALL SELECT 'exon', chrom, s, e FROM e
       UNION ALL SELECT 'cds', chrom, greatest(s, thickStart), least(e, thickEnd) FROM e WHERE e > thickStart AND s < thickEnd
       UNION ALL SELECT CASE strand WHEN '+' THEN '5utr' ELSE '3utr' END, chrom, s, least(e, thickStart) FROM e WHERE s < thickStart
       UNION ALL SELECT CASE strand WHEN '+' THEN '3utr' ELSE '5utr' END, chrom, greatest(s, thickEnd), e FROM e WHERE e > thickEnd
       UNION ALL SELECT CASE strand WHEN '+' THEN 'up' ELSE 'down' END, chrom, chromStart - 300, chromStart FROM gs
       UNION ALL SELECT CASE strand WHEN '+' THEN 'down' ELSE 'up' END, chrom, chromEnd, chromEnd + 300 FROM gs),
     fl AS (SELECT t.name, {', '.join(f"coalesce(bool_or(kind = '{k}'), false) AS f_{k}" for k in ('genic', 'exon', 'cds', '5utr', '3utr', 'up', 'down'))}
       FROM tags t LEFT JOIN sets ON sets.chrom = t.chrom AND t.chromStart < sets.e AND sets.s < t.chromEnd AND sets.e - sets.s > CASE WHEN kind IN ('5utr', '3utr', 'cds', 'exon') THEN 1 ELSE 0 END GROUP BY t.name)"""
_add("annotate_region", lambda v: annotate.annotate_region(v["tags"], _sets(v)).select("name", "region"),
     f""", {_FLAGS} SELECT name, coalesce(nullif(concat_ws('||', CASE WHEN f_cds THEN 'CDS' END, CASE WHEN f_5utr THEN '5''UTR' END, CASE WHEN f_3utr THEN '3''UTR' END,
        CASE WHEN f_exon AND NOT (f_cds OR f_5utr OR f_3utr) THEN 'exon_unclassified' END, CASE WHEN f_genic AND NOT f_exon THEN 'intron' END,
        CASE WHEN f_down AND NOT f_genic THEN 'downstream_10k' END, CASE WHEN f_up AND NOT f_genic THEN 'upstream_10k' END), ''), 'deep_intergenic') AS region FROM fl""")  # fmt: skip
_add("annotate_region_summary", lambda v: annotate.region_summary(v["tags"], _sets(v)).select("region", "n", "percent"),
     f""", {_FLAGS}, c AS (SELECT count(*) AS total, count(*) FILTER (f_genic OR f_exon) AS genic, count(*) FILTER (f_exon) AS exon, count(*) FILTER (f_cds) AS cds, count(*) FILTER (f_5utr) AS u5, count(*) FILTER (f_3utr) AS u3,
        count(*) FILTER (f_up AND NOT f_genic) AS up, count(*) FILTER (f_down AND NOT f_genic) AS down, count(*) FILTER (f_genic OR f_up OR f_down) AS ext FROM fl)
        SELECT region, n::BIGINT AS n, round(n * 100.0 / (SELECT total FROM c), 1)::DOUBLE AS percent FROM (SELECT unnest(['Total', 'Genic', 'Exon', 'CDS exon', '5'' UTR exon', '3'' UTR exon', 'Intron', 'Upstream 10K', 'Downstream 10K', 'Genic+ext10K', 'Deep intergenic']) AS region,
        unnest([total, genic, exon, cds, u5, u3, genic - exon, up, down, ext, total - ext]) AS n FROM c)""")  # fmt: skip

# --- Statistics ---
_rate = lambda v: v["tags"].sparkSession.createDataFrame([(round(K.alignment_error_rate(v["tags"]), 8),)], "rate double")
_add("alignment_error_rate", _rate, "SELECT round(sum(score)::DOUBLE / sum(chromEnd - chromStart), 8)::DOUBLE AS rate FROM tags")
# Mixtures iterate and valleys nest: no SQL, tested against brute force.
_add("collapse_em", lambda v: K.collapse_em(v["tags"], 30, "em-local"), None)
_add("em_global_error", lambda v: v["tags"].sparkSession.createDataFrame([(K.global_error_rate(v["tags"], least=3),)], "rate double"), None)
_add("valley_peaks", lambda v: peaks.call_peaks(v["tags"], valley=True, depth=0.5), None)


def _drawn(count: str, seed: str, *parts: str) -> str:
    return f"least(floor(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 15))::BIGINT::DOUBLE / pow(2, 60) * {count}), {count} - 1)::BIGINT"


_add("random_subinterval", lambda v: M.random_subinterval(v["regions"], 10),
     f"""SELECT chrom, chromStart + d AS chromStart, chromStart + d + 10 AS chromEnd, name, score, strand
        FROM (SELECT *, {_drawn("(chromEnd - chromStart - 10)", "1", "chrom", "chromStart", "chromEnd", "name")} AS d FROM regions)""")  # fmt: skip


def _simulated(total: str, per: str, empirical: bool = False) -> str:
    offsets, place, drawn, of = "", f"1 + {_drawn('greatest(chromEnd - chromStart - 2, 1)', '1:place', 'id')}", "", ""
    if empirical:  # a place is the offset of a drawn mutation from its read's 5' end
        offsets = """offs AS (SELECT CASE m.strand WHEN '+' THEN m.chromStart - t.chromStart ELSE t.chromEnd - m.chromEnd END AS place FROM mutations m JOIN tags t USING (name)),
        ranked AS (SELECT place, row_number() OVER (ORDER BY place) - 1 AS p FROM offs), """
        place, drawn, of = "ranked.place", f", {_drawn('(SELECT count(*) FROM offs)', '1:place', 'id')} AS p", " JOIN ranked USING (p)"
    return f"""{offsets}numbered AS (SELECT *, row_number() OVER (ORDER BY chrom, chromStart, chromEnd, strand, name) - 1 AS nth, count(*) OVER () AS c FROM tags),
        ids AS (SELECT unnest(range(0, {total})) AS id), draws AS (SELECT id, id // {per} AS iteration, {_drawn("(SELECT count(*) FROM tags)", "1:tag", "id")} AS nth{drawn} FROM ids),
        placed AS (SELECT draws.id, draws.iteration, numbered.* EXCLUDE (nth), {place} AS place FROM draws JOIN numbered USING (nth){of}),
        sim AS (SELECT iteration::INT AS iteration, chrom, greatest(CASE strand WHEN '+' THEN chromStart + place ELSE chromEnd - 1 - place END, 0) AS chromStart, concat('s', id) AS name, 0.0::DOUBLE AS score, strand FROM placed)"""


_add("simulate_sites", lambda v: U.simulate_sites(v["tags"], 1000, 2),
     f", {_simulated('2000', '1000')} SELECT iteration, chrom, chromStart, chromStart + 1 AS chromEnd, name, score, strand FROM sim")
def _cims_sql(empirical: bool = False, kept: str = "true") -> str:
    return f""", {_SITES.format('')}, {_HIST}, {_simulated("(SELECT 5 * count(*) FROM mutations)", "(SELECT count(*) FROM mutations)", empirical)},
        s3 AS (SELECT iteration, chrom, chromStart, strand, count(*) AS m FROM sim GROUP BY ALL), spots AS (SELECT DISTINCT chrom, chromStart, strand FROM s3),
        deep AS (SELECT p.chrom, p.chromStart, p.strand, count(t.name) AS k FROM spots p LEFT JOIN tags t ON t.chrom = p.chrom AND t.strand = p.strand AND t.chromStart <= p.chromStart AND p.chromStart < t.chromEnd GROUP BY ALL),
        q AS (SELECT k, m, count(*) AS n FROM s3 JOIN deep USING (chrom, chromStart, strand) GROUP BY ALL), qc AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY m DESC) AS c FROM q),
        f AS (SELECT hc.*, CASE WHEN c IS NULL THEN 0 ELSE least(1.0, c / 5.0 / sites_ge) END AS raw FROM hc LEFT JOIN qc USING (k, m)),
        fm AS (SELECT k, m, sites_ge, round(max(raw) OVER (PARTITION BY m ORDER BY k ROWS UNBOUNDED PRECEDING), 6)::DOUBLE AS fdr FROM f)
        SELECT chrom, chromStart, chromEnd, concat(chrom, ':', chromStart, strand) AS name, m::DOUBLE AS score, strand, k, m, fdr, sites_ge FROM k JOIN fm USING (k, m) WHERE {kept}"""


def _cims(v: dict[str, DataFrame], **options) -> DataFrame:
    return cims.mutation_sites(v["tags"], v["mutations"], **options).select("chrom", "chromStart", "chromEnd", "name", "score", "strand", "k", "m", _r("fdr"), "sites_ge")


_add("cims", _cims, _cims_sql())
_add("cims_empirical", lambda v: _cims(v, empirical=True, least_ratio=0.5), _cims_sql(True, "m / k >= 0.5"))


def _scan_sql(p: float, prefix: str) -> str:
    """Coverage steps of ``aligned`` above what the genes in ``areas`` have by chance: Naus' approximation."""
    pm, cd = (lambda n: f"(CASE WHEN {n} >= 0 THEN pm[({n} + 1)::INT] ELSE 0 END)"), (lambda n: f"(CASE WHEN {n} >= 0 THEN cd[({n} + 1)::INT] ELSE 0 END)")
    steps = _coverage_sql("chrom, strand", "1").replace("FROM tags", "FROM aligned")
    meet = "{a}.chrom = {b}.chrom AND {a}.strand = {b}.strand AND {a}.chromStart < {b}.chromEnd AND {b}.chromStart < {a}.chromEnd"
    return f"""{steps}, size AS (SELECT avg(chromEnd - chromStart) AS read FROM aligned),
        bg AS (SELECT a.name AS gene, a.chromEnd - a.chromStart AS size, count(t.chrom) / (a.chromEnd - a.chromStart) * (SELECT read FROM size) AS mean FROM areas a JOIN aligned t ON {meet.format(a="a", b="t")} GROUP BY a.name, a.chromStart, a.chromEnd),
        hit AS (SELECT c.*, a.name AS gene, bg.size, bg.mean FROM cov c JOIN areas a ON {meet.format(a="a", b="c")} JOIN bg ON bg.gene = a.name WHERE c.score >= 2 AND c.score > bg.mean),
        d AS (SELECT DISTINCT score, size, mean, score::INT AS h, size / (SELECT read FROM size) AS windows FROM hit),
        d1 AS (SELECT *, list_transform(range(0, 2 * h + 1), lambda i: exp(i * ln(mean) - mean - lgamma(i + 1))) AS pm FROM d),
        d2 AS (SELECT *, list_transform(range(0, 2 * h + 1), lambda i: least(list_sum(pm[1:(i + 1)::INT]), 1.0)) AS cd FROM d1),
        d3 AS (SELECT *, pow({cd("(h - 1)")}, 2) - (h - 1) * {pm("h")} * {pm("(h - 2)")} - (h - 1 - mean) * {pm("h")} * {cd("(h - 3)")} AS q2,
          2 * {pm("h")} * {cd("(h - 1)")} * ((h - 1) * {cd("(h - 2)")} - mean * {cd("(h - 3)")}) AS a1,
          0.5 * pow({pm("h")}, 2) * ((h - 1) * (h - 2) * {cd("(h - 3)")} - 2 * (h - 2) * mean * {cd("(h - 4)")} + pow(mean, 2) * {cd("(h - 5)")}) AS a2,
          coalesce(list_sum(list_transform(range(1, h), lambda r: {pm("(2 * h - r)")} * pow({cd("(r - 1)")}, 2))), 0) AS a3,
          coalesce(list_sum(list_transform(range(2, h), lambda r: {pm("(2 * h - r)")} * {pm("r")} * ((r - 1) * {cd("(r - 2)")} - mean * {cd("(r - 3)")}))), 0) AS a4 FROM d2),
        d4 AS (SELECT *, pow({cd("(h - 1)")}, 3) - a1 + a2 + a3 - a4 AS q3 FROM d3),
        d5 AS (SELECT score, size, mean, CASE WHEN q2 <= 0 OR q3 <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - exp(ln(q2) + (windows - 2) * (ln(q3) - ln(q2))))) END AS p FROM d4)
        SELECT hit.chrom, hit.strand, hit.chromStart, hit.chromEnd, hit.score::DOUBLE AS score, gene, round(CASE WHEN p = 0 THEN 1e-100 ELSE p END, 8)::DOUBLE AS p,
          concat('{prefix}_', row_number() OVER (ORDER BY hit.chrom, hit.chromStart, hit.chromEnd, hit.strand, gene)) AS name FROM hit JOIN d5 USING (score, size, mean) WHERE p <= {p}"""


_called = lambda df: df.select("chrom", "strand", "chromStart", "chromEnd", "score", "gene", _r("p", 8), "name")
_add("scan_peaks", lambda v: _called(peaks.call_peaks(v["tags"], v["regions"], p=0.9)), f", aligned AS (SELECT * FROM tags), areas AS (SELECT * FROM regions), {_scan_sql(0.9, 'Peak')}")
_add("cits", lambda v: _called(cits.truncation_sites(v["tags"], v["mutations"], p=0.05)),
     f""", {_islands('chrom, strand', '<= -1')}, grouped AS (SELECT chrom, strand, min(chromStart) AS chromStart, max(chromEnd) AS chromEnd, count(*) AS n,
          concat(chrom, CASE strand WHEN '+' THEN '_f_c' ELSE '_r_c' END, row_number() OVER (PARTITION BY chrom, strand ORDER BY min(chromStart), max(chromEnd), island) - 1) AS name FROM y GROUP BY chrom, strand, island),
        areas AS (SELECT * FROM grouped WHERE n > 2),
        aligned AS (SELECT chrom, strand, CASE strand WHEN '+' THEN chromStart - 1 ELSE chromEnd END AS chromStart, CASE strand WHEN '+' THEN chromStart ELSE chromEnd + 1 END AS chromEnd FROM tags WHERE name NOT IN (SELECT name FROM mutations)),
        {_scan_sql(0.05, 'CITS')}""")  # fmt: skip
_add("exons_whole_codons", lambda v: _exon(G.exons(v["genes"], "coding", partial=True, whole_codons=True)),
     f""", {_EXON}, c AS (SELECT *, greatest(least(e, thickEnd) - greatest(s, thickStart), 0) AS own FROM e), f AS (SELECT *, sum(own) OVER (PARTITION BY name ORDER BY i) - own AS done, sum(own) OVER (PARTITION BY name) AS total FROM c),
        t AS (SELECT *, greatest(s + greatest(thickStart - s, 0) + (3 - done % 3) % 3, thickStart) AS s2, least(e - greatest(e - thickEnd, 0) - (done + own) % 3, thickEnd) AS e2 FROM f WHERE total % 3 = 0 AND own > 0)
        SELECT concat(name, '_', {_STRANDED.format(2)}) AS name, chrom, s2::BIGINT AS chromStart, e2::BIGINT AS chromEnd, strand FROM t WHERE e2 > s2 + 1""")  # fmt: skip


def _two_counts(v: dict[str, DataFrame]) -> DataFrame:
    first = O.region_counts(v["regions"], v["tags"].where("score < 20")).select("name", F.col("n").alias("n1"))
    return first.join(O.region_counts(v["regions"], v["tags"].where("score >= 20")).select("name", F.col("n").alias("n2")), "name")


_add("diff_binomial", lambda v: differential(_two_counts(v)).select("name", "n1", "n2", _r("p", 8), _r("log2fc_counts")),
     f""", b AS (SELECT r.name, count(t.name) FILTER (t.score < 20) AS n1, count(t.name) FILTER (t.score >= 20) AS n2 FROM regions r LEFT JOIN tags t ON {_ON} GROUP BY r.name),
        r0 AS (SELECT *, sum(n1) OVER () / sum(n2) OVER () AS r, n1 + n2 AS t FROM b),
        l AS (SELECT *, list_transform(range(0, t + 1), lambda i: lgamma(t + 1) - lgamma(i + 1) - lgamma(t - i + 1) + i * ln(r / (r + 1)) + (t - i) * ln(1 - r / (r + 1))) AS pm FROM r0)
        SELECT name, n1, n2, round(CASE WHEN t = 0 THEN 1.0 ELSE greatest(least(list_sum(list_transform(list_filter(pm, lambda x: x <= pm[n1 + 1] + ln(1 + 1e-7)), lambda x: exp(x))), 1.0), 1e-100) END, 8)::DOUBLE AS p,
          round(log2((CASE n1 WHEN 0 THEN 1e-7 ELSE n1 END) / (CASE n2 WHEN 0 THEN 1e-7 ELSE n2 END) / r), 6)::DOUBLE AS log2fc_counts FROM l""")  # fmt: skip


def _sam(v: dict[str, DataFrame]) -> DataFrame:
    """SAM lines of six kinds: matches with a substitution, a deletion, a splice, an insertion, a clip, no MD."""
    t = v["tags"].withColumn("n", F.col("chromEnd") - F.col("chromStart")).withColumn("h", F.floor(F.col("n") / 2))
    n, half, rest = (c.cast("string") for c in (F.col("n"), F.col("h"), F.col("n") - F.col("h")))
    kind = F.col("chromStart") % 6
    between = {1: "M2D", 2: "M90N", 3: "M2I"}
    cigar = F.when(kind.isin(0, 5), F.concat(n, F.lit("M"))).when(kind == 4, F.concat(F.lit("3S"), n, F.lit("M")))
    for k, ops in between.items():
        cigar = cigar.when(kind == k, F.concat(half, F.lit(ops), rest, F.lit("M")))
    md = F.when(kind == 1, F.concat(half, F.lit("^AC"), rest)).when(kind == 5, F.lit(None)).otherwise(F.concat(F.lit("6A"), (F.col("n") - 7).cast("string")))
    nm = F.when(kind == 1, 2).when(kind == 3, 3).otherwise(1)
    seq = F.expr("substring(repeat('ACGTTGCA', 10), 1, int(n + case chromStart % 6 when 3 then 2 when 4 then 3 else 0 end))")
    cells = [F.col("name"), F.when(F.col("strand") == "+", "0").otherwise("16"), F.col("chrom"), (F.col("chromStart") + 1).cast("string"), F.lit("60"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), seq, F.lit("*"), F.concat(F.lit("NM:i:"), nm.cast("string")), F.concat(F.lit("MD:Z:"), md)]
    return t.select(F.concat_ws("\t", *cells).alias("value"))


_add("sam_parse", lambda v: sam_tags(sam_columns(_sam(v))).select("chrom", "chromStart", "chromEnd", "name", "score", "strand"),
     """SELECT chrom, chromStart, chromEnd + CASE chromStart % 6 WHEN 1 THEN 2 WHEN 2 THEN 90 ELSE 0 END AS chromEnd, name, CASE chromStart % 6 WHEN 1 THEN 0 ELSE 1 END::DOUBLE AS score, strand FROM tags""")  # fmt: skip
_add("sam_blocks", lambda v: parse_sam(sam_columns(_sam(v))).select("name", F.concat_ws(",", "blockSizes").alias("sizes"), F.concat_ws(",", "blockStarts").alias("starts"), "matchStart"),
     """SELECT name, CASE chromStart % 6 WHEN 1 THEN n + 2 || '' WHEN 2 THEN h || ',' || n - h ELSE n || '' END AS sizes, CASE chromStart % 6 WHEN 2 THEN '0,' || h + 90 ELSE '0' END AS starts,
        CASE WHEN chromStart % 6 = 4 AND strand = '+' THEN 0 ELSE 1 END AS matchStart
        FROM (SELECT *, chromEnd - chromStart AS n, (chromEnd - chromStart) // 2 AS h FROM tags)""")  # fmt: skip
_add("sam_mutations", lambda v: mutations_of(parse_sam(sam_columns(_sam(v)))).select("name", "chromStart", "chromEnd", "offset", "mtype", "refBase", "altBase"),
     """, k AS (SELECT name, chromStart AS s, chromStart % 6 AS kind, (chromEnd - chromStart) // 2 AS h FROM tags)
        SELECT name, s + CASE WHEN kind = 2 AND h <= 6 THEN 96 ELSE 6 END AS chromStart, chromStart + 1 AS chromEnd, 6 AS offset, '>' AS mtype, 'A' AS refBase, CASE WHEN kind = 3 AND h <= 6 THEN 'A' ELSE 'C' END AS altBase
        FROM k WHERE kind IN (0, 2, 3, 4)
        UNION ALL SELECT name, s + h, s + h + 2, h, '-', 'AC', '.' FROM k WHERE kind = 1
        UNION ALL SELECT name, s + h, s + h + 1, h, '+', '.', substr('ACGTTGCAA', (h % 8 + 1)::INT, 2) FROM k WHERE kind = 3""")  # fmt: skip


def _novo(v: dict[str, DataFrame]) -> DataFrame:
    seq = F.expr("substring(repeat('ACGTTGCA', 10), 1, int(chromEnd - chromStart))")
    empty = F.lit(".")
    side = F.when(F.col("strand") == "+", "F").otherwise("R")
    cells = [F.col("name"), empty, seq, empty, F.when(F.col("chromStart") % 4 == 0, "R").otherwise("U"), empty, empty, F.col("chrom"), (F.col("chromStart") + 1).cast("string"), side, empty, empty, empty, F.lit("8A>G 5-C")]
    return v["tags"].select(F.concat_ws("\t", *cells).alias("value"))


_add("novoalign_parse", lambda v: parse_novoalign(novoalign_columns(_novo(v))).select("chrom", "name", "chromStart", "chromEnd", "score", F.size("mutations").alias("n")),
     "SELECT chrom, name, chromStart, chromEnd + 1 AS chromEnd, 1.0::DOUBLE AS score, 2::INT AS n FROM tags WHERE chromStart % 4 != 0")
_add("global_totals", lambda v: v["tags"].agg(F.count(F.lit(1)).alias("tags"), F.sum(F.col("chromEnd") - F.col("chromStart")).alias("bases"), F.countDistinct("name").alias("names")),
     "SELECT count(*) AS tags, sum(chromEnd - chromStart)::BIGINT AS bases, count(DISTINCT name) AS names FROM tags")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags per region with weights: the flagship query."""
    v = _views(spark, sf_dir)
    return O.region_counts(v["regions"], v["tags"]).select("chrom", "chromStart", "chromEnd", "name", "strand", "n", "total")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, q=query: q(_views(spark, sf_dir))) for name, (query, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _sql(sql) for name, (_, sql) in _QUERIES.items() if sql is not None}
