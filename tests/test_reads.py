"""Reads, rows, mutations, gene models and the text formats on hand-made cases."""

import random

import numpy as np
import plain_alignment
import pytest
from pyspark.sql import functions as F

from locusloom.functions import em, seq, stats
from locusloom.operators import cluster, collapse, coverage, differential, fdr, genes, mutations, reads, rows
from locusloom.plans import annotate, cims, cits, peaks
from locusloom.sources import alignments, bed, fastx, tables, tracks

BED = "chrom string, chromStart long, chromEnd long, name string, score double, strand string"
SPLICED = BED + ", thickStart long, thickEnd long, itemRgb string, blockCount int, blockSizes array<long>, blockStarts array<long>"


def test_barcode_strip_is_strict(spark):
    df = spark.createDataFrame([("a", "ACGTA"), ("b", "ACGTAC")], "id string, seq string")
    assert [tuple(r) for r in reads.strip_barcode(df, 5).select("id", "seq").collect()] == [("b#ACGTA", "C")]


def test_quality_rules_and_index(spark):
    df = spark.createDataFrame([("a", "AcGN", "5555"), ("b", "ACGT", "!555")], "id string, seq string, qual string")
    assert [r.id for r in reads.filter_reads(df, quality="min:0-0:20").collect()] == ["a"]
    assert [r.id for r in reads.filter_reads(df, quality="mean:0-3:16", index="1:cg").collect()] == ["a"]
    assert [r.id for r in reads.filter_reads(df, max_n=0).collect()] == ["b"]
    numbers = spark.createDataFrame([("20 30 -5",)], "q string").select(seq.qualities(F.col("q")).alias("q")).first().q
    assert numbers == [20, 30, -5]


def test_hamming_is_not_levenshtein(spark):
    row = spark.createDataFrame([("ACGTA", "CGTAA")], "a string, b string").select(seq.hamming(F.col("a"), F.col("b")).alias("d"), seq.reverse_complement(F.col("a")).alias("r")).first()
    assert (row.d, row.r) == (4, "TACGT")


def test_collapse_drops_bad_barcodes(spark):
    df = spark.createDataFrame([("c", 0, 10, "a#AC", 1.0, "+"), ("c", 0, 12, "b#AC", 1.0, "+"), ("c", 0, 9, "c#AN", 1.0, "+"), ("c", 4, 10, "d#AC", 1.0, "-"), ("c", 1, 10, "e#AC", 1.0, "-")], BED)
    got = {(r.name, r.score) for r in collapse.collapse_barcodes(df).collect()}
    assert got == {("b#AC", 2.0), ("e#AC", 2.0)}
    assert {(r.name, r.score) for r in collapse.collapse_5p(df).collect()} == {("b#AC", 3.0), ("e#AC", 2.0)}


def test_em_recovers_planted_barcodes(spark):
    rng = random.Random(7)
    true = ["ACGTACG", "TTGACCA", "GGGTTTA"]
    seen = {}
    for b, n in zip(true, (400, 300, 200), strict=True):
        for _ in range(n):
            s = "".join(rng.choice("ACGT".replace(x, "")) if rng.random() < 0.01 else x for x in b)
            seen[s] = seen.get(s, 0) + 1
    fit = em.barcode_mixture(list(seen), [float(x) for x in seen.values()])
    assert sum(fit["n"]) == pytest.approx(900)
    assert em.LOWEST_ERROR <= fit["error"] <= em.HIGHEST_ERROR
    best = sorted(zip(fit["n"], seen, strict=True), reverse=True)[:3]
    assert {b for _, b in best} == set(true)
    assert em.barcode_mixture(["A"], [5.0])["reliability"] == [100.0]
    assert em.radius(500, 10, 0.02) is None and em.radius(3000, 10, 0.02) == 1
    df = spark.createDataFrame([("c", 0, 10 + i, f"x{i}#{b}", 0.0, "+") for i, (b, n) in enumerate(seen.items()) for _ in range(n)], BED)
    kept = collapse.collapse_em(df, 30, "em-local").collect()
    assert {r.barcode for r in kept} == set(true)


def test_sparse_mixture_is_close_to_the_dense_one(monkeypatch):
    barcodes = ["AAAA", "AAAC", "CCGG", "CCGT", "TTTT"]
    dense = em.barcode_mixture(barcodes, [50.0, 2.0, 30.0, 1.0, 9.0], 0.02)
    monkeypatch.setattr(em, "DENSE_LIMIT", 1)
    sparse = em.barcode_mixture(barcodes, [50.0, 2.0, 30.0, 1.0, 9.0], 0.02)
    assert np.allclose(dense["n"], sparse["n"], atol=0.05)


def test_statistics():
    assert stats.scan_p_value(5, 1.0, 20) == pytest.approx(0.2145, abs=0.002)
    assert stats.binomial_two_sided(5, 10, 0.5) == pytest.approx(1.0)
    assert stats.binomial_two_sided(0, 10, 0.5) == pytest.approx(2 / 1024)


def parsed(spark, lines, **options):
    """Reads (flag, pos, cigar, seq, tags) as parsed by columns, None for those left out."""
    text = [("\t".join([f"q{i}", str(flag), "c", str(pos), "60", cigar, "*", "0", "0", seq, "*", *([tags] if tags else [])]),) for i, (flag, pos, cigar, seq, tags) in enumerate(lines)]
    found = alignments.parse_sam(alignments.sam_columns(spark.createDataFrame(text, "value string")), **options)
    rows = {r.name: {k: v for k, v in r.asDict(True).items() if k not in ("chrom", "name")} for r in found.collect()}
    return [rows.get(f"q{i}") for i in range(len(lines))]


def test_scan_p_values_go_together_by_height(spark):
    rng = np.random.default_rng(5)
    height, mean, windows = rng.integers(-1, 40, 500), rng.choice([0.0, 0.3, 2.0, 9.5], 500) * rng.random(500), rng.random(500) * 90 + 1
    many = stats.scan_p_values(height, mean, windows)
    assert np.array_equal(many, [stats.scan_p_value(*row) for row in zip(height, mean, windows, strict=True)])
    assert np.all((many >= 0) & (many <= 1)) and np.all(many[height <= 0] == 1) and np.all(many[(height > 1) & (mean == 0)] == 0)
    rows = spark.createDataFrame([(3.0, 1.0, 9.0), (None, 1.0, 9.0), (3.0, float("nan"), 9.0)], "h double, m double, w double")
    found = [r.p for r in rows.select(stats.scan_p(F.col("h"), F.col("m"), F.col("w")).alias("p")).collect()]
    assert found[0] == stats.scan_p_value(3, 1.0, 9.0) and found[1:] == [None, None]


def test_clusters_carry_no_names(spark):
    """Only rows shorter than the overlap asked for need telling apart."""
    name = lambda n: F.concat(F.lit("MARKED"), F.col("id").cast("string")).alias(n)
    tags = spark.range(40).select(F.lit("c").alias("chrom"), (F.floor(F.col("id") / 2) * 7).alias("chromStart"), (F.floor(F.col("id") / 2) * 7 + 5).alias("chromEnd"), name("name"), F.lit(1.0).alias("score"), F.lit("+").alias("strand"))
    made = cluster.cluster(tags, -1, stranded=True)
    assert [r.n for r in made.collect()] == [2] * 20 and "MARKED" not in made._jdf.queryExecution().optimizedPlan().toString()
    empty = tags.withColumn("chromEnd", F.col("chromStart"))
    assert [r.n for r in cluster.cluster(empty, -1, stranded=True).collect()] == [1] * 40


def test_coverage_looks_at_its_bins_once(spark):
    tags = spark.createDataFrame([("c", 5, 300_000, "t", 1.0, "+"), ("c", 7, 9, "t", 1.0, "+"), (None, 1, 2, "t", 1.0, "+")], BED)
    found = coverage.exact_coverage(tags)
    assert sorted(map(tuple, found.collect())) == [("c", 5, 7, 1.0), ("c", 7, 9, 2.0), ("c", 9, 300_000, 1.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_alignment_rules(spark):
    a, b, c, d = parsed(spark, [(0, 101, "3S10M2D10M100N5M", "NNN" + "A" * 25, "NM:i:3\tMD:Z:4C5^GT15"), (16, 1, "6M2I6M", "ACGTACTTACGTAC", "NM:i:2\tMD:Z:12"), (4, 1, "*", "A", ""), (0, 1, "5M", "ACGTA", "")])
    assert (a["chromStart"], a["chromEnd"], a["matchStart"], a["score"]) == (100, 227, 0, 1.0)
    assert (a["blockSizes"], a["blockStarts"]) == ([22, 5], [0, 122])
    kinds = [(m["mtype"], m["chromStart"], m["chromEnd"], m["refBase"], m["altBase"], m["good"]) for m in a["mutations"]]
    assert kinds == [(">", 104, 105, "C", "A", True), ("-", 110, 112, "GT", ".", True)]
    assert [(m["mtype"], m["altBase"], m["good"]) for m in b["mutations"]] == [("+", "TT", True)] and b["score"] == 0.0
    assert c is None and d["mutations"] == []


@pytest.mark.parametrize("anchors", [(1, 5), (3, 2), (0, 0)])
def test_columns_equal_plain_loops(spark, anchors):
    rng = random.Random(anchors[0])
    lines = []
    for _ in range(400):
        ops = [(rng.randrange(1, 9), rng.choice("MMMMDIN=XP")) for _ in range(rng.randrange(1, 7))]
        cigar = rng.choice(["", "2S", "3H1S"]) + "".join(f"{n}{op}" for n, op in ops) + rng.choice(["", "4S", "1S2H"])
        # MD that follows the operations, with bases replaced here and there.
        md, run = "", 0
        for n, op in ops:
            for _ in range(n if op in "M=X" else 0):
                if rng.random() < 0.15:
                    md, run = md + f"{run}{rng.choice('ACGTNg')}", 0
                else:
                    run += 1
            if op == "D":
                md, run = md + f"{run}^{''.join(rng.choices('ACGTN', [9, 9, 9, 9, 1], k=n))}", 0
        md += str(run)
        seq = "*" if rng.random() < 0.05 else "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=60))
        tags = rng.choice([f"NM:i:90\tMD:Z:{md}"] * 6 + ["NM:i:90", f"MD:Z:{md}", "", "MD:Z:3A^C2", "NM:i:90\tMD:Z:"])
        lines.append((rng.choice([0, 16]), rng.randrange(1, 99), cigar, seq, tags))
    for in_score in (False, True):
        found = parsed(spark, lines, anchor=anchors[0], indel_anchor=anchors[1], indel_in_score=in_score)
        want = [plain_alignment.parse_alignment(*line, *anchors, in_score) if set(line[2]) & set("M=X") else None for line in lines]
        for line, one, other in zip(lines, found, want, strict=True):
            assert one == other, line
    assert sum(len(w["mutations"]) for w in want if w) > 300


def test_wrong_lines_are_errors(spark):
    for line in [(0, 1, "5M2Q5M", "ACGTACGTAC", "NM:i:0"), (0, 1, "5M2D5M", "ACGTACGTAC", "NM:i:1")]:
        with pytest.raises(Exception, match="unexpected CIGAR|NM below"):
            parsed(spark, [line])


def test_arrays_are_made_once_and_ends_need_none(spark):
    sam = alignments.sam_columns(spark.createDataFrame([("q\t0\tc\t5\t60\t5M2D5M\t*\t0\t0\tACGTACGTAC\t*\tNM:i:2\tMD:Z:5^AC5",)], "value string"))
    plan = alignments.sam_tags(sam).select("chromStart", "chromEnd", "score")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "split" in plan
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = alignments.mutations_of(alignments.parse_sam(sam))._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "InArrow" not in plan and plan.count("([MIDN])") == plan.count("|[A-Za-z]") == plan.count("^[A-Za-z]$") == 1  # operations, tokens, replaced bases


def test_filters_do_not_make_a_line_anew(spark):
    rows = spark.createDataFrame([("q", "5M", 1)], "name string, cigar string, kind int")
    text = F.concat_ws("\t", "name", F.lit("0"), F.lit("c"), F.lit("7"), F.lit("60"), F.when(F.col("kind") == 1, F.concat("cigar", F.lit(""))).otherwise("MARKED"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGTA"), F.lit("*"))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    for query in (alignments.parse_sam, alignments.sam_tags):
        assert query(alignments.sam_columns(rows.select(text.alias("value"))))._jdf.queryExecution().optimizedPlan().toString().count("MARKED") == 1
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_short_lines_equal_plain_loops(spark):
    marks = ["", "0", "12", "5A6", "0A9", "9a2", "6N5", "5^AC7", "5^an7", "4^AC8", "6^ACG6", "11A0", "99A1", "1234567890A1", "6T0T5", "6^AC0T5"]
    lines = [(side, 11, cigar, seq, f"NM:i:9\tMD:Z:{md}") for side in (0, 16) for cigar in ("12M", "6M3I6M", "5M2D7M", "6M90N6M", "2S6M1I6M3S", "1I9M") for seq in ("ACGTTGCAACGTTGCAACGT", "ACGTTNNNACGT", "*") for md in marks]
    for anchors in ((1, 5), (0, 0), (6, 6)):
        found = parsed(spark, lines, anchor=anchors[0], indel_anchor=anchors[1])
        for line, one in zip(lines, found, strict=True):
            assert one == plain_alignment.parse_alignment(*line, *anchors, False), line


def test_sam_file_to_tags(spark, tmp_path):
    path = tmp_path / "x.sam"
    path.write_text("@HD\tVN:1\nr1\t0\tc\t11\t60\t10M\t*\t0\t0\tACGTACGTAC\t*\tNM:i:1\tMD:Z:5A4\n\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*\nr3\t0\tc\t5\t3\t4M\t*\t0\t0\tACGT\t*\tNM:i:0\tMD:Z:4\n")
    parsed = alignments.parse_sam(alignments.read_sam(spark, str(path)), least_quality=10)
    assert [(r.name, r.chromStart, r.chromEnd) for r in alignments.tags_of(parsed).collect()] == [("r1", 10, 20)]
    assert [(r.chromStart, r.refBase, r.altBase) for r in alignments.mutations_of(parsed).collect()] == [(15, "A", "C")]


def test_tags_without_python_equal_parsed_ones(spark):
    rng = random.Random(8)
    rows = [("3S10M2D10M100N5M", "NM:i:3"), ("6M2I6M", "NM:i:2"), ("2D5M", "NM:i:2"), ("4=1X5=", "NM:i:1"), ("5M1P5M", ""), ("2H3S9M4S1H", "NM:i:0"), ("5M3N2D5M", "NM:i:2"), ("5M2D3N5M", "NM:i:2"), ("4I", "NM:i:4"), ("*", "")]
    for _ in range(200):
        inner = "".join(f"{rng.randrange(1, 9)}{rng.choice('MMMDIN=X')}" for _ in range(rng.randrange(1, 6)))
        rows.append((f"{rng.choice(['', '2S', '3H1S'])}{inner}{rng.choice(['', '4S', '1S2H'])}", "NM:i:90"))
    lines = [("\t".join([f"q{i}", str(rng.choice([0, 16])), "c", str(rng.randrange(1, 99)), "60", cigar, "*", "0", "0", "ACGT" * 30, "*", *([tags] if tags else [])]),) for i, (cigar, tags) in enumerate(rows)]
    sam = alignments.sam_columns(spark.createDataFrame(lines, "value string"))
    for in_score in (False, True):
        want = alignments.tags_of(alignments.parse_sam(sam, indel_in_score=in_score))
        got = alignments.sam_tags(sam, indel_in_score=in_score)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100


def test_other_matches_and_padding(spark):
    plain, other = parsed(spark, [(0, 11, c, "ACGTACGTAC", "NM:i:1\tMD:Z:4T5") for c in ("10M", "4=1P1X5=")])
    assert plain == other and plain["blockSizes"] == [10]


def test_bed_round_trip(spark, tmp_path):
    path = tmp_path / "x.bed"
    path.write_text("track name=x\n# c\nc\t0\t10\nc\t5\t9\tn\t2.5\t-\t5\t9\t0\t2\t1,2,\t0,2,\n")
    table = bed.read_bed(spark, str(path), defaults=True)
    assert [(r.name, r.score, r.strand, r.blockSizes) for r in table.orderBy("chromStart").collect()] == [("c:1-10", 0.0, "+", None), ("n", 2.5, "-", [1, 2])]
    bed.write_bed(table.where("name = 'n'"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "c\t5\t9\tn\t2.5\t-\t5\t9\t0\t2\t1,2,\t0,2,"


def test_fastx_and_tracks(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 some\nACGT\nAC\n>r2\nAC\n")
    assert {(r.id, r.seq) for r in fastx.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {("r1", "ACGTAC"), ("r2", "AC")}
    (tmp_path / "a.fq").write_text("@q1 x\nACGT\n+\n!!!!\n@q2\nAC\n+\n55\n")
    found = fastx.read_fastq(spark, str(tmp_path / "a.fq"))
    assert sorted((r.id, r.seq, r.qual) for r in found.collect()) == [("q1", "ACGT", "!!!!"), ("q2", "AC", "55")]
    assert sorted(r.value for r in fastx.fastx_lines(found).collect())[0] == "@q1\nACGT\n+\n!!!!"
    (tmp_path / "a.bg").write_text("track name=x (+)\nc 0 5 2\ntrack name=x (-)\nc 5 9 3\n")
    assert [(r.chromStart, r.score, r.strand) for r in tracks.read_bedgraph(spark, str(tmp_path / "a.bg")).collect()] == [(0, 2.0, "+"), (5, 3.0, "-")]


def test_registry(spark, tmp_path):
    (tmp_path / "reg").write_text("# x\nhg1 region a.bed cds\nhg1 gene /abs/g.bed\n")
    registry = tables.read_registry(spark, str(tmp_path / "reg"))
    assert tables.locations(registry, "hg1", "region") == {"cds": f"{tmp_path}/a.bed"}
    assert tables.locations(registry, "hg1", "gene") == {"gene": "/abs/g.bed"}
    with pytest.raises(KeyError):
        tables.locations(registry, "hg2", "gene")


def gene(spark, rows_):
    return spark.createDataFrame(rows_, SPLICED)


def test_exons_and_codons(spark):
    g = gene(spark, [("c", 0, 100, "t", 0.0, "+", 5, 95, "0", 3, [20, 20, 20], [0, 40, 80]), ("c", 0, 100, "m", 0.0, "-", 5, 95, "0", 3, [20, 20, 20], [0, 40, 80])])
    assert {r.name: r.chromStart for r in genes.exons(g).collect()} == {"t_0": 0, "t_1": 40, "t_2": 80, "m_0": 80, "m_1": 40, "m_2": 0}
    five = {r.name: (r.chromStart, r.chromEnd) for r in genes.exons(g, "5utr", partial=True).collect()}
    assert five == {"t_0": (0, 5), "m_0": (95, 100)}
    assert [r.name for r in genes.exons(g, which="internal").where("strand = '+'").collect()] == ["t_1"]
    assert {r.name: r.chromStart for r in genes.introns(g).collect()} == {"t_0": 20, "t_1": 60, "m_0": 60, "m_1": 20}
    assert genes.exons(g, introns_are="long", intron_length=21).where("name = 't_1'").count() == 1
    frame = gene(spark, [("c", 0, 100, "t", 0.0, "+", 4, 90, "0", 3, [20, 21, 20], [0, 40, 80])])  # 16 + 21 + 10 = 47: no frame
    assert genes.exons(frame, "coding", partial=True, whole_codons=True).count() == 0
    frame = gene(spark, [("c", 0, 100, "t", 0.0, "+", 4, 91, "0", 3, [20, 21, 20], [0, 40, 80])])  # 48
    assert [(r.chromStart, r.chromEnd) for r in genes.exons(frame, "coding", partial=True, whole_codons=True).orderBy("chromStart").collect()] == [(4, 19), (42, 60), (82, 91)]


def test_union_of_transcripts(spark):
    t = gene(spark, [("c", 0, 50, "a", 0.0, "+", 0, 50, "0", 2, [10, 10], [0, 40]), ("c", 5, 30, "b", 0.0, "+", 5, 30, "0", 1, [25], [0]), ("d", 0, 9, "x", 0.0, "+", 0, 9, "0", 1, [9], [0]), ("d", 0, 9, "y", 0.0, "-", 0, 9, "0", 1, [9], [0])])
    of = spark.createDataFrame([("a", "g"), ("b", "g"), ("x", "h"), ("y", "h")], "transcript string, gene string")
    whole, bad = genes.union_transcripts(t, of)
    r = whole.collect()[0]
    assert (r.name, r.chromStart, r.chromEnd, r.blockSizes, r.blockStarts) == ("g", 0, 50, [30, 10], [0, 40])
    assert {x.name for x in bad.collect()} == {"x", "y"}


def test_lookup_rules(spark):
    probe = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    build = spark.createDataFrame([("A", "1"), ("A", ""), ("A", "2")], "k string, v string")
    one = rows.lookup_join(probe, build, "k", "k", ignore_case=True, single_line=True, outer=True, no_match="none")
    assert sorted((r.k, r.build_v) for r in one.collect()) == [("a", "1||2"), ("a", "1||2"), ("b", "none")]
    assert rows.lookup_join(probe, build, "k", "k", ignore_case=True).count() == 6
    with pytest.raises(ValueError):
        rows.checked_join(build, build.distinct(), "k")
    with pytest.raises(ValueError):
        rows.unique_rows(build, "k", "v", "no such")


def test_unique_rows_skip_missing(spark):
    df = spark.createDataFrame([("a", "1", "NA"), ("a", "3", "NA"), ("b", "NA", "2")], "k string, x string, y string")
    sums = {r.k: (r.x, r.y) for r in rows.unique_rows(df, "k", "x", "rowsum").collect()}
    means = {r.k: (r.x, r.y) for r in rows.unique_rows(df, "k", "x", "rowmean").collect()}
    assert sums == {"a": (4.0, 0.0), "b": (0.0, 2.0)} and means == {"a": (2.0, None), "b": (None, 2.0)}


def test_unique_rows_options(spark):
    df = spark.createDataFrame([("b", 1, "x"), ("a", 5, "y"), ("a", 7, "z")], "k string, v long, more string")
    assert [tuple(r) for r in rows.unique_rows(df, "k", "v", "max_num", extra=False, by_key=True).collect()] == [("a", 7), ("b", 1)]
    assert [r.more for r in rows.unique_rows(df, "k", "v", "max_num", by_key=True).collect()] == ["z", "x"]


def test_mixture_diagnostics(spark, tmp_path):
    df = spark.createDataFrame([("c", 0, 10, f"a{i}#{b}", 0.0, "+") for i, b in enumerate(["AC"] * 6 + ["AG"] * 2)] + [("c", 50, 60, "z#AC", 0.0, "+")], BED)
    found = collapse.mixture_diagnostics(df)
    want = em.barcode_mixture(["AC", "AG"], [6.0, 2.0])
    assert [(r.chrom, r.k, r.N, r.e) for r in found.collect()] == [("c", 2, 8.0, want["error"])]
    collapse.write_diagnostics(found, str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).first().value.split("\t")[:2] == ["2", "8.0"]


def test_other_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "by"
    folder.mkdir()
    (folder / "chr1.bed").write_text("chr1\t0\t5\tx\t1\t+\n")
    (folder / "chr2.bed").write_text("chr2\t3\t9\n")
    found = bed.read_bed_by_chromosome(spark, str(folder)).orderBy("chrom").collect()
    assert [(r.chrom, r.chromEnd, r.name, r.file_chrom) for r in found] == [("chr1", 5, "x", "chr1"), ("chr2", 9, "chr2:4-9", "chr2")]
    (tmp_path / "map").write_text("t1\tg1\nt2\tg1\n")
    assert sorted(map(tuple, tables.read_mapping(spark, str(tmp_path / "map"), "t", "g").collect())) == [("t1", "g1"), ("t2", "g1")]
    (tmp_path / "len").write_text("chr1\t100\n")
    assert [tuple(r) for r in tables.read_lengths(spark, str(tmp_path / "len")).collect()] == [("chr1", 100)]
    (tmp_path / "ids").write_text("a more\n\n  b\n")
    assert [r.name for r in tables.read_ids(spark, str(tmp_path / "ids")).collect()] == ["a", "b"]
    (tmp_path / "fc").write_text("c1\t-1.5\n")
    assert [tuple(r) for r in tables.read_expression(spark, str(tmp_path / "fc")).collect()] == [("c1", -1.5)]
    tables.write_tsv(spark.createDataFrame([("a", 1)], "x string, y long"), str(tmp_path / "tsv"), header=True)
    assert [tuple(r) for r in tables.read_tsv(spark, str(tmp_path / "tsv"), header=True).collect()] == [("a", "1")]


def test_fdr_is_zero_where_not_simulated_and_monotone(spark):
    observed = fdr.site_histogram(spark.createDataFrame([(1, 1)] * 4 + [(2, 1)] * 2 + [(2, 2)], "k long, m long"))
    simulated = fdr.site_histogram(spark.createDataFrame([(1, 1)] * 4 + [(2, 1)], "k long, m long"))
    rates = {(r.k, r.m): r.fdr for r in fdr.permutation_fdr(observed, simulated, 2).collect()}
    assert rates == {(1, 1): 0.5, (2, 1): 0.5, (2, 2): 0.0}


def test_fdr_pools_iterations_before_it_cumulates(spark):
    observed = fdr.site_histogram(spark.createDataFrame([(5, 2)] * 4, "k long, m long"))
    # The first iteration shows (5, 3) but not (5, 2), the second the reverse.
    drawn = spark.createDataFrame([(0, 5, 3), (1, 5, 2)], "iteration int, k long, m long")
    simulated = fdr.site_histogram(drawn, ["iteration"])
    assert [(r.k, r.m, r.fdr) for r in fdr.permutation_fdr(observed, simulated, 2).collect()] == [(5, 2, 0.25)]


def test_simulation_places_all_sites_on_tags(spark):
    tags = spark.createDataFrame([("c", 0, 30, "a", 0.0, "+"), ("c", 100, 130, "b", 0.0, "-")], BED)
    sites = mutations.simulate_sites(tags, 200, 3).collect()
    assert len(sites) == 600 and {r.iteration for r in sites} == {0, 1, 2}
    assert all(0 < r.chromStart % 100 < 29 for r in sites)
    offsets = spark.createDataFrame([(3,)], "offset long")
    assert {r.chromStart for r in mutations.simulate_sites(tags, 50, 1, offsets=offsets).collect()} == {3, 126}


def test_simulation_carries_no_names(spark):
    tags = spark.range(50).select(F.lit("c").alias("chrom"), F.col("id").alias("chromStart"), (F.col("id") + 9).alias("chromEnd"), F.concat(F.lit("MARKED"), F.col("id").cast("string")).alias("name"), F.lit("+").alias("strand"))
    drawn = mutations.simulate_sites(tags, 40, 2)
    assert drawn.count() == 80 and "MARKED" not in drawn._jdf.queryExecution().optimizedPlan().toString()


def test_cims_finds_a_planted_site(spark):
    rng = random.Random(1)
    tags, muts = [], []
    for i in range(400):
        s = rng.randrange(4000)
        tags.append(("c", s, s + 30, f"t{i}", 0.0, "+"))
        muts.append(("c", s + 10, s + 11, f"t{i}", 0.0, "+", "T", "-", "."))
    for i in range(40):
        s = 5000 + i % 5
        tags.append(("c", s, s + 30, f"p{i}", 0.0, "+"))
        muts.append(("c", 5015, 5016, f"p{i}", 0.0, "+", "T", "-", "."))
    found = cims.mutation_sites(spark.createDataFrame(tags, BED), spark.createDataFrame(muts, BED + ", refBase string, mtype string, altBase string"), fdr=0.01).collect()
    assert [(r.chromStart, r.m) for r in found if r.m > 10] == [(5015, 40)]


def test_cits_finds_a_planted_site(spark):
    rng = random.Random(2)
    tags = [("c", s, s + 30, f"t{i}", 0.0, "+") for i, s in enumerate(rng.randrange(600) for _ in range(200))] + [("c", 301, 330, f"p{i}", 0.0, "+") for i in range(40)]
    none = spark.createDataFrame([], BED)
    found = cits.truncation_sites(spark.createDataFrame(tags, BED), none, p=1e-6).collect()
    assert [(r.chromStart, r.score >= 40) for r in found] == [(300, True)]


def test_cits_areas_part_at_book_ends(spark):
    # Two pairs of reads that only touch: no area holds three, so nothing can be tested.
    pairs = [("c", 100, 130, "a", 0.0, "+"), ("c", 100, 130, "b", 0.0, "+"), ("c", 130, 160, "d", 0.0, "+"), ("c", 130, 160, "e", 0.0, "+")]
    none = spark.createDataFrame([], BED)
    assert cits.truncation_sites(spark.createDataFrame(pairs, BED), none, p=1.0).count() == 0
    # One more read over the border joins them to one area of five.
    over = [*pairs, ("c", 120, 150, "f", 0.0, "+")]
    found = cits.truncation_sites(spark.createDataFrame(over, BED), none, p=1.0).collect()
    assert sorted((r.chromStart, r.chromEnd, r.score) for r in found) == [(129, 130, 2.0)]


def test_peaks_need_genes_or_valleys(spark):
    with pytest.raises(ValueError):
        peaks.call_peaks(spark.createDataFrame([], BED))


def test_differential(spark):
    df = spark.createDataFrame([("a", 30, 10), ("b", 10, 30), ("z", 0, 0)], "name string, n1 long, n2 long")
    got = {r.name: r for r in differential.differential(df).collect()}
    assert got["a"].p == pytest.approx(stats.binomial_two_sided(30, 40, 0.5)) and got["a"].log2fc_counts == pytest.approx(np.log2(3))
    assert got["z"].p == 1.0


def test_annotation_labels(spark):
    tags = spark.createDataFrame([("c", 0, 10, "in", 0.0, "+"), ("c", 500, 510, "out", 0.0, "+"), ("c", 60, 70, "intron", 0.0, "+")], BED)
    mk = lambda s, e: spark.createDataFrame([("c", s, e, "x", 0.0, "+")], BED)
    sets = {"genic": mk(0, 100), "exon": mk(0, 20), "5utr": mk(0, 5), "3utr": mk(900, 905), "cds": mk(5, 20), "upstream_10k": mk(200, 210), "downstream_10k": mk(210, 220)}
    got = {r.name: r.region for r in annotate.annotate_region(tags, sets).collect()}
    assert got == {"in": "CDS||5'UTR", "out": "deep_intergenic", "intron": "intron"}
    summary = {r.region: (r.n, r.adjusted) for r in annotate.region_summary(tags, sets).collect()}
    assert summary["Genic"] == (2, None) and summary["CDS exon"] == (1, 16.7) and summary["Deep intergenic"] == (1, 33.3)


def test_report_text(spark, tmp_path):
    tags = spark.createDataFrame([("c", 0, 10, "in", 0.0, "+"), ("c", 500, 510, "out", 0.0, "+")], BED)
    gene_ = spark.createDataFrame([("c", 0, 20, "x", 0.0, "+")], BED)
    found = annotate.annotate_best(tags, gene_)
    repeat = annotate.report_section("rmsk", annotate.overlap_counts(found, "feature", "Intervals overlapping repeat masked region"))
    far = spark.createDataFrame([("c", 900, 905, "x", 0.0, "+")], BED)
    sets = {"genic": gene_, "exon": gene_, "5utr": far, "3utr": far, "cds": gene_, "upstream_10k": far, "downstream_10k": far}
    region = annotate.report_section("region", annotate.region_summary(tags, sets))
    annotate.write_report([repeat, region], str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert lines[:8] == ["", "", "Summary of rmsk annotation", "-" * 30, "", "Region\tNo.\t%", "Intervals overlapping repeat masked region\t1\t50.0", "Other\t1\t50.0"]
    assert lines[8:16] == ["", "", "Summary of region annotation", "-" * 30, "", "Region\tNo.\t%", "Total\t2\t100.0", "Genic\t1\t50.0"]
    assert lines[-10:] == ["", "Percentage of intervals in each region (adjusted):", "Region\t%", "CDS exon\t50.0", "5' UTR exon\t0.0", "Upstream 10K\t0.0", "3' UTR exon\t0.0", "Downstream 10K\t0.0", "Intron\t0.0", "Deep intergenic\t50.0"]
