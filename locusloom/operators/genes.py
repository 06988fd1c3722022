"""Gene models: exons, introns, unions of transcripts, whole codons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import blocks
from .cluster import islands

_PLUS = lambda: F.col("strand") == "+"


def _range(part: str) -> tuple[Column, Column]:
    """The stretch of a transcript that a filter allows."""
    s, e, ts, te = (F.col(c) for c in ("chromStart", "chromEnd", "thickStart", "thickEnd"))
    if part == "":
        return s, e
    if part == "coding":
        return ts, te
    if part == "5utr":
        return F.when(_PLUS(), s).otherwise(te), F.when(_PLUS(), ts).otherwise(e)
    if part == "3utr":
        return F.when(_PLUS(), te).otherwise(s), F.when(_PLUS(), e).otherwise(ts)
    raise ValueError(f"unknown filter {part!r}")


def _ready(genes: DataFrame, part: str, keep_noncoding: bool) -> DataFrame:
    if part and not keep_noncoding:
        genes = genes.where("thickEnd > thickStart + 1")
    lo, hi = _range(part)
    return genes.withColumn("_blocks", blocks(genes)).withColumn("_n", F.size("_blocks")).withColumn("_lo", lo).withColumn("_hi", hi)


def _output(df: DataFrame, numbered: bool) -> DataFrame:
    name = F.concat("name", F.lit("_"), F.col("j").cast("string")) if numbered else F.col("name")
    return df.select("chrom", F.col("s").alias("chromStart"), F.col("e").alias("chromEnd"), name.alias("name"), "score", "strand")


def exons(
    genes: DataFrame,
    part: str = "",
    partial: bool = False,
    which: str = "all",
    left: int = 0,
    right: int = 0,
    introns_are: str = "all",
    intron_length: int = 240,
    numbered: bool = True,
    keep_noncoding: bool = False,
    keep_1nt: bool = False,
    whole_codons: bool = False,
) -> DataFrame:
    """The exons of every transcript, numbered 5' to 3'.

    ``part``: "", ``5utr``, ``coding`` or ``3utr``; ``partial`` also takes exons that reach
    out of it, cut to it.  ``which``: ``all``, ``internal``, ``terminal``, ``terminal5`` or
    ``terminal3``.  ``left`` and ``right`` extend along the read.  ``introns_are`` ``long``
    or ``short`` keeps exons whose neighbouring introns all are (a missing one counts as
    length 0).  Exons of one base drop out unless ``keep_1nt``.  ``whole_codons`` cuts
    coding exons to whole codons and leaves out frames that are not.
    """
    ready = _ready(genes, part, keep_noncoding)
    if whole_codons:
        ready = _with_frames(ready)
    one = ready.select("*", F.posexplode("_blocks").alias("i", "_b")).withColumn("j", F.when(_PLUS(), F.col("i")).otherwise(F.col("_n") - 1 - F.col("i")))
    one = one.withColumn("s", F.col("_b.s")).withColumn("e", F.col("_b.e"))
    ends = {"internal": (F.col("i") > 0) & (F.col("i") < F.col("_n") - 1), "terminal": (F.col("i") == 0) | (F.col("i") == F.col("_n") - 1), "terminal5": F.col("j") == 0, "terminal3": F.col("j") == F.col("_n") - 1}
    if which != "all":
        one = one.where(ends[which])
    meets = (F.col("e") > F.col("_lo")) & (F.col("s") < F.col("_hi")) if partial else (F.col("s") >= F.col("_lo")) & (F.col("e") <= F.col("_hi"))
    one = one.where(meets)
    if introns_are != "all":
        after, before = F.get("_blocks", F.col("i") + 1), F.when(F.col("i") > 0, F.get("_blocks", F.greatest(F.col("i") - 1, F.lit(0))))
        up = F.coalesce(F.col("_b.s") - before["e"] + 1, F.lit(0))
        down = F.coalesce(after["s"] - F.col("_b.e") + 1, F.lit(0))
        one = one.where((up >= intron_length) & (down >= intron_length) if introns_are == "long" else (up <= intron_length) & (down <= intron_length))
    if whole_codons and part == "coding":
        one = one.where("_frame is not null").withColumn("_f", F.get("_frame", F.col("i"))).where("_f is not null")
        one = one.withColumn("s", F.col("s") + F.col("_f.head")).withColumn("e", F.col("e") - F.col("_f.tail"))
    one = one.withColumn("s", F.greatest("s", "_lo")).withColumn("e", F.least("e", "_hi"))
    if not (whole_codons and part == "coding"):
        one = one.withColumn("s", F.col("s") - F.when(_PLUS(), left).otherwise(right)).withColumn("e", F.col("e") + F.when(_PLUS(), right).otherwise(left))
    return _output(one.where("e > s" if keep_1nt else "e > s + 1"), numbered)


def _with_frames(ready: DataFrame) -> DataFrame:
    """Bases to cut from each coding exon's ends so that whole codons stay.

    ``_frame`` is null where the coding length is no multiple of three or the frame reaches
    the transcript's end; an exon without coding bases has a null entry.
    """
    ts, te = F.col("thickStart"), F.col("thickEnd")
    coding = F.transform("_blocks", lambda b: F.greatest(F.least(b["e"], te) - F.greatest(b["s"], ts), F.lit(0)))
    ready = ready.withColumn("_coding", coding)
    total = F.aggregate("_coding", F.lit(0).cast("long"), lambda n, c: n + c)
    before = lambda i: F.aggregate(F.slice("_coding", F.lit(1), i), F.lit(0).cast("long"), lambda n, c: n + c)

    def cut(b: Column, i: Column) -> Column:
        done, own = before(i), F.get("_coding", i)
        return F.when(
            own > 0,
            F.struct(
                (F.greatest(ts - b["s"], F.lit(0)) + F.pmod(F.lit(3) - done % 3, F.lit(3))).alias("head"),
                (F.greatest(b["e"] - te, F.lit(0)) + (done + own) % 3).alias("tail"),
            ),
        )

    whole = (total % 3 == 0) & (total > 0) & (ts > F.col("chromStart")) & (te < F.col("chromEnd"))
    return ready.withColumn("_frame", F.when(whole, F.transform("_blocks", cut)))


def introns(genes: DataFrame, part: str = "", left: int = 0, right: int = 0, lengths_are: str = "all", length: int = 240, numbered: bool = True, keep_noncoding: bool = False) -> DataFrame:
    """The introns of every transcript that lie in its ``part``, numbered 5' to 3'."""
    ready = _ready(genes, part, keep_noncoding).where("_n > 1")
    gaps = F.zip_with(F.slice("_blocks", F.lit(1), F.col("_n") - 1), F.slice("_blocks", F.lit(2), F.col("_n") - 1), lambda a, b: F.struct(a["e"].alias("s"), b["s"].alias("e")))
    one = ready.select("*", F.posexplode(gaps).alias("i", "_b")).withColumn("j", F.when(_PLUS(), F.col("i")).otherwise(F.col("_n") - 2 - F.col("i")))
    size = F.col("_b.e") - F.col("_b.s")
    one = one.where((F.col("_b.s") >= F.col("_lo")) & (F.col("_b.e") <= F.col("_hi")))
    if lengths_are != "all":
        one = one.where(size >= length if lengths_are == "long" else size <= length)
    one = one.withColumn("s", F.col("_b.s") - F.when(_PLUS(), left).otherwise(right)).withColumn("e", F.col("_b.e") + F.when(_PLUS(), right).otherwise(left))
    return _output(one.where("e > s"), numbered)


def union_transcripts(transcripts: DataFrame, genes: DataFrame, transcript: str = "transcript", gene: str = "gene") -> tuple[DataFrame, DataFrame]:
    """The union of the exon blocks of each gene's transcripts, as one spliced interval.

    ``genes`` maps transcript names to genes.  Returns the unions and, apart from them, the
    transcripts of genes that lie on more than one chromosome or strand.
    """
    of = genes.select(F.col(transcript).alias("_t"), F.col(gene).alias("gene"))
    named = transcripts.join(of, transcripts["name"] == of["_t"]).drop("_t")
    place = F.struct("chrom", "strand")
    spread = named.groupBy("gene").agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"))
    marked = named.join(spread, "gene").withColumn("_one", F.col("_lo") == F.col("_hi")).drop("_lo", "_hi")
    good, bad = marked.where("_one").drop("_one"), marked.where("not _one").drop("_one")
    parts = good.select("gene", "chrom", "strand", F.explode(blocks(good)).alias("_b")).select("gene", "chrom", "strand", F.col("_b.s").alias("chromStart"), F.col("_b.e").alias("chromEnd"))
    joined = islands(parts, ["gene", "chrom", "strand"]).groupBy("gene", "chrom", "strand", "island").agg(F.min("chromStart").alias("s"), F.max("chromEnd").alias("e"))
    sorted_ = F.sort_array(F.collect_list(F.struct("s", "e")))  # the exons of one gene
    whole = joined.groupBy("gene", "chrom", "strand").agg(sorted_.alias("_b"))
    start = F.element_at("_b", 1)["s"]
    union = whole.select(
        "chrom", start.alias("chromStart"), F.element_at("_b", -1)["e"].alias("chromEnd"), F.col("gene").alias("name"), F.lit(0.0).alias("score"), "strand",
        start.alias("thickStart"), F.element_at("_b", -1)["e"].alias("thickEnd"), F.lit("0").alias("itemRgb"), F.size("_b").alias("blockCount"),
        F.transform("_b", lambda b: b["e"] - b["s"]).alias("blockSizes"), F.transform("_b", lambda b: b["s"] - start).alias("blockStarts"),
    )
    return union, bad


def gene_sizes(exon_counts: DataFrame, gene: str = "gene") -> DataFrame:
    """Size and tags of each gene, summed over its exons (columns chromStart, chromEnd, n)."""
    return exon_counts.groupBy(gene).agg(F.sum(F.col("chromEnd") - F.col("chromStart")).alias("size"), F.sum("n").alias("n"))


def first_gene(pairs: DataFrame, key: list[str], gene: str) -> DataFrame:
    """One gene for each tag: the smallest name, where the choice is arbitrary."""
    return pairs.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(gene))).where("_nth = 1").drop("_nth")
