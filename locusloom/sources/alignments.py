"""SAM and novoalign lines to tags and mutations."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment as A

_SAM = ["QNAME", "FLAG", "RNAME", "POS", "MAPQ", "CIGAR", "RNEXT", "PNEXT", "TLEN", "SEQ", "QUAL"]
_MUTATIONS = "array<struct<chromStart:bigint,chromEnd:bigint,offset:bigint,refBase:string,mtype:string,altBase:string,good:boolean>>"


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven fixed columns and all tags in one, header lines left out."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$|^@[A-Z][A-Z]\t"))
    return sam_columns(lines)


def sam_columns(lines: DataFrame) -> DataFrame:
    # Exploded from an array of one: filters on a cell would else move below the split and make the line anew for each.
    cells = F.col("_cells")
    numbers = {"FLAG": "int", "POS": "long", "MAPQ": "int"}
    fixed = [F.get(cells, F.lit(i)).cast(numbers.get(n, "string")).alias(n) for i, n in enumerate(_SAM)]
    one = lines.select(F.explode_outer(F.array(F.split("value", "\t"))).alias("_cells"))
    return one.select(*fixed, F.array_join(F.slice(cells, 12, F.greatest(F.size(cells), F.lit(1))), "\t").alias("TAGS"))


def _mapped(sam: DataFrame, least_quality: int, least_length: int) -> DataFrame:
    """Mapped reads that are long and sure enough."""
    return sam.where((F.col("CIGAR") != "*") & (F.col("FLAG").bitwiseAND(4) == 0) & (F.length("SEQ") >= least_length) & (F.col("MAPQ") >= least_quality))


def _blocks(text: Column) -> Column:
    """``sizes`` and ``starts`` of the blocks of a CIGAR without clips: matches add to a block or
    open one after a skipped stretch, a deletion lengthens the block before it, an insertion
    joins the matches at its sides."""
    steps = F.zip_with(
        F.regexp_extract_all(text, F.lit(r"(\d+)[MIDN]"), 1), F.regexp_extract_all(text, F.lit(r"\d+([MIDN])"), 1),
        lambda n, op: F.struct(n.cast("long").alias("n"), op.alias("op")),
    )
    empty, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")
    begin = F.struct(zero.alias("at"), F.lit("").alias("last"), F.lit(False).alias("joined"), empty.alias("sizes"), empty.alias("starts"))

    def fold(a: Column, step: Column) -> Column:
        n, op, some = step["n"], step["op"], F.size(a["sizes"]) > 0
        longer = F.concat(F.slice(a["sizes"], F.lit(1), F.size(a["sizes"]) - 1), F.array(F.element_at(a["sizes"], -1) + n))
        extends = some & ((op == "D") | ((op == "M") & (a["joined"] | (a["last"] == "M"))))
        opens = (op == "M") & ~extends
        return F.struct(
            F.when(op.isin("M", "N") | ((op == "D") & some), a["at"] + n).otherwise(a["at"]).alias("at"),
            op.alias("last"),
            F.when(op == "M", F.lit(False)).when(op.isin("I", "D"), F.lit(True)).otherwise(a["joined"]).alias("joined"),
            F.when(extends, longer).when(opens, F.concat(a["sizes"], F.array(n))).otherwise(a["sizes"]).alias("sizes"),
            F.when(opens, F.concat(a["starts"], F.array(a["at"]))).otherwise(a["starts"]).alias("starts"),
        )

    folded = F.aggregate(steps, begin, fold, lambda a: F.struct(a["sizes"].alias("sizes"), a["starts"].alias("starts")))
    n, kind = _lengths(), F.col("_kind")
    one = F.struct(F.array(F.when(kind == "MDM", n[0] + n[1] + n[2]).otherwise(n[0] + n[2])).alias("sizes"), F.array(zero).alias("starts"))
    two = F.struct(F.array(n[0], n[2]).alias("sizes"), F.array(zero, n[0] + n[1]).alias("starts"))
    return F.when(kind.isNull(), folded).when(kind == "MNM", two).otherwise(one)


def _lengths() -> list[Column]:
    """The three lengths of a CIGAR that has a ``_kind``; 0 for those that are not there."""
    return [F.coalesce(F.get("_n", F.lit(i)).try_cast("bigint"), F.lit(0).cast("bigint")) for i in range(3)]


def _aligned(sam: DataFrame, least_quality: int, least_length: int, indel_in_score: bool) -> DataFrame:
    """Mapped reads with a match, their ends, score and side; ``_core`` is the CIGAR between clips.

    The ends are sums over operations of one kind, so a read needs no walk along its CIGAR
    unless its blocks or mutations are wanted, and the filter looks at the text alone.
    ``_kind`` names the operations of a CIGAR of one match, or of two with one operation between
    them, and ``_n`` has its lengths: such reads need no lambda, which Spark interprets.
    """
    kept = _mapped(sam, least_quality, least_length).where(F.col("CIGAR").rlike("[M=X]"))
    kept = kept.withColumn("_core", A.core(F.col("CIGAR")))
    text, zero = F.col("_core"), F.lit(0).cast("long")
    kind = F.when(text.rlike(r"^\d+M(\d+[IDN]\d+M)?$"), F.translate(text, "0123456789", ""))
    kept = kept.withColumn("_kind", kind).withColumn("_n", F.split(text, "[MIDN]"))
    n, kind = _lengths(), F.col("_kind")
    nm = F.expr(r"try_cast(regexp_extract(TAGS, 'NM:[^:\\s]*:(\\d+)', 1) as bigint)")
    indels = zero if indel_in_score else F.when(kind.isin("MIM", "MDM"), n[1]).when(kind.isNull() & text.rlike("[ID]"), A.bases_in(text, "ID")).otherwise(zero)
    start = F.col("POS") - 1 + F.when(kind.isNull(), A.shift(text)).otherwise(zero)
    span = F.when(kind.isNull(), A.span(text)).otherwise(n[0] + n[2] + F.when(kind == "MIM", zero).otherwise(n[1]))
    out = kept.select(
        F.col("RNAME").alias("chrom"), F.col("QNAME").alias("name"), "FLAG", "POS", "CIGAR", "SEQ", F.coalesce("TAGS", F.lit("")).alias("TAGS"), "_core", "_kind", "_n",
        start.alias("chromStart"), (F.col("POS") - 1 + span).alias("chromEnd"), nm.alias("_nm"), indels.alias("_indels"),
    )
    side = F.when(F.col("FLAG").bitwiseAND(16) != 0, "-").otherwise("+")
    return out.withColumn("score", F.greatest(F.coalesce("_nm", zero) - F.col("_indels"), zero).cast("double")).withColumn("strand", side)


def parse_sam(sam: DataFrame, least_quality: int = 0, least_length: int = 0, anchor: int = 1, indel_anchor: int = 5, indel_in_score: bool = False) -> DataFrame:
    """Tags with their mutations, one row for each kept alignment, by built-in functions alone.

    ``=`` and ``X`` are matches and padding is left out.  Clipped ends are cut off; a clip at
    the read's 5' end clears ``matchStart``.  A deletion lengthens the block before it
    (leading ones move the start), an insertion sits between two bases, and a skipped stretch
    opens a new block.  The score counts mismatches, without inserted and deleted bases unless
    ``indel_in_score``.  A read without MD has no substitutions or deletions.  Unmapped reads
    and those without a match are left out.  An unknown operation, or an NM below the inserted
    and deleted bases, is an error.
    """
    rows = _aligned(sam, least_quality, least_length, indel_in_score)
    unclipped = F.col("_core") == F.col("CIGAR")
    cut, back = (F.when(unclipped, F.lit(0).cast("long")).otherwise(A.clip(F.col("CIGAR"), leading)) for leading in (True, False))
    clipped = F.when(F.col("strand") == "+", F.col("CIGAR").rlike(r"^\d+[HS]")).otherwise(F.col("CIGAR").rlike(r"\d+[HS]$"))
    rows = rows.withColumn("_md", F.regexp_extract("TAGS", r"MD:Z:(\S+)", 1))
    md = F.col("_md")
    # A run, a replaced base or deleted ones, a run: with a CIGAR that has a kind such a read has no arrays either.
    rows = rows.withColumn("_few", F.col("_kind").isNotNull() & md.rlike(r"^(\d*|\d{1,9}([A-Za-z]|\^[A-Za-z]+)\d{1,9})$"))
    few = F.col("_few")
    # Arrays are made once, in a step of their own, and none for a read that matches throughout.
    walked = ~few & ~(md.rlike(r"^\d*$") & ~F.col("_core").rlike("[ID]"))
    unknown, low = F.col("_kind").isNull() & ~F.col("_core").rlike(r"^(\d+[MIDN])+$"), F.col("_nm") < F.col("_indels")
    score = F.when(unknown, F.raise_error(F.concat(F.lit("unexpected CIGAR "), "CIGAR"))).when(low, F.raise_error(F.concat(F.lit("NM below the indels of "), "CIGAR"))).otherwise(F.col("score"))
    rows = rows.select(
        "*", (~clipped).cast("int").alias("matchStart"), _blocks(F.col("_core")).alias("_blocks"), F.when(walked, A.operations(F.col("_core"))).alias("_ops"), F.when(walked, A.tokens(md)).alias("_tokens"),
        F.when(~unclipped & (cut + back > 0), F.substring(F.col("SEQ"), (cut + 1).cast("int"), F.greatest(F.length("SEQ") - cut - back, F.lit(0)).cast("int"))).otherwise(F.col("SEQ")).alias("_seq"), score.alias("_score"),
    )
    made = {"_runs": A.between_runs(F.col("_tokens"), anchor), "_indel_runs": A.between_runs(F.col("_tokens"), indel_anchor), "_subs": A.named_tokens(F.col("_tokens"), "^[A-Za-z]$"), "_gone": A.named_tokens(F.col("_tokens"), r"^\^")}
    made = {c: F.when(F.col("_tokens").isNotNull(), v) for c, v in made.items()}
    made |= {f"_part{i}": F.when(few, F.regexp_extract("_md", r"^(\d+)(\D+)(\d+)$", i + 1)) for i in range(3)}
    found = A.mutations(F.col("_ops"), F.col("_subs"), F.col("_gone"), F.col("_runs"), F.col("_indel_runs"), F.col("_seq"), F.col("POS") - 1, anchor, indel_anchor)
    of_few = A.few_mutations(F.col("_kind"), _lengths(), [F.col(f"_part{i}") for i in range(3)], F.col("_seq"), F.col("POS") - 1, anchor, indel_anchor)
    none = F.array().cast(_MUTATIONS)
    found = F.when(few, of_few).when(F.col("_ops").isNotNull(), F.coalesce(found, none)).otherwise(none)
    return rows.withColumns(made).select("chrom", "name", "chromStart", "chromEnd", F.col("_score").cast("double").alias("score"), "strand", "matchStart", F.col("_blocks.sizes").alias("blockSizes"), F.col("_blocks.starts").alias("blockStarts"), found.alias("mutations"))


def sam_tags(sam: DataFrame, least_quality: int = 0, least_length: int = 0, indel_in_score: bool = False) -> DataFrame:
    """The spliced intervals of SAM rows, without their mutations: ``tags_of(parse_sam(...))``."""
    rows = _aligned(sam, least_quality, least_length, indel_in_score).withColumn("_blocks", _blocks(F.col("_core")))
    return tags_of(rows.select("*", F.col("_blocks.sizes").alias("blockSizes"), F.col("_blocks.starts").alias("blockStarts")))


def tags_of(parsed: DataFrame) -> DataFrame:
    """The spliced intervals of parsed alignments."""
    s, e = F.col("chromStart"), F.col("chromEnd")
    return parsed.select(
        "chrom", "chromStart", "chromEnd", "name", "score", "strand", s.alias("thickStart"), e.alias("thickEnd"), F.lit("0").alias("itemRgb"),
        F.size("blockSizes").alias("blockCount"), "blockSizes", "blockStarts",
    )


def mutations_of(parsed: DataFrame, good_only: bool = True) -> DataFrame:
    """A row for each mutation; only those between good matches unless asked for all."""
    # The outer form: Spark would else test the whole array below the steps that make it, and make it twice.
    one = parsed.select("chrom", "name", "strand", "matchStart", F.explode_outer("mutations").alias("m")).where("m IS NOT NULL")
    if good_only:
        one = one.where("m.good")
    at = F.col("m.offset")
    return one.select("chrom", "m.chromStart", "m.chromEnd", "name", at.alias("offset"), "strand", at.alias("readOffset"), "m.refBase", "m.mtype", "m.altBase", "matchStart")


def read_novoalign(spark: SparkSession, path: str) -> DataFrame:
    """Name, sequence, status, chromosome, start, strand and details of each line."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$|^#"))
    return novoalign_columns(lines)


def novoalign_columns(lines: DataFrame) -> DataFrame:
    cells = F.split("value", "\t")
    at = {"name": 0, "seq": 2, "status": 4, "chrom": 7, "start": 8, "side": 9, "details": 13}
    return lines.select(*[F.get(cells, F.lit(i)).alias(n) for n, i in at.items()])


def parse_novoalign(rows: DataFrame, indel_in_score: bool = False, seed: int | None = None) -> DataFrame:
    """Uniquely mapped reads with their mutations; with ``seed`` their places are drawn."""

    @F.pandas_udf(f"chromStart bigint, chromEnd bigint, score double, mutations {_MUTATIONS}")
    def parse(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for names, starts, lengths, details in batches:
            out = []
            for name, start, length, detail in zip(names, starts, lengths, details, strict=True):
                draw = None if seed is None else random.Random(f"{seed}:{name}").randrange
                size, wrong, found = A.parse_novoalign_details(detail, int(start), int(length), indel_in_score, draw)
                out.append(dict(chromStart=int(start), chromEnd=int(start) + size, score=float(wrong), mutations=found))
            yield pd.DataFrame(out, columns=["chromStart", "chromEnd", "score", "mutations"])

    unique = rows.where(F.trim("status") == "U")
    name, chrom = F.regexp_replace("name", "^[@>]", ""), F.regexp_replace("chrom", "^>", "")
    parsed = unique.select(chrom.alias("chrom"), name.alias("name"), F.when(F.col("side") == "F", "+").otherwise("-").alias("strand"), F.lit(1).alias("matchStart"),
                           parse("name", F.col("start").cast("long") - 1, F.length("seq"), F.coalesce("details", F.lit(""))).alias("r"))
    return parsed.select("chrom", "name", "strand", "matchStart", "r.*")
