"""CIGAR and MD strings as columns, merged by read position, and the details of novoalign lines.

Everything here but the novoalign helper is built-in functions: operations and MD tokens
become arrays with running positions, each made once, and mutations are looked up between
them.  Work grows with operations times mutations of a read, which are few in short reads.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LONG = "bigint"
_MUTATION = "struct<chromStart:bigint,chromEnd:bigint,offset:bigint,refBase:string,mtype:string,altBase:string,good:boolean>"
_OPS = "array<struct<op:string,n:bigint,read:bigint,ref:bigint,inserted:bigint>>"
_TOKENS = "array<struct<pos:bigint,text:string>>"


def core(cigar: Column) -> Column:
    """The operations between the clips, ``=`` and ``X`` as M, without padding."""
    unclipped = F.regexp_replace(cigar, r"^(\d+[HS])+|(\d+[HS])+$", "")
    return F.translate(F.regexp_replace(unclipped, r"\d+P", ""), "=X", "MM")


def clip(cigar: Column, leading: bool) -> Column:
    """Bases of the read that are cut off at one of its ends."""
    ends = F.regexp_extract(cigar, r"^((?:\d+[HS])+)" if leading else r"((?:\d+[HS])+)$", 1)
    return F.when(ends == "", F.lit(0).cast(_LONG)).otherwise(bases_in(ends, "S"))


def bases_in(text: Column, ops: str) -> Column:
    """Sum of the lengths of some operations."""
    found = F.regexp_extract_all(text, F.lit(rf"(\d+)[{ops}]"), 1)
    return F.aggregate(found, F.lit(0).cast(_LONG), lambda total, n: total + n.cast(_LONG))


def shift(text: Column) -> Column:
    """Deleted bases before the first match, by which the start moves."""
    head = F.regexp_extract(text, r"^([^M]*?)\d+M", 1)
    return F.when(text.rlike(r"^\d+M"), F.lit(0).cast(_LONG)).otherwise(bases_in(head, "D"))


def span(text: Column) -> Column:
    """Bases of the reference up to the end of the last block.  A stretch counts as skipped if a
    block opens after it, which an insertion or deletion beside it prevents."""
    upto = F.regexp_extract(text, r"^(.*M(?:\d+N)+\d+M|[^M]*M)", 1)
    simple = F.regexp_extract(text, r"^(\d+)M$", 1)
    return F.when(simple != "", F.try_to_number(simple, F.lit("9999999999")).cast(_LONG)).otherwise(bases_in(text, "MD") + bases_in(upto, "N"))


def operations(text: Column) -> Column:
    """Every operation with the read's and the reference's position before it and the bases
    inserted until then; the read's position leaves insertions out, as MD does."""
    steps = F.arrays_zip(F.regexp_extract_all(text, F.lit(r"(\d+)[MIDN]"), 1).alias("n"), F.regexp_extract_all(text, F.lit(r"\d+([MIDN])"), 1).alias("op"))
    zero = F.lit(0).cast(_LONG)
    begin = F.struct(zero.alias("read"), zero.alias("ref"), zero.alias("inserted"), F.array().cast(_OPS).alias("out"))

    def fold(a: Column, step: Column) -> Column:
        n, op = step["n"].cast(_LONG), step["op"]
        one = F.struct(op.alias("op"), n.alias("n"), a["read"].alias("read"), a["ref"].alias("ref"), a["inserted"].alias("inserted"))
        return F.struct(
            F.when(op == "M", a["read"] + n).otherwise(a["read"]).alias("read"), F.when(op == "I", a["ref"]).otherwise(a["ref"] + n).alias("ref"),
            F.when(op == "I", a["inserted"] + n).otherwise(a["inserted"]).alias("inserted"), F.array_append(a["out"], one).alias("out"),
        )

    return F.aggregate(steps, begin, fold, lambda a: a["out"])


def tokens(md: Column) -> Column:
    """Runs, deleted bases (with ``^``) and replaced bases of an MD string with the read's position."""
    begin = F.struct(F.lit(0).cast(_LONG).alias("pos"), F.array().cast(_TOKENS).alias("out"))

    def fold(a: Column, text: Column) -> Column:
        ahead = F.when(text.rlike(r"^\d"), text.try_cast(_LONG)).when(text.startswith("^"), F.lit(0).cast(_LONG)).otherwise(F.lit(1).cast(_LONG))
        return F.struct((a["pos"] + ahead).alias("pos"), F.array_append(a["out"], F.struct(a["pos"].alias("pos"), text.alias("text"))).alias("out"))

    return F.aggregate(F.regexp_extract_all(md, F.lit(r"\d+|\^[A-Za-z]+|[A-Za-z]"), 0), begin, fold, lambda a: a["out"])


def between_runs(found: Column, least: int) -> Column:
    """The first and last token, from 1, that is a run of at least ``least`` matches; none: 0 and 0."""
    long = F.transform(found, lambda t: F.coalesce(t["text"].try_cast(_LONG), F.lit(0)) >= least)
    last = F.array_position(F.reverse(long), F.lit(True))
    return F.struct(F.array_position(long, F.lit(True)).alias("first"), F.when(last == 0, F.lit(0)).otherwise(F.size(found) + 1 - last).cast(_LONG).alias("last"))


def named_tokens(found: Column, pattern: str) -> Column:
    """The tokens of one kind with their number among all, from 1, as ``at``."""
    placed = F.transform(found, lambda t, i: F.struct(t["pos"].alias("pos"), t["text"].alias("text"), (i + 1).alias("at")))
    return F.filter(placed, lambda t: t["text"].rlike(pattern))


def mutations(ops: Column, subs: Column, gone: Column, runs: Column, indel_runs: Column, seq: Column, start: Column, anchor: int, indel_anchor: int) -> Column:
    """All mutations in the order of operations.

    A substitution lies in the match that covers its position, a deletion is named by the
    MD token at its position, an insertion by the read.  Each is good if runs of matches
    long enough stand somewhere on both of its sides, or, an insertion, far enough from
    the read's ends.  Bases other than A, C, G, T make none.  ``subs`` and ``gone`` are the
    MD's replaced and deleted bases by :func:`named_tokens`.
    """
    plain = r"^[ACGTacgt]*$"
    none = F.array().cast(f"array<{_MUTATION}>")

    def within(at: Column, anchors: Column, least: int) -> Column:
        return F.lit(True) if least <= 0 else (anchors["first"] > 0) & (anchors["first"] < at) & (at < anchors["last"])

    def of(where: Column, size: Column, offset: Column, ref: Column, kind: str, alt: Column, good: Column) -> Column:
        return F.struct(
            where.alias("chromStart"), (where + size).alias("chromEnd"), offset.alias("offset"), ref.alias("refBase"), F.lit(kind).alias("mtype"), alt.alias("altBase"), good.alias("good"),
        ).cast(_MUTATION)

    def bases(at: Column, n: Column) -> Column:
        return F.substring(seq, (at + 1).cast("int"), n.cast("int"))

    def one(op: Column) -> Column:
        where, one_base = start + op["ref"], F.lit(1)
        inside = F.filter(subs, lambda s: (s["pos"] >= op["read"]) & (s["pos"] < op["read"] + op["n"]))
        replaced = F.transform(inside, lambda s: of(where + s["pos"] - op["read"], one_base, s["pos"], s["text"], ">", bases(s["pos"] + op["inserted"], one_base), within(s["at"], runs, anchor)))
        here = F.filter(gone, lambda d: d["pos"] == op["read"])
        deleted = F.transform(F.slice(here, F.greatest(F.size(here), F.lit(1)), 1), lambda d: of(where, op["n"], op["read"], F.substring(d["text"], 2, 1 << 30), "-", F.lit("."), within(d["at"], indel_runs, indel_anchor)))
        far = (op["read"] >= indel_anchor) & (op["read"] + op["n"] - 1 <= F.length(seq) - 1 - indel_anchor)
        added = F.array(of(where, one_base, op["read"], F.lit("."), "+", bases(op["read"], op["n"]), far))
        # Their sizes are asked as well, so that Spark does not move the arrays' making into this step of each operation.
        some_subs, some_gone = F.size(subs) > 0, F.size(gone) > 0
        return F.when((op["op"] == "M") & some_subs, replaced).when((op["op"] == "D") & some_gone, deleted).when(op["op"] == "I", added).otherwise(none)

    every = F.flatten(F.transform(ops, one))
    return F.filter(every, lambda m: ((m["mtype"] == "+") | m["refBase"].rlike(plain)) & ((m["mtype"] == "-") | m["altBase"].rlike(plain)))


def few_mutations(kind: Column, n: list[Column], md: list[Column], seq: Column, start: Column, anchor: int, indel_anchor: int) -> Column:
    """:func:`mutations` of a read with one operation between two matches at most (``kind`` and the
    lengths ``n``), whose MD is at most a run, a base or deleted bases, and a run (``md``)."""
    plain = r"^[ACGTacgt]*$"
    before, named, after = md[0].try_cast(_LONG), md[1], md[2].try_cast(_LONG)
    first, size, last = n

    def of(where: Column, width: Column, offset: Column, ref: Column, mtype: str, alt: Column, good: Column) -> Column:
        return F.struct(where.alias("chromStart"), (where + width).alias("chromEnd"), offset.alias("offset"), ref.alias("refBase"), F.lit(mtype).alias("mtype"), alt.alias("altBase"), good.alias("good")).cast(_MUTATION)

    def bases(at: Column, width: Column) -> Column:
        return F.substring(seq, (at + 1).cast("int"), width.cast("int"))

    def runs(least: int) -> Column:
        return F.lit(True) if least <= 0 else (before >= least) & (after >= least)

    zero, one, later = F.lit(0).cast(_LONG), F.lit(1), before >= first
    shown = bases(before + F.when(later & (kind == "MIM"), size).otherwise(zero), one)
    moved = F.when(later & kind.isin("MDM", "MNM"), size).otherwise(zero)
    is_sub = F.length(named) == 1
    replaced = F.when(is_sub & (before < first + last) & named.rlike(plain) & shown.rlike(plain), of(start + before + moved, one, before, named, ">", shown, runs(anchor)))
    gone = F.substring(named, 2, 1 << 30)
    deleted = F.when((kind == "MDM") & named.startswith("^") & (before == first) & gone.rlike(plain), of(start + first, size, first, gone, "-", F.lit("."), runs(indel_anchor)))
    far = (first >= indel_anchor) & (first + size - 1 <= F.length(seq) - 1 - indel_anchor)
    extra = bases(first, size)
    added = F.when((kind == "MIM") & extra.rlike(plain), of(start + first, one, first, F.lit("."), "+", extra, far))
    sorted_ = F.when(later, F.array(added, replaced)).otherwise(F.array(replaced, F.coalesce(added, deleted)))
    return F.array_compact(F.when(kind == "MDM", F.array(F.coalesce(replaced, deleted))).when(kind == "MIM", sorted_).otherwise(F.array(replaced)))


def parse_novoalign_details(details: str | None, start: int, read_length: int, indel_in_score: bool = False, draw=None) -> tuple[int, int, list[dict]]:
    """Aligned length, mismatches and mutations of a novoalign line.

    ``8A>G`` is a substitution, ``8-A`` a deletion, ``8+AC`` an insertion before the base.
    Mutations at the first or last base are left out.  ``draw`` places them at random.
    """
    length, mismatches, found = read_length, 0, []
    for item in (details or "").split():
        m = re.fullmatch(r"(\d+)(?:(\S)>(\S)|-(\S)|\+(\S+))", item)
        if not m:
            raise ValueError(f"unknown detail {item!r}")
        number, ref, alt, gone, added = m.groups()
        if gone:
            length += 1
        at = draw(length) if draw else int(number) - 1
        if added:
            length -= len(added)
        if 0 < at < length - 1:
            mismatches += 1 if ref or indel_in_score else 0
            kind = ">" if ref else "-" if gone else "+"
            found.append(dict(chromStart=start + at, chromEnd=start + at + 1, offset=at, refBase=ref or gone or ".", mtype=kind, altBase=alt or added or ".", good=True))
    return length, mismatches, found
