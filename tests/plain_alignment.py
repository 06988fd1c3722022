"""One alignment line to a spliced interval and its mutations, in plain loops, to test the columns against."""

from __future__ import annotations

import re

_OP = re.compile(r"(\d+)([MIDNSHP=X])")
_OTHER = re.compile(r"[=XP]|M\d+M")
_MD = re.compile(r"(\d+)|\^([A-Za-z]+)|([A-Za-z])")


def parse_md(md: str, anchor: int, indel_anchor: int) -> tuple[list[dict], dict[int, dict]]:
    """Substitutions in order and deletions by read position, from an MD string.

    Each is good if runs of matches long enough stand somewhere on both of its sides:
    ``anchor`` for substitutions, ``indel_anchor`` for deletions.
    """
    tokens = [m.groups() for m in _MD.finditer(md)]
    runs = [int(run) if run else 0 for run, _, _ in tokens]
    left, right, best = [], [0] * len(runs), 0
    for run in runs:
        left.append(best := max(best, run))
    best = 0
    for i in range(len(runs) - 1, -1, -1):
        right[i] = best = max(best, runs[i])
    subs, dels, at = [], {}, 0
    for i, (run, deleted, base) in enumerate(tokens):
        if run:
            at += int(run)
        elif deleted:
            dels[at] = {"ref": deleted, "good": min(left[i], right[i]) >= indel_anchor}
        else:
            subs.append({"pos": at, "ref": base, "good": min(left[i], right[i]) >= anchor})
            at += 1
    return subs, dels


def plain_cigar(cigar: str) -> str:
    """The operations with ``=`` and ``X`` as M, without padding, neighbouring matches as one."""
    ops: list[list] = []
    for n, op in _OP.findall(cigar):
        op = "M" if op in "=X" else op
        if op == "M" and ops and ops[-1][1] == "M":
            ops[-1][0] += int(n)
        elif op != "P":
            ops.append([int(n), op])
    return "".join(f"{n}{op}" for n, op in ops)


def _bases(text: str) -> bool:
    return re.fullmatch("[ACGTacgt]*", text) is not None


def parse_alignment(flag: int, pos: int, cigar: str, seq: str, tags: str, anchor: int = 1, indel_anchor: int = 5, indel_in_score: bool = False) -> dict | None:
    """The interval and mutations of an alignment, or None without one.

    ``=`` and ``X`` are matches and padding is left out.  Clipped ends are cut off; a clip at the read's 5' end clears ``matchStart``.  A
    deletion lengthens the block before it (leading ones move the start), an insertion
    sits between two bases, and a skipped stretch opens a new block.  The score counts
    mismatches, without inserted and deleted bases unless ``indel_in_score``.
    """
    if cigar == "*" or flag & 4:
        return None
    strand = "-" if flag & 16 else "+"
    ops = [(int(n), op) for n, op in _OP.findall(plain_cigar(cigar) if _OTHER.search(cigar) else cigar)]
    match_start = 1
    for end, side in ((0, "+"), (-1, "-")):
        while ops and ops[end][1] in "HS":
            n, op = ops.pop(end)
            if op == "S":
                seq = seq[n:] if end == 0 else seq[: len(seq) - n]
            if strand == side:
                match_start = 0
    if not ops or any(op not in "MIDN" for _, op in ops):
        raise ValueError(f"unexpected CIGAR {cigar!r}")
    nm = re.search(r"NM:[^:\s]*:(\d+)", tags or "")
    md = re.search(r"MD:Z:(\S+)", tags or "")
    subs, dels = parse_md(md.group(1), anchor, indel_anchor) if md else ([], {})
    start, at_ref, at_read, inserted, indels, next_sub, joined = pos - 1, 0, 0, 0, 0, 0, False
    sizes: list[int] = []
    starts: list[int] = []
    mutations: list[dict] = []

    def mutation(kind: str, where: int, size: int, offset: int, ref: str, alt: str, good: bool) -> None:
        mutations.append(dict(chromStart=where, chromEnd=where + size, offset=offset, refBase=ref, mtype=kind, altBase=alt, good=good))

    for n, op in ops:
        if op == "I":
            alt = seq[at_read : at_read + n]
            if _bases(alt):
                good = at_read >= indel_anchor and at_read + n - 1 <= len(seq) - 1 - indel_anchor
                mutation("+", start + at_ref, 1, at_read, ".", alt, good)
            inserted += n  # the read position stays, as in MD
            indels += n
            joined = True
        elif op == "D":
            gone = dels.get(at_read)
            if gone and _bases(gone["ref"]):
                mutation("-", start + at_ref, n, at_read, gone["ref"], ".", gone["good"])
            if sizes:
                sizes[-1] += n
                at_ref += n
            else:
                start += n
            indels += n
            joined = True
        elif op == "M":
            while next_sub < len(subs) and subs[next_sub]["pos"] < at_read + n:
                s = subs[next_sub]
                alt = seq[s["pos"] + inserted : s["pos"] + inserted + 1]
                if _bases(s["ref"]) and _bases(alt):
                    mutation(">", start + at_ref + s["pos"] - at_read, 1, s["pos"], s["ref"], alt, s["good"])
                next_sub += 1
            if joined and sizes:
                sizes[-1] += n
            else:
                sizes.append(n)
                starts.append(at_ref)
            joined = False
            at_ref += n
            at_read += n
        else:
            at_ref += n
    if not sizes:
        return None
    score = int(nm.group(1)) if nm else 0
    if not indel_in_score:
        score -= indels
    if score < 0 and nm:
        raise ValueError(f"NM below the indels of {cigar!r}")
    end = start + starts[-1] + sizes[-1]
    return dict(chromStart=start, chromEnd=end, score=float(max(score, 0)), strand=strand, matchStart=match_start, blockSizes=sizes, blockStarts=starts, mutations=mutations)
