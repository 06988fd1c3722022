"""URL rules by a broadcast trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most characters of all rules together that are sent to every executor.
MOST_RULE_CHARS = 64_000_000

_UPPER_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for end in "?#":
        rest = rest.partition(end)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER_TO_LOWER), slash + path


class RuleTrie:
    """Rules ``(verdict, host, path)`` as a trie.

    The first levels are host labels from the right, so a rule fits its host and all
    subdomains.  A host's node has a trie of path segments: whole segments are edges,
    and the unfinished segment at a rule's end is looked up by its prefixes, of which only
    those as long as some rule's end are tried.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        chars = 0
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            chars += len(host) + len(path)
            if chars > MOST_RULE_CHARS:
                raise ValueError("the rules are too large to send to every executor")
            node = self.root
            for label in reversed(host.translate(_UPPER_TO_LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})  # no label holds a slash
            *segments, last = path.split("/")
            for segment in segments:
                node = node.setdefault(("segment", segment), {})
            ends, sizes = node.setdefault("ends", ({}, []))
            if len(last) not in sizes:
                sizes.append(len(last))
                sizes.sort(reverse=True)
            # A rule given twice with both verdicts blocks.
            if ends.get(last, ("allow",))[0] == "allow":
                ends[last] = (verdict, host.translate(_UPPER_TO_LOWER) + path)

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and text of the longest rule that fits; of equally long ones the
        more specific host decides."""
        best = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            if (node := node.get(label)) is None:
                break
            if (below := node.get("/")) is not None:
                found = self._longest(below, segments)
                if found and (best is None or len(found[1]) >= len(best[1])):
                    best = found
        return best

    @staticmethod
    def _longest(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if at_end := node.get("ends"):
                ends, sizes = at_end
                for n in sizes:
                    if n <= len(segment) and (found := ends.get(segment[:n])):
                        best = found
                        break
            if (node := node.get(("segment", segment))) is None:
                break
        return best


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow", url_col: str = "url") -> DataFrame:
    """Judge every page's url by allow and block rules.

    The trie is built once, checked for size and broadcast; rows stay where they are.

    Returns ``page`` (struct of the input's columns), ``host``, ``path``, ``rule``
    (null if none fits) and ``verdict`` (``default`` if none fits).

    Edge cases: a null url, or one without ``://``, has empty host and path and fits
    only rules without a host; the cost of a very long url is linear in its length and,
    at each segment in the trie, in the lengths of the rules that end there; repeated rows are judged alike; an empty table gives an empty result.
    """
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in urls:
            rows = []
            for url in batch:
                host, path = split_url(url)
                verdict, rule = trie.value.judge(host, path) or (default, None)
                rows.append((host, path, rule, verdict))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    page = F.struct(*[pages[c] for c in pages.columns]).alias("page")
    return pages.select(page, judged(pages[url_col]).alias("judged")).select("page", "judged.*")
