"""Token counts and ids by two tiers of pre-token tables inside the tasks."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Largest vocabulary file that is sent to every executor.
MOST_VOCABULARY_BYTES = 64 << 20
#: Entries of the broadcast table, and documents whose pre-tokens choose them.  Both
#: change the speed only: a pre-token that the table lacks is encoded by the worker.
FREQUENT = 50_000
PILOT_DOCS = 2_000
#: Pre-tokens that a worker keeps; beyond it the worker starts again from the table.  Longer
#: ones than ``CACHE_LENGTH`` characters, which seldom come again, are not kept.
CACHE_ENTRIES, CACHE_LENGTH = 100_000, 64

# Letters of the scripts that most texts keep to; their pattern is the fastest.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHER = re.compile(f"[^\\x00-\\x1b\\x20-\\x7f{_LETTERS}]")


def _pattern(letters: str, digits: str) -> re.Pattern:
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^\s{letters}{digits}]+|\s+(?!\S)|\s+")


_LATIN = _pattern(_LETTERS, "0-9")


@cache
def _unicode_pattern(top: int) -> re.Pattern:
    """The vocabulary's own pattern, in which letters and digits are Unicode classes, for
    code points up to ``top``; the classes are made from the interpreter's tables."""
    spans: dict[str, list[list[int]]] = {"L": [], "N": []}
    for point in range(top + 1):
        if (own := spans.get(unicodedata.category(chr(point))[0])) is not None:
            if own and own[-1][1] == point - 1:
                own[-1][1] = point
            else:
                own.append([point, point])
    return _pattern(*("".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in own) for own in spans.values()))


@cache
def _settled(char: str) -> bool:
    """Whether every library agrees on the class of a character: it is assigned, and none of
    the four separators that only Python counts as white space."""
    return unicodedata.category(char) not in ("Cn", "Cs") and not "\x1c" <= char <= "\x1f"


def split_text(text: str) -> list[str] | None:
    """The pre-tokens of a text in any script, or None where a character is not settled."""
    if not _OTHER.search(text):
        return _LATIN.findall(text)
    chars = set(text)
    if not all(map(_settled, chars)):
        return None
    return _unicode_pattern(0xFFFF if max(chars) <= "\uffff" else sys.maxunicode).findall(text)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible bytes stand for
    themselves, the others for the code points from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """One vocabulary inside one process.

    Texts are cut into pre-tokens here and each pre-token is encoded once.  Texts that hold
    an added token, or a character that is in no Unicode class yet, go to the library whole.
    """

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary
        spec = json.loads(vocabulary)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.piecewise = self._plain_byte_level(spec)
        if self.piecewise:
            special = set(self.added)
            alphabet = _byte_alphabet()
            ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
            self.merge = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def library(self) -> Tokenizer:
        """The library's encoder, which many workers never need."""
        made = Tokenizer.from_str(self.vocabulary)
        made.no_padding()
        made.no_truncation()
        return made

    @staticmethod
    def _plain_byte_level(spec: dict) -> bool:
        """Whether ids are the order of merges, and pre-tokens those of the pattern above."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        usual = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not usual or spec.get("normalizer") or any(model.get(k) for k in ("dropout", "ignore_merges", "end_of_word_suffix", "continuing_subword_prefix")):
            return False
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        made = [model["vocab"].get(a + b) for a, b in pairs]
        return made == list(range(256, 256 + len(made)))

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens, or None where the library must decide."""
        if not self.piecewise or any(t in text for t in self.added):
            return None
        return split_text(text)

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


class _Cache(dict):
    """Answers for pre-tokens: the broadcast ones, then what this worker has met."""

    def __init__(self, make: Callable[[str], object], table: dict):
        super().__init__(table)
        self.make, self.table = make, table

    def __missing__(self, piece: str):
        if len(piece) > CACHE_LENGTH:
            return self.make(piece)
        if len(self) >= CACHE_ENTRIES + len(self.table):
            self.clear()
            self.update(self.table)
        self[piece] = value = self.make(piece)
        return value


_kept: dict[str, object] = {}


def in_worker(key: str, make: Callable[[], object]):
    """What a Python worker keeps from task to task."""
    if key not in _kept:
        _kept.clear()  # one vocabulary at a time
        _kept[key] = make()
    return _kept[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        text = file.read(MOST_VOCABULARY_BYTES + 1)
    if len(text) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to send to every executor")
    return text


def frequent_pieces(docs: DataFrame, vocabulary, text_col: str, top: int = FREQUENT, pilot: int = PILOT_DOCS) -> list[str]:
    """Frequent pre-tokens of a pilot of about ``pilot`` documents, whatever their identifiers."""
    share = min(1.0, pilot / max(1, docs.count()))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for batch in batches:
            found = Counter()
            for text in batch["text"].dropna():
                found.update(encoder.pieces(text) or ())
            yield pd.DataFrame({"piece": list(found.keys()), "n": list(found.values())})

    chosen = docs.where(F.rand(17) < share).select(docs[text_col].alias("text"))
    counted = chosen.mapInPandas(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in counted.orderBy(F.desc("n"), "piece").limit(top).collect()]


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count every document's tokens where the document lies.

    Method: a compact table of frequent pre-tokens and their token counts is broadcast
    (``FREQUENT`` entries at most); a pre-token that it lacks is encoded by the worker,
    which keeps a bounded cache.  No pre-token of the corpus is shuffled; the table is
    chosen on a pilot and changes the speed alone.

    Returns identifier, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``, with the
    counts that the library gives: no added begin or end, no truncation, no padding,
    added tokens inside a text read as the library reads them.

    Edge cases: a null text counts as empty, which has no tokens; identifiers may be
    null or repeat; an empty table gives an empty result.
    """
    context = docs.sparkSession.sparkContext
    vocabulary = read_vocabulary(vocabulary_path)
    encoder = Encoder(vocabulary)
    table = {p: len(encoder.merge(p)) for p in frequent_pieces(docs, vocabulary, text_col)} if encoder.piecewise else {}
    shared, name = context.broadcast((vocabulary, table)), uuid.uuid4().hex

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def make():
            own = Encoder(shared.value[0])
            return own, _Cache(lambda p: len(own.merge(p)), shared.value[1])

        own, lengths = in_worker(name, make)
        for batch in texts:
            counts = np.zeros(len(batch), np.int64)
            for i, text in enumerate(batch):
                if text:
                    pieces = own.pieces(text)
                    counts[i] = len(own.whole(text)) if pieces is None else sum(map(lengths.__getitem__, pieces))
            yield pd.Series(counts)

    text = F.coalesce(docs[text_col], F.lit(""))
    counted = docs.select(docs[id_col], F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
