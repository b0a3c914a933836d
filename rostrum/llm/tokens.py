"""Problem 6: encoding of a corpus with a public byte-level BPE, by dynamic programming over byte prefixes."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rostrum.plans.session import spread

#: Fixed value: the published pre-tokenizer pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHED = 300_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines ``base64 rank`` of a vocabulary file."""
    return {base64.b64decode(t): int(n) for t, n in (line.split() for line in data.splitlines() if line)}


class PrefixEncoder:
    """BPE in which the encoding of every prefix of a piece is known by its last token.

    For any byte prefix exactly one token can be the last of its encoding: a token that ends there and that may
    follow the (already known) last token of the prefix before it. Two tokens may follow each other if merging
    their concatenation gives back these two. So one token a prefix describes all prefixes' encodings, and bytes
    appended to a piece extend the table without a look at what is before.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {n: t for t, n in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.may: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self.halves:
            parts = [self.bytes_of[token][i : i + 1] for i in range(len(self.bytes_of[token]))]
            if len(parts) == 1:
                self.halves[token] = None
            else:
                while len(parts) > 2:
                    merges = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None and r < token]
                    if not merges:
                        break
                    i = min(merges)[1]
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE leaves the boundary between these two neighbours alone.

        Walks the merges along the boundary backwards, latest first: a merge of the two border tokens that has a
        lower rank than every merge undone so far would have come before those, and so destroyed them.
        """
        key = left, right
        if (kept := self.may.get(key)) is not None:
            return kept
        bound, ok = float("inf"), True
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < bound:
                ok = False
                break
            ls, rs = self.split(left), self.split(right)
            if ls is None and rs is None:
                break
            if rs is None or (ls is not None and left > right):
                bound, left = left, ls[1]  # undone: the left token's own merge; a merge at the border must be earlier
            else:
                bound, right = right + 1, rs[0]  # of equal ranks the one further left comes first
        self.may[key] = ok
        return ok

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Continue the table ``last`` (``last[i]``: the last token of the first i + 1 bytes) to the whole piece."""
        for end in range(len(last) + 1, len(piece) + 1):
            for size in range(min(self.longest, end), 0, -1):
                token = self.ranks.get(piece[end - size : end])
                if token is not None and (size == end or self.follows(last[end - size - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte without a token")
        return last

    def read(self, last: list[int]) -> list[int]:
        """The encoding that a table ends with."""
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= len(self.bytes_of[ids[-1]])
        return ids[::-1]

    def piece(self, text: str) -> list[int]:
        """The ids of one pre-token, remembered."""
        ids = self.known.get(text)
        if ids is None:
            data = text.encode("utf-8", "replace")
            ids = self.read(self.extend(data, []))
            if len(text) <= 64:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[text] = ids
        return ids


class EncodedText:
    """A text with its pieces and prefix tables, which can be appended to and edited without encoding it anew."""

    def __init__(self, encoder: PrefixEncoder, text: str = "", pattern: str = PATTERN):
        self.encoder, self.pattern = encoder, regex.compile(pattern)
        self.text, self.starts, self.tables, self.encoded = "", [], [], 0
        self.replace(0, 0, text)

    def ids(self) -> list[int]:
        return [i for t in self.tables for i in self.encoder.read(t)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of ``text[start:end]``; pieces away from the edit keep their tables.

        The pieces are cut anew from two pieces before the edit (a piece's end depends on at most what follows it
        directly) until a cut falls on an old cut behind the edit.
        """
        text = self.text[:start] + new + self.text[end:]
        first = max(0, bisect_right(self.starts, start) - 3)
        begin = self.starts[first] if self.starts else 0
        shift = len(new) - (end - start)
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= end}
        starts, tables, rest = [], [], len(self.starts)
        for m in self.pattern.finditer(text, begin):
            if m.start() in old and m.start() > start + len(new):
                rest = old[m.start()]
                break
            data = m.group().encode("utf-8", "replace")
            kept: list[int] = []
            if first + len(starts) < len(self.starts) and self.starts[first + len(starts)] == m.start():
                same = self.tables[first + len(starts)]
                before = self.text[m.start() : start].encode("utf-8", "replace")
                kept = same[: min(len(same), len(before), len(data))]
            self.encoded += len(data) - len(kept)
            starts.append(m.start())
            tables.append(self.encoder.extend(data, kept))
        self.starts = self.starts[:first] + starts + [s + shift for s in self.starts[rest:]]
        self.tables = self.tables[:first] + tables + self.tables[rest:]
        self.text = text


_ENCODERS: dict[int, PrefixEncoder] = {}


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row, without special tokens.

    Null and empty texts give an empty list; their special tokens' strings are ordinary text; rows with repeated
    or null keys are kept as they are; other columns are dropped. The text is taken as it is: no normalisation.

    Plan: a map without any shuffle. The vocabulary file (under 1 MB, whatever the corpus) is read on the driver and
    broadcast. Each worker remembers the pieces it met, up to a fixed number.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    source = spread(docs.select(key, text).toDF("_key", "_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = hash(data.value)
        if name not in _ENCODERS:
            _ENCODERS[name] = PrefixEncoder(load_ranks(data.value))
        encoder, cut = _ENCODERS[name], regex.compile(pattern)
        piece = encoder.piece
        for batch in batches:
            offsets, values = [0], []
            for t in batch.column(1):
                if (s := t.as_py()) is not None:
                    for p in cut.findall(s):
                        values.extend(piece(p))
                offsets.append(len(values))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)['_key']}, ids array<int>")
