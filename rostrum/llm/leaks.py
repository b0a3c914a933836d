"""Problem 7: evaluation passages in training text, by an FM-index over each shard of the corpus."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rostrum.plans.session import spread

#: Words of a shard's index, about; a longer single text is a shard of its own.
SHARD_WORDS = 400_000
#: Passages looked for in one pass over the corpus, and their characters in all; more are taken in further passes.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
#: Places of words compared at once.
PLACES = 2_000_000
SAMPLE = 8
#: Symbols: the end of a shard (once), between documents, a word of no passage; the words of passages follow.
END, BETWEEN, OTHER = 0, 1, 2

#: Elements of HTML at which a word ends; other tags stand inside words too.
BREAKS = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html iframe img input "
    "label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
_MARKUP = re.compile(r"<!--.*?-->|</?([A-Za-z][A-Za-z0-9]*)(?:[\s/:-][^<>]*)?>", re.S)
_LINK = regex.compile(r"\]\(\s*(?:https?:|/|#)[^()\s]*\s*\)")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}--[\t\n\v\f\r\x1c-\x1f\x85]]|\p{Variation_Selector}", regex.V1)
_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, without regard to case, mark-up, invisible characters and Unicode form.

    Each tag decides for itself: one of BREAKS ends a word, any other stands in it.

    >>> words_of("<b>Ca\\u00adn&rsquo;t</b> _stop_, \\uff11\\uff12!")
    ['can', 't', 'stop', '12']
    """
    if "<" in text or "](" in text:
        text = _LINK.sub("]", _MARKUP.sub(lambda m: " " if (m[1] or "").lower() in BREAKS else "", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _WORD.findall(text.casefold())


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling from as many symbols as one number holds."""
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    step = max(1, 62 // bits)
    packed = np.zeros(n + step, np.int64)
    packed[:n] = symbols
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = (key << bits) | packed[k : k + n]
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while True:
        second = np.full(n, 0, np.int64)
        if step < n:
            second[:-step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = fresh
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletTree:
    """Rank and access over a symbol sequence: one bit a symbol and level, with the ones counted up to each place."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.ones, self.zeros = [], []
        at = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (at >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(at) - int(self.ones[-1][-1]))
            at = np.concatenate((at[bit == 0], at[bit == 1]))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=alphabet)))).astype(np.int64)
        self.start = self._down(np.zeros(alphabet, np.int64), np.arange(alphabet))

    def _down(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bit, ones = (symbol >> level) & 1, self.ones[k][place]
            place = np.where(bit == 1, self.zeros[k] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(place, symbol) - self.start[symbol]

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and how often each stands before there."""
        symbol = np.zeros(len(place), np.int64)
        for k in range(self.levels):
            ones = self.ones[k]
            bit = ones[place + 1] - ones[place]
            place = np.where(bit == 1, self.zeros[k] + ones[place], place - ones[place])
            symbol = symbol * 2 + bit
        return symbol, place - self.start[symbol]


class FMIndex:
    """Backward search and location over a sequence of symbols that ends in END, which stands nowhere else."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        order = suffix_array(symbols)
        self.tree = WaveletTree(symbols[order - 1], alphabet)
        self.first = self.tree.first
        self.sampled = np.where(order % SAMPLE == 0, order, -1).astype(np.int32)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of phrases (one a row, of equal length), all searched in step from their last word."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.first[-1])
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            low, high = self.first[c] + self.tree.rank(c, low), self.first[c] + self.tree.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the suffixes of intervals, and the interval each belongs to."""
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        row = np.repeat(low, size) + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        found, steps = np.full(len(row), -1, np.int64), np.zeros(len(row), np.int64)
        open_ = np.arange(len(row))
        while len(open_):
            known = self.sampled[row[open_]]
            hit = known >= 0
            found[open_[hit]] = known[hit] + steps[open_[hit]]
            open_ = open_[~hit]
            c, before = self.tree.access(row[open_])
            row[open_] = self.first[c] + before
            steps[open_] += 1
        return found, owner


def longest_common(passage: dict[int, int], words) -> int:
    """Length of the longest common subsequence, with the passage as a bit mask for each word."""
    v, full = 0, passage[-1]
    for w in words:
        m = passage.get(w)
        if m:
            x = v | m
            v = x & ~(x - ((v << 1) | 1)) & full
    return v.bit_count()


class Passages:
    """The held-out passages of one pass: words as numbers, the phrases to search, and the limits of each."""

    def __init__(self, items: list[tuple[int, str]], run: int = 15, share: float = 0.75, stretch: float = 1.5):
        self.run, self.share, self.stretch = run, share, stretch
        self.number: dict[str, int] = {}
        self.items, self.words = [], []
        for item, text in items:
            w = words_of(text or "")
            if w:
                self.items.append(item)
                self.words.append(np.array([self.number.setdefault(x, len(self.number) + 3) for x in w], np.int64))
        self.alphabet = len(self.number) + 3
        phrases = [(i, k) for i, w in enumerate(self.words) for k in range(len(w) - run + 1)]
        self.phrase_of = np.array([i for i, _ in phrases], np.int64)
        self.phrases = np.array([self.words[i][k : k + run] for i, k in phrases], np.int64).reshape(-1, run)
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.passage = np.repeat(np.arange(len(self.words)), self.length)
        self.need = np.ceil(share * self.length - 1e-9).astype(np.int64)
        self.window = np.floor(stretch * self.length + 1e-9).astype(np.int64)
        self.kept: dict[int, dict[int, int]] = {}

    def mask(self, i: int) -> dict[int, int]:
        """The places of each word of a passage, as bits; made when a passage is first compared."""
        if i not in self.kept:
            mask: dict[int, int] = defaultdict(int)
            for k, x in enumerate(self.words[i].tolist()):
                mask[x] |= 1 << k
            self.kept[i] = dict(mask) | {-1: (1 << len(self.words[i])) - 1}
        return self.kept[i]

    def numbers(self, text: str) -> list[int]:
        get = self.number.get
        return [get(w, OTHER) for w in words_of(text)]


def _spans(index: FMIndex, symbols: np.ndarray, doc_of: np.ndarray, p: Passages) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """For each (document, passage) of a shard that is a case, the stretches of the document, as shard positions."""
    found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    if len(p.phrases):
        low, high = index.search(p.phrases)
        some = np.flatnonzero(high > low)
        at, owner = index.locate(low[some], high[some])
        for a, i in zip(at.tolist(), p.phrase_of[some][owner].tolist()):
            found[int(doc_of[a]), i].append((a, a + p.run))
    for i, d, first, last in _candidates(index, doc_of, p):
        begin, end = np.searchsorted(doc_of, d, "left"), np.searchsorted(doc_of, d, "right")
        need, window = int(p.need[i]), int(p.window[i])
        lo, hi = max(begin, first - window), min(end, last + 2 * window)
        text = symbols[lo:hi].tolist()
        if longest_common(p.mask(i), text) >= need and (got := _stretch(p.mask(i), text, need, window)):
            found[d, i] += [(lo + a, lo + b) for a, b in got]
    return found


def _candidates(index: FMIndex, doc_of: np.ndarray, p: Passages) -> Iterator[tuple[int, int, int, int]]:
    """(passage, document, first and last place) where so many of a passage's rarest words stand close together that
    three quarters may be there. All passages are looked at together; the work grows with the places of their words.

    All but length - need of the words must be there, so of the (length - need + s) rarest ones at least s.
    """
    if not len(p.flat):
        return
    often = np.diff(index.first)[: p.alphabet]
    some = np.maximum(1, p.length // 4)
    order = np.lexsort((often[p.flat], p.passage))
    rare = np.arange(len(order)) - p.begin[p.passage] < (p.length - p.need + some)[p.passage]
    chosen = np.unique(p.passage[rare] * p.alphabet + p.flat[order][rare])
    passage, word = chosen // p.alphabet, chosen % p.alphabet
    # Words the passage repeats may stand once for several of the chosen places.
    least = np.maximum(1, some - (p.length - p.need + some - np.bincount(passage, minlength=len(p.words))))
    passage, word = passage[often[word] > 0], word[often[word] > 0]
    if not len(word):
        return
    known = np.unique(word)
    at, owner = index.locate(index.first[known], index.first[known + 1])
    at = at[np.lexsort((at, owner))]
    start = np.zeros(p.alphabet, np.int64)
    start[known] = np.cumsum(often[known]) - often[known]
    size = len(doc_of)
    cuts = np.flatnonzero(np.diff(passage)) + 1  # parts of whole passages, of about PLACES places each
    total = np.cumsum(often[word])
    part = [0, *[int(c) for c, change in zip(cuts, np.diff(total[cuts - 1] // PLACES, prepend=0)) if change], len(word)]
    for a, b in zip(part, part[1:]):
        n = often[word[a:b]]
        where = np.repeat(start[word[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.sort(np.repeat(passage[a:b], n) * size + at[where])
        i, place = both // size, both % size
        end = np.arange(len(i)) + least[i] - 1
        inside = end < len(i)
        end = np.minimum(end, len(i) - 1)
        near = np.flatnonzero(inside & (i[end] == i) & (place[end] - place < p.window[i]) & (doc_of[place[end]] == doc_of[place]))
        i, place = i[near], place[near]
        doc = doc_of[place]
        fresh = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (doc[1:] != doc[:-1])))) if len(i) else np.zeros(0, int)
        for f, t in zip(fresh.tolist(), [*fresh[1:].tolist(), len(i)]):
            yield int(i[f]), int(doc[f]), int(place[f]), int(place[t - 1])


def _stretch(mask: dict[int, int], text: list[int], need: int, window: int) -> list[tuple[int, int]]:
    """Stretches of at most ``window`` words that hold ``need`` of the passage's words in order; exact."""
    got, end = [], 0
    for a, w in enumerate(text):
        if w in mask and a >= end and longest_common(mask, text[a : a + window]) >= need:
            got.append((a, min(a + window, len(text))))
            end = a + max(1, window // 2)
    return got


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _shards(batches: Iterator[pa.RecordBatch], p: Passages):
    """Documents with a word of a passage, numbered, in groups of about SHARD_WORDS words."""
    ids, numbers, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            if (s := text.as_py()) and max(n := p.numbers(s), default=0) > OTHER:
                ids.append(key)
                numbers.append(n)
                size += len(n) + 1
                if size >= SHARD_WORDS:
                    yield ids, numbers
                    ids, numbers, size = [], [], 0
    if ids:
        yield ids, numbers


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "text",
    run: int = 15, share: float = 0.75, stretch: float = 1.5,
) -> DataFrame:
    """Each pair of a document and a passage that leaked into it: ``key, item, spans``.

    A pair is a case if the document holds ``run`` consecutive words of the passage, or at least ``share`` of its
    words in order within a stretch of ``stretch`` times its length. ``spans`` (array of start and end, in words of
    the document, the end exclusive) are the merged stretches to be removed.

    Null, empty and wordless texts and passages have no cases; documents or items with repeated text are cases of
    their own; repeated document ids each give their rows; columns besides the named ones are ignored.

    Plan: a map over the corpus without a shuffle. Each task cuts its documents into shards of bounded size and
    builds over each an FM-index (suffix order by prefix doubling, a wavelet tree over the last column, every 8th
    suffix position). All phrases of ``run`` words are searched backwards, in step, and located. For the second
    kind, so many of a passage's rarest words are located that some must be there if three quarters are; only the
    documents in which enough stand close together are compared exactly. All passages of a block are searched together.
    Passages reach the workers in blocks of BLOCK_ITEMS and BLOCK_CHARS, each one pass, so what is broadcast is bounded
    whatever the number of passages.
    """
    spark = docs.sparkSession
    source = spread(docs.select(key, text).toDF("_key", "_text").where("_text is not null"))
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item]
    schema = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, spans array<array<int>>"
    named = items.select(item, passage).toDF("_item", "_text").where("_text is not null")

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)
        item_type = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = Passages(shared.value, run, share, stretch)
            for ids, numbers in _shards(batches, p):
                lengths = np.array([len(n) for n in numbers])
                start = np.concatenate(([0], np.cumsum(lengths + 1)))
                symbols = np.full(start[-1] + 1, BETWEEN, np.int64)
                symbols[-1] = END
                for s, n in zip(start, numbers):
                    symbols[s : s + len(n)] = n
                doc_of = np.append(np.repeat(np.arange(len(ids)), lengths + 1), len(ids))
                found = _spans(FMIndex(symbols, p.alphabet), symbols, doc_of, p)
                rows = [(ids[d], p.items[i], [[a - int(start[d]), b - int(start[d])] for a, b in merged(spans)]) for (d, i), spans in sorted(found.items())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0].as_py() for r in rows], ids[0].type), pa.array([r[1] for r in rows], item_type), pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int32())))],
                    names=[key, item, "spans"],
                )

        return source.mapInArrow(work, schema)

    out, block, chars = spark.createDataFrame([], schema), [], 0
    for row in named.toLocalIterator():
        block.append((row[0], row[1]))
        chars += len(row[1])
        if len(block) == BLOCK_ITEMS or chars >= BLOCK_CHARS:
            out, block, chars = out.unionByName(scan(block)), [], 0
    return out.unionByName(scan(block)) if block else out
