"""Problem 8: abusive, hateful and sexual content, by class-conditional Kneser-Ney models."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import sentences
from rostrum.plans.session import spread

KINDS = ("abusive", "hateful", "sexual")
ORDINARY = "ordinary"

# Letters of other scripts and signs that stand for Latin letters in disguised words.
_LOOKALIKES = str.maketrans(dict(zip("асеорхуіјѕһӏԁтнкмвɡαβεικνορτυχ", "aceopxyijshldthkmbgabeiknoptux")))
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
_INVISIBLE = regex.compile(r"[\p{Cf}\u00ad\u034f\ufe00-\ufe0f]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][\s.\-_*]){2,}[^\W\d_](?![^\W_])")
_LATIN, _OTHER = re.compile(r"[A-Za-z]"), regex.compile(r"[^\p{Latin}\P{L}]")
#: Han, kana and Thai, where each character is a token; marks of other scripts that stand inside words.
_EAST, _MARKS = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff", "\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0900-\u0963"
_END = "\n|[。！？।॥؟]+|[.!?…]+[\"'”’»)\\]]*(?=\\s|$)"
_TOKEN = re.compile(rf"[{_EAST}]|(?:[^\W_{_EAST}]|[*#@$!|+](?=[\w*#]))(?:[^\W_{_EAST}]|[{_MARKS}*#@$+]|['’!|](?=[^\W\d_]))*|{_END}")
_REPEATED = regex.compile(r"(.)\1{2,}")
_ACCENT = regex.compile(r"\p{Mn}")


@dataclass(frozen=True)
class Settings:
    """``max_labelled`` and ``max_chars`` (of one text) bound the sample that is fitted on, the documents of the lowest
    hash; all documents are scored, whatever their length."""

    max_labelled: int = 10_000
    max_chars: int = 200_000
    discount: float = 0.75
    rounds: int = 3
    folds: int = 3
    min_gain: float = 0.3
    min_evidence: float = 7.0
    slack: float = 0.015


def pieces(text: str) -> list[str]:
    """The tokens of a text and the signs that end its sentences, in order, not yet in normal form."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _TOKEN.findall(_SPACED.sub(lambda m: re.sub(r"[\s.\-_*]", "", m.group()), text.lower()))


def normal(token: str) -> str:
    """A token with its disguises undone: other scripts' look-alikes, digits and signs for letters, drawn out letters."""
    if not token.isascii() and _LATIN.search(token) and _OTHER.search(token):
        token = token.translate(_LOOKALIKES)
    if any(c.isdigit() or c in "@$!|" for c in token):
        if token.isdigit():
            token = "#"
        elif _LATIN.search(token):
            token = token.translate(_LEET)
    return _REPEATED.sub(r"\1", token) if len(token) > 3 else token


def tokens(sentence: str) -> list[str]:
    """Words of a sentence with disguises undone; what stays hidden behind ``*`` or ``#`` keeps the sign.

    >>> tokens("You are an 1d\\u200biooooot, n a k e d m\\u0430ggot")
    ['you', 'are', 'an', 'idiot', 'naked', 'maggot']
    """
    return [normal(t) for t in pieces(sentence) if not _ENDS.match(t)]


_ENDS = re.compile(r"[\n。！？।॥؟.…?]|!+[\"'”’»)\]]*$")
#: Numbers of tokens: a word of no labelled document, the beginning and the end of a sentence; words follow.
UNKNOWN, BEGIN, STOP, WORDS = 0, 1, 2, 3
_SURE_END, _PERIOD = -1, -2


class Vocabulary(dict):
    """Tokens as they stand in texts -> numbers; looks up what it has not met, and adds it while ``open``."""

    def __init__(self, abbreviations: set[str]):
        super().__init__()
        self.words: dict[str, int] = {}
        self.abbreviations = abbreviations
        self.short: list[bool] = [False] * WORDS  # whether a period behind the word ends no sentence
        self.lexicon: dict[tuple[int, str], list[str]] = {}
        self.open = True

    def __missing__(self, token: str) -> int:
        if _ENDS.match(token):
            number = _PERIOD if token == "." else _SURE_END
        else:
            word = normal(token)
            number = self.words.get(word)
            if number is None and self.open:
                number = self.words[word] = len(self.words) + WORDS
                self.short.append(word in self.abbreviations)
            elif number is None:
                number = self.words.get(self.unmasked(word), UNKNOWN)
        if self.open or len(self) < 500_000:
            self[token] = number
        return number

    def unmasked(self, word: str) -> str:
        """A word with letters behind ``*`` or ``#``: the known word that fits, if there is one."""
        if len(word) > 2 and ("*" in word or "#" in word) and any(c.isalpha() for c in word):
            first = word[0] if word[0] not in "*#" else ""
            return next((k for k in self.lexicon.get((len(word), first), ()) if all(a == b or a in "*#" for a, b in zip(word, k))), word)
        return word


@dataclass
class Sentences:
    """Sentences of several documents as one array: ``<s> <s> words </s>``, one behind the other."""

    symbols: np.ndarray
    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray

    def events(self, chosen: np.ndarray | None = None, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The (two before, one before, symbol) of each word and end of the chosen sentences, as one number each, the sentence
        and the number of its first event."""
        which = np.arange(len(self.start)) if chosen is None else np.flatnonzero(chosen)
        count = self.size[which] + 1
        first = np.cumsum(count) - count
        at = np.repeat(self.start[which] + 2 - first, count) + np.arange(count.sum())
        x = (self.symbols if of is None else of[self.symbols]).astype(np.int64)
        return (x[at - 2] << 42) | (x[at - 1] << 21) | x[at], which, first


def read(texts: list[str | None], vocabulary: Vocabulary) -> Sentences:
    """The sentences of texts; line breaks end them too."""
    flat, sizes = [], []
    get = vocabulary.__getitem__
    for t in texts:
        got = list(map(get, pieces(t))) if t else []
        flat += got
        flat.append(_SURE_END)
        sizes.append(len(got) + 1)
    ids, doc = np.array(flat, np.int64), np.repeat(np.arange(len(texts)), sizes)
    short = np.array(vocabulary.short, bool)
    before = np.concatenate(([_SURE_END], ids[:-1]))
    ends = (ids == _SURE_END) | (ids == _PERIOD) & ~((before >= WORDS) & short[np.maximum(before, 0)])
    sentence = np.cumsum(ends) - ends
    word = ids >= 0
    ids, doc, sentence = ids[word], doc[word], sentence[word]
    _, first, size = np.unique(sentence, return_index=True, return_counts=True)
    start = np.cumsum(size + 3) - (size + 3)
    symbols = np.full(int((size + 3).sum()), BEGIN, np.int64)
    symbols[np.repeat(start + 2 - first, size) + np.arange(len(ids))] = ids
    symbols[start + 2 + size] = STOP
    return Sentences(symbols, start, size, doc[first])


_LOW = (1 << 42) - 1  # the last two symbols of an event


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


class KneserNey:
    """An interpolated Kneser-Ney model of three words of one class, whose lowest order is shared by all classes.

    Lower orders count the contexts that a word continues, not its occurrences. ``base`` holds the shared probability
    of each symbol, from how many different neighbours it has in all classes together.
    """

    def __init__(self, events: np.ndarray, base: np.ndarray, discount: float):
        size = len(base)
        self.three, n3 = np.unique(events, return_counts=True)
        self.two, n2 = np.unique(self.three & _LOW, return_counts=True)
        n1 = np.bincount(self.two & (1 << 21) - 1, minlength=size)
        total = max(1, n1.sum())
        left = discount * (n1 > 0).sum() / total if n1.any() else 1.0
        self.one = np.maximum(n1 - discount, 0.0) / total + left * base
        before = self.two >> 21
        count, kinds = np.bincount(before, n2, size), np.bincount(before, minlength=size)
        self.left1 = np.where(kinds > 0, discount * kinds / np.maximum(count, 1), 1.0)
        self.p2 = np.maximum(n2 - discount, 0.0) / count[before] + self.left1[before] * self.one[self.two & (1 << 21) - 1]
        self.context, inverse = np.unique(self.three >> 21, return_inverse=True)
        count2 = np.bincount(inverse, n3, len(self.context))
        self.left2 = discount * np.bincount(inverse, minlength=len(self.context)) / np.maximum(count2, 1)
        lower = self.p2[np.searchsorted(self.two, self.three & _LOW)]
        self.p3 = np.maximum(n3 - discount, 0.0) / count2[inverse] + self.left2[inverse] * lower if len(self.three) else np.zeros(0)

    def log(self, events: np.ndarray) -> np.ndarray:
        """The log probabilities of events."""
        last, before = events & (1 << 21) - 1, events >> 21 & (1 << 21) - 1
        p = self.left1[before] * self.one[last]
        for keys, wanted, value in ((self.two, events & _LOW, lambda p, at: self.p2[at]), (self.context, events >> 21, lambda p, at: self.left2[at] * p), (self.three, events, lambda p, at: self.p3[at])):
            if len(keys):
                at, hit = _find(keys, wanted)
                p = np.where(hit, value(p, at), p)
        return np.log(p)


@dataclass
class Detector:
    models: dict[str, KneserNey]
    vocabulary: Vocabulary
    thresholds: dict[str, float]
    min_evidence: float

    def gains(self, s: Sentences, chosen: np.ndarray | None = None, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``[sentence, kind]``: how much likelier a word is, in the mean, under each kind's model than as ordinary text; and
        the numbers of the sentences. All models are asked once for each distinct event."""
        events, which, first = s.events(chosen, of)
        if not len(which):
            return np.zeros((0, len(KINDS))), which
        distinct, inverse = np.unique(events, return_inverse=True)
        ordinary = self.models[ORDINARY].log(distinct)
        each = np.stack([self.models[k].log(distinct) - ordinary for k in KINDS], axis=1)
        return np.add.reduceat(each[inverse], first, axis=0) / (s.size[which] + 1)[:, None], which

    def best(self, s: Sentences, n_docs: int, chosen: np.ndarray | None = None, of: np.ndarray | None = None) -> np.ndarray:
        """``[document, kind]``: the best gain of a sentence; a sentence speaks only for the kind it fits best, and only
        with enough evidence in all. -inf where none does."""
        got, which = self.gains(s, chosen, of)
        out = np.full((n_docs, len(KINDS)), -np.inf)
        top = got.argmax(axis=1) if len(got) else np.zeros(0, int)
        gain = got[np.arange(len(got)), top]
        enough = gain * (s.size[which] + 1) >= self.min_evidence
        np.maximum.at(out, (s.doc[which][enough], top[enough]), gain[enough])
        return out


def fit(labelled: list[tuple[int, str, set[str]]], abbreviations: set[str], s: Settings = Settings()) -> Detector | None:
    """Fit the models on labelled documents (id, text, kinds).

    A flagged document is mostly ordinary; so each round gives its sentences to the kind (of its flags) under whose
    model, fitted without the fold the document is in, they are likelier than as ordinary text, and the rest to the
    ordinary model. Wrong flags thereby fade: a sentence that unflagged documents also have is ordinary.
    """
    if not any(kinds for _, _, kinds in labelled):
        return None
    vocabulary = Vocabulary(abbreviations)
    docs = read([t for _, t, _ in labelled], vocabulary)
    vocabulary.open = False
    if len(vocabulary.words) + WORDS >= 1 << 21:
        raise ValueError("the labelled sample has more words than the models can number; lower max_labelled")
    flags = np.array([[k in kinds for k in KINDS] for _, _, kinds in labelled])
    folds = random.Random(len(labelled))
    fold = np.array([folds.randrange(s.folds) for _ in labelled])[docs.doc]
    flagged = flags[docs.doc]
    is_flagged = flagged.any(axis=1)
    size = len(vocabulary.words) + WORDS
    # The words of flagged documents, those least ordinary first, are what a masked word may stand for.
    in_flagged = np.bincount(docs.symbols[docs.start.repeat(docs.size) + 2 + np.arange(docs.size.sum()) - np.repeat(np.cumsum(docs.size) - docs.size, docs.size)], np.repeat(is_flagged, docs.size), size)
    in_all = np.bincount(docs.symbols, minlength=size)
    lexicon: dict[tuple[int, str], list[str]] = defaultdict(list)
    for w, i in sorted(vocabulary.words.items(), key=lambda x: ((in_all[x[1]] - in_flagged[x[1]]) / max(1, in_flagged[x[1]]), -in_flagged[x[1]], x[0])):
        if in_flagged[i] and w.isalpha():
            lexicon[len(w), w[0]].append(w)
            lexicon[len(w), ""].append(w)
    vocabulary.lexicon = dict(lexicon)
    plain_of = np.arange(size)
    for w, i in vocabulary.words.items():
        plain_of[i] = vocabulary.words.get(vocabulary.unmasked(w), i)
    vocabulary.clear()
    # The shared lowest order: in how many different neighbourhoods a word stands.
    events, _, _ = docs.events()
    neighbours = np.bincount(np.unique(events & _LOW) & (1 << 21) - 1, minlength=size)
    total, rest = max(1, neighbours.sum()), s.discount * (neighbours > 0).sum() / (size - WORDS + 1000) / max(1, neighbours.sum())
    base = np.maximum(neighbours - s.discount, 0.0) / total + rest

    def train(chosen: np.ndarray) -> KneserNey:
        return KneserNey(docs.events(chosen)[0], base, s.discount)

    given: np.ndarray | None = None  # the kind of each sentence, -1 for ordinary; at first all kinds of its document

    def toxic(used: np.ndarray) -> dict[str, KneserNey]:
        return {k: train(used & (flagged[:, i] if given is None else given == i)) for i, k in enumerate(KINDS)}

    detector = Detector({}, vocabulary, {}, s.min_evidence)
    plain = train(~is_flagged)
    for _ in range(s.rounds):
        new = np.full(len(docs.start), -1)
        for f in range(s.folds):
            detector.models = toxic(fold != f) | {ORDINARY: plain}
            got, which = detector.gains(docs, is_flagged & (fold == f), plain_of)
            got = np.where(flagged[which], got, -np.inf)
            top = got.argmax(axis=1) if len(got) else np.zeros(0, int)
            gain = got[np.arange(len(got)), top]
            sure = (gain > s.min_gain) & (gain * (docs.size[which] + 1) > s.min_evidence)
            new[which[sure]] = top[sure]
        given = new
    # Thresholds from documents that the models have not seen.
    scored = np.full(flags.shape, -np.inf)
    for f in range(s.folds):
        detector.models = toxic(fold != f) | {ORDINARY: train((fold != f) & (given < 0))}
        scored = np.maximum(scored, detector.best(docs, len(labelled), fold == f, plain_of))
    detector.thresholds = {k: _threshold(list(zip(scored[:, i].tolist(), flags[:, i].tolist())), s.min_gain, s.slack) for i, k in enumerate(KINDS)}
    detector.models = toxic(fold >= 0) | {ORDINARY: train(given < 0)}
    return detector


def _threshold(scored: list[tuple[float, bool]], least: float, slack: float) -> float:
    """The lowest score from which flagging comes within ``slack`` of the best F1 on the labelled documents.

    Labels err both ways, so the best F1 alone would follow single wrong labels; ``least`` is the lowest threshold.
    """
    scored = sorted(scored, reverse=True)
    positives, hit, cuts = sum(f for _, f in scored), 0, []
    for i, (x, flag) in enumerate(scored):
        hit += flag
        if x < least:
            break
        if i + 1 == len(scored) or scored[i + 1][0] < x:
            cuts.append((2 * hit / (i + 1 + positives), x, scored[i + 1][0] if i + 1 < len(scored) else 0.0))
    if not cuts:
        return least
    best = max(f for f, _, _ in cuts)
    _, x, below = [c for c in cuts if c[0] >= best - slack][-1]
    return max(least, (x + max(below, 0.0)) / 2)


def content_scores(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """For every document and kind ``doc_id, source, kind, score, flagged``.

    ``score`` is the highest length-normalised log-likelihood gain of a sentence of that kind over ordinary text
    (null if no sentence fits the kind best); ``flagged`` says whether it reaches the kind's threshold.

    A document counts as labelled with a kind if more raters say 1 than 0; nulls are no votes, and a document
    without a vote on some kind and without a flag is not fitted on. Null, empty and
    wordless texts are scored null and unflagged; repeated texts each for themselves; without any positive label
    everything is null. Other columns are ignored.

    Plan: the abbreviations that no sentence ends with are learned and the models fitted on at most ``max_labelled`` documents of at most
    ``max_chars`` characters, and broadcast (their size is bounded by that sample); scoring is a map over all
    documents without a shuffle. It splits sentences by the learned abbreviations (a split too many parts no insult), numbers the words once, and asks all
    models for each distinct event of an Arrow batch in sorted arrays. Fitting runs when this is called.
    """
    spark = docs.sparkSession
    votes = [(F.sum(F.when(F.col(k) == 1, 1).when(F.col(k) == 0, -1).otherwise(0)) > 0).alias(k) for k in KINDS]
    told = F.least(*[F.count(k) for k in KINDS]).alias("told")
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(*votes, told).where("told > 0 or abusive or hateful or sexual").orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_labelled)
    sample = docs.where(F.col("text").isNotNull() & (F.length("text") <= s.max_chars)).select("doc_id", "text").join(F.broadcast(judged), "doc_id").persist()
    try:
        rows = [(r["doc_id"], r["text"], {k for k in KINDS if r[k]}) for r in sorted(sample.collect(), key=lambda r: r["doc_id"])]
        learned = sentences.learn(sample).titles
    finally:
        sample.unpersist()
    detector = fit(rows, {w for of in learned.values() for w in of if len(w) > 1}, s)
    shared = spark.sparkContext.broadcast(detector)
    source = spread(docs.select("doc_id", "source", "text").toDF("_id", "_source", "_text"))
    kind = dict(source.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for b in batches:
            n = b.num_rows
            best = d.best(read(b.column(2).to_pylist(), d.vocabulary), n) if d is not None else np.full((n, len(KINDS)), -np.inf)
            flags = best >= np.array([d.thresholds[k] for k in KINDS]) if d is not None else best > 0
            index = pa.array(np.repeat(np.arange(n), len(KINDS)))
            scores = pa.array(best.ravel(), pa.float64(), mask=np.isneginf(best.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(index), b.column(1).take(index), pa.array([*KINDS] * n, pa.string()), scores, pa.array(flags.ravel(), pa.bool_())],
                names=["doc_id", "source", "kind", "score", "flagged"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, source string, kind string, score double, flagged boolean")


def rates(scores: DataFrame) -> DataFrame:
    """``source, kind, n_docs, n_flagged, rate``; documents without a source are one source, null."""
    by = scores.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"))
    return by.withColumn("rate", F.col("n_flagged") / F.col("n_docs"))
