"""Problem 4: sentence boundaries across languages and scripts, from statistics learned without labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from unicodedata import category

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.encoding import repair
from rostrum.plans.session import spread

#: Followers that are no known sentence starter, expected after a true sentence end; and the critical value of the ratio.
BASE_RATE, CRITICAL = 0.05, 7.88

# Frequent function words that tell the four languages in Latin script apart.
_STOPWORDS = {
    "en": "the of and to in is that for it was we our with as not be are this by from or have you i he she they at on",
    "de": "der die und den das wir ist nicht für ein eine auch war am im von zu mit gilt nannte wer wenn heute über sagte ca",
    "fr": "le la les des du nous est et que qui une un il pour dans avons pas au aux ne si en à a",
    "es": "el la los las que de y en por con un una del al no si se para esta está nosotros hoy aún",
}
_STOP = {w: {lang for lang, ws in _STOPWORDS.items() if w in ws.split()} for ws in _STOPWORDS.values() for w in ws.split()}
_SCRIPTS = [
    ("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("zh", regex.compile(r"\p{Han}")), ("th", regex.compile(r"\p{Thai}")), ("hi", regex.compile(r"\p{Devanagari}")),
    ("ar", regex.compile(r"\p{Arabic}")), ("ru", regex.compile(r"\p{Cyrillic}")), ("el", regex.compile(r"\p{Greek}")),
]
_LATIN = regex.compile(r"\p{Latin}")
_SIGNS = str.maketrans(dict.fromkeys(".,;:!?()[]\"'’‘“”«»¿¡-–—…_*", " "))
_BLOCKS = re.compile(r"\r?\n[^\S\n]*\n\s*")
_ENDS = re.compile(r"[.!?…。！？｡．।॥؟۔;;]+")
_CLOSERS = "\"”’»)]}』」）】›"
_OPENERS = "\"“‘«([{『「（【‹„¿¡"
_PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "{": "}"}
_NOTE = regex.compile(r"\s*(?:\[[^\[\]\n]*\]|\([^()\n]*\)|\{[^{}\n]*\}|（[^（）\n]*）|[¹²³⁴⁵⁶⁷⁸⁹⁰]+|[*†‡]+(?=\s|$))")
_NOTE_BEGINS = frozenset("[({（¹²³⁴⁵⁶⁷⁸⁹⁰*†‡")
_PARTS = frozenset(".'’-_&$€£")
_NEXT = re.compile("[\\w\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0900-\u0963]+(?:['’-]\\w+)*")  # marks of other scripts stand inside words
_NUMERAL = regex.compile(r"\p{Nd}")
_TITLE_WORD = regex.compile(r"^[\p{Lu}\p{N}\W]|^(?:of|the|and|to|a|an|in|on|for|at|by|de|la|le|les|du|des|el|los|las|y|et|und|der|die|das|del)$")


_SCRIPT_OF: dict[str, str | None] = {}


def _script(c: str) -> str | None:
    """Which of the scripts a character belongs to."""
    if c not in _SCRIPT_OF:
        _SCRIPT_OF[c] = next((lang for lang, p in _SCRIPTS if p.match(c)), None)
    return _SCRIPT_OF[c]


def language(text: str) -> str:
    """One of eleven codes: the script decides, for Latin letters the function words; English if nothing tells."""
    by: dict[str, int] = {}
    if not text.isascii():
        for c in set(text):
            if c > "\u036f" and (lang := _script(c)):
                by[lang] = by.get(lang, 0) + text.count(c)
    if by:
        latin = len(_LATIN.findall(text))
        east = by.get("ja", 0) + by.get("zh", 0)
        if east > latin / 2:
            return "ja" if by.get("ja", 0) * 10 > by.get("zh", 0) else "zh"
        best = max((n, lang) for lang, n in by.items())
        if best[0] > latin:
            return best[1]
    votes = dict.fromkeys(("en", "de", "fr", "es"), 0.0)
    found = Counter(text.lower().translate(_SIGNS).split())
    for w in _STOP.keys() & found.keys():
        for lang in _STOP[w]:
            votes[lang] += found[w] / len(_STOP[w])
    return max(votes, key=lambda lang: votes[lang])


def _word_before(block: str, at: int) -> str:
    """The token that a period at ``at`` ends, lower-case, numbers as ``#``; of a run of over 100 characters, those at its end."""
    i, least = at, max(0, at - 100)
    while i > least and ((c := block[i - 1]).isalnum() or c in _PARTS or not c.isascii() and category(c)[0] == "M"):
        i -= 1
    w = block[i:at].lower().strip("'’-_&$€£")
    return "#" if w and not w.strip(".").strip("0123456789,.") else w


def _word_after(block: str, at: int) -> tuple[str, str]:
    """The next word from ``at``, and what stands there: ``lower``, ``upper``, ``other`` (no case), ``initial``, ``digit``, ``sign``, ``end``."""
    size = len(block)
    while at < size and ((c := block[at]).isspace() or c in _OPENERS):
        at += 1
    if at >= size:
        return "", "end"
    m = _NEXT.match(block, at)
    if not m:
        return c, "sign"
    if m.end() == at + 1 and c.isupper() and block[at + 1 : at + 2] == ".":
        return c, "initial"
    return m.group(), "digit" if c.isnumeric() else "lower" if c.islower() else "upper" if c.isupper() or c.istitle() else "other"


def count_events(text: str, into: Counter, words: dict[str, Counter]) -> None:
    """Add what one text says of its language: its words, those after sure sentence ends, and what follows each token with a period."""
    lang = language(text)
    if lang in ("th", "zh", "ja"):
        return
    words.setdefault(lang, Counter()).update(_NEXT.findall(text))
    for block in _BLOCKS.split(text):
        word, kind = _word_after(block, 0)
        if kind in ("upper", "other"):
            into[lang, "start", word, ""] += 1
        inside, _ = _protected(block)
        for m in _ENDS.finditer(block):
            ender = m.group()
            if inside and inside[m.start()] or ender[-1] == ";" and lang != "el":
                continue
            end = m.end()
            while end < len(block) and block[end] in _CLOSERS:
                end += 1
            if end < len(block) and not block[end].isspace():
                continue
            word, kind = _word_after(block, end)
            if ender == ".":
                before = _word_before(block, m.start())
                if before:
                    into[lang, "period", before, word if kind in ("upper", "other") else "\x00" + kind] += 1
            elif kind in ("upper", "other") and "." not in ender and "…" not in ender:
                into[lang, "start", word, ""] += 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    words: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [*counts.items(), *(((lang, "word", w, ""), n) for lang, by in words.items() for w, n in by.items())]
        arrays = [pa.array([k[i] for k, _ in rows], pa.string()) for i in range(4)] + [pa.array([n for _, n in rows], pa.int64())]
        counts.clear()
        words.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "kind", "a", "b", "n"])

    for batch in batches:
        for t in batch.column(0):
            count_events(t.as_py(), counts, words)
            if len(counts) + sum(map(len, words.values())) > 100_000:
                yield flush()
    yield flush()


def _ratio(k: Column, n: Column, others: Column, rest: Column) -> Column:
    """Dunning's ratio as a column: how much better k of n and others of rest fit two rates than their common one."""
    def log(k: Column, n: Column, rate: Column) -> Column:
        return F.when(k > 0, k * F.ln(rate)).otherwise(0.0) + F.when(n > k, (n - k) * F.ln(1 - rate)).otherwise(0.0)

    common = (k + others) / (n + rest)
    return 2 * (log(k, n, k / n) + F.when(rest > 0, log(others, rest, others / rest)).otherwise(0.0) - log(k, n, common) - log(others, rest, common))


def _formal(before: str) -> bool:
    """Whether a token before a period is an initial or dotted, so an abbreviation by its form."""
    letters = before.replace(".", "")
    return len(letters) == 1 and letters.isalpha() or "." in before.strip(".") and letters.isalpha() and before != "#"


class Model:
    """Starters, abbreviations, names' titles and collocations over a period of each language."""

    def __init__(self):
        self.starters: dict[str, set[str]] = {}
        self.abbreviations: dict[str, set[str]] = {}
        self.titles: dict[str, set[str]] = {}
        self.collocations: dict[str, set[tuple[str, str]]] = {}


def learn(rows: DataFrame, text: str = "text") -> Model:
    """Learn from all texts of ``rows``, garbled ones too, as their odd tokens pass no test: counting and tests are distributed; only what passes its test is collected.

    Words that open blocks or follow ``!`` and ``?`` twice, and oftener there than elsewhere, are openers. A token
    with a period is an abbreviation if what follows it is too rarely an opener, by the ratio against BASE_RATE; it is
    a title if almost no opener follows. A word is a starter if its rate behind sentence ends (those of the openers,
    and periods after all but abbreviations, initials and numbers) is above its rate elsewhere, by Dunning's ratio.
    An abbreviation, initial or number and the word behind its period are a collocation if the pair is more frequent,
    by the ratio, than the word is elsewhere (a starter: than it is behind sentence ends), and if the word else stands
    mostly inside sentences, as names and months do.
    """
    source = spread(rows.select(F.col(text).alias("_text")).where("_text is not null"))
    events = source.mapInArrow(_counts, "lang string, kind string, a string, b string, n long").groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))
    events = events.persist()
    try:
        words = events.where("kind = 'word'").groupBy("lang", "a").agg(F.sum("n").alias("uses"))
        sizes = words.groupBy("lang").agg(F.sum("uses").alias("size"))
        starts = events.where("kind = 'start'").select("lang", "a", "n")
        openers = _leading(starts, words, sizes)
        period = events.where("kind = 'period'")
        known = period.join(openers.select("lang", F.col("a").alias("b"), F.lit(1).alias("known")), ["lang", "b"], "left")
        by = known.groupBy("lang", "a").agg(
            F.sum(F.when(F.col("b") != "\x00end", F.col("n")).otherwise(0)).alias("n"),
            F.sum(F.when(F.col("b").startswith("\x00") & (F.col("b") != "\x00end"), F.col("n")).otherwise(0)).alias("low"),
            F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)).alias("starter"),
        )
        k, n = F.col("n") - F.col("starter"), F.col("n")
        ratio = 2 * (k * F.ln(k / n) + F.when(n > k, (n - k) * F.ln(1 - k / n)).otherwise(0.0) - k * math.log(BASE_RATE) - (n - k) * math.log(1 - BASE_RATE))
        by = by.where((k > 0.2 * n) & (ratio >= CRITICAL))
        model = Model()
        for r in by.collect():
            lang, n, k = r["lang"], r["n"], r["n"] - r["starter"]
            model.abbreviations.setdefault(lang, set()).add(r["a"])
            if k >= 0.97 * n and r["low"] < 0.5 * n and n >= 5:
                model.titles.setdefault(lang, set()).add(r["a"])
        shared = source.sparkSession.sparkContext.broadcast(model)
        pairs = period.where(~F.col("b").startswith("\x00")).mapInArrow(lambda batches: _split_pairs(batches, shared.value), "lang string, a string, b string, k long, cut boolean")
        opens = starts.unionByName(pairs.where("cut").select("lang", F.col("b").alias("a"), F.col("k").alias("n")))
        leading = _leading(opens, words, sizes)
        starters = leading.where(F.col("ratio") >= CRITICAL)
        learned = starters.select("lang", "a").collect()
        collocations = _collocations(pairs.where("not cut"), opens, words, sizes, starters).collect()
        for r in learned:
            model.starters.setdefault(r["lang"], set()).add(r["a"])
        for r in collocations:
            model.collocations.setdefault(r["lang"], set()).add((r["a"], r["b"]))
        return model
    finally:
        events.unpersist()


def _leading(opens: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang, a, n, all, ratio`` of the words that stand at least twice, and at a higher rate than elsewhere, in ``opens``."""
    opens = opens.groupBy("lang", "a").agg(F.sum("n").alias("n"))
    total = opens.groupBy("lang").agg(F.sum("n").alias("all"))
    counted = opens.where("n >= 2").join(words, ["lang", "a"]).join(F.broadcast(total.join(sizes, "lang")), "lang")
    elsewhere, rest = F.greatest(F.col("uses") - F.col("n"), F.lit(0)), F.greatest(F.col("size") - F.col("all"), F.lit(0))
    leads = F.col("n") * rest >= elsewhere * F.col("all")
    return counted.where(leads).select("lang", "a", "n", "all", _ratio(F.col("n"), F.col("all"), elsewhere, F.greatest(rest, elsewhere)).alias("ratio"))


def _split_pairs(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """``lang, a, b, k, cut``: whether the period between a and b is taken to end a sentence, a being no abbreviation, initial or number."""
    for batch in batches:
        lang, a = batch.column("lang"), batch.column("a")
        cut = [not (t == "#" or _formal(t) or t in model.abbreviations.get(g, ())) for g, t in zip(lang.to_pylist(), a.to_pylist())]
        yield pa.RecordBatch.from_arrays([lang, a, batch.column("b"), batch.column("n"), pa.array(cut, pa.bool_())], names=["lang", "a", "b", "k", "cut"])


def _collocations(pairs: DataFrame, opens: DataFrame, words: DataFrame, sizes: DataFrame, starters: DataFrame) -> DataFrame:
    """``lang, a, b``: pairs over a period that belong together; without a starter only those of numbers, as other pairs are not cut."""
    before = pairs.groupBy("lang", "a").agg(F.sum("k").alias("n"))
    opens = opens.groupBy("lang", F.col("a").alias("b")).agg(F.sum("n").alias("opens"))
    known = starters.select("lang", F.col("a").alias("b"), "all")
    found = pairs.where("k >= 2").join(before, ["lang", "a"]).join(words.withColumnRenamed("a", "b"), ["lang", "b"])
    found = found.join(opens, ["lang", "b"], "left").join(known, ["lang", "b"], "left").join(F.broadcast(sizes), "lang").fillna(0, ["opens"])
    starter = F.col("all").isNotNull()
    elsewhere = F.greatest(F.col("uses") - F.col("k"), F.lit(0))
    others = F.when(starter, F.col("opens")).otherwise(elsewhere)
    rest = F.when(starter, F.col("all")).otherwise(F.greatest(F.col("size") - F.col("n"), elsewhere, F.lit(1)))
    inside = 2 * F.col("opens") <= elsewhere
    leads = F.col("k") * rest > others * F.col("n")
    return found.where(((F.col("a") == "#") | starter) & inside & leads & (_ratio(F.col("k"), F.col("n"), others, rest) >= CRITICAL)).select("lang", "a", "b")


_PAIRED = re.compile('[„“”«»「」『』()\\[\\]（）【】{}"]')


def _protected(block: str) -> tuple[bytearray | None, dict[int, int]]:
    """For each character whether it stands inside a pair of quotes or brackets (None: none does); and the opener of each closer."""
    signs = [(m.start(), m.group()) for m in _PAIRED.finditer(block)]
    if not signs:
        return None, {}
    pairs, stack = {}, []
    straight = [i for i, c in signs if c == '"']
    if len(straight) % 2 == 0:
        pairs = dict(zip(straight[1::2], straight[::2]))
    for i, c in signs:
        if c == "„":
            stack.append((i, "“”"))
        elif stack and c in stack[-1][1]:
            pairs[i] = stack.pop()[0]
        elif c in _PAIRS:
            stack.append((i, _PAIRS[c]))
        elif c in "”»」』)]）】}" and any(c in s[1] for s in stack):
            while c not in stack[-1][1]:
                stack.pop()
            pairs[i] = stack.pop()[0]
    if not pairs:
        return None, {}
    inside = bytearray(len(block) + 1)
    for b, a in pairs.items():
        inside[a:b] = b"\x01" * (b - a)
    return inside, pairs


def _is_heading(block: str) -> bool:
    """A line without a final stop that has the look of a title."""
    words = block.split()
    if not words or len(words) > 12 or _ENDS.search(block[-1]) or block[-1] in _CLOSERS:
        return False
    return all(_TITLE_WORD.match(w) for w in words) and any(c.isupper() for c in block)


def _next_sign(block: str, at: int) -> str:
    """The next character from ``at`` that is not white space, or ''."""
    while at < len(block) and block[at].isspace():
        at += 1
    return block[at : at + 1]


def _period_ends(block: str, at: int, end: int, lang: str, model: Model) -> bool:
    """Whether the period at ``at`` ends a sentence; ``end`` is behind it and its closers."""
    word, kind = _word_after(block, end)
    spaced = end < len(block) and block[end].isspace()
    follows = _next_sign(block, end)
    if kind in ("end",):
        return True
    if kind == "lower" or follows in ",;:—–-،、" or (kind == "sign" and follows not in "♪*•#§&@%"):
        return False
    before = _word_before(block, at) if end == at + 1 else ""
    formal = _formal(before)
    if not spaced:
        if kind == "digit" or formal or before in model.abbreviations.get(lang, ()) or (end == at + 1 and not before):
            return False
        return kind in ("upper", "other") and lang != "hi"
    if not before and end == at + 1 and block[at - 1 : at].isspace() and not block[max(0, at - 40) : at].rstrip()[-1:].isalnum():
        return False
    if lang == "hi":
        return False
    if (before, word) in model.collocations.get(lang, ()):
        return False
    if formal or before in model.abbreviations.get(lang, ()):
        if before in model.titles.get(lang, ()):
            return False
        return kind in ("upper", "other") and word in model.starters.get(lang, ())
    return True


def sentence_ends(text: str, model: Model, lang: str | None = None) -> list[int]:
    """The number of characters up to the end of each sentence of a text, its trailing white space left out.

    >>> sentence_ends('Who asked? "We did." (Laughter.) He left', Model())
    [10, 32, 40]
    """
    lang = lang or language(text)
    ends, at = [], 0
    for part in [*_BLOCKS.finditer(text), None]:
        stop = part.start() if part else len(text)
        block = text[at:stop].rstrip()
        lead = len(block) - len(block.lstrip())
        if block.strip():
            inner = block[lead:]
            cuts = [] if _is_heading(inner) else _thai(inner) if lang == "th" else _block_ends(inner, lang, model)
            ends += [at + lead + c for c in cuts if c < len(inner)] + [at + len(block)]
        at = part.end() if part else stop
    return ends


def _absorb(block: str, end: int) -> int:
    """Move an end behind the bracketed notes and numbers that follow."""
    if _next_sign(block, end) not in _NOTE_BEGINS:
        return end
    while m := _NOTE.match(block, end):
        if _next_sign(block, m.end()).islower():
            break
        end = m.end()
        if block[end : end + 1] in (".", "。") and end < len(block):
            end += 1
    return end


def _thai(block: str) -> list[int]:
    inside, _ = _protected(block)
    ends, done = [], 0
    for m in re.finditer(r"\s+", block):
        if m.start() < done or inside and inside[m.start()] or _NUMERAL.match(block[m.start() - 1]) or _NUMERAL.match(block[m.end() : m.end() + 1] or " "):
            continue
        end = _absorb(block, m.start())
        if end < len(block) or end > m.start():
            ends.append(end)
        done = max(end, m.end())
    return ends


def _block_ends(block: str, lang: str, model: Model) -> list[int]:
    inside, pairs = _protected(block)
    ends, begin = [], 0
    east = lang in ("zh", "ja")
    candidates = [(m.start(), m.end()) for m in _ENDS.finditer(block)]
    for start, stop in candidates:
        if start < begin:
            continue
        ender = block[start:stop]
        if set(ender) <= {";", ";"} and lang != "el":
            continue
        end = stop
        while end in pairs and block[end] in _CLOSERS:
            end += 1
        quoted = end > stop and any(block[i] not in ")]}）】" for i in range(stop, end))
        if inside and inside[end - 1 if end > stop else start]:
            continue
        if end > stop:
            opener = min(pairs[i] for i in range(stop, end))
            if block[opener] in "([{（【":  # a note in brackets ends nothing by itself
                if block[begin:opener].strip():
                    continue
                # It opens the sentence: it stands alone only at the end of the block.
                continue
            if quoted and east:
                if not block[begin:opener].strip():
                    continue
                end = _absorb(block, end)
                ends.append(end)
                begin = end
                continue
        word, kind = _word_after(block, end)
        nxt = _next_sign(block, end)
        if ender == ".":
            good = _period_ends(block, start, end, lang, model)
        elif set(ender) <= set(".…"):
            good = not east and kind in ("upper", "other", "digit") and (word in model.starters.get(lang, ()) or not model.starters.get(lang)) and end < len(block) and (block[end].isspace() or kind == "upper")
        elif east or ender[-1] in "।॥。！？｡．":
            good = True
        else:
            good = kind in ("upper", "other", "initial", "digit", "end") or (kind == "sign" and nxt not in ",;:—–-،、.")
        if good and nxt and nxt in ",;:،、—–":
            good = False
        if good and quoted and not east and kind in ("lower",):
            good = False
        # What looks like a lower-case or sign continuation may be a note that closes the sentence.
        if not good or end < len(block):
            moved = _absorb(block, end)
            if moved > end:
                w2, k2 = _word_after(block, moved)
                if k2 in ("upper", "other", "initial", "end", "digit"):
                    good, end = good or k2 == "end" or "." not in ender or _period_ends(block[:end] + " " + block[moved:].lstrip(), start, end, lang, model), moved
        if good:
            ends.append(end)
            begin = end
    return ends


def split_sentences(rows: DataFrame, model: Model, keys: list[str], text: str = "text", skip_garbled: bool = True) -> DataFrame:
    """One row for each sentence: ``keys, end_pos``.

    ``end_pos`` counts the characters (code points) of the text as stored up to the sentence's last character that
    is not white space. Null and blank texts have no sentences; neither have garbled ones if ``skip_garbled``.
    Repeated rows give repeated sentences. Columns besides ``keys`` and ``text`` are dropped.

    Plan: a map over the rows with the broadcast model, no shuffle.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kinds = dict(rows.dtypes)
    source = spread(rows.select(*keys, F.col(text).alias("_text")).where("_text is not null"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", end_pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, ends = [], []
            for i, t in enumerate(batch.column(len(keys))):
                s = t.as_py()
                if s.strip() and not (skip_garbled and repair(s)[1]):
                    got = sentence_ends(s, shared.value)
                    index += [i] * len(got)
                    ends += got
            take = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(take) for k in range(len(keys))] + [pa.array(ends, pa.int32())], names=[*keys, "end_pos"])

    return source.mapInArrow(run, schema)
