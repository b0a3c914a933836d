"""Problem 3: text decoded with a wrong character encoding, found and restored by best-first search."""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.plans.session import spread

#: A token counts as garbled if some reachable text is cheaper by this much (less where UTF-8 itself bears witness).
MARGIN, UTF8_MARGIN = 2.0, 0.5

#: Code pages by which bytes of UTF-8 are commonly misread.
MISREADINGS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1253", "cp1254", "cp1256", "koi8-r", "cp866", "cp874", "gbk", "shift_jis", "big5", "euc_kr")
#: Older encodings whose bytes are commonly misread as Western ones.
ORIGINALS = ("cp1251", "koi8-r", "cp866", "cp1253", "iso8859-7", "cp1256", "iso8859-6", "cp874", "cp1250", "iso8859-5", "shift_jis", "euc_jp", "gbk", "big5", "euc_kr")
WESTERN = ("latin-1", "cp1252", "mac_roman")
#: Pairs of encodings of one script that are commonly taken for each other.
CROSSED = (("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("iso8859-5", "cp1251"), ("cp1251", "iso8859-5"), ("mac_cyrillic", "cp1251"))
_TWO_BYTES = {"shift_jis", "euc_jp", "gbk", "big5", "euc_kr"}

_MULTIBYTE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}")
_CUT_OFF = re.compile(rb"\xe2\x80(?![\x80-\xbf])")
_CODE_POINT = re.compile(r"<U\+([0-9A-Fa-f]{4,6})>|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]+);|&#([0-9]+);")
_ENTITY = re.compile(r"&[A-Za-z]{2,8};")
#: Characters of wrong decoding wherever they stand: C1 controls, the replacement character, written code points.
EVIDENCE = "[\\u0080-\\u009f\\ufffd]|<U\\+[0-9A-Fa-f]{4,6}>|\\\\u00[89][0-9A-Fa-f]|\\\\x[89A-Fa-f][0-9A-Fa-f]|&#x?0*(?:12[89]|1[345][0-9]|[89][0-9a-fA-F]);"
_EVIDENCE = re.compile(EVIDENCE)
_SPACES = re.compile(r"[ \t\n\r]+")

# Plausible punctuation and signs of ordinary text, and letters that few texts hold.
_PLAIN_SIGNS = set("’‘“”„—–…«»¿¡§°£€½¼¾±•№†™©®×·、。，！？；：「」『』（）《》〈〉・ー।॥؟،؛٪¥♪  　​­")
_COMMON = set("оеаинтсрвлкм")
_RARE = set("жшюцщэфъёЖШЮЦЩЭФЪЁЬЫ")
_FREQUENT = set("дпуяыьгзбчйх" + "αοιετσνηυρπκμλςωγδθχάέήίόύώ" + "اليمنوترسعبدهفقكةحجشأءصىخطغئضإذز")
_RARE_CYRILLIC = set("ЃѓЉљЊњЌќЋћЏџЂђЎўЈјҐґЄєЇїІіЅѕ")


def _is_common(ch: str) -> bool:
    """Whether a Chinese character is on the first level of one of the national standards, by its lead byte there."""
    return any((b := ch.encode(codec, "ignore")) and low <= b[0] <= high for codec, low, high in (("gb2312", 0xB0, 0xD7), ("big5", 0xA4, 0xC6), ("shift_jis", 0x88, 0x97)))


@lru_cache(maxsize=70_000)
def _kind(ch: str) -> tuple[str, float]:
    """Script (or ``sign``) of a character, and its own cost."""
    code = ord(ch)
    if code < 128:
        return ("latin" if ch.isalpha() else "ascii"), 0.0
    if code < 0xA0 or code == 0xFFFD or 0xE000 <= code < 0xF900:
        return "bad", 6.0
    category = unicodedata.category(ch)
    if category in ("Cn", "Co", "Cs"):
        return "bad", 6.0
    if category[0] in "LM":
        if code < 0x100:
            return "latin1", 3.0 if ch in "ªº" else 1.0
        if code < 0x250:
            return "latinx", 1.2 if ch in "œŒšŠžŽŸ" else 2.5
        script = unicodedata.name(ch, "?").split()[0]
        if script == "CYRILLIC":
            return "cyrillic", 3.0 if ch in _RARE_CYRILLIC else 0.5 if ch.lower() in _COMMON else 1.4 if ch in _RARE else 0.9 if code < 0x460 else 2.5
        if script == "GREEK":
            return "greek", 0.7 if ch in _FREQUENT else 0.9 if code < 0x3CF and ch not in "ΆΈΉΊ" else 2.0
        if script == "ARABIC":
            return "arabic", 0.7 if ch in _FREQUENT else 0.9 if code < 0x660 else 2.5
        if script in ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "IDEOGRAPHIC", "HANGUL"):
            return "east", (2.5 if "HALFWIDTH" in unicodedata.name(ch, "") else 1.0 if script != "CJK" else 1.6 if _is_common(ch) else 3.0) if code < 0xF900 or code > 0xFB00 else 3.0
        if script in ("DEVANAGARI", "THAI"):
            return script.lower(), 0.7
        return "other", 3.0
    if ch in _PLAIN_SIGNS:
        return "sign", 0.4
    return "sign", 2.5


def cost(text: str) -> float:
    """How implausible a text is as text of one language: odd characters, mixed scripts, heaps of accents."""
    total, run, before, before_ch = 6.0 * len(_CODE_POINT.findall(text)), 0, "ascii", ""
    for ch in text:
        kind, own = _kind(ch)
        total += own
        if kind in ("latin1", "latinx"):
            run += 1
            if run > 2:
                total += 1.5
            if ch.isupper() and before_ch.islower():
                total += 2.0
            if before == "sign" and before_ch in "‚„ƒ√∂¬":
                total += 1.0
        else:
            if kind == "sign" and before in ("latin1", "latinx") and before_ch in "ÃÂâÎÏÐÑØÙàáäåãÄÅÇ":
                total += 1.5
            if run and kind == "latin" and ch.isupper() and before_ch.islower():
                total += 0.5
            run = 0
        if kind not in ("ascii", "sign"):
            script, last = ("latin" if k.startswith("latin") else k for k in (kind, before))
            if last not in ("ascii", "sign", script):
                total += 4.0
            if kind in ("cyrillic", "greek") and ch.isupper() and before == kind:
                total += 1.5 if before_ch.islower() else 0.15
        before, before_ch = kind, ch
    return total


def _to_bytes(text: str, codec: str) -> bytes | None:
    """Encode; code pages with holes take the control characters that readers put into the holes."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        if not codec.startswith("cp12"):
            return None
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(codec)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) < 0xA0:
                return None
            out.append(ord(ch))
    return bytes(out)


def _from_utf8(data: bytes, codec: str) -> str | None:
    """Read the multi-byte sequences of UTF-8 and leave other bytes as they were misread; None if there is none."""
    out, at, found = [], 0, False
    for m in _MULTIBYTE.finditer(data):
        out += [data[at : m.start()].decode(codec, "replace"), m.group().decode("utf-8")]
        at, found = m.end(), True
    if not found:
        cut_off = _CUT_OFF.search(data)
        if not cut_off:
            return None
        return data[: cut_off.start()].decode(codec, "replace") + "”" + data[cut_off.end() :].decode(codec, "replace")
    return "".join(out) + data[at:].decode(codec, "replace")


def _character(m: re.Match) -> str:
    """The character a written code point means; those of the C1 range are meant as Windows-1252."""
    code = int(m.group(5)) if m.group(5) else int(next(g for g in m.groups()[:4] if g), 16)
    if 0x80 <= code < 0xA0:
        return bytes([code]).decode("cp1252", "replace")
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def _neighbours(text: str, pages: bool) -> Iterator[tuple[str, str]]:
    """Texts one operation away, each with the operation's name; ``pages``: also those by reading one page as another."""
    if _CODE_POINT.search(text):
        yield "unescape", _CODE_POINT.sub(_character, text)
    if _ENTITY.search(text) and (plain := html.unescape(text)) != text:
        yield "unescape", plain
    if text.isascii():
        return
    for codec in MISREADINGS:
        data = _to_bytes(text, codec)
        if data is not None and (got := _from_utf8(data, codec)) is not None:
            yield f"{codec}>utf-8", got
    if any(0x80 <= ord(c) < 0xA0 for c in text):
        yield "latin-1>cp1252", "".join(bytes([ord(c)]).decode("cp1252", "replace") if 0x80 <= ord(c) < 0xA0 else c for c in text)
    letters = sum(map(str.isalpha, text))
    if not pages or sum(c.isalpha() and not c.isascii() for c in text) < 2:
        return
    pairs = [(w, c) for w in WESTERN for c in ORIGINALS] + list(CROSSED)
    encoded = {w: _to_bytes(text, w) for w in {w for w, _ in pairs}}
    for western, codec in pairs:
        if (data := encoded[western]) is not None:
            try:
                got = data.decode(codec)
            except UnicodeDecodeError:
                continue
            # Letters stay letters of one script beside ASCII; a sign or two more would be no gain in sense.
            if sum(map(str.isalpha, got)) * (2 if codec in _TWO_BYTES else 1) >= letters:
                yield f"{western}>{codec}", got


@lru_cache(maxsize=200_000)
def repair_token(token: str) -> tuple[str, bool, str, bool]:
    """The cheapest text reachable from a token, whether the token was garbled, the first operation, and whether the search
    says so (else only a character that no right text holds does).

    The frontier is ordered by cost, so the search goes on from the most plausible text found so far; a state that
    was reached before, by whatever path, is not taken up again. It ends when no state is left: reading UTF-8 and undoing
    escapes shorten a text, and may follow one another any number of times; one page is read as another once on a path,
    as two such readings are another mapping of single characters.
    """
    start = cost(token)
    evidence = bool(_EVIDENCE.search(token))
    if start < UTF8_MARGIN and not evidence:
        return token, False, "", False
    seen, frontier, best = {(token, True)}, [(start, 0, token, True, False, "")], (start, token, False, "")
    while frontier:
        at, depth, text, pages, utf8, first = heapq.heappop(frontier)
        if at < best[0]:
            best = (at, text, utf8, first)
        # What UTF-8 has read needs no other page.
        for op, new in _neighbours(text, pages and not utf8):
            shorter = op.endswith("utf-8") or op in ("unescape", "latin-1>cp1252")
            state = new, pages and shorter
            if state not in seen:
                seen.add(state)
                heapq.heappush(frontier, (cost(new) + 0.05 * (depth + 1), depth + 1, *state, utf8 or op.endswith("utf-8"), first or op))
    gain = start - best[0]
    searched = gain >= (UTF8_MARGIN if best[2] else MARGIN)
    garbled = searched or evidence
    return (best[1] if gain > 0 and garbled else token), garbled, best[3] if garbled else "", searched


def repair(text: str) -> tuple[str, bool]:
    """A text with its garbled tokens restored where that is possible, and whether it had any."""
    return examine(text)[:2]


def examine(text: str) -> tuple[str, bool, bool]:
    """As ``repair``, and whether the search found a garbled token, not only a character that no right text holds."""
    if text.isascii() and not _EVIDENCE.search(text) and not _CODE_POINT.search(text):
        return text, False, False
    tokens = {t for t in _SPACES.split(text) if t and (not t.isascii() or "<U+" in t or "\\" in t or "&#" in t)}
    fixed = {t: repair_token(t) for t in tokens}
    signs = [first for _, garbled, first, _ in fixed.values() if garbled]
    if not signs:
        return text, False, False
    searched = any(by for _, _, _, by in fixed.values())
    crossed = {">".join(p): p for p in CROSSED}
    if all(first in crossed for first in signs):  # capitals or rare names may look better the other way round: the whole text decides
        western, codec = crossed[max(set(signs), key=lambda f: (signs.count(f), f))]
        data = _to_bytes(text, western)
        if data is None or cost(data.decode(codec, "replace")) > cost(text) - MARGIN:
            return text, False, False
    # One text was misread in one way: the way of most letters also reads the words too short to tell.
    ways: dict[tuple[str, str], int] = {}
    for t, (_, garbled, first, _) in fixed.items():
        if garbled and ">" in first and not first.endswith("utf-8") and first != "latin-1>cp1252":
            way = tuple(first.split(">"))
            ways[way] = ways.get(way, 0) + len(t)
    if ways:
        western, codec = max(ways, key=lambda w: (ways[w], w))
        for t, (_, garbled, first, _) in fixed.items():
            if not first.endswith("utf-8") and (data := _to_bytes(t, western)) is not None:
                try:
                    fixed[t] = (data.decode(codec), True, first, True)
                except UnicodeDecodeError:
                    continue
    return "".join(fixed[p][0] if p in fixed else p for p in re.split(r"([ \t\n\r]+)", text)), True, searched


def find_garbled(rows: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """The rows whose text holds garbled characters: ``key, restored, is_whole, by_search``.

    ``restored`` is the cheapest text found; ``is_whole`` says that no character of wrong decoding is left in it (it
    is false where the original is lost). ``by_search`` says that the search found a garbled token; where it is false the row
    is given only for a character of EVIDENCE, of which the original is lost. Null and empty texts are never garbled. Repeated rows are found each for
    themselves. Other columns are dropped.

    Plan: a filter in the JVM keeps texts with a character outside ASCII or a written code point; only these go to
    Python. There each distinct token is searched once a worker (a bounded memory): states are texts, operations
    encode by one code page and decode by another or undo an escape, and the cost says how implausible the
    characters are beside one another. No shuffle.
    """
    kind = dict(rows.dtypes)[key]
    source = spread(rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"))).where(suspicious(F.col("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, restored, whole, by_search = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                fixed, garbled, searched = examine(t)
                if garbled:
                    by_search.append(searched)
                    keep.append(i)
                    restored.append(fixed)
                    whole.append(not _EVIDENCE.search(fixed))
            keys = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(restored, pa.string()), pa.array(whole, pa.bool_()), pa.array(by_search, pa.bool_())], names=[key, "restored", "is_whole", "by_search"])

    return source.mapInArrow(run, f"`{key}` {kind}, restored string, is_whole boolean, by_search boolean")


def suspicious(text: Column) -> Column:
    """Whether a text needs a look: it is not all ASCII, or holds a code point written out."""
    return text.rlike("[^\\x00-\\x7f]") | text.rlike("<U\\+[0-9A-Fa-f]{4,6}>|\\\\[ux][0-9A-Fa-f]{2}|&#")
