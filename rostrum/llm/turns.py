"""Problem 5: transcripts into clean, ordered speaker turns, by a semi-Markov model over labelled spans."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm.encoding import repair
from rostrum.plans.session import cut, parallelism

#: Paragraphs that are read together; blocks only spread the work, the result is the same for any size.
BLOCK = 256
#: Doubtful labels in a row, with no sure one between them, that are decoded together.
STRETCH = 256
#: Bits of the signature of a unit's content words, as long columns of 64.
BITS, LONGS = 512, 8

# Words of labels. Roles without a name stand for questioners, or for the person of that role.
QUESTIONERS = {"q", "question", "questions", "questioner", "reporter", "audience", "press", "journalist", "voice", "student", "unidentified", "speaker", "member", "correspondent", "inquirer"}
ROLES = {"host", "moderator", "senator", "governor", "interviewer", "chairman", "chair", "chairwoman", "secretary", "minister", "mayor", "representative", "congressman", "congresswoman", "general", "judge", "ambassador", "anchor", "presenter", "translator", "interpreter"}
_SHORT = {"pres": "president", "sen": "senator", "gov": "governor", "mod": "moderator", "sec": "secretary", "gen": "general", "rep": "representative", "amb": "ambassador", "min": "minister"}
_HONORIFICS = {"mr", "mrs", "ms", "miss", "dr", "prof", "the", "hon", "sir", "madam", "mme", "m"}
FILLERS = {"um", "uh", "er", "ah", "eh", "hm", "hmm", "mm", "mhm", "mm-hmm", "mmhmm", "mm-hm", "uh-huh", "uh-hum", "huh", "erm", "oh", "well", "you", "know", "like", "ahem", "yeah", "so"}
_ALONE = {"you", "know", "well", "so", "like", "oh", "yeah"}
_SOUNDS = (
    "laughter|laughs?|laughing|applause|applauds?|cheers?|cheering|music|coughs?|coughing|boo(?:s|ing)?|pause[sd]?|silence|crosstalk|cross[- ]talk|inaudible|unintelligible|"
    "indistinct|noise|whistl\\w+|sighs?|clears throat|bell|chuckl\\w+|gavel|off[- ]mic|phone|sneez\\w+|clap\\w*|shout\\w*|scattered|recording|static|microphone"
)

_TIME = re.compile(r"[\[(<{]\s*(?:t\s*=\s*)?\d{1,3}(?::\d{2}){1,2}(?:[.,]\d+)?\s*[\])>}]|\{t=\d+m\d+s\}|(?m:^)\s*\d{1,2}:\d{2}(?::\d{2})?\s*\||(?<![\w:])\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?![\w:])(?:\s+[-–—]+(?=\s|$))?")
_NOTE = re.compile(
    rf"\(\(?[^()]*\b(?:{_SOUNDS})\b[^()]*\)\)?|<[^<>]*\b(?:{_SOUNDS})\b[^<>]*>|\*+[^*\n]*\b(?:{_SOUNDS})\b[^*\n]*\*+|\{{[^{{}}]*\b(?:{_SOUNDS})\b[^{{}}]*\}}|♪[^♪\n]*♪|[♪♫]|\[[^\[\]]*\]|\(\([^()]*\)\)", re.I
)
_WHOLE_NOTE = re.compile(r"^\s*(?:\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>|\*[^*]*\*|\{[^{}]*\}|♪[^♪]*♪)\s*$")
_ROSTER = re.compile(r"^\s*(?:the\s+)?(?:present|participants?|speakers?|panelists?|attendees|in attendance|attending|those present|members present)\s*:\s*(.+)$", re.I | re.S)
_TOKEN = r"(?:(?:\p{Lu}|(?i:pres|sen|gov|rep|sec|gen|amb|min|mod|mr|mrs|ms|dr|prof|hon))\.|\p{Lu}[\p{L}'’]*(?:-\p{Lu}[\p{L}'’]*)*)"
_LABEL = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}.'’-])(?P<arrows>(?:>>+\s*)?)(?:"
    rf"\[\s*(?P<boxed>(?:[Tt]he\s+|THE\s+)?{_TOKEN}(?:\s+{_TOKEN}){{0,3}})\s*\]\s*:?"
    rf"|(?P<name>(?:[Tt]he\s+|THE\s+)?{_TOKEN}(?:\s+{_TOKEN}){{0,4}})(?:,\s*(?P<after>[\p{{L}}]+(?:\s+[\p{{L}}]+)?))?\s*(?:\((?P<paren>[^()\n]{{1,30}})\))?\s*(?P<sep>:|--+|–|—)(?=\s|$)"
    rf"|(?P<plain>(?:[Tt]he\s+|THE\s+){_TOKEN}|Q|QUESTION|Question)\.(?=\s|$))"
)
_OPEN_TO_LABEL = re.compile(r"(?:^|[.!?…\"”’»)\]>}*♪]|--|—|–)\s*$")
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*")


def _near(a: str, b: str) -> bool:
    """Whether two words differ by one slip at most: a swap, a lost, an added or a changed letter."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _role(token: str) -> str | None:
    token = _SHORT.get(token, token)
    if token in ROLES or token in QUESTIONERS or token == "president":
        return token
    return next((r for r in ("president", "moderator", "host", "senator", "governor", "reporter", "question", "questioner", "audience", "interviewer") if len(token) > 4 and _near(token, r)), None)


def last_name(person: str | None) -> str:
    """The last name in lower case, without marks of rank behind it."""
    words = [w.strip(".,").lower() for w in (person or "").split()]
    words = [w for w in words if w and w not in ("jr", "sr", "ii", "iii", "iv")]
    return words[-1] if words else ""


@dataclass
class Cast:
    """Who speaks in a speech: the president's name, names by role, and all names known to be speakers."""

    president: str
    by_role: dict[str, str] = field(default_factory=dict)
    names: set[str] = field(default_factory=set)

    def speaker(self, role: str | None, name: str) -> str:
        if name and (name == self.president or _near(name, self.president)):
            return "president"
        if name:
            if name not in self.names:
                return next((n for n in sorted(self.names) if _near(name, n)), name)
            return name
        if role == "president":
            return "president"
        if role in QUESTIONERS:
            return "questioner"
        return self.by_role.get(role or "", role or "")


def read_label(words: str, after: str | None = None, paren: str | None = None) -> tuple[str | None, str]:
    """The role and the last name that the words of a label give."""
    tokens = [t.strip(".").lower() for t in words.split()]
    tokens = [t for t in tokens if t not in _HONORIFICS or len(tokens) == 1]
    roles = [r for t in tokens if (r := _role(t))]
    names = [t for t in tokens if len(t) > 1 and not _role(t)]
    for more in (after, paren):
        for t in (more or "").lower().replace(".", "").split():
            if r := _role(t):
                roles.append(r)
    if any(r in QUESTIONERS for r in roles) and not names:
        return "question", ""
    return next((r for r in roles if r not in QUESTIONERS), roles[0] if roles else None), names[-1] if names else ""


@dataclass
class Cue:
    """A place where a turn may begin, who its label says is speaking, and its features."""

    start: int
    stop: int
    reading: str
    features: list[float]
    seed: int  # 1: a label beyond doubt, -1: certainly none, 0: open; only the fit looks at it


#: Features of a place where a turn may begin, each with the mean of the prior that its weight is fitted from.
OPENING = {
    "label": 0.0, "arrows": 2.0, "line start": 1.5, "after a stop": 0.5, "inside a sentence": -4.0, "role": 2.0, "known name": 2.0, "unknown name": -2.0, "neither": -1.0, "role in brackets": 1.0,
    "colon": 1.0, "dash": -0.5, "boxed": 0.5, "full stop": 0.0, "capitals": 0.5, "other words behind": -3.0, "time mark": 0.5, "sound or filler": -3.0, "boxed stranger": -3.0, "dash after stranger": -3.0, "full stop after no role": -3.0,
}
#: Features of whole segments, and of a segment and the one before it, with the means of their priors.
WHOLE = {"same speaker as before": -0.5, "goes on with the words before": -1.0, "length": 0.0, "length of a questioner's": -0.5, "its words hold together": 1.0, "a label of another inside": -1.0, "a time mark inside": -0.5}
#: What each of them can lose and gain where one segment is cut in two. All but the first lie between 0 and 1; cohesion goes
#: from one value to two, and a label of another or a time mark inside the whole is in one part, in both, or was the cut.
CHANGE = np.array([[-1, 1], [0, 1], [-1, 1], [-1, 1], [-1, 2], [-1, 1], [-1, 1]])
_NOISE = re.compile(rf"(?:{_SOUNDS})", re.I)


def find_cues(text: str, cast: Cast) -> list[Cue]:
    """Places of one paragraph where a turn may begin."""
    cues = []
    # Time marks stand between a sentence and the label behind it; blanked out, they are no part of either.
    blank = _TIME.sub(lambda m: " " * len(m.group()), text)
    for m in _LABEL.finditer(blank):
        words = m["boxed"] or m["name"] or m["plain"]
        role, name = read_label(words, m["after"], m["paren"])
        before = blank[: m.start()]
        at_start = not _NOTE.sub("", before.rsplit("\n", 1)[-1]).strip()
        after_stop = not at_start and bool(_OPEN_TO_LABEL.search(before[-80:]))
        known = bool(name) and (name == cast.president or name in cast.names or _near(name, cast.president) or any(_near(name, n) for n in cast.names))
        stranger = not role and not known
        noise = stranger and (words.lower() in FILLERS or bool(_NOISE.fullmatch(words.split()[-1])) or bool(_NOISE.fullmatch(words)))
        timed = text[max(0, m.start() - 16) : m.start()] != blank[max(0, m.start() - 16) : m.start()] or text[m.end() : m.end() + 16] != blank[m.end() : m.end() + 16]
        dash = bool(m["sep"]) and m["sep"] != ":"
        other_words = bool(m["after"]) and not _role(m["after"].lower().split()[-1])
        features = [
            1, bool(m["arrows"]), at_start, after_stop, not at_start and not after_stop, bool(role), known, bool(name) and not known, not role and not name,
            bool(m["paren"]) and bool(role or _role(m["paren"].lower())), m["sep"] == ":", dash, bool(m["boxed"]), bool(m["plain"]), words.isupper(), other_words, timed, noise,
            bool(m["boxed"]) and stranger, dash and stranger, bool(m["plain"]) and not role,
        ]
        sure = (at_start or bool(m["arrows"])) and m["sep"] == ":" and not stranger and not other_words
        seed = 1 if sure else -1 if noise or stranger and not at_start and not after_stop else 0
        cues.append(Cue(m.start(), m.end(), cast.speaker(role, name), [float(x) for x in features], seed))
    return cues


def signature(text: str) -> int:
    """The content words of a text as bits, so that the words of several spans are united by ``or``."""
    bits = 0
    for w in _WORD.findall(text):
        if len(w) > 4:
            h = 0
            for c in w.lower().encode("utf-8", "replace"):
                h = (h * 31 + c) & 0xFFFFFFFF
            bits |= 1 << (h * 2654435761 >> 8) % BITS
    return bits


def continuity(words: int, before: int) -> float:
    """How far a span's words stand in what is before it, beyond what chance gives; 1: all, 0: as by chance or less."""
    n, chance = words.bit_count(), before.bit_count() / BITS
    return max(0.0, ((words & before).bit_count() / n - chance) / (1 - chance)) if n and chance < 1 else 0.0


@dataclass
class Unit:
    """The span from one possible beginning of a turn to the next."""

    reading: str | None
    opening: float
    timed: bool
    words: int
    bits: int


def segment_features(units: list[Unit]) -> np.ndarray:
    """``[i, j]``: the features, in the order of WHOLE but for the first, of the segment of units i to j.

    None of them is a sum over the units: the length is a logarithm of the whole, the cohesion compares each unit
    with all of the segment before it, and a label of another speaker or a time mark inside counts once.
    """
    n = len(units)
    got = np.zeros((n, n, len(WHOLE) - 1))
    for i, first in enumerate(units):
        words, bits, held, other, timed = first.words, first.bits, 0.0, False, False
        goes_on = continuity(first.bits, units[i - 1].bits) if i else 0.0
        asks = first.reading == "questioner"
        for j in range(i, n):
            if j > i:
                u = units[j]
                held += continuity(u.bits, bits)
                words, bits = words + u.words, bits | u.bits
                other |= u.reading != first.reading
                timed |= u.timed
            length = min(1.0, math.log2(1 + words) / 10)
            got[i, j] = goes_on, 0.0 if asks else length, length if asks else 0.0, held / max(1, j - i), other, timed
    return got


@dataclass
class Weights:
    opening: np.ndarray
    whole: np.ndarray

    @property
    def doubt(self) -> tuple[float, float]:
        """Openings scored between these two are doubtful: whole segments' features may decide for or against them.

        Cutting the best segmentation at a place scored above the second would better it, so it opens there; joining
        two of its segments at one scored below the first would, so it does not.
        """
        change = self.whole[:, None] * CHANGE
        return -float(change.max(axis=1).sum()), -float(change.min(axis=1).sum())


def decode(units: list[Unit], whole: np.ndarray) -> list[bool]:
    """Whether each unit begins a segment, in the best segmentation; the first always does.

    Semi-Markov decoding: the state is the speaker of the last segment, a step appends a whole segment, whose score is
    that of its opening and of its features as a whole, and of its speaker beside the one before.
    """
    n = len(units)
    score = segment_features(units) @ whole[1:]
    best: list[dict[str | None, tuple[float, int, str | None]]] = [{} for _ in range(n + 1)]  # speaker -> score, start, speaker before
    for i, u in enumerate(units):
        if i:
            came, before = max(((s + (whole[0] if y == u.reading else 0.0), y) for y, (s, _, _) in best[i].items()), key=lambda x: (x[0], str(x[1])))
            came += u.opening
        else:
            came, before = 0.0, None
        for j in range(i, n):
            total = came + score[i, j]
            kept = best[j + 1].get(u.reading)
            if kept is None or total > kept[0]:
                best[j + 1][u.reading] = (total, i, before)
    opens, at = [False] * n, n
    speaker = max(best[n], key=lambda y: (best[n][y][0], str(y))) if n else None
    while at:
        _, start, before = best[at][speaker]
        opens[start] = True
        at, speaker = start, before
    return opens


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = np.maximum(x.max(axis=axis, keepdims=True), -1e30)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


class _Batch:
    """Speeches of similar length, padded, for the passes of the fit."""

    def __init__(self, speeches: list[tuple[list[Unit], np.ndarray, np.ndarray]]):
        size, width = len(speeches), max(len(u) for u, _, _ in speeches)
        readings = [{r: k for k, r in enumerate(dict.fromkeys(u.reading for u in us))} for us, _, _ in speeches]
        self.n = np.array([len(u) for u, _, _ in speeches])
        self.label, self.phi = np.zeros((size, width), int), np.zeros((size, width, len(OPENING)))
        self.whole = np.zeros((size, width, width, len(WHOLE) - 1))
        self.free, self.bound = np.full((size, width, width), -np.inf), np.full((size, width, width), -np.inf)
        for b, (us, features, seeds) in enumerate(speeches):
            n = len(us)
            self.label[b, :n] = [readings[b][u.reading] for u in us]
            self.phi[b, :n], self.whole[b, :n, :n] = features, segment_features(us)
            must = np.cumsum(seeds == 1)  # a segment may not run over a label beyond doubt
            for i in range(n):
                self.free[b, i, i:n] = 0.0
                if i == 0 or seeds[i] >= 0:
                    self.bound[b, i, i:n] = np.where(must[i:] > must[i], -np.inf, 0.0)
        self.is_label = np.eye(max(map(len, readings)))[self.label]

    def expected(self, w: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The features' expectation over all segmentations that the mask allows, by a forward and a backward pass."""
        same, (size, width), rows = w[len(OPENING)], self.label.shape, np.arange(len(self.n))
        opening = self.phi @ w[: len(OPENING)]
        opening[:, 0] = 0.0
        score = mask + opening[:, :, None] + self.whole @ w[len(OPENING) + 1 :]
        done = np.full((size, width + 1, self.is_label.shape[2]), -np.inf)  # units before, speaker of the last segment
        after = np.full(done.shape, -np.inf)
        came, from_here, left = np.zeros((size, width)), np.full((size, width), -np.inf), np.full(score.shape, -np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            for j in range(width):
                if j:
                    step = done[:, j].copy()
                    step[rows, self.label[:, j]] += same
                    came[:, j] = _log_sum(step, 1)
                ends = came[:, : j + 1] + score[:, : j + 1, j]
                most = np.maximum(ends.max(axis=1, keepdims=True), -1e30)
                done[:, j + 1] = np.log(np.matmul(np.exp(ends - most)[:, None], self.is_label[:, : j + 1])[:, 0]) + most
            total = _log_sum(done[rows, self.n], 1)
            after[rows, self.n] = 0.0
            for i in range(width - 1, -1, -1):
                own = np.take_along_axis(after[:, i + 1 :], np.broadcast_to(self.label[:, i, None, None], (size, width - i, 1)), axis=2)[:, :, 0]
                left[:, i, i:] = score[:, i, i:] + own
                from_here[:, i] = _log_sum(left[:, i, i:], 1)
                step = np.repeat(from_here[:, i, None], after.shape[2], axis=1)
                step[rows, self.label[:, i]] += same
                after[:, i] = np.where((i < self.n)[:, None], step, after[:, i])
            p = np.exp(np.where(np.isfinite(left), came[:, :, None] + left - total[:, None, None], -np.inf))
            again = np.exp(np.take_along_axis(done[:, :width], self.label[:, :, None], axis=2)[:, :, 0] + same + from_here - total[:, None])
        starts = p.sum(axis=2)
        starts[:, 0] = 0.0
        return np.concatenate((np.tensordot(starts, self.phi, 2), [np.nansum(again[:, 1:])], np.tensordot(p, self.whole, 3)))


def fit(speeches: list[tuple[list[Unit], np.ndarray, np.ndarray]], steps: int = 40, spread: float = 1.5) -> Weights:
    """Fit the weights of the conditional model; a speech is its units, their opening features and their seeds.

    Maximises the likelihood of what the seeds leave open: the sum over all segmentations that open at the labels
    beyond doubt and at none that is certainly no label, over the sum of all segmentations, under a normal prior
    around the means of OPENING and WHOLE. So weights of doubtful shapes are learned from how segments cut there fit
    beside those of sure labels.
    """
    prior = np.array([*OPENING.values(), *WHOLE.values()])
    ordered = sorted((x for x in speeches if len(x[0]) > 1), key=lambda x: len(x[0]))
    batches = [_Batch(ordered[k : k + 64]) for k in range(0, len(ordered), 64)]
    w, mean, square = prior.copy(), np.zeros(len(prior)), np.zeros(len(prior))
    for t in range(1, steps + 1 if batches else 1):
        slope = sum(b.expected(w, b.bound) - b.expected(w, b.free) for b in batches) - (w - prior) / spread**2
        mean, square = 0.8 * mean + 0.2 * slope, 0.95 * square + 0.05 * slope**2
        w = w + 0.2 * (mean / (1 - 0.8**t)) / (np.sqrt(square / (1 - 0.95**t)) + 1e-9) * min(1.0, 15 / t)
    return Weights(w[: len(OPENING)], w[len(OPENING) :])


def spoken(text: str) -> list[str]:
    """The words of a span without time marks, sound notes and fillers; fillers inside a sentence leave the rest."""
    if _WHOLE_NOTE.match(text.strip()):
        return []
    words = [w.lower() for w in _WORD.findall(_NOTE.sub(" ", _TIME.sub(" ", text)))]
    return [] if all(w in FILLERS for w in words) and not (words and all(w in _ALONE for w in words)) else [w for w in words if w not in FILLERS - _ALONE]


def clean(text: str) -> str:
    """A span as it was said: without labels' marks, time marks, sound notes and fillers."""
    text = _NOTE.sub(" ", _TIME.sub(" ", text))
    text = re.sub(r"(?i)(?:--|—|–)\s*(?:um|uh|er|ah|you know)\s*(?:--|—|–)|,\s*(?:um|uh|er|ah|you know)\s*,|\b(?:um|uh|er|ah|mm-hmm)\b[,.]?", " ", text)
    return re.sub(r"\s+([,.;!?])", r"\1", re.sub(r"\s+", " ", text)).strip(" ,")


def _cast_events(text: str, title: str | None) -> list[tuple[str, str]]:
    """(role, last name) pairs that a paragraph's labels, a list of those present, or the title give; role may be ''."""
    out = []
    if (m := _ROSTER.match(text)) and not regex.search(r"[.!?]\s+\p{Lu}\p{Ll}+\s+\p{Ll}", m.group(1)):
        for part in re.split(r"[;\n]|,\s*and\s|\band\b", m.group(1)):
            bits = [b.strip() for b in part.split(",")]
            role, name = read_label(bits[0], bits[1] if len(bits) > 1 else None)
            if name:
                out.append((role or "", name))
        return out
    blank = _TIME.sub(lambda m: " " * len(m.group()), text)
    for m in _LABEL.finditer(blank):
        words = m["boxed"] or m["name"] or m["plain"]
        role, name = read_label(words, m["after"], m["paren"])
        line = _NOTE.sub("", blank[: m.start()].rsplit("\n", 1)[-1]).strip()
        if name and role and m["sep"] and (not line or _OPEN_TO_LABEL.search(line)):
            out.append((role, name))
        elif name and not role and m["sep"] == ":" and not line and (words.isupper() or len(words.split()) == 2 and words.split()[0].strip(".").isalpha()):
            out.append(("", name))
    if title:
        for m in regex.finditer(rf"\b(?P<role>Senator|Governor|Sen\.|Gov\.|Secretary|Mayor|Minister)\s+(?P<name>{_TOKEN}(?:\s+{_TOKEN}){{0,2}})", title):
            out.append((_role(m["role"].strip(".").lower()) or "", last_name(m["name"])))
    return out


def is_roster(text: str) -> bool:
    return bool(_ROSTER.match(text))


def make_cast(president: str | None, title: str | None, events: list[dict] | None) -> Cast:
    """The cast of a speech from its counted (role, name) pairs and its title."""
    last = last_name(president)
    counts = {(e["role"], e["name"]): e["n"] for e in events or []}
    for e in _cast_events("", title):
        counts.setdefault(e, 1)
    by_role: dict[str, str] = {}
    for (role, name), _ in sorted(counts.items(), key=lambda kv: (kv[1], kv[0])):
        if role and role not in QUESTIONERS and role != "president" and not _near(name, last):
            by_role[role] = name
    return Cast(last, by_role, {n for _, n in counts if not _near(n, last)})


def spans(text: str, cast: Cast, keep) -> list[tuple[Cue | None, str]]:
    """The spans of one paragraph from one cue that ``keep`` accepts to the next; the first may have none."""
    if is_roster(text):
        return []
    cues = [c for c in find_cues(text, cast) if keep(c)]
    head = text[: cues[0].start] if cues else text
    return ([(None, head)] if head.strip() else []) + [(c, text[c.stop : n.start if n else len(text)]) for c, n in zip(cues, [*cues[1:], None])]


_PIECE = "paragraph int, piece int, cue boolean, sure boolean, reading string, opening double, timed boolean, words int, said boolean, text string, " + ", ".join(f"b{k} long" for k in range(LONGS))


def _unsigned(longs) -> int:
    return sum((x & (1 << 64) - 1) << 64 * k for k, x in enumerate(longs))


def _signed(bits: int) -> list[int]:
    return [x - (1 << 64) if (x := bits >> 64 * k & (1 << 64) - 1) >> 63 else x for k in range(LONGS)]


def _read(batches: Iterator[pa.RecordBatch], w: Weights) -> Iterator[pa.RecordBatch]:
    """The pieces of paragraphs (speech_id, block, paragraph, text, president, title, events)."""
    kept: tuple = (None, None)
    low, high = w.doubt
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    fields = [f.split() for f in _PIECE.split(", ")]
    for batch in batches:
        take, rows = [], []
        for i, r in enumerate(batch.select(["speech_id", "paragraph", "text", "president", "title"]).to_pylist()):
            if kept[0] != r["speech_id"] or kept[1] is None:
                kept = r["speech_id"], make_cast(r["president"], r["title"], batch.column("events")[i].as_py())
            score = lambda c: float(np.dot(c.features, w.opening))
            for k, (cue, text) in enumerate(spans(r["text"], kept[1], lambda c: score(c) >= low)):
                said, x = bool(spoken(text)), score(cue) if cue else 0.0
                take.append(i)
                words = len(_WORD.findall(text))
                rows.append((r["paragraph"], k, cue is not None, cue is not None and x > high, cue.reading if cue else None, x, bool(cue and cue.features[16]), words, said, clean(text) if said else None, *_signed(signature(text))))
        index = pa.array(take, pa.int64())
        arrays = [batch.column(0).take(index), batch.column(1).take(index)] + [pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)]
        yield pa.RecordBatch.from_arrays(arrays, names=["speech_id", "block", *[n for n, _ in fields]])


def _sample(rows: list) -> list[tuple[list[Unit], np.ndarray, np.ndarray]]:
    """Units of whole speeches (paragraph rows in order) as the fit takes them, in stretches of at most 48."""
    out, nothing = [], np.zeros(len(OPENING))
    by: dict = {}
    for r in rows:
        by.setdefault(r["speech_id"], []).append(r)
    for paragraphs in by.values():
        cast = make_cast(paragraphs[0]["president"], paragraphs[0]["title"], [e.asDict() for e in paragraphs[0]["events"] or []])
        units, features, seeds = [Unit("president", 0.0, False, 0, 0)], [nothing], [1]
        for r in sorted(paragraphs, key=lambda r: r["paragraph"]):
            for cue, text in spans(r["text"], cast, lambda c: True):
                if cue:
                    units.append(Unit(cue.reading, 0.0, bool(cue.features[16]), 0, 0))
                    features.append(np.array(cue.features))
                    seeds.append(cue.seed)
                units[-1].words += len(_WORD.findall(text))
                units[-1].bits |= signature(text)
        for a in range(0, len(units), 48):
            out.append((units[a : a + 48], np.array(features[a : a + 48]), np.array(seeds[a : a + 48])))
    return out


def _decide(group: pa.Table, whole: np.ndarray) -> pa.Table:
    """Which doubtful cues of one stretch open a turn."""
    rows = sorted(group.to_pylist(), key=lambda r: r["unit"])
    units = [Unit(r["reading"], r["opening"], r["timed"], r["words"], _unsigned(r[f"b{k}"] for k in range(LONGS))) for r in rows]
    if rows[0]["part"] or not rows[0]["sure"] and rows[0]["unit"]:  # goes on with what is before
        units = [Unit(None if rows[0]["part"] else "president", 0.0, False, 0, 0), *units]
    opens = decode(units, whole)[len(units) - len(rows) :]
    chosen = [k for k, r in enumerate(rows) if not r["sure"] and r["unit"] and opens[k]]
    return pa.table({"speech_id": group.column("speech_id").take(pa.array([0] * len(chosen), pa.int64())), "unit": pa.array([rows[k]["unit"] for k in chosen], pa.int64())})


def speaker_turns(rows: DataFrame, max_fitted: int = 200) -> DataFrame:
    """Pieces of turns in order: ``speech_id, paragraph, piece, speaker, turn_in_paragraph, text``.

    A piece is what one speaker says within one paragraph, cleaned. ``turn_in_paragraph`` numbers, from 1, the turns
    that begin in the paragraph; it is null for a piece that goes on with the turn before it. ``speaker`` is
    ``president`` for the holder of the office, ``questioner`` for those who ask without a name, else a last name.

    ``rows`` has speech_id, paragraph, row_id, president, speech_title, text; other columns are ignored. Of rows of
    one (speech_id, paragraph) the one of the lowest row_id counts. Rows with a null speech_id, paragraph or text
    say nothing. Speech before any label is the president's. Spans of nothing but fillers, notes or time marks, lists
    of those present and scene notes are no pieces and interrupt no turn. An empty table gives no rows.

    A semi-Markov conditional model decides which possible labels open a turn. Its weights are fitted on the first
    BLOCK paragraphs of ``max_fitted`` speeches (of the lowest hash). Whether a label is beyond what the features of
    whole segments could outweigh follows from the weights; such a sure label is opened by every best segmentation, so
    the stretches between sure labels are decoded apart, and exactly, however blocks cut the speech. More than STRETCH
    doubtful labels in a row are decoded in parts.

    Plan: one shuffle for the repeated rows; names by speech are counted with partial aggregation. Reading runs over
    blocks of paragraphs, so a very long speech is many tasks; its numbering comes from scans over one small row a
    block. Only units of stretches with a doubtful label go to the decoder, without their texts. Paragraphs and pieces
    are written once each to the shared folder; those two jobs and the fit run when this is called.
    """
    spark = rows.sparkSession
    base = rows.where("speech_id is not null and paragraph is not null and text is not null").select(
        "speech_id", "paragraph", "row_id", "text", "president", "speech_title"
    )
    tasks = parallelism(spark)
    once = base.repartition(tasks, "speech_id", "paragraph").groupBy("speech_id", "paragraph")
    once = once.agg(F.min_by(F.struct("text", "president", "speech_title"), F.coalesce("row_id", F.lit(1 << 62))).alias("r")).select("speech_id", "paragraph", "r.*")
    kind = dict(base.dtypes)["speech_id"]

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        event = pa.list_(pa.struct([("role", pa.string()), ("name", pa.string())]))
        for batch in batches:
            texts = [repair(t)[0] for t in batch.column(2).to_pylist()]
            named = [[{"role": r, "name": n} for r, n in _cast_events(t, None)] for t in texts]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(3), batch.column(4), pa.array(named, event)]
            yield pa.RecordBatch.from_arrays(arrays, names=["speech_id", "paragraph", "text", "president", "title", "named"])

    read = cut(once.mapInArrow(mend, f"speech_id {kind}, paragraph int, text string, president string, title string, named array<struct<role: string, name: string>>"))
    named = read.select("speech_id", F.explode("named").alias("e")).groupBy("speech_id", "e.role", "e.name").agg(F.count(F.lit(1)).alias("n"))
    cast = named.groupBy("speech_id").agg(F.collect_list(F.struct("role", "name", "n")).alias("events"))
    heads = read.groupBy("speech_id").agg(F.min_by("president", F.when(F.col("president").isNotNull(), F.col("paragraph"))).alias("president"), F.max("title").alias("title"))
    block = F.floor(F.col("paragraph") / BLOCK).cast("long").alias("block")
    # What is known of a speech goes to its blocks first, so that no task gets all paragraphs of a long speech.
    known = read.select("speech_id", block).distinct().join(heads, "speech_id").join(cast, "speech_id", "left")
    texts = read.select("speech_id", block, "paragraph", "text").repartition(tasks, "speech_id", "block").join(known, ["speech_id", "block"])

    chosen = heads.select("speech_id").orderBy(F.xxhash64("speech_id"), "speech_id").limit(max_fitted)
    sample = read.select("speech_id", "paragraph", "text").where(F.col("paragraph").between(0, BLOCK - 1)).join(F.broadcast(chosen), "speech_id")
    weights = fit(_sample(sample.join(known.where("block = 0"), "speech_id").collect()))
    whole = weights.whole

    pieces = texts.sortWithinPartitions("speech_id", "block").mapInArrow(lambda batches: _read(batches, weights), f"speech_id {kind}, block long, {_PIECE}")
    pieces = cut(pieces)
    in_block = Window.partitionBy("speech_id", "block").orderBy("paragraph", "piece")
    earlier = Window.partitionBy("speech_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy("speech_id", "block").agg(F.count_if("cue").alias("cues"), F.count_if("sure").alias("sures"))
    sums = sums.select("speech_id", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("cues", "sures")])
    numbered = pieces.join(sums, ["speech_id", "block"])
    for name, flag, base_ in (("unit", "cue", "_cues"), ("stretch", "sure", "_sures")):
        numbered = numbered.withColumn(name, F.col(base_) + F.sum(F.col(flag).cast("long")).over(in_block))
    doubtful = F.col("cue") & ~F.col("sure")
    bits = [F.bit_or(f"b{k}").alias(f"b{k}") for k in range(LONGS)]
    # The cue's piece is the only one of its unit with a reading; pieces before the first cue are unit 0, the president's.
    units = numbered.groupBy("speech_id", "stretch", "unit").agg(
        F.max("reading").alias("reading"), F.sum("opening").alias("opening"), F.max("timed").alias("timed"), F.max("sure").alias("sure"), F.sum("words").cast("long").alias("words"), *bits
    )
    open_ = numbered.where(doubtful).groupBy("speech_id", "stretch").agg(F.min("unit").alias("_from"))
    units = units.join(open_, ["speech_id", "stretch"]).withColumn("reading", F.when(F.col("unit") == 0, "president").otherwise(F.col("reading")))
    units = units.withColumn("part", F.floor((F.col("unit") - F.col("_from")) / STRETCH).cast("long")).withColumn("part", F.greatest("part", F.lit(0))).drop("_from")
    decided = units.groupBy("speech_id", "stretch", "part").applyInArrow(lambda group: _decide(group, whole), f"speech_id {kind}, unit long").withColumn("opened", F.lit(True))
    columns = ["speech_id", "block", "paragraph", "piece", "said", "text"]
    certain = numbered.where(~doubtful).select(*columns, F.when(F.col("sure"), F.col("reading")).alias("speaker"))
    settled = numbered.where(doubtful).join(decided, ["speech_id", "unit"], "left").select(*columns, F.when(F.col("opened"), F.col("reading")).alias("speaker"))
    labelled = certain.unionByName(settled)
    labelled = labelled.withColumn("speaker", F.last("speaker", True).over(in_block))
    ends = labelled.groupBy("speech_id", "block").agg(F.max_by("speaker", F.struct("paragraph", "piece")).alias("last"), F.max_by("speaker", F.when(F.col("said"), F.struct("paragraph", "piece"))).alias("told"), F.max("said").alias("any"))
    carried = ends.select("speech_id", "block", "told", "any", F.coalesce(F.last("last", True).over(earlier), F.lit("president")).alias("carry"))
    told = F.when(F.col("any"), F.coalesce("told", "carry"))
    carried = carried.select("speech_id", "block", "carry", F.last(told, True).over(earlier).alias("before"))
    resolved = labelled.where("said").join(carried, ["speech_id", "block"]).withColumn("speaker", F.coalesce("speaker", "carry"))
    before = F.coalesce(F.lag("speaker").over(in_block), F.col("before"))
    resolved = resolved.withColumn("_opens", before.isNull() | (before != F.col("speaker")))
    number = F.sum(F.col("_opens").cast("int")).over(Window.partitionBy("speech_id", "block", "paragraph").orderBy("piece"))
    return resolved.select("speech_id", "paragraph", "piece", "speaker", F.when(F.col("_opens"), number).cast("int").alias("turn_in_paragraph"), "text")
