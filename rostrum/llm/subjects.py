"""Problem 2: subject areas of documents, by class-association rules mined with parallel FP-growth."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Bounds and thresholds. The classifier is fitted on at most ``max_labelled`` labelled documents (those of the
    lowest hash); every document is scored."""

    max_labelled: int = 20_000
    min_support: float = 0.002
    min_count: int = 3
    min_confidence: float = 0.4
    telling: float = 0.4
    improvement: float = 0.02
    share: float = 0.2
    most: int = 3
    fallback: str = "ceremony"
    held_out: int = 5  # one of so many labelled documents is left out of the counts that are calibrated


def words(text: Column) -> Column:
    """The distinct lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))


@dataclass
class Rules:
    """Word -> the rules it is part of, the surest first: (other words, subject, evidence); evidence is the log of the odds
    over the prior odds, calibrated."""

    by_word: dict[str, list[tuple[frozenset[str], str, float]]]
    scale: float
    offset: float

    def scores(self, found: set[str]) -> dict[str, float]:
        """For each subject with a matching rule the summed evidence that a text of these words deals with it."""
        score: dict[str, float] = defaultdict(float)
        for w in sorted(found & self.by_word.keys()):  # each word speaks through the surest rule that it is part of, once
            for others, subject, evidence in self.by_word[w]:
                if others <= found:
                    score[subject] += evidence
                    break
        return score

    def best(self, found: set[str]) -> str | None:
        """The subject of most evidence, if its calibrated probability is at least a half."""
        score = self.scores(found)
        top = max(sorted(score), key=lambda c: score[c], default=None)
        return top if top is not None and self.scale * score[top] + self.offset >= 0 else None


def clean_labels(labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(speech_id, subject), once each, of the subjects that exist; case and white space do not matter."""
    named = labels.select("speech_id", F.lower(F.trim("subject")).alias("subject")).where("speech_id is not null and subject is not null").distinct()
    known = areas.select(F.lower(F.trim("subject")).alias("subject")).where("subject is not null").distinct()
    return named.join(F.broadcast(known), "subject", "left_semi")


@dataclass
class Count:
    """Paragraphs with all words of an antecedent (``n``) and those of the class too (``k``); in ``held`` both among those
    left out."""

    n: int = 0
    k: int = 0
    held: tuple[int, int] = (0, 0)

    def evidence(self, prior: float, all_: bool = True) -> float:
        n, k = (self.n, self.k) if all_ else (self.n - self.held[0], self.k - self.held[1])
        return math.log((k + 0.5) / (n - k + 0.5)) - math.log(prior / (1 - prior) if prior < 1 else 1.0)


def grow(rows: list[tuple[tuple[int, ...], tuple[int, ...], bool, int]], suffix: tuple[int, ...], least: int, sure: float, improvement: float, before: dict[int, float]) -> Iterator[tuple[tuple[int, ...], int, Count]]:
    """The frequent antecedents that end in ``suffix``, with their classes and counts.

    ``rows`` are the conditional transactions (words before the suffix in the order of frequency, classes, held out or
    not, how many), ``before`` the confidences of the suffix. A set is grown further only while a class of it is frequent, surer
    than in the suffix by ``improvement``, and not yet ``sure``, as longer antecedents could not be surer by that much. So their
    length has no set bound, but each word must have bettered the rule.
    """
    found: dict[int, list] = defaultdict(lambda: [0, 0, defaultdict(lambda: [0, 0])])
    for words_, classes, held, times in rows:
        for x in words_:
            cell = found[x]
            cell[0] += times
            cell[1] += times * held
            for c in classes:
                cell[2][c][0] += times
                cell[2][c][1] += times * held
    for x, (n, h, by) in sorted(found.items()):
        frequent = {c: k for c, k in by.items() if k[0] >= least}
        for c, (k, kh) in frequent.items():
            yield (x, *suffix), c, Count(n, k, (h, kh))
        if any(before.get(c, 0.0) + improvement < k / n < sure for c, (k, _) in frequent.items()):
            shorter = [(w[: w.index(x)], cs, held, t) for w, cs, held, t in rows if x in w and w[0] != x]
            yield from grow(shorter, (x, *suffix), least, sure, improvement, {c: k / n for c, (k, _) in frequent.items()})


def mine(parts: DataFrame, labels: DataFrame, areas: DataFrame, s: Settings = Settings()) -> Rules:
    """Fit the rules on labelled parts of documents (``speech_id, items``).

    A transaction is the words of one paragraph and the subjects of its speech; the description of each subject is
    one more. Words that tell no subject apart (no class holds ``telling`` of their paragraphs) are left out before
    growing, but for those of one description only. Parallel FP-growth: each transaction sends every word of it what
    stands before that word in the order of frequency, and the sets that end in a word are grown where its
    transactions meet. A rule stays only if it is surer, by ``improvement``, than all rules of fewer of its words.
    One of ``held_out`` speeches is left out of the counts with which the evidence is calibrated on them. What reaches
    the driver is bounded by ``max_labelled`` and ``min_support``.
    """
    spark = parts.sparkSession
    chosen = labels.select("speech_id").distinct().orderBy(F.xxhash64("speech_id"), "speech_id").limit(s.max_labelled)
    tagged = labels.join(chosen, "speech_id", "left_semi").groupBy("speech_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    held = F.pmod(F.xxhash64("speech_id", F.lit(1)), F.lit(s.held_out)) == 0
    rows = parts.join(F.broadcast(tagged), "speech_id").select("items", "subjects", held.alias("held"), F.lit(False).alias("described"))
    described = areas.where("subject is not null").select(
        words(F.concat_ws(" ", "subject", "description")).alias("items"), F.array(F.lower(F.trim("subject"))).alias("subjects"), F.lit(False).alias("held"), F.lit(True).alias("described")
    )
    rows = rows.unionByName(described).where("size(items) > 0").persist()
    try:
        marked = F.concat(F.array(F.lit("")), "subjects")
        totals = {r["c"]: r["n"] for r in rows.select(F.explode(marked).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(totals) < 2:
            return Rules({}, 1.0, 0.0)
        n_rows = totals.pop("")
        prior = {c: k / n_rows for c, k in totals.items()}
        least = max(s.min_count, math.ceil(s.min_support * n_rows))
        cells = rows.select("held", "described", "subjects", F.explode("items").alias("w")).select("held", "described", "w", F.explode(marked).alias("c"))
        cells = cells.groupBy("w", "c").agg(F.count(F.lit(1)).alias("n"), F.count_if("held").alias("h"), F.count_if("described").alias("d"))
        whole = F.col("c") == ""
        by = cells.groupBy("w").agg(
            F.max(F.when(whole, F.col("n"))).alias("n"), F.max(F.when(whole, F.col("h"))).alias("h"), F.max(F.when(whole, F.col("d"))).alias("d"),
            F.max(F.when(~whole, F.col("n"))).alias("k"), F.collect_list(F.when(~whole, F.struct("c", "n", "h", "d"))).alias("by"),
        )
        telling = (F.col("n") >= least) & (F.col("k") >= s.telling * F.col("n"))
        own = (F.col("d") == 1) & (F.length("w") > 3)  # stands in one description
        kept = sorted(by.where(telling | own).collect(), key=lambda r: (-r["n"], r["w"]))  # few: of min_support in a bounded sample, or of a description
        classes = sorted(prior)
        number = {c: i for i, c in enumerate(classes)}
        counts: dict[tuple[int, ...], dict[int, Count]] = {}
        frequent, near = {}, []
        for i, r in enumerate(kept):
            of_words = {number[c["c"]]: Count(r["n"], c["n"], (r["h"], c["h"])) for c in r["by"] if c["n"] >= least or (c["d"] and r["n"] < least)}
            if of_words:
                counts[(i,)] = of_words
            near.append({c: k.k / k.n for c, k in of_words.items()})
            if r["n"] >= least:
                frequent[r["w"]] = i
        shared = spark.sparkContext.broadcast((frequent, number, near))

        def conditional(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, number_of, grows = shared.value
            for b in batches:
                out: tuple[list, ...] = ([], [], [], [])
                for ws, cs, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    items = sorted(known[w] for w in ws if w in known)
                    cs = [number_of[c] for c in cs]
                    for j in range(1, len(items)):
                        if any(c < 1 - s.improvement for c in grows[items[j]].values()):
                            for column, value in zip(out, (items[j], items[:j], cs, h)):
                                column.append(value)
                kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["item", "before", "classes", "held"])

        def grown(group: pa.Table) -> pa.Table:
            last = group.column("item")[0].as_py()
            times: dict[tuple, int] = defaultdict(int)
            for ws, cs, h in zip(group.column("before").to_pylist(), group.column("classes").to_pylist(), group.column("held").to_pylist()):
                times[tuple(ws), tuple(cs), h] += 1
            got = list(grow([(*k, t) for k, t in times.items()], (last,), least, 1 - s.improvement, s.improvement, shared.value[2][last]))
            return pa.table({"a": pa.array([a for a, _, _ in got], pa.list_(pa.int32())), **{n: pa.array(v, pa.int64()) for n, v in (("c", [c for _, c, _ in got]), ("n", [x.n for *_, x in got]), ("k", [x.k for *_, x in got]), ("nh", [x.held[0] for *_, x in got]), ("kh", [x.held[1] for *_, x in got]))}})

        sent = rows.select("items", "subjects", "held").mapInArrow(conditional, "item int, before array<int>, classes array<int>, held boolean")
        for r in sent.groupBy("item").applyInArrow(grown, "a array<int>, c long, n long, k long, nh long, kh long").where(F.col("k") >= s.min_confidence * F.col("n")).collect():
            counts.setdefault(tuple(r["a"]), {})[r["c"]] = Count(r["n"], r["k"], (r["nh"], r["kh"]))
        rules = {(a, c): x for a, of in counts.items() for c, x in of.items() if x.k >= s.min_confidence * x.n and not _redundant(a, c, x, counts, s.improvement)}

        def made(all_: bool) -> dict[str, list[tuple[frozenset[str], str, float]]]:
            by_word: dict[str, list[tuple[frozenset[str], str, float]]] = defaultdict(list)
            for (a, c), x in rules.items():
                if (evidence := x.evidence(prior[classes[c]], all_)) > 0:
                    names = [kept[i]["w"] for i in a]
                    for w in names:
                        by_word[w].append((frozenset(names) - {w}, classes[c], evidence))
            return {w: sorted(of, key=lambda r: (-r[2], r[1], sorted(r[0]))) for w, of in by_word.items()}

        scale, offset = _calibrate(rows.where("held").select("items", "subjects"), Rules(made(False), 1.0, 0.0))
        return Rules(made(True), scale, offset)
    finally:
        rows.unpersist()


def _redundant(a: tuple[int, ...], c: int, x: Count, counts: dict[tuple[int, ...], dict[int, Count]], improvement: float) -> bool:
    """Whether a rule of fewer of the words is as sure, but for ``improvement``."""
    for size in range(1, len(a)):
        for shorter in combinations(a, size):
            less = counts.get(shorter, {}).get(c)
            if less is not None and x.k / x.n <= less.k / less.n + improvement:
                return True
    return False


def _calibrate(rows: DataFrame, rules: Rules) -> tuple[float, float]:
    """Platt's fit: how the summed evidence of a subject turns into the share of texts that have the subject.

    Sums over a grid of 200 scores are all that leaves the workers.
    """
    shared = rows.sparkSession.sparkContext.broadcast(rules)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: dict[int, list[int]] = defaultdict(lambda: [0, 0])
            for ws, cs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                have = set(cs)
                for c, score in shared.value.scores(set(ws)).items():
                    cell = got[round(min(20.0, score) * 10)]
                    cell[0] += 1
                    cell[1] += c in have
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([v[0] for v in got.values()], pa.int64()), pa.array([v[1] for v in got.values()], pa.int64())], names=["x", "n", "k"])

    cells = rows.mapInArrow(score, "x int, n long, k long").groupBy("x").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect()
    if not cells:
        return 1.0, 0.0
    x, n, k = (np.array([r[c] for r in cells], float) for c in ("x", "n", "k"))
    x /= 10
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton's steps of the logistic fit, none longer than 0.5, drawn slightly towards scale 1
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([np.sum((k - n * p) * x) - (a - 1), np.sum(k - n * p) - b])
        h = np.array([[np.sum(w * x * x) + 1, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if 0 < a < 20 else (1.0, 0.0)


def subject_areas(speeches: DataFrame, labels: DataFrame, areas: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One to three subjects of every speech: ``speech_id, subject, n_paragraphs, share``.

    Each paragraph goes to the subject of the best calibrated evidence, if its probability is at least a half. A
    subject counts if it holds ``share`` of the paragraphs that have a subject, and more than one paragraph or half
    of them (one is passing). The fallback subject is given only where no other is; where no paragraph tells a
    subject, the title's words decide, else the fallback. Every non-null speech_id of ``speeches`` has a row.

    Repeated (speech_id, paragraph) count once (lowest row_id). Null or empty texts, titles, labels and unknown
    labels are passed over. An empty table gives no rows; without labels only the descriptions make rules. Other
    columns are ignored.

    Plan: one shuffle for repeated rows; the rules (bounded by support) are broadcast to a map over the paragraphs, which
    is made once; two partial aggregations bring the counts of a speech's subjects, at most as many as there are
    subjects, into one row, from which the speech is decided. Mining reads the labelled speeches only; it runs when this
    is called.
    """
    spark = speeches.sparkSession
    base = speeches.where("speech_id is not null").select("speech_id", "paragraph", "row_id", "text", "speech_title")

    def parts(of: DataFrame) -> DataFrame:
        once = of.groupBy("speech_id", "paragraph").agg(F.min_by("text", F.coalesce("row_id", F.lit(1 << 62))).alias("text"), F.max("speech_title").alias("title"))
        return once.select("speech_id", words(F.col("text")).alias("items"), "title")

    known = clean_labels(labels, areas)
    fitted = known.select("speech_id").distinct().orderBy(F.xxhash64("speech_id"), "speech_id").limit(s.max_labelled)
    shared = spark.sparkContext.broadcast(mine(parts(base.join(F.broadcast(fitted), "speech_id", "left_semi")), known, areas, s))
    kind = dict(base.dtypes)["speech_id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [shared.value.best(set(ws)) for ws in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(best, pa.string())], names=["speech_id", "title", "subject"])

    scored = parts(base).mapInArrow(score, f"speech_id {kind}, title string, subject string")
    counts = scored.groupBy("speech_id", "subject").agg(F.count(F.lit(1)).alias("k"), F.max("title").alias("title"))
    speech = counts.groupBy("speech_id").agg(F.collect_list(F.when(F.col("subject").isNotNull(), F.struct("subject", "k"))).alias("found"), words(F.max("title")).alias("items"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, rows = [], []
            for i, (found, items) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                got = given([(x["subject"], x["k"]) for x in found], s) or [(shared.value.best(set(items)) or s.fallback, 0, 0.0)]
                take += [i] * len(got)
                rows += got
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *arrays], names=["speech_id", "subject", "n_paragraphs", "share"])

    return speech.mapInArrow(decide, f"speech_id {kind}, subject string, n_paragraphs long, share double")


def given(counts: list[tuple[str, int]], s: Settings = Settings()) -> list[tuple[str, int, float]]:
    """The subjects of a speech from how many paragraphs each has: (subject, paragraphs, share)."""
    m = sum(k for _, k in counts)
    ordered = sorted(counts, key=lambda x: (-x[1], x[0]))
    enough = [(c, k) for c, k in ordered if c != s.fallback and k >= s.share * m and (k > 1 or 2 * k >= m)]
    return [(c, k, k / m) for c, k in enough[: s.most] or ordered[:1]]
