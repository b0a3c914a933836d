"""Problem 1: frequency of every distinct value or term, by heavy-light aggregation."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map of repeated identities: 64 to a word, so at most 2^18 words, whatever the input.
REPEAT_BITS = 1 << 24
#: (term, group) pairs that a task gathers before it sums them up.
GATHERED = 400_000


def normal_form(value: str | None) -> str | None:
    """The form under which two spellings are one term; None for null and empty values.

    >>> normal_form(" Don\\u2019t\\u200b ")
    "don't"
    """
    if value is None:
        return None
    value = value.replace("​", "").replace("’", "'")
    if not value.isascii():
        value = unicodedata.normalize("NFC", unicodedata.normalize("NFC", value).lower())
    return value.strip().lower() or None


def heavy_terms(rows: DataFrame, fields: list[str], k: int) -> dict[tuple[str, str], int]:
    """Up to ``k`` frequent terms of each field, found by one frequent-items sketch over all rows.

    The sketch decides only where a term is counted, never its count, so its error does no harm. Its size is
    bounded by ``k`` whatever the input, and so is what reaches the driver.
    """
    got = rows.agg(*[F.expr(f"approx_top_k(lower(trim(`{f}`)), {k}, {max(4 * k, 1024)})").alias(f) for f in fields]).first()
    terms = {(f, t) for f in fields for item in (got[f] or []) if (t := normal_form(item["item"]))}
    return {t: i for i, t in enumerate(sorted(terms))}


def repeated_identities(base: DataFrame) -> DataFrame:
    """``_word, _bits``: a map of the hashes ``_h`` that stand more than once, at most REPEAT_BITS / 64 rows of two numbers.

    Only hashes are shuffled. A row whose bit is not set is surely single; one whose bit is set may be repeated.
    """
    place = F.pmod("_h", F.lit(REPEAT_BITS))
    twice = base.where("_h is not null").groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    return twice.groupBy(F.floor(place / 64).cast("int").alias("_word")).agg(F.bit_or(one).alias("_bits"))


class _Pairs:
    """Pairs of a term's number and a group, summed up: how often, and the groups as bits of words of 64."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, term: np.ndarray, word: np.ndarray, known: np.ndarray, bits: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((term, word, known, bits, n))
        self.size += len(term)

    def summed(self) -> tuple[np.ndarray, ...]:
        term, word, known, bits, n = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.lexsort((word, known, term))
        term, word, known, bits, n = (x[order] for x in (term, word, known, bits, n))
        fresh = np.ones(len(term), bool)
        fresh[1:] = (term[1:] != term[:-1]) | (word[1:] != word[:-1]) | (known[1:] != known[:-1])
        at = np.flatnonzero(fresh)
        got = (term[at], word[at], known[at], np.bitwise_or.reduceat(bits, at), np.add.reduceat(n, at)) if len(at) else (term, word, known, bits, n)
        self.parts, self.size = [got], len(at)
        return got


def _local_counts(fields: list[str], heavy: dict[tuple[str, str], int]):
    """Counts one partition of (group, fields): heavy terms in arrays kept to its end, other terms as they are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {f: [t for (g, t) in heavy if g == f] for f in fields}
        first = {f: len(names[f]) for f in fields}
        number = {f: {t: i for i, t in enumerate(names[f])} for f in fields}
        raw: dict[str, dict[str, int]] = {f: {} for f in fields}
        occurrences = {f: np.zeros(first[f], np.int64) for f in fields}
        groups, light = {f: _Pairs() for f in fields}, {f: _Pairs() for f in fields}

        def rows(f: str, term: np.ndarray, word: np.ndarray, known: np.ndarray, bits: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            arrays = [
                pa.array([f] * len(term), pa.string()), pa.array([names[f][t] for t in term.tolist()], pa.string()),
                pa.array(word, pa.int64(), mask=~known), pa.array(bits.view(np.int64), pa.int64()), pa.array(n, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["field", "term", "word", "bits", "n"])

        def flush(f: str) -> pa.RecordBatch:
            term, word, known, bits, n = light[f].summed()
            local = term < first[f]
            np.add.at(occurrences[f], term[local], n[local])
            groups[f].add(term[local], word[local], known[local], bits[local], np.zeros(local.sum(), np.int64))
            if groups[f].size > 4 * GATHERED:
                groups[f].summed()
            out = rows(f, term[~local], word[~local], known[~local], bits[~local], n[~local])
            light[f] = _Pairs()
            if len(raw[f]) > GATHERED:
                raw[f], names[f] = {}, names[f][: first[f]]
                number[f] = {t: i for i, t in enumerate(names[f])}
            return out

        for batch in batches:
            g = batch.column(0)
            known = g.is_valid().to_numpy(zero_copy_only=False)
            ids = g.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            word, bits = ids >> 6, np.left_shift(np.uint64(1), (ids & 63).astype(np.uint64))
            word, bits = np.where(known, word, 0), np.where(known, bits, np.uint64(0))
            for k, f in enumerate(fields, 1):
                coded = batch.column(k).dictionary_encode()
                look = np.full(len(coded.dictionary) + 1, -1, np.int64)
                for i, value in enumerate(coded.dictionary.to_pylist()):
                    t = raw[f].get(value)
                    if t is None:
                        form = normal_form(value)
                        t = -1 if form is None else number[f].setdefault(form, len(names[f]))
                        if t == len(names[f]):
                            names[f].append(form)
                        raw[f][value] = t
                    look[i] = t
                term = look[coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)]
                some = term >= 0
                light[f].add(term[some], word[some], known[some], bits[some], np.ones(some.sum(), np.int64))
                if light[f].size >= GATHERED:
                    yield flush(f)
        for f in fields:
            yield flush(f)
            yield rows(f, *groups[f].summed())
            some = np.flatnonzero(occurrences[f])
            nothing = np.zeros(len(some), np.int64)
            yield rows(f, some, nothing, nothing > 0, nothing.astype(np.uint64), occurrences[f][some])

    return run


def term_frequency(
    rows: DataFrame,
    fields: list[str] = ["word", "lemma", "pos"],  # noqa: B006
    identity: tuple[str, str] = ("batch_file", "row_idx"),
    group: str = "speech_id",
    heavy: int = 700,
    common_share: float = 0.5,
) -> DataFrame:
    """Occurrences of each distinct term of each field and the groups it stands in.

    Result: ``field, term, n_occurrences, n_groups, mark``; ``mark`` is ``rare`` for terms of exactly one group,
    ``common`` for terms of more than ``common_share`` of all groups (``common`` wins where there is one group
    only, as a term of the sole group is in all of them), else null.

    Terms are compared in their ``normal_form``. Null and empty values are no terms. Rows of one identity count
    once, also where their values differ (the row of the lowest group and values counts); a row with a null in its
    identity counts as a row of its own. ``group`` is an integral column; rows with a null group add occurrences
    and no group. Other columns of ``rows`` are ignored, whatever their names. An empty table gives no rows.

    Plan: no row is shuffled but those that may be repeated. Repeated identities are found by an exchange of their
    hashes and spread as a map of fixed size; rows outside of it are single and are counted where they are read,
    the few others meet by identity first. Each task adds the detected heavy terms into exact arrays of its own:
    occurrences, and the groups they stand in as bits. Only these sums and the other terms, summed up by task, are
    shuffled, and one aggregation unites both. Neither a hot group nor a hot term gathers rows in one task. Detection
    errors and map collisions shift work only. Runs two small jobs when called: the number of groups and the sketch of
    frequent terms, which brings at most ``heavy`` terms a field to the driver.
    """
    if dict(rows.dtypes)[group] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{group} must be an integral column")
    a, b = identity
    base = rows.select(F.col(group).cast("long").alias("_g"), F.col(a).alias("_a"), F.col(b).alias("_b"), *[F.col(f).alias(f"_{k}") for k, f in enumerate(fields)])
    base = base.withColumn("_h", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.xxhash64("_a", "_b")))
    n_groups = base.agg(F.count_distinct("_g").alias("n")).first()["n"]
    heavies = heavy_terms(rows.select(*fields), fields, heavy)
    place = F.pmod("_h", F.lit(REPEAT_BITS))
    marked = base.join(F.broadcast(repeated_identities(base)), F.floor(place / 64).cast("int") == F.col("_word"), "left")
    again = F.coalesce(F.call_function("getbit", F.col("_bits"), (place % 64).cast("int")) == 1, F.lit(False))
    values = ["_g", *[f"_{k}" for k in range(len(fields))]]
    single = marked.where(~again).select(*values)
    met = marked.where(again).groupBy("_a", "_b").agg(F.min(F.struct(*values)).alias("r")).select("r.*")
    count, schema = _local_counts(fields, heavies), "field string, term string, word long, bits long, n long"
    partial = single.mapInArrow(count, schema).unionByName(met.mapInArrow(count, schema))
    words = partial.groupBy("field", "term", "word").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    counts = words.groupBy("field", "term").agg(F.sum("n").alias("n_occurrences"), F.sum(F.when(F.col("word").isNotNull(), F.bit_count("bits")).otherwise(0)).alias("n_groups"))
    mark = F.when(F.col("n_groups") > common_share * n_groups, "common").when(F.col("n_groups") == 1, "rare")
    return counts.select("field", "term", "n_occurrences", F.col("n_groups").cast("long").alias("n_groups"), mark.alias("mark"))
