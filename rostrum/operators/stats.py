"""Statistics of authors and speeches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import ascii_only, or_nan, vector_tokens, word_count
from rostrum.plans.session import parallelism

#: Classes of characters whose runs are counted, as Java's regular expressions have them.
WORD_CHARS, NO_SPACE = r"[\p{L}\p{N}_]", r"\S"


def joined_speeches(paragraphs: DataFrame, separator: str = "", mode: str = "intent") -> DataFrame:
    """``president, speech_title, text``: a speech's paragraphs in order, joined. A speech is (president, title).

    The result is one string a speech by its meaning, so a speech must fit a task. Nothing else here builds it: counts
    over joined texts are added up from their paragraphs (``border_runs``).
    """
    rows = paragraphs.where("president is not null and speech_title is not null").withColumn("_t", or_nan(F.col("text"), mode)).where("_t is not null")
    ordered = F.array_sort(F.collect_list(F.struct("paragraph", "row_id", "_t")))
    return rows.groupBy("president", "speech_title").agg(F.array_join(F.transform(ordered, lambda x: x["_t"]), separator).alias("text"))


def no_debates(speeches: DataFrame) -> DataFrame:
    """Without speeches whose title holds ``Debate``; a null title is no debate but names no speech either."""
    return speeches.where(~F.contains(F.col("speech_title"), F.lit("Debate")))


def border_runs(rows: DataFrame, keys: list[str], order: list[str], text: str, chars: str) -> DataFrame:
    """``keys, run``: the runs of ``chars`` at the borders of texts that are joined with nothing between, in order.

    Together with the runs inside of texts (``inner_text``) they are all runs of the joined text, which is never built. Rows
    are range-partitioned by keys and order, so those of one key may be many tasks; each task fuses its own borders and
    leaves what is open at its two ends, one row for each key, to be fused in a second step.
    """
    spark = rows.sparkSession
    head, tail = F.regexp_extract(text, f"^({chars}*)", 1), F.regexp_extract(text, rf"({chars}*)\z", 1)
    whole = head == F.col(text)  # a text of nothing but one run, or empty, joins its neighbours
    ends = rows.select(*keys, *order, head.alias("_head"), tail.alias("_tail"), whole.alias("_whole"))
    ends = ends.repartitionByRange(parallelism(spark), *keys, *order).sortWithinPartitions(*keys, *order).select(*keys, "_head", "_tail", "_whole", F.spark_partition_id().alias("_part"))
    kinds = dict(rows.dtypes)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None  # key, part, what is open at the beginning, whether a run has been closed, what is open at the end
        for batch in batches:
            got: list[tuple] = []
            for *key, h, t, w, part in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != key:
                    got += _open_ends(state)
                    state = [key, part, "", False, ""]
                if w:
                    state[4] += h
                elif state[3]:
                    got.append((*key, 0, 0, state[4] + h, ""))
                    state[4] = t
                else:
                    state[2], state[3], state[4] = state[4] + h, True, t
            yield _run_batch(got, batch.schema, keys)
        if state is not None:
            yield _run_batch(_open_ends(state), batch.schema, keys)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", kind int, part int, run string, last string"
    local = ends.mapInArrow(fuse, schema)

    def stitch(group: pa.Table) -> pa.Table:
        parts = sorted(zip(group.column("part").to_pylist(), group.column("kind").to_pylist(), group.column("run").to_pylist(), group.column("last").to_pylist()))
        runs, open_ = [], ""
        for _, kind, first, last in parts:
            open_ += first
            if kind == 2:
                runs.append(open_)
                open_ = last
        runs = [r for r in [*runs, open_] if r]
        return pa.table({**{k: group.column(k).take(pa.array([0] * len(runs), pa.int64())) for k in keys}, "run": pa.array(runs, pa.string())})

    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", run string"
    stitched = local.where("kind > 0").groupBy(*keys).applyInArrow(stitch, out)  # one row for each key and task
    return local.where("kind = 0 and run <> ''").select(*keys, "run").unionByName(stitched)


def _open_ends(state: list | None) -> list[tuple]:
    """What a task leaves open of a key: kind 1 for one run all through, kind 2 for its first and last piece."""
    return [] if state is None else [(*state[0], 2, state[1], state[2], state[4]) if state[3] else (*state[0], 1, state[1], state[4], "")]


def _run_batch(rows: list[tuple], schema: pa.Schema, keys: list[str]) -> pa.RecordBatch:
    n = len(keys)
    arrays = [pa.array([r[k] for r in rows], schema.field(k).type) for k in range(n)]
    arrays += [pa.array([r[n + k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, "kind", "part", "run", "last"])


def inner_text(text: Column, chars: str) -> Column:
    """A text without the runs of ``chars`` at its borders."""
    return F.regexp_replace(text, rf"^{chars}+|{chars}+\z", "")


def president_stats(paragraphs: DataFrame, mode: str = "intent", first_number: int = 44) -> DataFrame:
    """One row for each president: number, mean vocabulary and words of a speech, total vocabulary, words, speeches.

    The vocabulary of a speech counts distinct tokens of its paragraphs. Words are counted on the joined speech:
    ``reference`` joins with nothing, which fuses words at paragraph ends, and reads null text as ``nan``;
    ``intent`` joins by line breaks and leaves nulls out. The number counts down from ``first_number`` in order of
    first appearance (lowest row_id). Debates and rows without president or title are left out.

    Words are counted by paragraph and added, the fused ones at borders apart; distinct tokens after a partial
    aggregation by (president, speech, token). No speech is ever joined, so none needs to fit a task.
    """
    rows = no_debates(paragraphs)
    parts = rows.where("president is not null").withColumn("_t", or_nan(F.col("text"), mode)).where("_t is not null")
    speech = ["president", "speech_title"]
    vocabulary = parts.select(*speech, F.explode(vector_tokens(F.col("_t"))).alias("token")).distinct().groupBy(*speech).agg(F.count(F.lit(1)).alias("vocab"))
    bare = parts.withColumn("_a", F.lower(ascii_only(F.col("_t"))))
    if mode == "reference":
        counted = parts.groupBy(*speech).agg(F.sum(word_count(inner_text(F.col("_t"), WORD_CHARS))).alias("inner"))
        borders = border_runs(parts, speech, ["paragraph", "row_id"], "_t", WORD_CHARS).groupBy(*speech).agg(F.count(F.lit(1)).alias("fused"))
        counted = counted.join(borders, speech, "left").select(*speech, (F.col("inner") + F.coalesce("fused", F.lit(0))).alias("words"))
        fused = border_runs(bare, speech, ["paragraph", "row_id"], "_a", WORD_CHARS).where(F.length("run") > 1).select("president", F.col("run").alias("token"))
        tokens = bare.select("president", F.explode(vector_tokens(inner_text(F.col("_a"), WORD_CHARS))).alias("token")).unionByName(fused)
    else:
        counted = parts.groupBy(*speech).agg(F.sum(word_count(F.col("_t"))).alias("words"))
        tokens = bare.select("president", F.explode(vector_tokens(F.col("_a"))).alias("token"))
    by_speech = counted.join(vocabulary, speech, "left").withColumn("vocab", F.coalesce("vocab", F.lit(0)))
    total_vocab = tokens.distinct().groupBy("president").agg(F.count(F.lit(1)).alias("total_vocab"))
    per = by_speech.groupBy("president").agg(
        F.avg("vocab").alias("avg_vocab"), F.avg("words").alias("avg_words"), F.sum("words").cast("long").alias("total_words"), F.count(F.lit(1)).alias("total_speeches")
    )
    order = parts.groupBy("president").agg(F.min("row_id").alias("first"))
    number = F.lit(first_number + 1) - F.row_number().over(Window.orderBy("first"))  # over one row a president
    numbered = per.join(order, "president").join(total_vocab, "president", "left").withColumn("president_num", number)
    return numbered.select(
        "president_num", "president", "avg_vocab", "avg_words", F.coalesce("total_vocab", F.lit(0)).alias("total_vocab"), "total_words", "total_speeches"
    )


def vocabulary_table(paragraphs: DataFrame) -> DataFrame:
    """``president, speech_title, vocab``: distinct tokens of each speech, debates left out."""
    rows = no_debates(paragraphs).where("president is not null and text is not null")
    tokens = rows.select("president", "speech_title", F.explode(vector_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("president", "speech_title").agg(F.count_distinct("token").alias("vocab"))


_MARKERS = {
    "applause": ["(Applause.)", "(APPLAUSE.)", "(applause.)", "(Applause)", "(APPLAUSE)", "(applause)"],
    "laughter": ["(Laughter)", "(LAUGHTER)", "(laughter)", "(Laughter.)", "(LAUGHTER.)", "(laughter.)"],
}  # Fixed values: reaction marks as single tokens; the longer marks never equal a token.


def crowd_reactions(paragraphs: DataFrame, mode: str = "intent") -> DataFrame:
    """``president, speech_title, applause, laughter``.

    ``reference`` counts white-space tokens of the unseparated text that equal a mark; ``intent`` counts marks
    anywhere in a paragraph, a mark of both kinds for both. Counts are added up from paragraphs; tokens that fuse at
    borders are counted apart.
    """
    speech = ["president", "speech_title"]
    rows = no_debates(paragraphs).where("president is not null and text is not null")

    if mode == "reference":
        def tokens(text: Column, kind: str) -> Column:
            return F.sum(F.size(F.filter(F.split(text, r"\s+"), lambda t: t.isin(_MARKERS[kind]))))

        inner = rows.groupBy(*speech).agg(*[tokens(inner_text(F.col("text"), NO_SPACE), kind).alias(kind) for kind in _MARKERS])
        fused = border_runs(rows, speech, ["paragraph", "row_id"], "text", NO_SPACE).groupBy(*speech).agg(*[F.count_if(F.col("run").isin(_MARKERS[kind])).alias(kind) for kind in _MARKERS])
        return inner.unionByName(fused).groupBy(*speech).agg(*[F.sum(kind).alias(kind) for kind in _MARKERS])
    return rows.groupBy(*speech).agg(*[F.sum(F.regexp_count("text", F.lit(rf"(?i)\((?:[^()]* )?{kind}\b[^()]*\)"))).alias(kind) for kind in _MARKERS])
