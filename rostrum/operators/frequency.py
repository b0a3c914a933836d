"""Relative frequency of word categories over time, and the counts around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.lexicon import URGENCY, category


def category_frequency(words: DataFrame, tags: list[str], groups: dict[str, list[str]], mode: str = "intent") -> DataFrame:
    """``year, word, freq, category`` over the grid of all years and all lemmas that have one of ``tags``.

    ``freq`` is the lemma's count over the year's tagged tokens, 0 where it does not occur. ``reference`` counts a
    lemma of several tags by its alphabetically first tag only, and lists a lemma once for each tag of ``tags`` that
    it has; ``intent`` sums the counts of ``tags`` and lists each lemma once.

    Rows with a null year, lemma or pos count for nothing but the year's total (where pos is not null). An empty
    table gives no rows. The grid (years times distinct lemmas of a closed class) and the totals are small; the only
    large exchange is the partial count by (year, lemma, pos). The years come as one array to each lemma.
    """
    tokens = words.select("year", "lemma", "pos").where("year is not null")
    counts = tokens.where("lemma is not null and pos is not null").groupBy("year", "lemma", "pos").agg(F.count(F.lit(1)).alias("n"))
    totals = tokens.groupBy("year").agg(F.count("pos").alias("total"))
    named = counts.where(F.col("pos").isin(tags))
    if mode == "reference":
        lemmas = named.select("lemma", "pos").distinct().select("lemma")
        amounts = counts.groupBy("year", "lemma").agg(F.min_by("n", "pos").alias("n"))
    else:
        lemmas = named.select("lemma").distinct()
        amounts = named.groupBy("year", "lemma").agg(F.sum("n").alias("n"))
    years = totals.agg(F.collect_list(F.struct("year", "total")).alias("y")).scalar()  # as many as the calendar has
    grid = lemmas.select("lemma", F.explode(years).alias("y")).select("lemma", "y.year", "y.total")
    rows = grid.join(amounts, ["year", "lemma"], "left")
    freq = F.coalesce(F.col("n") / F.when(F.col("total") > 0, F.col("total")), F.lit(0.0))
    return rows.select("year", F.col("lemma").alias("word"), freq.alias("freq"), category(F.col("lemma"), groups).alias("category"))


def by_category(frequency: DataFrame, how: str = "mean") -> DataFrame:
    """The plotted series ``year, category, value``: mean or sum of the frequencies, words of no category left out."""
    value = F.avg("freq") if how == "mean" else F.sum("freq")
    return frequency.where(F.col("category") != "n/a").groupBy("year", "category").agg(value.alias("value"))


def pivot_counts(rows: DataFrame, index: str, column: str, values: list | None = None) -> DataFrame:
    """Counts with one row for each ``index`` and one column for each value of ``column``; 0 where there are none.

    Give ``values`` where they are known: without them Spark first runs a job to find them.
    """
    grouped = rows.groupBy(index)
    return (grouped.pivot(column, values) if values else grouped.pivot(column)).agg(F.count(F.lit(1))).na.fill(0)


def urgency(words: DataFrame, by: str = "president") -> DataFrame:
    """Counts of forceful, suggestive, possible and questionable words for each ``by``, in one pass."""
    word = F.lower("word")

    def hits(pairs: list[tuple[str, str]]) -> Column:
        cond = F.lit(False)
        for tag, w in pairs:
            cond = cond | ((F.col("pos") == tag) & (word == w))
        return F.count_if(cond)

    return words.groupBy(by).agg(*[hits(pairs).alias(name) for name, pairs in URGENCY.items()], F.count(F.lit(1)).alias("n_words"))


def tag_groups(words: DataFrame) -> DataFrame:
    """Counts of tokens and distinct lemmas for each tag, instead of one filter for each tag."""
    return words.where("pos is not null").groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lemma").alias("lemmas"))


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with their place by first appearance, from 1. For values of which there are few, such as authors: the
    final ranking, over one row a value, is one task."""
    first = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("first", value)))
