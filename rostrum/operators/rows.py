"""Row and column operators: ranges, patches, ordinals, unions, paragraph normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import split_lines


def row_range(rows: DataFrame, order: list[str], start: int, stop: int) -> DataFrame:
    """Rows ``start`` (from 0) to ``stop`` (without it) in the order of ``order``, which must be total."""
    return rows.orderBy(*order).offset(start).limit(stop - start)


def patch(rows: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    """``column`` replaced in the rows that satisfy ``where``; a null condition leaves the row."""
    return rows.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def drop_last(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Without the row of the highest ``order`` of each group; rows of a null order stay."""
    last = rows.groupBy(*by).agg(F.max(order).alias("_last"))
    return rows.join(last, by).where(F.col("_last").isNull() | F.col(order).isNull() | (F.col(order) != F.col("_last"))).drop("_last")


def ordinal(rows: DataFrame, by: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """A count from 0 within each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name, missing columns null; an index column of a CSV (``Unnamed: 0``, ``_c0``) is dropped."""
    bare = [f.drop(*[c for c in f.columns if c.startswith("Unnamed") or c in ("_c0", "")]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), bare)


def normalize_paragraphs(rows: DataFrame) -> DataFrame:
    """Speeches kept as one paragraph (``full_document`` 1) split at line breaks and numbered anew from 0; rows of
    several paragraphs (0) pass; error rows (2) go. The columns but ``text``, ``paragraph``, ``full_document`` stay."""
    kept = [c for c in rows.columns if c not in ("text", "paragraph", "full_document")]
    whole = rows.where("full_document = 0").select(*kept, "paragraph", "text")
    split = rows.where("full_document = 1").select(*kept, F.posexplode(split_lines(F.col("text"))).alias("paragraph", "text"))
    return whole.unionByName(split)


def replace_speech(rows: DataFrame, is_it: Column, paragraphs: list[str]) -> DataFrame:
    """One speech's rows replaced by literal paragraphs that keep its other columns."""
    head = rows.where(is_it).orderBy("paragraph").limit(1)
    new = head.drop("text", "paragraph").select("*", F.posexplode(F.array(*map(F.lit, paragraphs))).alias("paragraph", "text"))
    return rows.where(~F.coalesce(is_it, F.lit(False))).unionByName(new)


def unpivot(rows: DataFrame, ids: list[str], columns: list[str], index: str = "topic_idx", value: str = "label") -> DataFrame:
    """A wide table in long form: ``ids``, the column's place from 0 and its value; nulls are left out."""
    long = rows.select(*ids, F.posexplode(F.array(*[F.col(c) for c in columns])).alias(index, value))
    return long.where(F.col(value).isNotNull())
