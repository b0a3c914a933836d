"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.sources.readers import read_batches

_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite", null: str = "") -> None:
    """CSV with a header and without any index column; nothing is trimmed. ``null`` is how null is written; give a mark that no
    field holds, and the same to the reader, to tell null from empty."""
    rows.write.mode(mode).options(**_CSV, nullValue=null).csv(path)


def write_batches(rows: DataFrame, path: str, batch: str = "batch_file", null: str = "") -> None:
    """CSV files in a folder for each value of ``batch``."""
    rows.write.mode("overwrite").options(**_CSV, nullValue=null).partitionBy(batch).csv(path)


def load_batches(spark: SparkSession, pattern: str, schema: str, target: str, index: bool = True, null: str = "") -> None:
    """Batch files of a glob, read as one scan, with ``word`` in lower case, appended to a parquet table at once."""
    append_parquet(read_batches(spark, pattern, schema, index, null).withColumn("word", F.lower("word")), target)


def append_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_table(rows: DataFrame, name: str) -> None:
    rows.write.mode("append").saveAsTable(name)


def append_sql(rows: DataFrame, url: str, name: str, properties: dict[str, str] | None = None) -> None:
    """Append to a database table, which is made if it is missing."""
    rows.write.mode("append").jdbc(url, name, properties=properties or {})
