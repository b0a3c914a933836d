"""What operators need from the session: table paths, the shared folder, partition counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory; a file or a directory of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rostrum-checkpoint-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, as Spark's readers and writers take it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """A number of partitions for work that Python workers do: two waves of all cores at least."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that they need no copy of the repository.

    The archive goes through Spark's own file server; where workers can import the package already, it does no harm.
    """
    sc = spark.sparkContext
    if getattr(sc, "_rostrum_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="rostrum-code-")) / "rostrum_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._rostrum_shipped = True


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where a scan of few and small files would leave most of them idle.

    Decided from the files' number and the planner's estimate of their size, without running anything. A large input
    comes in more splits than there are cores and passes as it is, without a shuffle; so does what is not read from files.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = rows.inputFiles()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    small = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * split
    return rows.repartition(2 * cores) if 0 < len(files) < cores and small else rows
