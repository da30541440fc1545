"""Helpers shared by the corpus operators: shared scratch space, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are none of the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table that may be broadcast when their number has been counted and each row is a few numbers or a short key.
BROADCAST_ROWS = 1_000_000
#: Bytes of texts in a table that may be broadcast.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder of our own if all runs on this machine; on a cluster that raises, since each
    executor would write to a disk of its own.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the rows go to the shared folder and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes the rows as a columnar table in the shared folder, and reads them from there: later steps read only the columns they need."""
    path = shared_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, *texts: str) -> DataFrame:
    """Broadcast if the counted rows are within the bound, and the bytes of the columns ``texts`` within BROADCAST_BYTES; else a
    shuffled join does it. Give it tables that are cheap to count; columns of any length must be named."""
    if texts:
        size = F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts), F.lit(0)))
        found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(size, F.lit(0)).alias("size")).first()
        return F.broadcast(df) if found.n <= rows and found.size <= BROADCAST_BYTES else df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_short_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``; the session hands at most so many rows at once to Python from now on: a batch of whole texts is held twice."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def missing(df: DataFrame, *names: str) -> None:
    """Raises if a column that the operator reads isn't there."""
    if lost := [n for n in names if n not in df.columns]:
        raise ValueError(f"no column {', '.join(lost)}; there are {', '.join(df.columns)}")
