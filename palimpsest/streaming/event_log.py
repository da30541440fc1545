"""A log of events that batches are appended to, numbered by record without holes, each batch once.

A batch is a claimed entry (``sources.archive``): one that is sent again finds its own entry and adds nothing; one that broke off
before its entry has added nothing, whatever it had written. Writers that append at once number their rows anew if another was first.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.sources import archive

ROWS, HEADS = "_rows", "_heads"


def _batches(root: str) -> list[tuple[str, str]]:
    """(batch, table) of the entries, in order."""
    return [tuple(e.split("\n", 1)) for e in archive.entries(root)]


def heads(spark: SparkSession, root: str) -> DataFrame:
    """record, seq: each record's last number."""
    root = archive.full_uri(spark, root)
    tables = [t for _, t in _batches(root)]
    if not tables:
        return spark.createDataFrame([], "record string, seq long")
    return spark.read.schema("record string, seq long").parquet(*[f"{root}/{HEADS}/{t}" for t in tables]).groupBy("record").agg(F.max("seq").alias("seq"))


def append(events: DataFrame, root: str, batch: str, order: list[str]) -> bool:
    """Appends ``events`` (record, ...) as one batch; False if the batch is there already. Numbers go on by record, in ``order``.

    As a sink of a stream: ``foreachBatch(lambda rows, n: append(rows, root, f"comments-{n}", ["at", "key"]))``.
    """
    spark = events.sparkSession
    root = archive.full_uri(spark, root)
    if "\n" in batch:
        raise ValueError("a batch's name is one line")
    for attempt in range(archive.TRIES):
        known = _batches(root)
        if any(b == batch for b, _ in known):
            return False
        table = f"{uuid.uuid4().hex}-{attempt}"
        nth = F.row_number().over(W.partitionBy("record").orderBy(*order)) + F.coalesce("__last", F.lit(0))
        rows = events.join(heads(spark, root).withColumnRenamed("seq", "__last"), "record", "left").withColumn("seq", nth.cast("long")).drop("__last")
        rows.write.parquet(f"{root}/{ROWS}/{table}")
        spark.read.parquet(f"{root}/{ROWS}/{table}").groupBy("record").agg(F.max("seq").alias("seq")).write.parquet(f"{root}/{HEADS}/{table}")
        if archive.claim(spark, root, len(known), f"{batch}\n{table}"):
            return True
        time.sleep(archive.WAIT * (int(table[:4], 16) % 97) / 97)
    raise RuntimeError(f"{root}: others were first {archive.TRIES} times")


def read(spark: SparkSession, root: str) -> DataFrame | None:
    """All rows with their numbers; None if nothing was ever appended."""
    root = archive.full_uri(spark, root)
    tables = [t for _, t in _batches(root)]
    return spark.read.option("mergeSchema", "true").parquet(*[f"{root}/{ROWS}/{t}" for t in tables]) if tables else None
