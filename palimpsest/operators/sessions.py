"""Gap sessions: a session ends where the next event comes more than a threshold later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.columns import millis

HOUR_MS = 3_600_000


def with_session(events: DataFrame, hours: float, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``events`` with ``session`` (from 0 in each key) and ``gap_before_hours`` (on the first event of all but the first).

    A gap equal to the threshold doesn't end a session; a threshold under 0 counts as 0. Events of equal time keep the order ``seq``.
    """
    keys = keys or ["doc_id"]
    w = W.partitionBy(*keys).orderBy(*(order or ["ts", "seq"]))
    gap = millis(F.col("ts")) - millis(F.lag("ts").over(w))
    events = events.withColumn("__gap", gap)
    first = F.col("__gap") > F.lit(max(0.0, float(hours)) * HOUR_MS)
    events = events.withColumn("session", F.sum(F.coalesce(first.cast("int"), F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return events.withColumn("gap_before_hours", F.when(first, F.col("__gap") / HOUR_MS)).drop("__gap")


def summaries(sessions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row a session: times, counts, inserted and deleted characters, the gap before it."""
    keys = keys or ["doc_id"]
    chars = lambda kind: F.sum(F.when(F.col("type") == kind, F.col("chars")).otherwise(0))
    return sessions.groupBy(*keys, "session").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("events"),
        chars("ins").alias("inserted"), chars("del").alias("deleted"), F.max("gap_before_hours").alias("gap_before_hours"),
    )


def totals(events: DataFrame, final_chars: Column | None = None) -> DataFrame:
    """Inserted and deleted characters and event counts of each document; with ``final_chars`` also the baseline, never under 0."""
    chars = lambda kind: F.sum(F.when(F.col("type") == kind, F.col("chars")).otherwise(0))
    n = lambda kind: F.count_if(F.col("type") == kind)
    out = events.groupBy("doc_id").agg(chars("ins").alias("inserted"), chars("del").alias("deleted"), n("ins").alias("insertions"), n("del").alias("deletions"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    if final_chars is not None:
        out = out.withColumn("baseline", F.greatest(F.lit(0), final_chars - F.col("inserted") + F.col("deleted")))
    return out
