"""Submissions of one document over time: what each brings that no earlier one had, and what of it is dated too early."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.columns import key, millis

#: Fixed value: a change counts as dated too early if it is so many milliseconds before the last one known.
TOLERANCE_MS = 60_000


def event_key(df: DataFrame) -> DataFrame:
    """``df`` with ``event_key``: what makes a change the same change in another submission."""
    return df.withColumn("event_key", key(F.col("type"), F.col("author"), millis(F.col("ts")), F.col("text")))


def new_events(events: DataFrame) -> DataFrame:
    """``events`` (key, n, seq, ...) with ``is_new``: the k-th occurrence of a change in a submission is new if no earlier one had k."""
    events = event_key(events)
    events = events.withColumn("__k", F.row_number().over(W.partitionBy("key", "n", "event_key").orderBy("seq")))
    first = F.min("n").over(W.partitionBy("key", "event_key", "__k"))
    return events.withColumn("is_new", F.col("n") == first).drop("__k")


def deltas(events: DataFrame) -> DataFrame:
    """One row for each submission: new and carried changes, characters, new ones dated before the last known change."""
    marked = events if "is_new" in events.columns else new_events(events)
    new = F.col("is_new")
    chars = lambda kind: F.sum(F.when(new & (F.col("type") == kind), F.col("chars")).otherwise(0)).cast("long")
    at = millis(F.col("ts"))
    rows = marked.groupBy("key", "n").agg(F.count_if(new).alias("new_events"), F.count_if(~new).alias("carried_events"), chars("ins").alias("inserted"), chars("del").alias("deleted"), F.min(F.when(new, at)).alias("__first"), F.max(F.when(new, at)).alias("__last"))
    earlier = W.partitionBy("key").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("previous_last_ms", F.max("__last").over(earlier))
    late = marked.where("is_new").join(rows.select("key", "n", "previous_last_ms"), ["key", "n"]).where(at < F.col("previous_last_ms") - TOLERANCE_MS).groupBy("key", "n").agg(F.count(F.lit(1)).alias("dated_before_previous"))
    return rows.join(late, ["key", "n"], "left").fillna(0, ["dated_before_previous"])


def sessions(delta_rows: DataFrame) -> DataFrame:
    """Submissions with new changes as sessions: start, end and the gap to the one before, never under 0."""
    rows = delta_rows.where("new_events > 0")
    gap = (F.col("__first") - F.lag("__last").over(W.partitionBy("key").orderBy("n"))) / 3_600_000
    return rows.withColumn("gap_before_hours", F.greatest(F.lit(0.0), gap)).withColumn("gap_before_hours", F.when(gap.isNotNull(), F.col("gap_before_hours"))).select("key", "n", F.timestamp_millis("__first").alias("start"), F.timestamp_millis("__last").alias("end"), "gap_before_hours", "new_events", "inserted", "deleted")


def late_evidence(delta_rows: DataFrame) -> DataFrame:
    """key, n, evidence (datedBeforePrevious) with its details, for submissions that bring changes dated too early."""
    return delta_rows.where("dated_before_previous > 0").select("key", "n", F.lit("datedBeforePrevious").alias("evidence"), F.create_map(F.lit("changes"), F.col("dated_before_previous").cast("string"), F.lit("previousLastChange"), F.date_format(F.timestamp_millis("previous_last_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("details"))


def changed_files(files: DataFrame) -> DataFrame:
    """Of each key's files (key, arrived, sha256) those that differ from the one before, numbered from 1: what an archive keeps."""
    by = W.partitionBy("key").orderBy("arrived", "path")
    rows = files.withColumn("__before", F.lag("sha256").over(by)).where("__before is null or __before <> sha256").drop("__before")
    return rows.withColumn("n", F.row_number().over(by))
