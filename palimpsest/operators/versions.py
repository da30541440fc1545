"""Points in time at which a document's versions are made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.columns import millis
from palimpsest.operators.sessions import HOUR_MS


def version_points(events: DataFrame, at: DataFrame | None = None, every_seconds: float | None = None, session_hours: float | None = None) -> DataFrame:
    """doc_id, at_ms, label, changes (dated up to there) in order of time; of equal times the first label stays.

    at: doc_id, at. Labels: at, initial (just before the first change, if every or session are asked for), every (the end of
    each step with changes in it, not beyond the last change) and session (the last change before a longer gap, or at all).
    """
    dated = events.where("ts is not null").select("doc_id", millis(F.col("ts")).alias("t"))
    ends = dated.groupBy("doc_id").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    parts = []
    if at is not None:
        parts.append(at.select("doc_id", millis(F.col("at")).alias("at_ms"), F.lit("at").alias("label"), F.lit(0).alias("__rank")))
    if every_seconds is not None or session_hours is not None:
        parts.append(ends.select("doc_id", (F.col("first") - 1).alias("at_ms"), F.lit("initial").alias("label"), F.lit(1).alias("__rank")))
    if every_seconds is not None:
        step = int(every_seconds * 1000)
        k = F.greatest(F.lit(1), F.ceil((F.col("t") - F.col("first")) / step))
        rows = dated.join(ends, "doc_id").select("doc_id", F.least(F.col("first") + k * step, F.col("last")).cast("long").alias("at_ms")).distinct()
        parts.append(rows.select("doc_id", "at_ms", F.lit("every").alias("label"), F.lit(2).alias("__rank")))
    if session_hours is not None:
        following = F.lead("t").over(W.partitionBy("doc_id").orderBy("t"))
        rows = dated.withColumn("__next", following).where(F.col("__next").isNull() | (F.col("__next") - F.col("t") > max(0.0, session_hours) * HOUR_MS))
        parts.append(rows.select("doc_id", F.col("t").alias("at_ms"), F.lit("session").alias("label"), F.lit(3).alias("__rank")).distinct())
    if not parts:
        raise ValueError("no points are asked for")
    rows = reduce(DataFrame.unionByName, parts)
    first = W.partitionBy("doc_id", "at_ms").orderBy("__rank")
    rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("doc_id", "at_ms", "label")
    return changes_up_to(rows, dated)


def changes_up_to(points: DataFrame, dated: DataFrame) -> DataFrame:
    """``points`` (doc_id, at_ms, ...) with the number of changes (doc_id, t) up to each: one sorted pass over both, no join of ranges."""
    both = points.withColumns({"__t": F.col("at_ms"), "__point": F.lit(1)}).unionByName(dated.select("doc_id", F.col("t").alias("__t"), F.lit(0).alias("__point")), allowMissingColumns=True)
    upto = W.partitionBy("doc_id").orderBy("__t", "__point").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("changes", F.sum(1 - F.col("__point")).over(upto)).where("__point = 1").drop("__t", "__point")
