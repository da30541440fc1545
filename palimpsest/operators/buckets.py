"""Time buckets: a dense grid of equal widths from a document's first event on, with the running length of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.columns import millis

#: Seconds of the named widths, the widths that "auto" picks from, and the number of buckets it aims at.
NAMED = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
AUTO = [1, 5, 10, 30, 60, 300, 600, 900, 1800, 3600, 10800, 21600, 43200, 86400, 604800, 2592000]
TARGET = 40


def width_seconds(span: Column, width: str | float) -> Column:
    """Seconds of a bucket for a span in seconds."""
    if width != "auto":
        return F.lit(float(NAMED.get(width) or max(1.0, float(width))))
    chosen = F.lit(float(AUTO[-1]))
    for c in reversed(AUTO[:-1]):
        chosen = F.when(F.lit(float(c)) >= span / TARGET, F.lit(float(c))).otherwise(chosen)
    return F.when(span <= 0, F.lit(60.0)).otherwise(chosen)


def bucketed(events: DataFrame, width: str | float = "auto") -> DataFrame:
    """``events`` with start_ms (of the grid), width_ms and bucket (from 0)."""
    w = W.partitionBy("doc_id")
    at = millis(F.col("ts"))
    first, last = F.min(at).over(w), F.max(at).over(w)
    ms = (width_seconds(F.greatest(F.lit(1.0), (last - first) / 1000), width) * 1000).cast("long")
    events = events.withColumns({"start_ms": first, "width_ms": ms})
    return events.withColumn("bucket", F.floor((at - F.col("start_ms")) / F.col("width_ms")).cast("int"))


def buckets(events: DataFrame, width: str | float = "auto", baseline: DataFrame | None = None) -> DataFrame:
    """One row for each document and bucket, empty ones too.

    Counts characters: added and its parts fine, bulk and moved (by ``kind``, where it is there), deleted, and
    total_at_end, the length after the bucket from ``baseline`` (doc_id, baseline) on; it may go under 0. By category:
    added_by_category, a map over the bulk insertions.
    """
    if "kind" not in events.columns:
        events = events.withColumn("kind", F.lit("fine"))
    if "category" not in events.columns:
        events = events.withColumn("category", F.lit(None).cast("string"))
    marked = bucketed(events, width)
    ins = F.col("type") == "ins"
    part = lambda cond: F.sum(F.when(cond, F.col("chars")).otherwise(0)).cast("long")
    sums = marked.groupBy("doc_id", "bucket").agg(part(ins).alias("added"), part(ins & (F.coalesce("kind", F.lit("fine")) == "fine")).alias("fine"), part(ins & (F.col("kind") == "bulk")).alias("bulk"), part(ins & (F.col("kind") == "moved")).alias("moved"), part(F.col("type") == "del").alias("deleted"))
    by_category = marked.where(ins & (F.col("kind") == "bulk")).groupBy("doc_id", "bucket", F.coalesce("category", F.lit("bulk")).alias("category")).agg(F.sum("chars").cast("long").alias("n"))
    by_category = by_category.groupBy("doc_id", "bucket").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("added_by_category"))
    grid = marked.groupBy("doc_id").agg(F.min("start_ms").alias("start_ms"), F.max("width_ms").alias("width_ms"), F.max("bucket").alias("n"))
    grid = grid.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("n")))).drop("n")
    rows = grid.join(sums, ["doc_id", "bucket"], "left").join(by_category, ["doc_id", "bucket"], "left").fillna(0, ["added", "fine", "bulk", "moved", "deleted"])
    if baseline is not None:
        rows = rows.join(baseline.select("doc_id", "baseline"), "doc_id", "left")
    else:
        rows = rows.withColumn("baseline", F.lit(0).cast("long"))
    running = F.sum(F.col("added") - F.col("deleted")).over(W.partitionBy("doc_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("total_at_end", F.coalesce("baseline", F.lit(0)) + running)
    starts = F.timestamp_millis(F.col("start_ms") + F.col("bucket") * F.col("width_ms"))
    return rows.withColumns({"start": starts, "width_seconds": F.col("width_ms") / 1000, "added_by_category": F.coalesce("added_by_category", F.create_map().cast("map<string,bigint>"))}).drop("start_ms", "width_ms", "baseline")


def scale(rows: DataFrame) -> DataFrame:
    """``rows`` of buckets with the largest bar and the largest length of their document."""
    w = W.partitionBy("doc_id")
    return rows.withColumns({"max_bar": F.max(F.greatest("added", "deleted")).over(w), "max_total": F.max("total_at_end").over(w)})
