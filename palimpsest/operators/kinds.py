"""Kinds of insertions: moved (the same text was deleted in the document), bulk (much at one time by one author) or fine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.containment import with_contained

#: Fixed value: characters from which insertions of one author and time count as bulk.
BULK_CHARS = 150


def with_moved(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``events`` with ``moved``: insertions whose text is among the document's deletions, one after the other."""
    return with_contained(events, events.where("type = 'del'"), "moved", ["doc_id"], order or ["ts", "seq"], looked_for=F.col("type") == "ins")


def with_kinds(events: DataFrame, bulk_chars: int = BULK_CHARS) -> DataFrame:
    """``events`` with ``kind``; null for deletions. Reads doc_id, type, author, ts, chars and text; or ``moved`` in text's place."""
    if "moved" not in events.columns:
        events = with_moved(events)
    fine = (F.col("type") == "ins") & ~F.col("moved")
    group = F.sum(F.when(fine, F.col("chars")).otherwise(0)).over(W.partitionBy("doc_id", F.coalesce("author", F.lit("")), "ts"))
    kind = F.when(F.col("type") != "ins", None).when(F.col("moved"), "moved").when(group >= bulk_chars, "bulk").otherwise("fine")
    return events.withColumn("kind", kind)


def with_levels(events: DataFrame, levels: DataFrame) -> DataFrame:
    """``events`` with kind, level and category from the levels of windows; levels: doc_id, rev_id, level, category."""
    if "moved" not in events.columns:
        events = with_moved(events)
    levels = levels.select("doc_id", "rev_id", F.col("level").alias("__level"), F.col("category").alias("__category"))
    events = events.join(levels, ["doc_id", "rev_id"], "left")
    ins = F.col("type") == "ins"
    hit = ins & ~F.col("moved") & F.col("__level").isNotNull()
    kind = F.when(~ins, None).when(F.col("moved"), "moved").when(hit, "bulk").otherwise("fine")
    return events.withColumns({"kind": kind, "level": F.when(hit, F.col("__level")), "category": F.when(hit, F.coalesce("__category", F.concat(F.lit("level:"), F.col("__level"))))}).drop("__level", "__category")
