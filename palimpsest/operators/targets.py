"""Addressable parts of figures, with excerpts, sections, links and the notes that users attach to them."""

from __future__ import annotations

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.columns import excerpt, safe_href
from palimpsest.sources.adapters import spread

#: Tasks that the parts of one key are dealt to.
SHARES = 16


def bucket_targets(buckets: DataFrame) -> DataFrame:
    """doc_id, key, bucket, value of the parts of a chart: the bars of what was added, bulk and deleted, and the line."""
    part = lambda kind, column: F.struct(F.concat_ws(":", F.lit("chart"), F.lit("line" if kind == "total" else "bar"), F.lit(kind), F.col("bucket")).alias("key"), F.col(column).cast("long").alias("value"))
    rows = buckets.select("doc_id", "bucket", F.inline(F.array(part("fine", "fine"), part("bulk", "bulk"), part("moved", "moved"), part("deleted", "deleted"), part("total", "total_at_end"))))
    return rows.where("value <> 0 or key like 'chart:line:%'")


def flow_targets(units: DataFrame) -> DataFrame:
    """doc_id, key, session, unit, first_para: a part for each unit of each session."""
    return units.select("doc_id", F.concat_ws(":", F.lit("flow"), F.col("session"), F.col("unit")).alias("key"), "session", "unit", F.get("paras", F.lit(0)).alias("first_para"))


def sections(paragraphs: DataFrame) -> DataFrame:
    """doc_id, para_index, section, bookmark: the last heading and bookmark at or before each paragraph.

    paragraphs: doc_id, para_index, heading (its text, or null), bookmark (or null).
    """
    w = W.partitionBy("doc_id").orderBy("para_index").rowsBetween(W.unboundedPreceding, 0)
    return paragraphs.select("doc_id", "para_index", F.last("heading", ignorenulls=True).over(w).alias("section"), F.last("bookmark", ignorenulls=True).over(w).alias("bookmark"))


def document_link(base: Column, bookmark: Column) -> Column:
    """A link into a document, to a bookmark if there is one."""
    return F.when(bookmark.isNull(), base).otherwise(F.concat(base, F.lit("#"), F.url_encode(bookmark)))


def enriched(targets: DataFrame, section_rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``targets`` (first_para) with excerpt, section and bookmark. texts: doc_id, para_index, text."""
    rows = targets.join(section_rows.withColumnRenamed("para_index", "first_para"), ["doc_id", "first_para"], "left")
    return rows.join(texts.select("doc_id", F.col("para_index").alias("first_para"), excerpt(F.col("text")).alias("excerpt")), ["doc_id", "first_para"], "left")


def annotated(targets: DataFrame, notes: DataFrame) -> DataFrame:
    """``targets`` with tooltip (those of all notes of a part, a line each) and href (the first safe one). notes: nth, target, tooltip, href."""
    lines = F.transform(F.sort_array(F.collect_list(F.when(F.col("tooltip").isNotNull(), F.struct("nth", "tooltip")))), lambda x: x["tooltip"])
    by_part = notes.withColumn("safe", safe_href(F.col("href"))).groupBy(F.col("target").alias("key")).agg(F.array_join(lines, "\n").alias("tooltip"), F.min_by("safe", F.when(F.col("safe").isNotNull(), F.col("nth"))).alias("href"))
    # few keys stand for most parts: each key's parts are dealt to SHARES tasks by a hash, and its notes go to all of these
    share = F.pmod(F.xxhash64(*[c for c, kind in targets.dtypes if "map<" not in kind]), F.lit(SHARES)).cast("int").alias("__share")
    parts = targets.select("*", share).repartition(spread(targets.sparkSession), "key", "__share")
    by_part = by_part.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return parts.join(by_part, ["key", "__share"], "left").drop("__share")


NOTES = "nth int, target string, tooltip string, href string"


def notes_of(text: str) -> list[tuple]:
    """Rows of NOTES from an annotation file: YAML or JSON, a list of target, tooltip and href, alone or as ``annotations``."""
    found = yaml.safe_load(text)
    found = found.get("annotations") if isinstance(found, dict) else found
    if not isinstance(found, list):
        raise ValueError("annotations must be a list")
    for k, x in enumerate(found):
        if not isinstance(x, dict) or not isinstance(x.get("target"), str):
            raise ValueError(f"annotation {k}: no target")
    return [(k, x["target"], None if x.get("tooltip") is None else str(x["tooltip"]), None if x.get("href") is None else str(x["href"])) for k, x in enumerate(found)]
