"""Observations on whether a file's change history is whole. None of them proves anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Fixed value: milliseconds by which a change may be later than the file's last-modified time.
MODIFIED_MS = 60_000
TEXT_TAGS = ["ins", "del", "moveFrom", "moveTo"]


def id_decreases(revisions: DataFrame) -> DataFrame:
    """doc_id, numbered, decreases: how often numeric ids get smaller in document order. revisions: doc_id, seq, id."""
    rows = revisions.withColumn("number", F.expr("try_cast(id as double)")).where("number is not null and not isnan(number)")
    before = F.lag("number").over(W.partitionBy("doc_id").orderBy("seq"))
    return rows.withColumn("less", (F.col("number") < before).cast("int")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("numbered"), F.coalesce(F.sum("less"), F.lit(0)).alias("decreases"))


def duplicate_ids(revisions: DataFrame) -> DataFrame:
    """doc_id, revisions, duplicated: how many ids occur more than once."""
    return revisions.groupBy("doc_id", "id").count().groupBy("doc_id").agg(F.sum("count").alias("revisions"), F.count_if(F.col("count") > 1).alias("duplicated"))


def reversed_deletions(segments: DataFrame) -> DataFrame:
    """doc_id, both, reversed: segments with a dated insertion and deletion, and those whose deletion is the earlier one."""
    return segments.where("ins.ts is not null and del.ts is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("both"), F.count_if(F.col("del.ts") < F.col("ins.ts")).alias("reversed"))


def _instant(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def check(facts: DataFrame, segments: DataFrame, now: Column) -> DataFrame:
    """doc_id, item, observed (null: nothing to go by) and details, nine rows a file. facts as from the file source; now: a timestamp."""
    f = facts.withColumns({"created_ms": _instant(F.col("created")), "modified_ms": _instant(F.col("modified")), "elements": F.col("revisions"), "revisions_n": F.size("revisions")}).drop("revisions")
    revs = f.select("doc_id", "created_ms", "modified_ms", F.inline("elements")).withColumns({"at": _instant(F.col("date")), "is_text": F.col("tag").isin(TEXT_TAGS)})
    n = lambda cond: F.count_if(cond)
    some = F.col("at").isNotNull()
    counts = revs.groupBy("doc_id").agg(
        n(F.col("is_text")).alias("text_revisions"), n(F.col("is_text") & F.col("date").isNull()).alias("undated_text"), n(F.col("is_text") & (F.coalesce("author", F.lit("")) == "")).alias("anonymous"),
        F.count_distinct(F.when(F.col("is_text") & (F.col("author") != ""), F.col("author"))).alias("authors"), n(some).alias("dates"), n(F.col("at") > F.unix_millis(now) + DAY_MS).alias("after_now"),
        n(F.col("at") > F.col("modified_ms") + MODIFIED_MS).alias("after_modified"), n(F.col("at") < F.col("created_ms") - DAY_MS).alias("before_created"),
    )
    rows = f.join(counts, "doc_id", "left").join(duplicate_ids(revs), "doc_id", "left").join(id_decreases(revs), "doc_id", "left").join(reversed_deletions(segments), "doc_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    listed = F.array_distinct(F.concat("listed_rsids", F.when(F.col("rsid_root").isNotNull(), F.array("rsid_root")).otherwise(F.array().cast("array<string>"))))
    unlisted = F.size(F.array_except("used_rsids", listed))
    have = (F.size(listed) > 0) & (F.size("used_rsids") > 0)

    def item(key: str, known: Column, seen: Column, **details: Column) -> Column:
        pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
        return F.struct(F.lit(key).alias("item"), F.when(known, seen).alias("observed"), F.create_map(*pairs).alias("details"))

    removes = F.col("remove_personal_information") | F.col("remove_date_and_time") if "remove_date_and_time" in facts.columns else F.lit(False)
    items = [
        item("settings", F.col("settings_part_found"), ~F.col("track_revisions") | removes, track_revisions=F.col("track_revisions")),
        item("undated", z("text_revisions") > 0, (z("undated_text") > 0) | (z("anonymous") > 0), revisions=z("text_revisions"), undated=z("undated_text"), without_author=z("anonymous"), authors=z("authors")),
        item("duplicateIds", z("revisions_n") > 0, z("duplicated") > 0, duplicated=z("duplicated")),
        item("idOrder", z("numbered") > 1, z("decreases") > 0, decreases=z("decreases")),
        item("futureDates", z("dates") > 0, (z("after_now") > 0) | (z("after_modified") > 0), after_now=z("after_now"), after_modified=z("after_modified")),
        item("beforeCreated", F.col("created_ms").isNotNull() & (z("dates") > 0), z("before_created") > 0, before_created=z("before_created")),
        item("deletedBeforeInserted", z("both") > 0, z("reversed") > 0, both=z("both"), reversed=z("reversed")),
        item("rsids", have, unlisted > 0, listed=F.size(listed), used=F.size("used_rsids"), unlisted=unlisted),
        item("application", F.lit(False), F.lit(False), application=F.col("application"), app_version=F.col("app_version"), total_time=F.col("total_time")),
    ]
    return rows.select("doc_id", F.inline(F.array(*items)))
