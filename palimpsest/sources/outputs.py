"""Reports: one JSON document a file, a CSV summary, an archive of submissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.columns import base_name
from palimpsest.operators.snapshots import changed_files


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def analysis_json(windows: DataFrame, highlights: DataFrame, rule_set: str, **more: DataFrame) -> DataFrame:
    """doc_id, json: rules, windows with their levels in order, and highlights of each document, and a list for each table of ``more``."""
    w = windows.withColumns({"start": iso(F.col("start")), "end": iso(F.col("end"))}).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("index", *[c for c in windows.columns if c not in ("doc_id", "index")]))).alias("windows"))
    h = highlights.withColumns({"start": iso(F.col("start")), "end": iso(F.col("end"))}).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("nth", "start", "classifier", "category", "level", "event_ids", "end", "lo", "hi"))).alias("highlights"))
    both = w.join(h, "doc_id", "full")
    if more:
        # a map has no order, so rows are sorted by their JSON; all tables take one shuffle
        lines = reduce(DataFrame.union, [rows.select("doc_id", F.lit(name).alias("name"), F.to_json(F.struct(*[c for c in rows.columns if c != "doc_id"])).alias("line")) for name, rows in more.items()])
        read = lambda kind: lambda x: F.from_json(x, kind)
        listed = lambda name: F.sort_array(F.collect_list(F.when(F.col("name") == name, F.col("line"))))
        both = both.join(lines.groupBy("doc_id").agg(*[F.transform(listed(name), read(rows.drop("doc_id").schema.simpleString())).alias(name) for name, rows in more.items()]), "doc_id", "full")
    return both.select("doc_id", F.to_json(F.struct(F.lit(rule_set).alias("ruleSet"), "windows", "highlights", *more)).alias("json"))


def score_json(doc_scores: DataFrame, top: DataFrame) -> DataFrame:
    """doc_id, json: the score of each document and its most suspicious insertions."""
    t = top.withColumn("at", iso(F.col("ts"))).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "at", "author", "chars", "event_score"))).alias("topSuspiciousEvents"))
    return doc_scores.join(t, "doc_id", "left").select("doc_id", F.to_json(F.struct("score", F.col("risk").alias("riskLevel"), F.col("inserted").alias("totalInsertedChars"), F.col("deleted").alias("totalDeletedChars"), "topSuspiciousEvents")).alias("json"))


def write_summary(rows: DataFrame, path: str) -> None:
    """A CSV with a header, every field quoted."""
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").mode("overwrite").csv(path)


def archive_name(path: Column, n: Column) -> Column:
    """A submission's name in the archive: its own and its number, of two digits or more."""
    digits = n.cast("string")
    return F.concat(base_name(path), F.lit("-s"), F.when(n < 10, F.concat(F.lit("0"), digits)).otherwise(digits), F.lit(".docx"))


def snapshot_key(path: Column, depth: int = 1) -> Column:
    """What submissions of one document have in common: the last ``depth`` folders and the name without extension."""
    parts = F.split(path, r"[/\\]")
    return F.array_join(F.concat(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - depth), F.least(F.lit(depth), F.size(parts) - 1)), F.array(base_name(path))), "/")


def archived(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """What an archive gains: of files (key, arrived, path, sha256) those that differ from the one before, numbered on from ``known`` (key, n, sha256)."""
    if known is None:
        return changed_files(files)
    last = known.groupBy("key").agg(F.max("n").alias("last_n"), F.max_by("sha256", "n").alias("last_sha"))
    by = W.partitionBy("key").orderBy("arrived", "path")
    rows = files.join(last, "key", "left").withColumn("before", F.coalesce(F.lag("sha256").over(by), F.col("last_sha"))).where("before is null or before <> sha256")
    return rows.withColumn("n", F.row_number().over(by) + F.coalesce("last_n", F.lit(0))).drop("before", "last_n", "last_sha")
