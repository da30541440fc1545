"""Suspicion scores: how far insertions are from typing, by their size and by the speed that they imply."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.columns import clamped, millis, rounded, scaled


@dataclasses.dataclass(frozen=True)
class ScoreOptions:
    """The defaults of the score."""

    least_chars: int = 20
    burst_low: float = 20
    burst_high: float = 300
    rate_low: float = 8
    rate_high: float = 40
    max_weight: float = 0.6


def risk(score: Column) -> Column:
    return F.when(score >= 75, "very_high").when(score >= 45, "high").when(score >= 20, "medium").otherwise("low")


def event_scores(events: DataFrame, options: ScoreOptions = ScoreOptions()) -> DataFrame:
    """Each insertion with index (from 0 in its document), dt_seconds, implied_cps, burst_score, rate_score and event_score."""
    w = W.partitionBy("doc_id").orderBy("ts", "seq")
    ins = events.where("type = 'ins'")
    dt = F.greatest(F.lit(1.0), (millis(F.col("ts")) - millis(F.lag("ts").over(w))) / 1000)
    dt = F.when(F.lag("ts").over(w).isNotNull(), dt)
    ins = ins.withColumns({"index": F.row_number().over(w) - 1, "dt_seconds": dt})
    ins = ins.withColumn("implied_cps", F.col("chars") / F.col("dt_seconds"))
    enough = F.col("chars") >= options.least_chars
    burst = F.when(enough, scaled(F.col("chars"), options.burst_low, options.burst_high)).otherwise(0.0)
    rate = F.when(enough & F.col("implied_cps").isNotNull(), scaled(F.col("implied_cps"), options.rate_low, options.rate_high)).otherwise(0.0)
    return ins.withColumns({"burst_score": rounded(burst, 1), "rate_score": rounded(rate, 1), "event_score": rounded(F.greatest(burst, rate), 1)})


def document_scores(events: DataFrame, options: ScoreOptions = ScoreOptions()) -> DataFrame:
    """score (0 to 100), risk and totals of each document; 0 and low without insertions."""
    scored = event_scores(events, options).groupBy("doc_id").agg(F.max("event_score").alias("__max"), (F.sum(F.col("event_score") * F.col("chars")) / F.greatest(F.lit(1), F.sum("chars"))).alias("__mean"))
    chars = lambda kind: F.sum(F.when(F.col("type") == kind, F.col("chars")).otherwise(0)).cast("long")
    totals = events.groupBy("doc_id").agg(chars("ins").alias("inserted"), chars("del").alias("deleted"), F.count_if(F.col("type") == "ins").alias("insertions"))
    raw = options.max_weight * F.col("__max") + (1 - options.max_weight) * F.col("__mean")
    rows = totals.join(scored, "doc_id", "left").withColumn("score", F.coalesce(rounded(clamped(raw, 0, 100)), F.lit(0.0)).cast("long"))
    return rows.withColumns({"risk": risk(F.col("score")), "few_events": F.col("insertions") < 5}).drop("__max", "__mean")


def top_events(scores: DataFrame, n: int = 5) -> DataFrame:
    """The n insertions of each document with the highest scores, without those of score 0; of equal ones the earlier."""
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("event_score").desc(), "index"))
    return scores.withColumn("rank", rank).where((F.col("rank") <= n) & (F.col("event_score") > 0))
