"""Mixing sources to target weights with hash-threshold histograms.

Each document has a 60-bit hash of its id. Words are summed by source and hash bucket; the bucket in which a source's
budget runs out is refined by the next hash bits, and only rows of that bucket are looked at again. What is below the
threshold found is taken: a filter, without sorting. Thresholds of several budgets are nested, since the hash is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, missing, small, word_count

#: 4 levels of 15 bits make the 60 bits of the hash: 32,768 buckets a source and level.
LEVELS, BITS = 4, 15


def hash60(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the md5 of the id as text; without an id, of the text itself, null as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def cyclic_weight(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... by rank from 1."""
    return ((rank - 1) % 3 + 1).cast("double")


def source_targets(sizes: DataFrame, weight: Callable[[Column], Column] = cyclic_weight, budget: float = 1.0, most: float = 3.0) -> DataFrame:
    """Targets from (source, source_size): shares of ``budget`` times all sizes by weight, stopped at ``most`` times a source's size.

    Resharing an excess by weight again and again ends where target = min(most * size, level * weight) for one level, so
    the level is found directly: sources in order of the level at which they stop, and the first at which the rest fits.
    One row a source; the windows run over that small table.
    """
    by_name, by_level = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("stops", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    ranked = sizes.withColumn("weight", weight(F.row_number().over(by_name))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ranked = ranked.withColumn("stops", F.col("cap") / F.col("weight"))
    level = (F.lit(float(budget)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    level = F.min(F.when(F.col("level") <= F.col("stops"), F.struct("stops", F.col("source").isNull().alias("last"), "source", "level"))).over(whole)["level"]
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def thresholds(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, edge, keep_edge) for what a source's target needs beyond whole repeats of it.

    slim: source, size, h. plan: source, rest. Take h < edge, and h = edge too if keep_edge: that is nearer to the target.
    """
    state = plan.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("under"), F.lit(0).cast("long").alias("over"))
    state = cut(state)
    for step in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - step)
        s = state.select(F.col("source").alias("s_source"), "rest", F.col("bucket").alias("above"), "under")
        rows = slim.where("size > 0").join(small(s), F.col("source").eqNullSafe(F.col("s_source")) & (F.shiftright("h", shift + BITS) == F.col("above")))
        sums = rows.groupBy("source", "rest", "under", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        so_far = F.col("under") + F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
        sums = sums.withColumn("over", so_far)
        last = F.col("bucket") == F.max("bucket").over(W.partitionBy("source"))  # rounding of the target may ask for a little more than there is
        at = F.min(F.when((F.col("over") >= F.col("rest")) | F.col("last"), F.struct("bucket", (F.col("over") - F.col("words")).alias("under"), "over")))
        state = cut(sums.withColumn("last", last).groupBy("source", "rest").agg(at.alias("at")).select("source", "rest", "at.*"))
    return state.select("source", F.col("bucket").alias("edge"), (F.col("over") - F.col("rest") <= F.col("rest") - F.col("under")).alias("keep_edge"))


def plan_of(slim: DataFrame, *, weight: Callable[[Column], Column] = cyclic_weight, budget: float = 1.0, most: float = 3.0) -> DataFrame:
    """A row a source: mix_source, source_size, target, whole, edge, keep_edge. slim: source, size, h."""
    plan = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weight, budget, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = cut(plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    edges = thresholds(slim, plan).withColumnRenamed("source", "e_source")
    plan = plan.join(edges, F.col("source").eqNullSafe(F.col("e_source")), "left").withColumnRenamed("source", "mix_source")
    return cut(plan.select("mix_source", "source_size", "target", "whole", "edge", "keep_edge"))


def repeats_of(h: Column, whole: Column, edge: Column, keep_edge: Column) -> Column:
    """How often a row is taken, by its hash and the thresholds of its source."""
    return whole + F.coalesce((h < edge) | ((h == edge) & keep_edge), F.lit(False)).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """How often each document goes into the mix. Options: weight, budget, most, as in ``source_targets``.

    Reads doc_id, text and source; returns doc_id, source, size (words), source_size, target, repeats and taken, a row for
    each row of ``docs``. A source whose target is t times its size gives floor(t) copies of each document, and one more of
    those under its threshold, so no document is taken more than ceil(most) times. Sources differ from their targets by
    half of what is taken or left together at most: a document, or the rows that share its id.

    Null or empty text: size 0, taken 0. Null source: a source of its own, last in order. Null doc_id: hashed by its text.
    Rows with the same doc_id are taken alike, and so are those without one that have the same text. No rows: no rows.
    Other columns aren't read.
    """
    missing(docs, "doc_id", "text", "source")
    slim = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("h")))
    rows = slim.join(small(plan_of(slim, **options)), F.col("source").eqNullSafe(F.col("mix_source")))
    rows = rows.withColumn("repeats", repeats_of(*[F.col(c) for c in ("h", "whole", "edge", "keep_edge")]))
    return rows.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def take(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as ``mix`` says, 0 times too: a filter on the row's own hash, nothing but numbers is shuffled.

    Odd rows as in ``mix``. All columns stay, whatever they are called.
    """
    missing(docs, "doc_id", "text", "source")
    h = hash60(docs["doc_id"], docs["text"])
    slim = cut(docs.select(docs["source"], word_count(docs["text"]).alias("size"), h.alias("h")))
    plan = plan_of(slim, **options)
    plan = small(plan.select(*[F.col(c).alias(f"__mix_{c}") for c in ("mix_source", "whole", "edge", "keep_edge")]))
    times = repeats_of(h, *[F.col(f"__mix_{c}") for c in ("whole", "edge", "keep_edge")])
    rows = docs.join(plan, docs["source"].eqNullSafe(F.col("__mix_mix_source"))).withColumn("__mix_times", times).where("__mix_times > 0")
    return rows.withColumn("__mix_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
