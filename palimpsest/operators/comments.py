"""Review comments over time: what changed between the known state and a new version, and the state from the record of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The author that receipts are written under.
RECEIPT_AUTHOR = "palimpsest"
EVENT = ["doc_id", "seq", "at", "type", "key", "sha256", "text", "done"]


def is_receipt(author: str = "author") -> F.Column:
    return F.coalesce(F.col(author) == RECEIPT_AUTHOR, F.lit(False))


def diff(state: DataFrame, comments: DataFrame, versions: DataFrame) -> DataFrame:
    """The events (without seq) that lead from ``state`` to ``comments``: seen, reappeared or edited, resolved or reopened, removed.

    state: doc_id, key, text, done, present. comments: doc_id, nth, key, author, text, done. versions: doc_id, at, sha256 of
    the new version. Receipts aren't comments; of equal keys the first counts. ``nth`` gives the order of a version's events.
    """
    first = W.partitionBy("doc_id", "key").orderBy("nth")
    c = comments.where(~is_receipt()).withColumn("__k", F.row_number().over(first)).where("__k = 1").select("doc_id", "key", "nth", F.col("text").alias("c_text"), F.col("done").alias("c_done"))
    s = state.select("doc_id", "key", F.col("text").alias("s_text"), F.col("done").alias("s_done"), "present")
    both = s.join(c, ["doc_id", "key"], "full").join(versions, "doc_id")
    here, known = F.col("nth").isNotNull(), F.col("present").isNotNull()
    whole = F.when(here & ~known, "seen").when(here & ~F.col("present"), "reappeared").when(here & (F.col("s_text") != F.col("c_text")), "edited").when(~here & F.col("present"), "removed")
    mark = F.when(here & known & (F.col("s_done") != F.col("c_done")), F.when(F.col("c_done"), "resolved").otherwise("reopened"))
    rows = both.withColumn("type", F.explode(F.filter(F.array(whole, mark), lambda t: t.isNotNull())))
    carries = F.col("type").isin("seen", "reappeared", "edited")
    return rows.select("doc_id", "at", "type", "key", "sha256", F.when(carries, F.col("c_text")).alias("text"), F.when(carries, F.col("c_done")).alias("done"), F.coalesce("nth", F.lit(2**31 - 1)).alias("nth"))


def numbered(events: DataFrame, last_seq: DataFrame | None = None) -> DataFrame:
    """``events`` with seq: going on from the last number of each document (doc_id, last_seq)."""
    order = W.partitionBy("doc_id").orderBy("at", "nth", F.col("type").isin("resolved", "reopened"), "key")
    rows = events.withColumn("seq", F.row_number().over(order).cast("long"))
    if last_seq is not None:
        rows = rows.join(last_seq, "doc_id", "left").withColumn("seq", F.col("seq") + F.coalesce("last_seq", F.lit(0))).drop("last_seq")
    return rows.drop("nth")


def replay(events: DataFrame) -> DataFrame:
    """The state of each comment: doc_id, key, seq (of the first sight), first_seen, text, done, present, removed_at, receipt_at.

    What an event sets is the last value set at or before the end: no loop over events, just the latest by seq. Events
    before a comment was seen have no effect.
    """
    seen = F.min(F.when(F.col("type") == "seen", F.col("seq"))).over(W.partitionBy("doc_id", "key"))
    rows = events.withColumn("__from", seen).where(F.col("seq") >= F.col("__from"))
    latest = lambda value, *types: F.max_by(value, F.when(F.col("type").isin(*types), F.col("seq")))
    done = F.when(F.col("type") == "resolved", True).when(F.col("type") == "reopened", False).otherwise(F.col("done"))
    whole = ("seen", "edited", "reappeared")
    out = rows.groupBy("doc_id", "key").agg(
        F.max(F.when(F.col("type") == "seen", F.col("seq"))).alias("seq"), latest(F.col("at"), "seen").alias("first_seen"), latest(F.col("text"), *whole).alias("text"),
        latest(done, *whole, "resolved", "reopened").alias("done"), latest(F.col("type") != "removed", *whole, "removed").alias("present"),
        latest(F.col("at"), "removed").alias("removed_at"), latest(F.col("at"), "receipt").alias("receipt_at"),
    )
    return out.withColumn("removed_at", F.when(~F.col("present"), F.col("removed_at")))
