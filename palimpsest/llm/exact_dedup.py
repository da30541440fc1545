"""Exact duplicates by an extendible-hash index on shared files.

The key of a text is a 64-bit hash. A bucket is a prefix of it; the directory has a slot for each prefix of the global depth
and says which bucket owns it. Buckets with more keys than the capacity are split, which doubles the directory when one of
them is as deep as it is. The texts go to the owner of their bucket, a task that has whole buckets, that is ranges of keys.
It compares those of one key byte by byte and chains what differs: an entry for each text, with how many rows have it and
the largest id. What is said of a row is read from the entry that the directory, the key and, in a chain, the bytes lead to.

Keys of many rows are summed up within each task before; of those there are few, by a bound on their number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, missing, small, stored

#: Keys in a bucket, at least: more where the directory would get more than SLOTS slots otherwise.
CAPACITY = 1 << 12
#: Deeper than this a bucket isn't split; it just holds a longer list.
DEEPEST = 40
#: Rows of a key from which it is popular, at least; and popular keys, at most: with n rows, n / MOST_POPULAR have a key then.
POPULAR, MOST_POPULAR = 100, 500_000
#: Slots of a directory that may be broadcast: three numbers each.
SLOTS = 4_000_000


def hash_key(text: Column) -> Column:
    return F.xxhash64(text)


def prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth)


def directory(keys: DataFrame, n_keys: int, capacity: int) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) with a row for each slot, and the global depth. keys: key, each once.

    It starts at the depth at which buckets are about full; only keys of overfull buckets are counted again, one bit deeper.
    The directory has about 2 * n_keys / capacity slots.
    """
    depth = max(1, math.ceil(math.log2(max(1, n_keys) / capacity))) if n_keys else 1
    buckets, rest = None, keys
    while True:
        sizes = cut(rest.groupBy(prefix(F.col("key"), depth).alias("prefix")).count())
        full = sizes.where(F.col("count") > capacity)
        deepest = depth >= DEEPEST or full.isEmpty()
        here = (sizes if deepest else sizes.where(F.col("count") <= capacity)).select("prefix", F.lit(depth).alias("local_depth"))
        buckets = here if buckets is None else buckets.unionByName(here)
        if deepest:
            break
        rest = rest.withColumn("prefix", prefix(F.col("key"), depth)).join(small(full.select("prefix")), "prefix", "left_semi").select("key")
        depth += 1
    slots = F.expr(f"sequence(0L, shiftleft(1L, {depth} - local_depth) - 1)")
    first = F.expr(f"shiftleft(prefix, {depth} - local_depth)")
    return cut(buckets.select(first.alias("bucket"), "local_depth", F.explode(slots).alias("k")).select((F.col("bucket") + F.col("k")).alias("slot"), "bucket", "local_depth")), depth


def in_bucket(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """``rows`` with the bucket of their key, by the directory."""
    return rows.withColumn("slot", prefix(F.col("key"), depth)).join(small(slots, SLOTS), "slot").drop("slot")


def build_index(texts: DataFrame, popular: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """The index: bucket, local_depth, key, nth (in the chain of the key), chain (its length), keep_id, group_size, text (in chains alone).

    texts: doc_id, key, text. popular: key, not too many to broadcast. Their rows are added up within each task before the
    shuffle, so a text with a third of all rows sends one row a task; the rows of other keys go to the owner as they are.
    """
    popular = F.broadcast(popular)
    many = texts.join(popular, "key", "left_semi").groupBy("key", "text").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    few = texts.join(popular, "key", "left_anti").select("key", "text", "doc_id", F.lit(1).cast("long").alias("n"))
    owned = in_bucket(few.unionByName(many), slots, depth).repartition("bucket")
    # all of a bucket are with its owner: neither the entries nor the chains deal rows out again
    entries = owned.groupBy("bucket", "local_depth", "key", "text").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    chains = entries.groupBy("bucket", "local_depth", "key").agg(F.count(F.lit(1)).alias("chain"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"))
    index = stored(chains, "hash-index").withColumn("nth", F.lit(1)).withColumn("text", F.lit(None).cast("string"))
    chained = cut(index.where("chain > 1").select("bucket", "local_depth", "key", "chain"))
    if chained.isEmpty():
        return index
    # the few keys whose texts differ: their entries hold the bytes that tell them apart
    some = texts.join(small(chained), "key", "left_semi").groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    nth = F.row_number().over(W.partitionBy("key").orderBy(F.col("keep_id").desc(), "text"))
    return index.where("chain = 1").unionByName(stored(some.join(small(chained), "key").withColumn("nth", nth), "hash-chains"))


def find_copies(docs: DataFrame, *, capacity: int | None = None, popular: int = POPULAR, key=hash_key) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays: doc_id, keep_id, group_size, kept, text_sha256.

    Whole texts, compared byte by byte without any change; a row for each row of ``docs``. Null text counts as empty. A
    null doc_id is never the largest; in a group without others, keep_id is null and its rows are kept. Rows that repeat
    with their doc_id count each in group_size, and share what is said of it. Other columns aren't read. An empty table gives none.
    """
    missing(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("key", key(F.col("text")).cast("long"))
    rows = stored(texts.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256")), "text-keys")
    keys = cut(rows.groupBy("key").count())
    sums = keys.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
    often = keys.where(F.col("count") > max(popular, sums.rows // MOST_POPULAR)).select("key")
    slots, depth = directory(keys.select("key"), sums["keys"], capacity or max(CAPACITY, 4 * sums["keys"] // SLOTS))
    index = build_index(texts, often, slots, depth)
    entry = ["bucket", "key", "keep_id", "group_size"]
    alone, found = index.where("chain = 1").select(*entry), in_bucket(rows, slots, depth).drop("local_depth")
    hot = alone.join(F.broadcast(often), "key", "left_semi")
    cold = found.join(F.broadcast(often), "key", "left_anti").join(alone.join(F.broadcast(often), "key", "left_anti"), ["bucket", "key"])
    told = cold.unionByName(found.join(F.broadcast(hot), ["bucket", "key"]).select(cold.columns))
    chains = index.where("chain > 1").select(*entry, "text")
    if not chains.isEmpty():  # texts with one hash: the bytes say to which entry of the chain a row belongs
        some = in_bucket(texts, slots, depth).join(small(chains.select("key").distinct()), "key", "left_semi")
        some = some.join(chains, ["bucket", "key", "text"]).withColumn("text_sha256", F.sha2("text", 256))
        told = told.unionByName(some.select(told.columns))
    return told.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that aren't kept. Rows that share the id of the row that stays, copies of it too, stay with it.

    All columns stay, whatever they are called; odd rows as in ``find_copies``. A row without an id goes if its text has a row with one.
    """
    missing(docs, "doc_id", "text")
    gone = find_copies(docs, **options).where("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__gone_sha256")).distinct()
    sha256 = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__gone"]) & (sha256 == gone["__gone_sha256"]), "left_anti")
