"""Which texts are contained in others, white space aside, by an index of sampled grams.

A text of QUERY units or more (UTF-16 units without white space) gives grams: in each window of QUERY units the gram with the
smallest hash. What contains the text holds the same windows, and so the same grams at the same distances. Each text takes
its rarest gram to the places where that occurs, and is compared there. Nothing holds a whole document: a row of texts that
follow each other is cut into chunks, each of which reaches into the next one by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.columns import MOVED_LEAST, squeezed
from palimpsest.sources.scratch import stored

#: Units of a window, and of a gram in it.
QUERY, GRAM = MOVED_LEAST, 10
#: Units of a chunk, without what it has of the next one.
CHUNK = 2048
_FACTORS = np.random.default_rng(20_240_601).integers(1, 2**63, GRAM, dtype=np.uint64) | np.uint64(1)


def units(text: Column) -> Column:
    """The text without white space as UTF-16, two bytes a unit."""
    return F.encode(squeezed(text), "UTF-16BE")


def text_id(text: Column) -> Column:
    """Texts that are equal without white space have one."""
    return F.sha2(squeezed(text), 256)


def size(u: Column) -> Column:
    return (F.octet_length(u) / 2).cast("int")


def sampled(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in it, hash) of the grams of rows of units that lie one after the other in ``data``."""
    n = len(data) - QUERY + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    h = np.zeros(len(data) - GRAM + 1, np.uint64)
    for j, factor in enumerate(_FACTORS):
        h += data[j : j + len(h)] * factor
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    windows = np.lib.stride_tricks.sliding_window_view(h, QUERY - GRAM + 1)
    inside = row[:n] == row[QUERY - 1 :]
    at = np.unique((np.arange(n) + windows.argmin(1))[inside])
    first = np.cumsum(sizes) - sizes
    return row[at], at - first[row[at]], h[at].astype(np.int64)


def grams(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, gram and at (the place) of the sampled grams of each row's ``u``."""
    kept = rows.select(*keep, "u")
    schema = kept.drop("u").schema.add("gram", "long").add("at", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(part.num_columns - 1).to_pylist()
                row, at, gram = sampled(np.frombuffer(b"".join(texts), ">u2").astype(np.uint64), np.array([len(t) // 2 for t in texts]))
                if len(row):
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in part.columns[:-1]), pa.array(gram), pa.array(at)], schema.names)

    return kept.mapInArrow(run, schema)


def chunks(texts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, chunk, u: the texts of each key, one after the other without white space, in chunks of CHUNK units.

    Only lengths go through the running sum by key; the texts are cut where chunks end and put together chunk by chunk.
    """
    rows = texts.select(*keys, *order, units(F.col("text")).alias("u")).withColumn("n", size(F.col("u"))).where("n > 0")
    rows = rows.withColumn("from", F.sum("n").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    first = F.greatest(F.lit(0), F.floor((F.col("from") - (QUERY - 1)) / CHUNK))
    rows = rows.withColumn("chunk", F.explode(F.sequence(first.cast("long"), F.floor((F.col("from") + F.col("n") - 1) / CHUNK))))
    start = F.greatest(F.col("from"), F.col("chunk") * CHUNK)
    end = F.least(F.col("from") + F.col("n"), (F.col("chunk") + 1) * CHUNK + QUERY - 1)
    part = F.struct(start.alias("at"), F.substring("u", (2 * (start - F.col("from")) + 1).cast("int"), (2 * (end - start)).cast("int")).alias("u"))
    parts = rows.select(*keys, "chunk", part.alias("part")).groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("part")).alias("parts"))  # CHUNK units at most
    return parts.select(*keys, "chunk", F.aggregate("parts", F.lit(b""), lambda u, p: F.concat(u, p["u"])).alias("u"))


def needles(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, u, n: the different texts of each key that are long enough."""
    return texts.select(*keys, text_id(F.col("text")).alias("id"), units(F.col("text")).alias("u")).withColumn("n", size(F.col("u"))).where(F.col("n") >= QUERY).dropDuplicates([*keys, "id"])


def likely(texts: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """keys, u of the texts that are long enough and whose gram with the smallest hash is in ``index`` (keys, gram).

    That gram is the smallest of its window in whatever contains the text, so none that is contained is lost; of those that
    aren't, few go on, and these alone are looked for by all of their grams.
    """
    rows = texts.select(*keys, units(F.col("text")).alias("u")).where(size(F.col("u")) >= QUERY)
    schema = T.StructType([*rows.schema.fields, T.StructField("gram", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                u = part.column(part.num_columns - 1).to_pylist()
                row, _, gram = sampled(np.frombuffer(b"".join(u), ">u2").astype(np.uint64), np.array([len(t) // 2 for t in u]))
                order = np.lexsort((gram.view(np.uint64), row))
                least = gram[order[np.searchsorted(row[order], np.arange(len(u)))]]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least)], schema.names)

    return rows.mapInArrow(run, schema).join(index, [*keys, "gram"], "leftsemi").drop("gram")


def rarest(index: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, gram, at: of each text's grams the one that ``index`` has least often; none of a text that has one it lacks."""
    often = index.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("often"))
    all_grams = grams(wanted, *keys, "id").join(often, [*keys, "gram"], "left")
    best = F.min(F.struct(F.col("often"), F.col("gram"), F.col("at"))).alias("best")
    found = all_grams.groupBy(*keys, "id").agg(best, F.bool_and(F.col("often").isNotNull()).alias("all_there")).where("all_there")
    return found.select(*keys, "id", F.col("best.gram").alias("gram"), F.col("best.at").alias("at"))


def contained(texts: DataFrame, corpus: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, id (see ``text_id``) of the texts that are contained in what the texts of ``corpus`` give one after the other.

    Both have the keys and ``text``; a match may span texts of the corpus that follow each other by ``order``. Texts under
    QUERY units, null and empty ones are in nothing. Texts that repeat are looked for once.
    """
    found = likely(texts, grams(chunks(corpus, keys, order), *keys).select(*keys, "gram"), keys)
    wanted = found.select(*keys, F.sha2(F.decode("u", "UTF-16BE"), 256).alias("id"), "u", size(F.col("u")).alias("n")).dropDuplicates([*keys, "id"])
    wanted = stored(wanted, "needles")
    there = chunks(corpus.join(wanted.select(*keys), keys, "leftsemi"), keys, order)
    index = grams(there, *keys, "chunk").select(*keys, "gram", (F.col("chunk") * CHUNK + F.col("at")).alias("place")).distinct()  # windows overlap, grams may come twice
    start = F.col("place") - F.col("at")
    tried = rarest(index, wanted, keys).join(index, [*keys, "gram"]).select(*keys, "id", start.alias("start")).where("start >= 0")
    tried = tried.join(wanted, [*keys, "id"])
    last = F.floor((F.col("start") + F.col("n") - 1) / CHUNK)
    # each chunk that the text would lie in is compared with its part of the text
    tried = tried.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / CHUNK), last)))
    a = F.greatest(F.col("start"), F.col("chunk") * CHUNK)
    z = F.least(F.col("start") + F.col("n"), (F.col("chunk") + 1) * CHUNK)
    tried = tried.select(*keys, "id", "start", "chunk", (2 * (a - F.col("chunk") * CHUNK) + 1).cast("int").alias("from"), F.substring("u", (2 * (a - F.col("start")) + 1).cast("int"), (2 * (z - a)).cast("int")).alias("mine"))
    tried = tried.join(there, [*keys, "chunk"], "left")
    same = F.coalesce(F.substring("u", F.col("from"), F.octet_length("mine")) == F.col("mine"), F.lit(False))
    return tried.groupBy(*keys, "id", "start").agg(F.bool_and(same).alias("same")).where("same").select(*keys, "id").distinct()


def with_contained(rows: DataFrame, corpus: DataFrame, name: str, keys: list[str], order: list[str], *, looked_for: Column | None = None) -> DataFrame:
    """``rows`` with a boolean ``name``: whether the row's text is contained in the corpus of its keys; only rows ``looked_for`` are."""
    asked = rows if looked_for is None else rows.where(looked_for)
    found = stored(contained(asked, corpus, keys, order), "contained").withColumn(name, F.lit(True)).withColumnRenamed("id", "__text_id")
    looked_for = F.lit(True) if looked_for is None else looked_for
    marked = rows.withColumn("__text_id", F.when(looked_for, text_id(F.col("text")))).join(found, [*keys, "__text_id"], "left")
    return marked.withColumn(name, F.coalesce(name, F.lit(False))).select(*rows.columns, name)


def containing(texts: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, other_id: pairs of a text and one of the others that holds it as a whole, equal ones too.

    Both have the keys and ``text``. Pairs of different texts: texts that repeat count once. Each other text is a row.
    """
    wanted, there = needles(texts, keys), needles(others, keys)
    index = grams(there, *keys, "id").select(*keys, "gram", F.col("id").alias("other_id"), F.col("at").alias("place"))
    start = F.col("place") - F.col("at")
    tried = rarest(index, wanted, keys).join(index, [*keys, "gram"]).select(*keys, "id", "other_id", start.alias("start")).where("start >= 0")
    tried = tried.join(wanted, [*keys, "id"]).join(there.select(*keys, F.col("id").alias("other_id"), F.col("u").alias("other")), [*keys, "other_id"])
    return tried.where(F.substring("other", (2 * F.col("start") + 1).cast("int"), F.octet_length("u")) == F.col("u")).select(*keys, "id", "other_id").distinct()
