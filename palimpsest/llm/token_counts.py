"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes says for each document and tokenizer what it counted before and what it counts now: an insert has no
before, a delete no after, a revision both. Each batch is reduced to signed sums by (source, lang, tokenizer) before
anything is stored; totals are the sum of the stored deltas. A batch is committed by writing its deltas and then its name
to the log, so a batch that is sent again, or that broke off between the two writes, counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import missing, word_count

KEY = ["source", "lang", "tokenizer"]
#: Tokenizer versions that count without a vocabulary.
COUNTERS = {"utf8-bytes-1": lambda text: F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "words-1": word_count}
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_rows long"


def counted(docs: DataFrame, counters: dict = COUNTERS, keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, lang, (keep,) tokenizer, n_tokens: a row for each document and tokenizer version. Null text counts 0."""
    missing(docs, "doc_id", "text", "source", "lang")
    each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), count(F.col("text")).alias("n_tokens")) for name, count in sorted(counters.items())])
    return docs.select("doc_id", "source", "lang", *(keep or []), F.inline(each))


def inserts(rows: DataFrame) -> DataFrame:
    """Changes that add what isn't there yet."""
    return _changes(rows, F.lit(None).cast("long"), F.col("n_tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    """Changes that take out what is there."""
    return _changes(rows, F.col("n_tokens"), F.lit(None).cast("long"))


def revisions(rows: DataFrame, before: Column) -> DataFrame:
    """Changes that put the count n_tokens in the place of ``before``."""
    return _changes(rows, before.cast("long"), F.col("n_tokens"))


def _changes(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    return rows.select(*KEY, before.alias("before"), after.alias("after"))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by key. Spark adds up within each task first, so a key with most of the rows costs no more than others."""
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(1)
    return changes.groupBy(*KEY).agg(
        F.sum(n("after") - n("before")).cast("long").alias("n_docs"),
        F.sum(F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).cast("long").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_rows"),
    )


class TokenCounts:
    """The rollup in a folder that driver and executors share: deltas/<batch>, and log/ with a row for each committed batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def committed(self) -> DataFrame:
        """batch_id of each committed batch."""
        return self._read("log/*", "batch_id string").distinct()

    def _read(self, below: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return self.spark.read.schema(schema).parquet(*[str(s.getPath().toString()) for s in found]) if found else self.spark.createDataFrame([], schema)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Applies a batch once; False if it was there already.

        The deltas overwrite what a broken-off attempt left; the log entry comes last and its name is the batch's, so two
        writers of one batch leave one entry.
        """
        if not batch_id or set(batch_id) & set("/*?[]{}\\ "):
            raise ValueError(f"batch id {batch_id!r}: it names a folder")
        if not self.committed().where(F.col("batch_id") == batch_id).isEmpty():
            return False
        deltas(changes).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/deltas/{batch_id}")
        self.spark.createDataFrame([(batch_id,)], "batch_id string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/log/{batch_id}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over the committed batches; keys whose documents are all gone are left out.

        Null source and null lang are keys of their own.
        """
        names = [r.batch_id for r in self.committed().collect()]  # a short name for each batch since the last compaction
        if not names:
            return self.spark.createDataFrame([], _DELTA).drop("n_rows")
        rows = self.spark.read.schema(_DELTA).parquet(*[f"{self.root}/deltas/{n}" for n in sorted(names)])
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
