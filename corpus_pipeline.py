"""The training-corpus pipeline: language ID, near duplicates, benchmark decontamination, source mixing, token-ID files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, jaccard_join, lang_id, mixing, token_files
from palimpsest.llm.common import stored
from palimpsest.llm.queries import END_ID, table, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those far from all centroids.

    Null and empty texts, and those without a letter, go. Null ids stay if their text does, but aren't learned from. Rows that
    repeat are judged alike. Without labelled rows nothing can be told, so all go. An empty table gives none; all columns stay.
    """
    model = lang_id.fit(docs.where(~lang_id.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    return lang_id.drop_rejected(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id: 5-word shingles, similarity 0.8 or more.

    Null and empty texts are like nothing and stay, and so do rows without an id. Rows with the id that stays all stay, so
    rows that repeat do. An empty table gives none; all columns stay.
    """
    return jaccard_join.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, with other names and numbers too, in any case.

    Null and empty texts hold nothing and stay. Rows without an id go if they hold one; rows with one id are judged each.
    An empty table gives none; all columns stay.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), any_case=True)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: sources weigh 1, 2, 3, repeating.

    Rows are told by their own source and hash, so one id in two sources is taken as each asks. Null and empty texts have
    no words and go with their hash; a null source is one of its own; without an id the text is hashed. An empty table gives
    none; all columns stay.
    """
    return mixing.take(docs)


def token_id_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row, written to files and read back: doc_id, start, n_tokens, ids_crc32.

    A null text is as empty: the end id alone. Rows without an id come first; rows with one id follow each other, each a
    document. An empty table gives no files and no rows; other columns aren't read.
    """
    _, manifest = token_files.encode_to_files(spark, docs, tokenizer_path(), end_id=END_ID)
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mix", source_mix), ("token_id_files", token_id_files)]
#: SQL expresses neither trained centroids nor a tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
