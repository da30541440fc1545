from palimpsest.llm import token_counts
from palimpsest.llm.common import shared_path


def rows(df):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in df.collect()}


def test_batches(spark, odd, clashing, empty):
    counts = token_counts.counted(odd)
    rollup = token_counts.TokenCounts(spark, shared_path(spark, "counts"))
    assert rows(rollup.totals()) == {}
    assert rollup.commit("a", token_counts.inserts(counts))
    assert not rollup.commit("a", token_counts.inserts(counts))  # sent again
    got = rows(rollup.totals())
    assert got["a", "en", "words-1"] == (3, 24) and got["c", "en", "utf8-bytes-1"] == (2, 150_005) and got[None, "en", "words-1"] == (1, 0)
    assert sum(n for n, _ in got.values()) == 2 * odd.count()
    revised = counts.withColumn("was", counts.n_tokens).withColumn("n_tokens", counts.n_tokens + 1)
    from pyspark.sql import functions as F

    assert rollup.commit("b", token_counts.revisions(revised, F.col("was")))
    assert rows(rollup.totals())["a", "en", "words-1"] == (3, 27)
    assert rollup.commit("c", token_counts.deletes(revised))
    assert rows(rollup.totals()) == {}
    other = token_counts.TokenCounts(spark, shared_path(spark, "counts"))
    other.commit("x", token_counts.inserts(token_counts.counted(clashing)))
    other.commit("y", token_counts.inserts(token_counts.counted(empty)))
    assert rows(other.totals()) == got


def test_a_batch_that_broke_off_counts_once(spark, odd):
    root = shared_path(spark, "counts")
    changes = token_counts.inserts(token_counts.counted(odd))
    token_counts.deltas(changes).coalesce(1).write.parquet(f"{root}/deltas/a")  # no log entry
    rollup = token_counts.TokenCounts(spark, root)
    assert rows(rollup.totals()) == {}
    assert rollup.commit("a", changes)
    assert rows(rollup.totals())["a", "en", "words-1"] == (3, 24)
