import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup


def check(docs, **options):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    keep = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    want = sorted(repr((d, keep[t], len(groups[t]), d == keep[t], hashlib.sha256(t.encode()).hexdigest())) for d, t in rows)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in exact_dedup.find_copies(docs, **options).collect()) == want


def test_odd_rows(odd, clashing, empty):
    check(odd)
    check(clashing)
    check(empty)


def test_splits_and_hot_group(spark):
    docs = spark.createDataFrame([(k, "hot" if k % 3 == 0 else f"text {k % 400}") for k in range(3000)], "doc_id long, text string")
    check(docs, capacity=8)
    keys = docs.select(F.xxhash64("text").alias("key")).distinct()
    slots, depth = exact_dedup.directory(keys, keys.count(), 8)
    rows = slots.collect()
    assert len(rows) == len({r.slot for r in rows}) == 2**depth
    sizes = keys.withColumn("slot", exact_dedup.prefix(F.col("key"), depth)).join(slots, "slot").groupBy("bucket").count()
    assert sizes.where("count > 8").count() == 0


def test_chains_of_equal_hashes(odd, spark):
    check(odd, key=F.length)
    docs = spark.createDataFrame([(k, "ab"[k % 2] * (k % 5)) for k in range(300)], "doc_id long, text string")
    check(docs, key=F.length, capacity=2)


def test_popular_keys_are_summed_before(odd, spark):
    check(odd, popular=1)
    check(odd, popular=1, key=F.length)
    docs = spark.createDataFrame([(k, "hot" if k % 3 == 0 else f"text {k % 7}") for k in range(900)], "doc_id long, text string")
    check(docs, popular=150, capacity=2)


def test_the_result_comes_from_the_index(spark, monkeypatch):
    """Without a slot of the directory nothing is said of its rows; with a wrong owner for one, neither."""
    docs = spark.createDataFrame([(k, f"text {k % 40}") for k in range(200)], "doc_id long, text string")
    whole = exact_dedup.directory

    def broken(keys, n_keys, capacity):
        slots, depth = whole(keys, n_keys, capacity)
        return slots.where(F.col("slot") != slots.first().slot), depth

    monkeypatch.setattr(exact_dedup, "directory", broken)
    assert 0 < exact_dedup.find_copies(docs, capacity=4).count() < 200
    build = exact_dedup.build_index
    monkeypatch.setattr(exact_dedup, "directory", whole)
    monkeypatch.setattr(exact_dedup, "build_index", lambda *a: build(*a).withColumn("bucket", F.col("bucket") + 1))
    assert exact_dedup.find_copies(docs, capacity=4).count() == 0


def test_drop(odd, clashing):
    left = exact_dedup.drop_copies(clashing)
    assert left.columns == clashing.columns
    want = sorted(map(repr, [2, 2, 4, 5, 6, 7, 8, 9]))
    assert sorted(repr(r.doc_id) for r in left.collect()) == want
    assert sorted(repr(r.doc_id) for r in exact_dedup.drop_copies(odd).collect()) == want
