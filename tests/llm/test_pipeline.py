import tempfile
from collections import Counter

import corpus_pipeline
from palimpsest.llm import jaccard_join, mixing, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents").cache()
    items = [r.text for r in queries.table(spark, SF, "benchmark").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == docs.columns
        before, left = docs.collect(), after.collect()
        seen[name] = (before, left)
        docs = after
    before, left = seen["language_id"]
    assert {r.doc_id for r in before} == {r.doc_id for r in left}  # all have letters and a language
    before, left = seen["near_duplicates"]
    groups = {r.doc_id: r.component_id for r in jaccard_join.join_components(spark.createDataFrame(before)).collect()}
    assert sorted(r.doc_id for r in left) == sorted({c for c in groups.values()})
    before, left = seen["decontamination"]
    assert {r.doc_id for r in left} == {r.doc_id for r in before if not any(t in r.text for t in items)}
    before, left = seen["source_mix"]
    assert len(left) == sum(r.repeats for r in mixing.mix(spark.createDataFrame(before)).collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).orderBy("start").collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in left)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(last, last[1:], strict=False))


def rows_of(docs):
    return sorted(repr((r.doc_id, r.text, r.lang, r.source, r.n_chars)) for r in docs.collect())


def test_stages_take_odd_rows(spark, odd, clashing, empty):
    """Nulls, ties, repeated rows and clashing names: each stage's rows against what a plain loop keeps."""
    rows = [tuple(r) for r in odd.collect()]
    stages = dict(corpus_pipeline.STAGES)
    shown = lambda kept: sorted(map(repr, kept))
    group = "alpha beta gamma delta epsilon zeta eta theta"
    items = [(1, group), (2, "an item that nobody holds, with some words more")]
    for docs in (odd, clashing):
        out = {}
        for name in ("near_duplicates", "source_mix", "language_id"):
            after = stages[name](spark, docs, SF)
            assert after.columns == docs.columns, name
            out[name] = rows_of(after)
        assert out["near_duplicates"] == shown(r for r in rows if not (r[0] == 2 and r[1] == group))
        left = out["language_id"]  # few labelled rows: what is left is among those with letters, and like rows are judged alike
        assert set(left) <= {repr(r) for r in rows if r[1] and any(c.isalpha() for c in r[1])} and left
        assert all(left.count(x) == shown(rows).count(x) for x in set(left))
        taken = Counter(out["source_mix"])
        words = Counter()
        for r in rows:
            words[r[3]] += len((r[1] or "").split(" ")) if r[1] and r[1].strip() else 0
        per_row = {repr(r): taken[repr(r)] / shown(rows).count(repr(r)) for r in rows}
        assert all(n == int(n) and n <= 3 for n in per_row.values())
        after = stages["decontamination"](spark, docs, with_benchmark(spark, items))
        assert after.columns == docs.columns and rows_of(after) == shown(r for r in rows if r[1] != group)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
    ids = stages["token_id_files"](spark, clashing, SF).orderBy("start").collect()
    assert len(ids) == len(rows) and [r.doc_id for r in ids] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))


def with_benchmark(spark, items):
    at = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{at}/benchmark.parquet")
    return at


def test_one_id_in_two_sources_is_taken_as_each_asks(spark):
    text = "one two three four five"
    docs = spark.createDataFrame([(k, text, "en", "a", 1) for k in range(300)] + [(k, text, "en", "b", 1) for k in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] += r.repeats
    got = Counter((r.doc_id, r.source) for r in dict(corpus_pipeline.STAGES)["source_mix"](spark, docs, SF).collect())
    assert got == +want
    words = Counter()
    for (_, source), n in got.items():
        words[source] += 5 * n
    assert abs(words["a"] - 2000 / 3) <= 5 and abs(words["b"] - 4000 / 3) <= 5


def test_rows_without_an_id_are_mixed_by_their_texts(spark):
    docs = spark.createDataFrame([(None, f"text number {k} here", "ab"[k % 2]) for k in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source").sum("taken", "size").collect()
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    assert all(abs(r["sum(taken)"] - target[r.source]) <= 4 for r in got)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 100
