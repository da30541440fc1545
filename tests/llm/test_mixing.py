from collections import defaultdict

import pytest

from palimpsest.llm import mixing


def plain_targets(sizes, most=3.0):
    """Shares by weight, what is above the stop reshared, until none is."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    stopped, total = {}, float(sum(sizes.values()))
    while True:
        rest = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > most * sizes[s]]
        if not above:
            return share | stopped
        stopped |= {s: most * sizes[s] for s in above}


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_targets_and_taken(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k * 7 % 50), f"s{k * k % 11}" if k % 13 else None) for k in range(900)], "doc_id long, text string, source string")
    got = rows_of(mixing.mix(docs))
    sizes = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["repeats"] * r["size"] and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 25.5, (s, taken[s], want[s])
    assert sorted(map(repr, got)) == sorted(map(repr, rows_of(mixing.mix(docs.repartition(7)))))


def test_stops_are_reshared(spark):
    docs = spark.createDataFrame([(1, "w " * 1000, "a"), (2, "w " * 10, "b"), (3, "w " * 10, "c")], "doc_id long, text string, source string")
    got = {r["source"]: r["target"] for r in rows_of(mixing.mix(docs))}
    assert got == pytest.approx(plain_targets({"a": 1000, "b": 10, "c": 10}))
    assert got["b"] == 30 and got["c"] == 30


def test_nested_budgets(spark):
    docs = spark.createDataFrame([(k, "w " * 5, "s") for k in range(500)], "doc_id long, text string, source string")
    part = {b: {r["doc_id"] for r in rows_of(mixing.mix(docs, budget=b)) if r["taken"]} for b in (0.1, 0.3, 0.7)}
    assert part[0.1] < part[0.3] < part[0.7]


def test_odd_rows(odd, clashing, empty):
    got = rows_of(mixing.mix(odd))
    assert len(got) == odd.count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    assert len({(r["taken"], r["repeats"]) for r in got if r["doc_id"] == 2}) == 1
    assert sorted(map(repr, rows_of(mixing.mix(clashing)))) == sorted(map(repr, got))
    assert rows_of(mixing.mix(empty)) == []
