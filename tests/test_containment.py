import hashlib
import random
import re

import numpy as np
import pytest

from palimpsest.operators import containment, dominance


def plain(text):
    return re.sub(r"\s", "", text or "")


def u16(text):
    return len(text.encode("utf-16-be")) // 2


@pytest.fixture(scope="module")
def texts():
    """Texts of four documents, and texts to look for: parts of what they give together, parts with one character changed, others."""
    rng = random.Random(1)
    some = lambda n: "".join(rng.choice("ab c é😀") for _ in range(n))
    corpus = [(d, i, some(rng.randrange(70))) for d in range(4) for i in range(60)] + [(0, 60, None), (1, 60, "ab" * 300)]
    whole = {d: "".join(plain(t) for x, _, t in corpus if x == d) for d in range(4)}
    asked = []
    for k in range(500):
        d = rng.randrange(5)
        text = some(rng.randrange(60))
        if d < 4 and rng.random() < 0.7:
            a = rng.randrange(len(whole[d]))
            text = whole[d][a : a + rng.randrange(8, 200)]
            text = text[:5] + " \n" + text[5:] if rng.random() < 0.3 else text
            if rng.random() < 0.3:
                at = rng.randrange(len(text))
                text = text[:at] + "x" + text[at + 1 :]
        asked.append((d, k, text))
    return corpus, whole, [*asked, (0, 900, None), (0, 901, ""), (1, 902, "ab" * 150), (1, 903, "ab" * 150), (None, 904, "ab" * 150)]


SCHEMA = "doc_id long, seq long, text string"


@pytest.mark.parametrize("chunk", [50, 2048])
def test_contained(spark, texts, monkeypatch, chunk):
    monkeypatch.setattr(containment, "CHUNK", chunk)
    corpus, whole, asked = texts
    found = containment.with_contained(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(corpus, SCHEMA), "found", ["doc_id"], ["seq"])
    got = {r.seq: r.found for r in found.collect()}
    assert got == {k: u16(plain(t)) >= 20 and plain(t) in whole.get(d, "") for d, k, t in asked}
    assert sum(got.values()) > 100 and found.columns == ["doc_id", "seq", "text", "found"]


def test_containing(spark, texts):
    corpus, _, asked = texts
    got = {tuple(r) for r in containment.containing(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(corpus, SCHEMA), ["doc_id"]).collect()}
    name = lambda t: hashlib.sha256(plain(t).encode()).hexdigest()
    long_enough = lambda t: u16(plain(t)) >= 20
    assert got == {(d, name(t), name(o)) for d, _, t in asked for e, _, o in corpus if d == e and long_enough(t) and long_enough(o) and plain(t) in plain(o)}


def test_empty_tables(spark, texts):
    corpus, none = spark.createDataFrame(texts[0], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert containment.contained(none, corpus, ["doc_id"], ["seq"]).collect() == []
    assert not any(r.found for r in containment.with_contained(corpus, none, "found", ["doc_id"], ["seq"]).collect())
    assert containment.containing(corpus, none, ["doc_id"]).collect() == []


def test_grams_of_a_text_are_among_those_of_what_holds_it():
    rng = np.random.default_rng(2)
    for _ in range(200):
        data = rng.integers(0, 3, 300).astype(np.uint64)
        a = int(rng.integers(0, 250))
        z = a + int(rng.integers(20, 50))
        _, at, gram = containment.sampled(data, np.array([300]))
        there = set(zip(at.tolist(), gram.tolist(), strict=True))
        _, at, gram = containment.sampled(data[a:z].copy(), np.array([len(data[a:z])]))
        assert len(at) and {(x + a, g) for x, g in zip(at.tolist(), gram.tolist(), strict=True)} <= there


def test_dominance(spark):
    rng = random.Random(1)
    points = [(d, rng.randrange(30), rng.randrange(30), rng.randrange(-5, 9)) for d, n in ((1, 0), (2, 1), (3, 2), (4, 64), (5, 333)) for _ in range(n)]
    asked = [(d, i, rng.randrange(-2, 33), rng.randrange(-2, 33)) for d in range(1, 7) for i in range(60)]
    got = dominance.sums(spark.createDataFrame(points, "k long, t long, x long, w long"), spark.createDataFrame(asked, "k long, id long, t long, x long"), ["k"])
    upto = lambda d, t: [(x, w) for k, u, x, w in points if k == d and u <= t]
    assert {(r.k, r.id): (r.upto, r.below) for r in got.collect()} == {(d, i): (sum(w for _, w in upto(d, t)), sum(w for y, w in upto(d, t) if y < x)) for d, i, t, x in asked}


def test_sums_make_few_rows(spark):
    """A point goes into one block for each hexadecimal digit of the number of points, not for each binary one."""
    points = spark.range(200).selectExpr("1 as k", "id as t", "id * 7 % 200 as x", "1L as w")
    asked = spark.range(200).selectExpr("1 as k", "id", "id as t", "id as x")
    found = dominance.sums(points, asked, ["k"])
    want = {(q, q + 1, sum(i * 7 % 200 < q for i in range(q + 1))) for q in range(200)}
    assert {(r.id, r.upto, r.below) for r in found.collect()} == want
    assert "sequence(0, (length(hex(" in found._jdf.queryExecution().optimizedPlan().toString()


def test_what_cannot_be_contained_goes_early(spark, texts):
    """A text whose smallest gram the corpus lacks isn't looked for by its other grams."""
    corpus = spark.createDataFrame(texts[0], SCHEMA)
    index = containment.grams(containment.chunks(corpus, ["doc_id"], ["seq"]), "doc_id").select("doc_id", "gram")
    asked = spark.createDataFrame([(0, 0, "never said anywhere in that document"), (0, 1, texts[1][0][:40]), (0, 2, "short")], SCHEMA)
    left = containment.likely(asked, index, ["doc_id"]).collect()
    assert [bytes(r.u).decode("utf-16-be") for r in left] == [texts[1][0][:40]]
