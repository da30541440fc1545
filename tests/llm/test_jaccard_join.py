import random

import numpy as np
import pytest

from palimpsest.llm import jaccard_join as j


def plain_set(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def plain(rows, like):
    sets = [plain_set(t, like.size) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= like.percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted(repr((d, len(sets[k]), least[find(k)] if d is not None else None)) for k, (d, _) in enumerate(rows))


def got(docs, like, **options):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in j.join_components(docs, like, **options).collect())


@pytest.mark.parametrize("like", [j.Likeness(4, 85), j.Likeness(), j.Likeness(1, 60)])
@pytest.mark.parametrize("options", [{}, {"frequent": 2, "block": 40}, {"hot": 3, "block": 60, "bits": 3}])
def test_against_all_pairs(near, like, options):
    rows = [(r.doc_id, r.text) for r in near.collect()]
    assert got(near, like, **options) == plain(rows, like)


def test_without_broadcasts(near, monkeypatch):
    monkeypatch.setattr(j, "small", lambda df: df)
    rows = [(r.doc_id, r.text) for r in near.collect()]
    assert got(near, j.Likeness()) == plain(rows, j.Likeness())


def test_odd_rows(odd, clashing, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd, j.Likeness()) == got(clashing, j.Likeness()) == plain(rows, j.Likeness())
    assert got(empty, j.Likeness()) == []
    left = j.drop_near_copies(clashing)
    assert left.columns == clashing.columns
    assert sorted(repr(r.doc_id) for r in left.collect()) == sorted(map(repr, [1, 3, 4, 5, 6, 7, 8, 9, None, None]))


def test_one_doc_id_with_two_texts(spark):
    a = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, a), (1, "other words " * 9), (2, a + " more"), (3, "other words " * 9)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in j.join_components(docs).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_shingles_of_joined_texts():
    rng = random.Random(2)
    texts = ["", " ", "a", "a b c", " a\tB\nc d e ", "é É", "\u00a0 x"] + [" ".join(rng.choice("abcABC ") for _ in range(rng.randrange(40))) for _ in range(300)]
    data = [t.encode() for t in texts]
    h, o = j.shingles(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(x) for x in data]), 3)
    names = {}
    for k, t in enumerate(texts):
        want = plain_set(t, 3)
        mine = set(h[o == k].tolist())
        assert len(mine) == len(want) == (o == k).sum()
        for other, (w, m) in names.items():
            assert len(want & w) == len(mine & m), (texts[other], t)
        if k % 20 == 0 or k < 8:
            names[k] = (want, mine)


def test_components(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1001 + k) for k in range(200)]
    noise = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(200)]
    edges = chain + star + noise
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in j.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b}
    assert all(got[k] == find(k) for k in root if k not in alone or k in got)
    assert j.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_whose_sums_are_equal_modulo_a_power_of_two(spark):
    """Thue-Morse words and their complements, in shingles and in whole sets."""
    morse = {n: "".join("ab"[bin(k).count("1") % 2] for k in range(n)) for n in (1024, 2048, 4096)}
    other = str.maketrans("ab", "ba")
    texts = [t for w in morse.values() for t in (f"one two {w} three", f"one two {w.translate(other)} three", w, w.translate(other))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for like in (j.Likeness(4, 85), j.Likeness()):
        assert got(docs, like) == plain(list(enumerate(texts)), like)


def test_shingles_have_the_last_word(monkeypatch):
    """With one hash for all shingles, sets of one size look alike."""
    monkeypatch.setattr(j, "mix64", lambda x: x * j._U(0) + j._U(7))
    texts = ["a b c d e f", "g h i j k l", "m n o p q r"]
    h, o = j.shingles(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([len(t) for t in texts]), 5)
    sigs = [int(x) for x in j.signed(j.signatures(h, o, 3)[0])]
    assert len(set(sigs)) == 1
    assert j.links_among(texts, sigs, j.Likeness()) == []


def test_a_hot_group_is_linked_in_rounds(spark):
    """Near copies that all share a key, with strangers that share it too."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(600):
        text = list(base)
        text[rng.randrange(10, 60)] = f"x{k}"
        rows.append((k, " ".join(text)))
    rows += [(1000 + k, " ".join(base[:12] + [f"s{k}_{i}" for i in range(50)])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, j.Likeness(4, 85), hot=50, block=1200) == plain(rows, j.Likeness(4, 85))
