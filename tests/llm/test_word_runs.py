import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from palimpsest.llm import word_runs as w


def plain(words):
    """All runs (start, end, smallest period), period by period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((a, z, q) for (a, z), q in out.items())


def texts(rng, n):
    for _ in range(n):
        size, letters = rng.randrange(60), rng.choice([1, 2, 2, 3, 4])
        words = [rng.randrange(letters) for _ in range(size)]
        if rng.random() < 0.4 and size > 3:
            a = rng.randrange(size)
            p = 1 + rng.randrange((size - a) // 3 + 1)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(size)]
        yield words


def test_all_runs_against_plain():
    for words in texts(random.Random(1), 1500):
        assert [tuple(r) for r in w.all_runs(np.array(words, np.int64)).tolist()] == plain(words), words
    fibonacci = [0], [0, 1]
    for _ in range(9):
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert [tuple(r) for r in w.all_runs(np.array(fibonacci[1])).tolist()] == plain(fibonacci[1])


def test_long_enough_runs_across_texts():
    """Stretches that are searched hold all runs that are long enough, whatever the bounds; texts side by side stay apart."""
    rng = random.Random(2)
    for least, exponent in ((6, 4), (2, 2), (5, 3), (4, 2), (9, 5)):
        many = list(texts(rng, 200))
        found, collapsed = w.search([b" ".join(b"w%d" % x for x in words) for words in many], least, exponent)
        for words, runs, text in zip(many, found, collapsed, strict=True):
            want = sorted(((a, z - a, q) for a, z, q in plain(words) if z - a >= max(least, exponent * q)), key=lambda r: (r[0], r[2]))
            assert runs == want
            gone = {i for a, size, q in want for i in range(a + q, a + size)}
            assert text == b" ".join(b"w%d" % x for i, x in enumerate(words) if i not in gone)


def test_previous_factors_and_blocks():
    rng = random.Random(3)
    for _ in range(300):
        x = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        names = w.Names(np.array(x))
        assert names.order.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        lcp = np.concatenate([[0], names.common_prefix(names.order[:-1], names.order[1:])])
        longest, where = w.previous_factors(names.order, lcp)
        for i in range(len(x)):
            def common(j, i=i):
                k = 0
                while i + k < len(x) and x[j + k] == x[i + k]:
                    k += 1
                return k
            assert longest[i] == max((common(j) for j in range(i)), default=0)
            assert longest[i] == 0 or where[i] < i and common(where[i]) == longest[i]
        cut = w.blocks(longest, where)
        assert cut[0][0] == 0 and cut[-1][1] == len(x) and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))


def test_tables(spark, odd, clashing, empty):
    rows = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in w.find(odd).collect()}
    assert rows[(6, "word")] == [(0, 30_000, 1)] and rows[(3, "")] == [] and rows[(5, "")] == [] and rows[(None, "")] == []
    assert rows[(9, "naïve 😀 text here")] == []
    assert w.find(odd).count() == odd.count() and w.find(clashing).columns == ["doc_id", "runs", "collapsed"] and w.find(clashing).count() == odd.count()
    assert w.find(empty).collect() == []
    with pytest.raises(ValueError):
        w.find(odd, min_exponent=1)
    with pytest.raises(ValueError, match="no column"):
        w.find(odd.drop("text"))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(((a, z - a, q) for a, z, q in plain(words) if z - a >= max(6, 4 * q)), key=lambda r: (r[0], r[2]))
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = " ".join(x for i, x in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_against_plain(spark, tmp_path):
    """The whole query over texts of up to 400 words, odd rows among them."""
    from palimpsest.llm.queries import op13_word_runs

    rng = random.Random(6)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(f"w{rng.randrange(rng.choice([2, 9, 200]))}" for _ in range(rng.randrange(400)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "x"), (None, "a a a a a a a"), (204, "é " * 50), (204, "é " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op13_word_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    want = [expected(i, t) for i, t in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(x[1] > 0 for x in want) > 10
