import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1), (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1), (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1),
        (3, None, "en", None, None), (4, "", None, "b", 0), (5, " \t\n", "fr", "b", 3), (None, "alpha beta gamma delta epsilon zeta eta theta", None, None, 1), (None, None, None, None, None),
        (6, "word " * 30_000, "en", "c", 150_000), (7, "12345 !!! 6789", "de", "c", 3), (8, "short", "en", "c", 5), (9, "naïve 😀 text\u00a0here", "fr", "a", 12),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns called as operators might call their own."""
    from pyspark.sql import functions as F

    names = ["size", "h", "key", "sig", "n", "kept", "score", "lang_pred", "rejected", "target", "place", "slot", "bucket", "start", "count", "__gone", "item_id", "n_shingles", "component_id", "hash", "prefix", "repeats"]
    return odd.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def near(spark):
    """Texts, copies, near copies of two degrees, and texts that share a passage."""
    rng = random.Random(5)
    passage = words(rng, 25)
    rows, k = [], 0
    for _ in range(30):
        base = words(rng, rng.randrange(20, 120))
        for change in (0, 0, 1, 2, 4, 8):
            text = list(base)
            for _ in range(change):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10_000)}"
            if rng.random() < 0.4:
                at = rng.randrange(len(text))
                text[at:at] = passage
            rows.append((k, rng.choice([" ", "\n", "  "]).join(text).upper() if rng.random() < 0.1 else " ".join(text), "en", f"s{k % 5}", 1))
            k += 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows + [(k, "one two", "en", "s", 1), (k + 1, "ONE  two", "en", "s", 1), (k + 2, None, "en", "s", 1), (k + 3, "", "en", "s", 1)], DOCS)
