"""Benchmark decontamination by template canonicalisation, in DataFrame operations alone.

Words become templates: numbers, names (words with a capital first letter) and units turn into typed placeholders, other
words into lower case. In scripts without spaces between words each letter is a word. Windows of template words of the benchmark are hash-joined with those of the documents, and so are,
with ``any_case``, windows of the words as they are, in lower case. Along each alignment of a document with an item the
slots must be consistent: a value of the item stands for one value of the document and the other way round, that of most
places; windows with another value there don't count. So a question asked again with other numbers and names is found, and
a text that merely has the same shape isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, missing, small

#: Words of a window; template words in it that must be literal; share of an item's windows that must be there.
WINDOW, LITERAL, COVERAGE = 8, 3, 0.5
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
#: What counts as a unit after a number or by itself.
UNITS = ["mm", "cm", "km", "mg", "kg", "ml", "kb", "mb", "gb", "tb", "hz", "khz", "mhz", "ghz", "kw", "kwh", "mph", "km/h", "°c", "°f", "%", "$", "€", "£", "¥", "usd", "eur", "gbp", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "centimeter", "centimeters", "inch", "inches", "feet", "miles", "mile", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "liter", "liters", "litre", "litres", "gallon", "gallons", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollar", "dollars", "cents", "euro", "euros", "percent", "degrees"]
#: Scripts that set no space between words: each letter, with its marks, is a word.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsBopomofo}\p{IsYi}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
#: Letters and marks of the others. What most texts have comes first in each class, and the scripts are asked last: they are slow.
_LETTER = rf"[A-Za-zÀ-ÖØ-öø-ɏ[\p{{L}}\p{{M}}&&[^{_UNSPACED}]]]"
_WORDS = rf"{_LETTER}+(?:['’]{_LETTER}+)*|[0-9\p{{N}}]+(?:[.,][0-9\p{{N}}]+)*|[\u0E00-\x{{10FFFF}}&&[{_UNSPACED}]]\p{{M}}*|[%$€£¥]|°[CcFf]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORDS), F.lit(0))


def template(word: Column) -> Column:
    first, low = F.substring(word, 1, 1), F.lower(word)
    digit = first.between("0", "9") | (first > "\x7f") & first.rlike(r"\p{N}")
    return F.when(digit, NUMBER).when(low.isin(UNITS), UNIT).when(F.lower(first) != first, NAME).otherwise(low)


def is_slot(word: Column) -> Column:
    return template(word).isin(NUMBER, NAME, UNIT)


def _let(value: Column, then) -> Column:
    """``then`` of the value, which is computed once however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _windows(hashes: Column, size: Column | int) -> Column:
    """Hashes of the windows of ``size`` words, 4 to 8; none if there are fewer words.

    Two hashes of neighbours make one of two, then of four words; two of four, that may overlap, cover the window.
    """

    def joined(h: Column, by: Column | int) -> Column:
        n = F.greatest(F.size(h) - by, F.lit(0))
        return F.zip_with(F.slice(h, 1, n), F.slice(h, F.lit(1) + by, n), lambda x, y: F.xxhash64(x, y))

    return _let(_let(_let(hashes, lambda h: joined(h, 1)), lambda h: joined(h, 2)), lambda h: joined(h, size - F.lit(4)))


def item_windows(benchmark: DataFrame, *, any_case: bool = False) -> DataFrame:
    """item_id, at, size, hash, enough, n, n_all, n_words: the windows of the items; items shorter than a window have one, all of it.

    enough: whether the window has enough literal words to be looked for as a template; n: how many of the item's have, n_all:
    how many windows it has. With ``any_case`` each window is also there as its words in lower case, under the same ``at``.
    Items without a window aren't looked for: those under four words, and without ``any_case`` those that are nearly all
    placeholders.
    """
    raw = words(F.col("text"))
    rows = benchmark.where("item_id is not null").select("item_id", F.transform(raw, template).alias("t"), F.transform(raw, F.lower).alias("low")).where("size(t) >= 4")
    rows = rows.withColumn("size", F.least(F.size("t"), F.lit(WINDOW)))
    hashed = lambda c: _windows(F.transform(c, lambda x: F.xxhash64(x)), F.col("size"))
    literal = lambda i: F.size(F.filter(F.slice("t", i + 1, F.col("size")), lambda x: ~x.isin(NUMBER, NAME, UNIT)))
    w = F.transform(F.sequence(F.lit(0), F.size("t") - F.col("size")), lambda i: F.struct(i.alias("at"), (literal(i) >= F.least(F.lit(LITERAL), F.col("size") - 1)).alias("enough")))
    rows = rows.select("item_id", "size", F.size("t").alias("n_words"), w.alias("w"), hashed("t").alias("t"), hashed("low").alias("low"))
    rows = rows.select("item_id", "size", "n_words", F.size(F.filter("w", lambda w: w["enough"])).alias("n"), F.size("w").alias("n_all"), F.explode(F.arrays_zip("w", "t", "low")).alias("e"))
    hashes = F.when(F.col("e.w.enough"), F.array(F.col("e.t"))).otherwise(F.array().cast("array<long>"))
    if any_case:
        hashes = F.array_union(hashes, F.array(F.col("e.low")))
    return rows.select("item_id", "size", "n", "n_all", "n_words", F.col("e.w.at").alias("at"), F.col("e.w.enough").alias("enough"), F.explode(hashes).alias("hash"))


#: What tells a row of the documents from others: its id, which may be null or repeat, and 128 bits of its text.
ROW = ["doc_id", "h1", "h2"]


def _row_hashes(text: Column) -> tuple[Column, Column]:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit("again"), text)


def matches(docs: DataFrame, windows: DataFrame, *, any_case: bool = False) -> DataFrame:
    """ROW, item_id, n_words (of the item), at (in the item), enough, shift (place in the document less that in the item): windows that both have.

    A text is cut into words once, for windows of all sizes.
    """
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # WINDOW, and less for short items: 5 at most
    low = (lambda x: F.xxhash64(F.lower(x))) if any_case else (lambda x: F.xxhash64(template(x)))
    hashes = _let(words(F.col("text")), lambda w: F.struct(F.transform(w, lambda x: F.xxhash64(template(x))).alias("t"), F.transform(w, low).alias("low")))
    rows = docs.select(*ROW, hashes.alias("h"))
    each = [F.struct(F.lit(s).alias("size"), _windows(F.col("h.t"), s).alias("t"), (_windows(F.col("h.low"), s) if any_case else F.array().cast("array<long>")).alias("low")) for s in sizes]
    if not each:
        return docs.select(*ROW, F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("n_words"), F.lit(0).alias("at"), F.lit(True).alias("enough"), F.lit(0).alias("shift")).limit(0)
    rows = rows.select(*ROW, F.explode(F.array(*each)).alias("e"))
    rows = rows.select(*ROW, F.col("e.size").alias("size"), F.posexplode(F.arrays_zip(F.col("e.t").alias("t"), F.col("e.low").alias("low"))).alias("place", "w"))
    if any_case:  # a window without a placeholder is the same both ways, and is there once
        rows = rows.select(*ROW, "size", "place", F.explode(F.when(F.col("w.t") == F.col("w.low"), F.array("w.t")).otherwise(F.array("w.t", "w.low"))).alias("hash"))
    else:
        rows = rows.select(*ROW, "size", "place", F.col("w.t").alias("hash"))
    return rows.join(small(windows.drop("n", "n_all")), ["hash", "size"]).select(*ROW, "item_id", "n_words", "at", "enough", (F.col("place") - F.col("at")).alias("shift"))


def _most(pairs: Column) -> Column:
    """Of pairs (b, d), those that stand for each other in most places: each b and each d is in one of them at most."""
    votes = F.transform(F.array_distinct(pairs), lambda p: F.struct(F.size(F.filter(pairs, lambda q: q == p)).alias("n"), (p["b"] == p["d"]).alias("same"), p["b"].alias("b"), p["d"].alias("d")))
    best = _let(votes, lambda v: F.filter(v, lambda p: ~F.exists(v, lambda q: ((q["b"] == p["b"]) | (q["d"] == p["d"])) & (q > p))))
    return F.transform(best, lambda p: F.struct(p["b"].alias("b"), p["d"].alias("d")))


def row_leaks(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, any_case: bool = False) -> DataFrame:
    """(doc_id, h1, h2, item_id, covered, exact): ``find_leaks`` for each row of ``docs``, told by its id and hashes of its text."""
    missing(docs, "doc_id", "text")
    missing(benchmark, "item_id", "text")
    h1, h2 = _row_hashes(F.col("text"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", h1.alias("h1"), h2.alias("h2"), "text")
    benchmark = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    windows = cut(item_windows(benchmark, any_case=any_case))
    # one row for each alignment; the windows of an item are few, so the sets are
    lines = matches(docs, windows, any_case=any_case).groupBy(*ROW, "item_id", "shift").agg(F.collect_set(F.struct("at", "enough")).alias("at"), F.max("n_words").alias("n_words"))
    lines = cut(lines)
    leak = lines.select(*[F.col(c).alias(f"l_{c}") for c in ROW]).distinct()
    same_row = F.col("doc_id").eqNullSafe(F.col("l_doc_id")) & (F.col("h1") == F.col("l_h1")) & (F.col("h2") == F.col("l_h2"))
    some = docs.join(small(leak), same_row, "left_semi").dropDuplicates(ROW).select(*ROW, words(F.col("text")).alias("dw"))
    of_row = lines.groupBy(*ROW).agg(F.collect_list(F.struct("item_id", "shift", "n_words", "at")).alias("lines")).select(*[F.col(c).alias(f"l_{c}") for c in ROW], "lines")
    # the words of a document are there once; each alignment takes those beside the item's
    first = lambda x: F.greatest(x["shift"], F.lit(0))
    beside = lambda x: F.struct(x["item_id"].alias("item_id"), x["shift"].alias("shift"), x["at"].alias("at"), F.slice("dw", first(x) + 1, F.greatest(x["shift"] + x["n_words"] - first(x), F.lit(0))).alias("dw"))
    lines = some.join(of_row, same_row).select(*ROW, F.explode(F.transform("lines", beside)).alias("l")).select(*ROW, "l.*")
    bw = benchmark.join(small(windows.groupBy("item_id").agg(*[F.first(x).alias(x) for x in ("size", "n", "n_all")])), "item_id").select("item_id", "size", "n", "n_all", "text")
    bw = small(bw, 100_000, "text").withColumn("bw", words(F.col("text"))).drop("text")
    both = lines.join(bw, "item_id")
    # the words of the item and those of the document at the same places
    pair = lambda b, d: F.struct(F.lower(b).alias("b"), F.lower(d).alias("d"), is_slot(b).alias("slot"), F.coalesce(template(b) == template(d), F.lit(False)).alias("like"))
    pairs = F.transform("bw", lambda b, i: pair(b, F.when(i + F.col("shift") >= 0, F.get(F.col("dw"), i + F.least(F.col("shift"), F.lit(0))))))
    both = both.select(*ROW, "item_id", "n", "n_all", "size", F.array_sort("at").alias("at"), pairs.alias("p"))
    slots = lambda p: F.transform(F.filter(p, lambda x: x["slot"] & x["d"].isNotNull()), lambda x: F.struct(x["b"].alias("b"), x["d"].alias("d")))
    inside = F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a["at"], a["at"] + F.col("size") - 1))))
    # a window counts if its words are all there, and the same throughout, or alike with slots that the rest agrees with
    same = lambda p: F.forall(p, lambda x: x["b"].eqNullSafe(x["d"]))
    agrees = lambda p, most: F.forall(p, lambda x: x["like"]) & (F.size(F.array_except(slots(p), most)) == 0)
    window = lambda a, most: _let(F.slice(F.col("p"), a["at"] + 1, F.col("size")), lambda p: F.struct(a["at"].alias("at"), a["enough"].alias("enough"), same(p).alias("same"), agrees(p, most).alias("agrees")))
    counted = _let(_most(slots(F.transform(inside, lambda i: F.get(F.col("p"), i)))), lambda most: F.filter(F.transform("at", lambda a: window(a, most)), lambda w: w["same"] | w["agrees"]))
    good = both.select(*ROW, "item_id", "n", "n_all", counted.alias("w"))
    places = F.transform("w", lambda w: F.struct(w["at"].alias("at"), w["enough"].alias("enough")))
    exact = F.min(F.when(F.size("w") > 0, F.forall("w", lambda w: w["same"]))).alias("exact")
    found = good.groupBy(*ROW, "item_id").agg(F.flatten(F.collect_set(places)).alias("w"), F.max("n").alias("n"), F.max("n_all").alias("n_all"), exact)
    found = found.withColumn("w", F.array_distinct("w"))
    share = F.size(F.filter("w", lambda w: w["enough"])) / F.when(F.col("n") > 0, F.col("n"))
    if any_case:
        share = F.greatest(share, F.size("w") / F.col("n_all"))
    return found.select(*ROW, "item_id", share.alias("covered"), "exact").where(F.col("covered") >= coverage)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, any_case: bool = False) -> DataFrame:
    """(doc_id, item_id, covered, exact) of each document that has at least ``coverage`` of an item's windows.

    covered: share of the item's windows found along alignments, without those whose slots differ from the rest; of all
    windows or of those with enough literal words, whichever is more. exact: whether all slots in them have the item's own
    values, case aside. Whole texts of all documents. any_case: words that differ in case alone are the same, in texts
    and items in capitals too.

    Null or empty text: nothing found. Null item_id: not looked for. Null doc_id: looked at like any other, doc_id is null.
    Each row is judged for itself; of rows with one doc_id that hold one item, the best is told, once. Items with the same
    item_id count as one. An empty table gives no rows. Clashing columns aren't read.
    """
    found = row_leaks(docs, benchmark, coverage=coverage, any_case=any_case)
    best = F.max(F.struct("covered", "exact"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.covered", "best.exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold an item.

    Options and odd rows as in ``find_leaks``; rows without a doc_id go too if they hold one, and of rows with one doc_id those
    that do. All columns stay, whatever they are called.
    """
    leaked = row_leaks(docs, benchmark, **options).select(*[F.col(c).alias(f"__leaked_{c}") for c in ROW]).distinct()
    h1, h2 = _row_hashes(docs["text"])
    return docs.join(small(cut(leaked)), docs["doc_id"].cast("long").eqNullSafe(F.col("__leaked_doc_id")) & (h1 == F.col("__leaked_h1")) & (h2 == F.col("__leaked_h2")), "left_anti")
