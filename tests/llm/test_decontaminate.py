import random
import re
from collections import Counter

from palimpsest.llm import decontaminate as d
from palimpsest.llm import queries

ITEM = "Anna buys 12 apples and 7 pears for 3 dollars each, then gives 5 apples to her brother Tom before she walks 2 km home."
FILL = " ".join(f"filler{k} words stand around it" for k in range(30))


def found(spark, docs, items):
    return {(r.doc_id, r.item_id): r for r in d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_templates(spark):
    renamed = ITEM.replace("Anna", "Maria").replace("Tom", "Luis").replace("12", "90").replace("7 ", "33 ").replace(" 3 ", " 8 ").replace("5", "41").replace("2 km", "6 miles")
    mixed = "Maria buys 90 apples and 90 pears for 90 dollars each, then gives 90 apples to her brother Maria before she walks 90 km home."
    docs = [(1, f"{FILL} {ITEM} {FILL}"), (2, f"{FILL} {renamed} {FILL}"), (3, f"{FILL} {mixed} {FILL}"), (4, FILL), (5, f"{FILL} {ITEM.upper()}"), (6, " ".join(ITEM.split()[:9])), (7, None), (8, ""), (None, ITEM), (1, "other"), (9, "Anna " * 500)]
    got = found(spark, docs, [(10, ITEM), (11, None), (12, "two words"), (None, ITEM), (13, "Anna Tom Anna Tom 5 6 7 8 9 10 11"), (14, "what is the capital here")])
    assert got.keys() == {(1, 10), (2, 10), (None, 10)}
    assert got[1, 10].exact and got[1, 10].covered == 1 and not got[2, 10].exact


def test_short_items(spark):
    got = found(spark, [(1, "x what is the capital here y"), (2, "what is a capital here")], [(14, "what is the capital here"), (15, ITEM)])
    assert got.keys() == {(1, 14)}


def test_odd_rows(spark, odd, clashing, empty):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta", "x")], "item_id long, text string, doc_id string")
    for docs in (odd, clashing):
        assert {(r.doc_id, r.item_id) for r in d.find_leaks(docs, items).collect()} == {(1, 1), (2, 1), (None, 1)}
    assert d.find_leaks(empty, items).count() == 0 and d.find_leaks(odd, items.limit(0)).count() == 0
    left = d.decontaminate(clashing, items)
    assert left.columns == clashing.columns and left.count() == odd.count() - 4


def test_against_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (queries.table(spark, sf, t).collect() for t in ("documents", "benchmark"))
    want = {(x.doc_id, i.item_id) for x in docs for i in items if x.text and i.text in x.text}
    assert want and {(r.doc_id, r.item_id) for r in queries.op9_decontaminate(spark, sf).collect()} == want


def test_other_case_and_one_other_slot(spark, tmp_path):
    title = "What Is The Tallest Mountain Of The Northern Alps And Its Neighbour"
    one_off = ITEM.replace("gives 5", "gives 7")  # 7 stands for 7 and for 5
    docs = [(1, f"{FILL} {ITEM.upper()}"), (2, f"{FILL} {ITEM.lower()} {FILL}"), (3, f"{FILL} {title} {FILL}"), (4, f"{title.lower()} {FILL}"), (5, f"{FILL} {one_off}"), (6, FILL)]
    items = [(10, ITEM), (11, title)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r for r in queries.op9_decontaminate(spark, str(tmp_path)).collect()}
    assert got.keys() == {(1, 10), (2, 10), (3, 11), (4, 11), (5, 10)}
    assert all(got[k].exact and got[k].covered == 1 for k in ((1, 10), (2, 10), (3, 11), (4, 11)))
    assert 0.5 <= got[5, 10].covered < 1


def test_each_row_is_judged_for_itself(spark):
    """Another text under the same id neither makes an item of an inconsistent one nor takes one away."""
    mixed = "Maria buys 90 apples and 90 pears for 90 dollars each, then gives 90 apples to her brother Maria before she walks 90 km home."
    docs = [(3, mixed), (3, "other"), (4, ITEM), (4, "other"), (None, "other"), (None, f"x {ITEM}"), (4, ITEM)]
    assert found(spark, docs, [(10, ITEM)]).keys() == {(4, 10), (None, 10)}
    left = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(10, ITEM)], "item_id long, text string")).collect()
    assert sorted((repr(r.doc_id), r.text) for r in left) == sorted([("3", mixed), ("3", "other"), ("4", "other"), ("None", "other")])


def test_a_passage_many_times_in_one_text(spark):
    got = found(spark, [(1, f"{ITEM} and {FILL} " * 300), (2, "Anna buys 12 apples and 7 pears for 3 dollars each. " * 3000)], [(10, ITEM)])
    assert got.keys() == {(1, 10)} and got[1, 10].exact and got[1, 10].covered == 1


def plain(text, item, coverage=d.COVERAGE):
    """Brute force: all shifts of the item along the text. (covered, exact), or None."""
    cut = lambda t: re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[%$€£¥]|°[CcFf]", t)
    kind = lambda w: d.NUMBER if w[0].isdigit() else d.UNIT if w.lower() in d.UNITS else d.NAME if w[0].lower() != w[0] else w.lower()
    b, t = cut(item), cut(text)
    if len(b) < 4:
        return None
    size = min(len(b), d.WINDOW)
    slots = {d.NUMBER, d.NAME, d.UNIT}
    enough = [sum(kind(w) not in slots for w in b[k : k + size]) >= min(d.LITERAL, size - 1) for k in range(len(b) - size + 1)]
    covered, same_all = set(), True
    for shift in range(-len(b), len(t)):
        beside = [t[k + shift] if 0 <= k + shift < len(t) else None for k in range(len(b))]
        low = lambda x: [w and w.lower() for w in x]
        alike = lambda k: all(x is not None and kind(x) == kind(y) for x, y in zip(beside[k : k + size], b[k : k + size], strict=True))  # noqa: E731, B023
        hits = [k for k in range(len(enough)) if enough[k] and alike(k) or low(beside[k : k + size]) == low(b[k : k + size])]
        inside = sorted({i for k in hits for i in range(k, k + size)})
        pairs = [(b[i].lower(), beside[i].lower()) for i in inside if kind(b[i]) in slots and beside[i] is not None]
        votes = {(n, x == y, x, y) for (x, y), n in Counter(pairs).items()}
        most = {v[2:] for v in votes if not any(q > v and (q[2] == v[2] or q[3] == v[3]) for q in votes)}
        for k in hits:
            mine = [(b[i].lower(), beside[i].lower()) for i in range(k, k + size) if kind(b[i]) in slots]
            same = low(beside[k : k + size]) == low(b[k : k + size])
            if same or alike(k) and all(p in most for p in mine):
                covered.add(k)
                same_all = same_all and same
    share = max(len(covered) / len(enough), sum(enough[k] for k in covered) / max(1, sum(enough)))
    return (share, same_all) if share >= coverage else None


def test_renamed_and_renumbered_items_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "li", "mu", "ne", "ro", "ti") for b in ("dan", "fel", "gor", "hin", "jup", "kas", "lom", "mer", "nat")]
    names, units = ["Anna", "Tom", "Luis", "Maria", "Igor", "Yuki", "Omar"], ["km", "kg", "liters", "dollars"]

    def item():
        kinds = [rng.choices("wnsu", (12, 2, 2, 1))[0] for _ in range(rng.randrange(12, 40))]
        return [rng.choice(vocabulary) if k == "w" else str(rng.randrange(2, 99)) if k == "n" else rng.choice(names) if k == "s" else rng.choice(units) for k in kinds]

    def renamed(words):
        other = dict(zip(names, rng.sample(["Pia", "Bert", "Chen", "Dora", "Emil", "Fritz", "Gina"], 7), strict=True)) | dict(zip(units, rng.sample(["miles", "grams", "feet", "euros"], 4), strict=True))
        numbers = dict(zip(map(str, range(2, 99)), map(str, rng.sample(range(100, 999), 97)), strict=True))
        return [other.get(w) or numbers.get(w, w) for w in words]

    filler = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [item() for _ in range(40)]
    docs, planted = [], set()
    for k, x in enumerate(items):
        new = renamed(x)
        docs.append((k, " ".join(filler(30) + new + filler(20))))
        planted.add((k, k))
        docs.append((100 + k, " ".join(filler(10) + new[: len(new) // 4] + filler(40))))
        broken = [w if not w[0].isdigit() and not w[0].isupper() else rng.choice(["Pia", "Bert", "7", "9"]) for w in x]
        docs.append((200 + k, " ".join(broken + filler(5))))
    texts = [" ".join(x) for x in items]
    want = {(i, k): w for i, t in docs for k, x in enumerate(texts) if (w := plain(t, x))}
    got = d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"), any_case=True).collect()
    assert {(r.doc_id, r.item_id): (r.covered, r.exact) for r in got} == want
    assert len(planted & want.keys()) >= 0.9 * len(planted)
    assert not {k for k in want if 100 <= k[0] < 200}


SCRIPTS = {"han": (0x4E00, 0x5200), "hiragana": (0x3041, 0x3094), "thai": (0x0E01, 0x0E2F), "khmer": (0x1780, 0x17B0), "myanmar": (0x1000, 0x1020), "lao": (0x0E94, 0x0EA0)}


def test_scripts_without_spaces(spark):
    """Items verbatim and with other numbers, in the middle of text without a space: all are found, and nothing else."""
    rng = random.Random(8)
    docs, items, want = [], [], set()
    for letters in SCRIPTS.values():
        some = lambda n, letters=letters: "".join(chr(rng.randrange(*letters)) for _ in range(n))
        for _ in range(10):
            parts = [some(rng.randrange(8, 20)) for _ in range(3)]
            numbers = [rng.randrange(10, 99) for _ in range(2)]
            filled = lambda n, parts=parts: f"{parts[0]}{n[0]}{parts[1]}{n[1]}{parts[2]}"
            k = len(items)
            items.append((k, filled(numbers)))
            docs += [(10 * k, some(200) + filled(numbers) + some(100)), (10 * k + 1, some(50) + filled([n + 100 for n in numbers]) + some(300)), (10 * k + 2, some(400)), (10 * k + 3, some(80) + parts[0][:6] + some(80))]
            want |= {(10 * k, k), (10 * k + 1, k)}
    got = found(spark, docs, items)
    assert got.keys() == want and all(r.exact == (doc % 10 == 0) for (doc, _), r in got.items())


def test_digits_of_other_scripts(spark):
    item = "when the train has gone for ٣٤ minutes at a speed of ٨٨ units how far is it then"
    docs = [(1, f"{FILL} {item}"), (2, f"{FILL} {item.replace(chr(0x663) + chr(0x664), chr(0x968) + chr(0x967))}"), (3, f"{FILL} {item.replace(chr(0x668) * 2, '88')} {FILL}"), (4, FILL)]
    got = found(spark, docs, [(1, item)])
    assert got.keys() == {(1, 1), (2, 1), (3, 1)} and got[1, 1].exact and not got[2, 1].exact
