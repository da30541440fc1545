import numpy as np

from palimpsest.llm import lang_id, queries

DIR = "/root/testdata/sf0.01"


def test_accuracy(spark):
    got = queries.op7_language_id(spark, DIR).join(queries.table(spark, DIR, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and len(held) > 150
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.99
    assert all(0 <= r.score <= 1 and r.lang_pred in ("de", "en", "es", "fr") for r in got) and not any(r.rejected for r in got)


def test_odd_rows(spark, odd, clashing, empty):
    model = lang_id.fit(queries.table(spark, DIR, "documents"))
    got = {r.doc_id: r for r in lang_id.identify(odd, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in (3, 4, 5, 7))
    assert got[8].lang_pred in model.langs
    assert lang_id.identify(clashing, model).where("lang_pred = 'x'").count() == 0
    assert lang_id.identify(empty, model).count() == 0
    none = lang_id.fit(empty)
    assert {r.lang_pred for r in lang_id.identify(odd, none).collect()} == {"und"}


def test_far_texts_are_rejected(spark):
    model = lang_id.fit(queries.table(spark, DIR, "documents"))
    assert model.predict(["ぜんぜんちがうげんごのぶんしょうです " * 20])[0][2]


def test_counts_see_the_whole_text():
    a, b = lang_id.counts("abc " * 5000), lang_id.counts("abc " * 5000 + "xyz")
    assert a.sum() < b.sum() and np.abs(a - b).sum() > 0


def test_unseen_latin_languages_and_junk_are_rejected(spark):
    model = lang_id.fit(queries.table(spark, DIR, "documents"))
    rng = np.random.default_rng(1)
    far = [
        "Suomen kielessä on monta sijamuotoa ja sanat taipuvat niiden mukaan, joten lauseen järjestys on melko vapaa. Kirjasto on avoinna joka päivä.",
        "A magyar nyelvben a szavak végéhez ragok járulnak, ezért a mondat szórendje elég szabad. A könyvtár minden nap nyitva tart.",
        "Książki stoją na półkach w bibliotece, a czytelnicy przychodzą tu codziennie po południu. Rzeka płynie przez miasto.",
        "".join(rng.choice(list("asdfghjkl qwertyuiop"), 300)),
        "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 400)),
    ]
    assert [rejected for _, _, rejected in model.predict(far)] == [True] * len(far)


def plain_counts(text):
    kept = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in (" " + text.lower() + " ").encode())
    while b"  " in kept:
        kept = kept.replace(b"  ", b" ")
    found = {}
    for n in (1, 2, 3):
        for k in range(len(kept) - n + 1):
            code = int.from_bytes(kept[k : k + n], "big") + (n << 24)
            bucket = (code * 2654435761 & 0xFFFFFFFF) >> 20
            found[bucket] = found.get(bucket, 0) + 1
    return found


def test_against_plain_cosines(spark):
    """The query's rows against loops over n-grams, weights and centroids."""
    docs = queries.table(spark, DIR, "documents")
    model = lang_id.fit(docs.where(~lang_id.held_out(docs["doc_id"])))
    got = {r.doc_id: r for r in queries.op7_language_id(spark, DIR).collect()}
    for r in docs.where("length(text) < 900").orderBy("doc_id").limit(25).collect():
        x = {k: float(np.log1p(n) * model.idf[k]) for k, n in plain_counts(r.text).items()}
        length = sum(v * v for v in x.values()) ** 0.5
        cosines = [sum(v * float(c[k]) for k, v in x.items()) / length for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert abs(cosines[best] - got[r.doc_id].score) < 1e-4
        assert got[r.doc_id].lang_pred in {model.langs[model.owner[k]] for k in range(len(cosines)) if cosines[k] > cosines[best] - 1e-4}


def test_rare_languages_and_copies(spark):
    """A thousand languages of some rows each are all learned, one row a million times over counts once."""
    rows = [(k, f"w{k % 1000}x language text {k % 1000}", f"l{k % 1000}") for k in range(3000)] + [(7, "again and again", "l7")] * 500
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 1000


def test_signs_and_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog went home", "en"), ("le chat et le chien sont partis", "fr")] * 30)], "doc_id long, text string, lang string")
    model = lang_id.fit(docs)
    assert [r[0] for r in model.predict(["½ ² ①", "12 _ 7", "", None])] == ["und"] * 4 and model.predict(["the cat"])[0][0] == "en"
