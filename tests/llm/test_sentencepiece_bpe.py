import random

import pytest
from sentencepiece import SentencePieceProcessor

from palimpsest.llm import sentencepiece_bpe as s
from palimpsest.llm.queries import PIECE_MODEL, tokenizer_path

PATH = tokenizer_path(PIECE_MODEL)


@pytest.fixture(scope="module")
def codec():
    return s.Encoder(PATH)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


CASES = ["", " ", "  a  b ", "▁x", "a\tb\n\n c", "\0z", "naïve 😀😀 text here", "日本語の文章、漢字。", "<s> </s> <unk> <0x0A>", "a" * 1000, " " * 333 + "x" + " " * 65, "ﬁ ½ é", "don't Don'T DON'T", "\r\n" * 20]


def test_cases(codec, library):
    for text in CASES:
        assert codec.encode(text) == library.encode(text), text


def test_random_texts(codec, library):
    """Characters, pieces side by side, and runs of spaces and letters, against the library."""
    rng = random.Random(3)
    alphabet, pieces = "aabetion s  ▁\n\t.é中文日本の漢字абвгд😀\0ãTH", sorted(codec.pieces.ids)
    for k in range(6000):
        if k % 3 == 0:
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        elif k % 3 == 1:
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(8)))
        else:
            text = " " * rng.randrange(40) + "a" * rng.randrange(40) + " " * rng.randrange(20)
        assert codec.encode(text) == library.encode(text), text


def test_small_tables_change_nothing(library, monkeypatch):
    """Words and pairs are forgotten again and again."""
    monkeypatch.setattr(s, "WORDS", 3)
    monkeypatch.setattr(s, "PAIRS", 5)
    text = "the quick brown foxes jumped over the lazy dogs, unbelievably " * 20
    assert s.Encoder(PATH).encode(text) == library.encode(text)


def test_goes_back(codec):
    """With these scores the longest piece first is wrong: ab is merged before bcd can be."""
    codec = s.Encoder(PATH)
    codec.pieces = s.Pieces({"bc": -1.0, "ab": -2.0, "abc": -9.0, "cd": -3.0, "bcd": -4.0}, {"a": 1, "b": 2, "c": 3, "d": 4, "bc": 5, "ab": 6, "abc": 7, "cd": 8, "bcd": 9}, None, 0)
    codec.text = {i: p for p, i in codec.pieces.ids.items()}
    codec.size = [len(codec.text.get(i, " ")) for i in range(codec.n)]
    codec.prefix = [codec.shorter(i) for i in range(codec.n)]
    codec.automaton = s.ahocorasick.Automaton()
    for p, i in codec.pieces.ids.items():
        codec.automaton.add_word(p[::-1], i)
    codec.automaton.make_automaton()
    rng = random.Random(1)
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))
        assert [codec.string(p) for p in codec.split(word)] == codec.merge(word), word


def test_long_words_take_linear_time(codec, library):
    rng = random.Random(2)
    word = "".join(rng.choice("abcdehintors") for _ in range(200_000))
    assert codec.encode(word) == library.encode(word)


def test_tables(spark, odd, clashing, empty, library):
    path = PATH
    rows = s.decode(s.encode(odd, path), path).collect()
    want = [(r.doc_id, ids := library.encode(r.text or "", add_eos=True), library.decode(ids)) for r in odd.collect()]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert s.encode(clashing, path).columns == ["doc_id", "ids"] and s.encode(clashing, path).count() == odd.count()
    assert s.decode(s.encode(empty, path), path).collect() == []
    assert s.encode(odd.where("doc_id = 4"), path, end=False).first().ids == []
    assert s.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).first().text == ""
    with pytest.raises(ValueError, match="no column"):
        s.encode(odd.drop("text"), path)


def test_query_against_library(spark, library):
    import hashlib

    from palimpsest.llm.queries import op12_sentencepiece

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in op12_sentencepiece(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_eos=True)
        assert got[r.doc_id] == (r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
