import random
import zlib

import numpy as np
import pytest
import zstandard

from palimpsest.llm import queries, token_files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_word_table_gives_the_librarys_ids(tokenizer):
    import pyarrow as pa

    rng = random.Random(3)
    parts = ["a", "Bc", " ", "  ", "\n", ".", ",", "'s", "'ll", "é", "\u00a0", "1", "\t", "…", " the", "\u3000", "<|endoftext|>", "ß.", "😀", "\x1c", "\r\n"]
    texts = ["", " ", "\n", "don't. Stop,\n\nNow.\nGo"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)]
    table = token_files.WordIds(queries.tokenizer_path())
    from palimpsest.llm.hashing import pieces

    for _ in range(2):  # the second time all parts are known
        got = [ids for _, _, data, ends in pieces(pa.array(texts), 5000) for ids in table.encode(data, ends)]
        for text, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def round_trip(spark, docs):
    out, manifest = token_files.encode_to_files(spark, docs, queries.tokenizer_path())
    return out, manifest, token_files.read_token_files(manifest, frames=3).orderBy("shard", "nth").collect()


def test_round_trip(spark, odd, clashing, empty, tokenizer):
    out, manifest, got = round_trip(spark, odd)
    want = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [w[0] for w in want]
    start = 0
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == start and r.n_tokens == len(ids) and ids[-1] == 2
        start += len(ids)
    key = lambda doc_id, ids: (repr(doc_id), ids)
    assert sorted(key(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got) == sorted(key(d, [*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for d, t in want)
    assert [bytes(r.ids) for r in round_trip(spark, clashing)[2]] == [bytes(r.ids) for r in got]
    assert round_trip(spark, empty)[2] == []
    some = token_files.fetch(manifest, spark.createDataFrame([(9,), (4,)], "doc_id long")).collect()
    assert {r.doc_id: zlib.crc32(bytes(r.ids)) for r in some} == {r.doc_id: zlib.crc32(bytes(r.ids)) for r in got if r.doc_id in (4, 9)}


def test_file_format(spark, odd):
    _, manifest, got = round_trip(spark, odd)
    path = manifest.where("n_docs > 1").first().path
    fs, at = token_files.file_system(path)
    raw = fs.open_input_file(at).read()
    mine = b"".join(bytes(r.ids) for r in got if r.shard == int(path[-11:-4]))
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == mine  # any decoder reads it
    file = token_files.TokenFile(path)
    assert file.frame(1) == bytes([r for r in got if r.shard == int(path[-11:-4])][1].ids)
    broken = bytearray(raw)
    broken[int(file.ends[0]) - 1] ^= 1
    with fs.open_output_stream(at + ".broken") as f:
        f.write(bytes(broken))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.TokenFile(path + ".broken").frame(0)
    assert token_files.TokenFile(path + ".broken").frame(1) == file.frame(1)


def test_special_tokens_as_the_plain_library_has_them(spark, tmp_path):
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(queries.tokenizer_path()), random.Random(5)
    parts = ["a", " ", "  ", "\n", ".", ",", "'s", "<|endoftext|>", " the", "\t", "é", "<|endoftext", "\u00a0"]
    texts = ["end.<|endoftext|> Next", "<|endoftext|>", "x\n<|endoftext|>\ny", *("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(500))]
    assert plain.encode(texts[0], add_special_tokens=False).ids == [437, 13, 50256, 7406]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = 0
    for r in queries.op2_token_files(spark, str(tmp_path)).orderBy("doc_id").collect():
        ids = np.array([*plain.encode(texts[r.doc_id], add_special_tokens=False).ids, queries.END_ID], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), texts[r.doc_id]
        start += len(ids)
    assert start

def thue_morse(n, letters="ab"):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_parts_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from palimpsest.llm.hashing import of_spans, pieces

    plain = Tokenizer.from_file(queries.tokenizer_path())
    morse = [thue_morse(n, letters) for n in (1024, 4096) for letters in ("ab", "ba")]
    texts = [*morse, "one two three", "two three one two", " ".join(morse), "x", "<|endoftext|> one", "", "two"]

    def check(table):
        for _ in range(2):
            got = [ids for _, _, data, ends in pieces(pa.array(texts), 3000) for ids in table.encode(data, ends)]
            for text, ids in zip(texts, got, strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:40]

    check(token_files.WordIds(queries.tokenizer_path()))
    hashes = {int(of_spans(np.frombuffer(t.encode(), np.uint8), np.zeros(1, np.int64))[0]) for t in morse}
    assert len(hashes) == len(morse)
    monkeypatch.setattr(token_files, "of_spans", lambda data, starts: of_spans(data, starts) & np.uint64(0x300000) | np.uint64(1))
    check(token_files.WordIds(queries.tokenizer_path()))  # four hashes for all
    monkeypatch.setattr(token_files, "of_spans", of_spans)
    monkeypatch.setattr(token_files, "SLOTS", 8)
    check(token_files.WordIds(queries.tokenizer_path()))  # more words than slots
