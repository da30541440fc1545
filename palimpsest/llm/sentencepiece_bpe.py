"""Encoding with a SentencePiece merge-type model by backtracking, and decoding.

The library merges adjacent symbols, the best score first and the leftmost of equals. Whether two symbols are merged depends on
nothing but them, so a row of pieces is what the library gives if and only if the first piece comes out of merging its own
characters and each two neighbours come out of merging theirs. The encoder takes the longest piece at each place, found by one
pass of an Aho-Corasick automaton over the text from its end, and shorter ones where the neighbours would merge otherwise; it
goes a piece back where none fits. The pieces before a place are unique, so a place that failed once is never tried again: a
bitfield holds those places.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from palimpsest.llm.common import missing

SPACE = "▁"
#: Words and pairs of pieces that a worker remembers, and the length up to which it does; beyond that it works them out again.
WORDS, PAIRS, LONGEST = 250_000, 500_000, 24
#: Numbers of the model file's fields and kinds, fixed by its public format.
PIECES, TRAINER, MODEL_TYPE, BYTE_FALLBACK, MERGES, NORMAL = 1, 2, 3, 35, 2, 1
USER_DEFINED, UNUSED = 4, 5


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, message[at : at + size]
            at += size


class Pieces(NamedTuple):
    #: Score and id of each piece that merging can make.
    score: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int] | None
    unknown: int


def read_model(processor: SentencePieceProcessor) -> Pieces:
    """The pieces of a model. Raises for what isn't made of merges alone: other model types, user-defined and unused pieces."""
    score, ids, kinds, options = {}, {}, set(), {}
    number = 0
    for field, value in fields(processor.serialized_model_proto()):
        if field == TRAINER:
            options = dict(fields(value))
        if field == PIECES:
            piece = dict(fields(value))
            kinds.add(kind := piece.get(3, NORMAL))
            if kind == NORMAL:
                text = piece[1].decode()
                score[text], ids[text] = float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0, number
            number += 1
    if options.get(MODEL_TYPE, 1) != MERGES or kinds & {USER_DEFINED, UNUSED}:
        raise ValueError("only models of merge type without user-defined or unused pieces")
    byte_ids = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if options.get(BYTE_FALLBACK) else None
    return Pieces(score, ids, byte_ids, processor.unk_id())


def word_pattern(pieces: Iterable[str]) -> str:
    """A pattern that cuts texts only where no piece reaches across, so that words can be encoded one by one.

    A space begins a word if no piece has one after something else. Letters and signs (ASCII other than letters) are words
    apart if no piece has both side by side; characters that pieces have beside signs count as signs.
    """
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
    if any(b == SPACE != a for a, b in pairs):
        return "(?s:.+)"
    signs = {c for c in map(chr, range(128)) if not c.isalpha()}
    while more := {x for a, b in pairs for x, y in ((a, b), (b, a)) if y in signs and x not in signs and x != SPACE}:
        signs |= more
    if any(c.isascii() and c.isalpha() for c in signs):
        return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
    some = "".join(map(re.escape, sorted(signs)))
    return f"{SPACE}*(?:[^{SPACE}{some}]+|[{some}]+)|{SPACE}+"


class Encoder:
    """Encodes texts with one model; ``processor`` is the library's, for normalising, ids of special pieces and decoding.

    Inside, a piece goes by its id, and a character that is no piece by the number of pieces plus its code point.
    """

    def __init__(self, path: str) -> None:
        self.processor = SentencePieceProcessor(model_file=path)
        self.pieces = read_model(self.processor)
        self.n = self.processor.get_piece_size()
        self.text = {i: p for p, i in self.pieces.ids.items()}
        self.size = [len(self.text.get(i, " ")) for i in range(self.n)]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.pieces.ids.items():
            self.automaton.add_word(piece[::-1], i)
        self.automaton.make_automaton()
        self.word = re.compile(word_pattern(self.pieces.score))
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.prefix = [self.shorter(i) for i in range(self.n)]

    def merge(self, text: str) -> list[str]:
        """Merges the characters of a short text, the best score first, the leftmost of equals."""
        parts, score = list(text), self.pieces.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = score.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def string(self, piece: int) -> str:
        return self.text.get(piece) or chr(piece - self.n)

    def fits(self, before: int, piece: int) -> bool:
        """Whether the two stay as they are when their characters are merged anew; ``before`` is -1 at the start of a word."""
        parts = [self.string(piece)] if before < 0 else [self.string(before), self.string(piece)]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[(before + 1) << 22 | piece] = self.merge("".join(parts)) == parts
        return known

    def shorter(self, piece: int) -> int:
        """The longest piece that is a beginning of this one, or its first character; -1 for a single character."""
        text, ids = self.text.get(piece, ""), self.pieces.ids
        if len(text) < 2:
            return -1
        return next((ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in ids), self.n + ord(text[0]))

    def split(self, word: str) -> list[int]:
        """The pieces of a word, characters that are no piece among them."""
        n, total = len(word), self.n
        longest = [0] * n
        for end, piece in self.automaton.iter(word[::-1]):
            if not longest[-1 - end]:  # the longest of those that end here comes first; unknown, id 0, is never among them
                longest[-1 - end] = piece
        size, pairs, prefix = self.size, self.pairs, self.prefix
        failed, failures = bytearray(n // 8 + 1), False
        out: list[int] = []
        before, at = -1, 0
        piece = longest[0] or total + ord(word[0])
        while at < n:
            pair = (before + 1) << 22
            while piece >= 0:
                known = pairs.get(pair | piece)
                if known or known is None and self.fits(before, piece):
                    end = at + (size[piece] if piece < total else 1)
                    if not (failures and failed[end >> 3] >> (end & 7) & 1):
                        break
                piece = prefix[piece] if piece < total else -1
            if piece >= 0:
                out.append(piece)
                before, at = piece, end
                if at < n:
                    piece = longest[at] or total + ord(word[at])
            else:
                failed[at >> 3] |= 1 << (at & 7)
                failures = True
                piece = out.pop()
                at -= size[piece] if piece < total else 1
                before = out[-1] if out else -1
        return out

    def word_ids(self, word: str) -> tuple[int, ...]:
        raw, known = self.pieces.byte_ids, []
        for piece in self.split(word):
            if piece < self.n:
                known.append(piece)
            elif raw is not None:
                known += [raw[b] for b in chr(piece - self.n).encode()]
            else:
                known.append(self.pieces.unknown)
        out = tuple(known)
        if len(word) <= LONGEST:
            if len(self.known) >= WORDS:
                self.known.clear()
            self.known[word] = out
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without special ones."""
        out: list[int] = []
        known = self.known
        for word in self.word.findall(self.processor.normalize(text)):
            out += known.get(word) or self.word_ids(word)
        if self.pieces.byte_ids is None:  # unknown characters in a row are one unknown piece
            out = [x for k, x in enumerate(out) if x != self.pieces.unknown or not k or out[k - 1] != x]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a model file, made once a worker."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, model_path: str, *, end: bool = True) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text, with the model's end id after them if ``end``.

    Null text: as empty, the end id alone. Null ids stay null; rows that repeat are encoded each; very long texts are as others,
    a task holds one batch's ids. An empty table gives no rows. Other columns aren't read. Nothing is shuffled.
    """
    missing(docs, "doc_id", "text")
    read_model(SentencePieceProcessor(model_file=model_path))  # a model of another type fails here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(model_path)
        tail = [codec.processor.eos_id()] if end else []
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = [np.array(codec.encode(t or "") + tail, np.int32) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text that the ids decode to. Null ids: an empty text. Ids out of range: an error."""
    missing(encoded, "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids = part.column(1).fill_null([])
                values, ends = ids.flatten().to_numpy(), np.cumsum(pc.list_value_length(ids).to_numpy())
                texts = [processor.decode(values[a:z].tolist()) for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
