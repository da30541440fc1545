"""Language identification by nearest centroids of character n-gram vectors.

A text becomes a vector of hashed byte n-grams, weighted by TF-IDF and normalised. Each language has several centroids, found
by spherical k-means over its labelled texts. A text gets the language of the centroid with the largest cosine, and is
rejected if it is much further from all of them than labelled texts of its length in that language are: below a share of
their low quantile. Length counts in different n-grams, since the cosine grows with them.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import in_short_batches, missing

DIMS = 4096
#: Labelled rows that the fit reads: at most so many a language, and with many languages fewer of each, so many in all; but
#: LEAST of each language if it has them. Languages at most: more is an error.
ROWS_PER_LANG, ROWS, LEAST, LANGS = 400, 8000, 20, 1000
CENTROIDS = 4
#: A text is rejected below this share of the low quantile of the cosine among the labelled texts of the fit.
SLACK = 0.5
#: That quantile; labelled texts that it takes, by language and length, else by length; lengths, in powers of two.
QUANTILE, ENOUGH, LENGTHS = 0.01, 20, 13
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Bytes to what n-grams see: ASCII letters small, other ASCII as one space, bytes of other characters as they are.
_TABLE = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalpha() else b if b > 127 else 32 for b in range(256))
_SPACES = re.compile(rb"  +")


def counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of bytes, over the whole text."""
    b = np.frombuffer(_SPACES.sub(b" ", b" " + text.lower().encode("utf-8", "replace").translate(_TABLE) + b" "), np.uint8).astype(np.uint32)
    two = b[:-1] * 256 + b[1:]
    three = two[:-1] * 256 + b[2:] if len(b) > 2 else two[:0]
    codes = np.concatenate([b + np.uint32(1 << 24), two + np.uint32(2 << 24), three + np.uint32(3 << 24)])
    return np.bincount((codes * np.uint32(2654435761)) >> np.uint32(32 - 12), minlength=DIMS).astype(np.float32)


@dataclasses.dataclass
class Model:
    langs: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floor: float
    #: The floor by language and length (see ``length_of``), where there are labelled texts enough; ``floor`` where there aren't.
    floors: np.ndarray | None = None

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        x = np.log1p(rows) * self.idf
        return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text; no letters: (und, 0, True)."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        with_letters = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
        if with_letters and self.langs:
            rows = np.stack([counts(texts[k]) for k in with_letters])
            cosines = self.vectors(rows) @ self.centroids.T
            for k, row, length in zip(with_letters, cosines, length_of(rows).tolist(), strict=True):
                at = int(row.argmax())
                score = float(min(1.0, max(0.0, row[at])))
                out[k] = (self.langs[self.owner[at]], score, score < (self.floor if self.floors is None else self.floors[self.owner[at], length]))
        return out


def length_of(rows: np.ndarray) -> np.ndarray:
    """The number of different n-grams of each row of counts, as a power of two rounded down."""
    return np.log2(np.maximum(1, (rows > 0).sum(1))).astype(np.int64)


def floors(cosines: np.ndarray, lang: np.ndarray, length: np.ndarray, n_langs: int, slack: float, least: float) -> np.ndarray:
    """The floor by language and length. Lengths with too few labelled texts have that of the next shorter one, the shortest ``least``."""
    out = np.full((n_langs, LENGTHS), least)
    for j in range(n_langs):
        for k in range(LENGTHS):
            mine = cosines[(lang == j) & (length == k)]
            some = mine if len(mine) >= ENOUGH else cosines[length == k]
            out[j, k] = slack * float(np.quantile(some, QUANTILE)) if len(some) >= ENOUGH else out[j, k - 1] if k else least
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a start that is the same on each run: the mean's nearest vector, then each time the furthest."""
    chosen = [int((x @ x.mean(0)).argmax())]
    while len(chosen) < k:
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    centroids = x[chosen]
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(1)
        for j in range(k):
            if (nearest == j).any():
                centroids[j] = x[nearest == j].mean(0)
        centroids /= np.maximum(1e-12, np.linalg.norm(centroids, axis=1, keepdims=True))
    return centroids


def fit(labelled: DataFrame, *, rows_per_lang: int = ROWS_PER_LANG, rows: int = ROWS, centroids: int = CENTROIDS, slack: float = SLACK) -> Model:
    """Fits on a bounded sample of (doc_id, text, lang): of each language the rows with the smallest hashes of id and text.

    What comes to the driver is a vector of 4096 numbers (16 kB) for each of about 1.2 times ``rows`` rows and 20 more a language,
    since LEAST of each are taken however many languages there are: some 280 MB for 400 languages, 720 MB for LANGS. Rows without text or language aren't used; rows that repeat count once. Ties of the
    hash: one of them. Different rows are counted over all, to 2 %. No labelled rows: a model that says ``und``.
    """
    missing(labelled, "doc_id", "text", "lang")
    labelled = labelled.where("lang is not null and text is not null")
    row = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(7))
    totals = {r.lang: max(1, r.n) for r in labelled.groupBy("lang").agg(F.approx_count_distinct(row, 0.02).alias("n")).limit(LANGS + 1).collect()}
    if len(totals) > LANGS:
        raise ValueError(f"over {LANGS} languages")
    if not totals:
        return Model([], np.zeros(0, np.int64), np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), 0.0)
    each = max(LEAST, min(rows_per_lang, rows // len(totals)))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, 1.2 * each / n + 20 / n))]), F.col("lang"))
    draw = F.pmod(row, F.lit(1 << 30)) / float(1 << 30)
    # each language has its own threshold, so that rare ones keep their rows; about 1.2 * each + 20 rows of a language pass it
    sample = labelled.select("lang", "text", draw.alias("draw")).where(F.col("draw") < share).dropDuplicates(["lang", "draw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [counts(t).astype(np.uint32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), batch.column(2)], ["lang", "counts", "draw"])

    got = sample.mapInArrow(run, "lang string, counts binary, draw double").collect()
    by_lang: dict[str, list[np.ndarray]] = {}
    for r in sorted(got, key=lambda r: r.draw):
        if len(by_lang.setdefault(r.lang, [])) < each:
            by_lang[r.lang].append(np.frombuffer(bytes(r.counts), np.uint32).astype(np.float32))
    langs = sorted(by_lang)
    everything = np.concatenate([np.stack(by_lang[x]) for x in langs])
    idf = (np.log((1 + len(everything)) / (1 + (everything > 0).sum(0))) + 1).astype(np.float32)
    model = Model(langs, np.zeros(0, np.int64), np.zeros((0, DIMS), np.float32), idf, 0.0)
    owners, found = [], []
    for j, lang in enumerate(langs):
        x = model.vectors(np.stack(by_lang[lang]))
        k = max(1, min(centroids, math.ceil(len(x) / 20)))
        found.append(k_means(x, k))
        owners += [j] * k
    model.owner, model.centroids = np.array(owners), np.concatenate(found).astype(np.float32)
    nearest = (model.vectors(everything) @ model.centroids.T).max(1)
    model.floor = slack * float(nearest.min())
    lang_of = np.repeat(np.arange(len(langs)), [len(by_lang[x]) for x in langs])
    model.floors = floors(nearest, lang_of, length_of(everything), len(langs), slack, model.floor)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected, from each row's whole text.

    Null text, or none with a letter: lang_pred ``und``, score 0, rejected. A rejected text with letters keeps the nearest
    language in lang_pred. Empty tables and tables without labels: no rows, or all ``und``. Only the text is looked at;
    columns that are called like the three new ones are replaced.
    """
    missing(docs, "text")
    docs = docs.drop("lang_pred", "score", "rejected")
    at = docs.columns.index("text")
    kept = docs.schema
    schema = T.StructType([*kept.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = model.predict(part.column(at).to_pylist())
                more = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*kept.names, "lang_pred", "score", "rejected"])

    return in_short_batches(docs).mapInArrow(run, schema)


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that are rejected, null and empty texts among them. All columns stay, whatever they are called."""
    missing(docs, "text")
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield part.filter(pa.array([not rejected for _, _, rejected in model.predict(part.column(at).to_pylist())], pa.bool_()))

    return in_short_batches(docs).mapInArrow(run, docs.schema).toDF(*names)


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that is never learned from; false for a null id, which isn't learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
