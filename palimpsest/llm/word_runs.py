"""Runs of repeated words: stretches that repeat with a period, by suffix arrays and Lempel-Ziv blocks.

A word sequence is cut into the blocks that the longest previous factor (LPF) of each place gives; LPF comes from the suffix array
and the longest common prefixes (LCP) of its neighbours. A run that touches the border between two blocks is found by extending
to both sides for each possible period (Main's extensions: periods up to the next block, or to the last one twice and the next);
one strictly inside a block is a copy of an earlier run, taken over from the block's earlier occurrence, in buckets by start.

Names of word sequences come by doubling: level k names the 2^k words from each place. They give the suffix array, and the common
prefix or suffix of any two places as a descent over levels, many at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import missing
from palimpsest.llm.hashing import mix64, places

#: Words that are searched together: whole stretches up to this, or one that is longer.
TOGETHER = 1 << 18


def gram_size(min_length: int, min_exponent: int) -> int:
    """Words that recur at each place of every run: a run of n words and period q has those of n - 2q + 1 again, q words on or before."""
    return min(n - 2 * (n // min_exponent) + 1 for n in range(min_length, min_length + 4 * min_exponent))


def stretches(words: np.ndarray, doc: np.ndarray, size: int, min_length: int) -> list[tuple[int, int]]:
    """Where runs can be: stretches all of whose ``size`` words in a row occur again in their document. Equal hashes only make more."""
    n = len(words) - size + 1
    if n <= 0:
        return []
    h = np.zeros(n, np.uint64)
    for j, factor in enumerate(places(size)):
        h += mix64(words[j : j + n].astype(np.uint64)) * factor
    inside = doc[:n] == doc[size - 1 :]
    h = mix64(h ^ mix64(doc[:n].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    again &= inside
    on = np.concatenate([[-1], np.where(again, doc[:n], -1), [-1]])
    new = on[1:] != on[:-1]  # a stretch ends with its document
    begins, ends = np.flatnonzero(new & (on[1:] >= 0)), np.flatnonzero(new & (on[:-1] >= 0))
    return [(a, z + size - 1) for a, z in zip(begins.tolist(), ends.tolist(), strict=True) if z + size - 1 - a >= min_length]


class Names:
    """Names of the 2^k symbols from each place, for k = 0, 1, ... until no two places share one; place n has a name of its own.

    Symbols of different texts must differ, so that what two places share ends with the text.
    """

    def __init__(self, codes: np.ndarray) -> None:
        self.n = len(codes)
        name = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
        self.levels = []
        while True:
            self.levels.append(np.append(name, 0).astype(np.int32))
            if name.max(initial=0) == self.n:
                break
            step = 1 << (len(self.levels) - 1)
            beyond = np.zeros(self.n, np.int64)
            beyond[: max(0, self.n - step)] = name[step:]
            key = name * (self.n + 1) + beyond
            order = np.argsort(key, kind="stable")
            name = np.empty(self.n, np.int64)
            name[order] = np.cumsum(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        self.order = np.argsort(name)

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` on equal those from ``b`` on; places up to n, never equal ones."""
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            same = self.levels[k][a] == self.levels[k][b]
            step = same.astype(np.int64) << k
            out += step
            a += step
            b += step
        return out

    def common_suffix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before ``a`` equal those before ``b``."""
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            size = 1 << k
            fits = (a >= size) & (b >= size)
            same = fits & (self.levels[k][np.where(fits, a - size, 0)] == self.levels[k][np.where(fits, b - size, 0)])
            step = same.astype(np.int64) << k
            out += step
            a -= step
            b -= step
        return out


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """LPF: the longest factor from each place that begins earlier too, and where. ``lcp[r]``: of ranks r - 1 and r."""
    n = len(order)
    longest, where = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []  # places in the order of ranks, each smaller than the next, with the LCP to the one below
    for place, common in [*zip(order.tolist(), lcp.tolist(), strict=True), (-1, 0)]:
        while stack and place < stack[-1][0]:
            top, below = stack.pop()
            if below >= common:
                if below:
                    longest[top], where[top] = below, stack[-1][0]
            else:
                longest[top], where[top] = common, place
            common = min(common, below)
        stack.append((place, common))
    return longest, where


def blocks(longest: list[int], where: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, earlier occurrence or -1) of the Lempel-Ziv blocks, from the first place to the last."""
    out, at = [], 0
    while at < len(longest):
        out.append((at, at + max(1, longest[at]), where[at]))
        at = out[-1][1]
    return out


def ranges(counts: np.ndarray) -> np.ndarray:
    """1, 2, ..., count, for each count."""
    return np.arange(1, counts.sum() + 1) - np.repeat(np.cumsum(counts) - counts, counts)


def all_runs(codes: np.ndarray) -> np.ndarray:
    """Every run of ``codes`` as rows (start, end, period), by start, then end: maximal stretches of at least twice their smallest period."""
    if len(codes) < 2:
        return np.zeros((0, 3), np.int64)
    names = Names(codes)
    order = names.order
    lcp = np.concatenate([[0], names.common_prefix(order[:-1], order[1:])])
    cut = blocks(*previous_factors(order, lcp))
    bounds = np.array([*(b[0] for b in cut), len(codes)])
    sizes = np.diff(bounds)
    border = bounds[1:]  # each border, the end too
    right = np.append(sizes[1:], 0)
    left = np.minimum(border, right + 2 * sizes)
    # periods to the right of a border: what follows it equals what follows a period later
    s, p = np.repeat(border, right), ranges(right)
    before, after = names.common_suffix(s, s + p), names.common_prefix(s, s + p)
    found = [np.stack([s - before, s + p + after, p], 1)[before + after >= p]]
    # periods to the left: what follows it equals what follows a period earlier
    s, p = np.repeat(border, left), ranges(left)
    before, after = names.common_suffix(s, s - p), names.common_prefix(s, s - p)
    found.append(np.stack([s - p - before, s + after, p], 1)[before + after >= p])
    touching = np.concatenate(found)
    touching = touching[np.lexsort((touching[:, 2], touching[:, 1], touching[:, 0]))]
    first = np.concatenate([[True], (touching[1:, :2] != touching[:-1, :2]).any(1)])[: len(touching)]
    touching = touching[first]  # of the periods of one stretch the smallest
    buckets: dict[int, list[tuple[int, int]]] = {}
    for a, z, q in touching.tolist():
        buckets.setdefault(a, []).append((z, q))
    copied = []
    for a, z, earlier in cut:
        shift = a - earlier
        if earlier < 0 or z - a < 4:
            continue
        for at in range(a + 1, z - 2):
            inside = []
            for end, q in buckets.get(at - shift, ()):
                if end + shift >= z:
                    break  # ends ascend in a bucket
                inside.append((end + shift, q))
            if inside:
                buckets[at] = inside + buckets.get(at, [])  # those found before reach the block's end
                copied += [(at, end, q) for end, q in inside]
    out = np.concatenate([touching, np.array(copied, np.int64).reshape(-1, 3)])
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def runs_of(words: np.ndarray, doc: np.ndarray, min_length: int, min_exponent: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs in the documents' words, one after the other, that are long enough."""
    places_of = stretches(words, doc, gram_size(min_length, min_exponent), min_length)
    while places_of:
        size, k = 0, 0
        while k < len(places_of) and (not k or size + places_of[k][1] - places_of[k][0] <= TOGETHER):
            size, k = size + places_of[k][1] - places_of[k][0], k + 1
        mine, places_of = places_of[:k], places_of[k:]
        at = np.concatenate([np.arange(a, z) for a, z in mine])
        number = np.repeat(np.arange(k), [z - a for a, z in mine])
        found = all_runs(number * (int(words.max()) + 1) + words[at])
        length = found[:, 1] - found[:, 0]
        good = (length >= min_length) & (length >= min_exponent * found[:, 2])
        yield from zip(at[found[good, 0]].tolist(), length[good].tolist(), found[good, 2].tolist(), strict=True)


def search(texts: list[bytes], min_length: int, min_exponent: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """The runs of each text, by start, then period, and the text's words without what repeats."""
    split = [t.split() for t in texts]  # bytes are split at ASCII white space only
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for s in split for w in s), np.int64, sum(map(len, split)))
    sizes = np.array([len(s) for s in split])
    first = np.cumsum(sizes) - sizes
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    doc = np.repeat(np.arange(len(texts)), sizes)
    for start, length, period in runs_of(words, doc, min_length, min_exponent):
        k = int(doc[start])
        found[k].append((start - int(first[k]), length, period))
    collapsed = []
    for mine, runs in zip(split, found, strict=True):
        runs.sort(key=lambda r: (r[0], r[2]))
        if runs:
            kept = np.ones(len(mine), bool)
            for start, length, period in runs:
                kept[start + period : start + length] = False
            mine = [mine[k] for k in np.flatnonzero(kept).tolist()]
        collapsed.append(b" ".join(mine))
    return found, collapsed


RUN = "struct<start:long,length:long,period:long>"


def find(docs: DataFrame, *, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """(doc_id, runs, collapsed) of each row's whole text: its runs of words by start, then period, and the text without repeats.

    A run is a stretch of words with smallest period q, ``min_length`` words or more and ``min_exponent`` (2 or more) times q or
    more, that no neighbouring word extends. ``collapsed`` joins by one space the words that no run holds after its first q.
    Null text: as empty, no runs and an empty text. Null ids stay null; rows that repeat are searched each. Very long texts are
    as others: memory goes with the longest text. An empty table gives no rows. Other columns aren't read; nothing is shuffled.
    """
    missing(docs, "doc_id", "text")
    if min_exponent < 2 or min_length < 2:
        raise ValueError("runs have at least two periods and two words")
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [b"" if t is None else t for t in part.column(1).cast(pa.binary()).to_pylist()]
                found, collapsed = search(texts, min_length, min_exponent)
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                offsets = np.concatenate([[0], np.cumsum([len(runs) for runs in found])]).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(collapsed, pa.binary()).view(pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, runs array<{RUN}>, collapsed string")
