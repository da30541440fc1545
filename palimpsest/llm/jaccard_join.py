"""N-gram Jaccard join: all documents whose sets of word shingles are alike, without comparing all with all.

1. ``sets_of`` hashes each text's shingles. Documents with the same set are one node from here on (two hashes of the set
   must be equal, 128 bits); shingles that occur often are counted over all documents.
2. Each node orders its shingles by one order for all, the rare first. Nodes that are alike share a shingle among the first
   few (prefix filter). Only those are shuffled.
3. Nodes of keys that very many share are linked first, block by block; then one node of each component goes on to the next
   round. So a large group of near copies soon is one component, and its blocks needn't meet.
4. Nodes of different components that share a key are candidates where their lengths (length filter), the index prefix of the
   smaller one and what can follow after the places of the key in both (positional filter) allow it. Candidates are dealt
   out as pairs of blocks of nodes, never as pairs of nodes of a group.
5. A task with a pair of blocks gets the nodes' counts by slices of the hash space, and drops nodes that have no other with
   which they could have enough in common (length and suffix filter; the suffix filter bounds what the whole sets share by
   what their slices do). Of the others it gets the texts, each once, counts the common shingles by hash, compares the
   shingles themselves before it links, and returns as many links as hold its classes together.
6. Links are contracted to components by their smallest members.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, in_short_batches, missing, small, stored
from palimpsest.llm.hashing import BYTE, mix64, pieces, places

#: Shingles that come last in the order, at most: 16 bytes each in every task.
FREQUENT = 1 << 19
#: Shingles of a block of nodes, and the most nodes of one. A task holds two blocks.
BLOCK, NODES = 1 << 16, 256
#: A key that more nodes have than this is hot: its nodes are linked in rounds before pairs of blocks are made.
HOT = 1 << 12
#: Bytes of text that are looked at at once, and shingles that are counted at once.
CHUNK, COUNTED = 1 << 19, 1 << 21
#: Shingles in a slice of the hash space, about, for the suffix filter; fewest slices.
SLICE, SLICES = 8, 16
_U = np.uint64
_rng = np.random.default_rng(7)
_PLACES = _rng.integers(1, 2**64 - 1, 64, dtype=_U) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclasses.dataclass(frozen=True)
class Likeness:
    """Shingles of ``size`` words; alike if 100 * common >= percent * union."""

    size: int = 5
    percent: int = 80

    def overlap(self, n):
        """Common shingles that two sets of n shingles together need."""
        return -(-self.percent * n // (100 + self.percent))


def shingles(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles' 64-bit hashes of texts that lie one after the other: (hash, number of its text), each hash once a text.

    data: UTF-8 bytes; ends: where each text ends. Words are runs without ASCII white space, A-Z lower-cased. A text with
    fewer words than ``size`` has one shingle, all of it; one without words has none.
    """
    data = _LOWER[data]
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = np.concatenate([[0], ends[:-1]])
    heads = first[first < len(data)]
    starts[heads] = inside[heads]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    text, inside = data[at[0] :], inside[at[0] :]  # from the first word on
    spans = np.diff(np.append(at, len(data)))
    place = np.arange(len(text), dtype=np.int32) - np.repeat((at - at[0]).astype(np.int32), spans)
    value = BYTE[text] * places(int(spans.max()))[place]
    value *= inside
    word = mix64(np.add.reduceat(value, at - at[0]))
    n_words = np.diff(np.searchsorted(at, np.concatenate([[0], ends])))
    owner = np.repeat(np.arange(len(ends)), n_words)
    full = np.zeros(max(0, len(word) - size + 1), _U)
    for k in range(size):
        full += word[k : len(word) - size + 1 + k] * _PLACES[k]
    whole = np.flatnonzero(owner[: len(full)] == owner[size - 1 :])
    h, o = mix64(full[whole]), owner[whole]
    if len(few := np.flatnonzero((n_words > 0) & (n_words < size))):
        begin = np.concatenate([[0], np.cumsum(n_words)])
        lone = [(word[begin[t] : begin[t + 1]] * _PLACES[: n_words[t]]).sum() + _U(n_words[t]) for t in few]
        o = np.concatenate([o, few])
        order = np.argsort(o, kind="stable")
        h, o = np.concatenate([h, mix64(np.array(lone, _U))])[order], o[order]
    edges = np.flatnonzero(np.diff(o, prepend=-1, append=-1)).tolist()
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        h[a:z].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], o[keep]


def signatures(h: np.ndarray, o: np.ndarray, n: int, twins: np.ndarray | None = None, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each text's set, a second one that confirms it, and the set's size.

    twins: hashes that different sets have; those sets go by the two hashes' exclusive or. Fewer ``bits`` of the first are for tests.
    """
    sizes = np.bincount(o, minlength=n)
    found = []
    for salt in (_U(0x5851F42D4C957F2D), _U(0x2545F4914F6CDD1D)):
        sums = np.zeros(n, _U)
        if len(h):
            some = np.flatnonzero(sizes)
            sums[some] = np.add.reduceat(mix64(h ^ salt), np.searchsorted(o, some))
        found.append(mix64(sums + sizes.astype(_U)))
    sig, check = found
    sig = sig >> _U(64 - bits)
    if twins is not None and len(twins):
        sig = np.where(np.isin(sig, twins), sig ^ check, sig)
    return sig, check, sizes


def shingle_set(text: bytes, size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    words = text.lower().split()
    return set(zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else {tuple(words)} if words else set()


def slices_of(h: np.ndarray, o: np.ndarray, n: int) -> list[bytes]:
    """How many of each of n texts' shingles are in each slice of the hash space: a byte each, a power of two of them by size.

    Empty if a count doesn't fit, so that the text is never filtered.
    """
    sizes = np.bincount(o, minlength=n)
    bits = np.maximum(int(np.log2(SLICES)), np.ceil(np.log2(np.maximum(sizes, 1) / SLICE)).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(1 << bits)])
    at = first[o] + (h >> (64 - bits[o]).astype(_U)).astype(np.int64)
    found = np.bincount(at, minlength=first[-1])
    raw, over = found.astype(np.uint8).tobytes(), set(np.searchsorted(first, np.flatnonzero(found > 255), "right").tolist())
    return [b"" if k + 1 in over else raw[a:z] for k, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))]


def possible_pairs(sizes: np.ndarray, slices: list[bytes], like: Likeness) -> np.ndarray:
    """Which pairs of sets, in order of their sizes, may be alike: by the length filter, and by what their slices have in common at most."""
    n = len(sizes)
    counts = np.array([len(x) for x in slices])
    stop = np.searchsorted(sizes * like.percent, sizes * 100, "right")
    out = np.zeros((n, n), bool)
    for size in np.unique(counts):
        mine = np.flatnonzero((counts == size) & (stop > np.arange(n) + 1))
        if not len(mine):
            continue
        a, z = mine[0], stop[mine].max()
        table = np.zeros((z - a, max(size, 1)), np.int16)
        for k in range(a, z):  # those with more slices are folded; those with none or fewer can't be told
            if size and counts[k] >= size:
                table[k - a] = np.frombuffer(slices[k], np.uint8).reshape(size, -1).sum(1)
        known = (counts[a:z] >= size) & (size > 0)
        for k in mine:
            others = np.arange(k + 1, stop[k])
            most = np.minimum(table[k - a], table[others - a]).sum(1, dtype=np.int64)
            out[k, others] = ~known[others - a] | (most >= like.overlap(sizes[k] + sizes[others]))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sets_of(docs: DataFrame, like: Likeness, bits: int = 64) -> DataFrame:
    """For each row doc_id, sig (of its set), check (a second hash), n (its size) and slices; and rows without n: a shingle that a task met ``times`` in different sets."""

    names = ["doc_id", "sig", "check", "n", "times", "slices"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch | None:
            values = np.concatenate(held)
            held.clear()
            met.clear()
            values.sort()
            edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
            times = np.diff(edges)
            often = times > 1
            return _batch(np.zeros(often.sum(), np.int64), signed(values[edges[:-1][often]]), times[often]) if often.any() else None

        for batch in batches:
            ids = batch.column(0)
            for a, z, data, ends in pieces(batch.column(1), CHUNK):
                h, o = shingles(data, ends, like.size)
                sig, check, n = signatures(h, o, z - a, bits=bits)
                parts = slices_of(h, o, z - a)
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.array(signed(sig)), pa.array(signed(check)), pa.array(n), pa.nulls(z - a, pa.int64()), pa.array(parts, pa.binary())], names)
                new = np.zeros(z - a, bool)
                for k, s in enumerate(sig.tolist()):
                    if s not in met:
                        met.add(s)
                        new[k] = True
                held.append(h[new[o]])
                if sum(map(len, held)) > COUNTED and (got := counted()):
                    yield got
        if held and (got := counted()):
            yield got

    def _batch(doc: np.ndarray, sig: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(sig), pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.int64()), pa.array(times), pa.nulls(len(doc), pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, sig long, check long, n long, times long, slices binary")


def twin_hashes(sets: DataFrame, most: int = 100_000) -> np.ndarray:
    """The hashes that more than one set has, told by the second hash and the size: for 10^11 sets, some 300 are to be expected."""
    found = sets.groupBy("sig").agg(F.min("check").alias("c"), F.max("check").alias("d"), F.min("n").alias("n"), F.max("n").alias("m"))
    rows = found.where("c <> d or n <> m").select("sig").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} hashes stand for more than one set")
    return np.sort(np.array([r.sig for r in rows], np.int64).view(_U))


def frequent_shingles(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(hash, times) of the shingles that were met most often, ``most`` at most, sorted by hash.

    Tasks leave out what they met once, so a count may be short; that changes the order, never the result.
    """
    sums = cut(counts.groupBy("sig").agg(F.sum("times").alias("times")).where("times > 2"))
    least, n = 3, 0
    for r in sums.groupBy(F.least("times", F.lit(100_000)).alias("t")).count().orderBy(F.col("t").desc()).collect():
        n += r["count"]
        if n > most:
            least = r.t + 1
            break
    rows = sums.where(F.col("times") >= least).limit(most).toArrow()
    keys, times = rows["sig"].to_numpy().astype(np.int64).view(_U), rows["times"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], times[order]


class Order:
    """The order of all shingles: those that aren't frequent by their hash, then the frequent ones, the rarest first."""

    def __init__(self, keys: np.ndarray, times: np.ndarray):
        self.keys, self.times = keys, times
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(keys >> _U(42)).astype(np.int64)] = True

    def often(self, h: np.ndarray) -> np.ndarray:
        """How often each was met, 0 if it isn't frequent."""
        out = np.zeros(len(h), np.int64)
        some = np.flatnonzero(self.maybe[(h >> _U(42)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == h[some], self.times[at], 0)
        return out

    def first(self, h: np.ndarray, o: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sets that lie one after the other, each sorted, the first ``want`` of each: (index, place)."""
        often = self.often(h)
        rare = often == 0
        before = np.concatenate([[0], np.cumsum(rare)])
        n = len(want)
        begin = np.searchsorted(o, np.arange(n + 1))
        place = before[:-1] - before[begin[:-1]][o]
        index = np.flatnonzero(rare & (place < want[o]))
        places = [place[index]]
        found = [index]
        rares = before[begin[1:]] - before[begin[:-1]]
        for t in np.flatnonzero(rares < want):
            rest = np.flatnonzero(~rare[begin[t] : begin[t + 1]]) + begin[t]
            rest = rest[np.lexsort((h[rest], often[rest]))][: want[t] - rares[t]]
            found.append(rest)
            places.append(rares[t] + np.arange(len(rest)))
        return np.concatenate(found), np.concatenate(places)


def prefixes(docs: DataFrame, like: Likeness, keys: np.ndarray, times: np.ndarray, twins: np.ndarray | None = None, bits: int = 64) -> DataFrame:
    """key, sig, n, place, known: the shingles among which nodes that are alike must share one. A task gives each set once.

    known: the shingle is frequent, so more than one set is known to have it.
    """
    sent = docs.sparkSession.sparkContext.broadcast((keys, times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*sent.value)
        met: set[int] = set()
        for batch in batches:
            for a, z, data, ends in pieces(batch.column(1), CHUNK):
                h, o = shingles(data, ends, like.size)
                sig, _, n = signatures(h, o, z - a, twins, bits)
                new = np.zeros(z - a, bool)
                for k, s in enumerate(sig.tolist()):
                    if s not in met and n[k]:
                        met.add(s)
                        new[k] = True
                # the other set has percent of this one's size at least; so they have percent of it in common
                want = np.where(new, n - (-(-like.percent * n // 100)) + 1, 0)
                at, place = order.first(h, o, want)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h[at])), pa.array(signed(sig[o[at]])), pa.array(n[o[at]]), pa.array(place), pa.array(order.often(h[at]) > 0)], ["key", "sig", "n", "place", "known"])

    return docs.mapInArrow(run, "key long, sig long, n long, place long, known boolean")


def blocks_of(nodes: DataFrame, weight: int = BLOCK) -> DataFrame:
    """sig, n, block: nodes with the same first key and about the same size lie together, a block has about ``weight`` shingles, and at most NODES nodes.

    nodes: sig, n, home. Ranges of them go to tasks, and each task cuts its own.
    """
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            out = []
            for n in batch.column(1).to_pylist():
                size = max(n, weight // NODES)
                if held and held + size > weight:
                    block, held = block + 1, 0
                held += size
                out.append(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["sig", "n", "block"])

    return nodes.repartitionByRange(parts, "home", "n", "sig").sortWithinPartitions("home", "n", "sig").select("sig", "n").mapInArrow(run, "sig long, n long, block long")


def shared_keys(entries: DataFrame) -> DataFrame:
    """key, sig, n, place of the keys that more than one set has.

    Keys known to be shared are dealt out with a part of the set's hash, so that a hot one doesn't end in one task.
    """
    entries = entries.withColumn("salt", F.when(F.col("known"), F.pmod("sig", F.lit(997)) + 1).otherwise(0))
    by_key = W.partitionBy("key", "salt")
    rows = entries.withColumn("lo", F.min("sig").over(by_key)).withColumn("hi", F.max("sig").over(by_key)).where("salt > 0 or lo <> hi")
    return rows.groupBy("key", "salt", "sig").agg(F.min("n").alias("n"), F.min("place").alias("place")).drop("salt")  # a set that several tasks met


def candidates(shared: DataFrame, blocks: DataFrame, like: Likeness) -> DataFrame:
    """(left, right, sig): the pairs of blocks in which nodes of different components share a key, and the nodes that do.

    shared: key, sig, n, place, root (the node's component so far). Sets of n and m shingles, n <= m, have overlap(n + m) in
    common. The first key that they share is at place n - overlap(2n) at most in the smaller one: its index prefix; the sizes
    differ by percent at most; and after its places i and j there is still room for the overlap: min(n - i, m - j) at least.
    """
    index = F.col("n") - F.ceil(F.lit(2 * like.percent) * F.col("n") / (100 + like.percent) - 1e-9)
    rows = shared.join(small(blocks.select("sig", "block")), "sig").withColumn("indexed", F.col("place") <= index)
    indexed = F.when(F.col("indexed"), F.col("n"))
    sums = [f(c).alias(a) for f, c, a in ((F.min, "n", "n_min"), (F.max, "n", "n_max"), (F.min, indexed, "i_min"), (F.max, indexed, "i_max"), (F.max, F.col("n") - F.col("place"), "room"), (F.min, "root", "r_min"), (F.max, "root", "r_max"))]
    blocks_of_key = rows.groupBy("key", "block").agg(*sums).withColumnRenamed("block", "other")
    both = rows.join(blocks_of_key, "key").where((F.col("r_min") != F.col("root")) | (F.col("r_max") != F.col("root")))
    smaller = F.col("indexed") & (F.col("n_max") >= F.col("n")) & (F.col("n_min") * like.percent <= F.col("n") * 100)
    larger = (F.col("i_min") <= F.col("n")) & (F.col("i_max") * 100 >= F.col("n") * like.percent)
    need = F.ceil(F.lit(like.percent) * (F.col("n") + F.col("n_min")) / (100 + like.percent) - 1e-9)
    room = F.least(F.col("n") - F.col("place"), F.col("room")) >= need
    return both.where((smaller | larger) & room).select(F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "sig").distinct()


def links_in_rounds(rows: DataFrame, link, block: int = BLOCK) -> DataFrame:
    """(a, b) links among the nodes of hot keys. rows: key, sig, n. link: gives the links of (left, right, sig), each from the least node of a class.

    Each round puts the nodes of a key into blocks and links within blocks alone; of what is linked, the least goes on to the
    next round. So a group of n near copies leaves n / NODES nodes. It ends where that no longer halves them; what isn't linked
    by then is left to the pairs of blocks.
    """
    rows, edges = cut(rows.select("key", "sig", "n")), None
    before = rows.count()
    while True:
        blocks = cut(blocks_of(rows.withColumnRenamed("key", "home"), block)).select("block", "sig").distinct()
        new = cut(link(blocks.select(F.col("block").alias("left"), F.col("block").alias("right"), "sig")))
        edges = new if edges is None else edges.unionByName(new)
        rows = cut(rows.join(small(new.select(F.col("b").alias("sig")).distinct()), "sig", "left_anti").select("key", "sig", "n"))
        now = rows.count()
        if 2 * now > before:
            return edges
        before = now


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with root: the component of the node, or the node itself."""
    roots = roots.select(F.col("node").alias("sig"), F.col("root").alias("r"))
    return rows.join(small(roots), "sig", "left").withColumn("root", F.coalesce("r", "sig")).drop("r")


def common_counts(h: np.ndarray, o: np.ndarray, n: int) -> np.ndarray:
    """How many shingles each two of n sets share; h: hashes, o: the set of each."""
    order = np.argsort(h, kind="stable")
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    number = np.cumsum(new) - 1
    more = np.bincount(number) > 1
    keep = more[number]
    number, o = np.unique(number[keep], return_inverse=True)[1], o[keep]
    out = np.zeros((n, n), np.float32)
    if not len(o):
        return out
    step = max(1, (1 << 22) // n)
    cuts = np.searchsorted(number, np.arange(0, number[-1] + step + 1, step))
    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        some = np.zeros((n, step), np.float32)
        some[o[a:z], number[a:z] - k * step] = 1
        out += some @ some.T
    return out


def links_among(texts: list[str], sigs: list[int], like: Likeness, twins: np.ndarray | None = None, bits: int = 64) -> list[tuple[int, int]]:
    """Links that hold the classes of these texts together, from the least signature of each to the others.

    Shingles of one hash make sets look more alike, never less; so where the hashes say alike, the shingles have the last word.
    """
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(d) for d in data])
    h, o = shingles(np.frombuffer(b"".join(data), np.uint8), ends, like.size)
    sig, _, sizes = signatures(h, o, len(texts), twins, bits)
    sizes[signed(sig) != np.array(sigs)] = 0  # another row with the same doc_id
    mine = sizes[o] > 0
    h, o = h[mine], o[mine]
    order = np.argsort(sizes, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    o, sizes, sigs = rank[o], sizes[order], [sigs[k] for k in order]
    n = len(sigs)
    possible = possible_pairs(sizes, slices_of(h, o, n), like)
    if not possible.any():
        return []
    used = possible.any(0) | possible.any(1)
    mask = used[o]
    some = np.flatnonzero(used)
    at = np.full(n, -1)
    at[some] = np.arange(len(some))
    common = common_counts(h[mask], at[o[mask]], len(some))
    x, y = np.nonzero(possible)
    both = common[at[x], at[y]].astype(np.int64)
    hold = 100 * both >= like.percent * (sizes[x] + sizes[y] - both)
    root = list(range(n))
    last: dict[int, set] = {}  # pairs come in order of their first, whose set is kept for the next

    def alike(x: int, y: int) -> bool:
        if x not in last:
            last.clear()
            last[x] = shingle_set(data[order[x]], like.size)
        a, b = last[x], shingle_set(data[order[y]], like.size)
        common = len(a & b)
        return 100 * common >= like.percent * (len(a) + len(b) - common)

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in zip(x[hold].tolist(), y[hold].tolist(), strict=True):
        ra, rb = find(a), find(b)
        if ra != rb and alike(a, b):
            root[max(ra, rb)] = min(ra, rb)
    least: dict[int, int] = {}
    for k in range(n):
        least[find(k)] = min(sigs[k], least.get(find(k), sigs[k]))
    return [(least[find(k)], sigs[k]) for k in range(n) if sigs[k] != least[find(k)]]


def by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
    """Of rows sorted by their first two columns: these, and the list of the rest of the rows that have them."""
    key, held = None, []
    for batch in batches:
        for left, right, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (left, right) != key:
                if held:
                    yield *key, held
                key, held = (left, right), []
            held.append(tuple(rest))
    if held:
        yield *key, held


def filtered(found: DataFrame, slices: DataFrame, like: Likeness) -> DataFrame:
    """The rows of ``found`` (left, right, sig) whose node may be alike another of the two blocks. slices: sig, n, slices."""
    parts = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, rows in by_pair(batches):
            rows.sort(key=lambda r: r[1])
            may = possible_pairs(np.array([r[1] for r in rows]), [r[2] for r in rows], like)
            used = np.flatnonzero(may.any(0) | may.any(1))
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array([left] * len(used), pa.int64()), pa.array([right] * len(used), pa.int64()), pa.array([rows[k][0] for k in used], pa.int64())], ["left", "right", "sig"])

    rows = slices.join(small(found), "sig").select("left", "right", "sig", "n", "slices").repartition(parts, "left", "right").sortWithinPartitions("left", "right")
    return rows.mapInArrow(run, "left long, right long, sig long")


def verified(found: DataFrame, texts: DataFrame, like: Likeness, twins: np.ndarray | None = None, bits: int = 64) -> DataFrame:
    """(a, b) signatures of linked nodes. found: left, right, sig. texts: sig, text, one row each."""
    parts = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in by_pair(batches):
            pairs = links_among([t for _, t in rows], [s for s, _ in rows], like, twins, bits) if len(rows) > 1 else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = texts.join(small(found), "sig").select("left", "right", "sig", "text").repartition(parts, "left", "right").sortWithinPartitions("left", "right", "sig")
    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node that is reached.

    Each round links all larger neighbours of a node to its smallest one, then all smaller ones; the rows never get more than
    two for each edge, and a long chain needs a number of rounds like the logarithm of its length.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        star = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        star = cut(star)
        n_star, n_edges = star.count(), edges.count()
        same = n_star == n_edges and star.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = star
        if same:
            break
    else:
        raise RuntimeError(f"components after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def join_components(docs: DataFrame, like: Likeness = Likeness(), *, frequent: int = FREQUENT, block: int = BLOCK, hot: int = HOT, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs``, over whole texts.

    Documents are linked if their sets of shingles are alike; component_id is the smallest doc_id that links reach, the
    document itself included. Null text, or one without words: no shingles, linked with nothing. Null doc_id: linked with
    nothing, component_id is null. Rows that repeat: linked like any others. An empty table gives none. Other columns aren't read.
    The other options change the cost, never the result.
    """
    missing(docs, "doc_id", "text")
    docs = in_short_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    rows = stored(sets_of(docs, like, bits), "shingle-sets")
    twins = twin_hashes(rows.where("n > 0"))
    if len(twins):
        rows = rows.withColumn("sig", F.when(F.col("n").isNotNull() & F.col("sig").isin(signed(twins).tolist()), F.col("sig").bitwiseXOR(F.col("check"))).otherwise(F.col("sig")))
    every = rows.where("n is not null").select("doc_id", "sig", "n")
    docs, slim = docs.where("doc_id is not null"), every.where("doc_id is not null")
    nodes = slim.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("first"))
    keys, times = frequent_shingles(rows.where("times is not null"), frequent)

    def link(found: DataFrame) -> DataFrame:
        found = cut(found)
        slices = rows.where("n is not null").join(small(found.select("sig").distinct()), "sig", "left_semi").select("sig", "n", "slices").dropDuplicates(["sig"])
        found = cut(filtered(found, slices, like))
        wanted = cut(found.select("sig").distinct().join(nodes, "sig").select("sig", F.col("first").alias("w_doc")))
        texts = docs.join(small(wanted), docs["doc_id"] == F.col("w_doc")).select("sig", "text")
        return verified(found, texts, like, twins, bits)

    shared = cut(shared_keys(prefixes(docs, like, keys, times, twins, bits)))
    many = cut(shared.groupBy("key").count().where(F.col("count") > hot).select("key"))
    early = None if many.isEmpty() else links_in_rounds(shared.join(small(many), "key", "left_semi"), link, block)
    if early is None:
        shared = shared.withColumn("root", F.col("sig"))
    else:  # keys whose nodes are in one component have nothing more to say
        early = components(early)
        shared = cut(with_roots(shared, early))
        open_keys = shared.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        shared = cut(shared.join(small(open_keys), "key", "left_semi"))
    homes = shared.groupBy("sig", "n").agg(F.min("key").alias("home"))
    blocks = cut(blocks_of(homes, block))
    edges = link(candidates(shared, blocks, like))
    roots = components(edges if early is None else edges.unionByName(early.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    firsts = nodes.groupBy("sig").agg(F.min("first").alias("first"))
    linked = roots.join(firsts, F.col("node") == F.col("sig")).groupBy("root").agg(F.min("first").alias("least"))
    linked = cut(roots.join(linked, "root").select(F.col("node").alias("sig"), "least"))
    of_node = nodes.join(linked, "sig", "left").select("sig", "n", F.coalesce("least", "first").alias("component_id"))
    alone = every.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return slim.where("n > 0").join(of_node, ["sig", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def drop_near_copies(docs: DataFrame, like: Likeness = Likeness(), **options) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id. Rows with a null doc_id stay."""
    gone = join_components(docs, like, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
