"""Insertion windows: insertions close to each other in time and place, with features of each window.

Positions are columns of the final document: start_offset and end_offset (characters), start_para and end_para.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.columns import millis
from palimpsest.operators import dominance
from palimpsest.operators.containment import with_contained

#: Kinds of what touches a window.
LATER, DELETED = 0, 1


@dataclasses.dataclass(frozen=True)
class WindowOptions:
    """A window holds what comes within ``seconds`` of its first insertion, within so many characters and paragraphs of its range."""

    seconds: float = 0
    chars: float | None = None
    paras: float | None = None
    by_author: bool = False


def range_gap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Distance of two ranges; 0 if they overlap or touch."""
    return F.greatest(F.lit(0), b_start - a_end, a_start - b_end)


def touches(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return (end >= lo) & (start <= hi)


def time_resolution(events: DataFrame) -> DataFrame:
    """Seconds to which the times of each document seem to be kept: 60, 1 or 0.001."""
    at = millis(F.col("ts"))
    return events.where("ts is not null").groupBy("doc_id").agg(F.when(F.bool_and(at % 60_000 == 0), 60.0).when(F.bool_and(at % 1000 == 0), 1.0).otherwise(0.001).alias("resolution"))


def candidates(events: DataFrame) -> DataFrame:
    """Dated insertions with text that are no moves, and whose text wasn't deleted elsewhere; undated deletions count there too."""
    not_move = ~F.coalesce("move", F.lit(False))
    deleted = events.where((F.col("type") == "del") & not_move)
    ins = events.where((F.col("type") == "ins") & not_move & F.col("ts").isNotNull() & (F.col("chars") > 0))
    return with_contained(ins, deleted, "__elsewhere", ["doc_id"], ["seq"]).where("not __elsewhere").drop("__elsewhere")


def grouped(rows: DataFrame, options: WindowOptions) -> DataFrame:
    """``rows`` with ``window``, a number in its document.

    With seconds 0 and without bounds on the place a window is what has one time (and author): no order matters, and it
    stays a grouping. Else the rows of each document (and author) are taken in order of time.
    """
    author = ["author"] if options.by_author else []
    if options.seconds == 0 and options.chars is None and options.paras is None:
        by = W.partitionBy("doc_id").orderBy(millis(F.col("ts")), *author)
        return rows.withColumn("window", F.dense_rank().over(by))
    rows = rows.withColumns({"__at": millis(F.col("ts")), "__who": F.coalesce("author", F.lit("")) if options.by_author else F.lit(""), "__named": F.col("author").isNotNull() if options.by_author else F.lit(True)})
    if options.chars is None and options.paras is None:
        return _by_time(rows, options).drop("__at", "__who", "__named")
    return _by_place(rows, options).drop("__at", "__who", "__named")


def _in_order(rows: DataFrame, *more: str) -> DataFrame:
    """The rows of each document (and author) in order of time, side by side in one partition; a task holds a batch of them."""
    keys = ["doc_id", "__who", "__named"]
    return rows.select(*keys, F.col("seq").cast("long"), "__at", *more).repartition(*keys).sortWithinPartitions(*keys, "__at", "seq")


def _numbered(rows: DataFrame, found: DataFrame) -> DataFrame:
    found = rows.join(found, ["doc_id", "seq"])
    return found.withColumn("window", F.dense_rank().over(W.partitionBy("doc_id").orderBy("__who", "__named", "window")))


def _by_place(rows: DataFrame, options: WindowOptions) -> DataFrame:
    """Windows with bounds on the place: one pass over the sorted rows, with the open windows as state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Greedy(options)
        for pdf in batches:
            out = []
            for k in zip(*(pdf[c] for c in ("doc_id", "__who", "__named", "__at", "start_offset", "end_offset", "start_para", "end_para")), strict=True):
                if k[:3] != key:
                    key, state = k[:3], Greedy(options)
                out.append(state.window(k[3:]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "seq": pdf["seq"], "window": out})

    slim = _in_order(rows, "start_offset", "end_offset", "start_para", "end_para")
    return _numbered(rows, slim.mapInPandas(run, "doc_id long, seq long, window long"))


def _by_time(rows: DataFrame, options: WindowOptions) -> DataFrame:
    """Windows by time alone: a new one starts where the last one's first insertion is too long ago. One pass over the sorted rows."""
    most = options.seconds * 1000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, number = None, 0, 0
        for pdf in batches:
            out = []
            for k in zip(pdf["doc_id"], pdf["__who"], pdf["__named"], pdf["__at"], strict=True):
                if k[:3] != key:
                    key, start, number = k[:3], k[3], 0
                elif k[3] - start > most:
                    start, number = k[3], number + 1
                out.append(number)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "seq": pdf["seq"], "window": out})

    return _numbered(rows, _in_order(rows).mapInPandas(run, "doc_id long, seq long, window long"))


def nearest(windows: list, row: tuple, options: WindowOptions) -> int | None:
    """Which of the windows (at, start, end, first paragraph, last one) is the first within the bounds on place of a row like them."""
    _, start, end, p0, p1 = row
    for k, w in enumerate(windows):
        near = options.chars is None or max(0, start - w[2], w[1] - end) <= options.chars
        if near and (options.paras is None or max(0, p0 - w[4], w[3] - p1) <= options.paras):
            return k
    return None


class Greedy:
    """Rows in order of time, each to the first open window that is near, else to a new one. Holds the open windows."""

    def __init__(self, options: WindowOptions) -> None:
        self.options, self.open, self.closed = options, [], 0

    def window(self, row: tuple) -> int:
        """The number of the window of a row (at, start, end, first paragraph, last one)."""
        at, start, end, p0, p1 = row
        while self.open and at - self.open[0][0] > self.options.seconds * 1000:
            self.open.pop(0)
            self.closed += 1
        k = nearest(self.open, row, self.options)
        if k is None:
            self.open.append(list(row))
            k = len(self.open) - 1
        w = self.open[k]
        if start < w[1]:
            w[1], w[3] = start, p0
        if end > w[2]:
            w[2], w[4] = end, p1
        return self.closed + k


def greedy(rows: list[tuple], options: WindowOptions) -> list[int]:
    """The window of each row, in order of time."""
    state = Greedy(options)
    return [state.window(row) for row in rows]


def nearby(rows: DataFrame, events: DataFrame, seconds: float) -> DataFrame:
    """doc_id, window, post_edit_chars, preceding_deleted_chars: what touches each window's range and came later, or was deleted shortly before.

    What touches a range is all but what ends before and what starts behind it, so each is a sum over points in two orders:
    one side's places, and time, downwards for what came later. A window's own insertions are in neither.
    """
    pool = events.where(~F.coalesce("move", F.lit(False)) & F.col("ts").isNotNull()).select("doc_id", "type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("chars").cast("long").alias("w"), F.col("start_offset").cast("long").alias("a"), F.col("end_offset").cast("long").alias("z"))
    sides = lambda lo, hi: F.array(F.struct(F.lit(0).alias("side"), lo.alias("x")), F.struct(F.lit(1).alias("side"), hi.alias("x")))
    point = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("t"))
    kinds = F.filter(F.array(point(LATER, -F.col("us")), point(DELETED, F.col("us"))), lambda p: (p["kind"] == LATER) | (F.col("type") == "del"))
    points = pool.select("*", F.inline(kinds)).select("doc_id", "kind", "t", "w", F.inline(sides(F.col("z"), -F.col("a"))))
    us = lambda ts: F.unix_micros(F.col(ts).cast("timestamp"))
    early = F.ceil(millis(F.col("start")) - seconds * 1000).cast("long") * 1000 - 1
    asks = rows.select("doc_id", "window", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.inline(F.array(
        F.struct(F.lit(LATER).alias("kind"), (-us("end") - 1).alias("t"), F.lit(1).alias("sign")), F.struct(F.lit(DELETED).alias("kind"), us("end").alias("t"), F.lit(1).alias("sign")),
        F.struct(F.lit(DELETED).alias("kind"), early.alias("t"), F.lit(-1).alias("sign")),
    )))
    asks = asks.select("doc_id", "kind", (F.col("window") * 2 + (F.col("sign") > 0).cast("int")).alias("id"), "t", F.inline(sides(F.col("lo"), -F.col("hi"))))
    found = dominance.sums(points, asks, ["doc_id", "kind", "side"])
    # both sides say how much there is up to the time; that counts once
    signed = (F.col("id") % 2 * 2 - 1) * (F.when(F.col("side") == 0, F.col("upto")).otherwise(0) - F.col("below"))
    chars = lambda kind: F.sum(F.when(F.col("kind") == kind, signed).otherwise(0)).cast("long")
    return found.groupBy("doc_id", F.floor(F.col("id") / 2).cast("int").alias("window")).agg(chars(LATER).alias("post_edit_chars"), chars(DELETED).alias("preceding_deleted_chars"))


def windows(events: DataFrame, options: WindowOptions = WindowOptions(by_author=True)) -> DataFrame:
    """One row a window, with its index by start and place, events, authors, range and features.

    events: doc_id, seq, type, rev_id, author, ts, chars, text, move, start_offset, end_offset, start_para, end_para, paras.
    """
    members = grouped(candidates(events), options)
    start, end = F.min("ts"), F.max("ts")
    ends = lambda pick, by, what: pick(F.struct(by, what))[what]
    rows = members.groupBy("doc_id", "window").agg(
        start.alias("start"), end.alias("end"), F.array_sort(F.collect_set("author")).alias("authors"),
        F.transform(F.sort_array(F.collect_list(F.struct("ts", "seq", "rev_id"))), lambda e: e["rev_id"]).alias("event_ids"),
        F.min("start_offset").alias("lo"), F.max("end_offset").alias("hi"), ends(F.min, "start_offset", "start_para").alias("first_para"), ends(F.max, "end_offset", "end_para").alias("last_para"),
        F.sum("chars").cast("long").alias("inserted_chars"), F.max("chars").alias("max_single_insert"), F.count(F.lit(1)).alias("insert_count"),
        F.size(F.array_distinct(F.flatten(F.collect_list("paras")))).alias("para_count"),
    )
    rows = rows.join(time_resolution(events), "doc_id")
    rows = rows.join(nearby(rows, events, options.seconds), ["doc_id", "window"])
    seconds = (millis(F.col("end")) - millis(F.col("start"))) / 1000 + F.greatest(F.lit(1.0), F.col("resolution"))
    rows = rows.withColumns({"duration_sec": seconds, "index": F.row_number().over(W.partitionBy("doc_id").orderBy("start", "lo", "window")) - 1})
    return rows.withColumns({
        "cps": F.col("inserted_chars") / F.col("duration_sec"), "span_chars": F.col("hi") - F.col("lo"), "span_paras": F.col("last_para") - F.col("first_para") + 1,
        "post_edit_ratio": F.col("post_edit_chars") / F.col("inserted_chars"), "preceded_by_deletion": F.col("preceding_deleted_chars") > 0,
    }).drop("window", "resolution", "post_edit_chars")
