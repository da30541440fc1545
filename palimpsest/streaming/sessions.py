"""Sessions and buckets over a stream of edit events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FOUND = "doc_id long, kind string, start timestamp, end timestamp, events long, ins_chars long, del_chars long"
SESSION, LATE = "session", "late"


def merged(sessions: list[list], row: tuple[int, int, int], gap: int) -> list[list]:
    """The sessions [start, end, events, ins, del] with one more event (at, ins, del), which may join two of them."""
    at, ins, gone = row
    near = [s for s in sessions if s[0] - gap <= at <= s[1] + gap]
    one = [min([at, *(s[0] for s in near)]), max([at, *(s[1] for s in near)]), 1, ins, gone]
    for s in near:
        one[2:] = [a + b for a, b in zip(one[2:], s[2:], strict=True)]
    return sorted([s for s in sessions if s not in near] + [one])


class OpenSessions(StatefulProcessor):
    """The sessions of one document that may still grow. They come out ``wait`` after the document's last event arrived; until ``keep``
    after that event the state knows how far they reached, so that what arrives behind them is told as late. Then it ends."""

    def __init__(self, gap: int, wait: int, keep: int) -> None:
        self.gap, self.wait, self.keep = gap, wait, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, end long, events long, ins long, del long")
        self.told = handle.getValueState("told", "upto long, arrived long")

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])
        for c in ("start", "end"):
            out[c] = pd.to_datetime(out[c], unit="us", utc=True)
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        kept = [list(s) for s in self.open.get()] if self.open.exists() else []
        upto, arrived = self.told.get() if self.told.exists() else (None, 0)
        late = []
        for r in pd.concat(list(rows)).sort_values(["at", "ins", "gone"], kind="stable").itertuples():
            if upto is not None and r.arrived - arrived > self.keep * 1000:
                upto = None  # the state's time is over, though its timer hasn't fired yet
            arrived = max(arrived or 0, r.arrived)
            if upto is not None and r.at <= upto + self.gap:
                late.append((key[0], LATE, r.at, r.at, 1, r.ins, r.gone))  # its session has come out
            else:
                kept = merged(kept, (r.at, r.ins, r.gone), self.gap)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(arrived) // 1000 + (self.wait if kept else self.keep))
        if kept:
            self.open.put([tuple(int(x) for x in s) for s in kept])
        self.told.update((upto, int(arrived)))
        yield self._frame(late)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = list(self.open.get()) if self.open.exists() else []
        if not kept:
            self.told.clear()
            yield self._frame([])
            return
        upto, arrived = self.told.get()
        self.open.clear()
        self.told.update((max([s[1] for s in kept] + ([upto] if upto is not None else [])), arrived))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.keep)
        yield self._frame([(key[0], SESSION, *s) for s in sorted(kept)])

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, hours: float, wait: str = "1 day", keep: str = "30 days") -> DataFrame:
    """FOUND of a stream of events (doc_id, ts, type, chars, arrived): gap sessions by document, and late events.

    ``ts`` is what files claim, in any order; nothing is dropped for it. ``arrived`` is a trusted clock: a document's sessions come
    out when nothing of it has arrived for ``wait``. An event that arrives after that and lies within a gap of a session that
    has come out, or before it, is a row of kind ``late``: evidence, not a session. ``keep`` after the last sessions a
    document's state ends; what comes then starts anew. A gap equal to the threshold joins. Undated events aren't looked at.
    Needs the RocksDB state store. Rows that arrive more than ``wait`` behind others are Spark's late rows.
    """
    if hours < 0:
        raise ValueError("a gap isn't under 0")
    millis_of = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    chars = lambda kind: F.when(F.col("type") == kind, F.col("chars").cast("long")).otherwise(0)
    rows = events.where("ts is not null").withWatermark("arrived", wait)
    rows = rows.select("doc_id", F.unix_micros("ts").alias("at"), chars("ins").alias("ins"), chars("del").alias("gone"), F.unix_micros("arrived").alias("arrived"), F.col("arrived").alias("clock"))
    # timers fire when the watermark, which is ``wait`` behind, reaches them
    processor = OpenSessions(int(hours * 3_600_000_000), 1, millis_of(keep))
    return rows.groupBy("doc_id").transformWithStateInPandas(processor, outputStructType=FOUND, outputMode="Append", timeMode="EventTime")


def arrivals(events: DataFrame, width: str) -> DataFrame:
    """Inserted and deleted characters by document and window of time, anchored at the epoch."""
    chars = lambda kind: F.sum(F.when(F.col("type") == kind, F.col("chars")).otherwise(0)).alias(f"{kind}_chars")
    return events.groupBy("doc_id", F.window("ts", width).alias("w")).agg(chars("ins"), chars("del")).select("doc_id", F.col("w.start").alias("start"), "ins_chars", "del_chars")
