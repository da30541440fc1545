"""Watching documents: which record a document continues, what changed while nobody looked, and receipts that wait until it is closed.

File streams see new files, not files that are saved again; so a watcher polls (``polled``) into a table or an archive. State
is in tables; each function takes them and returns what they become.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.functions.columns import file_name, millis
from palimpsest.operators.windows import WindowOptions, nearest
from palimpsest.streaming.comment_stream import new_versions

#: Bytes at a ZIP file's end in which its directory's end record starts: the record and the longest comment.
ZIP_TAIL = 22 + 65_535


def watch_key(path: Column, name: Column | None = None) -> Column:
    """The name of a document's record: its own, cut to 40 characters, and ten digits of its path's hash."""
    base = F.regexp_replace(F.regexp_replace(file_name(path) if name is None else name, r"(?i)\.docx$", ""), r'[\\/:*?"<>|]', "_")
    base = F.substring(base, 1, 40)
    return F.concat(F.when(base == "", "document").otherwise(base), F.lit("-"), F.substring(F.sha2(path, 256), 1, 10))


def complete(files: DataFrame) -> DataFrame:
    """The files that are whole ZIP files; one that is still being written comes with a later poll."""
    return files.where(F.contains(F.substring("content", -ZIP_TAIL, ZIP_TAIL), F.lit(b"PK\x05\x06")))


def polled(files: DataFrame, seen: DataFrame, tool_writes: DataFrame | None = None) -> DataFrame:
    """Of the files (path, content) of one poll those that are whole, and new or saved since the last one. seen: path, sha256 of
    each path's last version; tool_writes: sha256 of what the tool wrote itself."""
    return new_versions(complete(files), tool_writes).join(seen.select("path", "sha256"), ["path", "sha256"], "left_anti")


def continued(files: DataFrame, records: DataFrame) -> DataFrame:
    """``files`` (path, guid, sha256) with ``record``: the record of that path's key; else, for a moved document, the first record
    with its guid whose last version it is; else its key, a new record. records: record, guid, last_sha256."""
    rows = files.withColumn("__key", watch_key(F.col("path")))
    rows = rows.join(records.select(F.col("record").alias("__key"), F.lit(True).alias("__known")), "__key", "left")
    moved = records.where("guid is not null and last_sha256 is not null").groupBy("guid", F.col("last_sha256").alias("sha256")).agg(F.min("record").alias("__moved"))
    rows = rows.join(moved, ["guid", "sha256"], "left")
    return rows.withColumn("record", F.when(F.col("__known"), F.col("__key")).otherwise(F.coalesce("__moved", "__key"))).drop("__key", "__known", "__moved")


def gaps(files: DataFrame, records: DataFrame, tool_writes: DataFrame | None = None) -> DataFrame:
    """record, since, sha256: documents that changed while no watcher ran, other than by the tool itself.

    files: record, sha256 at the start of a watch. records: record, last_sha256 (null: none yet), ended (of the last watch, null
    if it broke off), last_seen.
    """
    known = records.where("last_sha256 is not null").select("record", "last_sha256", F.coalesce("ended", "last_seen").alias("since"))
    rows = files.select("record", "sha256").join(known, "record").where("sha256 <> last_sha256")
    if tool_writes is not None:
        rows = rows.join(tool_writes.select("sha256"), "sha256", "left_anti")
    return rows.select("record", "since", "sha256")


QUEUE = "record string, key string, seq long, state string, at timestamp, sha256 string, reason string"


def queued(queue: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """QUEUE with a pending receipt for each comment that was seen for the first time; events: record, key, seq, type."""
    seen = events.where("type = 'seen'").groupBy("record", "key").agg(F.min("seq").alias("seq")).join(queue.select("record", "key"), ["record", "key"], "left_anti")
    return queue.unionByName(seen.withColumns({"state": F.lit("pending"), "at": now}), allowMissingColumns=True)


def due(queue: DataFrame, files: DataFrame) -> DataFrame:
    """record, key, seq to write now: pending in documents that are closed and as they were last read. files: record, open, sha256, last_sha256."""
    ready = files.where(~F.coalesce("open", F.lit(False)) & (F.col("sha256") == F.col("last_sha256")))
    return queue.where("state = 'pending'").join(ready.select("record"), "record", "left_semi").select("record", "key", "seq")


def settled(queue: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """QUEUE after an attempt; results: record, key, sha256 (of the file written), reason (null: written, else why it was skipped)."""
    r = results.select("record", "key", F.col("sha256").alias("__sha"), F.col("reason").alias("__why"), F.lit(True).alias("__tried"))
    rows = queue.join(r, ["record", "key"], "left").withColumn("__now", F.coalesce("__tried", F.lit(False)) & (F.col("state") == "pending"))
    state = F.when(F.col("__now"), F.when(F.col("__why").isNull(), "written").otherwise("skipped")).otherwise(F.col("state"))
    return rows.withColumns({
        "state": state, "at": F.when(F.col("__now"), now).otherwise(F.col("at")), "sha256": F.when(F.col("__now") & F.col("__why").isNull(), F.col("__sha")).otherwise(F.col("sha256")),
        "reason": F.when(F.col("__now"), F.col("__why")).otherwise(F.col("reason")),
    }).select(*[c.split()[0] for c in QUEUE.split(", ")])


def open_documents(paths: DataFrame) -> DataFrame:
    """path, open: whether a lock file lies beside each document. paths: the paths of all files of the folders."""
    parts = F.regexp_extract("path", r"^(.*[/\\])?([^/\\]*)$", 2)
    folder = F.regexp_extract("path", r"^(.*[/\\])?([^/\\]*)$", 1)
    # the lock's name is "~$" and the name, of which longer ones lose the first two characters
    locks = paths.where(parts.startswith("~$")).select(folder.alias("__folder"), F.substring(parts, 3, 1000).alias("__rest")).distinct()
    docs = paths.where(~parts.startswith("~$")).withColumns({"__folder": folder, "__name": parts})
    there = lambda name: docs.withColumn("__rest", name).join(locks, ["__folder", "__rest"], "left_semi").select("path")
    found = there(F.col("__name")).union(there(F.substring("__name", 3, 1000))).distinct().withColumn("open", F.lit(True))
    return docs.select("path").join(found, "path", "left").withColumn("open", F.coalesce("open", F.lit(False)))


PLACES = "doc_id long, seq long, window long"


class OpenWindows(StatefulProcessor):
    """Insertion windows of one document and author that may still take an insertion; older ones leave the state."""

    def __init__(self, options: WindowOptions):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "number long, at long, lo int, hi int, first_para int, last_para int")
        self.next = handle.getValueState("next", "number long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        kept = [list(w) for w in self.open.get()] if self.open.exists() else []
        number = self.next.get()[0] if self.next.exists() else 0
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable").itertuples():
            kept = [w for w in kept if r.at - w[1] <= self.options.seconds * 1000]
            k = nearest([w[1:] for w in kept], (r.at, r.start_offset, r.end_offset, r.start_para, r.end_para), self.options)
            if k is None:
                kept.append([number, r.at, r.start_offset, r.end_offset, r.start_para, r.end_para])
                k, number = len(kept) - 1, number + 1
            w = kept[k]
            if r.start_offset < w[2]:
                w[2], w[4] = r.start_offset, r.start_para
            if r.end_offset > w[3]:
                w[3], w[5] = r.end_offset, r.end_para
            out.append((key[0], r.seq, w[0]))
        self.open.put([tuple(int(x) for x in w) for w in kept])
        self.next.update((int(number),))
        yield pd.DataFrame(out, columns=["doc_id", "seq", "window"])

    def close(self) -> None:
        pass


def window_stream(insertions: DataFrame, options: WindowOptions) -> DataFrame:
    """PLACES of a stream of insertions (doc_id, author, seq, ts, start_offset, end_offset, start_para, end_para): the number of its
    window in its document (and author). Insertions count in the order in which the stream brings them, those of one batch by
    time. Needs the RocksDB state store."""
    rows = insertions.select("doc_id", F.coalesce("author", F.lit("")).alias("who") if options.by_author else F.lit("").alias("who"), "seq", millis(F.col("ts")).alias("at"), "start_offset", "end_offset", "start_para", "end_para")
    return rows.groupBy("doc_id", "who").transformWithStateInPandas(OpenWindows(options), outputStructType=PLACES, outputMode="Append", timeMode="None")


def last_versions(versions: DataFrame) -> DataFrame:
    """path, sha256 of the last of each path's versions (path, at, sha256)."""
    by = W.partitionBy("path").orderBy(F.col("at").desc(), F.col("sha256"))
    return versions.withColumn("__k", F.row_number().over(by)).where("__k = 1").select("path", "sha256")
