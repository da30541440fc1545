"""A stream of document versions with their comments, turned into the stream of what changed.

State is kept by document and comment; the events of a comment come out in the order of the versions. A version whose
content was seen before changes nothing. Dates that files carry are never used to drop anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

EVENTS = "doc_id long, key string, at long, type string, sha256 string, text string, done boolean"
#: A comment that a version doesn't have is sent as a row with ``present`` false.
VERSIONS = "doc_id long, key string, at long, sha256 string, present boolean, text string, done boolean"


def changes(state: tuple[str, bool, bool] | None, row: tuple[str | None, bool | None, bool]) -> tuple[list[str], tuple[str, bool, bool] | None]:
    """The events that one version brings for one comment, and its state after: (text, done, present)."""
    text, done, present = row
    if state is None:
        return (["seen"], (text, done, True)) if present else ([], None)
    if not present:
        return (["removed"], (state[0], state[1], False)) if state[2] else ([], state)
    found = ["reappeared"] if not state[2] else ["edited"] if state[0] != text else []
    if state[1] != done:
        found.append("resolved" if done else "reopened")
    return found, (text, done, True)


class CommentState(StatefulProcessor):
    """Text, done, present and the last version's time of one comment."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("comment", "text string, done boolean, present boolean, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = self.state.get() if self.state.exists() else None
        at = known[3] if known else None
        state = (known[0], bool(known[1]), bool(known[2])) if known else None
        out = []
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            if at is not None and r.at <= at:
                continue  # sent again
            found, state = changes(state, (r.text, bool(r.done), bool(r.present)))
            at = r.at
            for kind in found:
                carries = kind in ("seen", "edited", "reappeared")
                out.append((key[0], key[1], r.at, kind, r.sha256, r.text if carries else None, bool(r.done) if carries else None))
        if state is not None:
            self.state.update((*state, int(at)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    def close(self) -> None:
        pass


def comment_events(versions: DataFrame) -> DataFrame:
    """The events of a stream of VERSIONS rows, by document and comment. Needs the RocksDB state store."""
    return versions.groupBy("doc_id", "key").transformWithStateInPandas(CommentState(), outputStructType=EVENTS, outputMode="Append", timeMode="None")


def read_log(spark, path: str, schema: StructType | str) -> DataFrame:
    """A log with a JSON object a line. A torn line, one that breaks off before its closing brace, is left out; any other line that
    can't be read raises."""
    schema = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).add("_torn", "string")
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(path)
    bad = F.raise_error(F.concat(F.lit("not a row of the log: "), "_torn")).cast("boolean")
    return rows.where(F.when(F.col("_torn").isNull(), True).when(F.rtrim("_torn").endswith("}"), bad).otherwise(False)).drop("_torn")


def new_versions(files: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """Of a stream or table of files (path, content) each content once, without those that the tool wrote itself (sha256)."""
    rows = files.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["path", "sha256"])
    return rows if written is None else rows.join(written.select("sha256").distinct(), "sha256", "left_anti")
