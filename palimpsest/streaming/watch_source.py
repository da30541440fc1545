"""A stream source of documents that are saved again and again.

``spark.dataSource.register(WatchSource)``, then ``spark.readStream.format("palimpsest_watch").load(folder)``: path, modified, sha256
and content of each version of each document. An offset says of each path which version (time of change and size) has been
read, so a restarted stream goes on where it stopped. What was changed a moment ago, or isn't a whole ZIP file, is pending in
the offset: it is looked at again with each batch, and read when it rests and is whole. The driver lists the folder; tasks
read the documents. A document that is saved once more between the two is read as it is then, and again as its next version:
``comment_stream.new_versions`` tells contents apart.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Seconds that a document must have rested; end of a ZIP file that holds its directory's end record.
REST, ZIP_TAIL = 1.5, 22 + 65_535
#: Documents of one watch: an offset has a line for each.
MOST = 100_000
PENDING = "pending"


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def is_whole(system: pyarrow.fs.FileSystem, path: str, size: int) -> bool:
    """Whether a file's end has the end record of a ZIP file's directory, without anything missing behind it."""
    with system.open_input_file(path) as f:
        f.seek(max(0, size - ZIP_TAIL))
        return has_end(f.read())


def has_end(tail: bytes) -> bool:
    at = tail.rfind(b"PK\x05\x06")
    return at >= 0 and len(tail) >= at + 22 and len(tail) == at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little")


class Version(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WatchReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.rest = options["path"], float(options.get("rest", REST))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """The version of each document; ``pending`` for one that doesn't rest yet or isn't whole."""
        system, base = opened(self.folder)
        out = {}
        for f in system.get_file_info(pyarrow.fs.FileSelector(base, recursive=True, allow_not_found=True)):
            if f.is_file and f.base_name.lower().endswith(".docx") and not f.base_name.startswith(("~$", ".")):
                rests = time.time() - f.mtime_ns / 1e9 >= self.rest
                try:
                    ready = rests and is_whole(system, f.path, f.size)
                except OSError:  # gone, or locked, for now
                    ready = False
                out[f.path] = f"{f.mtime_ns}:{f.size}" if ready else PENDING
        if len(out) > MOST:
            raise ValueError(f"{self.folder}: over {MOST} documents")
        return dict(sorted(out.items()))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Version(path) for path, version in end.items() if version not in (PENDING, start.get(path))]

    def read(self, partition: Version) -> Iterator[tuple]:
        """The document as it is now; nothing if it is gone or being saved again, since then another version follows."""
        system, _ = opened(self.folder)
        try:
            with system.open_input_file(partition.path) as f:
                content = f.read()
            modified = system.get_file_info(partition.path).mtime_ns
        except OSError:
            return
        if modified is not None and has_end(content[-ZIP_TAIL:]):
            yield partition.path, datetime.fromtimestamp(modified / 1e9, timezone.utc), hashlib.sha256(content).hexdigest(), content

    def commit(self, end: dict) -> None:
        pass


class WatchSource(DataSource):
    """Options: path, and ``rest``, the seconds that a document must have rested."""

    @classmethod
    def name(cls) -> str:
        return "palimpsest_watch"

    def schema(self) -> str:
        return "path string, modified timestamp, sha256 string, content binary"

    def streamReader(self, schema) -> WatchReader:  # noqa: N802
        return WatchReader(self.options)
