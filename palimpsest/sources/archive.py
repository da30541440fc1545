"""An archive of submissions: numbered copies by key, which are never overwritten, and a log of what was added.

Several writers may add at once. The log is a row of numbered entries, each created only if its number is free; an entry names a
table of copies. A writer numbers its copies on from the log that it has seen and claims the next entry; if another one was
faster, it reads that one's copies and numbers its own anew. The contents are written before, under names of their own, and
moved to their numbered names after the entry is there. Who breaks off in between has lost nothing: the next writer, or
``repair``, moves what an entry promises.
"""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources import docx
from palimpsest.sources.outputs import archive_name, archived

MANIFEST = "key string, n int, file string, source string, source_modified timestamp, archived_at timestamp, sha256 string"
ROWS = f"{MANIFEST}, staged string"
#: The log's entries, the tables that they name, and contents that have no number yet.
LOG, TABLES, STAGED = "_log", "_copies", "_staged"
#: Times that a writer tries to be first, and seconds that it waits after losing, at most.
TRIES, WAIT = 50, 0.5


def full_uri(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: one without is resolved as Spark does, by the default file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def _opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def written_files(rows: DataFrame, root: str) -> DataFrame:
    """file, sha256 of the files (file, content) written below ``root``, a folder that all executors reach.

    A file goes to a name of its own first and is moved when whole, so a task that is run again does no harm. A file that is
    there with other bytes raises. Nothing is written until the rows are read.
    """
    root = full_uri(rows.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        for batch in batches:
            for name, content in zip(batch["file"].to_pylist(), batch["content"].to_pylist(), strict=True):
                at = f"{base}/{name}"
                if system.get_file_info(at).type == pyarrow.fs.FileType.NotFound:
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    part = f"{at.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                    with system.open_output_stream(part) as out:
                        out.write(content)
                    system.move(part, at)
                else:
                    with system.open_input_file(at) as there:
                        if there.read() != content:
                            raise FileExistsError(f"{at} is there with other content")
                yield pa.RecordBatch.from_pydict({"file": [name], "sha256": [hashlib.sha256(content).hexdigest()]})

    return rows.select("file", F.coalesce("content", F.lit(b"")).alias("content")).mapInArrow(run, "file string, sha256 string")


def entries(root: str) -> list[str]:
    """The tables that the log's entries name, in order. A hole in the numbers raises: an entry was taken away."""
    system, base = _opened(root)
    found = sorted(f.path for f in system.get_file_info(pyarrow.fs.FileSelector(f"{base}/{LOG}", allow_not_found=True)) if f.base_name.isdigit())
    if [int(p.rpartition("/")[2]) for p in found] != list(range(len(found))):
        raise ValueError(f"{root}: the log has a hole")
    out = []
    for path in found:
        with system.open_input_file(path) as entry:
            out.append(entry.read().decode())
    return out


def claim(spark: SparkSession, root: str, number: int, content: str) -> bool:
    """Creates the log's entry of this number, if it is free."""
    _, base = _opened(root)
    path, data = f"{base}/{LOG}/{number:012d}", content.encode()
    if urlparse(root).scheme == "file":
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
        with open(part, "xb") as out:
            out.write(data)
        try:
            os.link(part, path)  # whole or not at all, and never over another
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/{LOG}/{number:012d}")
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = system.create(at, False)
    except Exception:
        if system.exists(at):
            return False
        raise
    out.write(data)
    out.close()
    return True


def _rows(spark: SparkSession, root: str, tables: list[str]) -> DataFrame:
    if not tables:
        return spark.createDataFrame([], ROWS)
    rows = spark.read.schema(ROWS).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").json([f"{root}/{TABLES}/{t}" for t in tables])
    sound = F.col("key").isNotNull() & F.col("n").isNotNull() & F.col("file").isNotNull()
    return rows.where(F.when(sound, True).otherwise(F.raise_error(F.lit(f"{root}: invalid manifest")).cast("boolean")))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The archive's copies, from its log; none if there is no archive yet. A row without key, number or file raises."""
    root = full_uri(spark, root)
    return _rows(spark, root, entries(root)).drop("staged")


def keys(rows: DataFrame) -> DataFrame:
    """key, copies: what the archive holds, from its manifest."""
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))


def _settled(rows: DataFrame, root: str) -> int:
    """Moves the contents of ROWS to their numbered names, where that isn't done yet; how many it moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        there = lambda at: system.get_file_info(at).type != pyarrow.fs.FileType.NotFound
        moved = 0
        for batch in batches:
            for name, staged in zip(batch["file"].to_pylist(), batch["staged"].to_pylist(), strict=True):
                at, before = f"{base}/{name}", f"{base}/{STAGED}/{staged}"
                if not there(at):
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    try:
                        system.move(before, at)
                        moved += 1
                    except OSError:
                        if not there(at):  # another writer may have moved it
                            raise
        yield pa.RecordBatch.from_pydict({"moved": pa.array([moved], pa.int64())})

    return rows.select("file", "staged").mapInArrow(run, "moved long").agg(F.coalesce(F.sum("moved"), F.lit(0))).first()[0]


def _taken(rows: DataFrame, root: str) -> list[str]:
    """A name, if any, under which something else is there than what it is for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        for batch in batches:
            for name, sha in zip(batch["file"].to_pylist(), batch["sha256"].to_pylist(), strict=True):
                if system.get_file_info(f"{base}/{name}").type != pyarrow.fs.FileType.NotFound:
                    with system.open_input_file(f"{base}/{name}") as there:
                        if hashlib.sha256(there.read()).hexdigest() != sha:
                            yield pa.RecordBatch.from_pydict({"file": [name]})

    return [r.file for r in rows.select("file", "sha256").mapInArrow(run, "file string").take(1)]


def repair(spark: SparkSession, root: str) -> int:
    """Moves what writers that broke off have left without its numbered name; how many copies that were."""
    root = full_uri(spark, root)
    return _settled(_rows(spark, root, entries(root)), root)


def add(files: DataFrame, root: str, now: Column | None = None) -> DataFrame:
    """Adds the files (key, path, arrived, content) that differ from the last copy of their key; the manifest after that.

    Files of one key come in order of arrival, then path. Writers may add at the same time: no number is given twice, and none
    is left out. A numbered name that someone else has used raises, and nothing is added.
    """
    spark = files.sparkSession
    root = full_uri(spark, root)
    mine = uuid.uuid4().hex
    files = files.withColumn("sha256", F.sha2("content", 256))
    for attempt in range(TRIES):
        log = entries(root)
        known = _rows(spark, root, log)
        gained = archived(files.drop("content"), known.select("key", "n", "sha256"))
        gained = gained.withColumn("file", F.concat("key", F.lit("/"), archive_name(F.concat(F.col("key"), F.lit(".docx")), F.col("n"))))
        # by content and place, so that a second try finds what the first one wrote
        gained = gained.withColumn("staged", F.concat(F.lit(f"{mine}/"), F.sha2(F.concat_ws("|", "key", "path", F.col("arrived").cast("string"), "sha256"), 256)))
        table = f"{mine}-{attempt}"
        rows = gained.select("key", F.col("n").cast("int").alias("n"), "file", F.col("path").alias("source"), F.col("arrived").cast("timestamp").alias("source_modified"), (F.current_timestamp() if now is None else now).alias("archived_at"), "sha256", "staged")
        rows.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").json(f"{root}/{TABLES}/{table}")
        rows = _rows(spark, root, [table])
        if rows.isEmpty():
            return manifest(spark, root)
        contents = files.withColumn("staged", F.concat(F.lit(f"{mine}/"), F.sha2(F.concat_ws("|", "key", "path", F.col("arrived").cast("string"), "sha256"), 256)))
        written_files(contents.join(rows.select("staged"), "staged").select(F.col("staged").alias("file"), "content"), f"{root}/{STAGED}").write.format("noop").mode("overwrite").save()
        if (taken := _taken(rows, root)) and len(entries(root)) == len(log):  # else another writer was first
            raise FileExistsError(f"{root}/{taken[0]} is there with other content")
        if not taken and claim(spark, root, len(log), table):
            _settled(rows, root)
            return manifest(spark, root)
        time.sleep(WAIT * (int(mine[:4], 16) % 97) / 97)
    raise RuntimeError(f"{root}: others were first {TRIES} times")


def copies(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, path, modified, content, key, n, sha256 of the archive's copies."""
    root = full_uri(spark, root)
    at = f"{urlparse(root).path.rstrip('/')}/"
    rows = docx.files(spark, root).withColumn("file", F.expr("substring(path, instr(path, {at}) + length({at}))".format(at="'" + at.replace("\\", "\\\\").replace("'", "\\'") + "'")))
    return rows.join(manifest(spark, root).select("file", "key", "n", "sha256", "source_modified"), "file").withColumn("modified", F.col("source_modified")).drop("file", "source_modified")
