import os
import tempfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import archive, outputs
from palimpsest.streaming import event_log

FILES = "key string, path string, arrived timestamp, content binary"


def files(spark, *rows):
    return spark.createDataFrame([(k, f"/in/{k}.docx", t, c.encode()) for k, t, c in rows], "key string, path string, arrived long, content binary").withColumn("arrived", F.timestamp_seconds("arrived"))


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def kept(spark, root):
    """key, number, content of the copies; each is where the manifest says."""
    out = []
    for r in archive.manifest(spark, root).collect():
        with open(f"{root}/{r.file}", "rb") as f:
            out.append((r.key, r.n, f.read().decode()))
    return sorted(out)


def test_names(spark):
    names = spark.createDataFrame([(n,) for n in (1, 9, 10, 99, 100, 107, 1000)], "n int").select(outputs.archive_name(F.lit("x/a.docx"), F.col("n")).alias("f")).collect()
    assert [r.f for r in names] == ["a-s01.docx", "a-s09.docx", "a-s10.docx", "a-s99.docx", "a-s100.docx", "a-s107.docx", "a-s1000.docx"]


def test_numbers_go_on(spark):
    root = folder()
    archive.add(files(spark, ("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "x")), root)
    archive.add(files(spark, ("a", 4, "y"), ("b", 2, "z")), root)
    archive.add(files(spark, ("a", 5, "y")), root)
    archive.add(files(spark, ("a", 6, "x")), root)
    assert kept(spark, root) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("b", 1, "x"), ("b", 2, "z")]


def test_over_a_hundred_copies_of_a_key(spark):
    root = folder()
    archive.add(files(spark, *[("a", k, f"text {k}") for k in range(99)]), root)
    archive.add(files(spark, *[("a", k, f"text {k}") for k in range(99, 108)]), root)
    assert kept(spark, root) == [("a", k + 1, f"text {k}") for k in range(108)]


def test_writers_at_once(spark):
    """Four writers add to the same keys: each content is there once, the numbers have no holes and no doubles."""
    root = folder()
    parts = [[(key, 100 * w + k, f"{w} {key} {k}") for key in "ab" for k in range(3)] for w in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda rows: archive.add(files(spark, *rows), root), parts))
    found = kept(spark, root)
    assert sorted(c for _, _, c in found) == sorted(c for rows in parts for _, _, c in rows)
    for key in "ab":
        assert [n for k, n, _ in found if k == key] == list(range(1, 13))
    assert len(os.listdir(f"{root}/{archive.LOG}")) == 4


def test_a_writer_that_lost_numbers_anew(spark, monkeypatch):
    root, claim, beaten = folder(), archive.claim, []

    def late(session, at, number, content):
        if not beaten:
            beaten.append(number)
            archive.add(files(spark, ("a", 1, "other")), root)
        return claim(session, at, number, content)

    monkeypatch.setattr(archive, "claim", late)
    archive.add(files(spark, ("a", 2, "mine"), ("a", 3, "more")), root)
    assert kept(spark, root) == [("a", 1, "other"), ("a", 2, "mine"), ("a", 3, "more")]


def test_a_writer_that_broke_off(spark, monkeypatch):
    root = folder()
    with monkeypatch.context() as m:
        m.setattr(archive, "_settled", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            archive.add(files(spark, ("a", 1, "x")), root)
    archive.add(files(spark, ("a", 2, "y")), root)
    assert not os.path.exists(f"{root}/a/a-s01.docx") and archive.repair(spark, root) == 1 and archive.repair(spark, root) == 0
    assert kept(spark, root) == [("a", 1, "x"), ("a", 2, "y")]


def test_a_hole_in_the_log(spark):
    root = folder()
    for k in range(2):
        archive.add(files(spark, ("a", k, f"{k}")), root)
    os.unlink(f"{root}/{archive.LOG}/{0:012d}")
    with pytest.raises(ValueError, match="hole"):
        archive.manifest(spark, root)


def test_paths_without_a_scheme(spark):
    assert archive.full_uri(spark, "/x/y") == "file:///x/y" and archive.full_uri(spark, "file:///x/y") == "file:///x/y"


def logged(spark, root):
    return sorted((r.record, r.seq, r.text) for r in event_log.read(spark, root).collect())


def events(spark, *rows):
    return spark.createDataFrame(rows, "record string, at long, text string")


def test_event_log(spark, monkeypatch):
    """Numbers go on by record; a batch counts once; one that broke off, or lost against another, leaves no trace and no hole."""
    root = folder()
    assert event_log.read(spark, root) is None
    one, two = events(spark, ("a", 2, "second"), ("a", 1, "first"), ("b", 1, "b1")), events(spark, ("a", 3, "third"), ("c", 9, "c1"))
    assert event_log.append(one, root, "batch-0", ["at"]) and not event_log.append(one, root, "batch-0", ["at"])
    with monkeypatch.context() as m:
        m.setattr(archive, "claim", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            event_log.append(two, root, "batch-1", ["at"])
    claim, beaten = archive.claim, []

    def late(session, at, number, content):
        if not beaten:
            beaten.append(number)
            event_log.append(events(spark, ("a", 5, "another's")), root, "other-0", ["at"])
        return claim(session, at, number, content)

    monkeypatch.setattr(archive, "claim", late)
    assert event_log.append(two, root, "batch-1", ["at"]) and not event_log.append(two, root, "batch-1", ["at"])
    assert logged(spark, root) == [("a", 1, "first"), ("a", 2, "second"), ("a", 3, "another's"), ("a", 4, "third"), ("b", 1, "b1"), ("c", 1, "c1")]
