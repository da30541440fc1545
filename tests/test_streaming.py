import hashlib
import io
import json
import os
import tempfile
import time
import zipfile

from palimpsest.streaming import comment_stream, sessions, watch_source


def test_changes():
    c = comment_stream.changes
    assert c(None, ("t", False, True)) == (["seen"], ("t", False, True)) and c(None, (None, None, False)) == ([], None)
    assert c(("t", False, True), ("u", True, True)) == (["edited", "resolved"], ("u", True, True))
    assert c(("t", True, True), (None, None, False)) == (["removed"], ("t", True, False)) and c(("t", True, False), (None, None, False))[0] == []
    assert c(("t", True, False), ("t", False, True)) == (["reappeared", "reopened"], ("t", False, True))


def test_comment_stream(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, checkpoint = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    versions = [(1, "a", 1, "h1", True, "x", False), (1, "a", 2, "h2", True, "y", True), (1, "a", 2, "h2", True, "y", True), (1, "a", 3, "h3", False, None, None)]
    names = [c.split()[0] for c in comment_stream.VERSIONS.split(", ")]
    got = []
    for part in (versions[:2], versions[2:]):
        with open(f"{folder}/{len(got)}.json", "w") as f:
            f.write("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in part))
        stream = spark.readStream.schema(comment_stream.VERSIONS).json(folder)
        query = comment_stream.comment_events(stream).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start()
        query.awaitTermination()
    assert [r.type for r in sorted(got, key=lambda r: r["at"])] == ["seen", "edited", "resolved", "removed"]


def test_merged():
    gap = 10
    assert sessions.merged([], (5, 1, 0), gap) == [[5, 5, 1, 1, 0]]
    assert sessions.merged([[0, 5, 2, 3, 1]], (15, 0, 4), gap) == [[0, 15, 3, 3, 5]]
    assert sessions.merged([[0, 5, 2, 3, 1]], (16, 1, 0), gap) == [[0, 5, 2, 3, 1], [16, 16, 1, 1, 0]]
    assert sessions.merged([[0, 5, 1, 1, 0], [20, 25, 1, 1, 0]], (13, 1, 0), gap) == [[0, 25, 3, 3, 0]]


def test_session_stream(spark):
    """Sessions in any order of dates come out when a document has rested; what lies behind them is told as late; the state ends."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, checkpoint, got = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-"), []
    schema = "doc_id long, ts timestamp, type string, chars long, arrived timestamp"
    batches = [
        [(1, "2024-01-01 12:00:01", "ins", 3, "2024-02-01 00:00"), (1, "2024-01-01 10:00:00", "ins", 5, "2024-02-01 00:00"), (2, "2020-01-01 00:00:00", "del", 7, "2024-02-01 00:01"), (2, None, "del", 7, "2024-02-01 00:01")],
        [(1, "2024-01-01 11:00:00", "del", 2, "2024-02-01 01:00")],  # an hour after one, over an hour before the other
        [(3, "2024-01-01 00:00:00", "ins", 1, "2024-02-03 00:00")],  # the clock goes on: 1 and 2 have rested
        [(1, "2024-01-01 10:30:00", "ins", 9, "2024-02-03 00:01"), (1, "2024-01-05 10:30:00", "ins", 4, "2024-02-03 00:01")],
        [(4, "2024-01-01 00:00:00", "ins", 1, "2024-05-01 00:00")],
        [(1, "2024-01-01 10:30:00", "ins", 6, "2024-05-01 00:01")],  # the state of 1 has ended
        [(5, "2024-01-01 00:00:00", "ins", 1, "2024-05-09 00:00")],
    ]
    names = [c.split()[0] for c in schema.split(", ")]
    for n, rows in enumerate(batches):
        with open(f"{folder}/{n}.json", "w") as f:
            f.write("".join(json.dumps({k: v for k, v in zip(names, r, strict=True) if v is not None}) + "\n" for r in rows))
        stream = sessions.session_stream(spark.readStream.schema(schema).json(folder), 1)
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _, n=n: got.extend((n, *r) for r in df.collect())).start().awaitTermination()
    found = sorted((r[1], r[2], str(r[3])[:16], str(r[4])[:16], *r[5:]) for r in got)
    assert found == sorted([
        (1, "session", "2024-01-01 10:00", "2024-01-01 11:00", 2, 5, 2), (1, "session", "2024-01-01 12:00", "2024-01-01 12:00", 1, 3, 0), (2, "session", "2020-01-01 00:00", "2020-01-01 00:00", 1, 0, 7),
        (1, "late", "2024-01-01 10:30", "2024-01-01 10:30", 1, 9, 0), (1, "session", "2024-01-05 10:30", "2024-01-05 10:30", 1, 4, 0), (3, "session", "2024-01-01 00:00", "2024-01-01 00:00", 1, 1, 0),
        (4, "session", "2024-01-01 00:00", "2024-01-01 00:00", 1, 1, 0), (1, "session", "2024-01-01 10:30", "2024-01-01 10:30", 1, 6, 0),
    ])


def package(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", text)
    return out.getvalue()


def test_watch_source(spark):
    """Saved, saved over, broken off, not at rest: each version is read once, over restarts of the stream."""
    spark.dataSource.register(watch_source.WatchSource)
    folder, checkpoint, got = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-"), []
    os.makedirs(f"{folder}/deep")

    def save(name, content, age=60):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content)
        at = time.time() - age - len(got)
        os.utime(f"{folder}/{name}", (at, at))

    def poll():
        del got[:]
        stream = spark.readStream.format("palimpsest_watch").load(f"file://{folder}")
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start().awaitTermination()
        return sorted((os.path.basename(r.path), bytes(r.content)) for r in got)

    one, two, three = package("one"), package("two"), package("three")
    save("a.docx", one), save("deep/b.DOCX", two), save("~$a.docx", b"lock"), save("c.docx", three[:-9]), save("d.docx", three, age=-60), save("e.txt", one)
    assert poll() == [("a.docx", one), ("b.DOCX", two)] and all(r.sha256 == hashlib.sha256(r.content).hexdigest() for r in got)
    assert poll() == []
    save("a.docx", two, age=30), save("c.docx", three)
    assert poll() == [("a.docx", two), ("c.docx", three)]
    os.unlink(f"{folder}/deep/b.DOCX")
    save("a.docx", two[:-4], age=20)
    assert poll() == []
    save("a.docx", one, age=10), save("d.docx", three)
    assert poll() == [("a.docx", one), ("d.docx", three)]
