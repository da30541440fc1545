import io
import json
import tempfile
import time
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import classify, windows
from palimpsest.streaming import comment_stream, watch


def test_log_with_a_torn_line(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    (folder / "a.json").write_text('{"seq": 1}\n{"seq": 2}\n{"seq": 3, "te')
    assert sorted(r.seq for r in comment_stream.read_log(spark, str(folder), "seq long").collect()) == [1, 2]
    (folder / "b.json").write_text('{"seq": x}\n{"seq": 5}\n')
    with pytest.raises(Exception, match="not a row of the log"):
        comment_stream.read_log(spark, str(folder), "seq long").collect()


def test_poll(spark):
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("a", "b")
    files = spark.createDataFrame([("a.docx", whole.getvalue()), ("b.docx", whole.getvalue()[:-30]), ("c.docx", b""), ("d.docx", None)], "path string, content binary")
    found = watch.polled(files, spark.createDataFrame([], "path string, sha256 string")).cache()
    assert [r.path for r in found.collect()] == ["a.docx"]
    assert watch.polled(files, found).count() == 0 and watch.polled(files, found.limit(0), found).count() == 0


def test_records(spark):
    key = lambda path: spark.range(1).select(watch.watch_key(F.lit(path))).first()[0]
    assert key("/x/My: paper.DOCX").startswith("My_ paper-") and key("/.docx").startswith("document-") and len(key("/" + "y" * 90)) == 51
    records = spark.createDataFrame([(key("/a.docx"), "g1", "s1", "e1", "l1"), ("old", "g2", "s2", None, "l2"), ("older", "g2", "s2", None, "l2"), ("new", None, None, None, None)], "record string, guid string, last_sha256 string, ended string, last_seen string")
    files = spark.createDataFrame([("/a.docx", "g2", "s2"), ("/moved.docx", "g2", "s2"), ("/edited.docx", "g2", "s3"), ("/plain.docx", None, "s2")], "path string, guid string, sha256 string")
    assert {r.path: r.record for r in watch.continued(files, records).collect()} == {"/a.docx": key("/a.docx"), "/moved.docx": "old", "/edited.docx": key("/edited.docx"), "/plain.docx": key("/plain.docx")}
    now = spark.createDataFrame([(key("/a.docx"), "s9"), ("old", "s2"), ("older", "s8"), ("new", "s7")], "record string, sha256 string")
    tool = spark.createDataFrame([("s8",)], "sha256 string")
    assert [tuple(r) for r in watch.gaps(now, records, tool).collect()] == [(key("/a.docx"), "e1", "s9")]
    assert {(r.record, r.since) for r in watch.gaps(now, records).collect()} == {(key("/a.docx"), "e1"), ("older", "l2")}


def test_receipts(spark):
    at = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    events = spark.createDataFrame([("r", "k1", 1, "seen"), ("r", "k1", 2, "edited"), ("s", "k2", 1, "seen"), ("r", "k3", 3, "seen")], "record string, key string, seq long, type string")
    queue = watch.queued(spark.createDataFrame([], watch.QUEUE), events, at(1))
    assert watch.queued(queue, events, at(2)).count() == queue.count() == 3
    files = spark.createDataFrame([("r", False, "x", "x"), ("s", True, "y", "y"), ("t", None, "z", "a")], "record string, open boolean, sha256 string, last_sha256 string")
    assert {(r.record, r.key) for r in watch.due(queue, files).collect()} == {("r", "k1"), ("r", "k3")}
    queue = watch.settled(queue, spark.createDataFrame([("r", "k1", "w", None), ("r", "k3", "w", "gone")], "record string, key string, sha256 string, reason string"), at(3))
    assert {(r.key, r.state, r.sha256, r.reason, r["at"].day) for r in queue.collect()} == {("k1", "written", "w", None, 3), ("k3", "skipped", None, "gone", 3), ("k2", "pending", None, None, 1)}
    assert watch.due(queue, files).count() == 0
    paths = spark.createDataFrame([("/a/paper.docx",), ("/a/~$per.docx",), ("/b/paper.docx",), ("/b/x.docx",), ("/b/~$x.docx",)], "path string")
    assert {r.path for r in watch.open_documents(paths).where("open").collect()} == {"/a/paper.docx", "/b/x.docx"}
    versions = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "path string, at long, sha256 string")
    assert {tuple(r) for r in watch.last_versions(versions).collect()} == {("a", "y"), ("b", "z")}


def test_window_stream_is_the_batch_form(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = [(k % 2, "a" if k % 3 else None, k, f"2024-01-01 00:{k:02d}:00", k * 37 % 200, k * 37 % 200 + k % 9, k * 37 % 200 // 50, k * 37 % 200 // 50) for k in range(40)]
    schema = "doc_id long, author string, seq long, ts timestamp, start_offset int, end_offset int, start_para int, end_para int"
    names = [c.split()[0] for c in schema.split(", ")]
    options = windows.WindowOptions(seconds=600, chars=30)
    got, checkpoint = [], tempfile.mkdtemp(prefix="spark-")
    for n, part in enumerate((rows[:15], rows[15:])):
        Path(f"{folder}/{n}.json").write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in part))
        stream = watch.window_stream(spark.readStream.schema(schema).json(folder), options)
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start().awaitTermination()
    events = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts string")).withColumns({"ts": F.col("ts").cast("timestamp"), "type": F.lit("ins"), "rev_id": F.col("seq").cast("string"), "chars": F.lit(1), "text": F.lit(""), "move": F.lit(False)})
    want = windows.grouped(windows.candidates(events), options).select("doc_id", "seq", "window").collect()
    sets = lambda found: {tuple(sorted(r.seq for r in found if (r.doc_id, r.window) == w)) for w in {(r.doc_id, r.window) for r in found}}
    assert len(got) == 40 and sets(got) == sets(want) and 2 < len(sets(want)) < 40


class Foreign:
    id, version, categories = "foreign", "1", []

    def __init__(self, what, **more):
        self.what = what
        self.__dict__.update(more)

    def classify(self, context):
        e = context.events.where("type = 'ins'")
        return e.select("doc_id", F.lit(self.id).alias("classifier"), self.what(F.col("text")).alias("category"), F.lit(None).cast("string").alias("level"), F.array("rev_id").alias("event_ids"), F.col("ts").alias("start"), F.col("ts").alias("end"), F.lit(0).alias("lo"), F.lit(1).alias("hi"))


def test_classifiers_from_elsewhere(spark):
    events = spark.createDataFrame([(1, "ins", "r1", "secret", "2024-01-01")], "doc_id long, type string, rev_id string, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    fails = Foreign(lambda text: F.raise_error(F.lit("broken")).cast("string"))
    found = classify.run([fails, Foreign(lambda text: text), Foreign(lambda text: text, document_text=True)], classify.Context(events), isolate=True)
    assert "broken" in found.errors["foreign"]
    assert sorted((r.nth, r.category) for r in found.highlights.collect()) == [(1, ""), (2, "secret")]


class Hangs(Foreign):
    def classify(self, context):
        if self.what == "driver":
            time.sleep(300)
        rows = Foreign(lambda text: text).classify(context)
        slow = F.udf(lambda x: (time.sleep(300), x)[1], "string")
        return rows.withColumn("category", slow("category"))


def test_a_classifier_that_hangs(spark):
    events = spark.createDataFrame([(1, "ins", "r1", "x", "2024-01-01")], "doc_id long, type string, rev_id string, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for where in ("driver", "task"):
        began = time.monotonic()
        found = classify.run([Hangs(where, id="slow"), Foreign(lambda text: text, document_text=True)], classify.Context(events), isolate=True, seconds=15)
        assert "15 seconds" in found.errors["slow"] and [r.category for r in found.highlights.collect()] == ["x"]
        assert time.monotonic() - began < 120
    deadline = time.monotonic() + 60  # the job of the one that hung is cancelled
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.monotonic() < deadline:
        time.sleep(0.5)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
