import argparse
import json
import tempfile
from pathlib import Path

import pytest
from files import change, docx, para
from pyspark.sql import functions as F

from palimpsest import cli
from palimpsest.sources import archive


@pytest.fixture(scope="module")
def folder():
    root = Path(tempfile.mkdtemp(prefix="spark-"))
    for n in (1, 2):
        (root / f"round{n}" / "ann").mkdir(parents=True)
        body = [para(change("ins", "2024-01-01T10:00:00Z", "x" * 200, number=1), " and "), para(change("ins", "2024-01-02T10:00:00Z", "more", number=2))]
        (root / f"round{n}" / "ann" / "paper.docx").write_bytes(docx(*body[:n]))
    (root / "round2" / "~$paper.docx").write_bytes(b"open")
    return root


def rows(path):
    return [json.loads(line) for f in Path(path).glob("*.json") for line in f.read_text().splitlines()]


def test_commands(spark, folder):
    out = tempfile.mkdtemp(prefix="spark-")
    for argv in (["score"], ["chart", "--bucket", "hour"], ["chart", "--gap", "2"], ["flow"], ["snapshot"], ["versions", "--sessions", "--at", "2024-01-01"]):
        cli.main([argv[0], str(folder), "--out", f"{out}/{argv[0]}", *argv[1:]])
    assert len(rows(f"{out}/score/scores")) == 2
    assert {r["added"] for r in rows(f"{out}/chart/buckets")} == {0, 200, 4} and len(rows(f"{out}/chart/sessions")) == 3 and len(rows(f"{out}/chart/analysis")) == 2
    assert {r["change"] for r in rows(f"{out}/flow/units")} == {"bulk", "unchanged", "fine"}
    assert {(r["n"], r["new_events"]) for r in [dict(zip(["key", "n", "new_events"], line.replace('"', "").split(",")[:3], strict=True)) for f in Path(f"{out}/snapshot/summary").glob("*.csv") for line in f.read_text().splitlines()[1:]]} == {("1", "1"), ("2", "1")}
    made = rows(f"{out}/versions/manifest")
    assert {r["label"] for r in made} == {"at", "initial", "session"} and all((Path(out) / "versions/files" / r["file"]).exists() for r in made)
    analysis = json.loads(rows(f"{out}/chart/analysis")[0]["json"])
    assert len(analysis["integrity"]) == 9 and {"windows", "highlights"} <= set(analysis)


def test_notes_texts_and_archive(spark, folder):
    out = tempfile.mkdtemp(prefix="spark-")
    notes = Path(out) / "notes.yml"
    notes.write_text("annotations:\n  - {target: 'chart:bar:bulk:0', tooltip: pasted, href: 'https://e.org/1'}\n")
    cli.main(["chart", str(folder), "--out", f"{out}/chart", "--bucket", "day", "--annotations", str(notes)])
    parts = [p for r in rows(f"{out}/chart/analysis") for p in json.loads(r["json"])["targets"]]
    assert {(p["tooltip"], p["href"]) for p in parts if p["key"] == "chart:bar:bulk:0"} == {("pasted", "https://e.org/1")} and len(parts) > 2
    cli.main(["versions", str(folder), "--out", f"{out}/texts", "--sessions", "--format", "txt"])
    texts = {r["label"]: (Path(out) / "texts/files" / r["file"]).read_text() for r in rows(f"{out}/texts/manifest")}
    assert texts["initial"].strip() == "and" and "x" * 200 in texts["session"]
    for n in (1, 2, 2):  # what is the same as the last copy isn't kept again
        found = cli.docx.files(spark, f"{folder}/round{n}").select("path", F.col("modified").alias("arrived"), "content", F.lit("ann/paper").alias("key"))
        archive.add(found, f"{out}/kept")
    found = archive.manifest(spark, f"{out}/kept").orderBy("n").collect()
    assert [(r.key, r.n, r.file) for r in found] == [("ann/paper", 1, "ann/paper/paper-s01.docx"), ("ann/paper", 2, "ann/paper/paper-s02.docx")]
    cli.main(["snapshot", f"{folder}/round2", "--out", f"{out}/snapshot", "--archive", f"{out}/kept"])
    assert sum(len(f.read_text().splitlines()) - 1 for f in Path(f"{out}/snapshot/summary").glob("*.csv")) == 2
    assert (Path(out) / "kept/ann/paper/paper-s02.docx").read_bytes() == (folder / "round2/ann/paper.docx").read_bytes()
    (Path(out) / "kept/ann/paper/paper-s03.docx").write_bytes(b"someone's")
    more = spark.createDataFrame([("ann/paper", "p", 1, b"new")], "key string, path string, n int, content binary").select("key", "path", F.current_timestamp().alias("arrived"), "content")
    with pytest.raises(Exception, match="is there with other content"):
        archive.add(more, f"{out}/kept")
    assert archive.manifest(spark, f"{out}/kept").count() == 2 and archive.keys(archive.manifest(spark, f"{out}/kept")).collect()[0].copies == 2
    assert archive.manifest(spark, f"{out}/nowhere").count() == 0


def test_options(tmp_path):
    config = tmp_path / "c.yml"
    config.write_text("bucket: day\nbulk-chars: 99\n")
    o = cli.options(["chart", "in", "--out", "o", "--config", str(config), "--bucket", "hour"])
    assert (o.bucket, o.bulk_chars) == ("hour", 99)
    config.write_text("colour: red\n")
    with pytest.raises(SystemExit):
        cli.options(["chart", "in", "--out", "o", "--config", str(config)])
    assert cli.seconds("15m") == 900 and cli.moment("2024-01-01").isoformat() == "2024-01-01T23:59:59.999000+00:00"
    with pytest.raises(argparse.ArgumentTypeError):
        cli.seconds("0h")
