"""Command line: chart, score, flow, snapshot and versions over files or folders of them.

    python -m palimpsest.cli score /theses --out /reports
    python -m palimpsest.cli chart /theses --bucket day --rules rules.yml --out /reports

Options come from the command line, then from a YAML file of option names (``--config``), then from defaults.
"""

from __future__ import annotations

import argparse
import datetime
import re
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators import buckets, classify, flow, integrity, kinds, positions, rules, scores, sessions, snapshots, tamper, targets, versions
from palimpsest.sources import archive, docx, docx_edit, outputs
from palimpsest.sources.scratch import stored
from palimpsest.streaming.watch import watch_key

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}


def seconds(text: str) -> float:
    """A length of time: 90, 15m, 2h, 1d."""
    found = re.fullmatch(r"(\d+(?:\.\d+)?)([smhd]?)", text.strip())
    if not found or float(found[1]) <= 0:
        raise argparse.ArgumentTypeError(f"{text!r}: a number over 0 with s, m, h or d")
    return float(found[1]) * UNITS[found[2] or "s"]


def moment(text: str) -> datetime.datetime:
    """A time in UTC; a date alone means the end of that day."""
    day = re.fullmatch(r"\d{4}-\d\d-\d\d", text.strip())
    try:
        at = datetime.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from None
    at = at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)
    return at + datetime.timedelta(days=1, milliseconds=-1) if day else at


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palimpsest", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("input")
        p.add_argument("--out", required=True)
        p.add_argument("--config")
        return p

    def rule_options(p: argparse.ArgumentParser) -> None:
        p.add_argument("--bulk-chars", type=int, default=kinds.BULK_CHARS)
        p.add_argument("--rules")
        for name, kind in (("seconds", float), ("chars", float), ("paras", float)):
            p.add_argument(f"--window-{name}", type=kind)

    p = command("chart", "time buckets, or sessions with --gap")
    p.add_argument("--bucket", default="auto")
    p.add_argument("--gap", type=float, help="hours")
    p.add_argument("--annotations", help="YAML or JSON with notes for parts of the figure")
    rule_options(p)
    p = command("flow", "sessions, heat, units and links")
    p.add_argument("--gap", type=float, default=1.0)
    p.add_argument("--from", dest="start", type=moment)
    p.add_argument("--to", dest="end", type=moment)
    rule_options(p)
    p = command("score", "suspicion scores")
    d = scores.ScoreOptions()
    for name, value in (("least-chars", d.least_chars), ("burst-low", d.burst_low), ("burst-high", d.burst_high), ("rate-low", d.rate_low), ("rate-high", d.rate_high), ("max-weight", d.max_weight)):
        p.add_argument(f"--{name}", type=type(value), default=value)
    p = command("snapshot", "what each submission adds, and traces of tampering")
    p.add_argument("--template")
    p.add_argument("--key-depth", type=int, default=1)
    p.add_argument("--archive", help="a folder to which new submissions are added; all that it holds are compared")
    p.add_argument("--no-tamper-check", action="store_true")
    p = command("versions", "the files as they were")
    p.add_argument("--at", type=moment, action="append")
    p.add_argument("--every", type=seconds)
    p.add_argument("--sessions", action="store_true")
    p.add_argument("--format", choices=["docx", "txt"], default="docx")
    p.add_argument("--gap", type=float, default=1.0)
    return top


def options(argv: list[str]) -> argparse.Namespace:
    """The options of a call; those of its configuration file are defaults for it."""
    top = parser()
    first = top.parse_args(argv)
    if first.config:
        kept = yaml.safe_load(Path(first.config).read_text()) or {}
        sub = top._subparsers._group_actions[0].choices[first.command]
        known = {a.dest for a in sub._actions}
        names = {k.replace("-", "_"): v for k, v in kept.items()}
        if lost := sorted(set(names) - known):
            sub.error(f"{first.config}: unknown option {', '.join(lost)}")
        sub.set_defaults(**names)
    return top.parse_args(argv)


def rule_set(o: argparse.Namespace) -> rules.RuleSet:
    import dataclasses

    found = rules.load_rules(Path(o.rules).read_text()) if o.rules else rules.default_rules(o.bulk_chars)
    own = {k: v for k in ("seconds", "chars", "paras") if (v := getattr(o, f"window_{k}")) is not None}
    return dataclasses.replace(found, window=dataclasses.replace(found.window, **own)) if own else found


def classified(files: DataFrame, o: argparse.Namespace) -> tuple[DataFrame, classify.Result, rules.RuleSet]:
    """Events with kinds and categories, the classifiers' result, and the rules."""
    found = rule_set(o)
    placed = positions.final_positions(stored(docx.segments(files), "segments"), stored(docx.paragraphs(files), "paragraphs"))
    result = classify.run(classify.built_in(found), classify.Context(placed))
    return classify.apply(docx.revisions(files), result.winners), result, found


def chart(spark: SparkSession, o: argparse.Namespace) -> None:
    files = docx.files(spark, o.input)
    events, result, found = classified(files, o)
    more: dict[str, DataFrame] = {}
    if o.gap is not None:
        sessions.summaries(sessions.with_session(events, o.gap)).write.mode("overwrite").json(f"{o.out}/sessions")
    else:
        base = docx.stats(files).select("doc_id", F.col("baseline_chars").alias("baseline"))
        width = o.bucket if o.bucket in ("auto", *buckets.NAMED) else float(o.bucket)
        rows = buckets.buckets(events, width, base)
        buckets.scale(rows).write.mode("overwrite").json(f"{o.out}/buckets")
        notes = spark.createDataFrame(targets.notes_of(Path(o.annotations).read_text()) if o.annotations else [], targets.NOTES)
        more["targets"] = targets.annotated(targets.bucket_targets(rows), notes).select("doc_id", "key", "bucket", "value", "tooltip", "href")
    placed = positions.final_positions(stored(docx.segments(files), "segments"), stored(docx.paragraphs(files), "paragraphs"))
    windows = rules.with_level(classify.Context(placed).windows(found.window), found)
    facts = docx.facts(files)
    more |= {"integrity": integrity.check(facts, docx.segments(files), F.current_timestamp()), "tamper": tamper.check(facts)}
    outputs.analysis_json(windows, result.highlights, found.name, **more).write.mode("overwrite").json(f"{o.out}/analysis")


def run_flow(spark: SparkSession, o: argparse.Namespace) -> None:
    files = docx.files(spark, o.input)
    _, result, _ = classified(files, o)
    marked = result.winners.where("role = 'highlight'").select("doc_id", "rev_id", "category")
    bound = lambda at: None if at is None else F.lit(at)
    for name, rows in flow.build(docx.segments(files), docx.paragraphs(files), hours=o.gap, bulk_chars=o.bulk_chars, highlights=marked, start=bound(o.start), end=bound(o.end)).items():
        rows.write.mode("overwrite").json(f"{o.out}/{name}")


def score(spark: SparkSession, o: argparse.Namespace) -> None:
    picked = scores.ScoreOptions(o.least_chars, o.burst_low, o.burst_high, o.rate_low, o.rate_high, o.max_weight)
    events = docx.revisions(docx.files(spark, o.input))
    top = scores.top_events(scores.event_scores(events, picked))
    outputs.score_json(scores.document_scores(events, picked), top).write.mode("overwrite").json(f"{o.out}/scores")


def snapshot(spark: SparkSession, o: argparse.Namespace) -> None:
    files = docx.files(spark, o.input)
    keyed = outputs.snapshot_key(F.col("path"), o.key_depth).alias("key")
    if o.archive:
        archive.add(files.select("path", F.col("modified").alias("arrived"), "content", keyed), o.archive)
        mine = archive.copies(spark, o.archive)
        kept = mine.select("doc_id", "key", "n")
    else:
        arrived = files.select("doc_id", "path", F.col("modified").alias("arrived"), F.sha2("content", 256).alias("sha256"), keyed)
        kept = snapshots.changed_files(arrived)
        mine = files.join(kept.select("doc_id", "key", "n"), "doc_id")
    events = docx.revisions(mine).join(kept.select("doc_id", "key", "n"), "doc_id")
    deltas = snapshots.deltas(events)
    outputs.write_summary(deltas.drop("__first", "__last"), f"{o.out}/summary")
    snapshots.sessions(deltas).write.mode("overwrite").json(f"{o.out}/sessions")
    if not o.no_tamper_check:
        facts = tamper.by_submission(docx.facts(mine).join(kept.select("doc_id", "key", "n"), "doc_id"))
        templates = facts
        if o.template:
            given = docx.facts(docx.files(spark, o.template)).limit(1)
            only = given.select(F.col("doc_id").alias("__given"))
            facts = facts.join(F.broadcast(only), F.lit(True), "left").withColumn("template_id", F.coalesce("template_id", "__given")).drop("__given")
            templates = facts.select(*given.columns).unionByName(given)
        found = tamper.check(facts, templates, compare_password=False).join(kept.select("doc_id", "key", "n"), "doc_id").select("key", "n", "evidence", "details")
        found.unionByName(snapshots.late_evidence(deltas)).write.mode("overwrite").json(f"{o.out}/evidence")


def run_versions(spark: SparkSession, o: argparse.Namespace) -> None:
    files = docx.files(spark, o.input)
    at = files.select("doc_id", F.explode(F.array(*[F.lit(x) for x in o.at])).alias("at")) if o.at else None
    points = versions.version_points(docx.revisions(files), at, o.every, o.gap if o.sessions else None)
    # a folder a document; of names of one second, later ones get -2, -3
    name = F.concat(outputs.base_name(F.col("path")), F.lit("-"), F.date_format(F.timestamp_millis("at_ms"), "yyyyMMdd-HHmmss"))
    named = points.join(files.select("doc_id", "path"), "doc_id").withColumns({"folder": watch_key(F.col("path")), "name": name})
    twin = F.row_number().over(W.partitionBy("doc_id", "name").orderBy("at_ms", "label"))
    named = named.withColumn("twin", twin).select("doc_id", "at_ms", "label", "changes", F.concat("folder", F.lit("/"), "name", F.when(F.col("twin") > 1, F.concat(F.lit("-"), "twin")).otherwise(""), F.lit(f".{o.format}")).alias("file"))
    if o.format == "docx":
        made = docx_edit.versions(points.join(files.select("doc_id", "content"), "doc_id")).select("doc_id", "at_ms", "label", "content")
    else:
        texts = positions.joined_text_at(docx.segments(files), docx.paragraphs(files), points.select("doc_id", "at_ms").distinct())
        made = points.select("doc_id", "at_ms", "label").join(texts.select("doc_id", "at_ms", F.encode("text", "UTF-8").alias("content")), ["doc_id", "at_ms"])
    written = archive.written_files(named.join(made, ["doc_id", "at_ms", "label"]).select("file", "content"), f"{o.out}/files")
    named.join(written, "file").write.mode("overwrite").json(f"{o.out}/manifest")


COMMANDS = {"chart": chart, "flow": run_flow, "score": score, "snapshot": snapshot, "versions": run_versions}


def main(argv: list[str] | None = None) -> None:
    import sys

    o = options(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName(f"palimpsest {o.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    COMMANDS[o.command](spark, o)


if __name__ == "__main__":
    main()
