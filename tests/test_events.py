import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import columns
from palimpsest.operators import buckets, classify, comments, kinds, rules, scores, sessions, targets, windows

START = datetime(2024, 5, 10, 9)
EVENT = "doc_id long, seq int, type string, rev_id string, author string, ts timestamp, chars int, text string"


def frame(spark, rows):
    return spark.createDataFrame([(1, k, kind, str(k), author, ts, chars, text) for k, (kind, author, ts, chars, text) in enumerate(rows)], EVENT)


def test_suspicious_paste_scores_93(spark):
    """Insertions under 20 characters, one of 295 a second after the last: 0.6 * 100 + 0.4 * 100 * 295 / 360."""
    rows, t = [], START
    for chars in [6, 6, 6, 6, 6, 5, 295, 6, 6, 6, 6, 6]:
        t += timedelta(seconds=1 if chars == 295 else 40)
        rows.append(("ins", "a", t, chars, ""))
    events = frame(spark, rows)
    r = scores.document_scores(events).first()
    assert (r.score, r.risk, r.inserted) == (93, "very_high", 360)
    top = scores.top_events(scores.event_scores(events)).collect()
    assert [(x["index"], x.event_score, x.rate_score, x.burst_score) for x in top] == [(6, 100.0, 100.0, 98.2)]


def test_typing_scores_0_and_no_insertions_are_low(spark):
    events = frame(spark, [("ins", "a", START + timedelta(seconds=30 * k), 19, "") for k in range(10)] + [("del", "a", START, 500, "")])
    assert scores.document_scores(events).first().score == 0
    r = scores.document_scores(frame(spark, [("del", "a", START, 5, "")])).first()
    assert (r.score, r.risk, r.insertions, r.few_events) == (0, "low", 0, True)


@pytest.mark.parametrize(("hours", "want"), [(12, 3), (24, 2), (48, 1), (0, 32)])
def test_sessions(spark, hours, want):
    t, rows = START, []
    for n, gap in ((10, 0), (14, 29), (8, 20.5)):
        t += timedelta(hours=gap)
        for _ in range(n):
            rows.append(("ins", "a", t, 3, ""))
            t += timedelta(minutes=1)
        t -= timedelta(minutes=1)
    assert sessions.with_session(frame(spark, rows), hours).select("session").distinct().count() == want


def test_a_gap_equal_to_the_threshold_joins(spark):
    rows = [("ins", "a", START, 1, ""), ("ins", "a", START + timedelta(hours=1), 1, ""), ("ins", "a", START + timedelta(hours=2, milliseconds=1), 1, "")]
    got = sessions.with_session(frame(spark, rows), 1).orderBy("seq").collect()
    assert [r.session for r in got] == [0, 0, 1] and got[2].gap_before_hours == pytest.approx(1 + 1 / 3_600_000)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["ins", "del"]), st.integers(0, 400_000), st.integers(0, 300)), min_size=1, max_size=40), st.sampled_from(["auto", "hour", 7.5]))
def test_buckets_add_up(spark, rows, width):
    events = frame(spark, [(kind, "a", START + timedelta(seconds=s), chars, "") for kind, s, chars in rows])
    got = buckets.buckets(events, width).orderBy("bucket").collect()
    ins, gone = (sum(c for k, _, c in rows if k == kind) for kind in ("ins", "del"))
    assert sum(r.added for r in got) == ins and sum(r.deleted for r in got) == gone and got[-1].total_at_end == ins - gone
    assert [r.bucket for r in got] == list(range(len(got))) and all(r.fine + r.bulk + r.moved == r.added for r in got)
    rows = sessions.summaries(sessions.with_session(events, 2)).collect()
    assert sum(r.inserted for r in rows) == ins and sum(r.events for r in rows) == events.count()


def test_kinds(spark):
    text = "This sentence is long enough to be found again."
    rows = [
        ("del", "a", START, 10, "This sentence is "), ("del", "a", START + timedelta(seconds=1), 10, "long enough to be found again."), ("ins", "b", START + timedelta(hours=1), len(text), text),
        ("ins", "b", START + timedelta(hours=2), 100, "x"), ("ins", "b", START + timedelta(hours=2), 50, "y"), ("ins", None, START + timedelta(hours=2), 149, "z"), ("ins", "b", START + timedelta(hours=3), 5, "short"),
    ]
    got = [r.kind for r in kinds.with_kinds(frame(spark, rows)).orderBy("seq").collect()]
    assert got == [None, None, "moved", "bulk", "bulk", "fine", "fine"]  # a match may span two deletions


def test_white_space_and_u16(spark):
    df = spark.createDataFrame([("a　b ﻿\tc\u0085d", "😀x")], "a string, b string")
    r = df.select(columns.squeezed(F.col("a")).alias("a"), columns.u16_length(F.col("b")).alias("b")).first()
    assert r.a == "abc\u0085d" and r.b == 3
    r = spark.range(1).select(columns.rounded(F.lit(2.25), 1).alias("a"), columns.rounded(F.lit(-2.5)).alias("b"), columns.gap_label(F.lit(47.0)).alias("c"), columns.gap_label(F.lit(60.0)).alias("d"), columns.base_name(F.lit("a/b.c.docx")).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (2.3, -2.0, "47 h", "2.5 d", "b.c")


def placed(spark, rows):
    names = "doc_id long, seq int, type string, rev_id string, author string, ts timestamp, chars int, text string, move boolean, start_offset int, end_offset int, start_para int, end_para int, paras array<int>"
    return spark.createDataFrame([(1, k, kind, str(k), author, ts, end - start if kind == "ins" else 5, text, False, start, end, start // 100, end // 100, [start // 100]) for k, (kind, author, ts, start, end, text) in enumerate(rows)], names)


def plain_windows(rows, o):
    groups = []
    for k, (kind, author, ts, start, end, _) in sorted(enumerate(rows), key=lambda x: x[1][2]):
        if kind != "ins" or start == end:
            continue
        for g in groups:
            a, z, p, q = g["range"]
            if (ts - g["start"]).total_seconds() <= o.seconds and (not o.by_author or g["author"] == author) and (o.chars is None or max(0, start - z, a - end) <= o.chars) and (o.paras is None or max(0, start // 100 - q, p - end // 100) <= o.paras):
                g["ids"].append(str(k))
                g["range"] = (min(a, start), max(z, end), start // 100 if start < a else p, end // 100 if end > z else q)
                break
        else:
            groups.append({"start": ts, "author": author, "range": (start, end, start // 100, end // 100), "ids": [str(k)]})
    return sorted(sorted(g["ids"]) for g in groups)


@pytest.mark.parametrize("options", [windows.WindowOptions(by_author=True), windows.WindowOptions(), windows.WindowOptions(60, by_author=True), windows.WindowOptions(60), windows.WindowOptions(120, chars=30), windows.WindowOptions(90, paras=1, by_author=True)])
def test_windows(spark, options):
    rng = random.Random(9)
    rows = [(rng.choice(["ins", "ins", "del"]), rng.choice(["a", "b", None]), START + timedelta(seconds=rng.randrange(40) * 10), s := rng.randrange(900), s + rng.randrange(1, 40), "t") for _ in range(60)]
    got = windows.windows(placed(spark, rows), options).collect()
    assert sorted(sorted(r.event_ids) for r in got) == plain_windows(rows, options)
    for r in got:
        mine = [rows[int(k)] for k in r.event_ids]
        assert r.inserted_chars == sum(z - a for _, _, _, a, z, _ in mine) and r.lo == min(m[3] for m in mine) and r.hi == max(m[4] for m in mine)
        end, start = max(m[2] for m in mine), min(m[2] for m in mine)
        pool = [(k, x) for k, x in enumerate(rows) if not (x[0] == "ins" and str(k) in r.event_ids) and x[4] >= r.lo and x[3] <= r.hi]
        after = sum((x[4] - x[3]) if x[0] == "ins" else 5 for _, x in pool if x[2] > end)
        before = sum(5 for _, x in pool if x[0] == "del" and start - timedelta(seconds=options.seconds) <= x[2] <= end)
        assert r.post_edit_ratio == pytest.approx(after / r.inserted_chars) and r.preceding_deleted_chars == before
        assert r.duration_sec == (end - start).total_seconds() + (60 if all(x[2].second == 0 for x in rows) else 1)


def test_rule_errors():
    ok = {"ruleSet": "r", "levels": [{"id": "a", "color": "#fff", "when": {"cps": {"gte": 1}}}]}
    level = lambda **k: {"ruleSet": "r", "levels": [ok["levels"][0] | k]}
    bad = [
        [], {"x": 1}, {"ruleSet": " ", "levels": []}, {"ruleSet": "r", "levels": []}, ok | {"window": {"chars": 1}}, ok | {"window": {"seconds": -1}}, ok | {"window": {"seconds": 1, "byAuthor": 1}}, {"ruleSet": "r", "levels": ok["levels"] * 2},
        level(id=""), level(color="red"), level(when={}), level(when={"all": []}), level(when={"all": [{"cps": 1}], "cps": 1}), level(when={"speed": 1}), level(when={"cps": {"near": 1}}), level(when={"cps": "1"}), level(when={"precededByDeletion": {"gte": True}}), level(when={"precededByDeletion": 1}), level(label={"fr": "x"}), level(pattern="wave"), level(other=1),
    ]
    for value in bad:
        with pytest.raises(rules.RuleError):
            rules.rule_set(value)


def test_rules_and_errors_need_no_session_for_paths(spark):
    loaded = rules.load_rules("ruleSet: r\nlevels:\n- {id: a, color: '#fff', when: {any: [{insertedChars: {gt: 10}}, {not: {insertCount: 1}}]}}\n- {id: b, color: '#000', label: {en: B}, when: {precededByDeletion: false}}\n")
    df = spark.createDataFrame([(11, 1, True), (5, 2, True), (5, 1, True), (5, 1, False)], "inserted_chars long, insert_count long, preceded_by_deletion boolean")
    assert [r.level for r in rules.with_level(df, loaded).collect()] == ["a", "a", None, "b"] and loaded.levels[1].name("ja") == "B"


def test_highest_priority_wins(spark):
    class Broken:
        id, version, categories = "ext.broken", "1", []

        def classify(self, context):
            raise RuntimeError("no")

    text = "the very same words again"
    rows = [("del", "a", START, 0, 0, text), ("ins", "a", START, 5, 30, text), ("ins", "a", START + timedelta(minutes=5), 5, 300, "x")]
    context = classify.Context(placed(spark, rows))
    result = classify.run([*classify.built_in(rules.default_rules(100)), Broken()], context, isolate=True)
    assert {(r.rev_id, r.category) for r in result.winners.collect()} == {("1", "moved"), ("2", "bulk")} and list(result.errors) == ["ext.broken"]
    assert [r.kind for r in classify.apply(context.events, result.winners).orderBy("seq").collect()] == [None, "moved", "bulk"]
    assert context.windows(windows.WindowOptions()) is context.windows(windows.WindowOptions())


def test_comment_diff_and_replay(spark):
    c = "doc_id long, nth int, key string, author string, text string, done boolean"
    versions = [[("a", "x", False), ("b", "y", False)], [("a", "x2", True)], [("a", "x2", False), ("b", "y", True)]]
    log, want = None, [["seen a", "seen b"], ["edited a", "resolved a", "removed b"], ["reopened a", "reappeared b", "resolved b"]]
    for k, rows in enumerate(versions):
        now = spark.createDataFrame([(1, n, key, "r", text, done) for n, (key, text, done) in enumerate(rows)] + [(1, 9, "z", comments.RECEIPT_AUTHOR, "kept", False)], c)
        at = spark.createDataFrame([(1, k, f"h{k}")], "doc_id long, at long, sha256 string")
        state = comments.replay(log).select("doc_id", "key", "text", "done", "present") if log is not None else spark.createDataFrame([], "doc_id long, key string, text string, done boolean, present boolean")
        last = log.groupBy("doc_id").agg(F.max("seq").alias("last_seq")) if log is not None else None
        new = spark.createDataFrame(comments.numbered(comments.diff(state, now, at), last).collect(), "doc_id long, at long, type string, key string, sha256 string, text string, done boolean, seq long")
        assert [f"{r.type} {r.key}" for r in new.orderBy("seq").collect()] == want[k]
        log = new if log is None else log.unionByName(new)
    assert [r.seq for r in log.orderBy("seq").collect()] == list(range(1, 9))
    assert {(r.key, r.text, r.done, r.present) for r in comments.replay(log).collect()} == {("a", "x2", False, True), ("b", "y", True, True)}


def test_targets(spark):
    notes = spark.createDataFrame([(2, "k1", "second", "https://ok.example/x"), (1, "k1", "first", "javascript:x"), (3, "k2", None, None)], "nth int, target string, tooltip string, href string")
    got = {r.key: (r.tooltip, r.href) for r in targets.annotated(spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string"), notes).collect()}
    assert got["k1"] == ("first\nsecond", "https://ok.example/x") and got["k3"] == (None, None)


def test_parts_of_one_key_are_dealt_out(spark):
    """One key stands for most parts: no task has them all, and each has its notes."""
    parts = spark.range(2000).select(targets.F.col("id").alias("doc_id"), targets.F.concat(targets.F.lit("k"), targets.F.col("id") % 1).alias("key"), targets.F.lit(1).alias("value"))
    rows = targets.annotated(parts, spark.createDataFrame([(1, "k0", "b", None), (0, "k0", "a", None)], targets.NOTES))
    sizes = rows.groupBy(targets.F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 1000 and rows.where("tooltip = 'a\nb'").count() == 2000


def test_totals_ask_for_nothing_visible(spark):
    """Totals of sessions are sums of changes: what is visible isn't worked out for them, and for heat only where a session was."""
    from palimpsest.operators import flow
    from palimpsest.sources import adapters

    events = spark.createDataFrame([(k, k % 6, f"2024-01-{1 + k % 9:02d} 00:00:00", "error" if k % 4 == 0 else "view", 30.0) for k in range(60)], "event_id long, user_id long, ts string, event_type string, value double")
    made = flow.build(*adapters.segments(adapters.revisions(events)), hours=6)
    assert made.totals.count() > 0 and not {"states", "heat"} & set(vars(made))
    early = sorted(map(repr, made.heat.drop("highlight_chars").collect()))
    assert "states" not in vars(made)
    whole = flow.shares(made.sums, made.state("e"))
    assert early == sorted(map(repr, whole.drop("highlight_chars").select(made.heat.drop("highlight_chars").columns).collect()))
