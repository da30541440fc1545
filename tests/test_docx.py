import base64
import itertools
import random
from datetime import datetime, timedelta, timezone

import pytest
from files import NO_PART, change, docx, kept_settings, para, run, table, w, written
from pyspark.sql import functions as F

from palimpsest.operators import flow, integrity, positions, snapshots, tamper, versions
from palimpsest.sources import docx as source
from palimpsest.sources import docx_edit


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


TIMES = [f"2021-11-{d:02d}T0{d % 7}:{13 * d % 60:02d}:07" for d in (4, 9, 15, 22, 27)]
T = [t + "Z" for t in TIMES]


def invented(rng):
    """A document of random pieces: (paragraphs, file). A paragraph: (pieces, insertion, deletion of its mark); a piece: (text, insertion, deletion).

    A change is None, or its time: an index of TIMES, or "?" without one. The last paragraph is plain.
    """
    when = lambda: rng.choice([0, 1, 2, 3, 4, "?"]) if rng.random() < 0.5 else None
    stamp = lambda t: None if t == "?" else T[t]
    paragraphs, body = [], []
    for _ in range(rng.randrange(2, 9)):
        pieces, inside = [], []
        for _ in range(rng.randrange(4)):
            text, ins, gone = "".join(rng.choice("xyz é😀") for _ in range(rng.randrange(1, 9))), when(), when()
            made = run(text)
            if gone is not None:
                made = change("del", stamp(gone), made)
            if ins is not None:
                made = change("ins", stamp(ins), made)
            pieces.append((text, ins, gone))
            inside.append(made)
        kind = rng.choice([None, None, "ins", "del"])
        mark = rng.randrange(5) if kind else None
        paragraphs.append((pieces, mark if kind == "ins" else None, mark if kind == "del" else None))
        body.append(para(*inside, mark=(kind, T[mark]) if kind else None))
    paragraphs.append(([("tail", None, None)], None, None))
    return paragraphs, docx(*body, para("tail"))


def shows(ins, gone, k):
    """Whether something is there when the first k of TIMES are over; what has no time always was."""
    over = lambda t: t == "?" or t < k
    return (ins is None or over(ins)) and not (gone is not None and over(gone))


def lines_at(paragraphs, k):
    """The text of a version: a paragraph without its mark goes on with the next one."""
    out = [""]
    for pieces, ins, gone in paragraphs:
        out[-1] += "".join(text for text, a, z in pieces if shows(a, z, k))
        if shows(ins, gone, k):
            out.append("")
    return out[:-1]


@pytest.fixture(scope="module")
def histories():
    rng = random.Random(77)
    return [invented(rng) for _ in range(25)]


def test_versions(spark, histories):
    files = table(spark, [content for _, content in histories])
    times = [int(at(TIMES[0]).timestamp() * 1000) - 1, *(int(at(t).timestamp() * 1000) for t in TIMES)]
    points = files.crossJoin(spark.createDataFrame([(t, str(k)) for k, t in enumerate(times)], "at_ms long, label string"))
    seen = 0
    for r in docx_edit.versions(points).collect():
        package = source.Package(bytes(r.content))
        model = source.Model(package.tree("word/document.xml"))
        lines = ["".join(s["text"] or "" for s in model.segments if s["para_index"] == p["para_index"]) for p in model.paragraphs]
        assert lines == lines_at(histories[r.doc_id][0], int(r.label)), (r.doc_id, r.label)
        xml = package.text("word/document.xml")
        assert not any(f"<w:{x}" in xml for x in ("ins ", "del ", "move", "delText")) and "palimpsest" not in xml
        seen += 1
    assert seen == len(histories) * len(times)
    texts = {(r.doc_id, r.at_ms): r.text for r in positions.joined_text_at(source.segments(files), source.paragraphs(files), points.select("doc_id", "at_ms")).collect()}
    for n, (paragraphs, _) in enumerate(histories):
        for k, t in enumerate(times):
            assert texts[n, t] == "\n".join(lines_at(paragraphs, k))


def test_a_look_is_taken_back(spark):
    files = table(spark, [docx(para(run("slanted once", look=[w("b"), change("rPrChange", T[2], w("rPr", w("i")))])))])
    points = files.crossJoin(spark.createDataFrame([(int(at(TIMES[k]).timestamp() * 1000), str(k)) for k in (1, 2)], "at_ms long, label string"))
    xml = {r.label: source.Package(bytes(r.content)).text("word/document.xml") for r in docx_edit.versions(points).collect()}
    assert "<w:i/>" in xml["1"] and "<w:b/>" not in xml["1"] and "<w:b/>" in xml["2"] and not any("rPrChange" in x for x in xml.values())


def u16(text):
    return len(text.encode("utf-16-le")) // 2


def test_events_and_stats(spark, histories):
    files = table(spark, [content for _, content in histories] + [b"no zip", docx(para("x"), settings=NO_PART)])
    events, n = {}, len(histories)
    for e in source.revisions(files).orderBy("doc_id", "seq").collect():
        events.setdefault(e.doc_id, []).append(e)
    stats = {r.doc_id: r for r in source.history_problem(source.stats(files)).collect()}
    for k, (paragraphs, _) in enumerate(histories):
        changes = [(kind, text, t) for pieces, _, _ in paragraphs for text, *both in pieces for kind, t in zip(("ins", "del"), both, strict=True) if t is not None]
        marks = [(kind, "", t) for _, *both in paragraphs for kind, t in zip(("ins", "del"), both, strict=True) if t is not None]
        dated = [c for c in changes + marks if c[2] != "?"]
        mine = events.get(k, [])
        assert sorted((e.type, e.text, e.ts) for e in mine) == sorted((kind, text, at(TIMES[t]).replace(tzinfo=None)) for kind, text, t in dated)
        assert all(a.ts <= b.ts for a, b in zip(mine, mine[1:], strict=False))
        inserted, deleted = (sum(u16(text) for kind, text, t in dated if kind == which) for which in ("ins", "del"))
        final = sum(u16(text) for pieces, _, _ in paragraphs for text, _, gone in pieces if gone is None)
        r = stats[k]
        assert (r.undated, r.inserted, r.deleted, r.final_chars) == (len(changes) + len(marks) - len(dated), inserted, deleted, final)
        assert r.baseline_chars == max(0, final - inserted + deleted) and r.track_revisions
    assert "BadZipFile" in stats[n].error and stats[n + 1].settings_part_found is False and stats[n + 1].diagnosis == "tracking_off"


def test_u16_lengths_and_tabs(spark):
    body = para(change("ins", T[0], run("😀a", w("tab"), w("br"))))
    e = source.revisions(table(spark, [docx(body)])).first()
    assert e.chars == 5 and e.text == "😀a\t\n"


def test_final_positions(spark, histories):
    files = table(spark, [content for _, content in histories])
    segs, paras = source.segments(files), source.paragraphs(files)
    final = {r.doc_id: r.text for r in positions.text_at(segs, paras).collect()}
    rows = positions.final_positions(segs, paras).collect()
    inside = lambda r: final[r.doc_id].encode("utf-16-le")[2 * r.start_offset : 2 * r.end_offset].decode("utf-16-le")
    for r in rows:
        if r.type == "ins" and r.final_chars == r.chars and r.chars:
            assert inside(r) == r.text, r
        if r.type == "del":
            assert r.start_offset == r.end_offset
    assert len(rows) > 100
    went = lambda kind, number: para(w(f"{kind}RangeStart", id=number, name="away"), change(kind, T[1], "gone by"), w(f"{kind}RangeEnd", id=number), mark=(kind, T[1]))
    files = table(spark, [docx(para("front"), went("moveFrom", 3), para("middle"), went("moveTo", 4), para("back"))])
    segs, paras = source.segments(files), source.paragraphs(files)
    [moved] = [r for r in positions.final_positions(segs, paras).collect() if r.move and r.type == "ins" and r.chars]
    assert moved.move_name == "away" and positions.text_at(segs, paras).first().text[moved.start_offset : moved.end_offset] == "gone by"


def plain_places(rows):
    """Where each dated change was, from a state for each."""
    out = {}
    for kind in ("ins", "del"):
        for rev in {r[f"{kind}_id"] for r in rows if r[f"{kind}_id"] is not None and r[f"{kind}_ms"] is not None}:
            t = next(r[f"{kind}_ms"] for r in rows if r[f"{kind}_id"] == rev) - (kind == "del")
            shows = lambda r: (r["ins_id"] is None or r["ins_ms"] is None or r["ins_ms"] <= t) and not (r["del_id"] is not None and (r["del_ms"] is None or r["del_ms"] <= t))  # noqa: E731, B023
            start = end = None
            offset = n = 0
            waiting = False
            for p in sorted({r["para"] for r in rows}):
                here = [r for r in rows if r["para"] == p]
                mine = any(r[f"{kind}_id"] == rev for r in here)
                if not any(map(shows, here)):
                    waiting |= mine
                    continue
                if waiting:
                    start = start if start is not None else offset
                    end, waiting = offset, False
                x = offset
                for r in here:
                    if r[f"{kind}_id"] == rev:
                        start = start if start is not None else x
                        end = x + (r["n"] if shows(r) else 0)
                    x += r["n"] if shows(r) else 0
                offset, n = x + 1, n + 1
            if waiting:
                last = max(0, offset - 1)
                start = start if start is not None else last
                end = last
            out[kind, rev] = (start, end)
    return out


def test_edit_places(spark):
    """Random pieces of many documents, against a state for each change. The last piece of a paragraph is its mark."""
    rng = random.Random(11)
    want, segs, paras = {}, [], []
    change_of = lambda rev, ms: None if rev is None else (rev, None if ms is None else datetime.fromtimestamp(ms, timezone.utc), "A", False, None)
    for doc in range(80):
        rows, dates = [], {}
        for k in range(rng.randrange(1, 14)):
            mark = k % 4 == 3
            r = {"para": k // 4, "n": 0 if mark else rng.randrange(4)}
            for kind in ("ins", "del"):
                rev = rng.choice([None, None, f"r{rng.randrange(5)}"])
                r[f"{kind}_id"] = rev
                ms = dates.setdefault((kind, rev), rng.choice([None, rng.randrange(1, 6)])) if rev else None
                r[f"{kind}_ms"] = None if ms is None else ms * 1000
            both = [change_of(r[f"{kind}_id"], None if r[f"{kind}_ms"] is None else r[f"{kind}_ms"] // 1000) for kind in ("ins", "del")]
            if mark:
                paras.append((doc, k // 4, None, *both))
            else:
                segs.append((doc, k // 4, k % 4, "text", "x" * r["n"], *both))
            rows.append(r)
        for p in {r["para"] for r in rows} - {x[1] for x in paras if x[0] == doc}:
            paras.append((doc, p, None, None, None))
            rows.append({"para": p, "n": 0, "ins_id": None, "ins_ms": None, "del_id": None, "del_ms": None})
        want |= {(doc, *key): place for key, place in plain_places(rows).items()}
    kind = "struct<id:string,ts:timestamp,author:string,move:boolean,move_name:string>"
    found = positions.edit_positions(spark.createDataFrame(segs, f"doc_id long, para_index int, seg_index int, kind string, text string, ins {kind}, del {kind}"), spark.createDataFrame(paras, f"doc_id long, para_index int, table_id int, mark_ins {kind}, mark_del {kind}"))
    assert {(r.doc_id, r.type, r.rev_id): (r.edit_start, r.edit_end) for r in found.collect()} == want
    assert len(want) > 100


def kept(tracks=True, lock="same", root="00AA0001", rsids=("00AA0002",)):
    """Settings as facts: whether changes are tracked, what became of the lock, of which file the sessions are."""
    how = {"same": dict(enforcement="1", hash="H"), "off": dict(enforcement="0", hash="H"), "other": dict(enforcement="1", hash="I")}
    lock = [w("documentProtection", edit="trackedChanges", salt="S", **how[lock])] if lock != "none" else []
    return kept_settings(*([w("trackRevisions")] if tracks else []), *lock, w("rsids", w("rsidRoot", val=root), *[w("rsid", val=r) for r in (root, *rsids)]))


def test_tamper(spark):
    """All combinations of facts, against what each fact by itself is evidence of."""
    title = para(run("Title", rsid="00AA0002"))
    facts_of = list(itertools.product([True, False], ["same", "none", "off", "other"], ["own", "foreign"], ["tracked", "typed", "blank", "taken"], [True, False]))
    extra = {"tracked": change("ins", T[0], "My text", rsid="00BB0001"), "typed": run("pasted", rsid="00CC0001"), "blank": run("", rsid="00CC0001"), "taken": change("del", T[1], "typed", rsid="00CC0001")}
    made, alone, against = [], [], []
    for tracks, lock, root, text, named in facts_of:
        root_id = "00AA0001" if root == "own" else "00DD0001"
        signed = change("ins", T[0], "x", rsid="00BB0001") if named else change("ins", None, "x", by=None, rsid="00BB0001")
        made.append(docx(title, para(extra[text], signed), settings=kept(tracks, lock, root_id)))
        here = ({"trackingOff"} if not tracks else set()) | ({"authorDateRemoved"} if not named else set())
        alone.append(here | ({"lockReleased"} if lock == "off" else set()))
        tampered = {"none": {"lockReleased"}, "off": {"lockReleased"}, "other": {"lockChanged"}, "same": set()}[lock]
        against.append(here | tampered | ({"notFromTemplate"} if root == "foreign" else set()) | ({"untrackedText"} if text in ("typed", "taken") else set()))
    facts = source.facts(table(spark, made)).withColumn("template_id", F.lit(1000).cast("long"))
    templates = source.facts(table(spark, [docx(title, settings=kept())])).withColumn("doc_id", F.lit(1000).cast("long"))
    for want, rows in ((against, tamper.check(facts, templates)), (alone, tamper.check(facts.drop("template_id")))):
        found = {r.doc_id: r.evidence for r in tamper.report([rows]).collect()}
        for k, facts_k in enumerate(facts_of):
            assert set(found.get(k, [])) == want[k], facts_k
            assert found.get(k, []) == sorted(found.get(k, []), key=tamper.EVIDENCE.index)
    bare = source.facts(table(spark, [docx(title, settings=NO_PART)])).withColumn("template_id", F.lit(1000).cast("long"))
    assert [r.evidence for r in tamper.check(bare, templates).collect()] == ["lockReleased"]
    assert [r.n for r in spark.createDataFrame([("a/b.docx",)], "p string").select(tamper.marked_name(F.col("p")).alias("n")).collect()] == ["a/b-tampered.docx"]


def test_integrity(spark):
    core = '<x xmlns:dcterms="d"><dcterms:created>2021-11-20T00:00:00Z</dcterms:created><dcterms:modified>2021-11-25T00:00:00Z</dcterms:modified></x>'
    numbered = [change("ins", T[0], "a", number=5), change("ins", T[4], "b", number=3), change("ins", None, "c", by=None, number=5)]
    body = para(*numbered, change("ins", T[2], change("del", T[0], "x", number=10), number=9), run("y", rsid="00EE0001"))
    files = table(spark, [docx(body, settings=kept(), parts={"docProps/core.xml": core, "docProps/app.xml": "<p><Application>App</Application></p>"})])
    got = {r.item: r for r in integrity.check(source.facts(files), source.segments(files), F.lit("2024-06-01").cast("timestamp")).collect()}
    assert {k: r.observed for k, r in got.items()} == {"settings": False, "undated": True, "duplicateIds": True, "idOrder": True, "futureDates": True, "beforeCreated": True, "deletedBeforeInserted": True, "rsids": True, "application": None}
    assert got["undated"].details == {"revisions": "5", "undated": "1", "without_author": "1", "authors": "1"}
    assert got["idOrder"].details["decreases"] == "1" and got["application"].details["application"] == "App"


def test_lock_and_history():
    assert docx_edit.password_key("Example").to_bytes(4, "little").hex().upper() == "7EEDCE64" and docx_edit.password_key("") == 0
    assert docx_edit.password_key("123456789012345") == docx_edit.password_key("1234567890123456789")
    # A salt and hash as a word processor wrote them
    salt = base64.b64decode("RgLp8iDWIxKFGIUl0I4aWA==")
    assert docx_edit.password_hash("Teacher2026", salt) == "OJG4rIAmgXYL7zhvrW9dAdhp+pDTHdJ2j03hTqy2VeMtmPSp7WcLXMwtYsx6YU/SFYqg740eNj5ax4Wq7v3fYg=="
    made = docx_edit.lock(docx(para("x"), settings=kept_settings(w("zoom", percent=100), w("defaultTabStop", val=1))), "pw", salt)
    xml = source.Package(made).text("word/settings.xml")
    assert xml.index("zoom") < xml.index("trackRevisions") < xml.index("documentProtection") < xml.index("defaultTabStop")
    assert docx_edit.verify_lock(xml, "pw") is True and docx_edit.verify_lock(xml, "no") is False and docx_edit.verify_lock(written(kept_settings()), "pw") is None
    again = source.Package(docx_edit.lock(made)).text("word/settings.xml")
    assert again.count("documentProtection") == 1 and again.count("trackRevisions") == 1
    fixed = source.Package(docx_edit.keep_history(docx(para("x"), settings=kept_settings(w("removePersonalInformation"), w("removeDateAndTime"))))).text("word/settings.xml")
    assert "remove" not in fixed and "trackRevisions" in fixed


def test_comments(spark):
    said = lambda number, para_id, text, **more: w("comment", para(text, w14__paraId=para_id), id=number, **more)
    thread = lambda para_id, done, parent=None: w("w15:commentEx", w15__paraId=para_id, w15__paraIdParent=parent, w15__done=done)
    parts = {
        "word/comments.xml": w("comments", said(1, "0000000a", "Why?", author="Rev", date="2024-03-01T08:00:00Z"), said(2, "0000000B", "So", author="Ann")),
        "word/commentsExtended.xml": w("w15:commentsEx", thread("0000000A", 0), thread("0000000B", 1, "0000000A")),
        "word/commentsIds.xml": w("w16cid:commentsIds", w("w16cid:commentId", w16cid__paraId="0000000A", w16cid__durableId="0000d001")),
    }
    body = para("before ", w("commentRangeStart", id=1), change("ins", T[0], "quoted"), w("commentRangeEnd", id=1), w("r", w("commentReference", id=1)), " after")
    content = docx(body, parts=parts)
    a, b = source.comments(table(spark, [content])).orderBy("nth").collect()
    assert (a.key, a.quote, a.prefix, a.suffix, a.done) == ("d:0000D001", "quoted", "before ", " after\n", False)
    assert a.revisions == [f"ins|Ann|{T[0]}|{source.fnv_pair('quoted')}"] and b.parent_key == a.key and b.done and b.key.startswith("h:")
    made = docx_edit.reply(content, "0000000A", "Kept <safe>", "palimpsest", at(TIMES[1]), "0000000C")
    replied = source.comments_of(source.Package(made))
    assert replied[2]["text"] == "Kept <safe>" and replied[2]["parent_key"] == a.key and replied[2]["quote"] == "quoted"
    plain = lambda c: [(s["text"], s["ins"] and s["ins"]["id"]) for s in source.Model(source.Package(c).tree("word/document.xml")).segments]
    assert plain(made) == plain(content)


def test_submissions(spark):
    """Random histories: what each submission adds, keeps and dates back is known from how it was made."""
    rng = random.Random(3)
    minute = lambda k: f"2024-05-{1 + k // 1440:02d}T{k // 60 % 24:02d}:{k % 60:02d}:00Z"
    rows, want, made = [], {}, []
    for key in range(12):
        seen, latest, last = [], None, 0
        for n in range(1, 6):
            new = []
            for _ in range(rng.randrange(4)):
                back = latest is not None and rng.random() < 0.3
                last += rng.randrange(10, 300)
                when = rng.randrange(max(1, latest - 5)) if back else max(last, (latest or 0) + 10)
                new.append((when, f"text {key} {n} {rng.random()} ", rng.choice(["ins", "del"])))
            shown = [x for x in seen if rng.random() < 0.7]  # the others were accepted or rejected
            late = sum(latest is not None and x[0] < latest for x in new)
            want[f"k{key}", n] = (len(new), len(shown), late)
            rows.append((len(made), f"k{key}", n))
            made.append(docx(para("Text. ", *[change(kind, minute(when), text) for when, text, kind in rng.sample(shown + new, len(shown + new))])))
            seen += new
            latest = max([latest or 0, *[x[0] for x in new]]) if new or latest is not None else None
            last = max(last, latest or 0)
    events = source.revisions(table(spark, made)).join(spark.createDataFrame(rows, "doc_id long, key string, n int"), "doc_id")
    found = snapshots.deltas(events.select("key", "n", "seq", "type", "author", "ts", "text", "chars"))
    got = {(r.key, r.n): (r.new_events, r.carried_events, r.dated_before_previous) for r in found.collect()}
    assert got == {k: x for k, x in want.items() if x[0] + x[1]}  # a submission without changes has no row
    assert {(r.key, r.n) for r in snapshots.late_evidence(found).collect()} == {k for k, x in want.items() if x[2]}
    assert all(r.gap_before_hours is None or r.gap_before_hours >= 0 for r in snapshots.sessions(found).collect())


def test_version_points(spark):
    start = datetime(2022, 7, 5, 16, 40, tzinfo=timezone.utc)
    minutes = [0, 12, 25, 41, 900]
    events = spark.createDataFrame([(1, start + timedelta(minutes=m)) for m in minutes] + [(1, None)], "doc_id long, ts timestamp")
    ms = lambda m: int(start.timestamp() * 1000) + m * 60_000
    got = [(r.at_ms, r.label, r.changes) for r in versions.version_points(events, session_hours=1).orderBy("at_ms").collect()]
    assert got == [(ms(0) - 1, "initial", 0), (ms(41), "session", 4), (ms(900), "session", 5)]
    got = [(r.at_ms, r.label) for r in versions.version_points(events, every_seconds=1200).orderBy("at_ms").collect()]
    assert got == [(ms(0) - 1, "initial"), (ms(20), "every"), (ms(40), "every"), (ms(60), "every"), (ms(900), "every")]


def test_flow(spark):
    day = lambda h, m=0: f"2024-04-01T{h:02d}:{m:02d}:00Z"
    text = "A sentence that is long enough to count as moved."
    moved = lambda kind: para(w(f"{kind}RangeStart", id=7, name="mv"), change(kind, day(14), "going"), w(f"{kind}RangeEnd", id=7), mark=(kind, day(14)))
    lone = lambda kind, when: para(change(kind, when, text), mark=(kind, when))
    body = [para("Base ", change("ins", day(9), "typed"), change("ins", day(9, 30), "b" * 200)), lone("del", day(11)), lone("ins", day(11, 5)), moved("moveFrom"), moved("moveTo"), para("still")]
    files = table(spark, [docx(*body)])
    made = flow.build(source.segments(files), source.paragraphs(files))
    assert [(r.session, r.changes) for r in made["sessions"].orderBy("session").collect()] == [(0, 2), (1, 4), (2, 4)]
    units = {(r.session, r.unit): r.change for r in made["units"].collect()}
    assert units[0, "p0"] == "bulk" and units[0, "p5"] == "unchanged" and units[1, "p1"] == "movedFrom" and units[1, "p2"] == "movedTo" and units[2, "p3"] == "movedFrom" and units[2, "p4"] == "movedTo"
    links = {(r.session, r.from_unit, r.to_unit, r.kind) for r in made["links"].collect()}
    assert links == {(1, "p1", "p2", "relocate"), (2, "p3", "p4", "move")}
    heat = {(r.session, r.para_index): r for r in made["heat"].collect()}
    assert heat[0, 0].ins_chars == 205 and heat[0, 0].bulk_chars == 200 and heat[1, 2].moved_in == len(text)
    categories = spark.createDataFrame([("fine", 0), ("bulk", 1), ("moved", 100)], "category string, priority int")
    paint = {(r.session, r.para_index, r.rank): r.category for r in flow.paint(made["heat"], categories).collect()}
    assert paint[0, 0, 1] == "bulk" and paint[1, 2, 1] == "moved"


def test_looks_sections_and_notes(spark):
    style = lambda id, *inside: w("style", *inside, styleId=id)
    styles = w("styles", style("Base", w("rPr", w("sz", val=30))), style("Quiet", w("basedOn", val="Base"), w("rPr", w("vanish"))), style("H", w("name", val="heading 2")))
    footnotes = w("footnotes", w("footnote", w("p"), type="separator", id=0), w("footnote", para("見る"), para("ab"), id=2))
    extent, shape = w("wp:extent"), w("v:shape")
    extent.attrib |= {"cx": "1", "cy": "254000"}
    shape.set("style", "width:2cm;height:1in")
    figure = [run(w("drawing", w("wp:inline", extent))), run(w("pict", shape))]
    section = w("sectPr", w("type", val="continuous"), w("pgSz", w=11906, h=16838), w("pgMar", top=1440, left=1000), w("cols", num=2))
    quiet = w("rStyle", val="Quiet")
    body = [para(run("a見", look=[quiet]), run("b", look=[quiet, w("sz", val=20), w("vanish", val=0)]), "c", *figure, look=[w("pStyle", val="H")]), section]
    files = table(spark, [docx(*body, parts={"word/styles.xml": styles, "word/footnotes.xml": footnotes})])
    got = source.segments(files).orderBy("seg_index").collect()
    assert [(s.text, s.size_pt, s.hidden, s.width, s.height_pt) for s in got] == [("a見", 15.0, True, 1.5, None), ("b", 10.0, False, 0.5, None), ("c", None, False, 0.5, None), (None, None, False, 0.0, 20.0), (None, None, False, 0.0, 72.0)]
    assert source.paragraphs(files).first().heading_level == 2
    s = source.sections(files).first()
    assert (s.width_twips, s.margin_top, s.margin_bottom, s["columns"], s.breaks_page) == (11906, 1440, None, 2, False)
    assert [(n.kind, n.note_id, n.paragraphs, n.chars, n.width) for n in source.notes(files).collect()] == [("footnote", "2", 2, 4, 3.0)]
