from files import change, docx, para, run, table, w

from palimpsest.operators import structure
from palimpsest.sources import adapters, nodes
from palimpsest.sources import docx as read_docx


def style(name, *inside, **more):
    return w("style", *inside, styleId=name, **more)


def numbers(*levels, pattern=3, num=9, overrides=()):
    kinds = [w("lvl", w("start", val=start), w("numFmt", val=kind), w("lvlText", val=text), w("pPr", w("ind", left=100 * k)), ilvl=k) for k, (start, kind, text) in enumerate(levels)]
    return w("numbering", w("abstractNum", *kinds, abstractNumId=pattern), w("num", w("abstractNumId", val=pattern), *[w("lvlOverride", w("startOverride", val=v), ilvl=k) for k, v in overrides], numId=num))


def listed(level, num=9):
    return para("x", look=[w("numPr", w("ilvl", val=level), w("numId", val=num))])


def rows_of(spark, *contents):
    return nodes.nodes(table(spark, contents)).cache()


def test_nodes(spark):
    rows = rows_of(spark, docx(para("a", "b")), b"no zip", docx(parts={"word/styles.xml": "<w:styles xmlns:w='x'><w:style/><w:broken"}))
    assert [(r.doc_id, r.part, r.text.partition(":")[0]) for r in rows.where("tag = '#error'").orderBy("doc_id").collect()] == [(1, None, "BadZipFile"), (2, "word/styles.xml", "ExpatError")]
    assert rows.where("doc_id = 1").count() == 1
    body = rows.where("doc_id = 0 and part = 'word/document.xml'").orderBy("node").collect()
    assert [(r.tag, r.parent, r.depth, r.text) for r in body] == [("document", None, 0, None), ("body", 0, 1, None), ("p", 1, 2, None), ("r", 2, 3, None), ("t", 3, 4, "a"), ("r", 2, 3, None), ("t", 5, 4, "b")]
    assert [r.in_p for r in body] == [None, None, 2, 2, 2, 2, 2] and [r.in_r for r in body][3:] == [3, 3, 5, 5]
    assert rows.where("doc_id = 2 and tag = 'style'").count() == 1  # what came before the break


def test_chains(spark):
    """Fourteen styles in a row: what is twelve up or more doesn't count; two styles in a ring; a style based on one that isn't there."""
    long = [style(f"L{k}", *([w("basedOn", val=f"L{k - 1}")] if k else []), w("pPr", w("jc", val="c") if k == 0 else w("ind", left=k))) for k in range(14)]
    ring = [style("A", w("basedOn", val="B"), w("rPr", w("b"))), style("B", w("basedOn", val="A"), w("rPr", w("b", val=0), w("sz", val=9)))]
    more = [style("N", w("basedOn", val="none"), w("name", val="Heading 3")), style("T", w("tblStylePr", w("rPr", w("i")))), style("A", w("rPr", w("i")), w("basedOn", val="B"))]
    found = structure.resolved_styles(structure.styles(rows_of(spark, docx(parts={"word/styles.xml": w("styles", *long, *ring, *more)}))))
    got = {r.style: (r.properties, r.heading_level) for r in found.collect()}
    assert got["L11"][0]["pPr/jc"] == "c" and "pPr/jc" not in got["L12"][0] and got["L13"][0] == {"pPr/ind": '{"left":"13"}'}
    assert got["A"] == ({"rPr/i": "true", "rPr/b": "0", "rPr/sz": "9"}, None) and got["B"][0] == {"rPr/b": "0", "rPr/sz": "9", "rPr/i": "true"}  # of equal ids the last
    assert got["N"] == ({}, 3) and got["T"] == ({}, None)


def test_paragraphs_take_properties_in_order(spark):
    defaults = w("docDefaults", w("rPrDefault", w("rPr", w("sz", val=21), w("lang", val="en"))), w("pPrDefault", w("pPr", w("jc", val="left"), w("keepNext"))))
    styles = w("styles", defaults, w("style", w("pPr", w("jc", val="both"), w("outlineLvl", val=1), w("numPr", w("numId", val=9))), styleId="D", type="paragraph", default=1), style("S", w("rPr", w("sz", val=30))))
    old = w("pPrChange", w("pPr", w("jc", val="right"), w("numPr", w("numId", val=9))), id=1)
    body = [para("a"), para("b", look=[w("pStyle", val="S"), w("jc", val="center"), w("outlineLvl", val=9), old]), para("c", look=[w("numPr", w("numId", val=0))]), para(run("d", look=[w("sz", val=99)]), look=[w("ind", left=7)])]
    rows = rows_of(spark, docx(*body, parts={"word/styles.xml": styles, "word/numbering.xml": numbers((1, "decimal", "%1."))}))
    a, b, c, d = structure.paragraphs(rows).orderBy("para_index").collect()
    assert (a.style, a.num, a.level, a.heading_level) == ("D", "9", 0, 2) and a.properties["pPr/jc"] == "both" and a.properties["rPr/sz"] == "21" and a.properties["pPr/ind"] == '{"left":"0"}' and a.properties["pPr/keepNext"] == "true"
    assert (b.style, b.num, b.heading_level) == ("S", None, None) and b.properties["pPr/jc"] == "center" and b.properties["rPr/sz"] == "30"
    assert c.num is None and c.properties["pPr/jc"] == "both" and d.properties["pPr/ind"] == '{"left":"7"}' and d.properties["rPr/sz"] == "21"


def test_labels(spark):
    levels = [(1, "upperRoman", "%1."), (3, "lowerLetter", "%1-%2)"), (1, "decimalZero", "%1/%2/%3"), (1, "bullet", "*")]
    order = [0, 1, 1, 2, 0, 2, 2, 1, 3, 0, 5]
    body = [listed(k) for k in order] + [para("plain"), listed(0, num=4)] + [listed(1)] * 27
    rows = rows_of(spark, docx(*body, parts={"word/numbering.xml": numbers(*levels, overrides=[(0, 4)])}))
    got = [(r.label, r.counters) for r in structure.labels(structure.paragraphs(rows), structure.numbering(rows)).orderBy("para_index").collect()]
    assert [x[0] for x in got[:12]] == ["IV.", "IV-c)", "IV-d)", "IV/d/01", "V.", "V/c/01", "V/c/02", "V-c)", "*", "VI.", None, None]
    assert got[3][1] == [4, 4, 1] and got[12][0] == "VI-c)" and got[-1][0] == "VI-cc)"
    n = spark.range(1).select(*[structure.roman(structure.F.lit(k)).alias(str(k)) for k in (1, 4, 9, 40, 1994, 3999, 4000)]).first()
    assert list(n) == ["I", "IV", "IX", "XL", "MCMXCIV", "MMMCMXCIX", "4000"]


def test_cells(spark):
    cell = lambda span=None, merge=None, inside=(): w("tc", w("tcPr", *([w("gridSpan", val=span)] if span else []), *([w("vMerge", val=None if merge == "on" else merge)] if merge else [])), *inside)
    inner = w("tbl", w("tr", cell(), cell(2)))
    rows = [w("tr", cell(2, "restart"), cell()), w("tr", cell(2, "on"), cell(inside=[inner])), w("tr", w("trPr", w("gridBefore", val=1)), cell(), cell(merge="on")), w("tr", cell(2, "on"), cell(merge="on"))]
    got = structure.cells(rows_of(spark, docx(para(change("ins", "2024-01-01T00:00:00Z", "x")), w("tbl", *rows)))).orderBy("table", "row", "cell").collect()
    at = [(r.row, r.cell, r.col, r.col_span, r.row_span, r.first_row) for r in got]
    assert at[:8] == [(0, 0, 0, 2, 2, 0), (0, 1, 2, 1, 1, 0), (1, 0, 0, 2, 2, 0), (1, 1, 2, 1, 3, 1), (2, 0, 1, 1, 1, 2), (2, 1, 2, 1, 3, 1), (3, 0, 0, 2, 1, 3), (3, 1, 2, 1, 3, 1)]
    assert at[8:] == [(0, 0, 0, 1, 1, 0), (0, 1, 1, 2, 1, 0)]


def test_changes(spark):
    """Nested changes, undated ones, tabs and breaks, changes of paragraph marks, dates of all kinds."""
    when = "2023-05-06T07:08:09+02:00"
    inner = change("del", "2023-05-06T07:08:09", "gone", number=2)
    body = [para(change("ins", when, run("a", w("tab"), "b", w("br")), inner, number=1), change("del", None, "?", number=3), change("ins", "no date", "x", number=4), look=[w("tabs", w("tab", val="left"))]), para("plain", mark=("ins", when))]
    found = nodes.revisions(rows_of(spark, docx(*body)), ["word/document.xml"]).orderBy("node").collect()
    assert [(r.type, r.rev_id, r.text, r.ts and str(r.ts), r.dated) for r in found] == [("ins", "1", "a\tb\ngone", "2023-05-06 05:08:09", True), ("del", "2", "gone", "2023-05-06 07:08:09", True), ("del", "3", "?", None, False), ("ins", "4", "x", None, True), ("ins", "1001", "", "2023-05-06 05:08:09", True)]


def test_wanted_elements(spark):
    """Only the elements that are asked for become rows, with the properties that are theirs alone, first of equal names."""
    old = w("pPrChange", w("pPr", w("jc", val="right")), id=1)
    body = [para(run("a", look=[w("sz", val=9)]), look=[w("jc", val="both"), w("jc", val="left"), w("ind", left="7", right='"'), w("numPr", w("numId", val=4)), w("keepNext"), old])]
    files = table(spark, [docx(*body, parts={"word/styles.xml": w("styles", style("S", w("rPr", w("b"))))})])
    rows = nodes.nodes(files, structure.FOR_PARAGRAPHS).collect()
    assert [(r.tag, r.node) for r in rows if r.part == structure.BODY] == [("p", 2)]
    p, s = [next(r.properties for r in rows if r.tag == tag) for tag in ("p", "style")]
    assert p == {"pPr/jc": "both", "pPr/ind": '{"left":"7","right":"\\""}', "pPr/keepNext": "true", "pPr/numId": "4", "pPr/pPrChange": '{"id":"1"}'} and s == {"rPr/b": "true"}
    assert {r.part for r in nodes.nodes(files, structure.FOR_STYLES).collect()} == {structure.STYLES}


def test_files_are_made_by_many_tasks(spark):
    """Small tables give large files: their bytes don't say how many tasks these take."""
    talks = spark.createDataFrame([(k, 0, "user", "a b") for k in range(64)], "conv_id long, turn int, role string, text string")
    for made in (adapters.structured_files(talks), adapters.conversation_files(talks)):
        assert made.rdd.getNumPartitions() >= 16 and made.count() == 64


def test_stats_read_files_once(spark):
    """What the lengths, changes and settings of files come from is parsed once, not once for each."""
    files = table(spark, [docx(para("a", change("ins", "2024-01-01T00:00:00Z", "xy")))]).withColumn("path", structure.F.lit("p"))
    found = read_docx.stats(files)
    assert [(r.final_chars, r.inserted, r.deleted) for r in found.collect()] == [(3, 2, 0)]
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
