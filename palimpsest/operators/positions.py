"""Places of changes in a document's states, from its segments.

segments: doc_id, para_index, seg_index, kind (text, lineBreak, pageBreak, figure), text, ins and del, each null or a struct of
id, ts, author, move, move_name. paragraphs: doc_id, para_index, table_id, mark_ins, mark_del (of the paragraph mark).
Lengths are UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.columns import millis, u16_length
from palimpsest.operators import dominance


def visible(ins: Column, deleted: Column, at_ms: Column | None = None) -> Column:
    """Whether something shows: in the final state if ``at_ms`` is None (not deleted), else at that time. Undated changes were always there."""
    if at_ms is None:
        return deleted.isNull()
    inserted = ins.isNull() | ins["ts"].isNull() | (millis(ins["ts"]) <= at_ms)
    gone = deleted.isNotNull() & (deleted["ts"].isNull() | (millis(deleted["ts"]) <= at_ms))
    return inserted & ~gone


def seg_text(kind: Column, text: Column) -> Column:
    return F.when(kind == "text", F.coalesce(text, F.lit(""))).when(kind.isin("lineBreak", "pageBreak"), "\n").otherwise("")


def pieces(segments: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Segments and paragraph marks as rows of one table, in document order: doc_id, para_index, seg_index, mark, text, ins, del.

    The mark comes last in its paragraph.
    """
    segs = segments.select("doc_id", "para_index", F.col("seg_index"), F.lit(False).alias("mark"), seg_text(F.col("kind"), F.col("text")).alias("text"), "ins", "del")
    marks = paragraphs.select("doc_id", "para_index", F.lit(2**31 - 1).alias("seg_index"), F.lit(True).alias("mark"), F.lit("").alias("text"), F.col("mark_ins").alias("ins"), F.col("mark_del").alias("del"))
    return segs.unionByName(marks)


def placed(rows: DataFrame, at_ms: Column | None = None) -> DataFrame:
    """``rows`` of pieces with where they are in a state: shown, exists (their paragraph), state_para, para_start and offset.

    state_para counts the paragraphs that exist before; para_start is the place of the paragraph in the text of the state
    (paragraphs joined by a line break), and offset the place in the paragraph. Prefix sums: one pass for each document.
    """
    rows = rows.withColumn("shown", visible(F.col("ins"), F.col("del"), at_ms))
    rows = rows.withColumn("__n", F.when(F.col("shown"), u16_length(F.col("text"))).otherwise(0))
    in_para = W.partitionBy("doc_id", "para_index").orderBy("seg_index")
    rows = rows.withColumn("offset", F.sum("__n").over(in_para.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n"))
    paras = rows.groupBy("doc_id", "para_index").agg(F.bool_or("shown").alias("exists"), F.sum("__n").alias("para_chars"))
    before = W.partitionBy("doc_id").orderBy("para_index").rowsBetween(W.unboundedPreceding, -1)
    count = lambda x: F.coalesce(F.sum(F.when(F.col("exists"), x).otherwise(0)).over(before), F.lit(0))
    after = W.partitionBy("doc_id").orderBy("para_index").rowsBetween(1, W.unboundedFollowing)
    paras = paras.withColumns({
        "state_para": count(F.lit(1)), "para_start": count(F.col("para_chars") + 1), "more": F.coalesce(F.bool_or("exists").over(after), F.lit(False)),
        "before_chars": F.last(F.when(F.col("exists"), F.col("para_chars")), ignorenulls=True).over(before),
    })
    return rows.join(paras, ["doc_id", "para_index"]).withColumnRenamed("__n", "shown_chars")


def final_positions(segments: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """One row for each change (doc_id, type, rev_id) with its place in the final document.

    A change in a paragraph that isn't there is at the start of the next one that is, or at the end of the document. Returns
    ts, author, move, move_name, chars, text, includes_para_mark, paras, start_offset, end_offset, start_para, end_para,
    start_in_para, end_in_para, start_missing, end_missing and final_chars. Undated changes last.
    """
    rows = placed(pieces(segments, paragraphs))
    at_end = ~F.col("exists") & ~F.col("more")
    para = F.when(at_end, F.greatest(F.lit(0), F.col("state_para") - 1)).otherwise(F.col("state_para"))
    # after the last paragraph: its end, one before where the next one would start
    base = F.when(at_end, F.greatest(F.lit(0), F.col("para_start") - 1)).otherwise(F.col("para_start"))
    inside = F.when(F.col("exists"), F.col("offset")).when(at_end, F.coalesce("before_chars", F.lit(0))).otherwise(0)
    start = F.when(F.col("exists"), base + F.col("offset")).otherwise(base)
    rows = rows.withColumns({"__para": para, "__start": start, "__in": inside, "__missing": ~F.col("exists")})
    each = F.array(F.struct(F.lit("ins").alias("type"), F.col("ins").alias("rev"), F.col("del").isNull().alias("stays")), F.struct(F.lit("del").alias("type"), F.col("del").alias("rev"), F.lit(False).alias("stays")))
    rows = rows.select("*", F.inline(F.filter(each, lambda e: e["rev"].isNotNull())))
    order = F.struct("para_index", "seg_index")
    first = lambda c: F.min_by(c, order)
    last = lambda c: F.max_by(c, order)
    shown = F.when(F.col("exists"), F.col("shown_chars")).otherwise(0)
    n = F.when(F.col("mark"), 0).otherwise(u16_length(F.col("text")))
    out = rows.groupBy("doc_id", "type", F.col("rev.id").alias("rev_id")).agg(
        first("rev.ts").alias("ts"), first("rev.author").alias("author"), first("rev.move").alias("move"), first("rev.move_name").alias("move_name"),
        F.sum(n).cast("int").alias("chars"), F.sum(F.when(F.col("stays"), n).otherwise(0)).cast("int").alias("final_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_index", "seg_index", "text"))), lambda p: p["text"]), "").alias("text"),
        F.bool_or("mark").alias("includes_para_mark"), F.sort_array(F.collect_set("para_index")).alias("paras"),
        first("__start").cast("int").alias("start_offset"), last(F.col("__start") + shown).cast("int").alias("end_offset"),
        first("__para").cast("int").alias("start_para"), last("__para").cast("int").alias("end_para"),
        first("__in").cast("int").alias("start_in_para"), last(F.col("__in") + shown).cast("int").alias("end_in_para"),
        first("__missing").alias("start_missing"), last("__missing").alias("end_missing"),
    )
    order = W.partitionBy("doc_id").orderBy(F.col("ts").asc_nulls_last(), first_of(F.col("paras")), "type", "rev_id")
    return out.withColumn("seq", F.row_number().over(order) - 1)


def first_of(values: Column) -> Column:
    return F.get(values, F.lit(0))


def edit_positions(segments: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """doc_id, type, rev_id and the place of each dated change in the document as it was then: after an insertion, just before a deletion.

    A piece shows from a time to another, so the characters before a place at a time are a sum over what came and went up to
    then and lies before it: points in two orders. So are the paragraphs that are there, which come with their first piece
    and go with their last. A change in a paragraph that isn't there is at the start of the next one, or at the document's end.
    """
    never, always = F.lit(2**62).cast("long"), F.lit(-(2**62)).cast("long")
    rows = pieces(segments, paragraphs).select("doc_id", "para_index", "seg_index", u16_length(F.col("text")).cast("long").alias("n"), "ins", "del")
    rows = rows.withColumns({"from": F.when(F.col("ins.ts").isNotNull(), millis(F.col("ins.ts"))).otherwise(always), "to": F.when(F.col("del").isNull(), never).otherwise(F.coalesce(millis(F.col("del.ts")), always))})
    steps = rows.where(F.col("from") < F.col("to")).select("doc_id", "para_index", "seg_index", "n", F.inline(F.array(F.struct(F.col("from").alias("t"), F.lit(1).alias("sign")), F.struct(F.col("to").alias("t"), F.lit(-1).alias("sign")))))
    chars = steps.where("n > 0").select("doc_id", "t", F.struct("para_index", "seg_index").alias("x"), (F.col("sign") * F.col("n")).alias("w"))
    each_time = steps.groupBy("doc_id", "para_index", "t").agg(F.sum("sign").alias("sign"))
    shown = F.sum("sign").over(W.partitionBy("doc_id", "para_index").orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    there = each_time.select("doc_id", "para_index", "t", "sign", shown.alias("shown"))
    there = there.select("doc_id", "t", F.col("para_index").alias("x"), ((F.col("shown") > 0).cast("int") - (F.col("shown") - F.col("sign") > 0).cast("int")).alias("w")).where("w <> 0")

    change = lambda kind, before: F.struct(F.lit(kind).alias("type"), F.col(f"{kind}.id").alias("rev_id"), (millis(F.col(f"{kind}.ts")) - before).alias("at"))
    dated = F.filter(F.array(change("ins", 0), change("del", 1)), lambda c: c["at"].isNotNull() & c["rev_id"].isNotNull())
    at = F.struct("para_index", "seg_index", F.when((F.col("from") <= F.col("at")) & (F.col("at") < F.col("to")), F.col("n")).otherwise(0).alias("n"))
    ends = rows.select("doc_id", "para_index", "seg_index", "n", "from", "to", F.inline(dated)).groupBy("doc_id", "type", "rev_id", "at").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    ends = ends.select("doc_id", "type", "rev_id", "at", F.inline(F.array(F.struct(F.lit("start").alias("end"), F.col("first").alias("p")), F.struct(F.lit("end").alias("end"), F.col("last").alias("p"))))).select("*", "p.*").drop("p")
    key = F.struct("type", "rev_id", "at", "end")
    before = dominance.sums(chars, ends.select("doc_id", key.alias("id"), F.col("at").alias("t"), F.struct("para_index", "seg_index").alias("x")), ["doc_id"])
    asks = ends.select("doc_id", "at", "para_index", F.inline(F.array(F.struct(F.lit(0).alias("and_own"), key.alias("end")), F.struct(F.lit(1).alias("and_own"), key.alias("end")))))
    paras = dominance.sums(there, asks.select("doc_id", F.struct("end", "and_own").alias("id"), F.col("at").alias("t"), (F.col("para_index") + F.col("and_own")).alias("x")), ["doc_id"])
    nth = lambda own: F.max(F.when(F.col("id.and_own") == own, F.col("below")))
    paras = paras.groupBy("doc_id", F.col("id.end").alias("id")).agg(nth(0).alias("nth"), nth(1).alias("with_own"), F.first("upto").alias("total"))
    found = ends.withColumn("id", key).join(before.select("doc_id", "id", F.col("below").alias("chars")), ["doc_id", "id"]).join(paras, ["doc_id", "id"])
    exists = F.col("with_own") > F.col("nth")
    back = F.when(~exists & (F.col("nth") == F.col("total")), 1).otherwise(0)  # none follows: the end of the last one
    place = F.struct(F.greatest(F.lit(0), F.col("nth") - back).cast("int").alias("para"), F.greatest(F.lit(0), F.col("chars") + F.col("nth") - back).cast("int").alias("at"), F.when(exists, F.col("n")).otherwise(0).cast("int").alias("n"), (~exists).alias("missing"))
    pick = lambda end: F.max(F.when(F.col("end") == end, place))
    both = found.groupBy("doc_id", "type", "rev_id", "at").agg(pick("start").alias("a"), pick("end").alias("z"))
    return both.select(
        "doc_id", "type", "rev_id", F.col("a.at").alias("edit_start"), (F.col("z.at") + F.col("z.n")).alias("edit_end"), F.col("a.para").alias("edit_start_para"),
        F.col("z.para").alias("edit_end_para"), F.col("a.missing").alias("edit_start_missing"), F.col("z.missing").alias("edit_end_missing"),
    )


def attach(events: DataFrame, positions: DataFrame) -> DataFrame:
    """``events`` of the body with start_offset and end_offset of their change; null for those elsewhere."""
    p = positions.select("doc_id", "type", "rev_id", "start_offset", "end_offset", "start_para", "end_para")
    body = events.where("part = 'word/document.xml'").join(p, ["doc_id", "type", "rev_id"], "left")
    return body.unionByName(events.where("part <> 'word/document.xml'"), allowMissingColumns=True)


def text_at(segments: DataFrame, paragraphs: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """doc_id, (at_ms,) text: paragraphs that exist, joined by a line break; the final text without ``at`` (doc_id, at_ms)."""
    rows = pieces(segments, paragraphs)
    keys = ["doc_id"] if at is None else ["doc_id", "at_ms"]
    when = None
    if at is not None:
        rows, when = rows.join(at, "doc_id"), F.col("at_ms")
    rows = rows.where(visible(F.col("ins"), F.col("del"), when))
    join = lambda what, sep, *order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(what).alias("__x")))), lambda x: x["__x"]), sep)
    paras = rows.groupBy(*keys, "para_index").agg(join("text", "", "seg_index").alias("__para"))
    return paras.groupBy(*keys).agg(join("__para", "\n", "para_index").alias("text"))


def joined_text_at(segments: DataFrame, paragraphs: DataFrame, at: DataFrame) -> DataFrame:
    """doc_id, at_ms, text of a version: a paragraph whose mark isn't there goes on with the next one's text."""
    rows = pieces(segments, paragraphs).join(at, "doc_id").withColumn("shown", visible(F.col("ins"), F.col("del"), F.col("at_ms")))
    before = W.partitionBy("doc_id", "at_ms").orderBy("para_index", "seg_index").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__run", F.coalesce(F.sum((F.col("mark") & F.col("shown")).cast("int")).over(before), F.lit(0))).where("shown")
    join = lambda what, sep, *order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(what).alias("__x")))), lambda x: x["__x"]), sep)
    runs = rows.groupBy("doc_id", "at_ms", "__run").agg(join("text", "", "para_index", "seg_index").alias("__text"))
    return runs.groupBy("doc_id", "at_ms").agg(join("__text", "\n", "__run").alias("text"))
