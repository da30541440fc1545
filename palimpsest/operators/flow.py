"""Edit flow: what each session did to each paragraph, the change of each unit (paragraph or table), and where text moved.

Works on segments and paragraphs as in ``positions``; lengths are code points.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.columns import millis
from palimpsest.operators import containment
from palimpsest.operators.kinds import BULK_CHARS
from palimpsest.operators.sessions import HOUR_MS
from palimpsest.sources.scratch import stored

#: Fixed values of the heat: characters and changes at which a paragraph counts as fully edited.
HEAT_CHARS, HEAT_CHANGES = 40, 8


def revisions(segments: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Dated changes, moves too: doc_id, type, rev_id, ts, author, move, chars."""
    def side(df: DataFrame, what: str, kind: str, chars: Column) -> DataFrame:
        return df.where(F.col(what).isNotNull()).select("doc_id", F.lit(kind).alias("type"), F.col(f"{what}.id").alias("rev_id"), F.col(f"{what}.ts").alias("ts"), F.col(f"{what}.author").alias("author"), F.col(f"{what}.move").alias("move"), chars.alias("chars"))

    n = F.when(F.col("kind") == "text", F.length("text")).otherwise(0)
    rows = side(segments, "ins", "ins", n).unionByName(side(segments, "del", "del", n))
    rows = rows.unionByName(side(paragraphs, "mark_ins", "ins", F.lit(0))).unionByName(side(paragraphs, "mark_del", "del", F.lit(0)))
    return rows.where("ts is not null").groupBy("doc_id", "type", "rev_id", "ts").agg(F.first("author").alias("author"), F.bool_or("move").alias("move"), F.sum("chars").alias("chars"))


def session_times(changes: DataFrame, hours: float = 1.0, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """doc_id, ts, session, changes (at that time): gap sessions of the changes within the period (inclusive), which is cut out first."""
    if start is not None:
        changes = changes.where(F.col("ts") >= start)
    if end is not None:
        changes = changes.where(F.col("ts") <= end)
    rows = changes.groupBy("doc_id", "ts").agg(F.count(F.lit(1)).alias("changes"))
    w = W.partitionBy("doc_id").orderBy("ts")
    first = millis(F.col("ts")) - millis(F.lag("ts").over(w)) > F.lit(max(0.0, hours) * HOUR_MS)
    return rows.withColumn("__first", F.coalesce(first.cast("int"), F.lit(0))).withColumn("session", F.sum("__first").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("__first")


def flow_sessions(times: DataFrame) -> DataFrame:
    """doc_id, session, start, end, changes of the sessions."""
    return times.groupBy("doc_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.sum("changes").alias("changes"))


def relocations(segments: DataFrame) -> DataFrame:
    """Pieces that were relocated: doc_id, type, para_index, rev_id, ts, text. An insertion whose text is among what was deleted, and the other way round.

    A piece is what one change did to one paragraph; what is compared with it are the segments with the other change alone.
    """
    text = segments.where("kind = 'text'")

    def side(kind: str, other: str) -> DataFrame:
        mine = text.where(F.col(kind).isNotNull() & ~F.coalesce(F.col(f"{kind}.move"), F.lit(False)))
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("seg_index", "text"))), lambda p: p["text"])
        pieces = mine.groupBy("doc_id", "para_index", F.col(f"{kind}.id").alias("rev_id"), F.col(f"{kind}.ts").alias("ts")).agg(F.array_join(ordered, "").alias("text"))
        theirs = text.where(F.col(other).isNotNull() & ~F.coalesce(F.col(f"{other}.move"), F.lit(False)) & F.col(kind).isNull())
        found = containment.with_contained(pieces, theirs, "__found", ["doc_id"], ["para_index", "seg_index"])
        return found.where("__found").select("doc_id", F.lit(kind).alias("type"), "para_index", "rev_id", "ts", "text")

    return side("ins", "del").unionByName(side("del", "ins"))


def touches_of(segments: DataFrame, times: DataFrame, moved: DataFrame) -> DataFrame:
    """A row for each text segment, its insertion or deletion, and the session in which that was made."""
    text = segments.where("kind = 'text'").withColumn("chars", F.length("text"))
    parts = []
    for kind in ("ins", "del"):
        c = F.col(kind)
        parts.append(text.where(c.isNotNull() & c["ts"].isNotNull()).select("doc_id", "para_index", "seg_index", "chars", F.lit(kind).alias("type"), c["id"].alias("rev_id"), c["ts"].alias("ts"), c["author"].alias("author"), F.coalesce(c["move"], F.lit(False)).alias("move"), c["move_name"].alias("move_name")))
    rows = parts[0].unionByName(parts[1])
    rows = rows.join(times.select("doc_id", "ts", "session"), ["doc_id", "ts"])  # each time is in one session
    m = moved.select("doc_id", "type", "para_index", "rev_id", "ts", F.lit(True).alias("relocated"))
    return rows.join(m, ["doc_id", "type", "para_index", "rev_id", "ts"], "left").withColumn("relocated", F.coalesce("relocated", F.lit(False)) & ~F.col("move"))


def visible_chars(segments: DataFrame, paragraphs: DataFrame, at: DataFrame) -> DataFrame:
    """doc_id, at_ms, para_index, chars of the paragraphs that are there at each time (doc_id, at_ms; with para_index, that one alone).

    A paragraph is there if a segment or its mark shows, the table rows around it do too (row_ins, row_del), and its cell
    isn't the continuation of one above (in_merge_continue).
    """
    always = F.lit(-(2**62)).cast("long")
    span = lambda ins, gone, n: ("doc_id", "para_index", F.coalesce(millis(ins["ts"]), always).alias("from"), F.when(gone.isNotNull(), F.coalesce(millis(gone["ts"]), always)).alias("to"), n.cast("long").alias("n"))
    spans = segments.select(*span(F.col("ins"), F.col("del"), F.when(F.col("kind") == "text", F.length("text")).otherwise(0)))
    spans = spans.unionByName(paragraphs.select(*span(F.col("mark_ins"), F.col("mark_del"), F.lit(0)))).where("to is null or to > from")
    step = lambda t, sign: F.struct(F.col(t).alias("t"), (sign * F.col("n")).alias("chars"), F.lit(sign).alias("pieces"))
    steps = spans.select("doc_id", "para_index", F.inline(F.filter(F.array(step("from", 1), step("to", -1)), lambda x: x["t"].isNotNull())))
    asked = paragraphs.select("doc_id", "para_index").join(at, ["doc_id", "para_index"] if "para_index" in at.columns else "doc_id").select("doc_id", "para_index", F.col("at_ms").alias("t"), F.lit(0).cast("long").alias("chars"), F.lit(0).alias("pieces"), F.lit(1).alias("ask"))
    # what came and went up to each time: one pass over both in order, not a join of segments and times
    upto = W.partitionBy("doc_id", "para_index").orderBy("t", "ask").rowsBetween(W.unboundedPreceding, 0)
    both = steps.withColumn("ask", F.lit(0)).unionByName(asked).withColumns({"chars": F.sum("chars").over(upto), "pieces": F.sum("pieces").over(upto)})
    rows = both.where("ask = 1 and pieces > 0").select("doc_id", F.col("t").alias("at_ms"), "para_index", "chars")
    if "row_ins" not in paragraphs.columns:
        return rows
    around = paragraphs.select("doc_id", "para_index", "row_ins", "row_del", "in_merge_continue")
    rows = rows.join(around, ["doc_id", "para_index"])
    in_time = lambda r: r["ts"].isNull() | (millis(r["ts"]) <= F.col("at_ms"))
    hidden = F.exists(F.coalesce("row_ins", F.array()), lambda r: ~in_time(r)) | F.exists(F.coalesce("row_del", F.array()), in_time)
    return rows.where(~hidden & ~F.coalesce("in_merge_continue", F.lit(False))).select("doc_id", "at_ms", "para_index", "chars")


def heat_sums(touches: DataFrame, bulk_chars: int = BULK_CHARS, highlights: DataFrame | None = None) -> DataFrame:
    """doc_id, session, para_index with the characters that a session inserted, deleted, moved in and out, by category and in all.

    highlights: doc_id, rev_id, category, of the insertions that count as bulk; without it, those of one author and time with
    ``bulk_chars`` together do.
    """
    group = W.partitionBy("doc_id", "session", F.coalesce("author", F.lit("")), "ts")
    ins, edit = F.col("type") == "ins", ~F.col("move")
    fresh = ins & edit & ~F.col("relocated")
    if highlights is None:
        rows = touches.withColumn("__big", F.sum(F.when(fresh, F.col("chars")).otherwise(0)).over(group) >= bulk_chars)
        rows = rows.withColumns({"__bulk": F.col("__big"), "__category": F.lit("bulk")})
    else:
        h = highlights.select("doc_id", "rev_id", F.col("category").alias("__category"))
        rows = touches.join(h, ["doc_id", "rev_id"], "left").withColumn("__bulk", F.col("__category").isNotNull())
        rows = rows.withColumn("__big", F.coalesce(F.bool_or(fresh & F.col("__bulk")).over(group), F.lit(False)))
    deleted = F.sum(F.when(~ins & edit, F.col("chars")).otherwise(0)).over(W.partitionBy("doc_id", "session", "rev_id"))
    rows = rows.withColumn("__deleted", deleted)
    is_bulk = fresh & F.col("__bulk")
    fine = (fresh & ~F.col("__bulk")) | (~ins & edit & ~F.col("relocated") & ~F.col("__big") & (F.col("__deleted") < bulk_chars))
    chars = lambda cond: F.sum(F.when(cond, F.col("chars")).otherwise(0)).cast("long")
    keys = ["doc_id", "session", "para_index"]
    out = rows.groupBy(*keys).agg(
        chars(ins & edit).alias("ins_chars"), chars(~ins & edit).alias("del_chars"), chars(is_bulk).alias("bulk_chars"),
        chars(ins & (F.col("move") | F.col("relocated"))).alias("moved_in"), chars(~ins & (F.col("move") | F.col("relocated"))).alias("moved_out"),
        chars(fine).alias("fine_chars"), F.count_distinct(F.when(fine, F.concat_ws(":", "type", "rev_id"))).alias("fine_changes"),
    )
    high = rows.where(is_bulk).groupBy(*keys, "__category").agg(F.sum("chars").cast("long").alias("n"))
    high = high.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__category", "n")))).alias("highlight_chars"))
    out = out.where("ins_chars > 0 or del_chars > 0 or moved_in > 0 or moved_out > 0").join(high, keys, "left")
    return out.withColumn("highlight_chars", F.coalesce("highlight_chars", F.create_map().cast("map<string,bigint>")))


def shares(sums: DataFrame, ends: DataFrame) -> DataFrame:
    """``heat_sums`` with green, orange and moved shares. ends: doc_id, session, para_index, chars (visible at the session's end)."""
    keys = ["doc_id", "session", "para_index"]
    out = sums.join(ends.select(*keys, F.col("chars").alias("__visible")), keys, "left")
    there = F.coalesce("__visible", F.lit(0))
    share = lambda x: F.when(there > 0, F.least(F.lit(1.0), F.col(x) / there)).otherwise(0.0)
    green = F.when(F.col("fine_chars") > 0, F.least(F.lit(1.0), F.greatest(F.col("fine_chars") / F.greatest(there, F.lit(HEAT_CHARS)), F.col("fine_changes") / HEAT_CHANGES))).otherwise(0.0)
    return out.withColumns({"green": green, "orange": share("bulk_chars"), "moved": share("moved_in")}).drop("__visible")


def heat(touches: DataFrame, ends: DataFrame, bulk_chars: int = BULK_CHARS, highlights: DataFrame | None = None) -> DataFrame:
    """The ``shares`` of the ``heat_sums``."""
    return shares(heat_sums(touches, bulk_chars, highlights), ends)


def session_totals(heat_rows: DataFrame) -> DataFrame:
    """doc_id, session: inserted, deleted, bulk and moved characters, and highlight_chars, those of each category."""
    keys = ["doc_id", "session"]
    sums = heat_rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("ins_chars", "del_chars", "bulk_chars", "moved_in")])
    each = heat_rows.select(*keys, F.explode("highlight_chars").alias("category", "chars")).groupBy(*keys, "category").agg(F.sum("chars").alias("chars"))
    maps = each.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "chars")))).alias("highlight_chars"))
    return sums.join(maps, keys, "left").withColumn("highlight_chars", F.coalesce("highlight_chars", F.create_map().cast("map<string,bigint>")))


def unit_key(table_id: Column, para_index: Column) -> Column:
    """A table's paragraphs are one unit, other paragraphs one each."""
    return F.when(table_id.isNotNull(), F.concat(F.lit("t"), table_id.cast("string"))).otherwise(F.concat(F.lit("p"), para_index.cast("string")))


def units(paragraphs: DataFrame, starts: DataFrame, ends: DataFrame, heat_rows: DataFrame) -> DataFrame:
    """The change of each unit from a session's start to its end: unchanged, fine, bulk, moved, added, deleted, movedTo or movedFrom.

    starts, ends: doc_id, session, para_index, chars of the paragraphs that are there.
    """
    keys = ["doc_id", "session", "para_index"]
    both = starts.select(*keys, F.lit(True).alias("s")).join(ends.select(*keys, F.col("chars").alias("e")), keys, "full")
    both = both.join(paragraphs.select("doc_id", "para_index", "table_id"), ["doc_id", "para_index"]).join(heat_rows.drop("moved"), keys, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = both.groupBy("doc_id", "session", unit_key(F.col("table_id"), F.col("para_index")).alias("unit")).agg(
        F.sort_array(F.collect_list("para_index")).alias("paras"), F.bool_or(F.col("s").isNotNull()).alias("in_start"), F.bool_or(F.col("e").isNotNull()).alias("in_end"),
        F.sum(z("e")).alias("visible"), F.sum(z("bulk_chars")).alias("bulk"), F.sum(z("moved_in")).alias("moved_in"), F.sum(z("moved_out")).alias("moved_out"), F.sum(z("del_chars")).alias("deleted"),
        F.greatest(F.lit(0), F.sum(z("ins_chars") - z("bulk_chars") - z("moved_in") + z("del_chars") - z("moved_out"))).alias("fine"),
        F.greatest(F.lit(0.0), F.max(F.greatest("green", "orange"))).alias("heat"),
        F.flatten(F.collect_list(F.map_entries("highlight_chars"))).alias("high"),
    )
    by_bulk = (F.col("bulk") > 0) & (F.col("bulk") >= F.col("fine"))
    gone = F.when((F.col("moved_out") > 0) & (F.col("moved_out") * 2 >= F.greatest("deleted", "moved_out")), "movedFrom").otherwise("deleted")
    came = F.when((F.col("moved_in") > 0) & (F.col("moved_in") * 2 >= F.col("visible")), "movedTo").otherwise("added")
    still = F.when((F.col("moved_in") > 0) | (F.col("moved_out") > 0), "moved").otherwise("unchanged")
    change = F.when(F.col("in_start") & ~F.col("in_end"), gone).when(~F.col("in_start") & F.col("in_end"), came)
    change = change.when((F.col("fine") == 0) & (F.col("bulk") == 0), still).when(by_bulk, "bulk").otherwise("fine")
    rows = rows.withColumn("change", change).withColumn("added_by_bulk", (F.col("change") == "added") & by_bulk)
    names = F.array_distinct(F.transform("high", lambda e: e["key"]))
    sums = F.transform(names, lambda k: F.struct(F.aggregate(F.filter("high", lambda e: e["key"] == k), F.lit(0).cast("long"), lambda a, e: a + e["value"]).alias("n"), k.alias("k")))
    top = F.aggregate(sums, F.struct(F.lit(-1).cast("long").alias("n"), F.lit("").alias("k")), lambda a, e: F.when(e["n"] > a["n"], e).otherwise(a))
    rows = rows.withColumn("category", F.when(((F.col("change") == "bulk") | F.col("added_by_bulk")) & (F.size("high") > 0), top["k"]))
    intensity = F.when(F.col("change") == "bulk", F.least(F.lit(1.0), F.col("bulk") / F.greatest("visible", F.lit(1)))).when(F.col("change") == "fine", F.col("heat")).otherwise(1.0)
    return rows.withColumn("intensity", intensity).drop("high", "heat")


def links(touches: DataFrame, moved: DataFrame, times: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """doc_id, session, from_unit, to_unit, kind (move or relocate), chars: where text went within a session."""
    moves = touches.where("move").withColumn("name", F.coalesce("move_name", "rev_id"))
    came = moves.where("type = 'ins'").groupBy("doc_id", "session", "name").agg(F.collect_set("para_index").alias("to"), F.sum("chars").alias("chars"))
    left = moves.where("type = 'del'").groupBy("doc_id", "session", "name").agg(F.collect_set("para_index").alias("from"))
    by_name = came.join(left, ["doc_id", "session", "name"]).select("doc_id", "session", "from", "to", F.lit("move").alias("kind"), "chars", F.lit(0).alias("__order"))
    here = moved.join(times.select("doc_id", "ts", "session"), ["doc_id", "ts"]).withColumn("id", containment.text_id(F.col("text")))
    keys = ["doc_id", "session"]
    a, d = here.where("type = 'ins'"), here.where("type = 'del'")
    # each two texts of which one holds the other, whatever the number of their pieces
    pairs = containment.containing(a, d, keys).unionByName(containment.containing(d, a, keys).select(*keys, F.col("other_id").alias("id"), F.col("id").alias("other_id"))).distinct()
    came = a.groupBy(*keys, "id", F.col("para_index").alias("t")).agg(F.sum(F.length("text")).alias("chars"))
    left = d.select(*keys, F.col("id").alias("other_id"), F.col("para_index").alias("f"))
    same = pairs.join(left, [*keys, "other_id"]).select(*keys, "id", "f").distinct().join(came, [*keys, "id"])
    by_name = by_name.withColumn("f", F.explode("from")).withColumn("t", F.explode("to")).drop("from", "to")
    rows = by_name.unionByName(same.select(*keys, "f", "t", F.lit("relocate").alias("kind"), "chars", F.lit(1).alias("__order")))
    unit = lambda name: paragraphs.select("doc_id", F.col("para_index").alias(name), unit_key(F.col("table_id"), F.col("para_index")).alias(f"{name}_unit"))
    rows = rows.join(unit("f"), ["doc_id", "f"]).join(unit("t"), ["doc_id", "t"])
    return rows.groupBy("doc_id", "session", F.col("f_unit").alias("from_unit"), F.col("t_unit").alias("to_unit")).agg(F.min_by("kind", "__order").alias("kind"), F.sum("chars").cast("long").alias("chars"))


class Flow:
    """sessions, heat, totals, units and links of documents. What several of them need is made once, when the first is asked for."""

    def __init__(self, segments: DataFrame, paragraphs: DataFrame, hours: float, bulk_chars: int, highlights: DataFrame | None, start: Column | None, end: Column | None) -> None:
        self.segments, self.paragraphs, self.bulk_chars, self.highlights = segments, paragraphs, bulk_chars, highlights
        self.dated = session_times(revisions(segments, paragraphs), hours, start, end)
        self.sessions = flow_sessions(self.dated)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, self[name]) for name in ("sessions", "heat", "totals", "units", "links")]

    @functools.cached_property
    def moved(self) -> DataFrame:
        return stored(relocations(self.segments), "relocations")

    @functools.cached_property
    def touches(self) -> DataFrame:
        return stored(touches_of(self.segments, self.dated, self.moved), "touches")

    @functools.cached_property
    def states(self) -> DataFrame:
        """doc_id, session, para_index, s and e: the characters that a paragraph has where it is there at the session's start and end."""
        times = self.sessions.select("doc_id", "session", F.explode(F.array(F.struct(F.lit("s").alias("which"), (millis(F.col("start")) - 1).alias("at_ms")), F.struct(F.lit("e").alias("which"), millis(F.col("end")).alias("at_ms")))).alias("t")).select("doc_id", "session", "t.*")
        there = visible_chars(self.segments, self.paragraphs, times.select("doc_id", "at_ms").distinct()).join(times, ["doc_id", "at_ms"])
        at = lambda which: F.max(F.when(F.col("which") == which, F.col("chars"))).alias(which)
        return stored(there.groupBy("doc_id", "session", "para_index").agg(at("s"), at("e")), "states")

    def state(self, which: str) -> DataFrame:
        return self.states.where(F.col(which).isNotNull()).select("doc_id", "session", "para_index", F.col(which).alias("chars"))

    @functools.cached_property
    def sums(self) -> DataFrame:
        return stored(heat_sums(self.touches, self.bulk_chars, self.highlights), "sums")

    @functools.cached_property
    def heat(self) -> DataFrame:
        """What is visible is asked for the paragraphs that a session touched, unless all are known already."""
        if "states" in self.__dict__:
            return stored(shares(self.sums, self.state("e")), "heat")
        touched = self.sums.select("doc_id", "session", "para_index").join(self.sessions.select("doc_id", "session", millis(F.col("end")).alias("at_ms")), ["doc_id", "session"])
        touched = stored(touched, "touched")
        there = visible_chars(self.segments, self.paragraphs, touched.select("doc_id", "para_index", "at_ms"))
        return stored(shares(self.sums, there.join(touched, ["doc_id", "para_index", "at_ms"])), "heat")

    @functools.cached_property
    def totals(self) -> DataFrame:
        return session_totals(self.sums)

    @functools.cached_property
    def units(self) -> DataFrame:
        starts, ends = self.state("s"), self.state("e")
        return units(self.paragraphs, starts, ends, self.heat)

    @functools.cached_property
    def links(self) -> DataFrame:
        return links(self.touches, self.moved, self.dated, self.paragraphs)


def build(segments: DataFrame, paragraphs: DataFrame, *, hours: float = 1.0, bulk_chars: int = BULK_CHARS, highlights: DataFrame | None = None, start: Column | None = None, end: Column | None = None) -> Flow:
    """sessions, heat, totals, units and links of the documents, by attribute or by name."""
    return Flow(segments, paragraphs, hours, bulk_chars, highlights, start, end)


def paint(heat_rows: DataFrame, categories: DataFrame, bulk_chars_column: str = "bulk_chars") -> DataFrame:
    """doc_id, session, para_index, rank, category, value: what a paragraph is painted with, the first two of the shares from 0.05 on."""
    base = F.array(F.struct(F.lit("fine").alias("category"), F.col("green").alias("value")), F.struct(F.lit("moved").alias("category"), F.col("moved").alias("value")))
    high = F.transform(F.map_entries("highlight_chars"), lambda e: F.struct(e["key"].alias("category"), (F.col("orange") * e["value"] / F.col(bulk_chars_column)).alias("value")))
    rows = heat_rows.select("doc_id", "session", "para_index", F.inline(F.concat(base, high))).where("value >= 0.05")
    rows = rows.join(F.broadcast(categories.select("category", "priority")), "category", "left")
    rank = F.row_number().over(W.partitionBy("doc_id", "session", "para_index").orderBy(F.coalesce("priority", F.lit(0)).desc(), F.col("value").desc(), "category"))
    return rows.withColumn("rank", rank).where("rank <= 2").select("doc_id", "session", "para_index", "rank", "category", "value")
