"""What a document's styles, lists and tables come to, from the rows of its elements (``sources.nodes``).

Properties are maps from ``pPr/jc`` or ``rPr/sz`` to a value: ``val``, or all attributes as JSON, or ``true`` where there are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.sources.scratch import stored

BODY, STYLES, NUMBERING = "word/document.xml", "word/styles.xml", "word/numbering.xml"
#: What ``nodes.nodes`` has to give for styles alone, for paragraphs and their lists, and for tables: parts, and their tags.
FOR_STYLES: dict = {STYLES: None}
FOR_PARAGRAPHS: dict = {BODY: ("p",), STYLES: None, NUMBERING: None}
FOR_CELLS: dict = {BODY: ("tr", "tc", "gridBefore", "gridSpan", "vMerge")}
#: Styles of a chain that count, from the style itself on; of those that a heading level is looked for in; list levels.
CHAIN, HEADING_CHAIN, LEVELS = 12, 10, 9


def _val(attributes: str = "attributes", key: str = "val") -> Column:
    return F.col(attributes)[key]


def _value() -> Column:
    return F.coalesce(_val(), F.when(F.size("attributes") > 0, F.to_json("attributes")).otherwise("true"))


def _properties(nodes: DataFrame, owner: str) -> DataFrame:
    """doc_id, owner, properties: of the elements below the pPr and rPr that belong to each ``owner`` directly; of equal names the first."""
    return nodes.where((F.col("tag") == owner) & (F.size("properties") > 0)).select("doc_id", F.col("node").alias("owner"), "properties")


def styles(nodes: DataFrame) -> DataFrame:
    """doc_id, style, type, is_default, based_on, own (properties), level (0 to 8, of its outline level or its name) of each style; of equal ids the last."""
    rows = nodes.where(F.col("part") == STYLES)
    head = rows.where("tag = 'style'").select("doc_id", F.col("node").alias("owner"), _val(key="styleId").alias("style"), _val(key="type").alias("type"), F.coalesce(_val(key="default").isin("1", "true"), F.lit(False)).alias("is_default"))
    child = lambda tag: F.min_by(F.when(F.col("tag") == tag, _val()), F.when(F.col("tag") == tag, F.col("node")))
    more = rows.where("tag in ('basedOn', 'name') and parent = in_style").groupBy("doc_id", F.col("parent").alias("owner")).agg(child("basedOn").alias("based_on"), child("name").alias("name"))
    found = head.where("style is not null").join(more, ["doc_id", "owner"], "left").join(_properties(rows, "style"), ["doc_id", "owner"], "left")
    own = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    outline = F.try_element_at(own, F.lit("pPr/outlineLvl")).try_cast("int")
    level = F.coalesce(F.when(outline.between(0, 8), outline), F.regexp_extract("name", r"(?i)^heading\s*(\d)$", 1).try_cast("int") - 1)
    found = found.select("doc_id", "style", "type", "is_default", "based_on", own.alias("own"), level.alias("level"), "owner")
    return found.withColumn("__n", F.row_number().over(W.partitionBy("doc_id", "style").orderBy(F.col("owner").desc()))).where("__n = 1").drop("__n")


def resolved_styles(style_rows: DataFrame) -> DataFrame:
    """doc_id, style, properties, heading_level (1 to 9): each style with what it takes from those that it is based on, the nearest first.

    Pointers are doubled: in each round a style takes over what the one it points to has gathered, and then points to where
    that one does, so that four joins reach 16 styles up; each property says how far up it comes from. From CHAIN styles on nothing
    counts (for the heading level, from HEADING_CHAIN). A cycle adds nothing: what is further round was met before.
    """
    far = lambda m, by: F.transform_values(m, lambda _, x: F.struct(x["value"].alias("value"), (x["far"] + by).alias("far")))
    with_level = F.map_concat("own", F.when(F.col("level").isNotNull(), F.create_map(F.lit("level"), F.col("level").cast("string"))).otherwise(F.create_map().cast("map<string,string>")))
    rows = style_rows.select("doc_id", "style", F.col("based_on").alias("up"), F.transform_values(with_level, lambda _, x: F.struct(x.alias("value"), F.lit(0).alias("far"))).alias("found"))
    hops = 1
    while hops < CHAIN:
        above = rows.select("doc_id", F.col("style").alias("up"), F.col("up").alias("__up"), F.col("found").alias("__found"))
        rows = rows.join(above, ["doc_id", "up"], "left")
        new = F.map_filter(F.coalesce("__found", F.create_map().cast(above.schema["__found"].dataType)), lambda k, _: ~F.map_contains_key(F.col("found"), k))
        rows = rows.select("doc_id", "style", F.col("__up").alias("up"), F.map_concat("found", far(new, hops)).alias("found"))
        hops *= 2
    level = F.try_element_at("found", F.lit("level"))
    kept = F.map_filter("found", lambda k, x: (k != "level") & (x["far"] < CHAIN))
    return rows.select("doc_id", "style", F.transform_values(kept, lambda _, x: x["value"]).alias("properties"), F.when(level["far"] < HEADING_CHAIN, level["value"].cast("int") + 1).alias("heading_level"))


def numbering(nodes: DataFrame) -> DataFrame:
    """doc_id, num, level, start, format, template, properties of each level of each list; a list's own start takes the place of its pattern's."""
    rows = nodes.where(F.col("part") == NUMBERING)
    value = lambda tag: F.min_by(F.when(F.col("tag") == tag, _val()), F.when(F.col("tag") == tag, F.col("node")))
    pattern = rows.where("tag = 'abstractNum'").select("doc_id", F.col("node").alias("in_abstractNum"), _val(key="abstractNumId").alias("pattern"))
    head = rows.where("tag = 'lvl' and in_abstractNum is not null").select("doc_id", "in_abstractNum", F.col("node").alias("owner"), _val(key="ilvl").cast("int").alias("level"))
    facts = rows.where("in_lvl is not null and parent = in_lvl").groupBy("doc_id", F.col("in_lvl").alias("owner")).agg(value("start").alias("start"), value("numFmt").alias("format"), value("lvlText").alias("template"))
    levels = head.join(pattern, ["doc_id", "in_abstractNum"]).join(facts, ["doc_id", "owner"], "left").join(_properties(rows, "lvl"), ["doc_id", "owner"], "left")
    lists = rows.where("tag = 'num'").select("doc_id", F.col("node").alias("in_num"), _val(key="numId").alias("num"))
    of = rows.where("tag = 'abstractNumId' and parent = in_num").select("doc_id", "in_num", _val().alias("pattern"))
    over = rows.where("tag = 'lvlOverride'").select("doc_id", "in_num", F.col("node").alias("parent"), _val(key="ilvl").cast("int").alias("level"))
    over = rows.where("tag = 'startOverride'").select("doc_id", "parent", _val().alias("own_start")).join(over, ["doc_id", "parent"]).select("doc_id", "in_num", "level", "own_start")
    found = lists.join(of, ["doc_id", "in_num"]).join(levels, ["doc_id", "pattern"]).join(over, ["doc_id", "in_num", "level"], "left")
    start = F.coalesce(F.col("own_start").try_cast("int"), F.col("start").try_cast("int"), F.lit(1))
    return found.select("doc_id", "num", "level", start.alias("start"), F.coalesce("format", F.lit("decimal")).alias("format"), F.coalesce("template", F.lit("")).alias("template"), F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"))


def _looks(nodes: DataFrame) -> DataFrame:
    """doc_id, para_index, node, style, own, base (the defaults' and the style's properties), style_level, num, level of the body's paragraphs."""
    none = F.create_map().cast("map<string,string>")
    merged = lambda low, high: F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)
    rows = nodes.where((F.col("part") == BODY) & (F.col("tag") == "p")).select("doc_id", "node", F.coalesce("properties", none).alias("own"))
    rows = rows.withColumn("para_index", F.row_number().over(W.partitionBy("doc_id").orderBy("node")) - 1)
    style_rows, defaults = stored(styles(nodes), "styles"), _defaults(nodes)
    default = style_rows.where("is_default and type = 'paragraph'").groupBy("doc_id").agg(F.min_by("style", "owner").alias("default_style"))
    chains = resolved_styles(style_rows).join(defaults, "doc_id", "left")
    base = merged(F.coalesce("defaults", none), F.col("properties"))
    # what a list needs comes as columns, so that the maps go along only for those who ask for them
    at = lambda name, of: F.try_element_at(of, F.lit(name))
    chains = chains.select("doc_id", "style", base.alias("__base"), F.col("heading_level").alias("style_level"), at("pPr/numId", base).alias("__num"), at("pPr/ilvl", base).alias("__level"), F.lit(True).alias("__known"))
    rows = rows.join(default.join(defaults, "doc_id", "full"), "doc_id", "left")
    own = lambda name: at(name, F.col("own"))
    rows = rows.select("doc_id", "para_index", "node", "own", "defaults", F.coalesce(own("pPr/pStyle"), "default_style").alias("style"), own("pPr/numId").alias("__own_num"), own("pPr/ilvl").alias("__own_level"), at("pPr/numId", F.col("defaults")).alias("__any_num"), at("pPr/ilvl", F.col("defaults")).alias("__any_level"))
    rows = rows.join(chains, ["doc_id", "style"], "left")
    pick = lambda name: F.coalesce(f"__own_{name}", F.when(F.col("__known"), F.col(f"__{name}")).otherwise(F.col(f"__any_{name}")))
    num = pick("num")
    return rows.select(
        "doc_id", "para_index", "node", "style", "own", F.coalesce("__base", "defaults", none).alias("base"), "style_level",
        F.when(num != "0", num).alias("num"), F.when(num != "0", F.coalesce(pick("level").try_cast("int"), F.lit(0))).alias("level"),
    )


def listed(nodes: DataFrame) -> DataFrame:
    """doc_id, para_index, num, level of the body's paragraphs: what ``labels`` needs of ``paragraphs``."""
    return _looks(nodes).select("doc_id", "para_index", "num", "level")


def paragraphs(nodes: DataFrame) -> DataFrame:
    """doc_id, para_index, node, style, properties, heading_level, num, level of the body's paragraphs, in document order.

    Properties are those of the document's defaults, then the style's (the default one's without a style), then the list level's,
    then the paragraph's own. A paragraph's own outline level beats its style's; beyond 8 it is none.
    """
    none = F.create_map().cast("map<string,string>")
    merged = lambda low, high: F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)
    of_list = numbering(nodes).where(F.size("properties") > 0).select("doc_id", "num", "level", F.col("properties").alias("of_list"))
    rows = _looks(nodes).join(of_list, ["doc_id", "num", "level"], "left")
    outline = F.try_element_at("own", F.lit("pPr/outlineLvl")).try_cast("int")
    level = F.when(outline.isNotNull(), F.when(outline.between(0, 8), outline + 1)).otherwise(F.col("style_level"))
    properties = merged(merged(F.col("base"), F.coalesce("of_list", none)), F.col("own"))
    return rows.select("doc_id", "para_index", "node", "style", properties.alias("properties"), level.alias("heading_level"), "num", "level")


def _defaults(nodes: DataFrame) -> DataFrame:
    """doc_id, defaults: the properties that a document gives to all of its paragraphs and runs."""
    rows = nodes.where((F.col("part") == STYLES) & F.col("in_docDefaults").isNotNull())
    groups = rows.where(F.col("tag").isin("pPr", "rPr")).select("doc_id", F.col("node").alias("parent"), F.col("tag").alias("group"))
    found = rows.join(groups, ["doc_id", "parent"]).select("doc_id", F.concat_ws("/", "group", "tag").alias("name"), _value().alias("value"), "node")
    found = found.groupBy("doc_id", "name").agg(F.min_by("value", "node").alias("value"))
    return found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("defaults"))


def roman(n: Column) -> Column:
    """Roman numerals up to 3999; beyond, figures."""
    digit = lambda unit, one, five, ten: F.element_at(F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (F.floor(n / unit) % 10 + 1).cast("int"))
    return F.when((n > 3999) | (n < 1), n.cast("string")).otherwise(F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(100, "C", "D", "M"), digit(10, "X", "L", "C"), digit(1, "I", "V", "X")))


def formatted(n: Column, kind: Column) -> Column:
    """A number as lists write it: figures, Roman numerals, or letters, which repeat after z (aa, bb)."""
    letters = F.when(n < 1, n.cast("string")).otherwise(F.repeat(F.chr(97 + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int")))
    padded = F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    return F.when(kind == "lowerLetter", letters).when(kind == "upperLetter", F.upper(letters)).when(kind == "upperRoman", roman(n)).when(kind == "lowerRoman", F.lower(roman(n))).when(kind == "decimalZero", padded).when(kind.isin("bullet", "none"), "").otherwise(n.cast("string"))


def labels(para_rows: DataFrame, levels: DataFrame) -> DataFrame:
    """doc_id, para_index, num, level, counters, label of the paragraphs in lists.

    A list counts on each level; a paragraph on a level above (a smaller one) sets it back. Level l's counter is how many of the
    list's paragraphs were on l since then: a running count, less what it was at the last paragraph above, so one sorted pass
    does all levels. Levels that were skipped stand at their start. A level that the list doesn't have gives no label.
    """
    rows = para_rows.where(F.col("num").isNotNull() & F.col("level").between(0, LEVELS - 1)).select("doc_id", "para_index", "num", "level")
    upto = W.partitionBy("doc_id", "num").orderBy("para_index").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"__s{k}": F.sum((F.col("level") == k).cast("int")).over(upto) for k in range(LEVELS)})
    rows = rows.withColumns({f"__b{k}": F.coalesce(F.last(F.when(F.col("level") < k, F.col(f"__s{k}")), ignorenulls=True).over(upto), F.lit(0)) for k in range(LEVELS)})
    of = levels.groupBy("doc_id", "num").agg(F.map_from_entries(F.collect_list(F.struct("level", F.struct("start", "format", "template")))).alias("__levels"))
    rows = rows.join(of, ["doc_id", "num"], "left")
    counts = F.array(*[F.greatest(F.lit(1), F.col(f"__s{k}") - F.col(f"__b{k}")) for k in range(LEVELS)])
    at = lambda k: F.try_element_at("__levels", k)
    counters = F.transform(F.slice(counts, F.lit(1), F.col("level") + 1), lambda n, k: n + F.coalesce(at(k)["start"], F.lit(1)) - 1)
    rows = rows.select("doc_id", "para_index", "num", "level", "__levels", counters.alias("counters"))
    parts = F.transform("counters", lambda n, k: formatted(n, F.coalesce(at(k)["format"], F.lit("decimal"))))
    label = at(F.col("level"))["template"]
    for k in range(LEVELS):
        label = F.replace(label, F.lit(f"%{k + 1}"), F.coalesce(F.get(parts, F.lit(k)), F.lit("")))
    return rows.select("doc_id", "para_index", "num", "level", "counters", label.alias("label"))


def cells(nodes: DataFrame) -> DataFrame:
    """doc_id, table, row, cell, col, col_span, row_span, first_row of each table cell; tables by the number of their element.

    A cell begins where those before it in its row end. Cells that go on with the one above are those of one column in rows that
    follow each other: an island, which begins where a cell doesn't go on, or has none above to go on with. row_span is the
    island's height, first_row where it begins.
    """
    body = nodes.where((F.col("part") == BODY) & F.col("in_tbl").isNotNull())
    order = lambda *keys: W.partitionBy("doc_id", *keys)
    rows = body.where("tag = 'tr'").select("doc_id", F.col("in_tbl").alias("table"), F.col("node").alias("in_tr")).withColumn("row", F.row_number().over(order("table").orderBy("in_tr")) - 1)
    shift = body.where("tag = 'gridBefore' and in_tr is not null and in_tc is null").groupBy("doc_id", "in_tr").agg(F.min_by(_val().try_cast("int"), "node").alias("before"))
    # properties of a cell are two levels below it; those of cells of tables in it have a cell of their own
    facts = body.where("tag in ('gridSpan', 'vMerge') and in_tc is not null").groupBy("doc_id", "in_tc").agg(F.min_by(F.when(F.col("tag") == "gridSpan", _val().try_cast("int")), F.when(F.col("tag") == "gridSpan", F.col("node"))).alias("span"), F.min_by(F.when(F.col("tag") == "vMerge", F.coalesce(_val(), F.lit("continue"))), F.when(F.col("tag") == "vMerge", F.col("node"))).alias("merge"))
    found = body.where("tag = 'tc'").select("doc_id", "in_tr", F.col("node").alias("in_tc")).join(rows, ["doc_id", "in_tr"]).join(shift, ["doc_id", "in_tr"], "left").join(facts, ["doc_id", "in_tc"], "left")
    span = F.greatest(F.lit(1), F.coalesce("span", F.lit(1)))
    in_row = order("table", "row").orderBy("in_tc")
    found = found.withColumns({"col_span": span, "cell": F.row_number().over(in_row) - 1, "goes_on": F.col("merge").isNotNull() & (F.col("merge") != "restart")})
    found = found.withColumn("col", (F.coalesce("before", F.lit(0)) + F.sum("col_span").over(in_row.rowsBetween(W.unboundedPreceding, 0)) - F.col("col_span")).cast("int"))
    down = order("table", "col").orderBy("row")
    starts = ~F.col("goes_on") | F.coalesce(F.lag("row").over(down) != F.col("row") - 1, F.lit(True))
    found = found.withColumn("island", F.sum(starts.cast("int")).over(down.rowsBetween(W.unboundedPreceding, 0)))
    island = order("table", "col", "island")
    return found.select("doc_id", "table", "row", "cell", "col", "col_span", F.count(F.lit(1)).over(island).cast("int").alias("row_span"), F.min("row").over(island).alias("first_row"))
