"""Word-processor files as rows of XML elements, for what Spark works out by joins and windows.

A task unzips a file and reads its parts as streams; it holds the open elements and a batch of rows.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Collection, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.functions.columns import u16_length

#: Parts whose elements become rows.
PARTS = re.compile(r"word/(document|styles|numbering|settings|footnotes|endnotes|comments\w*|header\d*|footer\d*)\.xml")
#: Elements for which each row says which of them is around it (or is it itself).
AROUND = ("tbl", "tr", "tc", "p", "r", "ins", "del", "style", "abstractNum", "num", "lvl", "docDefaults")
#: Elements whose own pPr and rPr are told with them.
OWNERS = ("p", "style", "lvl")
NODES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.StringType()), T.StructField("node", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())), *(T.StructField(f"in_{t}", T.LongType()) for t in AROUND),
])
#: What ``revisions`` and ``final_lengths`` look at.
CHANGES = ("ins", "del", "t", "delText", "tab", "br", "cr")
ROWS, ERROR = 2000, "#error"


def local(name: str) -> str:
    return name.rpartition(":")[2]


def _shown(attributes: dict) -> str | None:
    """A property's value: its val, or all attributes as JSON, or ``true`` where there are none."""
    for k, v in attributes.items():
        if local(k) == "val":
            return v
    text = ",".join(f"{json.dumps(local(k), ensure_ascii=False)}:{json.dumps(v, ensure_ascii=False)}" for k, v in attributes.items())
    return "{" + text + "}" if text else "true"


def elements(part: io.BufferedIOBase, tags: Collection[str] | None = None) -> Iterator[tuple]:
    """(node, parent, depth, tag, attributes, text, properties, what is around) of the elements of one part, when they end; numbers in
    the order in which they begin. With ``tags``, those alone are given; the numbers stay."""
    parser, out = expat.ParserCreate(), []
    # number, tag, what is around, attributes, text, properties; the last three of those that are given
    stack: list[tuple] = []
    count = 0
    names: dict[str, tuple] = {}

    def start(name: str, attributes: dict) -> None:
        nonlocal count
        if (known := names.get(name)) is None:
            tag = local(name)
            known = names[name] = (tag, AROUND.index(tag) if tag in AROUND else None, tags is None or tag in tags, tag in OWNERS)
        tag, at, given, owns = known
        around = stack[-1][2] if stack else (None,) * len(AROUND)
        if at is not None:
            around = (*around[:at], count, *around[at + 1 :])
        if len(stack) > 1:
            group, owner = stack[-1], stack[-2]
            if owner[5] is not None and group[1] in ("pPr", "rPr"):
                if tag != "numPr" or group[1] != "pPr":
                    owner[5].setdefault(f"{group[1]}/{tag}", _shown(attributes))
            # the numbering of a paragraph is one level further down
            elif tag in ("numId", "ilvl") and group[1] == "numPr" and owner[1] == "pPr" and len(stack) > 2 and stack[-3][5] is not None:
                stack[-3][5].setdefault(f"pPr/{tag}", next((v for k, v in attributes.items() if local(k) == "val"), None))
        stack.append((count, tag, around, attributes if given else None, [] if given else None, {} if owns and given else None))
        count += 1

    def end(_: str) -> None:
        node, tag, around, attributes, text, properties = stack.pop()
        if attributes is not None:
            parent = stack[-1][0] if stack else None
            out.append((node, parent, len(stack), tag, [(local(k), v) for k, v in attributes.items()], "".join(text) or None, None if properties is None else list(properties.items()), *around))

    def data(text: str) -> None:
        if stack and stack[-1][4] is not None:
            stack[-1][4].append(text)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    while chunk := part.read(1 << 18):
        parser.Parse(chunk)
        yield from out
        out.clear()
    parser.Parse(b"", True)
    yield from out


def nodes(files: DataFrame, wanted: dict[str, Collection[str] | None] | None = None) -> DataFrame:
    """A row for each element of the files (doc_id, content): its part, number in the part, parent, depth, tag and attributes without
    prefixes, text of its own, properties (of OWNERS: what its own pPr and rPr hold), and the numbers of the elements of AROUND that
    it is in. Of a part that breaks off, what came before, and a row with the tag ERROR and the reason as text; of a file that can't be
    read, that row alone, without a part. ``wanted`` names the parts to read, and for each the tags that become rows (None: all)."""
    arrow = to_arrow_schema(NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for k in range(batch.num_rows):
                doc = batch.column(0)[k].as_py()
                try:
                    package = zipfile.ZipFile(io.BytesIO(batch.column(1)[k].as_py() or b""))
                    names = [n for n in package.namelist() if (PARTS.fullmatch(n) if wanted is None else n in wanted)]
                except zipfile.BadZipFile as e:
                    rows.append(_failed(doc, None, e))
                    continue
                for name in names:
                    try:
                        with package.open(name) as part:
                            for row in elements(part, wanted and wanted[name]):
                                rows.append((doc, name, *row))
                                if len(rows) >= ROWS:
                                    yield _batch(rows, arrow)
                                    rows.clear()
                    except (expat.ExpatError, zipfile.BadZipFile) as e:
                        rows.append(_failed(doc, name, e))
        if rows:
            yield _batch(rows, arrow)

    return files.select("doc_id", "content").mapInArrow(run, NODES)


def _failed(doc: int, part: str | None, e: Exception) -> tuple:
    return (doc, part, None, None, None, ERROR, None, f"{type(e).__name__}: {e}", None, *(None,) * len(AROUND))


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def moment(text: Column) -> Column:
    """A date as files have it, or null if it can't be read; without a zone it is UTC."""
    plain = F.trim(text)
    return F.when(plain.rlike(r"(?:[zZ]|[+-]\d\d:?\d\d)$"), plain).otherwise(F.concat(plain, F.lit("Z"))).try_cast("timestamp")


def _characters(rows: DataFrame) -> DataFrame:
    """Text, tabs and breaks with what each is as text."""
    value = F.when(F.col("tag").isin("t", "delText"), F.coalesce("text", F.lit(""))).when(F.col("tag") == "tab", "\t").otherwise("\n")
    return rows.where(F.col("tag").isin("t", "delText", "tab", "br", "cr")).withColumn("said", value)


def revisions(rows: DataFrame, parts: list[str]) -> DataFrame:
    """doc_id, part, node, type, rev_id, author, ts, text, dated of the insertions and deletions of the parts, undated ones too.

    A change's text is that of the characters it is nearest to, of its kind: in a deletion within an insertion it is both's.
    """
    rows = rows.where(F.col("part").isin(parts))
    said = _characters(rows).select("doc_id", "part", "node", "said", F.explode(F.array_compact(F.array("in_ins", "in_del"))).alias("change"))
    texts = said.groupBy("doc_id", "part", "change").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "said"))), lambda x: x["said"]), "").alias("text"))
    at = F.col("attributes")["date"]
    changes = rows.where("tag in ('ins', 'del')").select("doc_id", "part", F.col("node").alias("change"), F.col("tag").alias("type"), F.col("attributes")["id"].alias("rev_id"), F.col("attributes")["author"].alias("author"), moment(at).alias("ts"), (F.coalesce(at, F.lit("")) != "").alias("dated"))
    return changes.join(texts, ["doc_id", "part", "change"], "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumnRenamed("change", "node")


def final_lengths(rows: DataFrame, parts: list[str]) -> DataFrame:
    """doc_id, final_chars: UTF-16 units of what isn't deleted; what a move took away counts, as files keep it."""
    left = _characters(rows.where(F.col("part").isin(parts) & F.col("in_del").isNull() & (F.col("tag") != "delText")))
    return left.groupBy("doc_id").agg(F.sum(u16_length(F.col("said"))).cast("int").alias("final_chars"))


def settings(rows: DataFrame) -> DataFrame:
    """doc_id, track_revisions, remove_personal_information, remove_date_and_time, document_id of the documents with settings."""
    rows = rows.where("part = 'word/settings.xml'")
    val = F.col("attributes")["val"]
    on = lambda tag: F.coalesce(F.min_by(F.when(F.col("tag") == tag, ~F.lower(F.coalesce(val, F.lit("true"))).isin("false", "0", "off")), F.when((F.col("tag") == tag) & (F.col("depth") == 1), F.col("node"))), F.lit(False))
    own = F.min_by(F.upper(F.regexp_extract(val, r"^\{?([0-9A-Fa-f-]+)\}?$", 1)), F.when((F.col("tag") == "docId") & val.rlike(r"^\{?[0-9A-Fa-f-]+\}?$"), F.col("node")))
    return rows.groupBy("doc_id").agg(on("trackRevisions").alias("track_revisions"), on("removePersonalInformation").alias("remove_personal_information"), on("removeDateAndTime").alias("remove_date_and_time"), own.alias("document_id"))
