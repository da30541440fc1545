"""Plain tables as the tables that the operators read: edit events, conversations as documents, files made of conversations."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Users that write one document together.
AUTHORS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revisions(events: DataFrame) -> DataFrame:
    """Events of users as changes of documents: errors are deletions, others insertions; the value is the number of characters."""
    return events.select(
        F.floor(F.col("user_id") / AUTHORS).cast("long").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("rev_id"), F.col("user_id").cast("string").alias("author"),
        F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "del").otherwise("ins").alias("type"), F.ceil("value").cast("long").alias("chars"),
    )


def by_day(changes: DataFrame) -> DataFrame:
    """``changes`` with times cut to the day, as a tool that keeps days would have them."""
    return changes.withColumn("ts", F.date_trunc("day", "ts"))


def placed(changes: DataFrame) -> DataFrame:
    """``changes`` with places in a final document, a paragraph for each seventh number, and no text."""
    start = (F.col("seq") * 37 % 5000).cast("int")
    return changes.withColumns({"start_offset": start, "end_offset": (start + F.when(F.col("type") == "ins", F.col("chars")).otherwise(0)).cast("int"), "start_para": (start / 250).cast("int"), "end_para": (start / 250).cast("int"), "paras": F.array((start / 250).cast("int")), "move": F.lit(False), "text": F.lit("")})


def segments(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and paragraphs: each insertion is a segment of its own text; each deletion one too, that was there from the start.

    Every fifth number is a move; paragraphs go by the number, of each ten the last four are a table.
    """
    para = (F.col("seq") % 40).cast("int")
    change = F.struct(F.col("rev_id").alias("id"), "ts", "author", (F.col("seq") % 5 == 0).alias("move"), F.when(F.col("seq") % 5 == 0, F.concat(F.lit("m"), F.col("seq") % 50)).alias("move_name"))
    none = F.lit(None).cast("struct<id:string,ts:timestamp,author:string,move:boolean,move_name:string>")
    ins = F.col("type") == "ins"
    segs = changes.select("doc_id", para.alias("para_index"), F.col("seq").alias("seg_index"), F.lit("text").alias("kind"), F.rpad(F.md5("rev_id"), F.col("chars").cast("int"), F.md5("rev_id")).alias("text"), F.when(ins, change).otherwise(none).alias("ins"), F.when(~ins, change).otherwise(none).alias("del"))
    paras = segs.select("doc_id", "para_index").distinct().select("doc_id", "para_index", F.when(F.col("para_index") % 10 >= 6, F.floor(F.col("para_index") / 10).cast("int")).alias("table_id"), none.alias("mark_ins"), none.alias("mark_del"))
    return segs, paras


def repeated_text(seq: Column) -> Column:
    """One of 97 texts of 20 to 116 characters, so that what is deleted here is inserted there."""
    return F.rpad(F.md5((seq % 97).cast("string")), (20 + seq % 97).cast("int"), F.md5((seq % 97).cast("string")))


def conversation_paragraphs(conversations: DataFrame) -> DataFrame:
    """Turns as paragraphs: doc_id, para_index, text, heading (the first line of what users ask)."""
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("para_index"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("role") == "user", F.regexp_extract("text", r"^([^\n]*)", 1)).alias("heading"))


def conversation_segments(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as segments: what assistants say was inserted a minute a turn after the first of January 2024, and half of it deleted an hour later."""
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("turn") * 60)
    kind = "struct<id:string,ts:timestamp,author:string,move:boolean,move_name:string>"
    change = lambda what, ts: F.struct(F.concat(F.lit(what), F.col("turn")).alias("id"), ts.alias("ts"), F.col("role").alias("author"), F.lit(False).alias("move"), F.lit(None).cast("string").alias("move_name"))
    said = F.col("role") == "assistant"
    later = F.timestamp_seconds(F.unix_seconds(at) + 3600)
    rows = conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("para_index"), F.lit(0).alias("seg_index"), F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.when(said, change("i", at)).otherwise(F.lit(None).cast(kind)).alias("ins"), F.when(said & (F.col("turn") % 4 == 1), change("d", later)).otherwise(F.lit(None).cast(kind)).alias("del"))
    paras = rows.select("doc_id", "para_index", F.lit(None).cast("int").alias("table_id"), F.lit(None).cast(kind).alias("mark_ins"), F.lit(None).cast(kind).alias("mark_del"))
    return rows, paras


def spread(spark: SparkSession) -> int:
    """Tasks for rows of which each makes much more than it takes, which their bytes don't tell."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (turn, role, text) in order, over as many tasks as ``spread`` says: small tables would else be put in one."""
    rows = conversations.repartition(spread(conversations.sparkSession), "conv_id")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one as Python objects at a time."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def made_file(turns: list[tuple]) -> bytes:
    """A file of the turns (turn, role, text): those of assistants are insertions, each third one deleted again."""
    body = []
    for turn, role, text in turns:
        stamp = f'w:author={quoteattr(role or "")} w:date="2024-01-01T{turn // 60 % 24:02d}:{turn % 60:02d}:00Z"'
        tag = "delText" if role == "assistant" and turn % 3 == 0 else "t"
        run = f'<w:r><w:{tag} xml:space="preserve">{escape(text or "")}</w:{tag}></w:r>'
        if tag == "delText":
            run = f'<w:del w:id="d{turn}" {stamp}>{run}</w:del>'
        if role == "assistant":
            run = f'<w:ins w:id="i{turn}" {stamp}>{run}</w:ins>'
        body.append(f"<w:p>{run}</w:p>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("word/settings.xml", f"<w:settings {NS}><w:trackRevisions/></w:settings>")
    return out.getvalue()


def conversation_files(conversations: DataFrame) -> DataFrame:
    """doc_id, path, content: a word-processor file for each conversation."""
    turns = _turns(conversations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _each(batch):
                content = made_file([(t["turn"], t["role"], t["text"]) for t in r["turns"]])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r["conv_id"]], pa.int64()), "path": [f"{r['conv_id']}.docx"], "content": pa.array([content], pa.binary())})

    return turns.mapInArrow(run, "doc_id long, path string, content binary")


def structured_file(conv: int, turns: list[tuple]) -> bytes:
    """A file with styles, lists and tables that follow from the turns (turn, role, text): each word of the texts is a paragraph.

    Styles s0, s1, ... are based on the one before, s0 on the last (a cycle) in each fourth file. A word's style and list go by
    its place, its list level by its length; each turn ends with a table.
    """
    val = lambda tag, value: f'<w:{tag} w:val="{value}"/>'
    count = 3 + conv % 15
    styles = []
    for k in range(count):
        up = val("basedOn", f"s{k - 1}") if k else val("basedOn", f"s{count - 1}") if conv % 4 == 0 else ""
        para = (val("jc", f"j{k}") if k % 5 == 1 else "") + (val("outlineLvl", k % 11) if k % 7 == 2 else "")
        styles.append(f'<w:style w:type="paragraph" w:styleId="s{k}">{val("name", f"heading {k % 9 + 1}" if k % 6 == 5 else f"n{k}")}{up}<w:pPr>{para}</w:pPr><w:rPr>{val("sz", 20 + k) if k % 3 == 0 else ""}{"<w:b/>" if k == 1 else ""}</w:rPr></w:style>')
    level = lambda k, kind, text, start: f'<w:lvl w:ilvl="{k}">{val("start", start)}{val("numFmt", kind)}{val("lvlText", text)}</w:lvl>'
    numbers = "".join(level(k, "decimal", ".".join(f"%{j + 1}" for j in range(k + 1)), 1 + k % 2) for k in range(4))
    letters = "".join(level(k, "lowerLetter", f"(%{k + 1})", 1) for k in range(4))
    lists = f'<w:abstractNum w:abstractNumId="7">{numbers}</w:abstractNum><w:abstractNum w:abstractNumId="8">{letters}</w:abstractNum><w:num w:numId="1">{val("abstractNumId", 7)}</w:num><w:num w:numId="2">{val("abstractNumId", 8)}<w:lvlOverride w:ilvl="0">{val("startOverride", 5)}</w:lvlOverride></w:num>'
    body, place = [], 0
    for turn, _, text in turns:
        for word in (text or "").split(" "):
            style, num = f"s{place % (count + 1)}", 1 + (place % 3 == 0)
            body.append(f'<w:p><w:pPr>{val("pStyle", style)}<w:numPr>{val("ilvl", len(word) % 4)}{val("numId", num)}</w:numPr></w:pPr><w:r><w:t xml:space="preserve">{escape(word)}</w:t></w:r></w:p>')
            place += 1
        rows = []
        for r in range(2 + turn % 4):
            made = [f'<w:tc><w:tcPr>{val("gridSpan", 1 + (r * 2 + c + turn) % 3) if (r + c) % 2 else ""}{("<w:vMerge/>" if (r + turn) % 3 else val("vMerge", "restart")) if c % 2 == 0 else ""}</w:tcPr></w:tc>' for c in range(1 + (r + conv) % 4)]
            rows.append(f'<w:tr>{"<w:trPr>" + val("gridBefore", 1) + "</w:trPr>" if r % 3 == 2 else ""}{"".join(made)}</w:tr>')
        body.append(f"<w:tbl>{''.join(rows)}</w:tbl>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {NS}>{''.join(styles)}</w:styles>")
        z.writestr("word/numbering.xml", f"<w:numbering {NS}>{lists}</w:numbering>")
    return out.getvalue()


def structured_files(conversations: DataFrame) -> DataFrame:
    """doc_id, content: a file with styles, lists and tables for each conversation."""
    turns = _turns(conversations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _each(batch):
                content = structured_file(r["conv_id"], [(t["turn"], t["role"], t["text"]) for t in r["turns"]])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r["conv_id"]], pa.int64()), "content": pa.array([content], pa.binary())})

    return turns.mapInArrow(run, "doc_id long, content binary")
