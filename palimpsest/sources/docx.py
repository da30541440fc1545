"""Word-processor files as DataFrames: tracked changes, segments and paragraphs, settings, facts for integrity, comments.

A file is a zip archive of XML parts. Spark lists and reads the files, one row each; a task parses the rows that it has.
Element and attribute names are compared without their namespaces.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.functions.columns import u16_length
from palimpsest.sources import nodes
from palimpsest.sources.scratch import stored

BODY = "word/document.xml"
INSERTED, DELETED = {"ins": False, "moveTo": True}, {"del": False, "moveFrom": True}
#: Elements whose blocks count as their parent's.
WRAPPERS = {"sdt", "sdtContent", "customXml", "ins", "del", "moveTo", "moveFrom"}
#: Elements without text of their own.
SILENT = {"rPr", "pPr", "instrText", "delInstrText", "fldChar", "bookmarkEnd", "proofErr", "commentRangeStart", "commentRangeEnd", "commentReference"}
FIGURES = {"drawing", "pict", "object", "AlternateContent"}

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType())}


def struct(fields: str, **more: T.DataType) -> T.StructType:
    """A schema from ``name type, name type``; ``strings`` is a list of them."""
    return T.StructType([*[T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(", "))], *[T.StructField(n, t) for n, t in more.items()]])


CHANGE = struct("id string, ts timestamp, author string, move boolean, move_name string")
REVISIONS = struct("doc_id long, path string, seq int, type string, rev_id string, author string, ts timestamp, chars int, text string, part string")
STATS = struct("doc_id long, path string, sha256 string, final_chars int, inserted int, deleted int, baseline_chars int, undated int, settings_part_found boolean, track_revisions boolean, remove_personal_information boolean, remove_date_and_time boolean, document_id string, error string")
SEGMENTS = struct("doc_id long, para_index int, seg_index int, kind string, text string, chars int, width double, size_pt double, hidden boolean, height_pt double", ins=CHANGE, **{"del": CHANGE})
PARAGRAPHS = struct("doc_id long, para_index int, kind string, style string, heading_level int, table_id int, para_id string, bookmarks strings, in_merge_continue boolean", mark_ins=CHANGE, mark_del=CHANGE, row_ins=T.ArrayType(CHANGE), row_del=T.ArrayType(CHANGE))
FACTS = struct("doc_id long, settings_part_found boolean, track_revisions boolean, protection_edit string, protection_enforced boolean, protection_key string, rsid_root string, listed_rsids strings, used_rsids strings, undated int, without_author int, created string, modified string, application string, app_version string, total_time string", runs=T.ArrayType(struct("rsid string, tracked boolean, chars int")), revisions=T.ArrayType(struct("seq int, tag string, id string, author string, date string")))
SECTIONS = struct("doc_id long, section int, width_twips int, height_twips int, margin_top int, margin_bottom int, margin_left int, margin_right int, columns int, breaks_page boolean")
NOTES = struct("doc_id long, kind string, note_id string, paragraphs int, chars int, width double")
COMMENTS = struct("doc_id long, nth int, id string, key string, durable_id string, para_id string, parent_key string, author string, initials string, date string, date_utc string, text string, done boolean, anchor_para_id string, quote string, prefix string, suffix string, revisions strings")


def name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def attr(element: ET.Element | None, key: str) -> str | None:
    if element is None:
        return None
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == key), None)


def child(element: ET.Element | None, key: str) -> ET.Element | None:
    return None if element is None else next((e for e in element if name(e) == key), None)


def instant(text: str | None) -> datetime | None:
    """A date as files have it, or None if there is none or it can't be read; without a zone it is UTC."""
    if not text:
        return None
    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def u16(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


class Package:
    """The parts of one file; a part that isn't there or can't be parsed is None."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def text(self, part: str) -> str | None:
        return self.zip.read(part).decode("utf-8-sig", "replace") if part in self.names else None

    def tree(self, part: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(part)) if part in self.names else None


def on(settings: ET.Element | None, key: str) -> bool:
    found = child(settings, key)
    return found is not None and (attr(found, "val") or "true").lower() not in ("false", "0", "off")


# the segment model


def display_width(text: str) -> float:
    """Width in full characters: those from U+1100 on count 1, others a half."""
    return sum(1.0 if ord(c) >= 0x1100 else 0.5 for c in text)


def number(text: str | None) -> float | None:
    try:
        return float(text) if text else None
    except ValueError:
        return None


#: Points in a CSS unit; units of DrawingML in a point.
CSS_POINTS, EMU = {"pt": 1.0, "in": 72.0, "cm": 72 / 2.54, "mm": 72 / 25.4, "px": 0.75, "pc": 12.0}, 12_700


def figure_height(figure: ET.Element) -> float | None:
    """Height in points of a drawing, or of a shape with a CSS style; None if it says nothing."""
    for e in figure.iter():
        if name(e) == "extent" and (cy := number(attr(e, "cy"))):
            return cy / EMU
        if found := re.search(r"(?:^|;)\s*height\s*:\s*([\d.]+)\s*(pt|in|cm|mm|px|pc)", attr(e, "style") or ""):
            return float(found[1]) * CSS_POINTS[found[2]]
    return None


def run_styles(styles: ET.Element | None) -> dict[str, tuple[float | None, bool | None, str | None]]:
    """Of each style its size in points, whether it hides text, and the style it is based on."""
    return {attr(e, "styleId"): (*run_look(child(e, "rPr")), attr(child(e, "basedOn"), "val")) for e in (styles if styles is not None else ()) if name(e) == "style" and attr(e, "styleId")}


def run_look(pr: ET.Element | None) -> tuple[float | None, bool | None]:
    half = number(attr(child(pr, "sz"), "val"))
    return half / 2 if half else None, on(pr, "vanish") if child(pr, "vanish") is not None else None


class Model:
    """Paragraphs and segments of a body, in document order."""

    def __init__(self, root: ET.Element | None, styles: ET.Element | None = None):
        self.styles = run_styles(styles)
        self.look: tuple[float | None, bool | None] = (None, None)
        self.paragraphs: list[dict] = []
        self.segments: list[dict] = []
        self.tables = 0
        self.moves = {"moveFromRange": None, "moveToRange": None}
        self.bookmarks: list[str] = []
        body = child(root, "body") if root is not None and name(root) == "document" else root
        if body is not None:
            self.blocks(body, None, [], [], False)

    def styled(self, style: str | None, pr: ET.Element, look: tuple) -> tuple[float | None, bool | None]:
        """Size and hiding of a run: its own, else its style's, else those of the styles that is based on, else what was before."""
        looks, depth = [run_look(pr)], 0
        while style in self.styles and depth < 12:
            looks.append(self.styles[style][:2])
            style, depth = self.styles[style][2], depth + 1
        looks.append(look)
        return next((x[0] for x in looks if x[0] is not None), None), next((x[1] for x in looks if x[1] is not None), None)

    def range_mark(self, e: ET.Element) -> bool:
        """Keeps the name of the move that is open; says whether the element was such a mark."""
        what = name(e)
        for kind in self.moves:
            if what == f"{kind}Start":
                self.moves[kind] = attr(e, "name")
                return True
            if what == f"{kind}End":
                self.moves[kind] = None
                return True
        return False

    def change(self, e: ET.Element, move: bool = False, move_name: str | None = None) -> dict:
        return {"id": attr(e, "id") or "", "ts": instant(attr(e, "date")), "author": attr(e, "author"), "move": move, "move_name": move_name}

    def blocks(self, parent: ET.Element, table: int | None, row_ins: list, row_del: list, merged: bool) -> None:
        for e in parent:
            what = name(e)
            if self.range_mark(e):
                continue
            if what == "bookmarkStart":
                self.bookmark(e)
            elif what == "p":
                self.paragraph(e, table, row_ins, row_del, merged)
            elif what == "tbl":
                unit = table
                if unit is None:
                    unit, self.tables = self.tables, self.tables + 1
                for tr in inner(e, "tr"):
                    pr = child(tr, "trPr")
                    ins, gone = child(pr, "ins"), child(pr, "del")
                    for tc in inner(tr, "tc"):
                        merge = child(child(tc, "tcPr"), "vMerge")
                        self.blocks(tc, unit, row_ins + ([self.change(ins)] if ins is not None else []), row_del + ([self.change(gone)] if gone is not None else []), merged or merge is not None and attr(merge, "val") != "restart")
            elif what in WRAPPERS:
                self.blocks(e, table, row_ins, row_del, merged)

    def bookmark(self, e: ET.Element) -> None:
        if (label := attr(e, "name")) and label != "_GoBack":
            self.bookmarks.append(label)

    def paragraph(self, p: ET.Element, table: int | None, row_ins: list, row_del: list, merged: bool) -> None:
        pr = child(p, "pPr")
        marks = child(pr, "rPr")
        index = len(self.paragraphs)
        row = {"para_index": index, "kind": "body" if table is None else "table", "style": attr(child(pr, "pStyle"), "val"), "heading_level": None, "table_id": table, "para_id": (attr(p, "paraId") or "").upper() or None, "in_merge_continue": merged, "mark_ins": None, "mark_del": None, "row_ins": row_ins, "row_del": row_del}
        level = attr(child(pr, "outlineLvl"), "val")
        row["heading_level"] = int(level) + 1 if level and level.isdigit() and int(level) < 9 else None
        for e in marks if marks is not None else ():
            if name(e) in INSERTED:
                row["mark_ins"] = self.change(e, INSERTED[name(e)], self.moves["moveToRange"] if INSERTED[name(e)] else None)
            elif name(e) in DELETED:
                row["mark_del"] = self.change(e, DELETED[name(e)], self.moves["moveFromRange"] if DELETED[name(e)] else None)
        self.paragraphs.append(row)
        first = len(self.segments)
        self.inline(p, None, None, index, first)
        row["bookmarks"], self.bookmarks = self.bookmarks, []

    def inline(self, parent: ET.Element, ins: dict | None, gone: dict | None, index: int, first: int) -> None:
        def add(kind: str, text: str | None = None, height: float | None = None) -> None:
            size, hidden = self.look
            self.segments.append({"para_index": index, "seg_index": len(self.segments) - first, "kind": kind, "text": text, "chars": len(text or ""), "width": 2.0 if text == "\t" else display_width(text or ""), "size_pt": size, "hidden": bool(hidden), "height_pt": height, "ins": ins, "del": gone})

        for e in parent:
            what = name(e)
            if self.range_mark(e) or what in SILENT:
                continue
            if what in INSERTED:
                self.inline(e, self.change(e, INSERTED[what], self.moves["moveToRange"] if INSERTED[what] else None), gone, index, first)
            elif what in DELETED:
                self.inline(e, ins, self.change(e, DELETED[what], self.moves["moveFromRange"] if DELETED[what] else None), index, first)
            elif what in ("t", "delText"):
                if e.text:
                    add("text", e.text)
            elif what == "tab":
                add("text", "\t")
            elif what in ("br", "cr"):
                add("pageBreak" if attr(e, "type") == "page" else "lineBreak")
            elif what in FIGURES:
                add("figure", height=figure_height(e))
            elif what == "r":
                before, pr = self.look, child(e, "rPr")
                if pr is not None:
                    self.look = self.styled(attr(child(pr, "rStyle"), "val"), pr, before)
                self.inline(e, ins, gone, index, first)
                self.look = before
            elif what == "bookmarkStart":
                self.bookmark(e)
            else:
                self.inline(e, ins, gone, index, first)


def inner(parent: ET.Element, key: str) -> Iterator[ET.Element]:
    """Rows of a table or cells of a row, those in wrappers too."""
    for e in parent:
        if name(e) == key:
            yield e
        elif name(e) in WRAPPERS:
            yield from inner(e, key)


# heading levels from styles


def style_levels(styles: ET.Element | None) -> dict[str, int]:
    """Outline level (from 1) of each paragraph style, its own or that of the styles it is based on, up to 12 deep."""
    own, base = {}, {}
    for s in styles if styles is not None else ():
        if name(s) == "style" and (key := attr(s, "styleId")):
            level = attr(child(child(s, "pPr"), "outlineLvl"), "val")
            named = re.fullmatch(r"heading ([1-9])", (attr(child(s, "name"), "val") or "").lower())
            own[key] = int(level) + 1 if level and level.isdigit() else int(named[1]) if named else None
            base[key] = attr(child(s, "basedOn"), "val")
    out = {}
    for key in own:
        at, depth = key, 0
        while at in own and own[at] is None and depth < 12:
            at, depth = base.get(at), depth + 1
        if at in own and own[at] and own[at] <= 9:
            out[key] = own[at]
    return out


# facts for integrity and tamper checks


def protection(settings: str | None) -> tuple[str | None, bool, str] | None:
    found = re.search(r"<(?:\w+:)?documentProtection\b([^>]*)>", settings or "")
    if not found:
        return None
    a = dict(re.findall(r'(?:\w+:)?(\w+)="([^"]*)"', found[1]))
    return a.get("edit"), a.get("enforcement", "").lower() in ("1", "true", "on"), f"{a.get('hashValue') or a.get('hash') or ''}|{a.get('saltValue') or a.get('salt') or ''}"


def facts_of(package: Package) -> dict:
    settings, body = package.text("word/settings.xml"), package.text(BODY)
    tree = package.tree("word/settings.xml")
    lock = protection(settings)
    runs, used, revisions = [], {}, []

    def walk(parent: ET.Element, tracked: bool) -> None:
        for e in parent:
            for k, v in e.attrib.items():
                if k.rpartition("}")[2].startswith("rsid") and re.fullmatch(r"[0-9A-Fa-f]{8}", v):
                    used[v.upper()] = True
            what = name(e)
            if what == "r":
                rsid = attr(e, "rsidR")
                texts = "".join(t.text or "" for t in e if name(t) in ("t", "delText"))
                runs.append({"rsid": rsid.upper() if rsid else None, "tracked": tracked, "chars": len("".join(texts.split()))})
            else:
                walk(e, tracked or what in INSERTED and attr(e, "id") is not None)

    undated = anonymous = 0
    if body is not None:
        root = package.tree(BODY)
        walk(root, False)
        for e in root.iter():
            what = name(e)
            if attr(e, "id") is not None and (what in ("ins", "del", "moveFrom", "moveTo", "cellIns", "cellDel") or what.endswith("Change")):
                revisions.append({"seq": len(revisions), "tag": what, "id": attr(e, "id"), "author": attr(e, "author"), "date": attr(e, "date")})
                if what in ("ins", "del", "moveFrom", "moveTo"):
                    undated += attr(e, "date") is None
                    anonymous += attr(e, "author") is None
    root_id = re.search(r'<(?:\w+:)?rsidRoot\b[^>]*?(?:\w+:)?val="([0-9A-Fa-f]{8})"', settings or "")
    prop = lambda part, key: (re.search(rf"<(?:\w+:)?{key}\b[^>]*>([^<]*)</", package.text(part) or "") or [None, None])[1]
    return {
        "settings_part_found": settings is not None, "track_revisions": on(tree, "trackRevisions"), "protection_edit": lock and lock[0], "protection_enforced": lock and lock[1], "protection_key": lock and lock[2],
        "rsid_root": root_id[1].upper() if root_id else None, "listed_rsids": sorted({x.upper() for x in re.findall(r'<(?:\w+:)?rsid\b[^>]*?(?:\w+:)?val="([0-9A-Fa-f]{8})"', settings or "")}), "used_rsids": sorted(used),
        "undated": undated, "without_author": anonymous, "runs": runs, "revisions": revisions,
        "created": prop("docProps/core.xml", "created"), "modified": prop("docProps/core.xml", "modified"), "application": prop("docProps/app.xml", "Application"), "app_version": prop("docProps/app.xml", "AppVersion"), "total_time": prop("docProps/app.xml", "TotalTime"),
    }


# comments


def fnv_pair(text: str) -> str:
    """16 hex digits from two 32-bit FNV-1a hashes over UTF-16 units. The two starts, the prime."""
    data = text.encode("utf-16-le", "surrogatepass")
    units = [data[k] | data[k + 1] << 8 for k in range(0, len(data), 2)]
    out = ""
    for h in (0x811C9DC5, 0x01000193):
        for u in units:
            h = ((h ^ u) * 0x01000193) & 0xFFFFFFFF
        out += f"{h:08x}"
    return out


def plain(element: ET.Element, deleted: bool) -> str:
    return "".join(e.text or "" for e in element.iter() if name(e) == "t" or deleted and name(e) == "delText")


def anchors_of(body: ET.Element, context: int = 32) -> dict[str, dict]:
    """By comment id the text of its range, what stands around it, its paragraph, and the keys of the changes in it."""
    text: list[str] = []
    size, para = 0, None
    open_, done, points = {}, {}, {}

    def put(s: str) -> None:
        nonlocal size
        text.append(s)
        size += len(s)

    def walk(parent: ET.Element) -> None:
        nonlocal para
        for e in parent:
            what, key = name(e), attr(e, "id")
            if what == "p":
                outer, para = para, (attr(e, "paraId") or "").upper() or None
                walk(e)
                put("\n")
                para = outer
            elif what == "t":
                put(e.text or "")
            elif what in ("tab", "br", "cr"):
                put("\t" if what == "tab" else "\n")
            elif what == "commentRangeStart" and key is not None:
                open_[key] = {"start": size, "para": para, "revisions": set()}
            elif what == "commentRangeEnd":
                if key in open_:
                    done[key] = open_.pop(key) | {"end": size}
            elif what == "commentReference" and key is not None:
                points.setdefault(key, {"start": size, "end": size, "para": para, "revisions": set()})
            elif what not in ("delText", "instrText", "delInstrText"):
                if what in INSERTED or what in DELETED:
                    for o in open_.values():
                        o["revisions"].add(f"{'ins' if what in INSERTED else 'del'}|{attr(e, 'author') or ''}|{attr(e, 'date') or ''}|{fnv_pair(plain(e, True))}")
                walk(e)

    walk(body)
    whole = "".join(text)
    return {k: {"anchor_para_id": a["para"], "quote": whole[a["start"] : a["end"]], "prefix": whole[max(0, a["start"] - context) : a["start"]], "suffix": whole[a["end"] : a["end"] + context], "revisions": sorted(a["revisions"])} for k, a in (points | done).items()}


def comments_of(package: Package) -> list[dict]:
    """The comments in their part's order, with what the extended parts say of them."""
    root = package.tree("word/comments.xml")
    if root is None:
        return []
    rows = lambda part, tag: [e for e in (package.tree(part) if part in package.names else ()) if name(e) == tag]
    upper = lambda e, key: (attr(e, key) or "").upper() or None
    extended = {upper(e, "paraId"): (attr(e, "done") == "1", upper(e, "paraIdParent")) for e in rows("word/commentsExtended.xml", "commentEx")}
    durable = {upper(e, "paraId"): upper(e, "durableId") for e in rows("word/commentsIds.xml", "commentId")}
    utc = {upper(e, "durableId"): attr(e, "dateUtc") for e in rows("word/commentsExtensible.xml", "commentExtensible")}
    anchors = anchors_of(package.tree(BODY)) if BODY in package.names else {}
    out = []
    for c in root:
        if name(c) != "comment":
            continue
        paras = [p for p in c if name(p) == "p"]
        ids = [x for x in (upper(p, "paraId") for p in paras) if x]
        para = next((x for x in reversed(ids) if x in extended or x in durable), ids[-1] if ids else None)
        lasting = durable.get(para) if para else None
        author, date = attr(c, "author"), attr(c, "date")
        text = "\n".join(plain(p, False) for p in paras)
        key = f"d:{lasting}" if lasting else "h:" + fnv_pair(f"{author or ''}\0{date or ''}\0{text}")
        out.append({"nth": len(out), "id": attr(c, "id") or "", "key": key, "durable_id": lasting, "para_id": para, "parent_key": None, "author": author, "initials": attr(c, "initials"), "date": date, "date_utc": utc.get(lasting) if lasting else None, "text": text, "done": extended[para][0] if para in extended else False, **anchors.get(attr(c, "id") or "", {})})
    by_para = {c["para_id"]: c["key"] for c in out if c["para_id"]}
    for c in out:
        if c["para_id"] in extended:
            c["parent_key"] = by_para.get(extended[c["para_id"]][1])
    return out


# DataFrames


def files(spark: SparkSession, path: str, *, most: int | None = None) -> DataFrame:
    """doc_id, path, modified, content of the files below a folder; hidden ones and owner files of open documents are left out.

    doc_id is a hash of the path. ``most``: so many at most, the first by path.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    base = F.element_at(F.split("path", "/"), -1)
    rows = rows.where(~base.startswith("~$") & ~base.startswith(".") & ~F.col("path").rlike(r"/\.[^/]+/"))
    rows = rows.select(F.xxhash64("path").alias("doc_id"), "path", F.col("modificationTime").alias("modified"), "content")
    return rows if most is None else rows.orderBy("path").limit(most)


def parsed(rows: DataFrame, schema: T.StructType, parse: Callable[[dict, Package], list[dict]], failed: Callable[[dict, str], list[dict]] | None = None) -> DataFrame:
    """The rows that ``parse`` gives for each file (doc_id, path, content); a file that can't be read gives what ``failed`` says, or none."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file = batch.slice(k, 1).to_pylist()[0]
                try:
                    found = parse(file, Package(file["content"]))
                except (zipfile.BadZipFile, ET.ParseError, KeyError, RecursionError, ValueError) as e:
                    found = failed(file, f"{type(e).__name__}: {e}") if failed else []
                for at in range(0, len(found), 5000):
                    part = [{f: r.get(f) for f in schema.names} | {"doc_id": file["doc_id"]} for r in found[at : at + 5000]]
                    yield pa.RecordBatch.from_pylist(part, schema=arrow)

    return rows.select("doc_id", "path", "content").mapInArrow(run, schema)


def revisions(rows: DataFrame, parts: list[str] = [BODY]) -> DataFrame:
    """The dated insertions and deletions of the parts, those of a document by time; equal times in document order."""
    found = nodes.revisions(nodes.nodes(rows), parts).where("dated").join(rows.select("doc_id", "path"), "doc_id")
    order = W.partitionBy("doc_id").orderBy(F.col("ts").asc_nulls_last(), F.array_position(F.lit(parts), F.col("part")), "node")
    found = found.withColumns({"seq": (F.row_number().over(order) - 1).cast("int"), "chars": u16_length(F.col("text"))})
    return found.select(*REVISIONS.names)


def stats(rows: DataFrame, parts: list[str] = [BODY]) -> DataFrame:
    """One row a file: lengths, undated changes, settings, its own id and its content's sha256; ``error`` if it can't be read."""
    # read once for all that follows, and only what that looks at
    elements = stored(nodes.nodes(rows, dict.fromkeys(parts, nodes.CHANGES) | {"word/settings.xml": None}), "elements")
    changes = nodes.revisions(elements, parts)
    chars = lambda kind: F.sum(F.when(F.col("dated") & (F.col("type") == kind), u16_length(F.col("text"))).otherwise(0)).cast("int")
    sums = changes.groupBy("doc_id").agg(chars("ins").alias("inserted"), chars("del").alias("deleted"), F.count_if(~F.col("dated")).cast("int").alias("undated"))
    failed = elements.where((F.col("tag") == nodes.ERROR) & (F.col("part").isNull() | F.col("part").isin(*parts, "word/settings.xml"))).groupBy("doc_id").agg(F.min("text").alias("error"))
    found = rows.select("doc_id", "path", F.sha2("content", 256).alias("sha256"))
    for more in (sums, nodes.final_lengths(elements, parts), nodes.settings(elements).withColumn("settings_part_found", F.lit(True)), failed):
        found = found.join(more, "doc_id", "left")
    found = found.fillna(0, ["inserted", "deleted", "undated", "final_chars"]).fillna(False, ["settings_part_found", "track_revisions", "remove_personal_information", "remove_date_and_time"])
    found = found.withColumn("baseline_chars", F.greatest(F.lit(0), F.col("final_chars") - F.col("inserted") + F.col("deleted")))
    told = [F.when(F.col("error").isNull(), F.col(c)).alias(c) if c not in ("doc_id", "path", "error") else F.col(c) for c in STATS.names]
    return found.select(*told)


def segments(rows: DataFrame) -> DataFrame:
    """Text, breaks and figures with their changes; chars are code points, width counts wide characters twice."""
    return parsed(rows, SEGMENTS, lambda _, package: Model(package.tree(BODY), package.tree("word/styles.xml")).segments)


def sections(rows: DataFrame) -> DataFrame:
    """Page size, margins (in twips) and columns of each section, and whether it begins on a new page."""

    def parse(_: dict, package: Package) -> list[dict]:
        root = package.tree(BODY)
        found = [e for e in (root.iter() if root is not None else ()) if name(e) == "sectPr"]
        value = lambda e, key: int(n) if (n := number(attr(e, key))) is not None else None
        out = []
        for k, e in enumerate(found):
            page, margin = child(e, "pgSz"), child(e, "pgMar")
            out.append({"section": k, "width_twips": value(page, "w"), "height_twips": value(page, "h"), **{f"margin_{side}": value(margin, side) for side in ("top", "bottom", "left", "right")}, "columns": value(child(e, "cols"), "num") or 1, "breaks_page": attr(child(e, "type"), "val") not in ("continuous", "nextColumn")})
        return out

    return parsed(rows, SECTIONS, parse)


def notes(rows: DataFrame) -> DataFrame:
    """Footnotes and endnotes with their extent; separators aren't notes."""

    def parse(_: dict, package: Package) -> list[dict]:
        out = []
        for kind in ("footnote", "endnote"):
            for e in package.tree(f"word/{kind}s.xml") if f"word/{kind}s.xml" in package.names else ():
                if name(e) == kind and attr(e, "type") in (None, "normal"):
                    texts = [plain(p, False) for p in e if name(p) == "p"]
                    out.append({"kind": kind, "note_id": attr(e, "id"), "paragraphs": len(texts), "chars": sum(map(len, texts)), "width": sum(map(display_width, texts))})
        return out

    return parsed(rows, NOTES, parse)


def paragraphs(rows: DataFrame) -> DataFrame:
    def parse(_: dict, package: Package) -> list[dict]:
        levels = style_levels(package.tree("word/styles.xml"))
        found = Model(package.tree(BODY)).paragraphs
        for p in found:
            p["heading_level"] = p["heading_level"] or levels.get(p["style"])
        return found

    return parsed(rows, PARAGRAPHS, parse)


def facts(rows: DataFrame) -> DataFrame:
    return parsed(rows, FACTS, lambda _, package: [facts_of(package)])


def comments(rows: DataFrame) -> DataFrame:
    return parsed(rows, COMMENTS, lambda _, package: comments_of(package))


def history_problem(stat_rows: DataFrame) -> DataFrame:
    """``stat_rows`` with removes_author_and_date, needs_fix, and why a file has no dated changes (ok, undated, tracking_off, tracking_on)."""
    removes = F.col("remove_personal_information") | F.col("remove_date_and_time")
    why = F.when(F.col("inserted") + F.col("deleted") > 0, "ok").when(F.col("undated") > 0, "undated").when(F.col("track_revisions"), "tracking_on").otherwise("tracking_off")
    return stat_rows.withColumns({"removes_author_and_date": removes, "needs_fix": F.col("settings_part_found") & removes, "diagnosis": why})
