"""New files from files: the document as it was at a time, settings that keep history, the lock of tracked changes, replies.

Each edit is bytes to bytes for one file; the DataFrame forms run it on the rows that a task has.
"""

from __future__ import annotations

import base64
import hashlib
import html
import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from xml.dom import minidom

import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.sources.docx import instant

#: The parts that may hold changes, elements that mark the ends of moves, and what old properties don't say.
PARTS = re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml")
ENDS = re.compile(r"(moveFrom|moveTo|customXmlIns|customXmlDel|customXmlMoveFrom|customXmlMoveTo)Range(Start|End)")
PROPERTIES = {"rPr": ([], []), "pPr": ([], ["rPr", "sectPr"]), "sectPr": (["headerReference", "footerReference"], []), "tblPr": ([], []), "tblPrEx": ([], []), "trPr": ([], []), "tcPr": ([], []), "tblGrid": ([], [])}
INSERTS, DELETES = {"ins", "moveTo"}, {"del", "moveFrom"}
SPINS = 100_000


def local(node) -> str:
    return (node.nodeName or "").rpartition(":")[2] if node.nodeType == node.ELEMENT_NODE else ""


def value(node, key: str) -> str | None:
    return next((v for k, v in node.attributes.items() if k.rpartition(":")[2] == key), None)


def first(node, *names: str):
    return next((c for c in node.childNodes if local(c) in names), None)


def rewritten(content: bytes, change: Callable[[str, bytes], bytes], more: dict[str, bytes] | None = None) -> bytes:
    """The archive with each part as ``change`` returns it, and with ``more`` parts."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in old.infolist():
            if item.filename not in (more or {}):
                info = zipfile.ZipInfo(item.filename, item.date_time)
                info.compress_type = zipfile.ZIP_DEFLATED
                new.writestr(info, change(item.filename, old.read(item.filename)))
        for key, data in (more or {}).items():
            new.writestr(key, data)
    return out.getvalue()


# a version at a time


class Past:
    """Undoes what happened after ``at`` and accepts what happened before, in one part's tree. Undated changes always happened."""

    def __init__(self, at: datetime):
        self.at = at

    def happened(self, node) -> bool:
        date = instant(value(node, "date"))
        return date is None or date <= self.at

    def there(self, properties) -> bool:
        """Whether a paragraph's mark or a row exists, by the marks among its properties."""
        ins, gone = (first(properties, *INSERTS), first(properties, *DELETES)) if properties is not None else (None, None)
        return (ins is None or self.happened(ins)) and not (gone is not None and self.happened(gone))

    def unwrap(self, node) -> None:
        parent = node.parentNode
        while node.firstChild is not None:
            parent.insertBefore(node.firstChild, node)
        parent.removeChild(node)

    def restore(self, node) -> None:
        """Deleted text that is there again is ordinary text."""
        for old, new in (("delText", "t"), ("delInstrText", "instrText")):
            for e in [e for e in node.getElementsByTagName("*") if local(e) == old]:
                e.tagName = e.nodeName = e.nodeName[: -len(old)] + new

    def apply(self, node) -> None:
        for child in list(node.childNodes):
            what = local(child)
            if not what:
                continue
            if ENDS.fullmatch(what) or what in ("cellIns", "cellDel", "cellMerge"):
                node.removeChild(child)
                continue
            if what in INSERTS or what in DELETES:
                stays = self.happened(child) if what in INSERTS else not self.happened(child)
                if not stays or local(node) in ("rPr", "trPr"):
                    node.removeChild(child)
                    continue
                if what in DELETES:
                    self.restore(child)
                self.apply(child)
                self.unwrap(child)
                continue
            if what == "tr" and not self.there(first(child, "trPr")):
                node.removeChild(child)
                continue
            if what == "p":
                pr = first(child, "pPr")
                if not self.there(first(pr, "rPr") if pr is not None else None):
                    child.setAttribute("palimpsest-open", "1")
            if what in PROPERTIES:
                self.properties(child, what)
            self.apply(child)
            if what == "tbl" and first(child, "tr") is None:
                node.removeChild(child)
        self.join(node)

    def properties(self, node, what: str) -> None:
        change = first(node, f"{what}Change")
        if change is None:
            return
        happened = self.happened(change)
        node.removeChild(change)
        if happened:
            return
        before, after = PROPERTIES[what]
        kept_first = [c for c in node.childNodes if local(c) in before]
        kept_last = [c for c in node.childNodes if local(c) in after]
        old = next((c for c in change.childNodes if local(c)), None)
        for c in list(node.childNodes):
            node.removeChild(c)
        for c in [*kept_first, *(list(old.childNodes) if old is not None else []), *kept_last]:
            node.appendChild(c)

    def join(self, node) -> None:
        """A paragraph without its mark goes on with the next one, whose properties count."""
        waiting = None
        for child in list(node.childNodes):
            what = local(child)
            if what == "p":
                if waiting is not None:
                    at = first(child, "pPr")
                    at = at.nextSibling if at is not None else child.firstChild
                    for c in [c for c in waiting.childNodes if local(c) != "pPr"]:
                        child.insertBefore(c, at)
                    node.removeChild(waiting)
                waiting = child if child.hasAttribute("palimpsest-open") else None
                if waiting is not None:
                    child.removeAttribute("palimpsest-open")
            elif what in ("tbl", "sectPr", "sdt", "customXml"):
                waiting = None


def part_at(xml: bytes, at: datetime) -> bytes:
    tree = minidom.parseString(xml)
    Past(at).apply(tree)
    return tree.toxml(encoding="UTF-8")


def version(content: bytes, at: datetime) -> bytes:
    """The file as the document was at a time, without any tracked changes."""
    return rewritten(content, lambda part, xml: part_at(xml, at) if PARTS.fullmatch(part) else xml)


def versions(points: DataFrame) -> DataFrame:
    """doc_id, at_ms, label, content of each version. points: doc_id, at_ms, label, content (of the file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                made = version(r["content"], datetime.fromtimestamp(r["at_ms"] / 1000, timezone.utc))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r["doc_id"]], pa.int64()), "at_ms": pa.array([r["at_ms"]], pa.int64()), "label": pa.array([r["label"]], pa.string()), "content": pa.array([made], pa.binary())})

    return points.select("doc_id", "at_ms", "label", "content").mapInArrow(run, "doc_id long, at_ms long, label string, content binary")


# settings


def _settings(content: bytes, edit: Callable[[str], str]) -> bytes:
    return rewritten(content, lambda part, xml: edit(xml.decode("utf-8-sig")).encode() if part == "word/settings.xml" else xml)


def _prefix(xml: str) -> str:
    found = re.search(r"<((?:\w+:)?)settings\b", xml)
    if not found:
        raise ValueError("no settings element")
    return found[1]


def _without(xml: str, key: str) -> str:
    return re.sub(rf"<(?:\w+:)?{key}\b[^>]*?(?:/>|>.*?</(?:\w+:)?{key}>)", "", xml, flags=re.DOTALL)


#: Settings that the schema puts before those which are written here.
EARLIER = ["writeProtection", "view", "zoom", "removePersonalInformation", "removeDateAndTime", "doNotDisplayPageBoundaries", "displayBackgroundShape", "printPostScriptOverText", "printFractionalCharacterWidth", "printFormsData", "embedTrueTypeFonts", "embedSystemFonts", "saveSubsetFonts", "saveFormsData", "mirrorMargins", "alignBordersAndEdges", "bordersDoNotSurroundHeader", "bordersDoNotSurroundFooter", "gutterAtTop", "hideSpellingErrors", "hideGrammaticalErrors", "activeWritingStyle", "proofState", "formsDesign", "attachedTemplate", "linkStyles", "stylePaneFormatFilter", "stylePaneSortMethod", "documentType", "mailMerge", "revisionView"]


def _with(xml: str, element: str, earlier: list[str]) -> str:
    """The settings with an element after those that come before it in the schema's order."""
    at = re.search(r"<(?:\w+:)?settings\b[^>]*?(/?)>", xml)
    if at[1]:
        xml = xml[: at.end(0) - 2] + f"></{_prefix(xml)}settings>" + xml[at.end(0) :]
        at = re.search(r"<(?:\w+:)?settings\b[^>]*?>", xml)
    place = at.end()
    for m in re.finditer(rf"<(?:\w+:)?({'|'.join(earlier)})\b[^>]*?(?:/>|>.*?</(?:\w+:)?\1>)", xml[place:], re.DOTALL):
        end = at.end() + m.end()
        place = max(place, end)
    return xml[:place] + element + xml[place:]


def keep_history(content: bytes) -> bytes:
    """The file with tracking on, and without the settings that take authors and dates away when it is saved."""

    def edit(xml: str) -> str:
        p = _prefix(xml)
        for key in ("removePersonalInformation", "removeDateAndTime", "trackRevisions"):
            xml = _without(xml, key)
        return _with(xml, f"<{p}trackRevisions/>", EARLIER)

    return _settings(content, edit)


# the lock


def password_key(password: str) -> int:
    """The 32-bit key of a password by the public file format: an initial value by its length, bits of a matrix, and a hash."""
    if not password:
        return 0
    codes = [(c & 0xFF) or (c >> 8) for c in (ord(ch) for ch in password[:15])]
    # Initial codes by length, and the matrix for the bits of each of the last fifteen characters.
    initial = [0xE1F0, 0x1D0F, 0xCC9C, 0x84C0, 0x110C, 0x0E10, 0xF1CE, 0x313E, 0x1872, 0xE139, 0xD40F, 0x84F9, 0x280C, 0xA96A, 0x4EC3]
    matrix = [
        [0xAEFC, 0x4DD9, 0x9BB2, 0x2745, 0x4E8A, 0x9D14, 0x2A09], [0x7B61, 0xF6C2, 0xFDA5, 0xEB6B, 0xC6F7, 0x9DCF, 0x2BBF], [0x4563, 0x8AC6, 0x05AD, 0x0B5A, 0x16B4, 0x2D68, 0x5AD0],
        [0x0375, 0x06EA, 0x0DD4, 0x1BA8, 0x3750, 0x6EA0, 0xDD40], [0xD849, 0xA0B3, 0x5147, 0xA28E, 0x553D, 0xAA7A, 0x44D5], [0x6F45, 0xDE8A, 0xAD35, 0x4A4B, 0x9496, 0x390D, 0x721A],
        [0xEB23, 0xC667, 0x9CEF, 0x29FF, 0x53FE, 0xA7FC, 0x5FD9], [0x47D3, 0x8FA6, 0x0F6D, 0x1EDA, 0x3DB4, 0x7B68, 0xF6D0], [0xB861, 0x60E3, 0xC1C6, 0x93AD, 0x377B, 0x6EF6, 0xDDEC],
        [0x45A0, 0x8B40, 0x06A1, 0x0D42, 0x1A84, 0x3508, 0x6A10], [0xAA51, 0x4483, 0x8906, 0x022D, 0x045A, 0x08B4, 0x1168], [0x76B4, 0xED68, 0xCAF1, 0x85C3, 0x1BA7, 0x374E, 0x6E9C],
        [0x3730, 0x6E60, 0xDCC0, 0xA9A1, 0x4363, 0x86C6, 0x1DAD], [0x3331, 0x6662, 0xCCC4, 0x89A9, 0x0373, 0x06E6, 0x0DCC], [0x1021, 0x2042, 0x4084, 0x8108, 0x1231, 0x2462, 0x48C4],
    ]
    high = initial[len(codes) - 1]
    for k, c in enumerate(codes):
        row = matrix[15 - len(codes) + k]
        for bit in range(7):
            if c >> bit & 1:
                high ^= row[bit]
    low = 0
    for c in reversed(codes):
        low = ((low >> 14 & 1) | (low << 1 & 0x7FFF)) ^ c
    low = ((low >> 14 & 1) | (low << 1 & 0x7FFF)) ^ len(codes) ^ 0xCE4B
    return high << 16 | low


def password_hash(password: str, salt: bytes, spins: int = SPINS) -> str:
    """The hash that a file keeps: SHA-512 over salt and the key as eight hex digits in reversed byte order, spun with a counter."""
    key = password_key(password).to_bytes(4, "little").hex().upper()
    h = hashlib.sha512(salt + key.encode("utf-16-le")).digest()
    for k in range(spins):
        h = hashlib.sha512(h + k.to_bytes(4, "little")).digest()
    return base64.b64encode(h).decode()


def lock(content: bytes, password: str | None = None, salt: bytes | None = None) -> bytes:
    """The file with tracking on and locked, with a password if one is given."""

    def edit(xml: str) -> str:
        p = _prefix(xml)
        for key in ("trackRevisions", "documentProtection"):
            xml = _without(xml, key)
        secret = ""
        if password:
            grain = salt or os.urandom(16)
            kept = {"cryptProviderType": "rsaAES", "cryptAlgorithmClass": "hash", "cryptAlgorithmType": "typeAny", "cryptAlgorithmSid": "14", "cryptSpinCount": str(SPINS), "hash": password_hash(password, grain), "salt": base64.b64encode(grain).decode()}
            secret = "".join(f' {p}{k}="{v}"' for k, v in kept.items())
        xml = _with(xml, f"<{p}trackRevisions/>", EARLIER)
        later = [*EARLIER, "trackRevisions", "doNotTrackMoves", "doNotTrackFormatting"]
        return _with(xml, f'<{p}documentProtection {p}edit="trackedChanges" {p}enforcement="1"{secret}/>', later)

    return _settings(content, edit)


def verify_lock(settings: str, password: str) -> bool | None:
    """Whether a password fits the lock in a settings part; None if there is no password."""
    found = re.search(r"<(?:\w+:)?documentProtection\b([^>]*)>", settings)
    a = dict(re.findall(r'(?:\w+:)?(\w+)="([^"]*)"', found[1])) if found else {}
    kept, salt = a.get("hash") or a.get("hashValue"), a.get("salt") or a.get("saltValue")
    if not kept or not salt:
        return None
    return password_hash(password, base64.b64decode(salt), int(a.get("cryptSpinCount") or a.get("spinCount") or SPINS)) == kept


# replies


def reply(content: bytes, para_id: str, text: str, author: str, at: datetime, own_para_id: str) -> bytes:
    """The file with a reply to the comment that ends with paragraph ``para_id``. The document's body gets the reply's anchors, nothing else."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        comments, extended = z.read("word/comments.xml").decode("utf-8-sig"), z.read("word/commentsExtended.xml").decode("utf-8-sig") if "word/commentsExtended.xml" in names else None
        body = z.read("word/document.xml").decode("utf-8-sig")
    if extended is None:
        raise ValueError("no extended comments part")
    parent = next((m for m in re.finditer(r"<((?:\w+:)?)comment\b([^>]*)>.*?</\1comment>", comments, re.DOTALL) if re.search(rf'paraId="{para_id}"', m[0], re.IGNORECASE)), None)
    if parent is None:
        raise ValueError(f"no comment with paragraph {para_id}")
    p, parent_id = parent[1], re.search(r'(?:\w+:)?id="([^"]*)"', parent[2])[1]
    new_id = str(1 + max((int(x) for x in re.findall(r"<(?:\w+:)?comment\b[^>]*?\b(?:\w+:)?id=\"(\d+)\"", comments)), default=0))
    stamp = at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    w14 = re.search(r'xmlns:(\w+)="http://schemas.microsoft.com/office/word/2010/wordml"', comments)
    own = f' {w14[1]}:paraId="{own_para_id}"' if w14 else ""
    made = f'<{p}comment {p}id="{new_id}" {p}author="{html.escape(author)}" {p}date="{stamp}"><{p}p{own}><{p}r><{p}t xml:space="preserve">{html.escape(text, quote=False)}</{p}t></{p}r></{p}p></{p}comment>'
    comments = re.sub(rf"</{p}comments>\s*$", lambda m: made + m[0], comments)
    q = re.search(r"<((?:\w+:)?)commentsEx\b", extended)[1]
    entry = f'<{q}commentEx {q}paraId="{own_para_id}" {q}paraIdParent="{para_id}" {q}done="0"/>'
    extended = re.sub(rf"</{q}commentsEx>\s*$", lambda m: entry + m[0], re.sub(rf"<({q}commentsEx\b[^>]*)/>\s*$", rf"<\1></{q}commentsEx>", extended))
    for tag, after in (("commentRangeStart", True), ("commentRangeEnd", True)):
        body = re.sub(rf'<((?:\w+:)?){tag}\b[^>]*?id="{re.escape(parent_id)}"[^>]*/>', lambda m, t=tag: m[0] + f'<{m[1]}{t} {m[1]}id="{new_id}"/>', body, count=1)
    body = re.sub(rf'(<((?:\w+:)?)r\b[^>]*>(?:(?!</\2r>).)*?<\2commentReference\b[^>]*?id="{re.escape(parent_id)}"[^>]*/>.*?</\2r>)', lambda m: m[0] + f'<{m[2]}r><{m[2]}commentReference {m[2]}id="{new_id}"/></{m[2]}r>', body, count=1, flags=re.DOTALL)
    made_parts = {"word/comments.xml": comments.encode(), "word/commentsExtended.xml": extended.encode(), "word/document.xml": body.encode()}
    return rewritten(content, lambda part, xml: xml, made_parts)


def edited(rows: DataFrame, edit: Callable[[bytes], bytes]) -> DataFrame:
    """doc_id, path, content, error of files after an edit; a file that can't be edited keeps its content and says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    made, error = edit(r["content"]), None
                except (ValueError, KeyError, zipfile.BadZipFile) as e:
                    made, error = r["content"], str(e)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r["doc_id"]], pa.int64()), "path": [r["path"]], "content": pa.array([made], pa.binary()), "error": pa.array([error], pa.string())})

    return rows.select("doc_id", "path", "content").mapInArrow(run, "doc_id long, path string, content binary, error string")
