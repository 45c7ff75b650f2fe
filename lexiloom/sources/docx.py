"""Word files as a source: paragraphs with context and Markdown, whole texts, images.

Files are read by Spark (``binaryFile``) and parsed on executors with the standard
library. A recursive walk turns the body, headers, footers, footnotes and comments
into one list of ``Part`` rows; texts, Markdown and documents are views of it.
"""

from __future__ import annotations

import base64
import io
import posixpath
import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexiloom.operators import runtime

# Fixed values of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
WPS_TXBX = "{http://schemas.microsoft.com/office/word/2010/wordprocessingShape}txbx"
VML_TXBX = "{urn:schemas-microsoft-com:vml}textbox"
NUMBERED = frozenset("decimal decimalZero upperRoman lowerRoman upperLetter lowerLetter ordinal cardinalText ordinalText hex chicago ideographDigital japaneseCounting aiueo iroha arabicFullWidth hindiNumbers thaiNumbers".split())
PAGE_FIELDS = ("PAGE", "NUMPAGES", "PAGEREF", "SECTIONPAGES")
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}
SCHEMA = "path string, para_idx int, kind string, raw_text string, md_text string, additional_context string, error string"


class DocxError(ValueError):
    """A file that cannot be converted."""


class DocxFormatError(DocxError):
    """Not a Word package."""


class DocxXmlError(DocxError):
    """A part that is no XML."""


class DocxContentError(DocxError):
    """An element that cannot be understood."""


@dataclass
class Options:
    tables: bool = True
    comments: bool = True
    footnotes: bool = True
    headers: bool = True
    footers: bool = True
    textboxes: bool = True
    images: bool = True
    links: bool = True
    inline: bool = True
    strict: bool = False


@dataclass
class Part:
    """A paragraph of the result; table rows are shown together in Markdown text."""

    text: str
    md: str
    context: str
    kind: str = "body"
    table: int | None = None


@dataclass
class Package:
    """The XML parts and relations of a file."""

    zip: zipfile.ZipFile
    main: ElementTree.Element = None
    rels: dict[str, tuple[str, str, bool]] = field(default_factory=dict)
    styles: dict[str, str] = field(default_factory=dict)
    lists: dict[tuple[str, int], str] = field(default_factory=dict)

    @classmethod
    def open(cls, data: bytes) -> Package:
        try:
            z = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise DocxFormatError("not a zip package") from e
        if "word/document.xml" not in z.namelist():
            raise DocxFormatError("no word/document.xml")
        p = cls(z)
        p.main = p.xml("word/document.xml")
        rels = p.xml("word/_rels/document.xml.rels", True)
        for r in rels if rels is not None else ():
            p.rels[r.get("Id")] = (r.get("Type", "").rsplit("/", 1)[-1], r.get("Target", ""), r.get("TargetMode") == "External")
        styles = p.xml("word/styles.xml", True)
        for s in styles.iter(f"{W}style") if styles is not None else ():
            name = s.find(f"{W}name")
            p.styles[s.get(f"{W}styleId")] = name.get(f"{W}val") if name is not None else s.get(f"{W}styleId")
        numbering = p.xml("word/numbering.xml", True)
        if numbering is not None:
            levels = {a.get(f"{W}abstractNumId"): {int(x.get(f"{W}ilvl", "0")): val(x.find(f"{W}numFmt"), "bullet") for x in a.iter(f"{W}lvl")} for a in numbering.iter(f"{W}abstractNum")}
            for n in numbering.iter(f"{W}num"):
                for level, form in levels.get(val(n.find(f"{W}abstractNumId")), {}).items():
                    p.lists[n.get(f"{W}numId"), level] = form
        return p

    def xml(self, name: str, may_miss: bool = False):
        if name not in self.zip.namelist():
            if may_miss:
                return None
            raise DocxFormatError(f"no {name}")
        try:
            return ElementTree.fromstring(self.zip.read(name))
        except ElementTree.ParseError as e:
            raise DocxXmlError(f"{name}: {e}") from e

    def of_kind(self, kind: str):
        """(relation id, part name) of all relations of a kind."""
        for rid, (k, target, external) in self.rels.items():
            if k == kind and not external:
                yield rid, posixpath.normpath(posixpath.join("word", target)) if not target.startswith("/") else target[1:]

    def images(self) -> list[tuple[str, str]]:
        """Distinct (mime, base64) pictures, first ones first."""
        out: dict[str, str] = {}
        for _, name in self.of_kind("image"):
            if name in self.zip.namelist():
                out.setdefault(base64.b64encode(self.zip.read(name)).decode(), MIME.get(name.rsplit(".", 1)[-1].lower(), "image/png"))
        return [(mime, data) for data, mime in out.items()]


def val(element, default: str | None = None) -> str | None:
    return default if element is None else element.get(f"{W}val", default)


def on(properties, name: str) -> bool:
    e = None if properties is None else properties.find(f"{W}{name}")
    return e is not None and e.get(f"{W}val", "1").lower() not in ("0", "false", "off", "none")


def decorate(text: str, properties) -> str:
    """Strike-through, underline, italics, bold, from the inside out."""
    if not text.strip():
        return text
    for name, before, after in (("strike", "~~", "~~"), ("u", "<u>", "</u>"), ("i", "*", "*"), ("b", "**", "**")):
        if on(properties, name):
            text = before + text + after
    return text


class Walker:
    """One pass over a package. Numbering is counted along the way."""

    def __init__(self, package: Package, options: Options):
        self.p, self.o = package, options
        self.counts: dict[tuple[str, int], int] = {}
        self.last: tuple[str | None, int] = (None, -1)
        self.tables = 0

    # ---- inside a paragraph: (plain text, Markdown, boxes, urls, notes, comments)

    def runs(self, element, state: dict) -> None:
        for e in element:
            tag = e.tag
            if tag in (f"{W}del", f"{W}moveFrom", f"{W}pPr", f"{W}rPr"):
                continue
            if tag == f"{W}r":
                self.run(e, state)
            elif tag == f"{W}hyperlink":
                self.link(e, state)
            elif tag == f"{W}fldSimple":
                if not self.is_page(e.get(f"{W}instr", "")):
                    self.runs(e, state)
            elif tag == f"{MC}AlternateContent":
                chosen = e.find(f"{MC}Choice")
                self.runs(chosen if chosen is not None else e.find(f"{MC}Fallback") or [], state)
            elif tag not in (f"{W}p", f"{W}tbl"):
                self.runs(e, state)

    @staticmethod
    def is_page(instruction: str) -> bool:
        return instruction.strip().split(" ")[0].upper() in PAGE_FIELDS if instruction.strip() else False

    def run(self, r, state) -> None:
        text = ""
        for e in r:
            tag = e.tag
            if tag == f"{W}fldChar":
                kind = e.get(f"{W}fldCharType")
                if kind == "begin":
                    state["fields"].append(["", False])
                elif kind == "separate" and state["fields"]:
                    state["fields"][-1][1] = True
                elif kind == "end" and state["fields"]:
                    state["fields"].pop()
            elif tag == f"{W}instrText" and state["fields"]:
                state["fields"][-1][0] += e.text or ""
            elif any(self.is_page(i) for i, _ in state["fields"]):
                continue
            elif tag == f"{W}t":
                text += e.text or ""
            elif tag in (f"{W}br", f"{W}cr"):
                text += "\n"
            elif tag == f"{W}footnoteReference" and self.o.footnotes:
                text += f"[Footnote {e.get(f'{W}id')}]"
                state["notes"].append(e.get(f"{W}id"))
            elif tag == f"{W}commentReference" and self.o.comments:
                text += f"[Comment {e.get(f'{W}id')}]"
                state["comments"].append(e.get(f"{W}id"))
            elif tag == f"{MC}AlternateContent" or tag in (f"{W}drawing", f"{W}pict"):
                if self.o.textboxes:
                    chosen = e.find(f"{MC}Choice") if tag == f"{MC}AlternateContent" else e
                    if chosen is None:
                        chosen = e.find(f"{MC}Fallback")
                    for box in (b for b in (chosen.iter() if chosen is not None else ()) if b.tag in (WPS_TXBX, VML_TXBX)):
                        for p in box.iter(f"{W}p"):
                            inner = self.content(p)
                            if inner["text"].strip():
                                state["boxes"].append(inner)
        state["text"] += text
        state["md"] += decorate(text, r.find(f"{W}rPr")) if self.o.inline else text

    def link(self, e, state) -> None:
        inner = self.fresh()
        self.runs(e, inner)
        target = self.p.rels.get(e.get(f"{R}id"), ("", "", False))
        state["text"] += inner["text"]
        if self.o.links and target[2] and inner["text"].strip():
            state["md"] += f"[{inner['md']}]({target[1]})"
            if target[1] not in state["urls"]:
                state["urls"].append(target[1])
        else:
            state["md"] += inner["md"]
        for k in ("boxes", "notes", "comments"):
            state[k] += inner[k]

    @staticmethod
    def fresh() -> dict:
        return {"text": "", "md": "", "boxes": [], "urls": [], "notes": [], "comments": [], "fields": []}

    def content(self, p) -> dict:
        state = self.fresh()
        self.runs(p, state)
        return state

    # ---- a paragraph

    def listing(self, p) -> tuple[str | None, int, str | None]:
        """(list id, level, number format) of a list item."""
        ppr = p.find(f"{W}pPr")
        num = None if ppr is None else ppr.find(f"{W}numPr")
        if num is None:
            return None, 0, None
        ident, level = val(num.find(f"{W}numId")), int(val(num.find(f"{W}ilvl"), "0") or 0)
        return (ident, level, self.p.lists.get((ident, level), "bullet")) if ident and ident != "0" else (None, 0, None)

    def numbered(self, ident: str, level: int) -> int:
        if self.last[0] != ident or level < self.last[1]:
            for key in [k for k in self.counts if k[0] == ident and k[1] > level]:
                del self.counts[key]
        self.counts[ident, level] = self.counts.get((ident, level), 0) + 1
        self.last = ident, level
        return self.counts[ident, level]

    def paragraph(self, p, extra: str = "", kind: str = "body", table: int | None = None) -> list[Part]:
        state = self.content(p)
        ppr = p.find(f"{W}pPr")
        style = self.p.styles.get(val(ppr.find(f"{W}pStyle")) if ppr is not None and ppr.find(f"{W}pStyle") is not None else "", None)
        style = " ".join(w[:1].upper() + w[1:] for w in (style or "Normal").split(" "))
        ident, level, form = self.listing(p)
        is_numbered = form in NUMBERED
        n = self.numbered(ident, level) if ident and is_numbered else 0
        out = []
        seen: set[str] = set()
        for box in [None, *state["boxes"]]:
            own = box or state
            text, md = own["text"].strip(), own["md"].strip()
            if not re.sub(r"[\s\x00-\x1f\x7f-\x9f]", "", text) or (box and text in seen):
                continue
            seen.add(text)
            bits = [f"Style: {style}", *(["Text Box"] if box else []), *([extra] if extra else [])]
            if not box:
                if ident:
                    bits += [f"List Type: {'Numbered' if is_numbered else 'Bullet'}", f"List Level: {level}", f"List Format: {form[:1].upper() + form[1:]}", f"List ID: {ident}"]
                heading = re.match(r"(?i)heading\D*(\d+)?", style)
                if heading:
                    md = "#" * int(heading[1] or 1) + " " + md
                elif ident:
                    md = "    " * level + (f"{n}. " if is_numbered else "- ") + md
            bits += [f"Link URL: {u}" for u in own["urls"]]
            bits += [f"Footnote: {x}" for x in own["notes"]] + [f"Comment: {x}" for x in own["comments"]]
            out.append(Part(text, md, ", ".join(bits), kind, table))
        return out

    # ---- tables, body, other parts

    def table(self, t, outer: str = "", top: bool = True) -> tuple[list[Part], str]:
        """Cells' paragraphs, and the table as Markdown with padded columns."""
        self.tables += 1
        number, parts, grid = self.tables, [], []
        for i, row in enumerate(t.findall(f"{W}tr"), 1):
            cells = []
            for j, cell in enumerate(row.findall(f"{W}tc"), 1):
                merge = cell.find(f"{W}tcPr/{W}vMerge")
                lines = []
                if merge is None or merge.get(f"{W}val") == "restart":
                    where = f"Table ID: {number}, Row: {i}, Column: {j}, Table Cell"
                    for e in self.flow(cell):
                        if e.tag == f"{W}p":
                            got = self.paragraph(e, where + outer, "table", number)
                            parts += got
                            lines += [g.md for g in got]
                        elif e.tag == f"{W}tbl":
                            got, md = self.table(e, f", Nested In Table: {number}", False)
                            parts += got
                            lines.append(md)
                cells.append("\n".join(lines))
            grid.append(cells)
        width = [max((len(r[c]) for r in grid if c < len(r)), default=0) for c in range(max(map(len, grid), default=0))]
        line = lambda r: "| " + " | ".join(c.ljust(width[i]) for i, c in enumerate(r)) + " |"
        rows = [line(r) for r in grid]
        if grid:
            rows.insert(1, "| " + " | ".join("-" * max(1, width[i]) for i in range(len(grid[0]))) + " |")
        return parts, "\n".join(rows)

    def flow(self, element):
        """Paragraphs and tables in order, through content controls; deleted and moved-away ones are left out."""
        for e in element:
            if e.tag in (f"{W}p", f"{W}tbl"):
                yield e
            elif e.tag in (f"{W}sdt", f"{W}sdtContent", f"{W}ins", f"{W}moveTo", f"{W}customXml", f"{W}smartTag"):
                yield from self.flow(e)

    def block(self, element, extra: str = "", kind: str = "body", label: str = "") -> list[Part]:
        out = []
        for e in self.flow(element):
            try:
                if e.tag == f"{W}p":
                    got = self.paragraph(e, extra, kind)
                elif self.o.tables:
                    got, md = self.table(e)
                    if got:
                        got[0].md, rest = md, got[1:]
                        for g in rest:
                            g.md = ""  # the whole table stands in the Markdown of its first paragraph
                else:
                    got = []
            except DocxError:
                raise
            except Exception as x:
                if self.o.strict:
                    raise DocxContentError(str(x)) from x
                continue
            if label:
                for g in got:
                    g.md = f"**{label}**: {g.md}"
            out += got
        return out

    def all(self) -> list[Part]:
        """Headers, body, footnotes, comments, footers."""
        out: list[Part] = []
        if self.o.headers:
            for rid, name in self.p.of_kind("header"):
                out += self.block(self.p.xml(name), f"Header ID: {rid}", "header", "Header")
        out += self.block(self.p.main.find(f"{W}body"))
        if self.o.footnotes and (root := self.p.xml("word/footnotes.xml", True)) is not None:
            for f in root.iter(f"{W}footnote"):
                if (ident := f.get(f"{W}id")) not in ("-1", "0"):
                    out += self.block(f, f"Footnote ID: {ident}", "footnote", f"Footnote {ident}")
        if self.o.comments and (root := self.p.xml("word/comments.xml", True)) is not None:
            for c in root.iter(f"{W}comment"):
                who, when = c.get(f"{W}author", ""), c.get(f"{W}date", "")
                about = f"Comment ID: {c.get(f'{W}id')}, Author: {who}" + (f", Date: {when}" if when else "")
                out += self.block(c, about, "comment", f"Comment {c.get(f'{W}id')} (by {who})")
        if self.o.footers:
            for rid, name in self.p.of_kind("footer"):
                out += self.block(self.p.xml(name), f"Footer ID: {rid}", "footer", "Footer")
        return out


def parts(data: bytes, options: Options | None = None) -> list[Part]:
    return Walker(Package.open(data), options or Options()).all()


def as_text(data: bytes, markdown: bool = True, options: Options | None = None) -> str:
    """The whole file as Markdown or plain text, paragraphs an empty line apart."""
    found = parts(data, options)
    return "\n\n".join(x for x in ((p.md if markdown else p.text) for p in found) if x)


def read(spark, path: str, options: Options | None = None) -> DataFrame:
    """(path, para_idx, kind, raw_text, md_text, additional_context, error) of all .docx files below a path.

    A file that cannot be read gives one row with its error, or fails the job if ``options.strict``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return converted(files.select("path", "content"), options)


def converted(files: DataFrame, options: Options | None = None) -> DataFrame:
    runtime.prepare(files.sparkSession)
    options = options or Options()
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def work(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    found = parts(row["content"], options)
                except DocxError as e:
                    if options.strict:
                        raise
                    out.append({"path": row["path"], "error": f"{type(e).__name__}: {e}"})
                    continue
                out += [{"path": row["path"], "para_idx": i, "kind": p.kind, "raw_text": p.text, "md_text": p.md, "additional_context": p.context} for i, p in enumerate(found)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.mapInArrow(work, SCHEMA)


def images(spark, path: str) -> DataFrame:
    """(path, img_idx, mime_type, base64, error) of the distinct pictures of each file; a file that cannot be read is one row with its error."""
    return pictures(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path))


def pictures(files: DataFrame) -> DataFrame:
    """``images`` of a table (path, content)."""
    runtime.prepare(files.sparkSession)
    ddl = "path string, img_idx int, mime_type string, base64 string, error string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def work(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    out += [{"path": r["path"], "img_idx": i, "mime_type": m, "base64": d} for i, (m, d) in enumerate(Package.open(r["content"]).images())]
                except DocxError as e:
                    out.append({"path": r["path"], "error": f"{type(e).__name__}: {e}"})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("path", "content").mapInArrow(work, ddl)


def documents(files: DataFrame, options: Options | None = None) -> DataFrame:
    """One document a file (path, content): (path, raw_text, md_text, paras, md_paras, images, error), ready for extraction."""
    runtime.prepare(files.sparkSession)
    options = options or Options()
    ddl = "path string, raw_text string, md_text string, paras array<string>, md_paras array<string>, images array<struct<mime:string,data:string>>, error string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def work(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    held = Package.open(row["content"])
                    found = Walker(held, options).all()
                    pictures = [{"mime": m, "data": d} for m, d in held.images()] if options.images else []
                except DocxError as e:
                    if options.strict:
                        raise
                    out.append({"path": row["path"], "error": f"{type(e).__name__}: {e}"})
                    continue
                join = lambda texts: "\n\n".join(t for t in texts if t)
                out.append({"path": row["path"], "raw_text": join(p.text for p in found), "md_text": join(p.md for p in found), "paras": [p.text for p in found], "md_paras": [p.md or None for p in found], "images": pictures})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("path", "content").mapInArrow(work, ddl)


def whole_texts(found: DataFrame, markdown: bool = True) -> DataFrame:
    """(path, text) from the rows of ``read``."""
    column = "md_text" if markdown else "raw_text"
    listed = F.array_sort(F.collect_list(F.when(F.length(column) > 0, F.struct("para_idx", column)))).alias("listed")
    return found.where("error IS NULL").groupBy("path").agg(listed).select("path", F.array_join(F.transform("listed", lambda p: p[column]), "\n\n").alias("text"))
