"""Word files as a sink: blocks to WordprocessingML packages with the standard library.

``paragraph``, ``table`` and the other functions give XML of one block each; ``package`` puts
blocks, headers, footers, notes, comments, links, lists and pictures into the bytes of a file.
Characters that XML cannot hold are left out.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

# Fixed values of the format.
NS = (
    'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
    'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:wps="http://schemas.microsoft.com/office/word/2010/wordprocessingShape" xmlns:v="urn:schemas-microsoft-com:vml"'
)
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
MARKS = {"bold": "b", "italic": "i", "underline": "u", "strike": "strike"}


def text_of(text: str) -> str:
    return escape(FORBIDDEN.sub("", text))


def run(text: str, *marks: str) -> str:
    """A run with some of bold, italic, underline and strike."""
    props = "".join(f'<w:{MARKS[m]}{" w:val=" + chr(34) + "single" + chr(34) if m == "underline" else ""}/>' for m in marks)
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text_of(text)}</w:t></w:r>'


def link(text: str, rel: str) -> str:
    return f"<w:hyperlink r:id={quoteattr(rel)}>{run(text)}</w:hyperlink>"


def note(kind: str, ident: int) -> str:
    """A reference to a footnote or comment."""
    return f'<w:r><w:{kind}Reference w:id="{ident}"/></w:r>'


def deleted(text: str) -> str:
    """A run that a tracked change has taken out."""
    return f'<w:del w:id="1" w:author="x"><w:r><w:delText>{text_of(text)}</w:delText></w:r></w:del>'


def page_field(shown: str) -> str:
    """A page number with the text that was shown last."""
    mark = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    return f'{mark("begin")}<w:r><w:instrText xml:space="preserve"> PAGE </w:instrText></w:r>{mark("separate")}{run(shown)}{mark("end")}'


def text_box(blocks: str) -> str:
    """A text box, in the new form and once more in the old one for old readers."""
    new = f"<mc:Choice Requires=\"wps\"><w:drawing><wps:wsp><wps:txbx><w:txbxContent>{blocks}</w:txbxContent></wps:txbx></wps:wsp></w:drawing></mc:Choice>"
    old = f"<mc:Fallback><w:pict><v:textbox><w:txbxContent>{blocks}</w:txbxContent></v:textbox></w:pict></mc:Fallback>"
    return f"<w:r><mc:AlternateContent>{new}{old}</mc:AlternateContent></w:r>"


def paragraph(*content: str, style: str | None = None, item: tuple[int, int] | None = None) -> str:
    """A paragraph of runs; ``item``: (list number, level)."""
    props = f"<w:pStyle w:val={quoteattr(style)}/>" if style else ""
    props += f'<w:numPr><w:ilvl w:val="{item[1]}"/><w:numId w:val="{item[0]}"/></w:numPr>' if item else ""
    return f"<w:p><w:pPr>{props}</w:pPr>{''.join(content)}</w:p>"


def table(rows: list[list[str]]) -> str:
    """Rows of cells, each cell's blocks as XML."""
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"


def package(
    body: str,
    headers: tuple[str, ...] = (),
    footers: tuple[str, ...] = (),
    footnotes: dict[int, str] | None = None,
    comments: tuple[tuple[int, str, str, str], ...] = (),
    links: dict[str, str] | None = None,
    styles: dict[str, str] | None = None,
    lists: dict[int, tuple[str, ...]] | None = None,
    pictures: tuple[tuple[str, bytes], ...] = (),
) -> bytes:
    """The bytes of a file. ``comments``: (id, author, date, blocks); ``lists``: number -> format of each level; ``pictures``: (name, bytes)."""
    parts = {"word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>"}
    rels = [(r, "hyperlink", u, True) for r, u in (links or {}).items()]
    for kind, tag, given in (("header", "hdr", headers), ("footer", "ftr", footers)):
        for i, blocks in enumerate(given, 1):
            parts[f"word/{kind}{i}.xml"] = f"<w:{tag} {NS}>{blocks}</w:{tag}>"
            rels.append((f"r{kind}{i}", kind, f"{kind}{i}.xml", False))
    rels += [(f"rimage{i}", "image", f"media/{name}", False) for i, (name, _) in enumerate(pictures, 1)]
    if footnotes:
        parts["word/footnotes.xml"] = f"<w:footnotes {NS}>" + "".join(f'<w:footnote w:id="{i}">{b}</w:footnote>' for i, b in footnotes.items()) + "</w:footnotes>"
        rels.append(("rnotes", "footnotes", "footnotes.xml", False))
    if comments:
        parts["word/comments.xml"] = f"<w:comments {NS}>" + "".join(f'<w:comment w:id="{i}" w:author={quoteattr(a)} w:date={quoteattr(d)}>{b}</w:comment>' for i, a, d, b in comments) + "</w:comments>"
        rels.append(("rcomments", "comments", "comments.xml", False))
    if styles:
        parts["word/styles.xml"] = f"<w:styles {NS}>" + "".join(f"<w:style w:styleId={quoteattr(i)}><w:name w:val={quoteattr(n)}/></w:style>" for i, n in styles.items()) + "</w:styles>"
        rels.append(("rstyles", "styles", "styles.xml", False))
    if lists:
        level = lambda i, form: f'<w:lvl w:ilvl="{i}"><w:numFmt w:val={quoteattr(form)}/></w:lvl>'
        kinds = "".join(f'<w:abstractNum w:abstractNumId="{n}">{"".join(level(i, f) for i, f in enumerate(forms))}</w:abstractNum>' for n, forms in lists.items())
        nums = "".join(f'<w:num w:numId="{n}"><w:abstractNumId w:val="{n}"/></w:num>' for n in lists)
        parts["word/numbering.xml"] = f"<w:numbering {NS}>{kinds}{nums}</w:numbering>"
        rels.append(("rlists", "numbering", "numbering.xml", False))
    rows = "".join(f"<Relationship Id={quoteattr(r)} Type={quoteattr(f'{REL}/{kind}')} Target={quoteattr(target)}{' TargetMode=' + quoteattr('External') if out else ''}/>" for r, kind, target, out in rels)
    parts["word/_rels/document.xml.rels"] = f'<Relationships xmlns="{PACKAGE}/relationships">{rows}</Relationships>'
    parts["_rels/.rels"] = f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{REL}/officeDocument" Target="word/document.xml"/></Relationships>'
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    kinds = {"document": "document.main", "styles": "styles", "numbering": "numbering", "footnotes": "footnotes", "comments": "comments"}
    types = "".join(f'<Override PartName="/{n}" ContentType="{main}.{kinds.get(n[5:-4], n[5:11])}+xml"/>' for n in parts if n.startswith("word/") and n.endswith(".xml"))
    defaults = "".join(f'<Default Extension="{e}" ContentType="{t}"/>' for e, t in (("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("xml", "application/xml"), ("png", "image/png"), ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("webp", "image/webp")))
    parts["[Content_Types].xml"] = f'<Types xmlns="{PACKAGE}/content-types">{defaults}{types}</Types>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        for name, data in pictures:
            z.writestr(zipfile.ZipInfo(f"word/media/{name}"), data)
    return out.getvalue()
