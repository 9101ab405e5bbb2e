"""Small files of the formats that are read, written from rows; for queries and demonstrations."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def packed(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def workbook(name: str, rows: list[list[str]]) -> bytes:
    """One sheet of texts."""
    cells = lambda r: "".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in r)
    return packed({
        "[Content_Types].xml": "<Types/>", "xl/workbook.xml": f'<workbook xmlns:r="{_REL}"><sheets><sheet name="{escape(name)}" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": "<worksheet><sheetData>" + "".join(f"<row>{cells(r)}</row>" for r in rows) + "</sheetData></worksheet>",
    })


def open_sheet(name: str, rows: list[list[str]]) -> bytes:
    cells = lambda r: "".join(f"<t:table-cell><x:p>{escape(c)}</x:p></t:table-cell>" for c in r)
    body = "".join(f"<t:table-row>{cells(r)}</t:table-row>" for r in rows)
    return packed({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": f'<d xmlns:t="urn:t" xmlns:x="urn:x"><t:table t:name="{escape(name)}">{body}</t:table></d>'})


def letter(title: str, items: list[str], rows: list[list[str]]) -> bytes:
    """A heading, a list and a table."""
    p = lambda t, props="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    lines = "".join(p(t, '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>') for t in items)
    cells = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    heading = p(title, '<w:pStyle w:val="Heading1"/>')
    return packed({"[Content_Types].xml": "<Types/>", "word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{heading}{lines}<w:tbl>{cells}</w:tbl></w:body></w:document>'})


def deck(slides: list[tuple[str, str]]) -> bytes:
    """Slides of a title and a text."""
    ns = f'xmlns:p="urn:p" xmlns:a="urn:a" xmlns:r="{_REL}"'
    shape = lambda t, y, kind: f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="1" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:txBody></p:sp>'
    files = {"[Content_Types].xml": "<Types/>", "ppt/presentation.xml": f"<p:presentation {ns}><p:sldIdLst>" + "".join(f'<p:sldId r:id="s{i}"/>' for i in range(len(slides))) + "</p:sldIdLst></p:presentation>"}
    files["ppt/_rels/presentation.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="s{i}" Target="slides/slide{i}.xml"/>' for i in range(len(slides))) + "</Relationships>"
    for i, (title, text) in enumerate(slides):
        files[f"ppt/slides/slide{i}.xml"] = f"<p:sld {ns}><p:cSld><p:spTree>{shape(text, 9, '')}{shape(title, 1, '<p:ph type=' + chr(34) + 'title' + chr(34) + '/>')}</p:spTree></p:cSld></p:sld>"
    return packed(files)


def book(title: str, author: str, chapters: list[tuple[str, str]]) -> bytes:
    names = [f"c{i}.xhtml" for i in range(len(chapters))]
    items = "".join(f'<item id="{n}" href="{n}"/>' for n in names)
    spine = "".join(f'<itemref idref="{n}"/>' for n in names)
    files = {"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfile full-path="b.opf"/></container>'}
    files["b.opf"] = f'<package xmlns:dc="urn:dc"><metadata><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>'
    for n, (head, body) in zip(names, chapters, strict=True):
        files[n] = f"<html><body><h2>{escape(head)}</h2><p>{escape(body)}</p></body></html>"
    return packed(files)


def feed(title: str, about: str, items: list[tuple[str, str, str]]) -> bytes:
    body = "".join(f"<item><title>{escape(t)}</title><pubDate>{escape(d)}</pubDate><description>{escape(escape(x))}</description></item>" for t, d, x in items)
    return f'<?xml version="1.0"?><rss version="2.0"><channel><title>{escape(title)}</title><description>{escape(about)}</description>{body}</channel></rss>'.encode()


def records(name: str, rows: list[dict[str, str]]) -> bytes:
    body = "".join(f'<row id="{escape(r["id"])}">' + "".join(f"<{k}>{escape(v)}</{k}>" for k, v in r.items() if k != "id") + "</row>" for r in rows)
    return f"<{name}>{body}</{name}>".encode()


def form(rows: list[list[str]], columns: list[int]) -> bytes:
    """A PDF page of texts at fixed columns, a row every 15 points."""
    put = lambda t, x, y: b"BT /F1 9 Tf %d %d Td (%s) Tj ET\n" % (x, y, t.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)"))
    body = zlib.compress(b"".join(put(t, x, 740 - 15 * i) for i, r in enumerate(rows) for t, x in zip(r, columns, strict=True)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [4 0 R] >>", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 5 0 R /Resources << /Font << /F1 3 0 R >> >> >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def web_archive(title: str, body: str) -> bytes:
    import quopri

    page = quopri.encodestring(f"<html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><p>{escape(body)}</p></body></html>".encode())
    head = b"From: folio\r\nMIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=part\r\n\r\n--part\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n"
    return head + page + b"\r\n--part--\r\n"


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with the streams in its root, all as large streams."""
    sector = 512
    chunks: list[bytes] = []
    entries = []
    fat: list[int] = []
    for name, data in streams.items():
        data = data.ljust(4096, b"\0") if len(data) < 4096 else data
        n = -(-len(data) // sector)
        start = len(chunks)
        chunks += [data[i * sector : (i + 1) * sector].ljust(sector, b"\0") for i in range(n)]
        fat += [*range(start + 1, start + n), 0xFFFFFFFE]
        entries.append((name, start, len(data)))

    def entry(name: str, kind: int, left: int, right: int, child: int, start: int, size: int) -> bytes:
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    none = 0xFFFFFFFF
    table = entry("Root Entry", 5, none, none, 1 if entries else none, 0xFFFFFFFE, 0)
    for i, (name, start, size) in enumerate(entries, 1):
        table += entry(name, 2, none, i + 1 if i < len(entries) else none, none, start, size)
    directory = len(chunks)
    n = -(-len(table) // sector)
    chunks += [table[i * sector : (i + 1) * sector].ljust(sector, b"\0") for i in range(n)]
    fat += [*range(directory + 1, directory + n), 0xFFFFFFFE]
    n_fat = -(-(len(fat) + 8) // 128)
    first_fat = len(chunks)
    fat += [0xFFFFFFFD] * n_fat
    fat += [none] * (n_fat * 128 - len(fat))
    chunks += [struct.pack("<128I", *fat[i * 128 : (i + 1) * 128]) for i in range(n_fat)]
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, n_fat, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    difat = [first_fat + i for i in range(n_fat)] + [none] * (109 - n_fat)
    return head + struct.pack("<109I", *difat) + b"".join(chunks)


def old_workbook(sheet: str, rows: list[list[str | float]]) -> bytes:
    """A workbook of the binary format, with its strings in the shared table."""
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    begin = lambda what: record(0x809, struct.pack("<HHHHII", 0x600, what, 0, 0, 0, 0))
    texts = [v for r in rows for v in r if isinstance(v, str)]
    strings = record(0xFC, struct.pack("<II", len(texts), len(texts)) + b"".join(struct.pack("<HB", len(t), 0) + t.encode("latin-1") for t in texts))
    cells, k = b"", 0
    for i, r in enumerate(rows):
        for j, v in enumerate(r):
            if isinstance(v, str):
                cells, k = cells + record(0xFD, struct.pack("<HHHI", i, j, 0, k)), k + 1
            else:
                cells += record(0x203, struct.pack("<HHHd", i, j, 0, v))
    name = struct.pack("<BB", len(sheet), 0) + sheet.encode("latin-1")
    head = lambda at: begin(5) + record(0x85, struct.pack("<IBB", at, 0, 0) + name) + strings + record(0x0A, b"")
    return compound({"Workbook": head(len(head(0))) + begin(0x10) + cells + record(0x0A, b"")})


def mail(subject: str, sender: str, to: str, body: str) -> bytes:
    """A message file; texts are padded with blanks to the length of a large stream."""
    padded = lambda t: (t + " " * (2100 - len(t))).encode("utf-16-le")
    parts = {"0037": subject, "0C1F": sender, "0E04": to, "1000": body}
    return compound({"__properties_version1.0": b"\0" * 32} | {f"__substg1.0_{k}001F": padded(v) for k, v in parts.items()})


def mobi(title: str, html: str) -> bytes:
    """A book of one uncompressed record."""
    body, name = html.encode(), title.encode()
    head = bytearray(300)
    struct.pack_into(">HHIHHHH", head, 0, 1, 0, len(body), 1, 4096, 0, 0)
    struct.pack_into(">4sI", head, 16, b"MOBI", 232)
    struct.pack_into(">I", head, 28, 65001)
    struct.pack_into(">II", head, 84, 260, len(name))
    head[260 : 260 + len(name)] = name
    start = 78 + 2 * 8 + 2
    return b"book".ljust(60, b"\0") + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">HIIII", 2, start, 0, start + len(head), 0) + b"\0\0" + bytes(head) + body


def prose(title: str, lines: list[str]) -> bytes:
    """A PDF page with a large title and lines of text below."""
    put = lambda t, size, y: b"BT /F1 %d Tf 72 %d Td (%s) Tj ET\n" % (size, y, t.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)"))
    body = zlib.compress(put(title, 20, 740) + b"".join(put(t, 10, 700 - 12 * i) for i, t in enumerate(lines)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [4 0 R] >>", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 5 0 R /Resources << /Font << /F1 3 0 R >> >> >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def equation(numerator: str, denominator: str, before: str) -> bytes:
    """A letter of one paragraph: a text, and a fraction."""
    run = lambda t: f"<m:r><m:t>{escape(t)}</m:t></m:r>"
    math = f"<m:oMath><m:f><m:num>{run(numerator)}</m:num><m:den>{run(denominator)}</m:den></m:f></m:oMath>"
    spaces = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    return packed({"word/document.xml": f"<w:document {spaces}><w:body><w:p><w:r><w:t xml:space='preserve'>{escape(before)} </w:t></w:r>{math}</w:p></w:body></w:document>"})

