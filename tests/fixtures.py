"""Small files made with the standard library."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib


def zipped(files: dict[str, str | bytes], stored: tuple[str, ...] = ()) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="%s"' % _REL
PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 7, 5, 8, 2, 0, 0, 0) + b"\0\0\0\0"
PNG += (lambda b: struct.pack(">I", len(b)) + b"tEXt" + b + b"\0\0\0\0")(b"Title\0A picture")


def docx() -> bytes:
    def p(text: str, style: str = "", props: str = "") -> str:
        style = f'<w:pStyle w:val="{style}"/>' if style else ""
        return f"<w:p><w:pPr>{style}{props}</w:pPr>{text}</w:p>"

    def r(text: str, props: str = "") -> str:
        return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'

    def item(text: str, level: int, num: int) -> str:
        return p(r(text), props=f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>')

    cells = lambda *ts: "<w:tr>" + "".join(f"<w:tc>{p(r(t))}</w:tc>" for t in ts) + "</w:tr>"
    math = '<m:oMathPara><m:oMath><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f></m:oMath></m:oMathPara>'
    inline = "<m:oMath><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath>"
    body = "".join([
        p(r("The Title"), "H1"), p(r("A ") + r("bold", "<w:b/>") + r(" and ") + r("slanted", "<w:i/>") + r(" word.")),
        p('<w:hyperlink r:id="rL">' + r("a link") + "</w:hyperlink>"), p(r("Part"), "H2"), item("one", 0, 1), item("inner", 1, 1), item("first", 0, 2), item("second", 0, 2),
        "<w:tbl>" + cells("k", "v") + cells("a|b", "2") + "</w:tbl>", p('<w:r><w:drawing><a:blip r:embed="rI"/></w:drawing></w:r>'), p(math), p(inline), p(r("noted") + '<w:r><w:commentReference w:id="0"/></w:r>'),
    ])
    return zipped({
        "[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {_W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {_W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num></w:numbering>',
        "word/comments.xml": f'<w:comments {_W}><w:comment w:id="0" w:author="Ann"><w:p><w:r><w:t>why so</w:t></w:r></w:p></w:comment></w:comments>',
        "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rL" Target="https://x.example/" TargetMode="External"/><Relationship Id="rI" Target="media/i.png"/></Relationships>',
        "word/media/i.png": PNG,
    })


def xlsx() -> bytes:
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>when</t></is></c></row><row r="3"><c r="A3"><v>1.5</v></c><c r="B3" s="1"><v>45000</v></c><c r="C3" t="b"><v>1</v></c></row></sheetData></worksheet>'
    return zipped({
        "[Content_Types].xml": "<Types/>", "xl/workbook.xml": f'<workbook xmlns:r="{_REL}"><sheets><sheet name="Data" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>x|y</t></si></sst>", "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>', "xl/worksheets/sheet1.xml": sheet,
    })


def ods() -> bytes:
    body = '<d xmlns:t="urn:t" xmlns:x="urn:x"><t:table t:name="S"><t:table-row><t:table-cell><x:p>a</x:p></t:table-cell><t:table-cell t:number-columns-repeated="2"><x:p>b</x:p></t:table-cell></t:table-row><t:table-row t:number-rows-repeated="1000"><t:table-cell t:number-columns-repeated="1000"/></t:table-row></t:table></d>'
    return zipped({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": body}, ("mimetype",))


def pptx() -> bytes:
    def shape(text: str, y: int, kind: str = "") -> str:
        return f'<p:sp><p:nvSpPr><p:cNvPr name="n"/><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="5" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'

    ns = f'xmlns:p="urn:p" xmlns:a="urn:a" xmlns:r="{_REL}" xmlns:c="urn:c"'
    table = '<p:graphicFrame><p:xfrm><a:off x="5" y="300"/></p:xfrm><a:tbl><a:tr><a:tc><p:txBody><a:p><a:r><a:t>h</a:t></a:r></a:p></p:txBody></a:tc></a:tr><a:tr><a:tc><p:txBody><a:p><a:r><a:t>v</a:t></a:r></a:p></p:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>'
    chart = '<p:graphicFrame><p:xfrm><a:off x="5" y="400"/></p:xfrm><c:chart r:id="rC"/></p:graphicFrame>'
    pic = '<p:pic><p:nvPicPr><p:cNvPr name="Picture 4" descr="a [cat]"/></p:nvPicPr><p:blipFill><a:blip r:embed="rI"/></p:blipFill><p:spPr><a:xfrm><a:off x="5" y="500"/></a:xfrm></p:spPr></p:pic>'
    slide = f"<p:sld {ns}><p:cSld><p:spTree>{shape('below', 200)}{shape('Headline', 100, '<p:ph type=' + chr(34) + 'title' + chr(34) + '/>')}{table}{chart}{pic}</p:spTree></p:cSld></p:sld>"
    data = '<c:ser><c:tx><c:pt idx="0"><c:v>Sales</c:v></c:pt></c:tx><c:cat><c:pt idx="0"><c:v>2003</c:v></c:pt></c:cat><c:val><c:pt idx="0"><c:v>7</c:v></c:pt></c:val></c:ser>'
    return zipped({
        "[Content_Types].xml": "<Types/>", "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/></Relationships>', "ppt/slides/slide1.xml": slide,
        "ppt/slides/_rels/slide1.xml.rels": '<Relationships><Relationship Id="rC" Target="../charts/chart1.xml"/><Relationship Id="rI" Target="../media/i.png"/><Relationship Id="rN" Target="../notesSlides/n1.xml"/></Relationships>',
        "ppt/charts/chart1.xml": f"<c:chartSpace {ns}><c:chart><c:title><a:t>Growth</a:t></c:title><c:plotArea>{data}</c:plotArea></c:chart></c:chartSpace>", "ppt/media/i.png": PNG,
        "ppt/notesSlides/n1.xml": f"<p:notes {ns}>{shape('remember', 1, '<p:ph type=' + chr(34) + 'body' + chr(34) + '/>')}</p:notes>",
    })


def epub() -> bytes:
    opf = '<package xmlns:dc="urn:dc"><metadata><dc:title>A Book</dc:title><dc:creator>Ann</dc:creator><dc:creator>Bob</dc:creator></metadata><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="gone"/></spine></package>'
    return zipped({"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>', "O/c.opf": opf, "O/a.xhtml": "<html><body><h1>One</h1><ul><li>item</li></ul></body></html>", "O/b.xhtml": "<html><body><p><b>b</b> <i>i</i></p><blockquote>quote</blockquote></body></html>"}, ("mimetype",))


def pdf(*contents: bytes, packed: bool = True) -> bytes:
    objs: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>"]
    kids = []
    for c in contents:
        body = zlib.compress(c) if packed else c
        objs.append(b"<< /Length %d%s >>\nstream\n" % (len(body), b" /Filter /FlateDecode" if packed else b"") + body + b"\nendstream")
        objs.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % len(objs))
        kids.append(len(objs))
    objs[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objs, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


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


def xls() -> bytes:
    def record(kind: int, body: bytes) -> bytes:
        return struct.pack("<HH", kind, len(body)) + body

    bof = lambda what: record(0x809, struct.pack("<HHHHII", 0x600, what, 0, 0, 0, 0))
    strings = record(0xFC, struct.pack("<II", 2, 2) + b"".join(struct.pack("<HB", len(s), 0) + s for s in (b"Name", b"Ann")))
    sheet = bof(0x10) + record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 1, 0, 0, 1)) + record(0x203, struct.pack("<HHHd", 0, 1, 0, 2.5)) + record(0x27E, struct.pack("<HHHI", 1, 1, 0, 30 << 2 | 2)) + record(0x0A, b"")
    head = lambda at: bof(5) + record(0x85, struct.pack("<IBBBB", at, 0, 0, 3, 0) + b"Tab") + strings + record(0x0A, b"")
    return compound({"Workbook": head(len(head(0))) + sheet})


def msg() -> bytes:
    text = lambda s: s.encode("utf-16-le")
    pad = lambda s: text(s + " " * (2100 - len(s)))
    return compound({"__properties_version1.0": b"\0" * 32, "__substg1.0_0037001F": pad("Hello"), "__substg1.0_0C1F001F": pad("a@x.example"), "__substg1.0_0E04001F": pad("b@x.example"), "__substg1.0_1000001F": pad("The body.")})


def wav() -> bytes:
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 2, 44100, 176400, 4, 16)
    data = struct.pack("<4sI", b"data", 176400) + b"\0" * 64
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + fmt + data


def mobi(text: str = "<html><body><p>Once upon.</p></body></html>") -> bytes:
    body, title = text.encode(), b"Tale"
    head = bytearray(300)
    head[:16] = struct.pack(">HHIHHHH", 1, 0, len(body), 1, 4096, 0, 0)
    head[16:20], head[20:24], head[28:32], head[84:92] = b"MOBI", struct.pack(">I", 232), struct.pack(">I", 65001), struct.pack(">II", 260, len(title))
    head[260:264] = title
    start = 78 + 16 + 2
    return b"x".ljust(60, b"\0") + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", 2) + struct.pack(">II", start, 0) + struct.pack(">II", start + 300, 0) + b"\0\0" + bytes(head) + body
