"""Word, Excel, OpenDocument and PowerPoint files."""

from __future__ import annotations

import base64
import datetime as dt
import posixpath
import re
from xml.etree.ElementTree import Element

from folio.converters.archive import Container
from folio.converters.omml import children as math
from folio.converters.xmltree import safe_xml
from folio.plans.detect import MIME_OF, extension
from folio.plans.model import ConversionError, Info, Options, Result, asked
from folio.render.table_md import table

_DEPTH = 4000


def _xml(zip_: Container, name: str) -> Element | None:
    data = zip_.read(name)
    return None if data is None else safe_xml(data, _DEPTH)


def _relations(zip_: Container, part: str) -> dict[str, str]:
    """Target of each relation of a part, as a path in the container or an address."""
    folder, name = posixpath.split(part)
    root = _xml(zip_, f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
    out = {}
    for r in root if root is not None else []:
        target = r.attrib.get("Target", "")
        inside = r.attrib.get("TargetMode") != "External"
        out[r.attrib.get("Id", "")] = posixpath.normpath(posixpath.join("/" + folder, target)).lstrip("/") if inside else target
    return out


def data_uri(data: bytes, name: str, keep: bool) -> str:
    mime = MIME_OF.get(extension(name) or "", "image/png")
    return f"data:{mime};base64,{base64.b64encode(data).decode()}" if keep else f"data:{mime};base64..."


# -- Word ---------------------------------------------------------------------------------------


class _Word:
    def __init__(self, data: bytes, options: Options):
        self.zip, self.options = Container(data), options
        main = next((t for t in _relations(self.zip, "").values() if t.endswith("document.xml")), "word/document.xml")
        root = _xml(self.zip, main)
        if root is None:
            raise ConversionError("no word/document.xml")
        self.body = root.find("body")
        self.body = root if self.body is None else self.body
        self.links = _relations(self.zip, main)
        styles = _xml(self.zip, "word/styles.xml")
        self.styles = {s.attrib.get("styleId", ""): n.attrib.get("val", "").lower() for s in (styles if styles is not None else []) if s.tag == "style" and (n := s.find("name")) is not None}
        self.ordered = self._numbered()
        self.counts: dict[tuple[str, int], int] = {}
        self.notes: list[str] = []
        self.degraded = False

    def _numbered(self) -> dict[tuple[str, int], bool]:
        """Which levels of which lists are numbers."""
        root = _xml(self.zip, "word/numbering.xml")
        if root is None:
            return {}
        kinds = {}
        for a in root.findall("abstractNum"):
            for level in a.findall("lvl"):
                f = level.find("numFmt")
                kinds[a.attrib.get("abstractNumId", ""), int(level.attrib.get("ilvl", 0))] = f is not None and f.attrib.get("val") not in ("bullet", "none")
        out = {}
        for n in root.findall("num"):
            a = n.find("abstractNumId")
            for (aid, level), is_number in kinds.items():
                if a is not None and a.attrib.get("val") == aid:
                    out[n.attrib.get("numId", ""), level] = is_number
        return out

    def heading(self, p: Element) -> int:
        style = p.find("pPr/pStyle")
        name = self.styles.get(style.attrib.get("val", ""), style.attrib.get("val", "").lower()) if style is not None else ""
        m = re.fullmatch(r"heading ?([1-9])", name)
        return 1 if name == "title" else min(6, int(m[1])) if m else 0

    @staticmethod
    def _on(run: Element, name: str) -> bool:
        e = run.find(f"rPr/{name}")
        return e is not None and e.attrib.get("val", "1") not in ("0", "false", "none")

    def image(self, rid: str, alt: str) -> str:
        target = self.links.get(rid, "")
        data = self.zip.read(target)
        if data is None:
            return ""
        if text := asked(self.options.hooks, "ocr", data):
            return f"*[Image OCR]\n{text}\n[End OCR]*"
        return f"![{alt}]({data_uri(data, target, self.options.keep_data_uris)})"

    def run(self, r: Element) -> str:
        out = []
        for e in r:
            if e.tag in ("t", "delText"):
                out.append(e.text or "")
            elif e.tag in ("br", "cr"):
                out.append(" ")
            elif e.tag == "tab":
                out.append("\t")
            elif e.tag == "noBreakHyphen":
                out.append("-")
            elif e.tag in ("drawing", "pict", "object", "AlternateContent"):
                alt = next((d.attrib.get("descr") or "" for d in e.iter("docPr")), "")
                rids = dict.fromkeys(b.attrib.get("embed") or b.attrib.get("id", "") for b in e.iter() if b.tag in ("blip", "imagedata"))
                out += [self.image(i, re.sub(r"\s+", " ", alt)) for i in rids]
                box = [self.paragraph(p).strip() for x in e.iter("txbxContent") for p in x.iter("p")]
                out.append(" ".join(dict.fromkeys(filter(None, box))))
            elif e.tag in ("footnoteReference", "endnoteReference"):
                out.append(f"[^{e.tag[0]}{e.attrib.get('id', '')}]")
            elif e.tag == "commentReference":
                out.append(f"[^c{e.attrib.get('id', '')}]")
        text = "".join(out)
        if not text.strip() or "](data:" in text:
            return text
        lead, inner, tail = text[: len(text) - len(text.lstrip())], text.strip(), text[len(text.rstrip()) :]
        if self._on(r, "b"):
            inner = f"**{inner}**"
        if self._on(r, "i"):
            inner = f"*{inner}*"
        if self._on(r, "strike"):
            inner = f"~~{inner}~~"
        return lead + inner + tail

    def inline(self, parent: Element) -> str:
        out = []
        for e in parent:
            if e.tag == "r":
                out.append(self.run(e))
            elif e.tag == "hyperlink":
                text, href = self.inline(e), self.links.get(e.attrib.get("id", ""), "")
                out.append(f"[{text.strip()}]({href})" if href and text.strip() else text)
            elif e.tag == "oMathPara":
                out.append("".join(f"$${math(m)}$$" for m in e.findall("oMath")))
            elif e.tag == "oMath":
                out.append(f"${math(e)}$")
            elif e.tag == "sdt":
                content = e.find("sdtContent")
                out.append(self.inline(content) if content is not None else "")
            elif e.tag in ("ins", "smartTag", "moveTo", "fldSimple", "dir", "bdo"):
                out.append(self.inline(e))
        return "".join(out).replace("****", "")  # neighbouring bold runs are one

    paragraph = inline

    def blocks(self, parent: Element, out: list[str]) -> None:
        for e in parent:
            if e.tag == "p":
                text = self.inline(e).strip()
                level, number = self.heading(e), e.find("pPr/numPr")
                if not text:
                    continue
                if level:
                    out.append("#" * level + f" {text}\n\n")
                elif number is not None and (nid := number.find("numId")) is not None and nid.attrib.get("val") != "0":
                    at = number.find("ilvl")
                    depth, key = int(at.attrib.get("val", 0)) if at is not None else 0, nid.attrib.get("val", "")
                    mark = "- "
                    if self.ordered.get((key, depth)):
                        self.counts = {k: v for k, v in self.counts.items() if k[0] != key or k[1] <= depth}
                        self.counts[key, depth] = self.counts.get((key, depth), 0) + 1
                        mark = f"{self.counts[key, depth]}. "
                    out.append("  " * depth + f"{mark}{text}\n")
                else:
                    if out and re.match(r" *(?:-|\d+\.) ", out[-1]):
                        out.append("\n")
                    out.append(f"{text}\n\n")
            elif e.tag == "tbl":
                rows = [[self.cell(c) for c in r.iter("tc") if self._of(r, c)] for r in e.findall("tr")]
                rows = [r for r in rows if r]
                if rows:
                    out.append("\n" + table(rows, safe=True) + "\n\n")
            elif e.tag in ("sdt", "ins", "customXml"):
                content = e.find("sdtContent") if e.tag == "sdt" else e
                if content is not None:
                    self.blocks(content, out)

    @staticmethod
    def _of(row: Element, cell: Element) -> bool:
        """Whether a cell is the row's own, not one of a table in a cell."""
        stack = [c for c in row if c.tag != "tc"]
        if cell in list(row):
            return True
        while stack:
            e = stack.pop()
            if e.tag == "tc":
                continue
            if cell in list(e):
                return e.tag in ("sdtContent", "customXml")
            stack += list(e)
        return False

    def cell(self, c: Element) -> str:
        return " ".join(filter(None, (self.inline(p).strip() for p in c.iter("p"))))

    def side(self, part: str, tag: str, letter: str) -> list[str]:
        """Notes or comments as footnotes."""
        root = _xml(self.zip, part)
        out = []
        for n in root if root is not None else []:
            if n.tag == tag and n.attrib.get("type") not in ("separator", "continuationSeparator", "continuationNotice"):
                text = " ".join(filter(None, (self.inline(p).strip() for p in n.iter("p"))))
                who = f"{n.attrib['author']}: " if tag == "comment" and n.attrib.get("author") else ""
                if text:
                    out.append(f"[^{letter}{n.attrib.get('id', '')}]: {who}{text}")
        return out


def docx(data: bytes, info: Info, options: Options) -> Result:
    """Headings, runs, links, lists, tables, images, math, notes and comments in document order."""
    w = _Word(data, options)
    out: list[str] = []
    w.blocks(w.body, out)
    notes = [x for part, tag, letter in (("word/footnotes.xml", "footnote", "f"), ("word/endnotes.xml", "endnote", "e"), ("word/comments.xml", "comment", "c")) for x in w.side(part, tag, letter)]
    text = re.sub(r"\n{3,}", "\n\n", "".join(out).strip() + ("\n\n" + "\n".join(notes) if notes else "")).strip()
    first = next((x.strip().lstrip("#").strip() for x in text.split("\n") if x.strip().lstrip("#").strip()), None)
    return Result(text, first)


# -- Excel and OpenDocument ---------------------------------------------------------------------


def number(text: str) -> str:
    """A stored number as a person would write it."""
    try:
        x = float(text)
    except ValueError:
        return text
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    return repr(x)


def serial_date(x: float, base1904: bool = False) -> str:
    """A day number as date, or date and time, or time alone."""
    start = dt.datetime(1904, 1, 1) if base1904 else dt.datetime(1899, 12, 30)
    try:
        when = start + dt.timedelta(seconds=round(x * 86400))
    except OverflowError:
        return number(repr(x))
    if 0 <= x < 1 and x:
        return when.strftime("%H:%M:%S")
    return when.strftime("%Y-%m-%d" if when.time() == dt.time() else "%Y-%m-%d %H:%M:%S")


#: The built-in formats that are dates.
_DATES = frozenset([*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)])


def is_date_format(code: str) -> bool:
    code = re.sub(r"\"[^\"]*\"|\[[^\]]*\]|\\.|_.|\*.", "", code)
    return bool(re.search(r"[dmyhs]", code, re.I)) and not re.search(r"[#?]|0\.?0*$|General", code)


def column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_md(name: str, rows: list[list[str]], options: Options) -> str:
    """A heading and the sheet as a table, without the empty rows and columns at its edges."""
    while rows and not any(rows[-1]):
        rows.pop()
    while rows and not any(rows[0]):
        rows.pop(0)
    width = max((i + 1 for r in rows for i, c in enumerate(r) if c), default=0)
    first = min((i for r in rows for i, c in enumerate(r) if c), default=0)
    rows = [(r + [""] * width)[first:width] for r in rows]
    return f"## {name}\n" + (table([[" ".join(c.split()).replace("|", "\\|") for c in r] for r in rows]) if rows else "")


def xlsx(data: bytes, info: Info, options: Options) -> Result:
    zip_ = Container(data)
    main = next((t for t in _relations(zip_, "").values() if t.endswith("workbook.xml")), "xl/workbook.xml")
    book = _xml(zip_, main)
    if book is None:
        raise ConversionError("no workbook")
    links = _relations(zip_, main)
    shared_root = _xml(zip_, next((t for t in links.values() if t.endswith("sharedStrings.xml")), "xl/sharedStrings.xml"))
    shared = ["".join(t.text or "" for part in ([si] if si.find("r") is None else si.findall("r")) for t in part.findall("t")) for si in (shared_root if shared_root is not None else [])]
    styles = _xml(zip_, next((t for t in links.values() if t.endswith("styles.xml")), "xl/styles.xml"))
    formats = {int(f.attrib["numFmtId"]): f.attrib.get("formatCode", "") for f in (styles.iter("numFmt") if styles is not None else []) if "numFmtId" in f.attrib}
    xfs = styles.find("cellXfs") if styles is not None else None
    dates = [(n := int(x.attrib.get("numFmtId", 0))) in _DATES or n in formats and is_date_format(formats[n]) for x in (xfs if xfs is not None else [])]
    prop = book.find("workbookPr")
    base1904 = prop is not None and prop.attrib.get("date1904") in ("1", "true")
    out = []
    for s in book.iter("sheet"):
        target = links.get(s.attrib.get("id", ""), "")
        root = _xml(zip_, target)
        if root is None or root.tag != "worksheet":
            continue
        rows: list[list[str]] = []
        for r in root.iter("row"):
            at = int(r.attrib.get("r", len(rows) + 1))
            rows += [[] for _ in range(min(at - 1 - len(rows), 100_000))]
            cells: list[str] = []
            for c in r.findall("c"):
                i = column(c.attrib["r"]) if "r" in c.attrib else len(cells)
                cells += [""] * (min(i, 16_384) - len(cells))
                v, kind, style = c.find("v"), c.attrib.get("t", "n"), int(c.attrib.get("s", 0))
                text = (v.text or "") if v is not None else ""
                if kind == "s":
                    text = shared[int(text)] if text.isdigit() and int(text) < len(shared) else ""
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter("t"))
                elif kind == "b":
                    text = {"1": "True", "0": "False"}.get(text, text)
                elif kind == "n" and text:
                    text = serial_date(float(text), base1904) if style < len(dates) and dates[style] else number(text)
                cells.append(text)
            rows.append(cells)
        images = _sheet_images(zip_, target, options)
        out.append(sheet_md(s.attrib.get("name", ""), rows, options) + images)
    if not out:
        raise ConversionError("no sheets")
    return Result("\n\n".join(out))


def _sheet_images(zip_: Container, sheet: str, options: Options) -> str:
    """What an OCR hook reads in the images of a sheet."""
    if not getattr(options.hooks, "ocr", None):
        return ""
    found = []
    for drawing in (t for t in _relations(zip_, sheet).values() if "/drawings/" in t and t.endswith(".xml")):
        for image in _relations(zip_, drawing).values():
            if (data := zip_.read(image)) and (text := asked(options.hooks, "ocr", data)):
                found.append(f"*[Image OCR]\n{text}\n[End OCR]*")
    return "\n\n### Images in this sheet:\n\n" + "\n\n".join(found) if found else ""


def ods(data: bytes, info: Info, options: Options) -> Result:
    root = _xml(Container(data), "content.xml")
    if root is None:
        raise ConversionError("no content.xml")
    out = []
    for t in root.iter("table"):
        rows: list[list[str]] = []
        for r in t.iter("table-row"):
            cells: list[str] = []
            for c in r:
                if c.tag in ("table-cell", "covered-table-cell"):
                    text = "\n".join("".join(p.itertext()) for p in c.findall("p"))
                    text = text or c.attrib.get("date-value") or number(c.attrib.get("value", ""))
                    cells += [text] * (min(int(c.attrib.get("number-columns-repeated", 1)), 1024) if text else min(int(c.attrib.get("number-columns-repeated", 1)), 16_384))
            while cells and not cells[-1]:
                cells.pop()
            rows += [cells] * (min(int(r.attrib.get("number-rows-repeated", 1)), 1024) if cells else 1)
        out.append(sheet_md(t.attrib.get("name", ""), [list(r) for r in rows], options))
    if not out:
        raise ConversionError("no sheets")
    return Result("\n\n".join(out))


# -- PowerPoint ---------------------------------------------------------------------------------


class _Deck:
    def __init__(self, data: bytes, options: Options):
        self.zip, self.options = Container(data), options
        root = _xml(self.zip, "ppt/presentation.xml")
        if root is None:
            raise ConversionError("no presentation")
        links = _relations(self.zip, "ppt/presentation.xml")
        self.slides = [links[s.attrib["id"]] for s in root.iter("sldId") if s.attrib.get("id") in links]
        if not self.slides:
            self.slides = sorted((n for n in self.zip.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))

    @staticmethod
    def words(body: Element | None) -> str:
        """The paragraphs of a text body."""
        if body is None:
            return ""
        return "\n".join("".join(t.text or "" if t.tag == "t" else "\v" if t.tag == "br" else "" for t in p.iter() if t.tag in ("t", "br")) for p in body.findall("p"))

    @staticmethod
    def place(shape: Element) -> tuple[float, float]:
        off = next((o for x in ("spPr/xfrm/off", "grpSpPr/xfrm/off", "xfrm/off") if (o := shape.find(x)) is not None), None)
        get = lambda k: (float(off.attrib.get(k, 0)) if off is not None else 0) or float("-inf")
        return get("y"), get("x")

    def shapes(self, parent: Element, links: dict[str, str], out: list[str]) -> None:
        for s in sorted((c for c in parent if c.tag in ("sp", "pic", "graphicFrame", "grpSp", "cxnSp")), key=self.place):
            if s.tag == "pic" or s.tag == "sp" and s.find("blipFill/blip") is not None:
                out.append(self.picture(s, links))
            elif s.tag == "graphicFrame":
                t = next(s.iter("tbl"), None)
                if t is not None:
                    rows = [[self.words(c.find("txBody")) for c in r.findall("tc")] for r in t.findall("tr")]
                    out.append(table([[" ".join(c.split()).replace("|", "\\|") for c in r] for r in rows]) + "\n")
                chart = next(s.iter("chart"), None)
                if chart is not None:
                    out.append(self.chart(links.get(chart.attrib.get("id", ""), "")))
            elif s.tag == "grpSp":
                self.shapes(s, links, out)
            elif (body := s.find("txBody")) is not None:
                ph = s.find("nvSpPr/nvPr/ph")
                title = ph is not None and ph.attrib.get("type") in ("title", "ctrTitle")
                text = self.words(body).replace("\v", "\n")
                out.append(f"# {text.lstrip()}\n" if title else f"{text}\n")

    def picture(self, s: Element, links: dict[str, str]) -> str:
        """An image with its description, or else its name, as a label; what a text hook reads stands for all of it."""
        own = next((e.attrib for e in s.iter("cNvPr")), {})
        part = next((links.get(b.attrib.get("embed", ""), "") for b in s.iter("blip")), "")
        data, said = self.zip.read(part), None
        if data:
            said = asked(self.options.hooks, "caption", data, MIME_OF.get(extension(part) or "", "image/png"))
            if not said and (text := asked(self.options.hooks, "ocr", data)):
                return f"\n*[Image OCR]\n{text}\n[End OCR]*\n"
        described = f"{said or ''} {own.get('descr', '')}"
        if not described.strip():
            described = own.get("name", "")
        label = " ".join(re.findall(r"[^\s\[\]]+", described))
        if data and self.options.keep_data_uris:
            source = data_uri(data, part, True)
        else:
            source = "".join(c for c in own.get("name", "") if c.isalnum() or c == "_") + ".jpg"
        return f"\n![{label}]({source})\n"

    def chart(self, part: str) -> str:
        try:
            root = _xml(self.zip, part)
            title = root.find("chart/title")
            series = list(root.iter("ser"))
            if not series:
                return "\n\n[unsupported chart]\n\n"
            points = lambda e, *names: next(([(int(p.attrib.get("idx", 0)), p.findtext("v") or "") for p in c.iter("pt")] for n in names if (c := e.find(n)) is not None), [])
            categories = dict(points(series[0], "cat", "xVal"))
            columns = [dict(points(s, "val", "yVal")) for s in series]
            names = ["".join(v for _, v in points(s, "tx")) for s in series]
            head = "\n\n### Chart" + (f": {''.join(t.text or '' for t in title.iter('t'))}" if title is not None else "") + "\n\n"
            keys = sorted({*categories, *(k for c in columns for k in c)})
            value = lambda v: v if v is None else str(float(v)) if re.fullmatch(r"-?\d+(\.\d+)?([eE][-+]?\d+)?", v) else v
            rows = [["Category", *names], *([categories.get(k, ""), *(str(value(c.get(k))) for c in columns)] for k in keys)]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            return head + "\n".join([lines[0], "|" + "|".join(["---"] * len(rows[0])) + "|", *lines[1:]]) + "\n"
        except (AttributeError, ValueError, ConversionError):
            return "\n\n[unsupported chart]\n\n"


def pptx(data: bytes, info: Info, options: Options) -> Result:
    """Slides in order, their shapes from top left to bottom right, and the notes."""
    deck, text = _Deck(data, options), ""
    for i, part in enumerate(deck.slides, 1):
        root = _xml(deck.zip, part)
        if root is None:
            continue
        links, out = _relations(deck.zip, part), []
        tree = next(root.iter("spTree"), root)
        deck.shapes(tree, links, out)
        text = (text + f"\n\n<!-- Slide number: {i} -->\n" + "".join(out)).strip()
        notes = next((_xml(deck.zip, t) for t in links.values() if "/notesSlides/" in t), None)
        if notes is not None:
            body = next((s.find("txBody") for s in notes.iter("sp") if (p := s.find("nvSpPr/nvPr/ph")) is not None and p.attrib.get("type") == "body"), None)
            text = (text + "\n\n### Notes:\n" + deck.words(body)).strip()
    return Result(text)


