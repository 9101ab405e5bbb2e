"""PDF to Markdown: forms as tables by word positions, other pages as prose by glyph layout."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from statistics import median

from folio.converters.pdf_reader import Glyph, Page, read_pages
from folio.plans.model import ConversionError, Info, Options, Result, asked

PARTIAL = re.compile(r"^\.\d+$")
ANY_PARTIAL = re.compile(r"(?m)^\s*\.\d+\s*$")


def merge_partial_numbers(text: str) -> str:
    """A line that is only ".1" joins the next line that isn't blank."""
    if not ANY_PARTIAL.search(text):
        return text
    out: list[str] = []
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        if PARTIAL.match(lines[i].strip()):
            j = next((j for j in range(i + 1, len(lines)) if lines[j].strip()), None)
            if j is not None:
                out.append(f"{lines[i].strip()} {lines[j].strip()}")
                i = j + 1
                continue
        out.append(lines[i])
        i += 1
    return "\n".join(out)


# -- forms: tables by the places of words --------------------------------------------------------

# Fixed values, here and below: distances in points or in multiples of the font size, and the shares and counts from
# which something is a form, a column, a heading, a running head or a table.


@dataclass(slots=True)
class Word:
    text: str
    x0: float
    x1: float
    top: float


def _row_words(words: list[Word]) -> list[list[Word]]:
    """Words by bands of five points, each from left to right."""
    rows: dict[int, list[Word]] = {}
    for w in words:
        rows.setdefault(round(w.top / 5) * 5, []).append(w)
    return [sorted(rows[k], key=lambda w: w.x0) for k in sorted(rows)]


def _starts(xs: list[float], apart: float) -> list[float]:
    """The places at which groups of places begin that lie more than ``apart`` after the last begin."""
    out: list[float] = []
    for x in sorted(xs):
        if not out or x - out[-1] > apart:
            out.append(x)
    return out


def form_text(words: list[Word], width: float = 612.0) -> str | None:
    """The page with its borderless tables, or nothing if it isn't a form."""
    rows = _row_words(words)
    prose = [r[-1].x1 - r[0].x0 > 0.55 * width and len(" ".join(w.text for w in r)) > 60 for r in rows]
    xs = sorted(x for r, p in zip(rows, prose, strict=True) if not p and len(g := _starts([w.x0 for w in r], 50)) >= 3 for x in g)
    if not xs:
        return None
    gaps = sorted(b - a for a, b in zip(xs, xs[1:], strict=False) if b - a > 5)
    apart = max(25, min(50, gaps[int(0.7 * len(gaps))])) if len(gaps) >= 3 else 35
    columns = _starts(xs, apart)
    n, span = len(columns), columns[-1] - columns[0]
    if n < 2 or span / n < 30 or n / (span / 72) > 10 or n > max(15, int(20 * width / 612)):
        return None

    def tabular(r: list[Word], is_prose: bool) -> bool:
        if is_prose or PARTIAL.match(r[0].text.strip()):
            return False
        met = {next((i for i, c in enumerate(columns) if abs(w.x0 - c) < 40), None) for w in r}
        return len(met - {None}) >= 2

    flags = [tabular(r, p) for r, p in zip(rows, prose, strict=True)]
    if sum(flags) < 0.2 * len(rows):
        return None
    out: list[str] = []
    region: list[list[str]] = []

    def flush() -> None:
        if region:
            sizes = [max(3, *(len(r[i]) for r in region)) for i in range(n)]
            line = lambda r: "| " + " | ".join(c.ljust(s) for c, s in zip(r, sizes, strict=True)) + " |"
            out.extend([line(region[0]), "| " + " | ".join("-" * s for s in sizes) + " |", *map(line, region[1:])])
            region.clear()

    for r, is_table in zip(rows, flags, strict=True):
        if not is_table:
            flush()
            out.append(" ".join(w.text for w in r))
            continue
        cells = [""] * n
        for w in r:
            at = next((i for i in range(n - 1) if w.x0 < columns[i + 1] - 20), n - 1)
            cells[at] = f"{cells[at]} {w.text}".strip() if cells[at] else w.text
        region.append(cells)
    flush()
    return "\n".join(out)


# -- prose: lines, columns, headings, lists and paragraphs by glyphs ------------------------------


@dataclass(slots=True)
class Cell:
    text: str
    x0: float
    x1: float
    bold: bool


@dataclass(slots=True)
class Line:
    y: float
    size: float
    cells: list[Cell]
    bold: bool
    page: int = 0
    x0: float = field(init=False)
    x1: float = field(init=False)

    def __post_init__(self) -> None:
        self.x0, self.x1 = min(c.x0 for c in self.cells), max(c.x1 for c in self.cells)

    @property
    def text(self) -> str:
        return " ".join(c.text for c in self.cells).strip()


def sizes_of(glyphs: list[Glyph]) -> Counter[float]:
    """How many glyphs have each size, in steps of half a point."""
    return Counter(round(g.size * 2) / 2 for g in glyphs if g.ch.strip())


def body_size(counts: Counter[float]) -> float:
    """The most frequent size, the smaller of equals; 10 without glyphs."""
    return min(counts, key=lambda s: (-counts[s], s)) if counts else 10.0


def lines_of(glyphs: list[Glyph], page: int = 0) -> list[Line]:
    """Lines from top to bottom; a wide gap parts cells, a small one words."""
    rows: list[list[Glyph]] = []
    for g in sorted((g for g in glyphs if g.ch), key=lambda g: (-g.y, g.x)):
        for r in reversed(rows[-3:]):
            if abs(r[0].y - g.y) <= 0.45 * max(r[0].size, g.size):
                r.append(g)
                break
        else:
            rows.append([g])
    out = []
    for r in rows:
        r.sort(key=lambda g: g.x)
        inked = [g for g in r if g.ch.strip()]
        if not inked:
            continue
        size = median(g.size for g in inked)
        gaps = sorted(b.x - a.end for a, b in zip(inked, inked[1:], strict=False))
        usual = gaps[len(gaps) // 2] if len(gaps) > 8 and gaps[len(gaps) // 2] > 0.1 * size and gaps[-1] < 2.2 * gaps[len(gaps) // 2] + 0.2 * size else 0.0
        cells: list[Cell] = []
        text, start, bold, last, blank = "", 0.0, 0, None, False
        for g in r:
            if not g.ch.strip():
                blank = True
                continue
            if last is not None:
                gap = g.x - last.end - usual
                if abs(g.x - last.x) < 0.05 * size and g.ch == last.ch:  # printed twice to look bold
                    continue
                if gap > 1.4 * size:
                    cells.append(Cell(text, start, last.end, bold * 2 > len(text)))
                    text, bold = "", 0
                elif gap > 0.1 * size or blank and gap > -0.5 * size:
                    text += " "
            if not text:
                start = g.x
            text += g.ch
            bold += g.bold
            last, blank = g, False
        cells.append(Cell(text, start, last.end, bold * 2 > len(text)))
        for c in cells:
            c.text = unicodedata.normalize("NFKC", c.text) if any("ﬀ" <= x <= "ﬆ" for x in c.text) else c.text
        out.append(Line(inked[0].y, size, cells, all(c.bold for c in cells), page))
    return out


def page_words(lines: list[Line], height: float) -> list[Word]:
    """The cells of lines as words with their blanks kept, measured from the top."""
    return [Word(c.text, c.x0, c.x1, height - ln.y - ln.size) for ln in lines for c in ln.cells]


def drop_running_heads(pages: list[list[Line]]) -> list[list[Line]]:
    """Without lines at the edges that most pages share but for their numbers."""
    n = len(pages)
    if n < 3:
        return pages
    key = lambda ln: re.sub(r"\d+", "#", ln.text)
    edges = [{key(ln) for ln in p[:2] + p[-2:]} for p in pages]
    counts = Counter(k for e in edges for k in e)
    shared = {k for k, c in counts.items() if c >= max(3, 2 * n // 5)}
    return [[ln for i, ln in enumerate(p) if not ((i < 2 or i >= len(p) - 2) and key(ln) in shared)] for p in pages]


def in_columns(lines: list[Line], width: float) -> list[Line]:
    """Two columns of prose one after the other, between the lines that cross the gutter."""
    if len(lines) < 8:
        return lines
    bins = [0] * 200
    for ln in lines:
        for c in ln.cells:
            for b in range(max(0, int(c.x0 / width * 200)), min(200, int(c.x1 / width * 200) + 1)):
                bins[b] += 1
    gutters = [i for i in range(56, 144) if bins[i] <= max(1, 0.04 * len(lines))]
    runs: list[list[int]] = []
    for i in gutters:
        if runs and i == runs[-1][-1] + 1:
            runs[-1].append(i)
        else:
            runs.append([i])
    best = max(runs, key=len, default=[])
    if len(best) < 4:
        return lines
    middle = (best[0] + best[-1] + 1) / 2 / 200 * width
    left = [c for ln in lines for c in ln.cells if c.x1 <= middle]
    right = [c for ln in lines for c in ln.cells if c.x0 >= middle]
    long = lambda cs: sum(len(c.text) > 25 for c in cs) >= 4 and sum(len(c.text) for c in cs) / max(1, len(cs)) > 25
    if not long(left) or not long(right):
        return lines
    out: list[Line] = []
    a: list[Line] = []
    b: list[Line] = []
    for ln in lines:
        ls, rs = [c for c in ln.cells if c.x1 <= middle], [c for c in ln.cells if c.x0 >= middle]
        if len(ls) + len(rs) < len(ln.cells):  # crosses the gutter
            out += a + b
            a, b = [], []
            out.append(ln)
            continue
        if ls:
            a.append(Line(ln.y, ln.size, ls, all(c.bold for c in ls), ln.page))
        if rs:
            b.append(Line(ln.y, ln.size, rs, all(c.bold for c in rs), ln.page))
    return out + a + b


_BULLET = re.compile(r"^[•◦▪‣●○■□–·*-]\s+(.*)$")
_NUMBER = re.compile(r"^(\d{1,3}[.)]|\(?[a-z]\))\s+(.*)$")


def heading_level(line: Line, body: float, alone: bool) -> int:
    """By how much larger than the body a line is set; a lone bold line is a level-five heading."""
    text = line.text
    if len(line.cells) != 1 or len(text) > 120 or not any(c.isalpha() for c in text):
        return 0
    ratio = line.size / body
    for level, least in ((1, 1.8), (2, 1.5), (3, 1.3), (4, 1.15)):
        if ratio >= least:
            return level
    return 5 if line.bold and alone and not text.endswith((".", ",", ";")) else 0


def _tables(lines: list[Line]) -> dict[int, tuple[int, list[list[str]]]]:
    """Runs of lines of several cells whose columns line up: where each begins, its end and its rows."""
    out: dict[int, tuple[int, list[list[str]]]] = {}
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and len(lines[j].cells) >= 2 and lines[j].page == lines[i].page:
            j += 1
        run = lines[i:j]
        if len(run) >= 2:
            spans: list[list[float]] = []
            for c in sorted((c for ln in run for c in ln.cells), key=lambda c: c.x0):
                hit = next((s for s in spans if c.x0 < s[1] and c.x1 > s[0]), None)
                if hit:
                    hit[0], hit[1] = min(hit[0], c.x0), max(hit[1], c.x1)
                else:
                    spans.append([c.x0, c.x1])
            spans.sort()
            cells = [c for ln in run for c in ln.cells]
            if 2 <= len(spans) <= 12 and sum(len(c.text) for c in cells) / len(cells) <= 55:
                rows = []
                for ln in run:
                    row = [""] * len(spans)
                    for c in ln.cells:
                        k = next((k for k, s in enumerate(spans) if c.x0 < s[1] and c.x1 > s[0]), 0)
                        row[k] = f"{row[k]} {c.text}".strip()
                    rows.append(row)
                out[i] = (j, rows)
        i = max(j, i + 1)
    return out


def layout_text(lines: list[Line], body: float) -> str:
    """Markdown of lines in reading order."""
    tables, out, para = _tables(lines), [], ""
    last: Line | None = None
    i = 0

    def flush() -> None:
        nonlocal para
        if para.strip():
            out.append(para.strip() + "\n\n")
        para = ""

    while i < len(lines):
        ln = lines[i]
        if i in tables:
            flush()
            end, rows = tables[i]
            clean = [[c.replace("|", "\\|") for c in r] for r in rows]
            out.append("\n".join(["| " + " | ".join(clean[0]) + " |", "| " + " | ".join(["---"] * len(clean[0])) + " |", *("| " + " | ".join(r) + " |" for r in clean[1:])]) + "\n\n")
            i, last = end, None
            continue
        gap = abs(last.y - ln.y) if last is not None and last.page == ln.page and last.y > ln.y else 1e9
        apart = gap > 1.6 * max(ln.size, body)
        after = lines[i + 1] if i + 1 < len(lines) else None
        alone = (last is None or apart or not last.bold) and (after is None or not after.bold or after.size != ln.size)
        level = heading_level(ln, body, alone)
        text = ln.text
        if level:
            flush()
            out.append("#" * level + f" {text}\n\n")
        elif m := _BULLET.match(text):
            flush()
            para = f"- {m[1]}"
        elif m := _NUMBER.match(text):
            flush()
            para = f"{m[1]} {m[2]}"
        elif para and (not apart or last is not None and last.page != ln.page and not para.rstrip().endswith((".", "!", "?", ":")) and text[:1].islower()):
            if para.endswith("-") and len(para) > 1 and para[-2].isalpha() and text[:1].islower():
                para = para[:-1] + text
            else:
                para += f" {text}"
        else:
            flush()
            para = text
        last = ln
        i += 1
    flush()
    text = "".join(out)
    return re.sub(r"(?m)^((?:- |\d{1,3}[.)] ).*)\n\n(?=- |\d{1,3}[.)] )", r"\1\n", text).strip()


SCANNED = "<!-- This PDF seems to be scanned: no text could be extracted. OCR is needed to read it. -->"


def pages_markdown(pages: Iterable[Page | None]) -> Result:
    """Form pages as tables where there are any; all as prose otherwise.

    The glyphs of one page are held at a time: a form page leaves its table, another one its lines.
    """
    n, sizes = 0, Counter()
    read: list[tuple[str | None, list[Line], float]] = []
    for page in pages:
        n += 1
        if page is not None:
            lines = lines_of(page.glyphs, len(read))
            sizes.update(sizes_of(page.glyphs))
            form = form_text(page_words(lines, page.height), page.width)
            read.append((form, [] if form is not None else lines, page.width))
    if n and not read:
        raise ConversionError("no page of the file can be read")
    body, degraded = body_size(sizes), len(read) < n
    if any(form is not None for form, _, _ in read):
        parts = [form if form is not None else layout_text(in_columns(lines, width), body) for form, lines, width in read]
        text = "\n\n".join(x.strip() for x in parts if x.strip())
    else:
        kept = drop_running_heads([lines for _, lines, _ in read])
        text = layout_text([ln for lines, (_, _, width) in zip(kept, read, strict=True) for ln in in_columns(lines, width)], body)
    if not text.strip():
        return Result(SCANNED, degraded=True)
    return Result(merge_partial_numbers(text), degraded=degraded)


def pdf(data: bytes, info: Info, options: Options) -> Result:
    out = pages_markdown(read_pages(data))
    if out.markdown == SCANNED and (texts := asked(options.hooks, "ocr_pdf", data)):
        return Result("\n\n".join(f"## Page {i}\n\n*[Image OCR]\n{t}\n[End OCR]*" for i, t in enumerate(texts, 1)))
    return out
