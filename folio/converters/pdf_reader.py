"""A small PDF reader: objects, streams, fonts, and the placed glyphs of each page."""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from folio.plans.model import ConversionError

MAX_STREAM = 256 << 20
#: Objects and operators that are followed at most, against cycles and floods.
MAX_DEPTH, MAX_OPS = 60, 5_000_000


#: Bytes of a stream that is not kept once its page is read.
LARGE = 64 << 10


class Name(str):
    __slots__ = ()


class Op(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    info: dict
    raw: bytes


@dataclass(slots=True)
class Glyph:
    """A character's place from the left and from the bottom, its end, size and weight."""

    x: float
    y: float
    end: float
    size: float
    bold: bool
    italic: bool
    ch: str


@dataclass(slots=True)
class Page:
    width: float
    height: float
    glyphs: list[Glyph]
    images: int


_WHITE, _DELIM = b"\0\t\n\x0c\r ", b"()<>[]{}/%"
_TOKEN = re.compile(rb"[\0\t\n\x0c\r ]*(?:%[^\r\n]*|(<<|>>|[\[\]{}])|/([^\0\t\n\x0c\r ()<>\[\]{}/%]*)|([+-]?(?:\d+\.?\d*|\.\d+))(?=[\0\t\n\x0c\r ()<>\[\]{}/%]|$)|(\()|<([0-9A-Fa-f\0\t\n\x0c\r ]*)>|([^\0\t\n\x0c\r ()<>\[\]{}/%]+)|(.))", re.S)
_REF = re.compile(rb"[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?![A-Za-z0-9])")
_WORDS = {b"true": True, b"false": False, b"null": None}
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string after its opening bracket."""
    out, depth, i = bytearray(), 1, at
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            nxt = data[i + 1 : i + 2]
            if octal := re.match(rb"[0-7]{1,3}", data[i + 1 : i + 4]):
                out.append(int(octal[0], 8) & 255)
                i += 1 + len(octal[0])
                continue
            if nxt in (b"\r", b"\n"):
                i += 3 if data[i + 1 : i + 3] == b"\r\n" else 2
                continue
            out += _ESCAPES.get(nxt, nxt)
            i += 2
            continue
        if c == b"(":
            depth += 1
        elif c == b")":
            depth -= 1
            if not depth:
                return bytes(out), i + 1
        out += c
        i += 1
    return bytes(out), i


def parse(data: bytes, at: int = 0, refs: bool = True) -> Iterator[tuple[Any, int]]:
    """Objects and operators from ``at`` on, each with the place after it."""
    stack: list[tuple[str, list]] = []
    i = at
    while i < len(data):
        m = _TOKEN.match(data, i)
        if m is None:
            return
        i = m.end()
        kind = m.lastindex
        if kind is None or kind == 7:
            continue
        token = m[kind]
        value: Any
        if kind == 1:
            if token in (b"<<", b"["):
                stack.append((token.decode(), []))
                if len(stack) > MAX_DEPTH:
                    return
                continue
            if not stack or token not in (b">>", b"]"):
                continue
            opened, items = stack.pop()
            value = {k: v for k, v in dict(zip(items[::2], items[1::2], strict=False)).items() if isinstance(k, Name)} if opened == "<<" else items
        elif kind == 2:
            value = Name((re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), token) if b"#" in token else token).decode("latin-1"))
        elif kind == 3:
            if refs and token.isdigit() and (r := _REF.match(data, i)):
                value, i = Ref(int(token)), r.end()
            else:
                value = float(token) if b"." in token else int(token)
        elif kind == 4:
            value, i = _string(data, i)
        elif kind == 5:
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        else:
            value = _WORDS[token] if token in _WORDS else Op(token.decode("latin-1"))
        if stack:
            stack[-1][1].append(value)
        else:
            yield value, i


# -- filters ------------------------------------------------------------------------------------


def _flate(data: bytes) -> bytes:
    d = zlib.decompressobj()
    try:
        return d.decompress(data, MAX_STREAM)
    except zlib.error:
        out, d = b"", zlib.decompressobj(-15)
        for skip in (2, 0):
            try:
                return zlib.decompressobj(-15).decompress(data[skip:], MAX_STREAM)
            except zlib.error:
                continue
        d = zlib.decompressobj()
        for i in range(0, len(data), 64):  # what can be read of a broken stream
            try:
                out += d.decompress(data[i : i + 64])
            except zlib.error:
                break
        return out


def _lzw(data: bytes, early: int) -> bytes:
    table, out, width, buf, bits, prev = [bytes([i]) for i in range(256)] + [b"", b""], [], 9, 0, 0, b""
    for byte in data:
        buf, bits = (buf << 8 | byte) & 0xFFFFFFFF, bits + 8
        while bits >= width:
            code = buf >> (bits - width) & (1 << width) - 1
            bits -= width
            if code == 256:
                table, width, prev = table[:258], 9, b""
            elif code == 257:
                return b"".join(out)
            else:
                entry = table[code] if code < len(table) else prev + prev[:1]
                out.append(entry)
                if prev and len(table) < 4096:
                    table.append(prev + entry[:1])
                prev = entry
                width = 9 + (len(table) + early > 511) + (len(table) + early > 1023) + (len(table) + early > 2047)
    return b"".join(out)


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in re.sub(rb"[\0\t\n\x0c\r ]", b"", data.split(b"~>")[0].removeprefix(b"<~")):
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                n = 0
                for g in group:
                    n = n * 85 + g
                out += (n & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = 0
        for g in group + [84] * (5 - len(group)):
            n = n * 85 + g
        out += (n & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def _run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        out += data[i + 1 : i + 2 + n] if n < 128 else data[i + 1 : i + 2] * (257 - n)
        i += 2 + n if n < 128 else 2
    return bytes(out)


def _predicted(data: bytes, parms: dict) -> bytes:
    kind, columns = parms.get("Predictor", 1), parms.get("Columns", 1)
    if kind < 10:
        return data
    step = max(1, parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) // 8)
    width = (columns * parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) + 7) // 8
    out, above = bytearray(), bytearray(width)
    for at in range(0, len(data), width + 1):
        how, row = data[at], bytearray(data[at + 1 : at + 1 + width].ljust(width, b"\0"))
        for i in range(width):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            if how == 1:
                p = a
            elif how == 2:
                p = b
            elif how == 3:
                p = (a + b) // 2
            elif how == 4:
                q = a + b - c
                p = min((a, b, c), key=lambda x: abs(q - x))
            else:
                p = 0
            row[i] = row[i] + p & 255
        out += row
        above = row
    return bytes(out)


# -- the file -----------------------------------------------------------------------------------


class Pdf:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ConversionError("not a PDF file")
        self.data = data
        self.cache: dict[int, Any] = {}
        self.places = {int(m[1]): m.end() for m in re.finditer(rb"(?:^|[\0\t\n\x0c\r ])(\d+)[\0\t\n\x0c\r ]+\d+[\0\t\n\x0c\r ]+obj", data)}  # the last wins
        self.packed: dict[int, tuple[int, int]] = {}
        trailers = [t for m in re.finditer(rb"trailer", data) for t, _ in [next(parse(data, m.end()), ({}, 0))] if isinstance(t, dict)]
        for n in list(self.places):
            o = self.get(Ref(n))
            if isinstance(o, Stream) and o.info.get("Type") == "ObjStm":
                first = next(iter(parse(self.decoded(o)[: self.get(o.info.get("First")) or 0])), None)
                if first is not None:
                    heads = [v for v, _ in parse(self.decoded(o)[: self.get(o.info.get("First")) or 0], refs=False) if isinstance(v, int)]
                    for k, (number, _) in enumerate(zip(heads[::2], heads[1::2], strict=False)):
                        if number not in self.places:
                            self.packed[number] = (n, k)
            elif isinstance(o, Stream):
                if o.info.get("Type") == "XRef":
                    trailers.append(o.info)
                self.cache.pop(n, None)  # a copy of a part of the file, read again where it is needed
        if any("Encrypt" in t for t in trailers):
            raise ConversionError("the file is encrypted")
        roots = [r for t in reversed(trailers) if isinstance(r := self.get(t.get("Root")), dict)]
        self.root = next((r for r in roots if "Pages" in r), None) or next((o for n in [*self.places, *self.packed] if isinstance(o := self.get(Ref(n)), dict) and o.get("Type") == "Catalog"), None)
        if self.root is None:
            raise ConversionError("no document catalog")

    def get(self, x: Any) -> Any:
        """What a reference stands for."""
        for _ in range(MAX_DEPTH):
            if not isinstance(x, Ref):
                return x
            if x.number not in self.cache:
                self.cache[x.number] = None
                self.cache[x.number] = self._load(x.number)
            x = self.cache[x.number]
        return None

    def _load(self, n: int) -> Any:
        if n in self.places:
            got = next(parse(self.data, self.places[n]), None)
            if got is None:
                return None
            value, end = got
            m = re.compile(rb"[\0\t\n\x0c\r ]*stream(\r\n|\n|\r)?").match(self.data, end) if isinstance(value, dict) else None
            if m is None:
                return None if isinstance(value, Op) else value
            size = self.get(value.get("Length"))
            if not isinstance(size, int) or not re.match(rb"[\0\t\n\x0c\r ]*endstream", self.data[m.end() + size : m.end() + size + 32]):
                stop = self.data.find(b"endstream", m.end())
                size = (stop if stop >= 0 else len(self.data)) - m.end()
            return Stream(value, self.data[m.end() : m.end() + size])
        if n in self.packed:
            holder, k = self.packed[n]
            s = self.get(Ref(holder))
            body, first = self.decoded(s), self.get(s.info.get("First")) or 0
            heads = [v for v, _ in parse(body[:first], refs=False) if isinstance(v, int)]
            if 2 * k + 1 < len(heads):
                got = next(parse(body, first + heads[2 * k + 1]), None)
                return got[0] if got else None
        return None

    def decoded(self, s: Stream) -> bytes:
        if "_out" in s.__dict__:
            return s.__dict__["_out"]
        names, parms, data = self.get(s.info.get("Filter")) or [], self.get(s.info.get("DecodeParms")) or [], s.raw
        names, parms = names if isinstance(names, list) else [names], parms if isinstance(parms, list) else [parms]
        for i, name in enumerate(names):
            p = self.get(parms[i]) if i < len(parms) else None
            p = {k: self.get(v) for k, v in p.items()} if isinstance(p, dict) else {}
            name = self.get(name)
            if name in ("FlateDecode", "Fl"):
                data = _predicted(_flate(data), p)
            elif name in ("LZWDecode", "LZW"):
                data = _predicted(_lzw(data, p.get("EarlyChange", 1)), p)
            elif name in ("ASCII85Decode", "A85"):
                data = _ascii85(data)
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif name in ("RunLengthDecode", "RL"):
                data = _run_length(data)
            else:
                data = b""  # an image format
        s.__dict__["_out"] = data
        return data

    def pages(self) -> Iterator[dict]:
        """Page dictionaries in order, with what they inherit."""
        stack, seen = [(self.root.get("Pages"), {}, 0)], set()
        while stack:
            ref, inherited, depth = stack.pop()
            if isinstance(ref, Ref):
                if ref.number in seen:
                    continue
                seen.add(ref.number)
            node = self.get(ref)
            if not isinstance(node, dict) or depth > MAX_DEPTH:
                continue
            now = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                stack += [(k, now, depth + 1) for k in reversed(kids)]
            else:
                yield now | node

    def read(self, page: dict) -> Page:
        box = [self.get(v) for v in (self.get(page.get("CropBox")) or self.get(page.get("MediaBox")) or [0, 0, 612, 792])]
        if len(box) != 4 or not all(isinstance(v, (int, float)) for v in box):
            box = [0, 0, 612, 792]
        x0, y0 = min(box[0], box[2]), min(box[1], box[3])
        body = self.get(page.get("Contents"))
        parts = [self.get(b) for b in body] if isinstance(body, list) else [body]
        code = b"\n".join(self.decoded(p) for p in parts if isinstance(p, Stream))
        known = set(self.cache)
        out = _Interpreter(self)
        out.run(code, self.get(page.get("Resources")) or {}, (1.0, 0.0, 0.0, 1.0, -x0, -y0))
        # contents are of one page, and so are large streams as a rule; fonts and small objects stay
        contents = {r.number for r in ([page.get("Contents")] + (body if isinstance(body, list) else [])) if isinstance(r, Ref)}
        for n in contents | (set(self.cache) - known):
            x = self.cache.get(n)
            if isinstance(x, Stream) and (n in contents or len(x.raw) > LARGE):
                del self.cache[n]
        return Page(abs(box[2] - box[0]), abs(box[3] - box[1]), out.glyphs, out.images)


# -- fonts --------------------------------------------------------------------------------------

# Glyph names that don't follow from Unicode names.
_GLYPH_NAMES = {"space": " ", "hyphen": "-", "period": ".", "comma": ",", "colon": ":", "semicolon": ";", "quotesingle": "'", "quotedbl": '"', "parenleft": "(", "parenright": ")", "slash": "/", "backslash": "\\", "bracketleft": "[", "bracketright": "]", "braceleft": "{", "braceright": "}", "exclam": "!", "question": "?", "ampersand": "&", "at": "@", "numbersign": "#", "dollar": "$", "percent": "%", "asterisk": "*", "plus": "+", "equal": "=", "less": "<", "greater": ">", "underscore": "_", "asciitilde": "~", "asciicircum": "^", "grave": "`", "bar": "|", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "dotlessi": "ı", "degree": "°", "copyright": "©", "registered": "®", "trademark": "™", "section": "§", "paragraph": "¶", "sterling": "£", "Euro": "€", "yen": "¥", "cent": "¢", "minus": "−", "multiply": "×", "divide": "÷", "plusminus": "±", "periodcentered": "·", "guillemotleft": "«", "guillemotright": "»", "nbspace": " "}
_DIGITS = "zero one two three four five six seven eight nine".split()
_MARKS = {"acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON", "macron": "MACRON", "breve": "BREVE", "ogonek": "OGONEK"}


def glyph_char(name: str) -> str:
    """The character of a glyph name; empty if unknown."""
    name = name.split(".")[0]
    if len(name) == 1:
        return name
    if name in _GLYPH_NAMES:
        return _GLYPH_NAMES[name]
    if name in _DIGITS:
        return str(_DIGITS.index(name))
    if m := re.fullmatch(r"(?:uni([0-9A-F]{4})|u([0-9A-F]{4,6}))", name):
        return chr(min(0x10FFFF, int(m[1] or m[2], 16)))
    for mark, said in _MARKS.items():
        if name[1:] == mark:
            try:
                return unicodedata.lookup(f"LATIN {'CAPITAL' if name[0].isupper() else 'SMALL'} LETTER {name[0].upper()} WITH {said}")
            except KeyError:
                return name[0]
    try:
        return unicodedata.lookup(f"GREEK {'CAPITAL' if name[0].isupper() else 'SMALL'} LETTER {name.upper()}")
    except KeyError:
        return ""


def _cmap(data: bytes) -> tuple[dict[bytes, str], int]:
    """A ToUnicode map, and the bytes of its codes."""
    out: dict[bytes, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace") if len(b) > 1 else chr(b[0]) if b else ""
    items: list[Any] = []
    widths: set[int] = set()
    for value, _ in parse(data, refs=False):
        if not isinstance(value, Op):
            items.append(value)
            continue
        if value == "endcodespacerange":
            widths |= {len(v) for v in items if isinstance(v, bytes)}
        elif value == "endbfchar":
            pairs = [v for v in items if isinstance(v, bytes)]
            out |= {a: text(b) for a, b in zip(pairs[::2], pairs[1::2], strict=False)}
        elif value == "endbfrange":
            for lo, hi, to in zip(items[::3], items[1::3], items[2::3], strict=False):
                if not isinstance(lo, bytes) or not isinstance(hi, bytes):
                    continue
                n = min(int.from_bytes(hi, "big") - int.from_bytes(lo, "big") + 1, 65536)
                for k in range(max(0, n)):
                    code = (int.from_bytes(lo, "big") + k).to_bytes(len(lo), "big")
                    if isinstance(to, list):
                        out[code] = text(to[k]) if k < len(to) and isinstance(to[k], bytes) else ""
                    elif isinstance(to, bytes) and to:
                        out[code] = text((int.from_bytes(to, "big") + k & (1 << 8 * len(to)) - 1).to_bytes(len(to), "big"))
        items = []
    return out, max(widths, default=max(map(len, out), default=1))


@functools.cache
def _plain(codec: str) -> dict[bytes, str]:
    """The characters of a one-byte encoding; not to be changed."""
    return {bytes([c]): bytes([c]).decode(codec, "replace") for c in range(32, 256)}


class Font:
    def __init__(self, pdf: Pdf, info: dict):
        get = pdf.get
        name = str(get(info.get("BaseFont")) or "")
        self.bold, self.italic = bool(re.search(r"bold|black|heavy|demi", name, re.I)), bool(re.search(r"italic|oblique", name, re.I))
        self.wide = get(info.get("Subtype")) == "Type0"
        self.map: dict[bytes, str] = {}
        self.code_bytes = 2 if self.wide else 1
        if isinstance(u := get(info.get("ToUnicode")), Stream):
            self.map, n = _cmap(pdf.decoded(u))
            self.code_bytes = n if self.wide else 1
        self.widths: dict[int, float] = {}
        self.default = 500.0
        if self.wide:
            below = get((get(info.get("DescendantFonts")) or [None])[0]) or {}
            self.default = float(get(below.get("DW")) or 1000)
            w, i = get(below.get("W")) or [], 0
            while i + 1 < len(w):
                a, b = get(w[i]), get(w[i + 1])
                if isinstance(b, list):
                    self.widths |= {a + k: float(get(v) or 0) for k, v in enumerate(b)}
                    i += 2
                elif i + 2 < len(w):
                    self.widths |= dict.fromkeys(range(a, min(b, a + 65536) + 1), float(get(w[i + 2]) or 0))
                    i += 3
                else:
                    break
        else:
            first = get(info.get("FirstChar")) or 0
            self.widths = {first + k: float(v) for k, v in enumerate(map(get, get(info.get("Widths")) or [])) if isinstance(v, (int, float))}
            enc = get(info.get("Encoding"))
            base = (get(enc.get("BaseEncoding")) if isinstance(enc, dict) else enc) or ""
            codec = "mac-roman" if base == "MacRomanEncoding" else "cp1252"
            plain = dict(_plain(codec))
            at = 0
            for d in (get(enc.get("Differences")) or []) if isinstance(enc, dict) else []:
                d = get(d)
                if isinstance(d, Name):
                    if ch := glyph_char(d):
                        plain[bytes([at & 255])] = ch
                    at += 1
                elif isinstance(d, (int, float)):
                    at = int(d)
            self.map = plain | self.map
        if flags := get((get(info.get("FontDescriptor")) or {}).get("Flags") if isinstance(get(info.get("FontDescriptor")), dict) else None):
            self.italic |= bool(int(flags) & 64)
        scale = get(info.get("FontMatrix"))
        self.unit = float(get(scale[0])) if get(info.get("Subtype")) == "Type3" and isinstance(scale, list) and scale else 0.001

    def read(self, s: bytes) -> Iterator[tuple[str, float, bool]]:
        """Character, width in text units, and whether the code is a one-byte space."""
        for i in range(0, len(s), self.code_bytes):
            code = s[i : i + self.code_bytes]
            n = int.from_bytes(code, "big")
            ch = self.map.get(code)
            yield ("�" if self.wide else "") if ch is None else ch, self.widths.get(n, self.default) * self.unit, code == b" "


# -- page contents ------------------------------------------------------------------------------

Matrix = tuple[float, float, float, float, float, float]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


class _Interpreter:
    """Runs the text operators of a page."""

    def __init__(self, pdf: Pdf):
        self.pdf, self.glyphs, self.images, self.fonts, self.steps = pdf, [], 0, {}, 0

    def font(self, resources: dict, name: str) -> Font | None:
        fonts = self.pdf.get(resources.get("Font"))
        ref = fonts.get(name) if isinstance(fonts, dict) else None
        info = self.pdf.get(ref)
        if not isinstance(info, dict):
            return None
        key = ref.number if isinstance(ref, Ref) else id(info)
        if key not in self.fonts:
            self.fonts[key] = Font(self.pdf, info)
        return self.fonts[key]

    def run(self, code: bytes, resources: dict, ctm: Matrix, depth: int = 0) -> None:
        get = self.pdf.get
        state = {"ctm": ctm, "font": None, "size": 0.0, "cs": 0.0, "ws": 0.0, "h": 1.0, "lead": 0.0, "rise": 0.0}
        saved: list[dict] = []
        tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        args: list[Any] = []

        def show(s: bytes) -> None:
            nonlocal tm
            f = state["font"]
            if f is None:
                return
            points, h, rise, cs, ws, ctm_ = state["size"], state["h"], state["rise"], state["cs"], state["ws"], state["ctm"]
            a, b, c, d, x, y = tm  # within a string only the place moves
            to = _times(tm, ctm_)
            place = _times((points * h, 0.0, 0.0, points, 0.0, rise), to)
            size, wide = (place[2] ** 2 + place[3] ** 2) ** 0.5, (place[0] ** 2 + place[1] ** 2) ** 0.5
            for ch, w, space in f.read(s):
                if ch and size > 0:
                    left = rise * to[2] + (x * ctm_[0] + y * ctm_[2] + ctm_[4])
                    self.glyphs.append(Glyph(left, rise * to[3] + (x * ctm_[1] + y * ctm_[3] + ctm_[5]), left + w * wide, size, f.bold, f.italic, ch))
                move = (w * points + cs + (ws if space else 0.0)) * h
                x, y = move * a + x, move * b + y
            tm = (a, b, c, d, x, y)

        def newline(x: float, y: float) -> None:
            nonlocal tm, line
            tm = line = _times((1.0, 0.0, 0.0, 1.0, x, y), line)

        at = 0
        while at < len(code):
            for value, at_ in parse(code, at, refs=False):
                at = at_
                if not isinstance(value, Op):
                    args.append(value)
                    if len(args) > 4096:
                        args.clear()
                    continue
                self.steps += 1
                if self.steps > MAX_OPS:
                    return
                try:
                    if value == "BT":
                        tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
                    elif value == "Tf":
                        state["font"], state["size"] = self.font(resources, args[-2]), float(args[-1])
                    elif value in ("Td", "TD"):
                        if value == "TD":
                            state["lead"] = -args[-1]
                        newline(args[-2], args[-1])
                    elif value == "Tm":
                        tm = line = tuple(float(v) for v in args[-6:])
                    elif value == "T*":
                        newline(0, -state["lead"])
                    elif value == "Tj":
                        show(args[-1])
                    elif value in ("'", '"'):
                        if value == '"':
                            state["ws"], state["cs"] = args[-3], args[-2]
                        newline(0, -state["lead"])
                        show(args[-1])
                    elif value == "TJ":
                        for part in args[-1]:
                            if isinstance(part, bytes):
                                show(part)
                            elif isinstance(part, (int, float)):
                                tm = _times((1.0, 0.0, 0.0, 1.0, -part / 1000 * state["size"] * state["h"], 0.0), tm)
                    elif value in ("Tc", "Tw", "TL", "Ts", "Tz"):
                        state[{"Tc": "cs", "Tw": "ws", "TL": "lead", "Ts": "rise", "Tz": "h"}[value]] = args[-1] / (100 if value == "Tz" else 1)
                    elif value == "cm":
                        state["ctm"] = _times(tuple(float(v) for v in args[-6:]), state["ctm"])
                    elif value == "q":
                        saved.append(dict(state))
                    elif value == "Q" and saved:
                        state = saved.pop()
                    elif value == "Do":
                        objects = get(resources.get("XObject"))
                        x = get(objects.get(args[-1])) if isinstance(objects, dict) else None
                        if isinstance(x, Stream) and x.info.get("Subtype") == "Form" and depth < 12:
                            m = get(x.info.get("Matrix"))
                            inner = _times(tuple(float(get(v)) for v in m), state["ctm"]) if isinstance(m, list) and len(m) == 6 else state["ctm"]
                            self.run(self.pdf.decoded(x), get(x.info.get("Resources")) or resources, inner, depth + 1)
                        elif isinstance(x, Stream):
                            self.images += 1
                    elif value == "ID":  # an image within the contents
                        self.images += 1
                        end = re.compile(rb"[\0\t\n\x0c\r ]EI(?=[\0\t\n\x0c\r ]|$)").search(code, at)
                        at = end.end() if end else len(code)
                        args.clear()
                        break
                except (IndexError, TypeError, ValueError, KeyError):
                    pass
                args.clear()
            else:
                return


def read_pages(data: bytes) -> Iterator[Page | None]:
    """Every page; nothing for one that can't be read."""
    pdf = Pdf(data)
    for page in pdf.pages():
        try:
            yield pdf.read(page)
        except (ConversionError, RecursionError, ValueError, TypeError, KeyError, IndexError, AttributeError):
            yield None
