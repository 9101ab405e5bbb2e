"""Compound files: mail messages and old workbooks."""

from __future__ import annotations

import re
import struct

from folio.converters.office import is_date_format, number, serial_date, sheet_md
from folio.converters.web import page_markdown
from folio.plans.detect import OLE, decode
from folio.plans.model import ConversionError, Info, Options, Result

_END = 0xFFFFFFFA  # sector numbers from here on have other meanings


class Compound:
    """The streams of a compound file by path."""

    def __init__(self, data: bytes):
        if data[:8] != OLE:
            raise ConversionError("not a compound file")
        try:
            self._read(data)
        except (struct.error, IndexError, ValueError) as e:
            raise ConversionError(f"corrupt compound file: {e}") from e

    def _read(self, data: bytes) -> None:
        self.data = data
        big, small = struct.unpack("<HH", data[30:34])
        if not 7 <= big <= 16 or not 2 <= small < big:
            raise ConversionError("corrupt compound file")
        self.big, self.small = 1 << big, 1 << small
        root, _, self.cutoff, mini, _, more, n_more = struct.unpack("<IIIIIII", data[48:76])
        table = list(struct.unpack("<109I", data[76:512]))
        seen = 0
        while more < _END and seen < n_more + 1:
            sector = self._sector(more)
            words = struct.unpack(f"<{len(sector) // 4}I", sector)
            table += words[:-1]
            more, seen = words[-1], seen + 1
        self.fat: list[int] = []
        for s in table:
            if s < _END:
                sector = self._sector(s)
                self.fat += struct.unpack(f"<{len(sector) // 4}I", sector)
        directory = self._chain(root)
        raw = self._chain(mini) if mini < _END else b""
        self.minifat = struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])
        self.entries = [self._entry(directory[i : i + 128]) for i in range(0, len(directory) - 127, 128)]
        self.ministream = self._chain(self.entries[0][5])[: self.entries[0][6]]
        self.streams: dict[str, tuple[int, int]] = {}
        stack, visited = [(self.entries[0][4], "")], set()
        while stack:
            i, path = stack.pop()
            if i >= len(self.entries) or (i, path) in visited:
                continue
            visited.add((i, path))
            name, kind, left, right, child, start, size = self.entries[i]
            stack += [(left, path), (right, path)]
            if kind == 1:
                stack.append((child, f"{path}{name}/"))
            elif kind == 2:
                self.streams[path + name] = (start, size)

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.big : (n + 2) * self.big]

    def _chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < _END and n not in seen:
            first = n
            while True:  # neighbours in one piece
                seen.add(n)
                last, n = n, self.fat[n]
                if n != last + 1 or n in seen:
                    break
            out.append(self.data[(first + 1) * self.big : (last + 2) * self.big])
        return b"".join(out)

    def _entry(self, e: bytes) -> tuple:
        size = struct.unpack("<H", e[64:66])[0]
        name = e[: max(0, size - 2)].decode("utf-16-le", "replace")
        left, right, child = struct.unpack("<III", e[68:80])
        start, length = struct.unpack("<IQ", e[116:128])
        return name, e[66], left, right, child, start, length & 0xFFFFFFFF if self.big == 512 else length

    def read(self, path: str) -> bytes | None:
        if path not in self.streams:
            return None
        start, size = self.streams[path]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < _END and start not in seen and start < len(self.minifat):
            seen.add(start)
            out.append(self.ministream[start * self.small : (start + 1) * self.small])
            start = self.minifat[start]
        return b"".join(out)[:size]


# -- mail ---------------------------------------------------------------------------------------


def _property(file: Compound, number_: str, folder: str = "") -> str | None:
    """A text property, Unicode or not."""
    for suffix in ("001F", "001E"):
        raw = file.read(f"{folder}__substg1.0_{number_}{suffix}")
        if raw is not None:
            if suffix == "001F":
                try:
                    return raw.decode("utf-16-le").strip()
                except UnicodeDecodeError:
                    pass
            try:
                return raw.decode("utf-8").strip()
            except UnicodeDecodeError:
                return raw.decode("utf-8", "ignore").strip()
    return None


def is_mail(data: bytes) -> bool:
    if data[:8] != OLE:
        return False
    try:
        names = Compound(data).streams
    except ConversionError:
        return False
    return "__properties_version1.0" in names and any(n.startswith("__substg1.0_") for n in names)


def msg(data: bytes, info: Info, options: Options) -> Result:
    """Sender, recipients, subject and body of a saved mail."""
    file = Compound(data)
    sender, subject = _property(file, "0C1F") or _property(file, "0C1A"), _property(file, "0037")
    heads = [(k, v) for k, v in (("From", sender), ("To", _property(file, "0E04")), ("Subject", subject)) if v]
    body, degraded = _property(file, "1000"), False
    if not body:
        raw = file.read("__substg1.0_10130102") or file.read("__substg1.0_1013001E")
        if raw:
            body = page_markdown(decode(raw, None, html=True), options).markdown
        degraded = not body and file.read("__substg1.0_10090102") is not None
    text = "# Email Message\n\n" + "".join(f"**{k}:** {v}\n" for k, v in heads) + "\n## Content\n\n" + (body or "")
    return Result(text.strip(), subject, degraded)


# -- old workbooks ------------------------------------------------------------------------------


_NOT_NULL = re.compile(rb"[^\0]")


def _records(data: bytes):
    """Place, kind and body of each record; of a run of empty ones of kind 0, which is padding, the first alone."""
    i = 0
    while i + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, i)
        yield i, kind, data[i + 4 : i + 4 + size]
        i += 4 + size
        if not kind and not size:
            more = _NOT_NULL.search(data, i)
            i += ((more.start() if more else len(data)) - i) // 4 * 4


class _Strings:
    """Reads the strings of a shared table that goes on over several records."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.part < len(self.parts):
            piece = self.parts[self.part][self.at : self.at + n - len(out)]
            out += piece
            self.at += len(piece)
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        wide, out = flags & 1, []
        while n and self.part < len(self.parts):
            room = len(self.parts[self.part]) - self.at
            k = min(n, room // 2 if wide else room)
            out.append(self.take(k * (1 + wide)).decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= k
            if n:  # goes on in the next record, which says anew how wide its characters are
                if self.at:
                    self.part, self.at = self.part + 1, 0
                flag = self.take(1)
                wide = flag[0] & 1 if flag else 0
        self.take(4 * runs + extra)
        return "".join(out)


def _rk(v: int) -> float:
    x = float(struct.unpack("<i", struct.pack("<I", v))[0] >> 2) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


_ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


def xls(data: bytes, info: Info, options: Options) -> Result:
    """The sheets of a binary workbook (BIFF8), as they were last calculated."""
    file = Compound(data)
    book = file.read("Workbook") or file.read("Book")
    if book is None:
        raise ConversionError("no workbook stream")
    try:
        return Result("\n\n".join(sheet_md(n, r, options) for n, r in _sheets(book)))
    except (struct.error, IndexError) as e:
        raise ConversionError(f"corrupt workbook: {e}") from e


def _sheets(book: bytes):
    sheets, shared, formats, xfs, base1904 = [], [], {}, [], False
    records = list(_records(book))
    for i, (_, kind, b) in enumerate(records):
        if kind == 0x85:  # a sheet's place and name
            at, _, what, n, flags = struct.unpack("<IBBBB", b[:8])
            if what == 0:
                sheets.append((at, b[8 : 8 + n * 2].decode("utf-16-le", "replace") if flags & 1 else b[8 : 8 + n].decode("latin-1")))
        elif kind == 0xFC:  # shared strings
            parts = [b]
            for _, k, more in records[i + 1 :]:
                if k != 0x3C:
                    break
                parts.append(more)
            reader = _Strings(parts)
            total = struct.unpack("<II", reader.take(8))[1]
            shared = [reader.string() for _ in range(total)]
        elif kind == 0x41E:
            code, n, flags = struct.unpack("<HHB", b[:5])
            formats[code] = b[5 : 5 + n * 2].decode("utf-16-le", "replace") if flags & 1 else b[5 : 5 + n].decode("latin-1")
        elif kind == 0xE0:
            xfs.append(struct.unpack("<H", b[2:4])[0])
        elif kind == 0x22:
            base1904 = b[:2] == b"\1\0"
        elif kind == 0x2F:
            raise ConversionError("the workbook is encrypted")
    from folio.converters.office import _DATES

    def value(x: float, xf: int) -> str:
        f = xfs[xf] if xf < len(xfs) else 0
        return serial_date(x, base1904) if f in _DATES or f in formats and is_date_format(formats[f]) else number(repr(x))

    for at, name in sheets:
        cells: dict[tuple[int, int], str] = {}
        pending = None
        depth = 0
        for _, kind, b in _records(book[at:]):
            if kind == 0x809:
                depth += 1
            elif kind == 0x0A:
                depth -= 1
                if depth <= 0:
                    break
            elif depth == 1 and kind in (0xFD, 0x203, 0x27E, 0x205, 0x204, 0x06, 0xD6):
                r, c, xf = struct.unpack("<HHH", b[:6])
                if kind == 0xFD:
                    k = struct.unpack("<I", b[6:10])[0]
                    cells[r, c] = shared[k] if k < len(shared) else ""
                elif kind == 0x203:
                    cells[r, c] = value(struct.unpack("<d", b[6:14])[0], xf)
                elif kind == 0x27E:
                    cells[r, c] = value(_rk(struct.unpack("<I", b[6:10])[0]), xf)
                elif kind == 0x205:
                    cells[r, c] = _ERRORS.get(b[6], "") if b[7] else str(bool(b[6]))
                elif kind in (0x204, 0xD6):
                    n, flags = struct.unpack("<HB", b[6:9])
                    cells[r, c] = b[9 : 9 + 2 * n].decode("utf-16-le", "replace") if flags & 1 else b[9 : 9 + n].decode("latin-1")
                elif b[12:14] == b"\xff\xff":  # a formula without a number
                    if b[6] == 0:
                        pending = (r, c)
                    elif b[6] == 1:
                        cells[r, c] = str(bool(b[8]))
                    elif b[6] == 2:
                        cells[r, c] = _ERRORS.get(b[8], "")
                else:
                    cells[r, c] = value(struct.unpack("<d", b[6:14])[0], xf)
            elif depth == 1 and kind == 0xBD:
                r, c = struct.unpack("<HH", b[:4])
                for k in range((len(b) - 6) // 6):
                    xf, v = struct.unpack("<HI", b[4 + 6 * k : 10 + 6 * k])
                    cells[r, c + k] = value(_rk(v), xf)
            elif depth == 1 and kind == 0x207 and pending:
                n, flags = struct.unpack("<HB", b[:3])
                cells[pending] = b[3 : 3 + 2 * n].decode("utf-16-le", "replace") if flags & 1 else b[3 : 3 + n].decode("latin-1")
                pending = None
        rows: list[list[str]] = []
        if cells:
            width = max(c for _, c in cells) + 1
            rows = [[cells.get((r, c), "") for c in range(width)] for r in range(max(r for r, _ in cells) + 1)]
        yield name, rows
