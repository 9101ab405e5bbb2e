"""Electronic books."""

from __future__ import annotations

import posixpath
import struct
from urllib.parse import unquote

from folio.converters.archive import Container
from folio.converters.web import page_markdown
from folio.converters.xmltree import safe_xml
from folio.plans.detect import decode
from folio.plans.model import ConversionError, Info, Options, Result


def epub(data: bytes, info: Info, options: Options) -> Result:
    """The book's details, then its chapters in reading order."""
    zip_ = Container(data)
    container = zip_.read("META-INF/container.xml")
    if container is None:
        raise ConversionError("no META-INF/container.xml")
    root_file = next((e.attrib.get("full-path", "") for e in safe_xml(container).iter("rootfile")), "")
    package = zip_.read(root_file)
    if package is None:
        raise ConversionError("no package file")
    opf = safe_xml(package)
    texts = lambda name: [t for e in opf.iter(name) if (t := "".join(e.itertext()).strip())]
    details = []
    for label, name in (("Title", "title"), ("Authors", "creator"), ("Language", "language"), ("Publisher", "publisher"), ("Date", "date"), ("Description", "description"), ("Identifier", "identifier")):
        found = texts(name)
        if found:
            details.append(f"**{label}:** {', '.join(found) if label == 'Authors' else found[0]}")
    files = {e.attrib.get("id", ""): e.attrib.get("href", "") for e in opf.iter("item")}
    base, parts, degraded = posixpath.dirname(root_file), ["\n".join(details)], False
    for ref in opf.iter("itemref"):
        href = files.get(ref.attrib.get("idref", ""))
        if href is None:
            continue
        path = posixpath.normpath(posixpath.join(base, href))
        body = zip_.read(path) if path in zip_ else zip_.read(unquote(path))
        if body is None:
            degraded |= path in zip_
            continue
        parts.append(page_markdown(decode(body, None, html=True), options).markdown.strip())
    return Result("\n\n".join(parts), next(iter(texts("title")), None), degraded)


def is_mobi(data: bytes) -> bool:
    return data[60:68] == b"BOOKMOBI"


def _palm_lz77(data: bytes) -> bytes:
    """PalmDOC compression."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c == 0 or 9 <= c <= 0x7F:
            out.append(c)
        elif c <= 8:
            out += data[i : i + c]
            i += c
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif i < len(data):
            pair = (c << 8 | data[i]) & 0x3FFF
            i += 1
            back, n = pair >> 3, (pair & 7) + 3
            if not back or back > len(out):
                raise ConversionError("corrupt book text")
            for _ in range(n):
                out.append(out[-back])
    return bytes(out)


def _trailing(data: bytes, flags: int) -> bytes:
    """A text record without its trailing entries."""
    for bit in range(1, 16):
        if flags >> bit & 1:
            size, shift = 0, 0
            for b in reversed(data[-4:]):
                size |= (b & 0x7F) << shift
                shift += 7
                if b & 0x80:
                    break
            data = data[: max(0, len(data) - size)]
    return data[: len(data) - (data[-1] & 3) - 1] if flags & 1 and data else data


def mobi(data: bytes, info: Info, options: Options) -> Result:
    """The text of an unprotected Mobipocket book, under its title."""
    try:
        if not is_mobi(data):
            raise ConversionError("not a Mobipocket book")
        n = struct.unpack(">H", data[76:78])[0]
        offsets = [struct.unpack(">I", data[78 + 8 * i : 82 + 8 * i])[0] for i in range(n)] + [len(data)]
        head = data[offsets[0] : offsets[1]]
        compression, _, _, records, _, encryption = struct.unpack(">HHIHHH", head[:14])
        if encryption:
            raise ConversionError("the book is protected")
        if compression not in (1, 2):
            raise ConversionError("unsupported book compression")
        length, codepage = struct.unpack(">I", head[20:24])[0], struct.unpack(">I", head[28:32])[0]
        at, size = struct.unpack(">II", head[84:92])
        title = head[at : at + size].decode("utf-8" if codepage == 65001 else "cp1252", "replace")
        flags = struct.unpack(">H", head[242:244])[0] if length >= 228 and len(head) >= 244 else 0
        body = b""
        for i in range(1, min(records, n - 1) + 1):
            raw = _trailing(data[offsets[i] : offsets[i + 1]], flags)
            body += _palm_lz77(raw) if compression == 2 else raw
    except (struct.error, IndexError) as e:
        raise ConversionError(f"corrupt book: {e}") from e
    out = page_markdown(body.decode("utf-8" if codepage == 65001 else "cp1252", "replace"), options)
    text = out.markdown if not title or title in out.markdown[:200] else f"# {title}\n\n{out.markdown}"
    return Result(text, title or out.title, out.degraded)
