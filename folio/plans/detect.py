"""What an input is: from its names, its first bytes and its characters."""

from __future__ import annotations

import codecs
import re
import struct
from pathlib import PurePosixPath
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.plans.model import Info

_OOXML = "application/vnd.openxmlformats-officedocument."
# The media type of each extension, and the extension of each media type.
MIME_OF = {
    ".pdf": "application/pdf", ".docx": _OOXML + "wordprocessingml.document", ".xlsx": _OOXML + "spreadsheetml.sheet",
    ".pptx": _OOXML + "presentationml.presentation", ".ods": "application/vnd.oasis.opendocument.spreadsheet", ".xls": "application/vnd.ms-excel",
    ".html": "text/html", ".htm": "text/html", ".xhtml": "application/xhtml+xml", ".mhtml": "multipart/related", ".mht": "multipart/related",
    ".csv": "text/csv", ".json": "application/json", ".jsonl": "application/json", ".ipynb": "application/json", ".md": "text/markdown",
    ".markdown": "text/markdown", ".txt": "text/plain", ".text": "text/plain", ".xml": "text/xml", ".rss": "application/rss+xml",
    ".atom": "application/atom+xml", ".epub": "application/epub+zip", ".mobi": "application/x-mobipocket-ebook", ".azw": "application/vnd.amazon.ebook",
    ".azw3": "application/vnd.amazon.ebook", ".zip": "application/zip", ".msg": "application/vnd.ms-outlook", ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".tiff": "image/tiff", ".tif": "image/tiff", ".bmp": "image/bmp",
    ".wav": "audio/x-wav", ".mp3": "audio/mpeg", ".m4a": "audio/mp4", ".flac": "audio/flac", ".mp4": "video/mp4", ".rtf": "text/rtf",
}
EXTENSION_OF = {m: e for e, m in reversed(MIME_OF.items())} | {"application/json": ".json", "text/html": ".html", "image/jpeg": ".jpg", "audio/wav": ".wav"}
#: Media types of text that don't begin with text/.
TEXTUAL = frozenset(["application/json", "application/xml", "application/xhtml+xml", "application/rss+xml", "application/atom+xml", "application/markdown", "application/x-ipynb+json", "message/rfc822"])

OLE = bytes.fromhex("d0cf11e0a1b11ae1")


def extension(name: str | None) -> str | None:
    """Lower-case extension with its dot, of at most ten characters."""
    m = re.search(r"\.([^./\\]{1,10})$", name or "")
    return "." + m[1].lower() if m else None


def normal_extension(ext: str | None) -> str | None:
    e = (ext or "").strip().lstrip(".").lower()
    return f".{e}" if e else None


def normal_charset(name: str | None) -> str | None:
    """The codec's own name; unknown names stay."""
    if not name:
        return None
    try:
        return codecs.lookup(name.strip("\"' ")).name
    except LookupError:
        return name


def sniff(data: bytes) -> str | None:
    """The media type by the first bytes."""
    head = data[:4096]
    if head[:5] == b"%PDF-" or b"%PDF-" in head[:1024]:
        return MIME_OF[".pdf"]
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return _zip_kind(data)
    if head[:8] == OLE:
        if "__properties_version1.0".encode("utf-16-le") in data or "__substg1.0_".encode("utf-16-le") in data:
            return MIME_OF[".msg"]
        return MIME_OF[".xls"] if any(x.encode("utf-16-le") in data for x in ("Workbook", "Book")) else "application/x-ole-storage"
    for start, ext in ((b"\xff\xd8\xff", ".jpg"), (b"\x89PNG\r\n\x1a\n", ".png"), (b"GIF8", ".gif"), (b"II*\0", ".tiff"), (b"MM\0*", ".tiff"), (b"fLaC", ".flac"), (b"ID3", ".mp3"), (b"{\\rtf", ".rtf")):
        if head.startswith(start):
            return MIME_OF[ext]
    if head[:4] == b"RIFF" and head[8:12] in (b"WEBP", b"WAVE"):
        return MIME_OF[".webp" if head[8:12] == b"WEBP" else ".wav"]
    if head[4:8] == b"ftyp":
        return MIME_OF[".m4a" if head[8:11] == b"M4A" else ".mp4"]
    if head[60:68] == b"BOOKMOBI":
        return MIME_OF[".mobi"]
    if head[:2] == b"BM" and len(data) >= 26 and struct.unpack("<I", head[14:18])[0] in (12, 40, 52, 56, 108, 124):
        return MIME_OF[".bmp"]
    if len(head) > 1 and head[0] == 0xFF and head[1] & 0xE0 == 0xE0 and head[1] & 0x06:
        return None if head[:2] == b"\xff\xfe" else MIME_OF[".mp3"]
    return _text_kind(head)


def _zip_kind(data: bytes) -> str:
    """Office files and books tell themselves apart by the names within."""
    for part, ext in ((b"word/", ".docx"), (b"xl/", ".xlsx"), (b"ppt/", ".pptx")):
        if b"[Content_Types].xml" in data and part in data:
            return MIME_OF[ext]
    if b"mimetypeapplication/epub+zip" in data[:128]:
        return MIME_OF[".epub"]
    if b"mimetypeapplication/vnd.oasis.opendocument.spreadsheet" in data[:128]:
        return MIME_OF[".ods"]
    return MIME_OF[".zip"]


def _text_kind(head: bytes) -> str | None:
    if not head or b"\0" in head and head[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        return None
    low = head.lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    if re.match(rb"(?:[a-z-]+: [^\n]*\r?\n(?:[ \t][^\n]*\n)*)*mime-version:", low):
        return "multipart/related" if b"multipart/related" in low[:2048] else "message/rfc822"
    if low.startswith((b"<!doctype html", b"<html")) or b"<html" in low[:1024]:
        return "text/html"
    if low.startswith(b"<?xml") or re.match(rb"<[a-z][\w:.-]*[\s/>]", low):
        return "application/rss+xml" if b"<rss" in low[:2048] else "application/atom+xml" if b"<feed" in low[:2048] else "text/xml"
    if low[:1] in (b"{", b"["):
        return "application/json"
    control = sum(c < 9 or 13 < c < 32 and c != 27 for c in head)
    return "text/plain" if control == 0 or head[:2] in (b"\xff\xfe", b"\xfe\xff") else None


_BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def guess_charset(data: bytes) -> str:
    """Of a sample: ASCII, UTF-8, or what a detector finds most likely."""
    sample = data[: 64 * 1024]
    for bom, name in _BOMS:
        if sample.startswith(bom):
            return name
    if sample.isascii():
        return "ascii"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(sample)
        return "utf-8"
    except UnicodeDecodeError:
        pass
    for name in ("cp932", "shift_jis", "euc_jp", "gb18030"):  # double-byte text that decodes and holds kana or ideographs
        try:
            text = codecs.getincrementaldecoder(name)().decode(sample)
        except UnicodeDecodeError:
            continue
        wide = sum("\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" for c in text)
        if wide > 0.5 * sum(c > "\x7f" for c in text) and (name != "gb18030" or wide > 8):
            return name
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(sample).best()
        if best is not None:
            return best.encoding
    except ImportError:
        pass
    return "cp1252"


_META = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)")


def decode(data: bytes, charset: str | None = None, html: bool = False) -> str:
    """Text of bytes: byte order mark, then the hint, for HTML its own declaration, then a guess; never fails."""
    for bom, name in _BOMS:
        if data.startswith(bom):
            return data.decode(name, "replace").removeprefix("\ufeff")
    names = [charset]
    if html and not charset:
        names += [m.decode() for m in _META.findall(data[:4096])]
    for name in names:
        if name:
            try:
                return data.decode(codecs.lookup(name).name)
            except (LookupError, UnicodeDecodeError, ValueError):
                continue
    name = guess_charset(data)
    try:
        return data.decode("utf-8" if name == "ascii" else name)
    except (LookupError, UnicodeDecodeError):
        return data.decode("utf-8", "replace")


def is_textual(mime: str | None) -> bool:
    m = (mime or "").split(";")[0].strip().lower()
    return m.startswith("text/") or m in TEXTUAL


def base_info(path: str | None = None, url: str | None = None) -> Info:
    """What a path or an address tells."""
    if path:
        p = PurePosixPath(path.replace("\\", "/"))
        return Info(local_path=path, filename=p.name or None, extension=extension(p.name))
    if url:
        name = unquote(PurePosixPath(urlsplit(url).path).name)
        ext = extension(name)
        return Info(url=url, extension=ext, filename=name if ext else None)
    return Info()


def guesses(data: bytes, base: Info) -> list[Info]:
    """One guess where the hints and the content agree, or the hints first and then the content."""
    ext = normal_extension(base.extension) or extension(base.filename) or extension(base.local_path)
    if not ext and base.url and not base.url.startswith("data:"):
        ext = extension(urlsplit(base.url).path)
    mime = base.mimetype
    known = base.updated(extension=ext, mimetype=mime or MIME_OF.get(ext or ""))
    if not ext and mime:
        known = known.updated(extension=EXTENSION_OF.get(mime.split(";")[0].strip().lower()))
    kind = sniff(data)
    if kind is None:
        return [known]
    charset = normal_charset(guess_charset(data)) if is_textual(kind) else None
    found = Info(mimetype=kind, extension=EXTENSION_OF.get(kind), charset=charset)
    if known.mimetype is None and known.extension is None:
        return [known.updated(found, charset=known.charset or charset)]
    same = _agree(known, found)
    if same:
        return [known.updated(charset=known.charset or (charset if is_textual(known.mimetype) or not known.mimetype else None), mimetype=known.mimetype or kind, extension=known.extension or found.extension)]
    return [known, base.updated(found)]


def _agree(a: Info, b: Info) -> bool:
    """Whether the content may be what the hints say: text may be any kind of text."""
    kind, other = (a.mimetype or "").split(";")[0].lower(), b.mimetype or ""
    if a.charset and b.charset and normal_charset(a.charset) != normal_charset(b.charset) and "ascii" not in (normal_charset(a.charset), normal_charset(b.charset)):
        return False
    if not kind or kind == other or a.extension and MIME_OF.get(a.extension) == other:
        return True
    if is_textual(kind) and is_textual(other):
        return True
    return {kind, other} <= {"audio/mp4", "video/mp4", "audio/x-m4a"} or other == MIME_OF[".zip"] and "zip" in kind


# -- the same as columns, for routing before any content is read ---------------------------------


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def extension_column(name: Column) -> Column:
    e = F.lower(F.regexp_extract(name, r"\.([^./\\]{1,10})$", 1))
    return F.when(e != "", F.concat(F.lit("."), e))


def url_extension_column(url: Column) -> Column:
    return extension_column(F.regexp_replace(url, r"[?#].*$", ""))


def mime_column(ext: Column) -> Column:
    return _lookup(F.coalesce(ext, F.lit("")), MIME_OF)


def magic_column(content: Column) -> Column:
    """The media type by the first bytes, where a few bytes tell."""
    head = F.hex(F.substring(content, 1, 16))
    tests = [("255044462D", ".pdf"), ("504B0304", ".zip"), ("FFD8FF", ".jpg"), ("89504E470D0A1A0A", ".png"), ("47494638", ".gif"), ("49492A00", ".tiff"), ("4D4D002A", ".tiff"), ("664C6143", ".flac"), ("494433", ".mp3"), ("7B5C727466", ".rtf")]
    out = F.lit(None).cast("string")
    for start, ext in reversed(tests):
        out = F.when(head.startswith(start), MIME_OF[ext]).otherwise(out)
    return F.when(head.rlike("^52494646.{8}57454250"), MIME_OF[".webp"]).when(head.rlike("^52494646.{8}57415645"), MIME_OF[".wav"]).otherwise(out)
