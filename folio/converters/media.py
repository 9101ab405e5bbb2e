"""Images and audio: what their headers say, and what injected hooks see or hear."""

from __future__ import annotations

import struct

from folio.plans.detect import MIME_OF
from folio.plans.model import ConversionError, Info, Options, Result, asked

# The fields that are shown, in order.
IMAGE_FIELDS = "ImageSize Format Title Caption Description Keywords Artist Author DateTimeOriginal CreateDate GPSPosition".split()
AUDIO_FIELDS = "Title Artist Author Band Album Genre Track DateTimeOriginal CreateDate Duration NumChannels SampleRate AvgBytesPerSec BitsPerSample".split()


# -- images -------------------------------------------------------------------------------------


def _exif(tiff: bytes, out: dict[str, str]) -> None:
    """The fields of a TIFF structure that are shown."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 8:
        return
    names = {0x010E: "Description", 0x013B: "Artist", 0x0132: "CreateDate", 0x9003: "DateTimeOriginal", 0x9004: "CreateDate", 0x9C9B: "Title", 0x9C9D: "Author", 0x9C9E: "Keywords"}
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
    todo, seen, gps = [(struct.unpack(order + "I", tiff[4:8])[0], False)], set(), {}
    while todo:
        at, in_gps = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        n = struct.unpack(order + "H", tiff[at : at + 2])[0]
        for i in range(min(n, 512)):
            entry = tiff[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                break
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            size = sizes.get(kind, 1) * count
            raw = entry[8 : 8 + size] if size <= 4 else tiff[(p := struct.unpack(order + "I", entry[8:12])[0]) : p + min(size, 1 << 16)]
            if tag in (0x8769, 0x8825):
                todo.append((struct.unpack(order + "I", entry[8:12])[0], tag == 0x8825))
            elif in_gps and tag in (1, 2, 3, 4):
                gps[tag] = raw.rstrip(b"\0").decode("latin-1") if kind == 2 else [a / b if b else 0.0 for a, b in struct.iter_unpack(order + "II", raw[: len(raw) // 8 * 8])]
            elif tag in names and not in_gps:
                text = raw.decode("utf-16-le", "replace") if tag >= 0x9C9B else raw.decode("utf-8", "replace")
                if text := text.split("\0")[0].strip() if tag < 0x9C9B else text.rstrip("\0").strip():
                    out.setdefault(names[tag], text)
            elif tag == 0x0100 and kind in (3, 4):
                out.setdefault("_w", str(struct.unpack(order + ("H" if kind == 3 else "I"), raw[: 2 if kind == 3 else 4])[0]))
            elif tag == 0x0101 and kind in (3, 4):
                out.setdefault("_h", str(struct.unpack(order + ("H" if kind == 3 else "I"), raw[: 2 if kind == 3 else 4])[0]))
    if all(len(gps.get(k) or "") for k in (1, 2, 3, 4)):
        degrees = lambda v: sum(x / 60**i for i, x in enumerate(v))
        out["GPSPosition"] = f"{degrees(gps[2]):.6f} {gps[1]}, {degrees(gps[4]):.6f} {gps[3]}"


def image_fields(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        w, h = struct.unpack(">II", data[16:24])
        out |= {"ImageSize": f"{w}x{h}", "Format": "PNG"}
        at = 8
        while at + 8 <= len(data):
            n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + n]
            if kind == b"tEXt" and b"\0" in body:
                k, v = body.split(b"\0", 1)
                out.setdefault({"Creation Time": "CreateDate", "Comment": "Caption"}.get(k.decode("latin-1"), k.decode("latin-1")), v.decode("latin-1").strip())
            elif kind == b"iTXt" and body.count(b"\0") >= 4 and body.split(b"\0", 1)[1][:1] == b"\0":
                k, rest = body.split(b"\0", 1)
                out.setdefault(k.decode("latin-1"), rest[2:].split(b"\0", 2)[-1].decode("utf-8", "replace").strip())
            elif kind == b"eXIf":
                _exif(body, out)
            at += 12 + n
    elif data[:2] == b"\xff\xd8":
        out["Format"], at = "JPEG", 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            marker, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + n]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
                h, w = struct.unpack(">HH", body[1:5])
                out["ImageSize"] = f"{w}x{h}"
            elif marker == 0xE1 and body[:6] == b"Exif\0\0":
                _exif(body[6:], out)
            elif marker == 0xFE:
                out.setdefault("Caption", body.decode("utf-8", "replace").strip("\0 "))
            elif marker == 0xDA:
                break
            at += 2 + n
    elif data[:4] == b"GIF8":
        w, h = struct.unpack("<HH", data[6:10])
        out |= {"ImageSize": f"{w}x{h}", "Format": "GIF"}
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        out["Format"], kind = "WEBP", data[12:16]
        if kind == b"VP8X":
            out["ImageSize"] = f"{int.from_bytes(data[24:27], 'little') + 1}x{int.from_bytes(data[27:30], 'little') + 1}"
        elif kind == b"VP8L":
            v = int.from_bytes(data[21:25], "little")
            out["ImageSize"] = f"{(v & 0x3FFF) + 1}x{(v >> 14 & 0x3FFF) + 1}"
        elif kind == b"VP8 ":
            out["ImageSize"] = "x".join(str(x & 0x3FFF) for x in struct.unpack("<HH", data[26:30]))
    elif data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        out |= {"ImageSize": f"{w}x{abs(h)}", "Format": "BMP"}
    elif data[:4] in (b"II*\0", b"MM\0*"):
        out["Format"] = "TIFF"
        _exif(data, out)
        if "_w" in out and "_h" in out:
            out["ImageSize"] = f"{out['_w']}x{out['_h']}"
    else:
        raise ConversionError("not an image that can be read")
    return out


def image(data: bytes, info: Info, options: Options) -> Result:
    """Header fields, and a hook's description; degraded without one."""
    try:
        fields = image_fields(data)
    except (struct.error, IndexError) as e:
        raise ConversionError(f"corrupt image: {e}") from e
    out = "".join(f"{k}: {fields[k]}\n" for k in IMAGE_FIELDS if fields.get(k))
    said = asked(options.hooks, "caption", data, info.mimetype or MIME_OF.get(info.extension or "", "application/octet-stream"))
    text = asked(options.hooks, "ocr", data)
    if said:
        out += f"\n# Description:\n{said.strip()}\n"
    if text:
        out += f"\n*[Image OCR]\n{text}\n[End OCR]*\n"
    return Result(out, degraded=not (said or text))


# -- audio --------------------------------------------------------------------------------------

_ID3 = {"TIT2": "Title", "TPE1": "Artist", "TPE2": "Band", "TALB": "Album", "TCON": "Genre", "TRCK": "Track", "TCOM": "Author", "TDRC": "CreateDate", "TYER": "CreateDate", "TDOR": "DateTimeOriginal", "TT2": "Title", "TP1": "Artist", "TP2": "Band", "TAL": "Album", "TCO": "Genre", "TRK": "Track"}
_VORBIS = {"title": "Title", "artist": "Artist", "albumartist": "Band", "album": "Album", "genre": "Genre", "tracknumber": "Track", "composer": "Author", "date": "CreateDate"}
_ATOMS = {b"\xa9nam": "Title", b"\xa9ART": "Artist", b"aART": "Band", b"\xa9alb": "Album", b"\xa9gen": "Genre", b"\xa9wrt": "Author", b"\xa9day": "CreateDate"}
_RIFF = {b"INAM": "Title", b"IART": "Artist", b"IPRD": "Album", b"IGNR": "Genre", b"ITRK": "Track", b"ICRD": "CreateDate"}


def clock(seconds: float) -> str:
    """Hours, minutes and seconds."""
    s = int(seconds)
    return f"{s // 3600}:{s // 60 % 60:02}:{s % 60:02}" if s >= 3600 else f"{s // 60}:{s % 60:02}"


def _text(raw: bytes) -> str:
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(code, "replace").strip("\0 ﻿")


def _id3(data: bytes, out: dict[str, str]) -> int:
    """Tags at the start; returns where they end."""
    if data[:3] != b"ID3":
        return 0
    calm = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    version, end = data[3], 10 + calm(data[6:10])
    at, head = 10, 6 if version == 2 else 10
    while at + head < min(end, len(data)) and data[at]:
        if version == 2:
            name, size = data[at : at + 3], int.from_bytes(data[at + 3 : at + 6], "big")
        else:
            name, size = data[at : at + 4], calm(data[at + 4 : at + 8]) if version == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        key = _ID3.get(name.decode("latin-1"))
        if key:
            out.setdefault(key, _text(data[at + head : at + head + size]))
        at += head + size
    return end


def _mpeg(data: bytes, at: int, out: dict[str, str]) -> None:
    """The first frame of an MPEG audio stream."""
    rates, kbit = (44100, 48000, 32000), (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
    for i in range(at, min(len(data) - 4, at + 65536)):
        if data[i] == 0xFF and data[i + 1] & 0xE6 == 0xE2 and data[i + 2] >> 4 not in (0, 15) and data[i + 2] >> 2 & 3 != 3:
            v1 = data[i + 1] >> 3 & 3 == 3
            rate = rates[data[i + 2] >> 2 & 3] // (1 if v1 else 2 if data[i + 1] >> 3 & 3 == 2 else 4)
            out |= {"SampleRate": str(rate), "NumChannels": "1" if data[i + 3] >> 6 == 3 else "2"}
            if v1:
                out["Duration"] = clock((len(data) - i) * 8 / (kbit[data[i + 2] >> 4] * 1000))
            return


def _atoms(data: bytes, out: dict[str, str]) -> None:
    stack = [(0, len(data), b"")]
    while stack:
        at, end, parent = stack.pop()
        while at + 8 <= end:
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            head = 8
            if size == 1 and at + 16 <= end:
                size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
            size = size if head <= size <= end - at else end - at
            inner = at + head
            if kind in (b"moov", b"udta", b"ilst", b"trak", b"mdia") or parent == b"ilst":
                stack.append((inner, at + size, b"ilst>" + kind if parent == b"ilst" else kind))
            elif kind == b"meta":
                stack.append((inner + 4, at + size, kind))
            elif kind == b"mvhd":
                wide = data[inner] == 1
                scale, length = struct.unpack(">IQ" if wide else ">II", data[inner + (20 if wide else 12) : inner + (32 if wide else 20)])
                out["Duration"] = clock(length / max(1, scale))
            elif kind == b"data" and parent[5:] in _ATOMS:
                out.setdefault(_ATOMS[parent[5:]], data[inner + 8 : at + size].decode("utf-8", "replace").strip())
            elif kind == b"data" and parent[5:] == b"trkn":
                out.setdefault("Track", str(int.from_bytes(data[inner + 10 : inner + 12], "big")))
            at += size


def audio_fields(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        at, rate = 12, 0
        while at + 8 <= len(data):
            kind, n = struct.unpack("<4sI", data[at : at + 8])
            body = data[at + 8 : at + 8 + n]
            if kind == b"fmt " and len(body) >= 16:
                _, channels, sample, rate, _, bits = struct.unpack("<HHIIHH", body[:16])
                out |= {"NumChannels": str(channels), "SampleRate": str(sample), "AvgBytesPerSec": str(rate), "BitsPerSample": str(bits)}
            elif kind == b"data" and rate:
                out["Duration"] = clock(n / rate)
            elif kind == b"LIST" and body[:4] == b"INFO":
                i = 4
                while i + 8 <= len(body):
                    k, size = struct.unpack("<4sI", body[i : i + 8])
                    if k in _RIFF:
                        out.setdefault(_RIFF[k], body[i + 8 : i + 8 + size].rstrip(b"\0").decode("latin-1"))
                    i += 8 + size + size % 2
            at += 8 + n + n % 2
    elif data[:4] == b"fLaC":
        at, last = 4, False
        while not last and at + 4 <= len(data):
            last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + n]
            if kind == 0 and len(body) >= 18:
                v = int.from_bytes(body[10:18], "big")
                rate = v >> 44
                out |= {"SampleRate": str(rate), "NumChannels": str((v >> 41 & 7) + 1), "BitsPerSample": str((v >> 36 & 31) + 1), "Duration": clock((v & (1 << 36) - 1) / max(1, rate))}
            elif kind == 4:
                i = 4 + int.from_bytes(body[:4], "little")
                count, i = int.from_bytes(body[i : i + 4], "little"), i + 4
                for _ in range(min(count, 1000)):
                    size = int.from_bytes(body[i : i + 4], "little")
                    k, _, v = body[i + 4 : i + 4 + size].decode("utf-8", "replace").partition("=")
                    if k.lower() in _VORBIS:
                        out.setdefault(_VORBIS[k.lower()], v)
                    i += 4 + size
            at += 4 + n
    elif data[4:8] == b"ftyp":
        _atoms(data, out)
    else:
        end = _id3(data, out)
        _mpeg(data, end, out)
        if data[-128:-125] == b"TAG":
            for k, lo, hi in (("Title", 3, 33), ("Artist", 33, 63), ("Album", 63, 93)):
                if v := data[-128:][lo:hi].split(b"\0")[0].decode("latin-1").strip():
                    out.setdefault(k, v)
        if not out:
            raise ConversionError("not audio that can be read")
    return out


def audio(data: bytes, info: Info, options: Options) -> Result:
    """Header fields, and a hook's transcript; degraded without one."""
    try:
        fields = audio_fields(data)
    except (struct.error, IndexError) as e:
        raise ConversionError(f"corrupt audio: {e}") from e
    out = "".join(f"{k}: {fields[k]}\n" for k in AUDIO_FIELDS if fields.get(k))
    listen = getattr(options.hooks, "transcribe", None)
    said = None
    if listen:
        said = listen(data, info.extension or "") or "[No speech detected]"
        out += f"\n\n### Audio Transcript:\n{said}"
    return Result(out.strip(), degraded=said is None)
