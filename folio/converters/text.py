"""Plain text, tables of separated values, notebooks and rich text."""

from __future__ import annotations

import csv
import io
import json
import re

from folio.plans.detect import decode
from folio.plans.model import ConversionError, Info, Options, Result
from folio.render.table_md import table


def plain(data: bytes, info: Info, options: Options) -> Result:
    return Result(decode(data, info.charset))


def separated(data: bytes, info: Info, options: Options) -> Result:
    """A Markdown table; the first row is the header."""
    csv.field_size_limit(1 << 30)
    rows = list(csv.reader(io.StringIO(decode(data, info.charset))))
    return Result(table(rows, options.gfm_safe))


def is_notebook(data: bytes) -> bool:
    return b"nbformat" in data and b"nbformat_minor" in data


def notebook(data: bytes, info: Info, options: Options) -> Result:
    try:
        book = json.loads(decode(data, info.charset))
        parts, title = [], None
        for cell in book.get("cells", []):
            source = cell.get("source", [])
            lines = source.splitlines(keepends=True) if isinstance(source, str) else source
            body, kind = "".join(lines), cell.get("cell_type")
            if kind == "markdown":
                parts.append(body)
                title = title or next((x[2:].strip() for x in lines if x.startswith("# ")), None)
            elif kind in ("code", "raw"):
                parts.append(f"```{'python' if kind == 'code' else ''}\n{body}\n```")
        return Result("\n\n".join(parts), (book.get("metadata") or {}).get("title", title))
    except (ValueError, AttributeError, TypeError) as e:
        raise ConversionError(f"not a notebook: {e}") from e


# Control words that stand for a character, and groups that hold no text.
_RTF_CHARS = {"par": "\n", "line": "\n", "row": "\n", "sect": "\n", "page": "\n", "tab": "\t", "cell": "|", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "emspace": " ", "enspace": " "}
_RTF_SKIP = frozenset("fonttbl colortbl stylesheet info pict object listtable listoverridetable rsidtbl generator themedata colorschememapping datastore latentstyles header footer xmlnstbl filetbl revtbl".split())
_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.S | re.I)


def rtf(data: bytes, info: Info, options: Options) -> Result:
    """The text of a rich text file."""
    text = data.decode("latin-1")
    if not text.lstrip().startswith("{\\rtf"):
        raise ConversionError("not rich text")
    page = re.search(r"\\ansicpg(\d+)", text)
    codec = f"cp{page[1]}" if page else "cp1252"
    out: list[str] = []
    pending = bytearray()
    stack: list[tuple[bool, int]] = []
    silent, skip_after, skip = False, 1, 0

    def flush() -> None:
        if pending:
            try:
                out.append(pending.decode(codec, "replace"))
            except LookupError:
                out.append(pending.decode("cp1252", "replace"))
            pending.clear()

    for m in _RTF.finditer(text):
        word, number, code, symbol, brace, char = m.groups()
        if not code:
            flush()
        if brace == "{":
            stack.append((silent, skip_after))
            skip = 0
        elif brace == "}":
            silent, skip_after = stack.pop() if stack else (silent, skip_after)
            skip = 0
        elif symbol is not None:
            if symbol == "*":
                silent = True
            elif not silent and symbol in "{}\\~_-":
                out.append({"~": "\xa0", "_": "-", "-": ""}.get(symbol, symbol))
            elif not silent and symbol in "\r\n":
                out.append("\n")
        elif word:
            word = word.lower()
            if word in _RTF_SKIP:
                silent = True
            elif word == "uc":
                skip_after = int(number or 1)
            elif word == "u" and not silent:
                n = int(number or 0)
                out.append(chr(n if n >= 0 else n + 0x10000))
                skip = skip_after
            elif word in _RTF_CHARS and not silent:
                out.append(_RTF_CHARS[word])
        elif code:
            if skip:
                skip -= 1
            elif not silent:
                pending.append(int(code, 16))
        elif char:
            if skip:
                skip -= 1
            elif not silent:
                out.append(char)
    flush()
    return Result("".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip())
