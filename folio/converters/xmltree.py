"""XML: a hardened parser into elements, feeds, and generic documents."""

from __future__ import annotations

import re
from xml.etree import ElementTree as ET
from xml.parsers import expat

from folio.plans.detect import decode
from folio.plans.model import ConversionError, Info, Options, Result
from folio.render.html_md import html_to_markdown

#: Levels of elements that are read.
DEPTH = 256


def safe_xml(data: bytes | str, depth: int = DEPTH, keep_prefix: bool = False) -> ET.Element:
    """The root element, namespaces stripped; entity declarations and deeper nesting are refused."""
    parser = expat.ParserCreate(namespace_separator=None)
    builder, level = ET.TreeBuilder(), 0

    def refuse(*_: object) -> None:
        raise ConversionError("XML with entity declarations is refused")

    def local(name: str) -> str:
        return name if keep_prefix else name.rpartition(":")[2]

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal level
        level += 1
        if level > depth:
            raise ConversionError(f"XML nesting exceeds {depth} levels")
        builder.start(local(name), {local(k): v for k, v in attrs.items() if k != "xmlns" and not k.startswith("xmlns:")})

    def end(name: str) -> None:
        nonlocal level
        level -= 1
        builder.end(local(name))

    parser.EntityDeclHandler = parser.UnparsedEntityDeclHandler = parser.ExternalEntityRefHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, builder.data
    parser.buffer_text = True
    try:
        parser.Parse(data, True)
        return builder.close()
    except (expat.ExpatError, AssertionError, ValueError) as e:
        raise ConversionError(f"not well-formed XML: {e}") from e


def all_named(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if e.tag == name]


def _first_text(root: ET.Element, name: str) -> str | None:
    found = next((e for e in root.iter() if e.tag == name), None)
    return found.text or None if found is not None else None


# -- feeds --------------------------------------------------------------------------------------


def is_feed(data: bytes) -> bool:
    try:
        root = safe_xml(data, keep_prefix=True)
    except ConversionError:
        return False
    return root.tag == "rss" or any(e.tag == "rss" for e in root.iter()) or root.tag == "feed" and any(e.tag == "entry" for e in root.iter())


def _body(html: str, options: Options) -> str:
    return html_to_markdown(html, options.keep_data_uris)


def feed(data: bytes, info: Info, options: Options) -> Result:
    """RSS and Atom: a heading and the items with their dates and rendered bodies."""
    root = safe_xml(data, keep_prefix=True)
    if any(e.tag == "rss" for e in root.iter()):
        channel = next((e for e in root.iter() if e.tag == "channel"), None)
        if channel is None:
            raise ConversionError("an RSS feed without a channel")
        title, about, items = _first_text(channel, "title"), _first_text(channel, "description"), all_named(channel, "item")
        dated, when, bodies = "Published on", "pubDate", ("description", "content:encoded")
    elif root.tag == "feed":
        title, about, items = _first_text(root, "title"), _first_text(root, "subtitle"), all_named(root, "entry")
        dated, when, bodies = "Updated on", "updated", ("summary", "content")
    else:
        raise ConversionError("not a feed")
    out = [f"# {title}\n" if title else "# \n" if root.tag == "feed" else "", f"{about}\n" if about else ""]
    for item in items:
        if name := _first_text(item, "title"):
            out.append(f"\n## {name}\n")
        if date := _first_text(item, when):
            out.append(f"{dated}: {date}\n")
        out += [_body(text, options) for b in bodies if (text := _first_text(item, b))]
    return Result("".join(out), title)


# -- any other XML ------------------------------------------------------------------------------


def _words(e: ET.Element) -> str:
    """An element's own text, blanks collapsed."""
    return " ".join(" ".join([e.text or "", *(c.tail or "" for c in e)]).split())


def _cell(s: str) -> str:
    return s.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ").strip()


def _records(node: ET.Element) -> list[str]:
    """Rows of a table, if the children are two or more flat records of one name; else nothing."""
    rows = list(node)
    if len(rows) < 2 or len({r.tag for r in rows}) > 1 or any(len(c) for r in rows for c in r) or not all(len(r) or r.attrib for r in rows):
        return []
    names = list(dict.fromkeys(n for r in rows for n in [*(f"@{a}" for a in r.attrib), *(c.tag for c in r)]))
    lines = [names, ["---"] * len(names)]
    for r in rows:
        fields = {f"@{a}": v for a, v in r.attrib.items()}
        for c in r:
            fields.setdefault(c.tag, _words(c))
        lines.append([_cell(fields.get(n, "")) for n in names])
    return ["| " + " | ".join(map(_cell, x) if i == 0 else x) + " |" for i, x in enumerate(lines)]


def _outline(node: ET.Element, level: int, out: list[str]) -> None:
    marks = f" ({', '.join(f'{k}={v}' for k, v in node.attrib.items())})" if node.attrib else ""
    text = _words(node)
    out.append(f"{'  ' * level}- **{node.tag}**{marks}" + (f": {text}" if text else ""))
    rows = _records(node)
    out += [f"{'  ' * (level + 1)}{r}" for r in rows]
    for c in [] if rows else node:
        _outline(c, level + 1, out)


def generic(data: bytes, info: Info, options: Options) -> Result:
    """A table of records, or an outline."""
    raw = decode(data, info.charset)
    root = safe_xml(re.sub(r"^\s*<\?xml[^>]*\?>", "", raw))
    out: list[str] = _records(root)
    if not out:
        for c in root:
            _outline(c, 0, out)
    if not len(root) and _words(root):
        out = [_words(root)]
    return Result(f"# {root.tag}\n\n" + "\n".join(out) + "\n", root.tag)
