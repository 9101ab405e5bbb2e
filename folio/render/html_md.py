"""HTML to Markdown: a forgiving parser into a small tree, and a renderer without recursion."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import quote, unquote

# Fixed values of HTML: elements without content, and those that end when a like one starts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "thead": ({"tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
BLOCKS = frozenset("address article aside body details dl dt dd div fieldset figcaption figure footer form header html main nav section summary caption center".split())
RAW = frozenset(["script", "style"])
#: Elements that the main-content rendering leaves out as page furniture.
FURNITURE = frozenset("script style noscript template svg canvas iframe button select nav dialog".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def find_all(self, tag: str | None = None, **attrs: str) -> list[Node]:
        return [n for n in self.walk() if (tag is None or n.tag == tag) and all(n.matches(k, v) for k, v in attrs.items())]

    def find(self, tag: str | None = None, **attrs: str) -> Node | None:
        return next((n for n in self.walk() if (tag is None or n.tag == tag) and all(n.matches(k, v) for k, v in attrs.items())), None)

    def matches(self, key: str, value: str) -> bool:
        if key == "cls":
            return value in self.attrs.get("class", "").split()
        return self.attrs.get(key) == value

    def text(self, between: str = "", skip: frozenset[str] = RAW) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in skip:
                stack += reversed(n.children)
        return between.join(out)

    def remove(self, tags: frozenset[str]) -> None:
        for n in list(self.walk()):
            n.children = [c for c in n.children if isinstance(c, str) or c.tag not in tags]


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root
        self.open: dict[str, int] = {}

    def _close(self, node: Node) -> None:
        """End ``node`` and all that is open within it."""
        n = self.at
        while True:
            self.open[n.tag] -= 1
            if n is node:
                break
            n = n.parent
        self.at = node.parent

    def _nearest(self, tags, stop) -> Node | None:
        """The outermost of the open elements ``tags`` inside the nearest ``stop``."""
        found, n = None, self.at
        while n is not self.root and n.tag not in stop:
            if n.tag in tags:
                found = n
            n = n.parent
        return found

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS and any(self.open.get(t) for t in ENDS[tag][0]) and (n := self._nearest(*ENDS[tag])):
            self._close(n)
        elif tag in ENDS_P and self.open.get("p") and (n := self._nearest({"p"}, {"table", "td", "th", "li", "button", "object"})):
            self._close(n)
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(self.at)

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            n = self.at
            while n.tag != tag:
                n = n.parent
            self._close(n)

    def handle_data(self, data: str) -> None:
        kids = self.at.children
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


# -- rendering ----------------------------------------------------------------------------------

_BLANK = re.compile(r"[ \t\r\n\f]+")
_ESCAPE = re.compile(r"([*_])")
_LINES = re.compile(r"\n{3,}")


def _trim(text: str) -> tuple[str, str, str]:
    """The blanks before and after a text that count, and the text."""
    inner = text.strip(" \n\t")
    return (" " if text[:1] in (" ", "\n") and inner else "", inner, " " if text[-1:] in (" ", "\n") and inner else "")


def _wrap(mark: str) -> Callable:
    def render(node: Node, text: str, ctx: Context) -> str:
        if ctx.pre:
            return text
        a, inner, b = _trim(text)
        return f"{a}{mark}{inner}{mark}{b}" if inner else ""

    return render


class Context:
    """What the ancestors of an element are, as far as it matters."""

    __slots__ = ("inline", "items", "pre")

    def __init__(self, pre: bool = False, inline: bool = False, items: int = 0):
        self.pre, self.inline, self.items = pre, inline, items

    def inside(self, tag: str) -> Context:
        pre = self.pre or tag in ("pre", "code", "kbd", "samp")
        inline = self.inline or tag in HEADINGS or tag in ("td", "th")
        items = self.items + (tag in ("ul", "ol"))
        return self if (pre, inline, items) == (self.pre, self.inline, self.items) else Context(pre, inline, items)


#: Schemes of links that readers may follow.
FOLLOWED = frozenset(["", "http", "https", "file"])
#: Scheme, the host with its slashes, path, and the rest of an address; every string fits.
_ADDRESS = re.compile(r"(?s)(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(.*)")


def link_target(href: str) -> str | None:
    """An address as it is shown, its path decoded and quoted anew; nothing where the scheme isn't to be followed."""
    scheme, host, path, rest = _ADDRESS.fullmatch(href.strip()).groups(default="")
    if scheme.lower() not in FOLLOWED:
        return None
    return f"{scheme.lower()}{':' if scheme else ''}{host}{quote(unquote(path))}{rest}"


def _reference(label: str, address: str, node: Node) -> str:
    """Markdown that points a label at an address, with the element's title if it has one."""
    title = node.attrs.get("title", "").replace('"', r"\"")
    return f'[{label}]({address} "{title}")' if title else f"[{label}]({address})"


class Renderer:
    """Markdown for a tree; ``keep_data_uris`` keeps embedded images whole."""

    def __init__(self, keep_data_uris: bool = False, skip: frozenset[str] = RAW):
        self.keep_data_uris, self.skip = keep_data_uris, skip
        self._places: dict[int, dict[int, int]] = {}
        self._first: dict[int, bool] = {}
        self.by_tag: dict[str, Callable[[Node, str, Context], str]] = {
            "a": self._a, "img": self._img, "input": self._input, "br": self._br, "hr": lambda n, t, c: "\n\n---\n\n", "p": self._p,
            "b": _wrap("**"), "strong": _wrap("**"), "i": _wrap("*"), "em": _wrap("*"), "del": _wrap("~~"), "s": _wrap("~~"), "strike": _wrap("~~"),
            "code": self._code, "kbd": self._code, "samp": self._code, "pre": self._pre, "blockquote": self._quote, "ul": self._list, "ol": self._list, "li": self._item,
            "table": self._block, "tr": self._row, "td": self._cell, "th": self._cell, "title": lambda n, t, c: "", "head": lambda n, t, c: "", "q": lambda n, t, c: f'"{t}"',
            "textarea": lambda n, t, c: "", "video": self._video,
        }
        for h in HEADINGS:
            self.by_tag[h] = self._heading
        for b in BLOCKS:
            self.by_tag[b] = self._block

    def render(self, root: Node) -> str:
        """Post-order over an explicit stack: depth is bounded by memory only."""
        top: list[str] = []
        stack: list[tuple[Node, Context, list[str], int]] = [(root, Context(), top, 0)]
        outs: list[list[str]] = []
        while stack:
            node, ctx, out, i = stack.pop()
            if i == 0:
                outs.append([])
            parts, inner = outs[-1], ctx.inside(node.tag)
            kids = node.children
            while i < len(kids):
                k = kids[i]
                i += 1
                if isinstance(k, str):
                    parts.append(self._text(k, node, inner, i - 1))
                elif k.tag not in self.skip:
                    stack.append((node, ctx, out, i))
                    stack.append((k, inner, parts, 0))
                    break
            else:
                outs.pop()
                text = self._join(parts)
                out.append(self.by_tag[node.tag](node, text, ctx) if node.tag in self.by_tag else text)
        return self._join(top)

    @staticmethod
    def _join(parts: list[str]) -> str:
        """Side by side, with no more than two line ends where blocks meet."""
        out: list[str] = []
        for p in parts:
            if not p:
                continue
            if out and p[0] == "\n":
                before = len(out[-1]) - len(out[-1].rstrip("\n"))
                here = len(p) - len(p.lstrip("\n"))
                if before + here > 2:
                    p = "\n" * max(0, 2 - before) + p.lstrip("\n") if before < 2 else p.lstrip("\n")
            elif out and out[-1].endswith("\n") and p[0] == " ":
                p = p.lstrip(" ")
            if p:
                out.append(p)
        return "".join(out)

    def _text(self, text: str, node: Node, ctx: Context, i: int) -> str:
        if ctx.pre:
            return text
        text = _BLANK.sub(" ", text)
        if text == " " and (node.tag in ("ul", "ol", "table", "thead", "tbody", "tfoot", "tr", "dl") or self._block_at(node, i - 1) and self._block_at(node, i + 1)):
            return ""
        if self._block_at(node, i - 1) or i == 0 and node.tag in BLOCKS | {"p", "li", "blockquote", ""}:
            text = text.lstrip(" ")
        if self._block_at(node, i + 1):
            text = text.rstrip(" ")
        return _ESCAPE.sub(r"\\\1", text)

    @staticmethod
    def _block_at(node: Node, i: int) -> bool:
        """Whether a block, or the end of one, stands at that place."""
        if not 0 <= i < len(node.children):
            return node.tag in BLOCKS or node.tag in ("p", "li", "blockquote", "", "body")
        k = node.children[i]
        return not isinstance(k, str) and (k.tag in BLOCKS or k.tag in HEADINGS or k.tag in ("p", "ul", "ol", "table", "pre", "blockquote", "hr", "br", "tr", "li", "script", "style"))

    def _block(self, node: Node, text: str, ctx: Context) -> str:
        if ctx.inline:
            return f" {text.strip()} " if text.strip() else ""
        text = text.strip("\n") if node.tag == "table" else text.strip(" \n")
        return f"\n\n{text}\n\n" if text else ""

    def _p(self, node: Node, text: str, ctx: Context) -> str:
        if ctx.inline:
            return f" {text.strip()} "
        text = text.strip(" \n")
        return f"\n\n{text}\n\n" if text else ""

    def _br(self, node: Node, text: str, ctx: Context) -> str:
        return " " if ctx.inline else "\n" if ctx.pre else "  \n"

    def _heading(self, node: Node, text: str, ctx: Context) -> str:
        text = _BLANK.sub(" ", text).strip()
        return f"\n\n{'#' * HEADINGS[node.tag]} {text}\n\n" if text else ""

    def _a(self, node: Node, text: str, ctx: Context) -> str:
        before, label, after = _trim(text)
        if ctx.pre and label:
            return text
        address = link_target(node.attrs.get("href", "")) if label else None
        if not address:  # nothing to click on, or nowhere to go
            return f"{before}{label}{after}"
        bare = "title" not in node.attrs and label.replace(r"\_", "_") == address
        return f"{before}<{address}>{after}" if bare else before + _reference(label, address, node) + after

    def _img(self, node: Node, text: str, ctx: Context) -> str:
        """The image by its address; within a heading or a cell what it shows."""
        label = " ".join(node.attrs.get("alt", "").splitlines())
        if ctx.inline and "data-keep" not in node.attrs:
            return label
        address = node.attrs.get("src") or node.attrs.get("data-src", "")
        embedded = address.startswith("data:") and not self.keep_data_uris
        return "!" + _reference(label, address.partition(",")[0] + "..." if embedded else address, node)

    def _input(self, node: Node, text: str, ctx: Context) -> str:
        box = node.attrs.get("type") == "checkbox"
        return ("[ ] ", "[x] ")["checked" in node.attrs] if box else ""

    def _video(self, node: Node, text: str, ctx: Context) -> str:
        label, src = text.strip(), node.attrs.get("src", "")
        return f"[{label}]({src})" if src and label else text

    def _code(self, node: Node, text: str, ctx: Context) -> str:
        if ctx.pre or not text.strip():
            return text
        a, inner, b = _trim(text)
        ticks = "`" * (1 + max((len(m) for m in re.findall("`+", inner)), default=0))
        pad = " " if inner[0] == "`" or inner[-1] == "`" else ""
        return f"{a}{ticks}{pad}{inner}{pad}{ticks}{b}"

    def _pre(self, node: Node, text: str, ctx: Context) -> str:
        return f"\n\n```\n{text.strip(chr(10))}\n```\n\n" if text.strip() else ""

    def _quote(self, node: Node, text: str, ctx: Context) -> str:
        text = _LINES.sub("\n\n", text.strip(" \n"))
        if ctx.inline or not text:
            return f" {text} " if text else ""
        return "\n\n" + "\n".join(f"> {x}" if x else ">" for x in text.split("\n")) + "\n\n"

    def _list(self, node: Node, text: str, ctx: Context) -> str:
        if node.parent is not None and node.parent.tag == "li":
            return "\n" + text.strip("\n") + "\n" if text.strip() else ""
        return f"\n\n{text.strip(chr(10))}\n\n" if text.strip() else ""

    def _item(self, node: Node, text: str, ctx: Context) -> str:
        text = _LINES.sub("\n\n", text.strip(" \n"))
        if not text:
            return ""
        parent = node.parent
        if parent is not None and parent.tag == "ol":
            start = parent.attrs.get("start", "1")
            mark = f"{(int(start) if start.isdigit() else 1) + self._place(node)}. "
        else:
            mark = "*+-"[(max(1, ctx.items) - 1) % 3] + " "
        pad = " " * len(mark)
        lines = text.split("\n")
        return mark + "\n".join([lines[0], *(pad + x if x else "" for x in lines[1:])]) + "\n"

    def _place(self, node: Node) -> int:
        """How many elements of the kind stand before one among its siblings; each parent's children are counted once."""
        known = self._places.get(id(node.parent))
        if known is None:
            counts: dict[str, int] = {}
            known = self._places[id(node.parent)] = {}
            for c in node.parent.children:
                if isinstance(c, Node):
                    known[id(c)] = counts.get(c.tag, 0)
                    counts[c.tag] = known[id(c)] + 1
        return known[id(node)]

    def _heads(self, parent: Node) -> bool:
        """Whether the first row in ``parent`` is the heading of its table: nothing of the table stands before it."""
        if id(parent) not in self._first:
            if parent.tag in ("tbody", "tfoot"):
                above = parent.parent.children
                before = itertools.takewhile(lambda c: c is not parent, above)
                first = not any(isinstance(c, Node) and c.tag in ("thead", "tr") for c in before)
            else:
                first = parent.tag != "table" or not any(isinstance(c, Node) and c.tag == "thead" for c in parent.children)
            self._first[id(parent)] = first
        return self._first[id(parent)]

    def _cell(self, node: Node, text: str, ctx: Context) -> str:
        span = node.attrs.get("colspan", "1")
        n = min(1000, max(1, int(span))) if span.isdigit() else 1
        return " " + _BLANK.sub(" ", text).strip().replace("|", r"\|") + " |" * n

    def _row(self, node: Node, text: str, ctx: Context) -> str:
        cells = [c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th")]
        if not cells:
            return ""
        head = self._place(node) == 0 and self._heads(node.parent)
        width = sum(min(1000, max(1, int(c.attrs.get("colspan", "1")))) if c.attrs.get("colspan", "1").isdigit() else 1 for c in cells)
        line = f"|{text.strip(chr(10)).rstrip(' ')}\n" if text.strip().endswith("|") else f"|{text}|\n"
        return line + ("| " + " | ".join(["---"] * width) + " |\n" if head else "")




def to_markdown(root: Node, keep_data_uris: bool = False, skip: frozenset[str] = RAW) -> str:
    return _LINES.sub("\n\n", Renderer(keep_data_uris, skip).render(root)).strip()


def html_to_markdown(html: str, keep_data_uris: bool = False) -> str:
    """Markdown of a piece of HTML: its body, or all of it."""
    root = parse(html)
    return to_markdown(root.find("body") or root, keep_data_uris)


def title_of(root: Node) -> str | None:
    t = root.find("title")
    return t.text().strip() or None if t else None


def main_content(root: Node) -> Node | None:
    """The one ``main``, ``role=main`` or ``article`` with enough of the body's text, in that order."""
    body = root.find("body") or root
    whole = len(body.text(skip=FURNITURE).strip().encode())
    for found in (body.find_all("main"), body.find_all(role="main"), body.find_all("article")):
        if len(found) == 1 and (size := len(found[0].text(skip=FURNITURE).strip().encode())) >= 200 and size >= 0.25 * whole:
            return found[0]
    return None
