"""The converters, what each takes, and the order in which they are tried."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from folio.converters import archive, books, media, office, ole, text, web, xmltree
from folio.converters import pdf as pdf_
from folio.hooks import ANALYZERS, CANONICAL, MODALITY
from folio.plans import detect
from folio.plans.model import ConversionError, Info, Options, Result, Unsupported

SPECIFIC, GENERIC = 0.0, 10.0
#: Plugins are modules of this group with a function register_converters(registry, **options).
PLUGIN_GROUP = "folio.plugin"
#: Characters that are normalised at once, up to the end of a line.
PIECE = 1 << 20


@dataclass(frozen=True)
class Converter:
    """A name, what it takes by name and type (and content, if given), and how it converts.

    ``accepts`` gets the hints and the bytes; ``convert`` gets the bytes, the hints and the options.
    """

    name: str
    convert: Callable[[bytes, Info, Options], Result]
    extensions: tuple[str, ...] = ()
    mimes: tuple[str, ...] = ()
    accepts_more: Callable[[Info, bytes], bool] | None = None
    #: instead of names and types
    accepts_only: Callable[[Info, bytes], bool] | None = None
    notes: str = ""

    def accepts(self, info: Info, data: bytes) -> bool:
        if self.accepts_only is not None:
            return self.accepts_only(info, data)
        mime = (info.mimetype or "").lower()
        return (info.extension or "").lower() in self.extensions or any(mime.startswith(m) for m in self.mimes) or self.accepts_more is not None and self.accepts_more(info, data)


def _page(info: Info) -> bool:
    return (info.extension or "") in (".html", ".htm") or (info.mimetype or "").lower().startswith(("text/html", "application/xhtml"))


def _is_json(info: Info) -> bool:
    return (info.mimetype or "").lower().startswith("application/json") or (info.extension or "") == ".json"


def _xml_like(info: Info) -> bool:
    return (info.extension or "") == ".xml" or (info.mimetype or "").lower().startswith(("text/xml", "application/xml"))


_WORD, _SHEET, _SLIDES = (detect.MIME_OF[e] for e in (".docx", ".xlsx", ".pptx"))

#: In the order in which they are tried: the special ones, and then the general ones. Names, extensions
#: and media types, and the order.
SPECIAL = [
    Converter("csv", text.separated, (".csv",), ("text/csv", "application/csv"), notes="the first row is the header"),
    Converter("epub", books.epub, (".epub",), ("application/epub", "application/epub+zip", "application/x-epub+zip"), notes="details, then chapters in reading order"),
    Converter("msg", ole.msg, (".msg",), ("application/vnd.ms-outlook",), lambda i, d: not i.extension and not i.mimetype and ole.is_mail(d), notes="headers and body"),
    Converter("pdf", pdf_.pdf, (".pdf",), ("application/pdf", "application/x-pdf"), notes="forms as tables, layout as headings, lists and paragraphs"),
    Converter("ipynb", text.notebook, (".ipynb",), (), lambda i, d: _is_json(i) and text.is_notebook(d), notes="cells in order"),
    Converter("image", media.image, (".jpg", ".jpeg", ".png", ".gif", ".webp", ".tiff", ".tif", ".bmp"), ("image/jpeg", "image/png", "image/gif", "image/webp", "image/tiff", "image/bmp"), notes="header fields, description by a hook"),
    Converter("audio", media.audio, (".wav", ".mp3", ".m4a", ".mp4", ".flac"), ("audio/x-wav", "audio/wav", "audio/mpeg", "audio/mp4", "audio/flac", "video/mp4"), notes="header fields, transcript by a hook"),
    Converter("pptx", office.pptx, (".pptx",), (_SLIDES,), notes="slides, tables, charts and notes"),
    Converter("xls", ole.xls, (".xls",), ("application/vnd.ms-excel", "application/excel"), notes="sheets as tables"),
    Converter("xlsx", office.xlsx, (".xlsx",), (_SHEET,), notes="sheets as tables"),
    Converter("ods", office.ods, (".ods",), ("application/vnd.oasis.opendocument.spreadsheet",), notes="sheets as tables"),
    Converter("docx", office.docx, (".docx",), (_WORD,), notes="headings, lists, tables, images, math, notes and comments"),
    Converter("mobi", books.mobi, (".mobi", ".azw", ".azw3", ".prc"), ("application/x-mobipocket-ebook", "application/vnd.amazon.ebook"), lambda i, d: books.is_mobi(d), notes="text of unprotected books"),
    Converter("mhtml", web.mhtml, (".mhtml", ".mht"), ("multipart/related", "message/rfc822", "application/x-mimearchive"), lambda i, d: not i.extension and web.is_archive(d), notes="the page of a saved archive"),
    Converter("rtf", text.rtf, (".rtf",), ("text/rtf", "application/rtf"), notes="text"),
    Converter("bing", web.bing, accepts_only=lambda i, d: bool(web.BING.match(i.url or "")) and _page(i), notes="results of a search page"),
    Converter("youtube", web.youtube, accepts_only=lambda i, d: web.youtube_url(i.url) and _page(i), notes="title, figures and description, transcript by a hook"),
    Converter("wikipedia", web.wikipedia, accepts_only=lambda i, d: bool(web.WIKIPEDIA.match(i.url or "")) and _page(i), notes="the article"),
    Converter("rss", xmltree.feed, (".rss", ".atom"), ("application/rss", "application/atom"), lambda i, d: _xml_like(i) and xmltree.is_feed(d), notes="items with dates and bodies"),
    Converter("xml", xmltree.generic, (".xml",), ("text/xml", "application/xml"), notes="records as a table, or an outline"),
]
GENERAL = [
    Converter("html", web.html, (".html", ".htm"), ("text/html", "application/xhtml"), notes="the page's body"),
    Converter("zip", lambda d, i, o: Result(""), (".zip",), ("application/zip",), notes="every file in the archive"),
    Converter("plain", text.plain, (".txt", ".text", ".md", ".markdown", ".json", ".jsonl"), ("text/", "application/json", "application/markdown"), lambda i, d: i.charset is not None, notes="as it is"),
]


def _modality(info: Info) -> str | None:
    """The kind of analysis that a service has for a type."""
    mime = (info.mimetype or "").split(";")[0].strip().lower()
    mime = CANONICAL.get(mime, mime)
    return next((k for k, types in MODALITY.items() if mime in types), None)


def _analyze(data: bytes, info: Info, options: Options) -> Result:
    """What an analysis service says, without its page comments."""
    said = options.hooks.analyze(data, info.mimetype, ANALYZERS[_modality(info)])
    if not said:
        raise ConversionError("the service said nothing")
    return Result(re.sub(r"(?s)<!--.*?-->", "", said))


#: Tried first where the caller gave a service.
ANALYSIS = Converter("analysis", _analyze, accepts_only=lambda i, d: _modality(i) is not None, notes="by a service")


def normalise(text: str) -> str:
    """Lines without blanks at their ends, and at most one blank line in a row; a long text goes by pieces, whose lines alone are held."""
    parts, at = [], 0
    while True:
        end = text.find("\n", at + PIECE) + 1 or len(text)
        parts.append("\n".join(ln.rstrip() for ln in re.split(r"\r?\n", text[at:end])))
        at = end
        if at >= len(text):
            return re.sub(r"\n{3,}", "\n\n", "".join(parts))


@dataclass
class Attempt:
    converter: str
    error_class: str
    message: str


@dataclass
class Converted:
    info: Info
    converter: str
    result: Result
    attempts: list[Attempt] = field(default_factory=list)


class FailedConversion(ConversionError):
    """Converters took the input, and all failed."""

    def __init__(self, attempts: list[Attempt]):
        self.attempts = attempts
        super().__init__("; ".join(f"{a.converter}: {a.error_class}: {a.message}" for a in attempts))


class Registry:
    """Converters by priority; among equals the one that was registered last is tried first."""

    def __init__(self, builtins: bool = True):
        self.entries: list[tuple[float, Converter]] = []
        if builtins:
            for c in reversed(GENERAL):
                self.register(c, GENERIC)
            for c in reversed(SPECIAL):
                self.register(c, SPECIFIC)

    def register(self, converter: Converter, priority: float = SPECIFIC) -> None:
        self.entries.insert(0, (priority, converter))

    def ordered(self) -> list[Converter]:
        return [c for _, c in sorted(self.entries, key=lambda e: e[0])]

    def load_plugins(self, **options: object) -> list[str]:
        """Register all installed plugins; one that fails is warned of and left out."""
        done = []
        for p in entry_points(group=PLUGIN_GROUP):
            try:
                p.load().register_converters(self, **options)
                done.append(p.name)
            except Exception as e:  # a plugin may fail in any way
                warnings.warn(f"plugin {p.name} failed to load: {e}", stacklevel=2)
        return done

    def convert(self, data: bytes, info: Info, options: Options, depth: int = 0) -> Converted:
        """The first success of the guesses, and of no guess at all, times the converters."""
        attempts: list[Attempt] = []
        order = self.ordered()
        if getattr(options.hooks, "analyze", None) is not None:
            order = [ANALYSIS, *order]
        for guess in [*detect.guesses(data, info), Info()]:
            for c in order:
                try:
                    if not c.accepts(guess, data):
                        continue
                    if c.name == "zip":
                        got = archive.archive(data, guess.updated(filename=info.filename, url=info.url, local_path=info.local_path) if info != Info() else guess, options, lambda d, i, o, n: self.convert(d, i, o, n).result, depth)
                    else:
                        got = c.convert(data, guess, options)
                except Exception as e:  # whatever a broken input does to a converter is that converter's failure
                    attempts.append(Attempt(c.name, type(e).__name__, str(e)[:500]))
                    continue
                got.markdown = normalise(got.markdown)
                return Converted(guess, c.name, got, attempts)
        if attempts:
            raise FailedConversion(attempts)
        raise Unsupported(f"no converter takes the input ({info.mimetype or 'unknown type'}, {info.extension or 'no extension'})")


def formats(registry: Registry | None = None) -> list[tuple[str, list[str], str]]:
    """Name, extensions and notes of every converter."""
    return [(c.name, list(c.extensions), c.notes) for c in (registry or Registry()).ordered()]
