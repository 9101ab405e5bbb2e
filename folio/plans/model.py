"""The data model: what is known about an input, the options, and the result of a conversion."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import types as T

INFO_FIELDS = ("mimetype", "extension", "charset", "filename", "local_path", "url")


@dataclass(frozen=True)
class Info:
    """Hints about an input; every field may be unknown."""

    mimetype: str | None = None
    extension: str | None = None
    charset: str | None = None
    filename: str | None = None
    local_path: str | None = None
    url: str | None = None

    def updated(self, *others: Info | None, **values: Any) -> Info:
        """What others know wins where they know it; keyword values win even if null."""
        known: dict[str, Any] = {}
        for o in others:
            if o is not None:
                known |= {f.name: v for f in fields(o) if (v := getattr(o, f.name)) is not None}
        return replace(self, **(known | values))


@dataclass(frozen=True)
class Options:
    """How to convert; ships to the workers with the converters."""

    keep_data_uris: bool = False
    #: escape pipes and line ends in table cells and pad to the widest row, not to the header
    gfm_safe: bool = False
    #: render only a page's main content where it has a clear one
    main_content: bool = False
    #: fail on pages that are too deep instead of falling back to their text
    strict: bool = False
    #: read archives of the caller's own whole, whatever the number and the size of their files; others have budgets
    whole_archives: bool = False
    hooks: Any = None


def asked(hooks: Any, name: str, *args: Any) -> Any:
    """What a hook says; nothing where there is none or where it fails, in whatever way a service may."""
    hook = getattr(hooks, name, None)
    try:
        return hook(*args) if hook else None
    except Exception:
        return None


@dataclass
class Result:
    """Markdown and title; ``degraded`` if something known to be there was left out."""

    markdown: str
    title: str | None = None
    degraded: bool = False

    def __post_init__(self) -> None:
        if self.title is not None and not self.title.strip():
            self.title = None

    @property
    def text_content(self) -> str:
        return self.markdown

    def __str__(self) -> str:
        return self.markdown


class ConversionError(Exception):
    """A converter took an input and couldn't read it."""


class MissingDependency(ConversionError):
    """A hook or library that the input needs isn't there."""


class Unsupported(Exception):
    """No converter takes the input."""


INFO = T.StructType([T.StructField(f, T.StringType()) for f in INFO_FIELDS])
ATTEMPT = T.StructType([T.StructField(f, T.StringType()) for f in ("converter", "error_class", "message")])
INPUT = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("hint", INFO)])
OUTPUT = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("info", INFO),
        T.StructField("converter", T.StringType()),
        T.StructField("markdown", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("degraded", T.BooleanType()),
        T.StructField("status", T.StringType()),
        T.StructField("attempts", T.ArrayType(ATTEMPT)),
    ]
)
