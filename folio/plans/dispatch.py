"""Conversion of whole tables: one Python pass a row, everything before and after it in Spark."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import effectively_empty, is_effectively_empty
from folio.plans import detect
from folio.plans.model import INFO_FIELDS, OUTPUT, Info, Options, Unsupported
from folio.plans.registry import FailedConversion, Registry
from folio.runtime import ship, spread

#: Characters of Markdown after which rows are handed back.
PART = 4 << 20


def convert_row(doc_id: str | None, content: bytes | None, hint: dict | None, registry: Registry, options: Options) -> dict:
    """A row of the output; never fails."""
    info = Info(**{f: hint.get(f) for f in INFO_FIELDS}) if hint else Info()
    out = {"doc_id": doc_id, "info": {f: getattr(info, f) for f in INFO_FIELDS}, "converter": None, "markdown": None, "title": None, "degraded": False, "status": "ok", "attempts": []}
    if content is None:
        return out | {"status": "invalid_input"}
    try:
        got = registry.convert(bytes(content), info, options)
    except Unsupported:
        return out | {"status": "unsupported"}
    except FailedConversion as e:
        return out | {"status": "failed", "attempts": [vars(a) for a in e.attempts]}
    except (MemoryError, RecursionError) as e:
        return out | {"status": "failed", "attempts": [{"converter": None, "error_class": type(e).__name__, "message": str(e)}]}
    return out | {"info": {f: _clean(getattr(got.info, f)) for f in INFO_FIELDS}, "converter": got.converter, "markdown": _clean(got.result.markdown), "title": _clean(got.result.title), "degraded": got.result.degraded, "attempts": [vars(a) for a in got.attempts]}


def _clean(s: str | None) -> str | None:
    """A string without lone surrogates, which can't be stored."""
    if s is None or s.isascii():
        return s
    try:
        s.encode()
    except UnicodeEncodeError:
        return s.encode("utf-8", "replace").decode()
    return s


def convert_documents(docs: DataFrame, options: Options = Options(), registry: Registry | None = None, keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008  frozen
    """doc_id, content and hint to the output schema; a bad row gets a status, the job goes on.

    The columns ``keep`` go along with each row.

    Rows stay where they are, unless few or small files would leave most cores idle: no shuffle, one
    crossing to Python, and a row's bytes are held by one task.
    """
    ship(docs.sparkSession)
    own = registry or Registry()
    return _converted(docs, lambda doc_id, content, hint_: convert_row(doc_id, content, hint_, own, options), keep)


def convert_made(rows: DataFrame, make: Callable, options: Options = Options(), registry: Registry | None = None, keep: T.StructType = T.StructType()) -> DataFrame:  # noqa: B008  frozen
    """The output of documents that ``make`` writes from rows, in the Python pass that converts them.

    ``make`` gets a task's frames and yields tuples of id, content, hint and the columns ``keep``, in this order. A
    document is never handed to Spark, and a task holds one at a time. Rows are dealt by the caller.
    """
    ship(rows.sparkSession)
    own = registry or Registry()
    return rows.mapInPandas(_run(make, lambda doc_id, content, hint_: convert_row(doc_id, content, hint_, own, options), keep.names), T.StructType([*OUTPUT.fields, *keep.fields]))


def _converted(docs: DataFrame, convert, keep: tuple[str, ...] = ()) -> DataFrame:
    """The output of ``convert`` (id, content and hint to a dict) for every row."""

    def rows(frames):
        for pdf in frames:
            yield from zip(*[pdf[c] for c in ("doc_id", "content", "hint", *keep)], strict=True)

    lean = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content", "hint", *keep)
    return spread(lean).mapInPandas(_run(rows, convert, list(keep)), T.StructType([*OUTPUT.fields, *[lean.schema[c] for c in keep]]))


def _run(make, convert, keep: list[str]):
    """A task's frames to frames of the output in parts of 64 rows or PART characters, which are handed back before they add up."""

    def run(frames):
        part, size = [], 0
        for doc_id, content, hint_, *rest in make(frames):
            row = convert(doc_id, content, hint_)
            del content
            size += len(row["markdown"] or "")
            part.append(row | dict(zip(keep, rest, strict=True)))
            if len(part) == 64 or size > PART:
                yield pd.DataFrame(part, columns=[*OUTPUT.names, *keep])
                part, size = [], 0
        if part:
            yield pd.DataFrame(part, columns=[*OUTPUT.names, *keep])

    return run


def needs_fallback() -> Column:
    return (F.col("status") != "ok") | F.col("degraded") | effectively_empty(F.coalesce("markdown", F.lit("")))


def with_fallback(docs: DataFrame, first: Registry, second: Registry, options: Options = Options()) -> DataFrame:  # noqa: B008  frozen
    """Convert with ``first``; what failed, is degraded or is empty again with ``second``, if that says anything.

    Row by row, in the task that holds the row: ids may repeat or be null, and nothing is shuffled.
    """
    ship(docs.sparkSession)

    def better(row: dict) -> bool:
        return row["status"] == "ok" and not is_effectively_empty(row["markdown"])

    def convert(doc_id, content, hint_) -> dict:
        once = convert_row(doc_id, content, hint_, first, options)
        if better(once) and not once["degraded"] or content is None:
            return once
        again = convert_row(doc_id, content, hint_, second, options)
        return again if better(again) else once

    return _converted(docs, convert)


def hint(**columns: Column | str | None) -> Column:
    """A hint struct; names that aren't given are null."""
    return F.struct(*[(columns[f] if isinstance(columns.get(f), Column) else F.lit(columns.get(f)).cast("string")).alias(f) for f in INFO_FIELDS])


def route_column(extension: Column, mime: Column, url: Column, is_notebook: Column | None = None) -> Column:
    """The converter that names, types and addresses choose: no content is read, so the plan prunes it.

    Null extension or type: as known as they are.
    """
    e, m, u = F.coalesce(extension, F.lit("")), F.lower(F.coalesce(mime, F.lit(""))), F.coalesce(url, F.lit(""))
    page = e.isin(".html", ".htm") | m.startswith("text/html") | m.startswith("application/xhtml")
    out = F.lit(None).cast("string")
    for c in reversed(Registry().ordered()):
        if c.accepts_only is None:
            test = e.isin(*c.extensions)
            for prefix in c.mimes:
                test = test | m.startswith(prefix)
            if c.name == "ipynb" and is_notebook is not None:
                test = test | (m.startswith("application/json") & is_notebook)
        elif c.name == "wikipedia":
            test = page & u.rlike(r"^https?://[a-zA-Z]{2,3}\.wikipedia.org/")
        elif c.name == "bing":
            test = page & u.rlike(r"^https://www\.bing\.com/search\?q=")
        else:
            test = page & u.startswith("https://www.youtube.com/watch?")
        out = F.when(test, F.lit(c.name)).otherwise(out)
    return out


def merge_infos(a: Column, b: Column) -> Column:
    """Field by field, what ``b`` knows over what ``a`` knows."""
    return F.struct(*[F.coalesce(b[f], a[f]).alias(f) for f in INFO_FIELDS])


def enriched(hint_: Column) -> Column:
    """A hint with extension and type filled in from its names."""
    ext = F.coalesce(hint_["extension"], detect.extension_column(hint_["filename"]), detect.extension_column(hint_["local_path"]), detect.url_extension_column(hint_["url"]))
    values = {"extension": ext, "mimetype": F.coalesce(hint_["mimetype"], detect.mime_column(ext))}
    return F.struct(*[values.get(f, hint_[f]).alias(f) for f in INFO_FIELDS])
