"""Archives as tables of their files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.converters.archive import Container
from folio.plans.detect import extension
from folio.plans.dispatch import PART, convert_documents, convert_made
from folio.plans.model import INFO_FIELDS, INPUT, ConversionError, Options
from folio.plans.registry import Registry
from folio.runtime import ship

#: What places a file in its archive.
_PLACE = T.StructType([T.StructField("archive_id", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("note", T.StringType())])
_NAMES = [*INPUT.names, *_PLACE.names]
ENTRY = T.StructType([{f.name: f for f in [*INPUT.fields, *_PLACE.fields]}[c] for c in ("archive_id", "position", "doc_id", "content", "hint", "name", "note")])


def entries(archives: DataFrame, whole: bool = False) -> DataFrame:
    """A row for every file of every archive (columns doc_id and content), in the archive's order.

    Files of one archive can then be converted by many tasks; ``doc_id`` is the archive's id, the position and the
    name, so that files of one name stay apart. What is beyond the budgets has a ``note`` and no content; a
    note on the whole archive has the position -1 and no name. A row of null or of what isn't an archive gives no
    rows. Rows that repeat an id count as one archive when they are collected. Archives that are to be read ``whole``
    have no budgets.
    """
    ship(archives.sparkSession)

    def run(frames):
        for pdf in frames:
            part, size = [], 0
            for e in (e for i, data in zip(pdf["doc_id"], pdf["content"], strict=True) for e in _entries(i, data, whole)):
                part.append(e)
                size += len(e[1] or b"")
                if len(part) == 64 or size > PART:
                    yield pd.DataFrame(part, columns=_NAMES)[ENTRY.names]
                    part, size = [], 0
            yield pd.DataFrame(part, columns=_NAMES)[ENTRY.names]

    return archives.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, ENTRY)


def _entries(archive_id: str, data: bytes | None, whole: bool):
    """The rows of one archive, as tuples of _NAMES."""
    try:
        container = Container(bytes(data), whole) if data is not None else None
    except ConversionError:
        container = None
    if container is None:
        return
    none = dict.fromkeys(INFO_FIELDS)
    if container.note:
        yield f"{archive_id}!", None, none, archive_id, -1, None, container.note
    for k, e in enumerate(container.entries()):
        hint = none | {"filename": e.name.rpartition("/")[2], "extension": extension(e.name)}
        yield f"{archive_id}!{k}!{e.name}", e.content, hint, archive_id, k, e.name, e.note


def converted_entries(found: DataFrame, options: Options = Options(), registry: Registry | None = None) -> DataFrame:  # noqa: B008  frozen
    """The rows of :func:`entries` in the output schema, with what places them in their archive."""
    return convert_documents(found, options, registry, keep=tuple(_PLACE.names))


def converted_made(rows: DataFrame, make: Callable, options: Options = Options(), registry: Registry | None = None) -> DataFrame:  # noqa: B008  frozen
    """The same of archives that ``make`` writes, in one Python pass (see :func:`~folio.plans.dispatch.convert_made`)."""

    def files(frames):
        for i, data, *_ in make(frames):
            yield from _entries(i, data, options.whole_archives)

    return convert_made(rows, files, options, registry, _PLACE)


def collected(converted: DataFrame) -> DataFrame:
    """One Markdown for each archive from its converted files (archive_id, position, name, markdown, status, degraded, note).

    An archive without a file that could be read has its heading alone. Degraded if anything was left out.
    """
    text = F.when(F.col("note").isNotNull(), F.col("note")).when(F.col("status") == "ok", F.col("markdown"))
    section = F.when(F.col("position") < 0, text).otherwise(F.concat(F.lit("## File: "), F.col("name"), F.lit("\n\n"), text))
    missing = F.col("note").isNotNull() | (F.col("status") != "ok") | F.col("degraded")
    parts = converted.groupBy("archive_id").agg(F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct("position", section.alias("s"))))).alias("parts"), F.bool_or(missing).alias("degraded"))
    head = F.concat(F.lit("Content from the zip file `"), F.col("archive_id"), F.lit("`:"))
    return parts.select("archive_id", F.concat_ws("\n\n", head, F.col("parts.s")).alias("markdown"), "degraded")
