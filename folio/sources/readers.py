"""Inputs as tables of doc_id, content and hint."""

from __future__ import annotations

import functools
import http.client
from collections.abc import Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import uri as uris
from folio.plans import detect
from folio.plans.dispatch import hint
from folio.plans.model import INFO_FIELDS, INPUT, Info
from folio.runtime import ship, spread
from folio.sources import fetch


def files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Every file under a path; size and time filters on the columns kept are pushed into the listing.

    ``path`` names any file system that Spark reads. The columns length and modificationTime stay, so
    that a filter on them, or a plan that doesn't need the content, reads no bytes.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return named(reader.load(path))


def named(found: DataFrame) -> DataFrame:
    """The input columns of a binaryFile table."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return found.select(F.col("path").alias("doc_id"), "content", hint(filename=name, local_path=F.col("path"), extension=detect.extension_column(name)).alias("hint"), "length", "modificationTime")


def rows(spark: SparkSession, items: Iterable[tuple[str, bytes | None, Info | None]]) -> DataFrame:
    """Inputs that the driver holds."""
    data = [(i, None if c is None else bytearray(c), tuple(getattr(h, f) for f in INFO_FIELDS) if h else None) for i, c, h in items]
    return spark.createDataFrame(data, INPUT)


def texts(table: DataFrame, doc_id: str, text: str, mimetype: str | None = "text/plain", url: str | None = None) -> DataFrame:
    """A text column as UTF-8 documents."""
    known = {"mimetype": mimetype, "charset": "utf-8"} | ({"url": F.col(url)} if url else {})
    return table.select(F.col(doc_id).cast("string").alias("doc_id"), F.encode(F.col(text), "UTF-8").alias("content"), hint(**known).alias("hint"))


def delimited(table: DataFrame) -> DataFrame:
    """A whole table of any size as CSV lines, one document a row with the header."""
    head = ",".join(table.columns)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]
    quoted = [F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
    return table.select(F.xxhash64(*table.columns).cast("string").alias("doc_id"), F.encode(F.concat(F.lit(head + "\n"), F.concat_ws(",", *quoted)), "UTF-8").alias("content"), hint(mimetype="text/csv", extension=".csv", charset="utf-8").alias("hint"))


def addresses(spark: SparkSession, uris_: DataFrame | Iterable[str], column: str = "uri", guard: bool = True, tasks: int = 64) -> DataFrame:
    """data:, file: and web addresses; each scheme, in any case, by its own reader, joined into one table.

    A row for each address: null content where it is null, malformed, of another scheme or without one, can't
    be fetched, or names a file that isn't there. Web pages are fetched and files read by the executors; no
    address is collected.
    """
    ship(spark)
    table = uris_ if isinstance(uris_, DataFrame) else spark.createDataFrame([(u,) for u in uris_], f"{column} string")
    table = table.select(F.trim(F.col(column)).alias("uri"))

    def data(frames):
        for pdf in frames:
            out = []
            for x in pdf["uri"]:
                try:
                    mime, attrs, body = uris.parse_data_uri(x)
                    out.append((x, body, _hint(mimetype=mime, charset=attrs.get("charset"))))
                except ValueError:
                    out.append((x, None, None))
            yield pd.DataFrame(out, columns=INPUT.names)

    def web(frames):
        for pdf in frames:
            yield pd.DataFrame([_fetched(x, guard) for x in pdf["uri"]], columns=INPUT.names)

    scheme = F.coalesce(F.lower(F.regexp_extract("uri", "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)), F.lit(""))
    kind = F.when(scheme == "data", "data").when(scheme.isin("http", "https"), "web").when(scheme == "file", "file").otherwise("none")
    table = table.withColumn("kind", kind)
    there = {r["kind"] for r in table.select("kind").distinct().collect()}  # four at most
    of = lambda k: table.where(F.col("kind") == k).drop("kind")
    parts = [spread(of("data")).mapInPandas(data, INPUT)]
    if "web" in there:
        parts.append(of("web").repartition(tasks).mapInPandas(web, INPUT))
    if "none" in there:
        parts.append(_unread(of("none")))
    if "file" in there:
        parts.append(_local(of("file")))
    return functools.reduce(DataFrame.unionByName, parts)


def _unread(table: DataFrame) -> DataFrame:
    return table.select(F.col("uri").alias("doc_id"), F.lit(None).cast("binary").alias("content"), F.lit(None).cast(INPUT["hint"].dataType).alias("hint"))


def _local(table: DataFrame) -> DataFrame:
    """Files by their addresses, read where the rows are, in the file system that the driver calls local.

    Only folders that all executors share make sense on a cluster, as for any ``file:`` path.
    """

    def read(frames):
        for pdf in frames:
            for x in pdf["uri"]:
                try:
                    host, path = uris.file_uri_to_path(x)
                    body = Path(path).read_bytes() if host in (None, "", "localhost") else None
                except (OSError, ValueError):
                    path, body = "", None
                name = path.rpartition("/")[2]
                yield pd.DataFrame([(x, body, None if body is None else _hint(filename=name, local_path=path, extension=detect.extension(name)))], columns=INPUT.names)

    return spread(table).mapInPandas(read, INPUT)


def _hint(**known: str | None) -> dict[str, str | None]:
    return dict.fromkeys(INFO_FIELDS) | known


def _fetched(address: str, guard: bool) -> tuple:
    try:
        got = fetch.fetch(address, guard=guard)
    except (OSError, ValueError, http.client.HTTPException):
        return address, None, None
    return address, got.body, _hint(**{f: getattr(got.info, f) for f in INFO_FIELDS})


