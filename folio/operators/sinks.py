"""Where converted documents go."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.shaping import output_names


def write_table(converted: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, parted by status, so that failures can be read without the rest."""
    converted.write.mode(mode).partitionBy("status").parquet(path)


def write_files(converted: DataFrame, folder: str, name: str = "doc_id") -> DataFrame:
    """One .md file for each converted row; returns doc_id, output, status and error of all rows.

    ``folder`` has to be a folder that all executors share. A file is written under another name and then
    renamed, so that a task that runs twice leaves whole files.
    """
    from folio.runtime import ship

    ship(converted.sparkSession)
    root = Path(folder).resolve()

    def put(frames):
        for pdf in frames:
            states = []
            for output, status, text in zip(pdf["output"], pdf["status"], pdf["markdown"], strict=True):
                if status != "ok":
                    states.append("not converted")
                    continue
                target = (root / output).resolve()
                if target.parent != root:
                    states.append("the name leads out of the folder")
                    continue
                try:
                    root.mkdir(parents=True, exist_ok=True)
                    part = root / f".{output}.{os.getpid()}"
                    part.write_text(text + "\n", encoding="utf-8")
                    part.replace(target)
                    states.append(None)
                except OSError as e:
                    states.append(str(e))
            yield pdf[["doc_id", "output", "status"]].assign(error=states)

    named = output_names(converted, "doc_id", name).select("doc_id", "output", "status", "markdown")
    return named.mapInPandas(put, "doc_id string, output string, status string, error string")


def summary(converted: DataFrame) -> DataFrame:
    """Rows, characters and degraded rows by status and converter."""
    return converted.groupBy("status", "converter").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.char_length("markdown")).alias("characters"), F.count_if("degraded").alias("degraded"))
