"""Conversion of what arrives in a folder; stateless, so nothing has to be kept between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from folio.plans.dispatch import convert_documents
from folio.plans.model import Options
from folio.plans.registry import Registry
from folio.sources.readers import named

BINARY_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def read_files(spark: SparkSession, path: str, glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """New files under a path as input rows."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return named(reader.load(path))


def convert_stream(spark: SparkSession, path: str, out: str, checkpoint: str, options: Options = Options(), registry: Registry | None = None, once: bool = True, glob: str | None = None, each_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:  # noqa: B008  frozen
    """Convert new files into Parquet (or hand each batch on); exactly once by the checkpoint."""
    converted = convert_documents(read_files(spark, path, glob), options, registry)
    writer = converted.writeStream.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    if each_batch is not None:
        return writer.foreachBatch(each_batch).start()
    return writer.format("parquet").option("path", out).outputMode("append").start()
