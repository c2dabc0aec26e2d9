"""Structured Streaming over a folder of files of one type, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import UnsupportedFormatError
from ..sources.formats import Format
from ..sources.readers import SEPARATORS


def watch(spark: SparkSession, folder: str, schema: StructType | str, format: Format = Format.PARQUET, files_per_trigger: int | None = None) -> DataFrame:
    """New files below ``folder`` as a stream. A stream needs its schema: that of a session's table will do."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if format is Format.PARQUET:
        return reader.parquet(folder)
    if format in SEPARATORS:
        return reader.options(header=True, sep=SEPARATORS[format], quote='"', escape='"').csv(folder)
    raise UnsupportedFormatError(f"{format.name} files cannot be streamed")


def windowed(stream: DataFrame, time: str, every: str, late: str, *keys: str, figures: dict[str, Column] | None = None) -> DataFrame:
    """Figures per window of ``every`` and key, rows later than ``late`` left out."""
    figures = figures or {"n": F.count("*")}
    dealt = stream.withWatermark(time, late).groupBy(F.window(time, every), *keys)
    return dealt.agg(*[c.alias(n) for n, c in figures.items()]).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *figures)
