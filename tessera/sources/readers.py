"""Readers: from a file to a DataFrame with the column types of its data."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DuplicateColumnError, EmptyDataError, InvalidDataError
from . import codec, infer
from .formats import Codec, FileType, Format, detect
from .options import ReadOptions
from .storage import Storage
from .xlsx import Workbook

BROKEN = "_tessera_broken"
SEPARATORS = {Format.CSV: ",", Format.TSV: "\t"}


def header_names(names: list[str]) -> list[str]:
    """Column names of a header: trimmed, each once; blank ones are named by their place."""
    out, seen = [], set()
    for i, raw in enumerate(names):
        name = raw.strip() or f"_c{i}"
        # Identifiers do not tell upper from lower case in SQL.
        if name.lower() in seen:
            raise DuplicateColumnError(f"duplicate column name: {name}")
        seen.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, path: str, options: ReadOptions = ReadOptions(), file_type: FileType | None = None, sheets: str = "all") -> dict[str, DataFrame]:
    """The tables in a file: one, named ``""``, or for a workbook one per sheet that is not empty, by its name.

    ``sheets="first"`` takes the first sheet of a workbook only.
    """
    kind = file_type or detect(path)
    storage = Storage(spark)
    if not storage.is_dir(path) and storage.size(path) == 0:
        raise EmptyDataError(f"file is empty: {path}")
    if kind.format is Format.PARQUET:
        return {"": _parquet(spark, storage, path, kind, options)}
    if kind.format is Format.XLSX:
        return _xlsx(spark, path, kind, options, sheets)
    if kind.format is Format.LTSV:
        return {"": _ltsv(_lines(spark, path, kind), path, options)}
    return {"": _delimited(spark, path, kind, options)}


# ---- texts ------------------------------------------------------------------------------------


def _lines(spark: SparkSession, path: str, kind: FileType) -> DataFrame:
    """Lines of a text file (column ``value``), decoded by Spark where it can and else on executors as a stream."""
    if kind.codec in codec.NATIVE and path.lower().endswith(kind.codec.extension):
        return spark.read.text(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held: list[str] = []
                for line in io.TextIOWrapper(codec.reader(io.BytesIO(data), kind.codec), "utf-8", errors="replace", newline=None):
                    held.append(line.rstrip("\r\n"))
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, "value string")


def _delimited(spark: SparkSession, path: str, kind: FileType, options: ReadOptions) -> DataFrame:
    sep = SEPARATORS[kind.format]
    native = kind.codec in codec.NATIVE and path.lower().endswith(kind.codec.extension)
    lines = _lines(spark, path, kind)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    try:
        if options.multi_line is None:
            ends = spark.read.option("lineSep", "\n").text(path) if native else lines
            returned = F.count(F.when(F.col("value").endswith("\r"), 1))
            figures = ends.agg(F.count(F.when(F.col("value").rlike("\\S"), 1)).alias("n"), F.sum(quotes).alias("quotes"), F.max(quotes % 2).alias("odd"), returned.alias("returned"), F.count("*").alias("lines")).first()
            if not figures["n"]:
                raise EmptyDataError(f"file is empty: {path}")
            if figures["quotes"] % 2:
                raise InvalidDataError(f"a quote is not closed: {path}")
            multi_line = bool(figures["odd"])
            # Spark takes one kind of line end for all of a file whose records span lines.
            if multi_line and 0 < figures["returned"] < figures["lines"]:
                native = False
        else:
            multi_line = options.multi_line
        names = header_names(_header(lines, sep, path))
    except (EmptyDataError, InvalidDataError):
        raise
    except Exception as e:
        raise InvalidDataError(f"cannot read {path}: {str(e).splitlines()[0]}") from e
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BROKEN]])
    settings = {"sep": sep, "header": True, "quote": '"', "escape": '"', "multiLine": multi_line, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, "nullValue": "\x00\x01", "emptyValue": "", "maxCharsPerColumn": -1, "maxColumns": max(20_480, len(names) + 1), "enforceSchema": True, "unescapedQuoteHandling": "STOP_AT_DELIMITER"}
    if native:
        rows = spark.read.schema(schema).options(**settings).csv(path)
    else:
        rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_records(sep, len(names), kind.codec), schema)
    strict = options.mode == "strict"
    texts = rows.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names], *[BROKEN] * strict)
    kinds, wrong = infer.infer(texts, names, options.sample_rows, F.max(BROKEN) if strict else None)
    if wrong is not None:
        raise InvalidDataError(f"wrong number of fields in {path}: {str(wrong)[:200]!r} does not have {len(names)}")
    return infer.typed(texts, kinds, empty_as=options.empty_as, datetime_mode=options.datetime_mode)


def _header(lines: DataFrame, sep: str, path: str) -> list[str]:
    """Fields of the first line that is not blank, taken further while a quote is open."""
    start = lines.where(F.trim("value") != "").limit(64).collect()
    if not start:
        raise EmptyDataError(f"file is empty: {path}")
    text = start[0][0]
    for more in start[1:]:
        if text.count('"') % 2 == 0:
            break
        text += "\n" + more[0]
    return next(csv.reader([text.lstrip("﻿")] if "\n" not in text else io.StringIO(text.lstrip("﻿")), delimiter=sep))


def _records(sep: str, width: int, kind: Codec):
    """Records of a compressed file that Spark does not decode, parsed on an executor as a stream."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 31)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                source = io.TextIOWrapper(codec.reader(io.BytesIO(data), kind), "utf-8-sig", errors="replace", newline="")
                records = csv.reader(source, delimiter=sep)  # takes any line end
                next((r for r in records if r), None)  # the header
                held: list[list[str | None]] = []
                for r in records:
                    if not r:
                        continue
                    wrong = sep.join(r) if len(r) != width else None
                    held.append([*(r + [""] * width)[:width], wrong])
                    if len(held) == 10_000:
                        yield _columns(held, width + 1)
                        held = []
                yield _columns(held, width + 1)

    return parse


def _columns(rows: list[list[str | None]], width: int) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * width
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[f"c{i}" for i in range(width)])


def _ltsv(lines: DataFrame, path: str, options: ReadOptions) -> DataFrame:
    """Lines of ``key:value`` pairs: keys of all lines are the columns, a later pair of a key counts."""
    trimmed = F.trim(F.rtrim(F.col("value"), F.lit("\r\n")))
    pairs = F.filter(F.transform(F.split(trimmed, "\t"), lambda p: F.trim(p)), lambda p: F.instr(p, ":") > 0)
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.trim(F.substr(p, F.instr(p, ":") + 1)).alias("v")))
    rows = lines.where(trimmed != "").select(entries.alias("e")).where(F.size("e") > 0)
    keys = rows.withColumn("_at", F.monotonically_increasing_id()).select("_at", F.posexplode(F.transform("e", lambda x: x["k"])).alias("_pos", "k"))
    order = "k" if options.column_order == "sorted" else "first"
    names = [r["k"] for r in keys.groupBy("k").agg(F.min(F.struct("_at", "_pos")).alias("first")).orderBy(order).collect()]
    if not names:
        raise EmptyDataError(f"no valid records found: {path}")
    header_names(names)
    # One map per line, so many keys do not mean many searches; a later pair of a key replaces the earlier.
    latest = F.aggregate("e", F.expr("CAST(map() AS MAP<STRING, STRING>)"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    maps = rows.select(latest.alias("m"))
    texts = maps.select(*[F.coalesce(F.try_element_at("m", F.lit(n)), F.lit("")).alias(n) for n in names])
    return _typed(texts, options)


def _typed(texts: DataFrame, options: ReadOptions) -> DataFrame:
    kinds, _ = infer.infer(texts, sample_rows=options.sample_rows)
    return infer.typed(texts, kinds, empty_as=options.empty_as, datetime_mode=options.datetime_mode)


# ---- Parquet ----------------------------------------------------------------------------------


def _parquet(spark: SparkSession, storage: Storage, path: str, kind: FileType, options: ReadOptions) -> DataFrame:
    if kind.codec is not Codec.NONE:
        plain = f"{storage.shared_folder()}/table.parquet"
        storage.write(plain, codec.decompress(storage.read(path), kind.codec))
        path = plain
    try:
        rows = spark.read.parquet(path)
        if rows.isEmpty():
            raise EmptyDataError(f"no records found in parquet file: {path}")
    except EmptyDataError:
        raise
    except Exception as e:
        raise InvalidDataError(f"cannot read {path}: {str(e).splitlines()[0]}") from e
    return rows if options.parquet_mode == "native" else as_text(rows)


def as_text(rows: DataFrame) -> DataFrame:
    """Every column as text: flags as 1 and 0, dates as days, times as the count of their unit, nested values as JSON."""
    out = []
    for field in rows.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(field.dataType, T.DateType):
            c = F.unix_date(c)
        elif isinstance(field.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(field.dataType, T.TimestampNTZType):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.regexp_replace(c.cast("string"), r"\.0$", "")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(field.name))
    return rows.select(*out)


# ---- workbooks --------------------------------------------------------------------------------


def _xlsx(spark: SparkSession, path: str, kind: FileType, options: ReadOptions, sheets: str) -> dict[str, DataFrame]:
    """Sheets as tables. Executors parse the workbook; the driver only sees sheet names and headers."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sheet", "name", "line", "cells"]
        for batch in batches:
            for data in batch.column(0).to_pylist():
                book = Workbook(codec.decompress(data, kind.codec) if kind.codec is not Codec.NONE else data)
                for k, name in enumerate(book.sheets):
                    if k and sheets == "first":
                        break
                    held: list[list[str]] = []
                    at = 0
                    for row in book.rows(k):
                        held.append(row)
                        if len(held) == 5_000:
                            yield _cells(names, k, name, at, held)
                            at, held = at + len(held), []
                    yield _cells(names, k, name, at, held)

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "sheet int, name string, line long, cells array<string>")
    filled = rows.where(F.exists("cells", lambda c: c != ""))
    try:
        heads = filled.groupBy("sheet", "name").agg(F.min_by("cells", "line").alias("head"), F.min("line").alias("line")).orderBy("sheet").collect()
    except Exception as e:
        raise InvalidDataError(f"cannot read {path}: {str(e).strip().splitlines()[-1]}") from e
    if not heads:
        raise EmptyDataError(f"no sheets with data found in workbook: {path}")
    tables = {}
    for h in heads:
        names = header_names(h["head"])
        own = rows.where((F.col("sheet") == h["sheet"]) & (F.col("line") > h["line"]))
        # A row shorter than the header is filled, what goes beyond it is cut.
        texts = own.select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])
        tables["" if sheets == "first" else h["name"]] = _typed(texts, options)
    return tables


def _cells(names: list[str], sheet: int, name: str, at: int, rows: list[list[str]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([sheet] * n, pa.int32()), pa.array([name] * n, pa.string()), pa.array(range(at, at + n), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=names)
