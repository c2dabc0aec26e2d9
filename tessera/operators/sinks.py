"""Sinks: one file per table, written by executors in parts; the driver joins and renames them."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EmptyDataError, UnsupportedFormatError
from ..sources import codec
from ..sources.formats import Codec, FileType, Format
from ..sources.storage import Storage
from ..sources.xlsx import write_workbook

#: Bytes of a file that travel at once.
PIECE = 1 << 22


@dataclass(frozen=True)
class DumpOptions:
    """Format and compression of written files; ``with_*`` give changed copies."""

    format: Format = Format.CSV
    codec: Codec = Codec.NONE
    go_floats: bool = False
    parquet_mode: str = "native"

    def with_format(self, format: Format | str) -> DumpOptions:
        return replace(self, format=FileType.parse(format).format if isinstance(format, str) else format)

    def with_compression(self, codec_: Codec | str) -> DumpOptions:
        return replace(self, codec=codec_ if isinstance(codec_, Codec) else Codec[codec_.upper()])

    @property
    def file_extension(self) -> str:
        return self.format.extension + self.codec.extension

    def check(self) -> None:
        if self.codec is Codec.BZIP2:
            raise UnsupportedFormatError("bzip2 compression is not supported for writing")
        if self.format is Format.PARQUET and self.codec is not Codec.NONE:
            raise UnsupportedFormatError("external compression not supported for Parquet format")


def cell(c: Column, kind: T.DataType, go_floats: bool = False) -> Column:
    """A value as the text formats show it: NULL as nothing, whole doubles without a fraction."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = _shortest(c) if go_floats else _exact(c)
    elif isinstance(kind, T.BooleanType):
        c = c.cast("int")
    elif isinstance(kind, T.BinaryType):
        c = F.decode(c, "UTF-8")
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        c = F.to_json(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1")
    return F.coalesce(c.cast("string"), F.lit(""))


def _exact(c: Column) -> Column:
    """Without an exponent below 1e15; between 1e-3 and 1e7 a double's own text has none, which is most values and much the fastest."""
    text = c.cast("string")
    usual = (F.abs(c) >= 1e-3) & (F.abs(c) < 1e7) & ~text.endswith("0")
    return F.when(F.abs(c) < 1e15, F.when(c == F.floor(c), F.format_string("%d", c.cast("long"))).when(usual, text).otherwise(_plain(c))).otherwise(text)


def _parts(c: Column) -> tuple[Column, Column, Column]:
    """Sign, digits and decimal exponent of a double's shortest text."""
    text = F.abs(c).cast("string")
    mantissa, power = F.regexp_extract(text, r"^([\d.]+)", 1), F.coalesce(F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    whole, fraction = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.regexp_extract(mantissa, r"\.(\d*)$", 1), "0+$", "")
    digits = F.concat(whole, fraction)
    lead = F.length(F.regexp_extract(digits, "^(0*)", 1))
    exponent = power + F.length(whole) - 1 - lead
    return F.when(c < 0, "-").otherwise(""), F.regexp_replace(digits, "^0+|0+$", ""), exponent


def _plain(c: Column) -> Column:
    """Without an exponent, for doubles below 1e15."""
    sign, digits, exponent = _parts(c)
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    padded = F.rpad(digits, F.greatest(F.length(digits), exponent + 1), F.lit("0"))
    large = F.concat(sign, F.substr(padded, F.lit(1), exponent + 1), F.lit("."), F.substr(padded, exponent + 2))
    return F.when(exponent < 0, small).otherwise(large)


def _shortest(c: Column) -> Column:
    """With an exponent, of two digits at least, from 1e6 on and below 1e-4."""
    sign, digits, exponent = _parts(c)
    fraction = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
    tail = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    scientific = F.concat(sign, F.substr(digits, F.lit(1), F.lit(1)), fraction, F.lit("e"), tail)
    plain = F.when(c == F.floor(c), F.format_string("%d", c.cast("long"))).otherwise(_plain(c))
    return F.when(c == 0, "0").when((exponent < -4) | (exponent >= 6), scientific).otherwise(plain)


def write_file(table: DataFrame, path: str, options: DumpOptions, name: str = "table") -> None:
    """Write ``table`` to the single file ``path``."""
    options.check()
    spark = table.sparkSession
    storage = Storage(spark)
    folder = f"{path.rsplit('/', 1)[0]}/.tessera-{uuid.uuid4().hex}" if "/" in path else f".tessera-{uuid.uuid4().hex}"
    try:
        if options.format is Format.PARQUET:
            if table.isEmpty():
                raise EmptyDataError("no data to write")
            rows = table if options.parquet_mode == "native" else _texts(table, options)
            _in_one_task(rows).write.parquet(folder)
        elif options.format is Format.XLSX:
            _workbook(table, folder, options, name, storage)
        else:
            _written_in_parts(table, folder, options, storage)
        parts = [f for f in storage.walk(folder) if not f.rsplit("/", 1)[-1].startswith(("_", "."))]
        storage.move(parts[0], path)
    finally:
        if storage.exists(folder):
            storage.delete(folder)


def _texts(table: DataFrame, options: DumpOptions) -> DataFrame:
    return table.select(*[cell(F.col(f"`{f.name}`"), f.dataType, options.go_floats).alias(f.name) for f in table.schema.fields])


def _in_one_task(rows: DataFrame) -> DataFrame:
    """All rows in one partition, in their order; what they are computed from keeps its tasks."""
    placed = rows.withColumn("_tessera_at", F.monotonically_increasing_id())
    return placed.repartition(1).sortWithinPartitions("_tessera_at").drop("_tessera_at")


def _written_in_parts(table: DataFrame, folder: str, options: DumpOptions, storage: Storage) -> None:
    """Text formats: each task formats and compresses its rows, and the parts' bytes are put one after another.

    Compressed files may consist of several streams, so nothing is decompressed for that.
    """
    parts, target = f"{folder}/.parts", f"{folder}/part-0"
    lines = _lines(table, options)
    header = [] if options.format is Format.LTSV else [codec.compress(f"{_header(table, options)}\n".encode(), options.codec)]
    if options.codec in (Codec.XZ, Codec.ZSTD):
        _compressed(lines, options.codec).write.parquet(parts)
        pieces = table.sparkSession.read.schema("at long, data binary").parquet(parts).orderBy("at")
        storage.write(target, chain(header, (piece["data"] for piece in pieces.toLocalIterator())))
    else:
        writer = lines.write.option("lineSep", "\n")
        if options.codec is Codec.GZIP:
            writer = writer.option("compression", "gzip")
        writer.text(parts)
        written = [f for f in storage.walk(parts) if f.rsplit("/", 1)[-1].startswith("part-")]
        storage.join(target, header, sorted(written, key=lambda f: int(f.rsplit("/", 1)[-1].split("-")[1])))
    storage.delete(parts)


def _compressed(lines: DataFrame, kind: Codec) -> DataFrame:
    """at, data: a partition's lines as one stream of a codec that Spark does not write, in pieces."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = io.BytesIO()
        stream = codec.writer(out, kind)
        some = False

        def taken() -> pa.RecordBatch:
            data = out.getvalue()
            out.seek(0)
            out.truncate()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

        for batch in batches:
            for line in batch.column(0).to_pylist():
                stream.write(f"{line}\n".encode())
                some = True
            if out.tell() > PIECE:
                yield taken()
        stream.close()
        if some:
            yield taken()

    return lines.mapInArrow(encode, "data binary").select(F.monotonically_increasing_id().alias("at"), "data")


def _field(value: Column, sep: str) -> Column:
    """A value quoted where it holds the separator, a quote or a line end, or starts with a space."""
    special = value.rlike(f'[{sep}"\r\n]') | value.startswith(" ") | value.startswith("\t")
    return F.when(special, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def _separator(options: DumpOptions) -> str:
    return "," if options.format is Format.CSV else "\t"


def _header(table: DataFrame, options: DumpOptions) -> str:
    sep = _separator(options)
    return table.sparkSession.range(1).select(F.concat_ws(sep, *[_field(F.lit(c), sep) for c in table.columns])).first()[0]


def _lines(table: DataFrame, options: DumpOptions) -> DataFrame:
    """The file's lines below its header."""
    fields = table.schema.fields
    values = [cell(F.col(f"`{f.name}`"), f.dataType, options.go_floats) for f in fields]
    if options.format is Format.LTSV:
        if not fields:
            return table.select(F.lit("").alias("value"))
        return table.select(F.concat_ws("\t", *[F.concat(F.lit(f"{f.name}:"), v) for f, v in zip(fields, values, strict=True)]).alias("value"))
    sep = _separator(options)
    body = table.select(F.concat_ws(sep, *[_field(v, sep) for v in values]).alias("value"))
    if len(fields) == 1:  # a lone blank field would be a blank line
        body = body.select(F.when(F.col("value") == "", F.lit('""')).otherwise(F.col("value")).alias("value"))
    return body


def _workbook(table: DataFrame, folder: str, options: DumpOptions, name: str, storage: Storage) -> None:
    """One task turns the rows into the workbook's bytes, whose parts it holds as the format asks for; they come back in pieces."""
    header = table.columns

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = io.BytesIO()
        write_workbook(whole, name, _with_header(header, batches))
        data = codec.compress(whole.getvalue(), options.codec)
        for i in range(0, len(data), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([data[i : i + PIECE]], pa.binary())], names=["data"])

    storage.make_dir(folder)
    pieces = _in_one_task(_texts(table, options)).mapInArrow(encode, "data binary")
    storage.write(f"{folder}/part-0", (piece["data"] for piece in pieces.toLocalIterator()))


def _with_header(header: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    yield header
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        yield from (list(r) for r in zip(*columns, strict=True))
