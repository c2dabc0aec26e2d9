"""File formats, compression codecs and the names of tables."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum

from ..errors import UnsupportedFormatError


class Format(Enum):
    CSV = ".csv"
    TSV = ".tsv"
    LTSV = ".ltsv"
    PARQUET = ".parquet"
    XLSX = ".xlsx"

    @property
    def extension(self) -> str:
        return self.value


class Codec(Enum):
    NONE = ""
    GZIP = ".gz"
    BZIP2 = ".bz2"
    XZ = ".xz"
    ZSTD = ".zst"

    @property
    def extension(self) -> str:
        return self.value


@dataclass(frozen=True)
class FileType:
    """A format and how the file is compressed."""

    format: Format
    codec: Codec = Codec.NONE

    @property
    def extension(self) -> str:
        return self.format.extension + self.codec.extension

    @classmethod
    def parse(cls, name: str | FileType | Format) -> FileType:
        """From ``"csv"``, ``"csv.gz"``, ``".csv.gz"`` and the like."""
        if isinstance(name, FileType):
            return name
        if isinstance(name, Format):
            return cls(name)
        return detect(f"x.{name.lstrip('.')}")


def base_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def codec_of(path: str) -> Codec:
    lower = path.lower()
    return next((c for c in Codec if c.value and lower.endswith(c.value)), Codec.NONE)


def without_codec(path: str) -> str:
    return path[: len(path) - len(codec_of(path).value)]


def detect(path: str) -> FileType:
    """The type that a path's extensions stand for, whatever their case."""
    plain = without_codec(path).lower()
    for f in Format:
        if plain.endswith(f.value):
            return FileType(f, codec_of(path))
    raise UnsupportedFormatError(f"unsupported file type: {path}")


def is_supported(path: str) -> bool:
    try:
        detect(path)
    except UnsupportedFormatError:
        return False
    return True


def table_name(path: str) -> str:
    """A file's name without compression and format extensions."""
    name = base_name(without_codec(path))
    stem, dot, _ = name.rpartition(".")
    return stem if dot and stem else name


def sanitize(name: str, fallback: str = "table") -> str:
    """A plain identifier: spaces, dashes and dots become underscores, other signs go, a leading digit gets a prefix."""
    plain = re.sub(r"[^A-Za-z0-9_]", "", re.sub(r"[ .\-]", "_", name.strip()))
    if not plain:
        return fallback
    return f"{fallback}_{plain}" if plain[0].isdigit() else plain
