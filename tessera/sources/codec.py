"""Decompression and compression of byte streams in Python, for what Spark's text sources do not do."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
from typing import BinaryIO

from ..errors import InvalidDataError, UnsupportedFormatError
from .formats import Codec

#: Codecs that Spark's text readers decode by a file's extension.
NATIVE = frozenset({Codec.NONE, Codec.GZIP, Codec.BZIP2, Codec.ZSTD})


def reader(raw: BinaryIO, codec: Codec) -> BinaryIO:
    """A stream of the decompressed bytes."""
    if codec is Codec.GZIP:
        return gzip.GzipFile(fileobj=raw)
    if codec is Codec.BZIP2:
        return bz2.BZ2File(raw)
    if codec is Codec.XZ:
        return lzma.LZMAFile(raw)
    if codec is Codec.ZSTD:
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True))
    return raw


def writer(raw: BinaryIO, codec: Codec) -> BinaryIO:
    """A stream whose bytes are compressed into ``raw``; closing it leaves ``raw`` open."""
    if codec is Codec.GZIP:
        return gzip.GzipFile(fileobj=raw, mode="wb", mtime=0)
    if codec is Codec.XZ:
        return lzma.LZMAFile(raw, "wb")
    if codec is Codec.ZSTD:
        import zstandard

        return zstandard.ZstdCompressor().stream_writer(raw, closefd=False)
    if codec is Codec.BZIP2:
        raise UnsupportedFormatError("bzip2 compression is not supported for writing")
    return raw


def decompress(data: bytes, codec: Codec) -> bytes:
    try:
        return reader(io.BytesIO(data), codec).read()
    except (OSError, EOFError, lzma.LZMAError, ValueError) as e:
        raise InvalidDataError(f"cannot decompress: {e}") from e
    except Exception as e:
        if type(e).__name__ == "ZstdError":
            raise InvalidDataError(f"cannot decompress: {e}") from e
        raise


def compress(data: bytes, codec: Codec) -> bytes:
    out = io.BytesIO()
    stream = writer(out, codec)
    stream.write(data)
    if stream is not out:
        stream.close()
    return out.getvalue()
