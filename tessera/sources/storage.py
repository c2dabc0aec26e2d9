"""Files by Hadoop's file systems, so that every path Spark can read is a source or a target."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from ..errors import NotFoundError, TesseraError


class Storage:
    """The few operations on files that the driver needs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def is_dir(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where) and fs.getFileStatus(where).isDirectory()

    def qualified(self, path: str) -> str:
        """One spelling for each file: absolute, with its scheme."""
        fs, where = self._at(path)
        return fs.makeQualified(where).toString()

    def size(self, path: str) -> int:
        fs, where = self._at(path)
        return fs.getFileStatus(where).getLen()

    def walk(self, path: str) -> Iterator[str]:
        """All files below a folder, in order of their names."""
        fs, where = self._at(path)
        entries = sorted(fs.listStatus(where), key=lambda s: s.getPath().getName())
        for s in entries:
            if s.isDirectory():
                yield from self.walk(s.getPath().toString())
            else:
                yield s.getPath().toString()

    def make_dir(self, path: str) -> None:
        fs, where = self._at(path)
        fs.mkdirs(where)

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def move(self, source: str, target: str) -> None:
        """Put ``source`` in place of ``target``."""
        fs, a = self._at(source)
        target_fs, b = self._at(target)
        if target_fs.exists(b):
            target_fs.delete(b, True)
        # Checksum files of local disks belong to the old content.
        crc = self._jvm.org.apache.hadoop.fs.Path(b.getParent(), f".{b.getName()}.crc")
        if target_fs.exists(crc):
            target_fs.delete(crc, False)
        if not fs.rename(a, b):
            raise NotFoundError(f"cannot move {source} to {target}")

    def write(self, path: str, data: bytes | Iterable[bytes]) -> None:
        """Bytes, or pieces of them, into a file."""
        fs, where = self._at(path)
        out = fs.create(where, True)
        pieces = (data[i : i + (1 << 20)] for i in range(0, len(data), 1 << 20)) if isinstance(data, bytes) else data
        try:
            for piece in pieces:
                out.write(bytearray(piece))
        finally:
            out.close()

    def join(self, path: str, head: Iterable[bytes], parts: Iterable[str]) -> None:
        """Bytes and then those of other files into a file; they are copied in the JVM."""
        fs, where = self._at(path)
        out = fs.create(where, True)
        try:
            for piece in head:
                out.write(bytearray(piece))
            for part in parts:
                part_fs, at = self._at(part)
                source = part_fs.open(at)
                try:
                    self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
        finally:
            out.close()

    def read(self, path: str) -> bytes:
        fs, where = self._at(path)
        source = fs.open(where)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()

    def shared_folder(self) -> str:
        """A new folder that executors see as well: below ``spark.checkpoint.dir``; where that is unset a temporary one, in local mode only."""
        root = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext.getCheckpointDir()
        if not root:
            master = self.spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise TesseraError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="tessera-")
        path = f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"
        self.make_dir(path)
        return path
