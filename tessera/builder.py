"""From sources to a session: add them, check them, open them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, BinaryIO

from pyspark.sql import DataFrame, SparkSession

from .errors import DuplicateTableError, NotFoundError, TesseraError, UnsupportedFormatError
from .operators.sinks import DumpOptions
from .session import AutoSave, FileSession, child_session
from .sources import discover, readers
from .sources.formats import FileType, Format, detect, is_supported, sanitize, table_name
from .sources.options import ReadOptions
from .sources.storage import Storage


@dataclass(frozen=True)
class _Reader:
    source: BinaryIO
    table: str
    type: FileType


class Builder:
    """Sources and settings of a session. ``build`` checks them, ``open`` reads."""

    def __init__(self, spark: SparkSession | None = None, options: ReadOptions = ReadOptions()):
        self._spark = spark or SparkSession.builder.getOrCreate()
        self._options = options
        self._paths: list[str] = []
        self._readers: list[_Reader] = []
        self._roots: list[Any] = []
        self._autosave: AutoSave | None = None
        self._files: dict[str, str] | None = None
        self._integer_division = True

    def add_path(self, path: str) -> Builder:
        self._paths.append(str(path))
        return self

    def add_paths(self, *paths: str) -> Builder:
        for p in paths:
            self.add_path(p)
        return self

    def add_reader(self, source: BinaryIO, table: str, type: FileType | Format | str) -> Builder:
        """Bytes of a stream as a table; compressed ones of any format as well."""
        if source is None:
            raise TesseraError("reader cannot be nil")
        if not str(table).strip():
            raise TesseraError("table name must be specified for reader input")
        self._readers.append(_Reader(source, table, FileType.parse(type)))
        return self

    def add_fs(self, root: Any) -> Builder:
        """Supported files of a traversable folder: ``pathlib.Path``, ``importlib.resources.files(...)``, ``zipfile.Path``."""
        if root is None:
            raise TesseraError("FS cannot be nil")
        self._roots.append(root)
        return self

    def set_default_chunk_size(self, rows: int) -> Builder:
        """Rows per chunk. Spark deals out splits of files, so this changes nothing but is kept for callers that set it."""
        self._options = self._options.but(chunk_rows=rows if rows > 0 else 1000)
        return self

    def with_options(self, **changes) -> Builder:
        self._options = self._options.but(**changes)
        return self

    def with_integer_division(self, on: bool) -> Builder:
        """Whether whole numbers divide to whole ones (the default) or as decimals."""
        self._integer_division = on
        return self

    def enable_auto_save(self, folder: str | None = None, options: DumpOptions = DumpOptions()) -> Builder:
        """Save all tables on closing; without a folder, beside the files they came from."""
        self._autosave = AutoSave(folder or None, options)
        return self

    def enable_auto_save_on_commit(self, folder: str | None = None, options: DumpOptions = DumpOptions()) -> Builder:
        self._autosave = AutoSave(folder or None, options, on_commit=True)
        return self

    def disable_auto_save(self) -> Builder:
        self._autosave = None
        return self

    def build(self) -> Builder:
        """Check all sources: paths exist, types are supported, tables have names of their own."""
        if not (self._paths or self._readers or self._roots):
            raise TesseraError("at least one path must be provided")
        if self._autosave is not None:
            self._autosave.options.check()
        storage = Storage(self._spark)
        for root in self._roots:
            found = list(_walk(root))
            if not found:
                raise UnsupportedFormatError("no supported files found in filesystem")
            for name, entry in found:
                self._readers.append(_Reader(entry.open("rb"), table_name(name), detect(name)))
        self._roots = []
        self._files = discover.one_per_table(discover.collect(storage, self._paths), last_wins=self._options.last_wins)
        seen: set[str] = {n.lower() for n in self._files}
        for r in self._readers:
            if r.table.lower() in seen:
                raise DuplicateTableError(f"table '{r.table}' already exists, duplicate table names are not allowed")
            seen.add(r.table.lower())
        return self

    def open(self) -> FileSession:
        """Read the sources that ``build`` has checked."""
        if self._files is None:
            raise TesseraError("no valid input files found, did you call Build()?")
        own = child_session(self._spark)
        tables: dict[str, DataFrame] = {}
        origins: dict[str, str] = {}

        def add(name: str, table: DataFrame, origin: str | None) -> None:
            if any(t.lower() == name.lower() for t in tables):
                raise DuplicateTableError(f"table '{name}' already exists, duplicate table names are not allowed")
            tables[name] = table
            if origin:
                origins[name] = origin

        for name, path in self._files.items():
            for sheet, table in readers.read(own, path, self._options).items():
                add(f"{sanitize(name, 'sheet')}_{sanitize(sheet, 'sheet')}" if sheet else name, table, path)
        storage = Storage(own)
        for r in self._readers:
            data = r.source.read()
            path = f"{storage.shared_folder()}/{sanitize(r.table)}{r.type.extension}"
            storage.write(path, data)
            for table in readers.read(own, path, self._options, r.type, sheets="first").values():
                add(r.table, table, None)
        return FileSession(own, tables, origins, self._autosave, self._integer_division)


def _walk(root: Any, prefix: str = ""):
    for entry in sorted(root.iterdir(), key=lambda e: e.name):
        name = f"{prefix}{entry.name}"
        if entry.is_dir():
            yield from _walk(entry, f"{name}/")
        elif is_supported(entry.name):
            yield name, entry


def open_files(*paths: str, spark: SparkSession | None = None, **options) -> FileSession:
    """A session over files and folders."""
    if not paths:
        raise NotFoundError("at least one path must be provided")
    return Builder(spark, ReadOptions(**options)).add_paths(*paths).build().open()
