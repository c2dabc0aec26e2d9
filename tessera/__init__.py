"""SQL over data files, on Spark.

::

    import tessera

    with tessera.open("sales.csv", "customers.tsv.gz", "folder/") as db:
        db.sql("SELECT c.name, SUM(s.amount) AS total FROM sales s JOIN customers c ON ...").show()
"""

from .builder import Builder, open_files
from .builder import open_files as open  # noqa: A004
from .errors import DuplicateColumnError, DuplicateTableError, EmptyDataError, InvalidDataError, NotFoundError, NoTablesError, SqlError, TesseraError, UnsupportedFormatError
from .operators.sinks import DumpOptions
from .session import FileSession
from .sources.formats import Codec, FileType, Format
from .sources.options import ReadOptions

__all__ = [
    "Builder",
    "Codec",
    "DumpOptions",
    "DuplicateColumnError",
    "DuplicateTableError",
    "EmptyDataError",
    "FileSession",
    "FileType",
    "Format",
    "InvalidDataError",
    "NoTablesError",
    "NotFoundError",
    "ReadOptions",
    "SqlError",
    "TesseraError",
    "UnsupportedFormatError",
    "open",
    "open_files",
]
