"""From what the caller names to the files that become tables."""

from __future__ import annotations

from collections.abc import Iterable

from ..errors import DuplicateTableError, NotFoundError, UnsupportedFormatError
from .formats import Codec, codec_of, is_supported, table_name
from .storage import Storage


def collect(storage: Storage, paths: Iterable[str]) -> list[str]:
    """Supported files among the paths and below the folders, each once, in the order given."""
    found: dict[str, None] = {}
    for path in paths:
        if not storage.exists(path):
            raise NotFoundError(f"path does not exist: {path}")
        # A Parquet table written by Spark is a folder, and one source.
        if storage.is_dir(path) and not is_supported(path):
            files = [f for f in _tables_below(storage, path)]
            if not files:
                raise UnsupportedFormatError(f"no supported files found in directory: {path}")
            found |= dict.fromkeys(storage.qualified(f) for f in files)
        elif is_supported(path):
            found[storage.qualified(path)] = None
        else:
            raise UnsupportedFormatError(f"unsupported file type: {path}")
    return list(found)


def _tables_below(storage: Storage, folder: str) -> list[str]:
    """Files of supported types, a folder called ``x.parquet`` being one."""
    found: dict[str, None] = {}
    for file in storage.walk(folder):
        inner = file.split("/")
        whole = next(("/".join(inner[: i + 1]) for i, part in enumerate(inner[:-1]) if i and part.lower().endswith(".parquet")), file)
        name = whole.rsplit("/", 1)[-1]
        if is_supported(whole) and not name.startswith((".", "_")):
            found[whole] = None
    return list(found)


def one_per_table(files: list[str], *, last_wins: bool = False) -> dict[str, str]:
    """Table name -> file. Of copies that differ in compression only, the plain one is taken, else the first.

    Two plain files of one name are an error, or the later one is taken.
    """
    chosen: dict[str, str] = {}
    for file in files:
        name = table_name(file)
        if name not in chosen:
            chosen[name] = file
            continue
        old_plain, new_plain = (codec_of(f) is Codec.NONE for f in (chosen[name], file))
        if new_plain and old_plain and not last_wins:
            raise DuplicateTableError(f"table '{name}' already exists, duplicate table names are not allowed: {chosen[name]}, {file}")
        if new_plain:
            chosen[name] = file
    return chosen
