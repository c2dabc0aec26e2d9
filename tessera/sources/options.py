"""How sources are read."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ReadOptions:
    """Choices where files and static column types leave some.

    ``empty_as``: blank cells, see :func:`tessera.sources.infer.typed`.
    ``datetime_mode``: ``"string"`` keeps dates as they are written,
    ``"timestamp"`` casts them.
    ``parquet_mode``: ``"native"`` keeps the file's types, ``"text"`` makes
    every column a string.
    ``column_order`` of LTSV: ``"first_seen"`` or ``"sorted"``.
    ``mode``: ``"strict"`` rejects rows with more or fewer fields than the
    header, ``"permissive"`` cuts or fills them.
    ``multi_line``: whether quoted fields hold line ends; ``None`` looks first.
    ``sample_rows``: rows to infer types from; ``None`` means all.
    ``chunk_rows``: accepted for callers that set one; Spark deals out splits.
    """

    empty_as: str = "default"
    datetime_mode: str = "string"
    parquet_mode: str = "native"
    column_order: str = "first_seen"
    mode: str = "strict"
    multi_line: bool | None = None
    sample_rows: int | None = None
    chunk_rows: int | None = None
    last_wins: bool = False

    def __post_init__(self) -> None:
        allowed = {"empty_as": ("default", "null", "string"), "datetime_mode": ("string", "timestamp"), "parquet_mode": ("native", "text"), "column_order": ("first_seen", "sorted"), "mode": ("strict", "permissive")}
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} is one of {values}, not {getattr(self, name)!r}")

    def but(self, **changes) -> ReadOptions:
        return replace(self, **changes)
