"""Column types from the data: one aggregation of native expressions, then a decision on the driver."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Kind(Enum):
    TEXT = "text"
    INTEGER = "integer"
    REAL = "real"
    DATETIME = "datetime"


# Shares at which a type is taken, and the length of date texts.
SURE_SHARE = 0.8
DATETIME_LENGTH = (4, 35)


# The ways to write a date, a time or both that are told from text.
_HOUR, _SIXTY, _FRACTION = r"([01]?\d|2[0-3])", r"[0-5]\d", r"(\.\d+)?"
_CLOCK = rf"([01]\d|2[0-3]):{_SIXTY}:{_SIXTY}{_FRACTION}"
DATETIMES = (
    rf"\d{{4}}-\d{{2}}-\d{{2}}(T{_CLOCK}(Z|[+-]\d{{2}}:\d{{2}})?| {_CLOCK})?",
    rf"\d{{1,2}}/\d{{1,2}}/\d{{4}}( {_HOUR}:{_SIXTY}:{_SIXTY}| (0?[1-9]|1[0-2]):{_SIXTY}:{_SIXTY} (AM|PM))?",
    rf"\d{{1,2}}\.\d{{1,2}}\.\d{{4}}( {_HOUR}:{_SIXTY}:{_SIXTY})?",
    rf"{_HOUR}:{_SIXTY}(:{_SIXTY}{_FRACTION})?",
)


def is_datetime(value: Column) -> Column:
    """A date, a time or both, in one of the usual ways to write them, and on a day that exists."""
    shaped = value.rlike(f"^({'|'.join(DATETIMES)})$")
    day = F.regexp_replace(F.regexp_replace(value, r"^(\d+)/(\d+)/(\d{4}).*$", "$3-$1-$2"), r"^(\d+)\.(\d+)\.(\d{4}).*$", "$3-$2-$1")
    exists = F.substring_index(F.substring_index(day, "T", 1), " ", 1).try_cast("date").isNotNull()
    return F.length(value).between(*DATETIME_LENGTH) & shaped & (exists | ~value.rlike(r"^\d+[-/.]"))


def is_integer(value: Column) -> Column:
    """A whole number of 64 bits."""
    return value.rlike(r"^[+-]?\d+$") & value.try_cast("bigint").isNotNull()


def is_real(value: Column) -> Column:
    """A decimal number, whole ones beyond 64 bits among them."""
    return value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def kind_of(value: Column) -> Column:
    """The name of a value's kind; null for blank ones."""
    v = F.trim(value)
    return (
        F.when(v.isNull() | (v == ""), F.lit(None))
        .when(is_datetime(v), Kind.DATETIME.value)
        .when(is_integer(v), Kind.INTEGER.value)
        .when(is_real(v), Kind.REAL.value)
        .otherwise(Kind.TEXT.value)
    )


def decide(counts: dict[Kind, int]) -> Kind:
    """A column's type from how many values of each kind it has.

    Columns are statically typed here, so where whole and decimal numbers meet
    the wider type is taken, however few decimals there are.
    """
    total = sum(counts.values())
    share = {k: counts.get(k, 0) / total if total else 0.0 for k in Kind}
    numbers = share[Kind.REAL] + share[Kind.INTEGER]
    if not total or share[Kind.TEXT]:
        return Kind.TEXT
    if share[Kind.DATETIME]:
        # Dates stay text; numbers among them cannot be cast, so only a column of dates alone counts as one.
        return Kind.DATETIME if share[Kind.DATETIME] >= SURE_SHARE or not numbers else Kind.TEXT
    return Kind.REAL if share[Kind.REAL] else Kind.INTEGER


def infer(rows: DataFrame, columns: list[str] | None = None, sample_rows: int | None = None, besides: Column | None = None) -> tuple[dict[str, Kind], object]:
    """Types of string columns, from all rows or the first ``sample_rows``, in one pass.

    ``besides`` is one more aggregate of all rows, whose value comes second.
    """
    columns = rows.columns if columns is None else columns
    if not columns:
        return {}, None
    seen = rows.limit(sample_rows) if sample_rows else rows
    found: dict[str, Kind] = {}
    more = None
    if besides is not None and sample_rows:
        more, besides = rows.agg(besides).first()[0], None
    for at in range(0, len(columns), 100):  # wide tables would overflow the size of generated methods
        part = columns[at : at + 100]
        kinds = seen.withColumns({f"_k{i}": kind_of(F.col(f"`{c}`")) for i, c in enumerate(part)})
        also = [besides.alias("besides")] if besides is not None else []
        figures = kinds.agg(*[F.count(F.when(F.col(f"_k{i}") == k.value, 1)).alias(f"n{i}_{k.value}") for i in range(len(part)) for k in Kind], *also).first()
        if also:
            more, besides = figures["besides"], None
        for i, c in enumerate(part):
            found[c] = decide({k: figures[f"n{i}_{k.value}"] for k in Kind})
    return found, more


def typed(rows: DataFrame, kinds: dict[str, Kind], *, empty_as: str = "default", datetime_mode: str = "string") -> DataFrame:
    """String columns cast to their types.

    Blank cells are NULL in columns of numbers and stay empty texts elsewhere;
    ``empty_as="null"`` makes them NULL everywhere, ``empty_as="string"`` keeps
    columns of numbers with blank cells as text.
    """
    blank = set()
    if empty_as == "string":
        numeric = [c for c, k in kinds.items() if k in (Kind.INTEGER, Kind.REAL)]
        if numeric:
            some = rows.agg(*[F.max(F.trim(F.col(f"`{c}`")) == "").alias(f"b{i}") for i, c in enumerate(numeric)]).first()
            blank = {c for i, c in enumerate(numeric) if some[i]}
    out = []
    for c in kinds:
        value, kind = F.col(f"`{c}`"), kinds.get(c, Kind.TEXT)
        if kind in (Kind.INTEGER, Kind.REAL) and c not in blank:
            value = F.trim(value).try_cast("bigint" if kind is Kind.INTEGER else "double")
        elif kind is Kind.DATETIME and datetime_mode == "timestamp":
            value = F.trim(value).try_cast("timestamp_ntz")
        elif empty_as == "null":
            value = F.nullif(value, F.lit(""))
        out.append(value.alias(c, metadata={"logical": kind.value}))
    return rows.select(*out)
