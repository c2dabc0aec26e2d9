"""Templates: from a call in the embedded-database dialect to Spark SQL text.

Each takes the arguments' Spark SQL and returns the call's.  Errors name what is
not supported, rather than giving another result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..errors import SqlError


def _text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def timestamp(x: str) -> str:
    """A date text, a timestamp or a Julian day number as a timestamp; NULL if it is none."""
    if _literal(x) == "now":
        return "CAST(current_timestamp() AS TIMESTAMP_NTZ)"
    day = f"try_cast({_text(x)} AS DOUBLE)"
    julian = f"CAST(timestamp_micros(CAST(round(({day} - 2440587.5D) * 86400000D) AS BIGINT) * 1000) AS TIMESTAMP_NTZ)"
    # A bare clock time is on 2000-01-01.
    clock = f"try_cast(concat('2000-01-01 ', {_text(x)}) AS TIMESTAMP_NTZ)"
    other = f"CASE WHEN {day} IS NOT NULL THEN {julian} WHEN {_text(x)} RLIKE '^\\\\d{{1,2}}:\\\\d{{2}}' THEN {clock} ELSE try_cast({_text(x)} AS TIMESTAMP_NTZ) END"
    # Types are known when Spark plans, so of this only one branch is left; that of a time column is the column, which can be pushed down.
    return f"(CASE WHEN typeof({x}) IN ('timestamp_ntz', 'timestamp', 'date') THEN to_timestamp_ntz({x}) ELSE {other} END)"


def _literal(x: str) -> str | None:
    m = re.fullmatch(r"'((?:[^']|'')*)'", x.strip())
    return m[1].replace("''", "'") if m else None


_UNITS = {"year", "month", "day", "hour", "minute", "second"}


def modified(moment: str, modifiers: list[str]) -> str:
    """A moment after date modifiers (``'+1 month'``, ``'start of day'``, ``'weekday 0'`` ...)."""
    for m in modifiers:
        text = _literal(m)
        if text is None:
            raise SqlError(f"date modifiers must be literals: {m}")
        text = text.strip().lower()
        step = re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s+([a-z]+?)s?", text)
        if step and step[2] in _UNITS:
            number, unit = step[1], step[2]
            if unit in ("year", "month"):
                if "." in number:
                    raise SqlError(f"unsupported date modifier: {text}")
                months = int(number) * (12 if unit == "year" else 1)
                # Days beyond the end of the month go on into the next, as in 31 January + 1 month.
                first = f"(trunc({moment}, 'MM') + INTERVAL '{months}' MONTH)"
                moment = f"CAST({first} AS TIMESTAMP_NTZ) + make_dt_interval(day({moment}) - 1, hour({moment}), minute({moment}), extract(SECOND FROM {moment}))"
                moment = f"({moment})"
            else:
                seconds = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
                moment = f"({moment} + make_dt_interval(0, 0, 0, CAST({float(number) * seconds:.6f} AS DECIMAL(18,6))))"
        elif text in ("start of day", "start of month", "start of year"):
            unit = {"day": "DAY", "month": "MONTH", "year": "YEAR"}[text.rsplit(" ", 1)[1]]
            moment = f"CAST(date_trunc('{unit}', {moment}) AS TIMESTAMP_NTZ)"
        elif weekday := re.fullmatch(r"weekday ([0-6])", text):
            ahead = f"pmod({weekday[1]} - (dayofweek({moment}) - 1), 7)"
            moment = f"({moment} + make_dt_interval({ahead}, 0, 0, 0))"
        elif text in ("localtime", "utc", "auto", "subsec", "subsecond"):
            continue  # times have no zone here
        else:
            raise SqlError(f"unsupported date modifier: {text}")
    return moment


def moment_of(args: list[str]) -> str:
    if not args:
        return timestamp("'now'")
    head, rest = args[0], args[1:]
    if rest and (_literal(rest[0]) or "").lower() == "unixepoch":
        base = f"CAST(timestamp_micros(CAST(try_cast({_text(head)} AS DOUBLE) * 1000000D AS BIGINT)) AS TIMESTAMP_NTZ)"
        return modified(base, rest[1:])
    if rest and (_literal(rest[0]) or "").lower() == "julianday":
        rest = rest[1:]
    return modified(timestamp(head), rest)


def _micros(moment: str) -> str:
    return f"unix_micros(CAST({moment} AS TIMESTAMP))"


def julianday(args: list[str]) -> str:
    return f"(CAST({_micros(moment_of(args))} AS DOUBLE) / 86400000000D + 2440587.5D)"


def formatted(pattern: str) -> Callable[[list[str]], str]:
    return lambda args: f"date_format({moment_of(args)}, '{pattern}')"


# What the conversions of strftime stand for in date_format's patterns.
_CONVERSIONS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "I": "hh", "p": "a", "f": "ss.SSS"}


def strftime(args: list[str]) -> str:
    if not args:
        raise SqlError("strftime needs a format")
    pattern = _literal(args[0])
    if pattern is None:
        raise SqlError("strftime's format must be a literal")
    moment, parts = moment_of(args[1:]), []
    for piece in re.findall(r"%.|[^%]+|%$", pattern):
        if not piece.startswith("%"):
            parts.append("'" + piece.replace("'", "''") + "'")
        elif piece == "%%":
            parts.append("'%'")
        elif piece[1:] == "w":
            parts.append(f"CAST(dayofweek({moment}) - 1 AS STRING)")
        elif piece[1:] == "u":
            parts.append(f"CAST(weekday({moment}) + 1 AS STRING)")
        elif piece[1:] == "W":
            parts.append(f"lpad(CAST((dayofyear({moment}) + 6 - weekday({moment})) div 7 AS STRING), 2, '0')")
        elif piece[1:] == "s":
            parts.append(f"CAST({_micros(moment)} div 1000000 AS STRING)")
        elif piece[1:] == "J":
            parts.append(f"CAST((CAST({_micros(moment)} AS DOUBLE) / 86400000000D + 2440587.5D) AS STRING)")
        elif piece[1:] in _CONVERSIONS:
            parts.append(f"date_format({moment}, '{_CONVERSIONS[piece[1:]]}')")
        else:
            raise SqlError(f"unsupported conversion in strftime: {piece}")
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})" if parts else "''"


def lenient_cast(x: str, kind: str) -> str:
    """CAST that takes the number a text starts with, or 0."""
    kind = kind.upper()
    if "INT" in kind:
        number = f"try_cast(regexp_extract(trim({_text(x)}), '^[+-]?\\\\d+', 0) AS BIGINT)"
        return f"(CASE WHEN {x} IS NULL THEN NULL WHEN typeof({x}) IN ('double', 'float') OR typeof({x}) LIKE 'decimal%' THEN try_cast(try_cast({_text(x)} AS DOUBLE) AS BIGINT) ELSE coalesce({number}, 0L) END)"
    if any(k in kind for k in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        number = f"try_cast(regexp_extract(trim({_text(x)}), '^[+-]?(\\\\d+\\\\.?\\\\d*|\\\\.\\\\d+)([eE][+-]?\\\\d+)?', 0) AS DOUBLE)"
        return f"(CASE WHEN {x} IS NULL THEN NULL ELSE coalesce({number}, 0D) END)"
    if any(k in kind for k in ("CHAR", "CLOB", "TEXT", "STRING")):
        return f"CAST({x} AS STRING)"
    if "BLOB" in kind or kind == "BINARY":
        return f"CAST({x} AS BINARY)"
    return f"CAST({x} AS {kind})"


def substr(args: list[str]) -> str:
    if len(args) == 2:
        s, p = args
        return f"(CASE WHEN {p} = 0 THEN {s} ELSE substr({s}, {p}) END)" if not _integer(p) else (s if int(p.replace(' ', '')) == 0 else f"substr({s}, {p})")
    s, p, n = args
    if _integer(p) and _integer(n) and int(p.replace(' ', '')) > 0 and int(n.replace(' ', '')) >= 0:
        return f"substr({s}, {p}, {n})"
    # Place 0 is the one before the first and counts towards the length; a negative length goes backwards.
    start = f"(CASE WHEN {p} < 0 THEN length({s}) + {p} + 1 ELSE {p} END)"
    low = f"(CASE WHEN {n} < 0 THEN {start} + {n} ELSE {start} END)"
    high = f"(CASE WHEN {n} < 0 THEN {start} ELSE {start} + {n} END)"
    return f"substr({s}, greatest({low}, 1), greatest({high} - greatest({low}, 1), 0))"


def _integer(x: str) -> bool:
    return re.fullmatch(r"-?\s*\d+", x.strip()) is not None


def _extreme(name: str) -> Callable[[list[str]], str]:
    def make(args: list[str]) -> str:
        if len(args) < 2:
            return f"{name}({', '.join(args)})"
        some_null = " OR ".join(f"{a} IS NULL" for a in args)
        return f"(CASE WHEN {some_null} THEN NULL ELSE {'greatest' if name == 'max' else 'least'}({', '.join(args)}) END)"

    return make


def _trim(side: str) -> Callable[[list[str]], str]:
    return lambda a: f"trim({side} ' ' FROM {a[0]})" if len(a) == 1 else f"trim({side} {a[1]} FROM {a[0]})"


def _log(args: list[str]) -> str:
    return f"log10({args[0]})" if len(args) == 1 else f"log({args[0]}, {args[1]})"


def glob_pattern(x: str) -> str:
    """A regular expression for a GLOB pattern, as Spark SQL text."""
    text = _literal(x)
    if text is None:
        raise SqlError("GLOB needs a literal pattern")
    out, i = "^", 0
    while i < len(text):
        c = text[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in text[i + 2 :]:
            end = text.index("]", i + 2)
            inner = text[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner.startswith("^") else inner).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    pattern = f"(?s){out}$"
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _typeof(args: list[str]) -> str:
    x = args[0]
    return (
        f"(CASE WHEN {x} IS NULL THEN 'null' WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' "
        f"WHEN typeof({x}) IN ('float', 'double') OR typeof({x}) LIKE 'decimal%' THEN 'real' WHEN typeof({x}) = 'binary' THEN 'blob' ELSE 'text' END)"
    )


def _quote(args: list[str]) -> str:
    x = args[0]
    return f"(CASE WHEN {x} IS NULL THEN 'NULL' WHEN typeof({x}) = 'string' THEN concat('''', replace({_text(x)}, '''', ''''''), '''') ELSE {_text(x)} END)"


def _json_path(x: str) -> str:
    """``a`` and ``0`` as in ``->>`` are paths as well."""
    text = _literal(x)
    if text is None:
        return f"concat('$[', {x}, ']')" if _integer(x) else x
    if text.startswith("$"):
        return x
    return "'$[" + text + "]'" if text.isdigit() else "'$." + text.replace("'", "''") + "'"


def json_extract(args: list[str]) -> str:
    return f"get_json_object({args[0]}, {_json_path(args[1])})"


def _json_object(args: list[str]) -> str:
    return f"to_json(named_struct({', '.join(args)}), map('ignoreNullFields', 'false'))"


def _wrap(name: str) -> Callable[[list[str]], str]:
    return lambda a: f"{name}({', '.join(a)})"


#: What calls become; names not listed are Spark's own.
def blankable(x: str) -> str:
    """A value as text, for comparing with the blank one: blank cells of number columns are NULL, those of text columns blank."""
    return f"(CASE WHEN typeof({x}) = 'string' THEN CAST({x} AS STRING) ELSE coalesce(CAST({x} AS STRING), '') END)"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(a: list[str]) -> str:
    """In lower case, as far as letters of ASCII go."""
    return f"translate({_text(a[0])}, '{_UPPER}', '{_LOWER}')"


def _char(a: list[str]) -> str:
    return "concat(" + ", ".join(f"decode(unhex(lpad(hex(CAST({x} AS BIGINT)), 8, '0')), 'UTF-32')" for x in a) + ")"


TEMPLATES: dict[str, Callable[[list[str]], str]] = {
    "julianday": julianday,
    "strftime": strftime,
    "date": formatted("yyyy-MM-dd"),
    "time": formatted("HH:mm:ss"),
    "datetime": formatted("yyyy-MM-dd HH:mm:ss"),
    "unixepoch": lambda a: f"({_micros(moment_of(a))} div 1000000)",
    "substr": substr,
    "substring": substr,
    "iif": lambda a: f"if(CAST({a[0]} AS BOOLEAN), {', '.join(a[1:]) if len(a) > 2 else a[1] + ', NULL'})",
    "lower": folded,
    "upper": lambda a: f"translate({_text(a[0])}, '{_LOWER}', '{_UPPER}')",
    "char": _char,
    "total": lambda a: f"coalesce(CAST(sum({a[0]}) AS DOUBLE), 0D)",
    "max": _extreme("max"),
    "min": _extreme("min"),
    "trim": _trim("BOTH"),
    "ltrim": _trim("LEADING"),
    "rtrim": _trim("TRAILING"),
    "log": _log,
    "unicode": lambda a: f"ascii({a[0]})",
    "typeof": _typeof,
    "quote": _quote,
    "round": lambda a: f"round(CAST({a[0]} AS DOUBLE){', ' + a[1] if len(a) > 1 else ''})",
    "json_extract": json_extract,
    "json_object": _json_object,
    "json_array": lambda a: f"to_json(array({', '.join(a)}))",
    "json_array_length": lambda a: f"json_array_length({a[0] if len(a) == 1 else json_extract(a)})",
    "json_valid": lambda a: f"(CASE WHEN {a[0]} IS NULL THEN NULL ELSE CAST(try_parse_json({a[0]}) IS NOT NULL AS INT) END)",
    "random": lambda a: "CAST((rand() - 0.5D) * 1.8446744073709552E19D AS BIGINT)",
    "last_insert_rowid": lambda a: "CAST(NULL AS BIGINT)",
    "total_changes": lambda a: "CAST(NULL AS BIGINT)",
    "format": _wrap("printf"),
    "sign": lambda a: f"CAST(sign({a[0]}) AS INT)",
    "sum": lambda a: f"try_sum({a[0]})",
    "zeroblob": lambda a: f"CAST(repeat(char(0), {a[0]}) AS BINARY)",
    "likely": lambda a: a[0],
    "unlikely": lambda a: a[0],
}
