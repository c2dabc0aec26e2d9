"""A session over files: tables, queries, changes, transactions and saving."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import DuplicateTableError, NoTablesError, SqlError, TesseraError
from .operators.sinks import DumpOptions, write_file
from .plans import changes
from .plans.branches import apart
from .plans.lexer import Token, closing, find, split, statements, tokenize
from .plans.rewrite import Dialect, group_bare_columns, quoted, rewrite
from .shipping import ship
from .sources.storage import Storage

#: Changes of a table after which its plan is cut.
CUT_AFTER = 20

_SETTINGS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.caseSensitive": "false",
    "spark.sql.cteRecursionLevelLimit": "100000",
    "spark.sql.cteRecursionRowLimit": "-1",
    "spark.sql.session.timeZone": "UTC",
}


@dataclass(frozen=True)
class AutoSave:
    """When tables are saved by themselves and where; no folder means over the files they came from."""

    folder: str | None
    options: DumpOptions
    on_commit: bool = False


def child_session(spark: SparkSession) -> SparkSession:
    """A session with views of its own and the settings that queries of the dialect need."""
    ship(spark)
    own = spark.newSession()
    for key, value in _SETTINGS.items():
        own.conf.set(key, value)
    return own


class FileSession:
    """Tables by name, and SQL over them.

    ``sql`` takes the embedded-database dialect and returns DataFrames, so
    nothing runs before a result is asked for.  Changes replace a table's
    DataFrame; files stay as they are until :meth:`dump` or autosave.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], origins: dict[str, str] | None = None, autosave: AutoSave | None = None, integer_division: bool = True):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}
        self._views: dict[str, list[Token]] = {}
        self._defaults: dict[str, dict[str, str]] = {}
        self._constraints: dict[str, changes.Constraints] = {}
        self._savepoints: list[tuple[str, tuple, bool]] = []
        self._changes: dict[str, int] = {}
        self._origins = origins or {}
        self._autosave = autosave
        self._saved: tuple | None = None
        self._integer_division = integer_division
        self.closed = False
        self._tag = f"tessera-{uuid.uuid4().hex}"
        for name, table in tables.items():
            self._put(name, table)
        self._catalog()

    # ---- tables ---------------------------------------------------------------------------

    @property
    def tables(self) -> list[str]:
        return list(self._tables)

    def table(self, name: str) -> DataFrame:
        return self._tables[self._known(name)]

    def register(self, name: str, table: DataFrame) -> None:
        """Add a DataFrame of this session as a table."""
        if self._find(name) is not None:
            raise DuplicateTableError(f"table '{name}' already exists, duplicate table names are not allowed")
        self._put(name, table)
        self._catalog()

    def _find(self, name: str) -> str | None:
        return next((t for t in (*self._tables, *self._views) if t.lower() == name.lower()), None)

    def _known(self, name: str) -> str:
        found = self._find(name)
        if found is None or found not in self._tables:
            raise SqlError(f"no such table: {name}")
        return found

    def _put(self, name: str, table: DataFrame, changed: bool = False) -> None:
        if changed:
            self._changes[name] = self._changes.get(name, 0) + 1
            if self._changes[name] % CUT_AFTER == 0:
                if not self.spark.sparkContext.getCheckpointDir():
                    self.spark.sparkContext.setCheckpointDir(Storage(self.spark).shared_folder())
                table = table.checkpoint()
        self._tables[name] = table
        table.createOrReplaceTempView(quoted(name))

    def _drop(self, name: str) -> None:
        self._tables.pop(name, None)
        self._views.pop(name, None)
        self._constraints.pop(name, None)
        self.spark.sql(f"DROP VIEW IF EXISTS {quoted(name)}")

    def _catalog(self) -> None:
        """Views follow their tables; ``sqlite_master`` lists both."""
        for name, query in self._views.items():
            self._run(list(query)).createOrReplaceTempView(quoted(name))
        rows = [("table", n, n, i + 2, f"CREATE TABLE [{n}] ({', '.join(f'[{f.name}] {declared(f.dataType)}' for f in t.schema.fields)})") for i, (n, t) in enumerate(self._tables.items())]
        rows += [("view", n, n, 0, f"CREATE VIEW [{n}] AS {' '.join(t.raw for t in q)}") for n, q in self._views.items()]
        master = self.spark.createDataFrame(rows, "type string, name string, tbl_name string, rootpage int, sql string")
        for name in ("sqlite_master", "sqlite_schema"):
            master.createOrReplaceTempView(name)

    # ---- statements -------------------------------------------------------------------------

    def sql(self, text: str, args: list | tuple | dict | None = None) -> DataFrame:
        """Run a statement, or several, and return the last one's result (changes: the number of tables' rows is not counted, so an empty frame)."""
        self._open()
        result = self._nothing()
        found = statements(text)
        if not found:
            raise SqlError("there is no statement")
        for tokens in found:
            result = self._statement(tokens, args)
        return result

    query = execute = sql

    def prepare(self, text: str):
        """A statement to run with different arguments."""
        return lambda *args: self.sql(text, list(args))

    def _open(self) -> None:
        if self.closed:
            raise TesseraError("the session is closed")

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "changes long")

    def _statement(self, tokens: list[Token], args) -> DataFrame:
        word = tokens[0].word
        if word in ("SELECT", "WITH", "VALUES") or tokens[0].is_sign("("):
            return self._run(tokens, args)
        if word == "EXPLAIN":
            rest = tokens[3:] if tokens[1].word == "QUERY" else tokens[1:]
            return self.spark.sql(f"EXPLAIN FORMATTED {self._text(rest)}")
        if word == "PRAGMA":
            return self._pragma(tokens)
        handler = {"INSERT": self._insert, "REPLACE": self._insert, "UPDATE": self._update, "DELETE": self._delete, "CREATE": self._create, "DROP": self._drop_statement, "ALTER": self._alter}.get(word)
        if handler is not None:
            handler(tokens, args)
            self._catalog()
            return self._nothing()
        if word in ("BEGIN", "START"):
            self.begin()
        elif word in ("COMMIT", "END"):
            self.commit()
        elif word == "ROLLBACK" and any(t.word == "TO" for t in tokens):
            self.rollback_to(tokens[-1].value)
        elif word == "ROLLBACK":
            self.rollback()
        elif word == "SAVEPOINT":
            self.savepoint(tokens[-1].value)
        elif word == "RELEASE":
            self.release(tokens[-1].value)
        elif word not in ("ANALYZE", "VACUUM", "REINDEX"):
            raise SqlError(f"unsupported statement: {tokens[0].raw}")
        return self._nothing()

    # ---- queries --------------------------------------------------------------------------

    def _names(self) -> frozenset[str]:
        names = {n.lower() for n in (*self._tables, *self._views)}
        for t in self._tables.values():
            names |= {c.lower() for c in t.columns}
        return frozenset(names)

    def _text(self, tokens: list[Token]) -> str:
        # Aliases are names as well.
        given = {b.value.lower() for a, b in zip(tokens, tokens[1:], strict=False) if a.word == "AS"}
        return rewrite(tokens, Dialect(self._names() | given, self._integer_division))

    def _run(self, tokens: list[Token], args=None) -> DataFrame:
        if tokens[0].word == "WITH" and tokens[1].word == "RECURSIVE":
            tokens = self._recursive(tokens, args)
        if any(t.kind == "word" and t.value.lower() in ("rowid", "oid", "_rowid_") for t in tokens):
            return self._with_rowid(tokens, args)
        return self._apart(tokens, args, self._spark(tokens, args))

    def _apart(self, tokens: list[Token], args, whole: DataFrame) -> DataFrame:
        """The same rows without products of left-joined tables, where only their different values are asked for."""

        def columns(name: str) -> list[str] | None:
            found = self._find(name)
            return self.spark.table(quoted(found)).columns if found else None

        less = apart(tokens, columns)
        if less is None or not whole._jdf.queryExecution().analyzed().deterministic():
            return whole
        try:
            made = self._call(self._text(less), args).toDF(*whole.columns)
        except (AnalysisException, ParseException):
            return whole
        return made if [f.dataType for f in made.schema.fields] == [f.dataType for f in whole.schema.fields] else whole

    def _spark(self, tokens: list[Token], args=None) -> DataFrame:
        try:
            return self._call(self._text(tokens), args)
        except (AnalysisException, ParseException) as e:
            if "MISSING_AGGREGATION" in str(e) or "MISSING_GROUP_BY" in str(e):
                return self._spark_error(self._text(group_bare_columns(tokens)), args)
            raise SqlError(first_line(e)) from e

    def _spark_error(self, text: str, args) -> DataFrame:
        try:
            return self._call(text, args)
        except (AnalysisException, ParseException) as e:
            raise SqlError(first_line(e)) from e

    def _call(self, text: str, args) -> DataFrame:
        if isinstance(args, dict):
            return self.spark.sql(text, args={k.lstrip(":@$"): v for k, v in args.items()})
        if args and ":p1" in text:
            return self.spark.sql(text, args={f"p{i}": v for i, v in enumerate(args, 1)})
        return self.spark.sql(text, args=list(args)) if args else self.spark.sql(text)

    def _with_rowid(self, tokens: list[Token], args) -> DataFrame:
        """Number the rows of tables that are named together with ``rowid``, for this query only."""
        words = {t.value.lower() for t in tokens}
        named = [n for n in self._tables if n.lower() in words]
        tokens = [Token("word", "rowid", "rowid") if t.kind == "word" and t.value.lower() in ("oid", "_rowid_") else t for t in tokens]
        try:
            for n in named:
                numbered(self._tables[n]).createOrReplaceTempView(quoted(n))
            return self._spark(tokens, args)
        finally:
            for n in named:
                self._tables[n].createOrReplaceTempView(quoted(n))

    def _recursive(self, tokens: list[Token], args) -> list[Token]:
        """Recursive queries by UNION, which Spark does not have, run to their fix-point here; what is left refers to the result."""
        at, kept = 2, []
        while True:
            name = tokens[at].value
            at += 1
            columns: list[str] = []
            if tokens[at].is_sign("("):
                end = closing(tokens, at)
                columns = [c[0].value for c in split(tokens[at + 1 : end])]
                at = end + 1
            start = next(i for i in range(at, len(tokens)) if tokens[i].is_sign("("))
            end = closing(tokens, start)
            body = tokens[start + 1 : end]
            union = find(body, "UNION")
            refers = any(t.value.lower() == name.lower() for t in body)
            if union >= 0 and refers and body[union + 1].word != "ALL":
                self._fix_point(name, columns, body[:union], body[union + 1 :], args)
            else:
                head = [tokens[at - 1]] if not columns else []
                kept.append([*(head or self._column_list(name, columns)), *tokenize("AS"), *tokens[start : end + 1]])
            at = end + 1
            if at < len(tokens) and tokens[at].is_sign(","):
                at += 1
                continue
            break
        if not kept:
            return tokens[at:]
        out = [*tokens[:2]]
        for i, part in enumerate(kept):
            out += ([*tokenize(",")] if i else []) + part
        return out + tokens[at:]

    @staticmethod
    def _column_list(name: str, columns: list[str]) -> list[Token]:
        return [Token("name", name, quoted(name)), *tokenize("(" + ", ".join(f"[{c}]" for c in columns) + ")")]

    def _fix_point(self, name: str, columns: list[str], base: list[Token], step: list[Token], args) -> None:
        """Rows that a step adds, until it adds none; each round's rows are written down, so plans stay small."""
        storage = Storage(self.spark)
        folder = storage.shared_folder()
        first = self._spark(base, args)
        first = first.toDF(*columns) if columns else first
        schema, rounds = first.schema, 0
        new = first.distinct()
        while True:
            path = f"{folder}/{rounds}"
            new.write.parquet(path)
            written = self.spark.read.schema(schema).parquet(path)
            if rounds and written.isEmpty():
                break
            rounds += 1
            written.createOrReplaceTempView(quoted(name))
            so_far = self.spark.read.schema(schema).parquet(*[f"{folder}/{r}" for r in range(rounds)])
            more = self._spark(step, args).toDF(*schema.names)
            more = more.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])
            new = more.distinct().exceptAll(so_far)
        self.spark.read.schema(schema).parquet(*[f"{folder}/{r}" for r in range(max(1, rounds))]).createOrReplaceTempView(quoted(name))

    def _pragma(self, tokens: list[Token]) -> DataFrame:
        name = tokens[1].value.lower()
        if name in ("table_info", "table_xinfo") and len(tokens) > 3:
            table = self.table(tokens[3].value)
            rows = [(i, f.name, declared(f.dataType), 0, None, 0) for i, f in enumerate(table.schema.fields)]
            return self.spark.createDataFrame(rows, "cid int, name string, type string, notnull int, dflt_value string, pk int")
        if name == "table_list":
            rows = [("main", n, "table", len(t.columns), 0, 0) for n, t in self._tables.items()]
            return self.spark.createDataFrame(rows, "schema string, name string, type string, ncol int, wr int, strict int")
        return self._nothing()

    # ---- changes --------------------------------------------------------------------------

    def _insert(self, tokens: list[Token], args) -> None:
        statement = changes.parse_insert(tokens)
        name = self._known(statement.table)
        table = self._tables[name]
        fields = {f.name.lower(): f for f in table.schema.fields}
        columns = [c.lower() for c in statement.columns] or list(fields)
        for c in columns:
            if c not in fields:
                raise SqlError(f"table {name} has no column named {c}")
        defaults = self._defaults.get(name, {})
        if statement.source:
            new = self._run(list(statement.source), args)
            if len(new.columns) != len(columns):
                raise SqlError(f"{len(new.columns)} values for {len(columns)} columns")
            new = new.toDF(*[f"v{i}" for i in range(len(columns))])
        else:
            new, columns = self.spark.range(1).select(), []
        given = {c: F.col(f"v{i}") for i, c in enumerate(columns)}
        value = lambda c: given[c] if c in given else F.expr(defaults[c]) if c in defaults else F.lit(None)
        new = new.select(*[value(c).alias(f.name) for c, f in fields.items()])
        table, new = self._fitted(table, new)
        table, new = self._constrained(name, table, new, statement.conflict)
        self._put(name, table.unionByName(new), changed=True)

    def _constrained(self, name: str, table: DataFrame, new: DataFrame, conflict: str) -> tuple[DataFrame, DataFrame]:
        """The table and new rows as far as the table's constraints and the statement's conflict clause let them stand."""
        rules = self._constraints.get(name)
        if not rules:
            return table, new
        column = lambda c: F.col(quoted(c))
        if rules.auto:
            known = table.agg(F.max(column(rules.auto))).first()[0]
            known = max(known or 0, new.agg(F.max(column(rules.auto))).first()[0] or 0)
            given = numbered(new.where(column(rules.auto).isNull())).withColumn(rules.auto, F.col("rowid") + known).drop("rowid")
            new = new.where(column(rules.auto).isNotNull()).unionByName(given.select(*[column(c).cast(new.schema[c].dataType).alias(c) for c in new.columns]))
        # Numbers that tell earlier rows from later ones must not change between uses.
        path = f"{Storage(self.spark).shared_folder()}/new"
        new.withColumn("_tessera_nth", F.monotonically_increasing_id()).write.parquet(path)
        new = self.spark.read.parquet(path)
        new = new.select(*[column(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields], "_tessera_nth")

        def refuse(bad: DataFrame, what: str) -> None:
            if not bad.isEmpty():
                raise SqlError(f"{what} constraint failed: {name}")

        for c in rules.not_null:
            if conflict != "IGNORE":
                refuse(new.where(column(c).isNull()), f"NOT NULL of {c}")
            new = new.where(column(c).isNotNull())
        for check in rules.checks:
            text = self._text(list(check))
            holds = F.coalesce(F.expr(text).cast("boolean"), F.lit(True))
            if conflict != "IGNORE":
                refuse(new.where(~holds), f"CHECK ({text})")
            new = new.where(holds)
        for key in rules.keys:
            whole = F.lit(True)
            for c in key:
                whole = whole & column(c).isNotNull()  # NULLs differ from each other
            keyed, free = new.where(whole), new.where(~whole)
            names = list(key)
            if conflict not in ("REPLACE", "IGNORE"):
                refuse(keyed.groupBy(*[quoted(c) for c in names]).count().where("count > 1"), f"UNIQUE of {', '.join(key)}")
                refuse(keyed.join(table.select(*[quoted(c) for c in names]), names, "left_semi"), f"UNIQUE of {', '.join(key)}")
                continue
            chosen = keyed.groupBy(*[quoted(c) for c in names]).agg((F.max if conflict == "REPLACE" else F.min)("_tessera_nth").alias("_tessera_nth"))
            keyed = keyed.join(chosen.select("_tessera_nth"), "_tessera_nth", "left_semi")
            if conflict == "REPLACE":
                table = table.join(keyed.select(*[quoted(c) for c in names]), names, "left_anti").select(*[column(c) for c in table.columns])
            else:
                keyed = keyed.join(table.select(*[quoted(c) for c in names]), names, "left_anti")
            new = keyed.select(*[column(c) for c in new.columns]).unionByName(free)
        return table, new.drop("_tessera_nth")

    def _kept_constraints(self, name: str, table: DataFrame, changed: set[str]) -> None:
        """An error if the rows of a table, after a change of some columns, break its constraints."""
        rules = self._constraints.get(name)
        if not rules:
            return
        for c in rules.not_null:
            if c.lower() in changed and not table.where(F.col(quoted(c)).isNull()).isEmpty():
                raise SqlError(f"NOT NULL of {c} constraint failed: {name}")
        for check in rules.checks:
            if not table.where(~F.coalesce(F.expr(self._text(list(check))).cast("boolean"), F.lit(True))).isEmpty():
                raise SqlError(f"CHECK constraint failed: {name}")
        for key in rules.keys:
            if changed & {c.lower() for c in key}:
                whole = table.dropna(subset=list(key))
                if not whole.groupBy(*[quoted(c) for c in key]).count().where("count > 1").isEmpty():
                    raise SqlError(f"UNIQUE of {', '.join(key)} constraint failed: {name}")

    @staticmethod
    def _fitted(table: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both with common column types: those of the table, wider where a value would not fit."""
        wide: dict[str, T.DataType] = {}
        for f, g in zip(table.schema.fields, new.schema.fields, strict=True):
            if f.dataType == g.dataType or isinstance(g.dataType, T.NullType):
                continue
            number = isinstance(f.dataType, T.NumericType)
            if number and isinstance(g.dataType, T.StringType):
                c = F.col(quoted(g.name))
                if not new.where(c.isNotNull() & c.try_cast(f.dataType).isNull()).isEmpty():
                    wide[f.name] = T.StringType()
            elif isinstance(f.dataType, T.IntegralType) and isinstance(g.dataType, (T.FractionalType)):
                wide[f.name] = T.DoubleType()
            elif isinstance(f.dataType, T.NullType):
                wide[f.name] = g.dataType
        shape = lambda df: df.select(*[F.col(quoted(f.name)).cast(wide.get(f.name, f.dataType)).alias(f.name) for f in table.schema.fields])
        return (shape(table) if wide else table), shape(new)

    def _with_row(self, name: str) -> DataFrame:
        """The table with ``_tessera_row``, written so that the numbers are the same in each use."""
        table = self._tables[name].withColumn("_tessera_row", F.monotonically_increasing_id())
        path = f"{Storage(self.spark).shared_folder()}/rows"
        table.write.parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def _matching(self, name: str, condition: list[Token], args, alias: str = "") -> tuple[DataFrame, DataFrame]:
        """The table with row numbers, and the numbers of rows for which a condition with a subquery holds."""
        table = self._with_row(name)
        table.createOrReplaceTempView(quoted(name))
        try:
            as_ = f" AS {quoted(alias)}" if alias else ""
            hits = self._spark_error(f"SELECT DISTINCT {quoted(alias or name)}._tessera_row FROM {quoted(name)}{as_} WHERE {self._text(condition)}", args)
        finally:
            self._tables[name].createOrReplaceTempView(quoted(name))
        return table, hits

    def _update(self, tokens: list[Token], args) -> None:
        statement = changes.parse_update(tokens)
        name = self._known(statement.table)
        table = self._tables[name]
        fields = {f.name.lower(): f.name for f in table.schema.fields}
        for c, _ in statement.assignments:
            if c.lower() not in fields:
                raise SqlError(f"no such column: {c}")
        set_ = {fields[c.lower()]: self._text(list(v)) for c, v in statement.assignments}
        if statement.source:
            new = self._updated_from(name, statement, set_, args)
            self._kept_constraints(name, new, {c.lower() for c in set_})
            self._put(name, new, changed=True)
            return
        condition = list(statement.condition)
        subquery = any(t.word == "SELECT" for t in condition)
        alias = f" AS {quoted(statement.alias)}" if statement.alias else ""
        if subquery:
            numbered_, hits = self._matching(name, condition, args, statement.alias)
            source = numbered_.join(hits.withColumn("_tessera_hit", F.lit(True)), "_tessera_row", "left")
            source.createOrReplaceTempView(quoted(name))
            test = "coalesce(_tessera_hit, false)"
        else:
            test = f"coalesce({self._text(condition)}, false)" if condition else "true"
        # Arguments come in the order of the text: values first, then the condition, once per column.
        columns = [f"CASE WHEN {test} THEN {set_[c]} ELSE {quoted(c)} END AS {quoted(c)}" if c in set_ else quoted(c) for c in table.columns]
        values = [args] if isinstance(args, dict) or not args else None
        try:
            if values is None:
                new = self._update_with_args(name, alias, table, statement, test if subquery else None, list(args))
            else:
                new = self._spark_error(f"SELECT {', '.join(columns)} FROM {quoted(name)}{alias}", values[0])
        finally:
            table.createOrReplaceTempView(quoted(name))
        self._kept_constraints(name, new, {c.lower() for c, _ in statement.assignments})
        self._put(name, new, changed=True)

    def _updated_from(self, name: str, statement: changes.Update, set_: dict[str, str], args) -> DataFrame:
        """Values from rows of other tables; where several fit a row, the least ones are taken."""
        table = self._with_row(name)
        me = quoted(statement.alias or name)
        as_ = f" AS {me}" if statement.alias else ""
        where = f" WHERE {self._text(list(statement.condition))}" if statement.condition else ""
        values = ", ".join(f"{v} AS {quoted(c)}" for c, v in set_.items())
        table.createOrReplaceTempView(quoted(name))
        try:
            found = self._spark_error(f"SELECT {values}, {me}._tessera_row FROM {quoted(name)}{as_} CROSS JOIN {self._text(list(statement.source))}{where}", args)
        finally:
            self._tables[name].createOrReplaceTempView(quoted(name))
        new = found.groupBy("_tessera_row").agg(F.min(F.struct(*[quoted(c) for c in set_])).alias("_tessera_new"))
        value = lambda c: F.when(F.col("_tessera_new").isNotNull(), F.col(f"_tessera_new.{quoted(c)}")).otherwise(F.col(quoted(c))).alias(c)
        return table.join(new, "_tessera_row", "left").select(*[value(c) if c in set_ else F.col(quoted(c)) for c in self._tables[name].columns])

    def _update_with_args(self, name: str, alias: str, table: DataFrame, statement: changes.Update, test: str | None, args: list) -> DataFrame:
        """Positional arguments are used once each: the condition's is computed in a query of its own below."""
        count = lambda tokens: sum(t.raw == "?" for t in tokens)
        n_values = sum(count(v) for _, v in statement.assignments)
        condition = list(statement.condition)
        inner_test = test or (f"coalesce({self._text(condition)}, false)" if condition else "true")
        inner = f"SELECT *, {inner_test} AS _tessera_test FROM {quoted(name)}{alias}"
        set_ = {c.lower(): self._text(list(v)) for c, v in statement.assignments}
        out = []
        for c in table.columns:
            out.append(f"CASE WHEN _tessera_test THEN {set_[c.lower()]} ELSE {quoted(c)} END AS {quoted(c)}" if c.lower() in set_ else quoted(c))
        # Values appear in the columns' order, which may not be that of SET.
        order, at = {}, 0
        for c, v in statement.assignments:
            order[c.lower()] = args[at : at + count(v)]
            at += count(v)
        values = [x for c in table.columns for x in order.get(c.lower(), [])]
        return self._spark_error(f"SELECT {', '.join(out)} FROM ({inner}) AS {quoted(statement.alias or name)}", values + args[n_values:])

    def _delete(self, tokens: list[Token], args) -> None:
        statement = changes.parse_delete(tokens)
        name = self._known(statement.table)
        table, condition = self._tables[name], list(statement.condition)
        if not condition:
            new = table.where(F.lit(False))
        elif any(t.word == "SELECT" for t in condition):
            numbered_, hits = self._matching(name, condition, args)
            new = numbered_.join(hits, "_tessera_row", "left_anti").select(*[F.col(quoted(c)) for c in table.columns])
        else:
            new = self._spark_error(f"SELECT * FROM {quoted(name)} WHERE NOT coalesce({self._text(condition)}, false)", args)
        self._put(name, new, changed=True)

    def _create(self, tokens: list[Token], args) -> None:
        rest = [t for t in tokens[1:]]
        if rest[0].word in ("TEMP", "TEMPORARY", "UNIQUE"):
            rest = rest[1:]
        kind, rest = rest[0].word, rest[1:]
        if kind == "INDEX":
            return  # Spark has no use for one
        if kind not in ("TABLE", "VIEW"):
            raise SqlError(f"unsupported: CREATE {kind}")
        unless = [t.word for t in rest[:3]] == ["IF", "NOT", "EXISTS"]
        name, rest = changes.name_at(rest[3:] if unless else rest)
        if self._find(name) is not None:
            if unless:
                return
            raise DuplicateTableError(f"table {name} already exists")
        if kind == "VIEW":
            self._views[name] = rest[1:]
            try:
                self._run(rest[1:], args)
            except SqlError:
                del self._views[name]
                raise
            return
        if rest[0].word == "AS":
            return self._put(name, self._run(rest[1:], args))
        columns = changes.parse_columns(rest[1 : closing(rest, 0)])
        self._constraints[name] = changes.parse_constraints(rest[1 : closing(rest, 0)])
        self._defaults[name] = {c.name.lower(): self._text(list(c.default)) for c in columns if c.default}
        self._put(name, self.spark.createDataFrame([], ", ".join(f"{quoted(c.name)} {c.type}" for c in columns)))

    def _drop_statement(self, tokens: list[Token], args) -> None:
        if tokens[1].word in ("INDEX", "TRIGGER"):
            return
        rest = tokens[2:]
        if_exists = [t.word for t in rest[:2]] == ["IF", "EXISTS"]
        name, _ = changes.name_at(rest[2:] if if_exists else rest)
        found = self._find(name)
        if found is not None:
            self._drop(found)
        elif not if_exists:
            raise SqlError(f"no such table: {name}")

    def _alter(self, tokens: list[Token], args) -> None:
        given, rest = changes.name_at(tokens[2:])
        name = self._known(given)
        table = self._tables[name]
        verb, rest = rest[0].word, rest[1:]
        if verb == "RENAME" and rest[0].word == "TO":
            rules, defaults = self._constraints.pop(name, None), self._defaults.pop(name, None)
            self._drop(name)
            if rules is not None:
                self._constraints[rest[1].value], self._defaults[rest[1].value] = rules, defaults or {}
            self._origins[rest[1].value] = self._origins.pop(name, "")
            return self._put(rest[1].value, table)
        if rest and rest[0].word == "COLUMN":
            rest = rest[1:]
        if verb == "RENAME":
            return self._put(name, table.withColumnRenamed(rest[0].value, rest[2].value), changed=True)
        if verb == "DROP":
            return self._put(name, table.drop(rest[0].value), changed=True)
        if verb == "ADD":
            column = changes.parse_columns(rest)[0]
            value = self._text(list(column.default)) if column.default else "NULL"
            return self._put(name, table.withColumn(column.name, F.expr(value).cast(column.type)), changed=True)
        raise SqlError(f"unsupported: ALTER TABLE ... {verb}")

    # ---- transactions and saving --------------------------------------------------------------

    def begin(self) -> None:
        self._open()
        if self._saved is not None:
            raise SqlError("cannot start a transaction within a transaction")
        self._saved = self._state()

    def _state(self) -> tuple:
        return dict(self._tables), dict(self._views), dict(self._defaults), dict(self._constraints)

    def commit(self) -> None:
        if self._saved is None:
            raise SqlError("no transaction is active")
        self._saved, self._savepoints = None, []
        if self._autosave is not None and self._autosave.on_commit:
            self._save()

    def rollback(self) -> None:
        if self._saved is None:
            raise SqlError("no transaction is active")
        saved, self._saved, self._savepoints = self._saved, None, []
        self._restore(saved)

    def savepoint(self, name: str) -> None:
        """A state to come back to; outside of a transaction it begins one."""
        begins = self._saved is None
        if begins:
            self.begin()
        self._savepoints.append((name.lower(), self._state(), begins))

    def _savepoint(self, name: str) -> int:
        found = [i for i, s in enumerate(self._savepoints) if s[0] == name.lower()]
        if not found:
            raise SqlError(f"no such savepoint: {name}")
        return found[-1]

    def release(self, name: str) -> None:
        """Forget a savepoint and those after it; one that began the transaction commits it."""
        at = self._savepoint(name)
        begins = self._savepoints[at][2]
        del self._savepoints[at:]
        if begins:
            self.commit()

    def rollback_to(self, name: str) -> None:
        """Back to a savepoint, which stays."""
        at = self._savepoint(name)
        del self._savepoints[at + 1 :]
        self._restore(self._savepoints[at][1])

    def _restore(self, state: tuple) -> None:
        tables, views, defaults, constraints = (dict(x) for x in state)
        for name in [n for n in (*self._tables, *self._views) if n not in tables and n not in views]:
            self._drop(name)
        self._views, self._defaults, self._constraints = views, defaults, constraints
        for name, table in tables.items():
            self._put(name, table)
        self._catalog()

    @contextmanager
    def transaction(self) -> Iterator[FileSession]:
        """Changes within are kept together: an error takes all of them back."""
        self.begin()
        try:
            yield self
        except BaseException:
            if self._saved is not None:
                self.rollback()
            raise
        if self._saved is not None:
            self.commit()

    # ---- cancelling ------------------------------------------------------------------------

    @contextmanager
    def limit(self, seconds: float | None = None) -> Iterator[FileSession]:
        """Jobs started within are cancelled after so many seconds, or by :meth:`cancel`."""
        sc = self.spark.sparkContext
        sc.addJobTag(self._tag)
        timer = threading.Timer(seconds, self.cancel) if seconds is not None else None
        if timer is not None:
            timer.daemon = True
            timer.start()
        try:
            yield self
        finally:
            if timer is not None:
                timer.cancel()
            sc.removeJobTag(self._tag)

    def cancel(self) -> None:
        """Stop the jobs started within :meth:`limit`, from any thread."""
        self.spark.sparkContext.cancelJobsWithTag(self._tag)

    def dump(self, folder: str, options: DumpOptions = DumpOptions()) -> list[str]:
        """Write each table into a file of its own below ``folder``; their paths."""
        self._open()
        options.check()
        if not self._tables:
            raise NoTablesError("no tables found in database")
        Storage(self.spark).make_dir(folder)
        paths = []
        for name in self._tables:
            path = f"{folder.rstrip('/')}/{name.replace('/', '_')}{options.file_extension}"
            self._write(name, path, options)
            paths.append(path)
        return paths

    def _write(self, name: str, path: str, options: DumpOptions) -> None:
        storage = Storage(self.spark)
        over = storage.exists(path)
        if over:
            # The plan may read the very file that is replaced.
            if not self.spark.sparkContext.getCheckpointDir():
                self.spark.sparkContext.setCheckpointDir(storage.shared_folder())
            self._put(name, self._tables[name].checkpoint())
        write_file(self._tables[name], path, options, name)

    def _save(self) -> None:
        assert self._autosave is not None
        if self._autosave.folder:
            self.dump(self._autosave.folder, self._autosave.options)
            return
        for name in self._tables:
            origin = self._origins.get(name)
            if origin:
                folder = origin.rsplit("/", 1)[0] if "/" in origin else "."
                self._write(name, f"{folder}/{name}{self._autosave.options.file_extension}", self._autosave.options)

    def close(self) -> None:
        """Save, if that is wanted on closing, and end the session."""
        if self.closed:
            return
        if self._saved is not None:
            self.rollback()
        try:
            if self._autosave is not None and not self._autosave.on_commit:
                self._save()
        finally:
            self.closed = True
            for name in (*self._tables, *self._views):
                self.spark.catalog.dropTempView(name)

    def __enter__(self) -> FileSession:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def first_line(error: Exception) -> str:
    """The first line of an error's text that says something."""
    return next((line for line in str(error).splitlines() if line.strip()), type(error).__name__)


def declared(kind: T.DataType) -> str:
    """The column type as the dialect names it."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "INTEGER"
    if isinstance(kind, (T.FractionalType,)):
        return "REAL"
    return "BLOB" if isinstance(kind, T.BinaryType) else "TEXT"


def numbered(table: DataFrame) -> DataFrame:
    """With ``rowid``, from 1 in the order of the rows: partitions are counted first, so no task sees all rows."""
    placed = table.withColumn("_tessera_at", F.monotonically_increasing_id())
    partition = F.shiftright("_tessera_at", 33)
    counts = sorted((r["p"], r["count"]) for r in placed.groupBy(partition.alias("p")).count().collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    # A row for each partition, as a local table whose size Spark knows; within a partition the numbers are dense already.
    starts = table.sparkSession.createDataFrame(pa.table({f"_tessera_{k}": pa.array([b[i] for b in before], pa.int64()) for i, k in enumerate(("part", "start"))}))
    placed = placed.withColumn("_tessera_part", partition).join(starts, "_tessera_part")
    rowid = F.col("_tessera_start") + F.col("_tessera_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("rowid", rowid.cast("bigint")).drop("_tessera_at", "_tessera_part", "_tessera_start")
