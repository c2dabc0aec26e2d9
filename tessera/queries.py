"""Catalogue of queries for the driver: each over the engine's session, with the DuckDB SQL of the same result."""

from __future__ import annotations

import bz2
import io
import zipfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .builder import Builder
from .operators.sinks import DumpOptions, write_file
from .session import FileSession, child_session
from .sources.storage import Storage

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Query:
    """``sql`` is in the engine's dialect; ``oracle`` defaults to the same text."""

    sql: str | Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if callable(self.sql):
            return self.sql(spark, sf_dir)
        return session(spark, sf_dir, self.sql).sql(self.sql)


def session(spark: SparkSession, sf_dir: str, text: str = "") -> FileSession:
    """A session over the driver's tables that a text names."""
    own = child_session(spark)
    wanted = [t for t in TABLES if not text or t in text]
    return FileSession(own, {t: own.read.parquet(f"{sf_dir}/{t}.parquet") for t in wanted})


FLAGSHIP = """
SELECT c.c_custkey, c.c_name, n.n_name AS nation, c.c_acctbal,
       CAST(RANK() OVER (PARTITION BY c.c_nationkey ORDER BY c.c_acctbal DESC, c.c_custkey) AS BIGINT) AS rank_in_nation,
       ROUND(AVG(c.c_acctbal) OVER (PARTITION BY c.c_nationkey), 4) AS nation_avg,
       COUNT(*) OVER (PARTITION BY c.c_nationkey) AS nation_customers,
       CASE WHEN c.c_acctbal > (SELECT AVG(x.c_acctbal) FROM customer x WHERE x.c_nationkey = c.c_nationkey) * 1.2 THEN 'High'
            WHEN c.c_acctbal < (SELECT AVG(x.c_acctbal) FROM customer x WHERE x.c_nationkey = c.c_nationkey) * 0.8 THEN 'Low'
            ELSE 'Average' END AS category
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE c.c_acctbal > (SELECT AVG(y.c_acctbal) * 0.7 FROM customer y WHERE y.c_nationkey = c.c_nationkey)
ORDER BY nation, c.c_acctbal DESC, c.c_custkey LIMIT 100
"""


def _changed(*statements: str, result: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir, " ".join(statements) + result)
        for text in statements:
            s.sql(text)
        return s.sql(result)

    return run


def _rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "customer")
    s.begin()
    s.sql("DELETE FROM customer WHERE c_custkey > 10")
    s.rollback()
    return s.sql("SELECT COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS total FROM customer")


def _round_trip(table: str, options: DumpOptions) -> Callable[[SparkSession, str], DataFrame]:
    """Write a table into a file, open the file as a source, infer its types and read it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = child_session(spark)
        rows = own.read.parquet(f"{sf_dir}/{table}.parquet")
        path = f"{Storage(own).shared_folder()}/{table}{options.file_extension}"
        write_file(rows, path, options, table)
        opened = Builder(own).add_path(path).build().open()
        back = opened.table(opened.tables[0])
        return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema.fields])

    return run


def _sqlite_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir, "region nation").sql("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")


def _table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = session(spark, sf_dir, "nation").sql("PRAGMA table_info(nation)")
    return info.select(F.col("cid").cast("bigint").alias("cid"), "name", "type")


def _rowid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir, "nation").sql("SELECT a.rowid AS row_no, a.n_name AS n_name FROM nation a JOIN nation b ON a.rowid = b.rowid")


def _written(own: SparkSession, sf_dir: str, **tables: str) -> tuple[Storage, str]:
    """A shared folder with a file for each table, named after it, of the extension that is given."""
    storage = Storage(own)
    folder = storage.shared_folder()
    for table, extension in tables.items():
        rows = own.read.parquet(f"{sf_dir}/{table}.parquet")
        plain = extension.removesuffix(".bz2")
        options = DumpOptions().with_format(plain)
        write_file(rows, f"{folder}/{table}.{plain}", options, table)
        if plain != extension:
            storage.write(f"{folder}/{table}.{extension}", bz2.compress(storage.read(f"{folder}/{table}.{plain}")))
            storage.delete(f"{folder}/{table}.{plain}")
    return storage, folder


def _folder_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of a table each as bzip2-compressed CSV, TSV, LTSV and Parquet, joined across formats."""
    own = child_session(spark)
    _, folder = _written(own, sf_dir, region="csv.bz2", nation="tsv", supplier="ltsv", customer="parquet")
    return Builder(own).add_path(folder).build().open().sql(FOLDER_JOINED)


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte stream, and a zip archive as a virtual folder, as sources."""
    own = child_session(spark)
    storage, folder = _written(own, sf_dir, region="csv", nation="tsv")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("inner/nation.tsv", storage.read(f"{folder}/nation.tsv"))
        archive.writestr("inner/read.me", b"left out")
    opened = Builder(own).add_reader(io.BytesIO(storage.read(f"{folder}/region.csv")), "places", "csv").add_fs(zipfile.Path(packed)).build().open()
    return opened.sql("SELECT p.r_name, n.n_name FROM places p JOIN nation n ON n.n_regionkey = p.r_regionkey")


def _header_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = Builder(child_session(spark)).add_reader(io.BytesIO(b"id,name\n"), "none", "csv").build().open()
    return opened.sql("SELECT COUNT(*) AS n, COUNT(id) AS ids, COUNT(name) AS names FROM none")


def _parquet_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = Builder(child_session(spark)).with_options(parquet_mode="text").add_path(f"{sf_dir}/part.parquet").build().open()
    return opened.sql("SELECT p_partkey, p_size, p_brand FROM part WHERE p_size = '7'")


def _arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "customer")
    found = s.prepare("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = ? AND c_acctbal > ? AND c_name LIKE ?")
    return found(3, 1000.0, "customer%").unionByName(s.sql("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = :n AND c_acctbal <= :low", {"n": 4, "low": 0}))


def _dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed tables are dumped, and the dump is opened."""
    s = session(spark, sf_dir, "nation region")
    s.sql("DELETE FROM nation WHERE n_regionkey = 2")
    folder = Storage(s.spark).shared_folder()
    s.dump(folder, DumpOptions().with_format("tsv").with_compression("gzip"))
    return Builder(s.spark).add_path(folder).build().open().sql("SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey")


def _autosaved(on_commit: bool) -> Callable[[SparkSession, str], DataFrame]:
    """A change is saved over the file it came from, on commit or on closing."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = child_session(spark)
        _, folder = _written(own, sf_dir, region="csv")
        builder = Builder(own).add_path(f"{folder}/region.csv")
        opened = (builder.enable_auto_save_on_commit() if on_commit else builder.enable_auto_save()).build().open()
        opened.begin()
        opened.sql("UPDATE region SET r_name = r_name || '!' WHERE r_regionkey > 1")
        opened.commit()
        if not on_commit:
            opened.close()
        return Builder(own).add_path(f"{folder}/region.csv").build().open().sql("SELECT r_regionkey, r_name FROM region")

    return run


FOLDER_JOINED = """
SELECT r.r_name, n.n_name, COUNT(DISTINCT s.s_suppkey) AS suppliers, COUNT(DISTINCT c.c_custkey) AS customers
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey
LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey
GROUP BY r.r_name, n.n_name
"""
SAVED = "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, CASE WHEN r_regionkey > 1 THEN r_name || '!' ELSE r_name END AS r_name FROM region"

QUERIES: dict[str, Query] = {
    "flagship": Query(FLAGSHIP),
    # projection, filter, predicates
    "filter_project": Query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND NOT l_returnflag = 'R'"),
    "filter_or_in_between": Query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') OR o_totalprice BETWEEN 1000 AND 20000"),
    "like_ci": Query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'customer%1' AND c_mktsegment NOT LIKE 'auto%'", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE 'customer%1' AND c_mktsegment NOT ILIKE 'auto%'"),
    "glob_match": Query("SELECT c_custkey FROM customer WHERE c_mktsegment GLOB '[A-B]*'", "SELECT c_custkey FROM customer WHERE c_mktsegment GLOB '[A-B]*'"),
    "regexp_match": Query("SELECT p_partkey FROM part WHERE p_brand REGEXP '[12]$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '[12]$')"),
    "null_coalesce": Query("SELECT o.o_orderkey, COALESCE(l.q, 0.0) AS q, IFNULL(l.q, -1.0) AS r, NULLIF(o.o_orderstatus, 'F') AS s FROM orders o LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS q FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey"),
    "is_null": Query("SELECT COUNT(*) AS n FROM (SELECT NULLIF(o_orderstatus, 'F') AS s FROM orders) WHERE s IS NULL", "SELECT COUNT(*) AS n FROM (SELECT NULLIF(o_orderstatus, 'F') AS s FROM orders) t WHERE s IS NULL"),
    "empty_string": Query("SELECT COUNT(*) AS n FROM customer WHERE c_acctbal != '' AND c_name != ''", "SELECT COUNT(*) AS n FROM customer WHERE CAST(c_acctbal AS VARCHAR) <> '' AND c_name <> ''"),
    "empty_string_left_join": Query(
        "SELECT c.c_custkey FROM customer c LEFT JOIN (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 300000) o ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = '' OR '' = o.o_orderstatus OR o.o_orderstatus IN ('', 'F')",
        "SELECT c.c_custkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 300000 AND o.o_orderstatus IN ('', 'F')",
    ),
    "like_backslash": Query("SELECT COUNT(*) AS n FROM nation WHERE n_name || '\\x' LIKE '%\\X' AND n_name NOT LIKE 'Ä%'", "SELECT COUNT(*) AS n FROM nation"),
    "iif_number": Query("SELECT n_nationkey, IIF(n_regionkey, 'some', 'none') AS r FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey <> 0 THEN 'some' ELSE 'none' END AS r FROM nation"),
    "case_bucket": Query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS bucket FROM orders"),
    "bit_ops": Query("SELECT p_partkey, p_size & 7 AS a, p_size | 8 AS b, p_size << 2 AS c, p_size >> 1 AS d FROM part"),
    "quoted_names": Query("SELECT [n_nationkey] AS [key], \"n_name\" AS \"name\", `n_regionkey` AS r FROM [nation]", "SELECT n_nationkey AS \"key\", n_name AS name, n_regionkey AS r FROM nation"),
    # functions
    "string_fns": Query(
        "SELECT c_custkey, CAST(LENGTH(c_name) AS BIGINT) AS len, UPPER(c_mktsegment) AS up, LOWER(c_name) AS low, SUBSTR(c_name, 1, 4) AS head, SUBSTR(c_name, -3) AS tail, CAST(INSTR(c_name, '#') AS BIGINT) AS at, REPLACE(c_name, '0', '') AS no_zero, c_mktsegment || '-' || c_nationkey AS both, TRIM(c_name, 'C') AS trimmed FROM customer",
        "SELECT c_custkey, length(c_name) AS len, upper(c_mktsegment) AS up, lower(c_name) AS low, substr(c_name, 1, 4) AS head, substr(c_name, -3) AS tail, instr(c_name, '#') AS at, replace(c_name, '0', '') AS no_zero, c_mktsegment || '-' || c_nationkey AS both, trim(c_name, 'C') AS trimmed FROM customer",
    ),
    "string_more": Query("SELECT p_partkey, LTRIM(p_brand, 'B') AS l, RTRIM(p_brand, '123') AS r, CHAR(65, 66) AS c, SUBSTR(p_name, 0, 3) AS z FROM part", "SELECT p_partkey, ltrim(p_brand, 'B') AS l, rtrim(p_brand, '123') AS r, chr(65) || chr(66) AS c, substr(p_name, 1, 2) AS z FROM part"),
    "string_shown": Query("SELECT p_partkey, PRINTF('%d-%s', p_size, p_brand) AS f, HEX(p_brand) AS h, UNICODE(p_brand) AS u, QUOTE(p_brand) AS q, CONCAT_WS('/', p_brand, p_type) AS j FROM part", "SELECT p_partkey, printf('%d-%s', p_size, p_brand) AS f, hex(p_brand) AS h, unicode(p_brand) AS u, '''' || replace(p_brand, '''', '''''') || '''' AS q, concat_ws('/', p_brand, p_type) AS j FROM part"),
    "math_fns": Query("SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 4) AS net, ABS(l_quantity - 25) AS away, CAST(l_orderkey % 7 AS BIGINT) AS m FROM lineitem"),
    "math_more": Query("SELECT p_partkey, SQRT(p_size) AS s, ROUND(LOG(p_size), 9) AS l, POW(p_size, 2) AS p, MAX(p_size, 25) AS hi, MIN(p_size, 25) AS lo FROM part", "SELECT p_partkey, sqrt(p_size) AS s, round(log10(p_size), 9) AS l, pow(p_size, 2) AS p, greatest(p_size, 25) AS hi, least(p_size, 25) AS lo FROM part"),
    "math_rest": Query("SELECT c_custkey, SIGN(c_acctbal) AS s, ROUND(EXP(c_nationkey / 10.0), 9) AS e, ROUND(LN(c_custkey), 9) AS l, CAST(FLOOR(c_acctbal) AS BIGINT) AS f, CAST(CEIL(c_acctbal) AS BIGINT) AS c FROM customer", "SELECT c_custkey, CAST(sign(c_acctbal) AS INTEGER) AS s, round(exp(c_nationkey / 10.0), 9) AS e, CASE WHEN c_custkey > 0 THEN round(ln(c_custkey), 9) END AS l, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c FROM customer"),
    "int_division": Query("SELECT o_orderkey, CAST(o_orderkey / 7 AS BIGINT) AS q, o_totalprice / 2 AS h FROM orders", "SELECT o_orderkey, CAST(o_orderkey // 7 AS BIGINT) AS q, o_totalprice / 2 AS h FROM orders"),
    "iif_total": Query("SELECT o_orderstatus, TOTAL(IIF(o_totalprice > 100000, 1, 0)) AS big FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS DOUBLE) AS big FROM orders GROUP BY o_orderstatus"),
    "date_month": Query("SELECT strftime('%Y-%m', o_orderdate) AS month, COUNT(*) AS n FROM orders GROUP BY month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n FROM orders GROUP BY 1"),
    "date_hour": Query("SELECT strftime('%H', ts) AS hour, COUNT(*) AS n, ROUND(AVG(value), 6) AS v FROM events GROUP BY strftime('%H', ts)", "SELECT strftime(ts, '%H') AS hour, COUNT(*) AS n, round(avg(value), 6) AS v FROM events GROUP BY 1"),
    "date_only": Query("SELECT DATE(ts) AS day, COUNT(DISTINCT user_id) AS users FROM events GROUP BY DATE(ts)", "SELECT strftime(ts, '%Y-%m-%d') AS day, COUNT(DISTINCT user_id) AS users FROM events GROUP BY 1"),
    "date_modifier": Query("SELECT o_orderkey, DATE(o_orderdate, 'start of month', '+1 month', '-1 day') AS last_day, CAST(strftime('%w', o_orderdate) AS INTEGER) AS dow FROM orders", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS last_day, CAST(strftime(o_orderdate, '%w') AS BIGINT) AS dow FROM orders"),
    "date_clock": Query("SELECT event_id, TIME(ts) AS t, DATETIME(ts) AS d, UNIXEPOCH(ts) AS u FROM events", "SELECT event_id, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS d, CAST(floor(epoch(ts)) AS BIGINT) AS u FROM events"),
    "date_range": Query("SELECT COUNT(*) AS n FROM orders WHERE DATE(o_orderdate) >= '1995-03-01' AND DATETIME(o_orderdate) < '1996-01-01 00:00:00'", "SELECT COUNT(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1995-03-01' AND strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') < '1996-01-01 00:00:00'"),
    "date_current": Query("SELECT COUNT(*) AS n FROM region WHERE CAST(CURRENT_DATE AS TEXT) > '2000-01-01' AND CAST(CURRENT_TIMESTAMP AS TEXT) > '2000-01-01' AND LENGTH(CURRENT_TIME) = 8 AND DATE('now') = DATE(CURRENT_TIMESTAMP)", "SELECT COUNT(*) AS n FROM region"),
    "julian_diff": Query("SELECT o_orderkey, ROUND(julianday(o_orderdate) - julianday('1995-01-01'), 4) AS days FROM orders", "SELECT o_orderkey, round(epoch(o_orderdate - TIMESTAMP '1995-01-01') / 86400, 4) AS days FROM orders"),
    "cast_roundtrip": Query("SELECT p_partkey, CAST(CAST(p_size AS TEXT) AS INTEGER) AS size, CAST(p_retailprice AS INTEGER) AS whole, CAST('12abc' AS INTEGER) AS lead, CAST(p_size AS REAL) AS real FROM part", "SELECT p_partkey, CAST(p_size AS BIGINT) AS size, CAST(trunc(p_retailprice) AS BIGINT) AS whole, CAST(12 AS BIGINT) AS lead, CAST(p_size AS DOUBLE) AS real FROM part"),
    "json_extract": Query("SELECT event_id, json_extract(props, '$.k') AS k, props ->> 'k' AS k2 FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS k2 FROM events"),
    "json_build": Query("SELECT n_nationkey, json_object('k', n_nationkey, 'n', n_name) AS o, CAST(json_array_length(json_array(n_nationkey, n_regionkey)) AS BIGINT) AS n FROM nation", "SELECT n_nationkey, CAST(json_object('k', n_nationkey, 'n', n_name) AS VARCHAR) AS o, CAST(2 AS BIGINT) AS n FROM nation"),
    "json_each": Query("SELECT e.event_id, j.key AS name, j.value AS shown FROM events e, json_each(e.props) AS j", "SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS shown FROM events"),
    # aggregation
    "agg_global": Query("SELECT COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS total, ROUND(AVG(l_quantity), 6) AS avg_q, MIN(l_shipdate) AS first, MAX(l_shipdate) AS last FROM lineitem"),
    "agg_multi_key": Query("SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS q, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_discount), 6) AS d, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "agg_distinct": Query("SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers, COUNT(o_orderkey) AS n FROM orders GROUP BY o_orderpriority"),
    "agg_conditional": Query("SELECT l_returnflag, CAST(SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS many, COUNT(*) FILTER (WHERE l_discount = 0) AS full_price FROM lineitem GROUP BY l_returnflag"),
    "agg_alias_having": Query("SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING n > 5 AND SUM(o_totalprice) > 100000", "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) > 5 AND SUM(o_totalprice) > 100000"),
    "agg_expression_key": Query("SELECT o_custkey % 10 AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10"),
    "agg_bare_column": Query("SELECT o_orderstatus, o_orderkey AS which, MAX(o_totalprice) AS top FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS which, MAX(o_totalprice) AS top FROM orders GROUP BY o_orderstatus"),
    "pct_of_total": Query("SELECT o_orderstatus, ROUND(SUM(o_totalprice) * 100.0 / (SELECT SUM(o_totalprice) FROM orders), 6) AS pct FROM orders GROUP BY o_orderstatus"),
    "group_concat": Query("SELECT n_regionkey, GROUP_CONCAT(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    # joins
    "join_inner": Query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'"),
    "join_4way": Query("SELECT r.r_name, n.n_name, COUNT(*) AS n, ROUND(SUM(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name"),
    "join_left": Query("SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey"),
    "join_left_theta": Query("SELECT a.s_suppkey, COUNT(b.s_suppkey) AS richer FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_acctbal > a.s_acctbal GROUP BY a.s_suppkey"),
    "join_left_const": Query("SELECT n.n_nationkey, r.r_name FROM nation n LEFT JOIN region r ON r.r_name = 'ASIA'"),
    "join_expr": Query("SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON LOWER(CAST(s.s_nationkey AS TEXT)) = REPLACE(CAST(n.n_nationkey AS TEXT), ' ', '')", "SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey"),
    "join_cross": Query("SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b"),
    "join_self_rank": Query("SELECT a.s_suppkey, CAST(COUNT(b.s_suppkey) + 1 AS BIGINT) AS rank FROM supplier a LEFT JOIN supplier b ON b.s_nationkey = a.s_nationkey AND (b.s_acctbal > a.s_acctbal OR (b.s_acctbal = a.s_acctbal AND b.s_suppkey < a.s_suppkey)) GROUP BY a.s_suppkey"),
    "join_full": Query("SELECT c.c_custkey, s.s_suppkey FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey + 5"),
    "join_right": Query("SELECT n.n_name, r.r_name FROM nation n RIGHT JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey > 20"),
    "join_using": Query("SELECT n_nationkey, a.n_name AS x FROM nation a JOIN nation b USING (n_nationkey)"),
    "join_natural": Query("SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) a NATURAL JOIN (SELECT r_name, r_regionkey AS k FROM region) b"),
    "join_rowid": Query(_rowid, "SELECT row_number() OVER () AS row_no, n_name FROM nation"),
    "semi_exists": Query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)"),
    "anti_not_exists": Query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)"),
    "in_subquery": Query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)"),
    "arguments": Query(_arguments, "SELECT c_custkey, c_name FROM customer WHERE (c_nationkey = 3 AND c_acctbal > 1000 AND c_name ILIKE 'customer%') OR (c_nationkey = 4 AND c_acctbal <= 0)"),
    "corr_scalar": Query("SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT AVG(x.o_totalprice) * 1.5 FROM orders x WHERE x.o_custkey = o.o_custkey)"),
    # windows
    "win_rank": Query("SELECT o_orderkey, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS BIGINT) AS d FROM orders"),
    "win_row_number": Query("SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS BIGINT) AS n FROM orders"),
    "win_avg_count": Query("SELECT o_orderkey, ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS a, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders"),
    "win_lag_lead": Query("SELECT o_orderkey, LAG(o_orderkey) OVER w AS before, LEAD(o_totalprice, 2, 0.0) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    "win_frame_rows": Query("SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders"),
    "win_frame_range": Query("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 100 FOLLOWING) AS n FROM orders"),
    "win_frame_groups": Query("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n, MAX(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC GROUPS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS m FROM orders"),
    "win_frame_exclude": Query("SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS n, MIN(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS m FROM orders"),
    "win_filter": Query("SELECT o_orderkey, COUNT(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS f FROM orders"),
    "win_ntile": Query("SELECT o_orderkey, CAST(NTILE(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS BIGINT) AS q, ROUND(PERCENT_RANK() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey), 9) AS p, ROUND(CUME_DIST() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey), 9) AS c FROM orders"),
    "win_first_last": Query("SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER w AS l, NTH_VALUE(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    # order, limit
    "topk": Query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "page_limit_offset": Query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30"),
    "limit_comma": Query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30, 15", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30"),
    "topk_per_group": Query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) t WHERE n <= 2"),
    "union_topk": Query("SELECT * FROM (SELECT o_orderkey, 'high' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) a UNION ALL SELECT * FROM (SELECT o_orderkey, 'low' AS side FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5) b"),
    # set operations and common table expressions
    "union_all": Query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name AS name FROM region"),
    "union_distinct": Query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier"),
    "intersect": Query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier"),
    "except": Query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders"),
    "distinct": Query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "cte_multi": Query("WITH spent AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM spent WHERE total > 200000) SELECT c.c_name, ROUND(t.total, 2) AS total FROM top t JOIN customer c ON c.c_custkey = t.o_custkey"),
    "cte_recursive": Query("WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 20) SELECT n, f FROM t"),
    "cte_recursive_union": Query("WITH RECURSIVE t(n) AS (SELECT 1 UNION SELECT (n * 3) % 17 FROM t) SELECT n FROM t"),
    # changes
    "dml_update": Query(_changed("UPDATE customer SET c_acctbal = c_acctbal + 100, c_mktsegment = 'X' WHERE c_nationkey = 3 OR c_acctbal < 0", result="SELECT c_custkey, c_acctbal, c_mktsegment FROM customer"), "SELECT c_custkey, CASE WHEN c_nationkey = 3 OR c_acctbal < 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 OR c_acctbal < 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "dml_update_subquery": Query(_changed("UPDATE nation SET n_name = 'none' WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)", result="SELECT n_nationkey, n_name FROM nation"), "SELECT n_nationkey, CASE WHEN n_nationkey NOT IN (SELECT s_nationkey FROM supplier) THEN 'none' ELSE n_name END AS n_name FROM nation"),
    "dml_update_from": Query(
        _changed("UPDATE nation AS n SET (n_name, n_regionkey) = (r.r_name || '/' || n.n_name, 9) FROM region r JOIN (SELECT DISTINCT s_nationkey FROM supplier) s WHERE r.r_regionkey = n.n_regionkey AND s.s_nationkey = n.n_nationkey", result="SELECT n_nationkey, n_name, n_regionkey FROM nation"),
        "SELECT n_nationkey, CASE WHEN s.k IS NULL THEN n_name ELSE r_name || '/' || n_name END AS n_name, CASE WHEN s.k IS NULL THEN n_regionkey ELSE 9 END AS n_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) s ON s.k = n_nationkey",
    ),
    "dml_insert_select": Query(_changed("CREATE TABLE totals (segment TEXT, n INTEGER, total REAL)", "INSERT INTO totals SELECT c_mktsegment, COUNT(*), ROUND(SUM(c_acctbal), 2) FROM customer GROUP BY c_mktsegment", "INSERT INTO totals (segment, n) VALUES ('none', 0), ('all', 1)", result="SELECT segment, n, total FROM totals"), "SELECT c_mktsegment AS segment, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS total FROM customer GROUP BY 1 UNION ALL SELECT 'none', 0, NULL UNION ALL SELECT 'all', 1, NULL"),
    "dml_insert_or_replace": Query(
        _changed("CREATE TABLE best (c INTEGER PRIMARY KEY, total REAL NOT NULL)", "INSERT INTO best SELECT o_custkey, MIN(o_totalprice) FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey", "INSERT OR REPLACE INTO best SELECT o_custkey, MAX(o_totalprice) FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey", "INSERT OR IGNORE INTO best SELECT o_custkey, 0.0 FROM orders", result="SELECT c, total FROM best"),
        "SELECT o_custkey AS c, CASE WHEN o_custkey % 3 = 0 THEN MAX(o_totalprice) WHEN o_custkey % 2 = 0 THEN MIN(o_totalprice) ELSE 0.0 END AS total FROM orders GROUP BY o_custkey",
    ),
    "dml_savepoint": Query(
        _changed("BEGIN", "UPDATE nation SET n_regionkey = 9 WHERE n_nationkey < 5", "SAVEPOINT one", "DELETE FROM nation", "ROLLBACK TO one", "UPDATE nation SET n_name = 'x' WHERE n_nationkey = 0", "RELEASE one", "COMMIT", result="SELECT n_nationkey, n_name, n_regionkey FROM nation"),
        "SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 'x' ELSE n_name END AS n_name, CASE WHEN n_nationkey < 5 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation",
    ),
    "dml_delete": Query(_changed("DELETE FROM orders WHERE o_totalprice < 50000 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)", result="SELECT o_orderkey FROM orders"), "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 50000 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5))"),
    "dml_rollback": Query(_rolled_back, "SELECT COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS total FROM customer"),
    "view_follows_table": Query(_changed("CREATE VIEW rich AS SELECT c_custkey FROM customer WHERE c_acctbal > 5000", "DELETE FROM customer WHERE c_custkey % 2 = 0", result="SELECT c_custkey FROM rich"), "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_custkey % 2 <> 0"),
    # catalog
    "sqlite_master": Query(_sqlite_master, "SELECT * FROM (VALUES ('nation'), ('region')) AS t(name)"),
    "table_info": Query(_table_info, "SELECT CAST(cid AS BIGINT) AS cid, name, type FROM (VALUES (0, 'n_nationkey', 'INTEGER'), (1, 'n_name', 'TEXT'), (2, 'n_regionkey', 'INTEGER')) AS t(cid, name, type)"),
    # files
    "csv_roundtrip": Query(_round_trip("supplier", DumpOptions()), "SELECT * FROM supplier"),
    "tsv_roundtrip": Query(_round_trip("customer", DumpOptions().with_format("tsv")), "SELECT * FROM customer"),
    "ltsv_roundtrip": Query(_round_trip("nation", DumpOptions().with_format("ltsv")), "SELECT * FROM nation"),
    "xlsx_roundtrip": Query(_round_trip("supplier", DumpOptions().with_format("xlsx")), "SELECT * FROM supplier"),
    "parquet_roundtrip": Query(_round_trip("part", DumpOptions().with_format("parquet")), "SELECT * FROM part"),
    "csv_gz_roundtrip": Query(_round_trip("part", DumpOptions().with_compression("gzip")), "SELECT * FROM part"),
    "csv_zst_roundtrip": Query(_round_trip("part", DumpOptions().with_compression("zstd")), "SELECT * FROM part"),
    "csv_xz_roundtrip": Query(_round_trip("part", DumpOptions().with_compression("xz")), "SELECT * FROM part"),
    "folder_joined": Query(_folder_joined, FOLDER_JOINED),
    "stream_and_archive": Query(_streams, "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey"),
    "header_only": Query(_header_only, "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ids, CAST(0 AS BIGINT) AS names"),
    "parquet_as_text": Query(_parquet_as_text, "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_brand FROM part WHERE p_size = 7"),
    "dump_tables": Query(_dumped, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey <> 2"),
    "autosave_on_close": Query(_autosaved(False), SAVED),
    "autosave_on_commit": Query(_autosaved(True), SAVED),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle or q.sql for name, q in QUERIES.items() if q.oracle or isinstance(q.sql, str)}
