"""Queries, the dialect, changes, transactions, saving, catalog and streams."""

import gzip
import lzma
import os
import sqlite3

import pytest
import zstandard

import tessera
from tessera.errors import DuplicateTableError, EmptyDataError, NoTablesError, SqlError, TesseraError, UnsupportedFormatError
from tessera.operators.sinks import DumpOptions
from tessera.plans.lexer import statements, tokenize
from tessera.plans.rewrite import rewrite

EMPLOYEES = """id,name,department_id,salary,hire_date
1,Mira Okonkwo,1,91200,2018-03-05
2,Tomas Lindqvist,1,83500,2020-07-19
3,Agnes Pereira,2,77250,2022-05-02
4,Jun Watanabe,1,70400,2017-11-23
5,Ama Boateng,2,68900,2022-09-30
6,Lev Sokolov,3,64100,2019-01-08
7,Nadia Haddad,3,58750,2021-06-14
8,Pia Moreau,2,52300,2016-02-29
"""
DEPARTMENTS = "id,name,budget,manager_id\n1,Hydrology,910000,4\n2,Cartography,640000,3\n3,Archive,575000,6\n4,Outreach,310000,9\n"


@pytest.fixture
def db(spark, files):
    return tessera.open(*files(employees__csv=EMPLOYEES, departments__csv=DEPARTMENTS), spark=spark)


def rows(db, text, args=None):
    return [tuple(r) for r in db.sql(text, args).collect()]


def test_update_from_against_sqlite(spark, files):
    told = {"stock": [(1, "a", 5), (2, "b", 6), (3, "c", None)], "moves": [(1, 10), (1, 12), (3, 7)]}
    lite = sqlite3.connect(":memory:")
    lite.execute("CREATE TABLE stock (id INTEGER, name TEXT, n INTEGER)")
    lite.execute("CREATE TABLE moves (id INTEGER, n INTEGER)")
    lite.executemany("INSERT INTO stock VALUES (?, ?, ?)", told["stock"])
    lite.executemany("INSERT INTO moves VALUES (?, ?)", told["moves"])
    text = lambda rows, head: head + "\n" + "".join(",".join("" if v is None else str(v) for v in r) + "\n" for r in rows)
    paths = files(stock__csv=text(told["stock"], "id,name,n"), moves__csv=text(told["moves"], "id,n"))
    with tessera.open(*paths, spark=spark) as db:
        for change, args in [
            ("UPDATE stock SET n = s.total, name = name || ? FROM (SELECT id, SUM(n) AS total FROM moves GROUP BY id) AS s WHERE s.id = stock.id AND s.total > ?", ["!", 7]),
            ("UPDATE stock AS t SET (n, name) = (o.n + 1, o.name) FROM stock AS o WHERE o.id = t.id + 1 AND o.n IS NOT NULL", None),
            ("UPDATE stock SET (n, name) = (n * 2, 'z') WHERE id IN (SELECT id FROM moves)", None),
        ]:
            lite.execute(change, args or [])
            db.sql(change, args)
            assert sorted(rows(db, "SELECT * FROM stock")) == sorted(lite.execute("SELECT * FROM stock").fetchall())
        for bad in ("UPDATE stock SET (n, name) = (1)", "UPDATE stock SET (n, name) = (SELECT 1, 2)"):
            with pytest.raises(tessera.SqlError):
                db.sql(bad)
        kinds = rows(db, "SELECT typeof(CURRENT_DATE), LENGTH(CURRENT_DATE), LENGTH(CURRENT_TIME), LENGTH(CURRENT_TIMESTAMP)")
        assert kinds == lite.execute("SELECT typeof(CURRENT_DATE), LENGTH(CURRENT_DATE), LENGTH(CURRENT_TIME), LENGTH(CURRENT_TIMESTAMP)").fetchall()


def test_report_of_ranked_employees(db):
    found = rows(
        db,
        """SELECT e.name, d.name AS department, e.salary,
                  RANK() OVER (PARTITION BY e.department_id ORDER BY e.salary DESC) AS r,
                  COUNT(*) OVER (PARTITION BY e.department_id) AS n,
                  CASE WHEN e.salary > (SELECT AVG(salary) FROM employees WHERE department_id = e.department_id) * 1.2 THEN 'High Performer'
                       WHEN e.salary < (SELECT AVG(salary) FROM employees WHERE department_id = e.department_id) * 0.8 THEN 'Below Average'
                       ELSE 'Average' END AS category
           FROM employees e JOIN departments d ON e.department_id = d.id
           WHERE e.salary > (SELECT AVG(salary) * 0.7 FROM employees e2 WHERE e2.department_id = e.department_id) AND d.budget > 500000
           ORDER BY d.name, e.salary DESC LIMIT 10""",
    )
    assert found[:3] == [("Lev Sokolov", "Archive", 64100, 1, 2, "Average"), ("Nadia Haddad", "Archive", 58750, 2, 2, "Average"), ("Agnes Pereira", "Cartography", 77250, 1, 3, "Average")]
    assert [r[0] for r in found[4:]] == ["Pia Moreau", "Mira Okonkwo", "Tomas Lindqvist", "Jun Watanabe"] and found[4][5] == "Below Average"


COMPANY = {
    "user__csv": "id,name,age,department_id\n1,User_1,36.0,2\n2,User_2,,1\n3,User_3,51,2\n4,User_4,29,\n",
    "department__tsv": "id\tname\tlocation\n1\tDepartment_1\t\n2\tDepartment_2\tTokyo\n3\tDepartment_3\tOsaka\n",
    "salary__ltsv": "user_id:1\tbase:500\tbonus:25.5\nuser_id:2\tbase:300\nuser_id:3\tbase:700\tbonus:0\n",
}


def test_tables_of_several_formats(spark, files):
    db = tessera.open(*files(**COMPANY), spark=spark)
    assert rows(db, "SELECT u.name, u.age, d.location, s.base + s.bonus FROM user u JOIN department d ON u.department_id = d.id JOIN salary s ON s.user_id = u.id WHERE s.bonus IS NOT NULL AND s.bonus != '' ORDER BY u.id") == [("User_1", 36.0, "Tokyo", 525.5), ("User_3", 51.0, "Tokyo", 700.0)]
    assert rows(db, "SELECT d.name, COUNT(u.id) AS n FROM department d LEFT JOIN user u ON u.department_id = d.id GROUP BY d.id, d.name HAVING n < 2 ORDER BY 1") == [("Department_1", 1), ("Department_3", 0)]
    assert rows(db, "SELECT name FROM department d WHERE NOT EXISTS (SELECT 1 FROM user u WHERE u.department_id = d.id)") == [("Department_3",)]
    assert rows(db, "SELECT COUNT(*) FROM user WHERE age IS NOT NULL AND age != ''") == [(3,)]
    assert rows(db, "SELECT (SELECT COUNT(*) FROM department WHERE location = '') + COUNT(*) FROM user WHERE department_id = ''") == [(2,)]


# Queries whose results must be those of the embedded database itself.
SAME = [
    "SELECT 7/2, -7/2, 7/2.0, 7%3, 1/0",
    "SELECT name FROM employees WHERE name LIKE 'a%' ORDER BY name",
    "SELECT name FROM employees WHERE name GLOB 'A*' ORDER BY name",
    "SELECT CAST('12abc' AS INTEGER), CAST('abc' AS INTEGER), CAST('' AS REAL), CAST('-3.9' AS INTEGER), CAST(3.9 AS INTEGER), CAST(' 5 ' AS INTEGER), CAST(12 AS TEXT)",
    "SELECT substr('hello', 0, 3), substr('hello', 2), substr('hello', -3, 2), substr('hello', 4, -2), substr('hello', 2, 3)",
    "SELECT max(1, NULL), max(3, 7, 5), min(2, 1), coalesce(NULL, 4), ifnull(NULL, 'x'), nullif(1, 1), iif(1 > 2, 'a', 'b')",
    "SELECT strftime('%Y-%m', hire_date) AS m, COUNT(*) FROM employees GROUP BY m ORDER BY m",
    "SELECT date(hire_date, '+1 month'), date('2024-01-31', '+1 month'), date('2024-05-15', 'start of month', '-1 day'), date('nonsense') FROM employees ORDER BY id LIMIT 1",
    "SELECT strftime('%H:%M:%S %j %w %s %%', '2024-03-05 06:07:08'), time('06:07'), datetime('2024-03-05T06:07:08'), date(0, 'unixepoch'), strftime('%d/%m', '2024-03-05')",
    "SELECT julianday('2024-03-05 12:00:00') - julianday('2024-03-01'), julianday('2000-01-01')",
    "SELECT date('2024-03-05', 'weekday 0'), datetime('2024-03-05 10:00:00', '+90 minutes', '-1 year')",
    "SELECT upper('abc') || lower('DEF') || length('xyz') || replace('aXa', 'X', '-') || instr('hello', 'l') || trim('  t ') || ltrim('xxa', 'x') || rtrim('axx', 'x')",
    "SELECT round(2.5), round(-2.5), round(1.005, 2), abs(-3), log(100), total(salary), round(avg(salary), 2) FROM employees",
    "SELECT department_id, name, MAX(salary) FROM employees GROUP BY department_id ORDER BY department_id",
    "SELECT department_id, COUNT(*) AS n FROM employees GROUP BY 1 HAVING n > 2 ORDER BY 1",
    "SELECT group_concat(name, '; ') FROM (SELECT name FROM employees WHERE id = 2)",
    "SELECT [id], \"name\", `salary` FROM [employees] WHERE id = 1",
    "SELECT \"no column\" FROM employees WHERE id = 1",
    "SELECT 'it''s', 'back\\slash', x'4142' IS NOT NULL",
    "SELECT id FROM employees ORDER BY salary DESC LIMIT 2, 3",
    "SELECT id FROM employees ORDER BY id LIMIT 2 OFFSET 5",
    "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 120) SELECT SUM(n), COUNT(*) FROM c",
    "WITH RECURSIVE c(n) AS (SELECT 1 UNION SELECT (n * 2) % 11 FROM c) SELECT n FROM c ORDER BY n",
    "SELECT id FROM employees WHERE department_id IN (SELECT id FROM departments WHERE budget < 700000) ORDER BY id",
    "SELECT d.name, COUNT(e.id) FROM departments d LEFT JOIN employees e ON e.department_id = d.id AND e.salary > 60000 GROUP BY d.id, d.name ORDER BY d.name",
    "SELECT name FROM departments UNION SELECT 'Outreach' EXCEPT SELECT 'Archive' ORDER BY 1",
    "SELECT typeof(1), typeof(1.5), typeof('x'), typeof(NULL)",
    "SELECT json_extract('{\"a\": {\"b\": 3}}', '$.a.b') || '', '{\"a\": \"x\"}' ->> 'a', json_array_length('[1, 2, 3]')",
    "SELECT 5 & 3, 5 | 3, ~5, 1 << 4, 32 >> 2",
    "SELECT id FROM employees WHERE name NOT LIKE '%e%' OR hire_date BETWEEN '2022-01-01' AND '2022-12-31' ORDER BY id",
    "SELECT id, LAG(id) OVER (ORDER BY id), SUM(salary) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM employees ORDER BY id",
    "SELECT COUNT(*) FILTER (WHERE salary > 70000) FROM employees",
    "SELECT rowid, name FROM departments ORDER BY rowid",
    "SELECT hex('AB'), char(72, 105), char(28450, 8364), printf('%d-%s', 5, 'x')",
    "SELECT 'a\\b' LIKE 'A\\B', 'a\\b' LIKE 'a%', 'ä' LIKE 'Ä', 'xä' LIKE 'Xä', 'x' || 'ä' NOT LIKE 'Xä', '50%' LIKE '50!%' ESCAPE '!'",
    "SELECT lower('ÄB'), upper('éb'), iif(0, 'a', 'b'), iif(2, 'a', 'b')",
    "SELECT d.id FROM departments d LEFT JOIN employees e ON e.department_id = d.id AND e.salary > 90000 WHERE e.name = ''",
    "SELECT d.id FROM departments d LEFT JOIN employees e ON e.department_id = d.id AND e.salary > 90000 WHERE '' = e.name OR e.name IN ('', 'Mira Okonkwo')",
    "SELECT id FROM employees WHERE salary ISNULL OR salary NOTNULL ORDER BY id LIMIT 1",
    "SELECT id FROM employees WHERE name = 'tomas LINDQVIST' COLLATE NOCASE",
    "SELECT id IS 1, id IS NOT 1 FROM employees WHERE id < 3 ORDER BY id",
]


def embedded():
    con = sqlite3.connect(":memory:")
    for name, text in (("employees", EMPLOYEES), ("departments", DEPARTMENTS)):
        head, *lines = text.strip().splitlines()
        types = {"id": "INTEGER", "department_id": "INTEGER", "salary": "INTEGER", "budget": "INTEGER", "manager_id": "INTEGER"}
        con.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {types.get(c, 'TEXT')}' for c in head.split(','))})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(head.split(',')))})", [line.split(",") for line in lines])
    return con


@pytest.mark.parametrize("query", SAME)
def test_results_are_those_of_the_dialect(db, query):
    if sqlite3.sqlite_version_info < (3, 38) and "->>" in query:
        pytest.skip("this library has no arrow operators")
    want = embedded().execute(query).fetchall()
    got = rows(db, query)

    def plain(v):
        if isinstance(v, bool):
            return int(v)
        if isinstance(v, (bytes, bytearray)):
            return bytes(v).decode()
        return pytest.approx(float(v), abs=1e-9) if isinstance(v, (int, float)) else v

    assert [[plain(v) for v in r] for r in got] == [[plain(v) for v in r] for r in want]


def test_arguments(db):
    assert rows(db, "SELECT id FROM employees WHERE salary > ? AND name LIKE ? ORDER BY id", [60000, "%E%"])[0] == (3,)
    assert rows(db, "SELECT id FROM employees WHERE id = ?2 OR id = ?1 ORDER BY id", [3, 1]) == [(1,), (3,)]
    assert rows(db, "SELECT id FROM employees WHERE name = :name", {"name": "Ama Boateng"}) == [(5,)]
    assert rows(db, "SELECT id FROM employees WHERE name = ?", ["x' OR '1'='1"]) == []
    by_id = db.prepare("SELECT name FROM employees WHERE id = ?")
    assert by_id(2).first()[0] == "Tomas Lindqvist"


def test_empty_strings_in_columns_of_numbers(spark, files):
    db = tessera.open(files(u__csv="id,age\n1,36\n2,\n3,5\n"), spark=spark)
    assert rows(db, "SELECT COUNT(*), AVG(age) FROM u WHERE age IS NOT NULL AND age != ''") == [(2, 20.5)]
    assert rows(db, "SELECT id FROM u WHERE age = ''") == [(2,)]


def test_division_of_decimals_as_an_option(spark, files):
    db = tessera.Builder(spark).add_path(files(a__csv="x\n7\n")).with_integer_division(False).build().open()
    assert rows(db, "SELECT x / 2 FROM a") == [(3.5,)]


def test_reserved_words_as_names(spark, tmp_path):
    (tmp_path / "select.csv").write_text("from,where\n1,2\n")
    assert rows(tessera.open(str(tmp_path / "select.csv"), spark=spark), "SELECT [from] + [where] FROM [select]") == [(3,)]


def test_tokens():
    assert [t.kind for t in tokenize("SELECT [a], 'b''c' -- x\n/* y */ FROM t")] == ["word", "name", "sign", "text", "word", "word"]
    assert len(statements("SELECT ';'; SELECT 2;")) == 2
    assert "ILIKE" in rewrite("SELECT a FROM t WHERE a LIKE 'x'")
    with pytest.raises(SqlError):
        tokenize("SELECT 'open")


def test_changes(db):
    db.sql("INSERT INTO employees VALUES (9, 'Ivy', 2, 50000, '2023-01-01'), (10, 'Jo', NULL, NULL, NULL)")
    db.sql("INSERT INTO employees (id, name) SELECT id + 100, name FROM departments WHERE id < 3")
    assert rows(db, "SELECT COUNT(*) FROM employees") == [(12,)]
    db.sql("UPDATE employees SET salary = salary * 2, name = name || '!' WHERE id = 9")
    assert rows(db, "SELECT name, salary FROM employees WHERE id = 9") == [("Ivy!", 100000)]
    db.sql("UPDATE employees SET name = ?, salary = ? WHERE id = ?", ["New", 7, 10])
    assert rows(db, "SELECT name, salary FROM employees WHERE id = 10") == [("New", 7)]
    db.sql("DELETE FROM employees WHERE id > 100 OR salary IN (SELECT MIN(salary) FROM employees)")
    assert rows(db, "SELECT MAX(id) FROM employees") == [(9,)]
    db.sql("UPDATE employees SET salary = 1 WHERE EXISTS (SELECT 1 FROM departments d WHERE d.id = employees.department_id AND d.name = 'Archive')")
    assert rows(db, "SELECT COUNT(*) FROM employees WHERE salary = 1") == [(2,)]
    db.sql("DELETE FROM employees")
    assert rows(db, "SELECT COUNT(*) FROM employees") == [(0,)]


def test_many_changes_keep_plans_short(db):
    for i in range(25):
        db.sql(f"INSERT INTO departments VALUES ({10 + i}, 'd', 1, 1)")
    assert rows(db, "SELECT COUNT(*) FROM departments") == [(29,)]
    assert db.table("departments")._jdf.queryExecution().logical().toString().count("Union") < 10


def test_definitions(db):
    db.sql("CREATE TABLE notes (id INTEGER PRIMARY KEY, body TEXT NOT NULL DEFAULT 'none', score REAL, UNIQUE (id))")
    db.sql("INSERT INTO notes (id) VALUES (1)")
    assert rows(db, "SELECT id, body, score FROM notes") == [(1, "none", None)]
    with pytest.raises(DuplicateTableError):
        db.sql("CREATE TABLE notes (x TEXT)")
    db.sql("CREATE TABLE IF NOT EXISTS notes (x TEXT); CREATE INDEX i ON notes (id)")
    db.sql("CREATE TABLE copy AS SELECT * FROM notes; ALTER TABLE copy ADD COLUMN more INTEGER DEFAULT 3; ALTER TABLE copy RENAME COLUMN body TO text; ALTER TABLE copy DROP COLUMN score; ALTER TABLE copy RENAME TO kept")
    assert db.table("kept").columns == ["id", "text", "more"]
    db.sql("CREATE VIEW v AS SELECT id FROM notes; INSERT INTO notes (id) VALUES (2)")
    assert rows(db, "SELECT COUNT(*) FROM v") == [(2,)]
    db.sql("DROP VIEW v; DROP TABLE IF EXISTS nothing; DROP TABLE kept")
    with pytest.raises(SqlError):
        db.sql("SELECT * FROM kept")
    with pytest.raises(SqlError):
        db.sql("CREATE TRIGGER t AFTER INSERT ON notes BEGIN SELECT 1; END")


def test_catalog(db):
    assert rows(db, "SELECT name FROM sqlite_master WHERE type='table' AND name NOT LIKE 'sqlite_%' ORDER BY name") == [("departments",), ("employees",)]
    assert rows(db, "SELECT COUNT(*) FROM sqlite_master WHERE name = ?", ["employees"]) == [(1,)]
    assert [r[:3] for r in rows(db, "PRAGMA table_info(departments)")] == [(0, "id", "INTEGER"), (1, "name", "TEXT"), (2, "budget", "INTEGER"), (3, "manager_id", "INTEGER")]


def test_transactions(db):
    with pytest.raises(RuntimeError), db.transaction():
        db.sql("DELETE FROM employees; CREATE TABLE x (a TEXT)")
        raise RuntimeError
    assert rows(db, "SELECT COUNT(*) FROM employees") == [(8,)] and db.tables == ["employees", "departments"]
    db.sql("BEGIN; DELETE FROM employees WHERE id = 1; COMMIT")
    db.sql("BEGIN; DELETE FROM employees; ROLLBACK")
    assert rows(db, "SELECT COUNT(*) FROM employees") == [(7,)]
    with pytest.raises(SqlError):
        db.sql("COMMIT")


def test_constraints_and_conflicts_are_those_of_the_dialect(spark, files):
    db = tessera.open(files(other__csv="a,b\n1,x\n"), spark=spark)
    con = sqlite3.connect(":memory:")
    both = lambda text: (db.sql(text), con.execute(text))
    same = lambda table: sorted(rows(db, f"SELECT * FROM {table}"), key=str) == sorted(con.execute(f"SELECT * FROM {table}").fetchall(), key=str)
    both("CREATE TABLE k (id INTEGER PRIMARY KEY, v TEXT NOT NULL, w INTEGER CHECK (w > 0), UNIQUE (v, w))")
    both("INSERT INTO k VALUES (1, 'a', 1), (2, 'b', NULL)")
    both("INSERT OR REPLACE INTO k VALUES (1, 'c', 5), (3, 'd', 6), (3, 'e', 7)")
    both("INSERT OR IGNORE INTO k VALUES (1, 'z', 1), (4, NULL, 1), (5, 'f', -1), (6, 'g', 8), (6, 'h', 9)")
    both("REPLACE INTO k VALUES (9, 'e', 7)")
    both("INSERT INTO k (v) VALUES ('auto'), ('more')")
    assert same("k")
    for bad, what in (("INSERT INTO k VALUES (1, 'q', 1)", "UNIQUE of id"), ("INSERT INTO k VALUES (70, NULL, 1)", "NOT NULL of v"), ("INSERT INTO k VALUES (71, 'q', -5)", "CHECK"), ("INSERT INTO k VALUES (72, 'q', 1), (72, 'r', 1)", "UNIQUE"), ("UPDATE k SET id = 1", "UNIQUE"), ("UPDATE k SET v = NULL WHERE id = 1", "NOT NULL"), ("UPDATE k SET w = -w", "CHECK")):
        with pytest.raises(SqlError, match=what):
            db.sql(bad)
        with pytest.raises(sqlite3.IntegrityError):
            con.execute(bad)
    assert same("k")


def test_savepoints(db):
    db.sql("SAVEPOINT a; DELETE FROM employees WHERE id = 1; SAVEPOINT b; DELETE FROM employees; ROLLBACK TO b")
    assert rows(db, "SELECT COUNT(*) FROM employees") == [(7,)]
    db.sql("DELETE FROM employees WHERE id = 2; RELEASE SAVEPOINT b; RELEASE a")
    assert rows(db, "SELECT COUNT(*) FROM employees") == [(6,)]
    with pytest.raises(SqlError, match="no such savepoint"):
        db.sql("ROLLBACK TO SAVEPOINT b")
    with pytest.raises(SqlError, match="no transaction"):
        db.sql("COMMIT")


def test_errors_name_what_is_wrong(db):
    with pytest.raises(SqlError, match="nowhere"):
        db.sql("SELECT * FROM nowhere")
    for text, what in (("SELEC 1", "SELEC"), ("SELECT 1 2 3", "(?i)syntax"), ("SELECT nothing FROM employees", "nothing"), ("SELECT SUM(id) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) FROM employees", "EXCLUDE"), ("UPDATE OR REPLACE employees SET id = 1", "UPDATE OR REPLACE")):
        with pytest.raises(SqlError, match=what):
            db.sql(text)
    with pytest.raises(SqlError, match="no such table"):
        db.sql("INSERT INTO nowhere VALUES (1)")
    db.close()
    with pytest.raises(TesseraError, match="closed"):
        db.sql("SELECT 1")


@pytest.mark.parametrize("format", ["csv", "tsv", "ltsv", "parquet", "xlsx"])
def test_dumps_read_back(spark, db, tmp_path, format):
    out = str(tmp_path / "out")
    paths = db.dump(out, DumpOptions().with_format(format))
    assert sorted(os.path.basename(p) for p in paths) == [f"departments.{format}", f"employees.{format}"]
    back = tessera.open(out, spark=spark)
    name = "employees" if format != "xlsx" else "employees_employees"
    assert rows(back, f"SELECT * FROM {name} ORDER BY id") == rows(db, "SELECT * FROM employees ORDER BY id")


@pytest.mark.parametrize(("codec", "unpack"), [("gzip", gzip.decompress), ("xz", lzma.decompress), ("zstd", lambda b: zstandard.ZstdDecompressor().stream_reader(b).read())])
def test_compressed_dumps(db, tmp_path, codec, unpack):
    path = next(p for p in db.dump(str(tmp_path), DumpOptions().with_compression(codec)) if "departments" in p)
    with open(path, "rb") as f:
        assert unpack(f.read()).decode() == DEPARTMENTS


def test_texts_of_values(spark, tmp_path):
    from tessera.operators.sinks import write_file

    df = spark.sql("SELECT * FROM VALUES (1.0D, 25.5D, CAST(NULL AS STRING), true), (1.0E7D, 1.5E-5D, 'a,\"b\"', false), (-0.25D, 123456789.125D, 'x\ny', NULL) AS t(a, b, s, f)").coalesce(1)
    write_file(df, str(tmp_path / "t.csv"), DumpOptions())
    assert (tmp_path / "t.csv").read_text() == 'a,b,s,f\n1,25.5,,1\n10000000,0.000015,"a,""b""",0\n-0.25,123456789.125,"x\ny",\n'


def test_floats_with_exponents_as_an_option(spark, tmp_path):
    from tessera.operators.sinks import write_file

    values = [1000000.0, 123456.0, 0.00012, 0.000012, 12.5, 0.0, -1234567.5, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    write_file(df, str(tmp_path / "t.csv"), DumpOptions(go_floats=True))
    assert (tmp_path / "t.csv").read_text().split()[1:] == ["1e+06", "123456", "0.00012", "1.2e-05", "12.5", "0", "-1.2345675e+06", "1e+300"]


def test_refused_dumps(spark, db, tmp_path):
    with pytest.raises(UnsupportedFormatError, match="bzip2"):
        db.dump(str(tmp_path), DumpOptions().with_compression("bzip2"))
    with pytest.raises(UnsupportedFormatError):
        db.dump(str(tmp_path), DumpOptions().with_format("parquet").with_compression("gzip"))
    db.sql("DELETE FROM employees")
    with pytest.raises(EmptyDataError):
        db.dump(str(tmp_path), DumpOptions().with_format("parquet"))
    db.sql("DROP TABLE employees; DROP TABLE departments")
    with pytest.raises(NoTablesError):
        db.dump(str(tmp_path))


def test_saving_on_close_and_over_the_source(spark, tmp_path):
    source = tmp_path / "a.csv"
    source.write_text("x\n1\n2\n")
    with tessera.Builder(spark).add_path(str(source)).enable_auto_save(str(tmp_path / "saved")).build().open() as db:
        db.sql("DELETE FROM a WHERE x = 1")
    assert (tmp_path / "saved" / "a.csv").read_text() == "x\n2\n" and source.read_text() == "x\n1\n2\n"
    with tessera.Builder(spark).add_path(str(source)).enable_auto_save().build().open() as db:
        db.sql("UPDATE a SET x = x + 10")
    assert sorted(source.read_text().split()) == ["11", "12", "x"]
    with tessera.Builder(spark).add_path(str(source)).enable_auto_save(str(tmp_path / "no")).disable_auto_save().build().open() as db:
        db.sql("DELETE FROM a")
    assert not (tmp_path / "no").exists()


def test_saving_on_commit(spark, tmp_path):
    source = tmp_path / "a.csv"
    source.write_text("x\n1\n")
    db = tessera.Builder(spark).add_path(str(source)).enable_auto_save_on_commit(str(tmp_path / "c"), DumpOptions().with_format("tsv")).build().open()
    with db.transaction():
        db.sql("INSERT INTO a VALUES (2)")
        assert not (tmp_path / "c").exists()
    assert sorted((tmp_path / "c" / "a.tsv").read_text().split()) == ["1", "2", "x"]


def test_files_stay_as_they_are(spark, files):
    path = files(a__csv="x\n1\n")
    db = tessera.open(path, spark=spark)
    db.sql("UPDATE a SET x = 5")
    assert rows(db, "SELECT x FROM a") == [(5,)] and open(path).read() == "x\n1\n"


def test_sessions_do_not_see_each_other(spark, files):
    a, b = tessera.open(files(a__csv="x\n1\n"), spark=spark), tessera.open(files(b__csv="x\n2\n"), spark=spark)
    with pytest.raises(SqlError):
        a.sql("SELECT * FROM b")
    assert rows(b, "SELECT x FROM b") == [(2,)]


def test_windows_over_a_stream(spark, tmp_path):
    from tessera.streaming.watch import watch, windowed

    (tmp_path / "a.csv").write_text("ts,kind\n2024-01-01 00:01:00,x\n2024-01-01 00:07:00,x\n2024-01-01 00:02:00,y\n")
    stream = watch(spark, str(tmp_path), "ts timestamp, kind string", tessera.Format.CSV)
    query = windowed(stream, "ts", "5 minutes", "10 minutes", "kind").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    found = {(str(r["window_start"])[11:16], r["kind"], r["n"]) for r in spark.table("counts").collect()}
    assert found == {("00:00", "x", 1), ("00:05", "x", 1), ("00:00", "y", 1)}


def test_jobs_can_be_limited_and_cancelled(spark, db):
    slow = "SELECT COUNT(*) FROM (SELECT a.id FROM employees a, employees b, employees c, employees d, employees e, employees f, employees g, employees h, employees i, employees j, employees k WHERE a.id + b.id + c.id + d.id + e.id + f.id + g.id + h.id + i.id + j.id + k.id = 7)"
    with pytest.raises(Exception, match="cancelled"), db.limit(1.0):
        db.sql(slow).collect()
    with db.limit(60):
        assert rows(db, "SELECT COUNT(*) FROM employees") == [(8,)]


def test_json_rows(spark, files):
    db = tessera.open(files(j__csv='id,tags\n1,"[""a"",""b""]"\n2,"{""k"": 5}"\n'), spark=spark)
    assert rows(db, "SELECT j.id, e.key, e.value FROM j, json_each(j.tags) AS e ORDER BY j.id, e.key") == [(1, "0", "a"), (1, "1", "b"), (2, "k", "5")]
    assert rows(db, "SELECT json_object('a', 1, 'b', NULL), json_array(1, 2), json_valid('[1]'), json_valid('[')") == [('{"a":1,"b":null}', "[1,2]", 1, 0)]
