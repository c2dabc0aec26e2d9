"""Window frames of GROUPS and EXCLUDE against the embedded database."""

import itertools
import sqlite3

import pytest

import tessera
from tessera.errors import SqlError

# Ties of the order, nulls in the value, a group of one row.
ROWS = [(i, "abb"[i % 3] if i != 11 else "c", i * 7 % 5, None if i % 6 == 5 else (i * 13 % 11) - 4) for i in range(24)]
BOUNDS = ["UNBOUNDED PRECEDING AND CURRENT ROW", "1 PRECEDING AND 1 FOLLOWING", "2 PRECEDING AND 1 PRECEDING", "CURRENT ROW AND UNBOUNDED FOLLOWING", "1 FOLLOWING AND 2 FOLLOWING", "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"]
CALLS = ["COUNT(*)", "COUNT(v)", "SUM(v)", "TOTAL(v)", "AVG(v)", "MIN(v)", "MAX(v)"]


@pytest.fixture
def both(spark, files):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (id INTEGER, p TEXT, o INTEGER, v INTEGER)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", ROWS)
    text = "id,p,o,v\n" + "".join(",".join("" if x is None else str(x) for x in r) + "\n" for r in ROWS)
    db = tessera.open(files(t__csv=text), spark=spark)

    def compare(select):
        query = f"SELECT id, {select} FROM t ORDER BY id"
        want, got = con.execute(query).fetchall(), [tuple(r) for r in db.sql(query).collect()]
        assert [tuple(None if x is None else pytest.approx(float(x)) for x in r) for r in want] == got, query

    return db, compare


@pytest.mark.parametrize("bounds", BOUNDS)
def test_groups(both, bounds):
    _, compare = both
    compare(", ".join(f"{c} OVER (PARTITION BY p ORDER BY o DESC GROUPS BETWEEN {bounds})" for c in CALLS) + f", SUM(v) FILTER (WHERE id > 3) OVER (ORDER BY p, o GROUPS BETWEEN {bounds})")


@pytest.mark.parametrize("exclude,bounds", list(itertools.product(["CURRENT ROW", "GROUP", "TIES", "NO OTHERS"], BOUNDS)))
def test_exclude_of_groups(both, exclude, bounds):
    _, compare = both
    calls = CALLS if bounds in BOUNDS[:2] else ["COUNT(*)", "SUM(v)", "MAX(v)"]
    compare(", ".join(f"{c} OVER (PARTITION BY p ORDER BY o GROUPS BETWEEN {bounds} EXCLUDE {exclude})" for c in calls))


def test_exclude_of_rows_and_ranges(both):
    _, compare = both
    compare(", ".join(f"SUM(v) OVER (PARTITION BY p ORDER BY o, id ROWS BETWEEN {b} EXCLUDE CURRENT ROW), COUNT(*) OVER (ORDER BY id ROWS BETWEEN {b} EXCLUDE CURRENT ROW)" for b in BOUNDS))
    compare(", ".join(f"SUM(v) OVER (PARTITION BY p ORDER BY o RANGE BETWEEN {b} EXCLUDE {e})" for b in (BOUNDS[0], BOUNDS[3], BOUNDS[5]) for e in ("GROUP", "TIES", "CURRENT ROW")))
    compare("COUNT(*) OVER (ORDER BY o GROUPS 1 PRECEDING), SUM(v) OVER (PARTITION BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP), SUM(v) FILTER (WHERE o > 1) OVER (ORDER BY o GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES)")
    compare("COUNT(*) OVER w, MIN(v) OVER w FROM (SELECT * FROM t) AS t WINDOW w AS (PARTITION BY p ORDER BY o GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) -- ")


def test_refused_by_name(both):
    db, _ = both
    for window, what in (
        ("ORDER BY o ROWS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE TIES", "EXCLUDE TIES"),
        ("GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW", "ORDER BY"),
        ("ORDER BY o GROUPS BETWEEN v PRECEDING AND CURRENT ROW EXCLUDE GROUP", "whole numbers"),
    ):
        with pytest.raises(SqlError, match=what):
            db.sql(f"SELECT SUM(v) OVER ({window}) FROM t")
    with pytest.raises(SqlError, match="(?i)first_value"):
        db.sql("SELECT FIRST_VALUE(v) OVER (ORDER BY o GROUPS CURRENT ROW EXCLUDE GROUP) FROM t")
    with pytest.raises(SqlError, match="named"):
        db.sql("SELECT SUM(v) OVER w FROM t WINDOW w AS (ORDER BY o GROUPS CURRENT ROW EXCLUDE GROUP)")
