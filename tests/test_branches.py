"""Left joins taken apart, against the embedded database and by their plans."""

import random
import sqlite3

import pytest

import tessera
from tessera.operators.sinks import DumpOptions, write_file

TABLES = {"area": "area_id,area_name,place", "shop": "shop_id,in_area,rent,name", "buyer": "buyer_id,lives_in,saved", "visit": "visit_id,at_shop,paid"}

APART = [
    "SELECT a.area_name, COUNT(DISTINCT s.shop_id) AS shops, COUNT(DISTINCT b.buyer_id) AS buyers FROM area a LEFT JOIN shop s ON s.in_area = a.area_id LEFT JOIN buyer b ON b.lives_in = a.area_id GROUP BY a.area_name",
    "SELECT area_name, place, MIN(rent) AS low, MAX(saved) AS high FROM area LEFT OUTER JOIN shop ON in_area = area_id LEFT JOIN buyer ON lives_in = area_id WHERE area_id <> 2 GROUP BY area_name, place HAVING MAX(saved) > 10 ORDER BY high DESC, area_name, place",
    "SELECT COALESCE(SUM(DISTINCT s.rent), -1) AS rents, COUNT(DISTINCT b.saved) + COUNT(DISTINCT a.place) AS n, COUNT(DISTINCT v.paid) AS spent FROM area a LEFT JOIN shop s ON s.in_area = a.area_id AND a.place > 1 LEFT JOIN buyer b ON b.lives_in = a.area_id LEFT JOIN visit v ON v.at_shop = s.shop_id",
    "SELECT a.place % 2 AS odd, COUNT(DISTINCT s.rent) AS rents FROM area a LEFT JOIN shop s ON s.in_area = a.area_id LEFT JOIN buyer b ON b.lives_in = a.area_id JOIN area c ON c.place = a.place GROUP BY a.place % 2",
    "SELECT UPPER(a.area_name) AS n, COUNT(DISTINCT s.name) AS names, MAX(b.saved) AS top FROM area AS a LEFT JOIN shop s ON s.in_area = a.area_id LEFT JOIN buyer AS b ON b.lives_in = a.area_id AND b.saved > 20 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
]
WHOLE = [
    "SELECT a.area_name, COUNT(s.shop_id) AS shops, COUNT(DISTINCT b.buyer_id) AS buyers FROM area a LEFT JOIN shop s ON s.in_area = a.area_id LEFT JOIN buyer b ON b.lives_in = a.area_id GROUP BY a.area_name",
    "SELECT a.area_name, COUNT(DISTINCT s.shop_id) AS shops, COUNT(*) AS n FROM area a LEFT JOIN shop s ON s.in_area = a.area_id LEFT JOIN buyer b ON b.lives_in = a.area_id GROUP BY a.area_name",
    "SELECT a.area_name, COUNT(DISTINCT COALESCE(s.rent, 0)) AS rents, COUNT(DISTINCT b.buyer_id) AS buyers FROM area a LEFT JOIN shop s ON s.in_area = a.area_id LEFT JOIN buyer b ON b.lives_in = a.area_id GROUP BY a.area_name",
    "SELECT a.area_name, COUNT(DISTINCT s.rent) AS rents, COUNT(DISTINCT b.buyer_id) AS buyers FROM area a LEFT JOIN shop s ON s.in_area = a.area_id LEFT JOIN buyer b ON b.lives_in = a.area_id WHERE b.saved > 20 GROUP BY a.area_name",
    "SELECT a.area_name, COUNT(DISTINCT s.rent) AS rents, COUNT(DISTINCT b.buyer_id) AS buyers FROM area a LEFT JOIN shop s ON s.in_area = a.area_id LEFT JOIN buyer b ON b.lives_in = a.area_id JOIN visit v ON v.at_shop = s.shop_id GROUP BY a.area_name",
    "SELECT s.name, COUNT(DISTINCT b.buyer_id) AS buyers, MAX(s.rent) AS top FROM area a LEFT JOIN shop s ON s.in_area = a.area_id LEFT JOIN buyer b ON b.lives_in = a.area_id GROUP BY s.name",
    "SELECT a.area_name, COUNT(DISTINCT b.buyer_id) AS name, MAX(s.rent) AS top FROM area a LEFT JOIN shop s ON s.in_area = a.area_id LEFT JOIN buyer b ON b.lives_in = a.area_id GROUP BY a.area_name ORDER BY name, a.area_name",
    "SELECT a.area_name, COUNT(DISTINCT s.shop_id) AS shops, MAX(s.rent) AS top FROM area a LEFT JOIN shop s ON s.in_area = a.area_id GROUP BY a.area_name",
]


@pytest.fixture(scope="module")
def told():
    r = random.Random(3)
    some = lambda *x: r.choice([None, *x])
    return {
        "area": [(i, r.choice(["x", "y", "z", "w"]), some(1, 2, 3)) for i in [*range(8), 3]],
        "shop": [(i, some(*range(6)), some(10, 20, 30), some("p", "q", "r")) for i in range(30)],
        "buyer": [(i % 33, some(*range(2, 11)), some(10, 20, 30, 40)) for i in range(40)],
        "visit": [(i, some(*range(35)), some(1, 2, 3, 4, 5)) for i in range(50)],
    }


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory, told):
    lite = sqlite3.connect(":memory:")
    for name, head in TABLES.items():
        lite.execute(f"CREATE TABLE {name} ({head})")
        lite.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * (head.count(',') + 1))})", [tuple("" if v is None and k == 3 else v for k, v in enumerate(r)) for r in told[name]])
    text = lambda name: TABLES[name] + "\n" + "".join(",".join("" if v is None else str(v) for v in r) + "\n" for r in told[name])
    folder = tmp_path_factory.mktemp("branches")
    for name in TABLES:
        (folder / f"{name}.csv").write_text(text(name))
    with tessera.open(str(folder), spark=spark) as db:
        yield db, lite


@pytest.mark.parametrize("text", APART + WHOLE)
def test_against_sqlite(both, text):
    db, lite = both
    found, want = db.sql(text), lite.execute(text)
    assert found.columns == [c[0] for c in want.description]
    order = (lambda x: x) if "ORDER BY" in text else (lambda x: sorted(x, key=repr))
    assert order([tuple(r) for r in found.collect()]) == order(want.fetchall())
    assert ("_tessera_apart" in found._jdf.queryExecution().analyzed().toString()) == (text in APART)


def test_rows_of_joins_do_not_multiply(spark, files):
    """A group of 60 000 and 60 000 rows: 3.6 thousand million pairs."""
    n = 60_000
    texts = {"area__csv": "area_id\n1\n2\n", "shop__csv": "shop_id,in_area\n" + "".join(f"{i},1\n" for i in range(n)), "buyer__csv": "buyer_id,lives_in\n" + "".join(f"{i // 2},1\n" for i in range(n))}
    with tessera.open(*files(**texts), spark=spark) as db:
        found = db.sql("SELECT area_id, COUNT(DISTINCT shop_id), COUNT(DISTINCT b.buyer_id) FROM area LEFT JOIN shop ON in_area = area_id LEFT JOIN buyer b ON lives_in = area_id GROUP BY area_id")
        assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, found.collect())) == [(1, n, n // 2), (2, 0, 0)]


def test_texts_of_doubles(spark, tmp_path):
    told = {"12.5": "12.5", "-0.001": "-0.001", "0.000999": "0.000999", "9999999.5": "9999999.5", "10000000.25": "10000000.25", "-0.0": "0", "1e7": "10000000", "2.5e-10": "0.00000000025", "123456789012.75": "123456789012.75", "1e15": "1.0E15"}
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(told)], "i int, x double").coalesce(1)
    write_file(rows, f"{tmp_path}/t.csv", DumpOptions())
    assert (tmp_path / "t.csv").read_text().split("\n")[1:-1] == [f"{i},{x}" for i, x in enumerate(told.values())]
