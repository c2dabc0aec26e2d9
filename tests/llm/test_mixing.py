"""Mixing against a plain queue, and against its SQL."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest

from tessera.llm import mixing, queries


def plain(docs, weights=(1, 2, 3)):
    """(doc_id, size, source_size, target, taken) by one global sort."""
    sized = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s, t) for i, t, s in docs]
    totals = {}
    for _, n, s, _ in sized:
        totals[s] = totals.get(s, 0) + n
    sources = {s.name: s for s in mixing.fill_targets(list(totals.items()), list(weights))}
    entries, done = [], {}
    order = sorted(range(len(sized)), key=lambda k: (hashlib.md5(f"mix:{'' if sized[k][0] is None else sized[k][0]}".encode()).hexdigest(), sized[k][0] is not None, sized[k][0] or 0))
    for k in order:
        i, n, s, _ = sized[k]
        done[s] = done.get(s, 0) + n
        if n and sources[s].target:
            entries += [((e * totals[s] + done[s]) / sources[s].target, sources[s].rank, k, n) for e in range(3)]
    left, taken = sum(totals.values()), dict.fromkeys(range(len(sized)), 0)
    for _, _, k, n in sorted(entries):
        if n > left:
            break
        left -= n
        taken[k] += n
    return sorted((i is None, i or 0, n, totals[s], round(sources[s].target, 6), taken[k]) for k, (i, n, s, _) in enumerate(sized))


def corpus(n):
    return [(i, " ".join(["w"] * (i * 7919 % 23)), [None, "a", "b", "B", "é"][min(4, i * 31 % 9)]) for i in range(n)]


@pytest.mark.parametrize("n", [60, 300])
def test_mix_is_that_of_a_plain_queue(spark, n):
    docs = corpus(n)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2], round(r[3], 6), r[4]) for r in got) == plain(docs)


def test_mix_is_that_of_its_sql(spark):
    docs = corpus(120)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    want = con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({queries.OP9_SQL})").fetchall()
    got = [tuple(r) for r in mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(got) == sorted(want)


def test_targets():
    found = mixing.fill_targets([("b", 10), (None, 1000), ("a", 100)], [1, 2, 3])
    assert [(s.name, s.weight) for s in found] == [("a", 1), ("b", 2), (None, 3)]
    assert found[1].target == 30 and abs(sum(s.target for s in found) - 1110) < 1e-9
    assert all(s.target <= 3 * s.size for s in found)


def taken_of(df, **options):
    return Counter(mixing.take(df, **options).select("doc_id", "text", "source").collect())


def test_the_mix_itself(spark):
    docs = corpus(80)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    text = {i: (i, t, s) for i, t, s in docs}
    want = Counter({text[r["doc_id"]]: r["taken"] // r["size"] for r in mixing.mix(df).collect() if r["taken"]})
    assert taken_of(df) == want and mixing.take(df).columns == df.columns


def test_repeated_rows_and_null_ids_in_bulk(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    docs = [(None, "same words here", "a")] * 150 + [(None, f"text {'x ' * (i % 5)}{i}", "b") for i in range(90)] + [(5, "five", "a")] * 60 + corpus(40)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs)
    spent, target = Counter(), {}
    for r in rows:
        spent[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(spent[s] - t) <= 25 for s, t in target.items())
    out = taken_of(df)
    assert out == taken_of(df.repartition(3))  # reruns agree, however the rows are dealt
    words = Counter()
    for r, n in out.items():
        words[r["source"]] += n * len(r["text"].split())
    assert words == +spent


def test_awkward_rows(awkward, none):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count() and mixing.mix(none).collect() == [] and mixing.take(none).collect() == []
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    odd = awkward.withColumn("a.b`c", awkward["doc_id"])
    out = mixing.take(odd).collect()
    assert mixing.take(odd).columns == odd.columns and {r["key"] for r in out} == {"clash"}
