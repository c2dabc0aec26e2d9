"""The registered queries themselves, over the smallest tables, against SQL or plain versions."""

import hashlib
import os
import zlib

import duckdb
import pytest
import test_neardup
import test_repeats

from tessera.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_results_are_those_of_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    key = lambda row: tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in row)
    assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(key, want.fetchall()))


def test_op1(spark, texts):
    assert {r["doc_id"]: tuple(r)[1:5] for r in run(spark, "op1_suffix_dedup")} == dict(zip(texts, test_repeats.brute(list(texts.values()), 400), strict=True))


def test_op3(spark, texts):
    classes = {r["doc_id"]: r["class_id"] for r in run(spark, "op3_minhash_neardup")}
    ids = sorted(texts)
    assert classes == {ids[k]: ids[root] for k, root in enumerate(test_neardup.brute([texts[i] for i in ids]))}


def test_op4_and_op7_hold_out_and_score_every_row(spark, texts):
    rows = run(spark, "op4_language_id")
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or "")) and 0 <= r["score"] <= 1 for r in rows)
    rows = run(spark, "op7_cotrained_quality")
    assert {r["doc_id"] for r in rows} == set(texts) and {r["held_out"] for r in rows} == {True, False}
    assert all(0 <= r[c] <= 1 for r in rows for c in ("text_score", "meta_score", "quality_score"))


def test_op5(spark, texts):
    rows = run(spark, "op5_audio_features")
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
