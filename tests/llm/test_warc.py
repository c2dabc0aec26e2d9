"""Archive: exact records back from payloads stored once."""

import hashlib

import pytest

from tessera.llm import warc
from tessera.llm.common import shared_dir


@pytest.fixture
def archive(spark, tmp_path):
    long_, short = "<p>" + "x" * 200, "<p>short"
    rows = [(5, "http://a/1", long_), (2, "http://a/2", long_), (9, None, long_), (3, "http://b", short), (4, "http://c", short), (7, "http://d", None), (8, "http://e\r\nWARC-Type: revisit", ""), (None, "http://f", long_), (None, "u", "only once and without an id, but long enough to be a revisit " * 3), (2, "http://a/2", long_)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS digest", "'clash' AS payload", "1 AS size")
    path = f"{shared_dir(spark)}/{tmp_path.name}"
    warc.write_archive(pages, path)
    return rows, path


def test_records_come_back(spark, archive):
    rows, path = archive
    back = warc.read_archive(spark, path).collect()
    assert len(back) == len(rows)
    for r in back:
        assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["digest"]
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.decode() + "\r\n\r\n" == r["header"] and head.startswith(b"WARC/1.1\r\n")
        length = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
        assert body == (b"" if r["record_type"] == "revisit" else bytes(r["payload"])) + b"\r\n\r\n" and length == len(body) - 4
    found = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in back if r["page_id"] is not None)
    assert found == [(2, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "revisit", 2), (7, "response", None), (8, "response", None), (9, "revisit", 2)]
    assert sorted((r["record_type"], r["refers_to"] or 0) for r in back if r["page_id"] is None) == [("response", 0), ("revisit", 2)]


def test_payloads_are_stored_once(spark, archive):
    rows, path = archive
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in rows})


def test_damage_is_found(spark, archive, tmp_path):
    _, path = archive
    bad = f"{shared_dir(spark)}/{tmp_path.name}-bad"
    spark.read.parquet(f"{path}/headers").write.parquet(f"{bad}/headers")
    spark.read.parquet(f"{path}/payloads").selectExpr("digest", "CAST('other' AS BINARY) AS payload").write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="archive is damaged"):
        warc.read_archive(spark, bad).collect()
    lost = f"{shared_dir(spark)}/{tmp_path.name}-lost"
    spark.read.parquet(f"{path}/headers").write.parquet(f"{lost}/headers")
    spark.read.parquet(f"{path}/payloads").where("false").write.parquet(f"{lost}/payloads")
    with pytest.raises(Exception, match="archive lacks"):
        warc.read_archive(spark, lost).collect()


def test_nothing_to_archive(spark, tmp_path):
    path = f"{shared_dir(spark)}/{tmp_path.name}"
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).collect() == []
