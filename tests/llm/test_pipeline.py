"""The pipeline's stages one after another, and each against what it promises."""

import random

import corpus_pipeline
from tessera.llm import packing, queries


def documents(spark):
    r = random.Random(4)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randint(2, 6)))
    passage = " ".join(word("abcdefg") for _ in range(90))
    rows = []
    for i in range(120):
        lang, letters = ("xx", "abcdefg") if i % 2 else ("yy", "nopqrst")
        text = " ".join(word(letters) for _ in range(r.randint(20, 200)))
        if i % 10 == 3:
            text += " " + passage + " " + word(letters)
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    rows += [(200 + k, rows[k][1], rows[k][2], "s1", rows[k][4]) for k in range(10)]
    rows += [(300, None, None, None, None), (301, "1234 %%", "xx", "s0", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), passage


def test_stages(spark, tmp_path):
    docs, passage = documents(spark)
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"{k}.parquet")
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            assert {300, 301} & {r[0] for r in docs.select("doc_id").collect()} == set() and docs.count() == before.count() - 2
        if k == 1:
            assert {r[0] for r in docs.select("doc_id").collect()} == set(range(120))
        if k == 2:
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert not any(passage in t for t in texts.values()) and len(texts) == 120
            assert sum(len(t) < len(r["text"]) for r in before.collect() if (t := texts[r["doc_id"]]) != r["text"]) == 12
        if k == 3:
            sizes = {r[0]: r[1] for r in docs.groupBy("source").agg({"n_chars": "sum"}).collect()}
            assert set(sizes) == {"s0", "s1", "s2", "s3"} and docs.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    rows = docs.collect()
    assert sum(r["length"] for r in rows) <= 1024 * len({r["sequence_id"] for r in rows})
    assert len(rows) >= before.count()


def test_passages_of_over_50_words_go(spark):
    r = random.Random(9)
    say = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 6))) for _ in range(n))
    passages = {n: say(n) for n in (50, 51, 52, 55, 58, 60, 65)}
    assert all(len(p) < 400 for p in passages.values())
    rows, alone = [], {}
    for n, passage in passages.items():
        for k in range(2):
            before, after = say(r.randint(1, 90)), say(r.randint(1, 90))
            # White space between words does not make another passage.
            inner = passage.replace(" ", "\n", 5) if k else passage
            alone[len(rows)] = (before, inner, after, n)
            rows.append((len(rows), f"{before} {inner} {after}", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {d["doc_id"]: d["text"] for d in corpus_pipeline.remove_repeats(spark, docs, "").collect()}
    for i, (before, inner, after, n) in alone.items():
        assert got[i] == (f"{before} {inner} {after}" if n <= 50 else f"{before}  {after}"), n


def test_run_is_the_stages_in_turn(spark, tmp_path):
    docs, _ = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
    assert out.agg({"length": "max"}).first()[0] <= packing.CAPACITY


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())
