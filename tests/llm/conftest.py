import pytest

AWKWARD = [None, "", " ", "a", "A b", "x" * 3000, "word " * 600, "tie tie tie tie tie", "\x00 nul", "ümläut ß 漢字 🙂", "<|endoftext|> y", "a\tb\nc"]


@pytest.fixture
def awkward(spark):
    """Documents with nulls in every column, blank, long, repeated and odd texts, and columns of clashing names."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(AWKWARD)]
    rows += [(1, "", "en", "s", 0), (7, "tie tie tie tie tie", "en", "s", 19), (None, "no id at all here today", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = "t1 t2 spans node key bands size taken target score lang_pred path host _text piece length sequence_id offset".split()
    return df.selectExpr("*", *[f"'clash' AS {n}" for n in names])


@pytest.fixture
def none(awkward):
    return awkward.where("false")
