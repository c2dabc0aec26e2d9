"""Suffix sorting and removal of repeats against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import repeats
from tessera.llm.suffixes import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols, np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("symbols", [[], [5], [1] * 50, [1, 2] * 40, list(range(30)), list(range(30))[::-1]])
def test_suffix_array_of_regular_texts(symbols):
    assert suffix_array(np.array(symbols, np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def brute(texts, span):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["ab", "the", "xx", "éa", "zz y", "q"]
    base = ["".join(r.choice(words) + " " for _ in range(60)) for _ in range(4)]
    texts = [None, "", "a" * 200, "abc" * 100, "abc" * 100 + "d", base[0], base[0], "x" + "say it. " * 30, "say it. " * 40]
    for _ in range(50):
        t = "".join(r.choice(words) + " " for _ in range(r.randint(0, 30)))
        for _ in range(r.randint(0, 3)):
            b = r.choice(base)
            a = r.randint(0, len(b))
            t += b[a : a + r.randint(0, 200)] + "".join(chr(97 + r.randrange(26)) for _ in range(r.randint(0, 20)))
        texts.append(t)
    return texts


@pytest.mark.parametrize(("span", "gram", "crowd", "seed"), [(40, 12, 2000, 1), (40, 12, 2, 2), (50, 30, 5, 3), (30, 29, 2000, 4)])
def test_report_is_that_of_brute_force(spark, span, gram, crowd, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in repeats.report(docs, span=span, gram=gram, crowd=crowd).collect()}
    assert got == dict(enumerate(brute(texts, span)))


def test_long_texts_are_cut_into_parts_without_loss(monkeypatch):
    r = random.Random(7)
    text = "".join(r.choice("abcdefgh ") for _ in range(5000)).encode()
    data = np.frombuffer(text, np.uint8)
    start, windows, mark, _ = repeats.runs(data, np.array([0, len(data)]), 60, 20)
    assert windows.sum() == len(data) - 59 and (start[1:] == start[:-1] + windows[:-1]).all()
    assert ((mark >= start + windows - 1) & (mark + 20 <= start + 60)).all()


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    work = repeats._cut_runs(40, 12)
    import pyarrow as pa

    text = "".join(random.Random(3).choice("abcd ") for _ in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], names=["t1", "t2", "text"])
    rows = pa.Table.from_batches(list(work(iter([batch])))).to_pydict()
    places = [p for starts, w in zip(rows["starts"], rows["windows"], strict=True) for s in starts for p in range(s, s + w)]
    assert sorted(places) == list(range(len(text) - 39))


def test_removal_keeps_other_columns(spark):
    passage = "this passage stands in two documents " * 12
    rows = [(1, "one " + passage + " end", "en", "s", 0, "k"), (2, passage + "two", "en", None, 0, "k"), (3, "clean", None, "s", 5, None), (4, passage, "en", "s", 0, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")
    out = {r["doc_id"]: r for r in repeats.remove(docs).collect()}
    assert out[1]["text"] == "one  end" or out[1]["text"].replace(" ", "") == "oneend"
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[3]["text"] == "clean" and out[3]["n_chars"] == 5
    assert 4 not in out and out[2]["spans"] == "k"


def test_awkward_rows(awkward, none):
    rows = repeats.report(awkward, span=50, gram=20).collect()
    assert len(rows) == awkward.count() and repeats.report(none).collect() == []
    assert repeats.remove(none).collect() == [] and repeats.remove(awkward, span=50, gram=20).columns == awkward.columns
    long_ = next(r for r in rows if r["doc_id"] == 5)
    assert long_["n_removed"] == 3000  # one letter over and over: every string in it starts elsewhere too


@pytest.mark.parametrize(("words", "crowd", "seed"), [(7, 2000, 5), (4, 2, 6)])
def test_passages_in_words_are_those_of_brute_force(spark, words, crowd, seed):
    texts = [t for t in corpus(seed) if t] + ["  lead  in a\tb", "漢字 ümläut " * 9, "x"]
    split = [[w for w in t.replace("\t", " ").split(" ") if w] for t in texts]
    count = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    want = []
    for w in split:
        gone = [any(count[tuple(w[i : i + words])] > 1 for i in range(max(0, k - words + 1), min(k, len(w) - words) + 1)) for k in range(len(w))]
        want.append([x for x, g in zip(w, gone, strict=True) if not g])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split() for r in repeats.remove(docs, words=words, crowd=crowd, span=5000, gram=100).collect()}
    assert got == {i: w for i, w in enumerate(want) if w}
