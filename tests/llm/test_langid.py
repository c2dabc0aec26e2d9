"""Language identification: the forward algorithm against enumeration, held-out accuracy, odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid

VOCAB = langid.vocabulary(langid.vocabulary_path())


def enumerate_segmentations(word, chances):
    """Sum over all cuts, scaled as the model scales."""
    index = {p: i for i, p in enumerate(VOCAB.pieces, 1)}
    total = {0: np.ones(chances.shape[1])}
    for j in range(1, len(word) + 1):
        total[j] = sum((total[i] * chances[index[word[i:j]]] for i in range(max(0, j - int(VOCAB.lengths.max())), j) if word[i:j] in index), np.zeros(chances.shape[1]))
    return total[len(word)]


def test_forward_is_the_sum_over_segmentations():
    rng = np.random.default_rng(0)
    chances = np.concatenate([np.zeros((1, 2)), rng.random((len(VOCAB.pieces), 2))])
    words = [b" the", b" internationalisation", "größe".encode(), b"x", b" \x00\x01", max(VOCAB.pieces, key=len), b" responsibilities" * 12, ("語" * 70).encode(), b"z" * 48, b"q" * 96]
    got = langid.word_scores(words, VOCAB, chances) + np.array([len(w) for w in words])[:, None] * np.log(langid.SCALE)
    want = np.log([enumerate_segmentations(w, chances) for w in words])
    assert np.allclose(got, want)


def test_the_whole_vocabulary_counts():
    assert len(VOCAB.pieces) >= 50_256 and max(map(len, VOCAB.pieces)) > 8
    for piece in random.Random(2).sample(VOCAB.pieces, 300):
        (seg,) = langid.lattice([piece], VOCAB)
        whole = [p for size, start, _, p, _ in seg.pieces if size == len(piece)]
        assert VOCAB.pieces[whole[0][0] - 1] == piece


def test_expected_pieces_do_not_depend_on_segments(monkeypatch):
    rng = np.random.default_rng(3)
    chances = np.concatenate([np.zeros((1, 2)), rng.random((len(VOCAB.pieces), 2))])
    words = [b" characteristically" * 5, b" a", "größenordnung".encode() * 4, b" hello"]
    args = (words, np.array([0, 1, 1, 0]), np.array([1.0, 2.0, 3.0, 4.0]), VOCAB, chances)
    parts = langid.expected_pieces(*args)
    monkeypatch.setattr(langid, "SEGMENT", 1000)
    assert np.allclose(parts, langid.expected_pieces(*args))
    assert np.isclose((parts.sum(axis=1) * VOCAB.lengths).sum(), sum(t * len(w) for w, t in zip(words, args[2], strict=True)))


def test_a_word_of_many_letters(spark):
    model = langid.fit(corpus(spark))
    names, scores = model.score(["bado" * 25_000, "schtumgrolk" * 10_000])
    assert names == ["aa", "bb"] and np.isfinite(scores).all()


def test_expected_pieces_add_up():
    chances = np.concatenate([np.zeros((1, 1)), np.full((len(VOCAB.pieces), 1), 0.3)])
    words, times = [b" hello", b" world"], np.array([2.0, 5.0])
    expected = langid.expected_pieces(words, np.zeros(2, np.int64), times, VOCAB, chances)
    covered = (expected[:, 0] * VOCAB.lengths).sum()
    assert np.isclose(covered, sum(t * len(w) for w, t in zip(words, times, strict=True)))


def corpus(spark, n=240):
    r = random.Random(0)
    kinds = {"aa": "bado kira luno teso mira".split(), "bb": "schtum grolk wreft klom prugt".split()}
    rows = []
    for i in range(n):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join("".join(r.choice(kinds[lang])[: r.randint(2, 5)] for _ in range(2)) for _ in range(r.randint(3, 20))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    out = langid.held_out(docs["doc_id"])
    model = langid.fit(docs.where(~out))
    rows = langid.identify(docs.where(out), model).collect()
    assert len(rows) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_training_does_not_see_held_out_rows(spark):
    import zlib

    ids = [r["doc_id"] for r in corpus(spark).where(langid.held_out(F.col("doc_id"))).collect()]
    assert ids == [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]


def test_equal_texts_get_equal_results_whatever_is_remembered(spark):
    model = langid.fit(corpus(spark))
    memory = langid.Remembered(len(model.languages))
    texts = ["bado kira", None, "12 34 !", "schtum grolk", "bado kira", "x" * 500, "²½"]
    first = model.score(texts, memory)
    again = model.score(texts[::-1], memory)
    assert memory.place and model.score(texts)[0] == first[0]
    assert first[0] == again[0][::-1] and (first[1] == again[1][::-1]).all()
    assert first[0][1] == first[0][2] == first[0][6] == "und" and first[0][0] == "aa" and first[0][3] == "bb"


def test_words():
    assert langid.words_of("Ab ab, c3d!") == Counter({"ab": 2, "c": 1, "d": 1})
    assert langid.words_of("123 --- ²") == Counter()
    assert langid.spelled("y" * 100) == b" " + b"y" * 100


def test_awkward_rows(awkward, none, spark):
    model = langid.fit(awkward)
    rows = langid.identify(awkward, model).collect()
    assert len(rows) == awkward.count()
    assert all(r["lang_pred"] == "und" for r in rows if not r["text"] or not any(c.isalpha() for c in r["text"]))
    assert langid.fit(none) is None and langid.identify(none, None).collect() == []
    assert {r["lang_pred"] for r in langid.identify(awkward, None).collect()} == {"und"}
    with pytest.raises(ValueError, match="lacks"):
        langid.fit(awkward.drop("lang"))
