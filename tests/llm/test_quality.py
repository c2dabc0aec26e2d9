"""Co-training: held-out accuracy, the worth of pseudo-labels, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality


def corpus(spark, n=600, labelled=0.3):
    r = random.Random(1)
    good, bad = "the of and river mountain letter history study".split(), "$$$ ### buy!! WIN!! click@@ now%%".split()
    docs, labels = [], []
    for i in range(n):
        fine = i % 3 != 0
        docs.append((i, " ".join(r.choice(good if fine else bad) + ("" if fine else "&") for _ in range(r.randint(5, 60))), "press" if fine == (r.random() < 0.9) else "forum", "en", r.randint(10, 500)))
        if r.random() < labelled:
            labels.append((i, int(fine)))
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long"), spark.createDataFrame(labels, "doc_id long, label int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    out = F.col("doc_id") % 5 == 0
    model = quality.fit(docs.where(~out), labels.where(~out))
    rows = quality.score(docs.where(out), model).collect()
    truth = np.array([r["doc_id"] % 3 != 0 for r in rows])
    both, meta = (np.array([r[c] >= 0.5 for r in rows]) for c in ("quality_score", "meta_score"))
    assert (both == truth).mean() > 0.97 and (meta == truth).mean() > 0.8
    assert all(0 <= r[c] <= 1 for r in rows for c in ("text_score", "meta_score", "quality_score"))


def test_fitting_is_repeatable(spark):
    docs, labels = corpus(spark, 200)
    a, b = (quality.fit(docs.repartition(n), labels) for n in (1, 5))
    assert np.allclose(a.text, b.text) and np.allclose(a.mix, b.mix)


def test_views_teach_each_other():
    """With labels for few rows, what one view is sure of helps the other."""
    rng = np.random.default_rng(0)
    n = 600
    truth = rng.integers(0, 2, n)
    rows = lambda f: quality.Rows(np.arange(n), f, np.ones(n), n)
    text = rows(np.where(truth, rng.integers(0, 20, n), rng.integers(20, 40, n)))
    meta = rows(np.where(rng.random(n) < 0.95, truth, 1 - truth))
    y = np.where(np.arange(n) < 16, truth, -1)
    right = lambda m: (((1 / (1 + np.exp(-text.times(m.text)))) > 0.5) == truth).mean()
    assert right(quality.co_train(text, meta, y, rounds=8, handed=0.1)) > right(quality.co_train(text, meta, y, rounds=0)) + 0.05


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, None)], 0.5)])
def test_without_labels_of_both_kinds(spark, awkward, labels, score):
    model = quality.fit(awkward, spark.createDataFrame(labels, "doc_id long, label int"))
    assert {r["quality_score"] for r in quality.score(awkward, model).collect()} == {score}


def test_awkward_rows(spark, awkward, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 0), (None, 1)], "doc_id long, label int")
    model = quality.fit(awkward, labels)
    rows = quality.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert quality.score(none, model).collect() == [] and quality.fit(none, labels).share == 0.5
