"""Near-duplicate classes against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import neardup


def shingles(text):
    words = [w for w in (text or "").lower().split() if w]
    if not words:
        return Counter()
    return Counter([tuple(words)]) if len(words) < 5 else Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(texts, similarity=0.8):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both, any_ = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if both >= similarity * any_:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def corpus(seed, groups=6, size=7):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = ["", None, "  ", "same", "Same", "a b", "b a"]
    for _ in range(groups):
        base = [word() for _ in range(r.randint(30, 200))]
        for _ in range(r.randint(1, size)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(50)) for _ in range(10)]
    return texts


@pytest.mark.parametrize(("seed", "small", "depth"), [(1, 5000, 4), (2, 2, 1), (3, 2, 0)])
def test_classes_are_those_of_brute_force(spark, seed, small, depth):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.report(docs, small=small, depth=depth).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_near_copies_of_few_words_are_found(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = []
    for i in range(60):
        base = [word() for _ in range(8)]
        texts += [" ".join(base), " ".join([*base, word()] if i % 2 else [word(), *base])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.report(docs).collect()}
    assert got == dict(enumerate(brute(texts))) and set(got.values()) == set(range(0, 120, 2))


@pytest.mark.parametrize(("small", "depth"), [(3, 1), (3, 4), (100, 4)])
def test_pairs_that_agree_in_a_large_buckets_band_only_are_found(spark, small, depth):
    from tessera.llm.common import Scratch

    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = []
    for n in (40, 44, 49, 60):
        base = [word() for _ in range(n)]
        texts += [" ".join(base), " ".join([*base, word()])]
    texts += [" ".join(word() for _ in range(50)) for _ in range(6)]
    # All agree in one band; in the others, none with any other.
    signed = spark.createDataFrame([(i, [7, 100 + i, 200 + i]) for i in range(len(texts))], "node long, bands array<long>")
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    with Scratch(spark, "test") as scratch:
        labels = neardup.link(signed, docs, scratch, words=5, similarity=0.8, small=small, depth=depth)
        got = {r["node"]: r["class"] for r in labels.collect()}
    assert got == {i: i // 2 * 2 for i in range(8)}


@pytest.mark.parametrize(("shared", "left", "right"), [(4, 0, 1), (12, 0, 3), (20, 0, 5), (60, 4, 11)])
def test_sketches_differ_as_computed(shared, left, right):
    rng = np.random.default_rng(2)
    share, seen = neardup.differing(shared, left, right), []
    for _ in range(100):
        x = rng.integers(0, 2**63, left + shared + right).astype(np.uint64)
        a, b = neardup.sketches(np.concatenate([x[: left + shared], x[left:]]), np.array([left + shared, shared + right]))
        seen.append(np.bitwise_count((a ^ b).view(np.uint64)).sum() / neardup.SKETCH)
    assert abs(np.mean(seen) - share) < 0.003 and share <= neardup.shares(0.8)[min(left + shared, neardup.EXACT)]
    assert max(seen) * neardup.SKETCH <= neardup.most(neardup.SKETCH, neardup.shares(0.8)[min(left + shared, neardup.EXACT)])


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(30):
        n = int(rng.integers(3, 300))
        keys = rng.integers(0, 2**62, 2 * n)
        a = {int(k): int(rng.integers(1, 5)) for k in keys[:n]}
        b = dict(a) | {int(k): int(rng.integers(1, 6)) for k in keys[n // 2 : n + n // 3]}
        items = [(k, d, w) for d, s in enumerate((a, b)) for k, w in s.items()]
        e, d, w = (np.array(x) for x in zip(*items, strict=True))
        signature = neardup.dart_signatures(e.astype(np.uint64), d, w, 2, 256)
        every = set(a) | set(b)
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in every) / sum(max(a.get(k, 0), b.get(k, 0)) for k in every)
        errors.append((signature[0] == signature[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.06


def test_signatures_do_not_depend_on_neighbours():
    e = np.arange(1, 50, dtype=np.uint64) * np.uint64(977)
    w = np.ones(49, np.int64)
    alone = neardup.dart_signatures(e, np.zeros(49, np.int64), w, 1, 64)
    two = neardup.dart_signatures(np.concatenate([e[:5], e]), np.concatenate([np.zeros(5, np.int64), np.ones(49, np.int64)]), np.ones(54, np.int64), 2, 64)
    assert (alone[0] == two[1]).all()


def test_shingles_are_the_words():
    import pyarrow as pa

    from tessera.llm.common import utf8

    texts = ["a b c d e f", "", "x  y", "a b c d e", "z\tb\nc d e f"]
    s, which = neardup.shingles(*utf8(pa.array(texts)))
    by = [s[which == k].tolist() for k in range(len(texts))]
    assert [len(b) for b in by] == [2, 0, 1, 1, 2] and by[3] == by[0][:1] and by[4][1] == by[0][1]


def test_one_of_each_class_stays(spark):
    texts = corpus(5)
    docs = spark.createDataFrame([(i, t, "k", "k") for i, t in enumerate(texts)] + [(3, "same", "k", "k")], "doc_id long, text string, class string, _near string")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute(texts)))


def test_awkward_rows(awkward, none):
    rows = neardup.report(awkward).collect()
    assert len(rows) == awkward.count() and neardup.report(none).collect() == [] and neardup.keep_one(none).collect() == []
    by = {r["doc_id"]: r["class_id"] for r in rows}
    assert by[0] == by[1] == by[2] == 0 and by[3] == 3
    assert neardup.keep_one(awkward).columns == awkward.columns
