"""Near-duplicate classes by DartMinHash and banded joining.

A document is the weighted set of its word shingles (lower-cased words parted
by ASCII white space, ``words`` in a row; a shorter document is one shingle),
weights being their counts.  Two documents are near-duplicates if the weighted
Jaccard similarity of these sets is at least ``similarity``; classes are the
connected components, named after their smallest document id.

DartMinHash: the plane (weight, time) above each shingle is cut into cells, the
first of unit width and each further one as wide as all before it.  A hashed
Poisson process throws darts into each cell, the same in all documents; a
document sees those below its weight.  Darts carry a coordinate of the
signature, and the earliest per coordinate is its value.  A document only
generates darts up to the time by which all coordinates are hit (its area, not
its length, sets their number); if one stays empty, the time is doubled.

Signatures are cut into bands; documents that agree in one are candidates.
Candidates are verified on the exact sets.  No bucket is expanded into pairs:

1. Members are compared with the bucket's leader, that which meets most others;
   classes are formed.
2. In buckets that still hold several classes (of up to ``small`` members), those
   outside the most common class are compared with the members of other classes.
   Larger buckets are dealt again by all bands within them, and start over at 1,
   which unites most of their classes at little cost.
3. After ``depth`` deals, 2. is done for the larger buckets as they first were, in
   blocks of about ``small`` by ``small`` members of like weight: most pairs of
   exactly the similarity that agree in but one band are found only there.  So no
   candidate is lost.  A pair within one class needs no test.

Before sets are compared, a pair's weights and SKETCH-bit sketches of its sets
must allow the similarity (:func:`likely`), which is looked at within the join
that makes the pair.

Exact copies are one document throughout.

Defined results: a null text is empty; texts without words are one class, as
are exact copies; rows that share an id are one document (one class); rows
without an id are grouped by text, and a class of only such rows has no id; an
empty table gives an empty result; further columns are ignored by
:func:`classes` and kept by :func:`keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ensure_columns, slices, text_key, tidy, utf8
from .repeats import Hashes, _mixed

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 22, 5
SMALL = 5_000
DEPTH = 4
SPARE = 3.0
SKETCH = 2_048
SHORT = 32
TOGETHER = 500
MISSED = 1e-4
EXACT = 64
MASK = (1 << 64) - 1
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each shingle of texts side by side, in order."""
    n = len(data)
    texts = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~WHITE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True  # no word goes on into the next text
    before = np.concatenate([[False], inside[:-1]]) & ~first[:n]
    after = np.concatenate([inside[1:], [False]]) & ~first[1:]
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    hashes = Hashes(data)
    word = _mixed((hashes.prefix[stop] - hashes.prefix[start]) * hashes.down[start])
    owner = np.searchsorted(offsets, start, "right") - 1
    counts = np.bincount(owner, minlength=texts)
    many = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    at = np.repeat(np.cumsum(counts) - counts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    which = np.repeat(np.arange(texts), many)
    width = np.minimum(counts, words)[which]
    total = width.astype(np.uint64)
    for j in range(words):
        here = j < width
        total = _mixed(total * np.uint64(0x100000001B3) + np.where(here, word[np.minimum(at + j, len(word) - 1)], np.uint64(0)))
    return total, which


def weighted(shingle: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text with their counts: hash, text index, count (sorted by text)."""
    order = np.lexsort((shingle, which))
    s, w = shingle[order], which[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(w) != 0) | (s[1:] != s[:-1])])) if len(s) else np.zeros(0, np.int64)
    return s[new], w[new], np.diff(np.concatenate([new, [len(s)]]))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(element: np.ndarray, which: np.ndarray, weight: np.ndarray, texts: int, coordinates: int) -> np.ndarray:
    """The signature of each text (row) from its weighted elements; texts without elements have zeros."""
    signature = np.zeros((texts, coordinates), np.uint64)
    total = np.bincount(which, weights=weight, minlength=texts)
    until = np.divide(coordinates * (np.log(coordinates) + SPARE), total, out=np.zeros(texts), where=total > 0)
    todo = total > 0
    while todo.any():
        chosen = todo[which]
        e, d, w = element[chosen], which[chosen], weight[chosen].astype(np.float64)
        found: list[tuple[np.ndarray, ...]] = []
        cell, low, width = 0, 0.0, 1.0
        while len(e):
            last, partial = until[d], w < low + width
            some = partial.any()
            time = np.zeros(len(e))
            seed = _mixed(e + np.uint64(0x632BE59BD9B4E019 * (cell + 1) & MASK))
            live_d, live_w, j = d, w, 0
            while len(seed):
                dart = _mixed(seed + np.uint64(0x9FB21C651E98DF25 * (j + 1) & MASK))
                time -= np.log(_uniform(dart)) / width
                on = np.flatnonzero(time < last)
                seed, time, last, live_d, dart = seed[on], time[on], last[on], live_d[on], dart[on]
                if some:
                    live_w = live_w[on]
                    seen = low + width * _uniform(_mixed(dart + np.uint64(0xD6E8FEB86659FD93))) < live_w
                    found.append((live_d[seen], time[seen], dart[seen]))
                else:
                    found.append((live_d, time.copy(), dart))
                j += 1
            low, width, cell = low + width, low + width, cell + 1
            more = w > low
            e, d, w = e[more], d[more], w[more]
        doc, time, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        coordinate = (_mixed(dart + np.uint64(1)) % np.uint64(coordinates)).astype(np.int64)
        slot = doc * coordinates + coordinate
        earliest = np.full(texts * coordinates, np.inf)
        np.minimum.at(earliest, slot, time)
        wins = time == earliest[slot]
        signature.reshape(-1)[slot[wins]] = dart[wins]
        todo &= ~np.isfinite(earliest).reshape(texts, coordinates).all(axis=1)
        until = np.where(todo, 2 * until, until)
    return signature


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    texts, coordinates = signature.shape
    parts = signature.reshape(texts, coordinates // rows, rows)
    total = np.broadcast_to(np.arange(coordinates // rows, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        total = _mixed(total * np.uint64(0x100000001B3) + parts[:, :, r])
    return total


def _list(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _signed(words: int, n_bands: int, rows: int):
    """Rows (node, text) to rows (node, bands)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            key = np.zeros((batch.num_rows, n_bands), np.uint64)
            short: list[tuple[np.ndarray, ...]] = []
            for i, j in slices(offsets, 1 << 18):
                s, which = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                s, which, times = weighted(s, which)
                # Few shingles throw many darts each, one after the other: such texts are done together.
                few = np.bincount(which, weights=times, minlength=j - i)[which] < SHORT
                short.append((s[few], which[few] + i, times[few]))
                key[i:j] = bands(dart_signatures(s[~few], which[~few], times[~few], j - i, n_bands * rows), rows)
            s, which, times = (np.concatenate(x) for x in zip(*short, strict=True)) if short else (np.zeros(0, np.int64),) * 3
            own, which = np.unique(which, return_inverse=True)
            # A text throws about as many darts whatever its length, so their number is bounded by that of texts.
            edges = np.searchsorted(which, np.arange(0, len(own) + TOGETHER, TOGETHER))
            for n, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                part = own[n * TOGETHER : (n + 1) * TOGETHER]
                key[part] = bands(dart_signatures(s[i:j], which[i:j] - n * TOGETHER, times[i:j], len(part), n_bands * rows), rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), _list(key.ravel(), np.full(batch.num_rows, n_bands))], names=["node", "bands"])

    return work, "node long, bands array<long>"


def sketches(element: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each set (elements side by side), on which side of SKETCH random planes it lies: bits as longs.

    Large sets whose vectors enclose an angle differ in about that share of a half turn of the bits; see :func:`shares`.
    """
    out = np.zeros((len(counts), SKETCH // 64), np.int64)
    ends = np.cumsum(counts)
    salt = np.arange(1, SKETCH // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
        total = np.zeros(SKETCH, np.int64)
        for at in range(end - n, end, 4096):
            words = _mixed(element[at : min(at + 4096, end), None] + salt)
            total += np.unpackbits(words.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * total > n).view(np.int64)
    return out


@lru_cache
def _votes(n: int) -> np.ndarray:
    """Probability of each number of ones among n fair votes."""
    return np.array([math.comb(n, k) / (1 << n) for k in range(n + 1)])


def differing(shared: int, left: int, right: int) -> float:
    """Probability that a sketch bit differs between sets of so many shared and so many own elements."""
    ones = np.arange(shared + 1)

    def set_(own: int) -> np.ndarray:
        """Probability of a one, by the ones among the shared elements: it takes more than half of all votes."""
        tail = np.append(np.cumsum(_votes(own)[::-1])[::-1], 0.0)
        return tail[np.clip((shared + own) // 2 + 1 - ones, 0, own + 1)]

    a, b = set_(left), set_(right)
    return float(_votes(shared) @ (a * (1 - b) + b * (1 - a)))


@lru_cache
def shares(similarity: float) -> tuple[float, ...]:
    """By the smaller set's size up to EXACT, the largest share of bits in which sets of that similarity differ.

    Ties of the votes, which count as zeros, and the few values that small sums
    take bring it above the angle's share; from EXACT on by less than in the
    last quarter before, which stands for all larger sets.
    """
    found = [0.0]
    for low in range(1, EXACT + 1):
        worst = 0.0
        for high in range(low, math.floor(low / similarity + 1e-9) + 1):
            least = math.ceil(similarity * (low + high) / (1 + similarity) - 1e-9)
            worst = max(worst, *(differing(s, low - s, high - s) for s in range(least, low + 1)), 0.0)
        found.append(worst)
    angle = float(np.arccos(2 * similarity / (1 + similarity))) / np.pi
    return (*found[:EXACT], max(angle, *found[EXACT * 3 // 4 :]))


@lru_cache
def most(bits: int, share: float) -> int:
    """So many of the bits differ at most, but for a probability of MISSED."""
    if not 0 < share < 1:
        return round(bits * share)
    k = np.arange(bits + 1)
    ways = np.array([math.lgamma(bits + 1) - math.lgamma(i + 1) - math.lgamma(bits - i + 1) for i in range(bits + 1)])
    chance = np.exp(ways + k * math.log(share) + (bits - k) * math.log1p(-share))
    return int(np.flatnonzero(np.append(np.cumsum(chance[::-1])[::-1], 0.0)[1:] <= MISSED)[0])


def likely(similarity: float) -> Column:
    """May two sets (columns ``w, sketch`` and those with an underscore) be similar enough?

    Their weights must allow it.  Sets of that similarity differ in the share of
    bits that :func:`shares` has for the smaller one's size; their sketches may
    differ in as many bits as that brings, each of the two tests missing such a
    pair with probability MISSED.
    """
    size = F.least("w", "w_", F.lit(EXACT)).cast("int")

    def differ(longs: int) -> Column:
        each = [F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("sketch_", F.lit(i)))) for i in range(longs)]
        limits = F.array(*[F.lit(most(64 * longs, share)) for share in shares(similarity)])
        return sum(each[1:], each[0]) <= F.get(limits, size)

    longs = SKETCH // 64
    # A few bits part most pairs already.
    return (F.least("w", "w_") >= similarity * F.greatest("w", "w_")) & differ(longs // 8) & differ(longs)


def _sets(words: int):
    """Rows (node, text) to rows (node, w, sketch, elements): a shingle that occurs n times gives n elements, so set measures are weighted ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                s, which = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                s, which, times = weighted(s, which)
                nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                element = _mixed(np.repeat(s, times) + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                counts = np.bincount(np.repeat(which, times), minlength=j - i)
                sketch = _list(sketches(element, counts).ravel(), np.full(j - i, SKETCH // 64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts), sketch, _list(element, counts)], names=["node", "w", "sketch", "elements"])

    return work, "node long, w long, sketch array<long>, elements array<long>"


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b), those of at least the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("_left"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("_right"))
    shared = F.size(F.array_intersect("_left", "_right"))
    # Sizes alone rule many pairs out before the sets are compared.
    sizes = F.least(F.size("_left"), F.size("_right")) >= similarity * F.greatest(F.size("_left"), F.size("_right"))
    enough = F.when(sizes, shared >= similarity * (F.size("_left") + F.size("_right") - shared)).otherwise(False)
    empty = (F.size("_left") == 0) & (F.size("_right") == 0)
    return edges.join(left, "a").join(right, "b").where(empty | enough).select("a", "b")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, class of all nodes of ``edges`` (a, b): the least node each can reach.

    Rounds of taking the least label among neighbours and then the label of
    one's label, until nothing changes.
    """
    both = scratch.table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")))
    while True:
        named = both.join(labels.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("_near"))
        lower = labels.join(named, "node").select("node", F.col("class").alias("_old"), F.least("class", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("class").alias("_far"))
        new = scratch.table(lower.join(jump, "_new", "left").select("node", "_old", F.least("_new", "_far").alias("class")))
        labels = new.select("node", "class")
        if new.where("class != _old").isEmpty():
            return labels


def link(signed: DataFrame, texts: DataFrame, scratch: Scratch, *, words: int, similarity: float, small: int, depth: int) -> DataFrame | None:
    """node, class of all nodes that have a near-duplicate; None if there is none."""
    deal = lambda df, *keys: df.select(F.explode("bands").alias("band"), "node", *keys)

    def named(column: str, mark: str = "") -> DataFrame:
        return sets.select(F.col("node").alias(column), *[F.col(c).alias(c + mark) for c in ("w", "sketch")])

    def buckets(dealt: DataFrame) -> DataFrame:
        """key, node, leader, its rank, members of all buckets with several members.

        A bucket is led by the member that meets most others in all buckets:
        of copies that differ from one original each in its own way, the original.
        """
        shared = dealt.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        met = scratch.table(dealt.join(shared, "key"))
        rank = met.groupBy("node").agg(F.sum("members").alias("rank"))
        leaders = met.join(rank, "node").groupBy("key").agg(F.max(F.struct("rank", (-F.col("node")).alias("node"))).alias("lead"))
        return scratch.table(met.join(leaders, "key").select("key", "node", (-F.col("lead.node")).alias("leader"), F.col("lead.rank").alias("rank"), "members"))

    members = buckets(deal(signed).select(F.col("band").alias("key"), "node"))
    work, schema = _sets(words)
    # The candidates' number follows the corpus, so their join is a shuffle at every size.
    candidates = members.select("node").distinct().hint("merge")
    sets = scratch.table(texts.join(candidates, "node").select("node", "text").mapInArrow(tidy(work), schema))
    scratch.release()
    tested: DataFrame | None = None
    links: DataFrame | None = None
    labels: DataFrame | None = None

    def test(pairs: DataFrame) -> None:
        """Verify those likely pairs that have not been, and form the classes anew if they hold links."""
        nonlocal tested, links, labels
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.table(pairs)
        if pairs.isEmpty():
            return
        tested = pairs if tested is None else tested.unionByName(pairs)
        more = scratch.table(verified(pairs, sets, similarity))
        scratch.release()
        if not more.isEmpty():
            links = more if links is None else links.unionByName(more)
            labels = components(links, scratch)

    def classed(df: DataFrame, node: str = "node", name: str = "class") -> DataFrame:
        if labels is None:
            return df.withColumn(name, F.col(node))
        return df.join(labels.select(F.col("node").alias(node), F.col("class").alias("_class")), node, "left").withColumn(name, F.coalesce("_class", node)).drop("_class")

    def across(df: DataFrame, in_blocks: bool = False) -> DataFrame:
        """Likely pairs of a bucket's members outside its most common class with members of other classes.

        A pair that meets in several buckets is made in that of the smallest key
        only.  In blocks, a bucket is many keys of the join: members meet those of
        their own and the next steps of weight, about ``small`` by ``small`` at a time.
        """
        sizes = df.groupBy("key", "class").count()
        largest = F.max(F.struct("count", "class"))
        common = sizes.groupBy("key").agg(largest["class"].alias("most"), *[x for x in ((F.sum("count") - largest["count"]).alias("out"), F.sum("count").alias("all")) if in_blocks])
        keys = df.groupBy("node").agg(F.collect_list("key").alias("keys"))
        rows = df.join(common, "key").join(keys, "node").join(named("node"), "node")
        kept = ["key", "node", "class", "keys", "w", "sketch", (F.col("class") != F.col("most")).alias("apart")]
        on = ["key"]
        if in_blocks:
            # A little wider than the similarity, so that rounding parts no pair; sizes that allow it are a step apart at most.
            step = max(-math.log(max(similarity, 1e-9)), 0.01) * 1.001
            blocks = lambda count: F.ceil(F.col(count) / F.lit(float(small))).cast("int")
            own = lambda count: F.pmod(F.xxhash64(F.lit(count), "node"), blocks(count)).cast("int")
            each = lambda count: F.explode(F.sequence(F.lit(0), blocks(count) - 1))
            rows = rows.withColumn("weight", F.floor(F.log(F.greatest("w", F.lit(1)).cast("double")) / step).cast("int"))
            on = ["key", "weight", "i", "j"]
            left = rows.where("class != most").withColumns({"i": own("out"), "weight": F.explode(F.array(*[F.col("weight") + n for n in (-1, 0, 1)]))}).withColumn("j", each("all")).select(*on[1:], *kept).drop("apart")
            right = rows.withColumns({"j": own("all")}).where("out > 0").withColumn("i", each("out")).select(*on[1:], *kept)
        else:
            rows = rows.select(*kept)
            left, right = rows.where("apart").drop("apart"), rows
        right = right.select(*on, *[F.col(c).alias(f"{c}_") for c in right.columns if c not in on])
        once = (~F.col("apart_") | (F.col("node") < F.col("node_"))) & (F.array_min(F.array_intersect("keys", "keys_")) == F.col("key"))
        pairs = left.join(right, on).where((F.col("class") != F.col("class_")) & likely(similarity) & once)
        return pairs.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b"))

    def still_mixed(df: DataFrame) -> DataFrame:
        """The members, with their classes, of buckets that hold several."""
        now = classed(df)
        mixed = now.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
        return scratch.table(now.join(mixed, "key"))

    large: DataFrame | None = None
    for level in range(depth + 1):
        star = members.where("node != leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.max("rank").alias("rank"))
        star = scratch.table(star.join(named("a"), "a").join(named("b", "_"), "b").where(likely(similarity)).select("a", "b", "rank"))
        # The highest leader first: most others are of the same class then, and need no test.
        test(star.groupBy("b").agg(F.max_by("a", F.struct("rank", -F.col("a"))).alias("a")).select("a", "b"))
        test(classed(classed(star, "a", "ca"), "b", "cb").where("ca != cb").select("a", "b"))
        mixed = still_mixed(members)
        test(across(mixed.where(F.col("members") <= small)))
        many = mixed.where(F.col("members") > small).select("key", "node")
        if large is None:
            large = many
        if level == depth or many.isEmpty():
            break
        # Most near-duplicates in a large bucket agree in further bands; the one that made the bucket parts nothing.
        again = deal(many.join(signed, "node"), "key").where("band != key").select(F.xxhash64("key", "band").alias("key"), "node")
        members = buckets(again)
    if not large.isEmpty():
        test(across(still_mixed(large), in_blocks=True))
    return labels


def _node(id_: Column, t1: Column) -> Column:
    """A document's number: its id, or a negative number from the text's hash."""
    return F.coalesce(id_, -F.shiftrightunsigned(t1, 1) - 1)


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """``docs``' t1, t2 (see :func:`tessera.llm.common.text_key`) with class_id, one row per different text."""
    ensure_columns(docs, id_col, text_col)
    t1, t2 = text_key(F.col("text"))
    rows_ = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumns({"t1": t1, "t2": t2})
    with Scratch(docs.sparkSession, "neardup") as scratch:
        texts = rows_.groupBy("t1", "t2").agg(F.min("id").alias("id"), F.first("text").alias("text"))
        texts = scratch.table(texts.select("t1", "t2", _node(F.col("id"), F.col("t1")).alias("node"), F.lower("text").alias("text")))
        work, schema = _signed(words, n_bands, rows)
        signed = scratch.table(texts.select("node", "text").mapInArrow(tidy(work), schema))
        scratch.release()
        labels = link(signed, texts, scratch, words=words, similarity=similarity, small=small, depth=depth)
        named = texts.select("t1", "t2", "node")
        if labels is not None:
            named = named.join(labels, "node", "left").withColumn("node", F.coalesce("class", "node"))
        return scratch.keep(named.select("t1", "t2", F.when(F.col("node") >= 0, F.col("node")).alias("class_id"), F.col("node").alias("class_key")))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, class_id and kept (is it the class's first document?) of each row of ``docs``."""
    named = classes(docs, id_col=id_col, text_col=text_col, **options)
    t1, t2 = text_key(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), t1.alias("t1"), t2.alias("t2"))
    return rows.join(named, ["t1", "t2"], "left").select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id."""
    named = classes(docs, id_col=id_col, text_col=text_col, **options)
    t1, t2 = text_key(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.withColumns({"_near_1": t1, "_near_2": t2, "_near_node": _node(F.col(id_col).cast("long"), t1)})
    named = named.select(F.col("t1").alias("_near_t1"), F.col("t2").alias("_near_t2"), F.col("class_key").alias("_near_class"))
    kept = rows.join(named, (F.col("_near_1") == F.col("_near_t1")) & (F.col("_near_2") == F.col("_near_t2")) & (F.col("_near_node") == F.col("_near_class")))
    # Rows that share the id as well are one document.
    return kept.dropDuplicates(["_near_node"]).select(*[F.col(f"`{c}`") for c in docs.columns])
