"""Suffix-array deduplication: bytes covered by strings that start in two places.

A string of ``span`` bytes is a repeat if it starts anywhere else too, in the
same document or in another; every byte of it goes, judged on the input.

Equal strings meet in four steps, none of which needs the corpus in one place:

1. Texts that are equal as a whole become one with a count.
2. Each text is cut into runs of consecutive windows (strings of ``span`` bytes)
   whose minimizer, the gram of ``gram`` bytes with the least hash in the
   window, is the same occurrence.  Every window lies in one run, and equal
   windows have equal minimizers.  Runs whose minimizer occurs once in the
   corpus are done: a shuffle of hashes, about 1 % of the text.
3. What is left is joined with the text and dealt by minimizer.  Equal runs are
   one with a count; the different ones of a minimizer are sorted together by a
   suffix array (:mod:`.suffixes`) over content-defined phrases, and neighbours
   in it tell which windows repeat.
4. Where more than ``crowd`` different runs share a minimizer (a passage in very
   many texts), the group is split, not sorted in one task: a run's windows fall
   into those that begin nearer to the minimizer and those that begin farther
   from it, and each half has a longer string in common, by which it is dealt
   anew (:func:`_crowded`).  Halves go on being halved until no group is too
   large for 3., which decides here too.

Passages can be counted in words as well (:func:`word_spans`): each word becomes
a code of WORD bytes, and equal strings of codes are found in the same way.

Defined results: a null text is empty; texts shorter than ``span`` keep all;
repeated rows are copies, so they go as a whole if long enough; an empty table
gives an empty result; further columns are ignored by :func:`report` and kept by
:func:`remove`; very long texts are cut into runs CHUNK bytes at a time.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_of, ensure_columns, slices, text_key, tidy, utf8
from .suffixes import suffix_array

SPAN = 400
GRAM = 128
CROWD = 2_000
CHUNK = 1 << 19
PLACE = 20
BLOCK = 1 << 19
TRIGGER = 8
PHRASE = 32
WORD = 6
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

RUN = "h long, d1 long, d2 long, t1 long, t2 long, starts array<long>, windows int, mark int"
_RUN = pa.schema([("h", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("starts", pa.list_(pa.int64())), ("windows", pa.int32()), ("mark", pa.int32())])
HALF = "h long, d1 long, d2 long, shift int, mark int, bytes binary, first int, low int, high int, group long, e1 long, e2 long"
_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


# ---- hashes of grams ---------------------------------------------------------------------------


@lru_cache(1)
def _tables() -> tuple[np.ndarray, int, int]:
    """A random value for each byte, an odd multiplier and its inverse modulo 2**64."""
    rng = np.random.default_rng(20_240_229)
    multiplier = int(rng.integers(0, 2**62)) * 2 + 1
    return rng.integers(0, 2**64, 256, np.uint64), multiplier, pow(multiplier, -1, 2**64)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    _, up, down = _tables()
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (up, down))


class Hashes:
    """Polynomial hashes of all substrings of ``data``, equal for equal ones wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _powers(max(1 << (n + 1).bit_length(), 1 << 16))
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_tables()[0][data] * up[:n], out=self.prefix[1:])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.prefix) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return _mixed((self.prefix[size:] - self.prefix[:n]) * self.down[:n])

    def at(self, start: np.ndarray, size: int) -> np.ndarray:
        return _mixed((self.prefix[start + size] - self.prefix[start]) * self.down[start])


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


# ---- runs of windows with one minimizer -----------------------------------------------------------


def runs(data: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs in texts side by side: first window, number of windows, place of the minimizer, its hash."""
    n, w = len(data), span - gram + 1
    ends = offsets[1:] - span
    counts = np.maximum(0, ends - offsets[:-1] + 1)
    total = int(counts.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    hashed = Hashes(data).grams(gram)
    if n >> PLACE:
        raise ValueError(f"runs are cut of at most {1 << PLACE} bytes at a time")
    # A fixed number of bits, so that equal windows choose alike whatever stands around them.
    bits = np.uint64(PLACE)
    # Hash above, place below: ties go to the leftmost, which equal windows agree on.
    keys = (hashed >> bits << bits) | np.arange(len(hashed), dtype=np.uint64)
    keys = np.concatenate([keys, np.full(-len(keys) % w, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(keys, axis=1).ravel()
    behind = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)
    least = np.minimum(behind[first], ahead[first + w - 1]) & ((np.uint64(1) << bits) - np.uint64(1))
    least = least.astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 1) | (np.diff(least) != 0)]))
    # A run must not go on into the next text, where windows can be adjacent only if texts are shorter than a window.
    length = np.diff(np.concatenate([cut, [total]]))
    return first[cut], length, least[cut], hashed[least[cut]]


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    digest = hashlib.blake2b
    joined = b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(joined, np.int64).reshape(-1, 2)


def _cut_runs(span: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(i).to_numpy() for i in (0, 1))
            data, offsets = utf8(batch.column(2))
            for i, j in slices(offsets, CHUNK):
                low, high = int(offsets[i]), int(offsets[j])
                # One very long text is gone through in parts that share span - 1 bytes, so no window is lost or doubled.
                parts = [(a, min(a + CHUNK + span - 1, high)) for a in range(low, max(low + 1, high - span + 1), CHUNK)] if j - i == 1 else [(low, high)]
                for a, b in parts:
                    part = data[a:b]
                    bounds = np.array([0, b - a]) if j - i == 1 else offsets[i : j + 1] - low
                    start, windows, mark, h = runs(part, bounds, span, gram)
                    if not len(start):
                        continue
                    doc = np.searchsorted(bounds, start, "right") - 1
                    digest = _digests(part, start, start + windows + span - 1)
                    place = start + a - offsets[i + doc] if j - i > 1 else start + a - low
                    # Equal runs of a text, which words said over and over make, are one row.
                    order = np.lexsort((digest[:, 1], digest[:, 0], doc))
                    d, n = digest[order], doc[order]
                    new = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (d[1:] != d[:-1]).any(axis=1)]))
                    first, own = order[new], i + n[new]
                    starts = pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(order)]]).astype(np.int32)), pa.array(place[order]))
                    yield batch_of(_RUN, h[first].view(np.int64), digest[first, 0], digest[first, 1], t1[own], t2[own], starts, windows[first].astype(np.int32), (mark - start)[first].astype(np.int32))

    return work


# ---- which windows of different runs are equal ------------------------------------------------------


def repeated_windows(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray, span: int) -> np.ndarray:
    """For each byte of strings side by side: does a window start there that also starts in another string?

    ``marks`` are the places of the strings' minimizers, which every window
    contains.  Phrases begin there and where the hash of TRIGGER bytes says so,
    so equal windows are cut alike.  The suffix array of the phrase sequence
    brings windows together that agree from their first phrase on; what they
    have before it is looked up by hash and compared.
    """
    n = len(data)
    flags = np.zeros(n, bool)
    hashes = Hashes(data)
    end_of = np.repeat(offsets[1:], np.diff(offsets))
    begins = np.zeros(n, bool)
    triggers = np.flatnonzero((hashes.grams(TRIGGER) >> np.uint64(40)) % np.uint64(PHRASE) == 0)
    begins[triggers[triggers + TRIGGER <= end_of[triggers]]] = True
    begins[offsets[:-1] + marks] = True
    starts = np.flatnonzero(begins)
    end = end_of[starts]
    following = np.concatenate([starts[1:], [n]])
    last = following >= end
    stop = np.where(last, end, np.minimum(following + TRIGGER, end))
    raw = data.tobytes()
    phrases = [raw[a:b] for a, b in zip(starts.tolist(), stop.tolist(), strict=True)]
    rank = {p: k for k, p in enumerate(sorted(set(phrases)), 1)}
    # symbols: the phrases of each string and then 0
    at = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(last)[:-1]])
    symbols = np.zeros(len(starts) + int(last.sum()), np.int64)
    symbols[at] = [rank[p] for p in phrases]
    back = np.full(len(symbols), -1)
    back[at] = np.arange(len(starts))
    order = back[suffix_array(symbols)]
    order = order[order >= 0]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))

    sorted_starts, room = starts[order], (end - starts)[order]
    common = np.zeros(len(order), np.int64)  # with the suffix before, at most span
    reach = np.arange(span)
    for a in range(1, len(order), 2048):
        b = min(a + 2048, len(order))
        here = data[np.minimum(sorted_starts[a:b, None] + reach, n - 1)]
        there = data[np.minimum(sorted_starts[a - 1 : b - 1, None] + reach, n - 1)]
        differ = here != there
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), span)
        common[a:b] = np.minimum(same, np.minimum(room[a:b], room[a - 1 : b - 1]))

    window = np.flatnonzero(np.arange(n) + span <= end_of)
    phrase = np.searchsorted(starts, window)
    before = starts[phrase] - window
    by_before = np.argsort(before, kind="stable")
    sizes = before[by_before]
    edges = np.flatnonzero(np.concatenate([[True], np.diff(sizes) != 0, [True]])) if len(sizes) else np.zeros(0, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        r = int(sizes[a])
        chosen = by_before[a:b]
        cluster = np.cumsum(common < span - r)[place[phrase[chosen]]].astype(np.uint64)
        key = _mixed(hashes.at(window[chosen], r) + cluster * np.uint64(0xD1B54A32D192ED03)) if r else cluster
        _, sample, which, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[which] > 1)
        for i in range(0, len(again), 1 + (1 << 22) // max(r, 1)):
            part = again[i : i + 1 + (1 << 22) // max(r, 1)]
            here, there = (data[window[chosen[x]][:, None] + np.arange(r)] for x in (part, sample[which[part]]))
            if (here != there).any():  # two strings of one hash: the bytes themselves are the key
                exact = [(raw[w : w + r], c) for w, c in zip(window[chosen].tolist(), cluster.tolist(), strict=True)]
                seen = Counter(exact)
                again = np.flatnonzero([seen[x] > 1 for x in exact])
                break
        flags[window[chosen[again]]] = True
    return flags


def _ranges(flags: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Runs of true values in each string, first and last place, relative to it."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    # strings end at least span - 1 bytes after their last window, so no run crosses into another
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    owner = np.searchsorted(offsets, first, "right") - 1
    counts = np.bincount(owner, minlength=len(offsets) - 1) if len(first) else np.zeros(len(offsets) - 1, np.int64)
    items = pa.StructArray.from_arrays([pa.array((first - offsets[owner]).astype(np.int32)), pa.array((last - offsets[owner]).astype(np.int32))], ["a", "b"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), items)


def _sort_blocks(span: int, named: str):
    """Rows (group, the columns ``named``, mark, bytes) sorted by group, in blocks of whole groups; gives ``named`` and ranges."""
    names = [c.split()[0] for c in named.split(", ")]

    def solve(rows: pa.Table) -> pa.RecordBatch:
        data, offsets = utf8(rows.column("bytes").combine_chunks())
        flags = repeated_windows(data, offsets, rows.column("mark").to_numpy().astype(np.int64), span)
        return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in names), _ranges(flags, offsets).cast(_RANGES)], names=[*names, "ranges"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            group = table.column("group").to_numpy()
            _, offsets = utf8(batch.column(batch.schema.get_field_index("bytes")))
            at = 0
            while at < len(group):
                # up to the first change of group after a block's worth of bytes
                full = int(np.searchsorted(offsets, offsets[at] + max(0, BLOCK - sum(t.nbytes for t in held)), "left"))
                change = np.flatnonzero(group[max(full, at + 1) :] != group[max(full, at + 1) - 1 : -1])
                if not len(change):
                    held.append(table.slice(at))
                    break
                to = max(full, at + 1) + int(change[0])
                yield solve(pa.concat_tables([*held, table.slice(at, to - at)]))
                held, at = [], to
        if held:
            yield solve(pa.concat_tables(held))

    return work, f"{named}, ranges array<struct<a:int,b:int>>"


# ---- DataFrames ---------------------------------------------------------------------------------


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """t1, t2, text, copies of the different texts of ``docs``."""
    ensure_columns(docs, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t1, t2 = text_key(F.col("text"))
    return docs.select(text.alias("text")).withColumns({"t1": t1, "t2": t2}).groupBy("t1", "t2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def _run_bytes(span: int, step: int):
    """Rows (text, list of runs) to rows (h, d1, d2, mark, bytes, first): the first window at a multiple of ``step`` of the text."""
    schema = pa.schema([("h", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("mark", pa.int32()), ("bytes", pa.binary()), ("first", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            wanted = batch.column(1)
            item = wanted.flatten()
            owner = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
            start = item.field("start").to_numpy(zero_copy_only=False) + offsets[owner]
            stop = start + item.field("windows").to_numpy(zero_copy_only=False) + span - 1
            raw = data.tobytes()
            for i, j in slices(np.concatenate([[0], np.cumsum(stop - start)]), BLOCK):
                pieces = [raw[a:b] for a, b in zip(start[i:j].tolist(), stop[i:j].tolist(), strict=True)]
                part = item.slice(i, j - i)
                first = -part.field("start").to_numpy(zero_copy_only=False) % step
                yield batch_of(schema, *(part.field(c) for c in ("h", "d1", "d2", "mark")), pieces, first.astype(np.int32))

    return work, "h long, d1 long, d2 long, mark int, bytes binary, first int"


def _halves(span: int, step: int):
    """Rows of HALF without group, e1 and e2 to those of their two halves that hold windows."""
    fields = [("h", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("shift", pa.int32()), ("mark", pa.int32()), ("bytes", pa.binary()), ("first", pa.int32()), ("low", pa.int32()), ("high", pa.int32())]
    schema = pa.schema([*fields, ("group", pa.int64()), ("e1", pa.int64()), ("e2", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [batch.column(c).to_numpy() for c in ("h", "d1", "d2")]
            shift, mark, first, low, high = (batch.column(c).to_numpy().astype(np.int64) for c in ("shift", "mark", "first", "low", "high"))
            data, offsets = utf8(batch.column("bytes"))
            raw = data.tobytes()
            least = mark - (np.diff(offsets) - span)
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                top, bottom = np.minimum(b, mark), np.maximum(a, least)
                begin = (first - (mark - top)) % step
                some = np.flatnonzero((a <= b) & (begin <= top - bottom))
                at = (offsets[:-1] + mark)[some]
                own = [raw[x:y] for x, y in zip((at - top[some]).tolist(), (at - bottom[some] + span).tolist(), strict=True)]
                common = [b"%d " % n + raw[x:y] for n, x, y in zip(a[some].tolist(), (at - a[some]).tolist(), (at - b[some] + span).tolist(), strict=True)]
                group = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=8).digest() for x in common]), np.int64)
                same = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in own]), np.int64).reshape(-1, 2)
                numbers = [x.astype(np.int32) for x in ((shift + mark - top)[some], top[some], begin[some], a[some], b[some])]
                yield batch_of(schema, *(k[some] for k in key), *numbers[:2], pa.array(own, pa.binary()), *numbers[2:], group, same[:, 0].copy(), same[:, 1].copy())

    return work, HALF


def _crowded(runs_: DataFrame, scratch: Scratch, *, span: int, gram: int, crowd: int, step: int) -> DataFrame:
    """h, d1, d2, ranges of runs (h, d1, d2, mark, bytes, first) of which too many share a minimizer.

    The windows that begin ``low`` to ``high`` bytes before the minimizer have
    the bytes in common that lie in all of them; the narrower that range, the
    more there are, so halving it parts a group until only equal windows are
    left together.  Halves that are alone in their group go, equal ones become
    one, and groups of up to ``crowd`` different ones are sorted.  A row brings
    two at most for each halving, of which there are as many as the range has bits.
    """
    work, schema = _halves(span, step)
    sort, sorted_schema = _sort_blocks(span, "h long, d1 long, d2 long, shift int")
    kind, key = ["group", "e1", "e2"], ["h", "d1", "d2"]
    moved = F.transform("ranges", lambda x: F.struct((F.col("shift") + x["a"]).alias("a"), (F.col("shift") + x["b"]).alias("b")))
    whole = F.array(F.struct(F.col("shift").alias("a"), (F.col("shift") + F.octet_length("bytes") - span).alias("b")))
    found: DataFrame | None = None
    rows = runs_.select(*key, F.lit(0).alias("shift"), "mark", "bytes", "first", F.lit(0).alias("low"), F.lit(span - gram).alias("high"))
    plain = rows.columns
    while True:
        rows = scratch.table(rows.mapInArrow(tidy(work), schema))
        kinds = scratch.table(rows.groupBy(*kind).agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in plain]))
        several = rows.join(kinds.where("times > 1").select(*kind), kind).select(*key, whole.alias("ranges"))
        width = kinds.groupBy("group").count().where("count > 1")
        few = kinds.join(width.where(F.col("count") <= crowd).select("group"), "group").select("group", *key, "shift", "mark", "bytes")
        alike = few.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(sort), sorted_schema).where(F.size("ranges") > 0).select(*key, moved.alias("ranges"))
        here = several.unionByName(alike)
        found = scratch.table(here if found is None else found.unionByName(here))
        crowds = scratch.table(width.where(F.col("count") > crowd).select("group"))
        if crowds.isEmpty():
            return found
        rows = kinds.join(crowds, "group", "left_semi").select(*plain)


def repeated_spans(texts: DataFrame, scratch: Scratch, *, span: int = SPAN, gram: int = GRAM, crowd: int = CROWD, step: int = 1) -> DataFrame:
    """t1, t2, spans of the texts of :func:`distinct_texts` in which a span repeats.

    Texts of codes of ``step`` bytes need windows at whole codes only.

    ``spans`` are byte ranges array<struct<start:bigint,stop:bigint>>, neither
    sorted nor merged (see :func:`merged`); copies are one range over the whole.
    """
    if not 1 <= gram < span:
        raise ValueError("gram must be shorter than span")
    key = ["h", "d1", "d2"]
    long_ = texts.where(F.octet_length("text") >= span)
    occurrences = scratch.table(long_.select("t1", "t2", "text").mapInArrow(tidy(_cut_runs(span, gram)), RUN))
    shared = occurrences.groupBy("h").agg(F.sum(F.size("starts")).alias("count")).where("count > 1").select("h")
    alike = scratch.table(occurrences.join(shared, "h"))
    scratch.drop(occurrences)

    first = [F.first(c).alias(c) for c in ("t1", "t2", "start", "windows", "mark")]
    counted = alike.withColumns({"start": F.get("starts", F.lit(0)), "n": F.size("starts")}).drop("starts")
    kinds = scratch.table(counted.groupBy(*key).agg(F.sum("n").alias("times"), *first))
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") - 1).alias("b")))
    several = kinds.where("times > 1").select(*key, whole.alias("ranges"))

    width = kinds.groupBy("h").count().where("count > 1")
    mixed = kinds.join(width, "h")
    wanted = mixed.groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "d1", "d2", "start", "windows", "mark")).alias("wanted"))
    work, schema = _run_bytes(span, step)
    content = scratch.table(long_.join(wanted, ["t1", "t2"]).select("text", "wanted").mapInArrow(tidy(work), schema))
    crowds = width.where(F.col("count") > crowd).select("h")
    work, schema = _sort_blocks(span, "h long, d1 long, d2 long")
    grouped = content.join(crowds, "h", "left_anti").select(F.col("h").alias("group"), *key, "mark", "bytes")
    sorted_ = grouped.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(work), schema)
    found = several.unionByName(sorted_.where(F.size("ranges") > 0))
    if not crowds.isEmpty():
        found = found.unionByName(_crowded(content.join(crowds, "h", "left_semi"), scratch, span=span, gram=gram, crowd=crowd, step=step))
    found = scratch.table(found)

    at = F.flatten(F.transform("starts", lambda s: F.transform("ranges", lambda x: F.struct((s + x["a"]).alias("start"), (s + x["b"] + span).alias("stop")))))
    parts = alike.join(found, key).select("t1", "t2", at.alias("part"))
    spans = parts.groupBy("t1", "t2").agg(F.flatten(F.collect_list("part")).alias("spans"))
    copies = long_.where("copies > 1").select("t1", "t2", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("stop"))).alias("spans"))
    return spans.join(copies.select("t1", "t2"), ["t1", "t2"], "left_anti").unionByName(copies)


# ---- passages counted in words --------------------------------------------------------------------


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word of texts side by side, and the number of words before each text."""
    inside = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # no word goes on into the next text
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside])[:-1]))
    stop = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside, [False]])[1:])) + 1
    return start, stop, np.searchsorted(start, offsets)


def _word_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t1, t2, copies, text): the text's words become WORD bytes each of their hash."""
    for batch in batches:
        data, offsets = utf8(batch.column(3))
        for i, j in slices(offsets, CHUNK):
            part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            start, stop, before = word_bounds(part, bounds)
            hashes = Hashes(part)
            codes = _mixed((hashes.prefix[stop] - hashes.prefix[start]) * hashes.down[start]).view(np.uint8).reshape(-1, 8)[:, 8 - WORD :]
            buffers = [None, pa.py_buffer((before * WORD).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(codes))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), pa.Array.from_buffers(pa.binary(), j - i, buffers)], names=["t1", "t2", "copies", "text"])


def _word_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t1, t2, text, spans of codes): the spans become bytes of the text."""
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for i, j in slices(offsets, CHUNK):
            bounds = offsets[i : j + 1] - offsets[i]
            start, stop, before = word_bounds(data[offsets[i] : offsets[j]], bounds)
            spans = batch.column(3).slice(i, j - i)
            item, counts = spans.flatten(), spans.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(j - i), counts)
            first, last = (item.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
            # The codes beside a passage may go on alike for some bytes by chance; whole ones count.
            first, last = -(-first // WORD), last // WORD
            some = first < last
            first, last, owner = first[some], last[some], owner[some]
            first, last = start[before[owner] + first] - bounds[owner], stop[before[owner] + last - 1] - bounds[owner]
            counts = np.bincount(owner, minlength=j - i)
            item = pa.StructArray.from_arrays([pa.array(first), pa.array(last)], ["start", "stop"])
            found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), item)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(2)), found], schema=schema)


def word_spans(texts: DataFrame, scratch: Scratch, *, words: int, crowd: int = CROWD) -> DataFrame:
    """As :func:`repeated_spans`, of passages of so many ``words`` (parted by ASCII white space, of whatever length).

    Codes are made anew where they are needed, since they take the room of the texts.
    """
    span = words * WORD
    coded = texts.select("t1", "t2", "copies", "text").mapInArrow(tidy(_word_codes), "t1 long, t2 long, copies long, text binary")
    spans = repeated_spans(coded, scratch, span=span, gram=min(GRAM, (span + 2) // 3), crowd=crowd, step=WORD)
    return texts.join(spans, ["t1", "t2"]).select("t1", "t2", "text", "spans").mapInArrow(tidy(_word_bytes), "t1 long, t2 long, spans array<struct<start:bigint,stop:bigint>>")


# ---- removal --------------------------------------------------------------------------------------


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of byte ranges, ascending, of an array of (start, stop)."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])]], axis=1)


def kept(text: bytes, runs_: np.ndarray) -> bytes:
    bounds = [0, *runs_.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))


def _each(texts: pa.Array, spans: pa.Array) -> Iterator[tuple[bytes, np.ndarray] | None]:
    """Each text's bytes and merged spans; None where nothing repeats."""
    data, offsets = utf8(texts)
    item = spans.flatten()
    both = np.stack([item.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop")], axis=1) if len(item) else np.zeros((0, 2), np.int64)
    counts = np.array([0 if n is None else n for n in spans.value_lengths().to_pylist()], np.int64)
    ends = np.cumsum(counts)
    for k, n in enumerate(counts):
        yield (data[offsets[k] : offsets[k + 1]].tobytes(), merged(both[ends[k] - n : ends[k]])) if n else None


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``."""
    ensure_columns(docs, id_col, text_col)
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(int((r[:, 1] - r[:, 0]).sum()), len(r), hashlib.sha256(kept(t, r)).hexdigest()) for t, r in _each(batch.column(2), batch.column(3))]
            yield batch_of(schema, batch.column(0), batch.column(1), *zip(*rows, strict=True))

    with Scratch(docs.sparkSession, "repeats") as scratch:
        texts = scratch.table(distinct_texts(docs, text_col))
        spans = repeated_spans(texts, scratch, **options)
        judged = texts.join(spans, ["t1", "t2"]).select("t1", "t2", "text", "spans").mapInArrow(tidy(work), "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string")
        judged = scratch.keep(judged)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t1, t2 = text_key(F.col("_text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).select("doc_id", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("_sha"), t1.alias("t1"), t2.alias("t2"))
    return rows.join(judged, ["t1", "t2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256")
    )


def remove(docs: DataFrame, *, text_col: str = "text", count_col: str | None = "n_chars", words: int | None = None, **options) -> DataFrame:
    """``docs`` with the repeats gone from the text; where a cut splits a character, its rest goes too.

    With ``words``, passages of so many words that repeat are repeats too.
    ``count_col``, if the table has it, is the number of characters and follows
    the text.  Rows whose text is left without a visible character are dropped.
    """
    ensure_columns(docs, text_col)
    with Scratch(docs.sparkSession, "repeats") as scratch:
        texts = scratch.table(distinct_texts(docs, text_col))
        with Scratch(docs.sparkSession, "repeats") as inner:
            spans = scratch.table(repeated_spans(texts, inner, **options))
        if words is not None:
            scratch.release()
            said = word_spans(texts, scratch, words=words, **{k: v for k, v in options.items() if k == "crowd"})
            spans = spans.unionByName(said).groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        spans = scratch.keep(spans.select(F.col("t1").alias("_rep_1"), F.col("t2").alias("_rep_2"), F.col("spans").alias("_rep_spans")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_ = batch.column(0)
            new = [None if x is None else kept(*x).decode("utf-8", "ignore") for x in _each(texts_, batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), *batch.columns[2:]], names=["_rep_new", *batch.schema.names[2:]])

    t1, t2 = text_key(F.coalesce(F.col(text_col), F.lit("")))
    named = docs.withColumns({"_rep_k1": t1, "_rep_k2": t2})
    joined = named.join(spans, (F.col("_rep_k1") == F.col("_rep_1")) & (F.col("_rep_k2") == F.col("_rep_2")), "left")
    plain = [f"`{c}`" for c in docs.columns]
    schema = ", ".join(["_rep_new string"] + [f"`{c}` {t}" for c, t in docs.dtypes])
    cut = joined.select(F.col(text_col).alias("_rep_text"), "_rep_spans", *plain).mapInArrow(tidy(work), schema)
    cut = cut.where(F.col("_rep_new").isNull() | F.col("_rep_new").rlike("\\S"))
    out = []
    for c, t in docs.dtypes:
        if c == text_col:
            out.append(F.coalesce("_rep_new", c).alias(c))
        elif c == count_col:
            out.append(F.when(F.col("_rep_new").isNotNull(), F.length("_rep_new")).otherwise(F.col(c)).cast(t).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return cut.select(*out)
