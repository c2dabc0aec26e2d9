"""Best-fit packing of token sequences by a configuration linear program.

Documents are tokenised once, ended with ``eos`` and cut only if longer than a
sequence.  What decides the packing is the histogram of piece lengths, at most
``capacity`` numbers: the configuration LP over it (how many sequences of each
filling) is solved by multiplicative weights, whose pricing step is a knapsack
by dynamic programming, then rounded down; the few pieces this leaves are
packed best-fit by decreasing length, on the histogram as well.  So the
driver's work and memory do not depend on the number of documents.

Prices also bound the number of sequences from below (:func:`lower_bound`, the
LP's dual), which tells how far a packing is from the best.

Pieces find their place by rank within their length.  Ranks are distributed:
each length is dealt into as many buckets as its count asks for, by a number
that each piece has of its own, buckets are ranked inside and offset by the sums
before them, so neither a length that a third of all pieces share nor a text
that a third of all rows repeat is a hot group.

Defined results: a null or empty text is the one piece [eos]; repeated rows are
packed separately; an empty table gives an empty result; further input columns
are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ensure_columns, slices, tidy, utf8

CAPACITY = 1024
EOS = 2
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Texts of other characters, or with what may be a special token, are left to the tokenizer itself.
PLAIN = re.compile("[\\x00-\\u024f\\u2010-\\u2027\\u20ac]*")
ROUNDS = 500
RATES = (0.05, 0.5)
SPREAD = 0.3
KEPT = (1.0, 0.5)
ROWS_PER_BUCKET = 20_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def _ranked(path: str):
    """The same vocabulary as ranks, which encodes plain texts to the same ids in a quarter of the time."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts: list[str], tokenizer: str, ranks: str | None) -> list[list[int]]:
    """Token ids of texts, as the file ``tokenizer`` gives them; ``ranks`` is its vocabulary as ranks, if there is one."""
    if ranks is None:
        whole = _tokenizer(tokenizer)
        return [e.ids for e in getattr(whole, "encode_batch_fast", whole.encode_batch)(texts, add_special_tokens=False)]
    plain = _ranked(ranks).encode_ordinary
    return [plain(t) if "<|" not in t and PLAIN.fullmatch(t) else _tokenizer(tokenizer).encode(t, add_special_tokens=False).ids for t in texts]


def pieces(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, eos: int = EOS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of each piece.

    A document longer than ``capacity`` is cut into pieces of that length, of
    which the first is the shorter one.
    """
    ensure_columns(docs, id_col, text_col)
    # A tokenizer of the caller's own comes without ranks.
    path, ranks = tokenizer or tokenizer_path(), None if tokenizer else ranks_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            _, offsets = utf8(texts)
            for i, j in slices(offsets, 1 << 19):
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, found in enumerate(encode(texts.slice(i, j - i).to_pylist(), path, ranks)):
                    tokens = np.array([*found, eos], "<u4")
                    n = len(tokens)
                    head = n % capacity or capacity
                    for p, (a, b) in enumerate([(0, head), *((x, x + capacity) for x in range(head, n, capacity))]):
                        part = tokens[a:b]
                        row.append(k)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(part.tobytes()))
                        kept.append(part.astype(np.int32)) if with_ids else None
                columns = [ids.slice(i, j - i).take(pa.array(row, pa.int32())), piece, start, length, crc] + [kept] * with_ids
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(tidy(work), schema)


def best_filling(values: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable multiset of ``lengths`` (ascending) in ``capacity``: unbounded knapsack by dynamic programming."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gains = best[c - lengths[:k]] + values[:k]
            i = int(gains.argmax())
            if gains[i] > best[c]:
                best[c], choice[c] = gains[i], i
    filling: dict[int, int] = {}
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            i = int(choice[c])
            filling[i] = filling.get(i, 0) + 1
            c -= int(lengths[i])
    return filling


def solve_lp(counts: np.ndarray, capacity: int, rate: float, rounds: int = ROUNDS) -> dict[tuple[tuple[int, int], ...], float]:
    """A fractional solution of the configuration LP: filling -> how many sequences.

    Multiplicative weights: a length's price starts a little above in
    proportion to its size (long pieces fit fewer fillings) and is multiplied by
    exp(rate * lag), lag being how far its cover trails that of the whole; the
    filling of greatest price gets the next share of sequences, at most what any
    length in it still needs, so no length is covered twice.
    """
    lengths = np.flatnonzero(counts)
    need = counts[lengths].astype(float)
    left = need.copy()
    bins = max(1.0, float((need * lengths).sum()) / capacity)
    step, done = bins / rounds, 0.0
    found: dict[tuple[tuple[int, int], ...], float] = {}
    while True:
        open_ = np.flatnonzero(left > 1e-9)
        if not len(open_):
            return found
        lag = left[open_] / need[open_] - max(0.0, 1 - done / bins)
        filling = best_filling(lengths[open_] * (1 + SPREAD * lengths[open_] / capacity) * np.exp(rate * lag), lengths[open_], capacity)
        used = np.array([open_[i] for i in filling])
        many = np.array([filling[i] for i in filling])
        amount = min(max(step, 1e-6), float((left[used] / many).min()))
        left[used] -= amount * many
        left[left < 1e-9] = 0
        done += amount
        key = tuple(sorted(zip(lengths[used].tolist(), many.tolist(), strict=True), reverse=True))
        found[key] = found.get(key, 0.0) + amount


def lower_bound(counts: np.ndarray, capacity: int, prices: np.ndarray | None = None) -> float:
    """Fewer sequences cannot hold the pieces: what all are worth at ``prices`` (by length; their size if None) over the most that one filling is."""
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return 0.0
    values = (lengths if prices is None else prices[lengths]).astype(float)
    filling = best_filling(values, lengths, capacity)
    return float(counts[lengths] @ values / sum(values[i] * n for i, n in filling.items()))


def best_fit(counts: np.ndarray, capacity: int) -> dict[tuple[tuple[int, int], ...], int]:
    """Best-fit decreasing on a histogram: filling -> how many sequences. Works on kinds of open sequences, not on pieces."""
    open_: list[dict[tuple[tuple[int, int], ...], int]] = [{} for _ in range(capacity + 1)]
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            room = next((r for r in range(size, capacity) if open_[r]), None)
            if room is None:
                each = min(capacity // size, left)
                many = left // each
                filling, taken = ((size, each),), each * many
                open_[capacity - size * each][filling] = open_[capacity - size * each].get(filling, 0) + many
                left -= taken
                continue
            filling, many = next(iter(open_[room].items()))
            each = min(room // size, left)
            use = min(many, left // each)
            open_[room][filling] -= use
            if not open_[room][filling]:
                del open_[room][filling]
            grown = (*filling, (size, each))
            rest = room - size * each
            open_[rest][grown] = open_[rest].get(grown, 0) + use
            left -= use * each
    return {f: n for kinds in open_ for f, n in kinds.items()}


def plan(counts: np.ndarray, capacity: int = CAPACITY, rates: tuple[float, ...] = RATES, rounds: int = ROUNDS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Fillings and how many sequences get each, for a histogram by length (index 0 to ``capacity``)."""
    counts = np.asarray(counts, np.int64).copy()
    full, counts[capacity] = int(counts[capacity]), 0
    best: dict | None = None
    for rate in rates:
        solved = solve_lp(counts, capacity, rate, rounds)
        for kept in KEPT:  # how much of the solution is kept; best-fit packs the rest, which matters for few pieces only
            whole = {f: int(x * kept + 1e-6) for f, x in solved.items()}
            left = counts.copy()
            for filling, n in whole.items():
                for size, each in filling:
                    left[size] -= each * n
            for filling, n in best_fit(left, capacity).items():
                whole[filling] = whole.get(filling, 0) + n
            if best is None or sum(whole.values()) < sum(best.values()):
                best = whole
    fillings = [(f, n) for f, n in (best or {}).items() if n]
    return fillings + [(((capacity, 1),), full)] * bool(full)


def places(fillings: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """Sorted by (length, first rank): which ranks of a length go to which sequences and offsets."""
    rows, ranks, sequence = [], {}, 0
    for filling, n in fillings:
        offset = 0
        for size, each in filling:
            rows.append((size, ranks.get(size, 0), sequence, each, offset))
            ranks[size] = ranks.get(size, 0) + each * n
            offset += size * each
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T.copy(), strict=True))


def pack(docs: DataFrame, *, capacity: int = CAPACITY, rates: tuple[float, ...] = RATES, with_ids: bool = False, **options) -> DataFrame:
    """The columns of :func:`pieces`, sequence_id and offset of each piece."""
    spark = docs.sparkSession
    with Scratch(spark, "packing") as scratch:
        cut = scratch.table(pieces(docs, capacity=capacity, with_ids=with_ids, **options).withColumn("_nth", F.monotonically_increasing_id()))
        counts = np.zeros(capacity + 1, np.int64)
        for length, n in cut.groupBy("length").count().collect():
            counts[length] = n
        table = places(plan(counts, capacity, rates))
        parts = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // ROWS_PER_BUCKET))) for n in counts]), (F.col("length") + 1).cast("int"))
        dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("_nth"), parts))
        before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = dealt.groupBy("length", "_bucket").count().select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
        inside = Window.partitionBy("length", "_bucket").orderBy("_nth")
        ranked = dealt.withColumn("_rank", F.row_number().over(inside)).join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1).drop("_bucket", "_before")
        kinds = [(n, t) for n, t in cut.dtypes if n != "_nth"]
        names = [n for n, _ in kinds]
        ranked = ranked.select("length", "_rank", *[n for n in names if n != "length"])
        schema = f"{', '.join(f'{n} {t}' for n, t in kinds)}, sequence_id bigint, offset bigint"

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts = table["length"] * (1 << 48) + table["rank"]
            for batch in batches:
                length, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
                at = np.searchsorted(starts, length * (1 << 48) + rank, "right") - 1
                within = rank - table["rank"][at]
                sequence = table["sequence"][at] + within // table["each"][at]
                offset = table["offset"][at] + within % table["each"][at] * length
                found = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
                yield pa.RecordBatch.from_arrays([*found.values(), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

        return scratch.keep(ranked.mapInArrow(tidy(place), schema))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the token sequences of a packing made with ``with_ids``."""
    ensure_columns(packed, "ids", "sequence_id", "offset")
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
