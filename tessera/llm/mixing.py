"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed pseudo-random order, run
through up to ``max_epochs`` times.  A document's virtual finish time is its
source's cumulative tokens, earlier epochs included, over the source's target.
All queue entries together are sorted by that time and cut where the total
budget (the corpus' own size) is spent, so each source ends near its target.

Texts are read once, to be counted; all the rest is done on slim rows, and both
sorts are range sorts whose parts are summed up, so neither a source nor the
whole order is one task's:

1. Rows are dealt by range of (source, shuffle key, hash of the row, number), a
   running sum in each part and the sums of the parts before it give cumulative
   sizes.  The number tells repeated rows apart, so they spread like others.
2. Entries (a row in an epoch) are range-sorted by finish time.  The sums of the
   parts tell in which of them the budget runs out, and a running sum in that
   part tells where.

:func:`take` needs no shuffle of texts: what is taken of a source in an epoch is
the beginning of its order, up to a last row that is the same for all.

Defined results: a null text has size 0; the null source is last; documents of
size 0 are never taken; repeated rows are separate documents of equal order
(their order among themselves does not show); an empty table gives an empty
result; :func:`mix` ignores further columns, :func:`take` keeps them, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ensure_columns, quoted

WORD = "[^\\x20\\x09-\\x0D]+"
MAX_EPOCHS = 3
SEED = "mix"
SOURCES = 10_000
COPIES = 10_000


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    weight: int
    target: float
    rank: int


def fill_targets(sizes: list[tuple[str | None, int]], weights: list[int], max_epochs: int = MAX_EPOCHS) -> list[Source]:
    """Share the total by weight; a target stops at ``max_epochs`` times its source's size and the rest is shared again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {i: weights[i % len(weights)] for i in range(len(order))}
    left, open_, target = sum(s for _, s in order), set(weight), {}
    while open_:
        total = sum(weight[i] for i in open_)
        over = {i for i in open_ if float(left) * weight[i] / total > max_epochs * order[i][1]}
        for i in over or open_:
            target[i] = float(max_epochs * order[i][1]) if over else float(left) * weight[i] / total
        if not over:
            break
        left -= sum(max_epochs * order[i][1] for i in over)
        open_ -= over
    return [Source(n, s, weight[i], target[i], i) for i, (n, s) in enumerate(order)]


def _named(docs: DataFrame, seed: str, id_col: str) -> dict[str, Column]:
    """Where a row stands in its source's queue: a key made of its id, then a hash of the whole row."""
    plain = [F.to_json(F.struct(quoted(c))) if "map<" in t or "variant" in t else F.col(quoted(c)) for c, t in docs.dtypes]
    return {
        "_mix_key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")))),
        "_mix_row": F.xxhash64(*plain, *[F.col(quoted(c)).isNull() for c in docs.columns]),
    }


def _finish(epoch: int) -> Column:
    """Virtual finish time of a row in an epoch, counted from 0."""
    return (F.lit(epoch).cast("long") * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")


def _decided(docs: DataFrame, scratch: Scratch, *, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, times (taken), and key, row and rank, which make the order, for each row."""
    ensure_columns(docs, id_col, text_col, source_col)
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(quoted(text_col)).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    named = _named(docs, seed, id_col)
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(source_col)).cast("string").alias("source"), size.alias("size"), named["_mix_key"].alias("key"), named["_mix_row"].alias("row"))
    slim = scratch.table(rows.withColumn("nth", F.monotonically_increasing_id()))
    per_source = slim.groupBy("source").agg(F.sum("size").alias("s")).limit(SOURCES + 1).collect()
    if len(per_source) > SOURCES:
        raise ValueError(f"{source_col} has more than {SOURCES} values, so it names no sources")
    sources = fill_targets([(r[0], r["s"]) for r in per_source], list(weights), max_epochs)
    known = spark.createDataFrame([(s.name, s.size, s.target, s.rank) for s in sources], "name string, source_size long, target double, rank int")
    order = ["key", "row", "nth"]
    dealt = slim.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name"))).drop("name").repartitionByRange("rank", *order)
    queue = scratch.table(dealt.withColumn("part", F.spark_partition_id()))
    # A row for each part and the sources in it, which are neighbours.
    sums = queue.groupBy("rank", "part").agg(F.sum("size").alias("s"))
    earlier = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = scratch.table(sums.select("rank", "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before")))
    upto = Window.partitionBy("rank", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    timed = queue.withColumn("cum", F.sum("size").over(upto)).join(before, ["rank", "part"]).withColumn("cum", F.col("cum") + F.col("before")).drop("before", "part", "nth")
    timed = scratch.table(timed)
    cut = _cut(timed, sum(s.size for s in sources), max_epochs, scratch)
    times = F.lit(0)
    if cut is not None:
        for epoch in range(max_epochs):
            v = _finish(epoch)
            times = times + F.when((v < cut[0]) | ((v == cut[0]) & (F.col("rank") <= cut[1])), 1).otherwise(0)
    return timed.withColumn("times", F.when((F.col("size") > 0) & (F.col("target") > 0), times).otherwise(0)).drop("cum")


def _cut(timed: DataFrame, budget: int, max_epochs: int, scratch: Scratch) -> tuple[float, int] | None:
    """The last (virtual time, source rank) of the sorted entries that the budget covers; None if it covers nothing."""
    entries = timed.where("size > 0 AND target > 0").select("size", "rank", F.explode(F.array(*[_finish(e) for e in range(max_epochs)])).alias("v"))
    ranged = scratch.table(entries.repartitionByRange("v", "rank").sortWithinPartitions("v", "rank").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.sum("size").alias("s"), F.max(F.struct("v", "rank")).alias("last")).collect()  # a row per part
    spent, last = 0, None
    for part in sorted(parts, key=lambda r: r["part"]):
        if spent + part["s"] > budget:
            upto = Window.partitionBy("part").orderBy("v", "rank").rowsBetween(Window.unboundedPreceding, 0)
            running = ranged.where(F.col("part") == part["part"]).withColumn("spent", F.sum("size").over(upto) + spent)
            found = running.where(F.col("spent") <= budget).agg(F.max(F.struct("v", "rank")).alias("last")).first()["last"]
            return tuple(found) if found is not None else last
        spent, last = spent + part["s"], tuple(part["last"])
    return last


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes, repeats counted) of each row of ``docs``.

    Options: ``weights`` and ``max_epochs``, ``seed`` of the order, ``id_col``,
    ``text_col``, ``source_col``.  Sources are labels: up to SOURCES of them, one
    row each, are gathered on the driver; more are an error.
    """
    with Scratch(docs.sparkSession, "mix") as scratch:
        decided = _decided(docs, scratch, **options)
        return scratch.keep(decided.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it.

    Of repeated rows of which an epoch takes some only, one row stands for all.
    """
    seed, id_col, text_col, source_col = (options.get(k, d) for k, d in (("seed", SEED), ("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    with Scratch(docs.sparkSession, "mix") as scratch:
        decided = scratch.table(_decided(docs, scratch, **options).select("source", "key", "row", "size", "times"))
        each = decided.where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
        last = each.groupBy("source", "epoch").agg(F.max(F.struct("key", "row")).alias("last"))
        last = last.select(F.col("source").alias("_s"), "epoch", F.col("last.key").alias("_k"), F.col("last.row").alias("_r"))
        # How many of the rows that are like the last are in: all, but where repeated rows lie across the end.
        met = decided.where("size > 0").join(F.broadcast(last), F.col("source").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("_k")) & (F.col("row") == F.col("_r")))
        ends = met.groupBy("_s", "_k", "_r", "epoch").agg(F.count("*").alias("n"), F.count(F.when(F.col("times") > F.col("epoch"), 1)).alias("m"))
        ends = scratch.keep(ends)
    limits = ends.groupBy(F.col("_s").alias("_mix_s")).agg(F.collect_list(F.struct("_k", "_r", (F.col("n") == F.col("m")).alias("all"))).alias("_mix_ends"))
    rows = docs.withColumns(_named(docs, seed, id_col) | {"_mix_some": F.col(quoted(text_col)).cast("string").rlike(WORD)}).where("_mix_some")
    here, own = F.struct(F.col("_mix_key").alias("k"), F.col("_mix_row").alias("r")), [F.col(quoted(c)) for c in docs.columns]

    def inside(x: Column) -> Column:
        end = F.struct(x["_k"].alias("k"), x["_r"].alias("r"))
        return (here < end) | ((here == end) & x["all"])

    times = F.size(F.filter("_mix_ends", inside))
    # What is broadcast here and above has a row for each source, of which there are SOURCES at most, and epoch.
    whole = rows.join(F.broadcast(limits), F.col(quoted(source_col)).cast("string").eqNullSafe(F.col("_mix_s"))).withColumn("_mix_times", times).where("_mix_times > 0")
    whole = whole.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).select(*own)
    parted = ends.where("m < n").groupBy("_s", "_k", "_r").agg(F.sum("m").alias("_m"))
    if parted.isEmpty():
        return whole
    like = F.col(quoted(source_col)).cast("string").eqNullSafe(F.col("_s")) & (F.col("_mix_key") == F.col("_k")) & (F.col("_mix_row") == F.col("_r"))
    some = rows.join(F.broadcast(parted), like).groupBy("_s", "_k", "_r").agg(F.first("_m").alias("_m"), F.first(F.struct(*own)).alias("_one"))
    chunk = some.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_m - 1) div {COPIES}")))).repartition("_k", "_c")
    copies = chunk.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("_m") - F.col("_c") * COPIES))))
    return whole.unionByName(copies.select("_one.*"))
