"""Quality classifier by co-training of two views.

One classifier sees the text's content (hashed words, and how it is written:
letters, digits, symbols, repetition), the other only page metadata (source,
language, length).  In each round both score a pool of unlabelled rows, and each
hands the rows it is most sure of, with its verdict, to the other's training
set.  Afterwards each view is calibrated on labelled rows kept apart, and a
logistic combination of the two calibrated log-odds, fitted there too, scores
all documents.

Fitting uses bounded samples, taken by a hash of the id: about ``labelled_rows``
labelled and ``pool_rows`` unlabelled documents.  Scoring covers all rows and
whole texts.

Defined results: a null text is empty; null metadata is a value of its own; a
null label leaves a row unlabelled, several labels of a document agree on the
least; without labels of both kinds every score is the labelled share (0.5 if
there are none); repeated rows get equal scores; an empty table gives an empty
result; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns, quoted, slices, utf8
from .neardup import shingles, weighted

WORDS, STYLES = 1 << 12, 10
META = 1 << 9
LABELLED_ROWS, POOL_ROWS = 4_000, 4_000
ROUNDS, HANDED = 4, 0.05
CALIBRATION = 0.25
SEED = 11


@dataclass
class Rows:
    """Sparse features of rows side by side: row, feature and value of each entry."""

    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    rows: int

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.feature] * self.value, minlength=self.rows)

    def back(self, values: np.ndarray, features: int) -> np.ndarray:
        return np.bincount(self.feature, weights=values[self.row] * self.value, minlength=features)

    def of(self, chosen: np.ndarray) -> Rows:
        """The rows of a mask, numbered anew."""
        number = np.cumsum(chosen) - 1
        keep = chosen[self.row]
        return Rows(number[self.row[keep]], self.feature[keep], self.value[keep], int(chosen.sum()))


_KIND = np.zeros(256, np.int64)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[97:123] = 4
_KIND[128:] = 4
_KIND[[c for c in range(33, 127) if _KIND[c] == 0]] = 5


def text_features(data: np.ndarray, offsets: np.ndarray) -> Rows:
    """Words by hash, weighted by their share of the text's norm, and STYLES figures of how it is written."""
    n = len(offsets) - 1
    word, which = shingles(data, offsets, 1)
    word, which, times = weighted(word, which)
    norm = np.sqrt(np.bincount(which, weights=times.astype(float) ** 2, minlength=n))
    total = np.bincount(which, weights=times, minlength=n)
    kinds = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * 6 + _KIND[data], minlength=6 * n).reshape(n, 6).astype(float)
    size = np.maximum(1, kinds.sum(axis=1))
    most = np.zeros(n)
    np.maximum.at(most, which, times.astype(float))
    different = np.bincount(which, minlength=n)
    style = np.stack(
        [np.ones(n), kinds[:, 1] / size, kinds[:, 2] / size, kinds[:, 3] / size, kinds[:, 4] / size, kinds[:, 5] / size, different / np.maximum(1, total), most / np.maximum(1, total), np.log1p(total) / 10, size / np.maximum(1, total) / 20],
        axis=1,
    )
    return Rows(
        np.concatenate([which, np.repeat(np.arange(n), STYLES)]),
        np.concatenate([(word % np.uint64(WORDS)).astype(np.int64), np.tile(np.arange(WORDS, WORDS + STYLES), n)]),
        np.concatenate([times / norm[which], style.ravel()]),
        n,
    )


def meta_features(columns: list[list]) -> Rows:
    """Each column's value by hash (numbers by their magnitude), and a constant."""
    from zlib import crc32

    n = len(columns[0]) if columns else 0
    found = [np.zeros(n, np.int64)]
    for i, values in enumerate(columns):
        shown = [f"{i}={int(np.log2(abs(v) + 1) * 2) if isinstance(v, (int, float)) and not isinstance(v, bool) and np.isfinite(v) else v}" for v in values]
        found.append(np.array([1 + crc32(s.encode()) % (META - 1) for s in shown], np.int64))
    return Rows(np.tile(np.arange(n), len(found)), np.concatenate(found), np.ones(n * len(found)), n)


def fit_logistic(x: Rows, y: np.ndarray, features: int, penalty: float = 1e-3, steps: int = 200) -> np.ndarray:
    """Weights of a penalised logistic regression, classes weighted alike, by gradient steps with momentum per coordinate."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w, m, v = np.zeros(features), np.zeros(features), np.zeros(features)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        g = x.back(weight * (p - y), features) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit_dense(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights, constant last, of a logistic regression on a few columns (Newton's method)."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + penalty * w)
    return w


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray  # slope and constant of the view's calibration
    meta_scale: np.ndarray
    mix: np.ndarray  # weights of both calibrated log-odds, and a constant
    share: float | None = None  # the score of all rows where nothing could be fitted

    def views(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view and both."""
        if self.share is not None:
            return (np.full(text.rows, self.share),) * 3
        a = text.times(self.text) * self.text_scale[0] + self.text_scale[1]
        b = meta.times(self.meta) * self.meta_scale[0] + self.meta_scale[1]
        c = a * self.mix[0] + b * self.mix[1] + self.mix[2]
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a, b, c))


def co_train(text: Rows, meta: Rows, y: np.ndarray, rounds: int = ROUNDS, handed: float = HANDED) -> Model:
    """``y`` is 1 (good), 0 (bad) or -1 (no label)."""
    known = np.flatnonzero(y >= 0)
    kinds = len(set(y[known].tolist()))
    if kinds < 2:
        return Model(*(np.zeros(1),) * 5, share=float(y[known].mean()) if len(known) else 0.5)
    order = np.random.default_rng(SEED).permutation(known)
    apart = np.zeros(len(y), bool)
    for label in (0, 1):
        own = order[y[order] == label]
        apart[own[: int(len(own) * CALIBRATION)]] = True
    if len(set(y[apart].tolist())) < 2:
        apart[:] = False
        apart[known] = True  # too few labels to keep some apart
    seed = (y >= 0) & ~apart if (apart != (y >= 0)).any() else y >= 0
    taught = {"text": np.where(seed, y, -1), "meta": np.where(seed, y, -1)}
    views = {"text": (text, WORDS + STYLES), "meta": (meta, META)}
    pool = y < 0
    weights = {}
    for turn in range(rounds + 1):
        for name, (x, features) in views.items():
            use = taught[name] >= 0
            weights[name] = fit_logistic(x.of(use), taught[name][use].astype(float), features)
        if turn == rounds or not pool.any():
            break
        for name, other in (("text", "meta"), ("meta", "text")):
            score = views[name][0].times(weights[name])
            free = np.flatnonzero(pool & (taught[other] < 0))
            n = int(len(free) * handed)
            ranked = free[np.argsort(score[free], kind="stable")]
            sure = np.abs(score[ranked]) > 1
            # as many of each kind as the labelled rows have, and only those the view is sure of
            good = max(1, int(n * y[known].mean()))
            taught[other][ranked[-good:][sure[-good:] & (score[ranked[-good:]] > 0)]] = 1
            bad = max(1, n - good)
            taught[other][ranked[:bad][sure[:bad] & (score[ranked[:bad]] < 0)]] = 0
    truth = y[apart].astype(float)
    logit = {name: x.times(weights[name])[apart] for name, (x, _) in views.items()}
    scale = {name: fit_dense(z[:, None], truth) for name, z in logit.items()}
    both = np.stack([logit[n] * scale[n][0] + scale[n][1] for n in ("text", "meta")], axis=1)
    return Model(weights["text"], weights["meta"], scale["text"], scale["meta"], fit_dense(both, truth))


def _features(batch: pa.RecordBatch, i: int, j: int, data: np.ndarray, offsets: np.ndarray, meta: int) -> tuple[Rows, Rows]:
    text = text_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
    return text, meta_features([batch.column(1 + c).slice(i, j - i).to_pylist() for c in range(meta)])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", meta_cols: tuple[str, ...] = ("source", "lang", "n_chars"), labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS, rounds: int = ROUNDS) -> Model:
    """Fit on ``docs``; ``labels`` (same id column) says of some whether they are good (1) or bad (0)."""
    ensure_columns(docs, id_col, text_col, *meta_cols)
    ensure_columns(labels, id_col, label_col)
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(F.min(label_col).cast("int").alias("_label"))
    # Somewhat more than are wanted come by their hash, and of these the first so many: rows that share an id, or have none, do not add up.
    below = lambda row, n, most: F.pmod(row, F.lit(1 << 30)) < F.lit(int(min(1.0, 1.2 * most / max(1, n)) * (1 << 30)))
    row = F.xxhash64(F.col(quoted(id_col)), F.col(quoted(text_col)))
    first = lambda df, most: df.orderBy("_row", "_text").limit(most).drop("_row")
    wanted = [F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *[F.col(quoted(c)) for c in meta_cols], "_label", row.alias("_row")]
    # At most labelled_rows ids and numbers: small enough to send everywhere, so texts need no shuffle.
    taught = known.where(below(F.xxhash64("_label_id"), known.count(), labelled_rows)).orderBy(F.xxhash64("_label_id"), "_label_id").limit(labelled_rows)
    labelled = first(docs.join(F.broadcast(taught), F.col(quoted(id_col)) == F.col("_label_id")).select(*wanted), labelled_rows)
    pool = docs.where(below(row, docs.count(), pool_rows)).join(known, F.col(quoted(id_col)) == F.col("_label_id"), "left_anti").withColumn("_label", F.lit(-1))
    sample = labelled.unionByName(first(pool.select(*wanted), pool_rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in slices(offsets, 1 << 20):
                text, meta = _features(batch, i, j, data, offsets, len(meta_cols))
                each = []
                for rows_, values, kind in ((text, text.feature, np.int32), (text, text.value, np.float32), (meta, meta.feature, np.int32)):
                    order = np.argsort(rows_.row, kind="stable")
                    bounds = np.searchsorted(rows_.row[order], np.arange(j - i + 1)).tolist()
                    sorted_ = values[order].astype(kind)
                    each.append(pa.array([sorted_[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays([*each, batch.column(1 + len(meta_cols)).slice(i, j - i)], names=["tf", "tv", "mf", "label"])

    # At most labelled_rows + pool_rows rows, features only.
    rows = sample.mapInArrow(work, "tf binary, tv binary, mf binary, label int").collect()
    rows.sort(key=lambda r: (bytes(r["tf"]), bytes(r["tv"]), bytes(r["mf"]), r["label"]))
    features = lambda c, t: [np.frombuffer(bytes(r[c]), t) for r in rows]

    def joined(f: list[np.ndarray], v: list[np.ndarray]) -> Rows:
        row = np.repeat(np.arange(len(f)), [len(x) for x in f]) if f else np.zeros(0, np.int64)
        whole = lambda x: np.concatenate(x) if x else np.zeros(0)
        return Rows(row.astype(np.int64), whole(f).astype(np.int64), whole(v).astype(float), len(f))

    mf = features("mf", np.int32)
    return co_train(joined(features("tf", np.int32), features("tv", np.float32)), joined(mf, [np.ones(len(x)) for x in mf]), np.array([r["label"] for r in rows], np.int64), rounds)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang", "n_chars")) -> DataFrame:
    """``docs`` with text_score, meta_score and quality_score, probabilities that a row is good."""
    ensure_columns(docs, text_col, *meta_cols)
    made = ["text_score", "meta_score", "quality_score"]
    own = [c for c in docs.columns if c not in made]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in slices(offsets, 1 << 20):
                views = model.views(*_features(batch, i, j, data, offsets, len(meta_cols)))
                rest = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rest.columns[1 + len(meta_cols) :], *(pa.array(np.round(v, 9)) for v in views)], names=[*rest.schema.names[1 + len(meta_cols) :], *made])

    schema = ", ".join([f"`{c}` {t}" for c, t in docs.select(*[F.col(f"`{c}`") for c in own]).dtypes] + [f"{c} double" for c in made])
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_quality_text"), *[F.col(c).alias(f"_quality_{i}") for i, c in enumerate(meta_cols)], *[F.col(f"`{c}`") for c in own]).mapInArrow(work, schema)
