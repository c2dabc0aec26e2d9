"""Language identification by segmentation-marginalised unigrams.

A word's probability in a language is the sum, over all ways to cut it into
pieces of a fixed public vocabulary, of the product of the pieces'
probabilities there; a forward algorithm over the word's bytes gives it, with
every piece of the vocabulary, however long.  A text's is the product over its
words.  Piece probabilities come from expectation
maximisation over the same segmentations, so no single tokenisation is trusted.

Words are runs of letters, lower-cased, with a space before them as in the
vocabulary, of any length: the sums are carried from each SEGMENT bytes to the
next, so a word without end takes no more memory than its bytes.  Equal words of
a batch are scored once, and each Python worker remembers recent ones, so the
cost follows the different words.

The model is fitted on a bounded sample of the labelled rows: about
``sample_rows`` per language, taken by a hash of the id.  Language frequencies
come from all labelled rows.

Defined results: a text that is null or has no letter is ``und`` with score 0;
with no labelled row at all every text is; ties go to the first language by
code point; repeated rows get equal results; a null id is not held out; an empty
table gives an empty result; columns of the input named lang_pred or score are
replaced, others are kept.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ensure_columns, tidy

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SEGMENT = 48
CELLS = 1 << 18
LANGUAGES = 10_000
SAMPLE_ROWS = 2_000
ROUNDS = 3
FLOOR = 1e-5
SCALE = 16.0
REMEMBERED = 100_000
REMEMBERED_LETTERS = 4_000_000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces and a tree of their bytes; a node is numbered, and a hash table leads from (node, byte) to the next.

    Piece 0 is none.  All single bytes are pieces; node 1 + b is that of byte b.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
        self.pieces = sorted((pieces - {b""}) | {bytes([b]) for b in range(256)})
        self.lengths = np.array([0, *(len(p) for p in self.pieces)])
        ends, steps = [0] * 257, {}
        for i, piece in enumerate(self.pieces, 1):
            node = piece[0] + 1
            for byte in piece[1:]:
                step = node << 8 | byte
                if step not in steps:
                    steps[step] = len(ends)
                    ends.append(0)
                node = steps[step]
            ends[node] = i
        self.ends = np.array(ends, np.int32)
        self.bits = max(12, (4 * len(steps)).bit_length())
        size = 1 << self.bits
        self.keys, self.node = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        packed = np.fromiter(steps, np.uint64, len(steps))
        for slot, key, node in zip(self._slot(packed).tolist(), steps, steps.values(), strict=True):
            while self.node[slot]:
                slot = (slot + 1) % size
            self.keys[slot], self.node[slot] = key, node

    def _slot(self, packed: np.ndarray) -> np.ndarray:
        return ((packed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes that bytes lead to, 0 where no piece goes on so."""
        packed = (node.astype(np.uint64) << np.uint64(8)) | byte
        slot = self._slot(packed)
        found = np.where(self.keys[slot] == packed, self.node[slot], 0)
        open_ = np.flatnonzero((self.keys[slot] != packed) & (self.node[slot] > 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            at = slot[open_]
            hit = self.keys[at] == packed[open_]
            found[open_[hit]] = self.node[at[hit]]
            open_ = open_[~hit & (self.node[at] > 0)]
        return found


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@dataclass
class Segment:
    """The pieces that start in the bytes ``at`` to ``at + width`` of some words.

    By length of the piece: start (from ``at`` on, ascending), word and piece,
    and where each start's are.  ``reach`` is the greatest length.
    """

    at: int
    width: int
    reach: int
    pieces: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[int]]]


def lattice(words: list[bytes], vocab: Vocabulary) -> Iterator[Segment]:
    """All pieces that occur in the words, SEGMENT bytes after SEGMENT bytes."""
    longest, most = max(map(len, words)), int(vocab.lengths.max())
    for at in range(0, longest, SEGMENT):
        width = min(SEGMENT, longest - at)
        parts = [w[at : at + width + most - 1] for w in words]
        length = np.array([len(x) for x in parts])
        flat = np.frombuffer(b"".join(parts), np.uint8)
        before = np.cumsum(length) - length
        start, word = np.nonzero(np.arange(width)[:, None] < length)
        node = flat[before[word] + start].astype(np.int64) + 1
        found = []
        for size in range(1, most + 1):
            piece = vocab.ends[node]
            some = np.flatnonzero(piece)
            if len(some):
                bounds = np.searchsorted(start[some], np.arange(width + 1)).tolist()
                found.append((size, start[some], word[some], piece[some], bounds))
            on = np.flatnonzero(start + size < length[word])
            start, word, node = start[on], word[on], node[on]
            node = vocab.step(node, flat[before[word] + start + size])
            on = np.flatnonzero(node)
            start, word, node = start[on], word[on], node[on]
            if not len(on):
                break
        yield Segment(at, width, found[-1][0], found)


def batches_of(words: list[bytes]) -> Iterator[np.ndarray]:
    """Indexes of words of like length, of CELLS bytes together at most if they are several."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < 4096 and (to - at + 1) * len(words[order[to]]) <= CELLS:
            to += 1
        yield np.array(order[at:to], np.int64)
        at = to


def _rescaled(sums: np.ndarray, scale: np.ndarray) -> None:
    """Columns of sums brought to a greatest value of 1; ``scale`` takes what they are divided by, as a logarithm."""
    most = sums.max(axis=0)
    most[most <= 0] = 1
    sums /= most
    scale += np.log(most)


def word_scores(words: list[bytes], vocab: Vocabulary, chances: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language: ``chances`` are those of pieces, times SCALE per byte."""
    out = np.empty((len(words), chances.shape[1]))
    for part in batches_of(words):
        length = np.array([len(words[i]) for i in part])
        sums, scale = np.ones((1, len(part), chances.shape[1])), np.zeros((len(part), chances.shape[1]))
        for seg in lattice([words[i] for i in part], vocab):
            # [byte, word, language]: summed probability of all segmentations up to a byte
            total = np.zeros((max(seg.width + seg.reach, len(sums)), *scale.shape))
            total[: len(sums)] = sums
            for s in range(seg.width):
                for size, _, word, piece, bounds in seg.pieces:
                    a, b = bounds[s], bounds[s + 1]
                    if a < b:
                        total[s + size, word[a:b]] += total[s, word[a:b]] * chances[piece[a:b]]
            done = np.flatnonzero((length > seg.at) & (length <= seg.at + seg.width))
            out[part[done]] = np.log(total[length[done] - seg.at, done]) + scale[done] - length[done, None] * np.log(SCALE)
            sums = total[seg.width :]
            _rescaled(sums, scale)
    return out


def expected_pieces(words: list[bytes], language: np.ndarray, times: np.ndarray, vocab: Vocabulary, chances: np.ndarray) -> np.ndarray:
    """[piece, language]: how often pieces are expected in the words' segmentations (words of equal language share a column)."""
    out = np.zeros(chances.shape)
    for part in batches_of(words):
        own, n = language[part], len(part)
        length = np.array([len(words[i]) for i in part])
        segments = list(lattice([words[i] for i in part], vocab))
        ahead, whole = [], np.zeros(n)
        sums, scale = np.ones((1, n)), np.zeros(n)
        for seg in segments:
            total = np.zeros((max(seg.width + seg.reach, len(sums)), n))
            total[: len(sums)] = sums
            for s in range(seg.width):
                for size, _, word, piece, bounds in seg.pieces:
                    a, b = bounds[s], bounds[s + 1]
                    if a < b:
                        total[s + size, word[a:b]] += total[s, word[a:b]] * chances[piece[a:b], own[word[a:b]]]
            ahead.append((total[: seg.width].copy(), scale.copy()))
            done = np.flatnonzero((length > seg.at) & (length <= seg.at + seg.width))
            whole[done] = np.log(total[length[done] - seg.at, done]) + scale[done]
            sums = total[seg.width :]
            _rescaled(sums, scale)
        sums, scale = np.zeros((1, n)), np.zeros(n)  # from here on of what follows a byte
        for seg, (before, upto) in zip(reversed(segments), reversed(ahead), strict=True):
            total = np.zeros((seg.width + max(seg.reach, len(sums)), n))
            total[seg.width : seg.width + len(sums)] = sums
            done = np.flatnonzero((length > seg.at) & (length <= seg.at + seg.width))
            total[length[done] - seg.at, done] = 1
            for s in reversed(range(seg.width)):
                for size, _, word, piece, bounds in seg.pieces:
                    a, b = bounds[s], bounds[s + 1]
                    if a < b:
                        total[s, word[a:b]] += total[s + size, word[a:b]] * chances[piece[a:b], own[word[a:b]]]
            share = np.exp(upto + scale - whole) * times[part]
            for size, start, word, piece, _ in seg.pieces:
                weight = before[start, word] * chances[piece, own[word]] * total[start + size, word] * share[word]
                np.add.at(out, (piece, own[word]), weight)
            sums = total[: int(vocab.lengths.max())]
            _rescaled(sums, scale)
    return out


def words_of(text: str) -> Counter:
    """Words of a text and how often they occur; none if it has no letter."""
    words = Counter(LETTERS.findall(text.lower()))
    if not any(c.isalpha() for w in words for c in w):
        return Counter()
    return words


def spelled(word: str) -> bytes:
    return f" {word}".encode()


class Remembered:
    """Words and their scores, until there are too many."""

    def __init__(self, languages: int):
        self.languages = languages
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.letters = 0
        self.scores = np.zeros((0, self.languages))

    def add(self, words: list[str], scores: np.ndarray) -> None:
        self.letters += sum(map(len, words))
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.scores = np.concatenate([self.scores, scores])


class Model:
    """Piece probabilities by language; what executors need to score texts."""

    def __init__(self, languages: list[str], priors: np.ndarray, chances: np.ndarray, path: str):
        self.languages, self.priors, self.chances, self.path = languages, priors, chances, path

    def score(self, texts: list[str | None], memory: Remembered | None = None) -> tuple[list[str], np.ndarray]:
        """Predicted languages and their posterior probabilities; ``memory`` keeps words' scores from call to call."""
        memory = memory or Remembered(len(self.languages))
        counted = [words_of(t) if t else Counter() for t in texts]
        words = {w for c in counted for w in c}
        new = list(words.difference(memory.place))
        if len(memory.place) + len(new) > REMEMBERED or memory.letters > REMEMBERED_LETTERS:
            memory.forget()
            new = list(words)
        if new:
            memory.add(new, word_scores([spelled(w) for w in new], vocabulary(self.path), self.chances))
        names, chances = [], np.zeros(len(texts))
        for i, c in enumerate(counted):
            if not c:
                names.append(UNKNOWN)
                continue
            # in the words' own order, so equal texts have equal sums
            at = np.fromiter((memory.place[w] for w in c), np.int64, len(c))
            total = self.priors + np.fromiter(c.values(), float, len(c)) @ memory.scores[at]
            best = int(total.argmax())
            names.append(self.languages[best])
            chances[i] = 1 / np.exp(total - total[best]).sum()
        return names, chances


def held_out(id_: Column, fold: int = 1, folds: int = 3) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, vocabulary_file: str | None = None) -> Model | None:
    """A model of the languages in ``docs`` (rows with a null language are left out); None if there are none."""
    ensure_columns(docs, id_col, text_col, lang_col)
    path = vocabulary_file or vocabulary_path()
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect())
    if len(counts) > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values, which are no languages")
    if not counts:
        return None
    languages, n = [c[0] for c in counts], np.array([c[1] for c in counts], float)
    vocab = vocabulary(path)
    base = np.zeros((len(vocab.pieces) + 1, len(languages)))
    # Start: all pieces alike, a byte of length costing what SCALE says, so that long pieces are not preferred as such.
    base[1:] = (SCALE ** -vocab.lengths[1:].astype(float))[:, None]
    base[1:] /= base[1:].sum(axis=0)
    position = {lang: i for i, lang in enumerate(languages)}
    share = F.element_at(F.create_map(*[x for lang, c in counts for x in (F.lit(lang), F.lit(min(1.0, sample_rows / c)))]), F.col("lang"))
    sampled = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).where(F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, times in words_of(text).items():
                    total[position[lang], spelled(word)] += times
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.binary()), pa.array(list(total.values()), pa.int64())], names=["lang", "word", "times"])

    def expect(chances: np.ndarray):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(chances.shape)
            for batch in batches:
                if batch.num_rows:
                    total += expected_pieces(batch.column(1).to_pylist(), batch.column(0).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(float), vocabulary(path), chances)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], names=["piece", "lang", "n"])

        return work

    def scaled(p: np.ndarray) -> np.ndarray:
        """Probabilities times SCALE per byte, which keeps products of a word's length in range."""
        return p * (SCALE ** vocab.lengths.astype(float))[:, None]

    with Scratch(docs.sparkSession, "langid") as scratch:
        words = scratch.table(sampled.select("text", "lang").mapInArrow(tidy(count), "lang int, word binary, times long").groupBy("lang", "word").agg(F.sum("times").alias("times")))
        chances = base
        for _ in range(rounds):
            # At most a row for each piece and language.
            rows_ = words.mapInArrow(tidy(expect(scaled(chances))), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
            seen = np.zeros(base.shape)
            seen[rows_["piece"], rows_["lang"]] = rows_["n"]
            anywhere = seen.sum(axis=1, keepdims=True) / max(1.0, seen.sum())
            chances = (seen + 50 * anywhere) / (seen.sum(axis=0) + 50)
            single = vocab.lengths == 1
            chances[single] = np.maximum(chances[single], FLOOR)
            chances /= chances.sum(axis=0)
    return Model(languages, np.log(n / n.sum()), scaled(chances), path)


_MEMORY: dict[int, Remembered] = {}


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    ensure_columns(docs, text_col)
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in own], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    mark = hash((model.chances.tobytes(), tuple(model.languages)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _MEMORY.setdefault(mark, Remembered(len(model.languages)))
        for other in [k for k in _MEMORY if k != mark]:
            del _MEMORY[other]
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                names, chances = model.score(part.column(0).to_pylist(), memory)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names, pa.string()), pa.array(chances)], names=[*part.schema.names[1:], "lang_pred", "score"])

    schema = ", ".join([f"`{c}` {t}" for c, t in docs.select(*own).dtypes] + ["lang_pred string", "score double"])
    return docs.select(F.col(text_col).cast("string").alias("_lang_text"), *[F.col(f"`{c}`") for c in own]).mapInArrow(tidy(work), schema)
