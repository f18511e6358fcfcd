"""Quality of whole texts: random-indexing vectors, pooled, and a small network.

1. Every word has two marks: a bucket of its letters (hashed, in lower case) and its shape
   (kinds of characters in a row, runs written once; a word that repeats the one before it has
   a shape of its own). Every mark has a fixed random index vector with a few plus and minus
   ones. A mark's vector is the sum of the index vectors around it, over all texts: each task
   adds up its own, Spark adds up the tasks'.
2. A document is the weighted mean of its marks' vectors (frequent marks weigh less), of
   their spread, and its length.
3. A network with one hidden layer, written in numpy, is fitted on labelled documents, and its
   probabilities are calibrated with a temperature on labelled documents kept apart.

The vectors' table has a fixed size. Labels are read of learnable rows only; language, source
and ids are never inputs. Null texts score like empty ones. Repeated rows are scored alike,
row by row; other columns stay, and one with the name of an output is replaced. Without labels
of both kinds every score is the share of good labels (1 if there are none). Empty tables give
empty tables.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import known_to_workers, with_batch_columns
from .labelled import SAMPLE_ROWS, fold, labelled_sample

WORDS, SHAPES, WIDTH = 4096, 512, 32
MARKS = WORDS + SHAPES
_ONES, _REACH = 4, 2
_PAD = 0
#: Words that are pooled at once; a longer text goes through several rounds.
GROUP_WORDS = 200_000
SEED = 20


def shape(word: str) -> str:
    """Kinds of characters of a word, each run written once; symbols stand for themselves."""
    out = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:12])


def core_and_shape(word: str) -> tuple[str, str]:
    """Letters and digits of a word in lower case, and its shape; most words the short way."""
    last = word[-1:]
    body, mark = (word, "") if last.isalnum() else (word[:-1], last)
    if body.isalpha():
        if body.islower():
            return body, "a" + mark
        if body[1:].islower() and body[0].isupper():
            return body.lower(), "Aa" + mark
    return "".join(filter(str.isalnum, word)).lower(), shape(word)


class Marks(dict):
    """Word to its two marks in one number; kept for a bounded number of words."""

    def __init__(self):
        self.forms: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        core, form = core_and_shape(word)
        bucket = 1 + zlib.crc32(core.encode("utf-8", "replace")) % (WORDS - 1)
        number = self.forms.get(form)
        if number is None:
            number = self.forms[form] = 2 + zlib.crc32(form.encode("utf-8", "replace")) % (SHAPES - 2)
        if len(self) >= 300_000:
            self.clear()
            self.forms.clear()
        found = self[word] = bucket * SHAPES + number
        return found


def marks_of(words: list[str], known: Marks, starts: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word bucket and shape of every word; shape 1 for a word equal to the one before it.

    ``starts`` are the places where texts begin.
    """
    both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    bucket, form = both // SHAPES, both % SHAPES
    again = np.zeros(len(both), bool)
    again[1:] = both[1:] == both[:-1]
    again[starts] = False
    form[again] = 1
    return bucket, form + WORDS


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For every mark the places and signs of its ones."""
    random = np.random.default_rng(SEED)
    places = np.array([random.permutation(WIDTH)[:_ONES] for _ in range(MARKS)])
    signs = random.choice([-1.0, 1.0], (MARKS, _ONES))
    signs[_PAD] = 0
    return places, signs


def _parts(texts: list[str]):
    """Lists of (text number, words) of about ``GROUP_WORDS`` words; long texts in several parts."""
    part, size = [], 0
    for i, text in enumerate(texts):
        words = text.split()
        for at in range(0, len(words), GROUP_WORDS):
            own = words[at : at + GROUP_WORDS]
            part.append((i, own))
            size += len(own)
            if size >= GROUP_WORDS:
                yield part
                part, size = [], 0
    if part:
        yield part


def _joined(part: list[tuple[int, list[str]]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All words of a part, where each text starts, and each word's place among the texts."""
    sizes = np.array([len(words) for _, words in part])
    return list(chain.from_iterable(words for _, words in part)), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(part)), sizes)


def _accumulate(texts: list[str], known: Marks, sums: np.ndarray, counts: np.ndarray, index) -> None:
    places, signs = index
    for part in _parts(texts):
        words, starts, owner = _joined(part)
        bucket, form = marks_of(words, known, starts)
        # Padding between texts, so that no window reaches from one into the next.
        at = np.arange(len(words)) + _REACH * owner
        b, f = np.full((2, len(words) + _REACH * len(part)), _PAD, np.int64)
        b[at], f[at] = bucket, form
        counts += np.bincount(b, minlength=MARKS) + np.bincount(f, minlength=MARKS)
        pairs = [(b[:-o], b[o:]) for o in range(1, _REACH + 1)] + [(b[o:], b[:-o]) for o in range(1, _REACH + 1)]
        pairs += [(f[:-1], f[1:]), (f[1:], f[:-1]), (f, f), (b, f)]
        for mark, near in pairs:
            for k in range(_ONES):
                sums += np.bincount(mark * WIDTH + places[near, k], signs[near, k], MARKS * WIDTH)


def mark_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Vectors of unit length of all marks, and the marks' weights, from all texts.

    At most ``MARKS * (WIDTH + 1)`` numbers are sent to the driver.
    """
    known_to_workers(docs.sparkSession)

    def run(batches):
        known, index = Marks(), index_vectors()
        sums, counts = np.zeros(MARKS * WIDTH), np.zeros(MARKS, np.int64)
        for batch in batches:
            _accumulate([t for t in batch.column(0).to_pylist() if t], known, sums, counts, index)
        cells = np.concatenate([sums, counts])
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at].astype(np.int64))], names=["cell", "n"])

    rows = docs.select(text).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(MARKS * (WIDTH + 1))
    cells[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    vectors, counts = cells[: MARKS * WIDTH].reshape(MARKS, WIDTH), cells[MARKS * WIDTH :]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = np.concatenate([counts[:WORDS] / max(counts[1:WORDS].sum(), 1), counts[WORDS:] / max(counts[WORDS:].sum(), 1)])
    weight = 1e-2 / (1e-2 + share)
    weight[_PAD] = 0
    return vectors.astype(np.float32), weight.astype(np.float32)


class QualityModel:
    def __init__(self, vectors: np.ndarray, weight: np.ndarray):
        self.vectors, self.weight = vectors, weight
        self.layers: list[np.ndarray] = []
        self.mean = self.scale = np.zeros(0)
        self.temperature, self.base = 1.0, 1.0

    def pooled(self, texts: list[str]) -> np.ndarray:
        """A row per text: means of its words' and shapes' vectors, the shapes' spread, its length."""
        known = Marks()
        total = np.zeros((len(texts), 3 * WIDTH))
        mass = np.zeros((len(texts), 2))
        length = np.zeros(len(texts))
        for part in _parts(texts):
            owner = np.array([i for i, _ in part])
            words, starts, _ = _joined(part)
            for side, mark in enumerate(marks_of(words, known, starts)):
                w = self.weight[mark] if side == 0 else np.ones(len(mark), np.float32)
                v = self.vectors[mark]
                np.add.at(total, (owner, slice(side * WIDTH, (side + 1) * WIDTH)), np.add.reduceat(v * w[:, None], starts))
                np.add.at(mass, (owner, side), np.add.reduceat(w, starts))
                if side:
                    np.add.at(total, (owner, slice(2 * WIDTH, None)), np.add.reduceat(v * v, starts))
            np.add.at(length, owner, np.diff(np.append(starts, len(words))))
        out = total / np.maximum(mass[:, [0] * WIDTH + [1] * 2 * WIDTH], 1e-9)
        out[:, 2 * WIDTH :] -= out[:, WIDTH : 2 * WIDTH] ** 2
        return np.hstack([out, np.log1p(length)[:, None]])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(texts)) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4) -> None:
        """Fit the network on four fifths of the rows and the temperature on the rest."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        random = np.random.default_rng(SEED)
        n = x.shape[1]
        self.layers = [random.normal(0, n**-0.5, (n, hidden)), np.zeros(hidden), random.normal(0, hidden**-0.5, hidden), np.zeros(())]
        apart = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
        z, t = ((x - self.mean) / self.scale)[~apart], y[~apart]
        first, second = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers]
        step = 0
        for _ in range(epochs):
            order = random.permutation(len(z))
            for at in range(0, len(z), 256):
                rows = order[at : at + 256]
                w1, b1, w2, b2 = self.layers
                h = np.tanh(z[rows] @ w1 + b1)
                off = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - t[rows]) / len(rows)
                back = off[:, None] * w2 * (1 - h * h)
                slopes = [z[rows].T @ back + decay * w1, back.sum(axis=0), h.T @ off + decay * w2, off.sum()]
                step += 1
                for k, g in enumerate(slopes):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.layers[k] = self.layers[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if apart.any() and 0 < y[apart].mean() < 1:
            logits, t = self.logits(x[apart]), y[apart]
            loss = [np.logaddexp(0, np.where(t > 0, -logits, logits) / c).mean() for c in _TEMPERATURES]
            self.temperature = float(_TEMPERATURES[int(np.argmin(loss))])


_TEMPERATURES = np.geomspace(0.25, 8, 61)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, bound: int = SAMPLE_ROWS) -> QualityModel:
    """The model of docs, learnt from at most ``bound`` labelled rows for which ``learnable`` holds."""
    model = QualityModel(*mark_vectors(docs))
    sample = labelled_sample(docs, labels, "quality", learnable, bound)

    def run(batches):
        for batch in batches:
            x = model.pooled(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *batch.columns[1:]], names=["x", "label", "key"])

    keyed = sample.select("text", "label", F.xxhash64("doc_id", "text").alias("key"))
    rows = keyed.mapInArrow(run, "x array<double>, label int, key long").toArrow()  # at most ``bound``
    y = rows["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        model.base = float(y.mean()) if len(y) else 1.0
        return model
    order = np.argsort(rows["key"].to_numpy(), kind="stable")  # the same rows in the same order on every run
    x = np.array(rows["x"].to_pylist())
    model.fit(x[order], y[order])
    return model


def with_scores(docs: DataFrame, model: QualityModel, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each text."""

    def compute(texts):
        return {name: pa.array(model.scores([t or "" for t in texts]))}

    return with_batch_columns(docs, [text], {name: DoubleType()}, compute)


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """docs with score, held_out (crc32 of the id modulo 4 is 2; never learnt from) and predicted."""
    model = fit(docs, labels, fold(4) != 2, bound)
    scored = with_scores(docs, model)
    return scored.withColumn("held_out", fold(4) == 2).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
