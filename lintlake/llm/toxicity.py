"""Toxicity of whole texts: disguised words are restored, then scored.

1. A character language model is made from all documents (``deobfuscation``).
2. From labelled documents, one of each group of near copies, the beginnings of words (four
   to six letters, as written and after restoring) are counted in toxic and in other documents. Beginnings
   that toxic documents have far more often than others (log-odds and a likelihood-ratio test)
   get their log-odds as weight.
3. A document's evidence (distinct words with strong and with weak weights, all of them, and
   their share) goes through a logistic regression fitted on the same documents.

Labels are read of learnable rows only; language, source and ids are never inputs. The model
is small: word beginnings must be in ``LEAST_DOCS`` of the sampled toxic documents at least, so
their number is bounded by what the bounded sample holds, whatever the number of documents.

Null texts score like empty ones, near zero. Repeated rows are scored alike, row by row; other
columns stay, and one with the name of an output is replaced. Without labels of both kinds
every score is the share of toxic labels (0 if there are none). Empty tables give empty tables.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from .common import known_to_workers, with_batch_columns
from .deobfuscation import SPACED, TRACE, LanguageModel, language_model
from .labelled import SAMPLE_ROWS, fit_logistic, fold, labelled_sample

LEAST_DOCS = 4
LEAST_LOG_ODDS = 1.2
#: Log-odds from which on a beginning is strong evidence; words with less count apart.
STRONG = 3.5
LEAST_RATIO_TEST = 20.0
EVIDENCE = ("strong", "strong_all", "strong_share", "weak", "weak_all", "weak_share")
_EDGE = ".,;:!?\"'()[]{}*#%&$-_"
_RUN = re.compile(r"[^\W\d_]+")


def beginnings(word: str) -> list[str]:
    """Beginnings of four to six letters of the letter runs in a word; shorter runs whole."""
    out = []
    for run in _RUN.findall(word):
        out += [run[:n] for n in (4, 5, 6) if len(run) >= n] or ([run + " "] if len(run) == 3 else [])
        if 4 <= len(run) <= 6:
            out.append(run + " ")
    return out


class Restorer:
    """Words of texts after restoring, each distinct word worked on once while it is kept."""

    KEPT = 200_000

    def __init__(self, model: LanguageModel):
        self.model, self.of_word = model, {}

    def words(self, text: str) -> list[str]:
        """Words in lower case; spaced-out letters are joined where the model says so."""
        text = text.lower()
        listed = text.split()
        for m in SPACED.finditer(text):
            listed += self.model.decode(" ".join(m[0].split())).split()
        return listed

    def restored(self, word: str) -> str:
        found = self.of_word.get(word)
        if found is None:
            if len(self.of_word) >= self.KEPT:
                self.of_word.clear()
            found = self.of_word[word] = self.model.restore_word(word)
        return found

    def beginnings(self, word: str) -> list[str]:
        """Those of the word as it is written and as it was restored."""
        restored = self.restored(word)
        return beginnings(word) if restored == word else beginnings(word) + beginnings(restored)


def _signature(text: str) -> int:
    """Least hash of the text's shingles of five words: equal for most near copies."""
    words = text.lower().split()
    shingles = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    return min(xxhash.xxh64_intdigest(s) for s in shingles) >> 1


def _counts(sample: DataFrame, model: LanguageModel, label: int, only: frozenset[str] | None) -> Counter:
    """In how many of the sample's documents with the label every beginning is.

    ``only`` bounds the beginnings; without it, rare ones are left out.
    """

    def run(batches):
        restorer, total, docs = Restorer(model), Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                docs += 1
                found = {b for w in set(restorer.words(text)) for b in restorer.beginnings(w)}
                total.update(found if only is None else found & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    rows = sample.where(F.col("label") == label)
    counted = rows.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    if only is None:
        counted = counted.where(F.col("n") >= LEAST_DOCS)
    return Counter({r["gram"]: r["n"] for r in counted.collect()})  # of a bounded sample: see the module


class ToxicityModel:
    def __init__(self, language: LanguageModel, weights: dict[str, float], logistic: np.ndarray, base: float):
        self.language, self.weights, self.logistic, self.base = language, weights, logistic, base
        self.stems = {b[:3] for b in weights}

    def weight(self, word: str, restorer: Restorer) -> float:
        """Largest weight of the beginnings of the word, as written or restored; 0 for most words."""
        core = word.strip(_EDGE)
        if core[:3] not in self.stems and core.isalpha() and not TRACE.search(word):
            return 0.0
        return max((self.weights.get(b, 0.0) for b in restorer.beginnings(word)), default=0.0)

    def evidence(self, texts: list[str]) -> np.ndarray:
        """A row per text: for strong and for weak words distinct ones, all, and their share."""
        restorer, out = Restorer(self.language), np.zeros((len(texts), len(EVIDENCE)))
        seen: set[str] = set()
        tiers: tuple[set[str], set[str]] = (set(), set())
        for k, text in enumerate(texts):
            words = restorer.words(text)
            found = set(words)
            new = found - seen
            seen |= new
            for w in new:
                weight = self.weight(w, restorer)
                if weight > 0:
                    tiers[weight < STRONG].add(w)
            for tier, weighted in enumerate(tiers):
                hits = found & weighted
                if hits:
                    total = sum(w in hits for w in words)
                    out[k, 3 * tier : 3 * tier + 3] = math.log1p(len(hits)), math.log1p(total), min(1.0, 20 * total / len(words))
            if len(seen) > Restorer.KEPT:
                seen.clear()
                tiers[0].clear()
                tiers[1].clear()
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.logistic):
            return np.full(len(texts), self.base)
        z = self.evidence(texts) @ self.logistic[:-1] + self.logistic[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, bound: int = SAMPLE_ROWS) -> ToxicityModel:
    """The model of docs, learnt from at most ``bound`` labelled rows for which ``learnable`` holds."""
    known_to_workers(docs.sparkSession)
    language = language_model(docs)
    sample = labelled_sample(docs, labels, "toxic", learnable, bound)
    signed = with_batch_columns(sample, ["text"], {"signature": LongType()}, lambda texts: {"signature": pa.array(map(_signature, texts), pa.int64())})
    sample = signed.dropDuplicates(["signature", "label"])
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not other:
        return ToxicityModel(language, {}, np.zeros(0), toxic / max(1, toxic + other))
    in_toxic = _counts(sample, language, 1, None)
    in_other = _counts(sample, language, 0, frozenset(in_toxic))
    weights = {}
    for gram, t in in_toxic.items():
        n = in_other.get(gram, 0)
        odds = math.log((t + 0.5) / (toxic - t + 0.5)) - math.log((n + 0.5) / (other - n + 0.5))
        if odds >= LEAST_LOG_ODDS and _ratio_test(t, toxic, n, other) >= LEAST_RATIO_TEST:
            weights[gram] = odds
    model = ToxicityModel(language, weights, np.zeros(0), 0.0)

    def run(batches):
        for batch in batches:
            x = model.evidence(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1)], names=[*EVIDENCE, "label"])

    schema = ", ".join(f"{c} double" for c in EVIDENCE) + ", label int"
    rows = sample.select("text", "label").mapInArrow(run, schema).toArrow()  # at most ``bound``
    x = np.column_stack([rows[c].to_numpy() for c in EVIDENCE])
    order = np.lexsort([*x.T, rows["label"].to_numpy()])  # the same sums on every run
    model.logistic = fit_logistic(x[order], rows["label"].to_numpy()[order])
    return model


def _ratio_test(t: int, toxic: int, n: int, other: int) -> float:
    """Likelihood-ratio statistic of a beginning's counts against independence."""
    cells = ((t, toxic), (n, other))
    share = (t + n) / (toxic + other)
    total = 0.0
    for k, size in cells:
        for seen, expected in ((k, size * share), (size - k, size * (1 - share))):
            if seen:
                total += 2 * seen * math.log(seen / expected)
    return total


def with_scores(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each text."""

    def compute(texts):
        return {name: pa.array(model.scores([t or "" for t in texts]))}

    return with_batch_columns(docs, [text], {name: DoubleType()}, compute)


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """docs with score, held_out (crc32 of the id modulo 5 is 0; never learnt from) and predicted."""
    model = fit(docs, labels, fold(5) != 0, bound)
    scored = with_scores(docs, model)
    return scored.withColumn("held_out", fold(5) == 0).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
