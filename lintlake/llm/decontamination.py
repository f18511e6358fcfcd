"""Benchmark passages in documents, by Wu-Manber search for all benchmark windows.

A-Z become lower case; words are runs of digits, letters and code points from 0x80 on. A window is ten
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Document words
inside any occurrence of a window are hit.

Benchmark items are cut into pieces of ``PIECE`` windows and dealt to parts of about ``PART_WORDS`` words
by hash; what the parts hold is counted first. A part is broadcast to the tasks as search tables and all
documents are searched for it where they are read, whole, without a shuffle. A benchmark of up to one part (the
usual case) takes one pass; a larger one takes a pass for each part, between which documents with what was
found so far are written to the shared folder, so no task or driver ever holds more than one part.

Null and empty texts have no words. Repeated documents are rows of their own; equal items count once. Hits
of items with a null id count as hits, but name no item; items with one id are one item. Documents'
other columns are kept, but for those named like a new one. Without documents there are no rows; without
items, or with items without words, nothing is hit.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from .common import bucket_of, with_batch_columns, written
from .wu_manber import Searcher

WINDOW = 10
PIECE = 5_000
PART_WORDS = 1_000_000
#: Words searched at once in a task, and bytes of a text cut into words at once.
BATCH_WORDS, BATCH_BYTES = 500_000, 1 << 20
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_END = re.compile(rb"[^0-9a-z\x80-\xff]")
NEW = {"bench_words": LongType(), "bench_spans": ArrayType(LongType()), "bench_items": ArrayType(StringType())}


def pieces_of_words(text: str | None, size: int = BATCH_BYTES):
    """The words of a text, list by list, in order."""
    line = (text or "").encode("utf-8", "surrogatepass").lower()
    at = 0
    while at < len(line):
        end = _END.search(line, at + size)
        stop = end.start() if end else len(line)
        yield _WORDS.findall(line, at, stop)
        at = stop


def benchmark_pieces(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words): items cut into pieces that have all windows between them."""

    def compute(texts):
        found = []
        for t in texts:
            words = [w for part in pieces_of_words(t) for w in part]
            cut = range(0, max(len(words) - WINDOW, 0) + 1, PIECE) if words else ()
            found.append([b" ".join(words[at : at + PIECE + WINDOW - 1]).decode("utf-8", "surrogatepass") for at in cut])
        return {"pieces": found}

    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    pieces = with_batch_columns(items, ["text"], {"pieces": ArrayType(StringType())}, compute)
    return pieces.select("item", F.explode("pieces").alias("words")).distinct()


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching [start, stop) pairs made one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.stack([spans[new, 0], reach[np.r_[new[1:], True]]], axis=1)


def _searched(docs: DataFrame, part: list, text: str) -> DataFrame:
    """docs with what one part of the benchmark adds to the three columns."""
    names = sorted({r.item for r in part if r.item is not None})
    number = {name: n for n, name in enumerate(names)}
    owned = [(number.get(r.item, -1), r.words.encode("utf-8", "surrogatepass").split(b" ")) for r in part]
    shared = docs.sparkSession.sparkContext.broadcast((Searcher(owned, WINDOW), names))

    def compute(texts, spans, items):
        searcher, listed = shared.value
        words, new_spans, new_items = [0] * len(texts), [None] * len(texts), [None] * len(texts)
        waiting, held = [], 0

        def search():
            if not waiting:
                return
            flat = np.concatenate([symbols for _, symbols in waiting] or [np.zeros(0, np.int32)])
            stops = np.cumsum([len(symbols) for _, symbols in waiting], dtype=np.int64)
            starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
            found = searcher.search(flat, starts, stops)
            of_text = np.searchsorted(stops, found.ends, "right")
            order = np.argsort(of_text, kind="stable")
            cuts = np.searchsorted(of_text[order], np.arange(len(waiting) + 1))
            for n, (row, symbols) in enumerate(waiting):
                own = order[cuts[n] : cuts[n + 1]]
                last = found.ends[own] - starts[n]
                both = np.stack([last - found.lengths[own] + 1, last + 1], axis=1)
                before = np.array(spans[row], np.int64).reshape(-1, 2)
                new_spans[row] = merged_spans(np.concatenate([before, both])).reshape(-1).tolist()
                owners = {int(o) for s in np.unique(found.sequences[own]) for o in searcher.owners_of(s)}
                new_items[row] = sorted({*items[row], *(listed[o] for o in owners if o >= 0)})
                words[row] = len(symbols)

        for row, t in enumerate(texts):
            symbols = [searcher.symbols(part) for part in pieces_of_words(t)]
            waiting.append((row, np.concatenate(symbols or [np.zeros(0, np.int32)])))
            held += len(waiting[-1][1])
            if held > BATCH_WORDS:
                search()
                waiting, held = [], 0
        search()
        return {"bench_words": pa.array(words, pa.int64()), "bench_spans": new_spans, "bench_items": new_items}

    return with_batch_columns(docs, [text, "bench_spans", "bench_items"], NEW, compute)


def with_benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """docs with ``bench_words`` (their number of words), ``bench_spans`` and ``bench_items``.

    Spans are word places, start and stop in turn, merged and in order; items are the ids, as strings in order, of
    the items a window of which occurs.
    """
    pieces = written(benchmark_pieces(benchmark), "bench-pieces")
    total = pieces.agg(F.sum(F.size(F.split("words", " ")))).first()[0] or 0
    parts = max(1, -(-total // part_words))
    named = {c for c in docs.columns if c.lower() in NEW}
    found = docs.drop(*named).withColumns({name: F.array().cast(kind) for name, kind in NEW.items() if name != "bench_words"})
    dealt = pieces.withColumn("part", bucket_of("item", "words", buckets=int(parts)))
    for part in range(parts):
        if part:
            found = written(found, "bench-found")
        found = _searched(found, dealt.where(F.col("part") == part).select("item", "words").collect(), text)
    return found


def report(docs: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """A row per document: its words, how many are hit, and the items found."""
    found = with_benchmark_hits(docs.select("doc_id", "text"), benchmark, part_words=part_words)
    hit = F.aggregate(
        F.transform("bench_spans", lambda place, n: F.when(n % 2 == 0, -place).otherwise(place)), F.lit(0).cast("long"), lambda a, b: a + b
    )
    return found.select(
        "doc_id",
        F.col("bench_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"),
        (F.size("bench_spans") > 0).alias("contaminated"),
    )
