"""Benchmark hits against comparing every window at every place."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintlake.llm import decontamination
from lintlake.llm.wu_manber import Searcher

ITEMS = "item_id long, text string"


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def expected(docs, items):
    found = []
    for doc_id, text in docs:
        words, hit, named = words_of(text), set(), set()
        for item, item_text in items:
            own = words_of(item_text)
            length = min(10, len(own))
            windows = {tuple(own[k : k + length]) for k in range(len(own) - length + 1)} if own else set()
            for at in range(len(words) - length + 1):
                if tuple(words[at : at + length]) in windows:
                    hit |= set(range(at, at + length))
                    named.add(item)
        listed = sorted(str(i) for i in named if i is not None)
        found.append((doc_id, len(words), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(found, key=str)


def check(spark, make_docs, docs, items, **more):
    got = decontamination.report(make_docs(docs), spark.createDataFrame(items, ITEMS), **more)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    wanted = expected(docs, items)
    assert sorted(map(tuple, got.collect()), key=str) == wanted
    return wanted


def planted(seed, n_docs=60, n_items=12):
    rng = random.Random(seed)

    def text(n):
        return " ".join(rng.choice(["a", "b", "c", "É9", "the", "w%d" % rng.randrange(30)]) for _ in range(n))

    items = [(i, text(rng.choice([1, 2, 3, 7, 9, 10, 11, 25, 40]))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        parts = [text(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            own = words_of(rng.choice(items)[1])
            at = rng.randrange(len(own))
            parts += [" , ".join(own[at : at + rng.randrange(1, 20)]).upper().replace("É", "É"), text(rng.randrange(5))]
        docs.append((i, "  ".join(parts)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_comparing_all_windows(spark, make_docs, seed):
    assert any(r[-1] for r in check(spark, make_docs, *planted(seed)))


def test_parts_give_the_same(spark, make_docs, monkeypatch):
    docs, items = planted(3, 30)
    monkeypatch.setattr(decontamination, "PIECE", 7)
    check(spark, make_docs, docs, items, part_words=60)


def test_odd_rows(spark, make_docs, odd_docs):
    items = [(1, None), (2, ""), (3, "!!"), (4, "one"), (4, "two words"), (4, "one"), (None, "no id"), (5, "no id"), (6, "漢字")]
    items += [(7, "gamma delta alpha beta gamma delta alpha beta gamma delta alpha")]
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(spark, make_docs, docs, items)
    check(spark, make_docs, docs, [])
    check(spark, make_docs, [], items)


def test_long_texts_are_cut_at_word_ends(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontamination, "BATCH_BYTES", 5)
    monkeypatch.setattr(decontamination, "BATCH_WORDS", 20)
    assert [w for p in decontamination.pieces_of_words("Abc défg, hij-klmnop") for w in p] == [w.encode() for w in words_of("Abc défg, hij-klmnop")]
    docs, items = planted(4, 20)
    check(spark, make_docs, docs, items)


def test_clashing_columns(spark, make_docs):
    docs = make_docs([(1, "one two three")]).selectExpr("*", "'a' AS Bench_Spans", "'b' AS bench_items", "'c' AS item", "'d' AS words")
    items = spark.createDataFrame([(1, "two three", "x")], "item_id long, text string, pieces string")
    found = decontamination.with_benchmark_hits(docs, items).first()
    assert (found.bench_words, found.bench_spans, found.bench_items) == (3, [1, 3], ["1"])
    assert (found.item, found.words, found.source) == ("c", "d", "src0")


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=8), max_size=5),
    st.lists(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30), min_size=1, max_size=4),
)
def test_search_finds_every_occurrence(owned, texts):
    searcher = Searcher(list(enumerate(owned)), 4)
    flat = np.concatenate([searcher.symbols(t) for t in texts])
    stops = np.cumsum([len(t) for t in texts])
    found = searcher.search(flat, np.r_[0, stops[:-1]].astype(np.int64), stops.astype(np.int64))
    got = {(int(e), int(n), int(o)) for e, n, s in zip(found.ends, found.lengths, found.sequences) for o in searcher.owners_of(s)}
    wanted = set()
    for t, stop in zip(texts, stops):
        for o, words in enumerate(owned):
            n = min(4, len(words))
            windows = [words[k : k + n] for k in range(len(words) - n + 1)]
            wanted |= {(int(stop) - len(t) + at + n - 1, n, o) for at in range(len(t) - n + 1) if t[at : at + n] in windows}
    assert got == wanted
