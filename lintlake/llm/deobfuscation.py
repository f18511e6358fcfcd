"""Restoring disguised words by Viterbi decoding under a character language model.

The channel turns letters into look-alikes (``1d10t``), puts separators between them
(``i.d.i.o.t``, ``i d i o t``) and repeats them (``iiidiot``). Read backwards, every character
of a passage stands for a few letters, or for nothing, or for the end of a word;
the passage is a lattice, and the path with the least cost under the channel and the language
model (three characters in a row) is the restored text. Which words are decoded is not a guess at what is disguised:
all are in which the channel can have left a trace, that is a sign, a mark between letters or a letter
twice in a row; the model decides whether anything is changed. Other words are their own only path.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_rounds import codes_of
from .common import known_to_workers

#: Symbols of the language model: word end, everything else, and the letters.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
END, OTHER = 0, 1
SYMBOLS = len(LETTERS) + 2
SYMBOL_OF = {c: i + 2 for i, c in enumerate(LETTERS)}
#: What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "ilt", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i",
}
SEPARATORS = " .-_*'~,·/"
_SIGN, _DROP, _REPEAT, _KEEP = 1.0, 0.7, 0.3, 4.0

_signs = re.escape("".join(LOOKALIKES))
_letter = r"[^\W\d_]"
_between = re.escape(SEPARATORS[1:])
#: What the channel can leave in a word: a look-alike, a mark between letters or signs, a letter twice in a row.
TRACE = re.compile(rf"[{_signs}]|[^\W_][{_between}]+(?=[^\W_])|({_letter})\1")
#: Single letters or signs with blanks between them, as many as one likes.
SPACED = re.compile(rf"(?<!\S)(?:\w|[{_signs}])(?:\s+(?:\w|[{_signs}])(?!\S)){{2,}}")
#: Marks before a word; signs other than the bracket may belong to it.
_HEAD = re.compile(r"[^\w@$!|+€£¡]*")


def trigram_counts(texts: list[str]) -> np.ndarray:
    """How often three symbols stand in a row in the texts' words."""
    flat, bounds = codes_of(["  " + t.lower() for t in texts] + ["  "])
    table = np.full(0x110000, OTHER, np.int32)
    for c, n in SYMBOL_OF.items():
        table[ord(c)] = n
    table[[0x20, *range(0x09, 0x0E), *map(ord, ".,;:!?")]] = END
    s = table[flat]
    keep = ~((s[2:] == END) & (s[1:-1] == END))
    return np.bincount(((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])[keep], minlength=SYMBOLS**3)


def core_of(word: str) -> str:
    """A word without the marks around it; look-alikes stay unless they are repeated at the end."""
    end = len(word)
    while end and not (word[end - 1].isalnum() or word[end - 1] in LOOKALIKES):
        end -= 1
    while end > 1 and not word[end - 1].isalnum() and word[end - 2] == word[end - 1]:
        end -= 2 if end > 2 and word[end - 3] != word[end - 1] else 1
    return word[_HEAD.match(word, 0, end).end() : end]


class LanguageModel:
    """Costs of a symbol after two others, from counts of three in a row."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        c3[:, OTHER, :] *= 0.01
        c2 = c3.sum(axis=0)
        p1 = (c2.sum(axis=0) + 1) / (c2.sum() + SYMBOLS)
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).astype(np.float32)

    def decode(self, passage: str) -> str:
        """The likeliest letters behind a passage (in lower case)."""
        return self.best_path(passage)[0]

    def best_path(self, passage: str) -> tuple[str, float]:
        """What ``decode`` gives, and its cost."""
        cost = self.cost
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(END, END): (0.0, None)}
        before = ""
        for c in passage:
            options: list[tuple[str, float]] = []
            if c in SYMBOL_OF:
                options.append((c, 0.0))
            elif c in LOOKALIKES:
                options += [(x, _SIGN) for x in LOOKALIKES[c]]
                options.append((c, _KEEP))
            if c == "*":
                options += [(x, _SIGN) for x in "aeiou"]
            if c in SEPARATORS:
                options += [("", _DROP), (" ", _DROP)]
            elif c == before:
                options.append(("", _REPEAT))
            if not options:
                options.append((c, 0.0))
            following: dict = {}
            for (a, b), (total, path) in best.items():
                for x, price in options:
                    if x == "":
                        state, now, trail = (a, b), total + price, path
                    elif x == " ":
                        now = total + price + (float(cost[a, b, END]) if b != END else 0.0)
                        state, trail = (END, END), (" ", path)
                    else:
                        symbol = SYMBOL_OF.get(x, OTHER)
                        state, now, trail = (b, symbol), total + price + float(cost[a, b, symbol]), (x, path)
                    old = following.get(state)
                    if old is None or now < old[0]:
                        following[state] = (now, trail)
            best, before = following, c
        total, path = min(((t + float(cost[a, b, END]), p) for (a, b), (t, p) in best.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out)), total

    def restore_word(self, word: str) -> str:
        """The likeliest word (or words) behind a word in lower case.

        One of signs alone is a number or ornament at the price of keeping its signs, unless letters cost less.
        """
        core = core_of(word)
        if not TRACE.search(core):
            return word
        read, cost = self.best_path(core)
        return read if cost < _KEEP * len(core) or any(c in SYMBOL_OF for c in core) else word


def language_model(docs: DataFrame, text: str = "text") -> LanguageModel:
    """The model of all texts: partial counts of each task, added up by Spark.

    The table has one row per three symbols that occur, fewer than ``SYMBOLS`` cubed whatever
    the number of documents; that many are sent to the driver.
    """
    known_to_workers(docs.sparkSession)

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            texts, size = [], 0
            for t in batch.column(0).to_pylist():
                if t:
                    texts.append(t)
                    size += len(t)
                if size > 2_000_000:
                    total += trigram_counts(texts)
                    texts, size = [], 0
            total += trigram_counts(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3)
    counts[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return LanguageModel(counts)
