"""Wu-Manber search for many sequences of words at once, over arrays of texts.

Symbols are words, as numbers of the vocabulary of the sequences searched for; words outside it are one
symbol more. Sequences of one length share tables: the shift table says, for the hash of a block of
two words, how far the window may move without passing over any sequence (a block that is in none lets
it move by nearly the whole length). Where the shift is zero, the hash of the window's
second half picks a bucket and the hash of its first half the sequences in it; each of these is compared
word by word.

Texts are searched in stretches that move on side by side, so every step is one numpy operation over
all stretches of a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 2
STRETCH = 256
_PART = 50_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every row."""
    found = np.full(len(columns), 17, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(columns.shape[1]):
            found = (found ^ columns[:, k].astype(np.uint64)) * _FACTOR
            found ^= found >> np.uint64(29)
    return found


@dataclass
class Found:
    """Occurrences: place of the last word, length, and number of the sequence."""

    ends: np.ndarray
    lengths: np.ndarray
    sequences: np.ndarray


class _Table:
    """Shift table and buckets of distinct sequences of one length."""

    def __init__(self, sequences: np.ndarray, first: int):
        self.length = sequences.shape[1]
        self.block = min(BLOCK, self.length)
        longest = self.length - self.block + 1
        size = 1 << int(4 * len(sequences) * longest).bit_length()
        self.mask = np.uint64(size - 1)
        self.shift = np.full(size, longest, np.int32)
        for at in range(longest):
            places = _mixed(sequences[:, at : at + self.block]) & self.mask
            np.minimum.at(self.shift, places.astype(np.int64), longest - 1 - at)
        keys = self._bucket(sequences)
        order = np.argsort(keys, kind="stable")
        self.keys, self.sequences, self.numbers = keys[order], sequences[order], order + first

    def _bucket(self, windows: np.ndarray) -> np.ndarray:
        half = self.length // 2
        with np.errstate(over="ignore"):
            return _mixed(windows[:, half:]) * _FACTOR + _mixed(windows[:, :half])

    def search(self, symbols: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the last word, numbers) of all occurrences inside the texts."""
        first = starts + self.length - 1
        many = np.maximum(-(-(stops - first) // STRETCH), 0)
        text = np.repeat(np.arange(len(starts)), many)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        at = first[text] + turn * STRETCH
        stop = np.minimum(at + STRETCH, stops[text])
        back = np.arange(1 - self.block, 1)
        candidates = [np.zeros(0, np.int64)]
        while len(at):
            step = self.shift[(_mixed(symbols[at[:, None] + back]) & self.mask).astype(np.int64)]
            zero = step == 0
            if zero.any():
                candidates.append(at[zero])
                step = step + zero
            at = at + step
            live = at < stop
            at, stop = at[live], stop[live]
        ends, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        listed = np.concatenate(candidates)
        for part in range(0, len(listed), _PART):
            own = listed[part : part + _PART]
            windows = symbols[own[:, None] + np.arange(1 - self.length, 1)]
            keys = self._bucket(windows)
            low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
            row = np.repeat(np.arange(len(own)), high - low)
            picked = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[row]
            equal = (self.sequences[picked] == windows[row]).all(axis=1)
            ends.append(own[row[equal]])
            numbers.append(self.numbers[picked[equal]])
        return np.concatenate(ends), np.concatenate(numbers)


class Searcher:
    """All distinct sequences, by length, with the owners of each."""

    def __init__(self, owned: list[tuple[int, list[bytes]]], window: int):
        """``owned`` lists (owner, words): searched for are all windows of so many words, of shorter ones the whole."""
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, list] = {}
        for owner, words in owned:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int32)
            length = min(window, len(ids))
            if length:
                rows = np.lib.stride_tricks.sliding_window_view(ids, length)
                by_length.setdefault(length, []).append((owner, rows))
        self.unknown = len(self.vocabulary)
        self.tables, owners, bounds = [], [], [np.zeros(1, np.int64)]
        first = 0
        for length, parts in sorted(by_length.items()):
            sequences, number = np.unique(np.concatenate([rows for _, rows in parts]), axis=0, return_inverse=True)
            owner = np.repeat([o for o, _ in parts], [len(rows) for _, rows in parts])
            pairs = np.unique(np.stack([number.reshape(-1), owner], axis=1), axis=0)
            owners.append(pairs[:, 1])
            bounds.append(np.searchsorted(pairs[:, 0], np.arange(len(sequences)), "right") + bounds[-1][-1])
            self.tables.append(_Table(sequences, first))
            first += len(sequences)
        self.owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        self.bounds = np.concatenate(bounds)

    def symbols(self, words: list[bytes]) -> np.ndarray:
        known, unknown = self.vocabulary, self.unknown
        return np.fromiter((known.get(w, unknown) for w in words), np.int32, len(words))

    def owners_of(self, sequence: int) -> np.ndarray:
        return self.owners[self.bounds[sequence] : self.bounds[sequence + 1]]

    def search(self, symbols: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Found:
        """All occurrences in texts that lie one after another in ``symbols``."""
        found = [(t.length, *t.search(symbols, starts, stops)) for t in self.tables]
        none = np.zeros(0, np.int64)
        return Found(
            np.concatenate([none, *(ends for _, ends, _ in found)]),
            np.concatenate([none, *(np.full(len(ends), length) for length, ends, _ in found)]),
            np.concatenate([none, *(numbers for _, _, numbers in found)]),
        )
