"""Pieces of a BPE ``.model`` file as arrays: symbols, merge ranks, bytes, cuts.

Read once in each Python worker. ``sentencepiece`` is used to read the vocabulary only;
the encoders of this package do their own merging.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = "▁"
SPACE_CODE = 0x2581
NO_RANK = np.int32(2**31 - 1)
CODES = 0x110000


class PairTable:
    """Open-addressing table from a pair of piece ids to the id of the joined piece."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(8, int(np.ceil(np.log2(max(len(pairs), 1) * 4))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        keys = np.array([left << 32 | right for left, right in pairs], np.int64)
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = self._slot(keys)
        todo = np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slots[todo]] < 0]
            # The first of several keys for one free slot takes it; the others go on.
            _, first = np.unique(slots[free], return_index=True)
            taken = free[first]
            self.keys[slots[taken]] = keys[taken]
            self.values[slots[taken]] = values[taken]
            todo = np.setdiff1d(todo, taken, assume_unique=True)
            slots[todo] = (slots[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that left and right make, -1 where there is none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.keys[slots]
            hit = found == keys
            out[todo[hit]] = self.values[slots[hit]]
            on = ~hit & (found >= 0)
            if not on.any():
                break
            todo, keys, slots = todo[on], keys[on], (slots[on] + 1) & self.mask
        return out


#: Texts that any normaliser would change: blanks at the ends and in a row, wide and joined letters, marks, tabs.
PROBES = ("  a  b ", " \tﬁ\n ", "Ａé \u0301①", "▁x ", "\u00a0x\u200b")


def refuse_other_rules(model) -> None:
    """ValueError for a model whose rules differ from those that this package follows.

    These are: no normalising, one blank put before a text that is not empty, blanks kept as they are,
    and merges in the order of whole-number scores.
    """
    for probe in ("", "a", *PROBES):
        if model.normalize(probe) != (SPACE + probe.replace(" ", SPACE) if probe else ""):
            raise ValueError(f"the model changes {probe!r} before it is encoded, which is not supported")
    if any(model.get_score(i) % 1 for i in range(model.vocab_size())):
        raise ValueError("the scores are not an order of merges: not a BPE model")


class PieceModel:
    """Vocabulary of one model file; others than ``refuse_other_rules`` describes are refused.

    ``symbol_of``  code point to the id of its one-character piece, else -1
    ``rank_of``    piece id to its place in the merge order; equal scores share a place
    ``tied``       places that several pieces share
    ``active_of``  code point to a small number if some longer piece holds it, else 0
    ``inside``     may the two active characters stand side by side inside a piece
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        refuse_other_rules(model)
        size = model.vocab_size()
        self.size = size
        self.begin, self.end = model.bos_id(), model.eos_id()
        normal, byte_ids, bytes_of = {}, np.full(256, -1, np.int32), []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                bytes_of.append(b"")
            else:
                normal[piece] = i
                bytes_of.append(piece.replace(SPACE, " ").encode())
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        self.pieces, self.byte_ids = normal, byte_ids
        self.score = np.array([model.get_score(i) for i in range(size)])
        self.piece_bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.piece_length = np.array([len(b) for b in bytes_of], np.int64)
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length

        self.symbol_of = np.full(CODES, -1, np.int32)
        active: dict[str, int] = {}
        neighbours, pairs = set(), {}
        for piece, i in normal.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
                continue
            for c in piece:
                active.setdefault(c, len(active) + 1)
            neighbours.update(zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                left, right = normal.get(piece[:cut]), normal.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = i
        self.symbol_of[ord(" ")] = self.symbol_of[SPACE_CODE]
        self.pairs = pairs
        self.table = PairTable(pairs)
        self.active_of = np.zeros(CODES, np.uint16)
        for c, n in active.items():
            self.active_of[ord(c)] = n
        self.active_of[ord(" ")] = self.active_of[SPACE_CODE]
        self.actives = len(active) + 1
        self.inside = np.zeros(self.actives * self.actives, bool)
        for a, b in neighbours:
            self.inside[active[a] * self.actives + active[b]] = True

        joined = sorted({-self.score[i] for i in pairs.values()})
        place = {score: n for n, score in enumerate(joined)}
        self.rank_of = np.full(size + 1, NO_RANK, np.int32)  # the last is for "no piece"
        for i in set(pairs.values()):
            self.rank_of[i] = place[-self.score[i]]
        counts = np.bincount(self.rank_of[list(set(pairs.values()))], minlength=len(joined))
        self.tied = counts > 1


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)
