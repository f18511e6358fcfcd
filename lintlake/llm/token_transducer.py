"""A deterministic transducer that counts the tokens of BPE without making them.

State. After a prefix of a text, what counts for the rest is, for every start from which a
piece could still grow over the end of the prefix, the trie node reached from there, the last
token of the text before that start, and the number of tokens up to there compared with the
number up to the end. A list of these is a state; there are finitely many, for pieces are
short. At every end of a prefix exactly one piece can be the last token: the one whose left
neighbour it does not merge with (two pieces may stand side by side if they encode, joined,
to themselves). So a character leads to one next state and changes the number of tokens by a
known amount, and both are written on the transition.

Compilation is lazy: a transition is made when it is first taken, into a dense table over
states and character classes, which is emptied once it exceeds a fixed size.

Running. A character that no piece holds next to the one before it leads to the same state
from everywhere. Texts are laid end to end and cut into chunks of equal length; all chunks
step through the table side by side. What a chunk does to a state it gets is a map: constant
after its first such character, a walk over its head before that. Maps are composed from left
to right, each round resolving all chunks whose left neighbour is resolved.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .bpe_rounds import codes_of, groups_of, word_starts
from .piece_model import PieceModel, piece_model

#: Table cells (of 4 bytes) after which compilation starts anew.
TABLE_CELLS = 24_000_000
CHUNK = 192
_SHIFT, _ZERO = 7, 64
_NONE = -1


class Transducer:
    def __init__(self, model: PieceModel):
        self.model = model
        self.agree: dict[tuple[int, int], bool] = {}
        # Trie over the pieces: children by code point, piece id at the node.
        self.children: list[dict[int, int]] = [{}]
        self.piece: list[int] = [-1]
        for text, i in model.pieces.items():
            node = 0
            for code in map(ord, text):
                found = self.children[node].get(code)
                if found is None:
                    found = self.children[node][code] = len(self.children)
                    self.children.append({})
                    self.piece.append(-1)
                node = found
            self.piece[node] = i
        self.text_id = model.pieces
        self.text_of = {i: p for p, i in model.pieces.items()}
        self.rank = model.rank_of.tolist()
        # Classes of characters that end every word: by the tokens they make.
        self.class_of = np.zeros(len(model.symbol_of), np.uint16)
        known = model.symbol_of >= 0
        codes = np.arange(len(known))
        self.class_of[:] = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)  # bytes of UTF-8
        self.class_of[0xD800:0xE000] = 1  # "?" stands for what UTF-8 cannot hold
        self.class_of[known & (model.active_of == 0)] = 1
        self.class_of[model.active_of > 0] = model.active_of[model.active_of > 0] + 4
        self.classes = model.actives + 4
        self.code_of = np.zeros(self.classes, np.int64)
        active = np.flatnonzero(model.active_of > 0)
        self.code_of[self.class_of[active]] = active
        self.code_of[self.class_of[ord(" ")]] = ord("▁")
        self.reset()

    def reset(self) -> None:
        """Empty the table. State 0 takes no part: chunk heads wait in it. State 1 starts a word."""
        self.states: list[tuple] = [(), ((0, _NONE, 0),)]
        self.number = {state: n for n, state in enumerate(self.states)}
        self.column_of = np.full(self.classes, -1, np.int16)
        self.kinds: list[int] = []
        self.table = np.full((1024, 64), -1, np.int32)
        self.table[0] = _ZERO

    def columns(self, kinds: np.ndarray) -> np.ndarray:
        """The table's columns of the classes; those not seen so far get new ones."""
        columns = self.column_of[kinds]
        if (columns < 0).any():
            for kind in np.unique(kinds[columns < 0]).tolist():
                self.column_of[kind] = len(self.kinds)
                self.kinds.append(kind)
            if len(self.kinds) > self.table.shape[1]:
                wider = np.full((len(self.table), -(-len(self.kinds) // 64) * 64), -1, np.int32)
                wider[:, : self.table.shape[1]] = self.table
                wider[0] = _ZERO
                self.table = wider
            columns = self.column_of[kinds]
        return columns

    def agrees(self, left: int, right: int) -> bool:
        """Do the two pieces, joined, encode to themselves?"""
        found = self.agree.get((left, right))
        if found is None:
            pieces = [right] if left == _NONE else [left, right]
            found = self._merged("".join(self.text_of[i] for i in pieces)) == pieces
            self.agree[left, right] = found
        return found

    def _merged(self, text: str) -> list[int]:
        """A few characters, merged pair by pair."""
        ids, pairs, rank = [self.text_id[c] for c in text], self.model.pairs, self.rank
        made = [pairs.get(pair) for pair in zip(ids, ids[1:])]
        while True:
            best, at = min(((rank[m], k) for k, m in enumerate(made) if m is not None), default=(0, -1))
            if at < 0:
                return ids
            ids[at : at + 2] = [made[at]]
            del made[at]
            if at:
                made[at - 1] = pairs.get((ids[at - 1], ids[at]))
            if at + 1 < len(ids):
                made[at] = pairs.get((ids[at], ids[at + 1]))

    def compile(self, state: int, kind: int) -> int:
        """The packed transition: next state, and the change of the number of tokens."""
        if kind <= 4:
            return 1 << _SHIFT | (kind + _ZERO)
        code = int(self.code_of[kind])
        entries = self.states[state]
        on = [(self.children[node][code], last, count) for node, last, count in entries if code in self.children[node]]
        if len(on) == 1 and on[0][2] == 0 and entries[-1][0] == 0 and on[0][0] == self.children[0].get(code):
            on = [(on[0][0], _NONE, 0)]  # no piece spans the place before this character
        ends = [(count + 1, self.piece[node]) for node, last, count in on if self.piece[node] >= 0 and self.agrees(last, self.piece[node])]
        if len(ends) != 1:
            raise ValueError(f"{len(ends)} pieces can end at one place: the model's merges are not ordered")
        change, token = ends[0]
        following = tuple((node, last, count - change) for node, last, count in on if self.children[node]) + ((0, token, 0),)
        number = self.number.get(following)
        if number is None:
            number = self.number[following] = len(self.states)
            self.states.append(following)
            if number >= len(self.table):
                more = np.full(self.table.shape, -1, np.int32)
                self.table = np.concatenate([self.table, more])
        return number << _SHIFT | (change + _ZERO)

    def step(self, states: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        packed = self.table[states, columns]
        missing = packed < 0
        if missing.any():
            wanted = np.unique(states[missing].astype(np.int64) * self.classes + columns[missing])
            for key in wanted.tolist():
                state, column = divmod(key, self.classes)
                made = self.compile(state, self.kinds[column])
                self.table[state, column] = made
            packed = self.table[states, columns]
        return packed >> _SHIFT, (packed & (2 * _ZERO - 1)) - _ZERO

    def changes(self, codes: np.ndarray, text_starts: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """For every character, by how much it changes the number of tokens of its text."""
        if self.table.size > TABLE_CELLS:
            self.reset()
        length = len(codes)
        chunks = -(-length // chunk)
        fresh = np.zeros(chunks * chunk, bool)
        fresh[word_starts(self.model, codes, text_starts)] = True
        kinds = np.full(chunks * chunk, 1, np.uint16)
        kinds[:length] = self.class_of[codes]
        kinds = np.ascontiguousarray(self.columns(kinds).reshape(chunks, chunk).T)
        fresh = np.ascontiguousarray(fresh.reshape(chunks, chunk).T)
        made = np.zeros((chunk, chunks), np.int8)
        states = np.zeros(chunks, np.int32)
        for k in range(chunk):
            states[fresh[k]] = 1
            states, made[k] = self.step(states, kinds[k])
        # Heads: characters before a chunk's first word start, with the state the left one ends in.
        head = np.where(fresh.any(axis=0), fresh.argmax(axis=0), chunk)
        open_ = np.flatnonzero(head > 0)
        while len(open_):
            ready = open_[(open_ == 0) | (states[open_ - 1] > 0)]
            own = states[ready - 1]
            whole = head[ready] == chunk
            for k in range(int(head[ready].max())):
                on = k < head[ready]
                at = ready[on]
                own[on], made[k, at] = self.step(own[on], kinds[k, at])
            states[ready[whole]] = own[whole]
            open_ = np.setdiff1d(open_, ready, assume_unique=True)
        return made.T.reshape(-1)[:length]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(piece_model(path))


def count_tokens(machine: Transducer, texts: list[str]) -> np.ndarray:
    """Number of tokens of each text, without begin and end."""
    out = np.zeros(len(texts), np.int64)
    for group in groups_of(texts):
        codes, bounds = codes_of([part for _, part in group])
        made = np.concatenate([[0], np.cumsum(machine.changes(codes, bounds), dtype=np.int64)])
        np.add.at(out, [i for i, _ in group], made[bounds[1:]] - made[bounds[:-1]])
    return out
