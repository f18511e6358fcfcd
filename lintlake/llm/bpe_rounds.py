"""BPE encoding and decoding by vectorised merge rounds.

A batch of texts becomes one flat array of symbols, cut into words wherever no piece could
span two neighbouring characters. In every round each word finds its best pair by a
segmented minimum over pair ranks, merges all leftmost non-overlapping occurrences of it at
once, and the array is compacted. Words without a pair leave the array; the rounds end when
none is left. Equal words of a batch are merged once. Where several pieces share a score
(runs of blanks), the leftmost pair goes first, and a word's pairs are merged from the left.
"""

from __future__ import annotations

import numpy as np

from .piece_model import NO_RANK, SPACE_CODE, PieceModel

BATCH_CODES = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 2**64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in one array, and where each text starts (one more at the end)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def word_starts(model: PieceModel, codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where words start: at text starts, and where no piece holds the two characters in a row."""
    active = model.active_of[codes].astype(np.int32)
    cut = np.ones(len(codes), bool)
    cut[1:] = ~model.inside[active[:-1] * model.actives + active[1:]]
    cut[text_starts[:-1][text_starts[:-1] < text_starts[1:]]] = True
    return np.flatnonzero(cut)


def _distinct(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of a word with the same characters for each word, and those words' places."""
    n = len(codes)
    mixed = codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    with np.errstate(over="ignore"):
        powers = np.full(n, _ODD, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers, dtype=np.uint64)])
        back = np.full(n, np.uint64(_inverse(int(_ODD))), np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        ends = np.append(starts[1:], n)
        keys = (sums[ends] - sums[starts]) * back[starts]
        keys = keys * _ODD + (ends - starts).astype(np.uint64)
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    return number, first


def merge_words(model: PieceModel, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of all words, word by word, and the number of each word's symbols."""
    words = len(starts)
    lengths = np.diff(np.append(starts, len(symbols)))
    done_word, done_symbol = [], []
    word = np.repeat(np.arange(words), lengths)
    alone = lengths[word] == 1
    done_word.append(word[alone])
    done_symbol.append(symbols[alone])
    word, sym = word[~alone], symbols[~alone]

    def ranks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined piece of the pairs that begin at these positions."""
        inner = at + 1 < len(sym)
        inner[inner] = word[at[inner]] == word[at[inner] + 1]
        piece = np.full(len(at), -1, np.int32)
        piece[inner] = model.table.joined(sym[at[inner]], sym[at[inner] + 1])
        return model.rank_of[piece], piece

    rank, piece = ranks(np.arange(len(sym)))
    while len(sym):
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.append(heads, len(word)))
        best = np.minimum.reduceat(rank, heads)
        ended = best == NO_RANK
        if ended.any():
            over = np.repeat(ended, sizes)
            done_word.append(word[over])
            done_symbol.append(sym[over])
            on = ~over
            word, sym, rank, piece = word[on], sym[on], rank[on], piece[on]
            if not len(sym):
                break
            best, sizes = best[~ended], sizes[~ended]
            heads = np.cumsum(sizes) - sizes
        tied = model.tied[best]
        if tied.any():
            over = np.repeat(tied, sizes)
            made = [_merge_tied(model, sym[h : h + n], r) for h, n, r in zip(heads[tied], sizes[tied], best[tied])]
            counts = np.fromiter(map(len, made), np.int64, len(made))
            word = np.concatenate([word[~over], np.repeat(word[heads[tied]], counts)])
            sym = np.concatenate([sym[~over], *made])
            rank, piece = ranks(np.arange(len(sym)))
            continue
        hit = rank == np.repeat(best, sizes)
        at = np.flatnonzero(hit)
        run_head = np.r_[True, at[1:] != at[:-1] + 1]
        head_of = np.maximum.accumulate(np.where(run_head, np.arange(len(at)), 0))
        take = (at - at[head_of]) % 2 == 0
        at = at[take]
        sym[at] = piece[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        at = moved[at]
        word, sym, rank, piece = word[keep], sym[keep], rank[keep], piece[keep]
        near = np.zeros(len(sym), bool)
        near[at] = True
        near[at[at > 0] - 1] = True
        changed = np.flatnonzero(near)
        rank[changed], piece[changed] = ranks(changed)

    word, sym = np.concatenate(done_word), np.concatenate(done_symbol)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=words)


def _merge_tied(model: PieceModel, symbols: np.ndarray, rank: int) -> np.ndarray:
    """One word after all merges of a place that several pieces share: always the leftmost pair."""
    done: list[int] = []
    for symbol in symbols.tolist():
        done.append(symbol)
        while len(done) > 1:
            piece = model.pairs.get((done[-2], done[-1]), -1)
            if model.rank_of[piece] != rank:
                break
            done[-2:] = [piece]
    return np.array(done, np.int32)


def encode_flat(model: PieceModel, codes: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's ids start (one more at the end).

    The texts are given as they are merged, a leading blank included; none may be cut from
    its neighbour inside a word.
    """
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(text_starts), np.int64)
    starts = word_starts(model, codes, text_starts)
    number, first = _distinct(codes, starts)
    lengths = np.diff(np.append(starts, len(codes)))
    own = codes[spread(starts[first], lengths[first])]
    own_starts = np.cumsum(lengths[first]) - lengths[first]
    symbols = model.symbol_of[own]
    unknown = symbols < 0
    symbols[unknown] = -1 - own[unknown].astype(np.int32)
    symbols, counts = merge_words(model, symbols, own_starts)
    if unknown.any():
        symbols, counts = _as_bytes(model, symbols, counts)
    offsets = np.cumsum(counts) - counts
    per_word = counts[number]
    ids = symbols[spread(offsets[number], per_word)]
    ends = np.concatenate([[0], np.cumsum(per_word)])
    return ids, ends[np.searchsorted(starts, text_starts)]


def _as_bytes(model, symbols, counts):
    """Characters without a piece (negative symbols, alone in their word) become byte pieces."""
    at = np.flatnonzero(symbols < 0)
    made = [model.byte_ids[list(chr(-1 - int(s)).encode("utf-8", "replace"))] for s in symbols[at]]
    width = np.ones(len(symbols), np.int64)
    width[at] = [len(m) for m in made]
    out = np.repeat(symbols, width)
    out[spread((np.cumsum(width) - width)[at], width[at])] = np.concatenate(made)
    word = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(word, weights=width, minlength=len(counts)).astype(np.int64)


def pieces_of(text: str, limit: int = BATCH_CODES) -> list[str]:
    """A text with its leading blank, cut before blanks into parts of about ``limit`` at most."""
    if not text:
        return []
    text = " " + text
    parts, start = [], 0
    while len(text) - start > limit:
        cut = start + limit
        while cut > start and not (text[cut] == " " and text[cut - 1] not in " ▁"):
            cut = text.rfind(" ", start, cut)
        if cut <= start:  # no blank within the limit: on to the next one
            cut = start + limit
            while 0 <= cut < len(text) and not (text[cut] == " " and text[cut - 1] not in " ▁"):
                cut = text.find(" ", cut + 1)
            if cut < 0 or cut >= len(text):
                break
        parts.append(text[start:cut])
        start = cut
    parts.append(text[start:])
    return parts


def groups_of(texts: list[str], limit: int = BATCH_CODES):
    """Lists of (text number, part) of about ``limit`` code points, in order."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for part in pieces_of(text, limit):
            group.append((i, part))
            size += len(part)
            if size >= limit:
                yield group
                group, size = [], 0
    if group:
        yield group


def encode_texts(model: PieceModel, texts: list[str], limit: int = BATCH_CODES) -> list[np.ndarray]:
    """Ids of each text, without begin and end."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for group in groups_of(texts, limit):
        ids, bounds = encode_flat(model, *codes_of([part for _, part in group]))
        for k, (i, _) in enumerate(group):
            found[i].append(ids[bounds[k] : bounds[k + 1]])
    empty = np.zeros(0, np.int32)
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else empty for x in found]


def decode_ids(model: PieceModel, ids: np.ndarray) -> str:
    """Text of the ids: control pieces are empty, the blank put before a text is taken off.

    Byte pieces that do not form UTF-8 become U+FFFD.
    """
    ids = np.asarray(ids, np.int64)
    length = model.piece_length[ids]
    raw = model.piece_bytes[spread(model.piece_start[ids], length)].tobytes()
    first = ids[length > 0][:1]
    if len(first) and first[0] not in model.byte_ids and raw[:1] == b" ":
        raw = raw[1:]
    return raw.decode("utf-8", "replace")


__all__ = ["SPACE_CODE", "decode_ids", "encode_flat", "encode_texts", "groups_of", "codes_of"]
