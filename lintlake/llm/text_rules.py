"""Counts over a whole text that quality rules need."""

from __future__ import annotations

#: Bytes between words, and the characters that count as symbols.
BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")


def repeated_in_windows(words: list[bytes], window: int = 3) -> int:
    """Number of words that stand in a window of words found twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    grams = list(zip(*(words[k:] for k in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    seen: set = set()
    twice = set()
    for g in grams:
        (twice if g in seen else seen).add(g)
    covered, end = 0, 0
    for i, g in enumerate(grams):
        if g in twice:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def repeated_lines(lines: list[str]) -> int:
    """Number of lines with a word that equal an earlier line."""
    full = [x for x in lines if x and x.encode("utf-8", "surrogatepass").strip()]
    return len(full) - len(set(full))


def count_text(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks, symbols = sum(map(raw.count, BLANKS)), sum(map(raw.count, SYMBOLS))
    return len(words), len(text) - blanks, symbols, repeated_lines(text.split("\n")), repeated_in_windows(words)
