"""Surface statistics of texts, for the rules and the classifier."""

from __future__ import annotations

import numpy as np

from ledgerlark.llm import _words as W

REPEAT_WINDOW = 8


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


# The characters that count as symbols.
SYMBOLS = _table("#*$%&|<>")
CAPITAL = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
DIGIT = _table("0123456789")
MARK = _table("!\"#$%&()*+/:;<=>?@[\\]^_`{|}~")


def _repeats(words: W.Words, h: np.ndarray, n: int, row: np.ndarray) -> np.ndarray:
    """Which words lie in a window of n words that the text has twice or more."""
    ok = W.whole(words.first, n)
    at = np.flatnonzero(ok)
    g, of = W.windows(h, n)[at], row[at]
    order = W.by_row(of, g, len(words.at))
    g, of = g[order], of[order]
    same = (g[1:] == g[:-1]) & (of[1:] == of[:-1])
    twice = np.zeros(len(g), bool)
    twice[1:] |= same
    twice[:-1] |= same
    begin = at[order[twice]]
    edge = np.zeros(len(words) + 1, np.int32)
    edge[begin] += 1
    np.add.at(edge, begin + n, -1)
    return np.cumsum(edge)[:-1] > 0


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values of h in each row."""
    order = W.by_row(row, h, rows)
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=rows)


def statistics(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each text."""
    rows = len(at) - 1
    words = W.Words(raw, at)
    h, row = words.hashes(), words.row()
    char = (raw & 0xC0) != 0x80
    solid = ~W.SEPARATOR[raw]
    lines = W.Words(raw, at, W.NEWLINE)
    line_row = lines.row()
    filled = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(solid, out=filled[1:])
    real = filled[lines.end] > filled[lines.start]
    n_lines = np.bincount(line_row[real], minlength=rows)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    out = {
        "n_words": words.counts(),
        "word_chars": W.sums(char & solid, at),
        "n_symbols": W.sums(SYMBOLS[raw], at),
        "n_dup_lines": n_lines - _distinct(line_row[real], lines.hashes()[real], rows),
        "n_repeat_words": W.sums(_repeats(words, h, REPEAT_WINDOW, row), words.first),
        "n_lines": n_lines,
        "n_chars": W.sums(char, at),
        "n_capitals": W.sums(CAPITAL[raw], at),
        "n_letters": W.sums(LETTER[raw] | (raw >= 0xC0), at),
        "n_digits": W.sums(DIGIT[raw], at),
        "n_marks": W.sums(MARK[raw], at),
        "n_again": W.sums(again, words.first),
        "n_distinct": _distinct(row, h, rows),
    }
    return {k: v.astype(np.int64) for k, v in out.items()}
