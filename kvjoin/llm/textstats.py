"""Word and byte statistics of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII white space 0x20, 0x09-0x0D: what bytes.split() splits at.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
START = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER, LOWER, DIGIT = (np.zeros(256, bool) for _ in range(3))
UPPER[65:91], LOWER[97:123], DIGIT[48:58] = True, True, True
WINDOW = 8
MIX = np.uint64(0x9E3779B97F4A7C15)

FEATURES = ["symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "bangs_per_word", "bars_per_word", "digit_share", "mean_word", "log_words", "distinct_share", "words_per_line", "lines"]
#: -1: more of it never raises the score; 0: free.
MONOTONE = [-1, -1, -1, -1, -1, -1, 0, 0, 0, 0, 0, 0]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive word hashes, by position."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * MIX + words[k : k + m]
        h ^= h >> np.uint64(29)
    return h


def repeated_words(words: np.ndarray, n: int = WINDOW) -> int:
    """How many words lie in windows of n words that the text has twice or more."""
    h = window_hashes(words, n)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def stats(text: bytes | None) -> tuple[list[int], list[float]]:
    """BASE counts and FEATURES of one text; null as the empty text."""
    text = text or b""
    words = text.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(hist[START & ~SPACE].sum())
    symbols = int(hist[SYMBOLS].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeat = repeated_words(hashes)
    w, c = max(n, 1), max(chars, 1)
    letters = max(int(hist[UPPER].sum() + hist[LOWER].sum()), 1)
    features = [
        symbols / w, dup / max(len(lines), 1), repeat / w, hist[UPPER].sum() / letters, hist[33] / w, hist[124] / w, hist[DIGIT].sum() / c,
        chars / w, np.log1p(n), len(set(words)) / w, n / max(len(lines), 1), len(lines),
    ]
    return [n, chars, symbols, dup, repeat], [float(x) for x in features]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes that are equal on every machine."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
