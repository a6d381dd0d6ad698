"""Splitting texts into words for tokenizers, a whole Arrow batch at a time, and finding the distinct words.

Characters get a class (letter, number, space, other) from one table; word borders follow from where classes
change, so the rules of the two split patterns below are array operations and not one regex match a word.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import xxhash

OTHER, LETTER, NUMBER, SPACE = range(4)
# The code points with the property White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


@dataclass
class Words:
    """Words of a batch of texts: the texts' bytes, each word's first byte and size, each text's number of words."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray


def split(texts: list[str], keep_spaces: bool) -> Words:
    """The matches of a split pattern in each text.

    keep_spaces: as ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``;
    otherwise as ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+``, which drops white space.
    """
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    data = np.frombuffer(whole.encode(), np.uint8)
    n = len(points)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not n:
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64))
    kind = classes()[points]
    border = np.empty(n + 1, bool)  # a word, or a stretch of spaces, begins here
    border[0] = border[n] = True
    np.not_equal(kind[1:], kind[:-1], out=border[1:n])
    first = np.zeros(n + 1, bool)
    first[np.cumsum(lengths)] = first[0] = True
    border |= first
    runs = np.flatnonzero(border)
    begin, end = runs[:-1], runs[1:]
    of = kind[begin]
    if keep_spaces:
        space = (of == SPACE) & ~first[end]  # something follows in the same text: the last space is a word or begins one
        last = end[space] - 1
        border[last] = True
        border[end[space][points[last] == 32]] = False
    else:
        border[:n] |= kind == NUMBER
    # an apostrophe alone, with letters behind: the known endings go with it
    quote = (of == OTHER) & (end - begin == 1) & (points[begin] == 39) & border[begin] & ~first[end]
    if quote.any():
        at = end[quote]
        padded = np.concatenate([points, [0, 0]])
        one, two = padded[at], padded[at + 1]
        two = np.where(first[at + 1] | (border[at + 1] & (kind[np.minimum(at + 1, n - 1)] != LETTER)), 0, two)
        is_in = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        taken = np.where(is_in(one, "stmd"), 1, 0)
        for a, b in ("re", "ve", "ll"):
            taken[(one == ord(a)) & (two == ord(b))] = 2
        at, taken = at[taken > 0], taken[taken > 0]
        border[at] = False
        border[at + taken] = True
    starts = np.flatnonzero(border[:n])
    ends = np.append(starts[1:], n)
    if not keep_spaces:
        real = kind[starts] != SPACE
        starts, ends = starts[real], ends[real]
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)])))
    if len(data) != n:
        each = np.ones(n, np.uint8)
        for least in (0x80, 0x800, 0x10000):
            each += points >= least
        offset = np.zeros(n + 1, np.int64)
        np.cumsum(each, out=offset[1:])
        starts, ends = offset[starts], offset[ends]
    return Words(data, starts, ends - starts, counts)


def _eight(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each position on, as a number."""
    found = data[at[:, None] + np.arange(8)].view("<u8").ravel()
    bits = np.clip(sizes, 0, 8).astype(np.uint64) * np.uint64(8)
    return np.where(bits < 64, found & ((np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1)), found)


def numbers(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each word: its bytes if it has up to 16, a hash otherwise."""
    data = np.concatenate([words.data, np.zeros(16, np.uint8)])
    low, high = _eight(data, words.starts, words.sizes), _eight(data, np.minimum(words.starts + 8, len(data) - 8), words.sizes - 8)
    for i in np.flatnonzero(words.sizes > 16):
        h = xxhash.xxh3_128_intdigest(words.data[words.starts[i]: words.starts[i] + words.sizes[i]])
        low[i], high[i] = h & (2**64 - 1), h >> 64
    return low, high


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its distinct word, and for each distinct word one place where it is.

    Words of up to 16 bytes are compared whole, longer ones by a 128-bit hash.
    """
    import pandas as pd

    low, high = numbers(words)
    sizes = words.sizes.astype(np.uint64)
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93):
        key = low * np.uint64(seed)
        key ^= key >> np.uint64(29)
        key += (high ^ (high >> np.uint64(31))) * np.uint64(seed ^ 0x5851F42D4C957F2D)
        key += sizes * np.uint64(0x94D049BB133111EB)
        codes, found = pd.factorize(key)
        model = np.zeros(len(found), np.int64)
        model[codes[::-1]] = np.arange(len(codes))[::-1]
        of = model[codes]
        if (low[of] == low).all() and (high[of] == high).all() and (words.sizes[of] == words.sizes).all():
            return codes, model
    raise RuntimeError("no seed tells the words apart")
