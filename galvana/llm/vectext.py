"""Whole-array text helpers that run inside Arrow tasks.

All functions work on the concatenation of several texts and a vector of the
texts' offsets, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex

U64 = np.uint64
#: An odd multiplier, invertible modulo 2**64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of the public splitmix64 generator)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=U64)
    return _POWERS[0], _POWERS[1]


#: Spans of so many symbols and more are hashed by scrambled symbols instead of a polynomial.
LONG = 64


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span of ``symbols``; equal spans get equal hashes wherever they stand.

    Short spans take a polynomial modulo 2**64. Its low bits are weak: long spans
    that mirror each other (Thue-Morse words) can share one whatever the base, so a
    long span sums scrambled numbers of its symbols and their places instead.
    """
    n = len(symbols)
    power, inverse = _powers(n + 1)
    prefix = np.zeros(n + 1, U64)
    np.cumsum((symbols.astype(U64) + U64(1)) * power[:n], out=prefix[1:])
    size = ends - starts
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    long = np.flatnonzero(size >= LONG)
    if len(long):
        own = size[long]
        first = np.cumsum(own) - own
        place = np.arange(int(own.sum())) - np.repeat(first, own)
        value = mix(symbols[np.repeat(starts[long], own) + place].astype(U64) + (place.astype(U64) + U64(1)) * U64(0xA24BAED4963EE407))
        h[long] = np.add.reduceat(value, first)
    return mix(h + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def distinct_spans(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every span its number among the distinct ones, of these the first span of each and its hash.

    Spans follow each other without gaps. Spans of one hash are compared with the
    first of them, symbol by symbol, so unlike ones never share a number.
    """
    codes, distinct = pd.factorize(span_hashes(symbols, starts, ends))
    where = np.empty(len(distinct), np.int64)
    where[codes[::-1]] = np.arange(len(codes))[::-1]
    size = ends - starts
    shift = (starts[where][codes] - starts).astype(np.int32 if len(symbols) < 2**31 else np.int64)
    own = np.arange(starts[0], ends[-1], dtype=shift.dtype)
    other = own + np.repeat(shift, size)  # never beyond a span's own place: the first stands before
    differs = symbols[other] != symbols[starts[0] : ends[-1]]
    unlike = size != size[where][codes]
    if differs.any():
        unlike |= np.logical_or.reduceat(differs, starts - starts[0])
    if unlike.any():
        found: dict[bytes, int] = {}
        for k in np.flatnonzero(unlike).tolist():
            raw = symbols[starts[k] : ends[k]].tobytes()
            if raw not in found:
                found[raw] = len(where)
                where, distinct = np.append(where, k), np.append(distinct, distinct[codes[k]])
            codes[k] = found[raw]
    return codes, where, distinct


def chunks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to ``limit`` at most; a larger row stands alone."""
    first, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield first, k
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def character_classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(lo, hi)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for found in regex.finditer(pattern, every):
                table[lo + found.start() : lo + found.end()] = kind
    return table


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the offsets of the texts among them (one more than texts)."""
    symbols = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return symbols, offsets


def pretoken_starts(symbols: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Start of every match of the byte-level BPE pattern.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
    ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``; its matches tile each text, so the next
    start ends a match. A run of one class is a match, but for three rules: a
    plain space joins the run after it; a run of white space before other text
    leaves its last character; a lone apostrophe takes its contraction's letters.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[symbols]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    run = edge[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    space = kind == SPACE
    joins = np.zeros(n, bool)  # a run's first character with a plain space before it
    joins[1:] = run[1:] & ~edge[1:n] & ~space[1:] & (symbols[:-1] == 0x20)
    start[joins] = False
    last = np.zeros(n, bool)  # the last white space before other text
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    start |= last
    quotes = np.flatnonzero((symbols == 0x27) & run & ~joins)
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[(kind[quotes + 1] == LETTER) & ~edge[quotes + 1]]
    if len(quotes):
        one = symbols[quotes + 1]
        after = np.minimum(quotes + 2, n - 1)
        two = np.where((quotes + 2 < n) & ~edge[quotes + 2], symbols[after], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        taken = short | long
        quotes, end = quotes[taken], (quotes + np.where(short, 2, 3))[taken]
        start[quotes + 1] = False
        end = end[end < n]
        start[end[(kind[end] == LETTER) & ~edge[end]]] = True
    return np.flatnonzero(start)


def ascii_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z in lower case, and each text's first word."""
    joined = b" ".join(texts).lower()
    symbols = np.frombuffer(joined, np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=offsets[1:])
    inside = np.zeros(len(symbols) + 2, bool)
    inside[1:-1] = (symbols != 0x20) & ((symbols < 0x09) | (symbols > 0x0D))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[0::2], turns[1::2]
    return span_hashes(symbols, starts, ends), np.searchsorted(starts, offsets)
