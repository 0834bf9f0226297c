"""Vectorised hashes of words and byte n-grams over Arrow text buffers.

Texts lie one after the other in a byte array. A word is a run of ASCII letters, digits and bytes
from 0x80 on; ASCII capitals are folded on request. Word hashes come from prefix sums of
``byte * P**position`` modulo 2**64, so a block of any number of words takes a few array passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
#: Bytes that are hashed at once: their eight-byte sums stay in a core's cache.
PIECE = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

_codes = np.arange(256)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
ALNUM = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)
#: All bytes but space and 0x09 to 0x0D.
NON_SPACE = ~((_codes == 32) | ((_codes >= 9) & (_codes <= 13)))

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """P**i, or its inverse, for i below n."""
    if len(_powers[kind]) < n:
        base = _P if kind == "up" else np.uint64(pow(int(_P), -1, 1 << 64))
        steps = np.full(max(n, BLOCK + 1), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every bit of the input reaches every bit of the result."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _S33)
        h *= _M1
        h ^= h >> _S33
        h *= _M2
        h ^= h >> _S33
    return h


def combine(parts: list[np.ndarray], salt: int) -> np.ndarray:
    """One hash for each row of several hash arrays, in order."""
    with np.errstate(over="ignore"):
        out = np.full(len(parts[0]), mix(np.array([salt + 0x51ED27], np.uint64))[0], np.uint64)
        for p in parts:
            out = (out ^ p) * _P
            out ^= out >> _S33
    return mix(out)


def blocks(data: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end at a byte outside words, or at the end."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + PIECE, n)
        if to < n:
            gap = np.flatnonzero(~is_word[data[at:to]])
            while not len(gap) and to < n:
                last, to = to, min(to + PIECE, n)
                gap = np.flatnonzero(~is_word[data[last:to]]) + (last - at)
            to = at + int(gap[-1]) + 1 if len(gap) and to < n else to
        yield at, to
        at = to


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = ALNUM, lower: bool = True, stems: tuple[int, ...] = (), table: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """Hashes of all words in order, and the n + 1 offsets of the texts in them.

    ``table`` replaces each byte before hashing, in place of lower-casing. For each of ``stems``, hashes of the words' first so many bytes follow; 0 where a word is no longer than that.
    """
    table = table if table is not None else LOWER if lower else np.arange(256)
    wide = table.astype(np.uint64) + np.uint64(1)
    hashes, begins = [], []
    short: list[list[np.ndarray]] = [[] for _ in stems]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    for at, to in blocks(data, is_word):
        piece = data[at:to]
        inside = is_word[piece]
        before = np.empty(len(piece), bool)
        before[0], before[1:] = False, inside[:-1]
        begin = np.flatnonzero(inside & (~before | edge[at:to]))
        if not len(begin):
            continue
        after = np.empty(len(piece), bool)
        after[-1], after[:-1] = False, inside[1:]
        end = np.flatnonzero(inside & (~after | edge[at + 1 : to + 1])) + 1
        total = np.zeros(len(piece) + 1, np.uint64)
        with np.errstate(over="ignore"):
            values = wide[piece]
            values *= _power("up", len(piece))[: len(piece)]
            np.cumsum(values, out=total[1:])
            h = (total[end] - total[begin]) * _power("down", len(piece) + 1)[begin]
            h += (end - begin).astype(np.uint64) << np.uint64(48)
            for size, own in zip(stems, short):
                to_stem = np.minimum(begin + size, end)
                stem = mix((total[to_stem] - total[begin]) * _power("down", len(piece) + 1)[begin] + np.uint64(size))
                own.append(np.where(end - begin > size, stem, np.uint64(0)))
        hashes.append(mix(h))
        begins.append(begin + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), *(np.zeros(0, np.uint64) for _ in stems)
    bounds = np.searchsorted(np.concatenate(begins), offsets, side="left").astype(np.int64)
    return np.concatenate(hashes), bounds, *(np.concatenate(own) for own in short)


def sequence_hashes(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits (two columns) for the words of each text in order, from prefix sums as for words."""
    n = len(words)
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    with np.errstate(over="ignore"):
        for k, salt in enumerate((0x1F0D3804, 0x7A5BE915)):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(words + np.uint64(salt)) * _power("up", n + 1)[:n], out=total[1:])
            h = (total[bounds[1:]] - total[bounds[:-1]]) * _power("down", n + 1)[bounds[:-1]]
            out[:, k] = mix(h + np.diff(bounds).astype(np.uint64))
    return out


def grams(words: np.ndarray, bounds: np.ndarray, steps: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at ``i + s`` for each step s, never across texts, and the row of each."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    reach = max(steps)
    n = len(words) - reach
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.flatnonzero(rows[:n] == rows[reach : reach + n]) if reach else np.arange(n)
    return combine([words[inside + s] for s in steps], salt), rows[inside]
