"""Byte-level BPE by a rank queue, and decoding.

A pre-token's bytes are a linked list of parts. Every adjacent pair that the ranks know goes into the
bucket of its rank; a bitmap of three levels with 64-way words marks the buckets in use, so the lowest
rank is three find-first-set steps away. A bucket's positions are merged together, the leftmost of two that
share a part. A merge changes the pairs at both sides; their old entries stay and are skipped when they come
up. No part is looked at but those beside a merge, so long pre-tokens take time in proportion to their
length, and many short ones share one queue.

Null texts count as empty: no ids, no bytes. Repeated rows give equal results; columns but the text pass
through unread, and ``ids`` and ``decoded`` replace columns so named. Ids are stored as little-endian
unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from linkfold.llm.common import extended, row_groups

#: Texts are matched in stretches of about this many characters, cut where no match can cross.
STRETCH = 1 << 20
#: Pre-tokens whose ids each worker keeps from one group of texts to the next.
KEPT = 300_000
#: Texts of about so many characters are encoded together.
TOGETHER = 6_000_000


class RankQueue:
    """Arrays of positions by rank; the lowest rank leaves first, with all its positions."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Positions with a rank each; a rank below zero is none."""
        some = np.flatnonzero(ranks >= 0)
        if not len(some):
            return
        if len(some) == 1:
            self.push(int(ranks[some[0]]), positions[some])
            return
        some = some[np.argsort(ranks[some], kind="stable")]
        sorted_ranks, positions = ranks[some], positions[some]
        cuts = np.flatnonzero(sorted_ranks[1:] != sorted_ranks[:-1]) + 1
        begin = 0
        for end in [*cuts.tolist(), len(positions)]:
            self.push(int(sorted_ranks[begin]), positions[begin:end])
            begin = end

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank and its positions, ascending; the queue must not be empty (``top`` is not 0)."""
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        bits = self.low[a]
        rank = a << 6 | (bits & -bits).bit_length() - 1
        bucket = self.buckets.pop(rank)
        self.low[a] = bits & (bits - 1)
        if not self.low[a]:
            self.mid[b] = word & (word - 1)
            if not self.mid[b]:
                self.top &= self.top - 1
        return rank, np.unique(np.concatenate(bucket)) if len(bucket) > 1 else bucket[0]


class Codec:
    """Encodes and decodes by the ranks of one vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.queue = RankQueue(self.size)
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([ranks.get(bytes([b]), self.size) for b in range(256)], np.int64)
        # Every way to make a token of two others, by left * (size + 1) + right.
        keys, made = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left * (self.size + 1) + right)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.known: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two ids make, -1 for none."""
        keys = left * (self.size + 1) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian ids of each pre-token.

        All pre-tokens lie in one linked list with a gap after each, which no pair reaches across; as they
        do not affect each other, one queue serves them all, and a rank's positions are merged together.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes + 1)
        n = int(ends[-1]) + 1
        gap = self.size
        ids = np.full(n, gap, np.int64)
        inside = np.ones(n, bool)
        inside[0] = False
        inside[ends] = False
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        whole = [self.ranks.get(p, -1) for p in pieces]
        begins = np.concatenate([[1], ends[:-1] + 1])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.full(n, -1, np.int64)
        pair[:-1] = self.rank_of(ids[:-1], ids[1:])
        for k in np.flatnonzero(np.array(whole) >= 0):
            pair[begins[k] : ends[k]] = -1
        queue = self.queue
        queue.push_all(pair, np.arange(n))
        while queue.top:
            rank, at = queue.pop()
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                # Of pairs that share a part, every other one from the left.
                linked = np.flatnonzero(at[1:] == after[at[:-1]])
                if len(linked):
                    step = np.zeros(len(at), np.int64)
                    step[linked + 1] = 1
                    index = np.arange(len(at))
                    run = index - np.maximum.accumulate(np.where(step == 0, index, 0))
                    at = at[run % 2 == 0]
            gone = after[at]
            end = after[gone]
            ids[at] = rank
            pair[gone] = -1
            ids[gone] = -1
            after[at] = end
            before[end] = at
            left = before[at]
            touched = np.concatenate([at, left])
            found = self.rank_of(ids[touched], ids[after[touched]])
            pair[touched] = found
            queue.push_all(found, touched)
        for k in np.flatnonzero(np.array(whole) >= 0):
            ids[begins[k] : ends[k]] = -1
            ids[begins[k]] = whole[k]
        kept = np.flatnonzero((ids >= 0) & (ids < gap))
        packed = ids[kept].astype("<u4").tobytes()
        cut = (np.searchsorted(kept, np.concatenate([begins, [n]])) * 4).tolist()
        return [packed[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def stretches(self, text: str) -> Iterator[str]:
        """The text in pieces: a match never crosses from a character that is no space to a single space."""
        at = 0
        while len(text) - at > STRETCH:
            cut = _CUT.search(text, at + STRETCH)
            if not cut:
                break
            yield text[at : cut.start() + 1]
            at = cut.start() + 1
        yield text[at:] if at else text

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of whole texts; new pre-tokens of all of them are merged together."""
        found = [[self.pattern.findall(part) for part in self.stretches(t)] for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        new: set[str] = set()
        for parts in found:
            for part in parts:
                new.update(part)
        new.difference_update(self.known)
        if new:
            fresh = list(new)
            self.known.update(zip(fresh, self.merge_all([p.encode("utf-8", "surrogatepass") for p in fresh])))
        get = self.known.__getitem__
        return [b"".join(b"".join(map(get, part)) for part in parts) for parts in found]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CUT = regex.compile(r"\S(?= \S)")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return Codec(ranks, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``ids`` of every text and the bytes ``decoded`` from them; ``path`` is the rank file on every machine."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(text)]
            sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            for a, b in row_groups(sizes, TOGETHER):
                ids = own.encode_all(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(a, b - a) for c in keep]
                    + [pa.array(ids, pa.binary()), pa.array([own.decode(i) for i in ids], pa.binary())],
                    names=[*keep, "ids", "decoded"],
                )

    read = docs.select(*dict.fromkeys([*keep, text]))
    return read.mapInArrow(run, extended(read.select(*keep).schema, ids="binary", decoded="binary"))
