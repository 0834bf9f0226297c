"""Near-duplicates by min-max hashing, with links confirmed on full shingle sets.

A document's set holds its distinct five-word shingles, as 64-bit hashes; A-Z is lower-cased and words are
runs without ASCII white space. Under each of the permutations both the smallest and the largest hash are
kept, so ``2 * PERMUTATIONS`` values come from half as many hash evaluations. Bands of four values, of the
minima or of the maxima of different permutations, are the candidates' keys: two sets with a Jaccard
similarity of 0.75 share none of the 30 bands with a probability of about 1e-5.

Documents with equal sets are one class, known by its smallest id, and only classes meet. A link needs
``100 * intersection >= 75 * union`` on the full sets.

Documents without words or text have an empty set and are linked with nothing. With fewer words than five the
whole sequence is the one shingle. Rows with a null id are linked with nothing and have no component. Rows
that share an id are one document, linked by any of its texts. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkfold.llm import hashing
from linkfold.llm.common import row_groups, text_buffer, written
from linkfold.llm.linkage import linked_components

WORDS = 5
PERMUTATIONS = 60
ROWS = 4
_rng = np.random.default_rng(20240)
_MULTIPLY = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, ordered by text, and the n + 1 offsets of the texts in them; repeats included."""
    words, bounds = hashing.word_hashes(data, offsets, hashing.NON_SPACE, lower=True)
    sizes = np.diff(bounds)
    found, rows = hashing.grams(words, bounds, tuple(range(WORDS)), WORDS)
    for n in range(1, WORDS):
        short = np.flatnonzero(sizes == n)
        if len(short):
            found = np.concatenate([found, hashing.combine([words[bounds[short] + k] for k in range(n)], n)])
            rows = np.concatenate([rows, short])
    order = np.argsort(rows, kind="stable")
    return found[order], np.searchsorted(rows[order], np.arange(len(offsets))).astype(np.int64)


def sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    found, bounds = shingles(data, offsets)
    return [np.unique(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def band_keys(own: list[np.ndarray]) -> np.ndarray:
    """Band keys (texts by bands) of sets that are not empty."""
    flat = np.concatenate(own)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in own])])[:-1]
    low, high = [], []
    with np.errstate(over="ignore"):
        for m, a in zip(_MULTIPLY, _ADD):
            h = flat * m
            h += a
            h ^= h >> np.uint64(29)
            h *= m
            low.append(np.minimum.reduceat(h, begin))
            high.append(np.maximum.reduceat(h, begin))
    bands = [side[k : k + ROWS] for side in (low, high) for k in range(0, PERMUTATIONS, ROWS)]
    return np.stack([hashing.combine(b, 100 + i) for i, b in enumerate(bands)], axis=1)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys; the last two are null for an empty set."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in row_groups(offsets, hashing.BLOCK):
                own = sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                some = [k for k, s in enumerate(own) if len(s)]
                keys: list = [None] * len(own)
                if some:
                    for k, row in zip(some, band_keys([own[k] for k in some]).view(np.int64)):
                        keys[k] = row
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in own]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in own], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, bands array<long>")


class ShingleSets:
    """Full sets of some texts, for exact comparison: distinct shingles are numbered, a set is its numbers."""

    def __init__(self, texts: pa.Array):
        own = sets(*text_buffer(texts))
        self.sizes = np.array([len(s) for s in own], np.int64)
        self.ends = np.cumsum(self.sizes)
        values, self.numbers = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_inverse=True)
        self.marked = np.zeros(len(values), bool)

    def _of(self, k: int) -> np.ndarray:
        return self.numbers[self.ends[k] - self.sizes[k] : self.ends[k]]

    def links(self, x: int, others: np.ndarray) -> np.ndarray:
        mine = self.sizes[x]
        out = np.zeros(len(others), bool)
        sizes = self.sizes[others]
        fit = np.flatnonzero((sizes > 0) & (100 * np.minimum(sizes, mine) >= 75 * np.maximum(sizes, mine)))
        if not len(fit) or not mine:
            return out
        self.marked[self._of(x)] = True
        picked = sizes[fit]
        begin = np.cumsum(picked) - picked
        at = np.repeat(self.ends[others[fit]] - picked - begin, picked) + np.arange(int(picked.sum()))
        common = np.add.reduceat(self.marked[self.numbers[at]], begin, dtype=np.int64)
        self.marked[self._of(x)] = False
        out[fit] = 100 * common >= 75 * (picked + mine - common)
        return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    docs = docs.select("doc_id", "text")
    rows = written(signatures(docs), "signatures")
    usable = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = written(usable.groupBy("digest").agg(F.min("doc_id").alias("node")).withColumnRenamed("digest", "_d"), "classes")
    heads = usable.join(classes, (F.col("doc_id") == F.col("node")) & (F.col("digest") == F.col("_d"))).select("node", "n_shingles", "bands").dropDuplicates(["node", "n_shingles", "bands"])
    keys = heads.select(F.explode("bands").alias("key"), "node", F.col("n_shingles").alias("info"))
    shared = keys.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("key").alias("_k"))
    buckets = written(keys.join(written(shared, "shared"), F.col("key") == F.col("_k"), "left_semi"), "buckets")
    nodes = written(buckets.select("node").distinct(), "nodes")
    texts = written(docs.join(nodes, F.col("doc_id") == F.col("node")).select("node", "text"), "texts")
    enough = lambda m, n: 100 * F.least(m, n) >= 75 * F.greatest(m, n)  # noqa: E731  sizes that allow a link
    found = linked_components(buckets, texts, enough, ShingleSets)
    label = written(found.select(F.col("node").alias("_n"), "component"), "label")
    member = rows.join(classes, F.col("digest") == F.col("_d"), "left").drop("_d", "bands")
    out = member.join(label, F.col("node") == F.col("_n"), "left")
    # Without a link, the class's smallest id; without a set, the document's own.
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group: that of the smallest id; of rows that share it, the first by text.

    Rows without words or without an id stay.
    """
    found = written(near_duplicates(docs), "near")
    gone = written(found.filter("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    often = written(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_often")), "often")
    left = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    if not often.limit(1).count():
        return left
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    again = left.join(often, F.col("doc_id") == F.col("_often"), "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("_r"))
    return left.join(often, F.col("doc_id") == F.col("_often"), "left_anti").unionByName(again.select("doc_id", "_r.*").select(*docs.columns))
