"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs, triples and pairs with one or
two words between, and of words cut to four and five bytes, so inflected forms share a feature. Each coordinate has its own learning rate and L1 keeps most weights at zero, so
the model is a short list of (bucket, weight) that is broadcast; scoring is one pass over the texts.

Null, empty and wordless texts have no feature and get the intercept's score. Rows are scored one by
one: repeated rows get equal scores, a null id is scored like any other, and columns other than the
id and the text are never read. Without labelled rows of both classes the model has no weight and
scores the base rate (0.5 smoothed).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkfold.llm import hashing
from linkfold.llm.common import extended, row_groups, text_buffer
from linkfold.session import ship

#: Steps of the words in a feature: words, pairs, triples, skip-grams.
FAMILIES = ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 3))
#: Words longer than this count with their first so many bytes too.
STEMS = (4, 5)


@dataclass(frozen=True)
class Params:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 1.0
    epochs: int = 8
    #: Bound of the fitting sample: so many labelled documents of each class, the first by hash of their id.
    sample_per_class: int = 4000
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    bits: int
    bucket: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.bucket] = self.weight
        return out


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family the buckets and the rows they belong to."""
    words, bounds, *stems = hashing.word_hashes(data, offsets, stems=STEMS)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for h in stems:
        long = np.flatnonzero(h)
        yield (h[long] >> np.uint64(64 - bits)).astype(np.int64), rows[long]
    for salt, steps in enumerate(FAMILIES):
        h, rows = hashing.grams(words, bounds, steps, salt)
        yield (h >> np.uint64(64 - bits)).astype(np.int64), rows


def _distinct(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[np.ndarray]:
    """Distinct buckets of each text, ascending."""
    n = len(offsets) - 1
    parts = list(features(data, offsets, bits))
    keys = np.unique(np.concatenate([(r << bits) | b for b, r in parts]))
    ends = np.searchsorted(keys, np.arange(n + 1) << bits)
    mask = (1 << bits) - 1
    return [(keys[a:b] & mask).astype("<u4") for a, b in zip(ends[:-1], ends[1:])]


def ftrl(rows: list[np.ndarray], labels: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes over the rows in the given order."""
    z = np.zeros(1 << p.bits)
    n = np.zeros(1 << p.bits)
    zb = nb = bias = 0.0
    for _ in range(p.epochs):
        for idx, y in zip(rows, labels):
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= p.l1, 0.0, (np.sign(zi) * p.l1 - zi) / ((p.beta + root) / p.alpha + p.l2))
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            z[idx] = zi + g - (np.sqrt(ni + g * g) - root) / p.alpha * w
            n[idx] = ni + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / p.alpha * bias
            nb += g * g
            bias = -zb / ((p.beta + np.sqrt(nb)) / p.alpha)
    w = np.where(np.abs(z) <= p.l1, 0.0, (np.sign(z) * p.l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))
    return w, float(bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, float]:
    """Ids, labels and order of a bounded sample, the same for any partitioning, and the share of label 1.

    Contradicting labels of an id count as the larger one; null labels and ids count as none.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    order = F.xxhash64(F.col("doc_id").cast("string"))
    parts = [
        known.filter(F.col("label") == k).select("doc_id", "label", order.alias("place")).orderBy("place", "doc_id").limit(per_class)
        for k in (0, 1)
    ]
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    share = (counts["ones"] + 0.5) / (counts["n"] + 1)
    # per_class bounds the rows that are broadcast.
    picked = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.filter(F.col("doc_id").isNotNull()).join(picked, "doc_id").select("doc_id", "text", "label", "place")
    return rows, float(share)


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Train on the bounded sample in one task, which gets hashed features only, never more than the bound."""
    ship(docs.sparkSession)
    rows, share = labelled_sample(docs, labels, "toxic", params.sample_per_class)

    def hashed(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in row_groups(offsets, hashing.BLOCK):
                own = _distinct(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], params.bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(a, b - a) for c in ("doc_id", "label", "place")]
                    + [pa.array([x.tobytes() for x in own], pa.binary())],
                    names=["doc_id", "label", "place", "features"],
                )

    kind = dict(rows.dtypes)["doc_id"]
    sample = rows.mapInArrow(hashed, f"doc_id {kind}, label int, place long, features binary")
    # A repeated id counts once: as the row with the least features.
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("place", "label", "features")).alias("r")).select("r.*")

    def train(batches):
        found = [(p.as_py(), y.as_py(), np.frombuffer(f.as_py(), "<u4")) for b in batches for p, y, f in zip(*(b.column(c) for c in ("place", "label", "features")))]
        found.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        y = np.array([r[1] for r in found], float)
        if not len(y) or y.min() == y.max():
            bucket, weight, bias = np.zeros(0, "<u4"), np.zeros(0, "<f4"), float(np.log(share / (1 - share)))
        else:
            w, bias = ftrl([r[2] for r in found], y, params)
            bucket = np.flatnonzero(w).astype("<u4")
            weight = w[bucket].astype("<f4")
            # The sample is balanced by class; the intercept goes back to the labels' own share.
            bias += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array([bucket.tobytes()], pa.binary()), "weight": pa.array([weight.tobytes()], pa.binary()), "bias": pa.array([bias])}
        )

    got = sample.coalesce(1).mapInArrow(train, "bucket binary, weight binary, bias double").first()
    return Model(params.bits, np.frombuffer(got["bucket"], "<u4"), np.frombuffer(got["weight"], "<f4"), got["bias"])


def score_texts(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bits: int, bias: float) -> np.ndarray:
    """Probability for each text; each distinct feature with a weight counts once."""
    n = len(offsets) - 1
    hits = [np.zeros(0, np.int64)]
    for bucket, rows in features(data, offsets, bits):
        at = np.flatnonzero(weights[bucket])
        hits.append((rows[at] << bits) | bucket[at])
    keys = np.unique(np.concatenate(hits))
    total = np.bincount(keys >> bits, weights[keys & ((1 << bits) - 1)], minlength=n)
    return 1.0 / (1.0 + np.exp(-np.clip(total + bias, -35, 35)))


def score(docs: DataFrame, model: Model, params: Params = Params(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows of ``docs``, the columns ``keep`` (all), and ``score`` and ``predicted``, which replace columns so named."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast((model.bucket, model.weight))
    bits, bias, threshold = model.bits, model.bias, params.threshold

    def run(batches):
        weights = np.zeros(1 << bits, np.float32)
        weights[sent.value[0]] = sent.value[1]
        for batch in batches:
            data, offsets = text_buffer(batch.column(text))
            out = np.concatenate(
                [np.zeros(0)]
                + [score_texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], weights, bits, bias) for a, b in row_groups(offsets, hashing.BLOCK)]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(out), pa.array((out >= threshold).astype(np.int32))],
                names=[*keep, "score", "predicted"],
            )

    read = docs.select(*dict.fromkeys([*keep, text]))
    return read.mapInArrow(run, extended(read.select(*keep).schema, score="double", predicted="integer"))
