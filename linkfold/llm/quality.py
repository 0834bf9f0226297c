"""Quality: supervised subword embeddings, averaged per document, softmax output.

Every word and every byte n-gram (3 and 4 bytes, case and punctuation kept, white space folded to one
space, none with a space inside) has a learned vector in a hashed table; a document is the mean of its
features' vectors, and a softmax over it gives the classes. Trained by stochastic gradient descent in
numpy on a bounded sample. Equal neighbouring words share one bucket, so repetition is a feature.

As the output is linear in the mean, each bucket's share of the class difference is worked out once:
scoring reads one number for each feature, and only those numbers are broadcast.

Null and empty texts have no feature and get the intercept's score. Rows are scored one by one:
repeated rows get equal scores and a null id is scored like any other. Without labelled rows of both
classes all texts get the base rate (0.5 smoothed).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkfold.llm import hashing
from linkfold.llm.common import extended, row_groups, text_buffer
from linkfold.session import ship
from linkfold.llm.toxicity import labelled_sample

ORDERS = (3, 4)
_SPACE = ~hashing.NON_SPACE


@dataclass(frozen=True)
class Params:
    bits: int = 18
    dim: int = 16
    epochs: int = 6
    rate: float = 0.5
    #: Bound of the fitting sample: so many labelled documents of each class, the first by hash of their id.
    sample_per_class: int = 2000
    threshold: float = 0.3
    seed: int = 7


@dataclass(frozen=True)
class Model:
    bits: int
    #: For each bucket, what it adds to logit(1) - logit(0) when it is the only feature.
    share: np.ndarray
    bias: float


def _squeezed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space at both ends and every run of white space as one space."""
    n = len(offsets) - 1
    blank = _SPACE[data]
    data = np.where(blank, np.uint8(32), data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    again = np.zeros(len(data), bool)
    again[1:] = blank[1:] & blank[:-1]
    keep = ~again | edge[:-1]
    kept_before = np.concatenate([[0], np.cumsum(keep)])[offsets]
    sizes = np.diff(kept_before)
    out_offsets = np.concatenate([[0], np.cumsum(sizes + 2)])
    out = np.full(int(out_offsets[-1]), 32, np.uint8)
    rows = np.repeat(np.arange(n), sizes)
    out[np.arange(int(kept_before[-1])) + 2 * rows + 1] = data[keep]
    return out, out_offsets


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and rows: words, pairs of equal neighbours, byte n-grams."""
    n = len(offsets) - 1
    shift = np.uint64(64 - bits)
    words, bounds = hashing.word_hashes(data, offsets, hashing.NON_SPACE, lower=False)
    rows = np.repeat(np.arange(n), np.diff(bounds))
    out = [((words >> shift).astype(np.int64), rows)]
    same = np.flatnonzero((words[1:] == words[:-1]) & (rows[1:] == rows[:-1])) if len(words) else np.zeros(0, np.int64)
    out.append((np.zeros(len(same), np.int64), rows[same]))
    flat, ends = _squeezed(data, offsets)
    at_row = np.repeat(np.arange(n), np.diff(ends))
    space = flat == 32
    wide = flat.astype(np.uint32)
    for order in ORDERS:
        m = len(flat) - order + 1
        if m <= 0:
            continue
        inner = np.zeros(m, bool)
        for k in range(1, order - 1):
            inner |= space[k : k + m]
        at = np.flatnonzero(~inner & (at_row[:m] == at_row[order - 1 :]))
        code = wide[at]
        with np.errstate(over="ignore"):
            for k in range(1, order):
                code = (code << np.uint32(8)) | wide[at + k]
            code = (code + np.uint32(order)) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
            code *= np.uint32(0x85EBCA77)
        out.append(((code >> np.uint32(32 - bits)).astype(np.int64), at_row[at]))
    return out


def _counted(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with their shares of all its features."""
    n = len(offsets) - 1
    keys, counts = np.unique(np.concatenate([(r << bits) | b for b, r in features(data, offsets, bits)]), return_counts=True)
    ends = np.searchsorted(keys, np.arange(n + 1) << bits)
    mask = (1 << bits) - 1
    return [((keys[a:b] & mask).astype("<u4"), (counts[a:b] / max(1, counts[a:b].sum())).astype("<f4")) for a, b in zip(ends[:-1], ends[1:])]


def sgd(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, output weights (dim x 2) and output bias; the rate falls linearly to zero."""
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (1 << p.bits, p.dim)).astype(np.float32)
    out = np.zeros((p.dim, 2), np.float32)
    out[:, 1] = rng.uniform(-0.1, 0.1, p.dim)
    bias = np.zeros(2, np.float32)
    steps, done = p.epochs * len(rows), 0
    for _ in range(p.epochs):
        for k in rng.permutation(len(rows)):
            idx, share = rows[k]
            rate = p.rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[idx] if len(idx) else np.zeros(p.dim, np.float32)
            logits = mean @ out + bias
            prob = np.exp(logits - logits.max())
            prob /= prob.sum()
            prob[int(labels[k])] -= 1
            back = out @ prob
            out -= rate * np.outer(mean, prob)
            bias -= rate * 0.1 * prob
            # The mean's gradient is spread by share; scaling by the share's norm keeps long texts learning.
            if len(idx):
                vectors[idx] -= (rate * 10 / np.sqrt(share @ share) * share)[:, None] * back
    return vectors, out, bias


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Train on the bounded sample in one task, which gets hashed features only, never more than the bound."""
    ship(docs.sparkSession)
    rows, share1 = labelled_sample(docs, labels, "quality", params.sample_per_class)

    def hashed(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in row_groups(offsets, hashing.BLOCK):
                own = _counted(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], params.bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(a, b - a) for c in ("doc_id", "label", "place")]
                    + [pa.array([i.tobytes() for i, _ in own], pa.binary()), pa.array([s.tobytes() for _, s in own], pa.binary())],
                    names=["doc_id", "label", "place", "features", "shares"],
                )

    kind = dict(rows.dtypes)["doc_id"]
    sample = rows.mapInArrow(hashed, f"doc_id {kind}, label int, place long, features binary, shares binary")
    # A repeated id counts once.
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("place", "label", "features", "shares")).alias("r")).select("r.*")

    def train(batches):
        found = []
        for b in batches:
            for p, y, f, s in zip(*(b.column(c) for c in ("place", "label", "features", "shares"))):
                found.append((p.as_py(), y.as_py(), np.frombuffer(f.as_py(), "<u4"), np.frombuffer(s.as_py(), "<f4")))
        found.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        y = np.array([r[1] for r in found], int)
        share, bias = np.zeros(0, "<f4"), float(np.log(share1 / (1 - share1)))
        if len(y) and y.min() != y.max():
            vectors, out, b = sgd([(r[2], r[3]) for r in found], y, params)
            share = (vectors @ (out[:, 1] - out[:, 0])).astype("<f4")
            # The sample is balanced by class; the intercept goes back to the labels' own share.
            bias += float(b[1] - b[0]) - float(np.log(y.mean() / (1 - y.mean())))
        yield pa.RecordBatch.from_pydict({"share": pa.array([share.tobytes()], pa.binary()), "bias": pa.array([bias])})

    got = sample.coalesce(1).mapInArrow(train, "share binary, bias double").first()
    share = np.frombuffer(got["share"], "<f4")
    return Model(params.bits, share if len(share) else np.zeros(1 << params.bits, "<f4"), got["bias"])


def score_texts(data: np.ndarray, offsets: np.ndarray, share: np.ndarray, bits: int, bias: float) -> np.ndarray:
    n = len(offsets) - 1
    total, count = np.zeros(n), np.zeros(n)
    for bucket, rows in features(data, offsets, bits):
        total += np.bincount(rows, share[bucket], minlength=n)
        count += np.bincount(rows, minlength=n)
    return 1.0 / (1.0 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -35, 35)))


def score(docs: DataFrame, model: Model, params: Params = Params(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows of ``docs``, the columns ``keep`` (all), and ``score`` and ``predicted``, which replace columns so named."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model.share)
    bits, bias, threshold = model.bits, model.bias, params.threshold

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(text))
            out = np.concatenate(
                [np.zeros(0)]
                + [score_texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], sent.value, bits, bias) for a, b in row_groups(offsets, hashing.BLOCK)]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(out), pa.array((out >= threshold).astype(np.int32))],
                names=[*keep, "score", "predicted"],
            )

    read = docs.select(*dict.fromkeys([*keep, text]))
    return read.mapInArrow(run, extended(read.select(*keep).schema, score="double", predicted="integer"))
