"""Toxicity and quality: held-out accuracy, brute-force features, odd inputs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkfold.llm import hashing, quality, queries, toxicity
from linkfold.llm.common import fold, text_buffer

from odd import ODD


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, label string, place string")


@pytest.fixture(scope="module")
def corpus(docs, prose, spark):
    """Clean texts, texts with an insult, and texts that repeat one word; labels for all."""
    rng, texts, labels = random.Random(5), [], []
    for i in range(400):
        words = prose(rng.randint(30, 120), i).split(" ")
        toxic, bad = int(i % 3 == 0), int(i % 5 == 0)
        if bad:
            words = [words[0]] * len(words)
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["Grubble", "grubbling", "snarf"]))
        texts.append(" ".join(words))
        labels.append((i, 1 - bad, toxic, "x", "x"))
    return docs(texts), labels


@pytest.mark.parametrize("kind, column", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(spark, corpus, kind, column):
    frame, labels = corpus
    known = [r for r in labels if r[0] % 2] + [(9999, 1, 1, "x", "x"), (None, 1, 1, "x", "x"), (3, None, None, "x", "x")]
    out = kind.score(frame, kind.fit(frame, _labels(spark, known)))
    assert out.columns.count("score") == 1
    got = {r["doc_id"]: (r["predicted"], r["score"]) for r in out.collect()}
    truth = {r[0]: r[2] if column == "toxic" else r[1] for r in labels}
    held = [i for i in truth if i % 2 == 0]
    assert sum(got[i][0] == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for _, s in got.values())


@pytest.mark.parametrize("kind", [toxicity, quality])
def test_odd_texts_and_no_labels(spark, docs, kind):
    frame = docs([*ODD, ODD[3]], [*range(len(ODD)), None])
    model = kind.fit(frame, _labels(spark, []))
    rows = kind.score(frame, model, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(ODD) + 1
    assert all(abs(r["score"] - 0.5) < 1e-9 for r in rows)  # no labelled row: the smoothed base rate
    assert kind.score(docs([]), model).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark, monkeypatch):
    """Turning every held-out label changes no score."""
    sf, plain = "/root/testdata/sf0.001", queries.table

    def turned(spark, sf_dir, name):
        frame = plain(spark, sf_dir, name)
        return frame if name != "labels" else frame.withColumn("toxic", F.when(fold(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))

    want = sorted(map(tuple, queries.op1_toxicity(spark, sf).collect()))
    monkeypatch.setattr(queries, "table", turned)
    assert sorted(map(tuple, queries.op1_toxicity(spark, sf).collect())) == want


def test_word_hashes_against_words():
    texts = ["One two, one  TWO", "", "a-b\na", "x" * 3000, "é É"]
    data, offsets = text_buffer(pa.array(texts))
    hashes, bounds = hashing.word_hashes(data, offsets)
    one, two, again, shout = hashes[:4]
    assert one == again and two == shout and one != two
    assert np.diff(bounds).tolist() == [4, 0, 3, 1, 2]


def test_words_across_blocks(monkeypatch):
    texts = [" ".join(f"w{k}" for k in range(3000)), "y" * 400]
    data, offsets = text_buffer(pa.array(texts))
    whole = hashing.word_hashes(data, offsets, stems=(2,))
    monkeypatch.setattr(hashing, "BLOCK", 100)
    small = hashing.word_hashes(data, offsets, stems=(2,))
    assert all((a == b).all() for a, b in zip(whole, small))


def test_ftrl_against_plain_loop():
    rng = np.random.default_rng(0)
    p = toxicity.Params(bits=6, l1=0.3, epochs=2)
    rows = [np.unique(rng.integers(0, 64, 9)).astype("<u4") for _ in range(40)]
    labels = np.array([float(5 in r) for r in rows])
    got, bias = toxicity.ftrl(rows, labels, p)
    z, n, zb, nb, b = [0.0] * 64, [0.0] * 64, 0.0, 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= p.l1:
            return 0.0
        return (math.copysign(p.l1, z[i]) - z[i]) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for r, y in zip(rows, labels):
            w = {int(i): weight(int(i)) for i in r}
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha * w[i]
                n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / p.alpha * b
            nb += g * g
            b = -zb / ((p.beta + math.sqrt(nb)) / p.alpha)
    assert np.allclose(got, [weight(i) for i in range(64)]) and abs(bias - b) < 1e-9


@pytest.mark.parametrize("name, parts, mine, column, least", [("op1_toxicity", 3, 1, "toxic", 0.9), ("op2_quality", 5, 0, "quality", 0.9)])
def test_query_on_held_out_rows(spark, name, parts, mine, column, least):
    sf = "/root/testdata/sf0.1"
    out = queries.QUERIES[name](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (out["predicted"] == out[column]).mean() > least
