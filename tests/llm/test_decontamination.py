"""Decontamination against windows looked up one by one, and longest matches against all pairs of places."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from odd import ODD

from linkfold.llm import decontamination as dc, hashing
from linkfold.llm.common import text_buffer


def _words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _plain(texts, items):
    """(n_words, n_hit, n_items, digest) of each text."""
    windows = {}
    for i, text in items:
        ws = _words(text)
        n = min(len(ws), 10)
        if i is not None:
            for p in range(len(ws) - n + 1) if n else ():
                windows.setdefault(tuple(ws[p : p + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        ws, hit, found = _words(text), set(), set()
        for n in sizes:
            for p in range(len(ws) - n + 1):
                own = windows.get(tuple(ws[p : p + n]))
                if own:
                    hit.update(range(p, p + n))
                    found |= own
        out.append((len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def _case(seed, n=60, vocabulary=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["É", "x9"]
    line = lambda k: " ".join(rng.choices(words, k=k))
    items = [(k, line(rng.choice([1, 3, 9, 10, 11, 25, 40]))) for k in range(20)] + [(3, line(12)), (None, line(10)), (77, None), (78, " .,"), (5, "Solo")]
    texts = [line(rng.randrange(60)) for _ in range(n)]
    texts += [f"before {t or ''}, after." for _, t in items] + [" ".join(t or "" for _, t in items)] + ODD + texts[:3]
    return texts, items


@pytest.mark.parametrize("vocabulary", [2, 4, 40])
@pytest.mark.parametrize("block", [dc.BLOCK, 200])
def test_digest(spark, docs, monkeypatch, block, vocabulary):
    texts, items = _case(vocabulary, vocabulary=vocabulary)
    monkeypatch.setattr(dc, "BLOCK", block)  # small: several blocks, whose hits are merged
    found = docs(texts).withColumnRenamed("score", "n_words").withColumnRenamed("key", "hit_items")
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = sorted(map(tuple, dc.digest(found, benchmark).collect()))
    want = _plain(texts, items)
    assert got == sorted((k, *w) for k, w in enumerate(want))
    left = dc.clean(found, benchmark)
    assert left.columns == found.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [k for k, w in enumerate(want) if not w[-1]]
    assert {r["n_words"] for r in left.collect()} == {"x"}


def test_longest_matches(spark, docs):
    texts, items = _case(9, n=15, vocabulary=3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, dc.matches(docs(texts), benchmark).collect()))
    want = []
    for d, text in enumerate(texts):
        ws = _words(text)
        for i, other in items:
            own = _words(other)
            for a in range(len(ws)) if i is not None else ():
                for b in range(len(own)):
                    if a and b and ws[a - 1] == own[b - 1]:
                        continue
                    n = 0
                    while a + n < len(ws) and b + n < len(own) and ws[a + n] == own[b + n]:
                        n += 1
                    if n and n >= min(10, len(own)):
                        want.append((d, str(i), a, b, n))
    assert got == sorted(want)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = dc.digest(docs(["a b c", None]), none).collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got] == [(3, 0, 0, False), (0, 0, 0, False)]
    assert dc.digest(docs([]), some).count() == 0 and dc.matches(docs([]), some).count() == 0 and dc.matches(docs(["a"]), none).count() == 0
    assert dc.clean(docs(["x a b c y", "a b"]), some).count() == 1


@pytest.mark.parametrize("size", [0, 1, 2, 50, 3000])
@pytest.mark.parametrize("letters", [1, 2, 30])
def test_suffix_array(size, letters):
    s = np.random.default_rng(size).integers(0, letters, size).astype(np.int32)
    if size > 100:
        s[1000:2000] = s[:1000]  # a long repeat
    want = sorted(range(size), key=lambda k: s[k:].tolist())
    assert dc.suffix_array(s).tolist() == want


def test_small_parts_give_the_same(monkeypatch):
    texts, items = _case(5, n=40, vocabulary=3)
    block = dc.Items.of([str(i) for i, t in items if i is not None], [t or "" for i, t in items if i is not None])
    hashes, bounds = hashing.word_hashes(*text_buffer(pa.array(texts, pa.large_string())))
    shard = dc.Shard(hashes, bounds, block)
    whole = [np.concatenate(c) for c in zip(*dc.longest(shard))]
    monkeypatch.setattr(dc, "HELD", 5)
    parts = [np.concatenate(c) for c in zip(*dc.longest(shard))]
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0])


def test_a_long_text_and_a_long_item(spark, docs):
    rng = random.Random(2)
    item = " ".join(f"v{rng.randrange(9999)}" for _ in range(30_000))
    text = "so it was " + item + " and " + "the same " * 50_000
    benchmark = spark.createDataFrame([(1, item), (2, "the same " * 5000)], "item_id long, text string")
    got = dc.digest(docs([text, "the same " * 9]), benchmark).collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"]) for r in got] == [(130_004, 130_000, 2), (18, 18, 1)]
    assert dc.matches(docs([text]), benchmark.filter("item_id = 1")).select("n_words").collect()[0][0] == 30_000
