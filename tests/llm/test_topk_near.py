"""Exact top-k, near-duplicates, line dedup and their linkage, against brute force."""

import random
import re

import numpy as np
import pytest
from odd import ODD
from pyspark.sql import functions as F

from linkfold.llm import line_dedup, linkage, minhash, topk
from linkfold.llm.common import written


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, v string")


def _search(spark, rows, every, k=5):
    v = written(topk.whole_vectors(_vectors(spark, [(*r, "x", "x") for r in rows]), "vec_id", "embedding", 256.0))
    return topk.search(v, v.filter(F.col("id") % every == 0), k)


def test_topk_with_ties_and_broken_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]  # ties by the hundred
    bad = [(1000, None), (1010, []), (1020, [None] * 8), (1030, [float("nan")] * 8), (1040, [float("inf")] + [0.0] * 7), (None, rows[0][1]), (1050, [1.0, 2.0])]
    monkeypatch.setattr(topk, "BLOCK", 64)
    got = sorted(map(tuple, _search(spark, rows + bad, 5).collect()))
    ids = np.array([r[0] for r in rows])
    m = np.floor(np.array([r[1] for r in rows]).astype(np.float32).astype(float) * 256)
    want = []
    for q in np.flatnonzero(ids % 5 == 0):
        scores = m @ m[q]
        scores[q] = -np.inf
        best = np.lexsort((ids, -scores))[:5]
        want += [(int(ids[q]), n + 1, int(ids[b]), int(scores[b])) for n, b in enumerate(best)]
    assert got == sorted(want)


def test_scores_are_exact_whatever_the_components():
    rng = np.random.default_rng(2)
    for reach in (100.0, 2.0**20, 2.0**27, 2.0**31, 2.0**40, 1e25):
        q, r = (np.floor(rng.normal(size=(5, 6)) * reach) for _ in range(2))
        r[0], q[1], r[2, 1:] = 0, [1, 0, 0, 0, 0, 0], 0
        got = topk.scores_of(q, r)
        for i in range(5):
            for k in range(5):
                want = sum(int(a) * int(b) for a, b in zip(q[i], r[k]))
                assert int(got[i, k]) - (1 << 63) == min(max(want, 1 - (1 << 63)), (1 << 63) - 1)


def test_topk_of_large_components(spark):
    """Scores around 2**60 that differ by one; one vector whose scores fit no long with some others."""
    rows = [(0, [4194304.0, 1.0 / 256]), (5, [3.0, 0.0])] + [(k, [4194304.0, k / 256]) for k in range(10, 40)] + [(77, [1e30, 0.0]), (78, [-1e30, 0.0])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in _search(spark, rows, 5, k=4).collect()}
    ints = {i: [int(np.floor(256.0 * float(np.float32(x)))) for x in v] for i, v in rows}
    for q in [i for i in ints if i % 5 == 0]:
        scored = sorted((-min(max(sum(a * b for a, b in zip(ints[q], ints[c])), 1 - 2**63), 2**63 - 1), c) for c in ints if c != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == [(c, -s) for s, c in scored]


def test_topk_few_and_none(spark):
    assert len(_search(spark, [(0, [1.0]), (5, [2.0]), (7, [-1.0])], 5).collect()) == 4
    assert _search(spark, [(0, [1.0])], 5).count() == 0
    assert _search(spark, [], 5).count() == 0
    again = _search(spark, [(0, [1.0]), (0, [1.0]), (1, [1.0]), (1, [1.0])], 5).collect()  # a repeated row may be listed twice
    assert [(r["vec_id"], r["score"]) for r in again] == [(1, 65536), (1, 65536)]


def _components(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 360)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in linkage.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = _components(range(400), links)
    assert all(got[n] == want[n] for n in got) and all(n in got for a, b in links if a != b for n in (a, b))


def test_a_group_is_one_batch_whatever_its_bytes(monkeypatch):
    """Texts of a group that came in several batches with short offsets all reach the work."""
    import pyarrow as pa

    seen = []

    def work(batch):
        seen.append((batch.column("key")[0].as_py(), batch.num_rows, sum(len(t.as_py()) for t in batch.column("text"))))
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["a"])

    def part(keys, size):
        n = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([0] * n), pa.array([0] * n), pa.array(["x" * size] * n, pa.string())], names=["key", "low", "high", "text"])

    list(linkage.by_group(work)(iter([part([1, 1], 10), part([], 1), part([1, 2], 1_000_000), part([2] * 3, 5), part([3], 1)])))
    assert seen == [(1, 3, 1_000_020), (2, 4, 1_000_015), (3, 1, 1)]


def test_blocks_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BYTES", 1000)
    rows = spark.createDataFrame([(1, k) for k in range(40)], "key long, node long")
    texts = spark.createDataFrame([(k, "y" * 100) for k in range(40)], "node long, text string")
    met = linkage.grouped_blocks(rows, texts).groupBy("key", "low", "high").agg(F.collect_set("node").alias("nodes"), F.sum(F.length("text")).alias("n")).collect()
    assert {frozenset((a, b)) for r in met for a in r["nodes"] for b in r["nodes"]} >= {frozenset((a, b)) for a in range(40) for b in range(40)}
    assert max(r["n"] for r in met) < 3500 and len(met) == 10


def test_linked_components_lose_no_link(spark, monkeypatch):
    """One key holds all nodes, and links are between near numbers only, so no single pivot sees them; blocks are small."""
    monkeypatch.setattr(linkage, "BLOCK", 16)

    class Close:
        """Texts are numbers; those at most 12 apart are linked."""

        def __init__(self, texts):
            self.numbers = np.array([int(t.as_py()) for t in texts])

        def links(self, x, others):
            return abs(self.numbers[others] - self.numbers[x]) <= 12

    nodes = sorted(random.Random(2).sample(range(2000), 120))
    buckets = spark.createDataFrame([(1, n, n) for n in nodes] + [(2, n, n) for n in nodes[:30]], "key long, node long, info long")
    texts = spark.createDataFrame([(n, str(n)) for n in nodes], "node long, text string")
    found = linkage.linked_components(written(buckets), texts, lambda a, b: F.lit(True), Close)
    got = {r["node"]: r["component"] for r in found.collect()}
    want = _components(nodes, [(a, b) for a in nodes for b in nodes if a < b <= a + 12])
    assert all(got.get(n, n) == want[n] for n in nodes)


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, prose):
    rng, texts = random.Random(4), list(ODD)
    for k in range(12):
        words = prose(150, k).split(" ")
        for copy in range(rng.randint(1, 6)):
            own = list(words)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(len(own))] = rng.choice(["zz", "yy", "xx"])
            texts.append(" ".join(own))
    texts += [prose(80, 99), prose(80, 99).upper(), "one two", "One Two", "one two three"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = minhash.near_duplicates(docs(texts, order).unionByName(docs(["one two", None], [None, None]))).collect()
    sets = {i: _shingles(t) for i, t in zip(order, texts)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = _components(sets, links)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert len(rows) == len(texts) + 2 and minhash.near_duplicates(docs([])).count() == 0


def test_distinct_documents_keep_one_row_each(docs, prose):
    frame = docs([prose(60, 1), prose(60, 1), None, ""], [3, 4, 5, 6]).unionByName(docs([prose(60, 1), None, None], [3, 5, None]))
    out = minhash.distinct_documents(frame)
    assert out.columns == frame.columns
    assert sorted((str(r["doc_id"]) for r in out.collect())) == ["3", "5", "6", "None"]


def test_edit_distance():
    rng = random.Random(0)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(400):
        a = [rng.randrange(4) for _ in range(rng.randrange(12))]
        b = [x for x in a if rng.random() > 0.15] + [rng.randrange(4) for _ in range(rng.randrange(3))]
        for most in (0, 1, 3, 20):
            assert line_dedup.edit_distance(np.array(a, int), np.array(b, int), most) == min(plain(a, b), most + 1)


def _plain_dedup(rows, p):
    """(doc_id, text) of the lines that stay, from all pairs of distinct lines."""
    places = {}
    for doc, text in rows:
        for k, line in enumerate(text.split("\n")):
            words = " ".join(re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line))))
            if len(words.split(" ")) >= p.min_words:
                places.setdefault(words, []).append((doc, k))
    kinds = list(places)
    links = []
    for i, a in enumerate(kinds):
        for j in range(i):
            x, y = a.split(" "), kinds[j].split(" ")
            code = {w: n for n, w in enumerate({*x, *y})}
            most = int((1 - p.similarity) * max(len(x), len(y)) + 1e-9)
            if line_dedup.edit_distance(np.array([code[w] for w in x]), np.array([code[w] for w in y]), most) <= most:
                links.append((i, j))
    group = _components(range(len(kinds)), links)
    first = {}
    for n, k in enumerate(kinds):
        first[group[n]] = min([first.get(group[n], (1 << 60, 0)), *places[k]])
    gone = {at for n, k in enumerate(kinds) for at in places[k] if at != first[group[n]]}
    return {doc: "\n".join(x for k, x in enumerate(text.split("\n")) if (doc, k) not in gone) for doc, text in rows}, len(links)


def test_line_dedup(docs, prose):
    rng, p = random.Random(8), line_dedup.Params(min_words=8)
    shared = [prose(60, 1000 + k, line=60) for k in range(6)]
    texts = [None, "", "short line\nshort line"]
    for k in range(40):
        lines = [prose(20, k * 10 + j, line=20) for j in range(3)]
        words = rng.choice(shared).split(" ")
        if k % 2:
            words[rng.randrange(len(words))] = "changed"
        lines.insert(rng.randrange(4), " ".join(words).upper() + "!" if k % 3 else " ".join(words))
        texts.append("\n".join(lines))
    texts.append("ab " * 30000 + "\n" + "ab " * 30000)
    frame = docs(texts).unionByName(docs(["\n".join(shared)], [None]))
    out = line_dedup.deduplicated(frame, p)
    assert out.columns == [*frame.columns, "n_lines", "n_removed"]
    rows = out.collect()
    got = {r["doc_id"]: r for r in rows}
    want, links = _plain_dedup([(i, t) for i, t in enumerate(texts) if t is not None], p)
    assert links > 0 and len(rows) == len(frame.collect())
    assert got[0]["text"] is None and got[None]["text"] == "\n".join(shared)
    for i, text in want.items():
        assert got[i]["text"] == text
    assert got[2]["n_removed"] == 0 and sum(r["n_removed"] for r in rows) > 30
    assert line_dedup.deduplicated(docs([])).count() == 0


def test_line_dedup_of_repeated_rows(docs, prose):
    text = prose(40, 1, line=20)
    rows = line_dedup.deduplicated(docs([text, text, text], [1, 1, 2])).select("doc_id", "text").collect()
    assert sorted(map(tuple, rows)) == [(1, text), (1, text), (2, "")]
