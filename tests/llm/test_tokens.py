"""Byte BPE, token counts and packing against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from odd import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkfold.llm import bpe, packing, queries, token_counts

PARTS = ["<|endoftext|>", "<|startoftext|>", " ", "\n", "İ", "é", "é", "'s", "'S", "123", "\x1c", " ", "abc", "!!", "ﬁ", "中文", "😀", "Wörter", " "]


def _mixed(n=60):
    return ["".join(random.Random(i).choices(PARTS, k=50)) for i in range(n)]


def _ranks(name):
    with open(P.path(name), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@pytest.fixture(scope="module")
def multi():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=_ranks("byte_bpe_multi_50k.tiktoken"), special_tokens={})


def test_bpe_equals_the_library_and_round_trips(docs, multi):
    texts = [*ODD, *_mixed(), "aaaaaaaab" * 700, " " * 3000 + "x"]
    frame = docs(texts, [*range(len(texts) - 1), None])
    out = bpe.round_trip(frame, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert out.columns == [*[c for c in frame.columns if c != "ids"], "ids", "decoded"]
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in out.collect()}
    for i, text in zip([*range(len(texts) - 1), None], texts):
        assert np.frombuffer(got[i][0], "<u4").tolist() == multi.encode_ordinary(text or "")
        assert got[i][1] == (text or "").encode()
    assert bpe.round_trip(docs([]), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_stretches_and_small_cache(monkeypatch, multi):
    monkeypatch.setattr(bpe, "STRETCH", 7)
    monkeypatch.setattr(bpe, "KEPT", 3)
    own = bpe.Codec(_ranks("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for text in [*_mixed(), "ab  cd   ef g\n\n h", "   lead"]:
        assert np.frombuffer(own.encode_all([text])[0], "<u4").tolist() == multi.encode_ordinary(text)


def test_rank_queue_order():
    rng, queue, held = random.Random(3), bpe.RankQueue(50_000), []
    for _ in range(300):
        rank, at = rng.randrange(50_000), rng.randrange(100)
        queue.push(rank, np.array([at]))
        held.append((rank, at))
    seen = []
    while queue.top:
        rank, positions = queue.pop()
        seen += [(rank, int(p)) for p in positions]
    assert seen == sorted(set(held)) and not any(queue.low) and not any(queue.mid)


def test_token_counts_equal_the_library(docs):
    texts = [*ODD, *_mixed()]
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    frame = docs(texts, [*range(len(texts) - 1), None])
    for chunk, overlap in ((50_000, 400), (40, 3)):
        out = token_counts.count_tokens(frame, P.path("word_bpe_49k.json"), limit=20, chunk=chunk, overlap=overlap)
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect()}
        for i, text in zip([*range(len(texts) - 1), None], texts):
            n = len(own.encode(text or "", add_special_tokens=False))
            assert got[i] == (len((text or "").encode()), n, n > 20)
    assert token_counts.count_tokens(docs([]), P.path("word_bpe_49k.json")).count() == 0


def test_overlaps_widen_where_nothing_aligns():
    own = token_counts.Counter(P.path("word_bpe_49k.json"))
    text = "head " + "x1-" * 900 + " tail " * 30
    assert own.spliced(text, 100, 10) == len(own.tokenizer.encode(text, add_special_tokens=False))


def _pieces(docs, texts, capacity=64):
    path = P.path("byte_bpe_50k.tiktoken")
    return packing.pieces(docs(texts), path, P.PATTERN, {"<|endoftext|>": 50256}, 2, capacity)


def test_pieces_equal_the_library(docs):
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*ODD, *_mixed()]
    got = {}
    for r in _pieces(docs, texts).orderBy("doc_id", "piece").collect():
        assert r["length"] == len(r["ids"]) // 4 and r["start"] == len(got.get(r["doc_id"], [])) and (r["piece"] == 0 or r["length"] == 64)
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    for i, text in enumerate(texts):
        assert got[i] == [*own.encode(text or "", add_special_tokens=False).ids, 2]


def _holds(plan, counts, capacity):
    held = np.zeros(capacity + 1, int)
    for config, many in plan:
        assert sum(config) <= capacity and many > 0
        for size in config:
            held[size] += many
    return (held == counts).all()


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 200))
    sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 3000)))
    counts = np.bincount(sizes, minlength=capacity + 1)
    plan = packing.solve(counts, capacity)
    assert _holds(plan, counts, capacity) and _holds(packing.best_fit(counts, capacity), counts, capacity)
    best = sum(m for _, m in packing.best_fit(counts, capacity))
    assert sum(m for _, m in plan) <= 1.03 * best + 3


@pytest.mark.parametrize("kind", ["uniform", "few", "thirds", "skewed", "tails"])
def test_plans_come_near_the_bound(kind):
    rng, counts = np.random.default_rng(1), np.zeros(1025, np.int64)
    if kind == "uniform":
        np.add.at(counts, rng.integers(1, 1025, 100_000), 1)
    elif kind == "few":
        counts[[600, 350, 180, 1024]] = 500, 800, 1000, 30
    elif kind == "thirds":
        counts[[342, 341, 700, 324]] = 9000, 100, 500, 100
    elif kind == "skewed":
        np.add.at(counts, np.clip(rng.lognormal(6, 1, 5000).astype(int), 1, 1024), 1)
    else:
        counts[1024] = 4000
        np.add.at(counts, rng.integers(1, 700, 3000), 1)
    _, _, bound = packing.linear_program(counts, 1024)
    plan = packing.solve(counts, 1024)
    used = sum(m for _, m in plan)
    assert _holds(plan, counts, 1024)
    assert bound >= (np.arange(1025) * counts).sum() / 1024 - 1e-6
    assert np.ceil(bound - 1e-6) <= used <= np.ceil(bound) * 1.01 + 1, (kind, used, bound)
    assert used <= sum(m for _, m in packing.best_fit(counts, 1024))


@pytest.mark.parametrize("seed", range(8))
def test_the_bound_against_the_best_packing(seed):
    """Few pieces: the fewest sequences by trying every place for every piece."""
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.integers(2, 13, 9).tolist(), reverse=True)

    def fewest(k, rooms, best):
        if len(rooms) >= best:
            return best
        if k == len(sizes):
            return len(rooms)
        for j in range(len(rooms)):
            if rooms[j] >= sizes[k] and rooms[j] not in rooms[:j]:
                best = fewest(k + 1, rooms[:j] + [rooms[j] - sizes[k]] + rooms[j + 1 :], best)
        return fewest(k + 1, [*rooms, 12 - sizes[k]], best)

    counts = np.bincount(sizes, minlength=13)
    want = fewest(0, [], 10)
    used = sum(m for _, m in packing.solve(counts, 12))
    assert packing.linear_program(counts, 12)[2] <= want + 1e-6 and want <= used <= want + 1


def test_knapsack_against_all_multisets():
    price = np.zeros(13)
    price[[3, 4, 7]] = [2.0, 3.1, 5.0]
    best, last = packing._knapsack(price, 12)
    for room in range(13):
        want = max(2.0 * a + 3.1 * b + 5.0 * c for a in range(5) for b in range(4) for c in range(2) if 3 * a + 4 * b + 7 * c <= room)
        assert abs(best[room] - want) < 1e-9
        assert abs(price[packing._fill(last, room)].sum() - want) < 1e-9 if packing._fill(last, room) else want == 0


def test_packing_has_no_gaps_or_overlaps(docs, prose):
    texts = [*ODD, *[prose(k % 90 + 1, k) for k in range(120)], *["same text"] * 50]
    found = queries.written(_pieces(docs, texts).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    rows = packing.pack(found, 64).toPandas()
    assert len(rows) == found.count() and not rows.duplicated(["doc_id", "piece"]).any()
    rows = rows.sort_values(["sequence_id", "offset"])
    ends = rows["offset"] + rows["length"]
    assert (ends.groupby(rows["sequence_id"]).shift(1).fillna(0) == rows["offset"]).all() and ends.max() <= 64
    assert packing.pack(queries.written(found.limit(0)), 64).count() == 0


def test_op4_and_op8_digests(spark, multi):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op4_byte_bpe(spark, sf).collect():
        ids = multi.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in queries.op8_best_fit_packing(spark, sf).collect():
        ids = [*own.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
