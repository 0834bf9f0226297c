"""Line dedup against all pairs of lines by plain edit similarity, with no other condition.

Blocks of SimHash bits may miss a pair, so lines with as many edits as a link allows are held to a recall; nothing is
taken out that all pairs would not take out, and exact copies and lines with few edits all go.
"""

import random
import re

import numpy as np

from linkfold.llm import line_dedup, queries


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _words(line):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))


def _stay(texts, p):
    """Texts without repeated lines, and the number of linked pairs."""
    places = {}
    for doc, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            words = tuple(_words(line))
            if len(words) >= max(1, p.min_words):
                places.setdefault(words, []).append((doc, k))
    kinds, links = list(places), 0
    up = list(range(len(kinds)))

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(kinds):
        for j in range(i):
            b, longer = kinds[j], max(len(a), len(kinds[j]))
            if abs(len(a) - len(b)) <= 0.15 * longer and len(set(a) & set(b)) and _distance(a, b) <= 0.15 * longer + 1e-9:
                links += 1
                up[top(i)] = top(j)
    first = {}
    for n, k in enumerate(kinds):
        first[top(n)] = min([first.get(top(n), (1 << 60, 0)), *places[k]])
    gone = {at for n, k in enumerate(kinds) for at in places[k] if at != first[top(n)]}
    return ["\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in enumerate(texts)], links


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, way = rng.randrange(len(words)), rng.randrange(4)
        words[at : at + (way != 1)] = [] if way == 0 else [f"new{''.join(rng.choices('abcdef', k=4))}"]
    return words


def _near_copies(seed, lengths, common=True):
    """Documents whose lines are copies of a few with up to as many edits as the threshold allows, or one more."""
    rng, lines = random.Random(seed), []
    for n in lengths:
        base = ["".join(rng.choices("bcdfg", k=3)) if rng.random() < 0.8 or not common else rng.choice(["is", "the"]) for _ in range(n)]
        most = int(0.15 * n + 1e-9)
        lines += [base, *[_edited(rng, base, rng.choice([most, most, max(1, most // 2), most + 1])) for _ in range(3)]]
    rng.shuffle(lines)
    return ["\n".join(" ".join(w) for w in lines[k : k + 5]) for k in range(0, len(lines), 5)]


def _held(docs, texts, p, least=1.0):
    want, links = _stay(texts, p)
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs(texts), p).collect()}
    if least == 1.0:
        assert [got[k] for k in range(len(texts))] == want
    gone = lost = 0
    for k, text in enumerate(texts):
        every, left, stays = ([x for x in t.split("\n") if x] for t in (text, got[k], want[k]))
        assert set(stays) <= set(left) <= set(every)
        gone += len(every) - len(stays)
        lost += len(left) - len(stays)
    assert lost <= (1 - least) * gone
    return links


def test_every_pair_within_the_edit_similarity_is_found(docs):
    assert _held(docs, _near_copies(1, [8, 9, 12, 13, 14, 20, 27, 30, 50, 60] * 2), line_dedup.Params(), 0.95) > 40


def _share(pairs, p):
    """Share of the pairs of lines that have a key in common, with marks that are near enough."""
    lines = [w for pair in pairs for w in pair]
    words = line_dedup.hashing.mix(np.array([x for w in lines for x in w], np.uint64))
    keys, at, kinds, marks = line_dedup.block_keys(words, np.cumsum([0, *map(len, lines)]), p)
    own = [{} for _ in lines]
    for key, line, kind, mark in zip(keys.tolist(), at.tolist(), kinds.tolist(), marks.tolist()):
        own[line][key] = kind, mark
    met = 0
    for (a, b), x, y in zip(pairs, own[::2], own[1::2]):
        most = np.array([int(0.15 * max(len(a), len(b)) + 1e-9)])
        met += any(bin(x[k][1] ^ y[k][1]).count("1") <= line_dedup.mark_limit(most, np.array([x[k][0]]))[0] for k in x.keys() & y.keys())
    return met / len(pairs)


def test_recall_by_length_and_edits():
    """Two words in five are of the 25 most frequent; edits replace, delete and insert words anywhere."""
    rng, p = random.Random(4), line_dedup.Params()
    for n in (7, 8, 10, 13, 14, 20, 27, 28, 40, 55, 56, 80, 111, 112, 180, 300, 600):
        most = int(0.15 * n + 1e-9)
        for edits, least in ((1, 0.98), (max(1, most // 2), 0.97), (most, 0.95)):
            pairs = []
            for _ in range(200):
                a = [rng.randrange(25) if rng.random() < 0.4 else rng.randrange(100, 1 << 40) for _ in range(n)]
                b = list(a)
                for _ in range(edits):
                    at, way = rng.randrange(len(b)), rng.random()
                    b[at : at + (way < 0.85)] = [] if 0.7 <= way < 0.85 else [rng.randrange(1 << 41, 1 << 42)]
                pairs.append((a, b))
            assert _share(pairs, p) >= least, (n, edits)


def test_majorities():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 9, 500)
    vote = rng.integers(0, 1 << 32, int(sizes.sum()), dtype=np.uint64).astype(np.uint32)
    got = line_dedup.majorities(vote, sizes)
    ends = np.cumsum(sizes)
    for value, a, b in zip(got, ends - sizes, ends):
        own = vote[a:b]
        assert int(value) == sum(1 << k for k in range(32) if 2 * int((own >> np.uint32(k) & 1).sum()) > b - a)


def test_large_keys_go_on_whole(monkeypatch):
    """A task that holds too many keys hands on those with many rows, and every pair still meets somewhere."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    key = np.concatenate([np.full(300, 7), rng.integers(0, 60, 300)])
    entry = np.zeros(600, line_dedup._ENTRY)
    entry["key"], entry["code"], entry["n"] = key, np.arange(600), 10
    monkeypatch.setattr(line_dedup, "RUN", 50)

    class Kept:
        def repartition(self, *_):
            return self

        def mapInArrow(self, run, _):
            blobs = [pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([entry[k : k + 40].tobytes()], pa.binary())], names=["part", "blob"]) for k in range(0, 600, 40)]
            return [r for b in run(iter(blobs)) for r in zip(b.column("key").to_pylist(), b.column("code").to_pylist())]

    for held in (10**9, 100):
        monkeypatch.setattr(line_dedup, "HELD", held)
        got = line_dedup.shared_keys(Kept(), 0.85, 4)
        assert len(got) == len(set(got))
        # Keys are renamed, but lines that shared one still do.
        named = {}
        for name, code in got:
            named.setdefault(name, set()).add(code)
        for k in set(key.tolist()):
            own = set(np.flatnonzero(key == k).tolist())
            assert len(own) == 1 or any(own <= codes for codes in named.values())


def test_rows_of_numbers_are_different_lines(docs):
    rows = ["12 34 56 78 90 11 22 33", "98 76 54 32 10 99 88 77", "12 34 56 78 90 11 22 34", "a1 " * 8]
    texts = ["\n".join(rows[:2]), rows[1].replace(" ", ", "), rows[2], rows[3], "A1 " * 8, "a2 " * 8]
    assert _held(docs, texts, line_dedup.Params()) == 1
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs(texts)).collect()}
    assert [got[k] for k in range(6)] == ["\n".join(rows[:2]), "", "", rows[3], "", "a2 " * 8]


def test_queries_take_lines_of_any_length(docs, monkeypatch):
    texts = ["Home\n\nAll rights reserved", "home!\n\n--\nall rights reserved\none two three four five six seven", "one two three four five six", "", "one two three four five six eight"]
    want, links = _stay(texts, line_dedup.ALL_LINES)
    frame = docs(texts)
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    got = {r["doc_id"]: r["text"] for r in queries.op10_line_dedup(frame.sparkSession, "").collect()}
    assert [got[k] for k in range(5)] == want == [texts[0], "\n--\none two three four five six seven", "", "", ""] and links == 3
