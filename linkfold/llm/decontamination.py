"""Benchmark decontamination: suffix arrays over shards of the training texts, searched for every test suffix.

Words are runs of ASCII letters and digits and of bytes from 0x80 on, with A-Z in lower case. A window is
``WINDOW`` neighbouring words of a benchmark item; an item of fewer words, but not none, is one window. A shard is a
stretch of whole documents of bounded size. Its words are numbered by the benchmark's vocabulary, and stretches
of words that are all in it, and long enough for a window, are sorted into a suffix array by prefix doubling. Each
test suffix that begins a window is then found by binary search: the range of training suffixes with its window
are the locations, and a location whose words before differ begins a longest verbatim match, which is followed to its
end. Documents with a location are affected.

Words are compared by 64-bit hashes. The benchmark goes to the tasks in blocks of about ``BLOCK`` bytes of text; a
document's hits of one block are kept with it for the next. A shard never cuts a document.

Null texts have no words and are not contaminated, nor are empty ones. Items without an id cannot be named and take
no part; items that share an id are one item with several texts. Repeated rows are each looked at. Columns
of the documents pass through; those named like an added column are replaced. An empty benchmark affects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkfold.llm import hashing
from linkfold.llm.common import extended, row_groups, text_buffer, written

WINDOW = 10
#: Bytes of document text in a shard, and of benchmark text in a block that is sent to the tasks.
SHARD = 4_000_000
BLOCK = 4_000_000
#: (document, item) pairs, or longest matches, that are held at once.
HELD = 500_000


# --- the test side ----------------------------------------------------------------------------


@dataclass
class Items:
    """A block of the benchmark, its words numbered from 1 on by their place in ``vocabulary``; a 0 ends each item."""

    vocabulary: np.ndarray
    words: np.ndarray
    #: Of each word: its item and its place there; of each item: its id.
    item: np.ndarray
    place: np.ndarray
    ids: np.ndarray
    #: Distinct windows: where the first suffix that begins with it starts, its words, and where its suffixes are listed.
    first: np.ndarray
    size: np.ndarray
    listed: np.ndarray
    suffixes: np.ndarray

    @staticmethod
    def of(ids: list[str], texts: list[str], window: int = WINDOW) -> Items:
        hashes, bounds = hashing.word_hashes(*text_buffer(pa.array(texts, pa.large_string())))
        vocabulary, codes = np.unique(hashes, return_inverse=True)
        sizes = np.diff(bounds)
        total = len(hashes) + len(sizes)
        words, item, place = np.zeros(total, np.int32), np.zeros(total, np.int64), np.zeros(total, np.int64)
        begin = bounds[:-1] + np.arange(len(sizes))
        own = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(hashes)) + own
        words[at], item[at], place[at] = codes + 1, own, at - begin[own]
        need = np.minimum(sizes, window)[own]
        starts = at[place[at] + need <= sizes[own]]
        need = need[place[at] + need <= sizes[own]]
        first, size, listed, suffixes = [], [], [np.zeros(1, np.int64)], []
        for n in np.unique(need):
            mine = starts[need == n]
            _, one, group = np.unique(np.stack([words[mine + k] for k in range(n)], axis=1), axis=0, return_index=True, return_inverse=True)
            first.append(mine[one])
            size.append(np.full(len(one), n, np.int64))
            suffixes.append(mine[np.argsort(group.ravel(), kind="stable")])
            listed.append(listed[-1][-1] + np.cumsum(np.bincount(group.ravel(), minlength=len(one))))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return Items(vocabulary, words, item, place, np.array(ids, object), join(first), join(size), join(listed), join(suffixes))


# --- a shard ----------------------------------------------------------------------------------


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``s`` in order, by prefix doubling; only suffixes still tied are sorted again."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(s)
    rank = np.zeros(n + 1, np.int64)  # the end ranks before all else
    new = np.ones(n, bool)
    new[1:] = s[order[1:]] != s[order[:-1]]
    # A group's rank is the place of its last member, from 1 on.
    last = lambda starts, total: np.append(starts[1:], total)
    starts = np.flatnonzero(new)
    ends = last(starts, n)
    rank[order] = np.repeat(ends, ends - starts)
    open_ = np.repeat(ends - starts > 1, ends - starts)
    at, step = np.flatnonzero(open_), 1
    while len(at):
        tied = order[at]
        key = rank[tied] * (n + 1) + rank[np.minimum(tied + step, n)]
        by = np.argsort(key)
        # Groups keep their places: ranks lead the key, and ``at`` lists places in order.
        order[at] = tied[by]
        key = key[by]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        ends = last(starts, len(at))
        rank[order[at]] = np.repeat(at[ends - 1] + 1, ends - starts)
        at = at[np.repeat(ends - starts > 1, ends - starts)]
        step *= 2
    return order


class Shard:
    """The suffix array of the words of some texts that a window can lie in."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, items: Items):
        self.items, self.bounds = items, bounds
        n = len(hashes)
        known = np.zeros(n, bool)
        codes = np.zeros(n, np.int32)
        if len(items.vocabulary) and n:
            at = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
            known = items.vocabulary[at] == hashes
            codes = np.where(known, at + 1, 0).astype(np.int32)
        # Runs of known words inside one text, long enough for the shortest window.
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        begin = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]]))) if n else np.zeros(0, np.int64)
        end = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1 if n else np.zeros(0, np.int64)
        fit = end - begin >= (items.size.min() if len(items.size) else n + 1)
        begin, end = begin[fit], end[fit]
        run = np.repeat(np.arange(len(begin)), end - begin)
        word = np.arange(len(run)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + begin[run]
        spot = np.arange(len(run)) + run
        # One zero between runs, and zeros at the end so that a look ahead stays inside.
        self.words = np.zeros(len(run) + len(begin) + int(items.size.max(initial=0)) + 1, np.int32)
        self.words[spot] = codes[word]
        self.word = np.full(len(self.words), -1, np.int64)
        self.word[spot] = word
        body = len(run) + len(begin)
        order = suffix_array(self.words[:body]) if body else np.zeros(0, np.int64)
        self.order = order[self.words[order] > 0]

    def _edge(self, after: bool) -> np.ndarray:
        """For each distinct window, the first training suffix not before it, or after all that begin with it."""
        items = self.items
        low, high = np.zeros(len(items.first), np.int64), np.full(len(items.first), len(self.order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            before = np.full(len(open_), after)  # whether the suffix at mid is before the edge; if equal, ``after``
            left = np.arange(len(open_))
            for k in range(int(items.size.max())):
                left = left[items.size[open_[left]] > k]
                mine, asked = self.words[self.order[mid[left]] + k], items.words[items.first[open_[left]] + k]
                before[left] = np.where(mine < asked, True, np.where(mine > asked, False, before[left]))
                left = left[mine == asked]
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
        return low

    def locations(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows and the places in ``words`` where they occur, row by row."""
        if not len(self.order) or not len(self.items.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = self._edge(False), self._edge(True)
        many = high - low
        window = np.repeat(np.arange(len(low)), many)
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + low[window]
        return window, self.order[at]


def hits(shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and end word of each maximal stretch of hit words, and (text, window) pairs, both by text."""
    window, at = shard.locations()
    word = shard.word[at]
    n = int(shard.bounds[-1])
    change = np.bincount(word, minlength=n + 1) - np.bincount(word + shard.items.size[window], minlength=n + 1)
    hit = np.cumsum(change)[:n] > 0
    edge = np.zeros(n + 1, bool)
    edge[shard.bounds] = True
    begin = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]]))) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1 if n else np.zeros(0, np.int64)
    text = np.searchsorted(shard.bounds, begin, side="right") - 1
    pairs = np.unique((np.searchsorted(shard.bounds, word, side="right") - 1) * (len(shard.items.first) + 1) + window)
    of, window = np.divmod(pairs, len(shard.items.first) + 1)
    return text, begin - shard.bounds[text], end - shard.bounds[text], of, window


def longest(shard: Shard):
    """Longest verbatim matches, in parts of at most about HELD: word in the shard, word in the items, length."""
    items = shard.items
    window, at = shard.locations()
    many = items.listed[window + 1] - items.listed[window]
    ends = np.cumsum(many)
    k = 0
    while k < len(window):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + HELD, side="right")))
        own = many[k:to]
        row = np.repeat(np.arange(k, to), own)
        suffix = items.suffixes[np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + items.listed[window[row]]]
        place = at[row]
        # What also agrees one word earlier is inside a longer match.
        start = (place == 0) | (items.place[suffix] == 0) | (shard.words[place - 1] != items.words[suffix - 1]) | (shard.words[place - 1] == 0)
        place, suffix = place[start], suffix[start]
        length = items.size[window[row[start]]].copy()
        grow = np.arange(len(place))
        while len(grow):
            mine = shard.words[np.minimum(place[grow] + length[grow], len(shard.words) - 1)]
            grow = grow[(mine == items.words[suffix[grow] + length[grow]]) & (mine > 0)]
            length[grow] += 1
        yield shard.word[place], suffix, length
        k = to


# --- Spark ------------------------------------------------------------------------------------


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> list[Items]:
    """The benchmark in blocks of about BLOCK bytes, each small enough for the driver and a broadcast."""
    own = written(benchmark.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).filter("id is not null").distinct(), "benchmark")
    size = own.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    many = max(1, -(-size // BLOCK))
    out = []
    for k in range(many):
        rows = own.filter(F.pmod(F.xxhash64("id"), F.lit(many)) == k).orderBy("id", "text").collect()  # one block
        found = Items.of([r["id"] for r in rows], [r["text"] for r in rows])
        if len(found.first):
            out.append(found)
    return out


def _texts(batch: pa.RecordBatch, text: str):
    """(first row, end row, word hashes, bounds) of each shard of a batch."""
    data, offsets = text_buffer(batch.column(text))
    for a, b in row_groups(offsets, SHARD):
        hashes, bounds = hashing.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, hashes, bounds


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Values of rows in order as one list a row."""
    ends = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


_ADDED = {"n_words": "long", "hit_starts": "array<long>", "hit_ends": "array<long>", "hit_items": "array<string>"}


def affected(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Columns ``keep`` of every document with ``n_words``, stretches of hit words (first, end) and item ids.

    Stretches of one block of the benchmark are disjoint and in order; ``n_hit`` counts words over all blocks.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*_ADDED, "n_hit")]
    blocks = item_blocks(benchmark, item_id) or [Items.of([], [])]
    state = docs.select(*dict.fromkeys([*keep, text]))
    for k, items in enumerate(blocks):
        state = _pass(state, items, keep if k + 1 == len(blocks) else list(dict.fromkeys([*keep, text])), text, first=k == 0)
        if k + 1 < len(blocks):
            state = written(state, "hits")
    # Words hit in several blocks count once: stretches are merged in order of their starts.
    merged = F.aggregate(
        F.array_sort(F.arrays_zip("hit_starts", "hit_ends")),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["hit_ends"] - F.greatest(s["hit_starts"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], s["hit_ends"]).alias("upto")
        ),
    )["n"]
    return state.withColumn("n_hit", merged)


def _pass(docs: DataFrame, items: Items, keep: list[str], text: str, first: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        items = sent.value
        for batch in batches:
            for a, b, hashes, bounds in _texts(batch, text):
                at, begin, end, of, window = hits(Shard(hashes, bounds, items))
                n, k = b - a, 0
                many = np.cumsum(np.bincount(of, (items.listed[window + 1] - items.listed[window]).astype(float), minlength=n)) if n else np.zeros(0)
                while k < n:
                    # So many documents that their items, one for each window at most, are no more than HELD.
                    to = max(k + 1, int(np.searchsorted(many, (many[k - 1] if k else 0) + HELD, side="right")))
                    part = batch.slice(a + k, to - k)
                    spans = slice(*np.searchsorted(at, [k, to]))
                    pairs = slice(*np.searchsorted(of, [k, to]))
                    own = [
                        _lists(at[spans] - k, to - k, pa.array(begin[spans])),
                        _lists(at[spans] - k, to - k, pa.array(end[spans])),
                        _named(of[pairs] - k, window[pairs], items, to - k),
                    ]
                    if not first:
                        names = ("hit_starts", "hit_ends", "hit_items")
                        own = [pa.array([x + y for x, y in zip(part.column(c).to_pylist(), now.to_pylist())], now.type) for c, now in zip(names, own)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(np.diff(bounds)[k:to]), *own], names=[*keep, *_ADDED])
                    k = to

    return docs.mapInArrow(run, extended(docs.select(*keep).schema, **_ADDED))


def _named(text: np.ndarray, window: np.ndarray, items: Items, n: int) -> pa.ListArray:
    """The ids of the items that have any of a text's windows, each once, as one list a text."""
    own = items.listed[window + 1] - items.listed[window]
    row = np.repeat(np.arange(len(window)), own)
    suffix = items.suffixes[np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + items.listed[window[row]]] if len(row) else np.zeros(0, np.int64)
    pairs = np.unique(text[row] * (len(items.ids) + 1) + items.item[suffix])
    at, item = np.divmod(pairs, len(items.ids) + 1)
    # Texts of one id stand next to each other: the id is listed once.
    names = items.ids[item] if len(item) else np.zeros(0, object)
    once = np.ones(len(names), bool)
    if len(names) > 1:
        once[1:] = (at[1:] != at[:-1]) | (names[1:] != names[:-1])
    return _lists(at[once], n, pa.array(list(names[once]), pa.string()))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, and where each longest verbatim match begins in both, in words, with its length."""
    kind = docs.schema[doc_id].dataType.simpleString()
    out = None
    for items in item_blocks(benchmark, item_id):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            items = sent.value
            for batch in batches:
                for a, _, hashes, bounds in _texts(batch, text):
                    for word, suffix, length in longest(Shard(hashes, bounds, items)):
                        row = np.searchsorted(bounds, word, side="right") - 1
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(doc_id).take(pa.array(row + a)),
                                pa.array(list(items.ids[items.item[suffix]]), pa.string()),
                                pa.array(word - bounds[row]),
                                pa.array(items.place[suffix]),
                                pa.array(length),
                            ],
                            names=["doc_id", "item_id", "doc_word", "item_word", "n_words"],
                        )

        found = docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, item_id string, doc_word long, item_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id string, doc_word long, item_word long, n_words long")
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item has a window in, with the columns of ``docs``."""
    own = docs.withColumns({f"_{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns) if c in (*_ADDED, "n_hit")})
    left = affected(own, benchmark).filter("n_hit = 0")
    return left.select(*(F.col(f"_{i}").alias(c) if c in (*_ADDED, "n_hit") else F.col(f"`{c}`") for i, c in enumerate(docs.columns)))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = affected(docs, benchmark, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hit_items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
