"""Line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence per group.

A normalised line is its words, runs of ASCII letters and digits and of bytes from 0x80 on, with A-Z in lower
case; another digit is another word. Lines with fewer than ``min_words`` words are left alone. Equal normalised
lines are one class. Two classes are linked if their word edit similarity, 1 - distance / longer length, is 0.85 or
more; nothing else decides.

Candidates come from SimHash blocks. A line's words, with the number of their occurrence in the line, are dealt by
their hash to blocks, and the bits of a block are voted for by its own words only. So an edit touches the blocks of
two words and leaves all others as they were, which is what the pigeonhole needs: lines within the threshold have
most blocks in common, and a key is two blocks that together hold a few words. How many blocks a line has depends on
its length class, whose limits double; lines near the upper limit go by both classes' blocks. Long lines have more
blocks than a link needs, and keep the share of their keys with small hashes, the same keys on both sides. Blocks
find nearly all links, not all: ``tests/llm/test_line_recall.py`` measures the recall by length and edits, 0.98 or more
with one edit and 0.95 or more with as many as a link allows. A key carries a mark of its line: whether the line holds an
odd number of the words of each of 64 kinds, which an edit changes in two places at most. Keys of lines whose lengths
or marks are too far apart are left out before any words are read; in long lines the marks see a sample of the words
only, and their limit leaves room for chance.

Of each connected group the first occurrence by (doc_id, hash of the text, line) stays and all others are
taken out, in their own document too. Documents are never dropped: one without lines left has an empty text.
Null texts stay null, empty ones empty; rows with a null id stay as they are. Repeated rows (equal id and
text) are one occurrence and get equal texts. Other columns pass through; ``n_lines`` and ``n_removed``
replace columns so named.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from linkfold.llm import hashing
from linkfold.llm.common import discard, extended, marked_only, row_groups, text_buffer, written
from linkfold.llm.linkage import linked_components

#: Keys that lines of the longer classes keep of those that hold enough words.
KEYS = 20.0
#: Rows of a key that are compared where they stand, and keys that a task holds before it looks for larger ones.
RUN = 2048
HELD = 8_000_000
#: Bytes of packed keys that one task is meant to get.
PART = 32_000_000
#: Keys that are packed at once.
PACKED = 2_000_000


@dataclass(frozen=True)
class Params:
    min_words: int = 1
    similarity: float = 0.85

    def __post_init__(self):
        if not 0.7 <= self.similarity < 1:
            raise ValueError("similarities from 0.7 to below 1 are meant")

    @property
    def first(self) -> int:
        """Words of the shortest line that one edit leaves similar."""
        return next(n for n in range(1, 1000) if most_edits(n, self.similarity) > 0)


#: Lines of any length with a word, as the queries take them.
ALL_LINES = Params()


@dataclass(frozen=True)
class LengthClass:
    """Lines of ``first * 2**number`` words up to twice as many."""

    number: int
    blocks: int
    #: Distances of the two blocks of a key, the words they must hold together, and the share of keys that is kept.
    apart: tuple[int, ...]
    least: int
    share: float

    @property
    def sampled(self) -> int:
        """One word in ``2**sampled`` takes part in a line's mark."""
        return max(0, self.number - 2)


@lru_cache(maxsize=256)
def length_class(number: int, first: int) -> LengthClass:
    """Blocks and keys so that at the threshold a handful of keys are left untouched, whatever the class."""
    if number == 0:
        blocks = max(4, first + 1)
        return LengthClass(number, blocks, tuple(range(1, blocks // 2 + 1)), 2, 1.0)
    blocks = max(4, (first - 1) << number)
    if number == 1:
        return LengthClass(number, blocks, (1, 2), 3, 1.0)
    # Long lines repeat words, which leaves more of their blocks empty.
    return LengthClass(number, blocks, (1,), 3, min(1.0, (KEYS + 5 * (number - 2)) / blocks))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hashing.word_hashes(data, offsets, hashing.ALNUM)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edit distance, or ``most + 1`` if it is larger.

    Columns of the usual table are two bit vectors of vertical steps up and down, one bit for each word of a
    (Myers' bit-parallel form), so a word of b takes a few operations on integers.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    # What the lines begin and end with alike costs nothing.
    same = a[: min(len(a), len(b))] == b[: min(len(a), len(b))]
    begin = len(same) if same.all() else int(same.argmin())
    a, b = a[begin:], b[begin:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    end = n if same.all() else int(same.argmin())
    a, b = a[: len(a) - end].tolist(), b[: len(b) - end].tolist()
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    where: dict[int, int] = {}
    for k, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << k
    full, last = (1 << len(a)) - 1, len(a) - 1
    up, down, distance = full, 0, len(a)
    for done, word in enumerate(b, start=1):
        match = where.get(word, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right_up = down | ~(diagonal | up) & full
        right_down = up & diagonal
        distance += (right_up >> last & 1) - (right_down >> last & 1)
        if distance - (len(b) - done) > most:
            return most + 1
        right_up = (right_up << 1 | 1) & full
        up = ((right_down << 1) & full) | ~(diagonal | right_up) & full
        down = right_up & diagonal
    return min(distance, most + 1)


def most_edits(n: int | np.ndarray, similarity: float):
    """The edits that leave lines of at most n words similar."""
    return np.floor((1 - similarity) * n + 1e-9).astype(np.int64)


def block_keys(words: np.ndarray, bounds: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """Keys of lines, the line of each, the class by which it goes, and the line's mark in that class.

    A key is a hash of the SimHash blocks of two blocks of a line.
    """
    sizes = np.diff(bounds)
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint64))]
    top = int(sizes.max(initial=0))
    number = 0
    while p.first << number <= top / p.similarity + 1e-9:
        low, high = p.first << number, p.first << (number + 1)
        # The longest line similar to one of n words has n / similarity; those that reach this class go by it too.
        reach = np.floor(sizes / p.similarity + 1e-9) >= low
        own = np.flatnonzero(reach & (sizes < high))
        for a, b in row_groups(np.concatenate([[0], np.cumsum(sizes[own])]), 1 << 18):
            found.append(_class_keys(words, bounds, own[a:b], length_class(number, p.first)))
        number += 1
    return tuple(np.concatenate(x) for x in zip(*found))


def _class_keys(words: np.ndarray, bounds: np.ndarray, own: np.ndarray, kind: LengthClass) -> tuple[np.ndarray, ...]:
    sizes = bounds[own + 1] - bounds[own]
    row = np.repeat(np.arange(len(own)), sizes)
    feature = words[np.arange(len(row)) + np.repeat(bounds[own] - (np.cumsum(sizes) - sizes), sizes)]
    seen = np.where((feature >> np.uint64(8)) & np.uint64((1 << kind.sampled) - 1) == 0, np.uint64(1) << (feature >> np.uint64(58)), np.uint64(0))
    mark = np.bitwise_xor.reduceat(seen, np.cumsum(sizes) - sizes) if len(own) else np.zeros(0, np.uint64)
    spot = row * kind.blocks + ((feature >> np.uint64(40)) % np.uint64(kind.blocks)).astype(np.int64)
    # In one number, by block and word; equal words of a line stand together.
    order = np.sort(spot.astype(np.uint64) << np.uint64(32) | feature & _LOW)
    spot, vote = (order >> np.uint64(32)).astype(np.int64), order.astype(np.uint32)
    twice = np.flatnonzero(order[1:] == order[:-1]) + 1
    if len(twice):
        # A word's second occurrence in the line votes as another word.
        new = np.ones(len(twice), bool)
        new[1:] = np.diff(twice) > 1
        again = np.arange(len(twice)) - np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(twice)))) + 1
        vote[twice] = hashing.mix(vote[twice].astype(np.uint64) + again.astype(np.uint64) * _ODD).astype(np.uint32)
    held = np.bincount(spot, minlength=len(own) * kind.blocks)
    filled = np.flatnonzero(held)
    value = np.zeros(len(held), np.uint64)
    value[filled] = majorities(vote, held[filled])
    keys, lines = [], []
    line, block = np.divmod(filled, kind.blocks)
    for apart in kind.apart:
        other = line * kind.blocks + (block + apart) % kind.blocks
        # Two blocks opposite each other are one pair, not two.
        once = (held[other] > 0) & (held[filled] + held[other] >= kind.least) & ((2 * apart < kind.blocks) | (block < apart))
        at = np.flatnonzero(once)
        with np.errstate(over="ignore"):
            place = np.uint64(kind.number << 48 | apart << 32) + block[at].astype(np.uint64)
            found = hashing.mix((value[filled[at]] << np.uint64(32) | value[other[at]]) * _ODD + hashing.mix(place))
        if kind.share < 1:
            few = np.flatnonzero((found & np.uint64(0xFFFF)) < np.uint64(int(kind.share * 65536)))
            found, at = found[few], at[few]
        keys.append(found)
        lines.append(line[at])
    line = np.concatenate(lines)
    return np.concatenate(keys), own[line], np.full(len(line), kind.number, np.uint8), mark[line]


_LOW, _ODD = np.uint64(0xFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)


def majorities(vote: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each group of 32-bit votes the bits that more than half of them have: the SimHash of a block."""
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(len(sizes), np.uint32)
    one, two, three = (np.flatnonzero(sizes == n) for n in (1, 2, 3))
    out[one] = vote[begin[one]]
    out[two] = vote[begin[two]] & vote[begin[two] + 1]
    a, b, c = (vote[begin[three] + k] for k in range(3))
    out[three] = a & b | a & c | b & c
    # Four counters of one bit for each bit of the votes, for groups of up to 15; the largest come first.
    some = np.flatnonzero((sizes > 3) & (sizes < 16))
    some = some[np.argsort(-sizes[some])]
    n = sizes[some]
    counts = [np.zeros(len(some), np.uint32) for _ in range(4)]
    for k in range(int(n.max(initial=0))):
        carry = vote[begin[some[: int(np.searchsorted(-n, -k))]] + k]
        for count in counts:
            own = count[: len(carry)]
            carry, own[:] = own & carry, own ^ carry
    # More than half: bit by bit from the highest, larger than what is half of the group.
    larger, equal = np.zeros(len(some), np.uint32), np.full(len(some), 0xFFFFFFFF, np.uint32)
    for k in (3, 2, 1, 0):
        half = np.where(n // 2 >> k & 1, np.uint32(0xFFFFFFFF), np.uint32(0))
        larger |= equal & counts[k] & ~half
        equal &= ~(counts[k] ^ half)
    out[some] = larger
    more = np.flatnonzero(sizes > 15)
    for i, j in row_groups(np.concatenate([[0], np.cumsum(sizes[more])]), 1 << 17):
        own = more[i:j]
        n = sizes[own]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1])) + np.repeat(begin[own] - (ends - n), n)
        bits = np.unpackbits(vote[at].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1)
        ones = np.add.reduceat(bits, ends - n, axis=0, dtype=np.int32)
        out[own] = np.packbits(2 * ones > n[:, None], axis=1).view("<u4").ravel()
    return out


def mark_limit(most: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Bits in which the marks of lines with at most so many edits differ; in samples 2.5 deviations over the mean."""
    share = 0.5 ** np.maximum(kind.astype(np.int64) - 2, 0)
    changed = 2.0 * most
    return np.where(share == 1, changed, 32 * (1 - np.exp(-changed * share / 32)) + 2.5 * np.sqrt(changed * share * (1 - share)))


def _cut(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the lines of some texts, their words and the offsets of the lines in them."""
    part, own = text_buffer(text)
    # A line begins with its text or after a newline; the newline itself is no word.
    begins = np.concatenate([own[:-1], np.flatnonzero(part == 10) + 1])
    # Where a text is empty or ends in a newline, its last line shares its place with the next text's first.
    rows = np.concatenate([np.arange(len(own) - 1), np.searchsorted(own, np.flatnonzero(part == 10), side="right") - 1])
    order = np.lexsort((begins, rows))
    begins, rows = begins[order], rows[order]
    return rows, *words_of(part, np.append(begins, len(part)))


def _long_lines(batches, p: Params):
    """For stretches of a batch: its first row, and rows, numbers, words and offsets of its lines, with those long enough."""
    for batch in batches:
        _, offsets = text_buffer(batch.column("text"))
        for a, b in row_groups(offsets, hashing.BLOCK):
            rows, words, bounds = _cut(batch.column("text").slice(a, b - a))
            line = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
            yield batch.slice(a, b - a), rows, line, words, bounds, np.flatnonzero(np.diff(bounds) >= max(1, p.min_words))


def _codes(digest: np.ndarray) -> np.ndarray:
    """60 bits of a digest. A class that shares its code with another one is only looked at in vain."""
    return (digest[:, 0] >> np.uint64(4)).astype(np.int64)


#: ``_codes`` of the rows of ``lines_of``.
CODE = "shiftrightunsigned(high, 4)"


def lines_of(docs: DataFrame, p: Params) -> DataFrame:
    """Lines long enough: where they stand, and a 128-bit digest of their words as two numbers; ``CODE`` is 60 bits of it."""
    read = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("row"), "text")

    def run(batches):
        for part, rows, line, words, bounds, long in _long_lines(batches, p):
            digest = hashing.sequence_hashes(words, bounds)[long]
            yield pa.RecordBatch.from_arrays(
                [part.column(c).take(pa.array(rows[long])) for c in ("doc_id", "row")]
                + [pa.array(line[long].astype(np.int32)), *(pa.array(np.ascontiguousarray(digest[:, k]).view(np.int64)) for k in (0, 1))],
                names=["doc_id", "row", "line", "high", "low"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    found = read.mapInArrow(run, f"doc_id {kind}, row long, line int, high long, low long")
    return found.select(F.struct("doc_id", "row", "line").alias("place"), "high", "low")


# --- keys, packed -------------------------------------------------------------------------

_ENTRY = np.dtype([("key", "<u4"), ("code", "<i8"), ("n", "<u2"), ("kind", "u1"), ("mark", "<u8")])
_LONGEST = 65535


def packed_keys(docs: DataFrame, p: Params, parts: int) -> DataFrame:
    """(part, blob): the keys of all lines, dealt by their upper bits, as arrays of 23 bytes a key with its line.

    Equal lines that a task meets together are packed once.
    """
    read = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("text")

    def run(batches):
        held, n = [], 0
        for _, _, _, words, bounds, long in _long_lines(batches, p):
            sizes = np.diff(bounds)
            long = long[np.floor(sizes[long] / p.similarity + 1e-9) >= p.first]
            if not len(long):
                continue
            codes = _codes(hashing.sequence_hashes(words, bounds))
            _, once = np.unique(codes[long], return_index=True)
            own = long[once]
            # Keys are made for these lines only.
            at = np.repeat(bounds[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(int(sizes[own].sum()))
            keys, line, kind, mark = block_keys(words[at], np.concatenate([[0], np.cumsum(sizes[own])]), p)
            line = own[line]
            part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            entry = np.empty(len(keys), _ENTRY)
            entry["key"], entry["code"], entry["n"] = keys.astype(np.uint32), codes[line], np.minimum(sizes[line], _LONGEST)
            entry["kind"], entry["mark"] = kind, mark
            held.append((part.astype(np.int32), entry))
            n += len(keys)
            if n >= PACKED:
                yield _packed(held)
                held, n = [], 0
        if n:
            yield _packed(held)

    return read.mapInArrow(run, "part int, blob binary")


def _in_order(key: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The order of rows by key and code. Few keys have several rows, so codes are looked at in those only."""
    order = np.argsort(key)
    found = key[order]
    same = np.concatenate([[False], found[1:] == found[:-1], [False]])
    tied = np.flatnonzero(same[1:] | same[:-1])
    rows = order[tied]
    order[tied] = rows[np.lexsort((code[rows], key[rows]))]
    return order


def _packed(held: list) -> pa.RecordBatch:
    part, entry = (np.concatenate(x) for x in zip(*held))
    order = _in_order(part.astype(np.uint64) << np.uint64(32) | entry["key"], entry["code"])
    part, entry = part[order], entry[order]
    if len(part):
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (entry["key"][1:] != entry["key"][:-1]) | (entry["code"][1:] != entry["code"][:-1])
        part, entry = part[new], entry[new]
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    blobs = [x.tobytes() for x in np.split(entry, begin[1:])]
    return pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.array(blobs, pa.binary())], names=["part", "blob"])


def shared_keys(packed: DataFrame, similarity: float, parts: int) -> DataFrame:
    """(key, code, n, kind, mark) of the lines that may be linked to another one of their key; keys are renamed.

    A part's keys are sorted and compared in one place. A task that has to hold more than it should looks for keys with
    more than ``RUN`` rows; those go on as they are, with all that still come, and are compared in blocks later.
    """

    def run(batches):
        held, n, large = [], 0, np.zeros(0, np.int64)
        for batch in batches:
            for part, blob in zip(batch.column("part").to_numpy(), batch.column("blob")):
                entry = np.frombuffer(blob.as_buffer(), _ENTRY)
                rows = (int(part) << 32 | entry["key"].astype(np.int64), entry["code"].copy(), entry["n"].copy(), entry["kind"].copy(), entry["mark"].copy())
                if len(large):
                    on = np.isin(rows[0], large)
                    if on.any():
                        yield _rows(*(r[on] for r in rows))
                        rows = tuple(r[~on] for r in rows)
                held.append(rows)
                n += len(rows[0])
                if n > HELD:
                    held = [_distinct(held)]
                    keys, many = np.unique(held[0][0], return_counts=True)
                    large = np.concatenate([large, keys[many > RUN]])
                    on = np.isin(held[0][0], large)
                    yield _rows(*(r[on] for r in held[0]))
                    held = [tuple(r[~on] for r in held[0])]
                    n = 0  # what is left has no large key; the next look is after as many more
        if held:
            yield _may_link_in(*_distinct(held), similarity)

    return packed.repartition(parts, "part").mapInArrow(run, "key long, code long, n int, kind int, mark long")


def _distinct(held: list) -> tuple[np.ndarray, ...]:
    """Rows in order of key and code, each pair once."""
    rows = [np.concatenate(x) for x in zip(*held)]
    order = _in_order(rows[0], rows[1])
    rows = [r[order] for r in rows]
    new = np.ones(len(order), bool)
    new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
    return tuple(r[new] for r in rows)


def _rows(key: np.ndarray, code: np.ndarray, n: np.ndarray, kind: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
    cells = [pa.array(key), pa.array(code), pa.array(n.astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(np.ascontiguousarray(mark).view(np.int64))]
    return pa.RecordBatch.from_arrays(cells, names=["key", "code", "n", "kind", "mark"])


def _may_link_in(key: np.ndarray, code: np.ndarray, n: np.ndarray, kind: np.ndarray, mark: np.ndarray, similarity: float) -> pa.RecordBatch:
    """Rows of sorted keys that may be linked to another one of their key, and all rows of keys with more than ``RUN``."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begin, len(key)))
    near = np.repeat(sizes > RUN, sizes)
    last = np.repeat(np.where(sizes > RUN, 0, begin + sizes), sizes)
    words = n.astype(np.int64)
    at, step = np.arange(len(key)), 1
    while len(at):
        at = at[at + step < last[at]]
        a, b = at, at + step
        most = most_edits(np.maximum(words[a], words[b]), similarity)
        hit = at[(np.abs(words[a] - words[b]) <= most) & (np.bitwise_count(mark[a] ^ mark[b]) <= mark_limit(most, kind[a]))]
        near[hit] = near[hit + step] = True
        step += 1
    # Lines that are near to each other share many keys: those with the same lines get the same name.
    name = key.copy()
    group = np.repeat(np.arange(len(sizes)), sizes)
    own = np.flatnonzero(near & (last > 0))
    if len(own):
        total = np.zeros(len(sizes), np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], group[own][1:] != group[own][:-1]]))
        with np.errstate(over="ignore"):
            total[group[own][starts]] = np.add.reduceat(hashing.mix(code[own].view(np.uint64)), starts)
        name[own] = hashing.mix(total)[group[own]].view(np.int64)
    return _rows(*(x[near] for x in (name, code, n, kind, mark)))


def _texts(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """(node, text) of the lines at the heads' places, by their codes, read from the documents again."""
    line = F.struct(F.col("place.line").alias("line"), F.col("code").alias("node"))
    wanted = written(heads.groupBy(F.col("place.doc_id").alias("_id"), F.col("place.row").alias("_row")).agg(F.collect_list(line).alias("lines")), "wanted")
    some = marked_only(docs.select("doc_id", F.xxhash64("text").alias("row"), "text"), ["doc_id", "row"], wanted, ["_id", "_row"])
    read = some.join(wanted, (F.col("doc_id") == F.col("_id")) & (F.col("row") == F.col("_row")))

    def pick(batches):
        for batch in batches:
            nodes, found = [], []
            for text, lines in zip(batch.column("text"), batch.column("lines").to_pylist()):
                parts = text.as_py().split("\n")
                nodes += [x["node"] for x in lines]
                found += [parts[x["line"]] for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.string())], names=["node", "text"])

    # Repeated rows repeat a place.
    return read.select("text", "lines").mapInArrow(pick, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))


class Lines:
    """Words of normalised lines, for exact comparison, and how many of 256 kinds each holds."""

    def __init__(self, texts: pa.Array, similarity: float):
        self.words, self.bounds = words_of(*text_buffer(texts))
        self.sizes = np.diff(self.bounds)
        self.similarity = similarity
        at = np.repeat(np.arange(len(self.sizes)), self.sizes) << 8 | (self.words >> np.uint64(56)).astype(np.int64)
        self.kinds = np.minimum(np.bincount(at, minlength=len(self.sizes) << 8), 32767).astype(np.int16).reshape(-1, 256)

    def _of(self, k: int) -> np.ndarray:
        return self.words[self.bounds[k] : self.bounds[k + 1]]

    def links(self, x: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        most = most_edits(np.maximum(self.sizes[others], self.sizes[x]), self.similarity)
        fit = np.flatnonzero(np.abs(self.sizes[others] - self.sizes[x]) <= most)
        # An edit changes two counts by one at most.
        fit = fit[np.abs(self.kinds[others[fit]] - self.kinds[x]).sum(axis=1, dtype=np.int64) <= 2 * most[fit]]
        for k in fit:
            out[k] = edit_distance(self._of(x), self._of(int(others[k])), int(most[k])) <= most[k]
        return out


def may_link(m: Column, n: Column, similarity: float) -> Column:
    """Whether two lines (n, kind, mark) of a key can be linked by their lengths and marks; ``mark_limit`` as a column."""
    most = F.floor(F.lit(1 - similarity) * F.greatest(m["n"], n["n"]) + F.lit(1e-9))
    share = F.pow(F.lit(0.5), F.greatest(m["kind"] - 2, F.lit(0)))
    changed = most * 2.0
    sampled = 32 * (1 - F.exp(-changed * share / 32)) + 2.5 * F.sqrt(changed * share * (1 - share))
    limit = F.when(share == 1, changed).otherwise(sampled)
    return (F.abs(m["n"] - n["n"]) <= most) & (F.bit_count(m["mark"].bitwiseXOR(n["mark"])) <= limit)


def removals(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, row (hash of the text) and the line numbers, from 0, to take out."""
    docs = docs.select("doc_id", "text")
    spark, similarity = docs.sparkSession, p.similarity
    lines = written(lines_of(docs, p), "lines")
    # A line has about a dozen keys; so many parts that each is a bounded piece of work.
    size = lines.count() * 12 * _ENTRY.itemsize
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    close = shared_keys(packed_keys(docs, p, parts), similarity, parts)
    # The first row of several gives all three.
    first = close.groupBy("key", F.col("code").alias("node")).agg(*(F.first(c).alias(c) for c in ("n", "kind", "mark")))
    buckets = written(first.select("key", "node", F.struct("n", "kind", "mark").alias("info")), "buckets")
    discard()
    # Only lines that have a twin or share a key go on: by codes, which a line of another class may share.
    codes = written(buckets.select(F.col("node").alias("_code")).distinct(), "codes")
    twins = lines.groupBy(F.expr(CODE).alias("_code")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_code")
    # Written first, so that the lines of a very common code can be split where they are joined.
    picked = written(twins.union(codes).distinct(), "picked")
    members = written(lines.join(picked, F.expr(CODE) == F.col("_code"), "left_semi"), "members")
    discard(lines, picked)
    classes = written(members.groupBy("high", "low").agg(F.min("place").alias("node")), "classes")
    # Of classes that share a code, which hardly any do, the first stands for it.
    near = classes.withColumn("code", F.expr(CODE)).join(codes, F.col("code") == F.col("_code"), "left_semi")
    heads = near.groupBy("code").agg(F.min(F.struct(F.col("node").alias("place"), "high", "low")).alias("_h"))
    heads = written(heads.select("code", "_h.*"), "heads")
    texts = written(_texts(docs, heads), "words")
    discard(codes)
    found = linked_components(buckets, texts, lambda m, n: may_link(m, n, similarity), lambda t: Lines(t, similarity))
    discard(buckets, texts)
    # A component is named by its first place.
    named = written(found.join(heads, F.col("node") == F.col("code")).select("high", "low", "component", "place"), "named")
    firsts = named.groupBy("component").agg(F.min("place").alias("_first")).withColumnRenamed("component", "_c")
    label = named.join(firsts, F.col("component") == F.col("_c")).select(F.col("high").alias("_h"), F.col("low").alias("_l"), "_first")
    stays = classes.join(label, (F.col("high") == F.col("_h")) & (F.col("low") == F.col("_l")), "left")
    stays = written(stays.select(F.col("high").alias("_h"), F.col("low").alias("_l"), F.coalesce("_first", "node").alias("stay")), "stays")
    gone = members.join(stays, (F.col("high") == F.col("_h")) & (F.col("low") == F.col("_l"))).filter(F.col("place") != F.col("stay"))
    return gone.groupBy("place.doc_id", "place.row").agg(F.collect_set("place.line").alias("lines"))


def deduplicated(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_lines``, ``n_removed`` appended."""
    gone = written(removals(docs, p), "gone").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "lines")
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    read = docs.select(*keep, F.xxhash64("text").alias("_hash"))
    ids = ["doc_id", "_hash"], gone, ["_id", "_row"]
    # Documents that lose nothing need not move.
    joined = marked_only(read, *ids).join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_row")), "left")
    joined = joined.select(*keep, F.col("lines").alias("_lines"))
    joined = joined.unionByName(marked_only(read, *ids, "left_anti").select(*keep, F.lit(None).cast("array<int>").alias("_lines")))

    def run(batches):
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, lines in zip(batch.column("text").to_pylist(), batch.column("_lines").to_pylist()):
                parts = (text or "").split("\n")
                out = set(lines or ())
                texts.append("\n".join(x for k, x in enumerate(parts) if k not in out) if out else text)
                counts.append(len(parts) if text else 0)
                removed.append(len(out))
            cells = [pa.array(texts, batch.column("text").type) if c == "text" else batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*keep, "n_lines", "n_removed"])

    return joined.mapInArrow(run, extended(docs.select(*keep).schema, n_lines="long", n_removed="long"))
