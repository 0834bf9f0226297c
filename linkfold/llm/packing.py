"""Best-fit packing by the configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fit into one sequence. The linear program covers every length as often
as there are pieces of it by as few configurations as it can. It is solved by multiplicative weights: each length has a
price, one knapsack dynamic program a round prices all lengths, that is, finds the best configuration and, for every
length, the best one that holds it. Those of nearly the best value are used for at most what each length asks for;
then prices fall for lengths that were served and rise against the others. Prices divided by the best value are a
solution of the dual, so every round gives a lower bound on any packing. Rounds end when the average of all rounds
covers everything within ``TOLERANCE`` of the bound, or after ``ROUNDS``.

The averaged amounts are rounded down to whole numbers, the largest first, and what rounding leaves is packed
best-fit, longest first. Where best-fit alone needs fewer sequences, its plan is taken. All of this sees the histogram
only, whose size is the sequence length, so it runs on the driver; pieces find their places by their rank among the
pieces of their length.

Null texts count as empty: one piece that holds the end token alone. Repeated rows, also with equal ids, are
packed each on its own. Extra columns are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from linkfold.llm.common import row_groups, written

#: Rounds of the linear program, and how near to its bound it has to come.
ROUNDS = 100
TOLERANCE = 0.01
#: Rows of a length that one task ranks, on average.
RANKED = 20_000


# --- tokens -------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    import tiktoken

    ranks: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ids(text: str, own, path: str) -> np.ndarray:
    try:
        return own.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        # Its expressions give up on white space of about a million characters without a break; the other library does not.
        return np.array(_library(str(Path(path).with_suffix(".json"))).encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(
    docs: DataFrame, path: str, pattern: str, special: dict[str, int], end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length and ids of every piece; only documents over ``capacity`` are cut, the first piece short.

    ``path`` is the vocabulary's rank file on every machine; its ids are those of the merge list it was made from,
    which lies beside it as JSON and takes the texts that the rank file's library cannot.
    """
    specials = tuple(sorted(special.items()))

    def run(batches):
        own = _encoding(path, pattern, specials)
        for batch in batches:
            column = batch.column(text)
            sizes = np.array([0, *np.cumsum([len(t.as_py() or "") for t in column])], np.int64)
            for a, b in row_groups(sizes, 4_000_000):
                source, number, start, length, blob = [], [], [], [], []
                for k in range(a, b):
                    ids = np.append(_ids(column[k].as_py() or "", own, path), end_id).astype("<u4")
                    n, at, j = len(ids), 0, 0
                    while at < n:
                        to = at + (capacity if at else (n - 1) % capacity + 1)
                        source.append(k)
                        number.append(j)
                        start.append(at)
                        length.append(to - at)
                        blob.append(ids[at:to].tobytes())
                        at, j = to, j + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(doc_id).take(pa.array(source, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(blob, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


# --- the plan ------------------------------------------------------------------------------


def _knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for every room up to ``capacity`` and the last length put in, 0 for none."""
    sizes = np.flatnonzero(price[: capacity + 1] > 0)
    sizes = sizes[sizes > 0]
    worth = price[sizes]
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, room, side="right"))
        if n:
            value = best[room - sizes[:n]] + worth[:n]
            k = int(value.argmax())
            if value[k] > best[room - 1]:
                best[room], last[room] = value[k], sizes[k]
                continue
        best[room] = best[room - 1]
    return best, last


def _fill(last: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if last[room]:
            out.append(int(last[room]))
            room -= int(last[room])
        else:
            room -= 1
    return out


Plan = list[tuple[tuple[int, ...], int]]


def solve(counts: np.ndarray, capacity: int) -> Plan:
    """(configuration, whole number of sequences) pairs that hold exactly ``counts[l]`` pieces of each length l."""
    amount, cover, _ = linear_program(counts, capacity)
    return min((rounded(counts, capacity, amount, cover), best_fit(counts, capacity)), key=lambda plan: sum(many for _, many in plan))


def linear_program(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[dict[tuple[int, ...], float], np.ndarray, float]:
    """Summed amounts of configurations, how often they cover each length, and a lower bound on the number of sequences.

    The step falls with the rounds, and so does the share that a configuration may be worse than the best one.
    """
    sizes = np.flatnonzero(counts)
    n = counts[sizes].astype(float)
    at = np.full(capacity + 1, -1)
    at[sizes] = np.arange(len(sizes))
    price, cover, amount = sizes / capacity, np.zeros(len(sizes)), {}
    bound, total = float((sizes * n).sum() / capacity), 0.0
    for turn in range(rounds if len(sizes) else 0):
        full = np.zeros(capacity + 1)
        full[sizes] = price
        value, last = _knapsack(full, capacity)
        # No configuration is worth more than the best, so prices over its value are a dual solution.
        bound = max(bound, float((n * price).sum() / value[capacity]))
        price = price / value[capacity]
        worth = price + value[capacity - sizes] / value[capacity]
        left, slack = n.copy(), 0.02 / (1 + turn / 20)
        for k in np.argsort(-worth, kind="stable"):
            if worth[k] < 1 - slack:
                break
            if left[k] <= 1e-9:
                continue
            config = tuple(sorted([int(sizes[k]), *_fill(last, capacity - int(sizes[k]))], reverse=True))
            held, times = np.unique(at[list(config)], return_counts=True)
            # The configuration's width: the first of its lengths that has no more to ask for ends it.
            many = float((left[held] / times).min())
            if many > 1e-9:
                left[held] -= many * times
                amount[config] = amount.get(config, 0.0) + many
                total += many
        served = 1 - left / n
        cover += served
        price = price * np.exp(-(served - served.mean()) / (1 + turn / 15))
        if cover.min() > 0 and total / cover.min() <= bound * (1 + tolerance):
            break
    return amount, cover, bound


def rounded(counts: np.ndarray, capacity: int, amount: dict[tuple[int, ...], float], cover: np.ndarray) -> Plan:
    """The amounts over the usual cover as whole numbers, as far as the pieces last, and best-fit for the rest."""
    scale = 1 / max(float(np.median(cover)), 1e-9) if len(cover) else 0.0
    plan: Plan = []
    rest = counts.astype(np.int64).copy()
    for config, x in sorted(amount.items(), key=lambda item: -item[1]):
        lengths, times = np.unique(config, return_counts=True)
        whole = min(int(np.floor(x * scale + 1e-6)), int((rest[lengths] // times).min()))
        if whole > 0:
            plan.append((config, whole))
            rest[lengths] -= whole * times
    return plan + best_fit(rest, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Longest first, each into the fullest sequence that has room; equal sequences are one entry with a number."""
    rooms: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for size in range(capacity, 0, -1):
        todo = int(counts[size])
        for room in range(size, capacity):
            while todo and rooms[room]:
                config, have = rooms[room].popitem()
                many = have
                fit = min(room // size, -(-todo // many)) if todo >= many else 1
                if todo < many:
                    rooms[room][config] = have - todo
                    many, fit = todo, 1
                elif todo < many * fit:
                    fit = max(1, todo // many)
                new = config + (size,) * fit
                spot = rooms[room - size * fit]
                spot[new] = spot.get(new, 0) + many
                todo -= many * fit
        per = capacity // size
        if todo >= per:
            full = (size,) * per
            spot = rooms[capacity - size * per]
            spot[full] = spot.get(full, 0) + todo // per
            todo %= per
        if todo:
            part = (size,) * todo
            spot = rooms[capacity - size * todo]
            spot[part] = spot.get(part, 0) + 1
    return [item for spot in rooms for item in spot.items()]


def slots(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Runs of places: for each length, from which rank on, the first sequence and the offset; ordered by (length, rank)."""
    taken = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for config, many in plan:
        offset = 0
        for size in config:
            rows.append((size, taken[size], sequence, offset))
            taken[size] += many
            offset += size
        sequence += many
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return tuple(table[:, k].copy() for k in range(4))


def pack(found: DataFrame, capacity: int) -> DataFrame:
    """``sequence_id`` and ``offset`` for every piece; ``found`` has doc_id, piece, length and is stable when read again."""
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    runs = slots(solve(counts, capacity), capacity)
    sent = found.sparkSession.sparkContext.broadcast(runs)
    # A length may be that of a third of all pieces: it is ranked in buckets, whose counts give their first ranks.
    buckets = max(1, -(-int(counts.sum()) // RANKED))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int")
    spread = found.withColumn("_bucket", bucket)
    sizes = spread.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("length", "_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "piece")
    ranked = (
        spread.withColumn("_k", F.row_number().over(own) - 1)
        .join(firsts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_k") + F.col("_first"))
        .drop("_k", "_first", "_bucket")
    )

    def place(batches):
        size, first, sequence, offset = sent.value
        keys = size << 40 | first
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, length.astype(np.int64) << 40 | rank, side="right") - 1
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"]
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank"]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def packed_digest(docs: DataFrame, path: str, pattern: str, special: dict[str, int], end_id: int, capacity: int) -> DataFrame:
    """Pieces with the checksum of their ids and their places. Texts are encoded once; the narrow table of pieces is kept."""
    found = pieces(docs, path, pattern, special, end_id, capacity)
    narrow = written(found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(narrow, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
