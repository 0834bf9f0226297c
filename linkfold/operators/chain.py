"""Follow ``position -> next position`` links through groups of any size.

Counted records are a chain: where a record ends decides where the next one starts. Each group is
cut into blocks of positions. A block is reduced to its exits (where a walk entering at a position
leaves it); the exits alone form a much shorter chain, which is reduced the same way until one
block is left. Going back down, each block walks only from its true entry. No task ever holds more
than one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from linkfold.session import attached, durable

#: Positions are below 2**40, so a place in a batch is its block's number there and its position in one integer.
POSITION_BITS = 40


def _jumps(place: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each sorted place the index of its target, or its own index where the target is no place."""
    at = np.minimum(np.searchsorted(place, target), max(len(place) - 1, 0))
    return np.where(place[at] == target, at, np.arange(len(place))) if len(place) else at


def _exits(place: np.ndarray, target: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """The next position behind its block that each place leads to, by pointer doubling."""
    jump = _jumps(place, target)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return nxt[jump]
        jump = further


def _marks(place: np.ndarray, target: np.ndarray, entered: np.ndarray) -> np.ndarray:
    """Places met on the way from the entered ones, by pointer doubling: each round looks twice as far."""
    seen, jump = entered.copy(), _jumps(place, target)
    while True:
        seen[jump[seen]] = True
        further = jump[jump]
        if np.array_equal(further, jump):
            return seen
        jump = further


def on_chain(
    nodes: DataFrame,
    keys: Sequence[str],
    starts: DataFrame,
    block: int = 50_000,
    fan: int = 1_000,
    max_position: int | None = None,
) -> DataFrame:
    """``(keys, pos)`` of the nodes met when following ``pos -> nxt`` from each start.

    ``nodes`` has the keys, ``pos`` and ``nxt`` (greater than ``pos``; anything that is no node of
    its group ends the walk). ``starts`` has the keys and ``pos``. Every start must be a node.
    """
    keys = list(keys)
    if max_position is None:
        max_position = nodes.agg(F.max("pos")).first()[0] or 0
    if max_position >= block:
        nodes = durable(nodes.select(*keys, "pos", "nxt"))
    return _level(nodes.select(*keys, "pos", "nxt"), keys, starts.select(*keys, "pos"), block, fan, max_position)


def _level(
    nodes: DataFrame, keys: list[str], starts: DataFrame, width: int, fan: int, max_position: int
) -> DataFrame:
    entries = starts
    if max_position >= width:
        exits = durable(_block_exits(nodes, keys, width))
        # Walks meet, so a block has few exits; written, they are known to be few and the exits are not shuffled for them.
        landings = attached(exits.select(*keys, F.col("nxt").alias("pos")).union(starts).distinct())
        upper = exits.join(landings, [*keys, "pos"], "left_semi")
        entries = _level(upper, keys, starts, width * fan, fan, max_position)
    return _marked(nodes, entries, keys, width)


def _block_exits(nodes: DataFrame, keys: list[str], width: int) -> DataFrame:
    def reduce_blocks(rows: pa.RecordBatch, place: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
        nxt = rows.column("nxt").to_numpy()
        return pa.RecordBatch.from_arrays(
            [*(rows.column(k) for k in keys), rows.column("pos"), pa.array(_exits(place, target, nxt))], names=[*keys, "pos", "nxt"]
        )

    schema = nodes.select(*keys, "pos", "nxt").schema
    return _by_block(nodes.select(*keys, "pos", "nxt"), keys, width).mapInArrow(_whole_blocks(keys, reduce_blocks), schema)


def _marked(nodes: DataFrame, entries: DataFrame, keys: list[str], width: int) -> DataFrame:
    def mark(rows: pa.RecordBatch, place: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
        # An entry is a row of its own beside the node at its place.
        is_entry = rows.column("_entry").to_numpy(zero_copy_only=False)
        node = np.flatnonzero(~is_entry)
        own = place[node]
        at = np.searchsorted(own, place[is_entry])
        entered = np.zeros(len(own), bool)
        inside = at < len(own)
        hit = at[inside][own[at[inside]] == place[is_entry][inside]]
        entered[hit] = True
        met = pa.array(node[_marks(own, target[node], entered)])
        return pa.RecordBatch.from_arrays([rows.column(c).take(met) for c in (*keys, "pos")], names=[*keys, "pos"])

    schema = nodes.select(*keys, "pos").schema
    # Nodes and entries often share an origin; fresh columns keep the two sides apart.
    left = nodes.select(*[F.col(c).alias(c) for c in (*keys, "pos", "nxt")], F.lit(False).alias("_entry"))
    right = entries.select(*[F.col(c).alias(c) for c in (*keys, "pos")], F.col("pos").alias("nxt"), F.lit(True).alias("_entry"))
    return _by_block(left.union(right), keys, width).mapInArrow(_whole_blocks(keys, mark), schema)


def _by_block(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rows of a block in one partition, sorted; a partition holds many blocks."""
    blocked = rows.withColumn("_block", F.floor(F.col("pos") / F.lit(width)))
    return blocked.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "pos")


def _whole_blocks(keys: list[str], work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch]) -> Callable:
    """Gives ``work`` stretches of whole blocks of a sorted partition, with places and targets that tell blocks apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # All rows up to the last change of block inside this batch are whole blocks; the rest waits.
            change = np.flatnonzero(_changes(batch, keys))
            begins_new = bool(held) and _changes(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]).combine_chunks().to_batches()[0], keys)[1]
            cut = int(change[-1]) if len(change) else 0
            if cut or begins_new:
                yield _worked([*held, batch.slice(0, cut)], keys, work)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield _worked(held, keys, work)

    return run


def _changes(rows: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether each row's block differs from the one before; false for the first."""
    out = np.zeros(rows.num_rows, bool)
    for c in (*keys, "_block"):
        column = rows.column(c)
        different = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)), True)
        out[1:] |= different.to_numpy(zero_copy_only=False)
    return out


def _worked(parts: list[pa.RecordBatch], keys: list[str], work: Callable) -> pa.RecordBatch:
    rows = pa.concat_batches([p for p in parts if p.num_rows])
    block = np.cumsum(_changes(rows, keys)).astype(np.int64) << POSITION_BITS
    # A next position that no node can have stays inside its block's numbers and ends the walk.
    last = (1 << POSITION_BITS) - 1
    target = np.clip(pc.fill_null(rows.column("nxt"), last).to_numpy(), 0, last)
    return work(rows, block + rows.column("pos").to_numpy(), block + target)
