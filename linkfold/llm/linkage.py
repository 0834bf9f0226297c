"""Groups of linked items: candidates from shared keys, verified links, connected components.

No key is expanded into all its pairs. First every key compares one item, its pivot, with its items of other
components, twice with components merged in between: of a group of copies that leaves few. Then the keys
that still hold several components are settled inside tasks: blocks of about ``BLOCK`` items or ``BYTES`` of text meet
two by two, compare what is in different components, and report a link only if it merges two of them. So every pair of
items that share a key was compared or found in one component, while only links leave a task.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from linkfold.llm.common import discard, row_groups, written

#: Rounds in which each key has one pivot.
STARS = 2
#: Items that meet inside a task, and bytes of their texts: two blocks of so many are the most that one holds.
BLOCK = 1024
BYTES = 32_000_000
#: Rows, and bytes of their texts, of small groups that a task prepares at once.
TOGETHER = 2048, 2_000_000


class Comparison(Protocol):
    def links(self, x: int, others: np.ndarray) -> np.ndarray:
        """Which of the texts ``others`` text x is linked to."""


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the smallest node it is connected to.

    Each round merges every node into the first of its neighbours and itself and keeps the links between
    what is left. First is the smallest in the first round, which ends stars at once, and by a hash that
    changes from round to round later, which takes a share of the nodes of any graph away each time.
    """
    edges = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    label = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    turn = 0
    while edges.limit(1).count():
        order = lambda c: F.struct(F.lit(0).cast("long") if turn == 0 else F.xxhash64(c, F.lit(turn)), F.col(c).alias("node"))  # noqa: E731, B023
        both = edges.union(edges.select("b", "a"))
        into = both.groupBy("a").agg(F.least(F.min(order("b")), F.min(order("a")))["node"].alias("_to")).select(F.col("a").alias("_from"), "_to")
        into = written(into, "into")
        merged = edges.join(into, F.col("a") == F.col("_from")).select(F.col("_to").alias("a"), "b")
        merged = merged.join(into, F.col("b") == F.col("_from")).select("a", F.col("_to").alias("b")).filter("a <> b")
        edges = written(merged.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        label = written(label.join(into, F.col("root") == F.col("_from"), "left").select("node", F.coalesce("_to", "root").alias("root")), "labels")
        turn += 1
    least = label.groupBy("root").agg(F.min("node").alias("component")).withColumnRenamed("root", "_r")
    return written(label.join(least, F.col("root") == F.col("_r")).select("node", "component"), "components")


def linked_components(
    buckets: DataFrame, texts: DataFrame, alike: Callable[[Column, Column], Column], compare: Callable[[pa.Array], Comparison]
) -> DataFrame:
    """(node, component) of every node with a link.

    ``buckets`` is (key, node, info) and ``texts`` (node, text), both stable when read again. ``alike(info, info)``
    is a cheap exact condition that links need; ``compare`` prepares texts, whose ``links(x, others)`` tells which
    of the others x is linked to.
    """
    label = None
    left = buckets
    for turn in range(STARS):
        now = _open_keys(left, label)
        # Hot keys are split by adaptive execution; the pivots' side has one row a key.
        pivots = now.filter(F.col("node") == F.col("pivot")).select(F.col("key").alias("_k"), F.col("node").alias("_p"), F.col("info").alias("_i"), F.col("component").alias("_c"))
        met = now.join(pivots, F.col("key") == F.col("_k")).filter((F.col("component") != F.col("_c")) & alike(F.col("info"), F.col("_i")))
        pairs = written(met.select(F.col("_p").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
        found = written(_confirmed(pairs, texts, compare), "found")
        discard(pairs)
        label = components(found) if label is None else _merged(label, found)
        left = now.filter(F.col("node") != F.col("pivot")).select("key", "node", "info")
    now = _open_keys(left, label)
    found = written(_settled(now, texts, compare), "settled")
    discard(now)
    return _merged(label, found)


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label``, as of ``components``, with more links: those between components, so what is merged already is not looked at again."""
    if not links.limit(1).count():
        return label
    own = label.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    for end in ("a", "b"):
        links = links.join(own, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_c", end)).drop("_n", "_c")
    into = components(links).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    old = label.join(into, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))
    # A node without a component so far comes by its own name.
    new = into.join(label, F.col("_n") == F.col("node"), "left_anti").select(F.col("_n").alias("node"), F.col("_c").alias("component"))
    return written(old.unionByName(new), "merged")


def _open_keys(left: DataFrame, label: DataFrame | None) -> DataFrame:
    """Rows of the keys with several components, with their component, the key's size and a pivot."""
    if label is None:
        labelled = left.withColumn("component", F.col("node"))
    else:
        own = label.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        joined = left.join(own, F.col("node") == F.col("_n"), "left")
        labelled = written(joined.withColumn("component", F.coalesce("_c", "node")).drop("_n", "_c"), "labelled")
    stats = labelled.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.min("node").alias("pivot"))
    several = written(stats.filter("_low <> _high").select(F.col("key").alias("_k"), "pivot"), "open")
    now = written(labelled.join(several, F.col("key") == F.col("_k")).drop("_k"), "now")
    discard(labelled, several)
    return now


def _confirmed(pairs: DataFrame, texts: DataFrame, compare: Callable[[pa.Array], Comparison]) -> DataFrame:
    """The pairs (a, b) that are links."""
    # The many different ends first: what is then dealt out by the pivots has no pivot's text yet.
    left = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    joined = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            sizes = pc.add(pc.binary_length(batch.column("text_a")), pc.binary_length(batch.column("text_b"))).to_numpy(zero_copy_only=False)
            for i, j in row_groups(np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]), 4_000_000):
                part = batch.slice(i, j - i)
                # Rows of one pivot mostly stand together: its text is prepared once.
                a = part.column("text_a")
                new = np.ones(j - i, bool)
                if j - i > 1:
                    new[1:] = pc.not_equal(a.slice(1), a.slice(0, j - i - 1)).to_numpy(zero_copy_only=False)
                begin = np.flatnonzero(new)
                own = compare(pa.concat_arrays([part.column("text_b"), a.take(pa.array(begin))]))
                keep = np.zeros(j - i, bool)
                for k, (first, end) in enumerate(zip(begin.tolist(), [*begin[1:].tolist(), j - i])):
                    keep[first:end] = own.links(j - i + k, np.arange(first, end))
                yield part.filter(pa.array(keep)).select(["a", "b"])

    return joined.mapInArrow(run, joined.select("a", "b").schema)


def _settled(now: DataFrame, texts: DataFrame, compare: Callable[[pa.Array], Comparison]) -> DataFrame:
    """Links between the components of each key, each pair of components of a block pair once."""
    rows = grouped_blocks(now.select("key", "node", F.xxhash64("component").alias("code")), texts)

    def settle(batch: pa.RecordBatch, begins: list[int]) -> pa.RecordBatch:
        codes, mines = batch.column("code").to_numpy(), batch.column("mine").to_numpy()
        alones = batch.column("low").to_numpy() == batch.column("high").to_numpy()
        own, a, b = compare(batch.column("text")), [], []
        for begin, end in zip(begins, [*begins[1:], batch.num_rows]):
            code, mine, alone = codes[begin:end], mines[begin:end], alones[begin]
            _, group, sizes = np.unique(code, return_inverse=True, return_counts=True)
            if len(sizes) < 2:
                continue
            # Items of small components ask first; the largest is only asked.
            rank = np.empty(len(sizes), np.int64)
            rank[np.argsort(sizes, kind="stable")] = np.arange(len(sizes))
            order, done = np.argsort(rank[group], kind="stable"), np.zeros(len(code), bool)
            for x in order[:-1]:
                others = np.flatnonzero(~done & (group != group[x]) & (alone | (mine != mine[x])))
                done[x] = True
                hits = others[own.links(begin + int(x), begin + others)] if len(others) else others
                for y in hits:
                    if group[x] != group[y]:
                        a.append(begin + int(x))
                        b.append(begin + int(y))
                        group[group == group[x]] = group[y]
        node = batch.column("node")
        return pa.RecordBatch.from_arrays([node.take(pa.array(a, pa.int64())), node.take(pa.array(b, pa.int64()))], names=["a", "b"])

    kind = now.schema["node"].dataType
    return rows.mapInArrow(by_groups(settle), StructType([StructField("a", kind), StructField("b", kind)]))


def grouped_blocks(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (key, node, ...) with their texts so that any two of a key stand together in some group of (key, low, high).

    A key is cut into blocks of about ``BLOCK`` rows and ``BYTES`` of text, and a group is two of its blocks (or the only
    one), so no group is large; ``mine`` is a row's block. Groups are sorted inside partitions, for ``by_group``.
    ``texts`` is (node, text).
    """
    sizes = texts.select(F.col("node").alias("_n"), F.octet_length("text").alias("_bytes"))
    weighed = written(rows.join(sizes, F.col("node") == F.col("_n")).drop("_n"), "weighed")
    count = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("_bytes") / BYTES), F.lit(1)).cast("int")
    keys = weighed.groupBy("key").agg(count.alias("_count")).withColumnRenamed("key", "_k")
    cut = weighed.join(keys, F.col("key") == F.col("_k")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("_count")).cast("int"))
    blocks = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    spread = blocks.withColumn("low", F.least("mine", "_other")).withColumn("high", F.greatest("mine", "_other")).drop("_other", "_count", "_k", "_bytes")
    return spread.join(texts, "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")


def by_group(work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """A function for ``mapInArrow`` that gives ``work`` each group of (key, low, high) of sorted rows as one batch."""

    def each(batch: pa.RecordBatch, begins: list[int]) -> pa.RecordBatch:
        parts = [work(batch.slice(i, j - i)) for i, j in zip(begins, [*begins[1:], batch.num_rows])]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if any(p.num_rows for p in parts) else parts[0]

    return by_groups(each)


def by_groups(work: Callable[[pa.RecordBatch, list[int]], pa.RecordBatch]) -> Callable:
    """The same with several whole groups at a time, as far as ``TOGETHER`` goes, and where each begins.

    Texts have long offsets there, so however many bytes a group has, it is one batch.
    """

    def run(batches):
        held, out, rows = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = _one_batch([_long(batch)] if held is None or not held.num_rows else [held, _long(batch)])
            keys = [whole.column(c).to_numpy() for c in ("key", "low", "high")]
            begins = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1])
            for part, own in _together(whole, begins):
                out.append(work(part, own))
                rows += out[-1].num_rows
                if len(out) > 500 or rows > 10_000:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, rows = [], 0
            held = whole.slice(int(begins[-1]))
        if held is not None and held.num_rows:
            out.append(work(held, [0]))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def _together(whole: pa.RecordBatch, begins: np.ndarray):
    """The groups but the last one, some at a time, and where each begins."""
    if "text" in whole.schema.names:
        weight = pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + TOGETHER[1] // TOGETHER[0]
    else:
        weight = np.full(whole.num_rows, TOGETHER[1] // TOGETHER[0])
    for i, j in row_groups(np.concatenate([[0], np.cumsum(weight)])[begins], TOGETHER[1]):
        yield whole.slice(int(begins[i]), int(begins[j] - begins[i])), (begins[i:j] - begins[i]).tolist()


def _long(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with long offsets in its texts."""
    return pa.RecordBatch.from_arrays([c.cast(pa.large_string()) if pa.types.is_string(c.type) else c for c in batch.columns], names=batch.schema.names)


def _one_batch(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays([p.column(k) for p in parts]) for k in range(parts[0].num_columns)], names=parts[0].schema.names)
