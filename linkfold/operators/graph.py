"""Routing graph: edges, downstream closure, renumbering."""

from __future__ import annotations

from collections.abc import Sequence

import functools
import itertools

from pyspark.sql import DataFrame, functions as F

from linkfold.functions import text
from linkfold.functions.ordinals import with_ids_between, with_sorted_ordinal
from linkfold.session import durable

# Object type, its connect file and its data file.
OBJECT_FILES = {
    "hru": ("hru.con", "hru-data.hru"),
    "ru": ("rout_unit.con", "rout_unit.rtu"),
    "sdc": ("chandeg.con", "channel-lte.cha"),
    "cha": ("channel.con", "channel.cha"),
    "aqu": ("aquifer.con", "aquifer.aqu"),
    "res": ("reservoir.con", "reservoir.res"),
    "rec": ("recall.con", "recall.rec"),
    "exc": ("exco.con", None),
    "dr": ("delratio.con", None),
    "out": ("outlet.con", None),
}

#: 0-based place of the target count in a connect line; four cells per target follow it.
TARGET_COUNT = 12

NODE = ["dataset_id", "typ", "id"]

#: Nodes are joined in this order: a sort compares the first key, and ids differ where datasets and types are alike.
NODE_KEY = ["id", "typ", "dataset_id"]


def target_groups(tokens, count_at=None):
    """Targets of a connect line: ``array<struct<nth, obj_typ, obj_id, hyd_typ, frac, frac_text>>``.

    Incomplete groups end the list, groups without an integer id are left out, and a fraction that
    is no number counts as 1.
    """
    at = F.lit(TARGET_COUNT) if count_at is None else count_at
    return text.bind(tokens, lambda cells: _groups(cells, at))


def _groups(cells, at):
    stated = F.coalesce(text.integer(F.get(cells, at)), F.lit(0))
    fitting = F.floor((F.size(cells) - at - 1) / F.lit(4))
    groups = F.greatest(F.least(stated, fitting), F.lit(0)).cast("int")
    nth = F.slice(F.sequence(F.lit(0), groups), F.lit(1), groups)

    def group(i):
        base = at + 1 + i * 4
        return F.struct(
            i.alias("nth"),
            F.get(cells, base).alias("obj_typ"),
            text.integer(F.get(cells, base + 1)).alias("obj_id"),
            F.get(cells, base + 2).alias("hyd_typ"),
            F.coalesce(text.number(F.get(cells, base + 3)), F.lit(1.0)).alias("frac"),
            F.get(cells, base + 3).alias("frac_text"),
        )

    return F.filter(F.transform(nth, group), lambda g: g["obj_id"].isNotNull())


def connect_rows(lines: DataFrame) -> DataFrame:
    """Connect lines of all object types: ``dataset_id, file_name, typ, id, line_no, tokens``.

    An id that occurs twice in a file keeps its last line.
    """
    types = {files[0]: typ for typ, files in OBJECT_FILES.items()}
    parsed = (
        lines.filter(F.col("file_name").isin(list(types)) & (F.col("line_no") > 2))
        .withColumn("id", text.integer(F.regexp_extract("raw", r"^\s*(\S+)", 1)))
        .filter("id is not null")
        .withColumn("typ", text.lookup(F.col("file_name"), types))
    )
    return (
        parsed.groupBy("dataset_id", "file_name", "typ", "id")
        .agg(F.max(F.struct("line_no", "raw")).alias("_l"))
        .select("dataset_id", "file_name", "typ", "id", "_l.line_no", text.tokens(F.col("_l.raw")).alias("tokens"))
    )


def routing_edges(connects: DataFrame) -> DataFrame:
    """``dataset_id, src_typ, src_id, dst_typ, dst_id, hyd_typ, frac``."""
    return connects.select(
        "dataset_id",
        F.col("typ").alias("src_typ"),
        F.col("id").alias("src_id"),
        F.explode(target_groups(F.col("tokens"))).alias("_t"),
    ).select(
        "dataset_id",
        "src_typ",
        "src_id",
        F.col("_t.obj_typ").alias("dst_typ"),
        F.col("_t.obj_id").alias("dst_id"),
        F.col("_t.hyd_typ").alias("hyd_typ"),
        F.col("_t.frac").alias("frac"),
    )


#: Rounds of ``hops`` steps, and single steps, before the graph is contracted: shallow graphs never need that.
PLAIN_ROUNDS = 2
PLAIN_STEPS = 6

#: Links that are few enough to be followed by doubling alone, and the share of links a contraction has to save.
FEW_LINKS = 100_000
LEAST_SAVING = 0.05

#: Types a step looks up by name in the links.
NAMED_TYPES = 100

_WAY = ["_typ", "_id"]
_WAY_KEY = ["_id", "_typ", "dataset_id"]


def downstream_closure(edges: DataFrame, seeds: DataFrame, hops: int = 3, stored: bool = False) -> DataFrame:
    """All nodes reachable from the seeds, seeds included, for all datasets at once.

    The first steps go on from the newest nodes only, over the links of their types. Where more is left, the
    graph is contracted: a node with a single way on gives its links in to the node it leads to, if a coin fell for
    the one and not for the other, so no two neighbours go at once. A long river loses about a quarter of its links a time, and
    all times together cost about as much as four. The few links left are followed ``hops`` at a time and doubled
    (``_followed``); on the way back each contracted node is reached if a link into it comes from a reached node. Steps
    are written to the shared folder; cycles end like other ways. ``stored`` says that the edges are columns of tables:
    they are read from there again, by type, instead of being written.
    """
    links = edges.select(
        "dataset_id",
        F.col("src_typ").alias("typ"),
        F.col("src_id").alias("id"),
        F.col("dst_typ").alias("_typ"),
        F.col("dst_id").alias("_id"),
    ).filter(_no_loop())
    links = links if stored else durable(links)
    visited = frontier = ends = durable(seeds.select(*NODE).distinct())
    for round_ in range(PLAIN_ROUNDS + PLAIN_STEPS):
        if round_ < PLAIN_ROUNDS:
            # Only the links of the nodes that the last step met were not followed yet.
            reached, step = frontier, ends
            for _ in range(hops):
                before, step = reached, durable(_step(step, _of_types(links, step)))
                reached = reached.union(step)
            ends = durable(_without(_without(step, before.distinct()), visited))
        else:
            reached = _step(frontier, _of_types(links, frontier))
        frontier = durable(_without(reached.distinct(), visited))
        if frontier.isEmpty():
            return visited
        visited = visited.union(frontier)
    return _contracted(links, durable(visited), hops)


def _without(nodes: DataFrame, others: DataFrame) -> DataFrame:
    """Nodes that are not among the others; null nodes are never among them."""
    return nodes.join(others, NODE_KEY, "left_anti").select(*NODE)


def _no_loop():
    return ~((F.col("typ") == F.col("_typ")) & (F.col("id") == F.col("_id")))


def _of_types(links: DataFrame, nodes: DataFrame) -> DataFrame:
    types = [r["typ"] for r in nodes.select("typ").distinct().limit(NAMED_TYPES + 1).collect()]
    return links.filter(F.col("typ").isin(types)) if len(types) <= NAMED_TYPES else links


def _contracted(links: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Nodes reachable from the seeds, by contraction of single ways and back."""
    links = durable(links.distinct())
    levels, size = [], links.count()
    while size > FEW_LINKS:
        coin = lambda typ, id_: F.xxhash64("dataset_id", typ, id_, F.lit(len(levels))).bitwiseAND(F.lit(1)) == 1
        gone = _single_ways(links, coin("typ", "id") & ~coin(*_WAY))
        to = gone.select("dataset_id", *[F.col(n).alias(f"_{n}") for n in ("typ", "id")], *[F.col(n).alias(f"{n}2") for n in _WAY])
        moved = durable(links.join(gone, NODE_KEY, "left_anti").join(to, _WAY_KEY, "left"))
        begun = seeds.join(gone, NODE_KEY, "left").withColumn("_gone", F.col("_typ").isNotNull())
        begun = durable(begun)
        levels.append((moved.filter("_typ2 is not null"), begun.filter("_gone").select(*NODE)))
        seeds = durable(begun.select("dataset_id", *[F.coalesce(f"_{n}", n).alias(n) for n in ("typ", "id")]).distinct())
        links = durable(moved.select(*NODE, *[F.coalesce(f"{n}2", n).alias(n) for n in _WAY]).filter(_no_loop()).distinct())
        before, size = size, links.count()
        if size > (1 - LEAST_SAVING) * before:
            break
    visited = _followed(links, seeds, hops)
    for into, begun in reversed(levels):
        met = visited.join(into, NODE_KEY).select("dataset_id", F.col("_typ").alias("typ"), F.col("_id").alias("id"))
        visited = durable(visited.union(met.union(begun).distinct()))
    return visited


def _followed(links: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Nodes reachable from the seeds, ``hops`` steps at a time and by doubled links.

    Nodes with a single way on are joined with themselves, so after k rounds a link leads 2**k nodes down, or to the
    end of the single way, and a stretch of n such nodes is met in about log2(n) rounds instead of n. A node has one
    doubled link of each length at most, so no round makes more links than there are nodes; where ways part, plain
    steps go on. Every link, plain or doubled, of a reached node is followed once.
    """
    visited = frontier = seeds
    ways, jumps, left = [links], None, 0
    for round_ in itertools.count():
        # New nodes take all ways known, old ones the new way.
        reached = step = frontier
        for _ in range(hops):
            step = _step(step, links)
            reached = reached.union(step)
        if jumps is None:
            jumps = _single_ways(links)
            left = jumps.count().bit_length()  # on a cycle every link can be doubled; more than this are of no use
        reached = reached.union(_step(frontier, functools.reduce(DataFrame.union, ways)))
        if left:
            jumps, left = _doubled(jumps), left - 1
            further = jumps.filter("_moved").select(*links.columns)
            if further.isEmpty():
                left = 0
            else:
                ways.append(further)
                reached = reached.union(_step(visited, further))
        frontier = durable(_without(reached.distinct(), visited))
        if frontier.isEmpty():
            return visited
        # The pieces are written tables already; they are merged only now and then to keep plans short.
        visited = visited.union(frontier)
        if round_ % 16 == 15:
            visited = durable(visited)


def _step(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return nodes.join(links, NODE_KEY).select("dataset_id", F.col("_typ").alias("typ"), F.col("_id").alias("id")).distinct()


def _single_ways(links: DataFrame, chosen=None) -> DataFrame:
    """Links of the nodes that have one only, and of those the chosen ones."""
    way = F.struct(*_WAY)
    one = links.groupBy(*NODE).agg(F.count(F.lit(1)).alias("_n"), F.min(way).alias("_to")).filter("_n = 1").select(*NODE, "_to._typ", "_to._id")
    return durable(one if chosen is None else one.filter(chosen))


def _doubled(jumps: DataFrame) -> DataFrame:
    """Links twice as far, or to where the single way ends; ``_moved`` tells which lead further than before."""
    on = jumps.select("dataset_id", F.col("typ").alias("_typ"), F.col("id").alias("_id"), F.col("_typ").alias("_typ2"), F.col("_id").alias("_id2"))
    met = jumps.select(*NODE, "_typ", "_id").join(on, _WAY_KEY, "left")
    return durable(met.select(*NODE, F.coalesce("_typ2", "_typ").alias("_typ"), F.coalesce("_id2", "_id").alias("_id"), F.col("_id2").isNotNull().alias("_moved")))


def id_maps(kept: DataFrame) -> DataFrame:
    """Dense new ids per dataset and type in the order of the old ids: ``..., id, new_id``."""
    return with_sorted_ordinal(kept.select(*NODE).distinct(), ["dataset_id", "typ"], ["id"], "new_id")


#: Up to so many rows a map is left to Spark, which may broadcast it.
FEW_NODES = 100_000


def hashed(maps: DataFrame) -> DataFrame:
    """Id maps written once, to be looked up: each partition of large ones is held as a hash table instead of sorted.

    A node has one row, so no key makes a large partition.
    """
    fixed = durable(maps)
    return fixed.hint("shuffle_hash") if fixed.count() > FEW_NODES else fixed


def renumber_dense(df: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """Rank of each distinct id among the distinct ids of its group, as ``new_id``."""
    ids = with_sorted_ordinal(df.select(*keys, id_column).distinct(), keys, [id_column], "new_id")
    return df.join(ids, [*keys, id_column])


def remap_targets(targets: DataFrame, maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Targets with new ids, those not kept dropped: input ``keys, nth, obj_typ, obj_id, ...``."""
    new = maps.select(
        "dataset_id",
        F.col("typ").alias("obj_typ"),
        F.col("id").alias("obj_id"),
        F.col("new_id").alias("new_obj_id"),
    )
    key = ["dataset_id", "obj_typ", "obj_id"]
    found = targets.join(new, key[::-1])
    return found.select(*key, *[c for c in found.columns if c not in key])


def routing_units_of(elements: DataFrame, definitions: DataFrame, selected: DataFrame, typ: str = "hru") -> DataFrame:
    """Units whose element list holds an element of a selected object.

    ``elements``: ``dataset_id, elem_id, obj_typ, obj_id``; ``definitions``: ``dataset_id, unit_id, spans`` with
    ``spans`` as ``text.signed_spans`` gives them; ``selected``: ``dataset_id, id``. A span is not written out: the
    chosen elements inside are counted from its ends.
    """
    chosen = (
        elements.filter(F.col("obj_typ") == typ)
        .join(selected.select("dataset_id", F.col("id").alias("obj_id")), ["dataset_id", "obj_id"], "left_semi")
        .select("dataset_id", "elem_id")
        .distinct()
    )
    spans = definitions.select("dataset_id", "unit_id", F.inline("spans")).select(
        "dataset_id", "unit_id", F.least("first", "last").alias("low"), F.greatest("first", "last").alias("high")
    )
    placed, _ = with_ids_between(spans, chosen, ["dataset_id"], "elem_id", "low", "high")
    return placed.filter("n_ids > 0").select("dataset_id", "unit_id").distinct()


def retained_counts(kept: DataFrame) -> DataFrame:
    return kept.groupBy("dataset_id", "typ").agg(F.count(F.lit(1)).alias("kept"))
