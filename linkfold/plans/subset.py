"""Whole-dataset subsets, isolated or with downstream routing."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from linkfold.functions import text
from linkfold.operators import graph, subset
from linkfold.session import attached, durable, scratch_path
from linkfold.sources.store import not_copied

#: Files both kinds of subset rewrite whenever they exist.
SHARED = ("ls_unit.ele", "ls_unit.def", "rout_unit.ele", "rout_unit.def", "object.cnt", "file.cio")
ISOLATED = (*SHARED, "hru.con", "hru-data.hru", "rout_unit.rtu", "print.prt")
ROUTED = (*SHARED, *(f for files in graph.OBJECT_FILES.values() for f in files if f))


def staged(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """Lines of the named files, stored once by file name in the shared folder.

    Each step of a subset works on one or two files; stored this way it opens only those instead of
    reading the whole corpus again.
    """
    spark = lines.sparkSession
    path = scratch_path(spark, "subset")
    wanted = lines.filter(F.lower("file_name").isin(sorted({n.lower() for n in names})))
    wanted.select("dataset_id", "file_name", "line_no", "raw").write.partitionBy("file_name").parquet(path)
    stored = spark.read.schema("dataset_id string, line_no bigint, raw string, file_name string").parquet(path)
    return stored.select("dataset_id", "file_name", "line_no", "raw")


def _copied(lines: DataFrame) -> DataFrame:
    return lines.filter(~not_copied(F.col("file_name"))).select("dataset_id", "file_name", "line_no", "raw")


def _union(pieces: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, pieces)


def isolated(lines: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected units only: ``(lines of the new datasets, id maps dataset_id, typ, id, new_id)``."""
    rest = _copied(lines).filter(~F.lower("file_name").isin(list(ISOLATED)))
    lines = staged(lines, ISOLATED)
    connect, ids, properties = subset.isolated_connect(lines, selected)
    ids, properties = durable(ids), durable(properties)
    wanted = properties.unionByName(
        ids.join(attached(properties.select("dataset_id").distinct()), "dataset_id", "left_anti").select("dataset_id", "id", "new_id")
    )
    unit_map = ids.withColumn("typ", F.lit("hru"))
    land_elements, land_map = subset.element_table(lines, "ls_unit.ele", unit_map, number_by_object=True)
    land_defs, _ = subset.definition_table(lines, "ls_unit.def", land_map, total_at=3, heads=3, count_line=True)
    unit_elements, element_map = subset.element_table(lines, "rout_unit.ele", unit_map, number_by_object=False)
    unit_defs, unit_ids = subset.definition_table(lines, "rout_unit.def", element_map, total_at=2)
    counts = subset.object_counts(unit_map.select("dataset_id", "typ", "id"))
    pieces = [
        connect,
        subset.data_table(lines, "hru-data.hru", wanted),
        land_elements,
        land_defs,
        unit_elements,
        unit_defs,
        subset.unit_table(lines, "rout_unit.rtu", unit_ids),
        subset.update_counts(lines, counts),
        subset.nullify_list(lines, subset.ISOLATED_NULL),
        subset.disable_print(lines),
        rest,
    ]
    return _union(pieces), unit_map.select("dataset_id", "typ", "id", "new_id")


def kept_objects(lines: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected units, the routing units that hold them, and everything downstream of either."""
    tokens = text.tokens(F.col("raw"))
    cells = lines.filter((F.col("file_name") == "rout_unit.ele") & (F.col("line_no") > 2)).withColumn("_t", tokens)
    elements = cells.select(
        "dataset_id",
        text.integer(F.get("_t", F.lit(0))).alias("elem_id"),
        F.get("_t", F.lit(2)).alias("obj_typ"),
        text.integer(F.get("_t", F.lit(3))).alias("obj_id"),
    )
    definitions = subset.definition_members(lines, "rout_unit.def", 2, 2).select(
        "dataset_id", F.col("id").alias("unit_id"), "spans"
    )
    units = graph.routing_units_of(elements, definitions, selected)
    seeds = selected.select("dataset_id", F.lit("hru").alias("typ"), "id").unionByName(
        units.select("dataset_id", F.lit("ru").alias("typ"), F.col("unit_id").alias("id"))
    )
    return graph.downstream_closure(graph.routing_edges(graph.connect_rows(lines)), seeds)


def routed(lines: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected units with all they drain to: ``(lines of the new datasets, id maps)``."""
    copied = _copied(lines)
    lines = staged(lines, ROUTED)
    maps = durable(graph.id_maps(kept_objects(lines, selected)))
    types = attached(maps.select("dataset_id", "typ").distinct())
    connect, properties = subset.routed_connect(lines, maps)
    properties = durable(properties)
    pieces = [connect]
    for typ, (_, data_file) in graph.OBJECT_FILES.items():
        if not data_file:
            continue
        own = maps.filter(F.col("typ") == typ)
        by_property = properties.filter(F.col("typ") == typ)
        # Data rows follow the property ids of the connect file; without any, the object ids.
        wanted = by_property.unionByName(
            own.join(attached(by_property.select("dataset_id").distinct()), "dataset_id", "left_anti")
        ).select("dataset_id", "id", "new_id")
        kept = lines.join(types.filter(F.col("typ") == typ).select("dataset_id"), "dataset_id", "left_semi")
        pieces.append(subset.data_table(kept, data_file, wanted, strict=False, by_rank=True))
    unit_elements, element_map = subset.element_table(
        lines, "rout_unit.ele", maps, number_by_object=False, sort_by_object=False, gap="  "
    )
    unit_defs, _ = subset.definition_table(
        lines, "rout_unit.def", element_map, total_at=2, kept=maps.filter("typ = 'ru'"), gap="  "
    )
    land_elements, land_map = subset.element_table(
        lines, "ls_unit.ele", maps.filter("typ = 'hru'"), number_by_object=True
    )
    land_defs, _ = subset.definition_table(lines, "ls_unit.def", land_map, total_at=3, heads=3, count_line=True)
    pieces += [
        unit_elements,
        unit_defs,
        land_elements,
        land_defs,
        subset.update_counts(lines, subset.object_counts(maps)),
        subset.nullify_unkept(lines, maps),
        _untouched(copied, types),
    ]
    return _union(pieces), maps


def _untouched(copied: DataFrame, types: DataFrame) -> DataFrame:
    """Copied files nothing rewrites: files of object types a dataset does not keep stay as they are."""
    owner = {f: typ for typ, files in graph.OBJECT_FILES.items() for f in files if f}
    others = copied.filter(~F.lower("file_name").isin(list(SHARED))).withColumn(
        "typ", text.lookup(F.lower("file_name"), owner, F.lit(""))
    )
    return others.join(types, ["dataset_id", "typ"], "left_anti").drop("typ")
