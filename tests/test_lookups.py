"""Ids are looked up once and where they are, and what was followed, parsed or joined is not done again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linkfold.operators import graph, refs
from linkfold.plans import text_queries
from linkfold.sources import store

EDGE = "dataset_id string, src_typ string, src_id long, dst_typ string, dst_id long"
NODE = "dataset_id string, typ string, id long"


@pytest.fixture
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def _counted(rows) -> dict:
    out = {}
    for r in rows:
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


def test_links_of_a_node_are_followed_once_in_the_first_rounds(spark, monkeypatch):
    # Two ways of different lengths meet, a cycle leads back, and null nodes are met twice.
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (1, 3), (4, 1), (2, None), (5, None)]
    edges = spark.createDataFrame([("d", "a", s, "a", t) for s, t in pairs], EDGE)
    seeds = spark.createDataFrame([("d", "a", 1), ("d", "a", None)], NODE)
    followed, step = [], graph._step
    monkeypatch.setattr(graph, "_step", lambda nodes, links: followed.append([tuple(r) for r in nodes.collect()]) or step(nodes, links))
    got = graph.downstream_closure(edges, seeds, hops=3, stored=True).collect()
    assert {r["id"] for r in got} == {1, 2, 3, 4, 5, 6, None}
    assert max(_counted(r for r in got if r["id"] is not None).values()) == 1
    # The second round starts where the first one ended, three steps down.
    assert {n[2] for n in followed[3] if n[2] is not None} == {5}


@pytest.mark.parametrize("stored", [False, True])
def test_stored_edges_are_not_written_again(spark, monkeypatch, stored):
    written, durable = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: written.append(df.columns) or durable(df))
    edges = spark.createDataFrame([("d", "a", i, "a", i + 1) for i in range(5)], EDGE)
    got = graph.downstream_closure(edges, spark.createDataFrame([("d", "a", 2)], NODE), stored=stored)
    assert sorted(r["id"] for r in got.collect()) == [2, 3, 4, 5]
    assert any("_typ" in columns for columns in written) == (not stored)


def test_ids_lead_where_nodes_are_sorted(spark, no_broadcasts):
    nodes = spark.range(50).select(F.lit("d").alias("dataset_id"), F.lit("a").alias("typ"), "id")
    links = nodes.select("*", F.lit("a").alias("_typ"), (F.col("id") + 1).alias("_id"))
    assert "SortMergeJoin [id#" in _plan(graph._step(nodes, links))
    maps = nodes.withColumn("new_id", F.col("id") + 1)
    targets = nodes.select("dataset_id", F.lit("f").alias("file_name"), F.lit("a").alias("obj_typ"), F.col("id").alias("obj_id"))
    found = graph.remap_targets(targets, maps, ["file_name"])
    assert "SortMergeJoin [obj_id#" in _plan(found)
    assert found.columns == ["dataset_id", "obj_typ", "obj_id", "file_name", "new_obj_id"] and found.count() == 50


def test_large_id_maps_are_looked_up_in_hash_tables(spark, monkeypatch, no_broadcasts):
    kept = spark.createDataFrame([("d", "a", 7), ("d", "a", 3), ("d", "b", 3), ("d", "a", 7)], NODE)
    targets = spark.createDataFrame([(0, "d", "a", 7), (1, "d", "b", 3), (2, "d", "b", 9), (3, "d", "a", None)], "n int, dataset_id string, obj_typ string, obj_id long")
    for few, kind in ((100, "SortMergeJoin"), (1, "ShuffledHashJoin")):
        monkeypatch.setattr(graph, "FEW_NODES", few)
        found = graph.remap_targets(targets, graph.hashed(graph.id_maps(kept)), ["n"])
        assert kind in _plan(found)
        assert {(r["n"], r["new_obj_id"]) for r in found.collect()} == {(0, 2), (1, 1)}


def test_key_values_lead_where_references_are_resolved(spark, no_broadcasts):
    found = spark.range(3).select(
        F.lit("d").alias("dataset_id"), F.lit("f").alias("source_file"), F.lit("s").alias("source_table"), F.col("id").alias("source_line"), F.lit("c").alias("source_column"),
        F.col("id").cast("string").alias("fk_value"), F.col("id").cast("string").alias("fk_lc"), F.lit("t").alias("target_table"), F.lit("name").alias("target_column"),
    )
    keys = spark.range(2).select(F.lit("d").alias("dataset_id"), F.lit("t").alias("table_name"), F.col("id").cast("string").alias("pk_lc"), F.lit("t.tbl").alias("file_name"), F.col("id").alias("line_no"))
    joined = refs.resolve_column_refs(found, keys)
    assert "SortMergeJoin [fk_lc#" in _plan(joined)
    assert sorted((r["fk_value"], r["resolved"]) for r in joined.collect()) == [("0", True), ("1", True), ("2", False)]


def test_references_of_a_saved_index_come_from_its_rows(spark, monkeypatch, tmp_path):
    items = spark.range(6).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 3).alias("l_partkey"), F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"),
        F.lit(2.0).alias("l_extendedprice"), F.lit(0.1).alias("l_discount"), F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
    )
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 10), (2, 50)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    read, save = {}, store.save_index
    monkeypatch.setattr(store, "save_index", lambda frames, path: read.update({n: f.inputFiles() for n, f in frames.items()}) or save(frames, path))
    ranged, durable = [], store.durable
    monkeypatch.setattr(store, "durable", lambda df: ranged.append(df.columns) or durable(df))
    got = text_queries.save_load_index(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {("A", "1", True, 2), ("A", "2", False, 2)}
    assert any("/rows/" in f for f in read["refs"])
    assert len(ranged) == 1
