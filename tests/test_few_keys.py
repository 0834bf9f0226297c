"""Frames with a row for each file meet the lines where they are, not under their few keys in a few tasks."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from linkfold.operators import subset
from linkfold.session import durable


@pytest.fixture
def small_broadcasts(spark):
    """Lines are over the broadcast threshold, frames of a few rows below it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _merged_by_file(df) -> list[str]:
    """Sort-merge joins whose only keys are those of a file or a dataset."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", plan)
    return [j for j in joins if {c.split("#")[0].strip() for c in j.split(",")} <= {"dataset_id", "file_name", "typ"}]


def _lines(spark, file: str, head: str, raw) -> object:
    body = spark.range(4000).select(F.lit("d").alias("dataset_id"), F.lit(file).alias("file_name"), (F.col("id") + 3).alias("line_no"), raw.alias("raw"))
    top = spark.createDataFrame([("d", file, 1, "title"), ("d", file, 2, head)], "dataset_id string, file_name string, line_no bigint, raw string")
    return durable(top.unionByName(body))


def test_elements_are_not_shuffled_for_their_header(spark, small_broadcasts):
    number = F.col("id").cast("string")
    lines = _lines(spark, "rout_unit.ele", "id name obj_typ obj_id frac", F.concat_ws(" ", number, F.sha2(number, 256), F.lit("hru"), number, F.lit("1.0")))
    maps = spark.range(0, 4000, 2).select(F.lit("d").alias("dataset_id"), F.lit("hru").alias("typ"), "id", (F.col("id") / 2 + 1).cast("long").alias("new_id"))
    places = subset.header_positions(lines, "rout_unit.ele", {"id_at": (("id",), 0)})
    assert not _merged_by_file(lines.join(places, ["dataset_id", "file_name"]))
    written, elements = subset.element_table(lines, "rout_unit.ele", maps, number_by_object=False)
    assert not _merged_by_file(written)
    assert written.count() == 2002 and elements.agg(F.max("new_id")).first()[0] == 2000


def test_isolated_units_are_padded_where_they_are(spark, small_broadcasts):
    number = F.col("id").cast("string")
    cells = [number, F.sha2(number, 256), *[F.lit(x) for x in ("1", "2", "3", "4", "5")], number, F.lit("sta"), F.lit("0")]
    lines = _lines(spark, "hru.con", "id name gis_id area lat lon elev prop wst out_tot", F.concat_ws(" ", *cells))
    selected = spark.range(0, 4000, 4).select(F.lit("d").alias("dataset_id"), "id")
    connect, ids, properties = subset.isolated_connect(lines, selected)
    assert not _merged_by_file(connect)
    assert (connect.count(), ids.count(), properties.count()) == (1002, 1000, 1000)
    assert connect.filter("line_no = 4").first()["raw"].split()[0] == "2"


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_decision_lines_are_not_shuffled_for_their_counts(spark, small_broadcasts):
    from linkfold.plans import text_queries

    lines = text_queries._decision_lines(spark, "/root/testdata/sf0.001")
    assert not _merged_by_file(lines)
    assert lines.filter("line_no = 2").agg(F.sum(F.col("raw").cast("long"))).first()[0] == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_records_follow_their_chain_once(spark, lines):
    from linkfold.plans import renderings, text_queries
    from linkfold.sources import tables

    text = lines({("a", "plant.ini"): "title\nname plnt_cnt rot_yr_ini\np1 2 1\nx 1\ny 2\np2 1 1\nz 1\np3 0 1"})
    catalog = text_queries._RECORDS
    headers = tables.resolve_header(text, renderings.bound(renderings.files_of(text), catalog), catalog)
    mains = tables.main_lines(tables.table_lines(text, headers), headers, catalog)
    assert "MapInArrow" not in _plan(mains)
    assert sorted(r["line_no"] for r in mains.collect()) == [3, 6, 8]


def test_text_of_line_items_is_rendered_once(spark, monkeypatch):
    from linkfold.plans import renderings, text_queries

    calls, render = [], renderings.lineitem_lines
    monkeypatch.setattr(renderings, "lineitem_lines", lambda *a: calls.append(a) or render(*a))
    hits = text_queries.target_at(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and not hits.isEmpty()
