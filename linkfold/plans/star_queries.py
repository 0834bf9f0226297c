"""Registered queries over typed tables: references, reports, exploration, graph.

Each entry pairs a Spark plan with the SQL that says the same thing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkfold.functions import text
from linkfold.functions.classify import category_filter, dir_categories, file_category, input_category
from linkfold.functions.ordinals import explode_spans, with_global_ordinal, with_ordinal
from linkfold.operators import explore, graph, refs, report
from linkfold.operators.explore import Condition
from linkfold.plans.corpus import STAR, line_of, load, star_keys, star_refs, star_rows
from linkfold.session import durable
from linkfold.sources.store import copy_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows that count as present; references to any other row dangle.
ACTIVE = {"customer": "c_acctbal >= 0", "part": "p_size <= 40", "supplier": "s_acctbal > 0"}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


_REFS = """
refs AS (
  SELECT 'nation' source_table, n_nationkey::BIGINT source_line, 'n_regionkey' source_column, n_regionkey::VARCHAR fk_value, 'region' target_table FROM nation
  UNION ALL SELECT 'customer', c_custkey, 'c_nationkey', c_nationkey::VARCHAR, 'nation' FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, 's_nationkey', s_nationkey::VARCHAR, 'nation' FROM supplier
  UNION ALL SELECT 'orders', o_orderkey, 'o_custkey', o_custkey::VARCHAR, 'customer' FROM orders
  UNION ALL SELECT 'lineitem', l_orderkey * 10 + l_linenumber, 'l_orderkey', l_orderkey::VARCHAR, 'orders' FROM lineitem
  UNION ALL SELECT 'lineitem', l_orderkey * 10 + l_linenumber, 'l_partkey', l_partkey::VARCHAR, 'part' FROM lineitem
  UNION ALL SELECT 'lineitem', l_orderkey * 10 + l_linenumber, 'l_suppkey', l_suppkey::VARCHAR, 'supplier' FROM lineitem
  UNION ALL SELECT 'labels', doc_id, 'doc_id', doc_id::VARCHAR, 'documents' FROM labels
),
keys AS (
  SELECT 'region' table_name, r_regionkey::VARCHAR pk_lc, r_regionkey::BIGINT line_no FROM region
  UNION ALL SELECT 'nation', n_nationkey::VARCHAR, n_nationkey FROM nation
  UNION ALL SELECT 'customer', c_custkey::VARCHAR, c_custkey FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_suppkey FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT 'part', p_partkey::VARCHAR, p_partkey FROM part WHERE p_size <= 40
  UNION ALL SELECT 'orders', o_orderkey::VARCHAR, o_orderkey FROM orders
  UNION ALL SELECT 'documents', doc_id::VARCHAR, doc_id FROM documents
),
resolved AS (
  SELECT refs.*, keys.line_no AS target_line, keys.pk_lc IS NOT NULL AS ok
  FROM refs LEFT JOIN keys ON keys.table_name = refs.target_table AND keys.pk_lc = refs.fk_value
)
"""


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return refs.resolve_column_refs(star_refs(spark, sf), star_keys(spark, sf, ACTIVE))


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    by = ["source_table", "source_column", "target_column"]
    return refs.resolved_counts(star_refs(spark, sf), star_keys(spark, sf, ACTIVE), by)


_FLAT = ["source_table", "source_line", "source_column", "fk_value", "target_table"]

# --- references ----------------------------------------------------------------


@query("fk_refs", f"WITH {_REFS} SELECT source_table, source_line, source_column, fk_value, target_table FROM refs")
def fk_refs(spark, sf):
    return star_refs(spark, sf).select(*_FLAT)


@query(
    "fk_resolved",
    f"""WITH {_REFS} SELECT source_table, source_line, source_column, fk_value, target_table, ok AS resolved,
    coalesce(target_line, -1) AS target_line FROM resolved""",
)
def fk_resolved(spark, sf):
    return _resolved(spark, sf).select(*_FLAT, "resolved", F.coalesce("target_line", F.lit(-1)).alias("target_line"))


@query(
    "fk_unresolved",
    f"WITH {_REFS} SELECT source_table, source_line, source_column, fk_value, target_table FROM resolved WHERE NOT ok",
)
def fk_unresolved(spark, sf):
    return refs.unresolved_refs(_resolved(spark, sf)).select(*_FLAT)


@query(
    "fk_generic_rows",
    """SELECT 'customer' AS source_table, c_custkey AS source_line, 'c_nationkey' AS source_column,
      c_nationkey::VARCHAR AS fk_value, 'nation' AS target_table, 'name' AS target_column FROM customer
    UNION ALL SELECT 'orders', o_orderkey, 'o_custkey', o_custkey::VARCHAR, 'customer', 'name' FROM orders""",
)
def fk_generic_rows(spark, sf):
    found = refs.extract_fk_refs(star_rows(spark, sf, ["customer", "orders"]), STAR)
    return found.select(*_FLAT, "target_column")


@query(
    "fk_case_insensitive",
    """WITH k AS (SELECT lower(c_name) pk, max(c_custkey) line_no FROM customer WHERE c_acctbal >= 0 GROUP BY 1)
    SELECT o.o_orderkey AS source_line, upper(c.c_name) AS fk_value, k.pk IS NOT NULL AS resolved,
      coalesce(k.line_no, -1) AS target_line
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN k ON k.pk = lower(c.c_name)""",
)
def fk_case_insensitive(spark, sf):
    customers = load(spark, sf, "customer")
    named = load(spark, sf, "orders").join(
        customers.select(F.col("c_custkey").alias("o_custkey"), F.upper("c_name").alias("customer_name")), "o_custkey"
    )
    found = refs.extract_column_refs(
        named, "orders", "orders.tbl", F.col("o_orderkey"), [refs.ForeignKey("customer_name", "customer")]
    )
    keys = refs.last_wins_keys(
        customers.filter(ACTIVE["customer"]).select(
            F.lit("main").alias("dataset_id"),
            F.lit("customer").alias("table_name"),
            F.lit("customer.tbl").alias("file_name"),
            F.lower("c_name").alias("pk_lc"),
            F.col("c_custkey").alias("line_no"),
        )
    )
    return refs.resolve_column_refs(found, keys).select(
        "source_line", "fk_value", "resolved", F.coalesce("target_line", F.lit(-1)).alias("target_line")
    )


def _brand_rows(spark, sf):
    return load(spark, sf, "part").select(
        F.lit("main").alias("dataset_id"),
        F.lit("part").alias("table_name"),
        F.lit("part.tbl").alias("file_name"),
        F.lower("p_brand").alias("pk_lc"),
        F.col("p_partkey").alias("line_no"),
    )


@query(
    "fk_last_wins",
    "SELECT lower(p_brand) AS pk_lc, max(p_partkey) AS line_no FROM part GROUP BY 1",
)
def fk_last_wins(spark, sf):
    return refs.last_wins_keys(_brand_rows(spark, sf)).select("pk_lc", "line_no")


@query(
    "duplicate_keys",
    """SELECT lower(p_brand) AS pk_lc, count(*) AS row_count, min(p_partkey) AS first_line, max(p_partkey) AS last_line
    FROM part GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf):
    return refs.duplicate_keys(_brand_rows(spark, sf)).drop("dataset_id", "table_name")


@query(
    "dependency_edges",
    f"""WITH {_REFS} SELECT source_table, target_table, count(*) AS total, count_if(ok)::BIGINT AS resolved,
      count_if(NOT ok)::BIGINT AS unresolved, array_to_string(list_sort(list_distinct(list(source_column))), ', ') AS columns
    FROM resolved GROUP BY 1, 2""",
)
def dependency_edges(spark, sf):
    return report.dependency_edges(_counted(spark, sf)).drop("dataset_id")


@query(
    "index_stats",
    f"""WITH {_REFS}, t AS (SELECT count(DISTINCT table_name) AS table_count, count(*) AS row_count FROM keys),
    r AS (SELECT count(*) AS fk_count, count_if(ok)::BIGINT AS resolved_count, count_if(NOT ok)::BIGINT AS unresolved_count FROM resolved)
    SELECT * FROM t, r""",
)
def index_stats(spark, sf):
    keys = star_keys(spark, sf, ACTIVE)
    return report.index_stats(keys, refs.resolve_column_refs(star_refs(spark, sf), keys)).drop("dataset_id")


@query(
    "unresolved_by_target",
    f"""WITH {_REFS}, c AS (SELECT target_table || '.' || CASE target_table WHEN 'customer' THEN 'c_custkey'
      WHEN 'supplier' THEN 's_suppkey' ELSE 'p_partkey' END AS name, count(*) AS unresolved_count
      FROM resolved WHERE NOT ok GROUP BY 1)
    SELECT name, unresolved_count, row_number() OVER (ORDER BY unresolved_count DESC, name)::INTEGER AS rank FROM c
    QUALIFY rank <= 25""",
)
def unresolved_by_target(spark, sf):
    return report.unresolved_by(_counted(spark, sf), "target_table", "target_column").drop("dataset_id")


@query(
    "unresolved_by_source",
    f"""WITH {_REFS}, c AS (SELECT source_table || '.' || source_column AS name, count(*) AS unresolved_count
      FROM resolved WHERE NOT ok GROUP BY 1)
    SELECT name, unresolved_count, row_number() OVER (ORDER BY unresolved_count DESC, name)::INTEGER AS rank FROM c
    QUALIFY rank <= 25""",
)
def unresolved_by_source(spark, sf):
    return report.unresolved_by(_counted(spark, sf), "source_table", "source_column").drop("dataset_id")


@query(
    "refs_by_file",
    f"""WITH {_REFS} SELECT source_table || '.tbl' AS file, count(*) AS refs, count_if(ok)::BIGINT AS resolved,
      count_if(NOT ok)::BIGINT AS unresolved FROM resolved GROUP BY 1""",
)
def refs_by_file(spark, sf):
    return report.refs_by_file(_resolved(spark, sf)).drop("dataset_id")


@query(
    "outbound_counts",
    f"WITH {_REFS} SELECT source_table, source_line, count(*) AS outbound FROM refs GROUP BY 1, 2",
)
def outbound_counts(spark, sf):
    return report.outbound_counts(star_refs(spark, sf)).drop("dataset_id", "source_file")


@query(
    "table_issue_counts",
    f"""WITH {_REFS} SELECT source_table, source_column, target_table, count(*) AS unresolved_values
    FROM resolved WHERE NOT ok GROUP BY 1, 2, 3""",
)
def table_issue_counts(spark, sf):
    return report.table_issue_counts(_resolved(spark, sf)).drop("dataset_id")


@query(
    "required_fk_missing",
    """SELECT 'orders' AS table_name, 'o_custkey' AS "column", 'customer' AS target_table, count(*) AS empty_values
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0 WHERE c_custkey IS NULL
    HAVING count(*) > 0""",
)
def required_fk_missing(spark, sf):
    # Orders whose customer is not active lose their reference, as an outer join would leave it.
    active = load(spark, sf, "customer").filter(ACTIVE["customer"]).select(F.col("c_custkey").alias("o_custkey"))
    rows = star_rows(spark, sf, ["orders"]).withColumn("o_custkey", F.col("values")["o_custkey"].cast("bigint"))
    kept = rows.join(active.withColumn("_ok", F.lit(True)), "o_custkey", "left").withColumn(
        "values",
        F.transform_values(
            "values", lambda k, v: F.when((k == "o_custkey") & F.col("_ok").isNull(), F.lit("")).otherwise(v)
        ),
    )
    return report.required_fk_missing(kept, STAR).drop("dataset_id")


@query(
    "orphan_rows",
    """WITH """ + _REFS[: _REFS.index("resolved AS")].rstrip().rstrip(",").replace("refs AS (", "refs AS MATERIALIZED (").replace("keys AS (", "keys AS MATERIALIZED (")
    + """ SELECT k.table_name, k.pk_lc, k.line_no FROM keys k
    LEFT JOIN (SELECT DISTINCT target_table, fk_value FROM refs) i ON i.target_table = k.table_name AND i.fk_value = k.pk_lc
    LEFT JOIN (SELECT DISTINCT source_table, source_line FROM refs) o ON o.source_table = k.table_name AND o.source_line = k.line_no
    WHERE i.fk_value IS NULL AND o.source_line IS NULL""",
)
def orphan_rows(spark, sf):
    found = refs.orphan_rows(star_keys(spark, sf, ACTIVE), star_refs(spark, sf))
    return found.select("table_name", "pk_lc", "line_no").orderBy("table_name", "line_no")


@query(
    "missing_target_tables",
    f"""WITH {_REFS} SELECT source_table, source_line, source_column, fk_value, target_table,
      target_table || '.tbl' AS target_file FROM refs WHERE target_table IN ('supplier', 'documents')""",
)
def missing_target_tables(spark, sf):
    # A corpus in which the supplier and document tables were never delivered.
    keys = star_keys(spark, sf).filter(~F.col("table_name").isin("supplier", "documents"))
    found = refs.resolve_column_refs(star_refs(spark, sf), keys)
    return refs.missing_target_tables(found, keys, STAR).select(*_FLAT, "target_file")


@query(
    "references_to_rows",
    f"""WITH {_REFS} SELECT source_table, source_line, source_column, fk_value, target_table FROM resolved
    WHERE ok AND target_table = 'part' AND fk_value IN (SELECT p_partkey::VARCHAR FROM part WHERE p_type = 'ECONOMY')""",
)
def references_to_rows(spark, sf):
    wanted = load(spark, sf, "part").filter("p_type = 'ECONOMY'").select(
        F.lit("main").alias("dataset_id"), F.lit("part").alias("table_name"), F.col("p_partkey").cast("string").alias("pk_lc")
    )
    return refs.references_to_rows(_resolved(spark, sf), wanted).select(*_FLAT)


@query(
    "references_to_row",
    f"""WITH {_REFS} SELECT source_table, source_line, source_column, fk_value, target_table FROM resolved
    WHERE ok AND target_table = 'nation' AND fk_value = '7'""",
)
def references_to_row(spark, sf):
    return refs.references_to_row(_resolved(spark, sf), "nation", "7").select(*_FLAT)


@query(
    "peek_row",
    """SELECT o_orderkey AS source_line, o_custkey::VARCHAR AS fk_value, c_custkey AS target_line, c_name, c_mktsegment
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0""",
)
def peek_row(spark, sf):
    rows = star_rows(spark, sf, ["customer"], ACTIVE)
    found = refs.resolve_refs(refs.extract_fk_refs(star_rows(spark, sf, ["orders"]), STAR), rows)
    return refs.peek_row(found, rows).select(
        "source_line",
        "fk_value",
        "target_line",
        F.col("target_values")["c_name"].alias("c_name"),
        F.col("target_values")["c_mktsegment"].alias("c_mktsegment"),
    )


@query(
    "related_rows",
    "SELECT c_custkey AS line_no, c_name FROM customer WHERE c_nationkey = 7",
)
def related_rows(spark, sf):
    rows = refs.related_rows(star_rows(spark, sf, ["customer"]), "customer", "c_nationkey", "7")
    return rows.select("line_no", F.col("values")["c_name"].alias("c_name"))


@query(
    "describe_refs",
    f"""WITH {_REFS} SELECT source_table, source_line, source_column,
      '''' || fk_value || ''' not found in ' || target_table || '.tbl' AS message FROM resolved WHERE NOT ok""",
)
def describe_refs(spark, sf):
    keys = star_keys(spark, sf, ACTIVE)
    found = refs.resolve_column_refs(star_refs(spark, sf), keys)
    return refs.describe_refs(found, keys, STAR).select("source_table", "source_line", "source_column", "message")


@query(
    "check_summary",
    f"""WITH {_REFS}, c AS (SELECT target_table || ':' || fk_value AS f, count(*) AS n FROM resolved
      WHERE NOT ok GROUP BY 1),
    t AS (SELECT sum(n)::BIGINT AS total, count(*) AS distinct_files FROM c),
    h AS (SELECT string_agg('"' || f || '" (' || n || ' ref' || CASE WHEN n = 1 THEN '' ELSE 's' END || ')', ', '
      ORDER BY n DESC, f) AS heads FROM (SELECT * FROM c ORDER BY n DESC, f LIMIT 5))
    SELECT total, distinct_files, heads || CASE WHEN distinct_files > 5 THEN ' +' || (distinct_files - 5) || ' more'
      ELSE '' END AS summary FROM t, h""",
)
def check_summary(spark, sf):
    missing = refs.unresolved_refs(_resolved(spark, sf)).withColumn(
        "file", F.concat_ws(":", "target_table", "fk_value")
    )
    return report.missing_file_summary(missing, "file", k=5).drop("dataset_id")


@query(
    "missing_file_counts",
    f"WITH {_REFS} SELECT target_table || ':' || fk_value AS file, count(*) AS refs FROM resolved WHERE NOT ok GROUP BY 1",
)
def missing_file_counts(spark, sf):
    missing = refs.unresolved_refs(_resolved(spark, sf)).withColumn("file", F.concat_ws(":", "target_table", "fk_value"))
    return report.missing_file_counts(missing, "file").drop("dataset_id")


# --- exploration -------------------------------------------------------------


@query(
    "filter_text",
    "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(p_partkey || p_name || p_brand || p_type), 'd#1')"
    " OR contains(lower(p_partkey || p_name || p_brand || p_type), 'd#1')",
)
def filter_text(spark, sf):
    df = load(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return explore.filter_text(df, "D#1")


@query(
    "filter_text_column",
    "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00001')",
)
def filter_text_column(spark, sf):
    return explore.filter_text(load(spark, sf, "customer").select("c_custkey", "c_name"), "00001", "c_name")


@query(
    "filter_numeric",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice >= 99000.5",
)
def filter_numeric(spark, sf):
    df = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return explore.filter_numeric(df, "l_extendedprice", ">=", "99000.5")


@query(
    "filter_numeric_text_cells",
    """SELECT o_orderkey, d FROM (SELECT o_orderkey, split_part(o_orderpriority, '-', 1) || CASE WHEN o_orderstatus = 'F'
      THEN 'd' ELSE '' END AS d FROM orders) WHERE regexp_matches(d, '^[0-9]+$') AND TRY_CAST(d AS DOUBLE) > 3""",
)
def filter_numeric_text_cells(spark, sf):
    cell = F.concat(
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)), F.when(F.col("o_orderstatus") == "F", "d").otherwise("")
    )
    df = load(spark, sf, "orders").select("o_orderkey", cell.alias("d"))
    return explore.filter_numeric(df, "d", ">", "3")


@query(
    "condition_filter_fold",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE
    ((((l_quantity > 45) OR lower(l_returnflag) = 'r') AND NOT contains(lower(l_linestatus), 'f'))
      AND l_extendedprice IN (50000.0, 1200.5) = FALSE) OR l_quantity IN (1, 2)""",
)
def condition_filter_fold(spark, sf):
    conditions = [
        Condition("l_quantity", "gt", "45"),
        Condition("l_returnflag", "equals", "R", join="or"),
        Condition("l_tax", "contains", "  "),
        Condition("l_linestatus", "contains", "F", negate=True),
        Condition("l_extendedprice", "in", "50,000; 1200.5".replace("50,000", "50000"), negate=True),
        Condition("l_quantity", "in", "1; 2", join="or"),
    ]
    kept = explore.condition_filter(load(spark, sf, "lineitem"), conditions)
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query(
    "natural_sort_topk",
    r"""SELECT l AS p_label, p_partkey, row_number() OVER (ORDER BY k, l, p_partkey)::INTEGER AS pos FROM
    (SELECT p_brand || ' ' || p_name AS l, p_partkey,
      array_to_string(list_transform(regexp_extract_all(lower(p_brand || ' ' || p_name), '[0-9]+|[^0-9]+'),
        lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN lpad(length(regexp_replace(t, '^0+([0-9])', '\1'))::VARCHAR, 4, '0')
          || regexp_replace(t, '^0+([0-9])', '\1') ELSE t END), '') AS k FROM part)
    QUALIFY pos <= 200""",
)
def natural_sort_topk(spark, sf):
    df = load(spark, sf, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("p_label"), "p_partkey")
    top = explore.natural_sort(df, "p_label", ties=["p_partkey"]).limit(200)
    return report.top_k(
        top.withColumn("_all", F.lit(1)), ["_all"], explore.natural_order(df, "p_label", ties=["p_partkey"]), 200
    ).select("p_label", "p_partkey", F.col("rank").alias("pos"))


@query(
    "preview",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 2000",
)
def preview(spark, sf):
    return explore.preview(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])


@query(
    "preview_counts",
    """SELECT l_returnflag, count(*) AS total_rows, least(count(*), 2000) AS preview_rows, count(*) > 2000 AS truncated
    FROM lineitem GROUP BY 1""",
)
def preview_counts(spark, sf):
    return explore.preview_counts(load(spark, sf, "lineitem"), ["l_returnflag"])


@query(
    "downsample",
    """WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS nth,
      count(*) OVER (PARTITION BY event_type) AS total FROM events WHERE value IS NOT NULL),
    p AS (SELECT event_type, i AS point, floor(i::DOUBLE / 79.0::DOUBLE * (total - 1)::DOUBLE)::BIGINT AS nth
      FROM (SELECT DISTINCT event_type, total FROM r), range(80) g(i))
    SELECT r.event_type, r.event_id, r.value AS y, p.point::INTEGER AS point FROM r JOIN p USING (event_type, nth)""",
)
def downsample(spark, sf):
    df = load(spark, sf, "events").select("event_type", "event_id", "value")
    return explore.downsample(df, ["event_type"], "event_id", "value").select("event_type", "event_id", "y", "point")


@query(
    "downsample_sorted",
    """WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS nth,
      count(*) OVER () AS total FROM orders),
    p AS (SELECT i AS point, floor(i::DOUBLE / 79.0::DOUBLE * (total - 1)::DOUBLE)::BIGINT AS nth
      FROM (SELECT DISTINCT total FROM r), range(80) g(i))
    SELECT r.o_orderkey, r.o_totalprice, p.point::INTEGER AS point FROM r JOIN p USING (nth)""",
)
def downsample_sorted(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    order = [F.asc("o_totalprice"), F.asc("o_orderkey")]
    return explore.downsample_sorted(df, order).select("o_orderkey", "o_totalprice", "point")


@query(
    "axis_range",
    """SELECT event_type, min(event_id)::DOUBLE AS x_min, max(event_id)::DOUBLE AS x_max, least(min(value), 0.0) AS y_min,
      greatest(max(value), 0.0) AS y_max FROM events GROUP BY 1""",
)
def axis_range(spark, sf):
    x = F.col("event_id").cast("double")
    return explore.axis_range(load(spark, sf, "events"), ["event_type"], x, F.col("value"))


@query(
    "numeric_columns",
    """WITH s AS (SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, split_part(o_orderpriority, '-', 1) || CASE WHEN
      o_orderstatus = 'F' THEN 'x' ELSE '' END AS coded, CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'n/a' END AS gap FROM orders),
    u AS (UNPIVOT s ON o_orderkey, o_orderstatus, coded, gap INTO NAME col VALUE v),
    a AS (SELECT col, count(*) AS cells, count_if(v <> '')::BIGINT AS filled, count_if(regexp_matches(v, '^[0-9]+$'))::BIGINT AS numeric
      FROM u GROUP BY 1)
    SELECT col AS "column", cells, filled, numeric, filled > 0 AND numeric >= 0.6 * filled AS is_numeric FROM a""",
)
def numeric_columns(spark, sf):
    status = F.col("o_orderstatus")
    coded = F.concat(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)), F.when(status == "F", "x").otherwise(""))
    df = load(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        "o_orderstatus",
        coded.alias("coded"),
        F.when(status == "O", "").otherwise("n/a").alias("gap"),
    )
    return explore.numeric_columns(df, df.columns)


@query(
    "describe_numeric",
    " UNION ALL ".join(
        f"""SELECT l_returnflag, '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, min({c}) AS "min", round(quantile_cont({c}, 0.25), 4) AS q25,
        round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS "max"
        FROM lineitem GROUP BY 1"""
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def describe_numeric(spark, sf):
    out = explore.describe_numeric(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"])
    rounded = [F.round(c, 4).alias(c) for c in ("mean", "std", "q25", "q50", "q75")]
    return out.select("l_returnflag", "column", "count", "min", "max", *rounded)


@query(
    "id_range_stats",
    "SELECT o_orderstatus, min(o_orderkey) AS min_id, max(o_orderkey) AS max_id, count(*) AS ids FROM orders GROUP BY 1",
)
def id_range_stats(spark, sf):
    return explore.id_range(load(spark, sf, "orders"), "o_orderkey", ["o_orderstatus"])


@query(
    "missing_ids",
    "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def missing_ids(spark, sf):
    asked = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return explore.missing_ids(asked, load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")))


@query(
    "id_list_filter",
    "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 4, 5, 6, 10, 30, 31)",
)
def id_list_filter(spark, sf):
    return explore.id_list_filter(load(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "1,4-6,10, 30 - 31")


@query(
    "range_expand",
    """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS q FROM lineitem),
    x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, unnest([l_partkey + 1] ||
      CASE WHEN l_suppkey + 1 <= q THEN generate_series(l_suppkey + 1, q) ELSE generate_series(l_suppkey + 1, q, -1) END) AS element FROM e)
    SELECT l_orderkey, l_linenumber, element FROM x""",
)
def range_expand(spark, sf):
    cells = F.array(
        (F.col("l_partkey") + 1).cast("string"),
        (F.col("l_suppkey") + 1).cast("string"),
        F.concat(F.lit("-"), F.col("l_quantity").cast("bigint").cast("string")),
    )
    df = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.signed_spans(cells).alias("_spans"))
    # A few megabytes of line items become thousands of elements each: the files' own splits are too few tasks.
    df = df.repartition(4 * spark.sparkContext.defaultParallelism, "l_orderkey", "l_linenumber")
    return explode_spans(df, F.col("_spans"), "element").drop("_spans")


# --- graph -------------------------------------------------------------------


def _star_edges(spark, sf) -> DataFrame:
    """Foreign keys as typed edges, with regions pointing back to their nations (a cycle)."""

    def edges(table, src_typ, src, dst_typ, dst):
        return load(spark, sf, table).select(
            F.lit("main").alias("dataset_id"),
            F.lit(src_typ).alias("src_typ"),
            F.col(src).cast("bigint").alias("src_id"),
            F.lit(dst_typ).alias("dst_typ"),
            F.col(dst).cast("bigint").alias("dst_id"),
        )

    return (
        edges("orders", "order", "o_orderkey", "cust", "o_custkey")
        .unionByName(edges("lineitem", "order", "l_orderkey", "part", "l_partkey"))
        .unionByName(edges("lineitem", "part", "l_partkey", "supp", "l_suppkey"))
        .unionByName(edges("customer", "cust", "c_custkey", "nation", "c_nationkey"))
        .unionByName(edges("supplier", "supp", "s_suppkey", "nation", "s_nationkey"))
        .unionByName(edges("nation", "nation", "n_nationkey", "region", "n_regionkey"))
        .unionByName(edges("nation", "region", "n_regionkey", "nation", "n_nationkey"))
    )


_EDGES = """edges AS (
  SELECT 'order' st, o_orderkey::BIGINT sid, 'cust' dt, o_custkey::BIGINT did FROM orders
  UNION ALL SELECT 'order', l_orderkey, 'part', l_partkey FROM lineitem
  UNION ALL SELECT 'part', l_partkey, 'supp', l_suppkey FROM lineitem
  UNION ALL SELECT 'cust', c_custkey, 'nation', c_nationkey FROM customer
  UNION ALL SELECT 'supp', s_suppkey, 'nation', s_nationkey FROM supplier
  UNION ALL SELECT 'nation', n_nationkey, 'region', n_regionkey FROM nation
  UNION ALL SELECT 'region', n_regionkey, 'nation', n_nationkey FROM nation),
closure AS (
  SELECT 'order' AS typ, o_orderkey::BIGINT AS id FROM orders WHERE o_totalprice > 400000
  UNION SELECT e.dt, e.did FROM closure c JOIN edges e ON e.st = c.typ AND e.sid = c.id)"""


def _closure(spark, sf) -> DataFrame:
    seeds = load(spark, sf, "orders").filter("o_totalprice > 400000").select(
        F.lit("main").alias("dataset_id"), F.lit("order").alias("typ"), F.col("o_orderkey").alias("id")
    )
    return graph.downstream_closure(_star_edges(spark, sf), seeds, stored=True)


@query("downstream_closure", f"WITH RECURSIVE {_EDGES} SELECT typ, id FROM closure")
def downstream_closure(spark, sf):
    return _closure(spark, sf).select("typ", "id")


@query(
    "chain_closure",
    """SELECT 'rch' AS typ, k AS id FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k >= 100
    UNION ALL SELECT 'out', 1""",
)
def chain_closure(spark, sf):
    """All line items as one river, its upper part parted at every 10000th reach, followed from the 100th reach on."""
    items = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    reaches = durable(with_global_ordinal(items, [F.col("l_orderkey"), F.col("l_linenumber")], "k").select((F.col("k") + 1).alias("k")))
    last = reaches.agg(F.max("k").alias("last"))

    def links(rows, typ, to):
        return rows.select(F.lit("main").alias("dataset_id"), F.lit("rch").alias("src_typ"), F.col("k").alias("src_id"), F.lit(typ).alias("dst_typ"), to.cast("long").alias("dst_id"))

    down = links(reaches.join(last, F.col("k") < F.col("last")), "rch", F.col("k") + 1)
    side = links(reaches.join(last, F.col("k") + 500 < F.col("last")).filter("k % 10000 = 0 AND k <= 30000"), "rch", F.col("k") + 500)
    out = links(last.select(F.col("last").alias("k")), "out", F.lit(1))
    seeds = last.select(F.lit("main").alias("dataset_id"), F.lit("rch").alias("typ"), F.lit(100).cast("long").alias("id"))
    return graph.downstream_closure(down.union(side).union(out), seeds).select("typ", "id")


@query(
    "id_maps",
    f"""WITH RECURSIVE {_EDGES} SELECT typ, id, row_number() OVER (PARTITION BY typ ORDER BY id) AS new_id
    FROM closure""",
)
def id_maps(spark, sf):
    return graph.id_maps(_closure(spark, sf)).select("typ", "id", "new_id")


@query(
    "remap_targets",
    f"""WITH RECURSIVE {_EDGES}, maps AS (SELECT typ, id, row_number() OVER (PARTITION BY typ ORDER BY id) AS new_id FROM closure)
    SELECT s.typ AS src_typ, s.new_id AS src_new, d.typ AS dst_typ, d.new_id AS dst_new
    FROM edges e JOIN maps s ON s.typ = e.st AND s.id = e.sid JOIN maps d ON d.typ = e.dt AND d.id = e.did""",
)
def remap_targets(spark, sf):
    # The ids of both ends are looked up in hash tables; sorting all references twice costs more than the rest.
    maps = graph.hashed(graph.id_maps(_closure(spark, sf)))
    sources = maps.select(
        "dataset_id", F.col("typ").alias("src_typ"), F.col("id").alias("src_id"), F.col("new_id").alias("src_new")
    )
    kept = _star_edges(spark, sf).join(sources, ["src_id", "src_typ", "dataset_id"])
    targets = kept.select(
        "dataset_id", "src_typ", "src_new", F.col("dst_typ").alias("obj_typ"), F.col("dst_id").alias("obj_id")
    )
    return graph.remap_targets(targets, maps, ["src_typ", "src_new"]).select(
        "src_typ", "src_new", F.col("obj_typ").alias("dst_typ"), F.col("new_obj_id").alias("dst_new")
    )


@query(
    "retained_counts",
    f"WITH RECURSIVE {_EDGES} SELECT typ, count(*) AS kept FROM closure GROUP BY 1",
)
def retained_counts(spark, sf):
    return graph.retained_counts(_closure(spark, sf)).drop("dataset_id")


@query(
    "renumber_dense",
    "SELECT l_returnflag, l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey)::BIGINT AS new_id FROM lineitem",
)
def renumber_dense(spark, sf):
    df = load(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return graph.renumber_dense(df, ["l_returnflag"], "l_orderkey")


@query(
    "renumber_hashed",
    "SELECT l_returnflag, l_orderkey * 2654435761 % 4611686018427387847 * 1000003 % 9007199254740881 AS hashed, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 2654435761 % 4611686018427387847 * 1000003 % 9007199254740881)::BIGINT AS new_id FROM lineitem",
)
def renumber_hashed(spark, sf):
    """Ids spread over 53 bits, no two near each other."""
    # The products of large keys leave 64 bits; as decimals they are exact.
    first = "CAST(l_orderkey AS DECIMAL(19, 0)) * CAST(2654435761 AS DECIMAL(10, 0)) % CAST(4611686018427387847 AS DECIMAL(19, 0))"
    hashed = F.expr(f"CAST({first} * CAST(1000003 AS DECIMAL(7, 0)) % CAST(9007199254740881 AS DECIMAL(16, 0)) AS BIGINT)").alias("hashed")
    return graph.renumber_dense(load(spark, sf, "lineitem").select("l_returnflag", hashed), ["l_returnflag"], "hashed")


@query(
    "renumber_in_file_order",
    "SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS new_id FROM orders",
)
def renumber_in_file_order(spark, sf):
    df = load(spark, sf, "orders").select("o_orderstatus", "o_orderkey")
    return with_ordinal(df, ["o_orderstatus"], "o_orderkey", "new_id")


@query(
    "routing_units_of",
    """SELECT DISTINCT l_orderkey AS unit_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)""",
)
def routing_units_of(spark, sf):
    # Each line of an order lists one element of the unit; a part is the object behind the element.
    parts = load(spark, sf, "part")
    elements = parts.select(
        F.lit("main").alias("dataset_id"),
        F.col("p_partkey").alias("elem_id"),
        F.lit("part").alias("obj_typ"),
        F.col("p_partkey").alias("obj_id"),
    )
    definitions = load(spark, sf, "lineitem").select(
        F.lit("main").alias("dataset_id"), F.col("l_orderkey").alias("unit_id"), text.signed_spans(F.array(F.col("l_partkey").cast("string"))).alias("spans")
    )
    selected = parts.filter("p_size = 7").select(F.lit("main").alias("dataset_id"), F.col("p_partkey").alias("id"))
    return graph.routing_units_of(elements, definitions, selected, "part").select("unit_id")


@query(
    "object_counts",
    """SELECT count_if(o_orderstatus = 'F')::BIGINT AS chandeg, count_if(o_orderstatus = 'O')::BIGINT AS outlet,
      count_if(o_orderstatus = 'P')::BIGINT AS recall, count(*) AS total FROM orders""",
)
def object_counts(spark, sf):
    from linkfold.operators.subset import object_counts as counts

    typ = F.when(F.col("o_orderstatus") == "F", "sdc").when(F.col("o_orderstatus") == "O", "out").otherwise("rec")
    kept = load(spark, sf, "orders").select(F.lit("main").alias("dataset_id"), typ.alias("typ"), F.col("o_orderkey").alias("id"))
    named = [F.try_element_at("counts", F.lit(k)).alias(k) for k in ("chandeg", "outlet", "recall")]
    return counts(kept).select(*named, "total")


# --- classification ------------------------------------------------------------


@query(
    "categorize_files",
    """WITH f AS (SELECT source, doc_id, lang || '_' || doc_id || CASE lang WHEN 'en' THEN '.con' WHEN 'de' THEN '.hyd'
      WHEN 'fr' THEN '.plt' ELSE '.csv' END AS file_name FROM documents)
    SELECT doc_id, file_name, CASE WHEN suffix(file_name, '.con') THEN 'connectivity' WHEN suffix(file_name, '.plt')
      THEN 'databases' ELSE 'other' END AS category FROM f""",
)
def categorize_files(spark, sf):
    return _document_files(spark, sf).select("doc_id", "file_name", input_category(F.col("file_name")).alias("category"))


def _document_files(spark, sf):
    ending = text.lookup(F.col("lang"), {"en": ".con", "de": ".hyd", "fr": ".plt"}, F.lit(".csv"))
    return load(spark, sf, "documents").select(
        "doc_id", "source", F.concat("lang", F.lit("_"), F.col("doc_id").cast("string"), ending).alias("file_name")
    )


@query(
    "dir_categories",
    """SELECT source AS dir, array_to_string(list_sort(list_distinct(list(CASE lang WHEN 'en' THEN 'connectivity'
      WHEN 'fr' THEN 'databases' ELSE 'other' END))), ',') AS categories FROM documents GROUP BY 1""",
)
def dir_categories_query(spark, sf):
    files = _document_files(spark, sf).select(
        F.lit("main").alias("dataset_id"), F.col("source").alias("dir"), input_category(F.col("file_name")).alias("category")
    )
    return dir_categories(files).select("dir", F.array_join("categories", ",").alias("categories"))


@query(
    "name_variants",
    """SELECT doc_id, unnest(list_distinct([n, replace(n, '-', '_'), replace(n, '_', '-')])) AS variant
    FROM (SELECT doc_id, lower(lang || '_' || source || '-' || doc_id) AS n FROM documents)""",
)
def name_variants(spark, sf):
    name = F.concat("lang", F.lit("_"), "source", F.lit("-"), F.col("doc_id").cast("string"))
    return load(spark, sf, "documents").select("doc_id", F.explode(text.name_variants(name)).alias("variant"))


# --- names and paths ---------------------------------------------------------------------


_PATHS_SQL = r"""p AS (SELECT doc_id, lang, source, CASE WHEN lang = 'en' THEN 'C:\' || source || '\' || doc_id || '.Txt'
  WHEN lang = 'de' THEN '/mnt/d/' || source || '/' || doc_id || '.txt' ELSE '/data/' || source || '/' || doc_id END AS path FROM documents)"""


@query(
    "path_forms",
    rf"""WITH {_PATHS_SQL} SELECT doc_id,
      CASE WHEN lang = 'en' THEN '/mnt/c/' || source || '/' || doc_id || '.Txt' ELSE path END AS mounted,
      CASE WHEN lang = 'de' THEN 'D:\' || source || '\' || doc_id || '.txt' ELSE path END AS on_drive,
      CASE WHEN lang = 'en' THEN 'c:/' || source || '/' || doc_id || '.txt' ELSE path END AS comparable,
      replace(path, '\', '/')[:-(length(regexp_extract(replace(path, '\', '/'), '/[^/]*$')) + 1)] AS folder,
      CASE WHEN lang IN ('en', 'de') THEN '.txt' ELSE '' END AS suffix, doc_id::VARCHAR AS stem,
      lang = 'en' AND source = 'src1' AS below
    FROM p""",
)
def path_forms(spark, sf):
    """Paths of drives, of mounts and plain ones, in their other forms and parts."""
    name = F.col("doc_id").cast("string")
    path = (
        F.when(F.col("lang") == "en", F.concat(F.lit("C:\\"), "source", F.lit("\\"), name, F.lit(".Txt")))
        .when(F.col("lang") == "de", F.concat(F.lit("/mnt/d/"), "source", F.lit("/"), name, F.lit(".txt")))
        .otherwise(F.concat(F.lit("/data/"), "source", F.lit("/"), name))
    )
    p = F.col("path")
    return load(spark, sf, "documents").withColumn("path", path).select(
        "doc_id", text.stored_path(p).alias("mounted"), text.mount_to_drive(p).alias("on_drive"), text.comparable_path(p).alias("comparable"),
        text.dir_name(p).alias("folder"), text.suffix(p).alias("suffix"), text.stem(p).alias("stem"),
        text.path_starts_with(p, F.lit("c:/SRC1/")).alias("below"),
    )


@query(
    "safe_titles",
    r"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'record_' || doc_id ELSE source || '__' || lang || '-ü_' || doc_id END AS title,
      lower(replace(replace(source || '.' || lang || '-X', '.', '_'), '-', '_')) AS table_name FROM documents""",
)
def safe_titles(spark, sf):
    """Titles as file names, and table names of files."""
    number = F.col("doc_id").cast("string")
    title = F.when(F.col("doc_id") % 4 == 0, F.lit(" *?* ")).otherwise(F.concat(F.lit("("), "source", F.lit(": "), "lang", F.lit("-ü/"), number, F.lit("!)")))
    return load(spark, sf, "documents").select(
        "doc_id",
        text.safe_title(title, F.concat(F.lit("record_"), number)).alias("title"),
        text.table_of_file(F.concat("source", F.lit("."), "lang", F.lit("-X"))).alias("table_name"),
    )


#: A name for each outcome of the category rules, and whether a subset takes such a file over.
_NAMED = (
    ("x_wgn.dat", "climate"), ("A.CNT", "simulation"), ("b.pcp", "climate"), ("c.rtu", "spatial"), ("d.sno", "land"), ("topo.hyd", "land"),
    ("e.lum", "landuse"), ("plant.ini", "landuse"), ("f.ops", "operations"), ("structural.str", "operations"), ("h.wet", "waterbodies"),
    ("i.cha", "channels"), ("gwflow.x", "groundwater"), ("k.lin", "connectivity"), ("l.ini", "initialization"), ("m.plt", "databases"),
    ("n.rec", "other"), ("o.csv", "output"), ("p.txt", "output"), ("fort.9", "other"),
)


@query(
    "file_categories",
    f"""WITH n AS (SELECT doc_id, [{", ".join(f"'{c}'" for _, c in _NAMED)}][doc_id % {len(_NAMED)} + 1] AS c, doc_id % {len(_NAMED)} AS k FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'output' WHEN doc_id % 5 = 0 AND k IN (17, 18) THEN 'other' ELSE c END AS category,
      k NOT IN (17, 18, 19) AS copied FROM n""",
)
def file_categories(spark, sf):
    """Categories of output tables, known inputs and other files by name, and which of them a subset takes over."""
    names = F.array(*[F.lit(n) for n, _ in _NAMED])
    files = load(spark, sf, "documents").select("doc_id", F.get(names, (F.col("doc_id") % len(_NAMED)).cast("int")).alias("file_name"))
    copied = copy_filter(files).select("doc_id", F.lit(True).alias("copied"))
    kind = file_category(F.col("file_name"), F.col("doc_id") % 7 == 0, F.col("doc_id") % 5 == 0)
    return files.withColumn("category", kind).join(copied, "doc_id", "left").select("doc_id", "category", F.coalesce("copied", F.lit(False)).alias("copied"))


@query(
    "category_ticks",
    """SELECT doc_id, file_name FROM (SELECT doc_id, lang || '_' || doc_id || CASE lang WHEN 'en' THEN '.con' WHEN 'de' THEN '.hyd' WHEN 'fr' THEN '.plt' ELSE '.csv' END AS file_name, lang
      FROM documents) WHERE lang IN ('en', 'fr')""",
)
def category_ticks(spark, sf):
    files = _document_files(spark, sf).withColumn("category", input_category(F.col("file_name")))
    return category_filter(files, ["connectivity", "databases"]).select("doc_id", "file_name")


@query(
    "nullified_names",
    r"""SELECT doc_id, lang || ' ' || CASE WHEN source IN ('src1', 'src10') THEN 'null' ELSE upper(source) || '.DAT' END || ' my' || source || '.dat' AS line FROM documents""",
)
def nullified_names(spark, sf):
    line = F.concat("lang", F.lit(" "), F.upper("source"), F.lit(".DAT my"), "source", F.lit(".dat"))
    return load(spark, sf, "documents").select("doc_id", text.nullify_names(line, ["src1.dat", "src10.dat"]).alias("line"))


@query(
    "refs_of_lines",
    f"""WITH {_REFS} SELECT source_table, source_line, source_column, fk_value, target_table FROM refs
    WHERE source_table = 'supplier' OR (source_table = 'lineitem' AND source_line = 11)""",
)
def refs_of_lines(spark, sf):
    """References of a whole file and of one line, by paths in another spelling."""
    every = star_refs(spark, sf)
    of_file = refs.refs_from_file(every, STAR.table("supplier").file_name)
    return of_file.unionByName(refs.refs_for_line(every, STAR.table("lineitem").file_name, 11)).select(*_FLAT)


@query("row_by_id", "SELECT p_partkey AS line_no, p_name AS name FROM part WHERE p_partkey = 7")
def row_by_id(spark, sf):
    row = refs.row_by_id(star_rows(spark, sf, ["part", "orders"]), "part", "7")
    return row.select("line_no", F.col("values")["p_name"].alias("name"))
