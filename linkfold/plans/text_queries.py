"""Registered queries over text: tables, records, outputs, checks, file lists and subsets.

The text is rendered from the tables by Spark and read back by the library's own readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from linkfold.catalog import Catalog, Column as Col, Table
from linkfold.functions import text
from linkfold.operators import checks, explore, graph, refs, subset
from linkfold.plans import renderings as r, subset as subset_plan
from linkfold.plans.corpus import load
from linkfold.plans.star_queries import ACTIVE, ORACLES, query
from linkfold.session import attached, durable, scratch_path
from linkfold.sources import decisions, filelist, lines as line_source, outputs, records, store, tables

# --- lines and plain tables -------------------------------------------------------


@query(
    "scan_lines",
    """SELECT lang || ' ' || source || ' ' || doc_id AS raw, TRUE AS in_order FROM documents""",
)
def scan_lines(spark, sf):
    """Text files written to the shared folder and read back: line numbers follow the file order."""
    path = scratch_path(spark, "lines")
    raw = F.concat_ws(" ", "lang", "source", F.col("doc_id").cast("string"))
    docs = load(spark, sf, "documents").select(raw.alias("value"), "doc_id")
    docs.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    lines = line_source.scan_lines(spark, path).withColumn(
        "doc", F.element_at(F.split("raw", " "), -1).cast("bigint")
    )
    # The documents of a file are consecutive, so line and document number differ by a constant.
    shift = lines.groupBy("path").agg(F.min("doc").alias("_first"))
    return lines.join(shift, "path").select("raw", (F.col("doc") - F.col("_first") + 1 == F.col("line_no")).alias("in_order"))


@query(
    "scan_document_text",
    """SELECT raw, count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents) GROUP BY raw""",
)
def scan_document_text(spark, sf):
    """All texts written as text files and read back line by line, each number once in its file."""
    path = scratch_path(spark, "texts")
    load(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("value")).repartition(4).write.text(path)
    lines = durable(line_source.scan_lines(spark, path))
    numbers = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("line_no").alias("d"), F.max("line_no").alias("m"))
    whole = numbers.filter("n = d AND n = m").select("path")
    return lines.join(whole, "path", "left_semi").groupBy("raw").agg(F.count(F.lit(1)).alias("n"))


@query(
    "document_lines",
    r"""SELECT doc_id, i AS line_no, raw, len(list_filter(regexp_split_to_array(raw, '[ \t]+'), lambda t: t <> '')) AS tokens
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i
      FROM documents)""",
)
def document_lines(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("_i", "raw"))
    return docs.select(
        "doc_id", (F.col("_i") + 1).cast("bigint").alias("line_no"), "raw", F.size(text.tokens(F.col("raw"))).cast("bigint").alias("tokens")
    )


_CATALOG = r.text_catalog(r.LINEITEM)


def _lineitem_rows(spark, sf, lines=None):
    lines = r.lineitem_lines(spark, sf) if lines is None else lines
    headers = tables.resolve_header(lines, r.bound(r.files_of(lines), _CATALOG), _CATALOG)
    return tables.parse_tables(lines, headers, _CATALOG)


@query(
    "text_roundtrip_lineitem",
    """SELECT l_returnflag AS dataset_id, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_quantity,
      l_extendedprice, l_discount, l_linestatus FROM lineitem""",
)
def text_roundtrip_lineitem(spark, sf):
    types = {
        "l_orderkey": "bigint",
        "l_linenumber": "bigint",
        "l_partkey": "bigint",
        "l_quantity": "double",
        "l_extendedprice": "double",
        "l_discount": "double",
        "l_linestatus": "string",
    }
    return explore.typed_table(_lineitem_rows(spark, sf), types).drop("file_name", "line_no")


@query(
    "text_row_keys",
    """SELECT l_returnflag AS dataset_id, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, raw) + 3) AS line_no,
      (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, raw) - 1)::VARCHAR AS pk_value
    FROM (SELECT l_returnflag, l_orderkey, '  ' || concat_ws('   ', l_partkey, l_orderkey, l_linenumber, l_quantity,
      l_extendedprice, l_discount, l_linestatus) COLLATE C AS raw FROM lineitem)""",
)
def text_row_keys(spark, sf):
    return _lineitem_rows(spark, sf).select("dataset_id", "line_no", "pk_value")


@query(
    "text_header_layout",
    """SELECT DISTINCT l_returnflag AS dataset_id, 3::BIGINT AS header_line, 4::BIGINT AS data_line, TRUE AS shifted,
      'l_partkey,l_orderkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_linestatus' AS columns FROM lineitem""",
)
def text_header_layout(spark, sf):
    lines = r.lineitem_lines(spark, sf)
    headers = tables.resolve_header(lines, r.bound(r.files_of(lines), _CATALOG), _CATALOG)
    return headers.select("dataset_id", "header_line", "data_line", "shifted", F.array_join("columns", ",").alias("columns"))


@query(
    "text_fk_refs",
    """SELECT l_returnflag AS dataset_id, l_partkey::VARCHAR AS fk_value, 'part' AS target_table, count(*) AS n
    FROM lineitem WHERE l_partkey <> 0 GROUP BY ALL""",
)
def text_fk_refs(spark, sf):
    found = refs.extract_fk_refs(_lineitem_rows(spark, sf), _CATALOG)
    return found.groupBy("dataset_id", "fk_value", "target_table").agg(F.count(F.lit(1)).alias("n"))


@query(
    "target_at",
    """SELECT l_returnflag AS dataset_id, l_partkey::VARCHAR AS fk_value, 2::BIGINT AS col_start,
      2 + length(l_partkey::VARCHAR) AS col_end, count(*) AS n FROM lineitem WHERE l_partkey <> 0 GROUP BY ALL""",
)
def target_at(spark, sf):
    lines = r.lineitem_lines(spark, sf)
    found = attached(refs.extract_fk_refs(_lineitem_rows(spark, sf, lines), _CATALOG))
    asked = found.select("dataset_id", "source_file", "source_line", F.lit(2).alias("char")).distinct()
    hits = refs.target_at(refs.position_refs(found, lines), asked)
    return hits.groupBy(
        "dataset_id", "fk_value", F.col("col_start").cast("bigint").alias("col_start"), F.col("col_end").cast("bigint").alias("col_end")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "token_spans",
    """SELECT p_partkey, 'small' AS word, strpos(p_name, 'small') - 1 AS col_start, strpos(p_name, 'small') + 4 AS col_end
    FROM part WHERE regexp_matches(p_name, '(^| )small( |$)')""",
)
def token_spans(spark, sf):
    spans = load(spark, sf, "part").select("p_partkey", F.inline(text.token_spans(F.col("p_name"))))
    wide = [F.col(c).cast("bigint").alias(c) for c in ("col_start", "col_end")]
    return spans.filter("token = 'small'").select("p_partkey", F.col("token").alias("word"), *wide)


# --- hierarchical records ------------------------------------------------------------

_RECORDS = Catalog(
    tables=(
        Table("soils_sol", "soils.sol", (Col("name"), Col("nly", "IntegerField"), Col("hyd_grp")), ("name",)),
        Table("plant_ini", "plant.ini", (Col("name"), Col("plnt_cnt", "IntegerField"), Col("rot_yr_ini", "IntegerField")), ("name",)),
        Table("management_sch", "management.sch", (Col("name"), Col("numb_ops", "IntegerField"), Col("numb_auto", "IntegerField")), ("name",)),
        Table("weather_wgn_cli", "weather-wgn.cli", (Col("name"), Col("lat", "DoubleField")), ("name",)),
        Table("atmo_cli", "atmo.cli", (Col("num_sta"), Col("timestep"), Col("num_aa")), ()),
    )
)


def _order_name():
    return F.concat(F.lit("Ord"), F.col("o_orderkey").cast("string"))


def _is_operation():
    """0 for line items that stand in the first section of a record, 1 for the others."""
    return F.when(F.col("l_returnflag") == "A", 0).otherwise(1)


def _records(lines):
    headers = tables.resolve_header(lines, r.bound(r.files_of(lines), _RECORDS), _RECORDS)
    return tables.parse_tables(lines, headers, _RECORDS)


def _soil_lines(spark, sf):
    main = r.words(_order_name(), "lines", "o_orderstatus", "o_totalprice", F.lit("0.5"), F.lit("0.1"), F.lit("loam"), F.lit("deep"), F.lit("red"))
    child = r.words("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey")
    return r.order_records(spark, sf, "soils.sol", ["soils", "name nly hyd_grp dp_tot"], main, child, F.lit(0))


@query(
    "soil_profiles",
    """SELECT substr(o_orderpriority, 1, 1) AS dataset_id, 'Ord' || o_orderkey AS pk_value, coalesce(n::VARCHAR, '') AS nly, o_orderstatus AS hyd_grp,
      'loam' AS texture, 'deep red' AS description
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def soil_profiles(spark, sf):
    soils = records.soil_profiles(_records(_soil_lines(spark, sf)))
    v = F.col("values")
    return soils.select("dataset_id", "pk_value", *[v[c].alias(c) for c in ("nly", "hyd_grp", "texture", "description")])


@query(
    "soil_layers",
    """SELECT substr(o_orderpriority, 1, 1) AS dataset_id, l_quantity AS dp, l_extendedprice AS bd, '' AS ph, l_partkey::VARCHAR AS carbon,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY concat_ws(' ', l_quantity, l_extendedprice, l_discount, l_tax, l_partkey))::VARCHAR AS layer
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def soil_layers(spark, sf):
    lines = _soil_lines(spark, sf)
    layers = records.soil_layers(_records(lines), lines)
    v = F.col("values")
    return layers.select(
        "dataset_id",
        v["dp"].cast("double").alias("dp"),
        v["bd"].cast("double").alias("bd"),
        v["ph"].alias("ph"),
        v["carbon"].alias("carbon"),
        v["layer"].alias("layer"),
    )


def _plant_lines(spark, sf):
    main = r.words(_order_name(), "lines", F.lit("1"))
    child = r.words(F.concat(F.lit("pl"), F.col("l_partkey").cast("string")), F.col("l_linenumber"), "l_quantity", "l_tax")
    return r.order_records(spark, sf, "plant.ini", ["plants", "PCOM_NAME plt_cnt rot_yr_ini"], main, child, F.lit(0))


@query(
    "plant_members",
    """SELECT substr(o_orderpriority, 1, 1) AS dataset_id, l_orderkey, 'pl' || l_partkey AS plnt_name, l_linenumber::VARCHAR AS lc_status,
      l_quantity AS lai_init FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def plant_members(spark, sf):
    lines = _plant_lines(spark, sf)
    mains = _records(lines)
    members = records.plant_members(mains, lines)
    names = mains.select("dataset_id", "file_name", F.col("line_no").alias("main_line"), "pk_value")
    v = F.col("values")
    return members.join(names, ["dataset_id", "file_name", "main_line"]).select(
        "dataset_id",
        F.substring("pk_value", 4, 20).cast("bigint").alias("l_orderkey"),
        v["plnt_name"].alias("plnt_name"),
        v["lc_status"].alias("lc_status"),
        v["lai_init"].cast("double").alias("lai_init"),
    )


@query(
    "plant_members_large",
    """SELECT l_returnflag AS dataset_id, 3::BIGINT AS main_line, 'pl' || l_partkey AS plnt_name, l_linenumber::VARCHAR AS lc_status, l_quantity AS lai_init
    FROM lineitem""",
)
def plant_members_large(spark, sf):
    """One record per return flag that holds all its line items: records of any length stay whole."""
    items = load(spark, sf, "lineitem").withColumn("dataset_id", F.col("l_returnflag")).withColumn("file_name", F.lit("plant.ini"))
    child = r.words(F.concat(F.lit("pl"), F.col("l_partkey").cast("string")), F.col("l_linenumber"), "l_quantity", "l_tax")
    body = r.numbered(items.select("dataset_id", "file_name", "l_orderkey", "l_linenumber", child.alias("raw")), "l_orderkey", ["l_linenumber", "raw"], 3)
    counts = items.groupBy("dataset_id", "file_name").agg(F.count(F.lit(1)).alias("n"))
    heads = r.head_lines(counts, F.lit("plants"), F.lit("PCOM_NAME plt_cnt rot_yr_ini"), r.words(F.lit("all"), "n", F.lit("1")))
    lines = durable(heads.unionByName(body.select(*r.LINE)))
    v = F.col("values")
    return records.plant_members(_records(lines), lines).select(
        "dataset_id", "main_line", v["plnt_name"].alias("plnt_name"), v["lc_status"].alias("lc_status"), v["lai_init"].cast("double").alias("lai_init")
    )


def _schedule_lines(spark, sf):
    main = r.words(_order_name(), "op_lines", "auto_lines")
    op = r.words(F.lower("l_linestatus"), "l_linenumber", F.lit("1"), F.lit("0.15"), "l_suppkey", F.lit("x"), F.concat(F.lit("op"), F.col("l_partkey").cast("string")), F.lit("9"))
    auto = r.words(F.concat(F.lit("tbl"), F.col("l_partkey").cast("string")), F.lit("corn"))
    child = F.when(_is_operation() == 0, auto).otherwise(op)
    return r.order_records(spark, sf, "management.sch", ["schedules", "name numb_ops numb_auto"], main, child, _is_operation())


_SCHEDULE = Catalog(tables=_RECORDS.tables, operation_targets={"o": "part_ops", "f": "part_fin"})


@query(
    "management_ops",
    """SELECT substr(o_orderpriority, 1, 1) AS dataset_id, CASE WHEN l_returnflag = 'A' THEN 'auto' ELSE 'op' END AS section,
      CASE WHEN l_returnflag = 'A' THEN 'tbl' || l_partkey ELSE lower(l_linestatus) END AS first_cell, count(*) AS n
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""",
)
def management_ops(spark, sf):
    lines = _schedule_lines(spark, sf)
    v = F.col("values")
    first = F.coalesce(F.try_element_at(v, F.lit("d_table")), F.try_element_at(v, F.lit("op_typ")))
    ops = records.management_ops(_records(lines), lines)
    return ops.groupBy("dataset_id", v["section"].alias("section"), first.alias("first_cell")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "management_refs",
    """SELECT substr(o_orderpriority, 1, 1) AS dataset_id, CASE WHEN l_returnflag = 'A' THEN 'auto_op_dtl'
        ELSE 'op_data1(' || lower(l_linestatus) || ')' END AS source_column,
      CASE WHEN l_returnflag = 'A' THEN 'tbl' ELSE 'op' END || l_partkey AS fk_value,
      CASE WHEN l_returnflag = 'A' THEN 'lum_dtl' WHEN l_linestatus = 'O' THEN 'part_ops' ELSE 'part_fin' END AS target_table,
      count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""",
)
def management_refs(spark, sf):
    lines = _schedule_lines(spark, sf)
    found = refs.management_refs(records.management_ops(_records(lines), lines), _SCHEDULE)
    return found.groupBy("dataset_id", "source_column", "fk_value", "target_table").agg(F.count(F.lit(1)).alias("n"))


@query(
    "generator_months",
    """SELECT 'main' AS dataset_id, 'sta' || c_custkey AS station, m::VARCHAR AS month, round(c_acctbal * m, 2) AS tmp_max_ave
    FROM customer, range(1, 13) g(m)""",
)
def generator_months(spark, sf):
    """Stations with one header and twelve month lines each."""
    name = F.concat(F.lit("sta"), F.col("c_custkey").cast("string"))
    body = load(spark, sf, "customer").select(
        F.lit("main").alias("dataset_id"),
        F.lit("weather-wgn.cli").alias("file_name"),
        "c_custkey",
        F.posexplode(
            F.concat(
                F.array(r.words(name, F.lit("40.5")), F.lit("tmp_max tmp_min")),
                F.transform(
                    F.sequence(F.lit(1), F.lit(12)), lambda m: F.concat_ws(" ", F.round(F.col("c_acctbal") * m, 2).cast("string"), m.cast("string"))
                ),
            )
        ).alias("_i", "raw"),
    )
    lines = r.numbered(body, "c_custkey", ["_i"], 2).select(*r.LINE)
    lines = durable(r.head_lines(r.files_of(lines), "generator", "name lat").unionByName(lines))
    mains = _records(lines)
    months = records.generator_months(mains, lines)
    names = mains.select("dataset_id", F.col("line_no").alias("main_line"), F.col("pk_value").alias("station"))
    v = F.col("values")
    return months.join(names, ["dataset_id", "main_line"]).select(
        "dataset_id", "station", v["month"].alias("month"), v["tmp_max_ave"].cast("double").alias("tmp_max_ave")
    )


@query(
    "deposition_blocks",
    """SELECT n_name AS dataset_id, 'sta ' || s_suppkey AS station_name, s_acctbal::VARCHAR AS nh4_wet, '1,2' AS no3_wet, '3' AS nh4_dry
    FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def deposition_blocks(spark, sf):
    """One deposition file per nation with its suppliers as stations."""
    suppliers = load(spark, sf, "supplier").join(
        load(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dataset_id")), "s_nationkey"
    )
    file = F.lit("atmo.cli").alias("file_name")
    lines_of = F.array(
        F.concat(F.lit("sta "), F.col("s_suppkey").cast("string")),
        r.words("s_acctbal", F.lit("end")),
        F.lit("1 2 end"),
        F.lit("3"),
        F.lit("4 5"),
    )
    body = suppliers.select("dataset_id", file, "s_suppkey", F.posexplode(lines_of).alias("_i", "raw"))
    body = r.numbered(body, "s_suppkey", ["_i"], 3).select(*r.LINE)
    counts = suppliers.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).withColumn("file_name", F.lit("atmo.cli"))
    heads = r.head_lines(counts, F.lit("deposition"), F.lit("num_sta timestep num_aa"), r.words("n", F.lit("mo"), F.lit("3")))
    lines = durable(heads.unionByName(body))
    blocks = records.deposition_blocks(_records(lines), lines)
    series = [F.array_join(c, ",").alias(c) for c in ("nh4_wet", "no3_wet", "nh4_dry")]
    return blocks.select("dataset_id", "station_name", *series)


@query(
    "deposition_large",
    "SELECT row_number() OVER (ORDER BY p_partkey) AS station, 'sta ' || p_partkey AS station_name, p_size::VARCHAR AS nh4_wet, '1,2' AS no3_wet FROM part",
)
def deposition_large(spark, sf):
    """One deposition file with every part as a station."""
    lines_of = F.array(F.concat(F.lit("sta "), F.col("p_partkey").cast("string")), r.words("p_size", F.lit("end")), F.lit("1 2 end"), F.lit("3"), F.lit("4 5"))
    parts = load(spark, sf, "part").withColumn("dataset_id", F.lit("main")).withColumn("file_name", F.lit("atmo.cli"))
    body = r.numbered(parts.select("dataset_id", "file_name", "p_partkey", F.posexplode(lines_of).alias("_i", "raw")), "p_partkey", ["_i"], 3)
    counts = parts.groupBy("dataset_id", "file_name").agg(F.count(F.lit(1)).alias("n"))
    heads = r.head_lines(counts, F.lit("deposition"), F.lit("num_sta timestep num_aa"), r.words("n", F.lit("mo"), F.lit("3")))
    lines = durable(heads.unionByName(body.select(*r.LINE)))
    blocks = records.deposition_blocks(_records(lines), lines)
    return blocks.select("station", "station_name", *[F.array_join(c, ",").alias(c) for c in ("nh4_wet", "no3_wet")])


def _decision_lines(spark, sf):
    conds, acts = F.col("auto_lines"), F.col("op_lines")
    main = r.words(_order_name(), conds, F.lit("2"), acts)
    cond = r.words("l_linestatus", F.lit("hru"), F.lit("0"), F.lit("null"), F.lit("-"), "l_quantity", F.lit("y"), F.lit("n"))
    act = r.words(
        F.when(F.col("l_linestatus") == "F", "harvest").otherwise("other"), F.lit("hru"), F.lit("0"), F.lit("nm"), F.lit("opt"),
        F.lit("1"), "l_tax", F.concat(F.lit("fp"), F.col("l_partkey").cast("string")), F.lit("y"),
    )
    child = F.when(_is_operation() == 0, cond).otherwise(act)
    body = r.order_records(spark, sf, "lum.dtl", ["tables", "{n}", "NAME CONDS ALTS ACTS"], main, child, _is_operation())
    priority = F.substring("o_orderpriority", 1, 1)
    counts = load(spark, sf, "orders").groupBy(priority.alias("dataset_id")).agg(F.count(F.lit(1)).cast("string").alias("_n"))
    # There are a few counts only: attached, they are broadcast, and the lines stay where they are.
    return body.join(attached(counts), "dataset_id").withColumn(
        "raw", F.when(F.col("line_no") == 2, F.col("_n")).otherwise(F.col("raw"))
    ).drop("_n")


def _decisions(spark, sf):
    lines = _decision_lines(spark, sf)
    names = r.files_of(lines).withColumn("table_name", F.lit("lum_dtl"))
    return decisions.decision_tables(lines, names)


@query(
    "decision_tables",
    """SELECT substr(o_orderpriority, 1, 1) AS dataset_id, 'Ord' || o_orderkey AS pk_value, coalesce(c, 0)::VARCHAR AS conds, coalesce(a, 0)::VARCHAR AS acts
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS c, count(*) FILTER (WHERE l_returnflag <> 'A') AS a
      FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def decision_tables(spark, sf):
    rows, _ = _decisions(spark, sf)
    v = F.col("values")
    return rows.select("dataset_id", "pk_value", v["conds"].alias("conds"), v["acts"].alias("acts"))


@query(
    "decision_children",
    """SELECT substr(o_orderpriority, 1, 1) AS dataset_id, CASE WHEN l_returnflag = 'A' THEN 'condition' ELSE 'action' END AS section,
      CASE WHEN l_returnflag = 'A' THEN l_quantity::VARCHAR ELSE 'fp' || l_partkey END AS cell, count(*) AS n
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""",
)
def decision_children(spark, sf):
    _, children = _decisions(spark, sf)
    v = F.col("values")
    cell = F.coalesce(F.try_element_at(v, F.lit("lim_const")), F.try_element_at(v, F.lit("fp")))
    return children.groupBy("dataset_id", v["section"].alias("section"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "dtl_action_refs",
    """SELECT substr(o_orderpriority, 1, 1) AS dataset_id, 'fp(harvest)' AS source_column, 'fp' || l_partkey AS fk_value,
      'harv_ops' AS target_table, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE l_returnflag <> 'A' AND l_linestatus = 'F' GROUP BY ALL""",
)
def dtl_action_refs(spark, sf):
    found = refs.dtl_action_refs(_decisions(spark, sf)[1], Catalog())
    return found.groupBy("dataset_id", "source_column", "fk_value", "target_table").agg(F.count(F.lit(1)).alias("n"))


@query(
    "alternative_count",
    "SELECT substr(o_orderpriority, 1, 1) AS dataset_id, 'Ord' || o_orderkey AS pk_value, 2::BIGINT AS alternatives FROM orders",
)
def alternative_count(spark, sf):
    return decisions.alternative_count(*_decisions(spark, sf)).select("dataset_id", "pk_value", "alternatives")


@query(
    "resolve_decision_refs",
    """WITH f AS (SELECT substr(o_orderpriority, 1, 1) AS d, 'Ord' || l_suppkey AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    k AS (SELECT substr(o_orderpriority, 1, 1) AS d, 'Ord' || o_orderkey AS v FROM orders)
    SELECT f.d AS dataset_id, f.v AS fk_value, k.v IS NOT NULL AS resolved, count(*) AS n FROM f LEFT JOIN k ON k.d = f.d AND k.v = f.v
    GROUP BY ALL""",
)
def resolve_decision_refs(spark, sf):
    """References to a table no dataset has, found in whatever decision table file holds the name."""
    rows, _ = _decisions(spark, sf)
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.substring("o_orderpriority", 1, 1).alias("_d"))
    named = load(spark, sf, "lineitem").join(orders, "l_orderkey").withColumn("rule", F.concat(F.lit("ORD"), F.col("l_suppkey").cast("string")))
    asked = refs.extract_column_refs(
        named, "lineitem", "lineitem.tbl", F.col("l_orderkey"), [refs.ForeignKey("rule", "res_rel_dtl")], F.col("_d")
    )
    found = refs.resolve_refs(asked, rows)
    return found.groupBy("dataset_id", F.initcap("fk_lc").alias("fk_value"), "resolved").agg(F.count(F.lit(1)).alias("n"))


@query(
    "weather_series",
    """SELECT 'cust_' || o_custkey || '.pcp' AS file_name, year(o_orderdate)::VARCHAR AS yr, dayofyear(o_orderdate)::VARCHAR AS jday,
      o_totalprice AS value, 'extra' AS col4 FROM orders""",
)
def weather_series(spark, sf):
    lines = _weather_lines(spark, sf)
    _, data = records.weather_series(lines, {".pcp": ("name", "nbyr", "lat", "year", "month", "value")})
    v = F.col("values")
    return data.select(
        "file_name", v["year"].alias("yr"), v["month"].alias("jday"), v["value"].cast("double").alias("value"), v["col4"].alias("col4")
    )


@query(
    "weather_stations",
    """SELECT 'cust_' || c_custkey || '.pcp' AS file_name, 'series ' || c_custkey AS pk_value, '7' AS nbyr, c_acctbal::VARCHAR AS lat
    FROM customer""",
)
def weather_stations(spark, sf):
    stations, _ = records.weather_series(
        _weather_lines(spark, sf), {".pcp": ("name", "nbyr", "lat", "year", "month", "value")}
    )
    v = F.col("values")
    return stations.select("file_name", "pk_value", v["nbyr"].alias("nbyr"), v["lat"].alias("lat"))


def _weather_lines(spark, sf):
    """One station file per customer, its orders as the series."""
    main, name = F.lit("main").alias("dataset_id"), lambda c: F.concat(F.lit("cust_"), F.col(c).cast("string"), F.lit(".pcp")).alias("file_name")
    heads = r.head_lines(
        load(spark, sf, "customer").select(main, name("c_custkey"), "c_custkey", "c_acctbal"),
        F.concat(F.lit(" series "), F.col("c_custkey").cast("string")),
        F.lit("nbyr lat"),
        F.concat(F.lit("7  "), F.col("c_acctbal").cast("string")),
    )
    body = load(spark, sf, "orders").select(
        main, name("o_custkey"), "o_orderkey", r.words(F.year("o_orderdate"), F.dayofyear("o_orderdate"), "o_totalprice", F.lit("extra")).alias("raw")
    )
    return durable(heads.unionByName(r.numbered(body, "o_orderkey", [], 3).select(*r.LINE)))


# --- outputs ------------------------------------------------------------------------


@query(
    "output_layouts",
    """SELECT 'cust_' || c_custkey || '.txt' AS file_name,
      'Orders of ' || c_custkey || CASE WHEN c_mktsegment = 'BUILDING' THEN ' --yearly--' ELSE '' END AS title, 'order,status,price' AS columns,
      CASE WHEN c_acctbal >= 0 THEN '-,text,usd/yr' ELSE '' END AS units,
      (CASE WHEN c_mktsegment = 'BUILDING' THEN 3 ELSE 2 END)::BIGINT AS header_line,
      (CASE WHEN c_mktsegment = 'BUILDING' THEN 3 ELSE 2 END + CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END)::BIGINT AS last_head_line
    FROM customer""",
)
def output_layouts(spark, sf):
    layouts = outputs.detect_output_layout(r.customer_outputs(spark, sf))
    joined = [F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("columns", "units")]
    return layouts.select("file_name", "title", *joined, "header_line", "last_head_line")


@query(
    "output_text",
    """SELECT 'cust_' || o_custkey || '.txt' AS file_name, o_orderkey::VARCHAR AS "order", o_orderstatus AS status, o_totalprice AS price
    FROM orders""",
)
def output_text(spark, sf):
    lines = r.customer_outputs(spark, sf)
    rows = outputs.read_output_text(lines, outputs.detect_output_layout(lines))
    named = outputs.named_output(rows, ["order", "status", "price"])
    return named.select("file_name", "order", "status", F.col("price").cast("double").alias("price"))


@query(
    "text_overflow_join",
    "SELECT p_partkey::VARCHAR AS partkey, p_size::VARCHAR AS size, p_name || ' made in ' || p_brand AS label FROM part",
)
def text_overflow_join(spark, sf):
    """More words than columns: the surplus joins the last cell."""
    label = F.concat_ws(" ", "p_name", F.lit("made   in"), "p_brand")
    body = load(spark, sf, "part").select(
        F.lit("main").alias("dataset_id"), F.lit("parts.out").alias("file_name"), "p_partkey", r.words("p_partkey", "p_size", label).alias("raw")
    )
    body = r.numbered(body, "p_partkey", [], 2).select(*r.LINE)
    lines = r.head_lines(r.files_of(body), "all parts", "partkey size label").unionByName(body)
    rows = outputs.read_output_text(lines, outputs.detect_output_layout(lines))
    return outputs.named_output(rows, ["partkey", "size", "label"]).drop("dataset_id", "file_name", "line_no")


@query(
    "fixed_width_slice",
    """SELECT c_custkey::VARCHAR AS custkey, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS segment, c_acctbal AS balance
    FROM customer""",
)
def fixed_width_slice(spark, sf):
    """Blank cells keep their place because columns are cut at the header's borders."""
    segment = F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment"))
    raw = F.format_string("%-12s%-14s%-12s", F.col("c_custkey").cast("string"), segment, F.col("c_acctbal").cast("string"))
    body = load(spark, sf, "customer").select(
        F.lit("main").alias("dataset_id"), F.lit("balance.out").alias("file_name"), "c_custkey", raw.alias("raw")
    )
    body = r.numbered(body, "c_custkey", [], 4).select(*r.LINE)
    header = f"{'custkey____':12s}{'segment______':14s}{'balance____':12s}"
    units = f"{'':12s}{'':14s}{'usd':12s}"
    example = f"{'900000001':12s}{'FIRST':14s}{'1.5':12s}"
    lines = r.head_lines(r.files_of(body), "balances", header, units, example).unionByName(body)
    rows = outputs.read_output_text(lines, outputs.detect_output_layout(lines))
    named = outputs.named_output(rows.filter("line_no > 4"), ["custkey", "segment", "balance"])
    return named.select("custkey", "segment", F.col("balance").cast("double").alias("balance"))


@query(
    "csv_quoted",
    """SELECT p_partkey::VARCHAR AS p_partkey, p_name || ', "' || p_brand || '"' AS p_label, p_type || ' ' || p_size AS p_kind FROM part""",
)
def csv_quoted(spark, sf):
    """Quoted cells with commas and doubled quotes; a surplus cell joins the last one."""
    label = F.concat(F.lit('"'), F.col("p_name"), F.lit(', ""'), F.col("p_brand"), F.lit('"""'))
    body = load(spark, sf, "part").select(
        F.lit("main").alias("dataset_id"),
        F.lit("parts.csv").alias("file_name"),
        "p_partkey",
        F.concat_ws(",", F.col("p_partkey").cast("string"), label, F.concat(F.lit(" "), F.col("p_type")), F.col("p_size").cast("string")).alias("raw"),
    )
    body = r.numbered(body, "p_partkey", [], 1).select(*r.LINE)
    lines = r.head_lines(r.files_of(body), 'p_partkey,"p_label",p_kind').unionByName(body)
    _, rows = outputs.read_output_csv(lines)
    return outputs.named_output(rows, ["p_partkey", "p_label", "p_kind"]).drop("dataset_id", "file_name", "line_no")


@query(
    "json_records",
    """SELECT event_id, 'events of ' || user_id AS title, 'day,kind,value' AS columns, '-,text,' AS units, 1::BIGINT AS row_no,
      event_type AS kind, value::VARCHAR AS value FROM events
    UNION ALL SELECT event_id, 'table_3', 'k', '', 1, coalesce(json_extract_string(props, '$.k'), ''), '' FROM events""",
)
def json_records(spark, sf):
    """One document per event: a titled record below a container key and an untitled one beside it."""
    first = F.format_string(
        '{"title": "events of %d", "header": "day kind value", "units": ["-", "text"], "data": [["1", "%s", %s, "surplus"]]}',
        "user_id", "event_type", F.col("value").cast("string"),
    )
    second = F.format_string('{"header": [], "title": "", "data": [%s]}', "props")
    document = F.format_string('{"results": [%s], "extra": {"deep": %s}}', first, second)
    docs = load(spark, sf, "events").select("event_id", document.alias("document"))
    rows = outputs.read_output_json(docs, "document", ["event_id"])
    # The record in the container is met twice before the untitled one, which so is the third.
    deep = F.col("title") == "table_3"
    return rows.select(
        "event_id",
        "title",
        F.array_join("columns", ",").alias("columns"),
        F.coalesce(F.array_join("units", ","), F.lit("")).alias("units"),
        "row_no",
        F.when(deep, F.get("cells", F.lit(0))).otherwise(F.get("cells", F.lit(1))).alias("kind"),
        F.when(deep, "").otherwise(F.get("cells", F.lit(2))).alias("value"),
    )


# --- format checks ---------------------------------------------------------------------

_ORDERS = Table(
    "orders",
    "orders.tbl",
    (Col("o_orderkey", "IntegerField"), Col("o_custkey", "IntegerField"), Col("o_totalprice", "DoubleField"), Col("flag", "BooleanField"), Col("note")),
    ("o_orderkey",),
)
_ORDER_HEADER = "o_orderkey o_custkey o_totalprice flag note"


def _order_files(spark, sf):
    """One order file per customer, with faults that depend on the customer and the order.

    Customers of machinery have the first data row in place of the header, of household a foreign
    header, of nation 3 blank files, and those in debt a blank title. Open orders over 300000 miss
    two cells; pending ones have bad cells.
    """
    customer = load(spark, sf, "customer")
    dataset = F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dataset_id")
    blank = F.col("c_nationkey") == 3
    header = (
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("1 2 3.5 y first"))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("foo bar baz qux"))
        .otherwise(F.lit(_ORDER_HEADER))
    )
    title = F.when(F.col("c_acctbal") < 0, "  ").otherwise("title")
    heads = r.head_lines(
        customer.select(dataset, F.lit("orders.tbl").alias("file_name"), blank.alias("_blank"), title.alias("_t"), header.alias("_h")),
        F.when(F.col("_blank"), " ").otherwise(F.col("_t")),
        F.when(F.col("_blank"), " ").otherwise(F.col("_h")),
    )
    status = F.col("o_orderstatus")
    full = r.words(
        "o_orderkey",
        F.when(status == "P", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string")),
        F.when((status == "P") & (F.col("o_totalprice") > 200000), F.lit("1e999")).otherwise(F.col("o_totalprice").cast("string")),
        F.when(F.col("o_orderpriority") == "1-URGENT", "maybe").otherwise("Yes"),
        F.lit("ok"),
    )
    raw = F.when((status == "O") & (F.col("o_totalprice") > 300000), r.words("o_orderkey", "o_custkey")).otherwise(full)
    orders = load(spark, sf, "orders").withColumn("raw", raw).withColumnRenamed("o_custkey", "c_custkey")
    body = orders.join(customer.select("c_custkey", "c_nationkey"), "c_custkey").filter(~blank)
    body = body.select(dataset, F.lit("orders.tbl").alias("file_name"), "o_orderkey", "raw")
    return durable(heads.unionByName(r.numbered(body, "o_orderkey", [], 2).select(*r.LINE)))


_CHECKED = Catalog(tables=(_ORDERS,))


def _issues(spark, sf, cap=None):
    lines = _order_files(spark, sf)
    return checks.format_issues(lines, r.bound(r.files_of(lines), _CHECKED), _CHECKED, cap)


_CHECK_SQL = """b AS (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 2 AS line_no
  FROM orders o JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 3),
i AS (
  SELECT o_custkey, line_no, 0 AS ord, 'wrong_column_count' AS kind, '' AS col, '2' AS actual FROM b WHERE o_orderstatus = 'O' AND o_totalprice > 300000
  UNION ALL SELECT o_custkey, line_no, 1, 'invalid_integer', 'o_custkey', 'c' || o_custkey FROM b WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_custkey, line_no, 2, 'invalid_decimal', 'o_totalprice', '1e999' FROM b WHERE o_orderstatus = 'P' AND o_totalprice > 200000
  UNION ALL SELECT o_custkey, line_no, 3, 'invalid_boolean', 'flag', 'maybe' FROM b WHERE o_orderpriority = '1-URGENT'
    AND NOT (o_orderstatus = 'O' AND o_totalprice > 300000))
"""


# Issues of whole files, and those of rows, with all they say.
_ALL_ISSUES = f"""{_CHECK_SQL},
f AS (
  SELECT c_custkey AS cust, 0 AS line_no, 'empty_file' AS kind, 'File is empty: orders.tbl' AS message, NULL AS expected, NULL AS actual FROM customer WHERE c_nationkey = 3
  UNION ALL SELECT c_custkey, 1, 'missing_metadata_line', 'Missing or blank title/metadata line in orders.tbl', 'Non-empty title line on line 1', NULL
    FROM customer WHERE c_nationkey <> 3 AND c_acctbal < 0
  UNION ALL SELECT c_custkey, 2, 'missing_header_line', 'Expected a column header in orders.tbl, but found a data row instead', 'Column header on line 2', '1 2 3.5 y first'
    FROM customer WHERE c_nationkey <> 3 AND c_mktsegment = 'MACHINERY'
  UNION ALL SELECT c_custkey, 2, 'header_column_mismatch', 'Column-header mismatch in orders.tbl: 5 of 5 expected columns not found in header', '{_ORDER_HEADER}', 'foo bar baz qux'
    FROM customer WHERE c_nationkey <> 3 AND c_mktsegment = 'HOUSEHOLD'),
every AS (
  SELECT 'c' || cust AS dataset_id, line_no, kind, '' AS col, message, expected, actual, 0 AS ord FROM f
  UNION ALL SELECT 'c' || o_custkey, line_no, kind, col, CASE kind WHEN 'wrong_column_count' THEN 'Too few columns in orders.tbl at line ' || line_no || ': expected 5 columns, found 2'
      ELSE 'Invalid ' || CASE kind WHEN 'invalid_integer' THEN 'integer' WHEN 'invalid_decimal' THEN 'numeric' ELSE 'boolean' END || ' value in orders.tbl at line ' || line_no || ', column "' || col
        || '": "' || actual || '"' || CASE kind WHEN 'invalid_boolean' THEN ' (expected 0/1, y/n, true/false, or yes/no)' ELSE '' END END,
    CASE kind WHEN 'wrong_column_count' THEN '5' WHEN 'invalid_integer' THEN 'integer' WHEN 'invalid_decimal' THEN 'number' ELSE '0/1, y/n, true/false, or yes/no' END, actual, ord FROM i)"""


@query(
    "format_issues_rows",
    f"""WITH {_ALL_ISSUES} SELECT dataset_id, line_no::BIGINT AS line_no, kind, col AS "column", coalesce(expected, '') AS expected, coalesce(actual, '') AS actual FROM every""",
)
def format_issues_rows(spark, sf):
    return _issues(spark, sf, cap=None).select("dataset_id", "line_no", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("column", "expected", "actual")])


@query(
    "format_issue_cap",
    f"""WITH {_ALL_ISSUES} SELECT dataset_id, line_no::BIGINT AS line_no, kind FROM
    (SELECT *, row_number() OVER (PARTITION BY dataset_id, line_no > 2 ORDER BY line_no, ord) AS n FROM every) WHERE n <= 20 OR line_no <= 2""",
)
def format_issue_cap(spark, sf):
    return _issues(spark, sf, cap=20).select("dataset_id", "line_no", "kind")


@query("format_issues_files", f"WITH {_ALL_ISSUES} SELECT dataset_id, line_no::BIGINT AS line_no, kind, message FROM every")
def format_issues_files(spark, sf):
    return _issues(spark, sf).select("dataset_id", "line_no", "kind", "message")


@query("issue_counts_by_kind", f"WITH {_ALL_ISSUES} SELECT dataset_id, kind, count(*) AS issues FROM every GROUP BY ALL")
def issue_counts_by_kind(spark, sf):
    from linkfold.operators.report import issue_counts_by_kind as by_kind

    return by_kind(_issues(spark, sf, cap=None))


# --- file lists ---------------------------------------------------------------------------

_CLASS = {"1-URGENT": "simulation", "2-HIGH": "Climate", "3-MEDIUM": "connect", "4-NOT SPECIFIED": "hru", "5-LOW": "soils"}
_LIST_SQL = """e AS (SELECT 'c' || o_custkey AS dataset_id, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'simulation' WHEN '2-HIGH' THEN 'Climate'
    WHEN '3-MEDIUM' THEN 'connect' WHEN '4-NOT SPECIFIED' THEN 'hru' ELSE 'soils' END AS classification,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS line_no,
  unnest(['f' || o_orderkey || '.dat', CASE o_orderstatus WHEN 'F' THEN 'NULL' WHEN 'O' THEN '0' ELSE 'plain' END, 'g' || o_custkey || '.dat']) AS file_name,
  unnest([1, 2, 3]) AS order_in_class FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY line_no, order_in_class) AS row_id,
  lower(file_name) IN ('null', '0') AS is_default FROM e)
"""


def _entries(spark, sf):
    """One master list per customer, one classification line per order."""
    second = text.lookup(F.col("o_orderstatus"), {"F": "NULL", "O": "0"}, F.lit("plain"))
    raw = r.words(
        text.lookup(F.col("o_orderpriority"), _CLASS),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".dat")),
        second,
        F.concat(F.lit("g"), F.col("o_custkey").cast("string"), F.lit(".dat")),
    )
    body = load(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dataset_id"), F.lit("file.cio").alias("file_name"), "o_orderkey", raw.alias("raw")
    )
    body = r.numbered(body, "o_orderkey", [], 1).select(*r.LINE)
    lines = durable(r.head_lines(r.files_of(body), "master list").unionByName(body))
    return filelist.file_list_entries(lines, Catalog())


def _inventory(spark, sf):
    """Files on disk: those of the finished orders, and the customer's own file."""
    dataset = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dataset_id")
    orders = load(spark, sf, "orders")
    own = orders.filter("o_orderstatus = 'F'").select(dataset, F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".dat")).alias("file_name"))
    shared = orders.filter("o_totalprice > 450000").select(dataset, F.concat(F.lit("g"), F.col("o_custkey").cast("string"), F.lit(".dat")).alias("file_name"))
    return own.unionByName(shared.distinct())


@query(
    "file_list_entries",
    f"WITH {_LIST_SQL} SELECT dataset_id, line_no, row_id, classification, order_in_class::BIGINT AS order_in_class, file_name, is_default FROM n",
)
def file_list_entries(spark, sf):
    return _entries(spark, sf).withColumn("order_in_class", F.col("order_in_class").cast("bigint")).drop("customization")


@query(
    "file_list_references",
    f"WITH {_LIST_SQL} SELECT DISTINCT dataset_id, file_name FROM n WHERE NOT is_default AND contains(file_name, '.')",
)
def file_list_references(spark, sf):
    return filelist.referenced_files(_entries(spark, sf))


@query(
    "file_list_class_summary",
    f"""WITH {_LIST_SQL}, l AS (SELECT dataset_id, lower(classification) AS classification, line_no, count(*) FILTER (WHERE NOT is_default) AS customized,
      count(*) AS total FROM n GROUP BY ALL)
    SELECT dataset_id, classification, customized, total FROM l QUALIFY row_number() OVER (PARTITION BY dataset_id, classification ORDER BY line_no DESC) = 1""",
)
def file_list_class_summary(spark, sf):
    return filelist.class_summary(_entries(spark, sf))


_DISK_SQL = """disk AS (SELECT 'c' || o_custkey AS dataset_id, 'f' || o_orderkey || '.dat' AS file_name FROM orders WHERE o_orderstatus = 'F'
  UNION SELECT 'c' || o_custkey, 'g' || o_custkey || '.dat' FROM orders WHERE o_totalprice > 450000)"""


@query(
    "missing_listed_files",
    f"""WITH {_LIST_SQL}, {_DISK_SQL} SELECT dataset_id, line_no, file_name FROM n WHERE NOT is_default AND contains(file_name, '.')
    AND NOT EXISTS (SELECT 1 FROM disk d WHERE d.dataset_id = n.dataset_id AND d.file_name = n.file_name)""",
)
def missing_listed_files(spark, sf):
    return filelist.missing_listed_files(_entries(spark, sf), _inventory(spark, sf)).select("dataset_id", "line_no", "file_name")


@query(
    "expected_vs_actual",
    f"""WITH {_LIST_SQL}, {_DISK_SQL}, d AS (SELECT DISTINCT dataset_id FROM n),
    p(classification, position, expected_file) AS (VALUES ('simulation', 1, 'time.sim'), ('simulation', 2, 'print.prt'), ('climate', 1, 'pcp.cli'),
      ('climate', 3, 'tmp.cli'), ('exco', 1, 'exco.exc')),
    a AS (SELECT dataset_id, lower(classification) AS classification, order_in_class AS position, nullif(arg_max(file_name, row_id), 'null') AS actual
      FROM n GROUP BY ALL)
    SELECT d.dataset_id, p.classification, p.position::INTEGER AS position, p.expected_file, coalesce(a.actual, '') AS actual_file,
      disk.file_name IS NOT NULL AND starts_with(a.actual, 'g') AS is_indexed
    FROM d CROSS JOIN p LEFT JOIN a USING (dataset_id, classification, position)
      LEFT JOIN disk ON disk.dataset_id = d.dataset_id AND disk.file_name = a.actual""",
)
def expected_vs_actual(spark, sf):
    return _compared(spark, sf).withColumn("actual_file", F.coalesce("actual_file", F.lit("")))


def _compared(spark, sf):
    plan = {"simulation": ("time.sim", "print.prt"), "climate": ("pcp.cli", None, "tmp.cli"), "exco": ("exco.exc",)}
    # The customers' own files are the ones whose tables have rows.
    rows = load(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dataset_id"),
        F.concat(F.lit("g"), F.col("c_custkey").cast("string"), F.lit("_dat")).alias("table_name"),
    )
    return filelist.expected_vs_actual(_entries(spark, sf), _inventory(spark, sf), rows, Catalog(), plan)


@query(
    "indexed_counts",
    f"""WITH x AS ({ORACLES["expected_vs_actual"]}) SELECT dataset_id, classification, count_if(is_indexed)::BIGINT AS indexed, count(*) AS expected FROM x GROUP BY ALL""",
)
def indexed_counts(spark, sf):
    return filelist.indexed_counts(_compared(spark, sf))


@query(
    "missing_file_pointers",
    f"""WITH {_DISK_SQL} SELECT 'c' || o_custkey AS dataset_id, o_orderkey AS source_line, 'pcp' AS source_column, 'f' || o_orderkey || '.dat' AS referenced_file
      FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'c' || o_custkey, o_orderkey, 'wgn', 'gen.' || o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'""",
)
def missing_file_pointers(spark, sf):
    order = F.col("o_orderkey").cast("string")
    rows = load(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dataset_id"),
        F.lit("weather_sta_cli").alias("table_name"),
        F.lit("weather-sta.cli").alias("file_name"),
        F.col("o_orderkey").alias("line_no"),
        F.create_map(
            F.lit("pcp"), F.concat(F.lit("f"), order, F.lit(".dat")),
            F.lit("tmp"), F.lit("Null"),
            F.lit("wgn"), F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("gen."), order)).otherwise("generator"),
        ).alias("values"),
    )
    found = refs.missing_file_pointers(rows, _inventory(spark, sf), Catalog())
    return found.select("dataset_id", "source_line", "source_column", "referenced_file")


# --- routing and subsets -----------------------------------------------------------------

_ROUTE_SQL = """sel AS (SELECT o_orderkey + 1 AS id, o_custkey + 1 AS cust, row_number() OVER (ORDER BY o_orderkey) AS new_id
  FROM orders WHERE o_totalprice > 400000)"""


def _selected(spark, sf):
    return load(spark, sf, "orders").filter("o_totalprice > 400000").select(F.lit("main").alias("dataset_id"), (F.col("o_orderkey") + 1).alias("id"))


def _squeezed(df):
    return df.withColumn("raw", F.regexp_replace(F.trim("raw"), " +", " "))


@query(
    "routing_edges",
    """SELECT 'hru' AS src_typ, o_orderkey + 1 AS src_id, 'sdc' AS dst_typ, o_custkey + 1 AS dst_id, 'tot' AS hyd_typ, 1.0::DOUBLE AS frac FROM orders
    UNION ALL SELECT 'hru', o_orderkey + 1, 'out', 999999, 'rhg', 1.0 FROM orders
    UNION ALL SELECT 'sdc', c_custkey + 1, 'out', c_nationkey + 1, 'tot', 0.25 FROM customer
    UNION ALL SELECT DISTINCT 'ru', o_orderkey // 10 + 1, 'out', 3, 'tot', 1.0 FROM orders""",
)
def routing_edges(spark, sf):
    return graph.routing_edges(graph.connect_rows(r.routed_dataset(spark, sf))).drop("dataset_id")


@query(
    "subset_isolated_connect",
    f"""WITH {_ROUTE_SQL} SELECT new_id + 2 AS line_no, concat_ws(' ', new_id, 'hru' || id, id, '1.5 40 -90 100', new_id, 'sta 0 0 0 0') AS raw FROM sel
    UNION ALL SELECT 1, 'title' UNION ALL SELECT 2, 'id name gis_id area lat lon elev prop wst cst ovfl rule src_tot'""",
)
def subset_isolated_connect(spark, sf):
    lines, _, _ = subset.isolated_connect(r.routed_dataset(spark, sf), _selected(spark, sf))
    return _squeezed(lines).select("line_no", "raw")


@query(
    "subset_isolated_data",
    f"""WITH {_ROUTE_SQL} SELECT s.new_id + 2 AS line_no, concat_ws(' ', s.new_id, 'data' || s.id, o_totalprice, 'soil1') AS raw
      FROM sel s JOIN orders ON o_orderkey = s.id - 1
    UNION ALL SELECT 1, 'title' UNION ALL SELECT 2, 'id name topo soil'""",
)
def subset_isolated_data(spark, sf):
    dataset = r.routed_dataset(spark, sf)
    _, ids, properties = subset.isolated_connect(dataset, _selected(spark, sf))
    return _squeezed(subset.data_table(dataset, "hru-data.hru", properties)).select("line_no", "raw")


@query(
    "subset_elements",
    f"""WITH {_ROUTE_SQL} SELECT new_id + 2 AS line_no, concat_ws(' ', new_id, 'el' || id, 'hru', new_id, '1.0') AS raw FROM sel
    UNION ALL SELECT 1, 'title' UNION ALL SELECT 2, 'id name obj_typ obj_id frac'""",
)
def subset_elements(spark, sf):
    dataset = r.routed_dataset(spark, sf)
    maps = subset.map_ids(_selected(spark, sf)).withColumn("typ", F.lit("hru"))
    lines, _ = subset.element_table(dataset, "rout_unit.ele", maps, number_by_object=False)
    return _squeezed(lines).select("line_no", "raw")


@query(
    "subset_definitions",
    f"""WITH {_ROUTE_SQL}, g AS (SELECT (id - 1) // 10 + 1 AS unit, count(*) AS n, string_agg(new_id::VARCHAR, ' ' ORDER BY id) AS elems FROM sel GROUP BY 1)
    SELECT row_number() OVER (ORDER BY unit) + 2 AS line_no, concat_ws(' ', row_number() OVER (ORDER BY unit), 'rtu' || unit, n, elems) AS raw FROM g
    UNION ALL SELECT 1, 'title' UNION ALL SELECT 2, 'id name elem_tot elements'""",
)
def subset_definitions(spark, sf):
    dataset = r.routed_dataset(spark, sf)
    lines, _ = subset.definition_table(dataset, "rout_unit.def", subset.map_ids(_selected(spark, sf)), total_at=2)
    return _squeezed(lines).select("line_no", "raw")


@query(
    "subset_definitions_wide",
    f"""WITH {_ROUTE_SQL}, g AS (SELECT (id - 1) // 10 + 1 AS unit, count(*) AS n, string_agg(new_id::VARCHAR, ' ' ORDER BY id) AS elems FROM sel GROUP BY 1),
    m AS (SELECT row_number() OVER (ORDER BY unit) AS k, 'rtu' || unit AS name, n, elems FROM g
      UNION ALL SELECT (SELECT count(*) FROM g) + 1, 'all', count(*), string_agg(new_id::VARCHAR, ' ' ORDER BY id) FROM sel
      UNION ALL SELECT (SELECT count(*) FROM g) + 2, 'down', count(*), string_agg(new_id::VARCHAR, ' ' ORDER BY id DESC) FROM sel)
    SELECT k + 2 AS line_no, concat_ws(' ', k, name, n, elems) AS raw FROM m UNION ALL SELECT 1, 'title' UNION ALL SELECT 2, 'id name elem_tot elements'""",
)
def subset_definitions_wide(spark, sf):
    """Two more units that list thousands of millions of elements as one range, up and down."""
    dataset = r.routed_dataset(spark, sf)
    more = spark.createDataFrame([("main", "rout_unit.def", 1 << 40, "900001 all 2 1 -9000000000"), ("main", "rout_unit.def", (1 << 40) + 1, "900002 down 2 9000000000 -1")], dataset.schema)
    lines, _ = subset.definition_table(dataset.unionByName(more), "rout_unit.def", subset.map_ids(_selected(spark, sf)), total_at=2)
    return _squeezed(lines).select("line_no", "raw")


_ROUTED_SQL = f"""{_ROUTE_SQL},
ru AS (SELECT u AS id, row_number() OVER (ORDER BY u) AS new_id FROM (SELECT DISTINCT (id - 1) // 10 + 1 AS u FROM sel)),
sdc AS (SELECT c AS id, row_number() OVER (ORDER BY c) AS new_id FROM (SELECT DISTINCT cust AS c FROM sel)),
outs AS (SELECT o AS id, row_number() OVER (ORDER BY o) AS new_id FROM (SELECT DISTINCT c_nationkey + 1 AS o FROM sdc JOIN customer ON c_custkey = sdc.id - 1
  UNION SELECT 999999 UNION SELECT 3))"""


@query(
    "subset_routed_maps",
    f"""WITH {_ROUTED_SQL} SELECT 'hru' AS typ, id, new_id FROM sel UNION ALL SELECT 'ru', id, new_id FROM ru
    UNION ALL SELECT 'sdc', id, new_id FROM sdc UNION ALL SELECT 'out', id, new_id FROM outs""",
)
def subset_routed_maps(spark, sf):
    kept = subset_plan.kept_objects(r.routed_dataset(spark, sf), _selected(spark, sf))
    return graph.id_maps(kept).select("typ", "id", "new_id")


_CONNECT_HEAD = "id name gis_id area lat lon elev prop wst cst ovfl rule src_tot obj_typ obj_id hyd_typ frac"
_COUNT_HEAD = "name ls_area tot_area objs hru lhru rtu gwfl aqu cha res rec exco dlr can pmp out lcha aqu2d hrd wro"


def _heads_sql(**files: str) -> str:
    """Title and header lines of files; a dot in a name is written as ``__``, a dash as ``_``."""
    return " UNION ALL ".join(
        f"SELECT '{f}', {n}, '{raw}'" for key, head in files.items() for f in [key.replace("__", ".")] for n, raw in ((1, "title"), (2, head))
    )


_ROUTED_CONNECT = f"""SELECT 'hru.con' AS file_name, s.new_id + 2 AS line_no, concat_ws(' ', s.new_id, 'hru' || s.id, s.id, '1.5 40 -90 100', s.new_id, 'sta 0 0 0 2 sdc', c.new_id,
      'tot 1.0 out', o.new_id, 'rhg x') AS raw FROM sel s JOIN sdc c ON c.id = s.cust JOIN outs o ON o.id = 999999
    UNION ALL SELECT 'chandeg.con', c.new_id + 2, concat_ws(' ', c.new_id, 'cha' || c.id, c.id, '1.5 40 -90 100', c.new_id, 'sta 0 0 0 1 out', o.new_id, 'tot 0.25')
      FROM sdc c JOIN customer ON c_custkey = c.id - 1 JOIN outs o ON o.id = c_nationkey + 1
    UNION ALL SELECT 'rout_unit.con', u.new_id + 2, concat_ws(' ', u.new_id, 'rtu' || u.id, u.id, '1.5 40 -90 100', u.new_id, 'sta 0 0 0 1 out', o.new_id, 'tot 1.0')
      FROM ru u JOIN outs o ON o.id = 3
    UNION ALL SELECT 'outlet.con', row_number() OVER (ORDER BY o.id) + 2, concat_ws(' ', o.new_id, 'out' || o.id, o.id, '1.5 40 -90 100',
      row_number() OVER (ORDER BY o.id), 'sta 0 0 0 0') FROM outs o JOIN nation ON n_nationkey = o.id - 1
    UNION ALL {_heads_sql(hru__con=_CONNECT_HEAD, chandeg__con=_CONNECT_HEAD, rout_unit__con=_CONNECT_HEAD, outlet__con=_CONNECT_HEAD)}"""


@query("subset_routed_connect", f"WITH {_ROUTED_SQL} {_ROUTED_CONNECT}")
def subset_routed_connect(spark, sf):
    dataset = r.routed_dataset(spark, sf)
    maps = graph.id_maps(subset_plan.kept_objects(dataset, _selected(spark, sf)))
    lines, _ = subset.routed_connect(dataset, maps)
    return _squeezed(lines).select("file_name", "line_no", "raw")


# Elements and definitions are numbered alike in both kinds of subset.
_UNITS_SQL = """g AS (SELECT (id - 1) // 10 + 1 AS unit, count(*) AS n, string_agg(new_id::VARCHAR, ' ' ORDER BY id) AS elems FROM sel GROUP BY 1),
u AS (SELECT *, row_number() OVER (ORDER BY unit) AS k FROM g)"""
_UNIT_FILES = f"""SELECT 'rout_unit.ele' AS file_name, new_id + 2 AS line_no, concat_ws(' ', new_id, 'el' || id, 'hru', new_id, '1.0') AS raw FROM sel
    UNION ALL SELECT 'ls_unit.ele', new_id + 2, concat_ws(' ', new_id, 'ls' || id, 'hru', new_id, '1.0') FROM sel
    UNION ALL SELECT 'rout_unit.def', k + 2, concat_ws(' ', k, 'rtu' || unit, n, elems) FROM u
    UNION ALL SELECT 'ls_unit.def', k + 3, concat_ws(' ', k, 'lsu' || unit, '9.5', n, elems) FROM u
    UNION ALL SELECT 'ls_unit.def', 1, 'title' UNION ALL SELECT 'ls_unit.def', 2, (SELECT count(*)::VARCHAR FROM u) UNION ALL SELECT 'ls_unit.def', 3, 'id name area elem_tot elements'
    UNION ALL SELECT 'object.cnt', 1, 'object.cnt: written' UNION ALL SELECT 'object.cnt', 2, '{_COUNT_HEAD}'
    UNION ALL SELECT 'file.cio', 1, 'file.cio: written' UNION ALL SELECT 'print.prt', 1, 'print.prt: written' UNION ALL SELECT 'print.prt', 3, 'basin_wb y n y y'
    UNION ALL {_heads_sql(rout_unit__ele="id name obj_typ obj_id frac", ls_unit__ele="id name obj_typ obj_typ_no frac", rout_unit__def="id name elem_tot elements")}"""


@query(
    "subset_routed",
    f"""WITH {_ROUTED_SQL}, {_UNITS_SQL}, counts AS (SELECT (SELECT count(*) FROM sel) AS h, (SELECT count(*) FROM ru) AS r, (SELECT count(*) FROM sdc) AS c, (SELECT count(*) FROM outs) AS o)
    {_ROUTED_CONNECT} UNION ALL {_UNIT_FILES}
    UNION ALL SELECT 'hru-data.hru', s.new_id + 2, concat_ws(' ', s.new_id, 'data' || s.id, o_totalprice, 'soil1') FROM sel s JOIN orders ON o_orderkey = s.id - 1
    UNION ALL SELECT 'channel-lte.cha', c.new_id + 2, concat_ws(' ', c.new_id, 'lte' || c.id, c_nationkey + 1) FROM sdc c JOIN customer ON c_custkey = c.id - 1
    UNION ALL SELECT 'rout_unit.rtu', new_id + 2, concat_ws(' ', new_id, 'rtu' || id, 'dr1') FROM ru
    UNION ALL SELECT 'hru-data.hru', n, x FROM (VALUES (1, 'title'), (2, 'id name topo soil')) t (n, x)
    UNION ALL SELECT 'channel-lte.cha', n, x FROM (VALUES (1, 'title'), (2, 'id name nation')) t (n, x)
    UNION ALL SELECT 'rout_unit.rtu', n, x FROM (VALUES (1, 'title'), (2, 'id name dr')) t (n, x)
    UNION ALL SELECT 'object.cnt', 3, concat_ws(' ', 'basin 10 10', h + r + c + o, h, 0, r, '0 0 0 0 0 0 0 0 0', o, c, '0 0 0') FROM counts
    UNION ALL SELECT 'file.cio', 2, 'connect hru.con null rout_unit.con null chandeg.con outlet.con' UNION ALL SELECT 'print.prt', 2, 'lsunit_wb y y y y'""",
)
def subset_routed(spark, sf):
    lines, _ = subset_plan.routed(r.routed_dataset(spark, sf), _selected(spark, sf))
    return _squeezed(lines).select("file_name", "line_no", "raw")


@query(
    "subset_isolated",
    f"""WITH {_ROUTE_SQL}, {_UNITS_SQL}, h AS (SELECT count(*) AS h FROM sel), blocks AS (SELECT DISTINCT o_orderkey // 10 + 1 AS id FROM orders)
    {_UNIT_FILES}
    UNION ALL SELECT 'hru.con', line_no, raw FROM ({ORACLES["subset_isolated_connect"]})
    UNION ALL SELECT 'hru-data.hru', line_no, raw FROM ({ORACLES["subset_isolated_data"]})
    UNION ALL SELECT 'rout_unit.rtu', k + 2, concat_ws(' ', k, 'rtu' || unit, 'dr1') FROM u UNION ALL SELECT 'rout_unit.rtu', n, x FROM (VALUES (1, 'title'), (2, 'id name dr')) t (n, x)
    UNION ALL SELECT 'object.cnt', 3, concat_ws(' ', 'basin 10 10', h, h, '0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0') FROM h
    UNION ALL SELECT 'file.cio', 2, 'connect hru.con null null null null null' UNION ALL SELECT 'print.prt', 2, 'lsunit_wb n n n n'
    UNION ALL SELECT 'chandeg.con', row_number() OVER (ORDER BY c_custkey) + 2, concat_ws(' ', c_custkey + 1, 'cha' || (c_custkey + 1), c_custkey + 1, '1.5 40 -90 100', c_custkey + 1, 'sta 0 0 0 1 out', c_nationkey + 1, 'tot 0.25') FROM customer
    UNION ALL SELECT 'channel-lte.cha', row_number() OVER (ORDER BY c_custkey) + 2, concat_ws(' ', c_custkey + 1, 'lte' || (c_custkey + 1), c_nationkey + 1) FROM customer
    UNION ALL SELECT 'outlet.con', n_nationkey + 3, concat_ws(' ', n_nationkey + 1, 'out' || (n_nationkey + 1), n_nationkey + 1, '1.5 40 -90 100', n_nationkey + 1, 'sta 0 0 0 0') FROM nation
    UNION ALL SELECT 'rout_unit.con', row_number() OVER (ORDER BY id) + 2, concat_ws(' ', id, 'rtu' || id, id, '1.5 40 -90 100', id, 'sta 0 0 0 1 out 3 tot 1.0') FROM blocks
    UNION ALL SELECT 'channel-lte.cha', n, x FROM (VALUES (1, 'title'), (2, 'id name nation')) t (n, x)
    UNION ALL {_heads_sql(chandeg__con=_CONNECT_HEAD, outlet__con=_CONNECT_HEAD, rout_unit__con=_CONNECT_HEAD)}""",
)
def subset_isolated(spark, sf):
    lines, _ = subset_plan.isolated(r.routed_dataset(spark, sf), _selected(spark, sf))
    return _squeezed(lines).select("file_name", "line_no", "raw")


# --- stores -------------------------------------------------------------------------------


@query(
    "save_load_index",
    """SELECT l_returnflag AS dataset_id, l_partkey::VARCHAR AS fk_value, p_partkey IS NOT NULL AS resolved, count(*) AS n
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 40 WHERE l_partkey <> 0 GROUP BY ALL""",
)
def save_load_index(spark, sf):
    """An index written to the shared folder and loaded again."""
    path = scratch_path(spark, "index")
    store.save_index({"rows": _lineitem_rows(spark, sf)}, path)
    # The references are taken from the saved rows, so the text is not parsed again.
    found = refs.extract_fk_refs(store.load_index(spark, path, ["rows"])["rows"], _CATALOG)
    keys = load(spark, sf, "part").filter(ACTIVE["part"]).select(
        F.explode(F.array(*[F.lit(f) for f in ("A", "N", "R")])).alias("dataset_id"),
        F.lit("part").alias("table_name"),
        F.lit("part.tbl").alias("file_name"),
        F.col("p_partkey").cast("string").alias("pk_lc"),
        F.col("p_partkey").alias("line_no"),
    )
    store.save_index({"refs": refs.resolve_column_refs(found, keys)}, path)
    loaded = store.load_index(spark, path)["refs"]
    return loaded.groupBy("dataset_id", "fk_value", "resolved").agg(F.count(F.lit(1)).alias("n"))


@query(
    "preflight_report",
    f"""WITH {_ALL_ISSUES}, {_LIST_SQL}, {_DISK_SQL},
    d AS (SELECT 'c' || c_custkey AS dataset_id, c_custkey AS k FROM customer),
    o AS (SELECT 'c' || o_custkey AS dataset_id, count(*) AS bought, count(*) FILTER (WHERE o_orderstatus = 'P') AS lost FROM b GROUP BY 1),
    missing AS (SELECT dataset_id, line_no, classification, file_name FROM n WHERE NOT is_default AND contains(file_name, '.')
      AND NOT EXISTS (SELECT 1 FROM disk WHERE disk.dataset_id = n.dataset_id AND disk.file_name = n.file_name)),
    t AS (
      SELECT d.dataset_id, k, coalesce(bought, 0) AS bought, coalesce(lost, 0) AS lost, (SELECT count(*) FROM missing m WHERE m.dataset_id = d.dataset_id) AS gone,
        (SELECT count(*) FROM every e WHERE e.dataset_id = d.dataset_id) AS faults FROM d LEFT JOIN o ON o.dataset_id = d.dataset_id),
    body AS (
      SELECT dataset_id, 1 AS section, unnest(range(1, 10)) AS ord, unnest(['- Tables indexed: ' || CASE WHEN bought > 0 THEN 2 ELSE 1 END, '- Rows indexed: ' || (bought + 1),
        '- Foreign key references: ' || bought, '- Resolved references: ' || (bought - lost), '- Unresolved references: ' || lost, '- Missing file pointers: ' || gone,
        '- Missing foreign key target files: 0', '- File format issues: ' || faults,
        '- Potential orphan rows (no inbound and no outbound refs): ' || CASE WHEN bought = lost THEN 1 ELSE 0 END]) AS line FROM t
      UNION ALL SELECT dataset_id, 2, row_number() OVER (PARTITION BY dataset_id ORDER BY line_no, kind, message),
        '| orders.tbl | ' || CASE WHEN line_no > 0 THEN line_no::VARCHAR ELSE '—' END || ' | ' || kind || ' | ' || message || ' |' FROM every
      UNION ALL SELECT dataset_id, 3, row_number() OVER (PARTITION BY dataset_id ORDER BY line_no, classification, file_name),
        '| file.cio | ' || line_no || ' | ' || classification || ' | ' || file_name || ' |' FROM missing
      UNION ALL SELECT dataset_id, 5, 1, '- customer.name: ' || lost FROM t WHERE lost > 0
      UNION ALL SELECT dataset_id, 6, 1, '- orders.o_custkey: ' || lost FROM t WHERE lost > 0
      UNION ALL SELECT dataset_id, 7, 1, '| customer | ' || k || ' | customer.tbl | ' || k || ' |' FROM t WHERE bought = lost),
    heads (section, title, header) AS (VALUES (1, '## Summary', NULL), (2, '## File format issues', '| file | line | kind | message |'),
      (3, '## Missing file pointers', '| source file | line | column | missing file |'),
      (4, '## Missing foreign key target files', '| source file | line | source column | fk value | missing target file |'),
      (5, '## Top unresolved targets', NULL), (6, '## Top unresolved source columns', NULL), (7, '## Potential orphan rows', '| table | pk | file | line |')),
    s AS (SELECT d.dataset_id, heads.*, EXISTS (SELECT 1 FROM body WHERE body.dataset_id = d.dataset_id AND body.section = heads.section) AS filled FROM d, heads)
    SELECT dataset_id, section::INT AS section, ord::BIGINT AS ord, line FROM body UNION ALL SELECT dataset_id, section, -2, title FROM s
    UNION ALL SELECT dataset_id, section, -1, CASE WHEN filled THEN header ELSE '- None' END FROM s WHERE header IS NOT NULL OR NOT filled""",
)
def preflight_report(spark, sf):
    """Report over the order files, whose customers are the datasets."""
    from linkfold.operators import report

    lines = _order_files(spark, sf)
    bound = r.bound(r.files_of(lines), _CHECKED)
    issues = checks.format_issues(lines, bound, _CHECKED)
    rows = tables.parse_tables(lines, tables.resolve_header(lines, bound, _CHECKED), _CHECKED)
    asked = refs.extract_column_refs(
        rows.withColumn("o_custkey", F.try_element_at("values", F.lit("o_custkey"))), "orders", "orders.tbl", F.col("line_no"),
        [refs.ForeignKey("o_custkey", "customer")], F.col("dataset_id"),
    )
    keys = load(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dataset_id"),
        F.lit("customer").alias("table_name"),
        F.lit("customer.tbl").alias("file_name"),
        F.col("c_custkey").cast("string").alias("pk_value"),
        F.col("c_custkey").cast("string").alias("pk_lc"),
        F.col("c_custkey").alias("line_no"),
    )
    every = rows.select(*keys.columns).unionByName(keys)
    found = refs.resolve_column_refs(asked, keys)
    counts = found.groupBy("dataset_id", "source_table", "source_column", "target_table", "target_column", "resolved").agg(
        F.count(F.lit(1)).alias("n")
    )
    entries = _entries(spark, sf)
    pointers = filelist.missing_listed_files(entries, _inventory(spark, sf)).select(
        "dataset_id", F.lit("file.cio").alias("source_file"), F.col("line_no").alias("source_line"),
        F.col("classification").alias("source_column"), F.col("file_name").alias("referenced_file"),
    )
    missing = refs.missing_target_tables(found, every, _CHECKED)
    return report.preflight_report(
        report.index_stats(every, found), issues, pointers, missing, counts, refs.orphan_rows(every, found)
    )
