"""Registered queries that write text files of a corpus, index them from disk, and store what was found.

Every nation is a dataset: a folder with a master list, its customers under another spelling of the table's file name,
its orders with references, a file pointer and decision references, a file of decision tables and a weather file.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkfold.catalog import Catalog, Column as Col, ForeignKey, Table
from linkfold.functions import text
from linkfold.operators import checks, refs
from linkfold.plans import renderings as r
from linkfold.plans.corpus import load
from linkfold.plans.index import Index, build_index
from linkfold.plans.star_queries import query
from linkfold.session import durable, scratch_path
from linkfold.sources import filelist, lines as line_source, outputs, store

_ORDER_KEYS = (ForeignKey("cust", "cust_data_tbl"), ForeignKey("pcp", "pcp_cli"), ForeignKey("dtab", "lum_dtl"), ForeignKey("clerk", "clerk_tbl"))
CATALOG = Catalog(
    tables=(
        Table("cust_data_tbl", "cust-data.tbl", (Col("id", "AutoField"), Col("name"), Col("seg"), Col("bal", "DoubleField")), ("name",)),
        Table("orders_tbl", "orders.tbl", (Col("id", "AutoField"), Col("name"), *(Col(k.column, "ForeignKeyField") for k in _ORDER_KEYS)), ("name",), _ORDER_KEYS),
        Table("lum_dtl", "lum.dtl", (Col("id", "AutoField"), Col("name")), ("name",)),
        Table("weather_pcp", "weather-pcp.pcp", tuple(Col(c) for c in ("name", "nbyr", "tstep", "lat", "lon", "elev")), ("name",)),
    ),
    pointers={"orders.tbl": {"pcp": "*.pcp"}},
    table_files={"clerk_tbl": "clerk.tbl"},
    purposes={"clerk.tbl": "Clerks", "cust-data.tbl": "Customers"},
)


def corpus_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all files, ``dataset_id, file_name, line_no, raw``, with datasets ``n0`` to ``n24``."""
    dataset = lambda c: F.concat(F.lit("n"), F.col(c).cast("string")).alias("dataset_id")
    nations = load(spark, sf, "nation").select(dataset("n_nationkey"), F.col("n_nationkey").cast("string").alias("k"))
    customers = load(spark, sf, "customer")
    fixed = {
        "file.cio": (
            F.concat(F.lit("file.cio: written by Model+ editor v2."), "k", F.lit(".3 on 2024-05-01 10:30 for Model+ rev.60."), "k"),
            "simulation time.sim null",
            "connect cust_data.tbl orders.tbl lum.dtl",
            "climate p.pcp null",
        ),
        "lum.dtl": ("dtl", "3", "", *(x for k in (2, 3, 4) for x in ("NAME CONDS ALTS ACTS", f"d_{k} 0 0 0", "COND_VAR OBJ", "ACT_TYP OBJ", ""))),
        "p.pcp": (F.concat(F.lit(" gauge"), "k"), "nbyr tstep lat lon elev", "", " 2 0 40.0 -90.0 100", "2000 1 0.5", "2000 2 0.0"),
    }
    parts = [r.head_lines(nations.withColumn("file_name", F.lit(name)), *raws) for name, raws in fixed.items()]
    name = F.concat(F.lit("cust"), F.col("c_custkey").cast("string"))
    own = customers.select(dataset("c_nationkey"), F.lit("cust_data.tbl").alias("file_name"), "c_custkey", r.words(name, "c_mktsegment", "c_acctbal").alias("raw"))
    orders = load(spark, sf, "orders").join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    spelled = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("cust"), "o_custkey", F.lit("x"))).otherwise(F.concat(F.lit("CUST"), "o_custkey"))
    table = F.when(F.col("o_orderpriority") == "1-URGENT", "null").otherwise(F.concat(F.lit("d_"), F.substring("o_orderpriority", 1, 1)))
    clerk = F.when(F.col("o_totalprice") > 300000, F.concat(F.lit("clerk"), F.col("o_custkey").cast("string"))).otherwise("0")
    row = r.words(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), spelled, F.when(F.col("o_orderstatus") == "P", "gone.pcp").otherwise("p.pcp"), table, clerk)
    bought = orders.select(dataset("c_nationkey"), F.lit("orders.tbl").alias("file_name"), "o_orderkey", row.alias("raw"))
    for body, position, head in ((own, "c_custkey", "name seg bal"), (bought, "o_orderkey", "name cust pcp dtab clerk")):
        parts += [r.head_lines(r.files_of(body), "title", head), r.numbered(body, position, [], 2).select(*r.LINE)]
    return functools.reduce(DataFrame.unionByName, parts)


def corpus_folder(spark: SparkSession, sf: str) -> str:
    """The corpus as files on disk, one folder for each dataset."""
    path = scratch_path(spark, "corpus")
    r.write_files(corpus_lines(spark, sf), path)
    return path


def _index(spark: SparkSession, sf: str) -> Index:
    return build_index(spark, corpus_folder(spark, sf), CATALOG, include_weather=True)


def _named(df: DataFrame) -> DataFrame:
    """Datasets by their last folder."""
    return df.withColumn("dataset_id", F.element_at(F.split("dataset_id", "/"), -1))


_SQL = """nat AS (SELECT 'n' || n_nationkey AS dataset_id, n_nationkey AS k FROM nation),
cust AS (SELECT 'n' || c_nationkey AS dataset_id, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 2 AS line_no FROM customer),
ord AS (SELECT 'n' || c_nationkey AS dataset_id, o.*, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) + 2 AS line_no
  FROM orders o JOIN customer ON c_custkey = o_custkey),
files AS (SELECT dataset_id, f AS file_name FROM nat, (VALUES ('file.cio'), ('lum.dtl'), ('p.pcp')) v (f)
  UNION ALL SELECT DISTINCT dataset_id, 'cust_data.tbl' FROM cust UNION ALL SELECT DISTINCT dataset_id, 'orders.tbl' FROM ord),
rows_ AS (
  SELECT dataset_id, 'cust_data_tbl' AS table_name, 'cust_data.tbl' AS file_name, line_no, 'cust' || c_custkey AS pk_value FROM cust
  UNION ALL SELECT dataset_id, 'orders_tbl', 'orders.tbl', line_no, 'o' || o_orderkey FROM ord
  UNION ALL SELECT dataset_id, 'lum_dtl', 'lum.dtl', 5 * j, 'd_' || (j + 1) FROM nat, range(1, 4) g (j)
  UNION ALL SELECT dataset_id, 'weather_pcp', 'p.pcp', 4, 'gauge' || k FROM nat
  UNION ALL SELECT dataset_id, 'file_cio', 'file.cio', l, i::VARCHAR FROM nat, (VALUES (2, 1), (2, 2), (3, 3), (3, 4), (3, 5), (4, 6), (4, 7)) v (l, i)),
asked AS (
  SELECT dataset_id, line_no AS source_line, 'cust' AS source_column, CASE WHEN o_orderstatus = 'F' THEN 'cust' || o_custkey || 'x' ELSE 'CUST' || o_custkey END AS fk_value, 'cust_data_tbl' AS target_table FROM ord
  UNION ALL SELECT dataset_id, line_no, 'dtab', 'd_' || left(o_orderpriority, 1), 'lum_dtl' FROM ord WHERE o_orderpriority <> '1-URGENT'
  UNION ALL SELECT dataset_id, line_no, 'clerk', 'clerk' || o_custkey, 'clerk_tbl' FROM ord WHERE o_totalprice > 300000),
res AS (
  SELECT a.*, t.line_no AS target_line, t.line_no IS NOT NULL AS resolved FROM asked a
  LEFT JOIN rows_ t ON t.dataset_id = a.dataset_id AND t.table_name = a.target_table AND t.pk_value = lower(a.fk_value))"""


@query("corpus_inventory", f"WITH {_SQL} SELECT dataset_id, file_name, lower(file_name) AS file_name_lc, file_name AS rel_path FROM files")
def corpus_inventory(spark, sf):
    return _named(line_source.list_inventory(spark, corpus_folder(spark, sf))).select("dataset_id", "file_name", "file_name_lc", "rel_path")


@query(
    "corpus_bound_files",
    f"""WITH {_SQL} SELECT dataset_id, file_name, CASE file_name WHEN 'cust_data.tbl' THEN 'cust-data.tbl' ELSE file_name END AS schema_file,
      CASE file_name WHEN 'cust_data.tbl' THEN 'cust_data_tbl' WHEN 'orders.tbl' THEN 'orders_tbl' ELSE 'lum_dtl' END AS table_name
    FROM files WHERE file_name IN ('cust_data.tbl', 'orders.tbl', 'lum.dtl')""",
)
def corpus_bound_files(spark, sf):
    return _named(_index(spark, sf).bound).select("dataset_id", "file_name", "schema_file", "table_name")


@query("corpus_rows", f"WITH {_SQL} SELECT dataset_id, table_name, file_name, line_no::BIGINT AS line_no, pk_value FROM rows_")
def corpus_rows(spark, sf):
    """Rows of plain tables, decision tables, weather stations and master lists, read from files."""
    return _named(_index(spark, sf).rows).select("dataset_id", "table_name", "file_name", "line_no", "pk_value")


@query(
    "corpus_references",
    f"""WITH {_SQL} SELECT dataset_id, source_line::BIGINT AS source_line, source_column, fk_value, target_table, resolved,
      coalesce(target_line, 0)::BIGINT AS target_line FROM res""",
)
def corpus_references(spark, sf):
    """The pointer column has a reference in the catalog too, and gives none."""
    found = _named(_index(spark, sf).resolved)
    return found.select("dataset_id", "source_line", "source_column", "fk_value", "target_table", "resolved", F.coalesce("target_line", F.lit(0).cast("long")).alias("target_line"))


@query(
    "corpus_messages",
    f"""WITH {_SQL} SELECT dataset_id, source_line::BIGINT AS source_line, source_column, CASE target_table
      WHEN 'clerk_tbl' THEN '''' || fk_value || ''' refers to clerk.tbl (Clerks), which is not in the dataset'
      WHEN 'lum_dtl' THEN '''' || fk_value || ''' not found in lum.dtl'
      ELSE '''' || fk_value || ''' not found in cust-data.tbl (Customers)' END AS message FROM res WHERE NOT resolved""",
)
def corpus_messages(spark, sf):
    index = _index(spark, sf)
    return _named(refs.describe_refs(index.resolved, index.rows, CATALOG)).select("dataset_id", "source_line", "source_column", "message")


@query(
    "corpus_missing",
    f"""WITH {_SQL} SELECT dataset_id, line_no::BIGINT AS source_line, 'pcp' AS source_column, 'gone.pcp' AS missing FROM ord WHERE o_orderstatus = 'P'
    UNION ALL SELECT dataset_id, source_line, source_column, fk_value FROM res WHERE target_table = 'clerk_tbl'
    UNION ALL SELECT dataset_id, 2, 'simulation', 'time.sim' FROM nat""",
)
def corpus_missing(spark, sf):
    """Missing files of all three kinds: pointers, tables that references need, and files of the master list."""
    index = _index(spark, sf)
    pointers = refs.missing_file_pointers(index.rows, index.inventory, CATALOG).select("dataset_id", "source_line", "source_column", F.col("referenced_file").alias("missing"))
    targets = refs.missing_target_tables(index.resolved, index.rows, CATALOG).select("dataset_id", "source_line", "source_column", F.col("fk_value").alias("missing"))
    listed = filelist.missing_listed_files(index.entries, index.inventory).select("dataset_id", F.col("line_no").alias("source_line"), F.col("classification").alias("source_column"), F.col("file_name").alias("missing"))
    return _named(pointers.unionByName(targets).unionByName(listed))


@query(
    "corpus_suppressed",
    """SELECT o_orderkey AS source_line, c.source_column FROM orders, (VALUES ('pcp', 'p' || 1, FALSE), ('cust', 'x.y', TRUE), ('memo', 'plain', TRUE), ('memo', 'a.txt', FALSE)) c (source_column, v, stays) WHERE stays""",
)
def corpus_suppressed(spark, sf):
    """Unresolved references without those of pointer columns: with a pattern all, without one those with a dot."""
    cells = F.array(*[F.struct(F.lit(c).alias("source_column"), F.lit(v).alias("fk_value")) for c, v in (("PCP", "p1"), ("cust", "x.y"), ("memo", "plain"), ("memo", "a.txt"))])
    asked = load(spark, sf, "orders").select(F.lit("d").alias("dataset_id"), F.lit("/in/Orders.tbl").alias("source_file"), F.col("o_orderkey").alias("source_line"), F.inline(cells))
    catalog = Catalog(pointers={"orders.tbl": {"pcp": "*.pcp", "memo": None}})
    return refs.suppress_pointer_refs(asked, catalog).select("source_line", F.lower("source_column").alias("source_column"))


@query(
    "corpus_list_headers",
    """SELECT 'n' || n_nationkey AS dataset_id, '2.' || n_nationkey || '.3' AS editor_version, '60.' || n_nationkey AS model_revision, '2024-05-01 10:30' AS generated_on FROM nation""",
)
def corpus_list_headers(spark, sf):
    titles = corpus_lines(spark, sf).filter("file_name = 'file.cio' AND line_no = 1")
    return filelist.file_list_header(titles).drop("raw")


@query(
    "snapshot_lookup",
    f"""WITH {_SQL}, pick AS (SELECT dataset_id, pk_value, line_no FROM rows_ WHERE pk_value = (SELECT 'cust' || min(c_custkey) FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'))
    SELECT 'row' AS what, dataset_id, line_no::BIGINT AS line_no FROM pick
    UNION ALL SELECT 'reference', r.dataset_id, source_line FROM res r JOIN pick ON r.dataset_id = pick.dataset_id AND lower(fk_value) = pk_value WHERE resolved
    UNION ALL SELECT t, dataset_id, n FROM (SELECT 'rows' AS t, dataset_id, count(*) AS n FROM rows_ GROUP BY ALL UNION ALL SELECT 'resolved', dataset_id, count(*) FROM res GROUP BY ALL
      UNION ALL SELECT 'inventory', dataset_id, count(*) FROM files GROUP BY ALL)""",
)
def snapshot_lookup(spark, sf):
    """A whole index saved twice and loaded: one customer and what refers to them, and the sizes of its tables."""
    index = _index(spark, sf)
    path = scratch_path(spark, "snapshot")
    frames = {name: getattr(index, name) for name in store.LAYOUT}
    store.save_snapshot(frames, path)
    store.save_snapshot(frames, path)
    saved = store.load_snapshot(spark, path)
    first = load(spark, sf, "orders").filter("o_orderstatus <> 'F'").agg(F.min("o_custkey").alias("k")).first()["k"]
    dataset = index.rows.filter((F.col("table_name") == "cust_data_tbl") & (F.col("pk_lc") == f"cust{first}")).first()["dataset_id"]
    found = saved.row(dataset, "cust_data_tbl", f"Cust{first}").select(F.lit("row").alias("what"), "dataset_id", "line_no")
    asked = saved.references_to(dataset, "cust_data_tbl", f"cust{first}").select(F.lit("reference").alias("what"), "dataset_id", F.col("source_line").alias("line_no"))
    sizes = [saved.tables[t].groupBy("dataset_id").agg(F.count(F.lit(1)).alias("line_no")).select(F.lit(t).alias("what"), "dataset_id", "line_no") for t in ("rows", "resolved", "inventory")]
    return _named(functools.reduce(DataFrame.unionByName, [found, asked, *sizes]))


@query(
    "export_read_back",
    f"""WITH {_SQL} SELECT 'tables' AS part, dataset_id, count(*) AS n FROM rows_ GROUP BY ALL UNION ALL SELECT 'references', dataset_id, count(*) FROM res GROUP BY ALL
    UNION ALL SELECT 'unresolved', dataset_id, count(*) FROM res WHERE NOT resolved GROUP BY ALL""",
)
def export_read_back(spark, sf):
    index = _index(spark, sf)
    path = scratch_path(spark, "export")
    store.export_index(index.rows, index.resolved, index.stats(), path)
    read = lambda part: spark.read.json(f"{path}/{part}")
    counted = lambda df, part: df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "dataset_id", "n")
    stats = read("stats").select(F.lit("unresolved").alias("part"), "dataset_id", F.col("unresolved_count").alias("n")).filter("n > 0")
    return _named(counted(read("tables"), "tables").unionByName(counted(read("references"), "references")).unionByName(stats))


@query(
    "subset_files_read_back",
    f"""WITH {_SQL} SELECT dataset_id, 'orders.tbl' AS file_name, count(*) + 2 AS n, count(DISTINCT o_orderkey) + 2 AS texts FROM ord GROUP BY ALL
    UNION ALL SELECT dataset_id, 'cust_data.tbl', count(*) + 2, count(*) + 2 FROM cust GROUP BY ALL
    UNION ALL SELECT dataset_id, f, n, t FROM nat, (VALUES ('file.cio', 4, 4), ('lum.dtl', 18, 9), ('p.pcp', 6, 6)) v (f, n, t)""",
)
def subset_files_read_back(spark, sf):
    path = scratch_path(spark, "files")
    store.write_subset(corpus_lines(spark, sf), path)
    back = spark.read.text(path)
    return back.groupBy("dataset_id", "file_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("texts"))


@query(
    "record_sets_read_back",
    """SELECT lpad(rank::VARCHAR, 2, '0') || '_' || replace(t, ' ', '_') AS "set", user_id::VARCHAR AS event_id, k, n FROM (
      SELECT event_type || ' events' AS t, dense_rank() OVER (ORDER BY event_type) AS rank, '__row_type' AS user_id, 'header' AS k, 0::BIGINT AS n FROM events GROUP BY event_type
      UNION ALL SELECT event_type || ' events', dense_rank() OVER (ORDER BY event_type), user_id::VARCHAR, 'row', count(*) FROM events GROUP BY event_type, user_id) WHERE k = 'row'""",
)
def record_sets_read_back(spark, sf):
    """Events as one record set a type, written in one job and read back by their headers."""
    rows = load(spark, sf, "events").select(
        F.concat("event_type", F.lit(" events")).alias("title"),
        F.array(F.lit("event_id"), F.lit("said, by"), F.lit("value")).alias("columns"),
        F.array(F.lit("-"), F.lit("text"), F.lit('5"')).alias("units"),
        (F.col("event_id") + 1).alias("row_no"),
        F.array(F.col("event_id").cast("string"), F.concat(F.lit(' u,"'), F.col("user_id").cast("string"), F.lit('"')), F.col("value").cast("string")).alias("cells"),
    )
    path = scratch_path(spark, "sets")
    store.write_record_sets(rows, path)
    back = spark.read.option("header", "true").option("escape", '"').csv(path).filter("__row_type = 'data'")
    user = F.regexp_extract(F.col("`said, by`"), '^ u,"([0-9]+)"$', 1)
    return back.select("set", user.alias("event_id")).groupBy("set", "event_id").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit("row"))


@query(
    "output_file_names",
    """SELECT CASE o_orderstatus WHEN 'F' THEN 'f' || o_orderkey || '.out' ELSE 'Yield-' || o_orderkey % 3 || '.txt' END AS file_name, o_orderkey FROM orders
      WHERE o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_orderkey % 3 <> 1)""",
)
def output_file_names(spark, sf):
    """Which files are outputs: by ending, by the catalog's output tables, not those that the master list names."""
    status = F.col("o_orderstatus")
    name = F.when(status == "F", F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".out"))).when(
        status == "P", F.concat(F.lit("Yield-"), (F.col("o_orderkey") % 3).cast("string"), F.lit(".txt"))
    ).otherwise(F.concat(F.lit("c"), F.col("o_orderkey").cast("string"), F.lit(".con")))
    folder = F.concat(F.lit("d"), F.col("o_orderkey").cast("string"))
    inventory = load(spark, sf, "orders").select(folder.alias("dataset_id"), name.alias("file_name"), name.alias("rel_path"), F.concat_ws("/", folder, name).alias("path"))
    catalog = Catalog(tables=(Table("yield0", "yield_0.txt", model="output.yield"), Table("in2", "in.txt", model="input.in")))
    listed = inventory.filter(F.col("file_name") == "Yield-1.txt").select("dataset_id", F.lit("yield_1.txt").alias("file_name"))
    found = outputs.output_files(inventory, catalog, listed)
    return found.select("file_name", F.substring("dataset_id", 2, 20).cast("long").alias("o_orderkey"))


@query(
    "format_issues_scope",
    """SELECT 'c' || o_custkey AS dataset_id, 'orders.tbl' AS file_name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 2 AS line_no, o_orderstatus FROM orders QUALIFY o_orderstatus = 'O'""",
)
def format_issues_scope(spark, sf):
    """Bad cells in three files with the same lines: hierarchical files and lines behind ``#`` are not looked at."""
    columns = (Col("name"), Col("n", "IntegerField"), Col("status"))
    names = ("orders.tbl", "soils.sol", "plant.ini")
    catalog = Catalog(tables=tuple(Table(n.replace(".", "_"), n, columns, ("name",)) for n in names))
    mark = F.when(F.col("o_orderstatus") == "P", " # ").otherwise("")
    raw = F.concat(mark, r.words(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.when(F.col("o_orderstatus") == "F", "1").otherwise("bad"), "o_orderstatus"))
    body = load(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dataset_id"), F.explode(F.array(*map(F.lit, names))).alias("file_name"), "o_orderkey", "o_orderstatus", raw.alias("raw")
    )
    numbered = durable(r.numbered(body, "o_orderkey", [], 2))
    lines = durable(r.head_lines(r.files_of(numbered), "title", "name n status").unionByName(numbered.select(*r.LINE)))
    issues = checks.format_issues(lines, r.bound(r.files_of(lines), catalog), catalog)
    status = numbered.select("dataset_id", "file_name", "line_no", "o_orderstatus")
    return issues.join(status, ["dataset_id", "file_name", "line_no"], "left").select("dataset_id", "file_name", "line_no", "o_orderstatus")
