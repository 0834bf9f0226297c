"""Text renderings of tables, so that the text readers can be checked against the tables.

Everything is rendered row by row; line numbers come from ``with_ordinal``, so no table, file or key
passes through one task. The lines are written once, which stands for the text files of a corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linkfold.catalog import Catalog, Column as Col, ForeignKey, Table
from linkfold.functions.ordinals import with_ordinal
from linkfold.plans.corpus import load
from linkfold.session import durable

LINE = ["dataset_id", "file_name", "line_no", "raw"]


def words(*cells: str | Column) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cells])


def head_lines(files: DataFrame, *raws: str | Column) -> DataFrame:
    """The first lines of every file (``dataset_id, file_name`` and whatever the texts use)."""
    texts = [F.lit(r) if isinstance(r, str) else r for r in raws]
    return files.select("dataset_id", "file_name", F.posexplode(F.array(*texts)).alias("_i", "raw")).select(
        "dataset_id", "file_name", (F.col("_i") + 1).cast("bigint").alias("line_no"), "raw"
    )


def numbered(df: DataFrame, position: str, ties: list[str], after: int) -> DataFrame:
    """Body lines in ``position, ties`` order behind ``after`` head lines."""
    out = with_ordinal(df, ["dataset_id", "file_name"], position, "_nth", ties)
    return out.withColumn("line_no", F.col("_nth") + after).drop("_nth")


def files_of(body: DataFrame) -> DataFrame:
    return body.select("dataset_id", "file_name").distinct()


def write_files(lines: DataFrame, path: str) -> None:
    """Lines as files ``path/<dataset>/<file>`` in the session's file system; each file is written by one task.

    Spark names its files itself, so they are written below a folder of their own and renamed.
    """
    spark = lines.sparkSession
    own = f"{path}-parts"
    whole = lines.repartition("dataset_id", "file_name").sortWithinPartitions("dataset_id", "file_name", "line_no")
    whole.select("dataset_id", "file_name", F.col("raw").alias("value")).write.partitionBy("dataset_id", "file_name").text(own)
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(own).getFileSystem(spark._jsc.hadoopConfiguration())
    for dataset in system.listStatus(hadoop.Path(own)):
        if not dataset.isDirectory():
            continue
        folder = f"{path}/{dataset.getPath().getName().split('=', 1)[1]}"
        system.mkdirs(hadoop.Path(folder))
        for file in system.listStatus(dataset.getPath()):
            name = file.getPath().getName().split("=", 1)[1]
            for part in system.listStatus(file.getPath()):
                if part.getPath().getName().startswith("part-"):
                    system.rename(part.getPath(), hadoop.Path(f"{folder}/{name}"))


# --- one plain table ---------------------------------------------------------------

LINEITEM = Table(
    "lineitem",
    "lineitem.tbl",
    (
        Col("id", "AutoField"),
        Col("l_orderkey", "ForeignKeyField"),
        Col("l_linenumber", "IntegerField"),
        Col("l_partkey", "ForeignKeyField"),
        Col("l_quantity", "DoubleField"),
        Col("l_extendedprice", "DoubleField"),
        Col("l_discount", "DecimalField"),
        Col("l_linestatus"),
        Col("note"),
    ),
    (),
    (ForeignKey("l_partkey", "part"),),
)

#: The header names the columns in another order and in another case than the catalog.
LINEITEM_HEADER = ("L_PARTKEY", "l_orderkey", "l_linenumber", "L_Quantity", "l_extendedprice", "l_discount", "l_linestatus")


def lineitem_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One file per return flag: title, a count line, header, rows with uneven gaps."""
    body = load(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("dataset_id"),
        F.lit("lineitem.tbl").alias("file_name"),
        "l_orderkey",
        F.concat(F.lit("  "), F.concat_ws("   ", *[F.col(c.lower()).cast("string") for c in LINEITEM_HEADER])).alias("raw"),
    )
    body = numbered(body, "l_orderkey", ["raw"], 3).select(*LINE)
    return durable(head_lines(files_of(body), "lines of orders", "189", " ".join(LINEITEM_HEADER)).unionByName(body))


def text_catalog(*tables: Table) -> Catalog:
    return Catalog(tables=tables)


def bound(files: DataFrame, catalog: Catalog) -> DataFrame:
    """Files bound to the table of the same file name."""
    names = {t.file_name: t.table_name for t in catalog.tables}
    from linkfold.functions.text import lookup

    return files.select("dataset_id", "file_name").withColumn("schema_file", F.col("file_name")).withColumn(
        "table_name", lookup(F.col("file_name"), names)
    )


# --- orders as records with their lines as children -----------------------------------


def order_records(spark: SparkSession, sf: str, file_name: str, heads: list[str], main: Column, child: Column, kind: Column) -> DataFrame:
    """Orders as main lines, their line items as child lines, one dataset per order priority.

    ``main`` may use the order columns and ``lines``, ``auto_lines``, ``op_lines``; ``child`` the line
    item columns; ``kind`` orders the children of a record (0 or 1).
    """
    orders = load(spark, sf, "orders")
    items = load(spark, sf, "lineitem").withColumn("_kind", kind)
    counts = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("_kind") == 0).alias("auto_lines"), F.count_if(F.col("_kind") == 1).alias("op_lines")
    )
    priority = F.substring("o_orderpriority", 1, 1)
    mains = (
        orders.join(counts, "o_orderkey", "left")
        .fillna(0, ["lines", "auto_lines", "op_lines"])
        .select(priority.alias("dataset_id"), "o_orderkey", F.lit(-1).alias("_kind"), main.alias("raw"))
    )
    children = items.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey").select(
        priority.alias("dataset_id"), F.col("l_orderkey").alias("o_orderkey"), "_kind", child.alias("raw")
    )
    # Written before it is numbered, which reads it twice: the joins run once.
    body = durable(mains.unionByName(children)).withColumn("file_name", F.lit(file_name))
    body = numbered(body, "o_orderkey", ["_kind", "raw"], len(heads)).select(*LINE)
    return durable(head_lines(files_of(body), *heads).unionByName(body))


# --- outputs: one file per customer ---------------------------------------------------


def customer_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """One structured text output per customer with its orders as rows.

    Customers in debt have no units line; customers in building have a two-line title.
    """
    customer = load(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    name = F.concat(F.lit("cust_"), F.col("c_custkey").cast("string"), F.lit(".txt"))
    two = F.col("c_mktsegment") == "BUILDING"
    units = F.col("c_acctbal") >= 0
    top = customer.select(
        F.lit("main").alias("dataset_id"),
        name.alias("file_name"),
        F.concat(
            F.array(F.concat(F.lit("Orders of "), F.col("c_custkey").cast("string"))),
            F.when(two, F.array(F.lit("--yearly--"))).otherwise(F.array().cast("array<string>")),
            F.array(F.lit(" order status price")),
            F.when(units, F.array(F.lit(" - text usd/yr"))).otherwise(F.array().cast("array<string>")),
        ).alias("_heads"),
    )
    heads = top.select("dataset_id", "file_name", F.posexplode("_heads").alias("_i", "raw")).select(
        "dataset_id", "file_name", (F.col("_i") + 1).cast("bigint").alias("line_no"), "raw"
    )
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_totalprice")
    body = orders.join(customer, "c_custkey").select(
        F.lit("main").alias("dataset_id"),
        name.alias("file_name"),
        "o_orderkey",
        (F.lit(2) + two.cast("int") + units.cast("int")).alias("_after"),
        F.concat(F.lit("  "), words("o_orderkey", "o_orderstatus", "o_totalprice")).alias("raw"),
    )
    body = numbered(body, "o_orderkey", [], 0).withColumn("line_no", F.col("line_no") + F.col("_after"))
    return durable(heads.unionByName(body.select(*LINE)))


# --- a routed dataset -------------------------------------------------------------------


def routed_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as units that drain to customers (channels), which drain to nations (outlets).

    Ten units with neighbouring ids form a routing unit, written as a range.
    """
    lit, main = F.lit, F.lit("main").alias("dataset_id")
    orders = load(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("id"), (F.col("o_custkey") + 1).alias("cust"), "o_totalprice")
    customers = load(spark, sf, "customer").select((F.col("c_custkey") + 1).alias("id"), (F.col("c_nationkey").cast("bigint") + 1).alias("nation"))
    nations = load(spark, sf, "nation").select((F.col("n_nationkey").cast("bigint") + 1).alias("id"))
    tag = lambda prefix: F.concat(lit(prefix), F.col("id").cast("string"))
    connect_head = "id name gis_id area lat lon elev prop wst cst ovfl rule src_tot obj_typ obj_id hyd_typ frac"

    def connect(df: DataFrame, file: str, prefix: str, *targets: Column) -> DataFrame:
        raw = words("id", tag(prefix), "id", lit("1.5"), lit("40"), lit("-90"), lit("100"), "id", lit("sta"), lit("0"), lit("0"), lit("0"), *targets)
        return df.select(main, lit(file).alias("file_name"), "id", raw.alias("raw"))

    parts = [
        (connect(orders, "hru.con", "hru", lit("2"), lit("sdc"), F.col("cust"), lit("tot"), lit("1.0"), lit("out"), lit("999999"), lit("rhg"), lit("x")), connect_head),
        (connect(customers, "chandeg.con", "cha", lit("1"), lit("out"), F.col("nation"), lit("tot"), lit("0.25")), connect_head),
        (connect(nations, "outlet.con", "out", lit("0")), connect_head),
        (orders.select(main, lit("hru-data.hru").alias("file_name"), "id", words("id", tag("data"), "o_totalprice", lit("soil1")).alias("raw")), "id name topo soil"),
        (customers.select(main, lit("channel-lte.cha").alias("file_name"), "id", words("id", tag("lte"), "nation").alias("raw")), "id name nation"),
        (orders.select(main, lit("rout_unit.ele").alias("file_name"), "id", words("id", tag("el"), lit("hru"), "id", lit("1.0")).alias("raw")), "id name obj_typ obj_id frac"),
        (orders.select(main, lit("ls_unit.ele").alias("file_name"), "id", words("id", tag("ls"), lit("hru"), "id", lit("1.0")).alias("raw")), "id name obj_typ obj_typ_no frac"),
    ]
    blocks = orders.select(F.floor((F.col("id") - 1) / 10).alias("b")).distinct().select(
        (F.col("b") + 1).alias("id"), (F.col("b") * 10 + 1).alias("first"), F.concat(lit("-"), (F.col("b") * 10 + 10).cast("string")).alias("last")
    )
    parts += [
        (blocks.select(main, lit("rout_unit.def").alias("file_name"), "id", words("id", tag("rtu"), lit("2"), "first", "last").alias("raw")), "id name elem_tot elements"),
        (blocks.select(main, lit("rout_unit.rtu").alias("file_name"), "id", words("id", tag("rtu"), lit("dr1")).alias("raw")), "id name dr"),
        (connect(blocks, "rout_unit.con", "rtu", lit("1"), lit("out"), lit("3"), lit("tot"), lit("1.0")), connect_head),
    ]
    out = None
    for df, head in parts:
        body = numbered(df, "id", [], 2).select(*LINE)
        piece = head_lines(files_of(body), "title", head).unionByName(body)
        out = piece if out is None else out.unionByName(piece)
    land = blocks.select(main, lit("ls_unit.def").alias("file_name"), "id", words("id", tag("lsu"), lit("9.5"), lit("2"), "first", "last").alias("raw"))
    body = numbered(land, "id", [], 3).select(*LINE)
    out = out.unionByName(head_lines(files_of(body), "title", "7", "id name area elem_tot elements").unionByName(body))
    single = spark.range(1).select(
        main,
        F.inline(
            F.array(
                *[
                    F.struct(lit(f).alias("file_name"), lit(n).cast("bigint").alias("line_no"), lit(r).alias("raw"))
                    for f, n, r in (
                        ("object.cnt", 1, "object.cnt: written"),
                        ("object.cnt", 2, "name ls_area tot_area objs hru lhru rtu gwfl aqu cha res rec exco dlr can pmp out lcha aqu2d hrd wro"),
                        ("object.cnt", 3, "basin 10 10 99 99 0 5 0 3 0 0 0 0 0 0 0 25 150 0 0 0"),
                        ("file.cio", 1, "file.cio: written"),
                        ("file.cio", 2, "connect hru.con null rout_unit.con aquifer.con chandeg.con outlet.con"),
                        ("print.prt", 1, "print.prt: written"),
                        ("print.prt", 2, "lsunit_wb y y y y"),
                        ("print.prt", 3, "basin_wb y n y y"),
                    )
                ]
            )
        ),
    )
    return durable(out.unionByName(single))
