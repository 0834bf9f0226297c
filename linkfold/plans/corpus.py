"""Views of a star schema as a corpus: typed tables with foreign keys, and their text renderings."""

from __future__ import annotations

from pyspark.sql import Column as C, DataFrame, SparkSession, functions as F

from linkfold.catalog import Catalog, Column, ForeignKey, Table

STAR = Catalog(
    tables=(
        Table("region", "region.tbl", (Column("r_regionkey", "IntegerField", False, True), Column("r_name")), ("r_regionkey",)),
        Table(
            "nation",
            "nation.tbl",
            (Column("n_nationkey", "IntegerField", False, True), Column("n_name"), Column("n_regionkey", "ForeignKeyField")),
            ("n_nationkey",),
            (ForeignKey("n_regionkey", "region", "r_regionkey"),),
        ),
        Table(
            "customer",
            "customer.tbl",
            (
                Column("c_custkey", "IntegerField", False, True),
                Column("c_name"),
                Column("c_nationkey", "ForeignKeyField"),
                Column("c_acctbal", "DoubleField"),
                Column("c_mktsegment"),
            ),
            ("c_custkey",),
            (ForeignKey("c_nationkey", "nation", "n_nationkey"),),
        ),
        Table(
            "supplier",
            "supplier.tbl",
            (
                Column("s_suppkey", "IntegerField", False, True),
                Column("s_name"),
                Column("s_nationkey", "ForeignKeyField"),
                Column("s_acctbal", "DoubleField"),
            ),
            ("s_suppkey",),
            (ForeignKey("s_nationkey", "nation", "n_nationkey"),),
        ),
        Table(
            "part",
            "part.tbl",
            (
                Column("p_partkey", "IntegerField", False, True),
                Column("p_name"),
                Column("p_brand"),
                Column("p_type"),
                Column("p_size", "IntegerField"),
                Column("p_retailprice", "DoubleField"),
            ),
            ("p_partkey",),
        ),
        Table(
            "orders",
            "orders.tbl",
            (
                Column("o_orderkey", "IntegerField", False, True),
                Column("o_custkey", "ForeignKeyField", False),
                Column("o_orderstatus"),
                Column("o_totalprice", "DoubleField"),
                Column("o_orderpriority"),
            ),
            ("o_orderkey",),
            (ForeignKey("o_custkey", "customer", "c_custkey"),),
        ),
        Table(
            "lineitem",
            "lineitem.tbl",
            (
                Column("l_orderkey", "ForeignKeyField", False),
                Column("l_partkey", "ForeignKeyField", False),
                Column("l_suppkey", "ForeignKeyField", False),
                Column("l_linenumber", "IntegerField"),
                Column("l_quantity", "DoubleField"),
                Column("l_extendedprice", "DoubleField"),
                Column("l_returnflag"),
            ),
            (),
            (
                ForeignKey("l_orderkey", "orders", "o_orderkey"),
                ForeignKey("l_partkey", "part", "p_partkey"),
                ForeignKey("l_suppkey", "supplier", "s_suppkey"),
            ),
        ),
        Table("documents", "documents.tbl", (Column("doc_id", "IntegerField", False, True),), ("doc_id",)),
        Table(
            "labels",
            "labels.tbl",
            (Column("doc_id", "ForeignKeyField", False), Column("quality", "IntegerField")),
            (),
            (ForeignKey("doc_id", "documents", "doc_id"),),
        ),
    ),
    null_sentinels=("null", ""),
    reference_column="name",
)

#: Line of each row: its key, or for lines of an order a number built from order and position.
LINES = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": "l_orderkey * 10 + l_linenumber",
    "documents": "doc_id",
    "labels": "doc_id",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_of(name: str) -> C:
    return F.expr(LINES[name]).cast("bigint")


def star_keys(spark: SparkSession, sf_dir: str, active: dict[str, str] | None = None) -> DataFrame:
    """Unique keys of every table that has one; ``active`` keeps only rows meeting a predicate."""
    frames = []
    for table in STAR.tables:
        if not table.primary_keys:
            continue
        df = load(spark, sf_dir, table.table_name)
        if active and table.table_name in active:
            df = df.filter(active[table.table_name])
        frames.append(
            df.select(
                F.lit("main").alias("dataset_id"),
                F.lit(table.table_name).alias("table_name"),
                F.lower(F.col(table.primary_keys[0]).cast("string")).alias("pk_lc"),
                F.lit(table.file_name).alias("file_name"),
                line_of(table.table_name).alias("line_no"),
            )
        )
    return _union(frames)


def star_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkfold.operators.refs import extract_column_refs

    return _union(
        [
            extract_column_refs(
                load(spark, sf_dir, t.table_name), t.table_name, t.file_name, line_of(t.table_name), t.foreign_keys
            )
            for t in STAR.tables
            if t.foreign_keys
        ]
    )


def star_rows(spark: SparkSession, sf_dir: str, names: list[str], active: dict[str, str] | None = None) -> DataFrame:
    """Generic rows (cells as a string map) of the named tables."""
    frames = []
    for name in names:
        table = STAR.table(name)
        df = load(spark, sf_dir, name)
        if active and name in active:
            df = df.filter(active[name])
        cells = [F.coalesce(F.col(c.name).cast("string"), F.lit("")) for c in table.columns]
        key = F.col(table.primary_keys[0]).cast("string") if table.primary_keys else line_of(name).cast("string")
        frames.append(
            df.select(
                F.lit("main").alias("dataset_id"),
                F.lit(name).alias("table_name"),
                F.lit(table.file_name).alias("file_name"),
                line_of(name).alias("line_no"),
                key.alias("pk_value"),
                F.lower(key).alias("pk_lc"),
                F.map_from_arrays(F.array(*[F.lit(c.name) for c in table.columns]), F.array(*cells)).alias("values"),
            )
        )
    return _union(frames)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
