"""Plain and hierarchical text tables as generic rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkfold.catalog import Catalog
from linkfold.functions import text
from linkfold.functions.ordinals import explode_upto, with_ordinal
from linkfold.operators.chain import on_chain
from linkfold.session import attached, durable

FILE = ["dataset_id", "file_name"]


def normalized_header(line: Column, file_name: Column, catalog: Catalog) -> Column:
    """Lower-cased header tokens with the file's own spellings mapped to column names."""
    pairs = {f"{file.lower()}|{old}": new for file, names in catalog.aliases.items() for old, new in names.items()}
    low = F.lower(file_name)
    return F.transform(
        text.tokens(F.lower(line)), lambda t: text.lookup(F.concat(low, F.lit("|"), t), pairs, t)
    )


def resolve_header(lines: DataFrame, bound: DataFrame, catalog: Catalog) -> DataFrame:
    """Column list and first data line of every bound file, one row per file.

    The header line decides the columns when at least one of its tokens is a known column. A count
    standing alone in the header slot moves header and data down by one line if the next line fits
    the catalog better. Adds ``header_line, data_line`` (1-based, the first line that may hold data),
    ``header_columns``, ``columns`` and ``key_column``. The result, one row per file, is computed here
    and marked for broadcast while it is small enough.
    """
    spark = lines.sparkSession
    files = attached(bound.join(catalog.tables_frame(spark), ["table_name", "schema_file"]))
    slot = F.greatest(F.col("data_starts_after"), F.lit(1))
    heads = (
        lines.join(files.select(*FILE, slot.alias("_slot")), FILE)
        .filter(F.col("line_no").between(F.col("_slot"), F.col("_slot") + 1))
        .groupBy(*FILE)
        .agg(
            F.max(F.when(F.col("line_no") == F.col("_slot"), F.col("raw"))).alias("_first"),
            F.max(F.when(F.col("line_no") == F.col("_slot") + 1, F.col("raw"))).alias("_second"),
        )
    )
    known = F.col("all_columns")

    def header(column: str) -> Column:
        return normalized_header(F.coalesce(F.col(column), F.lit("")), F.col("file_name"), catalog)

    def matches(tokens: Column) -> Column:
        return F.size(F.filter(tokens, lambda t: F.array_contains(known, t)))

    shifted = F.coalesce(
        F.trim("_first").rlike("^[0-9]+$") & (matches(F.col("_h2")) > matches(F.col("_h1"))), F.lit(False)
    )
    resolved = (
        files.join(heads, FILE, "left")
        .withColumn("_h1", header("_first"))
        .withColumn("_h2", header("_second"))
        .withColumn("shifted", F.col("has_header") & shifted)
        .withColumn("header_line", slot.cast("bigint") + F.col("shifted").cast("int"))
        # Without a count line the data starts where the catalog says, header or not.
        .withColumn(
            "data_line",
            F.when(F.col("shifted"), F.col("header_line")).otherwise(F.col("data_starts_after").cast("bigint")) + 1,
        )
        .withColumn("header_columns", F.when(F.col("shifted"), F.col("_h2")).otherwise(F.col("_h1")))
        .withColumn(
            "columns",
            F.when(F.col("has_header") & (matches(F.col("header_columns")) > 0), F.col("header_columns")).otherwise(
                F.col("columns")
            ),
        )
        .withColumn("header_raw", F.when(F.col("shifted"), F.col("_second")).otherwise(F.col("_first")))
        .drop("_h1", "_h2", "_first", "_second")
    )
    placed = resolved.withColumn("_places", cell_places(F.col("columns"))).withColumn("key_column", key_column())
    placed = _with_counts(placed, catalog)
    return attached(
        placed.withColumn("cell_names", F.col("_places.name")).withColumn("cell_at", F.col("_places.at")).drop("_places")
    )


def key_column() -> Column:
    """Column a file's keys come from: the catalog's first key, else ``name``, else ``filename``."""
    has = lambda c: F.array_contains(F.col("columns"), c)
    return (
        F.when(F.col("pk_column").isNotNull() & has(F.col("pk_column")), F.col("pk_column"))
        .when(has(F.lit("name")), F.lit("name"))
        .when(has(F.lit("filename")), F.lit("filename"))
    )


def cell_places(columns: Column) -> Column:
    """Distinct column names with the 0-based place of their cell; a repeated name keeps its last."""
    placed = F.transform(columns, lambda c, i: F.struct(c.alias("name"), i.alias("at")))
    return F.filter(placed, lambda e: ~F.array_contains(F.slice(columns, e["at"] + 2, F.size(columns)), e["name"]))


def cell_map() -> Column:
    """Cells by column name: missing cells empty, surplus dropped. The places come with the file."""
    return F.map_from_arrays("cell_names", F.transform("cell_at", lambda i: F.coalesce(F.get("tokens", i), F.lit(""))))


def table_lines(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Data lines of bound files, split into tokens and named cells."""
    info = headers.select(
        *FILE, "table_name", "schema_file", "cell_names", "cell_at", "data_line", "key_column",
        "count_fixed", "count_times", "count_second", "count_at",
    )
    return (
        lines.join(info, FILE)
        .filter((F.col("line_no") >= F.col("data_line")) & ~F.col("schema_file").endswith(".dtl"))
        .withColumn("tokens", text.tokens(F.col("raw")))
    )


def parse_tables(lines: DataFrame, headers: DataFrame, catalog: Catalog) -> DataFrame:
    """Main rows of all bound tables: the generic ``rows`` frame.

    Plain tables are parsed line by line without any shuffle beyond the header join. Files with
    counted records go through the chain of record starts first.
    """
    parsed = table_lines(lines, headers)
    counted = counted_files(catalog)
    plain = parsed.filter(~F.col("schema_file").isin(counted)).filter(F.size("tokens") > 0)
    soils = [f for f, layout in catalog.layouts.items() if layout.heuristic == "soils"]
    plain = plain.filter(~F.col("schema_file").isin(soils) | is_soil_main(F.col("tokens")))
    mains = plain.select(*_row_columns())
    if counted and not headers.filter(F.col("schema_file").isin(counted)).isEmpty():
        mains = mains.unionByName(main_lines(parsed, headers, catalog).select(*_row_columns()))
    return assign_keys(mains, ordinals=not headers.filter("key_column is null").isEmpty())


def counted_files(catalog: Catalog) -> list[str]:
    """Schema files with counted records; the bound file may be spelled in another way."""
    possible = {v for t in catalog.tables for v in _spellings(t.file_name, catalog.table_files.get(t.table_name))}
    return [f for f, layout in catalog.layouts.items() if layout.counted and f in possible]


def _spellings(*names: str | None) -> set[str]:
    return {v for n in names if n for v in (n, n.replace("-", "_"), n.replace("_", "-"))}


def _row_columns() -> list:
    return [
        *FILE,
        "table_name",
        "schema_file",
        "line_no",
        "key_column",
        cell_map().alias("values"),
        "tokens",
    ]


def assign_keys(mains: DataFrame, ordinals: bool = True) -> DataFrame:
    """Key of each row: its cell in the file's key column, else its 0-based ordinal in the file.

    ``ordinals=False`` says that every file has a key column, and saves numbering the rows.
    """
    columns = ["dataset_id", "table_name", "file_name", "line_no", "pk_value", "values", "tokens", "schema_file"]
    keyed = mains.filter("key_column is not null").withColumn(
        "pk_value", F.try_element_at("values", F.col("key_column"))
    )
    rows = keyed.select(*columns)
    if ordinals:
        loose = with_ordinal(mains.filter("key_column is null"), FILE, "line_no", "_n")
        rows = rows.unionByName(loose.withColumn("pk_value", (F.col("_n") - 1).cast("string")).select(*columns))
    return rows.withColumn("pk_lc", F.lower("pk_value")).select(
        "dataset_id", "table_name", "file_name", "line_no", "pk_value", "pk_lc", "values", "tokens", "schema_file"
    )


# --- hierarchical records ----------------------------------------------------


def is_soil_main(tokens: Column) -> Column:
    """A profile line: an integer second token and a third of letters only."""
    return (
        (F.size(tokens) >= 3)
        & F.coalesce(F.get(tokens, F.lit(1)).rlike(text.INTEGER), F.lit(False))
        & F.coalesce(F.get(tokens, F.lit(2)).rlike(r"^\p{L}+$"), F.lit(False))
    )


def _with_counts(files: DataFrame, catalog: Catalog) -> DataFrame:
    """Per file, where its child line counts come from: a fixed number, or cells to add up."""
    counted = {f: layout for f, layout in catalog.layouts.items() if layout.counted}
    name = F.col("schema_file")

    def setting(values: dict[str, str], default: str) -> Column:
        return text.lookup(name, values, F.lit(default))

    fields = F.split(setting({f: "+".join(x.fields) for f, x in counted.items()}, ""), r"\+")
    places = F.transform(
        F.filter("_places", lambda e: F.array_contains(fields, e["name"])), lambda e: e["at"]
    )
    return (
        files.withColumn("count_fixed", setting({f: str(x.fixed) for f, x in counted.items()}, "0").cast("bigint"))
        .withColumn("count_times", setting({f: str(x.multiplier) for f, x in counted.items()}, "1").cast("bigint"))
        .withColumn("count_second", setting({f: "y" for f, x in counted.items() if x.heuristic == "plants"}, "n") == "y")
        .withColumn("count_at", places)
    )


def child_count() -> Column:
    """Child lines claimed by a line read as a main record, as many as it says.

    Null when the line is no main record: in files that fall back on their second token, a line
    that neither states a count nor has an integer there.
    """
    # No file has 2**40 lines: a larger count only must not overflow.
    positive = lambda v: F.least(F.greatest(F.coalesce(text.integer(v), F.lit(0)), F.lit(0)), F.lit(1 << 40))
    stated = F.aggregate(
        "count_at", F.lit(0).cast("bigint"), lambda total, at: total + positive(F.get("tokens", at))
    )
    count = F.when(F.col("count_fixed") > 0, F.col("count_fixed")).otherwise(stated * F.col("count_times"))
    second = text.integer(F.get("tokens", F.lit(1)))
    fallback = F.when(second.isNotNull(), positive(F.get("tokens", F.lit(1))))
    return text.bind(count, lambda n: F.when(F.col("count_second") & (n <= 0), fallback).otherwise(n))


def main_lines(parsed: DataFrame, headers: DataFrame, catalog: Catalog) -> DataFrame:
    """Record starts of the counted files, with ``children`` (lines that belong to the record)."""
    counted = counted_files(catalog)
    with_children = lambda df: df.withColumn("children", F.when(F.size("tokens") > 0, child_count()))
    own = parsed.filter(F.col("schema_file").isin(counted))
    inside = with_children(own)
    nodes = inside.select(
        *FILE,
        F.col("line_no").alias("pos"),
        (F.col("line_no") + 1 + F.coalesce("children", F.lit(0))).alias("nxt"),
    )
    starts = headers.filter(F.col("schema_file").isin(counted)).select(*FILE, F.col("data_line").alias("pos"))
    # The main lines are used more than once; the chain is followed once.
    reached = attached(on_chain(nodes, FILE, starts).withColumnRenamed("pos", "line_no"))
    # Lines are shuffled without their cells, and those reached are written once.
    met = durable(own.drop("tokens").join(reached, [*FILE, "line_no"], "left_semi"))
    return with_children(met.withColumn("tokens", text.tokens(F.col("raw")))).filter("children is not null")


def child_lines(mains: DataFrame, lines: DataFrame, count: Column, skip: int = 0) -> DataFrame:
    """Lines ``1 .. count`` below each main line, after ``skip`` lines, with their ordinal.

    Only lines of the mains' files take part, and no count goes beyond a file's last line. The wanted line
    numbers are listed per record and joined by equality; no range join, no window.
    Columns: the keys, ``main_line``, ``ord`` (1-based), ``line_no``, ``tokens``, and the mains' other
    columns.
    """
    files = attached(mains.select(*FILE).distinct())
    body = lines.join(files, FILE).select(*FILE, "line_no", "raw")
    ends = attached(body.groupBy(*FILE).agg(F.max("line_no").alias("_last")))
    counted = (
        mains.withColumn("_wanted", count.cast("bigint"))
        .join(ends, FILE)
        .withColumnRenamed("line_no", "main_line")
        .drop("tokens", "values", "schema_file")
    )
    there = F.least(F.col("_wanted"), F.col("_last") - F.col("main_line") - F.lit(skip))
    wanted = explode_upto(counted, there, "ord").drop("_wanted", "_last")
    wanted = wanted.withColumn("line_no", F.col("main_line") + F.col("ord") + F.lit(skip)).withColumn("ord", F.col("ord").cast("int"))
    # Lines travel as they are and are split behind the join.
    return wanted.join(body, [*FILE, "line_no"]).withColumn("tokens", text.tokens(F.col("raw")))


def nest_children(mains: DataFrame, children: DataFrame) -> DataFrame:
    """Rows with their children as an array; meant for records of a size that fits a row."""
    nested = children.groupBy(*FILE, F.col("main_line").alias("line_no")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("at"), "values"))).alias("_c")
    )
    return mains.join(nested, [*FILE, "line_no"], "left").withColumn(
        "children",
        F.transform("_c", lambda c: F.struct(c["at"].alias("line_no"), c["values"].alias("values"))),
    ).drop("_c")
