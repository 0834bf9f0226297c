"""References between rows: extraction, case-insensitive resolution, and lookups over the result.

Frames used here
----------------
rows   ``dataset_id, table_name, file_name, line_no, pk_value, pk_lc, values map<string,string>``
refs   ``dataset_id, source_file, source_table, source_line, source_column, fk_value, fk_lc,
       target_table, target_column``; resolution adds ``resolved, actual_target_table, target_file,
       target_line``
keys   ``dataset_id, table_name, pk_lc, file_name, line_no`` with one row per key
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from linkfold.catalog import Catalog, ForeignKey
from linkfold.functions import text

REF_COLUMNS = (
    "dataset_id",
    "source_file",
    "source_table",
    "source_line",
    "source_column",
    "fk_value",
    "fk_lc",
    "target_table",
    "target_column",
)


# --- extraction ------------------------------------------------------------


def extract_fk_refs(
    rows: DataFrame,
    catalog: Catalog,
    pointer_mode: str = "strict",
    sentinels: Sequence[str] | None = None,
) -> DataFrame:
    """References of generic rows, one output row per non-null reference cell.

    ``pointer_mode='strict'`` skips pointer columns that have a file pattern; ``'compat'`` skips
    every column listed as a pointer; ``'none'`` skips nothing. ``sentinels`` replaces the
    catalog's null values.
    """
    sentinels = catalog.null_sentinels if sentinels is None else sentinels
    spark = rows.sparkSession
    fks = catalog.foreign_keys_frame(spark)
    pointers = catalog.pointers_frame(spark)
    if pointer_mode == "strict":
        pointers = pointers.filter("has_pattern")
    elif pointer_mode == "none":
        pointers = pointers.limit(0)
    elif pointer_mode != "compat":
        raise ValueError(f"unknown pointer mode {pointer_mode!r}")
    fks = fks.join(
        pointers.select(F.col("pointer_file").alias("schema_file"), "column"),
        ["schema_file", "column"],
        "left_anti",
    )
    per_table = fks.groupBy("table_name").agg(
        F.collect_set(F.struct("column", "target_table")).alias("_fks")
    )
    cells = F.transform(
        "_fks",
        lambda fk: F.struct(
            fk["column"].alias("column"),
            fk["target_table"].alias("target"),
            F.try_element_at(F.col("values"), fk["column"]).alias("value"),
        ),
    )
    wanted = F.filter(
        cells, lambda c: c["value"].isNotNull() & ~text.is_sentinel(c["value"], sentinels)
    )
    return (
        rows.join(F.broadcast(per_table), "table_name")
        .select(
            "dataset_id",
            F.col("file_name").alias("source_file"),
            F.col("table_name").alias("source_table"),
            F.col("line_no").alias("source_line"),
            F.explode(wanted).alias("_c"),
        )
        .select(
            "dataset_id",
            "source_file",
            "source_table",
            "source_line",
            F.col("_c.column").alias("source_column"),
            F.col("_c.value").alias("fk_value"),
            F.lower("_c.value").alias("fk_lc"),
            F.col("_c.target").alias("target_table"),
            F.lit(catalog.reference_column).alias("target_column"),
        )
    )


def extract_column_refs(
    df: DataFrame,
    table_name: str,
    file_name: str,
    line: Column,
    foreign_keys: Sequence[ForeignKey],
    dataset_id: Column | None = None,
    null_sentinels: Sequence[str] = ("null", ""),
) -> DataFrame:
    """References of a typed table: only its reference columns are read, all in one pass."""
    cells = F.array(
        *[
            F.struct(
                F.lit(fk.column).alias("source_column"),
                F.col(fk.column).cast("string").alias("fk_value"),
                F.lit(fk.target_table).alias("target_table"),
                F.lit(fk.target_column).alias("target_column"),
            )
            for fk in foreign_keys
        ]
    )
    return (
        df.select(
            (dataset_id if dataset_id is not None else F.lit("main")).alias("dataset_id"),
            line.cast("bigint").alias("source_line"),
            F.inline(cells),
        )
        .filter(F.col("fk_value").isNotNull() & ~text.is_sentinel(F.col("fk_value"), null_sentinels))
        .select(
            "dataset_id",
            F.lit(file_name).alias("source_file"),
            F.lit(table_name).alias("source_table"),
            "source_line",
            "source_column",
            "fk_value",
            F.lower("fk_value").alias("fk_lc"),
            "target_table",
            "target_column",
        )
    )


def management_refs(children: DataFrame, catalog: Catalog) -> DataFrame:
    """References of schedule child lines.

    Automatic lines name a decision table; operation lines name a row of the table their type maps
    to (``op_ref``, the seventh token). Types are matched case-sensitively.
    """
    v = F.col("values")
    target = text.lookup(v["op_typ"], catalog.operation_targets)
    auto = v["section"] == "auto"
    return _child_refs(
        children,
        catalog,
        value=F.when(auto, v["d_table"]).otherwise(v["op_ref"]),
        label=F.when(auto, F.lit("auto_op_dtl")).otherwise(F.concat(F.lit("op_data1("), v["op_typ"], F.lit(")"))),
        target=F.when(auto, F.lit("lum_dtl")).otherwise(target),
    )


def dtl_action_refs(children: DataFrame, catalog: Catalog) -> DataFrame:
    """References of decision-table action lines, by action type."""
    v = F.col("values")
    target = F.when(v["section"] == "action", text.lookup(v["act_typ"], catalog.action_targets))
    return _child_refs(
        children,
        catalog,
        value=v["fp"],
        label=F.concat(F.lit("fp("), v["act_typ"], F.lit(")")),
        target=target,
    )


def _child_refs(children: DataFrame, catalog: Catalog, value: Column, label: Column, target: Column) -> DataFrame:
    # Generated columns: a filter on them is not moved below, where it would make the map of values for each of its terms.
    found = F.struct(label.alias("source_column"), value.alias("fk_value"), target.alias("target_table"))
    return (
        children.select("*", F.inline(F.array(found)))
        .filter(
            F.col("target_table").isNotNull()
            & F.col("fk_value").isNotNull()
            & ~text.is_sentinel(F.col("fk_value"), catalog.null_sentinels)
        )
        .select(
            "dataset_id",
            F.col("file_name").alias("source_file"),
            F.col("table_name").alias("source_table"),
            F.col("line_no").alias("source_line"),
            "source_column",
            "fk_value",
            F.lower("fk_value").alias("fk_lc"),
            "target_table",
            F.lit("name").alias("target_column"),
        )
    )


# --- resolution ------------------------------------------------------------


def last_wins_keys(rows: DataFrame, table_order: Column | None = None) -> DataFrame:
    """One row per key: of rows that share a key the last one stays.

    Partial aggregation keeps one candidate per key and task, so a hot key costs nothing extra.
    """
    rank = F.struct(
        (table_order if table_order is not None else F.lit(0)).alias("o"),
        F.col("line_no").alias("l"),
        F.col("file_name").alias("f"),
    )
    return (
        rows.groupBy("dataset_id", "table_name", "pk_lc")
        .agg(F.max(rank).alias("_last"))
        .select(
            "dataset_id",
            "table_name",
            "pk_lc",
            F.col("_last.f").alias("file_name"),
            F.col("_last.l").alias("line_no"),
        )
    )


def duplicate_keys(rows: DataFrame) -> DataFrame:
    """Keys that occur on more than one row, with their first and last line."""
    return (
        rows.groupBy("dataset_id", "table_name", "pk_lc")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min("line_no").alias("first_line"),
            F.max("line_no").alias("last_line"),
        )
        .filter("row_count > 1")
    )


def is_decision_ref() -> Column:
    """References that may resolve in any decision table file."""
    return F.contains("target_table", F.lit("dtl")) | (F.col("source_column") == "auto_op_dtl")


def resolve_refs(refs: DataFrame, rows: DataFrame, table_order: Column | None = None) -> DataFrame:
    """Left equi-join of references to the last row holding their key, ignoring case.

    Decision references search all decision tables and keep the table they were found in. Both kinds
    use one join: decision tables share a single lookup space.
    """
    space = F.when(F.contains("table_name", F.lit("dtl")), F.lit("*dtl"))
    # A decision key is looked up in all tables together, so the last table, then line, wins there.
    plain = last_wins_keys(rows).select(
        "dataset_id",
        F.col("table_name").alias("_space"),
        F.col("pk_lc").alias("fk_lc"),
        F.col("table_name").alias("_table"),
        F.col("file_name").alias("target_file"),
        F.col("line_no").alias("target_line"),
    )
    order = table_order if table_order is not None else F.col("table_name")
    decisions = (
        rows.filter(space.isNotNull())
        .groupBy("dataset_id", "pk_lc")
        .agg(F.max(F.struct(order.alias("o"), F.col("line_no").alias("l"), "table_name", "file_name")).alias("_k"))
        .select(
            "dataset_id",
            F.lit("*dtl").alias("_space"),
            F.col("pk_lc").alias("fk_lc"),
            F.col("_k.table_name").alias("_table"),
            F.col("_k.file_name").alias("target_file"),
            F.col("_k.l").alias("target_line"),
        )
    )
    targets = plain.unionByName(decisions)
    asked = refs.withColumn(
        "_space", F.when(is_decision_ref(), F.lit("*dtl")).otherwise(F.col("target_table"))
    )
    return _joined(asked, targets)


def resolve_column_refs(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """Resolution against keys already known to be unique (``dataset_id, table_name, pk_lc, ...``)."""
    targets = keys.select(
        "dataset_id",
        F.col("table_name").alias("_space"),
        F.col("pk_lc").alias("fk_lc"),
        F.col("table_name").alias("_table"),
        F.col("file_name").alias("target_file"),
        F.col("line_no").alias("target_line"),
    )
    return _joined(refs.withColumn("_space", F.col("target_table")), targets)


def _joined(refs: DataFrame, targets: DataFrame) -> DataFrame:
    # A sort compares the first key, so the one with most values leads.
    return (
        refs.join(targets, ["fk_lc", "_space", "dataset_id"], "left")
        .withColumn("resolved", F.col("_table").isNotNull())
        .withColumn("actual_target_table", F.coalesce("_table", "target_table"))
        .select(*REF_COLUMNS, "resolved", "actual_target_table", "target_file", "target_line")
    )


def resolved_counts(refs: DataFrame, keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals per ``by`` columns and key, resolved before being summed any further.

    References are first counted per key with map-side combine, so a key held by a third of all
    references crosses the network as a handful of rows and the join never sees the skew.
    """
    per_key = refs.groupBy("dataset_id", "target_table", "fk_lc", *by).agg(F.count(F.lit(1)).alias("n"))
    known = keys.select(
        "dataset_id", F.col("table_name").alias("target_table"), F.col("pk_lc").alias("fk_lc")
    ).withColumn("resolved", F.lit(True))
    return per_key.join(known, ["dataset_id", "target_table", "fk_lc"], "left").withColumn(
        "resolved", F.coalesce("resolved", F.lit(False))
    )


# --- lookups over references -----------------------------------------------


def unresolved_refs(resolved: DataFrame) -> DataFrame:
    return resolved.filter(~F.col("resolved"))


def refs_from_file(refs: DataFrame, path: str) -> DataFrame:
    return refs.filter(text.comparable_path(F.col("source_file")) == text.comparable_path(F.lit(path)))


def refs_for_line(refs: DataFrame, path: str, line_no: int) -> DataFrame:
    return refs_from_file(refs, path).filter(F.col("source_line") == line_no)


def row_by_id(rows: DataFrame, table_name: str, pk_value: str) -> DataFrame:
    """Rows of a table by their key, ignoring case."""
    return rows.filter((F.col("table_name") == table_name) & (F.col("pk_lc") == pk_value.lower()))


def references_to_row(resolved: DataFrame, table_name: str, pk_value: str) -> DataFrame:
    """Reverse lookup: references that landed on a row."""
    return resolved.filter(
        F.col("resolved") & (F.col("actual_target_table") == table_name) & (F.col("fk_lc") == pk_value.lower())
    )


def references_to_rows(resolved: DataFrame, wanted: DataFrame) -> DataFrame:
    """Reverse lookup for a frame of ``dataset_id, table_name, pk_lc``."""
    named = wanted.select(
        "dataset_id", F.col("table_name").alias("actual_target_table"), F.col("pk_lc").alias("fk_lc")
    )
    return resolved.filter("resolved").join(named, ["dataset_id", "actual_target_table", "fk_lc"], "left_semi")


def peek_row(resolved: DataFrame, rows: DataFrame) -> DataFrame:
    """References with the cells of their target row."""
    target = rows.select(
        "dataset_id",
        F.col("table_name").alias("actual_target_table"),
        F.col("file_name").alias("target_file"),
        F.col("line_no").alias("target_line"),
        F.col("values").alias("target_values"),
    )
    return resolved.filter("resolved").join(
        target, ["dataset_id", "actual_target_table", "target_file", "target_line"]
    )


def related_rows(rows: DataFrame, table_name: str, column: str, fk_value: str | Column) -> DataFrame:
    """Rows of a table whose reference column holds a value (exact case)."""
    return rows.filter(
        (F.col("table_name") == table_name) & (F.try_element_at("values", F.lit(column)) == fk_value)
    )


def missing_target_tables(resolved: DataFrame, rows: DataFrame, catalog: Catalog) -> DataFrame:
    """Unresolved references whose target table has no rows at all in the dataset."""
    indexed = rows.select("dataset_id", F.col("table_name").alias("target_table")).distinct()
    files = {t.table_name: t.file_name for t in catalog.tables} | dict(catalog.table_files)
    return (
        unresolved_refs(resolved)
        .join(indexed, ["dataset_id", "target_table"], "left_anti")
        .withColumn("target_file", text.lookup(F.col("target_table"), files, F.col("target_table")))
    )


def missing_file_pointers(rows: DataFrame, inventory: DataFrame, catalog: Catalog) -> DataFrame:
    """Pointer cells that name a file the dataset does not have.

    Columns with a file pattern always count; other pointer columns only when the value has a dot.
    """
    pointers = catalog.pointers_frame(rows.sparkSession)
    files = {t.table_name: t.file_name for t in catalog.tables}
    cells = (
        rows.withColumn("pointer_file", text.lookup(F.col("table_name"), files, F.col("file_name")))
        .join(pointers, "pointer_file")
        .withColumn("referenced_file", F.try_element_at("values", F.col("column")))
    )
    asked = cells.filter(
        F.col("referenced_file").rlike(r"\S")
        & ~text.is_sentinel(F.col("referenced_file"), catalog.null_sentinels)
        & (F.col("has_pattern") | F.contains("referenced_file", F.lit(".")))
    )
    present = inventory.select("dataset_id", F.col("file_name").alias("referenced_file"))
    return asked.join(present, ["dataset_id", "referenced_file"], "left_anti").select(
        "dataset_id",
        F.col("file_name").alias("source_file"),
        F.col("table_name").alias("source_table"),
        F.col("line_no").alias("source_line"),
        F.col("column").alias("source_column"),
        "referenced_file",
        "note",
    )


def suppress_pointer_refs(unresolved: DataFrame, catalog: Catalog) -> DataFrame:
    """Unresolved references without those that are really file pointers."""
    pointers = catalog.pointers_frame(unresolved.sparkSession).select(
        F.lower("pointer_file").alias("_file"), F.lower("column").alias("_column"), "has_pattern"
    )
    condition = (
        (F.lower(text.base_name(F.col("source_file"))) == F.col("_file"))
        & (F.lower("source_column") == F.col("_column"))
        & (F.col("has_pattern") | F.contains("fk_value", F.lit(".")))
    )
    return unresolved.join(pointers, condition, "left_anti")


def orphan_rows(rows: DataFrame, refs: DataFrame, include_child_refs: DataFrame | None = None) -> DataFrame:
    """Rows that nothing refers to and that refer to nothing, by table then line.

    ``refs`` need not be resolved: a row that some reference names is referred to. References to
    decision tables may name a key of any of them, so those count for all.

    References found on child lines carry the child's line; pass ``include_child_refs``
    (``dataset_id, file_name, line_no, main_line``) to credit them to the main row.
    """
    outbound = refs.select(
        "dataset_id",
        F.col("source_table").alias("table_name"),
        F.col("source_file").alias("file_name"),
        F.col("source_line").alias("line_no"),
    ).distinct()
    if include_child_refs is not None:
        lifted = outbound.join(include_child_refs, ["dataset_id", "file_name", "line_no"]).select(
            "dataset_id", "table_name", "file_name", F.col("main_line").alias("line_no")
        )
        outbound = outbound.unionByName(lifted).distinct()
    space = lambda table, shared: F.when(shared, F.lit("*dtl")).otherwise(F.col(table))
    inbound = refs.select(
        "dataset_id", space("target_table", is_decision_ref()).alias("_space"), F.col("fk_lc").alias("pk_lc")
    ).distinct()
    return (
        rows.join(outbound, ["dataset_id", "table_name", "file_name", "line_no"], "left_anti")
        .withColumn("_space", space("table_name", F.contains("table_name", F.lit("dtl"))))
        .join(inbound, ["dataset_id", "_space", "pk_lc"], "left_anti")
        .drop("_space")
    )


def describe_refs(resolved: DataFrame, rows: DataFrame, catalog: Catalog) -> DataFrame:
    """Message per unresolved reference: the target table is missing, or only the value is."""
    files = {t.table_name: t.file_name for t in catalog.tables} | dict(catalog.table_files)
    indexed = (
        rows.select("dataset_id", F.col("table_name").alias("target_table"))
        .distinct()
        .withColumn("_indexed", F.lit(True))
    )
    file = text.lookup(F.col("target_table"), files, F.col("target_table"))
    purpose = text.lookup(F.col("_file"), catalog.purposes, F.lit(""))
    hint = F.when(F.col("_purpose") == "", F.lit("")).otherwise(
        F.concat(F.lit(" ("), F.col("_purpose"), F.lit(")"))
    )
    missing_value = F.format_string("'%s' not found in %s%s", "fk_value", "_file", hint)
    missing_file = F.format_string("'%s' refers to %s%s, which is not in the dataset", "fk_value", "_file", hint)
    return (
        unresolved_refs(resolved)
        .join(indexed, ["dataset_id", "target_table"], "left")
        .withColumn("_file", file)
        .withColumn("_purpose", purpose)
        .withColumn("message", F.when(F.col("_indexed"), missing_value).otherwise(missing_file))
        .drop("_indexed", "_file", "_purpose")
    )


def describe_table(spark, catalog: Catalog, table_name: str | None = None) -> DataFrame:
    """Columns of a table with key, reference target, pointer pattern and nullability."""
    columns = catalog.columns_frame(spark)
    if table_name:
        columns = columns.filter(F.col("table_name") == table_name)
    fks = catalog.foreign_keys_frame(spark).select("schema_file", "column", "target_table", "target_column")
    pointers = catalog.pointers_frame(spark).select(
        F.col("pointer_file").alias("schema_file"), "column", F.lit(True).alias("is_pointer"), "pattern", "note"
    )
    return (
        columns.filter("type <> 'AutoField'")
        .join(fks, ["schema_file", "column"], "left")
        .join(pointers, ["schema_file", "column"], "left")
        .withColumn("is_pointer", F.coalesce("is_pointer", F.lit(False)))
    )


def position_refs(refs: DataFrame, lines: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """References with the place their value stands in its line (``col_start``, ``col_end``).

    With resolved headers that is the place of the reference's column, so equal values in other columns
    are not taken for it; otherwise, as for child lines, the first token that equals the value.
    """
    spans = lines.select(
        "dataset_id",
        F.col("file_name").alias("source_file"),
        F.col("line_no").alias("source_line"),
        text.token_spans(F.col("raw")).alias("_spans"),
    )
    hit = F.get(F.filter("_spans", lambda s: s["token"] == F.col("fk_value")), F.lit(0))
    found = refs.join(spans, ["dataset_id", "source_file", "source_line"])
    if headers is not None:
        places = headers.select("dataset_id", F.col("file_name").alias("source_file"), "cell_names", "cell_at")
        found = found.join(places, ["dataset_id", "source_file"], "left")
        own = F.get("_spans", F.get("cell_at", F.array_position("cell_names", F.col("source_column")).cast("int") - 1))
        hit = F.coalesce(F.when(own["token"] == F.col("fk_value"), own), hit)
        found = found.withColumn("_place", hit).drop("cell_names", "cell_at")
        hit = F.col("_place")
    return (
        found.withColumn("_hit", hit)
        .withColumn("col_start", F.col("_hit.col_start"))
        .withColumn("col_end", F.col("_hit.col_end"))
        .drop("_spans", "_hit", "_place")
    )


def target_at(positioned: DataFrame, asked: DataFrame) -> DataFrame:
    """Targets under text positions ``dataset_id, source_file, source_line, char``."""
    return positioned.join(asked, ["dataset_id", "source_file", "source_line"]).filter(
        (F.col("char") >= F.col("col_start")) & (F.col("char") <= F.col("col_end"))
    )
