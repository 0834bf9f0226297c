"""Counts and reports over rows, references and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from linkfold.functions import text
from linkfold.functions.ordinals import with_sorted_ordinal
from linkfold.session import durable


def index_stats(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Tables, distinct keys, references, resolved and unresolved, per dataset."""
    per_table = rows.groupBy("dataset_id", "table_name", "pk_lc").agg(F.lit(1).alias("_one"))
    tables = per_table.groupBy("dataset_id", "table_name").agg(F.count(F.lit(1)).alias("_rows"))
    left = tables.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("table_count"), F.sum("_rows").alias("row_count")
    )
    right = resolved.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("fk_count"), F.count_if("resolved").alias("resolved_count")
    )
    joined = left.join(right, "dataset_id", "full")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("table_count", "row_count", "fk_count", "resolved_count")]
    return joined.select("dataset_id", *counts).withColumn(
        "unresolved_count", F.col("fk_count") - F.col("resolved_count")
    )


def dependency_edges(counted: DataFrame) -> DataFrame:
    """Table-to-table edges from ``resolved_counts(..., by=['source_table', 'source_column'])``."""
    by_column = counted.groupBy("dataset_id", "source_table", "target_table", "source_column").agg(
        F.sum("n").alias("_n"), F.sum(F.when(F.col("resolved"), F.col("n")).otherwise(0)).alias("_ok")
    )
    return (
        by_column.groupBy("dataset_id", "source_table", "target_table")
        .agg(
            F.sum("_n").alias("total"),
            F.sum("_ok").alias("resolved"),
            F.array_join(F.array_sort(F.collect_set("source_column")), ", ").alias("columns"),
        )
        .withColumn("unresolved", F.col("total") - F.col("resolved"))
        .orderBy(F.desc("total"), "source_table", "target_table")
    )


def unresolved_by(counted: DataFrame, table: str, column: str, k: int | None = None) -> DataFrame:
    """Most frequent ``table.column`` among unresolved references, per dataset.

    ``counted`` has the named columns, ``n`` and ``resolved``.
    """
    totals = (
        counted.filter(~F.col("resolved"))
        .groupBy("dataset_id", F.concat_ws(".", table, column).alias("name"))
        .agg(F.sum("n").alias("unresolved_count"))
    )
    return top_k(totals, ["dataset_id"], [F.desc("unresolved_count"), F.asc("name")], k)


def top_k(df: DataFrame, keys: list[str], order: list, k: int | None = None) -> DataFrame:
    """Rows ranked per key: the first ``k``, which every task cuts before the shuffle, or all, by one sort over ranges."""
    if k is None:
        return with_sorted_ordinal(df, keys, order, "rank")
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col("rank") <= k)


def outbound_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("dataset_id", "source_table", "source_file", "source_line").agg(
        F.count(F.lit(1)).alias("outbound")
    )


def refs_by_file(resolved: DataFrame) -> DataFrame:
    """References per source file name."""
    return resolved.groupBy("dataset_id", text.base_name(F.col("source_file")).alias("file")).agg(
        F.count(F.lit(1)).alias("refs"),
        F.count_if("resolved").alias("resolved"),
        F.count_if(~F.col("resolved")).alias("unresolved"),
    )


def table_issue_counts(resolved: DataFrame) -> DataFrame:
    """Unresolved values per source column and target table.

    Feed it references extracted with ``pointer_mode='none', sentinels=('',)`` to count every
    non-empty cell, null words included, the way a table view does.
    """
    return (
        resolved.filter(~F.col("resolved"))
        .groupBy("dataset_id", "source_table", "source_column", "target_table")
        .agg(F.count(F.lit(1)).alias("unresolved_values"))
    )


def required_fk_missing(rows: DataFrame, catalog) -> DataFrame:
    """Empty cells in reference columns that must not be empty."""
    spark = rows.sparkSession
    fks = catalog.foreign_keys_frame(spark)
    required = catalog.columns_frame(spark).filter("not nullable").select("schema_file", "column")
    needed = fks.join(required, ["schema_file", "column"]).select("table_name", "column", "target_table")
    cell = F.try_element_at("values", F.col("column"))
    return (
        rows.join(F.broadcast(needed), "table_name")
        .filter(cell.isNull() | (cell == ""))
        .groupBy("dataset_id", "table_name", "column", "target_table")
        .agg(F.count(F.lit(1)).alias("empty_values"))
    )


def issue_counts_by_kind(issues: DataFrame) -> DataFrame:
    return issues.groupBy("dataset_id", "kind").agg(F.count(F.lit(1)).alias("issues"))


def missing_file_counts(missing: DataFrame, file_column: str) -> DataFrame:
    """How often each missing file is referred to: ``dataset_id, file, refs``."""
    return missing.groupBy("dataset_id", F.col(file_column).alias("file")).agg(F.count(F.lit(1)).alias("refs"))


def missing_file_summary(missing: DataFrame, file_column: str, k: int = 5) -> DataFrame:
    """A line of text per dataset for display: total, the ``k`` most frequent missing files, and how many more there are.

    ``missing_file_counts`` has all of them as rows.
    """
    counts = missing_file_counts(missing, file_column)
    totals = counts.groupBy("dataset_id").agg(F.sum("refs").alias("total"), F.count(F.lit(1)).alias("distinct_files"))
    heads = (
        top_k(counts, ["dataset_id"], [F.desc("refs"), F.asc("file")], k)
        .withColumn("_text", F.format_string('"%s" (%d ref%s)', "file", "refs", F.when(F.col("refs") == 1, "").otherwise("s")))
        .groupBy("dataset_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "_text"))).alias("_heads"))
    )
    more = F.when(F.col("distinct_files") > k, F.format_string(" +%d more", F.col("distinct_files") - k)).otherwise("")
    return totals.join(heads, "dataset_id").select(
        "dataset_id",
        "total",
        "distinct_files",
        F.concat(F.array_join(F.transform("_heads", lambda h: h["_text"]), ", "), more).alias("summary"),
    )


def preflight_report(
    stats: DataFrame,
    issues: DataFrame,
    pointers: DataFrame,
    missing_tables: DataFrame,
    unresolved_counts: DataFrame,
    orphans: DataFrame,
    sample: int | None = None,
    top: int | None = None,
) -> DataFrame:
    """Markdown report as ``dataset_id, section, ord, line``.

    Lists are whole unless a display asks for the first ``sample`` rows or ``top`` names of each
    dataset; the totals always count everything. Each input is kept once and read for all its uses.
    """
    stats, issues, pointers, missing_tables, unresolved_counts, orphans = (
        durable(frame) for frame in (stats, issues, pointers, missing_tables, unresolved_counts, orphans)
    )
    pointer_total = pointers.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_pointers"))
    table_total = missing_tables.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_tables"))
    issue_total = issues.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_issues"))
    orphan_total = orphans.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_orphans"))
    totals = stats
    for frame in (pointer_total, table_total, issue_total, orphan_total):
        totals = totals.join(frame, "dataset_id", "left")
    # Labels, headings and table heads of the report.
    labels = [
        ("Tables indexed", "table_count"),
        ("Rows indexed", "row_count"),
        ("Foreign key references", "fk_count"),
        ("Resolved references", "resolved_count"),
        ("Unresolved references", "unresolved_count"),
        ("Missing file pointers", "_pointers"),
        ("Missing foreign key target files", "_tables"),
        ("File format issues", "_issues"),
        ("Potential orphan rows (no inbound and no outbound refs)", "_orphans"),
    ]
    lines = [
        F.concat(F.lit(f"- {label}: "), F.coalesce(F.col(column), F.lit(0)).cast("string"))
        for label, column in labels
    ]
    summary = totals.select("dataset_id", F.posexplode(F.array(*lines)).alias("ord", "line")).select(
        "dataset_id", F.lit(1).alias("section"), (F.col("ord") + 1).alias("ord"), "line"
    )
    line_text = F.when(F.col("line_no") > 0, F.col("line_no").cast("string")).otherwise("—")
    parts = [
        (2, "File format issues", issues, ["file_name", "line_no", "kind", "message"],
         ["file_name", line_text, "kind", "message"], sample, "| file | line | kind | message |"),
        (3, "Missing file pointers", pointers,
         ["source_file", "source_line", "source_column", "referenced_file"],
         ["source_file", F.col("source_line").cast("string"), "source_column", "referenced_file"], sample,
         "| source file | line | column | missing file |"),
        (4, "Missing foreign key target files", missing_tables,
         ["source_file", "source_line", "source_column", "fk_value"],
         ["source_file", F.col("source_line").cast("string"), "source_column", "fk_value", "target_file"], sample,
         "| source file | line | source column | fk value | missing target file |"),
        (7, "Potential orphan rows", orphans, ["table_name", "line_no", "file_name"],
         ["table_name", "pk_value", "file_name", F.col("line_no").cast("string")], sample,
         "| table | pk | file | line |"),
    ]
    out = summary
    for section, _, frame, order, cells, k, _ in parts:
        body = top_k(frame, ["dataset_id"], [F.asc(c) for c in order], k).select(
            "dataset_id",
            F.lit(section).alias("section"),
            F.col("rank").alias("ord"),
            F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"),
        )
        out = out.unionByName(body)
    for section, table, column in ((5, "target_table", "target_column"), (6, "source_table", "source_column")):
        heads = unresolved_by(unresolved_counts, table, column, top).select(
            "dataset_id",
            F.lit(section).alias("section"),
            F.col("rank").alias("ord"),
            F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("unresolved_count").cast("string")).alias("line"),
        )
        out = out.unionByName(heads)
    titles = [(1, "## Summary", None), (5, "## Top unresolved targets", None), (6, "## Top unresolved source columns", None)]
    titles += [(s, f"## {name}" + (f" (sample, max {k})" if k is not None else ""), header) for s, name, _, _, _, k, header in parts]
    return out.unionByName(_frame_titles(stats.sparkSession, stats, out, titles)).orderBy("dataset_id", "section", "ord")


def _frame_titles(spark: SparkSession, stats: DataFrame, body: DataFrame, titles: list) -> DataFrame:
    """Section titles, table headers, and ``- None`` where a section has no line."""
    head = F.array(
        *[F.struct(F.lit(s).alias("section"), F.lit(t).alias("title"), F.lit(h).cast("string").alias("header")) for s, t, h in titles]
    )
    filled = body.select("dataset_id", "section").distinct().withColumn("_filled", F.lit(True))
    sections = stats.select("dataset_id", F.inline(head)).join(filled, ["dataset_id", "section"], "left")
    lines = F.concat(
        F.array(F.struct(F.lit(-2).alias("ord"), F.col("title").alias("line"))),
        F.when(F.col("_filled").isNull(), F.array(F.struct(F.lit(-1).alias("ord"), F.lit("- None").alias("line"))))
        .when(F.col("header").isNotNull(), F.array(F.struct(F.lit(-1).alias("ord"), F.col("header").alias("line"))))
        .otherwise(F.array().cast("array<struct<ord:int,line:string>>")),
    )
    return sections.select("dataset_id", "section", F.inline(lines))
