"""Format checks over text tables: one ``issues`` frame.

``issues``: ``dataset_id, file_name, line_no, column, kind, message, expected, actual``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkfold.catalog import BOOLEAN_TYPE, DOUBLE_TYPE, INTEGER_TYPES, Catalog
from linkfold.functions import text
from linkfold.session import attached
from linkfold.sources.tables import FILE, normalized_header, resolve_header

ISSUE_COLUMNS = ("dataset_id", "file_name", "line_no", "column", "kind", "message", "expected", "actual")


def _issue(
    df: DataFrame,
    kind: str | Column,
    message: Column,
    line: Column,
    expected: Column | None = None,
    actual: Column | None = None,
    column: Column | None = None,
) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        "dataset_id",
        "file_name",
        line.cast("bigint").alias("line_no"),
        (none if column is None else column).alias("column"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        message.alias("message"),
        (none if expected is None else expected).alias("expected"),
        (none if actual is None else actual).alias("actual"),
    )


def file_lines(lines: DataFrame, bound: DataFrame) -> DataFrame:
    """Per bound file: filled and total lines; files without any line count zero."""
    counts = lines.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("total_lines"), F.count_if(~text.is_blank(F.col("raw"))).alias("filled_lines")
    )
    return attached(bound.join(counts, FILE, "left").fillna(0, ["total_lines", "filled_lines"]))


def empty_files(files: DataFrame) -> DataFrame:
    return _issue(
        files.filter("filled_lines = 0"), "empty_file", F.concat(F.lit("File is empty: "), "file_name"), F.lit(0)
    )


def missing_titles(lines: DataFrame, headers: DataFrame) -> DataFrame:
    blank = (
        headers.filter("has_title")
        .select(*FILE)
        .join(lines.filter("line_no = 1").select(*FILE, "raw"), FILE, "left")
        .filter(F.col("raw").isNull() | text.is_blank(F.col("raw")))
    )
    return _issue(
        blank,
        "missing_metadata_line",
        F.concat(F.lit("Missing or blank title/metadata line in "), "file_name"),
        F.lit(1),
        F.lit("Non-empty title line on line 1"),
    )


def looks_like_data(line: Column, types: Column, catalog: Catalog) -> Column:
    """True when a line in the header slot is really a data row.

    Either at least 60 % (and two) of the typed columns hold fitting values, or at least 60 % (and
    two) of the cells behind the first are numbers or null words.
    """
    cells = text.tokens(line)
    null = lambda v: text.is_sentinel(v, catalog.null_sentinels)
    numeric = lambda v: text.number(v).isNotNull()
    fits = lambda t, v: (
        F.when(t.isin(list(INTEGER_TYPES)), null(v) | text.is_whole(v))
        .when(t == DOUBLE_TYPE, null(v) | numeric(v))
        .when(t == BOOLEAN_TYPE, text.is_boolean_literal(v, catalog.null_sentinels))
    )
    verdicts = F.filter(
        F.transform(types, lambda t, i: F.when(F.get(cells, i).isNotNull(), fits(t, F.get(cells, i)))),
        lambda v: v.isNotNull(),
    )
    good = F.size(F.filter(verdicts, lambda v: v))
    typed = (F.size(verdicts) >= 2) & (good >= F.greatest(F.lit(2), F.ceil(F.size(verdicts) * 0.6)))
    tail = F.slice(cells, F.lit(2), F.greatest(F.size(cells), F.lit(1)))
    numbers = F.size(F.filter(tail, lambda v: null(v) | numeric(v)))
    return typed | ((F.size(tail) >= 2) & (numbers >= F.greatest(F.lit(2), F.ceil(F.size(tail) * 0.6))))


def analyzed_headers(headers: DataFrame, catalog: Catalog) -> DataFrame:
    """Verdict on each file's header line: ``header_kind`` is null when the header is fine."""
    expected = F.transform(F.col("physical"), F.lower)
    actual = normalized_header(F.coalesce("header_raw", F.lit("")), F.col("file_name"), catalog)
    missing = F.size(F.filter(expected, lambda e: ~F.array_contains(actual, e)))
    total = F.size("physical")
    blank = F.col("header_raw").isNull() | text.is_blank(F.col("header_raw"))
    kind = (
        F.when(~F.col("has_header"), F.lit(None).cast("string"))
        .when(blank, "missing_header_line")
        .when((total == 0) | (missing * 2 <= total), F.lit(None))
        .when(
            (missing == total) & looks_like_data(F.col("header_raw"), F.col("column_types"), catalog),
            "missing_header_line",
        )
        .otherwise("header_column_mismatch")
    )
    return headers.withColumn("missing_names", missing).withColumn("header_kind", kind)


def header_issues(analyzed: DataFrame) -> DataFrame:
    kind, total = F.col("header_kind"), F.size("physical")
    words = F.array_join(text.tokens(F.coalesce("header_raw", F.lit(""))), " ")
    message = (
        F.when(
            kind == "header_column_mismatch",
            F.format_string(
                "Column-header mismatch in %s: %d of %d expected columns not found in header",
                "file_name",
                "missing_names",
                total,
            ),
        )
        .when(
            F.col("header_raw").isNull() | text.is_blank(F.col("header_raw")),
            F.concat(F.lit("Missing or blank column-header line in "), "file_name"),
        )
        .otherwise(F.format_string("Expected a column header in %s, but found a data row instead", "file_name"))
    )
    expected = F.when(
        kind == "header_column_mismatch", F.array_join(F.transform("physical", F.lower), " ")
    ).otherwise(F.concat(F.lit("Column header on line "), F.col("header_line").cast("string")))
    actual = F.when(F.col("header_raw").isNotNull(), words)
    return _issue(analyzed.filter(kind.isNotNull()), kind, message, F.col("header_line"), expected, actual)


def column_positions(headers: DataFrame, catalog: Catalog) -> DataFrame:
    """Where each catalog column stands in its file: in the header's place if the header names it."""
    actual = normalized_header(F.coalesce("header_raw", F.lit("")), F.col("file_name"), catalog)
    placed = F.transform(
        F.col("physical"),
        lambda c, i: F.when(
            F.col("has_header") & F.array_contains(F.col("_actual"), c),
            (F.array_position(F.col("_actual"), c) - 1).cast("int"),
        ).otherwise(i),
    )
    return headers.withColumn("_actual", actual).withColumn("positions", placed).drop("_actual")


def row_issues(lines: DataFrame, placed: DataFrame, catalog: Catalog, cap: int | None = None) -> DataFrame:
    """Column count and cell type issues of plain tables, line by line.

    A line that is too short is not type-checked. All issues are kept unless a display asks for the
    first ``cap`` of each file, in line order and in the order integer, decimal, boolean within a
    line; tasks then cut their part before the shuffle.
    """
    special = catalog.hierarchical_files()
    info = placed.filter(
        ~F.col("file_name").isin(special) & ~F.lower("file_name").endswith(".dtl")
    ).select(*FILE, "data_line", "physical", "column_types", "positions")
    cells = (
        lines.join(info, FILE)
        .filter((F.col("line_no") >= F.col("data_line")) & ~text.is_blank(F.col("raw")) & ~F.ltrim("raw").startswith("#"))
        .withColumn("tokens", text.tokens(F.col("raw")))
        .withColumn("width", F.size("physical"))
    )
    short = (F.col("width") > 0) & (F.size("tokens") < F.col("width") - 1)
    where = F.concat(F.lit(" in "), "file_name", F.lit(" at line "), F.col("line_no").cast("string"))

    def at(i: Column) -> Column:
        return F.get("tokens", F.get("positions", i))

    filled = lambda v: v.isNotNull() & ~text.is_sentinel(v, catalog.null_sentinels)
    wrong = lambda t, v: (
        F.when(t.isin(list(INTEGER_TYPES)) & ~text.is_whole(v), F.lit(1))
        .when((t == DOUBLE_TYPE) & text.number(v).isNull(), F.lit(2))
        .when((t == BOOLEAN_TYPE) & ~text.is_boolean_literal(v, catalog.null_sentinels), F.lit(3))
    )
    found = F.filter(
        F.transform(
            "column_types",
            lambda t, i: F.struct(
                F.when(filled(at(i)), wrong(t, at(i))).alias("check"),
                i.alias("nth"),
                F.get("physical", i).alias("column"),
                at(i).alias("actual"),
            ),
        ),
        lambda e: e["check"].isNotNull(),
    )
    too_short = F.array(
        F.struct(
            F.lit(0).alias("check"),
            F.lit(0).alias("nth"),
            F.lit(None).cast("string").alias("column"),
            F.size("tokens").cast("string").alias("actual"),
        )
    )
    issues = cells.select(
        *FILE, "line_no", where.alias("_where"), "width", F.inline(F.when(short, too_short).otherwise(found))
    )
    if cap is not None:
        window = Window.partitionBy(*FILE).orderBy("line_no", "check", "nth")
        issues = issues.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= cap)
    check = F.col("check")
    kinds = ("wrong_column_count", "invalid_integer", "invalid_decimal", "invalid_boolean")
    wants = (None, "integer", "number", "0/1, y/n, true/false, or yes/no")
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), check)
    count = F.format_string(
        "Too few columns%s: expected %d columns, found %s", F.col("_where"), F.col("width"), F.col("actual")
    )
    bad = F.format_string(
        'Invalid %s value%s, column "%s": "%s"%s',
        F.get(F.array(*[F.lit(w) for w in ("", "integer", "numeric", "boolean")]), check),
        F.col("_where"),
        F.col("column"),
        F.col("actual"),
        F.when(check == 3, F.lit(" (expected 0/1, y/n, true/false, or yes/no)")).otherwise(""),
    )
    expected = F.when(check == 0, F.col("width").cast("string")).otherwise(
        F.get(F.array(*[F.lit(w).cast("string") for w in wants]), check)
    )
    return _issue(
        issues, kind, F.when(check == 0, count).otherwise(bad), F.col("line_no"), expected, F.col("actual"), F.col("column")
    )


def format_issues(lines: DataFrame, bound: DataFrame, catalog: Catalog, cap: int | None = None) -> DataFrame:
    """All format issues of all bound files.

    Empty files are reported once and not looked at further. Hierarchical files and decision tables
    only get the file and header checks.
    """
    spark = lines.sparkSession
    files = file_lines(lines, bound)
    filled = files.filter("filled_lines > 0").drop("total_lines", "filled_lines")
    physical = catalog.tables_frame(spark).select("schema_file", F.col("columns").alias("physical"))
    headers = attached(resolve_header(lines, filled, catalog).join(physical, "schema_file"))
    analyzed = analyzed_headers(headers, catalog)
    return (
        empty_files(files)
        .unionByName(missing_titles(lines, headers))
        .unionByName(header_issues(analyzed))
        .unionByName(row_issues(lines, column_positions(headers, catalog), catalog, cap))
    )
