"""Filtering, sorting, summarising and sampling of tables."""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from linkfold.functions import text
from linkfold.functions.ordinals import with_global_ordinal, with_sorted_ordinal
from linkfold.session import durable

# --- filters ---------------------------------------------------------------


def contains_text(value: Column, query: str) -> Column:
    return F.contains(F.lower(value), F.lit(query.strip().lower()))


def filter_text(df: DataFrame, query: str, column: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Case-insensitive substring filter on one column, or on the joined text of all columns."""
    if not query.strip():
        return df
    if column:
        return df.filter(contains_text(F.col(column).cast("string"), query))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns]
    return df.filter(contains_text(F.concat(*cells), query))


def filter_numeric(df: DataFrame, column: str, operator: str, operand: str | float) -> DataFrame:
    """Numeric comparison; cells that are no numbers never match, nor does a non-numeric operand."""
    target = _finite(str(operand))
    if target is None:
        return df.filter(F.lit(False))
    value = _as_number(df, column)
    tests = {
        "<": value < target,
        "<=": value <= target,
        ">": value > target,
        ">=": value >= target,
        "=": value == target,
        "!=": value != target,
    }
    return df.filter(F.coalesce(tests[operator], F.lit(False)) if operator in tests else F.lit(False))


def _as_number(df: DataFrame, column: str, thousands: bool = False) -> Column:
    """Typed numeric columns are compared as they are, so the test reaches the scan."""
    if dict(df.dtypes)[column] == "string":
        return text.number(F.col(column), thousands)
    return F.col(column).cast("double")


def _finite(literal: str, thousands: bool = False) -> float | None:
    literal = literal.strip()
    if thousands:
        literal = literal.replace(",", "")
    if not re.match(text.NUMBER, literal):
        return None
    value = float(literal)
    return value if abs(value) != float("inf") else None


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: str = ""
    join: str = "and"
    negate: bool = False

    @property
    def active(self) -> bool:
        known = self.operator in CONDITION_OPERATORS
        return bool(known and self.column and (self.operator == "is_empty" or self.value.strip()))


CONDITION_OPERATORS = ("contains", "equals", "gt", "gte", "lt", "lte", "in", "is_empty")


def condition_predicate(df: DataFrame, conditions: Sequence[Condition]) -> Column | None:
    """Left-to-right fold of the active conditions; AND and OR bind equally."""
    active = [c for c in conditions if c.active]
    if not active:
        return None

    def fold(acc: Column, condition: Condition) -> Column:
        test = _condition(df, condition)
        return acc | test if condition.join == "or" else acc & test

    return functools.reduce(fold, active[1:], _condition(df, active[0]))


def condition_filter(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    predicate = condition_predicate(df, conditions)
    return df if predicate is None else df.filter(predicate)


def _condition(df: DataFrame, condition: Condition) -> Column:
    if condition.column not in df.columns:
        return F.lit(False)
    value = F.trim(F.coalesce(F.col(condition.column).cast("string"), F.lit("")))
    query = condition.value.strip()
    if condition.operator == "is_empty":
        matched = value == ""
    elif condition.operator == "contains":
        matched = contains_text(value, query)
    elif condition.operator == "equals":
        matched = _equals(df, condition.column, value, query)
    elif condition.operator == "in":
        options = [part.strip() for part in re.split("[,;]+", query) if part.strip()]
        matched = functools.reduce(
            lambda a, b: a | b, [_equals(df, condition.column, value, o) for o in options], F.lit(False)
        )
    else:
        left, right = _as_number(df, condition.column, thousands=True), _finite(query, thousands=True)
        if right is None:
            matched = F.lit(False)
        else:
            matched = {
                "gt": left > right,
                "gte": left >= right,
                "lt": left < right,
                "lte": left <= right,
            }[condition.operator]
    matched = F.coalesce(matched, F.lit(False))
    return ~matched if condition.negate else matched


def _equals(df: DataFrame, column: str, value: Column, query: str) -> Column:
    """Numbers compare by size, everything else ignoring case."""
    literal = _finite(query, thousands=True)
    same_text = F.lower(value) == query.lower()
    if literal is None:
        return same_text
    number = _as_number(df, column, thousands=True)
    return F.when(number.isNotNull(), number == literal).otherwise(same_text)


def id_ranges(spark: SparkSession, expression: str) -> DataFrame:
    """``'1,4-6,10'`` as rows ``first, last``. Bad or empty input raises ``ValueError``."""
    parts = [p.strip() for p in expression.split(",") if p.strip()]
    if not parts:
        raise ValueError("no id given")
    ranges = []
    for part in parts:
        match = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not match:
            raise ValueError(f"not an id or a range: {part!r}")
        first, last = int(match[1]), int(match[2] or match[1])
        if first < 1:
            raise ValueError("ids must be positive")
        if first > last:
            raise ValueError(f"range runs backwards: {part!r}")
        ranges.append((first, last))
    return spark.createDataFrame(ranges, "first bigint, last bigint")


def id_list(spark: SparkSession, expression: str) -> DataFrame:
    """Distinct ids of an expression such as ``'1,4-6,10'``."""
    return id_ranges(spark, expression).select(F.explode(F.sequence("first", "last")).alias("id")).distinct()


def id_list_filter(df: DataFrame, column: str, expression: str) -> DataFrame:
    """Rows whose id is in the expression: a predicate on the scan, no join."""
    tests = [F.col(column).between(r["first"], r["last"]) for r in id_ranges(df.sparkSession, expression).collect()]
    return df.filter(functools.reduce(lambda a, b: a | b, tests))


def missing_ids(requested: DataFrame, found: DataFrame) -> DataFrame:
    return requested.select("id").join(found.select("id"), "id", "left_anti")


# --- order and samples -----------------------------------------------------


def natural_order(df: DataFrame, column: str, descending: bool = False, ties: Sequence[str] = ()) -> list[Column]:
    """Total order: numbers by size, then other cells by natural text, then the tie columns.

    Descending reverses the cells; ties stay ascending.
    """
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    num = _as_number(df, column)
    keys = [num.isNull().cast("int"), num, text.natural_key(value), value]
    return [k.desc() if descending else k.asc() for k in keys] + [F.asc(t) for t in ties]


def natural_sort(df: DataFrame, column: str, descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*natural_order(df, column, descending, ties))


def preview(df: DataFrame, order: Sequence[str], n: int = 2000) -> DataFrame:
    """The first ``n`` rows in file order (a top-k, not a sort of everything)."""
    return df.orderBy(*order).limit(n)


def preview_counts(df: DataFrame, keys: Sequence[str], n: int = 2000) -> DataFrame:
    """Total rows, previewed rows, and whether the preview is cut."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("total_rows"))
        .withColumn("preview_rows", F.least("total_rows", F.lit(n).cast("bigint")))
        .withColumn("truncated", F.col("total_rows") > n)
    )


def sample_positions(total: Column, limit: int) -> Column:
    """0-based positions ``floor(i / (limit - 1) * (total - 1))`` of an even sample, in doubles."""
    even = F.transform(
        F.sequence(F.lit(0), F.lit(limit - 1)),
        lambda i: F.floor(i.cast("double") / F.lit(float(limit - 1)) * (total - 1).cast("double")).cast("bigint"),
    )
    return F.when(total <= limit, F.sequence(F.lit(0).cast("bigint"), F.greatest(total - 1, F.lit(0)))).otherwise(even)


def downsample(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    y_column: str,
    limit: int = 80,
    chart: str = "line",
    ties: Sequence[str] = (),
) -> DataFrame:
    """Even sample of at most ``limit`` rows per key, in ``position`` order.

    Rows whose ``y`` is no number are left out first; bar charts never show more than 80 points.
    """
    limit = min(limit, 80) if chart == "bar" else limit
    points = df.withColumn("y", _as_number(df, y_column, thousands=True)).filter("y is not null")
    ranked = with_sorted_ordinal(points, keys, [position, *ties], "_rank")
    if limit <= 1:
        return ranked.withColumn("point", F.col("_rank") - 1).drop("_rank")
    totals = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    picks = totals.filter(F.col("_total") > limit).select(
        *keys, F.posexplode(sample_positions(F.col("_total"), limit)).alias("point", "_at")
    )
    whole = ranked.join(totals.filter(F.col("_total") <= limit).select(*keys), list(keys), "left_semi")
    sampled = ranked.withColumn("_at", F.col("_rank") - 1).join(picks, [*keys, "_at"]).drop("_at", "_rank")
    return sampled.unionByName(whole.withColumn("point", (F.col("_rank") - 1).cast("int")).drop("_rank"))


def downsample_sorted(df: DataFrame, order: Sequence[Column], limit: int = 80) -> DataFrame:
    """Even sample of a frame in any total order, with the 0-based ``point`` of each row."""
    ranked = with_global_ordinal(df, order, "_at")
    totals = ranked.agg(F.count(F.lit(1)).alias("_total"))
    picks = totals.select(F.posexplode(sample_positions(F.col("_total"), limit)).alias("point", "_at"))
    return ranked.join(picks, "_at").drop("_at")


def axis_range(df: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """Axis limits; the y axis always includes zero."""
    return df.groupBy(*keys).agg(
        F.min(x).alias("x_min"),
        F.max(x).alias("x_max"),
        F.least(F.min(y), F.lit(0.0)).alias("y_min"),
        F.greatest(F.max(y), F.lit(0.0)).alias("y_max"),
    )


# --- summaries -------------------------------------------------------------


def numeric_columns(df: DataFrame, columns: Sequence[str], rule: str = "explorer", share: float = 0.6) -> DataFrame:
    """Per column: cells, non-empty cells, numeric cells, and whether the column counts as numeric.

    ``explorer`` wants 60 % of the non-empty cells numeric; ``summary`` wants
    ``max(1, floor(0.6 * rows))`` numeric cells. All columns are measured in one pass.
    """
    aggregates = [F.count(F.lit(1)).alias("_cells")]
    for i, name in enumerate(columns):
        value = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
        aggregates.append(F.count_if(value != "").alias(f"_filled{i}"))
        aggregates.append(F.count_if(_as_number(df, name, thousands=True).isNotNull()).alias(f"_numeric{i}"))
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.col("_cells").alias("cells"),
                F.col(f"_filled{i}").alias("filled"),
                F.col(f"_numeric{i}").alias("numeric"),
            )
            for i, name in enumerate(columns)
        ]
    )
    out = df.agg(*aggregates).select(F.inline(entries))
    if rule == "explorer":
        verdict = (F.col("filled") > 0) & (F.col("numeric") >= F.lit(share) * F.col("filled"))
    elif rule == "summary":
        verdict = F.col("numeric") >= F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("cells")))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return out.withColumn("is_numeric", verdict)


QUARTILES = (0.25, 0.5, 0.75)
#: The sketch's ranks are off by at most 1 / ACCURACY of the rows; brackets are ``MARGIN`` times as wide at first.
ACCURACY = 10_000
MARGIN = 3


def describe_numeric(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column.

    Quartiles are exact, interpolated between the two values at their place. ``exact=False`` takes the mergeable
    sketch's values instead and reads the rows once.
    """
    keys = list(keys)
    aggregates = []
    for i, name in enumerate(columns):
        v = _as_number(df, name, thousands=True)
        aggregates += [
            F.struct(
                F.lit(name).alias("column"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                _around(v, MARGIN).alias("_cuts"),
            ).alias(f"_c{i}")
        ]
    grouped = df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
    stats = grouped.select(*keys, F.inline(F.array(*[F.col(f"_c{i}") for i in range(len(columns))])))
    names = [f"q{int(100 * q)}" for q in QUARTILES]
    out = [*keys, "column", "count", "mean", "std", "min", *names, "max"]
    if not exact:
        return stats.withColumns({n: F.get("_cuts", F.lit(3 * i + 1)) for i, n in enumerate(names)}).select(*out)
    stats = durable(stats)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _as_number(df, c, thousands=True).alias("v")) for c in columns])
    values = df.select(*keys, F.inline(cells)).filter("v is not null")
    found = durable(_quartiles(values, stats, keys, MARGIN))
    margin = MARGIN
    # A rank outside its bracket: the sketch promises that there is none, the counts make sure of it.
    while (lost := found.filter("not settled").select(*keys, "column").distinct()).limit(1).count():
        margin = max(1, 32 * margin)
        same = _same([*keys, "column"], lost, "_l")
        again = values.join(same[0], same[1], "left_semi")
        wider = again.groupBy(*keys, "column").agg(F.count("v").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), _around(F.col("v"), margin).alias("_cuts"))
        found = durable(found.filter("settled").unionByName(_quartiles(again, durable(wider), keys, margin)))
    picked = found.groupBy(*keys, "column").agg(*[F.max(F.when(F.col("_q") == i, F.col("value"))).alias(n) for i, n in enumerate(names)])
    right, on = _same([*keys, "column"], picked, "_p")
    return stats.join(right, on, "left").select(*out)


def _around(v: Column, margin: int) -> Column:
    """For each quartile the sketch's values below, at and above its rank; at the ends of the ranks the extremes."""
    wide = margin / ACCURACY
    return F.percentile_approx(v, [min(max(q + d, 0.0), 1.0) for q in QUARTILES for d in (-wide, 0.0, wide)], ACCURACY)


def _same(names: Sequence[str], right: DataFrame, mark: str) -> tuple[DataFrame, Column]:
    """``right`` with its columns ``names`` renamed, and the null-safe condition that they equal the left ones."""
    renamed = right.withColumnsRenamed({n: f"{mark}{i}" for i, n in enumerate(names)})
    return renamed, functools.reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{mark}{i}")) for i, n in enumerate(names)])


def _quartiles(values: DataFrame, stats: DataFrame, keys: list[str], margin: int) -> DataFrame:
    """``keys, column, _q, value, settled`` by counting below each quartile's bracket and ranking what lies inside.

    Inside are a few rows in ten thousand, equal values counted together, so ranks are running sums over those; all
    other values only add to a count. A quartile is settled if the bracket holds the ranks on both sides of its place.
    """
    group = [*keys, "column"]
    place = F.array(*[F.lit(q) * (F.col("count") - 1) for q in QUARTILES])
    wide = margin / ACCURACY
    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("_q"),
                (F.get("_cuts", F.lit(3 * i)) if q > wide else F.col("min")).alias("low"),
                (F.get("_cuts", F.lit(3 * i + 2)) if q + wide < 1 else F.col("max")).alias("high"),
                F.get(place, F.lit(i)).alias("place"),
            )
            for i, q in enumerate(QUARTILES)
        ]
    )
    asked = durable(stats.filter("count > 0").select(*group, F.inline(brackets)))
    told, on = _same(group, asked.groupBy(*group).agg(F.collect_list(F.struct("_q", "low", "high")).alias("_b")), "_a")
    met = values.join(told, on).select(*group, "v", F.explode(F.filter("_b", lambda b: F.col("v") <= b["high"])).alias("b"))
    # What lies below a bracket is one row with no value.
    inside = F.when(F.col("v") >= F.col("b.low"), F.col("v"))
    counts = met.groupBy(*group, F.col("b._q").alias("_q"), inside.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*group, "_q").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    right, on = _same([*group, "_q"], asked.select(*group, "_q", "place"), "_b")
    ranked = counts.withColumn("upto", upto).join(right, on)
    low, high = F.floor("place"), F.ceil("place")
    at = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank) & F.col("v").isNotNull()
    sides = ranked.groupBy(*group, "_q").agg(F.max(F.when(at(low), F.col("v"))).alias("a"), F.max(F.when(at(high), F.col("v"))).alias("b"), F.first("place").alias("place"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("place") - F.col("place")) * F.col("a") + (F.col("place") - F.floor("place")) * F.col("b"))
    # A quartile with no row at all lies outside too.
    right, on = _same([*group, "_q"], sides, "_s")
    return asked.select(*group, "_q").join(right, on, "left").select(*group, "_q", value.alias("value"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("settled"))


def id_range(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest integer id and how many there are."""
    value = text.integer(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column).cast("bigint")
    return df.groupBy(*keys).agg(F.min(value).alias("min_id"), F.max(value).alias("max_id"), F.count(value).alias("ids"))


def typed_table(rows: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Generic rows as typed columns; cells that do not convert become null."""

    def convert(cells: Column, name: str, kind: str) -> Column:
        value = F.try_element_at(cells, F.lit(name))
        if kind == "double":
            return text.number(value)
        if kind == "bigint":
            parsed = text.number(value)
            return F.coalesce(text.integer(value), F.when(parsed == F.floor(parsed), parsed.try_cast("bigint")))
        if kind == "boolean":
            low = F.lower(value)
            return F.when(low.isin("1", "y", "yes", "true"), True).when(low.isin("0", "n", "no", "false"), False)
        return value

    typed = text.bind(
        F.col("values"), lambda cells: F.struct(*[convert(cells, n, k).alias(n) for n, k in types.items()])
    )
    return rows.select("dataset_id", "file_name", "line_no", typed.alias("_typed")).select(
        "dataset_id", "file_name", "line_no", "_typed.*"
    )
