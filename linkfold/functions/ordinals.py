"""Row numbers for groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkfold.session import attached, durable


def with_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    name: str = "ordinal",
    ties: Sequence[str] = (),
    width: int = 100_000,
) -> DataFrame:
    """1-based rank of each row inside ``keys``, ordered by the integer ``position`` then ``ties``.

    For positions that are dense, as line numbers are: a group is cut into position ranges of ``width``; rows are
    numbered inside a range and shifted by the row counts of the ranges before, so a huge group spreads over many
    tasks. Positions with gaps, such as ids, go through ``with_sorted_ordinal``.
    """
    keys = list(keys)
    cut = df.withColumn("_range", F.floor(F.col(position) / F.lit(width)))
    inner = Window.partitionBy(*keys, "_range").orderBy(position, *ties)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        cut.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    numbered = cut.withColumn("_inner", F.row_number().over(inner))
    return (
        numbered.join(shifts, [*keys, "_range"])
        .withColumn(name, F.col("_inner") + F.col("_shift"))
        .drop("_inner", "_shift", "_range")
    )


def _in_ranges(df: DataFrame, keys: list[str], order: Sequence[str | Column]) -> DataFrame:
    """The rows sorted by keys and order over ranges that Spark samples, written once with ``_row`` and ``_part``."""
    # The high bits of the id are the range, the low 33 bits the row inside it.
    fixed = durable(df.orderBy(*keys, *order).withColumn("_row", F.monotonically_increasing_id()))
    return fixed.withColumn("_part", F.shiftright("_row", 33))


def _with_shifts(fixed: DataFrame, keys: list[str], *own: Column, amount: str) -> DataFrame:
    """``_shift``, the sum of ``amount`` over a group's ranges before, joined to each row with more about its range.

    There is one row for each group and range that meet: at most as many as there are groups and ranges together.
    """
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stats = fixed.groupBy(*keys, "_part").agg(*own)
    names = [c for c in stats.columns if c not in (*keys, "_part")]
    shifts = stats.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_of"),
        *names,
        F.coalesce(F.sum(amount).over(before), F.lit(0)).alias("_shift"),
    )
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return fixed.join(attached(shifts), same).drop("_of", *[f"_key{i}" for i in range(len(keys))])


def with_sorted_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "ordinal") -> DataFrame:
    """1-based rank of each row inside ``keys`` in any order.

    The rows are sorted once over sampled ranges, so neither a huge group nor sparse or hashed positions make a large
    task. A group's rows in a range stand together there, and its counts in the ranges before give their shift. Null
    keys are a group.
    """
    fixed = _in_ranges(df, list(keys), order)
    joined = _with_shifts(fixed, list(keys), F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"), amount="_n")
    return joined.withColumn(name, F.col("_row") - F.col("_first") + F.col("_shift") + 1).drop("_row", "_part", "_first", "_n", "_shift")


def with_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` over the rows of ``keys`` up to each row, itself included; groups and positions of any size."""
    fixed = _in_ranges(df, list(keys), order)
    joined = _with_shifts(fixed, list(keys), F.sum(amount).alias("_n"), amount="_n")
    upto = Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.sum(amount).over(upto) + F.col("_shift")).drop("_row", "_part", "_n", "_shift")


def with_ids_between(spans: DataFrame, ids: DataFrame, keys: Sequence[str], id_column: str, low: str, high: str) -> tuple[DataFrame, DataFrame]:
    """Which ids lie in each span, without writing the span out.

    The ids and the ends of the spans are sorted together, and the running count of ids turns a span of values, however
    wide, into one of ranks: the first frame is ``spans`` with ``first_rank`` and ``n_ids``, the second ``ids`` with ``rank``.
    Spans with no id have ``n_ids`` 0; those whose low end is null are left out.
    """
    keys = list(keys)
    told = durable(spans.withColumn("_span", F.monotonically_increasing_id()))
    # At equal values a low end stands before the ids and a high end behind them.
    ends = told.select(*keys, F.explode(F.array(F.struct(F.col(low).alias("_at"), F.lit(0).alias("_side")), F.struct(F.col(high).alias("_at"), F.lit(2).alias("_side")))).alias("_e"), "_span")
    marks = ends.select(*keys, "_e.*", "_span", F.lit(0).cast("bigint").alias("_id"))
    own = ids.select(*keys, F.col(id_column).cast("bigint").alias("_at")).distinct()
    marks = marks.unionByName(own.select(*keys, "_at", F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_span"), F.lit(1).cast("bigint").alias("_id")))
    counted = durable(with_running_sum(marks, keys, ["_at", "_side"], "_id", "_upto"))
    found = counted.filter("_side <> 1").groupBy("_span").agg(F.max(F.when(F.col("_side") == 0, F.col("_upto"))).alias("_a"), F.max(F.when(F.col("_side") == 2, F.col("_upto"))).alias("_b"))
    ranked = counted.filter("_side = 1").select(*keys, F.col("_at").alias("_value"), F.col("_upto").alias("rank"))
    placed = told.join(found, "_span").withColumn("first_rank", F.col("_a") + 1).withColumn("n_ids", F.col("_b") - F.col("_a")).drop("_span", "_a", "_b")
    named = ids.withColumn("_value", F.col(id_column).cast("bigint")).join(ranked, [*keys, "_value"]).drop("_value")
    return placed, named


def explode_upto(df: DataFrame, count: Column, name: str, block: int = 10_000) -> DataFrame:
    """Each row ``count`` times with ``name`` from 1 on; no array is longer than ``block`` or the count over it."""
    blocks = df.withColumn("_count", count.cast("bigint")).filter("_count > 0")
    blocks = blocks.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_count") - 1) / block))))
    first = F.col("_block") * block
    return blocks.withColumn(name, F.explode(F.sequence(first + 1, F.least(first + block, F.col("_count"))))).drop("_count", "_block")


def explode_spans(df: DataFrame, spans: Column, name: str) -> DataFrame:
    """A row for each integer of the spans, which may run up or down, as ``text.signed_spans`` gives them.

    No array is longer than a block of ``explode_upto``, however wide a span is.
    """
    each = df.withColumn("_s", F.explode(spans)).withColumn("_from", F.col("_s.first")).withColumn("_to", F.col("_s.last")).drop("_s")
    counted = explode_upto(each, F.abs(F.col("_to") - F.col("_from")) + 1, "_k")
    step = F.when(F.col("_from") <= F.col("_to"), F.col("_k") - 1).otherwise(1 - F.col("_k"))
    return counted.withColumn(name, F.col("_from") + step).drop("_from", "_to", "_k")


def with_global_ordinal(df: DataFrame, order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """0-based rank of each row in a total order, found by a range-partitioned sort.

    The sorted rows are written so that the partition counts and the rows agree.
    """
    fixed = durable(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    # The high bits of the id are the partition, the low 33 bits the row inside it.
    fixed = fixed.withColumn("_part", F.shiftright("_row", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, however many rows there are.
    shifts = (
        fixed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    inner = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return fixed.join(shifts, "_part").withColumn(name, inner + F.col("_shift")).drop("_row", "_part", "_shift")
