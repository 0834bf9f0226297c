"""Filter interaction audit by a recursive query over the orders of the filters.

Every document fails some of the filters: the bits of its mask. All that an audit needs are the mask cells, the
counts of documents by part and mask. A recursive common table expression then extends prefixes of filter orders
by each letter not used yet; every level joins the mask cells of its part, carries the bits applied so far, and
emits the metrics of that step: what the new filter removes, what it would have removed had an earlier one not,
what it alone removes, and what is left. The recursion sees cells only, so its size depends on the number of parts
and filters, not of documents; parts are taken in blocks, so that a block stays below Spark's row limit.

A null text is an empty one, a null ``lang`` the part ``''``. A null id has no smaller id and is none for others.
Repeated rows of one id are no copies of each other, as their ids are equal, and each counts. Of several label rows
of an id, one that says 1 is enough; other columns are not read. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkfold.llm.common import written

#: The letter of the filter that compares a text with those of smaller ids.
COPY = "E"
#: Parts in one recursion. 326 rows a part: Spark ends a recursion of over a million rows.
PARTS = 1500
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails, by letter; ``COPY`` is not among them."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": n < 200,
        "B": 100 * distinct.cast("long") < 50 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], letters: str, text: Column, part: Column) -> DataFrame:
    """(part, mask, n, good, toxic): documents by failed filters; bit i of a mask is letter i, ``COPY`` among them.

    Rows become narrow before anything is shuffled: a digest stands for the text. Rows of one id, text and part
    are counted together first, so that no id or text brings all its rows to one task.
    """
    bits = {letter: 1 << i for i, letter in enumerate(letters)}
    failed = sum((F.when(c, F.lit(bits[k])).otherwise(F.lit(0)) for k, c in filters.items()), F.lit(0))
    narrow = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), part.alias("part"), failed.alias("mask"))
    rows = narrow.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    told = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    rows = rows.join(told.withColumnRenamed("doc_id", "_labelled"), F.col("doc_id") == F.col("_labelled"), "left")
    # Of a text's rows in a cell, all are copies but those of its smallest id in the whole table.
    cell = ["digest", "part", "mask", "good", "toxic"]
    none = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without")
    cells = rows.groupBy(*(F.coalesce(c, F.lit(0)).alias(c) if c in ("good", "toxic") else c for c in cell)).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("lows"), none
    )
    cells = written(cells, "audit-cells")
    first = cells.groupBy("digest").agg(F.min("low").alias("_first")).withColumnRenamed("digest", "_digest")
    known = cells.join(first, F.col("digest") == F.col("_digest"))
    own = F.col("without") + F.when(F.col("low") == F.col("_first"), F.col("lows")).otherwise(F.lit(0))
    split = known.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), own.alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(bits[COPY])).alias("mask"), (F.col("n") - own).alias("n")),
    )).alias("c"))
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic")
    )


_WALK = """
WITH RECURSIVE walk (part, filter_order, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {parts}
  UNION ALL
  SELECT w.part, concat(w.filter_order, l.letter), w.applied | l.bit, w.step + 1,
    aggregate(p.cells, 0L, (a, c) -> a + IF(c.mask & (w.applied | l.bit) = 0, c.n, 0L)),
    aggregate(p.cells, 0L, (a, c) -> a + IF(c.mask & l.bit <> 0 AND c.mask & w.applied = 0, c.n, 0L)),
    aggregate(p.cells, 0L, (a, c) -> a + IF(c.mask & l.bit <> 0 AND c.mask & w.applied <> 0, c.n, 0L)),
    aggregate(p.cells, 0L, (a, c) -> a + IF(c.mask = l.bit, c.n, 0L)),
    aggregate(p.cells, 0L, (a, c) -> a + IF(c.mask & l.bit <> 0 AND c.mask & w.applied = 0, c.good, 0L)),
    aggregate(p.cells, 0L, (a, c) -> a + IF(c.mask & l.bit <> 0 AND c.mask & w.applied = 0, c.toxic, 0L))
  FROM walk w JOIN {parts} p ON w.part = p.part LATERAL VIEW inline({letters}) l AS letter, bit WHERE w.applied & l.bit = 0)
SELECT * FROM walk WHERE step > 0"""


def prefixes(cells: DataFrame, letters: str) -> DataFrame:
    """Every prefix of every order of the letters, with the metrics of its last step, for each part."""
    spark = cells.sparkSession
    # At most one element a mask: a short array for each part.
    parts = written(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "audit-parts")
    many = max(1, -(-parts.count() // PARTS))
    tag = uuid.uuid4().hex
    listed = "array(" + ", ".join(f"struct('{x}', {1 << i})" for i, x in enumerate(letters)) + ")"
    out = None
    for k in range(many):
        name = f"audit_parts_{tag}_{k}"
        parts.filter(F.pmod(F.xxhash64("part"), F.lit(many)) == k).createOrReplaceTempView(name)
        walk = spark.sql(_WALK.format(parts=name, letters=listed))
        out = walk if out is None else out.unionByName(walk)
        spark.catalog.dropTempView(name)
    return written(out, "audit-prefixes")


def audit(docs: DataFrame, labels: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the letters and step, with the step's counts and each filter's Shapley sum."""
    text = F.coalesce(F.col("text"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    cells = mask_cells(docs.select("doc_id", "text", "lang"), labels, text_filters(text), letters, text, part)
    found = prefixes(cells, letters).withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    # A prefix of s letters begins (k - s)! orders: each of them has this step.
    whole = found.filter(F.col("step") == len(letters)).select("part", F.col("filter_order").alias("_order"))
    step = found.withColumnRenamed("filter_order", "_prefix").withColumnRenamed("part", "_part")
    rows = whole.join(step, (F.col("part") == F.col("_part")) & (F.expr("substring(_order, 1, step)") == F.col("_prefix")))
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return rows.withColumn("shapley", shapley).select(
        "part", F.col("_order").alias("filter_order"), "step", "letter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
