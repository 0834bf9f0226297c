"""Decision tables: blocks of a head line, condition lines and action lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkfold.functions import text
from linkfold.functions.ordinals import with_ordinal
from linkfold.operators.chain import on_chain
from linkfold.session import attached, durable
from linkfold.sources.records import named_cells
from linkfold.sources.tables import FILE

# Columns of condition and action lines before the numbered ones.
CONDITION = ("cond_var", "obj", "obj_num", "lim_var", "lim_op", "lim_const")
ACTION = ("act_typ", "obj", "obj_num", "act_name", "act_option", "const", "const2", "fp")


def decision_table_names(inventory: DataFrame, bound: DataFrame) -> DataFrame:
    """Table name of every ``.dtl`` file: the catalog's, else derived from the file name."""
    known = bound.select("dataset_id", F.lower("file_name").alias("file_name_lc"), "table_name")
    return (
        inventory.filter(F.col("file_name").endswith(".dtl"))
        .select("dataset_id", "file_name", F.lower("file_name").alias("file_name_lc"))
        .join(known, ["dataset_id", "file_name_lc"], "left")
        .select(*FILE, F.coalesce("table_name", text.table_of_file(F.col("file_name"))).alias("table_name"))
    )


def decision_tables(lines: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, children)`` of all decision table files.

    A file states its number of tables on line 2. A table is a head line ``name conds alts acts``,
    an optional column line, ``conds`` condition lines (blank lines between them do not count), an
    optional column line, and ``acts`` action lines (blank lines do count). Where a table ends
    decides where the next begins, so the heads are found by following the chain of line numbers.
    """
    inside = (
        lines.filter(F.col("file_name").endswith(".dtl"))
        .join(attached(names), FILE)
        .withColumn("tokens", text.tokens(F.col("raw")))
    )
    stated = F.max(F.when(F.col("line_no") == 2, text.integer(F.trim("raw"))))
    files = inside.groupBy(*FILE).agg(stated.alias("_tables"), F.max("line_no").alias("_last"))
    files = attached(files.filter("_tables >= 0"))
    # Only decision table files get here; their lines are looked up by several keys below.
    body = durable(inside.join(files, FILE).filter("line_no >= 3").drop("raw"))
    filled = durable(
        with_ordinal(body.filter(F.size("tokens") > 0), FILE, "line_no", "k").withColumn(
            "_upper", F.upper(F.get("tokens", F.lit(0)))
        )
    )
    spot = filled.select(*FILE, "k", F.col("line_no").alias("_line"), "_upper")

    number = lambda i: text.integer(F.get("tokens", F.lit(i)))
    heads = (
        filled.filter(~F.col("_upper").startswith("NAME") & ~F.col("_upper").startswith("DTBL_NAME"))
        .withColumn("conds", number(1))
        .withColumn("alts", number(2))
        .withColumn("acts", number(3))
        .filter("conds is not null and alts is not null and acts is not null")
        # A count can claim no more lines than the file has.
        .withColumn("_conds", F.least(F.greatest("conds", F.lit(0)), F.col("_last")))
        .withColumn("_acts", F.least(F.greatest("acts", F.lit(0)), F.col("_last")))
        .drop("_upper")
    )
    after = spot.select(
        *FILE, (F.col("k") - 1).alias("k"), F.startswith("_upper", F.lit("COND_VAR")).cast("int").alias("_skip")
    )
    heads = heads.join(after, [*FILE, "k"], "left").withColumn("_cond_k", F.col("k") + 1 + F.coalesce("_skip", F.lit(0)))
    tail = spot.select(
        *FILE,
        F.col("k").alias("_act_k"),
        (F.col("_line") + F.startswith("_upper", F.lit("ACT_TYP")).cast("int")).alias("_act_line"),
    )
    heads = heads.withColumn("_act_k", F.col("_cond_k") + F.col("_conds")).join(tail, [*FILE, "_act_k"], "left")
    # A table whose actions lie behind the end of the file takes the rest of it.
    heads = heads.withColumn(
        "_end", F.coalesce(F.col("_act_line") + F.col("_acts"), F.col("_last") + 1)
    )
    heads = durable(heads)
    nodes = body.select(*FILE, F.col("line_no").alias("pos")).join(
        heads.select(*FILE, F.col("line_no").alias("pos"), "_end"), [*FILE, "pos"], "left"
    )
    nodes = nodes.withColumn("nxt", F.coalesce(F.greatest("_end", F.col("pos") + 1), F.col("pos") + 1))
    starts = files.select(*FILE, F.lit(3).cast("bigint").alias("pos")).filter("_last >= 3")
    reached = on_chain(nodes, FILE, starts).withColumnRenamed("pos", "line_no")
    real = with_ordinal(heads.join(reached, [*FILE, "line_no"], "left_semi"), FILE, "line_no", "_nth")
    real = real.filter(F.col("_nth") <= F.col("_tables"))

    name = F.get("tokens", F.lit(0))
    rows = real.select(
        "dataset_id",
        "table_name",
        "file_name",
        "line_no",
        name.alias("pk_value"),
        F.lower(name).alias("pk_lc"),
        F.create_map(
            F.lit("name"), name,
            F.lit("conds"), F.col("conds").cast("string"),
            F.lit("alts"), F.col("alts").cast("string"),
            F.lit("acts"), F.col("acts").cast("string"),
        ).alias("values"),
        "tokens",
    )
    return rows, _children(real, filled, body)


def _children(real: DataFrame, filled: DataFrame, body: DataFrame) -> DataFrame:
    head = real.select(*FILE, "table_name", F.col("line_no").alias("main_line"), "alts", "_conds", "_acts", "_cond_k", "_act_line")

    def numbered(prefix: str):
        labels = F.when(F.col("alts") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("alts"))).otherwise(
            F.array().cast("array<bigint>")
        )
        return F.transform(labels, lambda n: F.concat(F.lit(prefix), n.cast("string")))

    def with_alternatives(names: tuple[str, ...], prefix: str, section: str):
        fixed = named_cells(names, F.col("tokens"), section=F.lit(section))
        labels = numbered(prefix)
        cells = F.transform(labels, lambda _, i: F.coalesce(F.get("tokens", i + len(names)), F.lit("")))
        return F.map_concat(fixed, F.map_from_arrays(labels, cells))

    wanted_c = head.filter("_conds > 0").select(
        *FILE, "table_name", "main_line", "alts",
        F.posexplode(F.sequence(F.col("_cond_k"), F.col("_cond_k") + F.col("_conds") - 1)).alias("_i", "k"),
    )
    conditions = wanted_c.join(filled.select(*FILE, "k", "line_no", "tokens"), [*FILE, "k"]).select(
        "dataset_id", "table_name", "file_name", "main_line", (F.col("_i") + 1).alias("ord"), "line_no",
        with_alternatives(CONDITION, "alt", "condition").alias("values"),
    )
    wanted_a = head.filter("_acts > 0 and _act_line is not null").select(
        *FILE, "table_name", "main_line", "alts",
        F.posexplode(F.sequence(F.col("_act_line"), F.col("_act_line") + F.col("_acts") - 1)).alias("_i", "line_no"),
    )
    actions = (
        wanted_a.join(body.select(*FILE, "line_no", "tokens"), [*FILE, "line_no"])
        .filter(F.size("tokens") > 0)
        .select(
            "dataset_id", "table_name", "file_name", "main_line", (F.col("_i") + 1).alias("ord"), "line_no",
            with_alternatives(ACTION, "out", "action").alias("values"),
        )
    )
    return conditions.unionByName(actions)


def alternative_count(rows: DataFrame, children: DataFrame) -> DataFrame:
    """Alternatives of each decision table: its stated count, else the widest child line."""
    keys = [*FILE, "main_line"]

    def width(section: str, prefix: str):
        own = F.size(F.filter(F.map_keys("values"), lambda k: F.startswith(k, F.lit(prefix))))
        return F.max(F.when(F.try_element_at("values", F.lit("section")) == section, own))

    widths = children.groupBy(*keys).agg(
        F.greatest(width("condition", "alt"), width("action", "out")).alias("_widest")
    )
    stated = text.integer(F.try_element_at("values", F.lit("alts")))
    return (
        rows.withColumn("main_line", F.col("line_no"))
        .join(widths, keys, "left")
        .select(
            *FILE, "main_line", "pk_value",
            F.when(stated > 0, stated).otherwise(F.coalesce("_widest", F.lit(0)).cast("bigint")).alias("alternatives"),
        )
    )
