"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets counts of words, characters, symbols, repeated lines and repeated three-word windows.
Ratios of these are sketched per (lang, source): a value falls into a logarithmic bin (relative error
``2 ** (1 / STEPS) - 1``), and a sketch is the counts of its bins. Sketches merge by adding counts, in any
order and with equal results, so a group with less than ``min_rows`` rows takes the sketch of its language,
and that of all rows if the language is small too. The thresholds are quantiles of the sketch widened by a
factor, which follow each source instead of being fixed; they are joined back and decide.

Null and empty texts have no words and fail the base rule. Null lang or source is a group like any other.
Repeated rows count each time and get equal verdicts. Only the id, text, lang and source are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from linkfold.llm.common import written

#: Bins for each doubling of a value.
STEPS = 8
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Values measured per document; all but word_length fail when high.
METRICS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "word_length")


@dataclass(frozen=True)
class Params:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Groups with fewer rows use the sketch of the language, or of all rows.
    min_rows: int = 200
    low: float = 0.05
    high: float = 0.90
    #: A value fails beyond the quantile by this factor.
    widen: float = 2.0
    #: High limits of ratios are never below this.
    floor: float = 0.02


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeated_window_words(hashes: Column, n: Column) -> Column:
    """Words in three-word windows found twice or more: positions covered, by the sorted starts of such windows."""
    windows = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))
    )

    def starts(pairs: Column) -> Column:
        same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
        hit = F.filter(pairs, lambda p, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.array_sort(F.transform(hit, lambda p: p["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.coalesce(F.least(F.lit(3), F.get(at, i + 1) - p), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def count(ws: Column) -> Column:
        pairs = F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(
            _bind(F.sort_array(pairs), lambda p: _bind(starts(p), covered))
        )

    return F.when(n < 3, F.lit(0)).otherwise(_bind(windows, count)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document; the text goes no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select("doc_id", "lang", "source", text.alias("_text"), words(F.col("text")).alias("_w"), lines.alias("_l"))
    return split.select(
        "doc_id",
        "lang",
        "source",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all("_text", F.lit(SYMBOLS), F.lit(0))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        _bind(F.transform("_w", lambda w: F.xxhash64(w)), lambda h: repeated_window_words(h, F.size(h))).alias("n_repeat_words"),
    )


def _ratios(d: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.select(
        "*",
        per("n_symbols", "word_chars").alias("symbol_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"),
        per("word_chars", "n_words").alias("word_length"),
    )


def bin_of(value: Column) -> Column:
    """Null for zero, which is below every bin."""
    return F.when(value > 0, F.ceil(F.round(F.log2(value) * STEPS, 9)).cast("int"))


def upper(b: Column) -> Column:
    """Largest value of a bin."""
    return F.when(b.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(2.0), b / STEPS))


def sketches(ratios: DataFrame) -> DataFrame:
    """Bin counts per (lang, source, metric): at most some hundred rows for each, however many documents."""
    return (
        ratios.select("lang", "source", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), bin_of(F.col(m)).alias("bin")) for m in METRICS])))
        .groupBy("lang", "source", "metric", "bin")
        .agg(F.count("*").alias("n"))
    )


def _quantiles(sketch: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """For each group and metric the rows, and the low and high quantile's bin values."""
    from pyspark.sql import Window

    merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    # A group has as many rows here as its sketch has bins.
    by = Window.partitionBy(*keys, "metric")
    run = merged.select(
        "*",
        F.sum("n").over(by.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(by).alias("rows"),
    )
    reach = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("rows") * F.lit(q)), upper(F.col("bin"))))
    return run.groupBy(*keys, "metric", "rows").agg(reach(p.low).alias("low"), reach(p.high).alias("high"))


def thresholds(sketch: DataFrame, p: Params) -> DataFrame:
    """Limits per (lang, source), from the smallest group with ``min_rows`` rows around it."""
    own = _quantiles(sketch, ["lang", "source"], p)
    lang = _quantiles(sketch, ["lang"], p).select("lang", "metric", *[F.col(c).alias(f"l_{c}") for c in ("rows", "low", "high")])
    every = _quantiles(sketch, [], p).select(F.col("metric").alias("_m"), *[F.col(c).alias(f"g_{c}") for c in ("low", "high")])
    joined = (
        own.alias("o")
        .join(lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.metric") == F.col("l.metric")))
        .join(every, F.col("o.metric") == F.col("_m"))
    )
    pick = lambda c: F.when(F.col("rows") >= p.min_rows, F.col(c)).when(F.col("l_rows") >= p.min_rows, F.col(f"l_{c}")).otherwise(F.col(f"g_{c}"))
    limit = joined.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), F.col("o.metric").alias("metric"), pick("low").alias("low"), pick("high").alias("high"))
    cell = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    ratio_limits = [F.greatest(cell(m, "high") * p.widen, F.lit(p.floor)).alias(f"max_{m}") for m in METRICS[:3]]
    return limit.groupBy("lang", "source").agg(
        *ratio_limits, (cell("word_length", "low") / p.widen).alias("min_word_length"), (cell("word_length", "high") * p.widen).alias("max_word_length")
    )


def filter_verdicts(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per document with its counts, limits, ``base_failed`` and ``kept``."""
    # Measured once: the sketches and the verdicts both read this narrow table.
    ratios = _ratios(written(measure(docs.select("doc_id", "text", "lang", "source")), "rules"))
    limits = thresholds(sketches(ratios), p)
    # One row per group on the right; a hot group on the left is split by adaptive execution.
    t = limits.select(F.col("lang").alias("_tl"), F.col("source").alias("_ts"), *limits.columns[2:])
    joined = ratios.join(t, F.col("lang").eqNullSafe(F.col("_tl")) & F.col("source").eqNullSafe(F.col("_ts")), "left").drop("_tl", "_ts")
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))
    within = F.col("word_length").between(F.col("min_word_length"), F.col("max_word_length"))
    for m in METRICS[:3]:
        within = within & (F.col(m) <= F.col(f"max_{m}"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & within)
