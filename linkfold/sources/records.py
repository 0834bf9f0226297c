"""Child lines of the hierarchical files, one flat row per child.

Every function takes ``mains`` (rows of its file as made by ``parse_tables``) and the corpus
``lines`` and gives ``dataset_id, table_name, file_name, main_line, ord, line_no, values``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkfold.functions import text
from linkfold.session import attached
from linkfold.sources.tables import FILE, child_lines

# Column names of the child lines of each file.
SOIL_MAIN = ("name", "nly", "hyd_grp", "dp_tot", "anion_excl", "perc_crk", "texture")
SOIL_LAYER = (
    "dp", "bd", "awc", "soil_k", "carbon", "clay", "silt", "sand", "rock", "alb", "usle_k", "ec", "caco3", "ph",
)
PLANT_MEMBER = ("plnt_name", "lc_status", "lai_init", "bm_init", "phu_init", "plnt_pop", "yrs_init", "rsd_init")
AUTO_LINE = ("d_table", "plant1", "plant2")
OPERATION_LINE = ("op_typ", "mon", "day", "hu_sch", "op_data1", "op_data2", "op_data3")
MONTH_LINE = (
    "tmp_max_ave", "tmp_min_ave", "tmp_max_sd", "tmp_min_sd", "pcp_ave", "pcp_sd", "pcp_skew", "wet_dry", "wet_wet",
    "pcp_days", "pcp_hhr", "slr_ave", "dew_ave", "wnd_ave",
)
DEPOSITION = ("nh4_wet", "no3_wet", "nh4_dry", "no3_dry")


def named_cells(names: tuple[str, ...], tokens: Column, **extra: Column) -> Column:
    entries = [item for i, n in enumerate(names) for item in (F.lit(n), text.cell(tokens, i))]
    entries += [item for name, value in extra.items() for item in (F.lit(name), value)]
    return F.create_map(*entries)


def _flat(children: DataFrame, values: Column) -> DataFrame:
    return children.filter(~text.is_blank(F.col("raw"))).select(
        "dataset_id", "table_name", "file_name", "main_line", "ord", "line_no", values.alias("values")
    )


def soil_profiles(mains: DataFrame) -> DataFrame:
    """Profile rows with their eight main fields; what follows the seventh is the description."""
    tokens = F.col("tokens")
    count = F.coalesce(text.integer(F.get(tokens, F.lit(1))), F.lit(0))
    description = F.array_join(F.slice(tokens, F.lit(8), F.greatest(F.size(tokens), F.lit(1))), " ")
    fields = named_cells(SOIL_MAIN, tokens, description=description)
    overlay = F.map_concat(
        fields, F.map_filter("values", lambda k, _: ~F.array_contains(F.map_keys(fields), k))
    )
    layers = F.when(count == 0, F.lit("")).otherwise(count.cast("string"))
    return mains.withColumn(
        "values", F.transform_values(overlay, lambda k, v: F.when(k == "nly", layers).otherwise(v))
    )


def soil_layers(mains: DataFrame, lines: DataFrame) -> DataFrame:
    count = text.integer(F.get("tokens", F.lit(1)))
    children = child_lines(mains, lines, count)
    return _flat(children, named_cells(SOIL_LAYER, F.col("tokens"), layer=F.col("ord").cast("string")))


def plant_members(mains: DataFrame, lines: DataFrame) -> DataFrame:
    children = child_lines(mains, lines, plant_count())
    return _flat(children, named_cells(PLANT_MEMBER, F.col("tokens")))


def plant_count() -> Column:
    given = text.integer(F.try_element_at("values", F.lit("plnt_cnt")))
    return F.when(given > 0, given).otherwise(text.integer(F.get("tokens", F.lit(1))))


def management_counts(mains: DataFrame) -> DataFrame:
    """``numb_auto`` and ``numb_ops`` of each schedule, from named cells or token positions."""

    def count(name: str, at: int) -> Column:
        named = F.nullif(F.try_element_at("values", F.lit(name)), F.lit(""))
        by_place = F.when(F.size("tokens") >= 3, F.get("tokens", F.lit(at)))
        return F.greatest(F.coalesce(text.integer(F.coalesce(named, by_place)), F.lit(0)), F.lit(0))

    return mains.withColumn("numb_ops", count("numb_ops", 1)).withColumn("numb_auto", count("numb_auto", 2))


def management_ops(mains: DataFrame, lines: DataFrame) -> DataFrame:
    """Automatic lines first, then operation lines.

    ``op_data1`` is the fifth token as shown to users; ``op_ref`` is the seventh, which references
    are taken from.
    """
    counted = management_counts(mains)
    children = child_lines(counted, lines, F.col("numb_auto") + F.col("numb_ops"))
    tokens = F.col("tokens")
    auto = named_cells(AUTO_LINE, tokens, name=text.cell(tokens, 0), section=F.lit("auto"))
    op = named_cells(OPERATION_LINE, tokens, op_ref=text.cell(tokens, 6), section=F.lit("op"))
    return _flat(children, F.when(F.col("ord") <= F.col("numb_auto"), auto).otherwise(op))


def generator_months(mains: DataFrame, lines: DataFrame) -> DataFrame:
    """Twelve month lines per station; the line right below the station is a header."""
    children = child_lines(mains, lines, F.lit(12), skip=1)
    return _flat(children, named_cells(MONTH_LINE, F.col("tokens"), month=F.col("ord").cast("string")))


def deposition_blocks(mains: DataFrame, lines: DataFrame) -> DataFrame:
    """Stations with their four deposition series.

    Each station takes five lines; the last value of a series is dropped if there is more than one.
    ``dataset_id, file_name, main_line, station, line_no, station_name`` and per series its values
    (``array<string>``) and line.
    """

    def count(name: str) -> Column:
        return F.coalesce(text.integer(F.try_element_at("values", F.lit(name))), F.lit(0))

    stations = F.when((count("num_sta") > 0) & (count("num_aa") > 0), count("num_sta") * 5).otherwise(0)
    children = child_lines(mains, lines, stations)
    series = F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - 1, F.lit(1)))
    aggregates = [
        F.max(F.when(F.col("_part") == 0, F.col("line_no"))).alias("line_no"),
        F.max(F.when(F.col("_part") == 0, F.trim("raw"))).alias("station_name"),
    ]
    for i, name in enumerate(DEPOSITION, start=1):
        here = (F.col("_part") == i) & (F.size("tokens") > 0)
        aggregates.append(F.max(F.when(here, series)).alias(name))
        aggregates.append(F.max(F.when(here, F.col("line_no"))).alias(f"{name}_line"))
    return (
        children.withColumn("_part", F.pmod(F.col("ord") - 1, F.lit(5)))
        .withColumn("station", F.floor((F.col("ord") - 1) / 5) + 1)
        .groupBy(*FILE, "main_line", "station")
        .agg(*aggregates)
        .filter("line_no is not null")
    )


def deposition_children(mains: DataFrame, lines: DataFrame) -> DataFrame:
    """Stations and their series as child lines: the name, or the kind and the values, by position."""
    blocks = deposition_blocks(mains, lines)
    station = F.struct(
        F.col("line_no").alias("line_no"), F.create_map(F.lit("station_name"), F.col("station_name"), F.lit("section"), F.lit("station")).alias("values")
    )
    series = [
        F.struct(
            F.col(f"{name}_line").alias("line_no"),
            F.create_map(F.lit("section"), F.lit(name), F.lit("values"), F.array_join(name, " ")).alias("values"),
        )
        for name in DEPOSITION
    ]
    tables = mains.select(*FILE, F.col("line_no").alias("main_line"), "table_name")
    return (
        blocks.join(tables, [*FILE, "main_line"])
        .select("dataset_id", "table_name", "file_name", "main_line", F.inline(F.filter(F.array(station, *series), lambda x: x["line_no"].isNotNull())))
        .withColumn("ord", (F.col("line_no") - F.col("main_line")).cast("int"))
        .select("dataset_id", "table_name", "file_name", "main_line", "ord", "line_no", "values")
    )


def weather_series(lines: DataFrame, columns: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """Station weather files: ``(stations, data)``.

    ``columns`` maps a file suffix to the column names of its table. A file holds a comment line,
    a header, a station line and then data; every file may be far larger than a task, so the data
    lines are split where they are and only joined with the one-row-per-file station frame.
    """
    suffix = text.suffix(F.col("file_name"))
    inside = lines.filter(suffix.isin(list(columns))).withColumn("_suffix", suffix)
    table = lambda names: F.create_map(
        *[x for s, c in columns.items() for x in (F.lit(s), F.array(*[F.lit(n) for n in names(c)]))]
    )
    full = inside.filter(~text.is_blank(F.col("raw")) & (F.col("line_no") > 1))
    # Minima merge map-side, so finding the two head lines moves one row per file and task.
    header = full.groupBy(*FILE).agg(F.min("line_no").alias("_header"))
    station = (
        full.join(attached(header), FILE)
        .filter(F.col("line_no") > F.col("_header"))
        .groupBy(*FILE)
        .agg(F.min_by(F.struct("line_no", "raw"), "line_no").alias("_s"))
        .select(*FILE, F.col("_s.line_no").alias("station_line"), F.col("_s.raw").alias("_station"))
    )
    station = attached(station)
    comment = inside.filter("line_no = 1").select(*FILE, F.trim("raw").alias("_comment"))
    station_columns = ("nbyr", "tstep", "lat", "lon", "elev")
    tokens = text.tokens(F.col("_station"))
    names = F.try_element_at(table(lambda c: c), F.col("_suffix"))
    placed = F.try_element_at(table(lambda c: [n for n in station_columns if n in c]), F.col("_suffix"))
    title = F.when(F.coalesce(F.col("_comment"), F.lit("")) == "", F.col("file_name")).otherwise(F.col("_comment"))
    value = lambda n: (
        F.when(n == "name", title)
        .when(F.array_contains(placed, n), F.coalesce(F.get(tokens, (F.array_position(placed, n) - 1).cast("int")), F.lit("")))
        .otherwise(F.lit(""))
    )
    stations = (
        station.join(comment, FILE, "left")
        .withColumn("_suffix", suffix)
        .select(
            *FILE,
            "_suffix",
            "station_line",
            F.map_from_arrays(names, F.transform(names, value)).alias("values"),
            F.when(F.array_contains(names, "name"), title).otherwise(F.col("file_name")).alias("pk_value"),
        )
    )
    data_names = F.try_element_at(
        table(lambda c: [n for n in ("year", "month", "value") if n in c] or list(c)), F.col("_suffix")
    )
    cells = text.tokens(F.col("raw"))
    width = F.greatest(F.size(data_names), F.size(cells))
    labels = F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda i: F.coalesce(F.get(data_names, i), F.concat(F.lit("col"), (i + 1).cast("string"))),
    )
    data = (
        inside.join(station.select(*FILE, "station_line"), FILE)
        .filter((F.col("line_no") > F.col("station_line")) & ~text.is_blank(F.col("raw")))
        .select(
            *FILE,
            "line_no",
            F.map_from_arrays(
                labels, F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(cells, i), F.lit("")))
            ).alias("values"),
        )
    )
    return stations.drop("_suffix"), data
