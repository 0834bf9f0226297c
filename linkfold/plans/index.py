"""Build an index of a corpus, and check it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkfold.catalog import WEATHER_TABLES, Catalog
from linkfold.functions import text
from linkfold.operators import checks, refs, report
from linkfold.session import attached, durable
from linkfold.sources import decisions, filelist, lines as line_source, records, tables
from linkfold.sources.tables import FILE


@dataclass
class Index:
    """Frames of an indexed corpus.

    The text is read once, into a line store. Rows, children and references are written to the shared folder
    once, each when it is built, so that checks and lookups do not parse the text again.
    """

    catalog: Catalog
    inventory: DataFrame
    lines: DataFrame
    bound: DataFrame
    entries: DataFrame
    rows: DataFrame
    children: DataFrame
    refs: DataFrame
    resolved: DataFrame

    def stats(self) -> DataFrame:
        return report.index_stats(self.rows, self.resolved)

    def preflight(self) -> DataFrame:
        issues = checks.format_issues(self.lines, self.bound, self.catalog)
        pointers = refs.missing_file_pointers(self.rows, self.inventory, self.catalog)
        missing = refs.missing_target_tables(self.resolved, self.rows, self.catalog)
        counts = self.resolved.groupBy(
            "dataset_id", "source_table", "source_column", "target_table", "target_column", "resolved"
        ).agg(F.count(F.lit(1)).alias("n"))
        orphans = refs.orphan_rows(self.rows, self.resolved)
        return report.preflight_report(self.stats(), issues, pointers, missing, counts, orphans)


def build_index(
    spark: SparkSession,
    path: str | list[str],
    catalog: Catalog,
    include_weather: bool = False,
    pointer_mode: str = "strict",
    whole_files: bool = False,
) -> Index:
    """Index every dataset below ``path`` in one plan."""
    inventory = durable(line_source.list_inventory(spark, path))
    scanned = line_source.scan_lines(spark, path, whole_files, input_glob(catalog, include_weather))
    lines = line_source.dataset_lines(scanned, inventory)
    return index_lines(lines, line_source.dataset_files(inventory), catalog, include_weather, pointer_mode)


def input_glob(catalog: Catalog, include_weather: bool) -> str:
    """Glob of the file suffixes an index reads; outputs with other suffixes are never opened."""
    names = [t.file_name for t in catalog.tables] + list(catalog.table_files.values())
    suffixes = {n.rsplit(".", 1)[1] for n in names if "." in n} | {"cio", "dtl"}
    if include_weather:
        suffixes |= {s.lstrip(".") for s in WEATHER_TABLES}
    return "*.{" + ",".join(sorted(suffixes)) + "}"


def index_lines(
    lines: DataFrame,
    inventory: DataFrame,
    catalog: Catalog,
    include_weather: bool = False,
    pointer_mode: str = "strict",
) -> Index:
    """Index of given corpus lines and file inventory; each reader takes the kinds of files it needs."""
    def of(schema_file: str) -> DataFrame:
        return line_source.of_kinds(lines, *_kinds(catalog, schema_file))

    listed = line_source.of_kinds(lines, ".cio").filter(F.lower("file_name") == filelist.FILE_LIST)
    entries = durable(filelist.file_list_entries(listed, catalog))
    bound = attached(filelist.bind_files(inventory, catalog, entries))
    tabular = bound.filter(
        (F.lower("file_name") != filelist.FILE_LIST) & ~F.col("file_name").endswith(".dtl")
    )
    headers = tables.resolve_header(lines, tabular, catalog)
    plain = durable(tables.parse_tables(lines, headers, catalog))

    # By the schema's file: a bound file may be spelled with other separators.
    only = lambda name: plain.filter(F.col("schema_file") == name)
    soils = records.soil_profiles(only("soils.sol"))
    schedules = only("management.sch")
    dtl_rows, dtl_children = decisions.decision_tables(line_source.of_kinds(lines, ".dtl"), decisions.decision_table_names(inventory, bound))
    dtl_children = durable(dtl_children)
    operations = durable(records.management_ops(schedules, of("management.sch")))
    children = durable(
        records.soil_layers(soils, of("soils.sol"))
        .unionByName(records.plant_members(only("plant.ini"), of("plant.ini")))
        .unionByName(operations)
        .unionByName(records.generator_months(only("weather-wgn.cli"), of("weather-wgn.cli")))
        .unionByName(records.deposition_children(only("atmo.cli"), of("atmo.cli")))
        .unionByName(dtl_children)
    )
    list_rows = entries.select(
        "dataset_id",
        F.lit("file_cio").alias("table_name"),
        F.lit(filelist.FILE_LIST).alias("file_name"),
        "line_no",
        F.col("row_id").cast("string").alias("pk_value"),
        F.col("row_id").cast("string").alias("pk_lc"),
        F.create_map(
            F.lit("id"), F.col("row_id").cast("string"),
            F.lit("classification"), F.col("classification"),
            F.lit("order_in_class"), F.col("order_in_class").cast("string"),
            F.lit("file_name"), F.col("file_name"),
            F.lit("customization"), F.col("customization"),
        ).alias("values"),
    )
    kept = ["dataset_id", "table_name", "file_name", "line_no", "pk_value", "pk_lc", "values"]
    text_rows = plain.filter("schema_file <> 'soils.sol'").select(*kept).unionByName(soils.select(*kept))
    rows = text_rows.unionByName(dtl_rows.select(*kept)).unionByName(list_rows)
    if include_weather:
        rows = rows.unionByName(_weather_rows(lines, catalog, bound).select(*kept))
    rows = durable(rows)
    found = (
        refs.extract_fk_refs(text_rows, catalog, pointer_mode)
        .unionByName(refs.management_refs(operations, catalog))
        .unionByName(refs.dtl_action_refs(dtl_children, catalog))
    )
    resolved = durable(refs.resolve_refs(found, rows))
    return Index(catalog, inventory, lines, bound, entries, rows, children, found, resolved)


def _kinds(catalog: Catalog, schema_file: str) -> set[str]:
    """Suffixes of the files that a schema file's table may be bound to."""
    names = [schema_file, *(catalog.table_files.get(t.table_name) for t in catalog.tables if t.file_name == schema_file)]
    return {"." + n.lower().rsplit(".", 1)[1] for n in names if n and "." in n}


def weather_columns(catalog: Catalog) -> dict[str, tuple[str, ...]]:
    """Column names per weather file suffix, for the tables the catalog has."""
    known = {t.file_name: t for t in catalog.tables}
    return {
        suffix: tuple(c.name for c in known[file].columns if c.type != "AutoField")
        for suffix, file in WEATHER_TABLES.items()
        if file in known
    }


def _weather_rows(lines: DataFrame, catalog: Catalog, bound: DataFrame) -> DataFrame:
    """Station rows of weather data files that are no catalog tables themselves."""
    names = {suffix: catalog.table(WEATHER_TABLES[suffix]).table_name for suffix in weather_columns(catalog)}
    loose = line_source.of_kinds(lines, *WEATHER_TABLES).join(bound.select(*FILE), FILE, "left_anti")
    stations, _ = records.weather_series(loose, weather_columns(catalog))
    return stations.select(
        "dataset_id",
        text.lookup(text.suffix(F.col("file_name")), names).alias("table_name"),
        "file_name",
        F.col("station_line").alias("line_no"),
        "pk_value",
        F.lower("pk_value").alias("pk_lc"),
        "values",
    )
