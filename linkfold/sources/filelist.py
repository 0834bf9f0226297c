"""The master file list of a dataset and the binding of files to catalog tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from linkfold.catalog import Catalog, bounded
from linkfold.functions import text
from linkfold.functions.ordinals import with_ordinal

FILE_LIST = "file.cio"

# Files each classification of the master list names, by position.
EXPECTED_FILES = {
    "simulation": (
        "time.sim",
        "print.prt",
        "object.prt",
        "object.cnt",
        "constituents.cs",
    ),
    "basin": (
        "codes.bsn",
        "parameters.bsn",
    ),
    "climate": (
        "weather-sta.cli",
        "weather-wgn.cli",
        "wind-dir.cli",
        "pcp.cli",
        "tmp.cli",
        "slr.cli",
        "hmd.cli",
        "wnd.cli",
        "atmo.cli",
    ),
    "connect": (
        "hru.con",
        "hru-lte.con",
        "rout_unit.con",
        "gwflow.con",
        "aquifer.con",
        "aquifer2d.con",
        "channel.con",
        "reservoir.con",
        "recall.con",
        "exco.con",
        "delratio.con",
        "outlet.con",
        "chandeg.con",
    ),
    "channel": (
        "initial.cha",
        "channel.cha",
        "hydrology.cha",
        "sediment.cha",
        "nutrients.cha",
        "sed_nut.cha",
        "channel-lte.cha",
        "hyd-sed-lte.cha",
        "temperature.cha",
    ),
    "reservoir": (
        "initial.res",
        "reservoir.res",
        "hydrology.res",
        "sediment.res",
        "nutrients.res",
        "weir.res",
        "wetland.wet",
        "hydrology.wet",
    ),
    "routing_unit": (
        "rout_unit.def",
        "rout_unit.ele",
        "rout_unit.rtu",
        "rout_unit.dr",
    ),
    "hru": (
        "hru-data.hru",
        "hru-lte.hru",
    ),
    "exco": (
        "exco.exc",
        "exco_om.exc",
        "exco_pest.exc",
        "exco_path.exc",
        "exco_hmet.exc",
        "exco_salt.exc",
    ),
    "recall": (
        "recall.rec",
    ),
    "dr": (
        "del_ratio.del",
        "dr_om.del",
        "dr_pest.del",
        "dr_path.del",
        "dr_hmet.del",
        "dr_salt.del",
    ),
    "aquifer": (
        "initial.aqu",
        "aquifer.aqu",
    ),
    "herd": (
        "animal.hrd",
        "herd.hrd",
        "ranch.hrd",
    ),
    "water_rights": (
        "water_allocation.wro",
    ),
    "link": (
        "chan-surf.lin",
        "aqu_cha.lin",
    ),
    "hydrology": (
        "hydrology.hyd",
        "topography.hyd",
        "field.fld",
    ),
    "structural": (
        "tiledrain.str",
        "septic.str",
        "filterstrip.str",
        "grassedww.str",
        "bmpuser.str",
    ),
    "hru_parm_db": (
        "plants.plt",
        "fertilizer.frt",
        "tillage.til",
        "pesticide.pes",
        "pathogens.pth",
        "metals.mtl",
        "salt.slt",
        "urban.urb",
        "septic.sep",
        "snow.sno",
    ),
    "ops": (
        "harv.ops",
        "graze.ops",
        "irr.ops",
        "chem_app.ops",
        "fire.ops",
        "sweep.ops",
    ),
    "lum": (
        "landuse.lum",
        "management.sch",
        "cntable.lum",
        "cons_practice.lum",
        "ovn_table.lum",
    ),
    "chg": (
        "cal_parms.cal",
        "calibration.cal",
        "codes.sft",
        "wb_parms.sft",
        "water_balance.sft",
        "ch_sed_budget.sft",
        "ch_sed_parms.sft",
        "plant_parms.sft",
        "plant_gro.sft",
    ),
    "init": (
        "plant.ini",
        "soil_plant.ini",
        "om_water.ini",
        "pest_hru.ini",
        "pest_water.ini",
        "path_hru.ini",
        "path_water.ini",
        "hmet_hru.ini",
        "hmet_water.ini",
        "salt_hru.ini",
        "salt_water.ini",
    ),
    "soils": (
        "soils.sol",
        "nutrients.sol",
        "soils_lte.sol",
    ),
    "decision_table": (
        "lum.dtl",
        "res_rel.dtl",
        "scen_lu.dtl",
        "flo_con.dtl",
    ),
    "regions": (
        "ls_unit.ele",
        "ls_unit.def",
        "ls_reg.ele",
        "ls_reg.def",
        "ls_cal.reg",
        "ch_catunit.ele",
        "ch_catunit.def",
        "ch_reg.def",
        "aqu_catunit.ele",
        "aqu_catunit.def",
        "aqu_reg.def",
        "res_catunit.ele",
        "res_catunit.def",
        "res_reg.def",
        "rec_catunit.ele",
        "rec_catunit.def",
        "rec_reg.def",
    ),
}


def file_list_entries(lines: DataFrame, catalog: Catalog) -> DataFrame:
    """One row per file named in the master list.

    ``dataset_id, line_no, row_id, classification, order_in_class, file_name, customization,
    is_default``; ``lines`` holds the master list only.
    """
    tok = text.tokens(F.col("raw"))
    named = (
        lines.filter((F.col("line_no") > 1) & ~text.is_blank(F.col("raw")) & ~F.ltrim("raw").startswith("#"))
        .withColumn("_tok", tok)
        .filter(F.size("_tok") >= 2)
        .select(
            "dataset_id",
            "line_no",
            F.get("_tok", F.lit(0)).alias("classification"),
            F.posexplode(F.slice("_tok", F.lit(2), F.size("_tok"))).alias("_i", "file_name"),
        )
        .withColumn("order_in_class", F.col("_i") + 1)
        .drop("_i")
    )
    return with_ordinal(named, ["dataset_id"], "line_no", "row_id", ["order_in_class"]).select(
        "dataset_id",
        "line_no",
        "row_id",
        "classification",
        "order_in_class",
        "file_name",
        F.lit("0").alias("customization"),
        text.is_sentinel(F.col("file_name"), catalog.null_sentinels).alias("is_default"),
    )


def file_list_header(title: DataFrame) -> DataFrame:
    """Editor version, model revision and date from the title line (``dataset_id, raw``)."""
    raw = F.col("raw")

    def part(pattern: str):
        return F.nullif(F.regexp_extract(raw, pattern, 1), F.lit(""))

    return title.select(
        "dataset_id",
        F.nullif(F.trim(raw), F.lit("")).alias("raw"),
        part(r"(?i)written\s+by\s+\S+\s*editor\s*v?([0-9.]+)").alias("editor_version"),
        part(r"(?i)for\s+\S+\s*rev\.?([0-9.]+)").alias("model_revision"),
        part(r"(?i)on\s+([0-9]{4}-[0-9]{2}-[0-9]{2}\s+[0-9:]{2,5})").alias("generated_on"),
    )


def referenced_files(entries: DataFrame) -> DataFrame:
    """Distinct real file names of the list, per dataset."""
    return (
        entries.filter(~F.col("is_default") & F.contains("file_name", F.lit(".")))
        .select("dataset_id", "file_name")
        .distinct()
    )


def classification(entries: DataFrame, name: str) -> DataFrame:
    return entries.filter(F.lower("classification") == name.lower())


def is_referenced(entries: DataFrame, file_name: str) -> DataFrame:
    """Datasets whose list names the file."""
    return entries.filter(~F.col("is_default") & (F.col("file_name") == file_name)).select("dataset_id").distinct()


def class_summary(entries: DataFrame) -> DataFrame:
    """Customised and total entries per classification.

    A classification that occurs on several lines counts with its last line.
    """
    low = F.lower("classification").alias("classification")
    per_line = entries.groupBy("dataset_id", low, "line_no").agg(
        F.count_if(~F.col("is_default")).alias("customized"), F.count(F.lit(1)).alias("total")
    )
    return (
        per_line.groupBy("dataset_id", "classification")
        .agg(F.max_by(F.struct("customized", "total"), "line_no").alias("_s"))
        .select("dataset_id", "classification", "_s.customized", "_s.total")
    )


def missing_listed_files(entries: DataFrame, inventory: DataFrame) -> DataFrame:
    """Files the list names that the dataset does not have."""
    present = inventory.select("dataset_id", "file_name")
    return entries.filter(~F.col("is_default") & F.contains("file_name", F.lit("."))).join(
        present, ["dataset_id", "file_name"], "left_anti"
    )


def expected_vs_actual(
    entries: DataFrame,
    inventory: DataFrame,
    rows: DataFrame,
    catalog: Catalog,
    expected: Mapping[str, Sequence[str | None]] | None = None,
) -> DataFrame:
    """Expected against listed file per classification and position.

    ``expected`` has the file names of each classification by position, None where a position is unused.
    ``is_indexed`` says that the listed file exists and its table has rows.
    """
    plan = []
    for name, files in (EXPECTED_FILES if expected is None else expected).items():
        if isinstance(files, str):
            raise TypeError(f"a sequence of file names is wanted for {name!r}, not a text")
        plan += [(name, i + 1, file) for i, file in enumerate(files) if file is not None]
    slots = F.array(
        *[F.struct(F.lit(c).alias("classification"), F.lit(p).alias("position"), F.lit(f).alias("expected_file")) for c, p, f in plan]
    )
    # Every dataset is measured against the same fixed plan, a few hundred entries at most.
    wanted = entries.select("dataset_id").distinct().select("dataset_id", F.inline(slots))
    listed = (
        entries.groupBy(
            "dataset_id", F.lower("classification").alias("classification"), F.col("order_in_class").alias("position")
        )
        .agg(F.max_by("file_name", "row_id").alias("_name"))
        .withColumn("actual_file", F.when(F.col("_name") != "null", F.col("_name")))
        .drop("_name")
    )
    files = {t.file_name: t.table_name for t in catalog.tables}
    indexed = rows.select("dataset_id", "table_name").distinct().withColumn("_rows", F.lit(True))
    present = inventory.select("dataset_id", F.col("file_name").alias("actual_file")).distinct().withColumn(
        "_file", F.lit(True)
    )
    return (
        wanted.join(listed, ["dataset_id", "classification", "position"], "left")
        .join(present, ["dataset_id", "actual_file"], "left")
        .withColumn(
            "table_name", text.lookup(F.col("actual_file"), files, F.replace("actual_file", F.lit("."), F.lit("_")))
        )
        .join(indexed, ["dataset_id", "table_name"], "left")
        .withColumn("is_indexed", F.coalesce(F.col("_file") & F.col("_rows"), F.lit(False)))
        .select("dataset_id", "classification", "position", "expected_file", "actual_file", "is_indexed")
    )


def indexed_counts(compared: DataFrame) -> DataFrame:
    """How many of each classification's expected places have an indexed file: ``dataset_id, classification, indexed, expected``."""
    return compared.groupBy("dataset_id", "classification").agg(
        F.count_if("is_indexed").alias("indexed"), F.count(F.lit(1)).alias("expected")
    )


def bind_files(inventory: DataFrame, catalog: Catalog, entries: DataFrame | None = None) -> DataFrame:
    """Which file holds which catalog table: ``dataset_id, file_name, schema_file, table_name``.

    Tried in order: the catalog's file name, the metadata's name for the table, dash and underscore
    spellings, and last the only listed file that starts with the catalog file's stem and ends with
    its suffix.
    """
    spark = inventory.sparkSession
    candidates = []
    for t in catalog.tables:
        spellings = [t.file_name, catalog.table_files.get(t.table_name)]
        spellings += [t.file_name.replace("-", "_"), t.file_name.replace("_", "-")]
        seen: set[str] = set()
        for priority, name in enumerate(spellings):
            if name and name not in seen:
                seen.add(name)
                candidates.append((t.table_name, t.file_name, name, priority))
    wanted = bounded(
        spark, candidates, "table_name string, schema_file string, file_name string, priority int"
    )
    named = inventory.select("dataset_id", "file_name").join(wanted, "file_name")
    if entries is not None:
        named = named.unionByName(_listed_candidates(inventory, catalog, entries))
    return (
        named.groupBy("dataset_id", "table_name", "schema_file")
        .agg(F.min_by("file_name", "priority").alias("file_name"))
        .select("dataset_id", "file_name", "schema_file", "table_name")
    )


def _listed_candidates(inventory: DataFrame, catalog: Catalog, entries: DataFrame) -> DataFrame:
    shapes = [
        (t.table_name, t.file_name, t.file_name.lower().rsplit(".", 1)[0], "." + t.file_name.lower().rsplit(".", 1)[1])
        for t in catalog.tables
        if "." in t.file_name
    ]
    plan = bounded(
        inventory.sparkSession, shapes, "table_name string, schema_file string, _stem string, _suffix string"
    )
    listed = entries.filter(~F.col("is_default")).select("dataset_id", F.lower("file_name").alias("_name")).distinct()
    matches = (
        listed.withColumn("_suffix", text.suffix(F.col("_name")))
        .join(plan, "_suffix")
        .filter(F.startswith(F.get(F.split("_name", "[.]"), F.lit(0)), F.col("_stem")))
        .groupBy("dataset_id", "table_name", "schema_file")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_name").alias("file_name"))
        .filter("_n = 1")
    )
    return matches.join(inventory.select("dataset_id", "file_name"), ["dataset_id", "file_name"], "left_semi").select(
        "dataset_id", "file_name", "table_name", "schema_file", F.lit(9).alias("priority")
    )
