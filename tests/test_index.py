"""A small corpus of text files, indexed from disk."""

import pytest
from pyspark.sql import functions as F

from linkfold.catalog import Catalog
from linkfold.operators import refs, report
from linkfold.plans.index import build_index

CHAR, INT, DBL, FK = "CharField", "IntegerField", "DoubleField", "ForeignKeyField"


def table(name, columns, fks=(), keys=("name",), **extra):
    return {
        "table_name": name,
        "has_metadata_line": True,
        "has_header_line": True,
        "data_starts_after": 2,
        "columns": [{"name": "id", "type": "AutoField"}] + [{"name": c, "type": t, "nullable": c != "soil"} for c, t in columns],
        "primary_keys": list(keys),
        "foreign_keys": [{"column": c, "references": {"table": t, "column": "id"}} for c, t in fks],
        **extra,
    }


SCHEMA = {
    "tables": {
        "hru-data.hru": table(
            "hru_data_hru",
            [("name", CHAR), ("soil", FK), ("lu_mgt", FK), ("snow", FK)],
            [("soil", "soils_sol"), ("lu_mgt", "landuse_lum"), ("snow", "snow_sno")],
        ),
        "landuse.lum": table(
            "landuse_lum", [("name", CHAR), ("plnt_com", FK), ("mgt", FK)], [("plnt_com", "plant_ini"), ("mgt", "management_sch")]
        ),
        "soils.sol": table("soils_sol", [("name", CHAR), ("nly", INT), ("hyd_grp", CHAR)]),
        "plant.ini": table("plant_ini", [("name", CHAR), ("plnt_cnt", INT), ("rot_yr_ini", INT)]),
        "management.sch": table("management_sch", [("name", CHAR), ("numb_ops", INT), ("numb_auto", INT)]),
        "weather-wgn.cli": table("weather_wgn_cli", [("name", CHAR), ("lat", DBL), ("lon", DBL), ("elev", DBL), ("rain_yrs", INT)]),
        "weather-sta.cli": table("weather_sta_cli", [("name", CHAR), ("wgn", FK), ("pcp", CHAR)], [("wgn", "weather_wgn_cli"), ("pcp", "pcp_cli")]),
        "atmo.cli": table("atmo_cli", [("num_sta", CHAR), ("timestep", CHAR), ("mo_init", INT), ("yr_init", INT), ("num_aa", INT)], keys=()),
        "lum.dtl": table("lum_dtl", [("name", CHAR)]),
        "tillage.til": table("tillage_til", [("name", CHAR), ("eff", DBL)]),
        "harv.ops": table("harv_ops", [("name", CHAR)]),
        "weather-pcp.pcp": table("weather_pcp", [("name", CHAR), ("nbyr", INT), ("tstep", INT), ("lat", DBL), ("lon", DBL), ("elev", DBL)]),
        "snow.sno": table("snow_sno", [("name", CHAR)]),
    }
}
METADATA = {
    "table_name_to_file_name": {"tillage_til": "tillage.til", "description": "x"},
    "file_pointer_columns": {
        "description": "x",
        "weather-sta.cli": {"pcp": {"description": "Precipitation", "file_pattern": "*.pcp"}, "wg​n": "station name"},
        "landuse.lum": {"description": "x", "mgt": "Pointer to the schedule"},
    },
    "file_purposes": {"soils.sol": "Soil profiles"},
    "file_categories": {"description": "x", "soil": ["soils.sol"]},
    "hierarchical_files": {
        "description": "x",
        "plant.ini": {"structure": {"child_line_count_field": "plnt_cnt"}},
        "weather-wgn.cli": {"structure": {"child_line_count_field": None, "child_line_count_fixed": 13}},
    },
}
MONTHS = "\n".join(f"  {m}.0 {m}.5 " + " ".join(["1"] * 12) for m in range(1, 13))
FILES = {
    "file.cio": "file.cio: written by Model+ editor v2.1.3 on 2024-05-01 10:30 for Model+ rev.60.5\n"
    "simulation time.sim null\n# comment a b\nsoils soils.sol nutrients.sol 0\nops harv.ops tillage_my.til\n",
    "hru-data.hru": "hrus\nNAME soil lu_mgt snow extra\nh1 SoilA corn_lum null\n\nh2 soil_x CORN_LUM snow1 more cells here\nh1 0 wheat_lum",
    "landuse.lum": "lum\nname plnt_com mgt\ncorn_lum Com1 sch_a\nwheat_lum com2 nope",
    "soils.sol": "soils\nname nly hyd_grp dp_tot\nSoilA 2 B 1000 0.5 0.1 loam very deep\n 300 1.4 0.1\n 1000 1.5 0.2 9 1.1\n12345 1 C 500\n 500 1.6 0.3\n",
    "plant.ini": "plants\npcom_name plt_cnt rot_yr_ini\nCom1 2 1\n corn y 0 0\n soyb n\nempty 0 1\ncom2 1 1\n whea y 1",
    "management.sch": "sch\nname numb_ops numb_auto\nsch_a 2 1\n pl_hv corn\n till 4 15 0.0 fldcult null FieldCult 0\n harv 10 1 0.0 a b null 0\nsch_b 0 0\n",
    "weather-wgn.cli": f"wgn\nname lat lon elev rain_yrs\nwgn1 40.1 -90 200 30\n tmp_max tmp_min\n{MONTHS}\nwgn2 41 -91 210 20\n tmp_max tmp_min\n{MONTHS}\n",
    "weather-sta.cli": "sta\nname wgn pcp\ns1 WGN1 p1.pcp\ns2 wgn9 gone.pcp\ns3 null null",
    "p1.pcp": " gauge one\nnbyr tstep lat lon elev\n\n 2 0 40.0 -90.0 100\n2000 1 0.5 x\n2000 2 0.0\n",
    "atmo.cli": "atmo\nnum_sta timestep mo_init yr_init num_aa\n2 mo 1 1990 2\n staA \n 1 2 9\n 3\n 4 5 9\n 6 7 9\nstaB\n1 9\n2 9\n3 9\n4 9\n",
    "lum.dtl": "dtl\n2\n\nNAME CONDS ALTS ACTS\npl_hv 2 2 2\nCOND_VAR OBJ OBJ_NUM LIM_VAR LIM_OP LIM_CONST ALT1 ALT2\n"
    "w_stress hru 0 null - 0.5 > -\n\nmonth null 0 null - 4 = =\nACT_TYP OBJ OBJ_NUM NAME OPT CONST CONST2 FP OUT1 OUT2\n"
    "harvest hru 0 hv grain 0 0 Grain y n\n\nbad 1 x 1 line\nname conds alts acts\nsecond 0 1 1\n fertilize hru 0 ft x 1 2 null y\n",
    "res_rel.dtl": "res\n1\nrel 0 0 0\n",
    "tillage_my.til": "till\nname eff\nfieldcult 0.3\n",
    "harv.ops": "ops\nname\ngrain\n",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for dataset in ("one", "two"):
        folder = root / dataset / "TxtInOut"
        folder.mkdir(parents=True)
        for name, body in FILES.items():
            if dataset == "two" and name in ("harv.ops", "soils.sol"):
                continue
            (folder / name).write_text(body)
    (root / "one" / "notes.txt").write_text("outside of any dataset")
    return build_index(spark, str(root), Catalog.from_json(SCHEMA, METADATA), include_weather=True)


def one(frame):
    return frame.filter(F.col("dataset_id").endswith("one/TxtInOut"))


def test_catalog():
    catalog = Catalog.from_json(SCHEMA, METADATA)
    assert catalog.pointers["weather-sta.cli"] == {"pcp": "*.pcp", "wgn": None}
    assert catalog.pointer_notes[("landuse.lum", "mgt")] == "Pointer to the schedule"
    assert catalog.layouts["weather-wgn.cli"].fixed == 13 and catalog.layouts["plant.ini"].heuristic == "plants"
    assert catalog.categories == {"soils.sol": "soil"}
    assert catalog.resolve_name("hru-data.hru") == catalog.resolve_name("hru_data.hru") == "hru_data_hru"
    assert catalog.filter_mode("hru_data_hru", "soil") == "text" and catalog.filter_mode("plant_ini", "plnt_cnt") == "numeric"


def test_rows(index):
    rows = one(index.rows).collect()
    by_table = {}
    for r in sorted(rows, key=lambda r: r["line_no"]):
        by_table.setdefault(r["table_name"], []).append((r["line_no"], r["pk_value"]))
    assert by_table["hru_data_hru"] == [(3, "h1"), (5, "h2"), (6, "h1")]
    assert by_table["soils_sol"] == [(3, "SoilA"), (6, "12345")]
    assert by_table["plant_ini"] == [(3, "Com1"), (6, "empty"), (7, "com2")]
    assert by_table["management_sch"] == [(3, "sch_a"), (7, "sch_b")]
    assert by_table["weather_wgn_cli"] == [(3, "wgn1"), (17, "wgn2")]
    assert by_table["lum_dtl"] == [(5, "pl_hv"), (15, "second")]
    assert by_table["res_rel_dtl"] == [(3, "rel")]
    assert by_table["tillage_til"] == [(3, "fieldcult")]
    assert by_table["atmo_cli"] == [(3, "0")]
    assert by_table["weather_pcp"] == [(4, "gauge one")]
    assert sorted(by_table["file_cio"], key=lambda e: int(e[1])) == [
        (2, "1"), (2, "2"), (4, "3"), (4, "4"), (4, "5"), (5, "6"), (5, "7"),
    ]
    values = {(r["table_name"], r["line_no"]): r["values"] for r in rows}
    assert values[("hru_data_hru", 3)] == {"name": "h1", "soil": "SoilA", "lu_mgt": "corn_lum", "snow": "null", "extra": ""}
    assert values[("soils_sol", 3)]["description"] == "very deep" and values[("soils_sol", 3)]["texture"] == "loam"
    assert values[("weather_pcp", 4)] == {"name": "gauge one", "nbyr": "2", "tstep": "0", "lat": "40.0", "lon": "-90.0", "elev": "100"}


def test_children(index):
    rows = one(index.children).orderBy("file_name", "line_no").collect()
    kids = {}
    for r in rows:
        kids.setdefault((r["file_name"], r["main_line"]), []).append((r["line_no"], r["values"]))
    assert [(n, v["dp"], v["layer"], v["ph"]) for n, v in kids[("soils.sol", 3)]] == [(4, "300", "1", ""), (5, "1000", "2", "")]
    assert [(n, v["plnt_name"]) for n, v in kids[("plant.ini", 3)]] == [(4, "corn"), (5, "soyb")]
    assert [(n, v["plnt_name"]) for n, v in kids[("plant.ini", 7)]] == [(8, "whea")]
    sched = kids[("management.sch", 3)]
    assert sched[0][1]["section"] == "auto" and sched[0][1]["d_table"] == "pl_hv"
    assert sched[1][1]["op_data1"] == "fldcult" and sched[1][1]["op_ref"] == "FieldCult"
    assert [(n, v["month"], v["tmp_max_ave"]) for n, v in kids[("weather-wgn.cli", 17)]] == [(18 + m, str(m), f"{m}.0") for m in range(1, 13)]
    dtl = kids[("lum.dtl", 5)]
    # A blank line takes an action slot but no condition slot.
    assert [(n, v["section"]) for n, v in dtl] == [(7, "condition"), (9, "condition"), (11, "action")]
    assert dtl[0][1]["alt1"] == ">" and dtl[2][1]["fp"] == "Grain" and dtl[2][1]["out2"] == "n"
    assert [v["act_typ"] for _, v in kids[("lum.dtl", 15)]] == ["fertilize"]


def test_references(index):
    found = one(index.resolved).collect()
    seen = {(r["source_table"], r["source_line"], r["source_column"], r["fk_value"]): r for r in found}
    assert seen[("hru_data_hru", 3, "soil", "SoilA")]["target_line"] == 3
    assert not seen[("hru_data_hru", 5, "soil", "soil_x")]["resolved"]
    assert seen[("hru_data_hru", 5, "lu_mgt", "CORN_LUM")]["resolved"]
    assert ("hru_data_hru", 3, "snow", "null") not in seen and ("hru_data_hru", 6, "soil", "0") not in seen
    assert seen[("landuse_lum", 3, "plnt_com", "Com1")]["resolved"] and seen[("landuse_lum", 3, "mgt", "sch_a")]["resolved"]
    auto = seen[("management_sch", 4, "auto_op_dtl", "pl_hv")]
    assert auto["resolved"] and auto["actual_target_table"] == "lum_dtl"
    assert seen[("management_sch", 5, "op_data1(till)", "FieldCult")]["target_file"] == "tillage_my.til"
    assert seen[("lum_dtl", 11, "fp(harvest)", "Grain")]["resolved"]
    assert seen[("weather_sta_cli", 3, "wgn", "WGN1")]["resolved"] and not seen[("weather_sta_cli", 4, "wgn", "wgn9")]["resolved"]
    # Pointer columns with a pattern are no references.
    assert not any(key[2] == "pcp" for key in seen)


def test_compat_pointers(index):
    compat = refs.extract_fk_refs(index.rows, index.catalog, "compat").select("source_column").distinct()
    assert {r[0] for r in compat.collect()} == {"soil", "lu_mgt", "snow", "plnt_com"}


def test_checks_over_references(index):
    missing = refs.missing_target_tables(index.resolved, index.rows, index.catalog).collect()
    assert {(r["dataset_id"].split("/")[-2], r["fk_value"], r["target_file"]) for r in missing} == {
        ("one", "snow1", "snow.sno"), ("two", "snow1", "snow.sno"), ("two", "SoilA", "soils.sol"), ("two", "soil_x", "soils.sol"),
        ("two", "Grain", "harv.ops"),
    }
    pointers = refs.missing_file_pointers(index.rows, index.inventory, index.catalog).collect()
    assert {(r["source_column"], r["referenced_file"], r["note"]) for r in pointers} == {("pcp", "gone.pcp", "Precipitation")}
    messages = {r["message"] for r in one(refs.describe_refs(index.resolved, index.rows, index.catalog)).collect()}
    assert "'soil_x' not found in soils.sol (Soil profiles)" in messages
    assert "'snow1' refers to snow.sno, which is not in the dataset" in messages


def test_issue_counts(index):
    every = refs.extract_fk_refs(index.rows, index.catalog, "none", ("",))
    counted = one(report.table_issue_counts(refs.resolve_refs(every, index.rows))).collect()
    hru = {r["source_column"]: r["unresolved_values"] for r in counted if r["source_table"] == "hru_data_hru"}
    assert hru == {"soil": 2, "snow": 2}
    stats = {r["dataset_id"].split("/")[-2]: r for r in index.stats().collect()}
    # The second row named h1 replaces the first one.
    rows = one(index.rows).count()
    assert stats["one"]["row_count"] == rows - 1
    duplicates = one(refs.duplicate_keys(index.rows)).collect()
    assert [(r["pk_lc"], r["first_line"], r["last_line"]) for r in duplicates] == [("h1", 3, 6)]


def test_orphans(index):
    orphans = {(r["table_name"], r["pk_value"]) for r in one(refs.orphan_rows(index.rows, index.resolved)).collect()}
    assert ("plant_ini", "empty") in orphans and ("soils_sol", "12345") in orphans and ("lum_dtl", "second") in orphans
    assert ("soils_sol", "SoilA") not in orphans and ("management_sch", "sch_a") not in orphans


def test_file_list(index):
    from linkfold.sources import filelist

    header = filelist.file_list_header(one(index.lines).filter("file_name = 'file.cio' and line_no = 1")).first()
    assert (header["editor_version"], header["model_revision"], header["generated_on"]) == ("2.1.3", "60.5", "2024-05-01 10:30")
    missing = one(filelist.missing_listed_files(index.entries, index.inventory)).collect()
    assert {r["file_name"] for r in missing} == {"time.sim", "nutrients.sol"}
    plan = filelist.expected_vs_actual(index.entries, index.inventory, index.rows, index.catalog)
    soils = one(plan.filter("classification = 'soils'")).orderBy("position").collect()
    assert [(r["expected_file"], r["actual_file"], r["is_indexed"]) for r in soils] == [
        ("soils.sol", "soils.sol", True), ("nutrients.sol", "nutrients.sol", False), ("soils_lte.sol", "0", False),
    ]


def test_deposition(index):
    from linkfold.sources.records import deposition_blocks
    from linkfold.sources.tables import parse_tables, resolve_header

    bound = index.bound.filter("file_name = 'atmo.cli'")
    mains = parse_tables(index.lines, resolve_header(index.lines, bound, index.catalog), index.catalog)
    blocks = one(deposition_blocks(mains, index.lines)).orderBy("station").collect()
    assert [(b["station_name"], b["nh4_wet"], b["no3_wet"], b["line_no"], b["no3_dry_line"]) for b in blocks] == [
        ("staA", ["1", "2"], ["3"], 4, 8), ("staB", ["1"], ["2"], 9, 13),
    ]


def test_long_records_and_other_spellings(spark, tmp_path):
    """Counts are bounded by the file only, and a record file may be spelled with other separators."""
    folder = tmp_path / "TxtInOut"
    folder.mkdir()
    (folder / "file.cio").write_text(FILES["file.cio"])
    (folder / "weather_wgn.cli").write_text(FILES["weather-wgn.cli"])
    members = "\n".join(f" crop{k} y" for k in range(1500))
    (folder / "plant.ini").write_text(f"plants\npcom_name plt_cnt rot_yr_ini\nbig 1500 1\n{members}\nlast 1 1\n whea y\nodd 99999999999999 1\n corn y")
    stations = "\n".join(f"sta{k}\n 1 9\n 2 9\n 3 9\n 4 9" for k in range(250))
    (folder / "atmo.cli").write_text(f"atmo\nnum_sta timestep mo_init yr_init num_aa\n250 mo 1 1990 2\n{stations}\n")
    built = build_index(spark, str(tmp_path), Catalog.from_json(SCHEMA, METADATA))
    rows = {(r["table_name"], r["pk_value"]) for r in built.rows.filter("table_name <> 'file_cio'").collect()}
    assert rows == {("plant_ini", "big"), ("plant_ini", "last"), ("plant_ini", "odd"), ("weather_wgn_cli", "wgn1"), ("weather_wgn_cli", "wgn2"), ("atmo_cli", "0")}
    kids = {r["file_name"]: r["n"] for r in built.children.groupBy("file_name").agg(F.count("*").alias("n")).collect()}
    assert kids == {"plant.ini": 1502, "weather_wgn.cli": 24, "atmo.cli": 1250}


def test_position_by_column(spark):
    """Equal values in two reference columns: each position gives the reference of its own column."""
    from linkfold.operators import refs

    found = spark.createDataFrame(
        [("d", "f", 3, "one", "corn"), ("d", "f", 3, "two", "corn"), ("d", "f", 4, "two", "x")],
        "dataset_id string, source_file string, source_line long, source_column string, fk_value string",
    )
    text_lines = spark.createDataFrame([("d", "f", 3, "corn  corn"), ("d", "f", 4, " x")], "dataset_id string, file_name string, line_no long, raw string")
    headers = spark.createDataFrame([("d", "f", ["one", "two"], [0, 1])], "dataset_id string, file_name string, cell_names array<string>, cell_at array<int>")
    placed = refs.position_refs(found, text_lines, headers)
    at = lambda line, char: [
        r["source_column"]
        for r in refs.target_at(placed, spark.createDataFrame([("d", "f", line, char)], "dataset_id string, source_file string, source_line long, char int")).collect()
    ]
    assert (at(3, 1), at(3, 8), at(3, 5), at(4, 1)) == (["one"], ["two"], [], ["two"])


def test_preflight(index):
    report_lines = one(index.preflight()).orderBy("section", "ord").collect()
    text = "\n".join(r["line"] for r in report_lines)
    assert text.startswith("## Summary\n- Tables indexed: ")
    assert "- Missing file pointers: 1" in text and "| weather-sta.cli | 4 | pcp | gone.pcp |" in text
    assert "## Top unresolved targets\n- " in text and "| hru-data.hru | 5 | snow | snow1 | snow.sno |" in text


def test_suppressed_pointers(spark):
    rows = [("weather-sta.cli", "tmp", "ames.tem"), ("weather-sta.cli", "wgn", "ames_wgn"), ("weather-sta.cli", "wgn", "a.wgn"), ("recall.rec", "file", "pt001.rec"), ("other.x", "tmp", "a.b")]
    frame = spark.createDataFrame(rows, "source_file string, source_column string, fk_value string")
    catalog = Catalog(pointers={"Weather-Sta.cli": {"TMP": "*.tmp", "wgn": None}, "recall.rec": {"file": "*.rec"}})
    kept = refs.suppress_pointer_refs(frame, catalog).collect()
    assert sorted(r["fk_value"] for r in kept) == ["a.b", "ames_wgn"]


def test_merged_foreign_keys():
    from linkfold.catalog import ForeignKey

    catalog = Catalog.from_json(SCHEMA, METADATA).with_foreign_keys(
        {"hru-data.hru": [ForeignKey("soil", "soils_sol", "other"), ForeignKey("snow", "snow2")]}
    )
    assert [(fk.column, fk.target_table, fk.target_column) for fk in catalog.table("hru_data_hru").foreign_keys] == [
        ("soil", "soils_sol", "id"), ("lu_mgt", "landuse_lum", "id"), ("snow", "snow_sno", "id"), ("snow", "snow2", "name"),
    ]
