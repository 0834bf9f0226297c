import pytest
from pyspark.sql import functions as F

from linkfold.catalog import Catalog, Column, Table
from linkfold.operators import checks
from linkfold.sources.tables import resolve_header

DOUBLES = ("amt_mm", "eff_frac", "sumq_frac", "dep_sub", "salt_ppm", "no3_ppm", "po4_ppm")
IRRIGATION = Table("irr_ops", "irr.ops", (Column("id", "AutoField"), Column("name"), *(Column(c, "DoubleField") for c in DOUBLES), Column("description", "TextField")))
CALIBRATION = Table(
    "calibration_cal",
    "calibration.cal",
    (
        Column("cal_parm", "ForeignKeyField"), Column("chg_typ"), Column("chg_val", "DoubleField"),
        *(Column(c, "IntegerField") for c in ("soil_lyr1", "soil_lyr2", "yr1", "yr2", "day1", "day2")),
    ),
)
CODES = Table("codes_sft", "codes.sft", tuple(Column(c, "CharField" if c == "hyd" else "BooleanField") for c in "landscape hyd plnt sed nut ch_sed ch_nut res".split()))
AQUIFER = Table("aquifer_aqu", "aquifer.aqu", (Column("id", "AutoField"), Column("name"), Column("init", "ForeignKeyField"), Column("gw_flo", "DoubleField")), keeps_id=True)
MIXED = Table("mixed", "mixed.tbl", (Column("name"), Column("n", "IntegerField"), Column("x", "DoubleField"), Column("d", "DecimalField"), Column("ok", "BooleanField")))
CATALOG = Catalog(tables=(IRRIGATION, CALIBRATION, CODES, AQUIFER, MIXED, Table("soils_sol", "soils.sol", (Column("name"), Column("nly", "IntegerField")))))
HEADER = "name amt_mm eff_frac sumq_frac dep_sub salt_ppm no3_ppm po4_ppm description"
CAL = "NAME CHG_TYPE VAL CONDS LYR1 LYR2 YEAR1 YEAR2 DAY1 DAY2 OBJ_TOT"


def bound_to(spark, files):
    names = {t.file_name: t.table_name for t in CATALOG.tables}
    rows = [(d, f, f, names[f]) for d, f in files]
    return spark.createDataFrame(rows, "dataset_id string, file_name string, schema_file string, table_name string")


def issues(spark, lines, files, cap=20):
    out = checks.format_issues(lines(files), bound_to(spark, files), CATALOG, cap)
    return [tuple(r) for r in out.orderBy("dataset_id", "file_name", "line_no", "column").collect()]


def test_headers(spark, lines):
    row = "sprinkler 25.0 0.8 0.1 0 0 0 0 some"
    files = {
        ("blank", "irr.ops"): f"t\n\n{row}",
        ("data", "irr.ops"): f"t\n{row}\n{row}",
        ("other", "irr.ops"): f"t\nfoo bar baz qux quux corge grault garply waldo\n{row}",
        ("good", "irr.ops"): f"t\n{HEADER}\n{row}",
        ("alias", "calibration.cal"): f"t\n{CAL}\ncn2 pctchg 1 0 0 0 0 0 0 0 0",
        ("codes", "codes.sft"): "t\nLANDSCAPE_YN HYD_YN PLNT_YN SED_YN NUT_YN CH_SED_YN CH_NUT_YN RES_YN\ny b n n n n n n",
        ("short", "irr.ops"): "t",
    }
    got = {(d, kind): (line, message) for d, _, line, _, kind, message, _, _ in issues(spark, lines, files)}
    assert {k for k in got} == {("blank", "missing_header_line"), ("data", "missing_header_line"), ("other", "header_column_mismatch"), ("short", "missing_header_line")}
    assert got[("blank", "missing_header_line")] == (2, "Missing or blank column-header line in irr.ops")
    assert got[("data", "missing_header_line")] == (2, "Expected a column header in irr.ops, but found a data row instead")
    assert got[("other", "header_column_mismatch")] == (2, "Column-header mismatch in irr.ops: 9 of 9 expected columns not found in header")


def test_count_line(spark, lines):
    files = {("d", "calibration.cal"): f"t\n189\n{CAL}\ncn2 pctchg 1.5 0 0 0 0 0 0 0 0"}
    head = resolve_header(lines(files), bound_to(spark, files), CATALOG)
    physical = CATALOG.tables_frame(spark).select("schema_file", F.col("columns").alias("physical"))
    placed = checks.column_positions(head.join(physical, "schema_file"), CATALOG).first()
    assert (placed["header_line"], placed["data_line"]) == (3, 4)
    places = dict(zip(placed["physical"], placed["positions"]))
    assert (places["cal_parm"], places["chg_val"], places["soil_lyr1"], places["day2"]) == (0, 2, 4, 9)


def test_physical_columns():
    assert [c.name for c in AQUIFER.physical_columns] == ["id", "name", "init", "gw_flo"]
    assert [c.name for c in IRRIGATION.physical_columns][0] == "name"


def test_rows(spark, lines):
    body = "\n".join(
        ["t", "name n x d ok", "a 1 2.5 zz yes", "# b x x x x", "b 1.5 1e999 0 maybe", "c 1e2 null 0 TRUE", "d 1", "", "e x 0x10 0 0", "f 5.0 - 0 Null"]
    )
    files = {
        ("one", "mixed.tbl"): body,
        ("two", "mixed.tbl"): " \n\t\n",
        ("three", "mixed.tbl"): "  \nname n x d ok\na 1 2 3 y",
        ("four", "soils.sol"): "t\nname nly\nx",
    }
    got = [(d, line, column, kind, actual) for d, _, line, column, kind, _, _, actual in issues(spark, lines, files)]
    assert sorted(got, key=str) == sorted(
        [
            ("one", 5, "n", "invalid_integer", "1.5"),
            ("one", 5, "ok", "invalid_boolean", "maybe"),
            ("one", 5, "x", "invalid_decimal", "1e999"),
            ("one", 7, None, "wrong_column_count", "2"),
            ("one", 9, "n", "invalid_integer", "x"),
            ("one", 9, "x", "invalid_decimal", "0x10"),
            ("one", 10, "x", "invalid_decimal", "-"),
            ("three", 1, None, "missing_metadata_line", None),
            ("two", 0, None, "empty_file", None),
        ],
        key=str,
    )


@pytest.mark.parametrize("cap", [20, 3, None])
def test_cap(spark, lines, cap):
    files = {("d", "mixed.tbl"): "t\nname n x d ok\n" + "\n".join("a b c 1 q" for _ in range(10))}
    got = [(line, kind) for _, _, line, _, kind, _, _, _ in issues(spark, lines, files, cap)]
    order = [(n, k) for n in range(3, 13) for k in ("invalid_integer", "invalid_decimal", "invalid_boolean")]
    assert sorted(got) == sorted(order[:cap])
