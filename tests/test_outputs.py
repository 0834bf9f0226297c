import json

import pytest
from pyspark.sql import functions as F

from linkfold.catalog import Catalog, Table
from linkfold.sources import outputs, store


def parse(lines, body, name="out.txt"):
    frame = lines({("d", name): body})
    layouts = outputs.detect_output_layout(frame)
    rows = outputs.read_output_text(frame, layouts)
    return layouts.first(), [r["cells"] for r in rows.orderBy("line_no").collect()]


def test_units_row(lines):
    head, rows = parse(lines, "Channel summary\nDAY FLOW SED\nday m3/s t\n1 2.5 0.1\n2 3.5 0.2\n")
    assert (head["title"], head["columns"], head["units"]) == ("Channel summary", ["DAY", "FLOW", "SED"], ["day", "m3/s", "t"])
    assert rows == [["1", "2.5", "0.1"], ["2", "3.5", "0.2"]]


def test_banner_and_no_units(lines):
    body = (
        "  model run   2024\n  --plant--  output\njday mon day yr unit PLANTNM MASS C N P\n"
        "1 1 1 2000 1 corn 10.0 1.0 0.1 0.01\n2 1 2 2000 1 soyb 11.0 1.1 0.2 0.02\n"
    )
    head, rows = parse(lines, body)
    assert head["columns"][:5] == ["jday", "mon", "day", "yr", "unit"] and len(head["columns"]) == 10
    assert head["units"] is None and len(rows) == 2


def test_blank_unit_cells(lines):
    labels = ["jday", "mon", "day", "yr", "unit", "gis_id", "name", "yield", "bioms"]
    values = ["1", "1", "1", "2000", "1", "1", "hru1", "2.5", "3.5"]
    units = [""] * 7 + ["t/ha", "kg/ha"]
    row = lambda cells: "".join(c.rjust(9) for c in cells)
    head, rows = parse(lines, "\n".join(["crop yields", row(labels), row(units), row(values)]))
    assert head["mode"] == "fixed_width" and head["units"] == units and rows == [values]


def test_surplus_joins_last_cell(lines):
    labels = " ".join(f"c{i}" for i in range(11)) + " description"
    data = " ".join(str(i) for i in range(11)) + " two words"
    head, rows = parse(lines, f"title\n{labels}\n{data}\n-----  \n{data}")
    assert len(head["columns"]) == 12
    assert [r[-1] for r in rows] == ["two words", "two words"]


def test_blank_lines_and_separators(lines):
    _, rows = parse(lines, "t\n\nA B\n\n===\n1 2\n\n3\n")
    assert rows == [["1", "2"], ["3", ""]]


def test_files_that_end_with_their_head(lines):
    """No rows: units, title and banners are no data; a lone row of words stays a row."""
    for banner in ("", "--yearly--\n"):
        head, rows = parse(lines, f"Orders of 5\n{banner} order status price\n - text usd/yr\n")
        assert (head["title"], head["columns"], head["units"]) == (f"Orders of 5 {banner.strip()}".strip(), ["order", "status", "price"], ["-", "text", "usd/yr"])
        assert (rows, head["last_head_line"]) == ([], 4 if banner else 3)
        head, rows = parse(lines, f"Orders of 5\n{banner} order status price\n")
        assert (head["columns"], head["units"], rows) == (["order", "status", "price"], None, [])
        _, rows = parse(lines, f"Orders of 5\n order status\n{banner}abc n/a\ndef -\n")
        assert rows[-2:] == [["abc", "n/a"], ["def", "-"]]
    assert parse(lines, "names\nname place\nabc a/b\n")[1] == [["abc", "a/b"]]


def test_output_text_of_customers_without_orders(spark, tmp_path):
    from linkfold.plans import text_queries

    spark.createDataFrame(
        [(1, 5.0, "BUILDING"), (2, 5.0, "MACHINERY"), (3, -5.0, "BUILDING"), (4, -5.0, "MACHINERY"), (5, 5.0, "BUILDING")],
        "c_custkey long, c_acctbal double, c_mktsegment string",
    ).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(7, 5, "F", 1.5), (8, 5, "O", 2.5)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    got = sorted(map(tuple, text_queries.output_text(spark, str(tmp_path)).collect()))
    assert got == [("cust_5.txt", "7", "F", 1.5), ("cust_5.txt", "8", "O", 2.5)]


def test_csv(lines):
    frame = lines({("d", "x.csv"): 'day,label,flow\n1,"reach, upper",2.5\n\n2,"say ""hi""" , 3,4\n3\n4,a"b,c"d,5'})
    layouts, rows = outputs.read_output_csv(frame)
    assert layouts.first()["columns"] == ["day", "label", "flow"]
    assert [r["cells"] for r in rows.orderBy("line_no").collect()] == [
        ["1", "reach, upper", "2.5"],
        ["2", 'say "hi"', "3 4"],
        ["3", "", ""],
        ["4", "ab,cd", "5"],
    ]


def test_json_records(spark):
    document = {
        "meta": {"title": "no data here"},
        "results": [
            {"title": "flow", "header": ["day", "q"], "units": ["d"], "data": [[1, 2.50], [2], [3, 4, 5]]},
            {"header": "a b", "data": [{"a": 1}, {"b": "x", "c": 9}]},
        ],
        "deep": {"x": [{"title": "", "data": ["p", ["q", "r"]]}]},
    }
    docs = spark.createDataFrame([("f", json.dumps(document))], "file string, doc string")
    rows = outputs.read_output_json(docs, "doc", ["file"]).orderBy("record", "row_no").collect()
    seen = [(r["title"], r["columns"], r["units"], r["cells"]) for r in rows]
    assert seen == [
        ("flow", ["day", "q"], ["d", ""], ["1", "2.5"]),
        ("flow", ["day", "q"], ["d", ""], ["2", ""]),
        ("flow", ["day", "q"], ["d", ""], ["3", "4"]),
        ("table_2", ["a", "b"], None, ["1", ""]),
        ("table_2", ["a", "b"], None, ["", "x"]),
        ("table_5", ["col1", "col2"], None, ["p", ""]),
        ("table_5", ["col1", "col2"], None, ["q", "r"]),
    ]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_write_output_tables(spark, tmp_path, fmt):
    doc = json.dumps([{"title": "flow/day", "header": "d q", "units": "- m3", "data": [[1, 2], [3, 4]]}, {"title": "x", "header": "a", "data": [[7]]}])
    rows = outputs.read_output_json(spark.createDataFrame([("f", doc)], "file string, doc string"), "doc", ["file"])
    layouts = rows.select("title", "columns", "units").distinct()
    written = store.write_output_tables(rows, layouts, str(tmp_path), fmt)
    assert [w.rsplit("/", 1)[1] for w in written] == ["01_flow_day", "02_x"]
    reader = spark.read.option("header", "true")
    first, second = (reader.csv(w) if fmt == "csv" else reader.parquet(w) for w in written)
    assert [tuple(r) for r in first.collect()] == [("units", "-", "m3"), ("data", "1", "2"), ("data", "3", "4")]
    assert [tuple(r) for r in second.collect()] == [("7",)]


def test_output_files(spark):
    names = ["file.cio", "con.txt", "recall.rec", "summary.csv", "basin_wb.out", "yield.txt", "notebooks/x.csv", "sub/y.out", "listed-in.txt"]
    inventory = spark.createDataFrame(
        [("d", n.rsplit("/", 1)[-1], n, f"/d/{n}") for n in names], "dataset_id string, file_name string, rel_path string, path string"
    )
    catalog = Catalog(tables=(Table("con", "con.txt", model="input.con"), Table("yield", "yield.txt", model="output.yield")))
    listed = spark.createDataFrame([("d", "listed_in.txt")], "dataset_id string, file_name string")
    found = outputs.output_files(inventory, catalog, listed)
    assert sorted(r["rel_path"] for r in found.collect()) == ["basin_wb.out", "sub/y.out", "summary.csv", "yield.txt"]


def test_snapshot_versions(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "a"), ("d2", "b")], "dataset_id string, v string")
    store.save_index({"rows": rows}, str(tmp_path / "ok"))
    assert store.load_index(spark, str(tmp_path / "ok"), ["rows"])["rows"].count() == 2
    # Saving one dataset again leaves the other alone.
    store.save_index({"rows": rows.filter("dataset_id = 'd1'").withColumn("v", F.lit("new"))}, str(tmp_path / "ok"))
    assert {r["v"] for r in store.load_index(spark, str(tmp_path / "ok"), ["rows"])["rows"].collect()} == {"new", "b"}
    rows.withColumn("format_version", F.lit(1)).write.parquet(str(tmp_path / "old" / "rows"))
    rows.write.parquet(str(tmp_path / "none" / "rows"))
    for name in ("old", "none"):
        with pytest.raises(store.SnapshotVersionError):
            store.load_index(spark, str(tmp_path / name), ["rows"])


def test_write_subset_and_scan(spark, tmp_path, lines):
    from linkfold.sources.lines import scan_lines

    frame = lines({("d", "a.txt"): "\n".join(f"row {i}" for i in range(50)), ("d", "b.txt"): "one\n\ntwo"})
    store.write_subset(frame, str(tmp_path / "out"))
    for whole in (False, True):
        back = scan_lines(spark, str(tmp_path / "out"), whole).filter("path like '%a.txt%'")
        assert sorted(r["raw"] for r in back.collect()) == sorted(f"row {i}" for i in range(50))
    (tmp_path / "in").mkdir()
    body = "\n".join(f"{i} {'x' * (i % 7)}" for i in range(1, 5001)) + "\n"
    (tmp_path / "in" / "big+file one.txt").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = scan_lines(spark, str(tmp_path / "in")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5000 and all(int(r["raw"].split()[0]) == r["line_no"] for r in got)
    assert {r["path"] for r in got} == {str(tmp_path / "in" / "big+file one.txt")}


def test_copy_filter(spark):
    names = ["a.txt", "b.CSV", "hru.con", "fort.12", "x.sqlite", "time.sim"]
    frame = spark.createDataFrame([(n,) for n in names], "file_name string")
    assert [r["file_name"] for r in store.copy_filter(frame).collect()] == ["hru.con", "time.sim"]
