import pytest
from pyspark.sql import functions as F

from linkfold.operators import graph, subset
from linkfold.plans import subset as plan

CON = "id name gis_id area lat lon elev {obj} wst cst ovfl rule src_tot obj_typ obj_id hyd_typ frac"
FILES = {
    "hru.con": "hrus\n" + CON.format(obj="hru") + "\n"
    "1 h1 1 1 1 1 1 10 s 0 0 0 1 sdc 2 tot 1.0\n2 h2 2 1 1 1 1 30 s 0 0 0 0\n5 h5 5 1 1 1 1 20 s 0 0 0 2 sdc 3 tot 0.5 aqu 9 rhg bad\n",
    "hru-data.hru": "data\nid name soil\n10 d10  a  b\n20 d20 c\n30 d30 e\n",
    "chandeg.con": "cha\n" + CON.format(obj="lcha") + "\n2 c2 2 1 1 1 1 2 s 0 0 0 1 sdc 3 tot 1.0\n3 c3 3 1 1 1 1 3 s 0 0 0 2 out 1 tot 1.0 sdc 2 tot 1.0\n4 c4 4 1 1 1 1 4 s 0 0 0 0\n",
    "channel-lte.cha": "lte\nid name\n2 l2\n3 l3\n4 l4\n",
    "outlet.con": "out\n" + CON.format(obj="out") + "\n1 o1 1 1 1 1 1 1 s 0 0 0 0\n",
    "rout_unit.con": "ru\n" + CON.format(obj="rtu") + "\n7 r7 7 1 1 1 1 7 s 0 0 0 1 out 1 tot 1.0\n8 r8 8 1 1 1 1 8 s 0 0 0 1 sdc 4 tot 1.0\n",
    "rout_unit.ele": "ele\nid name obj_typ obj_id frac\n11 e1 hru 1 1\n12 e2 hru 2 1\n15 e5 hru 5 1\n",
    "rout_unit.def": "def\nid name elem_tot elements\n7 r7 3 11 -12 15\n8 r8 1 12\n",
    "rout_unit.rtu": "rtu\nid name\n7 u7\n8 u8\n",
    "ls_unit.ele": "ele\nid name obj_typ obj_typ_no frac\n21 e5 hru 5 1\n22 e1 HRU 1 1\n23 e2 hru 2 1\n",
    "ls_unit.def": "def\n2\nid name area elem_tot elements\n1 l1 5.5 2 21 -23\n2 l2 5.5 1 23\n",
    "object.cnt": "counts\nname ls_area obj hru lcha rtu aqu out rec\nbasin 1 99 9 9 9 9 9 9\n",
    "file.cio": "cio\nconnect hru.con Rout_unit.con recall.con chandeg.con\n",
    "print.prt": "prt\nlsunit_wb y y y y y\nbasin_wb y y y y\nru\n",
    "notes.txt": "not copied",
    "time.sim": "kept\nas is",
    "recall.rec": "stays\nid name\n1 x\n",
}


@pytest.fixture
def dataset(lines):
    return lines({(d, name): body.rstrip("\n") for d in ("a", "b") for name, body in FILES.items()})


def texts(frame, dataset):
    rows = frame.filter(F.col("dataset_id") == dataset).orderBy("file_name", "line_no").collect()
    out = {}
    for r in rows:
        out.setdefault(r["file_name"], []).append((r["line_no"], " ".join(r["raw"].split())))
    for name, body in out.items():
        assert [n for n, _ in body] == list(range(1, len(body) + 1)), name
    return {name: [raw for _, raw in body] for name, body in out.items()}


def test_isolated(spark, dataset):
    selected = spark.createDataFrame([("a", 5), ("a", 1), ("b", 2)], "dataset_id string, id bigint")
    out, maps = plan.isolated(dataset, selected)
    got = texts(out, "a")
    assert got["hru.con"][1:] == [
        "id name gis_id area lat lon elev hru wst cst ovfl rule src_tot", "1 h1 1 1 1 1 1 1 s 0 0 0 0", "2 h5 5 1 1 1 1 2 s 0 0 0 0",
    ]
    assert got["hru-data.hru"][2:] == ["1 d10 a b", "2 d20 c"]
    assert got["rout_unit.ele"][2:] == ["1 e1 hru 1 1", "2 e5 hru 2 1"]
    assert got["rout_unit.def"][2:] == ["1 r7 2 1 2"]
    assert got["rout_unit.rtu"][2:] == ["1 u7"]
    assert got["ls_unit.ele"][2:] == ["1 e1 HRU 1 1", "2 e5 hru 2 1"]
    assert got["ls_unit.def"] == ["def", "1", "id name area elem_tot elements", "1 l1 5.5 2 2 1"]
    assert got["object.cnt"][2] == "basin 1 2 2 0 0 0 0 0"
    assert got["file.cio"][1] == "connect hru.con null null null"
    assert got["print.prt"][1:] == ["lsunit_wb n n n n y", "basin_wb y y y y", "ru"]
    assert got["time.sim"] == ["kept", "as is"] and "notes.txt" not in got
    assert got["chandeg.con"][2].startswith("2 c2")
    other = texts(out, "b")
    assert other["hru.con"][2:] == ["1 h2 2 1 1 1 1 1 s 0 0 0 0"] and other["rout_unit.def"][2:] == ["1 r7 1 1", "2 r8 1 1"]
    assert {tuple(r) for r in maps.collect()} == {("a", "hru", 1, 1), ("a", "hru", 5, 2), ("b", "hru", 2, 1)}


def test_missing_unit(spark, dataset):
    selected = spark.createDataFrame([("a", 1), ("a", 99)], "dataset_id string, id bigint")
    with pytest.raises(subset.MissingIdsError, match="a:99"):
        plan.isolated(dataset, selected)


def test_routed(spark, dataset):
    selected = spark.createDataFrame([("a", 5), ("b", 2)], "dataset_id string, id bigint")
    out, maps = plan.routed(dataset, selected)
    got = texts(out, "a")
    mapped = {(r["typ"], r["id"]): r["new_id"] for r in maps.filter("dataset_id = 'a'").collect()}
    # Unit 5 drains to channel 3, that to outlet 1 and back to channel 2; aquifer 9 has no row.
    assert mapped == {("hru", 5): 1, ("ru", 7): 1, ("sdc", 2): 1, ("sdc", 3): 2, ("aqu", 9): 1, ("out", 1): 1}
    assert got["hru.con"][2:] == ["1 h5 5 1 1 1 1 1 s 0 0 0 2 sdc 2 tot 0.5 aqu 1 rhg bad"]
    assert got["hru-data.hru"][2:] == ["1 d20 c"]
    assert got["chandeg.con"][2:] == ["1 c2 2 1 1 1 1 1 s 0 0 0 1 sdc 2 tot 1.0", "2 c3 3 1 1 1 1 2 s 0 0 0 2 out 1 tot 1.0 sdc 1 tot 1.0"]
    assert got["channel-lte.cha"][2:] == ["1 l2", "2 l3"]
    assert got["rout_unit.con"][2:] == ["1 r7 7 1 1 1 1 1 s 0 0 0 1 out 1 tot 1.0"]
    assert got["rout_unit.ele"][2:] == ["1 e5 hru 1 1"] and got["rout_unit.def"][2:] == ["1 r7 1 1"]
    assert got["rout_unit.rtu"][2:] == ["1 u7"]
    assert got["ls_unit.def"][1:] == ["1", "id name area elem_tot elements", "1 l1 5.5 1 1"]
    assert got["object.cnt"][2] == "basin 1 6 1 2 1 1 1 0"
    assert got["file.cio"][1] == "connect hru.con Rout_unit.con null chandeg.con"
    assert got["recall.rec"] == ["stays", "id name", "1 x"]
    # In the other dataset unit 2 drains nowhere itself, but its routing units do.
    other = {(r["typ"], r["id"]) for r in maps.filter("dataset_id = 'b'").collect()}
    assert other == {("hru", 2), ("ru", 7), ("ru", 8), ("sdc", 4), ("out", 1)}


def test_closure_deep_chain(spark):
    edges = [("d", "n", i, "n", i + 1) for i in range(40)] + [("d", "n", 40, "n", 3), ("d", "n", 100, "n", 101), ("e", "n", 0, "m", 7)]
    frame = spark.createDataFrame(edges, "dataset_id string, src_typ string, src_id bigint, dst_typ string, dst_id bigint")
    seeds = spark.createDataFrame([("d", "n", 20), ("e", "n", 0)], "dataset_id string, typ string, id bigint")
    for hops in (1, 8):
        got = {tuple(r) for r in graph.downstream_closure(frame, seeds, hops=hops).collect()}
        assert got == {("d", "n", i) for i in range(3, 41)} | {("e", "n", 0), ("e", "m", 7)}


def test_target_groups(spark):
    from linkfold.functions import text

    head = "1 " * 12
    for tail, want in (
        ("2 a 1 t 0.5 b 2 t x", [("a", 1, 0.5), ("b", 2, 1.0)]),
        ("3 a 1 t 0.5 b", [("a", 1, 0.5)]),
        ("2 a z t 0.5 b 2 t 1", [("b", 2, 1.0)]),
        ("x", []),
        ("0", []),
    ):
        df = spark.createDataFrame([(head + tail,)], "raw string")
        got = df.select(graph.target_groups(text.tokens(F.col("raw"))).alias("t")).first()["t"]
        assert [(g["obj_typ"], g["obj_id"], g["frac"]) for g in got] == want


def test_long_lists_become_text_in_blocks(spark, monkeypatch):
    """Lists up, down and of several spans are whole and in order; what is collected for a row is text, no elements."""
    monkeypatch.setattr(subset, "LIST_BLOCK", 4)
    body = ["title", "id name elem_tot elements", "7 up 2 1 -90", "8 none 2 200 -300", "9 down 2 90 -1", "10 mixed 4 50 3 -8 40"]
    lines = spark.createDataFrame([("d", "rout_unit.def", i, raw) for i, raw in enumerate(body, 1)], "dataset_id string, file_name string, line_no bigint, raw string")
    elements = spark.createDataFrame([("d", 2 * i, i) for i in range(1, 46)], "dataset_id string, id bigint, new_id bigint")
    out, ids = subset.definition_table(lines, "rout_unit.def", elements, total_at=2)
    got = {r["line_no"]: r["raw"] for r in out.collect()}
    up = [str(i) for i in range(1, 46)]
    cells = [["1", "up", "45", *up], ["2", "down", "45", *reversed(up)], ["3", "mixed", "5", "25", "2", "3", "4", "20"]]
    assert got == {1: body[0], 2: body[1]} | {i: " ".join(c.rjust(12) for c in row) for i, row in enumerate(cells, 3)}
    assert sorted(map(tuple, ids.select("id", "new_id").collect())) == [(7, 1), (9, 2), (10, 3)]
    kept = spark.createDataFrame([("d", 8, 1), ("d", 9, 2)], "dataset_id string, id bigint, new_id bigint")
    out, _ = subset.definition_table(lines, "rout_unit.def", elements, total_at=2, kept=kept)
    got = {r["line_no"]: r["raw"].split() for r in out.filter("line_no > 2").collect()}
    assert got == {3: ["1", "none", "0"], 4: ["2", *cells[1][1:]]}
    assert "collect_list(struct(nth" in out._jdf.queryExecution().toString() and "new_elem" not in out._jdf.queryExecution().toString()
