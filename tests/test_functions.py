import random

import pytest
from pyspark.sql import functions as F

from linkfold.functions import classify, text
from linkfold.functions.ordinals import with_global_ordinal, with_ordinal
from linkfold.operators import explore
from linkfold.operators.chain import on_chain
from linkfold.operators.explore import Condition


def evaluate(spark, fn, *values):
    names = [f"v{i}" for i in range(len(values))]
    frame = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return frame.select(fn(*[F.col(n) for n in names]).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("fn", "args", "expected"),
    [
        (text.slashes, ("C:\\a\\b",), "C:/a/b"),
        (text.comparable_path, ("C:\\Data\\X.txt",), "c:/data/x.txt"),
        (text.comparable_path, ("/Home/User",), "/Home/User"),
        (text.path_starts_with, ("/home/user/x", "/home/user"), True),
        (text.path_starts_with, ("/home/user1/x", "/home/user"), False),
        (text.path_starts_with, ("/home/user", "/home/user/"), True),
        (text.path_starts_with, ("C:\\Data\\x", "c:/data"), True),
        (text.drive_to_mount, ("C:\\Users\\foo\\bar",), "/mnt/c/Users/foo/bar"),
        (text.drive_to_mount, ("D:/datasets/Ames",), "/mnt/d/datasets/Ames"),
        (text.drive_to_mount, ("C:\\",), "/mnt/c"),
        (text.drive_to_mount, ("/already/posix",), "/already/posix"),
        (text.mount_to_drive, ("/mnt/c/Users/foo",), "C:\\Users\\foo"),
        (text.mount_to_drive, ("/mnt/d",), "D:\\"),
        (text.mount_to_drive, ("/mnt/data/x",), "/mnt/data/x"),
        (text.stored_path, ("c:\\a\\b",), "/mnt/c/a/b"),
        (text.stored_path, ("/a/b",), "/a/b"),
        (text.suffix, ("dir/Weather-Sta.CLI",), ".cli"),
        (text.suffix, ("noending",), ""),
        (text.stem, ("dir/hru-data.hru",), "hru-data"),
        (text.table_of_file, ("Res-Rel.dtl",), "res_rel_dtl"),
        (text.number, ("1e3",), 1000.0),
        (text.number, ("0x10",), None),
        (text.number, ("1d",), None),
        (text.number, ("NaN",), None),
        (text.number, ("1e999",), None),
        (text.integer, ("12",), 12),
        (text.integer, ("1.5",), None),
        (text.is_whole, ("1e2",), True),
        (text.is_whole, ("5.0",), True),
        (text.is_whole, ("5.5",), False),
        (text.tokens, ("  a  b\tc ",), ["a", "b", "c"]),
        (text.tokens, ("   ",), []),
        (lambda v: text.nullify_names(v, ["hru.con"]), ("x HRU.CON chru.con hru.con2",), "x null chru.con hru.con2"),
        (lambda v: text.is_boolean_literal(v, ["null"]), ("maybe",), False),
        (lambda v: text.is_boolean_literal(v, ["null"]), ("Y",), True),
        (lambda v: text.safe_title(v, F.lit("table_1")), ("_day/flow (m3)_",), "day_flow__m3"),
        (lambda v: text.safe_title(v, F.lit("table_1")), ("__",), "table_1"),
        (lambda v: text.expand_signed_ranges(text.tokens(v)), ("4 9 -12 20 5 -3 x",), [4, 9, 10, 11, 12, 20, 5, 4, 3]),
        (lambda v: text.expand_signed_ranges(text.tokens(v)), ("-2 -4 -5",), [-2, -1, 0, 1, 2, 3, 4, -5]),
        (classify.input_category, ("weather-wgn.txt",), "climate"),
        (classify.input_category, ("plant.ini",), "landuse"),
        (classify.input_category, ("soil_plant.ini",), "initialization"),
        (classify.input_category, ("topography.hyd",), "land"),
        (classify.input_category, ("hydrology.hyd",), "other"),
        (classify.input_category, ("initial.res",), "waterbodies"),
    ],
)
def test_expression(spark, fn, args, expected):
    assert evaluate(spark, fn, *args) == expected


def test_token_spans(spark):
    spans = evaluate(spark, text.token_spans, "  ab   c")
    assert [(s["token"], s["col_start"], s["col_end"]) for s in spans] == [("ab", 2, 4), ("c", 7, 8)]


def test_natural_order(spark):
    values = ["b10", "B9", "100", "20", "a", "1.5", "b009x", ""]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, i int")
    assert [r["v"] for r in explore.natural_sort(df, "v", ties=["i"]).collect()] == [
        "1.5", "20", "100", "", "a", "B9", "b009x", "b10",
    ]


@pytest.mark.parametrize("width", [3, 100_000])
def test_with_ordinal(spark, width):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(40), i) for i in range(200)]
    df = with_ordinal(spark.createDataFrame(rows, "k string, p bigint, i int"), ["k"], "p", "n", ["i"], width)
    want = {}
    for k in "ab":
        for n, row in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]), start=1):
            want[row[2]] = n
    assert {r["i"]: r["n"] for r in df.collect()} == want


def test_global_ordinal(spark):
    df = spark.range(500).withColumn("v", F.hash("id"))
    got = with_global_ordinal(df, [F.asc("v"), F.asc("id")], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(500))
    assert [r["v"] for r in got] == sorted(r["v"] for r in got)


@pytest.mark.parametrize(("block", "fan"), [(50_000, 1000), (64, 4)])
def test_chain(spark, block, fan):
    rng = random.Random(5)
    rows = [("a", i, i + 1 + rng.choice([0, 0, 3, 40, 900])) for i in range(1, 4000)]
    rows += [("b", i, i + 2) for i in range(1, 50)]
    starts = [("a", 3), ("b", 1)]
    want = set()
    for key, at in starts:
        step = {p: n for k, p, n in rows if k == key}
        while at in step:
            want.add((key, at))
            at = step[at]
    nodes = spark.createDataFrame(rows, "k string, pos bigint, nxt bigint")
    got = on_chain(nodes, ["k"], spark.createDataFrame(starts, "k string, pos bigint"), block, fan)
    assert {tuple(r) for r in got.collect()} == want


def test_conditions_fold_left(spark):
    df = spark.createDataFrame([("x", "1"), ("y", "2,000"), ("", "abc"), ("X", "")], "a string, b string")

    def keep(*conditions):
        return [r["b"] for r in explore.condition_filter(df, conditions).collect()]

    assert keep() == ["1", "2,000", "abc", ""]
    assert keep(Condition("a", "equals", "x")) == ["1", ""]
    assert keep(Condition("b", "gt", "5")) == ["2,000"]
    assert keep(Condition("b", "gt", "5", negate=True)) == ["1", "abc", ""]
    assert keep(Condition("b", "equals", "2000.0")) == ["2,000"]
    assert keep(Condition("b", "in", "1; ABC")) == ["1", "abc"]
    assert keep(Condition("a", "is_empty")) == ["abc"]
    # (a = x OR b = abc) AND b is not empty, with no precedence of AND
    assert keep(
        Condition("a", "equals", "x"), Condition("b", "equals", "abc", join="or"), Condition("b", "is_empty", negate=True)
    ) == ["1", "abc"]
    assert keep(Condition("a", "contains", " "), Condition("nope", "equals", "1")) == []


@pytest.mark.parametrize("bad", ["", " , ", "a", "3-1", "0", "-4", "1-x"])
def test_bad_id_lists(spark, bad):
    with pytest.raises(ValueError):
        explore.id_list(spark, bad)


def test_id_list(spark):
    assert sorted(r["id"] for r in explore.id_list(spark, "1, 4-6 ,5,10").collect()) == [1, 4, 5, 6, 10]


@pytest.mark.parametrize(("total", "limit"), [(5, 80), (80, 80), (81, 80), (1000, 7), (50, 1)])
def test_downsample(spark, total, limit):
    df = spark.range(total).select(F.lit("k").alias("k"), "id", F.col("id").cast("string").alias("v"))
    got = [r["id"] for r in explore.downsample(df, ["k"], "id", "v", limit).orderBy("point").collect()]
    if total <= limit or limit <= 1:
        assert got == list(range(total))
    else:
        assert got == [int(i / (limit - 1) * (total - 1)) for i in range(limit)]


def test_numeric_rules(spark):
    df = spark.createDataFrame([("1", ""), ("x", ""), ("2", "3"), ("4", ""), ("n/a", "")], "a string, b string")
    explorer = {r["column"]: r["is_numeric"] for r in explore.numeric_columns(df, ["a", "b"]).collect()}
    summary = {r["column"]: r["is_numeric"] for r in explore.numeric_columns(df, ["a", "b"], "summary").collect()}
    assert explorer == {"a": True, "b": True}
    assert summary == {"a": True, "b": False}
