"""Operators that spread groups of any size: ranks, quartiles, closure, spans, chains, JSON records, snapshots, record sets."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkfold import session
from linkfold.functions import ordinals, text
from linkfold.operators import chain, explore
from linkfold.sources import lines as line_source, outputs, store


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sorted_ordinal_of_sparse_and_tied_positions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([5, rng.getrandbits(62), -rng.getrandbits(40), None]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, p long, i long")
    got = {r["i"]: r["n"] for r in ordinals.with_sorted_ordinal(df, ["g"], ["p", "i"], "n").collect()}
    for g in ("a", "b", None):
        own = sorted(((p is not None, p or 0, i) for x, p, i in rows if x == g))
        assert [got[i] for _, _, i in own] == list(range(1, len(own) + 1))


def test_sorted_ordinal_makes_no_large_task(spark):
    """One group of ids spread over 60 bits: every range gets about its share, and no window sees the rows."""
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.xxhash64("id").alias("p"))
    fixed = ordinals._in_ranges(df, ["g"], ["p"])
    sizes = [r["count"] for r in fixed.groupBy("_part").count().collect()]
    assert max(sizes) <= 3 * np.median(sizes)
    out = ordinals.with_sorted_ordinal(df, ["g"], ["p"], "n")
    assert out.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first() == (200_000, 1, 200_000)


def test_running_sum(spark):
    rows = [("k", (i * 7919) % 1000, i % 3) for i in range(1000)]
    got = ordinals.with_running_sum(spark.createDataFrame(rows, "k string, p long, a long"), ["k"], ["p"], "a", "s").orderBy("p").collect()
    assert [r["s"] for r in got] == np.cumsum([a for _, _, a in sorted(rows)]).tolist()


@pytest.mark.parametrize("margin", [None, 0])
def test_quartiles_are_exact(spark, monkeypatch, margin):
    """Also where the first brackets miss the ranks, and for ties, text cells, single values and empty groups."""
    if margin is not None:
        monkeypatch.setattr(explore, "MARGIN", margin)
        monkeypatch.setattr(explore, "ACCURACY", 10)
    rng = random.Random(2)
    rows = [("a", f"{rng.gauss(0, 1e6):.3f}", float(rng.choice([1, 2, 2, 3]))) for _ in range(1501)]
    rows += [("b", str(10.0**k), -(2.0**k)) for k in range(-200, 200)] + [("c", "7", None), ("c", "x", None), (None, "1", 1.0), (None, "2", 2.0)]
    df = spark.createDataFrame(rows, "g string, t string, v double")
    got = {(r["g"], r["column"]): r for r in explore.describe_numeric(df, ["t", "v"], ["g"]).collect()}
    for g in ("a", "b", "c", None):
        for column, at in (("t", 1), ("v", 2)):
            own = [float(r[at]) for r in rows if r[0] == g and r[at] not in (None, "x")]
            r = got[g, column]
            assert r["count"] == len(own)
            if own:
                assert np.allclose([r["q25"], r["q50"], r["q75"]], np.quantile(own, [0.25, 0.5, 0.75]), rtol=1e-12)
                assert (r["min"], r["max"]) == (min(own), max(own))
            else:
                assert r["q50"] is None
    every = explore.describe_numeric(df, ["v"]).first()
    assert np.isclose(every["q50"], np.quantile([r[2] for r in rows if r[2] is not None], 0.5))


def test_quartiles_hold_no_group_in_a_task(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert "percentile(" not in _plan(explore.describe_numeric(df, ["v"]))


def test_ids_between_wide_spans(spark):
    rng = random.Random(3)
    ids = [("d", rng.randrange(-50, 5000)) for _ in range(300)] + [("e", 2**62), ("e", 4)]
    spans = [("d", rng.randrange(-100, 5000), rng.choice([0, 10, 10**12])) for _ in range(60)] + [("e", 0, 2**62), ("e", 5, 6), ("f", 0, 9)]
    spans = [(d, lo, lo + w if w < 2**60 else w) for d, lo, w in spans]
    left = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "i long, dataset_id string, low long, high long")
    placed, ranked = ordinals.with_ids_between(left, spark.createDataFrame(ids, "dataset_id string, id long"), ["dataset_id"], "id", "low", "high")
    rank = {(r["dataset_id"], r["rank"]): r["id"] for r in ranked.collect()}
    for r in placed.collect():
        d, lo, hi = spans[r["i"]]
        want = sorted({v for x, v in ids if x == d and lo <= v <= hi})
        assert [rank[d, r["first_rank"] + k] for k in range(r["n_ids"])] == want


def test_chains_of_many_groups(spark):
    """Groups of a few and of many positions, blocks that end anywhere, links out of the group or nowhere."""
    rng = random.Random(4)
    rows, starts, want = [], [], set()
    for g in range(40):
        n = rng.choice([1, 5, 400])
        nxt = {p: p + rng.choice([1, 1, 2, 30, 10**13]) for p in range(1, n + 1) if rng.random() < 0.95 or p == 1}
        rows += [(f"g{g}", p, q) for p, q in nxt.items()]
        entries = [1] + [p for p in nxt if rng.random() < 0.01]
        starts += [(f"g{g}", p) for p in set(entries)]
        for p in entries:
            while p in nxt:
                want.add((f"g{g}", p))
                p = nxt[p]
    nodes = spark.createDataFrame(rows, "g string, pos long, nxt long")
    first = spark.createDataFrame(starts, "g string, pos long")
    for block, fan in ((50_000, 1000), (16, 4)):
        got = chain.on_chain(nodes, ["g"], first, block, fan)
        assert {tuple(r) for r in got.collect()} == want


def _met(value, found):
    """What a reader meets: the object, its container members, then all members."""
    if isinstance(value, dict):
        if "data" in value and ("header" in value or "title" in value):
            found.append(value.get("title"))
        for name in outputs.CONTAINER_KEYS:
            if value.get(name) is not None:
                _met(value[name], found)
        for v in value.values():
            _met(v, found)
    elif isinstance(value, list):
        for v in value:
            _met(v, found)
    return found


def test_json_records_nested_twelve_deep(spark):
    document = {"title": "leaf", "header": "a b", "data": [[1.50, "x"], [-2e5, True]]}
    for k in range(12):
        document = {"outputs" if k % 2 else "other": document, "items": [{"title": f"t{k}", "header": ["v"], "data": [[k]]}], "title": f"own{k}", "data": []}
    rng = random.Random(6)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return {"title": f"r{rng.getrandbits(40)}", "header": "h", "data": [[rng.randrange(9)]]}
        return {rng.choice(["results", "x", "items", "tables", "y"]) + ("" if rng.random() < 0.7 else str(k)): tree(depth - 1) if k % 2 else [tree(depth - 1)] for k in range(rng.randrange(1, 4))}

    documents = [document, *[tree(4) for _ in range(6)]]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "i long, doc string")
    rows = outputs.read_output_json(frame, "doc", ["i"]).collect()
    for i, d in enumerate(documents):
        met = _met(d, [])
        for r in (r for r in rows if r["i"] == i):
            assert met.index(r["title"]) + 1 == r["record"]
        titles = {r["title"] for r in rows if r["i"] == i}
        assert titles == {t for t in met if not t.startswith("own")}
    leaf = sorted((r["row_no"], r["cells"]) for r in rows if r["title"] == "leaf")
    assert leaf == [(1, ["1.5", "x"]), (2, ["-200000.0", "true"])]


def test_json_keeps_spelling_and_odd_strings(spark):
    raw = r'{"title": "a \"1\" : 2, [3] \\", "header": ["n", "s", "o"], "data": [[1.50, "12", {"k": 1.0, "q": "x\"y"}], [1e5, "n", null], [-0, "s\\", [1, "2"]], [true, "{", "[1"]]}'
    rows = outputs.read_output_json(spark.createDataFrame([(raw,)], "doc string").withColumn("i", F.lit(1)), "doc", ["i"]).orderBy("row_no").collect()
    assert {r["title"] for r in rows} == {'a "1" : 2, [3] \\'}
    assert [r["cells"] for r in rows] == [["1.50", "12", '{"k":1.0,"q":"x\\"y"}'], ["1e5", "n", None], ["-0", "s\\", '[1,"2"]'], ["true", "{", "[1"]]
    with pytest.raises(Exception):
        outputs.read_output_json(spark.createDataFrame([("{1.2.3}",)], "doc string").withColumn("i", F.lit(1)), "doc", ["i"]).collect()


def _index_frames(spark):
    text = lambda *names: ", ".join(f"{n} string" for n in names)
    rows = [("d", "t", "f", k, f"K{k % 50}", f"k{k % 50}", {"a": "b"}) for k in range(300)]
    resolved = [("d", "f", "t", k, "c", f"k{k % 50}", f"k{k % 50}", k % 2 == 0, "t" if k % 2 == 0 else None) for k in range(400)]
    return {
        "rows": spark.createDataFrame(rows, "dataset_id string, table_name string, file_name string, line_no long, pk_value string, pk_lc string, values map<string,string>"),
        "resolved": spark.createDataFrame(resolved, "dataset_id string, source_file string, source_table string, source_line long, source_column string, fk_value string, fk_lc string, resolved boolean, actual_target_table string"),
        "children": spark.createDataFrame([], text("dataset_id", "file_name") + ", line_no long"),
        "refs": spark.createDataFrame([("d", "f", 1)], text("dataset_id", "source_file") + ", source_line long"),
        "entries": spark.createDataFrame([("d", 1)], "dataset_id string, row_id long"),
        "bound": spark.createDataFrame([("d", "f")], text("dataset_id", "file_name")),
        "inventory": spark.createDataFrame([("d", "/d/f")], text("dataset_id", "path")),
    }


def test_snapshot_lookups_open_one_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 40)
    frames = _index_frames(spark)
    store.save_snapshot(frames, str(tmp_path / "s"))
    saved = store.load_snapshot(spark, str(tmp_path / "s"))
    found = saved.row("d", "t", "K7")
    assert sorted(r["line_no"] for r in found.collect()) == [7, 57, 107, 157, 207, 257] and found.columns == frames["rows"].columns
    asked = saved.references_to("d", "t", "k8")
    assert sorted(r["source_line"] for r in asked.collect()) == [8, 58, 108, 158, 208, 258, 308, 358]
    for plan in map(_plan, (found, asked)):
        assert "Exchange" not in plan and "PartitionFilters: [isnotnull(_bucket" in plan
    assert saved.tables["children"].count() == 0 and saved.buckets["rows"] == 8


def test_snapshots_that_broke_off_are_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(store.SnapshotVersionError):
        store.load_snapshot(spark, path)
    frames = _index_frames(spark)
    with pytest.raises(KeyError):
        store.save_snapshot({k: v for k, v in frames.items() if k != "inventory"}, path)
    with pytest.raises(store.SnapshotVersionError):
        store.load_snapshot(spark, path)  # no manifest was written
    store.save_snapshot(frames, path)
    store.save_snapshot(frames | {"rows": frames["rows"].limit(5)}, path)
    assert store.load_snapshot(spark, path).tables["rows"].count() == 5  # the newest
    newest = sorted(p for p in (tmp_path / "s").iterdir() if p.name.startswith("save-"))
    for folder in newest:
        for part in (folder / "rows").rglob("*.parquet"):
            part.write_bytes(b"")
    with pytest.raises(Exception):
        store.load_snapshot(spark, path).tables["rows"].count()


def test_record_sets_have_their_own_headers(spark, tmp_path):
    rows = [(t, [t, "b,c"], ["-", None] if t == "x y" else None, k, [str(k), f' "{k}"\n']) for t in ("x y", "z") for k in range(1, 60)]
    frame = spark.createDataFrame(rows, "title string, columns array<string>, units array<string>, row_no long, cells array<string>")
    store.write_record_sets(frame.repartition(3), str(tmp_path / "out"))
    read = lambda name: spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(str(tmp_path / "out" / name))
    first, second = read("set=01_x_y"), read("set=02_z")
    assert first.columns == ["__row_type", "x y", "b,c"] and second.columns == ["z", "b,c"]
    assert sorted(int(r["z"]) for r in second.collect()) == list(range(1, 60))
    assert [tuple(r) for r in first.filter("__row_type = 'units'").collect()] == [("units", "-", None)]
    assert {r["b,c"] for r in second.collect()} == {f' "{k}"\n' for k in range(1, 60)}


def test_the_text_is_read_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "in" / "b.Sol").write_text("three\n")
    got = line_source.scan_lines(spark, str(tmp_path / "in"))
    plan = _plan(got)
    assert "FileScan text" not in plan and "Scan text" not in plan
    only = line_source.of_kinds(got, ".sol")
    assert [r["raw"] for r in only.collect()] == ["three"]
    assert "PartitionFilters: [coalesce(kind" in _plan(only) or "PartitionFilters: [(coalesce(kind" in _plan(only)
    import inspect

    assert "_jdf" not in inspect.getsource(line_source) and "inputFiles" not in inspect.getsource(line_source)


def test_hashed_ids_of_large_keys(spark, tmp_path):
    """The products leave 64 bits from keys of a few thousand on."""
    from linkfold.plans.registry import QUERIES

    keys = [1, 1499, 59_999, 9_000_000, 2**40, 2**40, 2**62]
    spark.createDataFrame([(k, "A" if k % 2 else "N") for k in keys], "l_orderkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    hashed = {k: k * 2654435761 % 4611686018427387847 * 1000003 % 9007199254740881 for k in keys}
    got = sorted((r["l_returnflag"], r["hashed"], r["new_id"]) for r in QUERIES["renumber_hashed"](spark, str(tmp_path)).collect())
    want = []
    for flag in ("A", "N"):
        own = [hashed[k] for k in keys if ("A" if k % 2 else "N") == flag]
        want += [(flag, h, sorted(set(own)).index(h) + 1) for h in sorted(own)]
    assert got == want


def test_spans_of_any_width_are_exploded_in_blocks(spark):
    """Up, down, single and empty spans; a block holds no more than its length."""
    cells = spark.createDataFrame([(1, ["4", "9", "-12", "20"]), (2, ["7", "-3"]), (3, []), (4, None), (5, ["1", "-25000"])], "i int, c array<string>")
    out = ordinals.explode_spans(cells.select("i", text.signed_spans(F.col("c")).alias("s")), F.col("s"), "e")
    got = {i: sorted(r["e"] for r in out.filter(F.col("i") == i).collect()) for i in range(1, 6)}
    assert got == {1: [4, 9, 10, 11, 12, 20], 2: [3, 4, 5, 6, 7], 3: [], 4: [], 5: list(range(1, 25001))}
    assert "flatten" not in _plan(out)


def test_many_attached_rows_are_not_broadcast(spark, monkeypatch):
    """Rows that are alike are small on disk only; the hint outlives columns taken from the frame."""
    monkeypatch.setattr(session, "ATTACHED_ROWS", 10)
    wide = F.array_repeat(F.lit("the same border"), 50)
    left = spark.range(1000).withColumn("raw", F.col("id").cast("string"))
    for n, kind in ((10, "BroadcastHashJoin"), (11, "SortMergeJoin")):
        files = session.attached(spark.range(n).withColumn("bounds", wide).withColumn("mode", F.lit("m")))
        joined = left.join(files.select("id", "bounds").filter("id >= 0"), "id")
        assert kind in _plan(joined)
        assert joined.count() == n


@pytest.mark.parametrize("few", [0, 5])
def test_closure_of_contracted_graphs(spark, monkeypatch, few):
    """Long rivers, cycles, parting and meeting ways, seeds inside; against a plain search."""
    from linkfold.operators import graph

    monkeypatch.setattr(graph, "FEW_LINKS", few)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 25) for i in range(25)] + [(30, 105), (112, 200), (7, 7)]
    links += [(200 + i, 200 + rng.randrange(40)) for i in range(40) for _ in range(rng.choice([0, 1, 1, 2]))]
    rows = [(d, rng.choice("ab") if d == "x" else "a", *e) for d in ("x", "y") for e in links]
    types = {}
    named = lambda d, n: types.setdefault((d, n), rng.choice(["sdc", "out"]))
    edges = [(d, named(d, a), a, named(d, b), b) for d, _, a, b in rows]
    begin = {"x": [5, 40, 900], "y": [110]}
    seeds = [(d, named(d, n), n) for d in begin for n in begin[d]]
    want = set(seeds)
    while True:
        more = {(d, dt, di) for d, st, si, dt, di in edges if (d, st, si) in want} - want
        if not more:
            break
        want |= more
    frame = spark.createDataFrame(edges, "dataset_id string, src_typ string, src_id long, dst_typ string, dst_id long")
    got = graph._contracted(
        frame.toDF("dataset_id", "typ", "id", "_typ", "_id").filter(graph._no_loop()), spark.createDataFrame(seeds, "dataset_id string, typ string, id long"), 2
    )
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_long_river_is_contracted_before_it_is_doubled(spark, monkeypatch):
    """Doubling sees few links only, so its rounds over all ways known stay small."""
    from linkfold.operators import graph

    monkeypatch.setattr(graph, "FEW_LINKS", 1000)
    seen, followed = [], graph._followed
    monkeypatch.setattr(graph, "_followed", lambda links, *a: seen.append(links.count()) or followed(links, *a))
    river = spark.range(5000).select(F.lit("m").alias("dataset_id"), F.lit("r").alias("src_typ"), F.xxhash64("id").alias("src_id"), F.lit("r").alias("dst_typ"), F.xxhash64(F.col("id") + 1).alias("dst_id"))
    seeds = spark.range(1).select(F.lit("m").alias("dataset_id"), F.lit("r").alias("typ"), F.xxhash64(F.lit(1000).cast("long")).alias("id"))
    assert graph.downstream_closure(river, seeds).distinct().count() == 4001
    assert seen[0] <= 1000


def test_references_of_schedules_make_their_values_once(spark):
    """No filter makes the map of a line's values again, and record starts travel as raw lines."""
    from linkfold.operators import refs
    from linkfold.plans import text_queries
    from linkfold.sources import records

    raws = ["schedules", "name numb_ops numb_auto", "s1 2 1", "tbl7 corn", "o 1 1 0.15 3 x op5 9", "f 1 1 0.15 3 x null 9", "s2 0 0", "s3 1 0", "z 1 1 0.15 3 x op6 9"]
    lines = session.durable(spark.createDataFrame([("d", "management.sch", i, raw) for i, raw in enumerate(raws, 1)], "dataset_id string, file_name string, line_no bigint, raw string"))
    mains = text_queries._records(lines)
    assert [r["line_no"] for r in mains.orderBy("line_no").collect()] == [3, 7, 8]
    assert "leftsemi" not in mains._jdf.queryExecution().optimizedPlan().toString().lower()
    found = refs.management_refs(records.management_ops(mains, lines), text_queries._SCHEDULE)
    got = sorted(tuple(r) for r in found.select("source_line", "source_column", "fk_value", "target_table").collect())
    assert got == [(4, "auto_op_dtl", "tbl7", "lum_dtl"), (5, "op_data1(o)", "op5", "part_ops")]
    plan = found.select("fk_value", "target_table")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "map(" in x]
