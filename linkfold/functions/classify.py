"""File categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkfold.functions import text

# Category by suffix and name, first match wins. Each entry: category, suffixes,
# exact names, name prefixes, name parts, and (suffix, part) pairs.
RULES = (
    ("climate", (), (), (), ("wgn",), ()),
    ("simulation", (".cio", ".cnt", ".sim", ".prt", ".bsn", ".cal"), (), (), (), ()),
    ("climate", (".cli", ".pcp", ".tmp", ".slr", ".hmd", ".wnd"), (), (), (), ()),
    ("spatial", (".hru", ".rtu", ".def", ".ele"), (), (), (), ()),
    ("land", (".sol", ".fld", ".sno"), (), (), (), ((".hyd", "topo"),)),
    ("landuse", (".lum", ".sch", ".dtl"), ("plant.ini",), (), (), ()),
    ("operations", (".ops",), (), (), (), ((".str", "structural"),)),
    ("waterbodies", (".res", ".wet"), (), ("initial.res", "initial.wet"), (), ()),
    ("channels", (".cha",), (), ("initial.cha",), (), ()),
    ("groundwater", (".aqu",), (), ("initial.aqu",), ("gwflow",), ()),
    ("connectivity", (".con", ".lin"), (), (), (), ()),
    ("initialization", (".ini",), (), ("initial.",), ("om_water.ini", "pest_water.ini", "salt_water.ini", "-ini"), ()),
    ("databases", (".plt", ".frt", ".pst", ".pes", ".til", ".urb", ".sep"), (), (), (), ()),
)
OTHER_SUFFIXES = (".rec", ".del", ".dat", ".exc", ".sft")


def input_category(name: Column) -> Column:
    """Category of an input file by its name."""
    low = F.lower(text.base_name(name))
    ext = text.suffix(name)
    out: Column | None = None
    for category, suffixes, exact, prefixes, parts, pairs in RULES:
        tests = [ext.isin(list(suffixes))] if suffixes else []
        tests += [low.isin(list(exact))] if exact else []
        tests += [F.startswith(low, F.lit(p)) for p in prefixes]
        tests += [F.contains(low, F.lit(p)) for p in parts]
        tests += [(ext == s) & F.contains(low, F.lit(p)) for s, p in pairs]
        test = tests[0]
        for other in tests[1:]:
            test = test | other
        out = F.when(test, category) if out is None else out.when(test, category)
    return out.otherwise("other")


def file_category(name: Column, is_output_table: Column, is_known_input: Column) -> Column:
    """Category of any file; what is known from the catalog or the master list comes first."""
    ext = text.suffix(name)
    return (
        F.when(is_output_table, F.lit("output"))
        .when(is_known_input, input_category(name))
        .when(ext.isin(".csv", ".out"), F.lit("output"))
        .when(ext.isin(list(OTHER_SUFFIXES)), F.lit("other"))
        .when(ext == ".txt", F.lit("output"))
        .otherwise(input_category(name))
    )


def dir_categories(files: DataFrame) -> DataFrame:
    """Distinct categories per folder, outputs left out (``dataset_id, dir, category``)."""
    return (
        files.filter("category <> 'output'")
        .groupBy("dataset_id", "dir")
        .agg(F.array_sort(F.collect_set("category")).alias("categories"))
    )


def category_filter(files: DataFrame, categories: list[str]) -> DataFrame:
    """Files of the ticked categories; nothing ticked shows nothing."""
    return files.filter(F.col("category").isin(categories)) if categories else files.limit(0)


def dir_filter(dirs: DataFrame, categories: list[str]) -> DataFrame:
    """Folders with a file of a ticked category, and folders without inputs; nothing ticked, none."""
    if not categories:
        return dirs.limit(0)
    wanted = F.array(*[F.lit(c) for c in categories])
    return dirs.filter((F.size("categories") == 0) | F.arrays_overlap("categories", wanted))
