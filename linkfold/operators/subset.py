"""Reduced datasets: keep chosen units (alone or with all they drain to), renumber, rewrite references.

Text goes in as ``lines`` (``dataset_id, file_name, line_no, raw``) and comes out the same way with
new line numbers. ``selected`` is ``dataset_id, id``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from linkfold.functions import text
from linkfold.functions.ordinals import explode_upto, with_ids_between, with_ordinal, with_sorted_ordinal
from linkfold.operators import graph
from linkfold.session import attached, durable

FILE = ["dataset_id", "file_name"]

#: Elements of a definition that become text together.
LIST_BLOCK = 4096

# Files an isolated subset does without.
ISOLATED_NULL = (
    "rout_unit.dr", "water_allocation.wro", "element.wro", "water_rights.wro", "object.prt", "rout_unit.con",
    "aquifer.con", "aquifer2d.con", "channel.con", "reservoir.con", "recall.con", "exco.con", "delratio.con",
    "outlet.con", "chandeg.con", "gwflow.con", "hru-lte.con",
)
# Files a routed subset always does without.
ROUTED_NULL = ("water_allocation.wro", "element.wro", "water_rights.wro", "object.prt")
# Print rows switched off in an isolated subset.
UNPRINTED = ("lsunit_wb", "lsunit_nb", "lsunit_ls", "lsunit_pw", "ru", "ru_salt", "ru_cs")

# Header spellings of each object count.
COUNT_ALIASES = {
    "obj": ("obj", "objs"),
    "hru": ("hru",),
    "hru_lte": ("lhru", "hru_lte", "hrulte", "hlt"),
    "ru": ("rtu", "ru"),
    "gwflow": ("gwfl", "gwflow"),
    "aqu": ("aqu",),
    "cha": ("cha", "chan"),
    "res": ("res",),
    "recall": ("rec", "recall"),
    "exco": ("exco",),
    "dr": ("dlr", "dr", "del"),
    "canal": ("can", "canal"),
    "pump": ("pmp", "pump"),
    "outlet": ("out", "outlet"),
    "chandeg": ("lcha", "chandeg", "sdc"),
    "aqu2d": ("aqu2d",),
    "herd": ("hrd", "herd"),
    "wro": ("wro",),
}
# Count an object type adds to.
COUNT_OF_TYPE = {
    "hru": "hru",
    "hlt": "hru_lte",
    "hru_lte": "hru_lte",
    "ru": "ru",
    "gwflow": "gwflow",
    "aqu": "aqu",
    "cha": "cha",
    "res": "res",
    "rec": "recall",
    "recall": "recall",
    "exc": "exco",
    "exco": "exco",
    "dr": "dr",
    "out": "outlet",
    "outlet": "outlet",
    "sdc": "chandeg",
    "chandeg": "chandeg",
}


class MissingIdsError(ValueError):
    """Ids that were asked for do not exist."""


def require_ids(requested: DataFrame, found: DataFrame, what: str) -> None:
    """Raise when requested ids are missing; the message shows the smallest few."""
    missing = requested.join(found, ["dataset_id", "id"], "left_anti").orderBy("dataset_id", "id").limit(20).collect()
    if missing:
        raise MissingIdsError(f"{what}: " + ", ".join(f"{r['dataset_id']}:{r['id']}" for r in missing))


# --- shared pieces -------------------------------------------------------------


def put(tokens: Column, index: Column | int, value: Column) -> Column:
    """Tokens with the cell at a 0-based index replaced."""
    at = F.lit(index) if isinstance(index, int) else index
    return F.transform(tokens, lambda t, i: F.when(i == at, value).otherwise(t))


def right_aligned(tokens: Column, width: int, gap: str = " ") -> Column:
    """Cells padded on the left to ``width``; longer cells stay whole."""
    return F.array_join(
        F.transform(tokens, lambda t: F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(t), F.lit(0))), t)),
        gap,
    )


def _body(lines: DataFrame, name: str, after: int) -> DataFrame:
    return (
        lines.filter((F.lower("file_name") == name) & (F.col("line_no") > after))
        .withColumn("tokens", text.tokens(F.col("raw")))
        .filter(F.size("tokens") > 0)
    )


def _heads(lines: DataFrame, name: str, count: int) -> DataFrame:
    return lines.filter((F.lower("file_name") == name) & (F.col("line_no") <= count)).select(*FILE, "line_no", "raw")


def _written(heads: DataFrame, body: DataFrame, count: int) -> DataFrame:
    """Head lines followed by the body, whose ``new_line`` counts from one."""
    return heads.unionByName(body.select(*FILE, (F.col("new_line") + count).alias("line_no"), "raw"))


def header_positions(lines: DataFrame, name: str, wanted: dict[str, tuple[tuple[str, ...], int | None]]) -> DataFrame:
    """0-based places of named columns in the header (line 2) of a file, one row per dataset.

    ``wanted`` maps an output name to its header spellings and the place used without any of them.
    """
    head = lines.filter((F.lower("file_name") == name) & (F.col("line_no") == 2)).withColumn(
        "_h", text.tokens(F.lower("raw"))
    )

    def place(spellings: tuple[str, ...], default: int | None) -> Column:
        at = F.array_position(F.transform("_h", lambda h: h.isin(list(spellings))), True)
        return F.when(at > 0, (at - 1).cast("int")).otherwise(F.lit(default).cast("int"))

    # A row for each dataset: attached, the lines of a file need not meet under its one key in one task.
    return attached(head.select(*FILE, F.size("_h").alias("header_size"), *[place(*w).alias(n) for n, w in wanted.items()]))


def map_ids(ids: DataFrame) -> DataFrame:
    """``dataset_id, id`` to dense ``new_id`` in id order."""
    return with_sorted_ordinal(ids.select("dataset_id", "id").distinct(), ["dataset_id"], ["id"], "new_id")


# --- connect and data files ------------------------------------------------------


def isolated_connect(lines: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unit connect file cut to the selected units: ``(lines, id map, property map)``.

    Columns behind the routing count go and the count becomes 0. Units are numbered in file order,
    property ids densely in id order. Raises when a selected unit is missing.
    """
    name = "hru.con"
    places = header_positions(lines, name, {"id_at": (("id",), None), "out_at": (("out_tot", "src_tot"), None)})
    chosen = (
        _body(lines, name, 2)
        .join(places, FILE)
        .withColumn("id", text.integer(F.get("tokens", F.col("id_at"))))
        .drop("tokens")
        .join(selected.select("dataset_id", "id").distinct(), ["dataset_id", "id"], "left_semi")
    )
    # Lines are shuffled without their cells, and those chosen are written once.
    chosen = durable(chosen).withColumn("tokens", text.tokens(F.col("raw")))
    require_ids(selected.select("dataset_id", "id"), chosen.select("dataset_id", "id"), "units not in the connect file")
    prop = F.when(F.col("header_size") > 7, text.integer(F.get("tokens", F.lit(7))))
    chosen = with_ordinal(chosen.withColumn("prop", prop), ["dataset_id"], "line_no", "new_line")
    properties = map_ids(chosen.filter("prop is not null").select("dataset_id", F.col("prop").alias("id")))
    named = chosen.join(
        properties.select("dataset_id", F.col("id").alias("prop"), F.col("new_id").alias("new_prop")),
        ["dataset_id", "prop"],
        "left",
    )
    cut = F.slice("tokens", F.lit(1), F.col("out_at") + 1)
    cut = put(cut, F.col("id_at"), F.col("new_line").cast("string"))
    cut = F.when(F.col("new_prop").isNotNull(), put(cut, 7, F.col("new_prop").cast("string"))).otherwise(cut)
    rows = named.withColumn("cells", put(cut, F.col("out_at"), F.lit("0")))
    # A unit listed twice maps to its last line.
    ids = rows.groupBy("dataset_id", "id").agg(F.max("new_line").alias("new_id"))
    return _aligned(lines, name, rows, places), ids, properties


def _aligned(lines: DataFrame, name: str, rows: DataFrame, places: DataFrame) -> DataFrame:
    """Title, header and rows with every column as wide as its widest cell."""
    header = (
        lines.filter((F.lower("file_name") == name) & (F.col("line_no") == 2))
        .join(places.select(*FILE, "out_at"), FILE)
        .withColumn("cells", F.slice(text.tokens(F.col("raw")), F.lit(1), F.col("out_at") + 1))
        .select(*FILE, F.lit(0).cast("bigint").alias("new_line"), "cells")
    )
    table = header.unionByName(rows.select(*FILE, "new_line", "cells"))
    widths = (
        table.select(*FILE, F.posexplode(F.transform("cells", F.length)).alias("at", "w"))
        .groupBy(*FILE, "at")
        .agg(F.max("w").alias("w"))
        .groupBy(*FILE)
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("_w"))
    )
    padded = F.transform(
        "cells",
        lambda c, i: F.concat(F.repeat(F.lit(" "), F.element_at(F.col("_w"), i) - F.length(c)), c),
    )
    body = table.join(attached(widths), FILE).select(
        *FILE, (F.col("new_line") + 2).alias("line_no"), F.array_join(padded, " ").alias("raw")
    )
    return _heads(lines, name, 1).unionByName(body)


def data_table(lines: DataFrame, name: str, kept: DataFrame, strict: bool = True, by_rank: bool = False) -> DataFrame:
    """Rows of a data file whose first cell is a kept id (``dataset_id, id, new_id``).

    Rows take numbers in file order, or the kept id's ``new_id`` with ``by_rank``; the rest of each
    line stays as it is. ``strict`` raises when a kept id has no row.
    """
    rows = _body(lines, name, 2).withColumn("id", text.integer(F.get("tokens", F.lit(0)))).join(
        kept.select("dataset_id", "id", "new_id"), ["dataset_id", "id"]
    )
    if strict:
        require_ids(kept.select("dataset_id", "id"), rows.select("dataset_id", "id"), f"ids not in {name}")
    rows = with_ordinal(rows, FILE, "line_no", "new_line")
    number = F.col("new_id") if by_rank else F.col("new_line")
    rest = F.regexp_replace(F.regexp_replace("raw", r"^\s*\S+\s*", ""), r"\s+$", "")
    start = F.lpad(number.cast("string"), 8, " ")
    raw = F.when(rest == "", start).otherwise(F.concat(start, F.lit(" "), rest))
    return _written(_heads(lines, name, 2), rows.withColumn("raw", raw), 2)


def routed_connect(lines: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Connect files of all kept types: ``(lines, property ids dataset_id, typ, id)``.

    Rows of kept objects get new ids; targets are renumbered, those not kept are dropped and
    counted out; property ids are renumbered per file.
    """
    types = {files[0]: typ for typ, files in graph.OBJECT_FILES.items()}
    inside = lines.filter(F.col("file_name").isin(list(types))).withColumn("typ", text.lookup(F.col("file_name"), types))
    inside = inside.join(attached(maps.select("dataset_id", "typ").distinct()), ["dataset_id", "typ"], "left_semi")
    heads = inside.filter("line_no <= 2")
    places = attached(heads.filter("line_no = 2").select(
        *FILE,
        F.size(text.tokens(F.col("raw"))).alias("header_size"),
        F.coalesce(
            F.nullif(F.array_position(text.tokens(F.lower("raw")), F.lit("src_tot")), F.lit(0).cast("bigint")) - 1,
            F.lit(graph.TARGET_COUNT),
        )
        .cast("int")
        .alias("src_at"),
    ))
    rows = (
        inside.filter("line_no > 2")
        .withColumn("tokens", text.tokens(F.col("raw")))
        .withColumn("id", text.integer(F.get("tokens", F.lit(0))))
        .drop("tokens")
        .join(maps, ["dataset_id", "typ", "id"])
        .join(places, FILE)
    )
    # Lines are shuffled without their cells, and those kept are written once.
    rows = durable(rows).withColumn("tokens", text.tokens(F.col("raw")))
    rows = rows.withColumn("prop", F.when(F.col("header_size") > 7, text.integer(F.get("tokens", F.lit(7)))))
    rows = with_ordinal(rows, FILE, "line_no", "new_line")
    properties = graph.id_maps(
        rows.filter("prop is not null").select("dataset_id", "typ", F.col("prop").alias("id"))
    )
    targets = rows.select(
        *FILE, "line_no", F.inline(graph.target_groups(F.col("tokens"), F.col("src_at")))
    )
    # A list is no longer than the line it stands in.
    kept = (
        graph.remap_targets(targets, maps, FILE)
        .groupBy(*FILE, "line_no")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "nth",
                        F.array("obj_typ", F.col("new_obj_id").cast("string"), "hyd_typ", "frac_text").alias("cells"),
                    )
                )
            ).alias("_t")
        )
    )
    new_prop = properties.select(
        "dataset_id", "typ", F.col("id").alias("prop"), F.col("new_id").alias("new_prop")
    )
    out = rows.join(new_prop, ["dataset_id", "typ", "prop"], "left").join(kept, [*FILE, "line_no"], "left")
    base = put(F.slice("tokens", F.lit(1), F.col("src_at")), 0, F.col("new_id").cast("string"))
    base = F.when(F.col("new_prop").isNotNull(), put(base, 7, F.col("new_prop").cast("string"))).otherwise(base)
    links = F.coalesce(F.flatten(F.transform("_t", lambda t: t["cells"])), F.array().cast("array<string>"))
    count = F.coalesce(F.size("_t"), F.lit(0))
    cells = F.concat(base, F.array(F.when(F.col("_t").isNull(), 0).otherwise(count).cast("string")), links)
    body = out.withColumn("raw", right_aligned(cells, 8, "  "))
    return _written(heads.select(*FILE, "line_no", "raw"), body, 2), properties


# --- elements and definitions ------------------------------------------------------


def element_table(
    lines: DataFrame,
    name: str,
    maps: DataFrame,
    number_by_object: bool,
    sort_by_object: bool = True,
    gap: str = " ",
) -> tuple[DataFrame, DataFrame]:
    """Element file cut to members of the kept objects: ``(lines, element map)``.

    ``maps``: ``dataset_id, typ, id, new_id``. Elements are ordered by their object's new id (or stay
    in file order) and numbered by it or one after the other.
    """
    places = header_positions(
        lines,
        name,
        {
            "id_at": (("id",), 0),
            "typ_at": (("obj_typ", "objtyp"), 2),
            "obj_at": (("obj_typ_no", "objtypno", "obj_id"), 3),
        },
    )
    rows = (
        _body(lines, name, 2)
        .join(places, FILE)
        .withColumn("elem", text.integer(F.get("tokens", F.col("id_at"))))
        .withColumn("typ", F.lower(F.get("tokens", F.col("typ_at"))))
        .withColumn("id", text.integer(F.get("tokens", F.col("obj_at"))))
        .filter("elem is not null")
        .drop("tokens")
        .join(maps.select("dataset_id", "typ", "id", "new_id"), ["dataset_id", "typ", "id"])
    )
    # Lines are shuffled without their cells, and those kept are written once.
    rows = durable(rows).withColumn("tokens", text.tokens(F.col("raw")))
    rows = (
        with_ordinal(rows, FILE, "new_id", "new_line", ["line_no"])
        if sort_by_object
        else with_ordinal(rows, FILE, "line_no", "new_line")
    )
    number = F.col("new_id") if number_by_object else F.col("new_line")
    rows = rows.withColumn("new_elem", number.cast("bigint"))
    cells = put(
        put(F.col("tokens"), F.col("id_at"), F.col("new_elem").cast("string")),
        F.col("obj_at"),
        F.col("new_id").cast("string"),
    )
    body = rows.withColumn("raw", right_aligned(cells, 12, gap))
    # An element id that occurs twice maps to its last row.
    elements = rows.groupBy("dataset_id", F.col("elem").alias("id")).agg(
        F.max_by("new_elem", "new_line").alias("new_id")
    )
    return _written(_heads(lines, name, 2), body, 2), elements


def definition_members(lines: DataFrame, name: str, total_at: int, heads: int) -> DataFrame:
    """Definitions with their element lists as spans: ``..., line_no, tokens, id, spans``."""
    # The file's lines are written once: in one filter with the file's name, spans would be read from all lines of all files.
    own = durable(_body(lines, name, heads).drop("tokens")).withColumn("tokens", text.tokens(F.col("raw")))
    rows = own.withColumn("id", text.integer(F.get("tokens", F.lit(0)))).withColumn("total", text.integer(F.get("tokens", F.lit(total_at))))
    listed = F.slice("tokens", F.lit(total_at + 2), F.greatest("total", F.lit(0)).cast("int"))
    return rows.filter("id is not null and total is not null").withColumn("spans", text.signed_spans(listed))


def definition_table(
    lines: DataFrame,
    name: str,
    elements: DataFrame,
    total_at: int,
    heads: int = 2,
    count_line: bool = False,
    kept: DataFrame | None = None,
    gap: str = " ",
) -> tuple[DataFrame, DataFrame]:
    """Definition file with renumbered elements: ``(lines, id map)``.

    The elements inside the lists' spans are looked up, mapped and counted again; a span costs what it finds, however
    wide it is, and a long list is held as text only. Definitions left without elements go, and the others are numbered in file order; with ``kept``
    (``dataset_id, id, new_id``) exactly those definitions stay, under their new ids, empty or not. ``count_line`` writes the number of rows
    above the header.
    """
    rows = definition_members(lines, name, total_at, heads)
    spans = rows.select(*FILE, "line_no", F.posexplode("spans").alias("nth", "s")).select(
        *FILE, "line_no", "nth", (F.col("s.first") > F.col("s.last")).alias("down"), F.least("s.first", "s.last").alias("low"), F.greatest("s.first", "s.last").alias("high")
    )
    placed, ranked = with_ids_between(spans, elements.select("dataset_id", "id", F.col("new_id").alias("new_elem")), ["dataset_id"], "id", "low", "high")
    members = explode_upto(placed, F.col("n_ids"), "_k").withColumn("rank", F.col("first_rank") + F.col("_k") - 1)
    place = F.when(F.col("down"), -F.col("rank")).otherwise(F.col("rank"))
    found = members.join(ranked.select("dataset_id", "rank", "new_elem"), ["dataset_id", "rank"]).withColumn("place", place)
    # A list becomes text block by block, so that no row holds the elements of a long one.
    block = F.floor(F.col("place") / F.lit(LIST_BLOCK)).alias("_block")
    listed = F.transform("_e", lambda e: e["new_elem"].cast("string"))
    pieces = durable(
        found.groupBy(*FILE, "line_no", "nth", block)
        .agg(F.array_sort(F.collect_list(F.struct("place", "new_elem"))).alias("_e"))
        .select(*FILE, "line_no", "nth", "_block", F.size("_e").alias("_n"), F.nullif(right_aligned(listed, 12, gap), F.lit("")).alias("_text"))
    )
    rows = rows.select(*FILE, "line_no", "id", F.slice("tokens", F.lit(1), F.lit(total_at)).alias("base"))
    if kept is not None:
        joined = rows.join(kept.select("dataset_id", "id", "new_id"), ["dataset_id", "id"])
        numbered = with_ordinal(joined, FILE, "line_no", "new_line")
    else:
        joined = rows.join(pieces, [*FILE, "line_no"], "left_semi")
        numbered = with_ordinal(joined, FILE, "line_no", "new_line").withColumn("new_id", F.col("new_line"))
    base = put(F.col("base"), 0, F.col("new_id").cast("string"))
    whole = (
        numbered.withColumn("base", base)
        .join(pieces, [*FILE, "line_no"], "left")
        .groupBy(*FILE, "new_line")
        .agg(F.first("base").alias("base"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"), F.array_sort(F.collect_list(F.struct("nth", "_block", "_text"))).alias("_e"))
    )
    start = right_aligned(F.concat("base", F.array(F.col("_n").cast("string"))), 12, gap)
    body = whole.withColumn("raw", F.array_join(F.concat(F.array(start), F.transform("_e", lambda e: e["_text"])), gap))
    top = _heads(lines, name, heads)
    if count_line:
        counts = numbered.groupBy(*FILE).agg(F.count(F.lit(1)).alias("_n"))
        top = top.join(counts, FILE, "left").select(
            *FILE,
            "line_no",
            F.when(F.col("line_no") == 2, F.coalesce("_n", F.lit(0)).cast("string")).otherwise(F.col("raw")).alias("raw"),
        )
    ids = numbered.groupBy("dataset_id", "id").agg(F.max_by("new_id", "new_line").alias("new_id"))
    return _written(top, body, heads), ids


def unit_table(lines: DataFrame, name: str, maps: DataFrame) -> DataFrame:
    """Rows of a unit file whose first cell is mapped (``dataset_id, id, new_id``), in file order."""
    rows = _body(lines, name, 2).withColumn("id", text.integer(F.get("tokens", F.lit(0)))).join(
        maps.select("dataset_id", "id", "new_id"), ["dataset_id", "id"]
    )
    rows = with_ordinal(rows, FILE, "line_no", "new_line")
    cells = put(F.col("tokens"), 0, F.col("new_id").cast("string"))
    return _written(_heads(lines, name, 2), rows.withColumn("raw", right_aligned(cells, 12)), 2)


# --- single files --------------------------------------------------------------------


def object_counts(kept: DataFrame) -> DataFrame:
    """Kept objects per count column and their total: ``dataset_id, counts map, total``."""
    named = (
        kept.withColumn("key", text.lookup(F.col("typ"), COUNT_OF_TYPE, F.col("typ")))
        .filter(F.col("key").isin([k for k in COUNT_ALIASES if k != "obj"]))
        .groupBy("dataset_id", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return named.groupBy("dataset_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("counts"), F.sum("n").alias("total")
    )


def normalized_count_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def update_counts(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """Object count file with new numbers: known columns zero unless counted, the total rewritten."""
    spelled = {alias.replace("_", ""): key for key, aliases in COUNT_ALIASES.items() for alias in aliases}
    inside = lines.filter(F.lower("file_name") == "object.cnt")
    header = inside.filter("line_no = 2").select(
        *FILE,
        text.tokens(F.col("raw")).alias("_names"),
        F.transform(
            text.tokens(F.col("raw")), lambda h: text.lookup(normalized_count_name(h), spelled, F.lit(""))
        ).alias("_keys"),
    )
    rows = inside.filter("line_no > 2").join(header, FILE).join(counts, "dataset_id", "left")
    # Only the first column of each kind counts.
    first = lambda i, k: F.array_position("_keys", k) == i + 1
    value = lambda k: F.when(k == "obj", F.coalesce("total", F.lit(0))).otherwise(
        F.coalesce(F.try_element_at("counts", k), F.lit(0))
    )
    cells = F.transform(
        text.tokens(F.col("raw")),
        lambda t, i: F.when(
            (F.coalesce(F.get("_keys", i), F.lit("")) != "") & first(i, F.get("_keys", i)),
            value(F.get("_keys", i)).cast("string"),
        ).otherwise(t),
    )
    padded = F.transform(
        "_cells",
        lambda c, i: F.lpad(c, F.greatest(F.length(c), F.coalesce(F.length(F.get("_names", i)), F.lit(0))), " "),
    )
    body = rows.withColumn("_cells", cells).select(
        *FILE,
        "line_no",
        F.when(text.is_blank(F.col("raw")), F.col("raw")).otherwise(F.array_join(padded, " ")).alias("raw"),
    )
    return inside.filter("line_no <= 2").select(*FILE, "line_no", "raw").unionByName(body)


def nullify_list(lines: DataFrame, names: Iterable[str]) -> DataFrame:
    """Master list with the given files set to null."""
    return lines.filter(F.lower("file_name") == "file.cio").select(
        *FILE, "line_no", text.nullify_names(F.col("raw"), names).alias("raw")
    )


def nullify_unkept(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """Master list of a routed subset: files of object types a dataset does not keep become null."""
    types = kept.select("dataset_id", "typ").distinct().groupBy("dataset_id").agg(F.collect_set("typ").alias("_types"))
    inside = lines.filter(F.lower("file_name") == "file.cio").join(types, "dataset_id", "left")
    raw = text.nullify_names(F.col("raw"), ROUTED_NULL)
    for typ, files in graph.OBJECT_FILES.items():
        gone = ~F.coalesce(F.array_contains("_types", typ), F.lit(False))
        raw = F.when(gone, text.nullify_names(raw, [f for f in files if f])).otherwise(raw)
    return inside.select(*FILE, "line_no", raw.alias("raw"))


def disable_print(lines: DataFrame, names: Iterable[str] = UNPRINTED) -> DataFrame:
    """Print file with the four flags of the named rows set to ``n``."""
    tokens = text.tokens(F.col("raw"))
    off = F.array_join(F.transform(tokens, lambda t, i: F.when(i.between(1, 4), F.lit("n")).otherwise(t)), " ")
    hit = (F.size(tokens) >= 5) & F.lower(F.get(tokens, F.lit(0))).isin([n.lower() for n in names])
    return lines.filter(F.lower("file_name") == "print.prt").select(
        *FILE, "line_no", F.when(hit, off).otherwise(F.col("raw")).alias("raw")
    )
