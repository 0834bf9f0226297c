"""Simulation outputs: quoted CSV, structured text with detected layout, and JSON record sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkfold.functions import text
from linkfold.session import attached, durable

FILE = ["dataset_id", "file_name"]

#: Lines a layout is decided from: header candidates are lines 2 to 7, each looks two lines ahead.
HEAD_LINES = 9


# --- shared ------------------------------------------------------------------


def fitted(cells: Column, width: Column) -> Column:
    """Exactly ``width`` cells: short rows padded, surplus joined into the last cell."""
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
    surplus = F.concat(
        F.slice(cells, F.lit(1), F.greatest(width - 1, F.lit(0))),
        F.array(F.array_join(F.slice(cells, F.greatest(width, F.lit(1)), F.greatest(F.size(cells), F.lit(1))), " ")),
    )
    return F.when(width <= 0, cells).when(F.size(cells) > width, surplus).otherwise(padded)


def first_filled(lines: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` non-blank lines per file, as ``keys, lines array<struct<line_no, raw>>``.

    Every task keeps only its ``n`` best lines before the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy("line_no")
    return (
        lines.filter(~text.is_blank(F.col("raw")))
        .withColumn("_n", F.row_number().over(window))
        .filter(F.col("_n") <= n)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("lines"))
    )


# --- CSV -----------------------------------------------------------------------


def csv_cells(line: Column) -> Column:
    """Trimmed cells of a CSV line; quotes may stand anywhere in a cell and double to escape."""
    # A leading comma makes every cell match the same pattern and rules out empty matches.
    cells = F.regexp_extract_all(
        F.concat(F.lit(","), line), F.lit(r',((?:"(?:[^"]|"")*(?:"|$)|[^",])*)'), 1
    )

    def unquote(cell: Column) -> Column:
        # Doubled quotes inside quotes stay as one; quotes that open or close go.
        marked = F.regexp_replace(cell, r'"((?:[^"]|"")*)(?:"|$)', "$1")
        return F.trim(F.replace(marked, F.lit('""'), F.lit('"')))

    return F.transform(cells, unquote)


def read_output_csv(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(layouts, rows)`` of CSV outputs with a header line each; rows hold ``cells array<string>``."""
    filled = lines.filter(~text.is_blank(F.col("raw")))
    layouts = filled.groupBy(*FILE).agg(F.min_by(F.struct("line_no", "raw"), "line_no").alias("_h")).select(
        *FILE,
        F.col("file_name").alias("title"),
        csv_cells(F.col("_h.raw")).alias("columns"),
        F.lit(None).cast("array<string>").alias("units"),
        F.col("_h.line_no").alias("header_line"),
        F.col("_h.line_no").alias("last_head_line"),
    )
    layouts = attached(layouts)
    rows = (
        filled.join(layouts.select(*FILE, "columns", "header_line"), FILE)
        .filter(F.col("line_no") > F.col("header_line"))
        .select(*FILE, "line_no", fitted(csv_cells(F.col("raw")), F.size("columns")).alias("cells"))
    )
    return layouts, rows


# --- structured text ------------------------------------------------------------

#: A cell of a units row has one of these characters.
UNIT_MARK = "[a-zA-Z/%()]"
#: With no data below it, a units row is known by a cell like this beside a dash; a lone row of words stays data.
LONE_UNIT = "(?i)^(?!n/a$).*[/%()]"
RULE = "^[-=]+$"
#: A line of one or two words with this is a part of the title.
BANNER = "--.*--"


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def _numeric_share(cells: Column) -> Column:
    """Share of cells that read as numbers, 0 for no cells."""
    numbers = F.filter(cells, lambda c: text.number(_stripped(c), thousands=True).isNotNull())
    return F.when(F.size(cells) > 0, F.size(numbers) / F.size(cells)).otherwise(F.lit(0.0))


def _reads_as_data(size: Column, share: Column, width: Column) -> Column:
    """Mostly numbers: fewer are enough where the number of cells is the expected one."""
    enough = F.greatest(F.lit(2), F.floor(width * F.lit(0.6)))
    return (size > 0) & (((size == width) & (share >= 0.3)) | ((share >= 0.45) & (size >= enough)))


def _reading(name: str, first: str, second: str, width: Column) -> dict[str, Column]:
    """What two lines below a header look like when they are split in one way: the struct column ``name``.

    ``first`` and ``second`` are columns of cells, ``{first}_share`` and ``{second}_share`` their shares of numbers:
    read once, since each is asked for many times.
    """
    cells, share, next_share = F.col(first), F.col(f"{first}_share"), F.col(f"{second}_share")
    filled = F.filter(cells, lambda c: c != "")
    size, next_size = F.size(cells), F.size(F.col(second))
    gaps = F.size(filled) < size
    units = (
        (F.size(filled) > 0)
        & F.exists(filled, lambda c: ~c.rlike(RULE))
        & (share <= 0.25)
        & _reads_as_data(next_size, next_share, size)
        & (gaps | (F.exists(filled, lambda c: c.rlike(UNIT_MARK)) & (next_share >= share)))
    )
    return {
        name: F.struct(
            cells.alias("cells"),
            units.alias("units"),
            _reads_as_data(size, share, width).alias("data"),
            _reads_as_data(next_size, next_share, width).alias("next_data"),
        )
    }


def detect_output_layout(lines: DataFrame) -> DataFrame:
    """Title, columns, units, column borders and last head line of each structured text output.

    The second to seventh filled line of a file each are a candidate, a row of its own with the two
    lines below it, read word by word and cut at the borders in the middle of the gaps between the
    candidate's words. The header is the first candidate that units or data follow in one of the two
    readings. A file that ends with its head has none: there it is the line below the title and its banners, if that
    line, or its units, end the file. Or else it is the second filled line.
    """
    heads = first_filled(lines, FILE, HEAD_LINES).filter(F.size("lines") > 1)
    below = lambda n: F.coalesce(F.get("lines", F.col("nth") + n)["raw"], F.lit(""))
    candidates = heads.select(*FILE, "lines", F.posexplode(F.slice("lines", 2, 6)).alias("_i", "head")).select(
        *FILE, "lines", (F.col("_i") + 1).alias("nth"), "head", text.token_spans(F.col("head.raw")).alias("spans")
    )
    middle = lambda a, b: F.floor((a["col_end"] + b["col_start"]) / 2).cast("int")
    spans = F.col("spans")
    borders = F.transform(
        spans,
        lambda w, i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(middle(F.get(spans, i - 1), w)).alias("start"),
            F.coalesce(middle(w, F.get(spans, i + 1)), F.length("head.raw")).alias("end"),
        ),
    )
    cut = lambda line: F.transform("bounds", lambda b: _stripped(line.substr(b["start"] + 1, b["end"] - b["start"])))
    read = (
        candidates.select(*FILE, "lines", "nth", "head", F.transform(spans, lambda w: w["token"]).alias("columns"), borders.alias("bounds"), below(1).alias("one"), below(2).alias("two"))
        .withColumn("width", F.size("columns"))
        .withColumns({"_words": text.tokens(F.col("one")), "_next_words": text.tokens(F.col("two")), "_cut": cut(F.col("one")), "_next_cut": cut(F.col("two"))})
    )
    read = read.withColumns({f"{c}_share": _numeric_share(F.col(c)) for c in ("columns", "_words", "_next_words", "_cut", "_next_cut")})
    read = read.withColumns(_reading("by_words", "_words", "_next_words", F.col("width")) | _reading("by_borders", "_cut", "_next_cut", F.col("width")))
    banner = (F.col("width") <= 2) & F.col("head.raw").rlike(BANNER)
    same = F.size("by_words.cells") == F.col("width")
    may_be = (F.col("width") > 1) & (F.col("columns_share") <= 0.25) & ~banner
    is_header = may_be & ((same & (F.col("by_words.units") | F.col("by_words.data"))) | F.col("by_borders.units") | F.col("by_borders.data"))
    # Below the title and banners alone, and nothing but units below.
    below_title = F.forall(F.slice("lines", F.lit(2), F.col("nth") - 1), lambda x: _stripped(x["raw"]).rlike(r"^\S*(\s+\S+)?$") & x["raw"].rlike(BANNER))
    lone_units = same & (F.col("two") == "") & (F.col("_words_share") == 0) & F.array_contains("by_words.cells", "-") & F.exists("by_words.cells", lambda c: c.rlike(LONE_UNIT))
    ends = may_be & below_title & ((F.col("one") == "") | lone_units)
    fields = ("lines", "nth", "head", "columns", "bounds", "two", "width", "by_words", "by_borders", "lone_units")
    # Candidates that are no header come after all others, in their order.
    rank = F.col("nth") + F.when(is_header, 0).when(ends, HEAD_LINES).otherwise(2 * HEAD_LINES)
    chosen = read.withColumn("lone_units", ends & lone_units).groupBy(*FILE).agg(F.min_by(F.struct(*fields), rank).alias("_c")).select(*FILE, "_c.*")
    few = (F.size("by_words.cells") > 0) & (F.size("by_words.cells") < F.col("width")) & F.col("by_words.next_data")
    more = F.col("two") != ""
    fixed = more & few & F.col("by_borders.units")
    kind = chosen.withColumn("mode", F.when(fixed, "fixed_width").otherwise("whitespace")).withColumn(
        "_units", F.when(fixed, F.col("by_borders")).when((more & F.col("by_words.units")) | F.col("lone_units"), F.col("by_words"))
    )
    above = F.filter(F.transform(F.slice("lines", F.lit(1), F.col("nth")), lambda x: _stripped(x["raw"])), lambda t: t != "")
    title = F.array_join(above, " ")
    last = F.when(F.col("_units").isNotNull(), F.get("lines", F.col("nth") + 1)["line_no"]).otherwise(F.col("head.line_no"))
    return attached(
        kind.select(
            *FILE,
            F.when(title != "", title).otherwise(F.col("file_name")).alias("title"),
            "columns",
            F.col("_units.cells").alias("units"),
            "mode",
            "bounds",
            F.col("head.line_no").alias("header_line"),
            last.alias("last_head_line"),
        )
    )


def read_output_text(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """Data rows of structured text: ``dataset_id, file_name, line_no, cells``.

    Lines are parsed where they are; the layouts (one row per file) come to them.
    """
    words = text.tokens(F.col("raw"))
    cut = F.transform(
        "bounds", lambda b: F.trim(F.substring(F.col("raw"), b["start"] + 1, b["end"] - b["start"]))
    )
    short = F.when(F.col("mode") == "fixed_width", cut).otherwise(F.col("_words"))
    cells = F.when(F.size("_words") >= F.size("columns"), F.col("_words")).otherwise(short)
    info = layouts.select(*FILE, "columns", "mode", "bounds", "last_head_line")
    return (
        lines.join(info, FILE)
        .filter(
            (F.col("line_no") > F.col("last_head_line"))
            & ~text.is_blank(F.col("raw"))
            & ~F.trim("raw").rlike("^[-=]+$")
        )
        .withColumn("_words", words)
        .select(*FILE, "line_no", fitted(cells, F.size("columns")).alias("cells"))
    )


def named_output(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells of one kind of output as named string columns."""
    return rows.select(*FILE, "line_no", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])


# --- JSON ------------------------------------------------------------------------

# Keys that are searched for records first.
CONTAINER_KEYS = ("outputs", "output", "tables", "records", "result", "results", "items")



# Characters that no JSON text may hold as they are; they stand for escapes and marks while a text is marked.
_SLASH, _QUOTE, _OPEN, _MID, _CLOSE = "\x01", "\x02", "\x03", "\x04", "\x05"


def marked_json(document: Column) -> Column:
    """The document with an ``s`` before each string's content, and each number as a string after an ``n``.

    Opening an object or array then leaves its parts with their kind and spelling: what begins with ``{`` or ``[`` is
    a container, never a string. Escapes are out of the way meanwhile, so a string is what lies between two quotes.
    """
    plain = F.replace(F.replace(document, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    number = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    # A string becomes OPEN content MID CLOSE, a number OPEN MID digits CLOSE.
    found = F.regexp_replace(plain, f'"([^"]*+)"|({number})', f"{_OPEN}$1{_MID}$2{_CLOSE}")
    for mark, text_ in ((_MID + _CLOSE, '"'), (_OPEN + _MID, '"n'), (_OPEN, '"s'), (_CLOSE, '"'), (_QUOTE, '\\"'), (_SLASH, "\\\\")):
        found = F.replace(found, F.lit(mark), F.lit(text_))
    return found


def _unmarked(raw: Column) -> Column:
    """A part as it was written: a string's content, a number's digits, or a container's text."""
    plain = F.replace(F.replace(raw, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    inner = F.regexp_replace(F.regexp_replace(plain, '"s([^"]*+)"', f"{_OPEN}$1{_OPEN}"), '"n([^"]*+)"', "$1")
    for mark, text_ in ((_OPEN, '"'), (_QUOTE, '\\"'), (_SLASH, "\\\\")):
        inner = F.replace(inner, F.lit(mark), F.lit(text_))
    return F.when(raw.startswith("s") | raw.startswith("n"), F.substr(raw, F.lit(2))).when(raw.startswith("{") | raw.startswith("["), inner).otherwise(raw)


def _is(raw: Column, first: str) -> Column:
    return F.coalesce(F.startswith(raw, F.lit(first)), F.lit(False))


def _members(raw: Column) -> Column:
    """Members of a marked object in the order of the document: ``array<struct<key, raw>>``."""
    return F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(F.substr(e["key"], F.lit(2)).alias("key"), e["value"].alias("raw")))


def _elements(raw: Column) -> Column:
    return F.from_json(raw, "array<string>")


def _records(documents: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """``keys, place, members, record`` of each object with data and a header or a title, at any depth.

    The document is marked once, and each level opens what the level before left unopened, so every container is
    parsed once and looked at in one place. ``place`` is the way to it: for each step whether it is a container
    member of an object, which a reader meets first and again among all members, and its position there.
    """
    step = "array<struct<first:int,nth:int>>"
    # Text that is no JSON is an error, found by the one strict parse.
    valid = F.length(F.schema_of_variant(F.parse_json(column))) > 0
    level = documents.filter(valid).select(*keys, F.array().cast(step).alias("place"), marked_json(F.col(column)).alias("raw"))
    order = F.array(*[F.lit(k) for k in CONTAINER_KEYS])
    met: DataFrame | None = None
    while True:
        opened = durable(
            level.select(
                *keys, "place",
                F.when(_is(F.col("raw"), "{"), _members(F.col("raw"))).alias("members"),
                F.when(_is(F.col("raw"), "["), _elements(F.col("raw"))).alias("elements"),
            )
        )
        if opened.limit(1).count() == 0:
            break
        names = F.transform("members", lambda m: m["key"])
        found = opened.filter(F.array_contains(names, "data") & (F.array_contains(names, "header") | F.array_contains(names, "title")))
        found = found.select(*keys, "place", "members")
        met = found if met is None else met.unionByName(found)
        at = lambda first, nth, raw: F.struct(F.struct(first.cast("int").alias("first"), nth.cast("int").alias("nth")).alias("step"), raw.alias("raw"))
        below = F.when(F.col("members").isNotNull(), F.transform("members", lambda m, i: at(F.array_position(order, m["key"]), i, m["raw"]))).otherwise(
            F.transform("elements", lambda x, i: at(F.lit(0), i, x))
        )
        level = opened.select(*keys, "place", F.inline(F.filter(below, lambda c: _is(c["raw"], "{") | _is(c["raw"], "[")))).select(
            *keys, F.concat("place", F.array("step")).alias("place"), "raw"
        )
    met = durable(met)
    return met.join(_numbers(met.select(*keys, "place"), keys), [*keys, "place"])


def _numbers(places: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, place, record``: how many records a reader has met when it first meets each place.

    A reader of an object meets it, then its container members, then all its members, so what lies below k steps to
    container members is met 2**k times. Counts below every prefix of a place give what is met before it among
    the members beside each of its steps; nothing is expanded by how often it is met.
    """
    prefixes = places.select(*keys, "place", F.explode(F.sequence(F.lit(0), F.size("place"))).alias("n"))
    prefixes = prefixes.withColumn("head", F.slice("place", F.lit(1), F.col("n"))).withColumn("rest", F.slice("place", F.col("n") + 1, F.size("place")))
    again = F.aggregate("rest", F.lit(1).cast("bigint"), lambda n, s: F.when(s["first"] > 0, n * 2).otherwise(n))
    below = prefixes.groupBy(*keys, "head").agg(F.sum(again).alias("n"), F.max((F.size("rest") == 0).cast("bigint")).alias("own"))
    below = below.withColumn("above", F.slice("head", F.lit(1), F.greatest(F.size("head") - 1, F.lit(0)))).withColumn("last", F.element_at("head", F.greatest(F.size("head"), F.lit(1))))
    beside = lambda *order: Window.partitionBy(*keys, "above").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    container = F.col("last.first") > 0
    every = Window.partitionBy(*keys, "above")
    # Container members come first, in the order of their names; all members come in the order of the document.
    among_first = F.coalesce(F.sum(F.when(container, F.col("n"))).over(beside(F.when(container, F.col("last.first")).otherwise(F.lit(1 << 30)), "last.nth")), F.lit(0))
    all_first = F.coalesce(F.sum(F.when(container, F.col("n"))).over(every), F.lit(0))
    in_order = F.coalesce(F.sum("n").over(beside("last.nth")), F.lit(0))
    steps = below.filter(F.size("head") > 0).withColumn("before", F.when(container, among_first).otherwise(all_first + in_order)).select(*keys, "head", "before")
    met = prefixes.filter("n > 0").join(steps, [*keys, "head"]).groupBy(*keys, "place").agg(F.sum("before").alias("_before"))
    # The record itself, and every record that it lies in.
    inside = prefixes.join(below.filter("own = 1").select(*keys, "head"), [*keys, "head"]).groupBy(*keys, "place").agg(F.count(F.lit(1)).alias("_inside"))
    return inside.join(met, [*keys, "place"], "left").select(*keys, "place", (F.col("_inside") + F.coalesce("_before", F.lit(0))).alias("record"))


def _listed(raw: Column) -> Column:
    """Words of a header or units member: elements of an array, words of a text, nothing for null or none."""
    return (
        F.when(_is(raw, "["), F.transform(_elements(raw), lambda v: F.coalesce(_unmarked(v), F.lit("null"))))
        .when(_is(raw, "s"), text.tokens(_unmarked(raw)))
        .when(raw.isNotNull(), F.array(_unmarked(raw)))
        .otherwise(F.array().cast("array<string>"))
    )


def read_output_json(documents: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Rows of every record ``{title, header, units, data}`` found in JSON documents.

    One input row per document. Output: ``keys``, the record's number, title, columns and units, the
    row number and its cells; short rows are padded, long ones cut to the header. Values keep their
    spelling. Text that is no JSON is an error.
    """
    keys = list(keys)
    member = lambda name: F.get(F.filter("members", lambda m: m["key"] == name), F.lit(0))["raw"]
    parts = _records(documents, column, keys).select(
        *keys, "record", member("title").alias("_title"), _listed(member("header")).alias("header"), _listed(member("units")).alias("_units"),
        F.when(_is(member("data"), "["), _elements(member("data"))).alias("rows"),
    )
    parts = durable(parts.withColumn("named", _is(F.get("rows", F.lit(0)), "{")))
    opened = F.transform(
        F.filter("rows", lambda x: ~F.col("named") | _is(x, "{")),
        lambda x: F.struct(
            F.when(F.col("named"), F.map_from_entries(F.transform(_members(x), lambda m: F.struct(m["key"], _unmarked(m["raw"]))))).alias("by_name"),
            F.when(_is(x, "["), F.transform(_elements(x), _unmarked)).when(~F.col("named"), F.array(_unmarked(x))).alias("by_place"),
        ),
    )
    parts = parts.withColumn("rows", opened)
    found = F.array_distinct(F.flatten(F.transform("rows", lambda x: F.map_keys(x["by_name"]))))
    widest = F.coalesce(F.array_max(F.transform("rows", lambda x: F.size(x["by_place"]))), F.lit(0))
    numbered = F.when(widest > 0, F.transform(F.sequence(F.lit(1), F.greatest(widest, F.lit(1))), lambda i: F.concat(F.lit("col"), i.cast("string")))).otherwise(
        F.array().cast("array<string>")
    )
    columns = F.when(F.size("header") > 0, F.col("header")).when(F.col("named"), found).otherwise(numbered)
    shown_title = _unmarked(F.col("_title"))
    told = F.when(_is(F.col("_title"), "s"), F.when(shown_title != "", shown_title)).when(~shown_title.isin("false", "[]", "{}"), shown_title)
    wide = lambda cells: F.slice(F.concat(cells, F.array_repeat(F.lit(""), F.size("columns"))), F.lit(1), F.size("columns"))
    shown = parts.withColumn("columns", columns).select(
        *keys, "record", F.coalesce(told, F.format_string("table_%d", "record")).alias("title"), "columns",
        F.when(F.size("_units") > 0, wide(F.col("_units"))).alias("units"), F.posexplode("rows").alias("_i", "_row"),
    )
    by_name = F.transform("columns", lambda c: F.when(F.map_contains_key(F.col("_row.by_name"), c), F.element_at(F.col("_row.by_name"), c)).otherwise(F.lit("")))
    cells = F.when(F.col("_row.by_name").isNotNull(), by_name).otherwise(wide(F.col("_row.by_place")))
    return shown.select(*keys, F.col("record").cast("int").alias("record"), "title", "columns", "units", (F.col("_i") + 1).cast("bigint").alias("row_no"), cells.alias("cells"))


# --- which files are outputs -------------------------------------------------------

# Folders that are never searched.
SKIPPED_FOLDERS = (".git", "node_modules", "notebooks", ".venv", "venv", "__pycache__")


def output_files(inventory: DataFrame, catalog, listed: DataFrame) -> DataFrame:
    """Files that are outputs: an output table of the catalog, or no known input and ``.csv .out .txt``.

    ``listed`` has the files the dataset's master list names (``dataset_id, file_name``).
    """
    def spellings(output: bool) -> list[str]:
        names = {t.file_name.lower() for t in catalog.tables if t.model.startswith("output.") == output}
        return sorted({v for n in names for v in (n, n.replace("-", "_"), n.replace("_", "-"))})

    variants = text.name_variants(F.col("file_name"))
    is_one_of = lambda names: F.exists(variants, lambda v: v.isin(names)) if names else F.lit(False)
    named = listed.select(
        "dataset_id", F.explode(text.name_variants(F.col("file_name"))).alias("_variant"), F.lit(True).alias("_listed")
    ).distinct()
    folder = F.concat(F.lit("/"), F.lower(text.dir_name(F.concat(F.lit("/"), F.col("rel_path")))), F.lit("/"))
    searched = ~F.exists(F.split(folder, "/"), lambda part: part.isin(list(SKIPPED_FOLDERS)))
    marked = (
        inventory.filter(searched)
        .withColumn("_variant", F.explode(variants))
        .join(named, ["dataset_id", "_variant"], "left")
        .groupBy("dataset_id", "file_name", "rel_path", "path")
        .agg(F.max(F.coalesce("_listed", F.lit(False))).alias("_listed"))
    )
    plain = text.suffix(F.col("file_name")).isin(".csv", ".out", ".txt")
    known_input = is_one_of(spellings(False)) | F.col("_listed")
    return marked.filter(is_one_of(spellings(True)) | (~known_input & plain)).drop("_listed")
