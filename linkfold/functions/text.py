"""String expressions: tokens, numbers, paths and names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

#: Decimal literal accepted as a number; hexadecimal and type suffixes are not.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"

# Fixed value: literals a boolean cell may hold.
BOOLEAN_LITERALS = ("0", "1", "y", "n", "yes", "no", "true", "false")


def tokens(line: Column) -> Column:
    """Whitespace-separated tokens; a blank line has none."""
    # Only leading or trailing blanks make empty pieces.
    return F.array_remove(F.split(line, r"\s+"), "")


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"\S")


def cell(cells: Column, index: int | Column) -> Column:
    """Cell at a 0-based index, empty when the row is too short."""
    return F.coalesce(F.get(cells, index if isinstance(index, Column) else F.lit(index)), F.lit(""))


def number(value: Column, thousands: bool = False) -> Column:
    """Finite double, else null. ``thousands`` drops commas first."""
    text = F.trim(value)
    if thousands:
        text = F.replace(text, F.lit(","), F.lit(""))
    # No match extracts an empty text, which is no double either.
    parsed = F.regexp_extract(text, NUMBER, 0).try_cast("double")
    return F.when(F.abs(parsed) < F.lit(float("inf")), parsed)


def integer(value: Column) -> Column:
    """Whole number written in digits only, else null."""
    return F.regexp_extract(value, INTEGER, 0).try_cast("bigint")


def is_whole(value: Column) -> Column:
    """True for finite values without a fraction, ``1e2`` and ``5.0`` included."""
    parsed = number(value)
    return F.coalesce(parsed == F.floor(parsed), F.lit(False))


def is_sentinel(value: Column, sentinels: Iterable[str]) -> Column:
    return F.lower(value).isin([s.lower() for s in sentinels])


def is_boolean_literal(value: Column, sentinels: Iterable[str]) -> Column:
    return F.lower(value).isin(sorted(set(BOOLEAN_LITERALS) | {s.lower() for s in sentinels}))


def lookup(value: Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Plan-time map lookup."""
    if not mapping:
        return default if default is not None else F.lit(None).cast("string")
    literal = F.create_map(*[F.lit(item) for pair in mapping.items() for item in pair])
    found = F.try_element_at(literal, value)
    return F.coalesce(found, default) if default is not None else found


def natural_key(value: Column) -> Column:
    """Case-insensitive sort key in which digit runs compare by their numeric size."""

    def piece(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=[0-9])", "")
        sized = F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)
        return F.when(part.rlike("^[0-9]"), sized).otherwise(part)

    parts = F.regexp_extract_all(F.lower(value), F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, piece), "")


# --- paths -----------------------------------------------------------------


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def comparable_path(path: Column) -> Column:
    """Forward slashes; drive-letter paths also fold case."""
    unified = slashes(path)
    return F.when(unified.rlike("^[A-Za-z]:/"), F.lower(unified)).otherwise(unified)


def path_starts_with(path: Column, prefix: Column) -> Column:
    full, head = comparable_path(path), F.regexp_replace(comparable_path(prefix), "/$", "")
    return (full == head) | F.startswith(full, F.concat(head, F.lit("/")))


def drive_to_mount(path: Column) -> Column:
    """``C:\\a\\b`` to ``/mnt/c/a/b``; other paths unchanged."""
    drive = F.lower(F.regexp_extract(path, r"^([A-Za-z]):[\\/]", 1))
    rest = slashes(F.regexp_extract(path, r"^[A-Za-z]:[\\/](.*)$", 1))
    joined = F.regexp_replace(F.concat(F.lit("/mnt/"), drive, F.lit("/"), rest), "/+", "/")
    return F.when(drive != "", F.regexp_replace(joined, "/$", "")).otherwise(path)


def mount_to_drive(path: Column) -> Column:
    """``/mnt/c/a/b`` to ``C:\\a\\b``; other paths unchanged."""
    drive = F.upper(F.regexp_extract(path, r"^/mnt/([a-z])(/.*)?$", 1))
    rest = F.replace(F.regexp_extract(path, r"^/mnt/[a-z]/(.*)$", 1), F.lit("/"), F.lit("\\"))
    return F.when(drive != "", F.concat(drive, F.lit(":\\"), rest)).otherwise(path)


def stored_path(path: Column) -> Column:
    """Path from a saved snapshot made usable on a POSIX host."""
    return F.when(path.rlike(r"^[A-Za-z]:[\\/]"), drive_to_mount(path)).otherwise(path)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(slashes(path), "/[^/]*$", "")


def suffix(name: Column) -> Column:
    """Last extension with its dot, lower case, empty if there is none."""
    return F.lower(F.regexp_extract(base_name(name), r"^.+(\.[^.]*)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(base_name(name), r"(?<=.)\.[^.]*$", "")


def table_of_file(name: Column) -> Column:
    """Table name derived from a file name."""
    return F.lower(F.translate(name, ".-", "__"))


def safe_title(title: Column, fallback: Column) -> Column:
    cleaned = F.regexp_replace(title, r"[^\p{L}\p{N}_-]", "_")
    cleaned = F.regexp_replace(cleaned, "^_+|_+$", "")
    return F.when(cleaned == "", fallback).otherwise(cleaned)


def name_variants(name: Column) -> Column:
    """Spellings of a file name that count as the same file."""
    low = F.lower(name)
    return F.array_distinct(
        F.array(low, F.replace(low, F.lit("-"), F.lit("_")), F.replace(low, F.lit("_"), F.lit("-")))
    )


def nullify_names(line: Column, names: Iterable[str]) -> Column:
    """Replace whole-word file names by ``null``, in any case."""
    escaped = sorted((n.replace(".", r"\.") for n in names), key=len, reverse=True)
    if not escaped:
        return line
    return F.regexp_replace(line, r"(?i)\b(?:" + "|".join(escaped) + r")\b", "null")


def token_spans(line: Column) -> Column:
    """Tokens with 0-based start and end columns: ``array<struct<token, col_start, col_end>>``."""
    parts = F.regexp_extract_all(line, F.lit(r"(\s*\S+)"), 1)

    def grow(acc: Column, part: Column) -> Column:
        offset = acc["offset"]
        token = F.regexp_replace(part, r"^\s+", "")
        end = offset + F.length(part)
        span = F.struct(
            token.alias("token"),
            (end - F.length(token)).alias("col_start"),
            end.alias("col_end"),
        )
        return F.struct(end.alias("offset"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    empty = F.struct(
        F.lit(0).alias("offset"),
        F.array().cast("array<struct<token:string,col_start:int,col_end:int>>").alias("spans"),
    )
    return F.aggregate(parts, empty, grow)["spans"]


# --- integer lists ---------------------------------------------------------


def signed_spans(cells: Column) -> Column:
    """``[4, 9, -12, 20]`` to ``[(4, 4), (9, 12), (20, 20)]`` as ``array<struct<first, last>>``.

    A negative closes the range opened before it; a range may run downwards. Non-integers are ignored. A negative
    value that follows a closed range stands for itself. Lists in which every negative follows a non-negative take
    one linear pass; only the others are folded value by value.
    """
    numbers = F.filter(F.transform(cells, integer), lambda v: v.isNotNull())

    def spans(values: Column) -> Column:
        loose = F.filter(values, lambda v, i: (v < 0) & ((i == 0) | (F.get(values, i - 1) < 0)))

        def span(value: Column, i: Column) -> Column:
            following = F.get(values, i + 1)
            return F.when(value >= 0, _span(value, F.when(following < 0, F.abs(following)).otherwise(value)))

        linear = F.filter(F.transform(values, span), lambda s: s.isNotNull())
        return F.when(F.size(loose) == 0, linear).otherwise(_folded_spans(values))

    return bind(numbers, spans)


def expand_signed_ranges(cells: Column) -> Column:
    """``[4, 9, -12, 20]`` to ``[4, 9, 10, 11, 12, 20]``, for short lists: see ``signed_spans`` for those of any length."""
    return F.flatten(F.transform(signed_spans(cells), lambda s: _sequence(s["first"], s["last"])))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sequence(first: Column, last: Column) -> Column:
    return F.sequence(first, last, F.when(first <= last, F.lit(1)).otherwise(F.lit(-1)))


def _span(first: Column, last: Column) -> Column:
    return F.struct(first.alias("first"), last.alias("last"))


def _folded_spans(values: Column) -> Column:
    state = "struct<out:array<struct<first:bigint,last:bigint>>,open:bigint>"
    empty = F.struct(F.array().alias("out"), F.lit(None).alias("open")).cast(state)

    def step(acc: Column, value: Column) -> Column:
        open_, out = acc["open"], acc["out"]
        closes = open_.isNotNull() & (value < 0)
        flushed = F.when(open_.isNull(), out).otherwise(F.concat(out, F.array(_span(open_, open_))))
        return F.struct(
            F.when(closes, F.concat(out, F.array(_span(open_, F.abs(value))))).otherwise(flushed).alias("out"),
            F.when(closes, F.lit(None).cast("bigint")).otherwise(value).alias("open"),
        ).cast(state)

    def finish(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(_span(acc["open"], acc["open"]))))

    return F.aggregate(values, empty, step, finish)
