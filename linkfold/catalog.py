"""The catalog: what tables, columns, references, pointers and record layouts a corpus has.

A catalog is loaded from the schema and metadata JSON documents of a corpus (or built in code)
and is small: it grows with the number of table definitions, never with the data.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkfold.session import BROADCAST_BYTES

# Cells that stand for "no reference".
NULL_SENTINELS = ("null", "0", "")

# Header spellings per file and the column they mean.
HEADER_ALIASES = {
    "calibration.cal": {
        "name": "cal_parm",
        "chg_type": "chg_typ",
        "val": "chg_val",
        "lyr1": "soil_lyr1",
        "lyr2": "soil_lyr2",
        "year1": "yr1",
        "year2": "yr2",
    },
    "codes.sft": {
        "landscape_yn": "landscape",
        "hyd_yn": "hyd",
        "plnt_yn": "plnt",
        "sed_yn": "sed",
        "nut_yn": "nut",
        "ch_sed_yn": "ch_sed",
        "ch_nut_yn": "ch_nut",
        "res_yn": "res",
    },
    "plant.ini": {"pcom_name": "name", "plt_cnt": "plnt_cnt", "plt_name": "plnt_name"},
}

# Columns of the weather station table that name files, and their patterns.
FILE_POINTERS = {
    "weather-sta.cli": {
        "pcp": "*.pcp",
        "tmp": "*.tmp",
        "slr": "*.slr",
        "hmd": "*.hmd",
        "wnd": "*.wnd",
        "wnd_dir": "*.wnd",
        "atmo_dep": "*.atmo",
        "wgn": None,
    }
}

# Target table of a schedule operation, by operation type.
OPERATION_TARGETS = {
    "plnt": "plant_ini",
    "harv": "harv_ops",
    "hvkl": "plant_ini",
    "kill": "plant_ini",
    "till": "tillage_til",
    "irrm": "irr_ops",
    "irra": "irr_ops",
    "fert": "fertilizer_frt",
    "frta": "fertilizer_frt",
    "frtc": "fertilizer_frt",
    "pest": "pesticide_pes",
    "pstc": "pesticide_pes",
    "graz": "graze_ops",
}

# Target table of a decision action, by action type.
ACTION_TARGETS = {
    "harvest": "harv_ops",
    "harvest_kill": "harv_ops",
    "pest_apply": "chem_app_ops",
    "fertilize": "chem_app_ops",
}

# Weather data suffixes and the table file whose columns they use.
WEATHER_TABLES = {
    ".pcp": "weather-pcp.pcp",
    ".tem": "weather-tmp.tmp",
    ".tmp": "weather-tmp.tmp",
    ".slr": "weather-slr.slr",
    ".hmd": "weather-hmd.hmd",
    ".wnd": "weather-wnd.wnd",
}

INTEGER_TYPES = ("IntegerField", "PrimaryKeyField")
DOUBLE_TYPE = "DoubleField"
BOOLEAN_TYPE = "BooleanField"
AUTO_TYPE = "AutoField"

SPARK_TYPES = {
    "AutoField": "bigint",
    "PrimaryKeyField": "bigint",
    "IntegerField": "bigint",
    "DoubleField": "double",
    "DecimalField": "double",
    "BooleanField": "boolean",
}


@dataclass(frozen=True)
class Layout:
    """How many child lines follow a main line of a hierarchical file."""

    fixed: int = 0
    fields: tuple[str, ...] = ()
    multiplier: int = 1
    #: ``soils`` (integer then letters) or ``plants`` (integer second token) when no count is given.
    heuristic: str | None = None

    @property
    def counted(self) -> bool:
        return bool(self.fixed or self.fields or self.heuristic == "plants")


# Hierarchical files and where their child line counts come from.
LAYOUTS = {
    "soils.sol": Layout(heuristic="soils"),
    "plant.ini": Layout(fields=("plnt_cnt",), heuristic="plants"),
    "management.sch": Layout(fields=("numb_auto", "numb_ops")),
    "weather-wgn.cli": Layout(fixed=13),
    "atmo.cli": Layout(fields=("num_sta",), multiplier=5),
    "d_table.dtl": Layout(),
    "lum.dtl": Layout(),
}


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "CharField"
    nullable: bool = True
    key: bool = False


@dataclass(frozen=True)
class ForeignKey:
    column: str
    target_table: str
    target_column: str = "name"


@dataclass(frozen=True)
class Table:
    table_name: str
    file_name: str
    columns: tuple[Column, ...] = ()
    primary_keys: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    has_title: bool = True
    has_header: bool = True
    data_starts_after: int = 2
    model: str = ""
    #: The file physically holds its ``id`` column.
    keeps_id: bool = False

    @property
    def physical_columns(self) -> tuple[Column, ...]:
        """Columns expected in the text file; database ids are usually not written."""
        return tuple(c for c in self.columns if self.keeps_id or c.type != AUTO_TYPE)


@dataclass(frozen=True)
class Catalog:
    tables: tuple[Table, ...] = ()
    null_sentinels: tuple[str, ...] = NULL_SENTINELS
    #: file name -> column -> file pattern, or None for a plain name column
    pointers: Mapping[str, Mapping[str, str | None]] = field(default_factory=lambda: FILE_POINTERS)
    pointer_notes: Mapping[tuple[str, str], str] = field(default_factory=dict)
    layouts: Mapping[str, Layout] = field(default_factory=lambda: LAYOUTS)
    aliases: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: HEADER_ALIASES)
    table_files: Mapping[str, str] = field(default_factory=dict)
    purposes: Mapping[str, str] = field(default_factory=dict)
    categories: Mapping[str, str] = field(default_factory=dict)
    operation_targets: Mapping[str, str] = field(default_factory=lambda: OPERATION_TARGETS)
    action_targets: Mapping[str, str] = field(default_factory=lambda: ACTION_TARGETS)
    reference_column: str = "name"

    # --- loading -----------------------------------------------------------

    @classmethod
    def from_json(cls, schema: str | Mapping, metadata: str | Mapping | None = None) -> Catalog:
        """Catalog from the schema document (``{"tables": {...}}``) and the metadata document.

        Both may be paths or parsed objects.
        """
        schema, metadata = _document(schema), _document(metadata or {})
        file_meta = metadata.get("file_metadata", {})
        tables = tuple(
            _table(file_name, spec, file_meta.get(file_name, {}))
            for file_name, spec in schema.get("tables", {}).items()
        )
        pointers, notes = _pointers(metadata.get("file_pointer_columns", {}))
        layouts = dict(LAYOUTS)
        for name, spec in _named(metadata.get("hierarchical_files", {})):
            layouts[name] = _layout(spec.get("structure", {}), layouts.get(name))
        categories = {
            name: category
            for category, names in _plain(metadata.get("file_categories", {})).items()
            if isinstance(names, list)
            for name in names
        }
        behaviour = metadata.get("txtinout_fk_behavior", {})
        return cls(
            tables=tables,
            null_sentinels=tuple(metadata.get("null_sentinel_values", {}).get("global", NULL_SENTINELS)),
            pointers=pointers or FILE_POINTERS,
            pointer_notes=notes,
            layouts=layouts,
            table_files=_plain(metadata.get("table_name_to_file_name", {})),
            purposes=_plain(metadata.get("file_purposes", {})),
            categories=categories,
            reference_column=behaviour.get("default_target_column", "name"),
        )

    def with_foreign_keys(self, extra: Mapping[str, Iterable[ForeignKey]]) -> Catalog:
        """Add references per file; one already present for (column, target) wins."""
        merged = []
        for table in self.tables:
            known = {(fk.column, fk.target_table) for fk in table.foreign_keys}
            new = tuple(
                fk for fk in extra.get(table.file_name, ()) if (fk.column, fk.target_table) not in known
            )
            merged.append(replace(table, foreign_keys=table.foreign_keys + new))
        return replace(self, tables=tuple(merged))

    # --- lookups -----------------------------------------------------------

    def table(self, name: str) -> Table:
        for table in self.tables:
            if name in (table.table_name, table.file_name):
                return table
        raise KeyError(name)

    def file_of(self, table_name: str) -> str | None:
        for table in self.tables:
            if table.table_name == table_name:
                return table.file_name
        return self.table_files.get(table_name)

    def resolve_name(self, name: str) -> str | None:
        """Table name from a table name, a file name, or a file-like spelling of a table."""
        by_table = {t.table_name for t in self.tables}
        by_file = {t.file_name.lower(): t.table_name for t in self.tables}
        spelled = name.lower().replace(".", "_").replace("-", "_")
        if name in by_table:
            return name
        return by_file.get(name.lower()) or (spelled if spelled in by_table else None)

    def filter_mode(self, table_name: str, column: str) -> str:
        """``numeric`` or ``text`` filtering for a column."""
        table = self.table(table_name)
        if any(fk.column == column for fk in table.foreign_keys):
            return "text"
        kind = next((c.type for c in table.columns if c.name == column), "CharField").lower()
        textual = ("foreign", "char", "text", "string")
        return "text" if any(word in kind for word in textual) else "numeric"

    def hierarchical_files(self) -> list[str]:
        return sorted(self.layouts)

    # --- frames ------------------------------------------------------------

    def tables_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (
                t.table_name,
                t.file_name,
                t.has_title,
                t.has_header,
                t.data_starts_after,
                t.model,
                [c.name for c in t.columns],
                [c.name for c in t.physical_columns],
                [c.type for c in t.physical_columns],
                t.primary_keys[0] if t.primary_keys else None,
                order,
            )
            for order, t in enumerate(self.tables)
        ]
        return bounded(
            spark,
            rows,
            "table_name string, schema_file string, has_title boolean, has_header boolean,"
            " data_starts_after int, model string, all_columns array<string>,"
            " columns array<string>, column_types array<string>, pk_column string, table_order int",
        )

    def columns_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (t.table_name, t.file_name, i, c.name, c.type, c.nullable, c.key or c.name in t.primary_keys)
            for t in self.tables
            for i, c in enumerate(t.columns)
        ]
        return bounded(
            spark,
            rows,
            "table_name string, schema_file string, position int, column string, type string,"
            " nullable boolean, is_key boolean",
        )

    def foreign_keys_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (t.table_name, t.file_name, fk.column, fk.target_table, fk.target_column)
            for t in self.tables
            for fk in t.foreign_keys
        ]
        return bounded(
            spark,
            rows,
            "table_name string, schema_file string, column string, target_table string,"
            " target_column string",
        )

    def pointers_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (file, column, pattern is not None, pattern, self.pointer_notes.get((file, column)))
            for file, columns in self.pointers.items()
            for column, pattern in columns.items()
        ]
        return bounded(
            spark,
            rows,
            "pointer_file string, column string, has_pattern boolean, pattern string, note string",
        )


def bounded(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Frame of catalog entries, hinted for broadcast while their text is within the size bound."""
    frame = spark.createDataFrame(rows, schema)
    return F.broadcast(frame) if sum(len(repr(row)) for row in rows) <= BROADCAST_BYTES else frame


def _document(source: str | Mapping) -> Mapping:
    if isinstance(source, Mapping):
        return source
    with open(source, encoding="utf-8") as handle:
        return json.load(handle)


def _plain(mapping: Mapping) -> dict:
    return {k: v for k, v in mapping.items() if k != "description"}


def _named(mapping: Mapping) -> list[tuple[str, Mapping]]:
    return [(k, v) for k, v in _plain(mapping).items() if isinstance(v, Mapping)]


def _clean(name: str) -> str:
    """Column name without the zero-width characters some documents carry."""
    return "".join(ch for ch in name if ch not in "\u200b\u200c\u200d\ufeff").strip()


def _table(file_name: str, spec: Mapping, meta: Mapping) -> Table:
    columns = tuple(
        Column(
            _clean(c["name"]),
            c.get("type", "CharField"),
            bool(c.get("nullable", True)),
            bool(c.get("is_primary_key", False)),
        )
        for c in spec.get("columns", [])
    )
    references = tuple(
        ForeignKey(_clean(fk["column"]), fk["references"]["table"], fk["references"].get("column", "name"))
        for fk in spec.get("foreign_keys", [])
        if fk.get("column")
    )
    return Table(
        table_name=spec["table_name"],
        file_name=file_name,
        columns=columns,
        primary_keys=tuple(_clean(k) for k in spec.get("primary_keys") or ()),
        foreign_keys=references,
        has_title=bool(spec.get("has_metadata_line", True)),
        has_header=bool(spec.get("has_header_line", True)),
        data_starts_after=int(spec.get("data_starts_after", 0)),
        model=spec.get("model_class") or "",
        keeps_id="id" in (meta.get("primary_keys") or ()),
    )


def _layout(structure: Mapping, known: Layout | None) -> Layout:
    fields = structure.get("child_line_count_field")
    return Layout(
        fixed=int(structure.get("child_line_count_fixed") or 0),
        fields=tuple(f.strip() for f in fields.split("+")) if fields else (),
        multiplier=int(structure.get("child_line_count_multiplier") or 1),
        heuristic=known.heuristic if known else None,
    )


def _pointers(config: Mapping) -> tuple[dict, dict]:
    pointers: dict[str, dict[str, str | None]] = {}
    notes: dict[tuple[str, str], str] = {}
    for file, columns in _named(config):
        for raw, spec in _plain(columns).items():
            column = _clean(raw)
            detailed = isinstance(spec, Mapping)
            pointers.setdefault(file, {})[column] = spec.get("file_pattern") if detailed else None
            note = spec.get("description") if detailed else spec
            if note:
                notes[(file, column)] = note
    return pointers, notes
