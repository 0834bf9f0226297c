"""Saved snapshots, exports and text writers."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linkfold.functions import text
from linkfold.functions.ordinals import with_global_ordinal
from linkfold.session import durable

FORMAT_VERSION = 2


class SnapshotVersionError(ValueError):
    """The snapshot was written in another format version."""


def save_index(frames: dict[str, DataFrame], path: str) -> None:
    """Write the frames of an index, split by dataset; rewriting replaces only the datasets written.

    References are laid out by target so that reverse lookups read few row groups.
    """
    for name, frame in frames.items():
        out = frame.withColumn("format_version", F.lit(FORMAT_VERSION))
        if {"actual_target_table", "fk_lc"} <= set(frame.columns):
            # Ranges are sampled first, which would compute the frame a second time.
            out = durable(out).repartitionByRange("dataset_id", "actual_target_table", "fk_lc").sortWithinPartitions(
                "dataset_id", "actual_target_table", "fk_lc"
            )
        (
            out.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("dataset_id")
            .parquet(f"{path}/{name}")
        )


def load_index(spark: SparkSession, path: str, names: Sequence[str] = ("rows", "refs")) -> dict[str, DataFrame]:
    """Frames of a snapshot. Raises when a snapshot of another version, or of none, is found."""
    out = {}
    for name in names:
        frame = spark.read.option("mergeSchema", "false").parquet(f"{path}/{name}")
        if not is_current(frame):
            raise SnapshotVersionError(f"{path}/{name} is not in format version {FORMAT_VERSION}")
        out[name] = frame.drop("format_version").withColumn("dataset_id", F.col("dataset_id").cast("string"))
    return out


def is_current(frame: DataFrame) -> bool:
    """True unless a row of another format version is present; reads one narrow column."""
    if "format_version" not in frame.columns:
        return False
    other = F.col("format_version").isNull() | (F.col("format_version") != FORMAT_VERSION)
    return frame.filter(other).limit(1).isEmpty()


def export_index(rows: DataFrame, refs: DataFrame, stats: DataFrame, path: str) -> None:
    """JSON lines of rows, references and counts in three folders."""
    rows.drop("tokens").write.mode("overwrite").partitionBy("dataset_id", "table_name").json(f"{path}/tables")
    refs.write.mode("overwrite").partitionBy("dataset_id").json(f"{path}/references")
    stats.write.mode("overwrite").json(f"{path}/stats")


# --- snapshots of a whole index ---------------------------------------------------------

#: Tables of a snapshot: the columns its buckets are made of, and what its rows are sorted by inside a bucket.
LAYOUT = {
    "rows": (("dataset_id", "table_name", "pk_lc"), ("line_no",)),
    "resolved": (("dataset_id", "actual_target_table", "fk_lc"), ("source_table", "source_line")),
    "children": (("dataset_id", "file_name"), ("line_no",)),
    "refs": (("dataset_id", "source_file"), ("source_line",)),
    "entries": (("dataset_id",), ("row_id",)),
    "bound": (("dataset_id",), ("file_name",)),
    "inventory": (("dataset_id",), ("path",)),
}
#: Rows of a bucket, on average.
BUCKET_ROWS = 1_000_000


@dataclass
class Snapshot:
    """A saved index: its tables by name, and lookups that open one bucket and shuffle nothing."""

    tables: dict[str, DataFrame]
    buckets: dict[str, int]

    def _of(self, name: str, *key: str) -> DataFrame:
        columns, _ = LAYOUT[name]
        bucket = _bucket([F.lit(k) for k in key], self.buckets[name])
        found = self.tables[name].filter(F.col("_bucket") == bucket)
        return found.filter(functools.reduce(lambda a, b: a & b, [F.col(c) == k for c, k in zip(columns, key)])).drop("_bucket")

    def row(self, dataset_id: str, table_name: str, key: str) -> DataFrame:
        """Rows of a key, in any case; the last one is the one that references mean."""
        return self._of("rows", dataset_id, table_name, key.lower())

    def references_to(self, dataset_id: str, table_name: str, key: str) -> DataFrame:
        """References that resolved to a key."""
        return self._of("resolved", dataset_id, table_name, key.lower()).filter("resolved")


def _bucket(key: Sequence[Column], many: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(many)).cast("int")


def save_snapshot(frames: Mapping[str, DataFrame], path: str) -> None:
    """Write the tables of an index (``LAYOUT``) below ``path``, and last the manifest, which is the commit.

    Each save writes a folder of its own. A reader takes the newest manifest, so a save that broke off is never
    seen, and readers of the one before are not disturbed. Rows are cut into buckets by the hash of their key and
    sorted inside; a key with very many rows is spread over several files of its bucket.
    """
    spark = next(iter(frames.values())).sparkSession
    folder = f"save-{uuid.uuid4().hex}"
    manifest = {"format_version": FORMAT_VERSION, "folder": folder, "tables": {}}
    for name, (key, order) in LAYOUT.items():
        frame = frames[name]
        n = frame.count()
        many = max(1, -(-n // BUCKET_ROWS))
        own = frame.withColumn("_bucket", _bucket([F.col(c).cast("string") for c in key], many))
        ranged = own.repartitionByRange("_bucket", *key, *order).sortWithinPartitions("_bucket", *key, *order)
        ranged.write.partitionBy("_bucket").parquet(f"{path}/{folder}/{name}")
        manifest["tables"][name] = {"rows": n, "buckets": many, "schema": json.loads(frame.schema.json())}
    number = max(_manifests(spark, path), default=(0, ""))[0] + 1
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifests/{number:09d}")


def _manifests(spark: SparkSession, path: str) -> Iterator[tuple[int, str]]:
    """Numbers and texts of the finished manifests; a save that broke off left none."""
    try:
        found = spark.read.option("recursiveFileLookup", "true").text(f"{path}/manifests").select(F.col("_metadata.file_path").alias("file"), "value").collect()  # one short row a save
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER" in str(error):
            return
        raise
    for r in found:
        yield int(r["file"].rstrip("/").split("/")[-2]), r["value"]


def load_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The newest finished snapshot. Raises for none, another version, or tables that lack rows."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    _, newest = max(_manifests(spark, path), default=(0, None))
    if newest is None:
        raise SnapshotVersionError(f"{path} holds no finished snapshot")
    manifest = json.loads(newest)
    if manifest.get("format_version") != FORMAT_VERSION:
        raise SnapshotVersionError(f"{path} is not in format version {FORMAT_VERSION}")
    tables, buckets = {}, {}
    for name, told in manifest["tables"].items():
        schema = StructType(StructType.fromJson(told["schema"]).fields + [StructField("_bucket", IntegerType())])
        if told["rows"]:
            tables[name] = spark.read.schema(schema).parquet(f"{path}/{manifest['folder']}/{name}")
            found = tables[name].count()  # from the footers
            if found != told["rows"]:
                raise SnapshotVersionError(f"{path}: {name} has {found} rows of {told['rows']}")
        else:
            tables[name] = spark.createDataFrame([], schema)
        buckets[name] = told["buckets"]
    return Snapshot(tables, buckets)


# --- output tables ------------------------------------------------------------------------


def csv_line(cells: Column) -> Column:
    """Cells as a CSV line: quoted where they hold a comma, a quote, a line end or outer blanks; quotes are doubled."""
    quoted = F.transform(
        F.transform(cells, lambda c: F.coalesce(c, F.lit(""))),
        lambda c: F.when(c.rlike(r'[,"\r\n]|^\s|\s$'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c),
    )
    return F.array_join(quoted, ",")


def write_record_sets(rows: DataFrame, path: str) -> None:
    """All record sets of ``read_output_json`` as CSV below ``path/set=<number>_<title>`` in one write.

    Sets are numbered in the order of their titles. Rows are sorted by set and row over ranges, so a large set
    becomes several files; each begins with the set's own header. Sets with units have them as a first row, and a
    first column that tells units from data. Neither titles nor rows come to the driver.
    """
    titles = rows.groupBy("title", "columns").agg(F.max("units").alias("units"))
    numbered = with_global_ordinal(titles, [F.col("title"), F.col("columns")], "_n")
    clean = text.safe_title(F.col("title"), F.concat(F.lit("table_"), (F.col("_n") + 1).cast("string")))
    name = F.concat(F.lpad((F.col("_n") + 1).cast("string"), F.greatest(F.length((F.col("_n") + 1).cast("string")), F.lit(2)), "0"), F.lit("_"), clean)
    marked = lambda word, cells: F.when(F.col("units").isNotNull(), F.concat(F.array(F.lit(word)), cells)).otherwise(cells)
    sets = numbered.select("title", "columns", "units", name.alias("set"), csv_line(marked("__row_type", F.col("columns"))).alias("header"))
    units = sets.filter("units is not null").select("set", "header", F.lit(0).cast("bigint").alias("row_no"), csv_line(marked("units", F.col("units"))).alias("value"))
    known = rows.drop("units").join(sets, ["title", "columns"])
    data = known.select("set", "header", "row_no", csv_line(marked("data", F.col("cells"))).alias("value"))
    ranged = units.unionByName(data).repartitionByRange("set", "row_no").sortWithinPartitions("set", "row_no")

    def with_headers(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("set")
            new = [0] if own[0].as_py() != last else []
            if batch.num_rows > 1:
                new += (pc.indices_nonzero(pc.not_equal(own.slice(1), own.slice(0, batch.num_rows - 1))).to_numpy() + 1).tolist()
            last, at = own[batch.num_rows - 1].as_py(), 0
            lines = batch.select(["set", "value"])
            for k in new:
                yield lines.slice(at, k - at)
                yield pa.RecordBatch.from_arrays([own.slice(k, 1), batch.column("header").slice(k, 1)], names=["set", "value"])
                at = k
            yield lines.slice(at)

    ranged.mapInArrow(with_headers, "set string, value string").write.partitionBy("set").text(path)


def output_export(rows: DataFrame, layouts: DataFrame, title: str, columns: Sequence[str]) -> DataFrame:
    """Rows of one record set, with its units as a first row where it has any.

    ``rows`` has ``row_no`` and ``cells``; ``layouts`` has ``title`` and ``units``.
    """
    cells = [F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)]
    data = rows.filter(F.col("title") == title).select(F.lit("data").alias("__row_type"), "row_no", *cells)
    units = (
        layouts.filter((F.col("title") == title) & F.col("units").isNotNull())
        .select(F.lit("units").alias("__row_type"), F.lit(0).cast("bigint").alias("row_no"), F.col("units").alias("cells"))
        .distinct()
        .select("__row_type", "row_no", *cells)
    )
    return units.unionByName(data)


def write_output_tables(rows: DataFrame, layouts: DataFrame, path: str, fmt: str = "csv") -> list[str]:
    """One folder per record set below ``path``, named by its cleaned title.

    Only the titles and column lists, one row per record set, come to the driver.
    """
    fallback = F.concat(F.lit("table_"), F.col("_n").cast("string"))
    sets = (
        layouts.select("title", "columns").distinct().orderBy("title").withColumn("_n", F.monotonically_increasing_id() + 1)
        .withColumn("_name", text.safe_title(F.col("title"), fallback))
        .collect()
    )
    written = []
    for i, item in enumerate(sets, start=1):
        target = f"{path}/{i:02d}_{item['_name']}"
        out = output_export(rows, layouts, item["title"], item["columns"])
        has_units = not out.filter("__row_type = 'units'").limit(1).isEmpty()
        out = out.repartitionByRange("row_no").sortWithinPartitions("row_no").drop("row_no")
        out = out if has_units else out.drop("__row_type")
        writer = out.write.mode("overwrite")
        writer.option("header", "true").csv(target) if fmt == "csv" else writer.parquet(target)
        written.append(target)
    return written


def write_subset(lines: DataFrame, path: str) -> None:
    """Text files from ``dataset_id, file_name, line_no, raw``.

    Rows are ranged by file and line, so a big file becomes several part files whose names sort in
    line order, and never has to fit one task.
    """
    (
        lines.repartitionByRange("dataset_id", "file_name", "line_no")
        .sortWithinPartitions("dataset_id", "file_name", "line_no")
        .select("dataset_id", "file_name", F.col("raw").alias("value"))
        .write.mode("overwrite")
        .partitionBy("dataset_id", "file_name")
        .text(path)
    )


# Endings and the beginning of the names of files that a subset does not copy.
NOT_COPIED_ENDINGS = (".txt", ".csv", ".out", ".fin", ".sqlite", ".db", ".log", ".pid")
NOT_COPIED_BEGINNING = "fort."


def not_copied(file_name: Column) -> Column:
    """Whether a subset leaves a file out, by its name in any case."""
    name = F.lower(file_name)
    return functools.reduce(lambda a, b: a | b, [F.endswith(name, F.lit(e)) for e in NOT_COPIED_ENDINGS], F.startswith(name, F.lit(NOT_COPIED_BEGINNING)))


def copy_filter(inventory: DataFrame) -> DataFrame:
    """Files a subset takes over."""
    return inventory.filter(~not_copied(F.col("file_name")))
