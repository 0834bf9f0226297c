"""Text files as numbered lines, and the inventory of dataset folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from linkfold.functions import text
from linkfold.session import durable, scratch_path

def scan_lines(
    spark: SparkSession, path: str | list[str], whole_files: bool = False, name_glob: str | None = None
) -> DataFrame:
    """Every line of every file below ``path`` with its 1-based number: ``path, kind, line_no, raw``.

    The text is read once: one pass writes a line store in the shared folder, split by the files' kind, their
    lower-case suffix, so a reader that wants some kinds opens nothing else. ``name_glob`` limits the listing to
    matching file names, so other files are never opened.

    Files stay splittable. Inside a split the row id counts lines; the line counts of the splits before, taken from
    the store, give the offset, so no file passes through one task. ``whole_files`` reads each file in one
    piece instead, which is cheaper for many small files and must not be used for big ones.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    kind = text.suffix(text.base_name(F.col("path"))).alias("kind")
    if whole_files:
        pieces = reader.text(path, wholetext=True).select(
            text.slashes(F.col("_metadata.file_path")).alias("path"),
            # A trailing line end opens no further line.
            F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), "\r?\n")).alias("_i", "raw"),
        )
        return _stored(pieces.select(_clean_path("path"), (F.col("_i") + 1).cast("bigint").alias("line_no"), "raw").select("*", kind)).select(
            "path", "kind", "line_no", "raw"
        )
    lines = reader.text(path).select(
        F.col("value").alias("raw"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
    )
    store = _stored(lines.withColumn("path", _clean_path("_file")).select("path", "_split", "_id", "raw", kind))
    before = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = durable(
        store.groupBy("path", "_split")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select("path", "_split", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    )
    return store.join(splits, ["path", "_split"]).select("path", "kind", (F.col("_id") + F.col("_shift")).alias("line_no"), "raw")


def _stored(lines: DataFrame) -> DataFrame:
    """The lines written once, in a folder for each kind."""
    spark = lines.sparkSession
    path = scratch_path(spark, "lines")
    lines.write.partitionBy("kind").parquet(path)
    # An empty suffix is written as none.
    return spark.read.schema(lines.schema).parquet(path).withColumn("kind", F.coalesce("kind", F.lit("")))


def of_kinds(lines: DataFrame, *suffixes: str) -> DataFrame:
    """Lines of files with one of the suffixes: on a line store, only their folders are opened."""
    if "kind" in lines.columns:
        return lines.filter(F.col("kind").isin(list(suffixes)))
    return lines.filter(text.suffix(F.col("file_name")).isin(list(suffixes)))


def _clean_path(column: str):
    """Path without its scheme and with percent escapes undone."""
    return F.url_decode(F.replace(F.regexp_replace(column, "^file:/*", "/"), F.lit("+"), F.lit("%2B"))).alias("path")


def list_inventory(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files below dataset folders: ``dataset_id, file_name, file_name_lc, rel_path, path, length``.

    A dataset is a folder holding ``file.cio`` or ``File.cio``; a file belongs to the nearest such
    folder above it. Only the listing is read, never the contents.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(_clean_path("path"), "length")
        .withColumn("file_name", text.base_name(F.col("path")))
        .withColumn("dir", text.dir_name(F.col("path")))
    )
    roots = files.filter(F.col("file_name").isin("file.cio", "File.cio")).select(F.col("dir").alias("root")).distinct()
    parts = F.split("dir", "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    owned = (
        files.withColumn("root", F.explode(ancestors))
        .join(roots, "root")
        .groupBy("path", "length", "file_name", "dir")
        .agg(F.max_by("root", F.length("root")).alias("dataset_id"))
    )
    return owned.select(
        "dataset_id",
        "file_name",
        F.lower("file_name").alias("file_name_lc"),
        F.expr("substring(path, length(dataset_id) + 2)").alias("rel_path"),
        "path",
        "length",
    )


def dataset_files(inventory: DataFrame) -> DataFrame:
    """Files that lie directly in their dataset folder."""
    return inventory.filter(F.col("rel_path") == F.col("file_name"))


def dataset_lines(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Lines with their dataset: ``dataset_id, file_name, line_no, raw``, and ``kind`` if they come from a line store."""
    owner = dataset_files(inventory).select("path", "dataset_id", "file_name")
    kind = [c for c in ("kind",) if c in lines.columns]
    return lines.join(owner, "path").select("dataset_id", "file_name", "line_no", "raw", *kind)
