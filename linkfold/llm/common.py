"""Helpers shared by the operators: cut lineage, shared folder, Arrow text buffers."""

from __future__ import annotations

import gc
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from linkfold.session import ship

#: Used only where a session names no shared folder, as in tests.
DEFAULT_FOLDER = "/tmp/linkfold-shared"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a default of its own only in local mode where that is unset."""
    settings = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or settings.get("spark.checkpoint.dir")
    if not found and not settings.get("spark.master", "local").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or DEFAULT_FOLDER).rstrip("/")


def written(df: DataFrame, label: str = "llm") -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[id(out)] = (weakref.ref(out), path)
    return out


#: Where frames of ``written`` lie, as long as they are in use.
_PLACES: dict[int, tuple[weakref.ref, str]] = {}


#: Bitmaps of 32768 bits that ``marked_only`` sends to the tasks, however many rows there are.
MARKS = 1024


def marked_only(rows: DataFrame, keys: list[str], wanted: DataFrame, names: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose keys may be among the ``names`` of ``wanted``: all that are and a share of the others; or the rest, by ``left_anti``.

    A bit for each hash goes to the tasks, 4 MB in all, so that wide rows with nothing to meet are not shuffled.
    """
    place = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(MARKS << 15))
    own = wanted.select(place(names).alias("_at"))
    bits = own.groupBy(F.shiftright("_at", 15).alias("_map")).agg(F.bitmap_construct_agg(F.col("_at").bitwiseAND(F.lit(32767))).alias("_bits"))
    at = place(keys)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(at.bitwiseAND(F.lit(32767)), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    met = F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1
    return rows.join(F.broadcast(bits), (F.shiftright(at, 15) == F.col("_map")) & met, how)


def discard(*frames: DataFrame) -> None:
    """Delete the tables of frames of ``written`` that nothing will read again: what was made from them is written itself.

    The driver's collector then lets Spark remove the shuffle files of plans that are gone too.
    """
    for frame in frames:
        known, path = _PLACES.pop(id(frame), (None, ""))
        if known is not None and known() is frame:
            spark = frame.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    gc.collect()
    spark = frames[0].sparkSession if frames else SparkSession.getActiveSession()
    if spark:
        spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % F.lit(parts)


def extended(schema: StructType, **kinds: str) -> StructType:
    """A schema of its own with more columns at the end."""
    return StructType(schema.fields + [StructField(k, DataType.fromDDL(v)) for k, v in kinds.items()])


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` bytes together, one row at least."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        out.append((at, to))
        at = to
    return out
