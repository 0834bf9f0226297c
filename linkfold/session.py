"""Session settings, the shared folder, and lineage cutting."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Frames made on the driver are hinted for broadcast up to so many bytes of text.
BROADCAST_BYTES = 8 << 20

#: Where a session that names no shared folder keeps its intermediate tables.
DEFAULT_FOLDER = "/tmp/linkfold-shared"

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application, so they need no path of the driver's."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    target = Path(tempfile.mkdtemp(prefix="linkfold-ship-")) / "linkfold.zip"
    target.write_bytes(body.getvalue())
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "linkfold") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where that is unset, one fixed folder, but only in local mode: on a cluster every executor would write to a disk
    of its own, and tables read back would miss rows.
    """
    settings = spark.sparkContext.getConf()
    configured = spark.conf.get("spark.checkpoint.dir", None) or settings.get("spark.checkpoint.dir")
    if not configured and not settings.get("spark.master", "local").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured or DEFAULT_FOLDER


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage: write the frame to the shared folder and go on from there.

    The written table survives lost executors, is read column by column, and tells the optimizer
    its true size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Attached frames of more rows are never broadcast.
ATTACHED_ROWS = 20_000


def attached(df: DataFrame) -> DataFrame:
    """A per-file frame fixed once, to be joined to lines where they are.

    The written table tells the optimizer its bytes: below Spark's broadcast threshold the lines are not shuffled,
    above it they are, and skewed files are split at run time. Bytes on disk say little of rows that are much alike,
    such as the columns and borders of a million files, so a frame of many rows asks for a sort-merge join.
    """
    fixed = durable(df)
    return fixed.hint("merge") if fixed.count() > ATTACHED_ROWS else fixed
