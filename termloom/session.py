"""What an operator asks of the session: table paths, shared folders, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Hands this package's source to the session's Python workers, which may not have it on their path. Once a session."""
    package, app = Path(__file__).parent, spark.sparkContext.applicationId
    if app in _shipped or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="termloom-code-")) / "termloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))  # the driver serves it to all executors, also to those that join later
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: spark.checkpoint.dir where it is set.

    Only a local session may fall back on a temporary folder; on a cluster its absence is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="termloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; it outlives lost executors."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read back: smaller on disk than a checkpoint, and columns
    that a reader does not want are not read. It stays until the folder is cleared, as a checkpoint does that is still in use."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/termloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; counts no further than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast if it was counted to have at most max_rows rows, else unmarked, for a shuffled join."""
    return F.broadcast(df) if fits(df, max_rows) else df
