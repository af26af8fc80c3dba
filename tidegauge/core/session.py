"""Session and table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidegauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; cluster settings win where already set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a stored frame goes when nothing refers to it any more
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One driver table, pruned to the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python workers find it wherever the driver was started."""
    root = Path(__file__).resolve().parents[1]
    if spark.conf.get("spark.tidegauge.shipped", None):
        return
    folder = Path(tempfile.mkdtemp(prefix="tidegauge-"))
    archive = folder / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark.conf.set("spark.tidegauge.shipped", str(archive))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: the session's checkpoint folder.

    Where none is set, a local session uses a folder beside its warehouse; a cluster has no folder that is safe to assume.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(spark.conf.get("spark.sql.warehouse.dir").replace("file:", ""), "_checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files of one run; the file system drops it when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _hadoop(spark, path, lambda fs, p: fs.deleteOnExit(p))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path made by ``scratch_path`` as soon as nothing reads it any more."""
    _hadoop(spark, path, lambda fs, p: fs.delete(p, True))


def _hadoop(spark: SparkSession, path: str, act) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    act(fs, p)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor never re-runs the upstream plan."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """The frame written as Parquet in the shared folder and read back: cuts the lineage as a checkpoint does, and the size estimates of
    the plan, which joins multiply from round to round of a loop, start anew from the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_budget(spark: SparkSession, key: str, default: int) -> int:
    """A tunable row count read from the session, e.g. ``spark.tidegauge.scan.bucketRows``."""
    return int(spark.conf.get(key, str(default)))
