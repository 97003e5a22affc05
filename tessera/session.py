"""Session helpers: settings for local use, and the folder that all executors share."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "tessera", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for one machine. On a cluster the caller brings its own session."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with this package sent to its executors once, so that they need no installation of it.

    The archive lies in the shared folder as long as the driver lives, for executors that start later.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root, packed = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        path = new_path(spark)
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{root.name}.zip")
        out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(packed.getvalue()))
        out.close()
        context.addPyFile(f"{path}/{root.name}.zip")
        _SHIPPED.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder named by the session; a temporary one only where none is named (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"tessera-checkpoint-{os.getpid()}")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read again: for results that several later plans use.

    Plans may read the table as long as the driver lives; it is removed when the driver ends.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def new_path(spark: SparkSession) -> str:
    """A new place in the shared folder, which is removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(remove_written)
    _WRITTEN.append(path)
    return path


def remove_written() -> None:
    """Remove what this driver has put into the shared folder; a driver calls it when it has used all its results."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while _WRITTEN:
            path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # the JVM may be gone; the folder is the cluster's temporary one
        return
