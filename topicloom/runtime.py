"""Session settings, shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are tuned for. Only defaults: a session that already
#: exists keeps its own values.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_made: list[str] = []  # paths handed out by run_path
_forget: list[Callable[[], None]] = []  # what else refers to those paths


def session(master: str | None = None, app: str = "topicloom", **conf: str) -> SparkSession:
    """Get or create a session with the defaults above."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    made = builder.getOrCreate()
    ship(made)
    return made


_shipped: set[str] = set()  # applications whose workers have the package


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever the driver was started.

    Done once per application; Spark's own file server hands the archive out.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for file in sorted(files):
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.join(name, os.path.relpath(path, package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used in local mode only:
    on a cluster a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="topicloom-")
    context.setCheckpointDir(made)
    return made


def run_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def on_clean_up(forget: Callable[[], None]) -> None:
    """Have ``forget`` called when written tables are deleted."""
    _forget.append(forget)


def clean_up(spark: SparkSession) -> None:
    """Delete the tables and checkpoints this session wrote under the shared folder."""
    for forget in _forget:
        forget()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    made = df.checkpoint(eager=True)
    path = spark.sparkContext.getCheckpointDir()
    if path and path not in _made:
        _made.append(path)  # Spark's own sub-folder of this session
    return made


def open_fs(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a shared folder's URI."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back (columnar, prunable)."""
    path = run_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
