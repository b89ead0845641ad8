"""Session helpers: table loading, time zone and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def prepare(spark: SparkSession) -> SparkSession:
    """All naive source times are read as UTC, so the session must agree."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one Parquet table; zone-less timestamps become UTC instants."""
    df = prepare(spark).read.parquet(f"{folder}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


_local_folder: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; the cluster names it in spark.checkpoint.dir.

    Only a local session without the setting, as in tests, gets a temporary folder.
    """
    global _local_folder
    name = "spark.checkpoint.dir"
    folder = spark.sparkContext.getConf().get(name) or spark.conf.get(name, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {name} to a folder that all executors share")
        _local_folder = folder = _local_folder or tempfile.mkdtemp(prefix="slopecast-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the application's folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete every table that this application settled; call it when no result is read any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a table that several later steps read to the shared folder, and read it from there.

    Cuts the lineage, survives lost executors, and tells the planner the real size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()
_shipping = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    with _shipping:  # fits run side by side, and Spark refuses a second file of the name
        if context.applicationId in _shipped:
            return
        root = Path(__file__).resolve().parent
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="slopecast-")), "slopecast_package.zip")
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, str(file.relative_to(root.parent)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
