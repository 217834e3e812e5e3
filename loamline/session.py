"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loamline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between the JVM and Python; Spark's own default, 64 MB, is several
#: hundred MB of Python objects in every worker.
BATCH_BYTES = "4m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of ``spark``, and keep their batches small unless the user has set their size."""
    if not spark.sparkContext.getConf().contains(_BATCH_SETTING) and spark.conf.get(_BATCH_SETTING) == "67108864b":
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    target = Path(tempfile.mkdtemp(prefix="loamline-")) / "loamline.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(_PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(_PACKAGE.parent).as_posix())
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one if the session runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            master = spark.sparkContext.master
            if not master.startswith("local"):
                raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loamline-shared-"))
            current = spark.sparkContext.getCheckpointDir()
        found = current
    return found if "://" in found or found.startswith("file:") else f"file://{os.path.abspath(found)}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet; Hadoop deletes it when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/loamline-{label}-{uuid.uuid4().hex}"
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    handle.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(handle)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost only their own task."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        handle = spark._jvm.org.apache.hadoop.fs.Path(name)
        handle.getFileSystem(spark._jsc.hadoopConfiguration()).delete(handle, True)
