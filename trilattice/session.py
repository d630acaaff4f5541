"""Session defaults and shared scratch tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trilattice")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers of the session, wherever they run, once per context.

    Spark's own file service carries it, as it does the py-files of a submitted job.
    """
    context = spark.sparkContext
    if getattr(context, "_trilattice_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="trilattice-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = Path(folder) / "trilattice_code.zip"
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(made))
    context._trilattice_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent (tests, single machine) a folder of this machine is taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="trilattice-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under :func:`scratch_dir`."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs one reread, never a recomputation of what led here.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trilattice_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame made by :func:`stored` that nothing reads any more."""
    path = getattr(df, "_trilattice_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
