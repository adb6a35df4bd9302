"""Session helpers: tables, shipping this package to executors, the shared folder."""

from __future__ import annotations

import os
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per SparkContext (as a zip, so any cluster can import it)."""
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_shipped", False) or not _ROOT.is_dir():
        return
    target = os.path.join(sc._temp_dir, "plumbline.zip")  # Spark's own folder on the driver; executors fetch it from there
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, str(p.relative_to(_ROOT.parent)))
    sc.addPyFile(target)
    sc._plumbline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in its absence (tests, one machine) one beside the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return found or known.get()
    found = found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/plumbline-shared"
    spark.sparkContext.setCheckpointDir(found)
    return found


def write_out(rows: DataFrame) -> DataFrame:
    """The rows, written once as a table into the shared folder and read from there: what follows is not computed again, and a
    lost executor loses nothing. The table goes when the session's JVM ends."""
    spark = rows.sparkSession
    path = passing(spark, f"{shared_dir(spark).rstrip('/')}/plumbline-{uuid.uuid4().hex}")
    rows.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def passing(spark: SparkSession, path: str) -> str:
    """The path, whose folder is deleted when the session's JVM ends, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)  # which Hadoop does for what exists
    return path


def ship_file(spark: SparkSession, path: str) -> None:
    """Send a file of the driver, such as a vocabulary, to the executors once per SparkContext."""
    sc = spark.sparkContext
    sent = getattr(sc, "_plumbline_files", set())
    if path not in sent and os.path.isfile(path):
        sc.addFile(path)
        sc._plumbline_files = sent | {path}


def shipped_file(path: str) -> str:
    """Where a file that was shipped lies on this machine; the path itself if it was not."""
    try:
        here = SparkFiles.get(os.path.basename(path))
    except Exception:  # no Spark in this process
        return path
    return here if os.path.isfile(here) else path
