"""Written tables: how iterations cut their lineage so that lost executors cost no recomputation from the start."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once per Spark application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="lexiweave-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(archive := f"{folder}/lexiweave.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where it is unset, a temporary folder of this machine, and only if Spark runs within it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master or ""
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lexiweave-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def _path(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def stamp(spark: SparkSession, path: str) -> tuple:
    """Length and time of change of a file, or of the files in a folder: two equal stamps mean the same content."""
    p, fs = _path(spark, path)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(p)))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/lexiweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete everything that this application has written into the shared folder; results that still read from there are lost."""
    delete(spark, f"{root(spark)}/lexiweave/{spark.sparkContext.applicationId}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_path = path
    return found


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    delete(df.sparkSession, df.written_path)
