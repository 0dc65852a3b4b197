"""Session helpers: the shared work folder, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers: where it is on neither PYTHONPATH nor in the working folder, it is sent along, once per application."""
    sc, root = spark.sparkContext, str(PACKAGE.parent)
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if sc.applicationId in _SHIPPED or any(x and os.path.realpath(x) == os.path.realpath(root) for x in found):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="karst-"), "karst.zip")  # the driver's; it serves the file to the executors
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` or ``karst.work.dir``; one of our own only where the session names none and runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("karst.work.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = f"file://{tempfile.mkdtemp(prefix='karst-')}"
        spark.conf.set("karst.work.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/karst/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, in folders of the values of ``by`` if named: survives lost executors and is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files_of(df: DataFrame) -> list[str]:
    """The files of a table from ``written``, for tasks that read them themselves: what many tasks need is then no copy for each in the shuffle."""
    return sorted(df.inputFiles())


def batches_of(files: list[str], columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows of ``files_of`` a table, in a task; the shared folder is one that pyarrow can open (file, hdfs, s3, gs, abfs)."""
    from pyarrow import fs, parquet

    for f in files:
        where, path = fs.FileSystem.from_uri("s3" + f[3:] if f.startswith("s3a:") else f)
        with where.open_input_file(path) as opened:
            yield from parquet.ParquetFile(opened).iter_batches(rows, columns=columns)


def drop_read(df: DataFrame) -> None:
    """Deletes the tables from ``written`` that ``df`` reads, and lets Spark remove the shuffle files of what is over: for tables that nothing reads again."""
    sc = df.sparkSession.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    own = jvm.org.apache.hadoop.fs.Path(f"{work_dir(df.sparkSession)}/karst")
    fs = own.getFileSystem(conf)
    root = fs.makeQualified(own).toString() + "/"
    files = [fs.makeQualified(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(f))).toString() for f in df.inputFiles()]
    for table in {f[len(root) :].split("/")[0] for f in files if f.startswith(root)}:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root + table), True)
    gc.collect()
    jvm.System.gc()


def drop_work(spark: SparkSession) -> None:
    """Deletes what ``written`` and the operators left in the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/karst")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
