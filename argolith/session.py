"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


#: Bytes of a batch that goes to Python, unless the session says otherwise: rows hold whole texts.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each context, and bounds batches where the session doesn't."""
    sc = spark.sparkContext
    if BATCH_BYTES[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH_BYTES)
    if not getattr(sc, "_argolith_shipped", False):
        path = Path(tempfile.mkdtemp(prefix="argolith-"), "argolith.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(_PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(_PACKAGE.parent))
        sc.addPyFile(str(path))
        sc._argolith_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, if all runs on this machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="argolith-"))
    return sc.getCheckpointDir()


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, fs = _path(spark, name)
    return fs.exists(path)


def materialise(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what follows has a short plan and survives lost executors. The table goes when the driver ends, if it is not discarded before."""
    spark = df.sparkSession
    name = f"{shared_folder(spark)}/argolith-{uuid.uuid4().hex}"
    df.write.parquet(name)
    path, fs = _path(spark, name)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(name)
    out._argolith_table = name
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `materialise` that nothing reads any more."""
    for df in tables:
        if name := getattr(df, "_argolith_table", None):
            path, fs = _path(df.sparkSession, name)
            fs.delete(path, True)
