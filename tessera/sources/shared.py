"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of the tables that this process has stored, and what remembers tables that are read from there.
WRITTEN: list[str] = []
FORGOTTEN: list[dict] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset a session of one machine gets a
    temporary one; on a cluster that is an error, since executors wouldn't see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for several tables, which ``clear`` removes."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below spark.checkpoint.dir and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Remove what this process has stored, once nothing is read from it any more; how many tables that were."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for memory in FORGOTTEN:
        memory.clear()
    while WRITTEN:
        at = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n
