"""Tables written between steps, in the folder that driver and executors share.

A written table cuts lineage and survives lost executors. The folder is the session's
``spark.checkpoint.dir``. Only a local-mode session without that setting (tests) gets a
temporary folder of its own; on a cluster its absence is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written tables."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="pagewright-")
    return _LOCAL["dir"]


def fresh(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/pagewright/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Meanwhile Python workers take ``ROWS`` rows at a time at most, as rows hold whole texts.
    A collection on the driver afterwards lets Spark's cleaner delete the step's shuffle files,
    which it does once the finished plan is garbage.
    """
    spark = df.sparkSession
    path = fresh(spark, tag)
    rows = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(rows), ROWS) if int(rows) > 0 else ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of ``written`` that no later step reads."""
    jvm = spark.sparkContext._jvm
    root = shared_dir(spark) + "/pagewright/"
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        if root.split(":", 1)[-1].lstrip("/") in name:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
