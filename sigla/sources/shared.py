"""Tables that cut lineage: written where driver and executors both see them, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one in a local session."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
    if not _OWN:
        own = tempfile.mkdtemp(prefix="sigla-tables-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN.append("file://" + own)
    return _OWN[0]


#: The Arrow batches that Python gets while a table is made, in bytes, where they shall be small.
SMALL = 2 << 20


def settled(df: DataFrame, small_batches: bool = False) -> DataFrame:
    """``df`` as a table; it goes when the application ends.

    With ``small_batches`` Python gets rows in Arrow batches of about ``SMALL`` while the table is
    made, not of up to 10,000 rows: every task holds some of them on either side.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(key)
    try:
        if small_batches:
            spark.conf.set(key, SMALL)
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
