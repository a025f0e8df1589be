"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of anything else.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Texts are handed to vectorised functions in slices of about this many bytes, so that a
#: batch of very long texts takes no more memory than one of short texts.
SLICE_BYTES = 2 << 20

_OWN_FOLDER: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is set, a local session gets a temporary one; on a cluster that would be a folder
    of one machine only, so there it is an error.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
    if not _OWN_FOLDER:
        own = tempfile.mkdtemp(prefix="sigla-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN_FOLDER.append("file://" + own)
    return _OWN_FOLDER[0]


def write_shared(df: DataFrame, name: str, level: int = 3, page_bytes: int = 1 << 20) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    ``level`` is that of the Zstandard compression, ``page_bytes`` what is compressed at a time.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": level, "parquet.page.size": page_bytes}
    df.write.options(**options).parquet(path)
    remove_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sigla_path = path
    return out


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder of this application removed when the application ends."""
    where, fs = _file_system(spark, path)
    fs.deleteOnExit(where)


def drop_shared(df: DataFrame) -> None:
    """Remove a table of :func:`write_shared` that no later result reads."""
    path = getattr(df, "_sigla_path", None)
    if path:
        where, fs = _file_system(df.sparkSession, path)
        fs.delete(where, True)


def utf8(column: Column | str) -> Column:
    """The UTF-8 bytes of a text, those of the empty text for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` (binary) has about SLICE_BYTES in each, one row at least."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        start = size = 0
        for i, n in enumerate(pa.compute.binary_length(values).to_pylist()):
            size += n or 0
            if size >= SLICE_BYTES:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within is handed to Python in Arrow batches of about SLICE_BYTES, not of up to 10,000 rows.

    :func:`slices` cuts a batch only after it has been read whole, and the one before is still held then.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, SLICE_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def with_columns(batch: pa.RecordBatch, drop: tuple[str, ...], **new: pa.Array) -> pa.RecordBatch:
    """``batch`` without ``drop`` and with ``new`` appended."""
    kept = [(f.name, c) for f, c in zip(batch.schema, batch.columns) if f.name not in drop]
    kept += list(new.items())
    return pa.RecordBatch.from_arrays([c for _, c in kept], names=[n for n, _ in kept])


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those of the given names, in whatever case, as Spark compares them."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def packed(df: DataFrame) -> Column:
    """A row of ``df`` as one struct, so that no name of its columns can clash with an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(name: str, columns: list[str]) -> list[Column]:
    """Columns of a struct that :func:`packed` made."""
    return [F.col(name).getField(c).alias(c) for c in columns]


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or with underscores appended until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
