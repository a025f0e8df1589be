"""Reading and writing: CSV with embedded newlines, JSON dumps, checkpoints, manifests, reports.

Every reader has an explicit schema; every writer is a dry run unless told to write.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import MANIFEST, RAW, REGESTS, VITAE

CSV = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}
DECISIONS = "volume long, entry long, text string, candidates map<string, array<string>>, choices map<string, string>, errors array<string>, effort struct<tries int, server_retries int, readable boolean, seconds double>"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**CSV).csv(path)


def read_regests(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, REGESTS)


def read_vitae(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, VITAE)


def read_raw_glossary(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """Raw dictionary rows with their order; columns count by position, and a header can be asserted.

    A dictionary is one small file, so its row order is that of one partition.
    """
    if header is not None:
        first = spark.read.text(path).first()
        got = [c.strip().strip('"') for c in (first[0] if first else "").lstrip("﻿").split(",")]
        if got != header:
            raise ValueError(f"unexpected header {got}")
    rows = spark.read.schema(", ".join(f"{c} string" for c in RAW)).options(**CSV, enforceSchema=True).csv(path)
    cells = [F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in RAW]
    return rows.coalesce(1).select(*cells, F.monotonically_increasing_id().alias("row_order"))


def write_csv(df: DataFrame, path: str, write: bool = False, one_file: bool = False) -> DataFrame:
    """Write as CSV if ``write``; ``one_file`` is for review tables, which people read."""
    if write:
        (df.coalesce(1) if one_file else df).write.mode("overwrite").options(**CSV).csv(path)
    return df


def write_stage(df: DataFrame, path: str, write: bool = False) -> DataFrame:
    """A stage's table, by volume, so that a later read of some volumes skips the others."""
    if write:
        df.write.mode("overwrite").partitionBy("volume").parquet(path)
    return df


#: The line that a dump's results follow, but for the settings before it.
_RESULTS = '"results":['


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A step's settings and its results, a row for each result.

    What :func:`write_dump` made is read line by line, by as many tasks as there are; one JSON
    object in one file is read as a whole.
    """
    lines = spark.read.text(path).select(F.ltrim(F.col("value"), F.lit(",")).alias("value"))
    head = lines.where(F.col("value").endswith(_RESULTS)).limit(1).collect()
    if not head:
        whole = spark.read.schema(_nested(DECISIONS)).option("multiLine", True).json(path)
        return whole.select("step", "run", "prompt_sha1", "input", F.explode("results").alias("r")).select("step", "run", "prompt_sha1", "input", "r.*")
    told = json.loads(head[0].value + "]}")
    settings = [F.lit(told.get(k)).cast("int" if k == "step" else "string").alias(k) for k in ("step", "run", "prompt_sha1", "input")]
    rows = lines.where(F.col("value").startswith("{") & ~F.col("value").endswith(_RESULTS))
    return rows.select(*settings, F.from_json("value", DECISIONS, {"mode": "FAILFAST"}).alias("r")).select("step", "run", "prompt_sha1", "input", "r.*")


def _nested(results: str) -> str:
    fields = ", ".join(": ".join(f.split(" ", 1)) for f in _split(results))
    return f"step int, run string, prompt_sha1 string, input string, results array<struct<{fields}>>"


def _split(fields: str) -> list[str]:
    out, depth = [""], 0
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def write_dump(spark: SparkSession, path: str, decisions: DataFrame, write: bool = False, **settings) -> dict:
    """One JSON object of a step's settings and its results, ordered by entry.

    ``path`` is a folder whose files, one after the other, are that object: a line opens it, each
    result is a line, and a line closes it.  Results are written by ranges of entries; nothing
    holds them all.
    """
    head = {"step": None, "run": None, "model": None, "prompt_sha1": None, "input": None, "written": None} | settings
    if write:
        first = decisions.agg(F.min(F.struct("volume", "entry")).alias("k")).first().k
        opening = json.dumps(head, ensure_ascii=False, separators=(",", ":"))[:-1] + "," + _RESULTS
        comma = F.when((F.col("volume") == first.volume) & (F.col("entry") == first.entry), "").otherwise(",") if first else F.lit("")
        body = decisions.select("volume", "entry", F.concat(comma, F.to_json(F.struct(*decisions.columns), {"ignoreNullFields": "false"})).alias("value"))
        ends = spark.createDataFrame([(-(1 << 62), 0, opening), (1 << 62, 0, "]}")], "volume long, entry long, value string")
        body.unionByName(ends).orderBy("volume", "entry").select("value").write.mode("overwrite").text(path)
    return head


def append_checkpoint(rows: DataFrame, path: str) -> None:
    """Add a batch of decisions as JSON lines."""
    rows.write.mode("append").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def done_in(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    """volume, entry of the entries that a checkpoint has a decision for, without those that failed.

    ``by``: only what that chooser decided.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "volume long, entry long")
    return read_checkpoint(spark, path, "volume long, entry long, failure string", by).where("failure is null").select("volume", "entry")


def read_checkpoint(spark: SparkSession, path: str, schema: str = DECISIONS, by: str | None = None) -> DataFrame:
    """Decisions of a checkpoint, for each entry the last one written; ``by``: by that chooser.

    A line that cannot be read is left out where it is a file's last one (the write broke off);
    anywhere else it raises.  A file is a batch's part and is read whole, so that the order of its
    lines is that of the file whatever Spark's split size.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"), F.unix_micros("_metadata.file_modification_time").alias("at"))
    split = F.filter(F.split("value", "\n", -1), lambda x: F.trim(x) != "")
    lines = files.select("file", "at", F.size(split).alias("last"), F.posexplode(split).alias("line", "value"))
    own = lines.withColumn("r", F.from_json("value", f"{schema}, decided_by string, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r._bad").isNotNull() | F.col("r.volume").isNull()
    own = own.where(~bad | (F.col("line") + 1 < F.col("last")))
    if by is not None:
        own = own.where(bad | (F.col("r.decided_by") == by))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("unreadable line in "), F.col("file"))).cast("long")).otherwise(F.col("r.volume"))
    newest = F.row_number().over(Window.partitionBy("volume", "r.entry").orderBy(F.desc("at"), F.desc("file"), F.desc("line")))
    own = own.withColumn("volume", checked).withColumn("k", newest).where("k = 1")
    return own.select("volume", *[F.col(f"r.{f.split(' ')[0]}") for f in _split(schema)[1:]])


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """All entries ever recorded, of each run and step the last."""
    rows = spark.read.schema(MANIFEST + ", at long").json(path)
    newest = F.row_number().over(Window.partitionBy("run", "step").orderBy(F.desc("at")))
    return rows.withColumn("k", newest).where("k = 1").drop("k", "at")


def record_manifest(entries: DataFrame, path: str) -> None:
    entries.withColumn("at", F.lit(time.time_ns())).coalesce(1).write.mode("append").json(path)


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report section: a table's first rows, which the caller has made few and has ordered."""
    rows = df.limit(limit).collect()
    shown = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    body = "\n".join("| " + " | ".join(shown(v) for v in r) + " |" for r in rows)
    return f"## {title}\n\n| {' | '.join(df.columns)} |\n|{' --- |' * len(df.columns)}\n{body}\n"
