"""Token counts as delta-maintained rollups.

A batch is a set of signed rows: inserts add a document and its tokens, deletes take away what is
recorded of a document, revised counts take the old away and add the new.  Each batch is summed
by source, language and tokenizer version on its way in, and totals are sums over batches, so a
batch never touches what earlier ones wrote.

Commits are idempotent.  A batch goes to folders of its own name, first the ledger of documents,
then its totals; it counts from the moment the totals' folder has its success mark.  A batch that
is committed again is skipped, and one that broke off is written anew from the start.  Compaction
puts all batches so far into one snapshot, which counts from the moment the names of its batches
are written; so what a batch costs depends on the documents, not on how many batches there were.

Tokens are those of public tokenizers, one for each version; texts are read once for all versions.

Edge cases: null sources and languages are groups; null and empty texts have 0 tokens; very long
texts are counted whole; rows that repeat a doc_id are counted each, and deleted or revised
together; null ids can be inserted only; deleting or revising what is not there changes nothing;
empty batches commit; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import load_ranks
from .common import drop_shared, shared_folder, slices, table, utf8, write_shared

KEYS = ["source", "lang", "version"]
LEDGER = "doc_id long, source string, lang string, version string, docs long, tokens long"
TOTALS = "source string, lang string, version string, docs long, tokens long"
MARKS = "[#*$%&|<>]"


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _named(self, kind: str, mark: str) -> list[str]:
        where, fs = self._fs(f"{self.folder}/{kind}/{mark}=*/_SUCCESS")
        return sorted(x.getPath().getParent().getName().removeprefix(f"{mark}=") for x in fs.globStatus(where) or ())

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The last snapshot that is whole, and the batches in it."""
        found = self._named("names", "snapshot")
        if not found:
            return None, set()
        names = self.spark.read.schema("name string").parquet(f"{self.folder}/names/snapshot={found[-1]}")
        return found[-1], {r.name for r in names.collect()}  # names of batches, however many documents they have

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return sorted(self._snapshot()[1] | set(self._named("totals", "batch")))

    def _read(self, kind: str, schema: str) -> DataFrame:
        last, names = self._snapshot()
        paths = [f"{self.folder}/{kind}/batch={b}" for b in self._named("totals", "batch") if b not in names]
        paths += [f"{self.folder}/{kind}/snapshot={last}"] if last else []
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def totals(self) -> DataFrame:
        """source, lang, version, docs and tokens; groups without documents are left out."""
        sums = self._read("totals", TOTALS).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def documents(self, ids: DataFrame | None = None) -> DataFrame:
        """What is recorded now: docs and tokens of each doc_id and group; of some ids only, if given."""
        rows = self._read("ledger", LEDGER)
        if ids is not None:
            rows = rows.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        sums = rows.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Put all committed batches into one snapshot, and remove what it stands for."""
        last, _ = self._snapshot()
        names, number = self.batches(), f"{int(last or 0) + 1:09d}"
        for kind, rows in (("ledger", self.documents()), ("totals", self.totals())):
            rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/snapshot={number}")
        named = self.spark.createDataFrame([(n,) for n in names], "name string")
        named.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/names/snapshot={number}")
        # From here on the snapshot counts; removing is tidying up, and can be done again.
        for kind in ("ledger", "totals", *(["names"] if last else [])):
            old = [f"snapshot={last}"] if last else []
            for folder in old + ([f"batch={n}" for n in names] if kind != "names" else []):
                where, fs = self._fs(f"{self.folder}/{kind}/{folder}")
                fs.delete(where, True)

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revised: DataFrame | None = None) -> bool:
        """Apply a batch; false if it had been committed.

        inserts and revised: doc_id, source, lang, version, tokens; deletes: doc_id.
        """
        if batch in self.batches():
            return False
        signed = self.spark.createDataFrame([], LEDGER)
        plus = lambda df: df.select("doc_id", *KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))
        minus = lambda df: df.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        if inserts is not None:
            signed = signed.unionByName(plus(inserts))
        if deletes is not None:
            signed = signed.unionByName(minus(self.documents(deletes)))
        if revised is not None:
            own = self.documents(revised)
            ids = revised.select("doc_id", "version").distinct()
            signed = signed.unionByName(minus(own.join(ids, ["doc_id", "version"], "left_semi")))
            known = own.select("doc_id", "version").distinct()
            signed = signed.unionByName(plus(revised.join(known, ["doc_id", "version"])))
        ledger, totals = (f"{self.folder}/{kind}/batch={batch}" for kind in ("ledger", "totals"))
        signed.write.mode("overwrite").parquet(ledger)
        written = self.spark.read.schema(LEDGER).parquet(ledger)
        sums = written.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(totals)
        return True


@lru_cache(maxsize=4)
def _tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def counted(docs: DataFrame, tokenizers: dict[str, tuple[str, str]], marks: str = MARKS, text: str = "text") -> DataFrame:
    """doc_id, source, lang, version, tokens and bare (tokens without ``marks``) of each row and version.

    ``tokenizers``: for a version its rank file and pattern, which every machine has.
    """
    schema = T.StructType([docs.schema[c] for c in ("doc_id", "source", "lang")] + [T.StructField("version", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("bare", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without = re.compile(marks)
        for batch in slices(batches, "utf8"):
            texts = [b.decode("utf-8", "replace") for b in batch.column(3).to_pylist()]
            stripped = [without.sub("", t) for t in texts]
            for version, (path, pattern) in tokenizers.items():
                size = lambda t, own=_tokenizer(path, pattern): len(own.encode_ordinary(t))
                tokens = [size(t) for t in texts]
                bare = [n if len(s) == len(t) else size(s) for n, s, t in zip(tokens, stripped, texts)]
                columns = [*batch.columns[:3], pa.array([version] * len(texts)), pa.array(tokens, pa.int64()), pa.array(bare, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", "source", "lang", utf8(f"`{text}`").alias("utf8")).mapInArrow(run, schema)


def maintained(spark: SparkSession, sf_dir: str, tokenizers: dict[str, tuple[str, str]]) -> DataFrame:
    """Totals of ``documents`` after four batches, each committed twice, and a compaction.

    All documents by the first version; all by the second; those labelled bad are counted anew by
    the first without marks; those labelled toxic go.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    bad = labels.where("quality = 0").select("doc_id").distinct()
    toxic = labels.where("toxic = 1").select("doc_id")
    # Texts are read once; batches are made of counts.
    counts = write_shared(counted(docs, tokenizers), "counts")
    first, second = (counts.where(F.col("version") == v) for v in tokenizers)
    rollup = Rollup(spark)
    batches = [
        ("1", {"inserts": first}),
        ("2", {"inserts": second}),
        ("3", {"revised": first.withColumn("tokens", F.col("bare")).join(bad, "doc_id")}),
        ("4", {"deletes": toxic}),
    ]
    for name, changes in batches:
        rollup.commit(name, **changes)
        rollup.commit(name, **changes)
        if name == "3":
            rollup.compact()
    drop_shared(counts)
    return rollup.totals()
