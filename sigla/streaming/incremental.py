"""A step over a growing corpus: files of entries come in, each is worked on once.

The stream's checkpoint takes the place of a list of what is done.  Within a batch, the step
function is the same as for a whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schema import VITAE


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], schema: str = VITAE, files: int = 100) -> StreamingQuery:
    """Process what is in ``source`` (Parquet) and not yet done, and stop.

    A batch writes to a folder of its own number and replaces it if the batch is run again, so
    every entry counts once.
    """

    def one(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    incoming = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return incoming.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink)
