"""Route requests as a stream of files: each micro-batch goes through the batch router."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

REQUEST = "query_id bigint, scenario string, start string"


def dispatch(spark: SparkSession, source: str, target: str, checkpoint: str, route: Callable[[DataFrame], DataFrame], kind: str = REQUEST, once: bool = True) -> StreamingQuery:
    """Read JSON requests from `source`, route each micro-batch and write its results under its number in `target`.

    A batch that is run again after a failure overwrites its own folder, so that results come once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        route(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = spark.readStream.schema(kind).json(source).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
