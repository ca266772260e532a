"""Published snapshots as a stream: each new completion marker reloads the index it belongs to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera import schemas


def markers(spark: SparkSession, root: str) -> DataFrame:
    """A stream of completion markers below a folder of published indexes."""
    return spark.readStream.schema(schemas.MARKER).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "sync-complete*.json").json(root)


def on_publish(stream: DataFrame, reload: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls reload with the newest marker of each project in a batch; a marker that is read again has the same syncId."""

    def batch(df: DataFrame, epoch: int) -> None:
        newest = df.groupBy("project").agg({"completedAt": "max"}).withColumnRenamed("max(completedAt)", "completedAt")
        reload(df.join(newest, ["project", "completedAt"]).dropDuplicates(["project", "syncId"]), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
