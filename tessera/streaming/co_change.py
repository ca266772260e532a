"""Files that change together, kept up to date over a stream of published commits.

The state is keyed by commit and by pair of files; each batch publishes the counts that it changed as a delta of its
own. Counts only grow, so the newest count of a pair is its greatest one: a batch that runs again replaces its delta,
and a reader needs neither locks nor the order of the deltas.

Defined cases: a commit counts once by its hash, however often and in whatever batches it comes; of rows that share a
hash but not their files, the first batch's row counts. A late commit counts when it comes, as counts don't depend on
order. Commits without a hash can't be told from repeats and are left out, as are noise and files that don't count. A
batch without anything new publishes no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import history

SCHEMA = "fileA string, fileB string, together int"
#: Deltas of which a folder has at most so many before they are folded into one.
FOLD_AFTER = 32


def pair_counts(commits: DataFrame, max_files: int = history.MAX_FILES) -> DataFrame:
    """A stream's (fileA, fileB, together) so far; a file's pair with itself counts its commits."""
    known = commits.where("hash is not null").where(F.size("files") <= max_files)
    return history.pair_counts(known.dropDuplicates(["hash"]), max_files)


def start(commits: DataFrame, out: str, checkpoint: str, max_files: int = history.MAX_FILES, fold_after: int = FOLD_AFTER) -> StreamingQuery:
    """Keeps `out` up to date with all that the stream has; ends when no more is there.

    `out` and `checkpoint` are folders that driver and executors share; one stream writes to an `out`. The state of
    hashes and pairs stays in the checkpoint, under the session's state store provider.
    """

    def publish(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/delta/epoch={epoch}")
        if fold_after and (epoch + 1) % fold_after == 0:
            fold(changed.sparkSession, out, epoch)

    return pair_counts(commits, max_files).writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, out: str, kind: str) -> list[int]:
    """The epochs whose delta or fold is whole, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{kind}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{kind}/{n}/_SUCCESS")))


def counts(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """(fileA, fileB, together) as published: the newest whole fold, and the deltas after it; up to an epoch if given."""
    within = [e for e in written(spark, out, "fold") if upto is None or e <= upto]
    base = within[-1] if within else -1
    paths = [f"{out}/fold/epoch={base}"] * bool(within) + [f"{out}/delta/epoch={e}" for e in written(spark, out, "delta") if e > base and (upto is None or e <= upto)]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*paths).groupBy("fileA", "fileB").agg(F.max("together").alias("together"))


def fold(spark: SparkSession, out: str, epoch: int) -> None:
    """All counts up to an epoch as one table. Deltas stay, so a reader that has begun isn't disturbed; see `expire`."""
    counts(spark, out, epoch).write.mode("overwrite").parquet(f"{out}/fold/epoch={epoch}")


def expire(spark: SparkSession, out: str) -> int:
    """Removes what the newest fold but one holds already, and older folds; returns the number of folders.

    The newest fold's own deltas stay, as readers of the fold before may still be at work on them.
    """
    folds = written(spark, out, "fold")
    if len(folds) < 2:
        return 0
    old = [f"{out}/fold/epoch={e}" for e in folds[:-2]] + [f"{out}/delta/epoch={e}" for e in written(spark, out, "delta") if e <= folds[-2]]
    for place in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(old)


def co_change(spark: SparkSession, out: str, min_together: int = history.MIN_TOGETHER) -> DataFrame:
    """The published pairs as `history.co_change` gives them for all commits so far."""
    return history.strengths(counts(spark, out), min_together)
