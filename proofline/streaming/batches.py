"""Labels checked as they arrive: a stream of applications with their evidence, written batch by batch; what a stopped stream has written stays.

A batch of labels in the usual sense becomes files that arrive. The verifier is any function of DataFrames; progress is heard from the query's listener, with the total that a manifest gives;
a stop takes effect between micro-batches, and a stream that starts again goes on where it stopped. Every label is written once, whatever happened in between: a micro-batch
that runs again replaces its own folder, and only folders that were finished are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from proofline.operators.reconcile import cancelled
from proofline.operators.rules import evaluated, long_form

#: Raised inside a micro-batch that must not begin; it is how the query ends.
STOPPED = "stopped before this batch was begun"


def source(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of labels (application fields and evidence) as a stream, a file each time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def checked(labels: DataFrame) -> DataFrame:
    """One row for each label and check; no state, so nothing waits for later data."""
    return long_form(evaluated(labels), "filename")


def _folders(spark: SparkSession, folder: str) -> list[str]:
    """Finished micro-batches: their writers left a mark."""
    jvm = spark.sparkContext._jvm
    marks = jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(str(status.getPath().getParent().toString()) for status in found or [])


def finished(spark: SparkSession, folder: str, schema) -> DataFrame:
    """What has been written so far by whole micro-batches."""
    paths = _folders(spark, folder)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def outcome(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """results, and an error row for every listed label (filename) that a stopped stream did not reach."""
    lost = cancelled(manifest.select("filename").distinct(), results)
    with_error = results if "error" in results.columns else results.selectExpr("*", "CAST(NULL AS STRING) AS error")
    return with_error.unionByName(lost, allowMissingColumns=True)


class Progress(StreamingQueryListener):
    """Calls told(completed, total) after each micro-batch; completed never falls. Labels that were done before (or need no check) count from the start."""

    def __init__(self, told: Callable[[int, int], None], total: int, completed: int = 0):
        self.told, self.total, self.completed, self.last, self.own = told, total, completed, -1, None
        told(completed, total)

    def onQueryStarted(self, event) -> None:
        self.own = self.own or event.id

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.id != self.own or progress.batchId <= self.last or not progress.numInputRows:
            return
        self.last = progress.batchId
        self.completed = min(self.completed + progress.numInputRows, self.total)
        self.told(self.completed, self.total)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def write(results: DataFrame, folder: str, checkpoint: str, on_batch=None, should_stop: Callable[[], bool] | None = None) -> StreamingQuery:
    """Appends every micro-batch to a Parquet table and reports (number, rows) to on_batch; before each, should_stop may end the stream."""

    def each(batch: DataFrame, number: int) -> None:
        if should_stop is not None and should_stop():
            raise InterruptedError(STOPPED)
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if on_batch is not None:
            on_batch(number, batch.sparkSession.read.parquet(f"{folder}/batch={number}").count())

    return results.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run(labels: DataFrame, folder: str, checkpoint: str, verify: Callable[[DataFrame], DataFrame] = checked, told: Callable[[int, int], None] | None = None, total: int | None = None, should_stop: Callable[[], bool] | None = None, on_batch=None) -> bool:
    """Verifies a stream of labels to its present end, or until should_stop says so; whether it came to the end.

    total: number of labels in all, for progress. A stream that is run again with the same folders goes on after the last finished micro-batch.
    """
    spark, results = labels.sparkSession, verify(labels)
    listener = None
    if told is not None:
        done = finished(spark, folder, results.schema).select("filename").distinct().count()
        listener = Progress(told, total if total is not None else done, done)
        spark.streams.addListener(listener)
    try:
        write(results, folder, checkpoint, on_batch, should_stop).awaitTermination()
    except StreamingQueryException as error:
        if STOPPED not in str(error):
            raise
        return False
    finally:
        if listener is not None:
            # What the listener has not heard yet is on its way.
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
            spark.streams.removeListener(listener)
    return True
