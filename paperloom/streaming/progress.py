"""Progress of streams as a table: what each stage of a query counted in each batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "query string, batch long, stage string, name string, value long"


def observed(df: DataFrame, stage: str, **counts: Column) -> DataFrame:
    """STM-01, AGG-09: ``df``, whose rows are counted on their way, as ``rows`` of ``stage``; ``counts`` are further
    aggregates with whole numbers."""
    return df.observe(stage, F.count(F.lit(1)).alias("rows"), *[c.cast("long").alias(name) for name, c in counts.items()])


class ProgressTable(StreamingQueryListener):
    """STM-01: appends the counts of ``observed`` stages, a row for each, to a table; see ``spark.streams.addListener``.

    A batch that is run again after a failure writes its rows again, under the same query and batch; ``totals`` takes
    one of them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        now = event.progress
        rows = [(str(now.id), now.batchId, stage, name, value) for stage, row in (now.observedMetrics or {}).items() for name, value in row.asDict().items()]
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def totals(spark: SparkSession, path: str) -> DataFrame:
    """AGG-09: (query, stage, name, batches, value) over all batches, each once; a restarted query goes on."""
    once = spark.read.schema(PROGRESS).parquet(path).groupBy("query", "batch", "stage", "name").agg(F.max("value").alias("value"))
    return once.groupBy("query", "stage", "name").agg(F.count("*").alias("batches"), F.sum("value").alias("value"))
