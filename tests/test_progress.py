import time

from pyspark.sql import functions as F

from paperloom.streaming import progress


def test_totals_equal_the_batch_counts_after_a_restart(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "event_type", "value")
    parts = [events.filter(F.col("event_id") % 3 == k) for k in range(3)]
    listener = progress.ProgressTable(spark, f"{tmp_path}/progress")
    spark.streams.addListener(listener)
    try:
        for part in parts:  # each run starts the query again, from its checkpoint
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = progress.observed(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "read", errors=F.count_if(F.col("event_type") == "error"))
            kept = progress.observed(stream.filter("value > 50"), "kept")
            kept.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        want = {("read", "rows"): events.count(), ("read", "errors"): events.filter("event_type = 'error'").count(), ("kept", "rows"): events.filter("value > 50").count()}
        got, until = {}, time.time() + 60
        while got != want and time.time() < until:  # listeners are told a little later
            time.sleep(1)
            try:
                got = {(r.stage, r.name): r.value for r in progress.totals(spark, f"{tmp_path}/progress").collect()}
            except Exception as missing:  # no table yet
                assert "PATH_NOT_FOUND" in str(missing)
        assert got == want
        rows = progress.totals(spark, f"{tmp_path}/progress").collect()
        assert len({r.query for r in rows}) == 1 and {r.batches for r in rows} == {3}
        again = spark.read.parquet(f"{tmp_path}/progress").filter("batch = 1").collect()
        spark.createDataFrame(again, progress.PROGRESS).write.mode("append").parquet(f"{tmp_path}/progress")  # as a batch that is run again
        assert {(r.stage, r.name): r.value for r in progress.totals(spark, f"{tmp_path}/progress").collect()} == want
    finally:
        spark.streams.removeListener(listener)
