"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from tessera import streaming

SF = "/root/testdata/sf0.001"


def test_windows(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(4).write.parquet(f"{tmp_path}/in")
    events = streaming.read_files(spark, f"{tmp_path}/in", batch.schema)
    out = streaming.windowed(events, "ts", "1 hour", ["event_type"], "400 days", n=F.count("*"), total=F.sum("value"))
    query = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(str(r.window_start), r.event_type): r.n for r in spark.table("windows").collect()}
    want = batch.groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").count().collect()
    assert got == {(str(r.h), r.event_type): r["count"] for r in want}


def test_first_rows_are_written_once(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        first = streaming.first_of_key(streaming.read_files(spark, f"{tmp_path}/in", batch.schema), "ts", ["user_id"], "400 days")
        streaming.run_once(first, f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() == batch.select("user_id").distinct().count()
