"""Streams against the batch results of the same rows."""

import datetime

from pyspark.sql import functions as F

from readloom.operators.joins import windowed_reads
from readloom.streaming import windows


def test_coordinate_windows_of_a_stream(spark, tmp_path):
    rows = [(i, i % 7, "ACGTTGCA"[i % 3 :] * 5) for i in range(60)]
    df = spark.createDataFrame(rows, "read_id long, start int, seq string").withColumn("len", F.length("seq")).withColumn("stop", F.col("start") + F.col("len") - 1)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windows.window_objects(stream, 20, 2).writeStream.format("memory").queryName("objects").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("objects").collect()}
    want = {tuple(r) for r in windowed_reads(df, 20, 2).groupBy("wstart", "wseq").agg(F.count(F.lit(1)).alias("weight")).collect()}
    assert got == want and got


def test_late_events_and_restart(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=m)
    schema = "event_id long, ts timestamp, event_type string, value double"
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        windows.write_available(windows.event_windows(spark.readStream.schema(schema).parquet(source), "10 minutes", late="5 minutes"), out, check).awaitTermination(120)
        return sorted((r["start"].minute, r["key"], r["n"], r["total"]) for r in spark.read.schema("start timestamp, end timestamp, key string, n long, total double").parquet(out).collect())

    assert arrive([(1, at(1), "a", 1.0), (2, at(3), "a", 2.0), (3, at(12), "b", 4.0), (4, at(40), "a", 8.0)]) == [(0, "a", 2, 3.0), (10, "b", 1, 4.0)]
    # the first row is late by more than the bound; the windows of the others become final
    assert arrive([(5, at(2), "a", 99.0), (6, at(41), "a", 1.0), (7, at(90), "c", 1.0)]) == [(0, "a", 2, 3.0), (10, "b", 1, 4.0), (40, "a", 2, 9.0)]
