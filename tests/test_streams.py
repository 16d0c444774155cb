"""Registered streams against the batch queries, on one file and on folders of files."""

from pyspark.sql import functions as F

from pluvion.plans import network, streams


def test_corrected_hours_equal_the_batch(spark, sf):
    got = {tuple(r) for r in streams.stream_corrected_hours(spark, sf).collect()}
    assert got == {tuple(r) for r in network.p2_hourly_rain(spark, sf).collect()} and got


def test_folder_of_files(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    key = lambda rows: {tuple(r) for r in rows.collect()}
    got = key(streams.stream_hourly_totals(spark, str(tmp_path)))
    assert got == key(streams.stream_hourly_totals(spark, sf))
    assert sum(r[2] for r in got) == events.count()


def test_last_row_of_each_key(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("a", k), (f"only {k}", k)], "g string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    totals = stream.groupBy("g").agg(F.sum("v").alias("total"))
    assert {tuple(r) for r in streams.latest_rows(totals, "update", ["g"]).collect()} == {("a", 3), ("only 0", 0), ("only 1", 1), ("only 2", 2)}
