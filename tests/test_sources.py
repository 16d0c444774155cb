"""Sources, sinks, scalars and the stream."""

import numpy as np
from pyspark.sql import functions as F

from pluvion.functions import scalars
from pluvion.operators import late
from pluvion.plans import streams
from pluvion.sources import files
from pluvion.streaming import late_stream


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, None, None)], "k bigint, s string, v double")
    files.write_parquet(df, str(tmp_path / "p"))
    files.write_csv(df, str(tmp_path / "c"), ["k"])
    files.write_json(df, str(tmp_path / "j"))
    want = sorted(map(tuple, df.collect()), key=str)
    assert sorted(map(tuple, files.read_parquet(spark, str(tmp_path / "p"), "k", "s", "v").collect()), key=str) == want
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), "k bigint, s string, v double").collect()), key=str) == want
    assert sorted(map(tuple, spark.read.schema("k bigint, s string, v double").json(str(tmp_path / "j")).collect()), key=str) == want
    assert files.markdown_rows(df).count() == 4


def test_npz_grid_and_file_steps(spark, tmp_path):
    deep = tmp_path / "x"
    deep.mkdir()
    for d, v in ((tmp_path, 1.0), (deep, 2.0)):
        np.savez_compressed(d / "field.20230101-S000000-E002959.npz", precipitation=np.array([[v, -9999.0], [np.nan, 0.0]], dtype=np.float32), time=60)
    steps = files.file_steps(spark, str(tmp_path)).collect()
    assert len(steps) == 1 and "/x/" in steps[0]["path"]
    rows = files.read_npz_grid(spark, str(deep)).orderBy("i", "j").collect()
    assert [r["rate"] for r in rows] == [2.0, None, None, 0.0]
    assert files.not_yet_ingested(files.file_steps(spark, str(tmp_path)), spark.createDataFrame([("other",)], "path string")).count() == 1


def test_scalars(spark):
    df = spark.createDataFrame([('{"prec tot": " 1,5 "}', "MÃ³n"), ('{"prec tot": "None"}', None), ('{"prec tot": "abc"}', "Món"), ("{bad", "x")], "p string, t string")
    got = df.select(scalars.json_number("p", "prec tot").alias("n"), scalars.repaired_text("t").alias("t")).collect()
    assert [r["n"] for r in got] == [1.5, None, None, None] and [r["t"] for r in got] == ["Món", "Unknown", "Món", "x"]


def test_stream_equals_batch(spark, tmp_path):
    schema = "station_id string, event_time timestamp, inserted_ms bigint, ingest_order bigint, value double"
    base = 1_760_000_000_000 // 3_600_000 * 3_600_000
    rows = [("a" if i % 3 else "b", base + (i * 37 % 180) * 60_000, base + (i * 91 % 400) * 60_000, i, float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "station_id string, t bigint, inserted_ms bigint, ingest_order bigint, value double").select("station_id", F.timestamp_millis("t").alias("event_time"), "inserted_ms", "ingest_order", "value")
    for k in range(3):
        df.filter(F.col("ingest_order") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    named = lambda rows: rows.select("station_id", F.unix_millis("event_time").alias("t_ms"), F.col("inserted_ms").alias("n_ms"), "ingest_order", F.col("value").alias("precip_raw_mm"))
    totals = lambda state: {(r["station_id"], r["period_start_min"]): (r["readings"], r["total"]) for r in late.period_totals(state).collect()}
    got = totals(streams.latest_rows(late_stream.corrected_counters(named(stream)), "update", list(late.KEYS)))
    assert got == totals(late.late_counters(named(df), cutoffs_min=(1440,))) and got
