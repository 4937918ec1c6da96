from datetime import datetime, timedelta

from cuelark.streaming.intervals import flag_rates, sessions, stream_intervals

START = datetime(2024, 1, 1)


def frames(flags, video=1):
    return [(video, START + timedelta(minutes=i), f) for i, f in enumerate(flags)]


SCHEMA = "video_id long, ts timestamp, on boolean"


def test_stream_gives_closed_runs(spark, tmp_path):
    source = str(tmp_path / "in")
    data = frames([c == "T" for c in "FTTFFTTTFTF"])
    spark.createDataFrame(list(reversed(data[:6])), SCHEMA).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame(data[6:], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    later = [(9, START + timedelta(hours=5), False)]
    spark.createDataFrame(later, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = stream_intervals(stream, "on", "5 minutes").writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    # One more batch moves the watermark past all frames.
    spark.createDataFrame([(9, START + timedelta(hours=9), False)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    zero = int(START.timestamp()) * 10**6
    got = sorted((r.begin, r.end, r.n_points) for r in spark.table("runs").where("video_id = 1").collect())
    minute = 60 * 10**6
    assert [((b - zero) // minute, (e - zero) // minute, n) for b, e, n in got] == [(1, 3, 2), (5, 8, 3), (9, 10, 1)]


def test_rates_and_sessions_in_batch(spark):
    df = spark.createDataFrame(frames([True, False, None, True] * 30), SCHEMA)
    got = flag_rates(df, "on").orderBy("window").collect()
    assert [(r.frames, r.share) for r in got] == [(60, 0.5), (60, 0.5)] and flag_rates(df, "on", "1 hour", "30 minutes").count() == 5
    assert [r.frames for r in sessions(df, "on", "2 minutes").orderBy("begin").collect()] == [1, *[2] * 29, 1]
