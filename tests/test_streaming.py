from __future__ import annotations

from pebblegraph.streaming import transitions


def test_consecutive_events_of_a_stream_equal_those_of_the_table(spark, tables, tmp_path):
    events = spark.read.parquet(f"{tables}/events.parquet")
    first, last = tmp_path / "in" / "a", tmp_path / "in" / "b"
    half = events.selectExpr("percentile(event_id, 0.5)").first()[0]
    ordered = events.select("ts").orderBy("ts").collect()
    middle = ordered[len(ordered) // 2]["ts"]
    assert half is not None
    events.where(events["ts"] < middle).write.parquet(f"file://{first}")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in/*")
    query = transitions.consecutive(stream).writeStream.format("memory").queryName("moves").option("checkpointLocation", f"file://{tmp_path}/state").start()
    try:
        query.processAllAvailable()
        events.where(events["ts"] >= middle).write.parquet(f"file://{last}")
        query.processAllAvailable()
    finally:
        query.stop()
    events.createOrReplaceTempView("all_events")
    want = spark.sql("SELECT * FROM (SELECT user_id, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst FROM all_events) WHERE src IS NOT NULL")
    got = spark.sql("SELECT * FROM moves")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_windows_count_every_event(spark, tables):
    events = spark.read.parquet(f"{tables}/events.parquet")
    assert transitions.windowed_degrees(events).groupBy().sum("n").first()[0] == events.count()
