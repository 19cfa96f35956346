from deckmill.sources.tables import table
from deckmill.streaming import windows


def test_stream_equals_batch(spark, data, tmp_path):
    events = table(spark, data, "events")
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    q = windows.run_to_end(windows.windowed(windows.stream_of(spark, folder, events)), "event_windows_test", str(tmp_path / "cp"))
    assert q.exception() is None
    key = lambda r: (r.window_start, r.event_type, r.n, round(r.total, 2))
    assert sorted(map(key, spark.table("event_windows_test").collect())) == sorted(map(key, windows.windowed(events).collect()))
