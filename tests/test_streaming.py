from datetime import datetime

from loomspan.streaming import events

ROWS = [(1, datetime(2024, 1, 1, 0, 5), 1, "a", 1.0, ""), (2, datetime(2024, 1, 1, 0, 20), 1, "a", 2.0, ""), (3, datetime(2024, 1, 1, 1, 5), 2, "a", 4.0, ""), (4, datetime(2024, 1, 1, 9, 0), 1, "b", 1.0, "")]


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_windows_in_batch_and_stream(spark, tmp_path):
    batch = spark.createDataFrame(ROWS, events.EVENTS)
    batch.write.parquet(str(tmp_path / "e"))
    want = {(r.start, r.event_type, r.n, r.total) for r in events.windowed_counts(batch, "1 hour").collect()}
    assert (datetime(2024, 1, 1), "a", 2, 3.0) in want
    got = {tuple(r) for r in drain(events.windowed_counts(events.read_events(spark, str(tmp_path / "e")), "1 hour"), "w", "complete")}
    assert got == want


def test_ledger_numbers_go_on(spark, tmp_path):
    batch = spark.createDataFrame(ROWS, events.EVENTS)
    batch.coalesce(1).write.parquet(str(tmp_path / "e"))
    batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    rows = drain(events.numbered_ledger(events.read_events(spark, str(tmp_path / "e"), 1), keep=4), "l", "append")
    assert sorted(r.seq for r in rows if r.user_id == 1) == [1, 2, 3, 4, 5, 6] and max(r.held for r in rows) == 4


def test_silent_streak(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("r", k, z) for k, z in enumerate([0, 1, 0, 0, 0, 1])] + [("s", 0, 1)], "run string, step int, z int")
    assert {r.run: r.stopped_at for r in events.silent_streak(rows, "run", "step", F.col("z") == 0, 3).collect()} == {"r": 4, "s": None}
