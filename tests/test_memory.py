import json

import pytest
from pyspark.sql import functions as F

from loomspan.plans import memory as plans
from loomspan.streaming import events, memory

COLS = ["steps", "goal", "tool", "status", "focus", "tools", "facts", "completed", "takeaways", "working"]


def rows_of(df):
    return {r.user_id: [r[c] for c in COLS] for r in df.collect()}


def table(spark, n=400):
    kinds = ["view", "click", "error", "purchase", "signup", "x" * 90, *"abcdefgh"]
    made = [(k, f"2024-01-01 {k // 60 % 24:02d}:{k % 60:02d}:00", 1 if k % 3 else k % 7, kinds[k * k % len(kinds)], None if k % 11 == 0 else float(k * 37 % 100), json.dumps({"k": k % 9})) for k in range(n)]
    return spark.createDataFrame(made, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))


def run(df, path, where, **more):
    """The last memory of each session after all that is there."""
    seen = {}

    def take(batch, _):
        seen.update(rows_of(batch.filter("NOT closed")))
        seen.setdefault("closed", set()).update(r.user_id for r in batch.filter("closed").collect())

    q = df.writeStream.outputMode("update").option("checkpointLocation", str(path / where)).foreachBatch(take).trigger(availableNow=True).start()
    q.awaitTermination()
    return seen


def test_stream_restart_and_batch_agree(spark, tmp_path):
    every = table(spark)
    want = rows_of(memory.session_memory(plans.event_steps(every), "user_id", ["ts", "event_id"]))
    steps = [r for r in plans.event_steps(every).orderBy("ts", "event_id").collect()]
    for user, got in want.items():  # by the fold itself
        folded = memory.fold(None, [(r.tool, r.goal, r.points, r.status, r.focus) for r in steps if r.user_id == user], 5)
        assert [folded[c] for c in COLS] == got
    assert any(len(m[5]) == 8 for m in want.values()) and any(len(m[6]) == 10 for m in want.values())
    (tmp_path / "e").mkdir()
    stream = memory.memory_stream(plans.event_steps(events.read_events(spark, str(tmp_path / "e"), 1)), "user_id", ["ts", "event_id"])
    seen = {}
    for lo in (0, 150, 151, 300):  # files come while the query is down, and it goes on from its checkpoint
        hi = {0: 150, 150: 151, 151: 300, 300: 400}[lo]
        every.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        seen |= run(stream, tmp_path, "c")
    assert {k: v for k, v in seen.items() if k != "closed"} == want


def test_idle_sessions_close(spark, tmp_path):
    def put(k, minute, user):
        one = spark.createDataFrame([(k, f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00", user, "view", 1.0, "{}")], "event_id long, ts string, user_id long, event_type string, value double, props string")
        one.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))

    (tmp_path / "e").mkdir()
    rows = events.read_events(spark, str(tmp_path / "e"), 1).withWatermark("ts", "1 minute")
    stream = memory.memory_stream(plans.event_steps(rows), "user_id", ["ts", "event_id"], idle="30 minutes")
    closed = set()
    for k, (minute, user) in enumerate([(0, 1), (10, 2), (100, 2), (101, 2), (102, 3)]):
        put(k, minute, user)
        seen = run(stream, tmp_path, "c")
        closed |= seen["closed"]
    assert 1 in closed and 3 not in closed
    put(9, 104, 1)
    assert run(stream, tmp_path, "c")[1][0] == 1  # a new memory


def test_points_artifacts_and_goals(spark):
    obs = {"summary": " s " + "x" * 700, "intent_summary": {"task_name": "t", "scene": "", "camera": "c"}, "evaluation": {"overall_conclusion": "fine", "recommendation": None}, "references": [1, 2], "generated_images": [], "annotated_urls": ["u"]}
    given = [(1, json.dumps({"query": " ", "label": "find"}), json.dumps(obs)), (2, None, None), (3, "[1]", "not json"), (4, "{}", json.dumps({"success": False})), (5, "{}", json.dumps({"error": " "})), (6, "{}", json.dumps({"error": "e", "evaluation": {}}))]
    df = spark.createDataFrame(given, "id int, i string, o string")
    got = {r.id: r for r in memory.working_items(df, "id", [], F.lit(" tool "), F.col("i"), F.col("o"), F.lit("a, b；a")).collect()}
    assert got[1].goal == "find" and got[2].goal == "a, b；a" and got[1].tool == "tool" and got[1].focus == ["a", "b"]
    points = [json.loads(p) for p in got[1].points]
    assert [p["type"] for p in points] == ["summary", "intent_summary", "evaluation"] and points[1]["data"] == {"task_name": "t", "camera": "c"}
    assert len(points[0]["text"]) == 601 and points[0]["text"].endswith("…")
    assert got[1].artifacts == ["references:2", "annotated_images:1", "evaluation_report"] and got[2].points == [] and got[3].artifacts == [] and got[6].artifacts == []
    assert [got[k].status for k in range(1, 7)] == ["ok", "ok", "ok", "error", "ok", "error"]


def test_threads_steps_and_backfill(spark):
    kind = "s int, threads map<string, array<struct<thread_id: string, updated_at: string, run_stamp: string, x: int>>>"
    rows = [(1, {"b": [(None, "2", "1", 1), (None, None, None, 2), None], "a": [("c", "2", "0", 3), (None, "2", "1", 4)]}), (2, {}), (3, None)]
    got = memory.merged_threads(spark.createDataFrame(rows, kind), "s", "threads").orderBy("place").collect()
    assert [(r.thread_id, r.item.x, r.place) for r in got] == [("b", 2, 1), ("c", 3, 2), ("a", 4, 3), ("b", 1, 4)]
    steps = spark.createDataFrame([("t", k, "act " * 60, None if k == 2 else " ", "p" if k else None) for k in range(5)] + [("u", 0, None, "e", "p")], "t string, k int, action string, e string, p string")
    got = memory.normalized_steps(steps, ["t"], ["k"], "action", ["e", "p"], most=3).collect()
    assert sorted((r.t, r.k, r.observation_event_id, len(r.action)) for r in got) == [("t", 2, "p", 121), ("t", 3, "p", 121), ("t", 4, "p", 121), ("u", 0, "e", 0)]
    ledger = spark.createDataFrame([("a", 1, "seen", "{}")], "s string, seq int, observation string, payload string")
    old = spark.createDataFrame([("a", 1, "tool", "x"), ("b", 2, "", "y"), ("b", 1, "tool", "z")], "s string, k int, tool string, payload string")
    got = {(r.s, r.seq, r.observation, r.payload) for r in memory.backfilled(ledger, old, "s", ["k"]).collect()}
    assert got == {("a", 1, "seen", "{}"), ("b", 1, "tool", "z"), ("b", 2, "legacy", "y")}


@pytest.mark.parametrize("n", [0, 3])
def test_bounds_of_text(spark, n):
    assert spark.range(1).select(memory.trimmed(F.lit(" abcd "), n)).first()[0] == ("…" if n == 0 else "abc…")
