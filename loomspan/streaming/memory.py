"""Memory of agent sessions: steps of a ledger as working items, folded into a bounded memory for each session, in a stream or a batch."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much of each kind a memory holds, and how long its texts are.
TOOLS, FACTS, COMPLETED, TAKEAWAYS = 8, 10, 10, 10
GOAL_CHARS, STEP_CHARS, STATUS_CHARS, FOCUS, FOCUS_CHARS = 200, 180, 220, 8, 120
MEMORY = "steps long, goal string, tool string, status string, focus array<string>, tools array<string>, facts array<string>, completed array<string>, takeaways array<string>, working array<string>"


def trimmed(c: Column, n: int) -> Column:
    """The text without white space at its ends, cut after ``n`` characters with an ellipsis; null counts as empty."""
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), rf"(?s)^(.{{{n}}}).+$", "$1…")


def _held(c: Column) -> Column:
    return F.when(c != "", c)


def goal(action_input: Column, fallback: Column, n: int = 220) -> Column:
    """What a step is for: the first of its input's query, task text, label and goal that holds something, else a text of its own."""
    named = [_held(trimmed(F.get_json_object(action_input, f"$.{k}"), n)) for k in ("query", "task_text", "label", "goal")]
    return F.coalesce(*named, trimmed(fallback, n))


def artifacts(observation: Column) -> Column:
    """What a step has made, one label for each kind with its count."""
    many = [("references", "references"), ("generated_images", "generated_images"), ("annotated_urls", "annotated_images")]
    size = lambda key: F.json_array_length(F.get_json_object(observation, f"$.{key}"))
    labels = [F.when(size(key) > 0, F.concat(F.lit(f"{label}:"), size(key).cast("string"))) for key, label in many]
    report = F.get_json_object(observation, "$.evaluation")
    return F.array_compact(F.array(*labels, F.when(F.startswith(report, F.lit("{")) & (report != "{}"), F.lit("evaluation_report"))))


def key_points(observation: Column, most: int = 8) -> Column:
    """JSON objects of what a step found: its summary, what it understood of the task, and conclusions of an evaluation; each once."""
    fields, told = ("task_name", "scene", "target", "camera"), ("overall_conclusion", "recommendation")
    kind = f"summary string, intent_summary struct<{', '.join(f'{k}: string' for k in fields)}>, evaluation struct<{', '.join(f'{k}: string' for k in told)}>"

    def points(o: Column) -> Column:
        held = lambda c, n: _held(trimmed(c, n))
        intent = F.struct(*[held(o["intent_summary"][k], 100).alias(k) for k in fields])
        parts = [
            F.when(held(o["summary"], 600).isNotNull(), F.to_json(F.struct(F.lit("summary").alias("type"), held(o["summary"], 600).alias("text")))),
            F.when(F.to_json(intent) != "{}", F.to_json(F.struct(F.lit("intent_summary").alias("type"), intent.alias("data")))),
            *[F.when(held(o["evaluation"][k], 160).isNotNull(), F.to_json(F.struct(F.lit("evaluation").alias("type"), F.lit(k).alias("field"), held(o["evaluation"][k], 160).alias("text")))) for k in told],
        ]
        return F.slice(F.array_distinct(F.array_compact(F.array(*parts))), 1, most)

    return F.coalesce(F.transform(F.array(F.from_json(observation, kind)), points)[0], F.array().cast("array<string>"))  # parsed once, as the item of an array of one


def observation_status(observation: Column) -> Column:
    failed = (F.get_json_object(observation, "$.success") == "false") | (F.trim(F.get_json_object(observation, "$.error")) != "")
    return F.when(F.coalesce(failed, F.lit(False)), "error").otherwise("ok")


def focus(text: Column) -> Column:
    """The clauses of what the user said, each once."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[，,。；;！!\n]+"), lambda x: trimmed(x, FOCUS_CHARS)), lambda x: x != "")
    return F.slice(F.array_distinct(parts), 1, FOCUS)


def working_items(ledger: DataFrame, session: str, order: list[str], action: Column, action_input: Column, observation: Column, text: Column) -> DataFrame:
    """(session, order columns, tool, goal, points, artifacts, status, focus) of each step of a ledger."""
    given = F.struct(action.alias("action"), action_input.alias("input"), observation.alias("observation"), text.alias("text"))
    rows = ledger.select(session, *order, F.explode(F.array(given)).alias("__s"))  # made once a row, however often it is used below
    found = F.col("__s.observation")
    return rows.select(
        session, *order, F.coalesce(F.trim("__s.action"), F.lit("")).alias("tool"), goal(F.col("__s.input"), F.col("__s.text")).alias("goal"), key_points(found).alias("points"),
        artifacts(found).alias("artifacts"), observation_status(found).alias("status"), focus(F.col("__s.text")).alias("focus"),
    )


def _first(values: Iterable[str], most: int) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))[:most]


def fold(memory: dict | None, steps: Iterable[tuple], keep: int) -> dict:
    """Put steps (tool, goal, points, status, focus), in order, into a memory. Tools, facts and completed steps stay as first met, takeaways go newest first."""
    m = memory or {"steps": 0, "goal": "", "tool": "", "status": "", "focus": [], "tools": [], "facts": [], "completed": [], "takeaways": [], "working": []}
    cut = lambda s, n: s if len(s) <= n else s[:n] + "…"
    for tool, aim, points, status, clauses in steps:
        points = [str(p) for p in points]
        m["steps"] += 1
        m |= {"goal": cut(aim, GOAL_CHARS), "tool": cut(tool, 80), "status": cut(status, STATUS_CHARS), "focus": [str(c) for c in clauses]}
        done = cut(f"{m['tool'] or 'tool'}: {m['goal']}".strip(), STEP_CHARS) if m["tool"] or m["goal"] else ""
        m["tools"], m["facts"], m["completed"] = _first([*m["tools"], m["tool"]], TOOLS), _first([*m["facts"], *points], FACTS), _first([*m["completed"], done], COMPLETED)
        m["takeaways"] = _first([*points, *m["takeaways"]], TAKEAWAYS)
        m["working"] = [*m["working"], f"{tool}: {aim}"][-keep:]
    return m


def memory_stream(steps: DataFrame, session: str, order: list[str], keep: int = 5, idle: str | None = None, event_time: str = "ts") -> DataFrame:
    """The memory of each session of a stream of working items, put out (update mode) whenever a trigger changes it.

    State is one memory a session, whose size the limits above bound, however long a session is. With ``idle``, a session that has
    been silent for that long by the stream's watermark is put out once more as ``closed`` and its state goes; a later step then
    begins a new memory. Within a trigger steps go in order; a step that comes triggers late is folded when it comes.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = steps.schema[session].dataType.simpleString()
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        memory, last = (json.loads(state.get[0]), state.get[1]) if state.exists else (None, 0)
        closed = state.hasTimedOut
        if not closed:
            rows = pd.concat(list(parts)).sort_values(order)
            memory = fold(memory, rows[["tool", "goal", "points", "status", "focus"]].itertuples(index=False, name=None), keep)
            if wait:
                last = max(last, int(rows[event_time].max().timestamp() * 1000))
        yield pd.DataFrame([{session: key[0], **memory, "closed": closed}])
        if closed:
            state.remove()
        else:
            state.update((json.dumps(memory), last))
            if wait:
                state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return steps.groupBy(session).applyInPandasWithState(run, f"`{session}` {kind}, {MEMORY}, closed boolean", "memory string, last long", "update", timeout)


def session_memory(steps: DataFrame, session: str, order: list[str], keep: int = 5) -> DataFrame:
    """What ``memory_stream`` holds after all steps, from a table: by partial aggregates over (session, value) and ranks cut before they
    are shuffled, so that a session with most of all steps is never gathered."""
    at = F.struct(*order)
    rows = steps.select(session, at.alias("at"), trimmed(F.col("tool"), 80).alias("tool"), trimmed(F.col("goal"), GOAL_CHARS).alias("short"), "goal", "status", "focus", "points", F.col("tool").alias("whole"))
    done = trimmed(F.concat(F.when(F.col("tool") == "", "tool").otherwise(F.col("tool")), F.lit(": "), F.col("short")), STEP_CHARS)
    rows = rows.withColumn("done", F.when((F.col("tool") != "") | (F.col("short") != ""), done))

    def listed(values: DataFrame, most: int, name: str, newest: bool = False) -> DataFrame:
        """(session, array): distinct values in order of their first place, or those of the newest steps first."""
        first = F.max(F.struct("at", (-F.col("pos")).alias("pos"))) if newest else F.min(F.struct("at", "pos"))
        per = values.filter(F.col("v") != "").groupBy(session, "v").agg(first.alias("w"))
        by = [F.desc("w")] if newest else ["w"]
        best = per.withColumn("r", F.row_number().over(Window.partitionBy(session).orderBy(*by))).filter(F.col("r") <= most)
        return best.groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias(name))

    points = rows.select(session, "at", F.posexplode("points").alias("pos", "v"))
    one = lambda c: rows.select(session, "at", F.lit(0).alias("pos"), F.col(c).alias("v"))
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("at")))).filter(F.col("r") <= keep)
    work = last.groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), F.concat("whole", F.lit(": "), "goal").alias("v")))), lambda x: x["v"]).alias("working"))
    now = rows.groupBy(session).agg(F.count("*").alias("steps"), F.max_by(F.struct(F.col("short").alias("goal"), "tool", trimmed(F.col("status"), STATUS_CHARS).alias("status"), "focus"), "at").alias("m"))
    out = now.select(session, "steps", "m.*")
    for part in (listed(one("tool"), TOOLS, "tools"), listed(points, FACTS, "facts"), listed(one("done"), COMPLETED, "completed"), listed(points, TAKEAWAYS, "takeaways", True), work):
        out = out.join(part, session, "left")
    none = F.array().cast("array<string>")
    return out.select(session, "steps", "goal", "tool", "status", "focus", *[F.coalesce(c, none).alias(c) for c in ("tools", "facts", "completed", "takeaways", "working")])


def merged_threads(sessions: DataFrame, session: str, threads: str) -> DataFrame:
    """(session, thread_id, place, item): the items of all threads of a session in one list by (updated_at, run_stamp).

    ``threads`` is a map from thread to an array of structs with ``thread_id``, ``updated_at``, ``run_stamp``; a missing thread id is
    that of the map, missing times sort first, and equal ones go by thread and place there.
    """
    each = sessions.select(session, F.explode(threads).alias("__t", "__items")).select(session, "__t", F.posexplode("__items").alias("__i", "item")).filter(F.col("item").isNotNull())
    key = [F.coalesce(F.col(f"item.{c}"), F.lit("")) for c in ("updated_at", "run_stamp")]
    place = F.row_number().over(Window.partitionBy(session).orderBy(*key, "__t", "__i"))
    return each.select(session, F.coalesce("item.thread_id", "__t").alias("thread_id"), place.alias("place"), "item")


def normalized_steps(steps: DataFrame, trajectory: list[str], order: list[str], action: str, pointers: list[str], most: int = 200) -> DataFrame:
    """Steps with the event id they point to, the first of several columns that holds one; steps without one go, and of each trajectory the last ``most`` stay."""
    event = F.coalesce(*[_held(F.trim(F.col(p).cast("string"))) for p in pointers])
    rows = steps.withColumn("observation_event_id", event).filter("observation_event_id IS NOT NULL").withColumn(action, trimmed(F.col(action), 120))
    place = F.row_number().over(Window.partitionBy(*trajectory).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__r", place).filter(F.col("__r") <= most).drop("__r")


def backfilled(ledger: DataFrame, working: DataFrame, session: str, order: list[str]) -> DataFrame:
    """The ledger (session, seq, observation, payload) and, for sessions without any event there, an observation for each of their older working items (tool, payload)."""
    missing = working.join(ledger.select(session).distinct(), session, "left_anti")
    seq = F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long")
    made = missing.select(session, seq.alias("seq"), F.coalesce(_held(F.trim("tool")), F.lit("legacy")).alias("observation"), "payload")
    return ledger.select(session, F.col("seq").cast("long").alias("seq"), "observation", "payload").unionByName(made)
