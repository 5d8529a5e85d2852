"""Audits of session logs: many nested JSON files, or events, to counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = "struct<action:string>"
EVENT = "struct<event_type:string,observation:string,payload:struct<action:string,success:boolean,ok:boolean,error:string>>"
SESSION = f"threads map<string,struct<last_image_path:string,query_trajectories:map<string,struct<steps:array<{STEP}>>>,raw_ledger:array<{EVENT}>>>"


def parsed_sessions(files: DataFrame, text: str = "text") -> DataFrame:
    """Files with their session as a struct, and whether it could be read. A file that holds no JSON object is counted, not raised."""
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    return files.withColumns({"parsed": ok, "session": F.when(ok, F.from_json(text, SESSION))})


def action_name(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def session_counts(files: DataFrame, text: str = "text") -> DataFrame:
    """(what, name, n): files read and not, threads, steps by action, sequences of actions, events by type, observations by action and outcome.

    One pass over the files makes all rows; only counts are shuffled, and they are summed up before.
    """
    s = parsed_sessions(files, text)
    threads = F.map_values(F.coalesce(F.col("session.threads"), F.create_map().cast("map<string,struct<last_image_path:string,query_trajectories:map<string,struct<steps:array<struct<action:string>>>>,raw_ledger:array<" + EVENT + ">>>")))
    tracks = F.flatten(F.transform(threads, lambda t: F.coalesce(F.map_values(t["query_trajectories"]), F.array().cast(f"array<struct<steps:array<{STEP}>>>"))))
    events = F.flatten(F.transform(threads, lambda t: F.coalesce(t["raw_ledger"], F.array().cast(f"array<{EVENT}>"))))
    row = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    steps = lambda t: F.filter(F.coalesce(t["steps"], F.array().cast(f"array<{STEP}>")), lambda x: x.isNotNull())
    outcome = lambda p: F.when(F.coalesce(p["success"], p["ok"]), "success").when(~F.coalesce(p["success"], p["ok"]), "failure").when(F.coalesce(p["error"], F.lit("")) != "", "failure").otherwise("unknown")
    kind = lambda e: F.upper(F.trim(F.coalesce(F.nullif(e["event_type"], F.lit("")), F.lit("unknown"))))
    rows = F.concat(
        F.array(row("file", F.when(F.col("parsed"), "parsed").otherwise("unreadable"))),
        F.transform(threads, lambda t: row("thread", F.when(F.coalesce(F.trim(t["last_image_path"]), F.lit("")) != "", "with image").otherwise("plain"))),
        F.flatten(F.transform(tracks, lambda t: F.transform(steps(t), lambda x: row("step", action_name(x["action"]))))),
        F.transform(F.filter(tracks, lambda t: F.size(steps(t)) > 0), lambda t: row("sequence", F.array_join(F.transform(steps(t), lambda x: action_name(x["action"])), " -> "))),
        F.transform(events, lambda e: row("event", kind(e))),
        F.transform(F.filter(events, lambda e: kind(e) == "OBSERVATION"), lambda e: row("observation", F.concat_ws(":", action_name(F.coalesce(e["payload"]["action"], e["observation"])), outcome(e["payload"])))),
    )
    return s.select(F.explode(rows).alias("r")).groupBy("r.what", "r.name").agg(F.count("*").alias("n"))


def cohorts(files: DataFrame, path: str, rules: dict[str, str], other: str) -> DataFrame:
    """Files by cohort, told by parts of their names in order."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    cohort = F.coalesce(*[F.when(F.contains(name, F.lit(part)), label) for part, label in rules.items()], F.lit(other))
    return files.groupBy(cohort.alias("cohort")).agg(F.count("*").alias("n"))


def event_counts(events: DataFrame, session: str, kind: str, error_kind: str) -> DataFrame:
    """For each event type: events, sessions that have it, and sessions with it that also have an error; partial counts per session first."""
    per = events.groupBy(session, kind).agg(F.count("*").alias("n"))
    bad = events.filter(F.col(kind) == error_kind).select(session).distinct().withColumn("__e", F.lit(1))
    return per.join(bad, session, "left").groupBy(kind).agg(F.sum("n").alias("events"), F.count("*").alias("sessions"), F.count("__e").alias("with_error"))
