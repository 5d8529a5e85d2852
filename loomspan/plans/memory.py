"""Session memory, thread merges, supervision and schemas over event logs, conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import supervision
from loomspan.plans.base import Registry
from loomspan.sources import schemas
from loomspan.streaming import memory

R = Registry()


def event_steps(events: DataFrame) -> DataFrame:
    """Events of users as steps: the type is the tool, its properties the input, and what it found is told from its value."""
    label = F.concat(F.col("event_type"), F.lit(" "), F.get_json_object("props", "$.k"))
    found = F.when(F.col("value").isNull(), F.lit("{}")).otherwise(F.to_json(F.struct(
        F.concat("event_type", F.lit(" of "), F.floor("value").cast("string")).alias("summary"),
        F.when(F.col("value") > 50, F.array(F.lit("a"), F.lit("b"))).alias("references"),
        F.struct(F.when(F.col("value") > 80, F.concat(F.lit("above 80 in "), "event_type")).alias("recommendation")).alias("evaluation"),
        F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
    )))
    given = F.when(F.col("event_type") == "purchase", F.to_json(F.struct(F.concat(F.lit("buy "), F.get_json_object("props", "$.k")).alias("query")))).otherwise(F.lit("{}"))
    # the two timestamps of one instant are told apart by the id
    return memory.working_items(events, "user_id", ["ts", "event_id"], F.col("event_type"), given, found, label)


_K = "json_extract_string(props, '$.k')"
_ITEMS = f"""it AS (SELECT user_id, ts, event_id, event_type AS tool, CASE WHEN event_type = 'purchase' THEN coalesce('buy ' || {_K}, event_type || ' ' || {_K}, '') ELSE coalesce(event_type || ' ' || {_K}, '') END AS goal,
list_filter([CASE WHEN value IS NOT NULL THEN '{{"type":"summary","text":"' || event_type || ' of ' || floor(value)::BIGINT || '"}}' END, CASE WHEN value > 80 THEN '{{"type":"evaluation","field":"recommendation","text":"above 80 in ' || event_type || '"}}' END], lambda x: x IS NOT NULL) AS points,
list_filter([CASE WHEN value > 50 THEN 'references:2' END, CASE WHEN value > 80 THEN 'evaluation_report' END], lambda x: x IS NOT NULL) AS artifacts,
CASE WHEN event_type = 'error' AND value IS NOT NULL THEN 'error' ELSE 'ok' END AS status, coalesce(event_type || ' ' || {_K}, '') AS said FROM events)"""


@R.add("working_items", f"WITH {_ITEMS} SELECT event_id, tool, goal, array_to_string(points, '|') AS points, array_to_string(artifacts, '|') AS artifacts, status FROM it")
def working_items(t):
    return event_steps(t("events")).select("event_id", "tool", "goal", F.array_join("points", "|").alias("points"), F.array_join("artifacts", "|").alias("artifacts"), "status")


@R.add("session_memory", f"""WITH {_ITEMS}, pt AS (SELECT user_id, ts, event_id, unnest(points) AS v, unnest(range(len(points))) AS pos FROM it),
firsts AS (SELECT user_id, 'tools' AS k, 8 AS most, tool AS v, min((ts, event_id, 0)) AS w FROM it WHERE tool <> '' GROUP BY user_id, tool UNION ALL SELECT user_id, 'facts', 10, v, min((ts, event_id, pos)) FROM pt GROUP BY user_id, v
UNION ALL SELECT user_id, 'completed', 10, tool || ': ' || goal, min((ts, event_id, 0)) FROM it GROUP BY user_id, tool || ': ' || goal),
f AS (SELECT user_id, k, string_agg(v, '|' ORDER BY w) AS vs FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY w) AS r FROM firsts) WHERE r <= most GROUP BY 1, 2),
tk AS (SELECT user_id, string_agg(v, '|' ORDER BY w DESC) AS vs FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC) AS r FROM (SELECT user_id, v, max((ts, event_id, -pos)) AS w FROM pt GROUP BY 1, 2)) WHERE r <= 10 GROUP BY 1),
wk AS (SELECT user_id, string_agg(tool || ': ' || goal, '|' ORDER BY ts, event_id) AS vs FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM it) WHERE r <= 5 GROUP BY 1),
n AS (SELECT user_id, count(*) AS steps, arg_max(goal, (ts, event_id)) AS goal, arg_max(tool, (ts, event_id)) AS tool, arg_max(status, (ts, event_id)) AS status, arg_max(said, (ts, event_id)) AS focus FROM it GROUP BY 1)
SELECT n.*, coalesce(a.vs, '') AS tools, coalesce(b.vs, '') AS facts, coalesce(c.vs, '') AS completed, coalesce(tk.vs, '') AS takeaways, coalesce(wk.vs, '') AS working FROM n LEFT JOIN f a ON a.user_id = n.user_id AND a.k = 'tools' LEFT JOIN f b ON b.user_id = n.user_id AND b.k = 'facts'
LEFT JOIN f c ON c.user_id = n.user_id AND c.k = 'completed' LEFT JOIN tk ON tk.user_id = n.user_id LEFT JOIN wk ON wk.user_id = n.user_id""")
def session_memory(t):
    folded = memory.session_memory(event_steps(t("events")), "user_id", ["ts", "event_id"])
    return folded.select("user_id", "steps", "goal", "tool", "status", *[F.array_join(c, "|").alias(c) for c in ("focus", "tools", "facts", "completed", "takeaways", "working")])


@R.add("merged_threads", """SELECT conv_id, thread_id, row_number() OVER (PARTITION BY conv_id ORDER BY stamp, thread_id, turn) AS place, turn FROM (
SELECT conv_id, coalesce(role, '') AS thread_id, CASE WHEN length(text) % 3 = 0 THEN '' ELSE lpad((length(text) % 50)::VARCHAR, 4, '0') END AS stamp, turn FROM conversations WHERE text IS NOT NULL)""")
def merged_threads(t):
    """Each role's turns are a thread; times are missing in some of them and equal in others."""
    size = F.length("text") % 50
    item = F.struct(F.lit(None).cast("string").alias("thread_id"), F.when(F.length("text") % 3 != 0, F.lpad(size.cast("string"), 4, "0")).alias("updated_at"), F.lit(None).cast("string").alias("run_stamp"), "turn")
    rows = t("conversations").filter("text IS NOT NULL").select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.struct("turn", item.alias("item")).alias("x"))
    lists = rows.groupBy("conv_id", "role").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias("items"))
    threads = lists.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "items"))).alias("threads"))
    return memory.merged_threads(threads, "conv_id", "threads").select("conv_id", "thread_id", "place", F.col("item.turn").alias("turn"))


@R.add("normalized_steps", """SELECT conv_id, turn, event, action FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM (SELECT conv_id, turn,
coalesce(nullif(trim(split_part(text, ' ', 1)), ''), nullif(trim(CASE WHEN role = 'system' THEN 'sys' END), '')) AS event, CASE WHEN length(trim(text)) > 120 THEN substr(trim(text), 1, 120) || '…' ELSE coalesce(trim(text), '') END AS action FROM conversations) WHERE event IS NOT NULL) WHERE r <= 2""")
def normalized_steps(t):
    rows = t("conversations").select("conv_id", "turn", F.col("text").alias("action"), F.split_part("text", F.lit(" "), F.lit(1)).alias("observation_id"), F.when(F.col("role") == "system", "sys").alias("pointer"))
    return memory.normalized_steps(rows, ["conv_id"], ["turn"], "action", ["observation_id", "pointer"], 2).select("conv_id", "turn", F.col("observation_event_id").alias("event"), "action")


@R.add("supervision_audit")
def supervision_audit(t):
    import public_tokenizers

    return supervision.supervision_audit(t("conversations"), "conv_id", "turn", "role", "text", public_tokenizers.path("byte_bpe_50k.json"), 512)


_DEF = '{"type":"object","required":["lang"],"properties":{"lang":{"type":"string","description":" code "},"up":{"$ref":"#/defs/doc"}}}'


@R.add("flattened_schemas", """
WITH d AS (SELECT doc_id, coalesce(source, 'none') AS s, n_chars FROM documents)
SELECT doc_id, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS place, unnest([s, 'body', 'body.size', 'body.parts', 'body.parts[].lang', 'body.parts[].up', 'doc', 'doc.lang']) AS path, unnest(['string', 'object', 'integer | null', 'object[]', 'string', 'any', 'object', 'string']) AS type,
unnest([true, false, true, false, true, false, false, true]) AS required, unnest([NULL, NULL, n_chars::VARCHAR, NULL, NULL, NULL, NULL, NULL]) AS "default", unnest(['one of a, b', '', 'characters', '', 'code', '', '', 'code']) AS description FROM d
UNION ALL SELECT doc_id, 9, 'doc.up', 'any', false, NULL, '' FROM d""")
def flattened_schemas(t):
    """A schema for each document: its source and size name and fill fields, and a definition refers to itself."""
    d = t("documents").withColumn("s", F.coalesce("source", F.lit("none")))
    size = F.concat(F.lit('{"anyOf":[{"type":"integer"},{"type":"null"},{"type":"integer"}],"description":"characters","default":'), F.coalesce(F.col("n_chars").cast("string"), F.lit("null")), F.lit("}"))
    body = F.concat(F.lit('{"type":"object","required":["size"],"properties":{"size":'), size, F.lit(',"parts":{"type":"array","items":{"$ref":"#/defs/doc"}}}}'))
    schema = F.concat(F.lit('{"required":["'), "s", F.lit('"],"properties":{"'), "s", F.lit('":{"type":"string","enum":["a","b"]},"body":'), body, F.lit(',"doc":{"$ref":"#/defs/doc"}}}'))
    return schemas.flattened(d.select("doc_id", schema.alias("schema"), F.create_map(F.lit("#/defs/doc"), F.lit(_DEF)).alias("refs")), "doc_id", "schema", "refs")
