"""Ordered blocks: headers, packing, continuation, reassembly, chunk rules, tables; decisions and scores in JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import structured as J
from loomspan.operators import chunking, layout, sessions
from loomspan.plans.base import Registry

R = Registry()
_LINES = "(SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"


def lines(t):
    return sessions.lines_of(t("documents"), "doc_id", "text")


@R.add("title_headers", f"""
WITH l AS (SELECT *, length(line) < 20 AS tl FROM {_LINES}), n AS (SELECT *, (tl IS DISTINCT FROM lag(tl) OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS nw FROM l),
r AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM n),
h AS (SELECT doc_id, run, CASE WHEN count(*) = 2 THEN first(line ORDER BY line_no) WHEN count(*) > 2 THEN string_agg(line, chr(10) ORDER BY line_no) END AS h FROM r WHERE tl GROUP BY 1, 2)
SELECT r.doc_id, r.line_no::INT AS line_no, last_value(h.h IGNORE NULLS) OVER (PARTITION BY r.doc_id ORDER BY r.line_no ROWS UNBOUNDED PRECEDING) AS header FROM r LEFT JOIN h ON r.doc_id = h.doc_id AND r.run = h.run""")
def title_headers(t):
    return layout.title_headers(lines(t), "doc_id", "line_no", F.length("line") < 20, "line").select("doc_id", "line_no", "header")


@R.add("continued_blocks", """
WITH b AS (SELECT conv_id, turn, role = 'system' AS t, text, length(text) AS n FROM (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY 1, 2)),
j AS (SELECT *, coalesce(NOT t AND NOT lag(t) OVER w AND lag(turn) OVER w + 1 = turn AND (lag(n) OVER w < 200 OR n < 200) AND NOT regexp_matches(rtrim(lag(text) OVER w), '[。.]$'), false) AS j FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum((NOT j)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM j)
SELECT conv_id, min(turn) AS first, min(turn) AS page, count(*) AS parts, md5(string_agg(text, chr(10) ORDER BY turn)) AS text FROM g GROUP BY conv_id, g""")
def continued_blocks(t):
    blocks = t("conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    return layout.merge_continued(blocks.withColumn("page", F.col("turn")), "conv_id", "turn", "page", "text", F.col("role") == "system", 200).withColumn("text", F.md5("text"))


@R.add("packed_groups", f"""
WITH RECURSIVE l AS (SELECT doc_id, line_no, line, length(line) AS n FROM {_LINES}),
p AS (SELECT doc_id, line_no, n AS size, 0 AS g FROM l WHERE line_no = 0 UNION ALL
SELECT l.doc_id, l.line_no, CASE WHEN p.size > 0 AND p.size + l.n > 400 THEN l.n ELSE p.size + l.n END, p.g + (p.size > 0 AND p.size + l.n > 400)::INT FROM p JOIN l ON l.doc_id = p.doc_id AND l.line_no = p.line_no + 1)
SELECT doc_id, g AS "group", count(*)::INT AS n_parts, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text FROM p JOIN l USING (doc_id, line_no) GROUP BY doc_id, g""")
def packed_groups(t):
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    return layout.grouped_parts(t("documents"), "doc_id", parts, lambda p: layout.packed(p, 400)).withColumn("text", F.md5("text"))


@R.add("grown_groups")
def grown_groups(t):
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    return layout.grouped_parts(t("documents"), "doc_id", parts, lambda p: layout.grown(p, 40), "\n\n")


@R.add("merged_short_lines", f"""
WITH l AS (SELECT *, length(line) < 60 AS s FROM {_LINES}), n AS (SELECT *, (NOT (s AND coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY line_no), false)))::INT AS nw FROM l),
g AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM n), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g, line ORDER BY line_no) AS k FROM g)
SELECT doc_id, min(line_no)::INT AS first, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY line_no) FILTER (k = 1)) AS text FROM d GROUP BY doc_id, g""")
def merged_short_lines(t):
    return layout.merge_short_neighbours(lines(t), "doc_id", "line_no", "line", 60).withColumn("text", F.md5("text"))


@R.add("alternating_pattern", """
WITH r AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS p FROM conversations)
SELECT conv_id, count(*) FILTER (role = 'assistant' AND p <> 'assistant') >= 2 AS alternates FROM r GROUP BY 1""")
def alternating_pattern(t):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return t("conversations").groupBy("conv_id").agg(layout.alternates(roles, F.lit("assistant"), 2).alias("alternates"))


@R.add("whole_documents", """
WITH f AS (SELECT conv_id, string_agg(DISTINCT e, ',' ORDER BY e) AS ids FROM (SELECT conv_id, 'e' || turn AS e FROM conversations WHERE role = 'system') GROUP BY 1),
c AS (SELECT conv_id, turn, role, trim(text) AS x, row_number() OVER (PARTITION BY conv_id, trim(text) ORDER BY turn, role) AS k FROM conversations WHERE conv_id IN (SELECT conv_id FROM f))
SELECT conv_id, count(*) AS n_chunks, md5(string_agg('[page=' || turn || ' block_type=' || role || ' title=' || role || ']' || chr(10) || x, chr(10) || chr(10) ORDER BY turn, role) FILTER (k = 1 AND x <> '')) AS content, any_value(ids) AS evidence_ids FROM c JOIN f USING (conv_id) GROUP BY 1""")
def whole_documents(t):
    c = t("conversations")
    found = c.filter("role = 'system'").select("conv_id", F.concat(F.lit("e"), F.col("turn").cast("string")).alias("e"))
    out = layout.whole_documents(c, found, "conv_id", ["turn", "role"], "turn", "role", F.lit(None).cast("string"), "text", "e")
    return out.withColumns({"content": F.md5("content"), "evidence_ids": F.array_join("evidence_ids", ",")})


@R.add("section_chunks")
def section_chunks(t):
    return chunking.chunks(t("documents"), "doc_id", "text", cut=chunking.sections)


@R.add("sentence_chunks")
def sentence_chunks(t):
    return chunking.chunks(t("documents"), "doc_id", "text", cut=chunking.sentence_chunks)


@R.add("lookahead_chunks")
def lookahead_chunks(t):
    return chunking.chunks(t("documents"), "doc_id", "text", cut=chunking.ahead)


@R.add("nested_chunks")
def nested_chunks(t):
    return chunking.nested_chunks(t("documents"), "doc_id", "text")


@R.add("page_tables")
def page_tables(t):
    return layout.page_tables(t("pages"), "page_id", "html")


@R.add("decision_actions", """
SELECT CASE WHEN event_type = 'error' THEN 'clarify' WHEN event_type = 'purchase' THEN 'end' WHEN event_type = 'view' THEN 'answerer' ELSE event_type END AS action, count(*) AS n FROM events GROUP BY 1""")
def decision_actions(t):
    kind = F.when(F.col("event_type") == "error", "clarify").when(F.col("event_type") == "purchase", "end").otherwise("plain")
    action = F.when(F.col("event_type") == "view", "final_answer").otherwise(F.col("event_type"))
    said = F.concat(F.lit("I decide: "), F.to_json(F.struct(kind.alias("decision_type"), action.alias("action"))), F.lit(" done"))
    return t("events").groupBy(J.action_of(J.first_object(said)).alias("action")).agg(F.count("*").alias("n"))


@R.add("unit_scores", """
SELECT CASE WHEN event_type = 'click' THEN 1.0 WHEN event_type = 'error' THEN 0.0 ELSE round(greatest(0.0, least(1.0, value / 100)), 4) END::DOUBLE AS score, count(*) AS n FROM events GROUP BY 1""")
def unit_scores(t):
    said = F.when(F.col("event_type") == "click", " Yes").when(F.col("event_type") == "error", "n/a").otherwise((F.col("value") / 100).cast("string"))
    return t("events").groupBy(F.round(J.unit_score(said), 4).alias("score")).agg(F.count("*").alias("n"))


@R.add("box_agreement", """
WITH i AS (SELECT p_partkey, 15.0 * 20 / (2 * 400 - 300) AS a, 20.0 * least(20 + p_size, 40) / (20.0 * (20 + p_size) + 800 - 20.0 * least(20 + p_size, 40)) AS y FROM part)
SELECT p_partkey, (1 + (y >= 0.5)::INT)::INT AS matched, round((1 + (y >= 0.5)::INT) / 2.0, 6)::DOUBLE AS rate, round((CASE WHEN y >= 0.5 THEN (a + y) / 2 ELSE a END), 6)::DOUBLE AS mean_iou FROM i""")
def box_agreement(t):
    size = F.col("p_size").cast("double")
    box = lambda *v: F.array(*[x.cast("double") if hasattr(x, "cast") else F.lit(float(x)) for x in v])
    left = F.array(box(size, 0, size + 20, 20), box(100, 100, 120, 120 + size))
    right = F.array(box(size + 5, 0, size + 25, 20), box(100, 100, 120, 140))
    out = t("part").select("p_partkey", J.box_agreement(left, right).alias("x"))
    return out.select("p_partkey", "x.matched", F.round("x.rate", 6).alias("rate"), F.round("x.mean_iou", 6).alias("mean_iou"))
