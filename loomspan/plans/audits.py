"""Audits of data sets and runs. Events stand for steps: the user is the case, the type the category."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import rules
from loomspan.functions.text import normalize_query
from loomspan.operators import audit_logs as L
from loomspan.operators import audits as A
from loomspan.plans.base import Registry

R = Registry()


def rounded(df, *cols, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@R.add("prediction_coverage", """
WITH e AS (SELECT DISTINCT doc_id FROM documents), g AS (SELECT DISTINCT doc_id + 100 AS doc_id FROM labels)
SELECT coalesce(e.doc_id, g.doc_id) AS doc_id, CASE WHEN g.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS state FROM e FULL JOIN g ON e.doc_id = g.doc_id WHERE e.doc_id IS NULL OR g.doc_id IS NULL""")
def prediction_coverage(t):
    return A.coverage(t("documents"), t("labels").select((F.col("doc_id") + 100).alias("doc_id")), "doc_id")


@R.add("shard_contiguity", """
WITH s AS (SELECT o_custkey % 7 AS run, o_custkey // 7 AS k, count(*) AS n FROM orders GROUP BY 1, 2),
o AS (SELECT run, k, n, sum(n) OVER (PARTITION BY run ORDER BY k) - n + (run = 3 AND k % 5 = 4)::INT AS off, sum(n) OVER (PARTITION BY run) AS total FROM s),
m AS (SELECT *, off <> coalesce(lag(off + n) OVER (PARTITION BY run ORDER BY off), 0) AS b FROM o)
SELECT run, count(*) AS shards, sum(n)::BIGINT AS rows, sum(b::INT)::BIGINT AS breaks, sum(b::INT) = 0 AND count(DISTINCT total) = 1 AND sum(n) = max(total) AS complete FROM m GROUP BY 1""")
def shard_contiguity(t):
    from pyspark.sql import Window

    s = t("orders").groupBy((F.col("o_custkey") % 7).alias("run"), F.floor(F.col("o_custkey") / 7).alias("k")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("run")
    s = s.withColumn("off", F.sum("n").over(w.orderBy("k")) - F.col("n") + F.when((F.col("run") == 3) & (F.col("k") % 5 == 4), 1).otherwise(0)).withColumn("total", F.sum("n").over(w))
    return A.contiguous_shards(s, "run", "off", "n", "total")


_NQ = "regexp_replace(lower(text), '[\\s,，。.;；:：!！?？、]+', '', 'g')"


@R.add("file_overlaps", f"""
WITH q AS (SELECT DISTINCT md5({_NQ}) AS k FROM documents WHERE lang = 'en') SELECT source, count(*) AS overlap FROM (SELECT DISTINCT source, md5({_NQ}) AS k FROM documents) WHERE k IN (SELECT k FROM q) GROUP BY 1""")
def file_overlaps(t):
    d = t("documents").select("source", "lang", "doc_id", F.md5(normalize_query(F.col("text"))).alias("k"))
    return A.file_overlaps(d.filter("lang = 'en'"), d, "k", "source")


@R.add("case_statistics", f"SELECT lang, count(*) AS cases, count(DISTINCT doc_id) AS unique_ids, count(DISTINCT {_NQ}) AS unique_queries FROM documents GROUP BY 1")
def case_statistics(t):
    return A.case_statistics(t("documents"), "doc_id", normalize_query(F.col("text")), "lang")


@R.add("step_duplicates", """
WITH n AS (SELECT count(*) AS n, count(DISTINCT (role, text)) AS u FROM conversations)
SELECT n AS n_rows, n - u AS duplicates, round((n - u) / n, 9) AS duplicate_rate, (SELECT max(c) FROM (SELECT count(*) AS c FROM conversations GROUP BY conv_id)) AS most_rows_per_case FROM n""")
def step_duplicates(t):
    return rounded(A.step_duplicates(t("conversations"), "conv_id", F.col("role"), F.col("text")), "duplicate_rate", digits=9)


@R.add("strict_summary", """
WITH c AS (SELECT event_type, user_id, count(*) AS s, sum((value < 120)::INT) AS m, sum(value) AS v, bool_and(value < 120) AS ok, sum((value > 200)::INT) AS w FROM events GROUP BY 1, 2)
SELECT event_type, grouping(event_type)::BIGINT AS scope, sum(s)::BIGINT AS steps, count(*) AS cases, round(sum(m) / sum(s), 6) AS match_rate, round(sum(v) / sum(s), 6) AS mean_score, round(avg(ok::INT), 6) AS strict_case_rate, sum(w)::BIGINT AS side_effects
FROM c GROUP BY GROUPING SETS ((), (event_type))""")
def strict_summary(t):
    return rounded(A.strict_summary(t("events"), "user_id", "event_type", F.col("value") < 120, "value", F.col("value") > 200), "match_rate", "mean_score", "strict_case_rate")


@R.add("headroom", """
WITH c AS (SELECT event_type, user_id, avg(value / 500) AS m, bool_and(value < 120) AS a, bool_or(value < 120) AS o FROM events GROUP BY 1, 2),
g AS (SELECT event_type, count(*) AS cases, avg(m) AS ms, avg(a::INT) AS pa, avg(o::INT) AS po, count(*) FILTER (o AND NOT a) AS flaky FROM c GROUP BY 1)
SELECT event_type, cases, round(ms, 6) AS mean_score, round(pa, 6) AS pass_all, round(po, 6) AS pass_any, flaky, round(1 - ms, 6) AS mean_headroom, round(1 - pa, 6) AS pass_headroom FROM g""")
def headroom(t):
    e = t("events").withColumn("s", F.col("value") / 500)
    return rounded(A.headroom(e, "user_id", "event_type", "s", F.col("value") < 120), "mean_score", "pass_all", "pass_any", "mean_headroom", "pass_headroom")


@R.add("failure_reasons", """
WITH r AS (SELECT user_id, unnest(list_filter([CASE WHEN value > 120 THEN 'slow' END, CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN CAST(props->>'k' AS INT) % 2 = 1 THEN 'odd' END], lambda x: x IS NOT NULL)) AS reason FROM events)
SELECT reason, count(*) AS occurrences, count(DISTINCT user_id) AS cases FROM r GROUP BY 1""")
def failure_reasons(t):
    k = F.get_json_object("props", "$.k").cast("int")
    reasons = F.array_compact(F.array(F.when(F.col("value") > 120, "slow"), F.when(F.col("event_type") == "error", "error"), F.when(k % 2 == 1, "odd")))
    return A.reason_counts(t("events"), "user_id", reasons)


@R.add("family_stats", """
WITH c AS (SELECT lang, bool_and(quality = 1 AND toxic = 0) AS s, bool_and(quality = 1) AS r FROM documents JOIN labels USING (doc_id) GROUP BY lang, source),
g AS (SELECT lang, count(*) AS cases, avg(s::INT) AS sp, avg(r::INT) AS rp, count(*) FILTER (NOT s) AS sf, count(*) FILTER (NOT r) AS rf, count(*) FILTER (NOT s AND r) AS ao FROM c GROUP BY 1)
SELECT lang, cases, round(sp, 6) AS strict_pass_all, round(rp, 6) AS route_pass_all, sf AS strict_failed, rf AS route_failed, ao AS argument_only, round(CASE WHEN sf > 0 THEN ao / sf ELSE 0.0 END, 6) AS argument_only_share FROM g""")
def family_stats(t):
    rows = t("documents").select("doc_id", "lang", "source").join(t("labels"), "doc_id")
    cases = rows.groupBy("lang", "source").agg(F.bool_and((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("s"), F.bool_and(F.col("quality") == 1).alias("r"))
    return rounded(A.family_stats(cases, "lang", F.col("s"), F.col("r")), "strict_pass_all", "route_pass_all", "argument_only_share")


@R.add("action_changes", """
WITH s AS (SELECT user_id % 5 AS stratum, user_id, list_distinct(list(event_type) FILTER (event_id % 2 = 0 AND value > 60)) AS a, list_distinct(list(event_type) FILTER (event_id % 2 = 1 AND value > 60)) AS b FROM events GROUP BY 1, 2),
n AS (SELECT stratum, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s), m AS (SELECT stratum, len(a) AS c, len(b) AS r, len(a) - len(list_intersect(a, b)) AS i, len(b) - len(list_intersect(a, b)) AS o FROM n)
SELECT stratum, grouping(stratum)::BIGINT AS scope, sum(c)::BIGINT AS candidate_hits, sum(r)::BIGINT AS reference_hits, sum(i)::BIGINT AS introduced, sum(o)::BIGINT AS removed, count(*) FILTER (i > 0 OR o > 0) AS changed_cases, (sum(c) - sum(r))::BIGINT AS net_added FROM m GROUP BY GROUPING SETS ((), (stratum))""")
def action_changes(t):
    side = lambda k: F.collect_set(F.when((F.col("event_id") % 2 == k) & (F.col("value") > 60), F.col("event_type")))  # noqa: E731  at most one entry a type
    cases = t("events").groupBy((F.col("user_id") % 5).alias("stratum"), "user_id").agg(side(0).alias("a"), side(1).alias("b"))
    return A.action_changes(cases, "stratum", F.col("a"), F.col("b"))


@R.add("arm_scopes", """
WITH p AS (SELECT l_returnflag, l_linestatus, l_discount > 0.05 AS b, l_tax > 0.04 AS r FROM lineitem)
SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS scope, count(*) AS pairs, round(avg(b::INT), 6) AS base_rate, round(avg(r::INT), 6) AS reference_rate, count(*) FILTER (b AND r) AS "both", count(*) FILTER (NOT b AND NOT r) AS neither,
count(*) FILTER (b AND NOT r) AS base_only, count(*) FILTER (NOT b AND r) AS reference_only FROM p GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))""")
def arm_scopes(t):
    return rounded(A.arm_scopes(t("lineitem"), "l_returnflag", "l_linestatus", F.col("l_discount") > 0.05, F.col("l_tax") > 0.04), "base_rate", "reference_rate")


@R.add("bundle_checks", """
WITH b AS (SELECT doc_id // 3 AS bundle, count(*) AS size, count(DISTINCT doc_id % 3) AS n_roles, count(DISTINCT coalesce(lang, '')) > 1 AS vl, count(DISTINCT coalesce(source, '')) > 1 AS vs FROM documents GROUP BY 1)
SELECT bundle, size, n_roles, array_to_string(list_filter([CASE WHEN vl THEN 'lang' END, CASE WHEN vs THEN 'source' END], lambda x: x IS NOT NULL), ',') AS varying, size = 3 AND n_roles = 3 AND NOT vl AND NOT vs AS ok FROM b""")
def bundle_checks(t):
    d = t("documents").select(F.floor(F.col("doc_id") / 3).alias("bundle"), (F.col("doc_id") % 3).alias("role"), "lang", "source")
    return A.bundle_checks(d, "bundle", "role", 3, ["lang", "source"])


@R.add("rule_violations", """
SELECT page_id, unnest(list_filter([CASE WHEN NOT coalesce(starts_with(url, 'https://'), false) THEN 'https' END, CASE WHEN NOT coalesce(length(html) >= 1200, false) THEN 'length' END, CASE WHEN NOT coalesce(contains(html, '<article'), false) THEN 'article' END], lambda x: x IS NOT NULL)) AS rule FROM pages""")
def rule_violations(t):
    rules = [("https", F.col("url").startswith("https://")), ("length", F.length("html") >= 1200), ("article", F.col("html").contains("<article"))]
    return A.violations(t("pages"), "page_id", rules)


@R.add("repeated_ids", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(t):
    return A.repeated_ids(t("conversations"), "conv_id")


@R.add("grid_completeness", """
WITH g AS (SELECT lang, source FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT DISTINCT source FROM documents)), s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT lang, source, coalesce(n, 0) AS n FROM g LEFT JOIN s USING (lang, source) WHERE coalesce(n, 0) <> 1""")
def grid_completeness(t):
    d = t("documents").select("doc_id", "lang", "source")
    return A.expected_grid(d, d, d, "lang", "source")


@R.add("score_histogram", "SELECT round(l_discount, 2) AS score, count(*) AS n FROM lineitem GROUP BY 1")
def score_histogram(t):
    return A.score_histogram(t("lineitem"), F.col("l_discount"), 2)


@R.add("reward_range", """
SELECT count(*) AS n, round(min(x), 6) AS least, round(max(x), 6) AS most FROM (SELECT 0.7 * l_discount + coalesce(0.3 * CASE WHEN l_linestatus = 'O' THEN l_tax END, 0) AS x FROM lineitem)""")
def reward_range(t):
    rows = t("lineitem").select("l_discount", F.when(F.col("l_linestatus") == "O", F.col("l_tax")).alias("tax"))
    return rounded(A.weighted_range(rows, {"l_discount": 0.7, "tax": 0.3}), "least", "most")


@R.add("advantage_stats", "SELECT count(*) AS n, round(avg(v), 6) AS mean, round(avg(abs(v)), 6) AS mean_size, round(stddev_pop(v), 6) AS deviation, round(avg((v > 0)::INT), 6) AS positive FROM (SELECT value - 50 AS v FROM events)")
def advantage_stats(t):
    return rounded(A.advantage_stats(t("events").select((F.col("value") - 50).alias("v")), "v"), "mean", "mean_size", "deviation", "positive")


@R.add("trial_stats", """
WITH g AS (SELECT o_orderpriority AS c, count(*) AS n, avg(o_totalprice) AS m, coalesce(stddev_samp(o_totalprice), 0) AS d, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1)
SELECT c AS o_orderpriority, n AS trials, round(m, 4) AS mean, round(d, 4) AS deviation, round(p50, 4) AS p50, round(p95, 4) AS p95, round(100 * d / m, 4) AS cv_percent FROM g""")
def trial_stats(t):
    return rounded(A.trial_stats(t("orders"), "o_orderpriority", "o_totalprice"), "mean", "deviation", "p50", "p95", "cv_percent", digits=4)


@R.add("promote_checkpoint", """
WITH g AS (SELECT user_id, count(*) AS n, round(avg(value), 6) AS m, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1)
SELECT user_id, n, m, e FROM g WHERE n >= 20 AND e >= 1 ORDER BY m DESC, e, n DESC, user_id LIMIT 1""")
def promote_checkpoint(t):
    g = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("m"), F.count_if(F.col("event_type") == "error").alias("e"))
    return A.promote(g, [F.col("n") >= 20, F.col("e") >= 1], [F.desc("m"), F.asc("e"), F.desc("n"), F.asc("user_id")])


@R.add("ladder_gates", """
WITH g AS (SELECT l_quantity::INT AS rung, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1)
SELECT rung, mean, lead(mean) OVER (ORDER BY rung) AS next, lead(mean) OVER (ORDER BY rung) > mean AS rises FROM g""")
def ladder_gates(t):
    g = t("lineitem").groupBy(F.col("l_quantity").cast("int").alias("rung")).agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"))
    return A.adjacent_gates(g, "rung", "mean")


@R.add("event_audit", """
WITH b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS sessions, count(DISTINCT CASE WHEN user_id IN (SELECT user_id FROM b) THEN user_id END) AS with_error FROM events GROUP BY 1""")
def event_audit(t):
    return L.event_counts(t("events"), "user_id", "event_type", "error")


@R.add("query_aspects", """
WITH x AS (SELECT regexp_replace(lower(p_name), '\\s+', '', 'g') AS f, lower(p_name) AS l FROM part)
SELECT CASE WHEN contains(f, 'redbolt') THEN 'both' WHEN contains(f, 'red') OR contains(f, 'blue') THEN 'colour' WHEN contains(f, 'bolt') THEN 'part' ELSE 'general' END AS aspect,
array_to_string(list_filter([CASE WHEN contains(l, 'red') THEN 'red' END, CASE WHEN contains(l, 'bolt') OR contains(l, 'nut') THEN 'part' END], lambda x: x IS NOT NULL), ',') AS intents, count(*) AS n FROM x GROUP BY 1, 2""")
def query_aspects(t):
    first = rules.first_rule(F.col("p_name"), [("both", ("redbolt",)), ("colour", ("red", "blue")), ("part", ("bolt",))])
    every = rules.all_rules(F.col("p_name"), [("red", ("red",)), ("part", ("bolt", "nut"))])
    return t("part").groupBy(first.alias("aspect"), F.array_join(every, ",").alias("intents")).agg(F.count("*").alias("n"))


@R.add("weighted_term_overlap", """
SELECT p_partkey, round(s, 6) AS score FROM (SELECT p_partkey, CASE WHEN p_size > 45 THEN 0.0 ELSE greatest(CASE WHEN contains(lower(p_name), 'red') THEN 1.5 ELSE 0.0 END, CASE WHEN contains(lower(p_type), 'red') THEN 0.8 ELSE 0.0 END)
+ greatest(CASE WHEN contains(lower(p_name), 'economy') THEN 1.5 ELSE 0.0 END, CASE WHEN contains(lower(p_type), 'economy') THEN 0.8 ELSE 0.0 END) + CASE WHEN lower(p_brand) = 'brand#3' THEN 4.0 ELSE 0.0 END END::DOUBLE AS s FROM part) WHERE s > 0""")
def weighted_term_overlap(t):
    own = rules.weighted_rules([(F.lower("p_brand") == "brand#3", 4.0)])
    total = F.when(F.col("p_size") > 45, 0.0).otherwise(rules.term_overlap(["red", "economy"], {"p_name": 1.5, "p_type": 0.8}) + own)
    return t("part").select("p_partkey", F.round(total, 6).alias("score")).filter("score > 0")
