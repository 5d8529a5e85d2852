"""Gates, metric blocks and audit tables over evaluation runs; events stand for attempts, users for cases, orders for scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import gates as G
from loomspan.plans.base import Registry

R = Registry()


@R.add("metric_blocks", """
WITH o AS (SELECT coalesce(o_orderpriority, 'unknown') AS p, coalesce(o_orderstatus, 'unknown') AS s, (o_totalprice > 100000)::INT::DOUBLE AS e, (o_totalprice > 200000)::INT::DOUBLE AS x FROM orders)
SELECT CASE grouping(p, s) WHEN 3 THEN 'overall' WHEN 1 THEN 'o_orderpriority' ELSE 'o_orderstatus' END AS scope, CASE grouping(p, s) WHEN 3 THEN 'all' WHEN 1 THEN p ELSE s END AS value,
count(*) AS n, round(avg(e), 9) AS exact_rate, round(avg(x), 9) AS strict_rate FROM o GROUP BY GROUPING SETS ((), (p), (s))""")
def metric_blocks(t):
    out = G.metric_blocks(t("orders"), ["o_orderpriority", "o_orderstatus"], F.col("o_totalprice") > 100000, F.col("o_totalprice") > 200000)
    return out.withColumns({c: F.round(c, 9) for c in ("exact_rate", "strict_rate")})


@R.add("prediction_stats", """
WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS d, max(value) > 400 AS t, CASE WHEN max(value) > 450 THEN 'high' END AS e FROM events GROUP BY 1)
SELECT coalesce(e, 'none') AS error, count(*) AS cases, count(*) FILTER (d = 0) AS empty, sum(d)::BIGINT AS decisions, count(*) FILTER (t) AS truncated FROM c GROUP BY 1""")
def prediction_stats(t):
    c = t("events").groupBy("user_id").agg(F.collect_list(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("d"), F.max("value").alias("m"))
    return G.prediction_stats(c, F.col("d"), F.col("m") > 400, F.when(F.col("m") > 450, "high"))


@R.add("operational_metrics", """
WITH u AS (SELECT DISTINCT user_id FROM events), a AS (SELECT u.user_id, e.value > 50 AS v, e.event_id % 7 = 0 AS c FROM u LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = 'purchase')
SELECT count(*) AS attempts, round(avg(coalesce(v, false)::INT), 9) AS json_valid_rate, round(avg(coalesce(c, false)::INT), 9) AS clipped_rate FROM a""")
def operational_metrics(t):
    item = F.when(F.col("event_type") == "purchase", F.struct((F.col("value") > 50).alias("v"), (F.col("event_id") % 7 == 0).alias("c")))
    out = G.operational_metrics(t("events").groupBy("user_id").agg(F.collect_list(item).alias("a")), "a", "v", "c")
    return out.withColumns({c: F.round(c, 9) for c in ("json_valid_rate", "clipped_rate")})


@R.add("operational_validity", """
WITH r AS (SELECT event_type AS run, count(DISTINCT user_id) AS cases, avg((value > 20)::INT) AS v, avg((value > 300)::INT) AS c FROM events GROUP BY 1)
SELECT run, cases = (SELECT count(DISTINCT user_id) FROM events) AS complete, v >= 0.5 AS readable, c <= 0.05 AS uncut, cases = (SELECT count(DISTINCT user_id) FROM events) AND v >= 0.5 AND c <= 0.05 AS valid FROM r""")
def operational_validity(t):
    e = t("events")
    runs = e.groupBy(F.col("event_type").alias("run")).agg(F.countDistinct("user_id").alias("n"), F.avg((F.col("value") > 20).cast("int")).alias("v"), F.avg((F.col("value") > 300).cast("int")).alias("c"))
    return G.operational_validity(runs, "run", F.col("n"), e.select("user_id").distinct().count(), F.col("v"), F.col("c"), 0.5)


@R.add("scoped_support", """
WITH c AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS w, CASE WHEN o_orderstatus <> 'P' THEN avg(o_totalprice) END AS m FROM orders GROUP BY 1, 2)
SELECT round(coalesce(sum(w * coalesce(m, 0.0)) / nullif(sum(w), 0), 0.0), 4) AS support, sum(w)::BIGINT AS groups FROM c WHERE p LIKE '1%' OR s = 'P'""")
def scoped_support(t):
    cells = t("orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("w"), F.avg("o_totalprice").alias("a")).withColumn("m", F.when(F.col("o_orderstatus") != "P", F.col("a")))
    return G.scoped_support(cells, F.col("o_orderpriority").startswith("1") | (F.col("o_orderstatus") == "P"), "w", "m").withColumn("support", F.round("support", 4))


@R.add("development_gate", """
WITH g AS (SELECT o_orderpriority AS p, grouping(o_orderpriority) = 1 AS overall, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS b, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS c FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY GROUPING SETS ((o_orderpriority), ()))
SELECT p AS o_orderpriority, overall, round(b, 4) AS base, round(c, 4) AS candidate, round(c - b, 4) AS delta, coalesce(CASE WHEN overall THEN c - b >= -500 ELSE c - b >= -1000 END, false) AS passed FROM g""")
def development_gate(t):
    out = G.development_gate(t("orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "F", "O", -500.0, 1000.0)
    return out.withColumns({c: F.round(c, 4) for c in ("base", "candidate", "delta")})


@R.add("seed_gate", """
WITH s AS (SELECT user_id % 5 AS seed, avg(value) - 100 AS d FROM events GROUP BY 1)
SELECT count(*) AS seeds, round(avg(d), 6) AS mean_delta, count(*) FILTER (d > 0) AS wins, count(*) = 5 AND avg(d) >= 0 AND count(*) FILTER (d > 0) >= 4 AS passed FROM s""")
def seed_gate(t):
    e = t("events").select((F.col("user_id") % 5).alias("seed"), (F.col("value") - 100).alias("d"))
    return G.seed_gate(e, "seed", "d", 5, 0.0, 4).withColumn("mean_delta", F.round("mean_delta", 6))


@R.add("model_separation", """
WITH m AS (SELECT event_type, avg(value) AS v FROM events GROUP BY 1), p(weak, strong) AS (VALUES ('error', 'view'), ('view', 'click'), ('click', 'missing'))
SELECT weak, strong, round(a.v, 6) AS weak_mean, round(b.v, 6) AS strong_mean, round(b.v - a.v, 6) AS gap, coalesce(b.v - a.v >= 0.0, false) AS separated FROM p LEFT JOIN m a ON a.event_type = weak LEFT JOIN m b ON b.event_type = strong""")
def model_separation(t):
    out = G.separation(t("events"), "event_type", "value", ["error", "view", "click", "missing"], 0.0)
    return out.withColumns({c: F.round(c, 6) for c in ("weak_mean", "strong_mean", "gap")})


@R.add("run_audit_table", """
SELECT o.o_orderkey, o_orderstatus AS expected, max(l_linestatus) FILTER (l_linenumber = 1) AS "1", min(l_linestatus) FILTER (l_linenumber = 2) AS "2",
coalesce((min(l_linestatus) FILTER (l_linenumber = 1) = o_orderstatus)::INT, 0) + coalesce((min(l_linestatus) FILTER (l_linenumber = 2) = o_orderstatus)::INT, 0) AS agree
FROM orders o LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2) l ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def run_audit_table(t):
    ref = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    res = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("string").alias("run"), F.col("l_linestatus").alias("v"))
    return G.audit_table(ref, res, "o_orderkey", "run", "v", ["1", "2"])


@R.add("rescored_samples", """
SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 0.5 * l_quantity END), 6)::DOUBLE AS rescored FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def rescored_samples(t):
    steps = t("orders").filter("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    out = G.rescored(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), steps, ["l_orderkey"], F.when(F.col("o_orderpriority").startswith("1"), 0.5 * F.col("l_quantity")))
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("rescored"), 6).cast("double").alias("rescored"))


@R.add("two_score_audit", """
SELECT event_type, count(*) AS n, round(avg(value / 100), 6) AS first_mean, round(avg((user_id % 10) / 10.0), 6) AS second_mean, count(*) FILTER (value / 100 < 0.8) AS first_low, count(*) FILTER ((user_id % 10) / 10.0 < 0.8) AS second_low,
count(*) FILTER (value / 100 < 0.8 AND (user_id % 10) / 10.0 < 0.8) AS both_low FROM events GROUP BY 1""")
def two_score_audit(t):
    e = t("events").select("event_type", (F.col("value") / 100).alias("a"), ((F.col("user_id") % 10) / 10).alias("b"))
    return G.two_score_audit(e, "event_type", "a", "b").withColumns({c: F.round(c, 6) for c in ("first_mean", "second_mean")})


@R.add("training_log_summary", """
WITH l AS (SELECT user_id AS run, event_id AS step, value AS loss, CASE WHEN event_type = 'purchase' THEN value * 2 END AS reward, event_id % 60 AS rt FROM events)
SELECT run, max(step) AS last_step, count(reward) AS reward_steps, round(avg(loss) FILTER (reward IS NOT NULL), 6) AS mean_loss, round(arg_min(reward, step) FILTER (reward IS NOT NULL), 6) AS first_reward, round(arg_max(reward, step) FILTER (reward IS NOT NULL), 6) AS last_reward, sum(rt)::BIGINT AS runtime FROM l GROUP BY 1""")
def training_log_summary(t):
    log = t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"), F.when(F.col("event_type") == "purchase", F.col("value") * 2).alias("reward"), (F.col("event_id") % 60).alias("rt"))
    out = G.log_summary(log, "run", "step", "loss", "reward", "rt")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_loss", "first_reward", "last_reward")})


@R.add("family_order", """
WITH c AS (SELECT event_type, user_id, min(event_id) AS o, count(*) AS k FROM events GROUP BY 1, 2) SELECT event_type, min(o) AS first_seen, max(k) AS max_steps FROM c GROUP BY 1""")
def family_order(t):
    return G.family_order(t("events"), "event_type", "user_id", "event_id")


@R.add("image_labels", """
SELECT l_orderkey, count(*) AS boxes, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS labels, array_to_string(list_filter(['A', 'N', 'X'], lambda x: NOT list_contains(list(DISTINCT l_returnflag), x)), ',') AS missing FROM lineitem GROUP BY 1""")
def image_labels(t):
    out = G.image_labels(t("lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "X"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("labels", "missing")})
