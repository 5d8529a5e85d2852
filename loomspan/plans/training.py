"""Data set construction, scoring, comparison, gates and session queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.functions.text import benchmark_text, selection_key
from loomspan.operators import datasets as D
from loomspan.operators import evaluation as E
from loomspan.operators import rewards as W
from loomspan.operators import sessions as S
from loomspan.plans.base import Registry

R = Registry()


@R.add("exact_dedupe_first", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_dedupe_first(t):
    return D.keep_first_key(t("documents"), F.sha2(F.col("text"), 256), "doc_id").select("doc_id", "copies")


@R.add("benchmark_overlap_exact", """
SELECT count(DISTINCT b.item_id) AS items, count(*) AS pairs FROM benchmark b JOIN documents d ON regexp_replace(lower(b.text), '[^\\p{L}\\p{N}_]+', '', 'g') = regexp_replace(lower(d.text), '[^\\p{L}\\p{N}_]+', '', 'g')""")
def benchmark_overlap_exact(t):
    b = t("benchmark").select("item_id", F.md5(benchmark_text(F.col("text"))).alias("k"))
    d = t("documents").select(F.md5(benchmark_text(F.col("text"))).alias("k"))
    return b.join(d, "k").agg(F.countDistinct("item_id").alias("items"), F.count("*").alias("pairs"))


@R.add("benchmark_contamination_contains", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_contamination_contains(t):
    """Items that stand word for word in a document. An item of nine words or more is found by the hash of its second to eighth word,
    a shorter one by that of its inner words, or by its letters in a row where it has no inner word; runs carry ids only, and texts
    come last, for pairs that share one."""
    b = t("benchmark").filter("text != ''").select("item_id", F.xxhash64("text").alias("ih"), F.col("text").alias("item"), F.split("text", " ").alias("w"))
    docs = t("documents").filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text")
    inner = F.least(F.size("w") - 2, F.lit(7))  # words between the first and the last stand whole in the document
    keys = b.filter(F.size("w") > 2).select("item_id", "ih", inner.alias("n"), F.xxhash64(F.array_join(F.slice("w", F.lit(2), inner), " ")).alias("k"))
    sizes = [r[0] for r in keys.select("n").distinct().collect()]  # seven at most
    words = docs.select("doc_id", "th", F.split("text", " ").alias("w"))
    runs = words.select("doc_id", "th", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.xxhash64(F.array_join(F.slice("w", F.col("i") + 1, n), " ")).alias("k")) for n in sizes or [7]])).alias("r")
    pairs = runs.select("doc_id", "th", each).select("doc_id", "th", "r.*").join(keys, ["n", "k"]).select("doc_id", "th", "item_id", "ih")
    if b.filter(F.size("w") <= 2).limit(1).count():
        short = b.filter(F.size("w") <= 2).select("item_id", "ih", F.length("item").alias("n"), F.xxhash64("item").alias("k"))
        lengths = [r[0] for r in short.select("n").distinct().collect()]  # as many as lengths of texts of two words or fewer
        grams = docs.select("doc_id", "th", "text", F.explode(F.array(*map(F.lit, lengths))).alias("n")).filter(F.length("text") >= F.col("n"))
        grams = grams.select("doc_id", "th", "n", "text", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1)).alias("i")).select("doc_id", "th", "n", F.xxhash64(F.substring("text", F.col("i"), F.col("n"))).alias("k"))
        pairs = pairs.unionByName(grams.join(short, ["n", "k"]).select("doc_id", "th", "item_id", "ih"))
    pairs = pairs.distinct().join(b.select(F.col("ih"), "item").distinct(), "ih")
    return pairs.join(docs, ["doc_id", "th"]).filter(F.contains("text", "item")).select("doc_id", "item_id")


@R.add("protected_overlap", """
WITH d AS (SELECT source, lang, n_chars, CASE WHEN doc_id % 3 = 0 THEN 'dev' WHEN doc_id % 3 = 1 THEN 'test' ELSE 'train' END AS split FROM documents),
v AS (SELECT DISTINCT 'source' AS field, source AS value, split FROM d UNION SELECT 'n_chars', n_chars::VARCHAR, split FROM d)
SELECT a.field, a.split AS split_a, b.split AS split_b, count(*) AS overlap FROM v a JOIN v b ON a.field = b.field AND a.value = b.value AND a.split < b.split GROUP BY 1, 2, 3""")
def protected_overlap(t):
    split = F.when(F.col("doc_id") % 3 == 0, "dev").when(F.col("doc_id") % 3 == 1, "test").otherwise("train")
    return D.field_overlap(t("documents").withColumn("split", split), ["source", "n_chars"], "split")


_CELLS = [(p, s, q) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW") for s, q in (("F", 6), ("O", 4))]


def least_used_sql() -> str:
    """One step for each cell: its rows by how often earlier steps have used their nation, and by digest."""
    parts = ["o AS (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s, c_nationkey AS e, sha256('7' || chr(10) || o_orderpriority || chr(10) || o_orderkey) AS k FROM orders JOIN customer ON c_custkey = o_custkey)", "t0 AS (SELECT NULL::BIGINT AS o_orderkey, '' AS p, '' AS s, -1 AS e, 0::BIGINT AS place WHERE false)"]
    for i, (p, s, q) in enumerate(_CELLS):
        pick = f"SELECT o_orderkey, p, s, o.e, {sum(x[2] for x in _CELLS[:i])} + row_number() OVER (ORDER BY coalesce(n, 0), k, o_orderkey) AS place FROM o LEFT JOIN (SELECT e, count(*) AS n FROM t{i} GROUP BY 1) u ON u.e = o.e WHERE p = '{p}' AND s = '{s}' ORDER BY place LIMIT {q}"
        parts.append(f"t{i + 1} AS MATERIALIZED (FROM t{i} UNION ALL ({pick}))")
    return f"WITH {', '.join(parts)} SELECT p AS o_orderpriority, s AS o_orderstatus, e AS c_nationkey, o_orderkey, place FROM t{len(_CELLS)}"


@R.add("least_used_quota", least_used_sql())
def least_used_quota(t):
    rows = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return D.least_used(rows, "o_orderpriority", "o_orderstatus", "c_nationkey", "o_orderkey", {"F": 6, "O": 4}, seed=7)


@R.add("block_schedule", """
WITH p AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('3' || chr(10) || o_orderkey)) - 1 AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
b AS (SELECT *, pos // 10 AS block, least(10, n - (pos // 10) * 10) AS held FROM p), r AS (SELECT *, (row_number() OVER (PARTITION BY o_orderpriority, block ORDER BY sha256('3:value' || chr(10) || o_orderkey)) - 1) * 10 // held AS v FROM b)
SELECT o_orderpriority, o_orderkey, block, CASE WHEN v < 6 THEN 'migrate' ELSE 'retry' END AS value FROM r""")
def block_schedule(t):
    return D.block_schedule(t("orders"), "o_orderpriority", "o_orderkey", {"migrate": 6, "retry": 4}, seed=3)


@R.add("stratified_split", """
WITH i AS (SELECT DISTINCT lang, doc_id FROM documents), r AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY sha256('0' || chr(10) || doc_id)) AS r FROM i)
SELECT lang, doc_id, CASE WHEN n > 1 AND r <= greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM r""")
def stratified_split(t):
    return D.stratified_split(t("documents"), "lang", "doc_id", 0.1)


@R.add("hash_split", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('7' || chr(10) || doc_id)) AS r FROM documents)
SELECT doc_id, CASE WHEN r <= 50 THEN 'dev' WHEN r <= 80 THEN 'sealed' ELSE 'train' END AS split FROM r""")
def hash_split(t):
    return D.hash_split(t("documents").select("doc_id"), F.col("doc_id"), {"dev": 50, "sealed": 30}, 7, "train")


@R.add("proportional_quotas", """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), a AS (SELECT *, sum(n) OVER () AS al, count(*) OVER () AS k FROM c),
b AS (SELECT *, floor((200 - k) * n / al) AS base, round((200 - k) * n / al - floor((200 - k) * n / al), 9) AS rem FROM a)
SELECT lang, n, least(n, 1 + base + (row_number() OVER (ORDER BY rem DESC, lang) <= 200 - k - sum(base) OVER ())::INT)::BIGINT AS quota FROM b""")
def proportional_quotas(t):
    return D.proportional_quotas(t("documents"), "lang", 200)


@R.add("round_robin_sample", """
SELECT doc_id, source, place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('3' || chr(10) || doc_id)) AS place FROM documents) WHERE place <= 100 ORDER BY place, source LIMIT 100""")
def round_robin_sample(t):
    from loomspan.functions.text import selection_key

    return D.round_robin(t("documents").select("doc_id", "source"), "source", selection_key(3, F.col("doc_id")), 100)


@R.add("entity_first_subset", """
WITH f AS (SELECT event_type, user_id, min(event_id) AS f FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY f, user_id) AS r FROM f)
SELECT event_id, event_type, user_id FROM events WHERE (event_type, user_id) IN (SELECT (event_type, user_id) FROM r WHERE r <= 2)""")
def entity_first_subset(t):
    return D.entity_first(t("events").select("event_id", "event_type", "user_id"), "event_type", "user_id", "event_id", 2)


@R.add("balance_upsample", """
WITH s AS (SELECT quality, count(*) AS n, max(count(*)) OVER () AS m FROM labels GROUP BY 1), r AS (SELECT l.doc_id, l.quality, n, m, row_number() OVER (PARTITION BY l.quality ORDER BY sha256('balance' || chr(10) || doc_id), doc_id) AS r FROM labels l JOIN s USING (quality))
SELECT quality, doc_id, unnest(range(0, m // n + (r <= m % n)::INT))::INT AS copy FROM r""")
def balance_upsample(t):
    return D.balance_up(t("labels").select("quality", "doc_id"), "quality", "doc_id")


@R.add("weighted_replication", """
SELECT event_id, unnest(range(0, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'view' THEN 0 ELSE 1 END))::INT AS copy FROM events""")
def weighted_replication(t):
    w = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 0).otherwise(1)
    return D.replicate(t("events").select("event_id", "event_type"), w).select("event_id", "copy")


@R.add("funnel_reasons", """
SELECT CASE WHEN n_chars < 60 THEN 'short' WHEN n_chars > 8000 THEN 'long' WHEN contains(text, '###') THEN 'junk' WHEN lang <> 'en' THEN 'language' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def funnel_reasons(t):
    return D.funnel(t("documents"), ("short", F.col("n_chars") < 60), ("long", F.col("n_chars") > 8000), ("junk", F.contains("text", F.lit("###"))), ("language", F.col("lang") != "en"))


@R.add("step_rows_prev_action", """
SELECT conv_id, turn, role, (row_number() OVER w - 1)::INT AS step_index, coalesce(lag(role) OVER w, '') AS previous_action FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def step_rows_prev_action(t):
    return D.step_rows(t("conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@R.add("chatml_render", """
SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, '<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10))) AS prompt FROM conversations GROUP BY 1""")
def chatml_render(t):
    return D.chatml(t("conversations"), "conv_id", "turn", "role", "text").withColumn("prompt", F.md5("prompt"))


@R.add("preference_pairs", """
WITH l AS (SELECT doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY sha256('5' || chr(10) || doc_id), doc_id) AS k FROM documents JOIN labels USING (doc_id))
SELECT g.lang, g.k, g.doc_id AS chosen, b.doc_id AS rejected, substr(sha1(coalesce(g.lang, 'None') || chr(10) || g.doc_id || chr(10) || b.doc_id), 1, 24) AS pair_id FROM l g JOIN l b ON g.lang IS NOT DISTINCT FROM b.lang AND g.k = b.k WHERE g.quality = 1 AND b.quality = 0""")
def preference_pairs(t):
    """The n-th good and the n-th bad document of a language, in the order of a digest."""
    rows = t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", "quality"), "doc_id").withColumn("__k", selection_key(5, F.col("doc_id")))
    rows = D.numbered(rows, ["lang", "quality"], "__k", "doc_id").withColumnRenamed("__place", "k")
    return D.preference_pairs(rows.filter("quality = 1"), rows.filter("quality = 0"), ["lang", "k"], "doc_id", ["lang", "chosen", "rejected"])


# Events stand for evaluation runs: the user is the case, the type the category, the day the run, the value the score.
def passed():
    return F.col("value") < 120


@R.add("run_summary_macro", """
WITH c AS (SELECT user_id, event_type, avg(value) AS m, sum(value) AS s, count(*) AS n, bool_and(value < 120) AS ok FROM events GROUP BY 1, 2),
k AS (SELECT event_type, avg(m) AS m, sum(s) AS s, sum(n) AS n, sum(m) AS cs, count(*) AS c, sum(ok::INT) AS ok FROM c GROUP BY 1)
SELECT sum(n)::BIGINT AS steps, sum(c)::BIGINT AS cases, round(sum(s) / sum(n), 6) AS step_mean, round(sum(cs) / sum(c), 6) AS case_macro, round(avg(m), 6) AS category_macro, round(sum(ok) / sum(c), 6) AS pass_rate FROM k""")
def run_summary_macro(t):
    out = E.run_summary(t("events"), "user_id", "event_type", "value", passed())
    return out.select("steps", "cases", *[F.round(c, 6).alias(c) for c in ("step_mean", "case_macro", "category_macro", "pass_rate")])


_GROUPS = "(SELECT event_type, user_id % 4 AS step, avg(value / 500) AS mean_reward, coalesce(stddev_pop(value / 500), 0) AS reward_std, min(value / 500) AS min_reward, max(value / 500) AS max_reward, count(DISTINCT props) AS da FROM events GROUP BY event_type, user_id)"


@R.add("support_grouping_sets", f"""
SELECT event_type, step, grouping(event_type, step)::BIGINT AS scope, count(*) AS groups, round(avg(mean_reward), 6) AS mean_reward, round(avg(reward_std), 6) AS mean_group_std,
round(avg((reward_std > 1e-6)::INT), 6) AS nonzero_std_rate, round(avg((max_reward >= 0.5)::INT), 6) AS positive_support_rate, round(avg((reward_std > 1e-6 AND max_reward >= 0.3)::INT), 6) AS usable_support_rate,
round(avg((min_reward >= 0.5)::INT), 6) AS fully_saturated_rate, round(avg(da), 6) AS mean_distinct_actions FROM {_GROUPS} GROUP BY GROUPING SETS ((), (event_type), (step), (event_type, step))""")
def support_grouping_sets(t):
    g = E.support_groups(t("events").withColumn("r", F.col("value") / 500), ["event_type", "user_id"], "r", "props").withColumn("step", F.col("user_id") % 4)
    out = E.support_summary(g, "event_type", "step", positive=0.5, usable=0.3)
    return out.select("event_type", "step", "scope", "groups", *[F.round(c, 6).alias(c) for c in out.columns[4:]])


_RUNS = "(SELECT user_id, epoch_us(ts) // 86400000000 % 3 AS run, value FROM events)"


def runs(t):
    return t("events").withColumn("run", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) % 3)


@R.add("pass_all_any_flaky", f"""
WITH c AS (SELECT user_id, count(DISTINCT run) = (SELECT count(DISTINCT run) FROM {_RUNS}) AS f, bool_and(value < 120) AS a, bool_or(value < 120) AS o FROM {_RUNS} GROUP BY 1)
SELECT count(*) AS cases, round(avg((f AND a)::INT), 6) AS pass_all, round(avg((f AND o)::INT), 6) AS pass_any, round(avg((f AND o AND NOT a)::INT), 6) AS flaky FROM c""")
def pass_all_any_flaky(t):
    out = E.pass_all_any(runs(t), "user_id", "run", passed())
    return out.select("cases", *[F.round(c, 6).alias(c) for c in ("pass_all", "pass_any", "flaky")])


@R.add("repeat_stability", f"""
WITH m AS (SELECT run, avg(value) AS m FROM {_RUNS} GROUP BY 1)
SELECT count(*) AS runs, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m), 0), 6) AS stdev, round(min(m), 6) AS least, round(max(m), 6) AS most FROM m""")
def repeat_stability(t):
    out = E.repeat_stability(runs(t), "run", "value")
    return out.select("runs", *[F.round(c, 6).alias(c) for c in ("mean", "stdev", "least", "most")])


_SIDE = "(SELECT user_id, event_type, round(avg(value), 6) AS s FROM events WHERE event_id % 2 = {k} GROUP BY 1, 2)"
_PAIRS = f"(SELECT a.user_id, a.event_type, a.s AS l, b.s AS r, b.s - a.s AS d FROM {_SIDE.format(k=0)} a JOIN {_SIDE.format(k=1)} b USING (user_id, event_type))"


def pairs(t):
    side = lambda k: t("events").filter(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("s"))
    return E.paired(side(0), side(1), ["user_id", "event_type"], "s")


@R.add("paired_delta_counts", f"""SELECT count(*) AS steps, count(*) FILTER (d > 1e-12) AS improved, count(*) FILTER (abs(d) <= 1e-12) AS unchanged, count(*) FILTER (d < -1e-12) AS regressed, round(avg(d), 6) AS mean_delta FROM {_PAIRS}""")
def paired_delta_counts(t):
    return E.delta_counts(pairs(t)).withColumn("mean_delta", F.round("mean_delta", 6))


@R.add("contingency_2x2", f"""SELECT count(*) FILTER (l < 50 AND r < 50) AS "both", count(*) FILTER (l >= 50 AND r >= 50) AS neither, count(*) FILTER (l < 50 AND r >= 50) AS base_only, count(*) FILTER (l >= 50 AND r < 50) AS reference_only,
round(avg((l < 50)::INT), 6) AS base_rate, round(avg((r < 50)::INT), 6) AS reference_rate FROM {_PAIRS}""")
def contingency_2x2(t):
    out = E.contingency(pairs(t), F.col("left_score") < 50, F.col("right_score") < 50)
    return out.select("both", "neither", "base_only", "reference_only", F.round("base_rate", 6).alias("base_rate"), F.round("reference_rate", 6).alias("reference_rate"))


_CLUSTERS = f"(SELECT row_number() OVER (ORDER BY md5(user_id::VARCHAR), user_id) - 1 AS no, round(sum(d), 6) AS s, count(*) AS n FROM {_PAIRS} GROUP BY user_id)"


@R.add("cluster_bootstrap_ci", f"""
WITH k AS (SELECT * FROM {_CLUSTERS}), m AS (SELECT count(*) AS m FROM k), d AS (SELECT r.range AS rep, d.range AS draw, ('0x' || substr(md5('7:' || r.range || ':' || d.range), 1, 8))::BIGINT % m AS no FROM m, range(200) r, range((SELECT m FROM m)) d),
b AS (SELECT rep, round(sum(s) / sum(n), 9) AS mean FROM d JOIN k USING (no) GROUP BY 1), v AS (SELECT list(mean ORDER BY mean) AS v FROM b)
SELECT v[least(199, floor(200 * 0.025)::INT) + 1] AS low, v[least(199, floor(200 * 0.975)::INT) + 1] AS high FROM v""")
def cluster_bootstrap_ci(t):
    k = pairs(t).groupBy("user_id").agg(F.round(F.sum("delta"), 6).alias("s"), F.count("*").alias("n"))
    means = E.bootstrap(k, "user_id", "s", "n", 200).withColumn("mean", F.round("mean", 9))
    return E.interval(means)


@R.add("gate_checks", f"""
WITH o AS (SELECT avg(d) AS mean_delta, avg((l < 50)::INT) AS base_rate, count(*)::DOUBLE AS pairs FROM {_PAIRS})
SELECT 'base_rate >=' AS name, round(base_rate, 6) AS observed, '>=' AS op, 0.5 AS threshold, base_rate >= 0.5 AS passed FROM o
UNION ALL SELECT 'mean_delta >', round(mean_delta, 6), '>', 0.0, mean_delta > 0 FROM o UNION ALL SELECT 'pairs >=', round(pairs, 6), '>=', 100.0, pairs >= 100 FROM o""")
def gate_checks(t):
    o = pairs(t).agg(F.avg("delta").alias("mean_delta"), E.share(F.col("left_score") < 50).alias("base_rate"), F.count("*").cast("double").alias("pairs"))
    return E.gate_checks(o, [("base_rate", ">=", 0.5), ("mean_delta", ">", 0.0), ("pairs", ">=", 100.0)]).withColumn("observed", F.round("observed", 6))


@R.add("admission_select", """
SELECT event_id, event_type, place FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events WHERE value >= 20) WHERE place <= 4""")
def admission_select(t):
    return E.admission(t("events"), "event_type", F.col("value") >= 20, "event_id").select("event_id", "event_type", "place")


_SETS = "(SELECT conv_id, list_distinct(list(role) FILTER (turn < 3)) AS e, list_distinct(list(role) FILTER (turn >= 2)) AS p FROM conversations GROUP BY 1)"


@R.add("set_prf", f"""
WITH s AS (SELECT conv_id, coalesce(e, []) AS e, coalesce(p, []) AS p FROM {_SETS}), x AS (SELECT *, len(list_intersect(e, p)) AS i, len(e) AS ne, len(p) AS np FROM s), y AS (SELECT *, i / greatest(np, 1) AS pr, i / greatest(ne, 1) AS re FROM x)
SELECT conv_id, round(CASE WHEN ne = 0 AND np = 0 THEN 1.0 WHEN ne = 0 OR np = 0 THEN 0.0 ELSE pr END, 6)::DOUBLE AS "precision", round(CASE WHEN ne = 0 THEN 1.0 WHEN np = 0 THEN 0.0 ELSE re END, 6)::DOUBLE AS recall,
round(CASE WHEN ne = 0 AND np = 0 THEN 1.0 WHEN ne = 0 OR np = 0 OR pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END, 6)::DOUBLE AS f1, (CASE WHEN ne = 0 THEN 1.0 WHEN i > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit FROM y""")
def set_prf(t):
    g = t("conversations").groupBy("conv_id").agg(F.collect_set(F.when(F.col("turn") < 3, F.col("role"))).alias("e"), F.collect_set(F.when(F.col("turn") >= 2, F.col("role"))).alias("p"))
    return g.select("conv_id", E.set_scores(F.col("e"), F.col("p")).alias("x")).select("conv_id", *[F.round(f"x.{c}", 6).alias(c) for c in ("precision", "recall", "f1", "hit")])


_N = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"
_QA = f"(SELECT a.conv_id, {_N.format('a.text')} AS r, {_N.format('b.text')} AS a FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 1 AND b.turn = 2)"
_CHARS = "(SELECT conv_id, ch, count(*) AS n FROM (SELECT conv_id, unnest(string_split({c}, '')) AS ch FROM qa) WHERE ch <> '' GROUP BY 1, 2)"
_F1 = f"""(WITH qa AS (SELECT conv_id, any_value(r) AS r, any_value(a) AS a FROM {_QA} GROUP BY 1), c AS (SELECT x.conv_id, sum(least(x.n, y.n)) AS c FROM {_CHARS.format(c='r')} x JOIN {_CHARS.format(c='a')} y USING (conv_id, ch) GROUP BY 1)
SELECT conv_id, r, a, CASE WHEN r = '' AND a = '' THEN 1.0 WHEN r = '' OR a = '' OR coalesce(c, 0) = 0 THEN 0.0 ELSE 2 * (c / length(a)) * (c / length(r)) / (c / length(a) + c / length(r)) END AS f FROM qa LEFT JOIN c USING (conv_id))"""


def answers(t):
    c = t("conversations")
    a = c.filter("turn = 1").select("conv_id", benchmark_text(F.col("text")).alias("r"))
    b = c.filter("turn = 2").select("conv_id", benchmark_text(F.col("text")).alias("a"))
    return a.join(b, "conv_id").groupBy("conv_id").agg(F.first("r").alias("r"), F.first("a").alias("a"))


@R.add("char_f1", f"SELECT conv_id, round(f, 6) AS char_f1 FROM {_F1}")
def char_f1(t):
    return E.char_f1(answers(t), "conv_id", F.col("r"), F.col("a")).withColumn("char_f1", F.round("char_f1", 6))


@R.add("answer_score", f"""SELECT conv_id, round(s, 6) AS score, s >= 0.8 AS correct FROM (SELECT conv_id, greatest(CASE WHEN r <> '' AND r = a THEN 1.0 ELSE 0.0 END,
CASE WHEN (length(r) >= 6 AND contains(a, r)) OR (length(a) >= 6 AND contains(r, a)) THEN 0.95 ELSE 0.0 END, f) AS s FROM {_F1})""")
def answer_score(t):
    qa = answers(t)
    f1 = E.char_f1(qa, "conv_id", F.col("r"), F.col("a"))
    inside = ((F.length("r") >= 6) & F.contains("a", "r")) | ((F.length("a") >= 6) & F.contains("r", "a"))
    s = F.greatest(F.when((F.col("r") != "") & (F.col("r") == F.col("a")), 1.0).otherwise(0.0), F.when(inside, 0.95).otherwise(0.0), F.col("char_f1"))
    return qa.join(f1, "conv_id").select("conv_id", F.round(s, 6).alias("score"), (s >= 0.8).alias("correct"))


@R.add("mrr_at_k", """
WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS p FROM events), m AS (SELECT user_id, min(p) FILTER (event_type = 'purchase') AS f FROM r WHERE p <= 10 GROUP BY 1)
SELECT count(*) AS queries, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, round(avg((f IS NOT NULL)::INT), 6) AS recall FROM m""")
def mrr_at_k(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    r = t("events").withColumn("p", F.row_number().over(w)).filter("p <= 10")
    m = r.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("p"))).alias("f"))
    return m.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1.0 / F.col("f"), F.lit(0.0))), 6).alias("mrr"), F.round(E.share(F.col("f").isNotNull()), 6).alias("recall"))


# A decision is an event: its type is the action, even props the argument; the expected action follows from the id.
_STEP = """(SELECT user_id, event_id, 0.10 + 0.10 + 0.35 * (event_type = CASE event_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END)::INT + 0.25 * (CAST(props->>'k' AS INT) % 2 = 0)::INT + 0.10 AS s,
event_type = 'signup' AS forbidden FROM events)"""


def step_scores(t):
    want = F.when(F.col("event_id") % 3 == 0, "click").when(F.col("event_id") % 3 == 1, "view").otherwise("error")
    arg, even = F.get_json_object("props", "$.k"), F.create_map(F.lit("k"), F.lit("even"))
    given = F.create_map(F.lit("k"), F.when(arg.cast("int") % 2 == 0, "Even ").otherwise(arg))
    expected = F.struct(F.lit("tool").alias("kind"), want.alias("action"), even.alias("args"), F.lit(None).cast("map<string,array<string>>").alias("contains"))
    made = F.struct(F.lit("tool").alias("kind"), F.col("event_type").alias("action"), given.alias("args"))
    return t("events").select("user_id", "event_id", W.step_score(W.step_detail(expected, made)).alias("s"), (F.col("event_type") == "signup").alias("forbidden"))


@R.add("step_reward", f"SELECT event_id, round(s, 6)::DOUBLE AS score FROM {_STEP}")
def step_reward(t):
    return step_scores(t).select("event_id", F.round("s", 6).alias("score"))


@R.add("case_reward", f"""SELECT user_id, count(*) AS steps, round(((sum(s) + CASE WHEN bool_or(forbidden) THEN 0.0 ELSE 0.10 END) / (0.90 * count(*) + 0.10))::DOUBLE, 4) AS score, bool_or(forbidden) AS forbidden_hit FROM {_STEP} GROUP BY 1""")
def case_reward(t):
    g = step_scores(t).groupBy("user_id").agg(F.count("*").alias("steps"), F.sum("s").alias("s"), F.bool_or("forbidden").alias("forbidden_hit"))
    score = (F.col("s") + F.when(F.col("forbidden_hit"), 0.0).otherwise(0.10)) / (0.90 * F.col("steps") + 0.10)
    return g.select("user_id", "steps", F.round(score, 4).alias("score"), "forbidden_hit")


@R.add("trajectory_sequences", """
WITH d AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, string_agg(event_type, ' -> ' ORDER BY ts, event_id) AS sequence FROM events GROUP BY 1, 2)
SELECT sequence, count(*) AS n FROM d GROUP BY 1""")
def trajectory_sequences(t):
    e = t("events").withColumn("session", F.struct("user_id", F.to_date("ts").alias("day")))
    return S.trajectories(e, "session", ["ts", "event_id"], "event_type")


@R.add("repeated_tool", """
WITH e AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'look' WHEN 'click' THEN 'look' ELSE event_type END AS c, ts, event_id FROM events), r AS (SELECT user_id, c = lag(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM e)
SELECT user_id, count(*) FILTER (r) AS repeats, count(*) AS steps FROM r GROUP BY 1""")
def repeated_tool(t):
    return S.adjacent_repeats(t("events"), "user_id", ["ts", "event_id"], "event_type", {"view": "look", "click": "look"})


@R.add("recent_n", """
SELECT user_id, event_id, age FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 5""")
def recent_n(t):
    return S.recent(t("events"), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "age")


@R.add("ledger_join", "SELECT s.event_id, coalesce(l.props, '') AS payload FROM events s LEFT JOIN (SELECT * FROM events WHERE event_type <> 'error') l ON l.event_id = s.event_id + 1")
def ledger_join(t):
    steps = t("events").select("event_id", (F.col("event_id") + 1).alias("pointer"))
    return S.ledger_join(steps, t("events").filter("event_type != 'error'"), "pointer", "event_id", "props").select("event_id", "payload")


@R.add("event_windows", """
SELECT strftime(time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S') AS "start", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def event_windows(t):
    from loomspan.streaming.events import windowed_counts

    return windowed_counts(t("events"), "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@R.add("case_scores", """
WITH e AS (SELECT user_id, event_type, event_id % 4 <> 0 AS same, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT user_id, any_value(n) AS n, sum(0.55 + CASE WHEN same THEN 0.35 ELSE 0.0 END) AS s, bool_or(CASE WHEN same THEN event_type ELSE 'other' END = 'signup') AS f FROM e GROUP BY 1)
SELECT user_id, round(((s + CASE WHEN f THEN 0.0 ELSE 0.10 END) / (0.90 * n + 0.10))::DOUBLE, 4) AS score, f AS forbidden_hit FROM c""")
def case_scores(t):
    """Every event is an expected step; three of four are met by the decision made."""
    none, lists = F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,array<string>>")
    made = F.when(F.col("event_id") % 4 != 0, F.col("event_type")).otherwise("other")
    steps = F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("w"), made.alias("g"))))
    cases = t("events").groupBy("user_id").agg(steps.alias("s"))
    want = F.transform("s", lambda x: F.struct(F.lit("tool").alias("kind"), x["w"].alias("action"), none.alias("args"), lists.alias("contains")))
    got = F.transform("s", lambda x: F.struct(F.lit("tool").alias("kind"), x["g"].alias("action"), none.alias("args")))
    out = cases.select("user_id", W.case_score(want, got, F.array(F.lit("signup"))).alias("x"))
    return out.select("user_id", F.round("x.score", 4).alias("score"), "x.forbidden_hit")


_DONE = """SELECT event_id, event_id // 3 AS k, event_id % 3 AS p, event_type AS w, CASE WHEN event_id % 11 = 0 THEN 'final_answer' WHEN event_id % 5 = 0 THEN 'view' ELSE event_type END AS g,
CASE WHEN event_id % 3 = 2 THEN 'true' ELSE 'false' END AS wf, CASE WHEN event_id % 4 = 0 THEN 'false' WHEN event_id % 13 = 0 OR event_id % 3 = 2 THEN 'true' ELSE 'false' END AS gf FROM events"""
_CLASS = "CASE WHEN {0} IN ('view', 'click') THEN 'look' ELSE {0} END"
_SAME = {"view": "look", "click": "look"}


def _done(t):
    """Three events in a row are a case; the decision made differs now and then from the event, and finishes when it should not or not when it should."""
    i = F.col("event_id")
    made = F.when(i % 11 == 0, "final_answer").when(i % 5 == 0, "view").otherwise(F.col("event_type"))
    flag = F.when(i % 4 == 0, "false").when((i % 13 == 0) | (i % 3 == 2), "true").otherwise("false")
    return t("events").select("event_id", F.floor(i / 3).alias("k"), (i % 3).alias("p"), F.col("event_type").alias("w"), made.alias("g"), F.when(i % 3 == 2, "true").otherwise("false").alias("wf"), flag.alias("gf"))


def _wanted(action, finish):
    return F.struct(F.lit("tool").alias("kind"), action.alias("action"), F.create_map(F.lit(W.FINISH), finish).alias("args"), F.lit(None).cast("map<string,array<string>>").alias("contains"))


def _made(action, finish):
    return F.struct(F.lit("tool").alias("kind"), action.alias("action"), F.create_map(F.lit(W.FINISH), finish).alias("args"))


@R.add("process_detectors", f"""
WITH d AS ({_DONE}), c AS (SELECT k, count(*) AS n, list(w ORDER BY p) AS w, list(g ORDER BY p) AS g, list({_CLASS.format("w")} ORDER BY p) AS wc, list({_CLASS.format("g")} ORDER BY p) AS gc, list(gf ORDER BY p) AS gf, list(wf ORDER BY p) AS wf FROM d GROUP BY 1)
SELECT k, n > 1 AND (g[1] = 'final_answer' OR gf[1] = 'true' OR (n > 2 AND (g[2] = 'final_answer' OR gf[2] = 'true'))) AS stopped_early,
n > 1 AND NOT (wc[1] = wc[2] OR coalesce(wc[2] = wc[3], false)) AND ((gc[1] = gc[2] AND gc[1] <> 'final_answer') OR coalesce(gc[2] = gc[3] AND gc[2] <> 'final_answer', false)) AS repeated,
n > 1 AND w[1] IN ('view', 'click') AND w[2] = 'purchase' AND g[1] NOT IN ('view', 'click') AS skipped_probe, wc[n] = gc[n] AND wf[n] = 'true' AND gf[n] <> 'true' AS left_open FROM c""")
def process_detectors(t):
    cases = _done(t).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p", "w", "g", "wf", "gf"))).alias("s"))  # three steps
    want, got = F.transform("s", lambda x: _wanted(x["w"], x["wf"])), F.transform("s", lambda x: _made(x["g"], x["gf"]))
    faults = {"stopped_early": W.stopped_early(want, got), "repeated": W.repeats_a_tool(want, got, _SAME), "skipped_probe": W.skipped_probe(want, got, ("view", "click"), "purchase"), "left_open": W.left_open(want, got, _SAME)}
    return cases.select("k", *[c.alias(name) for name, c in faults.items()])


@R.add("online_step_reward", f"""
WITH d AS (SELECT *, {_CLASS.format("w")} AS wc, {_CLASS.format("g")} AS gc FROM ({_DONE})), n AS (SELECT *, p + 1 AS place, lag(wc) OVER c AS wb, lag(gc) OVER c AS gb, p = 0 AND w IN ('view', 'click') AND coalesce(lead(w) OVER c = 'purchase', false) AS due, count(*) OVER (PARTITION BY k) AS n FROM d WINDOW c AS (PARTITION BY k ORDER BY p)),
m AS (SELECT *, 0.1 + 0.1 + CASE WHEN wc = gc THEN 0.35 ELSE 0 END + 0.25 + CASE WHEN wf = gf THEN 0.1 ELSE 0 END + CASE WHEN g = 'signup' THEN 0 ELSE 0.1 END AS s,
CASE WHEN place < n THEN 0.2 ELSE 0 END AS w1, CASE WHEN place > 1 THEN 0.1 ELSE 0 END AS w2, CASE WHEN due THEN 0.15 ELSE 0 END AS w3, CASE WHEN place = n THEN 0.3 ELSE 0 END AS w4 FROM n),
r AS (SELECT event_id, wc = gc AS same, ((s + CASE WHEN g <> 'final_answer' AND gf = 'false' THEN w1 ELSE 0 END + CASE WHEN wb = wc OR gc <> gb THEN w2 ELSE 0 END + CASE WHEN g IN ('view', 'click') THEN w3 ELSE 0 END + CASE WHEN wf <> 'true' OR gf = 'true' THEN w4 ELSE 0 END)
/ (1.0 + w1 + w2 + w3 + w4))::DOUBLE AS x FROM m)
SELECT event_id, round(CASE WHEN same THEN x ELSE least(x, 0.5) END, 6) AS score FROM r""")
def online_step_reward(t):
    c = Window.partitionBy("k").orderBy("p")
    d = _done(t).withColumns({"before": F.lag("w").over(c), "previous": F.lag("g").over(c), "after": F.lead("w").over(c), "n": F.count("*").over(Window.partitionBy("k"))})
    due = (F.col("p") == 0) & F.col("w").isin("view", "click") & F.coalesce(F.col("after") == "purchase", F.lit(False))
    process = {"no_premature_stop": 0.2, "no_repeated_tool": 0.1, "no_skip_required_probe": 0.15, "final_tool_finish": 0.3}
    x = W.online_step_score(_wanted(F.col("w"), F.col("wf")), _made(F.col("g"), F.col("gf")), F.array(F.lit("signup")), F.col("p") + 1, F.col("n"), F.col("previous"), F.col("w"), F.col("before"), due, process, _SAME, ("view", "click"), 0.5)
    return d.select("event_id", F.round(x, 6).alias("score"))
