"""Confirmation gates, final objectives, support by samples, isolation and factors; orders stand for attempts, customers for cases and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import confirmation as C
from loomspan.plans.base import Registry

R = Registry()

LIMITS = C.Limits(cases=2000, runs=1, candidate_least=0.5, base_least=0.08, base_most=0.80, gap_least=-0.05, family_candidate_least=0.6, family_base_most=0.70, mix={"1-URGENT": 1000, "9-NONE": 1})
_OUTCOMES = """SELECT o_orderstatus AS a, o_custkey AS c, o_orderpriority AS f, count(*) AS runs, bool_and(o_totalprice > 90000) AS s, bool_and(o_totalprice > 70000) AS r, count(*) FILTER (o_orderkey % 50 <> 0) AS readable, count(*) FILTER (o_orderkey % 40 = 0) AS cut
FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2, 3"""
_CHECKS = f"""
WITH o AS ({_OUTCOMES}), g AS (SELECT f, grouping(f) = 1 AS w, count(*) FILTER (a = 'F') AS bn, count(*) FILTER (a = 'O') AS cn, count(*) FILTER (a = 'F' AND s) AS bs, count(*) FILTER (a = 'O' AND s) AS cs,
count(*) FILTER (a = 'F' AND NOT r) AS br, count(*) FILTER (a = 'F' AND NOT s AND r) AS ba, min(runs) AS lo, max(runs) AS hi,
sum(readable) FILTER (a = 'F') / sum(runs) FILTER (a = 'F') AS b_read, sum(readable) FILTER (a = 'O') / sum(runs) FILTER (a = 'O') AS c_read, sum(cut) FILTER (a = 'F') / sum(runs) FILTER (a = 'F') AS b_cut, sum(cut) FILTER (a = 'O') / sum(runs) FILTER (a = 'O') AS c_cut
FROM o GROUP BY GROUPING SETS ((f), ())), v AS (
SELECT NULL AS family, unnest([
{{'k': 'cases', 'v': least(bn, cn)::DOUBLE, 'lo': 2000.0::DOUBLE, 'hi': NULL::DOUBLE}}, {{'k': 'cases_at_most', 'v': greatest(bn, cn)::DOUBLE, 'lo': NULL, 'hi': 2000.0}}, {{'k': 'runs', 'v': lo::DOUBLE, 'lo': 1.0, 'hi': NULL}}, {{'k': 'runs_at_most', 'v': hi::DOUBLE, 'lo': NULL, 'hi': 1.0}},
{{'k': 'readable', 'v': least(b_read, c_read), 'lo': 0.95, 'hi': NULL}}, {{'k': 'cut', 'v': greatest(b_cut, c_cut), 'lo': NULL, 'hi': 0.05}}, {{'k': 'candidate', 'v': cs / cn, 'lo': 0.5, 'hi': NULL}}, {{'k': 'base', 'v': bs / bn, 'lo': 0.08, 'hi': 0.8}},
{{'k': 'gap', 'v': cs / cn - bs / bn, 'lo': -0.05, 'hi': NULL}}, {{'k': 'route_failures', 'v': br / bn, 'lo': 0.15, 'hi': NULL}}, {{'k': 'route_share', 'v': br / (bn - bs), 'lo': 0.7, 'hi': NULL}}, {{'k': 'argument_share', 'v': ba / (bn - bs), 'lo': NULL, 'hi': 0.2}}]) AS u FROM g WHERE w
UNION ALL SELECT f, unnest([{{'k': 'candidate', 'v': cs / cn, 'lo': 0.6, 'hi': NULL}}, {{'k': 'base', 'v': bs / bn, 'lo': NULL, 'hi': 0.7}}]) FROM g WHERE NOT w
UNION ALL SELECT NULL, {{'k': 'mix ' || coalesce(f, kind), 'v': bn::DOUBLE, 'lo': n, 'hi': n}} FROM (SELECT * FROM g WHERE NOT w) FULL JOIN (VALUES ('1-URGENT', 1000.0::DOUBLE), ('9-NONE', 1.0)) x(kind, n) ON kind = f),
k AS (SELECT family, u.k AS "check", u.v AS value, u.lo AS least, u.hi AS most, coalesce(u.v, -1e9) >= coalesce(u.lo, -1e8) - 1e-12 AND coalesce(u.v, 1e9) <= coalesce(u.hi, 1e8) + 1e-12 AND NOT (u.k LIKE 'mix%' AND u.lo IS NULL) AS passed FROM v)"""


def checks(t):
    o = t("orders")
    out = C.case_outcomes(o, "o_orderstatus", "o_custkey", "o_orderpriority", F.col("o_totalprice") > 90000, F.col("o_totalprice") > 70000, F.col("o_orderkey") % 50 != 0, F.col("o_orderkey") % 40 == 0)
    return C.confirmation(out, "F", "O", LIMITS)


@R.add("confirmation_gate", _CHECKS + """ SELECT family, "check", round(value, 9) AS value, least, most, passed FROM k""")
def confirmation_gate(t):
    return checks(t).withColumn("value", F.round("value", 9))


@R.add("confirmation_verdict", _CHECKS + """ SELECT count(*) AS checks, string_agg(coalesce(family || '/', '') || "check", ',' ORDER BY coalesce(family || '/', '') || "check") FILTER (NOT passed) AS failed, bool_and(passed) AS passed FROM k""")
def confirmation_verdict(t):
    return C.verdict(checks(t)).withColumn("failed", F.array_join("failed", ","))


@R.add("final_objective", """
WITH c AS (SELECT o_orderkey, o_custkey AS e, o_orderpriority < '3' AS p, (o_totalprice > 150000)::INT AS b, (o_totalprice > 120000)::INT AS n, (o_totalprice > 140000)::INT AS l, (o_orderkey % 11 = 0)::INT AS fb, (o_orderkey % 13 = 0)::INT AS fn FROM orders),
k AS (SELECT e, sum(n - b) AS sb, sum(n - l) AS sl, count(*) AS m, row_number() OVER (ORDER BY md5(e::VARCHAR), e) - 1 AS no FROM c WHERE p GROUP BY 1), z AS (SELECT count(*) AS z FROM k),
d AS (SELECT r.range AS rep, ('0x' || substr(md5('7:' || r.range || ':' || d.range), 1, 8))::BIGINT % z AS no FROM z, range(100) r, range((SELECT z FROM z)) d),
s AS (SELECT rep, round(sum(sb) / sum(m), 12) AS mb, round(sum(sl) / sum(m), 12) AS ml FROM d JOIN k USING (no) GROUP BY 1), v AS (SELECT list(mb ORDER BY mb) AS vb, list(ml ORDER BY ml) AS vl FROM s),
a AS (SELECT avg(n - b) FILTER (p) AS lead_base, avg(n - l) FILTER (p) AS lead_larger, avg(n - b) FILTER (NOT p) AS controls, sum(fb)::BIGINT AS base_effects, sum(fn)::BIGINT AS effects FROM c)
SELECT round(lead_base, 9) AS lead_base, round(lead_larger, 9) AS lead_larger, round(controls, 9) AS controls, base_effects, effects, round(vb[3], 9) AS low_base, round(vb[98], 9) AS high_base, round(vl[3], 9) AS low_larger, round(vl[98], 9) AS high_larger,
lead_base > 0 AND lead_larger > 0 AND controls >= -0.05 AND effects <= base_effects AS met, lead_base > 0 AND lead_larger > 0 AND controls >= -0.05 AND effects <= base_effects AND vl[3] > 0 AS strong,
lead_base > 0 AND lead_larger > 0 AND controls >= -0.05 AND effects <= base_effects AND vl[3] <= 0 AS point_only FROM a, v""")
def final_objective(t):
    price = F.col("o_totalprice")
    c = t("orders").select("o_orderkey", "o_custkey", (F.col("o_orderpriority") < "3").alias("p"), (price > 150000).alias("b"), (price > 120000).alias("n"), (price > 140000).alias("l"), (F.col("o_orderkey") % 11 == 0).cast("int").alias("fb"), (F.col("o_orderkey") % 13 == 0).cast("int").alias("fn"))
    out = C.objective(c, "o_custkey", F.col("p"), ("b", "n", "l"), {"b": "fb", "n": "fn"}, replicates=100)
    return out.withColumns({x: F.round(x, 9) for x in ("lead_base", "lead_larger", "controls", "low_base", "high_base", "low_larger", "high_larger")})


_GROUPS = """
WITH g AS (SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_partkey, l_extendedprice)) AS l_returnflag, arg_min(l_linestatus, (l_linenumber, l_partkey, l_extendedprice)) AS l_linestatus, count(*) AS samples, bool_or(l_quantity > 40) AS supported, avg(l_discount) AS mean,
CASE WHEN max(l_discount) = min(l_discount) THEN 0.0 ELSE stddev_pop(l_discount) END AS deviation, count(DISTINCT CASE WHEN l_tax > 0.01 THEN l_suppkey % 5 END) AS actions FROM lineitem GROUP BY 1)"""


def support(t):
    li = t("lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_extendedprice"))
    return C.step_support(li, "l_orderkey", "o", ["l_returnflag", "l_linestatus"], F.col("l_discount"), F.when(F.col("l_tax") > 0.01, F.col("l_suppkey") % 5), F.col("l_quantity") > 40)


@R.add("step_support_prompts", _GROUPS + " SELECT * REPLACE (round(mean, 9) AS mean, round(deviation, 9) AS deviation) FROM g")
def step_support_prompts(t):
    return support(t)[0].withColumns({c: F.round(c, 9) for c in ("mean", "deviation")})


@R.add("step_support_blocks", _GROUPS + """, b AS (SELECT 'overall' AS scope, 'all' AS value, * FROM g UNION ALL SELECT 'l_returnflag', l_returnflag, * FROM g UNION ALL SELECT 'l_linestatus', l_linestatus, * FROM g)
SELECT scope, value, count(*) AS prompts, round(avg(supported::INT), 9) AS support_rate, round(avg((deviation > 1e-12)::INT), 9) AS varied_rate, round(avg(actions), 9) AS mean_actions, round(avg(mean), 9) AS mean_score FROM b GROUP BY 1, 2""")
def step_support_blocks(t):
    return support(t)[1].withColumns({c: F.round(c, 9) for c in ("support_rate", "varied_rate", "mean_actions", "mean_score")})


@R.add("isolated_rows", """
WITH r AS (SELECT c.*, lower(trim(text)) AS q FROM conversations c WHERE conv_id % 2 = 0), s AS (SELECT c.*, lower(trim(text)) AS q FROM conversations c WHERE conv_id % 2 = 1),
a AS (SELECT 'conv' AS field, conv_id::VARCHAR AS v FROM r UNION SELECT 'query', q FROM r UNION SELECT 'role', role FROM r), b AS (SELECT 'conv' AS field, conv_id::VARCHAR AS v FROM s UNION SELECT 'query', q FROM s UNION SELECT 'role', role FROM s),
x AS (SELECT field, v, row_number() OVER (PARTITION BY field ORDER BY v) AS p FROM a JOIN b USING (field, v) WHERE v <> ''), n(field, protected) AS (VALUES ('conv', true), ('query', true), ('role', false))
SELECT field, protected, count(v) AS overlap, coalesce(md5(string_agg(v, '|' ORDER BY v) FILTER (p <= 10)), md5('')) AS examples, NOT protected OR count(v) = 0 AS passed FROM n LEFT JOIN x USING (field) GROUP BY 1, 2""")
def isolated_rows(t):
    c = t("conversations")
    out = C.isolation(c.filter("conv_id % 2 = 0"), c.filter("conv_id % 2 = 1"), {"conv": F.col("conv_id"), "query": F.lower(F.trim("text"))}, {"role": F.col("role")})
    return out.withColumn("examples", F.md5(F.array_join("examples", "|")))


@R.add("factor_balance", """
WITH l AS (SELECT *, (l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS o FROM lineitem), e AS (SELECT l_suppkey, arg_min(l_returnflag, o) AS f, arg_min(l_linestatus, o) AS s FROM l GROUP BY 1), b AS (SELECT l_orderkey, arg_min(l_linestatus, o) AS s FROM l GROUP BY 1)
SELECT 'entity' AS unit, 'l_returnflag' AS factor, f AS value, count(*) AS n FROM e GROUP BY 3 UNION ALL SELECT 'entity', 'l_linestatus', s, count(*) FROM e GROUP BY 3 UNION ALL SELECT 'entity', 'l_returnflag|l_linestatus', f || '|' || s, count(*) FROM e GROUP BY 3
UNION ALL SELECT 'bundle', 'l_linestatus', s, count(*) FROM b GROUP BY 3 UNION ALL SELECT 'row', 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM l GROUP BY 3""")
def factor_balance(t):
    li = t("lineitem").withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    return C.factor_report(li, "o", "l_suppkey", ["l_returnflag", "l_linestatus"], "l_orderkey", ["l_linestatus"], ["l_linenumber"])
