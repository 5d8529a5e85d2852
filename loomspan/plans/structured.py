"""Counts, breakdowns, profiles, distributions and percentiles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from loomspan.functions import percentiles as P
from loomspan.functions.text import benchmark_text, integer_answer, last_integer, normalize_query, text_tokens
from loomspan.operators import aggregates as A
from loomspan.plans.base import Registry

R = Registry()

for _name, _col in (("source_counts", "source"), ("language_counts", "lang")):
    R.add(_name, f"SELECT {_col} AS value, count(*) AS n FROM documents GROUP BY 1")(
        lambda t, c=_col: t("documents").groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    )

RED = A.Condition("p_name", "contains", ("red", "blue"))
SMALL = A.Condition("p_type", "equals", ("small",))
BRAND = A.Condition("p_brand", "in", ("Brand#3", "brand#4", "Brand#12"))


@R.add("structured_count_records", """
SELECT count(*) AS record_count, count(DISTINCT p_brand) AS unique_count, count(*) AS answer FROM part
WHERE (contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue')) AND lower(p_type) = 'small'""")
def structured_count_records(t):
    return A.structured_count(t("part"), A.Plan("count_records", dedupe_field="p_brand", conditions=(RED, SMALL)))


@R.add("structured_count_unique", """
SELECT count(*) AS record_count, count(DISTINCT p_name) AS unique_count, count(DISTINCT p_name) AS answer FROM part
WHERE lower(p_brand) IN ('brand#3', 'brand#4', 'brand#12')""")
def structured_count_unique(t):
    return A.structured_count(t("part"), A.Plan("count_unique", count_field="p_name", conditions=(BRAND,)))


@R.add("structured_count_any", """
SELECT count(*) AS record_count, count(DISTINCT p_partkey) AS unique_count, count(*) AS answer FROM part
WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') OR lower(p_brand) IN ('brand#3', 'brand#4', 'brand#12')""")
def structured_count_any(t):
    return A.structured_count(t("part"), A.Plan("count_records", dedupe_field="p_partkey", logic="any", conditions=(RED, BRAND)))


@R.add("structured_sample_values", """
SELECT DISTINCT p_name AS value FROM part WHERE lower(p_type) = 'small' ORDER BY value LIMIT 20""")
def structured_sample_values(t):
    return A.sample_values(t("part"), A.Plan(conditions=(SMALL,)), "p_name")


_LONG = "SELECT 'p_type' AS field, p_type AS value, p_name AS u FROM part UNION ALL SELECT 'p_brand', p_brand, p_name FROM part"


@R.add("aggregate_breakdown", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY record_count DESC, value) AS place FROM (
SELECT field, value, count(*) AS record_count, count(DISTINCT u) AS unique_count FROM ({_LONG}) GROUP BY 1, 2)) WHERE place <= 12""")
def aggregate_breakdown(t):
    return A.breakdown(t("part"), ["p_type", "p_brand"], "p_name")


@R.add("field_value_profile", """
SELECT field, value, n, place FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS place FROM (
SELECT field, value, count(*) AS n FROM (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents)
WHERE value <> '' GROUP BY 1, 2)) WHERE place <= 30""")
def field_value_profile(t):
    return A.value_profile(t("documents"), ["lang", "source"])


@R.add("multivalue_counter", """
SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) WHERE value <> '' GROUP BY 1""")
def multivalue_counter(t):
    return A.multivalue_counts(t("part"), "p_name", " ")


@R.add("preferred_source_rows", """
SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1""")
def preferred_source_rows(t):
    return A.preferred_rows(t("lineitem"), F.col("l_linestatus") == "O").groupBy("l_returnflag").agg(F.count("*").alias("n"))


_MI = "SELECT d.lang AS x, l.quality AS y, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2"
_MI_SQL = """SELECT round(sum(n / total * {log}(n * total / (nx * ny))), 6) AS mutual_information FROM (
SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS total FROM (""" + _MI + "))"
for _name, _base, _log in (("mutual_information_log2", "log2", "log2"), ("mutual_information_ln", "ln", "ln")):

    @R.add(_name, _MI_SQL.format(log=_log))
    def mutual_information(t, base=_base):
        both = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id")
        return A.mutual_information(both, "lang", "quality", base).select(F.round("mutual_information", 6).alias("mutual_information"))


@R.add("total_variation", """
WITH a AS (SELECT lang AS value, count(*) / sum(count(*)) OVER () AS s FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1),
b AS (SELECT lang AS value, count(*) / sum(count(*)) OVER () AS s FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1),
j AS (SELECT value, coalesce(a.s, 0) AS sa, coalesce(b.s, 0) AS sb FROM a FULL JOIN b USING (value))
SELECT value, round(sa, 9) AS share_a, round(sb, 9) AS share_b, round(sb - sa, 9) AS delta, round(0.5 * sum(abs(sb - sa)) OVER (), 9) AS total_variation FROM j""")
def total_variation(t):
    both = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id")
    out = A.distribution_shift(both.filter("quality = 1"), both.filter("quality = 0"), "lang")
    return out.select("value", *[F.round(c, 9).alias(c) for c in ("share_a", "share_b", "delta", "total_variation")])


@R.add("text_shape", """
SELECT lang, min(n_chars) AS least, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5) AS median, max(n_chars) AS most FROM documents GROUP BY 1""")
def text_shape(t):
    return t("documents").groupBy("lang").agg(F.min("n_chars").alias("least"), F.round(F.avg("n_chars"), 6).alias("mean"), P.linear(F.col("n_chars"), 0.5).alias("median"), F.max("n_chars").alias("most"))


@R.add("percentile_variants", """
WITH s AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n, quantile_cont(value, 0.95) AS lin FROM events GROUP BY 1)
SELECT event_type, v[least(n - 1, floor(n * 0.95)::BIGINT) + 1] AS truncating, v[round_even((n - 1) * 0.95, 0)::BIGINT + 1] AS half_even,
round(lin, 6) AS linear, v[floor((n - 1) * 0.95)::BIGINT + 1] AS lower, v[n // 2 + 1] AS upper_half FROM s""")
def percentile_variants(t):
    g = A.order_statistics(t("events"), "event_type", "value", {name: partial(place, f=0.95) for name, place in P.PLACES.items()})
    linear = F.round(P.between(F.col("lower"), F.col("upper"), F.col("n"), 0.95), 6)
    return g.select("event_type", "truncating", "half_even", linear.alias("linear"), "lower", "upper_half")


@R.add("latency_stats", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.5), 6) AS p50,
round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def latency_stats(t):
    e = t("events")
    shares = {"p50": 0.5, "p95": 0.95}
    places = {f"{side}_{name}": partial(P.PLACES[side], f=f) for name, f in shares.items() for side in ("lower", "upper")}
    at = A.order_statistics(e, "event_type", "value", places)
    at = at.select("event_type", *[F.round(P.between(F.col(f"lower_{name}"), F.col(f"upper_{name}"), F.col("n"), f), 6).alias(name) for name, f in shares.items()])
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return g.join(at, "event_type", "left")


@R.add("wilson_interval", """
WITH g AS (SELECT lang, sum(quality) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), p AS (SELECT *, k / n AS p FROM g)
SELECT lang, k AS successes, n, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS low,
round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS high FROM p""")
def wilson_interval(t):
    g = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("successes"), F.count("*").alias("n"))
    low, high = P.wilson(F.col("successes"), F.col("n"))
    return g.select("lang", "successes", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@R.add("fixed_bin_histogram", """
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT least(floor((value - lo) / ((hi - lo) / 12)), 11)::BIGINT AS bin, count(*) AS n FROM events, b GROUP BY 1""")
def fixed_bin_histogram(t):
    e = t("events")
    lo, hi = e.agg(F.min("value"), F.max("value")).first()
    lo, hi = (lo, hi) if lo is not None else (0.0, 1.0)
    return e.groupBy(F.least(F.floor((F.col("value") - F.lit(lo)) / F.lit((hi - lo) / 12)), F.lit(11)).alias("bin")).agg(F.count("*").alias("n"))


@R.add("token_profile", """
SELECT lang, sum(len(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.:/+-]+')))::BIGINT AS tokens, sum(length(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g')))::BIGINT AS kept
FROM documents GROUP BY 1""")
def token_profile(t):
    return t("documents").groupBy("lang").agg(F.sum(F.size(text_tokens(F.col("text")))).alias("tokens"), F.sum(F.length(benchmark_text(F.col("text")))).alias("kept"))


@R.add("normalized_dedupe_stats", """
WITH q AS (SELECT regexp_replace(lower(text), '[\\s,，。.;；:：!！?？、]+', '', 'g') AS k FROM documents)
SELECT count(*) AS n_rows, count(DISTINCT k) AS unique_texts, round((count(*) - count(DISTINCT k)) / count(*), 9) AS duplicate_rate FROM q""")
def normalized_dedupe_stats(t):
    # Digests stand for the texts, so that distinct counting moves 16 bytes a row.
    q = t("documents").select(F.md5(normalize_query(F.col("text"))).alias("k"))
    return q.agg(F.count("*").alias("n_rows"), F.countDistinct("k").alias("unique_texts")).withColumn("duplicate_rate", F.round((F.col("n_rows") - F.col("unique_texts")) / F.col("n_rows"), 9))


@R.add("integer_answer_contract", """
WITH q AS (SELECT item_id, text || chr(10) || '#### ' || (item_id * 1037) AS a FROM benchmark)
SELECT item_id, (item_id * 1037)::VARCHAR AS strict, (item_id * 1037)::VARCHAR AS loose, (CASE WHEN item_id % 2 = 0 THEN 0.95 ELSE 0.0 END)::DOUBLE + 0.05::DOUBLE AS reward FROM q""")
def integer_answer_contract(t):
    n = (F.col("item_id") * 1037).cast("string")
    a = t("benchmark").select("item_id", F.concat("text", F.lit("\n#### "), n).alias("a"), F.when(F.col("item_id") % 2 == 0, n).otherwise("no").alias("gold"))
    s = integer_answer(F.col("a"))
    return a.select("item_id", s.alias("strict"), last_integer(F.col("a")).alias("loose"), (F.when(s == F.col("gold"), 0.95).otherwise(0.0) + F.when(s.isNotNull(), 0.05).otherwise(0.0)).alias("reward"))
