"""Gates over evaluation runs: metric blocks, validity, support, comparisons of models and seeds, and audit tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_blocks(rows: DataFrame, levels: Sequence[str], exact: Column, strict: Column) -> DataFrame:
    """Rows, exact and strict rates over all rows and for each value of each level, in one aggregation. ``scope`` and ``value`` tell the block."""
    each = F.array(F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("scope"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in levels])
    long = rows.select(F.explode(each).alias("b"), exact.cast("double").alias("e"), strict.cast("double").alias("s"))
    return long.groupBy("b.scope", "b.value").agg(F.count("*").alias("n"), F.avg("e").alias("exact_rate"), F.avg("s").alias("strict_rate"))


def prediction_stats(cases: DataFrame, decisions: Column, truncated: Column, error: Column) -> DataFrame:
    """Over cases with their decisions: cases without one, decisions in all, truncated cases, and cases for each kind of error (``none`` if null)."""
    rows = cases.select(F.coalesce(F.size(decisions), F.lit(0)).alias("d"), F.coalesce(truncated, F.lit(False)).alias("t"), F.coalesce(error, F.lit("none")).alias("e"))
    return rows.groupBy(F.col("e").alias("error")).agg(F.count("*").alias("cases"), F.count_if(F.col("d") <= 0).alias("empty"), F.sum(F.greatest("d", F.lit(0))).alias("decisions"), F.count_if("t").alias("truncated"))


def operational_metrics(cases: DataFrame, attempts: str, valid: str, clipped: str) -> DataFrame:
    """Rates of valid and clipped attempts over all attempts; a case without any counts as one attempt that is neither."""
    one = cases.select(F.explode_outer(attempts).alias("a"))
    rate = lambda f: F.avg(F.coalesce(F.col("a")[f], F.lit(False)).cast("int"))
    return one.agg(F.count("*").alias("attempts"), rate(valid).alias("json_valid_rate"), rate(clipped).alias("clipped_rate"))


def operational_validity(runs: DataFrame, run: str, cases: Column, expected: int, valid_rate: Column, clipped_rate: Column, least_valid: float = 0.95, most_clipped: float = 0.05) -> DataFrame:
    """Whether each run may be judged at all: complete, nearly all attempts readable, few cut off. Missing numbers do not pass."""
    checks = {"complete": cases == expected, "readable": valid_rate >= least_valid, "uncut": clipped_rate <= most_clipped}
    parts = [F.coalesce(ok, F.lit(False)).alias(name) for name, ok in checks.items()]
    return runs.select(run, *parts).withColumn("valid", F.col("complete") & F.col("readable") & F.col("uncut"))


def scoped_support(cells: DataFrame, inside: Column, weight: str, metric: str) -> DataFrame:
    """The mean of a metric over the cells chosen, weighted by their groups; a missing metric counts as 0, no weight gives 0."""
    w = F.when(inside, F.col(weight)).otherwise(0)
    return cells.agg(F.coalesce(F.sum(w * F.coalesce(F.col(metric), F.lit(0.0))) / F.nullif(F.sum(w), F.lit(0)), F.lit(0.0)).alias("support"), F.sum(w).alias("groups"))


def development_gate(scores: DataFrame, group: str, arm: str, score: str, base: str, candidate: str, least_gain: float, most_loss: float) -> DataFrame:
    """A row for each group and one for all (null group): means of two arms, their difference, and whether it passes: the whole must
    gain at least ``least_gain``, no group may lose more than ``most_loss``, and an arm that is missing does not pass."""
    mean = lambda name: F.avg(F.when(F.col(arm) == name, F.col(score)))
    rows = scores.filter(F.col(arm).isin(base, candidate)).groupingSets([[F.col(group)], []], F.col(group)).agg(F.grouping_id().alias("whole"), mean(base).alias("base"), mean(candidate).alias("candidate"))
    delta = F.col("candidate") - F.col("base")
    ok = F.when(F.col("whole") == 1, delta >= least_gain).otherwise(delta >= -most_loss)
    return rows.select(group, (F.col("whole") == 1).alias("overall"), "base", "candidate", delta.alias("delta"), F.coalesce(ok, F.lit(False)).alias("passed"))


def seed_gate(seeds: DataFrame, seed: str, delta: str, expected: int, least_mean: float, least_wins: int) -> DataFrame:
    """Over the seeds of one candidate: all there, mean gain, how many gain, and whether all three suffice."""
    per = seeds.groupBy(seed).agg(F.avg(delta).alias("d"))
    out = per.agg(F.count("*").alias("seeds"), F.avg("d").alias("mean_delta"), F.count_if(F.col("d") > 0).alias("wins"))
    return out.withColumn("passed", F.coalesce((F.col("seeds") == expected) & (F.col("mean_delta") >= least_mean) & (F.col("wins") >= least_wins), F.lit(False)))


def separation(models: DataFrame, model: str, score: str, order: Sequence[str], least: float) -> DataFrame:
    """For each pair of neighbours in a list of models from weak to strong: their means, the gap, and whether it is ``least`` or more."""
    means = models.groupBy(model).agg(F.avg(score).alias("mean"))
    pairs = models.sparkSession.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)], "weak string, strong string")
    side = lambda name: means.select(F.col(model).alias(name), F.col("mean").alias(f"{name}_mean"))
    both = pairs.join(side("weak"), "weak", "left").join(side("strong"), "strong", "left")
    gap = F.col("strong_mean") - F.col("weak_mean")
    return both.select("weak", "strong", "weak_mean", "strong_mean", gap.alias("gap"), F.coalesce(gap >= least, F.lit(False)).alias("separated"))


def audit_table(reference: DataFrame, results: DataFrame, key: str, run: str, value: str, runs: Sequence[str]) -> DataFrame:
    """Every reference row with the value of each run beside it (null where a run has none) and how many runs have the reference's value."""
    wide = results.groupBy(key).pivot(run, list(runs)).agg(F.min(value))
    out = reference.select(key, F.col(value).alias("expected")).join(wide, key, "left")
    agree = sum((F.coalesce(F.col(r) == F.col("expected"), F.lit(False)).cast("int") for r in runs), F.lit(0))
    return out.withColumn("agree", agree)


def rescored(samples: DataFrame, steps: DataFrame, key: Sequence[str], score: Column, most: int = 500_000) -> DataFrame:
    """Samples scored again against the step rows they belong to; a sample without its step row stays, unscored. Both are dealt by the key
    to so many tasks that each gets about ``most`` samples, so more samples make more tasks and not larger ones; a later grouping by the
    key and more stays in these tasks."""
    n = max(samples.sparkSession.sparkContext.defaultParallelism, -(-samples.count() // most))
    return samples.repartition(n, *key).join(steps.repartition(n, *key).hint("merge"), list(key), "left").withColumn("rescored", score)


def two_score_audit(rows: DataFrame, group: str, first: str, second: str, low: float = 0.8) -> DataFrame:
    """For each group: rows, mean scores, rows below ``low`` by each score and by both."""
    a, b = F.col(first) < low, F.col(second) < low
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(first).alias("first_mean"), F.avg(second).alias("second_mean"), F.count_if(a).alias("first_low"), F.count_if(b).alias("second_low"), F.count_if(a & b).alias("both_low"))


def log_summary(log: DataFrame, run: str, step: str, loss: str, reward: str, runtime: str | None = None) -> DataFrame:
    """For each run: its last step, mean loss over steps with a reward, first and last reward, and the sum of runtimes."""
    rewarded = F.col(reward).isNotNull()
    total = F.sum(runtime) if runtime else F.lit(None).cast("double")
    return log.groupBy(run).agg(
        F.max(step).alias("last_step"), F.count_if(rewarded).alias("reward_steps"), F.avg(F.when(rewarded, F.col(loss))).alias("mean_loss"),
        F.min_by(F.when(rewarded, F.col(reward)), F.when(rewarded, F.col(step))).alias("first_reward"), F.max_by(F.when(rewarded, F.col(reward)), F.when(rewarded, F.col(step))).alias("last_reward"), total.alias("runtime"),
    )


def family_order(steps: DataFrame, family: str, case: str, ordinal: str) -> DataFrame:
    """Families in order of first appearance, with the most steps that one of their cases has."""
    per_case = steps.groupBy(family, case).agg(F.min(ordinal).alias("o"), F.count("*").alias("k"))
    return per_case.groupBy(family).agg(F.min("o").alias("first_seen"), F.max("k").alias("max_steps"))


def image_labels(boxes: DataFrame, image: str, label: str, wanted: Sequence[str]) -> DataFrame:
    """For each image: its boxes, its distinct labels in order, and the wanted labels it misses."""
    have = F.array_sort(F.collect_set(label))  # as many as there are labels
    out = boxes.groupBy(image).agg(F.count("*").alias("boxes"), have.alias("labels"))
    return out.withColumn("missing", F.array_except(F.array(*map(F.lit, wanted)), F.col("labels")))
