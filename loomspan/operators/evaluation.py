"""Summaries of evaluation runs, repeats, support, comparisons and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.datasets import numbered


def share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def run_summary(steps: DataFrame, case: str, category: str, score: str, passed: Column) -> DataFrame:
    """Means over steps, over cases and over categories of case means, and the share of cases with every step passed."""
    cases = steps.groupBy(case, category).agg(F.avg(score).alias("mean"), F.sum(score).alias("total"), F.count("*").alias("steps"), F.bool_and(passed).alias("ok"))
    per_category = cases.groupBy(category).agg(F.avg("mean").alias("mean"), F.sum("total").alias("total"), F.sum("steps").alias("steps"), F.sum("mean").alias("case_sum"), F.count("*").alias("cases"), F.sum(F.col("ok").cast("int")).alias("ok"))
    return per_category.agg(
        F.sum("steps").alias("steps"), F.sum("cases").alias("cases"), (F.sum("total") / F.sum("steps")).alias("step_mean"),
        (F.sum("case_sum") / F.sum("cases")).alias("case_macro"), F.avg("mean").alias("category_macro"), (F.sum("ok") / F.sum("cases")).alias("pass_rate"),
    )


def support_groups(samples: DataFrame, group: list[str], reward: str, action: str) -> DataFrame:
    """Reward statistics of each sampled group, with the population deviation."""
    return samples.groupBy(*group).agg(
        F.avg(reward).alias("mean_reward"), F.coalesce(F.stddev_pop(reward), F.lit(0.0)).alias("reward_std"), F.min(reward).alias("min_reward"),
        F.max(reward).alias("max_reward"), F.countDistinct(action).alias("distinct_actions"),
    )


def support_summary(groups: DataFrame, category: str, step: str, positive: float = 0.95, usable: float = 0.75) -> DataFrame:
    """Support rates overall, by category, by step and by both, in one aggregate over grouping sets."""
    spread = F.col("reward_std") > 1e-6
    return groups.groupingSets([[], [category], [step], [category, step]], category, step).agg(
        F.grouping_id().alias("scope"), F.count("*").alias("groups"), F.avg("mean_reward").alias("mean_reward"), F.avg("reward_std").alias("mean_group_std"),
        share(spread).alias("nonzero_std_rate"), share(F.col("max_reward") >= positive).alias("positive_support_rate"),
        share(spread & (F.col("max_reward") >= usable)).alias("usable_support_rate"), share(F.col("min_reward") >= positive).alias("fully_saturated_rate"),
        F.avg("distinct_actions").alias("mean_distinct_actions"),
    )


def pass_all_any(results: DataFrame, case: str, run: str, passed: Column) -> DataFrame:
    """Over all cases: the share that pass in every run, in any run, and in some but not all. Cases missing from a run pass neither way."""
    runs = results.select(run).distinct().count()
    cases = results.groupBy(case).agg(F.countDistinct(run).alias("seen"), F.bool_and(passed).alias("all_ok"), F.bool_or(passed).alias("any_ok"))
    full = F.col("seen") == runs
    return cases.agg(F.count("*").alias("cases"), share(full & F.col("all_ok")).alias("pass_all"), share(full & F.col("any_ok")).alias("pass_any"), share(full & F.col("any_ok") & ~F.col("all_ok")).alias("flaky"))


def repeat_stability(runs: DataFrame, run: str, score: str) -> DataFrame:
    """Mean, sample deviation (0 for one run), least and most of the runs' means."""
    means = runs.groupBy(run).agg(F.avg(score).alias("m"))
    return means.agg(F.count("*").alias("runs"), F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("stdev"), F.min("m").alias("least"), F.max("m").alias("most"))


def paired(left: DataFrame, right: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Both runs' scores on the keys they share, and the difference."""
    a, b = left.withColumnRenamed(score, "left_score"), right.select(*keys, F.col(score).alias("right_score"))
    return a.join(b, keys).withColumn("delta", F.col("right_score") - F.col("left_score"))


def delta_counts(pairs: DataFrame) -> DataFrame:
    """Improved, unchanged and regressed pairs; a difference up to 1e-12 is none."""
    d = F.col("delta")
    return pairs.agg(F.count("*").alias("steps"), F.count_if(d > 1e-12).alias("improved"), F.count_if(F.abs(d) <= 1e-12).alias("unchanged"), F.count_if(d < -1e-12).alias("regressed"), F.avg(d).alias("mean_delta"))


def contingency(pairs: DataFrame, base: Column, reference: Column) -> DataFrame:
    return pairs.agg(
        F.count_if(base & reference).alias("both"), F.count_if(~base & ~reference).alias("neither"), F.count_if(base & ~reference).alias("base_only"),
        F.count_if(~base & reference).alias("reference_only"), share(base).alias("base_rate"), share(reference).alias("reference_rate"),
    )


def bootstrap(clusters: DataFrame, cluster: str, total: str, count: str, samples: int, seed: int = 7) -> DataFrame:
    """Means of resampled clusters: (replicate, mean).

    Clusters come pre-aggregated to a sum and a count, and are numbered in order of a digest, by ranges of it. Draw d of replicate r
    takes the cluster whose number is a digest of (seed, r, d) modulo the number of clusters; draws are counted per (replicate, cluster
    number) before they meet the clusters in an equi-join, and no random state is kept, so the result is the same on any number of
    machines and in SQL.
    """
    keyed = clusters.select(cluster, total, count, F.md5(F.col(cluster).cast("string")).alias("__k"))
    places = numbered(keyed, [], "__k", cluster).withColumn("__no", F.col("__place") - 1)
    n = clusters.count()
    draws = clusters.sparkSession.range(samples * n).select(F.floor(F.col("id") / n).alias("replicate"), (F.col("id") % n).alias("draw"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("draw").cast("string"))
    number = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n
    counts = draws.groupBy("replicate", number.alias("__no")).agg(F.count("*").alias("times"))
    return counts.join(places, "__no").groupBy("replicate").agg((F.sum(F.col("times") * F.col(total)) / F.sum(F.col("times") * F.col(count))).alias("mean"))


def interval(means: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Bounds sorted[min(n - 1, int(f n))] of the replicates' means."""
    from loomspan.functions.percentiles import truncating

    values = F.array_sort(F.collect_list("mean"))  # one number a replicate
    return means.agg(values.alias("v")).select(truncating(F.col("v"), low).alias("low"), truncating(F.col("v"), high).alias("high"))


def gate_checks(observed: DataFrame, checks: list[tuple[str, str, float]]) -> DataFrame:
    """A row for each check: the observed metric, operator, threshold and whether it holds; a missing metric fails."""
    holds = {">=": lambda c, t: c >= t, "<=": lambda c, t: c <= t, ">": lambda c, t: c > t, "<": lambda c, t: c < t, "==": lambda c, t: c == t}
    rows = F.array(*[
        F.struct(F.lit(f"{m} {op}").alias("name"), F.col(m).cast("double").alias("observed"), F.lit(op).alias("op"), F.lit(float(t)).alias("threshold"), F.coalesce(holds[op](F.col(m), t), F.lit(False)).alias("passed"))
        for m, op, t in checks
    ])
    return observed.select(F.explode(rows).alias("c")).select("c.*")


def admission(items: DataFrame, group: str, ok: Column, order: str, n: int = 4) -> DataFrame:
    """The first ``n`` admitted items of each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return items.filter(ok).withColumn("place", place).filter(F.col("place") <= n)


def set_scores(expected: Column, predicted: Column) -> Column:
    """Precision, recall, F1 and hit of two sets, with the rules for empty ones."""
    inter = F.size(F.array_intersect(expected, predicted)).cast("double")
    n_e, n_p = F.size(F.array_distinct(expected)), F.size(F.array_distinct(predicted))
    p, r = inter / F.greatest(n_p, F.lit(1)), inter / F.greatest(n_e, F.lit(1))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    four = lambda a, b, c, d: F.struct(*[F.lit(x).cast("double").alias(k) for x, k in zip((a, b, c, d), ("precision", "recall", "f1", "hit"), strict=True)])
    return (
        F.when((n_e == 0) & (n_p == 0), four(1, 1, 1, 1)).when(n_e == 0, four(0, 1, 0, 1)).when(n_p == 0, four(0, 0, 0, 0))
        .otherwise(F.struct(p.alias("precision"), r.alias("recall"), f1.alias("f1"), F.when(inter > 0, 1.0).otherwise(0.0).alias("hit")))
    )


def char_f1(pairs: DataFrame, key: str, reference: Column, answer: Column) -> DataFrame:
    """F1 of the multisets of normalised characters of two texts; 1 if both are empty, 0 if one is."""
    count = lambda c, side: F.transform(F.array_distinct(F.split(c, "")), lambda x: F.struct(x.alias("ch"), (F.length(c) - F.length(F.replace(c, x, F.lit("")))).alias(side)))
    rows = pairs.select(key, reference.alias("r"), answer.alias("a"))
    rows = rows.withColumns({"rc": count(F.col("r"), "n"), "ac": F.map_from_entries(count(F.col("a"), "n"))})
    common = F.aggregate("rc", F.lit(0), lambda s, x: s + F.when(x["ch"] == "", 0).otherwise(F.least(x["n"], F.coalesce(F.col("ac")[x["ch"]], F.lit(0)))))
    p, q = common / F.length("a"), common / F.length("r")
    f1 = F.when((F.length("r") == 0) & (F.length("a") == 0), 1.0).when((F.length("r") == 0) | (F.length("a") == 0) | (common == 0), 0.0).otherwise(2 * p * q / (p + q))
    return rows.select(key, f1.alias("char_f1"))
