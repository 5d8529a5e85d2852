"""Audits of data sets and runs: coverage, shards, overlaps, strictness, headroom, side effects, rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.evaluation import share


def coverage(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(key, state) of every key that is ``missing`` among the results, or ``unexpected`` there; none of either: an empty table."""
    a = expected.select(key).distinct().withColumn("__e", F.lit(True))
    b = got.select(key).distinct().withColumn("__g", F.lit(True))
    both = a.join(b, key, "full")
    state = F.when(F.col("__g").isNull(), "missing").when(F.col("__e").isNull(), "unexpected")
    return both.select(key, state.alias("state")).filter("state IS NOT NULL")


def contiguous_shards(shards: DataFrame, run: str, offset: str, rows: str, total: str) -> DataFrame:
    """For each run: its shards, the rows they hold, gaps or overlaps between neighbours, and whether they make up the whole."""
    order = Window.partitionBy(run).orderBy(offset)
    want = F.coalesce(F.lag(F.col(offset) + F.col(rows)).over(order), F.lit(0))
    marked = shards.withColumn("__broken", (F.col(offset) != want).cast("int"))
    out = marked.groupBy(run).agg(F.count("*").alias("shards"), F.sum(rows).alias("rows"), F.sum("__broken").alias("breaks"), F.countDistinct(total).alias("__totals"), F.max(total).alias("__total"))
    return out.select(run, "shards", "rows", "breaks", ((F.col("breaks") == 0) & (F.col("__totals") == 1) & (F.col("rows") == F.col("__total"))).alias("complete"))


def file_overlaps(rows: DataFrame, others: DataFrame, key: str, file: str) -> DataFrame:
    """For each other file, how many of its distinct keys the rows have too."""
    return others.select(file, key).distinct().join(rows.select(key).distinct(), key, "left_semi").groupBy(file).agg(F.count("*").alias("overlap"))


def case_statistics(cases: DataFrame, case: str, query: Column, category: str) -> DataFrame:
    """For each category: rows, distinct ids and distinct normalised queries; digests stand for the queries."""
    rows = cases.select(category, case, F.md5(query).alias("__q"))
    return rows.groupBy(category).agg(F.count("*").alias("cases"), F.countDistinct(case).alias("unique_ids"), F.countDistinct("__q").alias("unique_queries"))


def step_duplicates(steps: DataFrame, case: str, *same: Column) -> DataFrame:
    """Rows, exact repeats of the columns ``same``, their share, and most rows of one case."""
    rows = steps.select(case, F.md5(F.to_json(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(same)]), {"ignoreNullFields": "false"})).alias("__h"))
    whole = rows.agg(F.count("*").alias("n_rows"), F.countDistinct("__h").alias("__u"))
    most = rows.groupBy(case).count().agg(F.max("count").alias("most_rows_per_case"))
    both = whole.join(F.broadcast(most))  # one row each
    extra = F.col("n_rows") - F.col("__u")
    return both.select("n_rows", extra.alias("duplicates"), (extra / F.greatest(F.col("n_rows"), F.lit(1))).alias("duplicate_rate"), "most_rows_per_case")


def strict_summary(steps: DataFrame, case: str, category: str, matched: Column, score: str, side_effect: Column) -> DataFrame:
    """Overall and for each category: steps, cases, share of matching steps, share of cases with every step matching, side effects.

    Steps are summed up per case first, so a category with most of all steps adds one row a case to the second step."""
    cases = steps.groupBy(category, case).agg(
        F.count("*").alias("s"), F.sum(matched.cast("int")).alias("m"), F.sum(score).alias("v"), F.bool_and(matched).alias("ok"), F.sum(side_effect.cast("int")).alias("w")
    )
    out = cases.groupingSets([[], [category]], category).agg(
        F.grouping_id().alias("scope"), F.sum("s").alias("steps"), F.count("*").alias("cases"), (F.sum("m") / F.sum("s")).alias("match_rate"),
        (F.sum("v") / F.sum("s")).alias("mean_score"), share(F.col("ok")).alias("strict_case_rate"), F.sum("w").alias("side_effects"),
    )
    return out


def headroom(results: DataFrame, case: str, category: str, score: str, passed: Column) -> DataFrame:
    """For each category: cases, mean of case means, shares that pass all and any runs, flaky cases, and what is left to gain."""
    cases = results.groupBy(category, case).agg(F.avg(score).alias("m"), F.bool_and(passed).alias("a"), F.bool_or(passed).alias("o"))
    out = cases.groupBy(category).agg(
        F.count("*").alias("cases"), F.avg("m").alias("mean_score"), share(F.col("a")).alias("pass_all"), share(F.col("o")).alias("pass_any"),
        F.count_if(F.col("o") & ~F.col("a")).alias("flaky"),
    )
    return out.withColumns({"mean_headroom": 1 - F.col("mean_score"), "pass_headroom": 1 - F.col("pass_all")})


def reason_counts(results: DataFrame, case: str, reasons: Column) -> DataFrame:
    """How often each reason occurs, and in how many distinct cases."""
    rows = results.select(case, F.explode(reasons).alias("reason")).groupBy("reason", case).agg(F.count("*").alias("n"))
    return rows.groupBy("reason").agg(F.sum("n").alias("occurrences"), F.count("*").alias("cases"))


def family_stats(cases: DataFrame, family: str, strict: Column, route: Column) -> DataFrame:
    """For each family: shares of cases strictly right and right in their route, and the share of strict failures with a right route."""
    out = cases.groupBy(family).agg(
        F.count("*").alias("cases"), share(strict).alias("strict_pass_all"), share(route).alias("route_pass_all"), F.count_if(~strict).alias("strict_failed"),
        F.count_if(~route).alias("route_failed"), F.count_if(~strict & route).alias("argument_only"),
    )
    return out.withColumn("argument_only_share", F.when(F.col("strict_failed") > 0, F.col("argument_only") / F.col("strict_failed")).otherwise(0.0))


def action_changes(cases: DataFrame, stratum: str, candidate: Column, reference: Column) -> DataFrame:
    """Unwanted actions of two runs by stratum: hits of each, those that came and those that went. Arrays of a case are sets."""
    a, b = F.array_distinct(candidate), F.array_distinct(reference)
    rows = cases.select(stratum, F.size(a).alias("c"), F.size(b).alias("r"), F.size(F.array_except(a, b)).alias("i"), F.size(F.array_except(b, a)).alias("o"))
    out = rows.groupingSets([[], [stratum]], stratum).agg(
        F.grouping_id().alias("scope"), F.sum("c").alias("candidate_hits"), F.sum("r").alias("reference_hits"), F.sum("i").alias("introduced"), F.sum("o").alias("removed"),
        F.count_if((F.col("i") > 0) | (F.col("o") > 0)).alias("changed_cases"),
    )
    return out.withColumn("net_added", F.col("candidate_hits") - F.col("reference_hits"))


def arm_scopes(pairs: DataFrame, first: str, second: str, base: Column, reference: Column) -> DataFrame:
    """Pass rates of two arms and their two-by-two counts, overall and by each of two attributes, in one aggregate."""
    return pairs.groupingSets([[], [first], [second]], first, second).agg(
        F.grouping_id().alias("scope"), F.count("*").alias("pairs"), share(base).alias("base_rate"), share(reference).alias("reference_rate"),
        F.count_if(base & reference).alias("both"), F.count_if(~base & ~reference).alias("neither"), F.count_if(base & ~reference).alias("base_only"), F.count_if(~base & reference).alias("reference_only"),
    )


def bundle_checks(rows: DataFrame, bundle: str, role: str, roles: int, constant: Sequence[str]) -> DataFrame:
    """Bundles of matched rows: their size and distinct roles, which attributes vary that must not, and whether all is well."""
    vary = [F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"__v{k}") for k, c in enumerate(constant)]
    out = rows.groupBy(bundle).agg(F.count("*").alias("size"), F.countDistinct(role).alias("n_roles"), *vary)
    varying = F.array_compact(F.array(*[F.when(F.col(f"__v{k}") > 1, c) for k, c in enumerate(constant)]))
    out = out.withColumn("varying", F.array_join(varying, ","))
    return out.select(bundle, "size", "n_roles", "varying", ((F.col("size") == roles) & (F.col("n_roles") == roles) & (F.col("varying") == "")).alias("ok"))


def violations(rows: DataFrame, id_col: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(id, rule) for each rule a row breaks. A rule is the condition that must hold; null breaks it."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]))
    return rows.select(id_col, F.explode(broken).alias("rule"))


def repeated_ids(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")


def expected_grid(a: DataFrame, b: DataFrame, got: DataFrame, left: str, right: str) -> DataFrame:
    """Combinations of the values of two short lists that ``got`` has not exactly once: (left, right, n).

    The grid is built from the distinct values of each list, not from rows.
    """
    grid = a.select(left).distinct().withColumn("__one", F.lit(1)).join(b.select(right).distinct().withColumn("__one", F.lit(1)), "__one").drop("__one")
    seen = got.groupBy(left, right).agg(F.count("*").alias("n"))
    return grid.join(seen, [left, right], "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n != 1")


def score_histogram(rows: DataFrame, score: Column, digits: int = 3) -> DataFrame:
    return rows.groupBy(F.round(score, digits).alias("score")).agg(F.count("*").alias("n"))


def weighted_range(rows: DataFrame, parts: dict[str, float]) -> DataFrame:
    """Least and most weighted sum of reward parts; missing parts and NaN are left out, rows with none at all count for nothing."""
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in parts}
    total = sum((F.coalesce(v * w, F.lit(0.0)) for (c, w), v in zip(parts.items(), clean.values(), strict=True)), F.lit(0.0))
    some = F.coalesce(*clean.values()).isNotNull()
    return rows.filter(some).agg(F.count("*").alias("n"), F.min(total).alias("least"), F.max(total).alias("most"))


def advantage_stats(rows: DataFrame, value: str) -> DataFrame:
    """Finite values only: mean, mean size, population deviation, share above zero."""
    v = F.col(value)
    finite = rows.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return finite.agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.avg(F.abs(v)).alias("mean_size"), F.stddev_pop(v).alias("deviation"), share(v > 0).alias("positive"))


def trial_stats(trials: DataFrame, condition: str, value: str) -> DataFrame:
    """Mean, sample deviation (0 for one trial), coefficient of variation in percent, and percentiles of each condition."""
    out = trials.groupBy(condition).agg(
        F.count("*").alias("trials"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"),
        F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"),
    )
    return out.withColumn("cv_percent", F.when(F.col("mean") != 0, 100 * F.col("deviation") / F.col("mean")).otherwise(0.0))


def promote(candidates: DataFrame, checks: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The one candidate that passes every check and comes first in the order; no row if none passes."""
    rows = candidates
    for c in checks:
        rows = rows.filter(c)
    return rows.orderBy(*order).limit(1)


def adjacent_gates(ladder: DataFrame, order: str, value: str, margin: float = 0.0) -> DataFrame:
    """Steps of a short ladder with the next step's value, and whether it is higher by more than ``margin``."""
    later = F.lead(value).over(Window.orderBy(order))
    return ladder.select(order, value, later.alias("next"), (later > F.col(value) + margin).alias("rises"))
