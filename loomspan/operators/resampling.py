"""Comparison of arms and seeds by resampling; selection and merging of data set rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.percentiles import wilson


def ratio_interval(trials: DataFrame, arm: str, trial: str, value: str, numerator: str, denominator: str, samples: int, seed: int = 11) -> DataFrame:
    """One row: the ratio of two arms' means and its bootstrap interval.

    Draws are digests of seed, arm, replicate and draw modulo the arm's trials; they are counted per trial before they meet the values.
    """
    rows = trials.filter(F.col(arm).isin(numerator, denominator)).withColumn("__no", F.row_number().over(Window.partitionBy(arm).orderBy(trial)) - 1)
    sizes = {r[arm]: r["n"] for r in rows.groupBy(arm).agg(F.count("*").alias("n")).collect()}  # two rows
    spark = trials.sparkSession
    parts = []
    for name in (numerator, denominator):
        n = sizes.get(name, 0)
        draws = spark.range(samples * n).select(F.lit(name).alias(arm), F.floor(F.col("id") / max(n, 1)).alias("rep"), (F.col("id") % max(n, 1)).alias("d"))
        key = F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col("rep").cast("string"), F.col("d").cast("string"))
        parts.append(draws.withColumn("__no", F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % max(n, 1)))
    times = parts[0].unionByName(parts[1]).groupBy(arm, "rep", "__no").agg(F.count("*").alias("t"))
    means = times.join(rows, [arm, "__no"]).groupBy("rep").pivot(arm, [numerator, denominator]).agg(F.sum(F.col("t") * F.col(value)) / F.sum("t"))
    x = F.round(F.col(numerator) / F.col(denominator), 9)
    bounds = means.agg(F.round(F.percentile(x, F.lit(0.025)), 6).alias("low"), F.round(F.percentile(x, F.lit(0.975)), 6).alias("high"))
    mean = lambda name: F.avg(F.when(F.col(arm) == name, F.col(value)))
    whole = rows.agg(F.round(mean(numerator) / mean(denominator), 6).alias("ratio"))
    return bounds.join(F.broadcast(whole))  # one row each


def mean_over_seeds(rows: DataFrame, keys: Sequence[str], seed: str, score: str, seeds: int) -> DataFrame:
    """The mean score of each key over the seeds, for keys that every seed has."""
    out = rows.groupBy(*keys).agg(F.avg(score).alias("score"), F.countDistinct(seed).alias("__n"))
    return out.filter(F.col("__n") == seeds).drop("__n")


def reviewed(rows: DataFrame, reviews: DataFrame, key: str, status: str, order: str, known: Sequence[str]) -> DataFrame:
    """Rows with the status of their last review; ``missing`` where there is none or it is unknown."""
    last = reviews.groupBy(key).agg(F.max_by(status, order).alias("__s"))
    return rows.join(last, key, "left").withColumn("status", F.when(F.col("__s").isin(*known), F.col("__s")).otherwise("missing")).drop("__s")


def merged_rows(rows: DataFrame, key: str, order: str, source: str) -> DataFrame:
    """One row for each key: the first id, the sorted distinct sources, how many rows there were."""
    each = rows.groupBy(key, source).agg(F.min(order).alias("__o"), F.count("*").alias("__n"))
    return each.groupBy(key).agg(F.min("__o").alias("first_id"), F.array_sort(F.collect_list(source)).alias("sources"), F.sum("__n").alias("n"))


def replaced(rows: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with their value replaced where there is a new one. New keys that repeat or that no row has are an error."""
    bad = new.groupBy(key).count().filter("count > 1").select(key).unionByName(new.select(key).join(rows.select(key), key, "left_anti"))
    if first := bad.limit(1).collect():
        raise ValueError(f"{key} repeats or is unknown: {first[0][0]}")
    out = rows.join(new.select(key, F.col(value).alias("__v"), F.lit(True).alias("__r")), key, "left")
    return out.withColumns({value: F.when(F.col("__r"), F.col("__v")).otherwise(F.col(value)), "replaced": F.coalesce("__r", F.lit(False))}).drop("__v", "__r")


def focused(rows: DataFrame, query: Column, id_col: str, category: str, allowed: Sequence[str], capped: dict[str, int]) -> DataFrame:
    """The first row of each query, from allowed categories, and the first few of capped ones."""
    key = rows.withColumn("__k", F.md5(query))
    first = key.groupBy("__k").agg(F.min(id_col).alias(id_col))
    kept = rows.join(first.select(id_col), id_col, "left_semi")
    whole = kept.filter(F.col(category).isin(*allowed))
    place = F.row_number().over(Window.partitionBy(category).orderBy(id_col))
    limit = F.create_map(*[x for c, n in capped.items() for x in (F.lit(c), F.lit(n))])
    some = kept.filter(F.col(category).isin(*capped)).withColumn("__p", place).filter(F.col("__p") <= limit[F.col(category)]).drop("__p")
    return whole.unionByName(some)


def telemetry(rows: DataFrame, unit: str, power: str, seconds: float) -> DataFrame:
    """One row: units, the sum of their mean power, the peak, and energy in watt hours; no sum if any unit lacks readings."""
    per = rows.groupBy(unit).agg(F.avg(power).alias("m"), F.max(power).alias("p"), F.bool_and(F.col(power).isNotNull()).alias("full"))
    total = F.when(F.bool_and(F.col("full") & F.col("m").isNotNull()), F.sum("m"))
    return per.agg(F.count("*").alias("units"), total.alias("total_mean"), F.max("p").alias("peak"), (total * seconds / 3600).alias("energy"))


def templated(rows: DataFrame, group: str, order: Column, most: int, templates: int) -> DataFrame:
    """The first ``most`` rows of each group in the given order, which take the templates in turn."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("__r", r).filter(F.col("__r") <= most).withColumn("template", (F.col("__r") - 1) % templates).drop("__r")
