"""Aggregates described by a small plan: conditions, a count, its breakdowns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import split_values


@dataclass(frozen=True)
class Condition:
    """``field`` contains, equals or is in any of ``values``, without regard to case. An empty field or list holds always."""

    field: str
    op: str
    values: tuple[str, ...]

    def column(self) -> Column:
        if not self.field or not self.values:
            return F.lit(True)
        value = F.lower(F.coalesce(F.col(self.field).cast("string"), F.lit("")))
        wanted = [v.lower() for v in self.values]
        if self.op == "contains":
            return reduce(or_, [value.contains(v) for v in wanted])
        return value.isin(wanted)


@dataclass(frozen=True)
class Plan:
    """count_records, or count_unique of ``count_field``; ``dedupe_field`` names what the deduplicated count counts."""

    operation: str = "count_records"
    count_field: str = ""
    dedupe_field: str = ""
    logic: str = "all"
    conditions: tuple[Condition, ...] = field(default_factory=tuple)

    def where(self) -> Column:
        if not self.conditions:
            return F.lit(True)
        return reduce(and_ if self.logic == "all" else or_, [c.column() for c in self.conditions])


def structured_count(df: DataFrame, plan: Plan) -> DataFrame:
    """One row: records that meet the plan's conditions and the distinct non-empty values of its count or dedupe field."""
    name = plan.count_field if plan.operation == "count_unique" else plan.dedupe_field
    value = F.when(F.col(name).cast("string") != "", F.col(name).cast("string")) if name else F.lit(None).cast("string")
    out = df.filter(plan.where()).agg(F.count("*").alias("record_count"), F.countDistinct(value).alias("unique_count"))
    answer = "unique_count" if plan.operation == "count_unique" else "record_count"
    return out.withColumn("answer", F.col(answer))


def sample_values(df: DataFrame, plan: Plan, name: str, n: int = 20) -> DataFrame:
    """The first ``n`` distinct values of a field among the records that meet the plan, in order."""
    return df.filter(plan.where()).select(F.col(name).cast("string").alias("value")).filter("value != ''").distinct().orderBy("value").limit(n)


def long_form(df: DataFrame, fields: list[str], *keep: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return df.select(*keep, pairs.alias("__p")).select(*keep, "__p.field", "__p.value").filter("value IS NOT NULL AND value != ''")


def breakdown(df: DataFrame, fields: list[str], unique: str, top: int = 12) -> DataFrame:
    """For each field, the ``top`` values by record count, with the number of distinct ``unique`` values."""
    counts = long_form(df.withColumn("__u", F.col(unique)), fields, "__u").groupBy("field", "value").agg(F.count("*").alias("record_count"), F.countDistinct("__u").alias("unique_count"))
    order = Window.partitionBy("field").orderBy(F.desc("record_count"), "value")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def value_profile(df: DataFrame, fields: list[str], top: int = 30) -> DataFrame:
    """The most frequent values of each field: count descending, value ascending."""
    counts = long_form(df, fields).groupBy("field", "value").count()
    order = Window.partitionBy("field").orderBy(F.desc("count"), "value")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).withColumnRenamed("count", "n")


def multivalue_counts(df: DataFrame, name: str, sep: str = r"[,，/、]") -> DataFrame:
    """How often each item occurs in a field that lists several."""
    return df.select(F.explode(split_values(F.col(name), sep)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def preferred_rows(df: DataFrame, preferred: Column) -> DataFrame:
    """The rows that meet the preference, or all rows if none does: one scalar decides, no row moves."""
    some = bool(df.filter(preferred).limit(1).count())
    return df.filter(preferred) if some else df


def mutual_information(df: DataFrame, nuisance: str, label: str, base: str = "log2") -> DataFrame:
    """Mutual information of two columns, in bits (log2) or nats (ln), from their joint counts."""
    joint = df.groupBy(F.col(nuisance).alias("x"), F.col(label).alias("y")).agg(F.count("*").alias("n"))
    of = lambda *c: F.sum("n").over(Window.partitionBy(*c))  # noqa: E731  windows over the joint counts only
    p = joint.select("n", of("x").alias("nx"), of("y").alias("ny"), of().alias("total"))
    log = F.log2 if base == "log2" else F.log
    return p.agg(F.sum(F.col("n") / F.col("total") * log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mutual_information"))


def distribution_shift(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Shares of each value in two tables, their difference, and the total variation distance on every row."""
    share = lambda df, c: df.groupBy(F.col(name).alias("value")).count().withColumn(c, F.col("count") / F.sum("count").over(Window.partitionBy())).drop("count")
    both = share(a, "share_a").join(share(b, "share_b"), "value", "full").na.fill(0.0, ["share_a", "share_b"])
    both = both.withColumn("delta", F.col("share_b") - F.col("share_a"))
    return both.withColumn("total_variation", 0.5 * F.sum(F.abs("delta")).over(Window.partitionBy()))


def order_statistics(df: DataFrame, group: str, value: str, places: dict[str, Callable[[Column], Column]], cuts: int = 64) -> DataFrame:
    """For each group the values at given places of its sorted values: (group, n, a column for each place).

    ``places`` map a name to a function from the number of values to a place from 0; a place outside gives null. Null values are left
    out. Rows are counted by value; a group's distinct values are cut into ranges at approximate quantiles, whose sketch has a bounded
    size, the exact counts of ranges tell which of them hold a place, and only these are sorted: no group is sorted or gathered whole.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("__g"), F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    marks = counts.groupBy(F.col("__g").alias("__mg")).agg(F.percentile_approx("__v", [k / cuts for k in range(1, cuts)], 1000).alias("__marks"))
    ranged = counts.join(marks, F.col("__g").eqNullSafe(F.col("__mg"))).withColumn("__b", F.size(F.filter("__marks", lambda m: m < F.col("__v")))).select("__g", "__v", "__n", "__b")
    per = ranged.groupBy(F.col("__g").alias("__wg"), F.col("__b").alias("__wb")).agg(F.sum("__n").alias("__in"))  # one row for each range
    per = per.withColumns({"__upto": F.sum("__in").over(Window.partitionBy("__wg").orderBy("__wb")), "n": F.sum("__in").over(Window.partitionBy("__wg"))})
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("at")) for name, place in places.items()]))
    asked = per.withColumn("__a", asked).filter((F.col("__a.at") < F.col("__upto")) & (F.col("__a.at") >= F.col("__upto") - F.col("__in")))
    asked = asked.groupBy("__wg", "__wb", "n", (F.col("__upto") - F.col("__in")).alias("__before")).agg(F.collect_list("__a").alias("__asked"))  # at most one entry for each place
    inside = ranged.join(asked, F.col("__g").eqNullSafe(F.col("__wg")) & (F.col("__b") == F.col("__wb")))
    last = F.col("__before") + F.sum("__n").over(Window.partitionBy("__g", "__b").orderBy("__v"))
    hits = inside.withColumn("__last", last).select("__g", "n", "__v", "__n", "__last", F.explode("__asked").alias("__a"))
    hits = hits.filter((F.col("__a.at") < F.col("__last")) & (F.col("__a.at") >= F.col("__last") - F.col("__n")))
    return hits.groupBy(F.col("__g").alias(group), "n").agg(*[F.max(F.when(F.col("__a.name") == name, F.col("__v"))).alias(name) for name in places])
