"""Confirmation of a candidate against a base: outcomes of cases, gates over all cases and each family, final objectives, support by samples, isolation of new rows, balance of factors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import evaluation

#: What a comparison may lack through rounding.
SLACK = 1e-12


@dataclass(frozen=True)
class Limits:
    """Bounds of a confirmation. A bound of None is not checked; ``mix`` fixes how many cases each kind has."""

    cases: int
    runs: int
    candidate_least: float = 0.95
    base_least: float | None = 0.08
    base_most: float = 0.80
    gap_least: float = 0.20
    route_failures_least: float | None = 0.15
    route_share_least: float | None = 0.70
    argument_share_most: float | None = 0.20
    family_candidate_least: float = 0.90
    family_base_most: float | None = 0.90
    readable_least: float = 0.95
    cut_most: float = 0.05
    mix: Mapping[str, int] = field(default_factory=dict)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def case_outcomes(attempts: DataFrame, arm: str, case: str, family: str, strict: Column, route: Column, readable: Column, cut: Column) -> DataFrame:
    """A row for each arm and case: (arm, case, family, runs, strict_all, route_all, readable, cut).

    A case holds strictly, or in its route, if every attempt does; null counts as no. A case has one family.
    """
    return attempts.groupBy(F.col(arm).alias("arm"), F.col(case).alias("case"), F.col(family).alias("family")).agg(
        F.count("*").alias("runs"), F.bool_and(_true(strict)).alias("strict_all"), F.bool_and(_true(route)).alias("route_all"),
        F.count_if(_true(readable)).alias("readable"), F.count_if(_true(cut)).alias("cut"),
    )


def _sums(arm: str) -> Column:
    """Counts of one arm's cases and attempts, as a struct of aggregates."""
    mine = F.col("arm") == arm
    s, r = F.col("strict_all"), F.col("route_all")
    runs = F.when(mine, F.col("runs"))
    return F.struct(
        F.count_if(mine).alias("n"), F.count_if(mine & s).alias("strict"), F.count_if(mine & ~r).alias("off_route"), F.count_if(mine & ~s & r).alias("argument"), F.min(runs).alias("fewest"),
        F.max(runs).alias("most"), F.sum(runs).alias("attempts"), F.sum(F.when(mine, F.col("readable"))).alias("readable"), F.sum(F.when(mine, F.col("cut"))).alias("cut"),
    )


def confirmation(outcomes: DataFrame, base: str, candidate: str, limits: Limits) -> DataFrame:
    """A row for each check: (family, check, value, least, most, passed); family is null for checks of the whole.

    One aggregation over families and the whole. The run counts of both arms must be ``limits.runs`` for every case. A rate over no
    cases is missing and does not pass. No outcomes give no rows, which ``verdict`` takes for a failure.
    """
    rows = outcomes.filter(F.col("arm").isin(base, candidate)).groupingSets([[F.col("family")], []], F.col("family")).agg(F.grouping_id().alias("whole"), _sums(base).alias("b"), _sums(candidate).alias("c"))
    rate = lambda a, x, n="n": F.try_divide(F.col(f"{a}.{x}"), F.col(f"{a}.{n}"))
    failed = F.col("b.n") - F.col("b.strict")
    share = lambda x: F.when(failed > 0, F.col(f"b.{x}") / failed).when(F.col("b.n") > 0, 0.0)
    both = lambda f, x: f(F.col(f"b.{x}"), F.col(f"c.{x}"))
    n = limits
    whole = [
        ("cases", both(F.least, "n"), n.cases, None), ("cases_at_most", both(F.greatest, "n"), None, n.cases),
        ("runs", both(F.least, "fewest"), n.runs, None), ("runs_at_most", both(F.greatest, "most"), None, n.runs),
        ("readable", F.least(rate("b", "readable", "attempts"), rate("c", "readable", "attempts")), n.readable_least, None),
        ("cut", F.greatest(rate("b", "cut", "attempts"), rate("c", "cut", "attempts")), None, n.cut_most),
        ("candidate", rate("c", "strict"), n.candidate_least, None), ("base", rate("b", "strict"), n.base_least, n.base_most),
        ("gap", rate("c", "strict") - rate("b", "strict"), n.gap_least, None), ("route_failures", rate("b", "off_route"), n.route_failures_least, None),
        ("route_share", share("off_route"), n.route_share_least, None), ("argument_share", share("argument"), None, n.argument_share_most),
    ]
    each = [("candidate", rate("c", "strict"), n.family_candidate_least, None), ("base", rate("b", "strict"), None, n.family_base_most)]
    checks = F.when(F.col("whole") == 1, _checks(whole)).otherwise(_checks(each))
    out = rows.select(F.when(F.col("whole") == 0, F.col("family")).alias("family"), F.explode(checks).alias("k")).select("family", "k.*")
    if not n.mix:
        return out
    want = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(v)).alias("least")) for k, v in n.mix.items()])
    have = outcomes.filter(F.col("arm") == base).groupBy(F.col("family").cast("string").alias("kind")).agg(F.count("*").cast("double").alias("value"))
    mixed = outcomes.sparkSession.range(1).select(F.explode(want).alias("w")).select("w.*").join(have, "kind", "full")
    mixed = mixed.select(F.lit(None).cast("string").alias("family"), F.concat(F.lit("mix "), F.col("kind")).alias("check"), "value", "least", F.col("least").alias("most"), _true(F.col("value") == F.col("least")).alias("passed"))
    return out.withColumn("family", F.col("family").cast("string")).unionByName(mixed)


def _checks(rows: Sequence[tuple[str, Column, float | None, float | None]]) -> Column:
    out = []
    for name, value, least, most in rows:
        if least is None and most is None:
            continue
        v = value.cast("double")
        low, high = F.lit(least).cast("double"), F.lit(most).cast("double")
        ok = (F.lit(True) if least is None else v >= low - SLACK) & (F.lit(True) if most is None else v <= high + SLACK)
        out.append(F.struct(F.lit(name).alias("check"), v.alias("value"), low.alias("least"), high.alias("most"), _true(ok).alias("passed")))
    return F.array(*out)


def verdict(checks: DataFrame) -> DataFrame:
    """One row: how many checks there are, the names of those that failed, whether all passed. Accepted or refused as a whole; no check is no pass."""
    name = F.concat_ws("/", F.col("family").cast("string"), F.col("check"))
    return checks.agg(F.count("*").alias("checks"), F.array_sort(F.collect_list(F.when(~F.col("passed"), name))).alias("failed"), _true(F.bool_and("passed")).alias("passed"))  # some rows a family


def objective(cases: DataFrame, entity: str, primary: Column, arms: Sequence[str], side_effects: Mapping[str, str], most_control_loss: float = 0.05, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """One row: whether the second of three arms (base, candidate, larger) meets its objective, and how strongly.

    ``cases`` has a row for each case with a pass column (boolean) for each arm; ``side_effects`` names columns of wrong actions with
    side effects for base and candidate. The candidate must lead both others on primary cases, lose at most ``most_control_loss`` on
    the rest against the base, and have no more side effects than it. The bounds are of bootstraps over entities of the candidate's
    lead on primary cases; a lower bound above 0 against the larger one is strong superiority. Nothing to compare is not met.
    """
    base, new, larger = arms
    p = _true(primary)
    num = lambda a: _true(F.col(a)).cast("int")
    lead = lambda a, where: F.avg(F.when(where, num(new) - num(a)))
    row = cases.agg(
        lead(base, p).alias("lead_base"), lead(larger, p).alias("lead_larger"), lead(base, ~p).alias("controls"),
        F.coalesce(F.sum(side_effects[base]), F.lit(0)).alias("base_effects"), F.coalesce(F.sum(side_effects[new]), F.lit(0)).alias("effects"),
    )
    bounds = []
    for name, other in (("base", base), ("larger", larger)):
        per = cases.filter(p).groupBy(entity).agg(F.sum(num(new) - num(other)).alias("s"), F.count("*").alias("n"))
        span = evaluation.interval(evaluation.bootstrap(per, entity, "s", "n", replicates, seed).withColumn("mean", F.round("mean", 12)))
        bounds.append(span.select(F.col("low").alias(f"low_{name}"), F.col("high").alias(f"high_{name}")))
    out = row.crossJoin(F.broadcast(bounds[0])).crossJoin(F.broadcast(bounds[1]))  # three frames of one row
    met = (F.col("lead_base") > 0) & (F.col("lead_larger") > 0) & (F.col("controls") >= -most_control_loss - SLACK) & (F.col("effects") <= F.col("base_effects"))
    out = out.withColumn("met", _true(met))
    return out.withColumns({"strong": F.col("met") & _true(F.col("low_larger") > 0), "point_only": F.col("met") & ~_true(F.col("low_larger") > 0)})


def step_support(samples: DataFrame, prompt: str, order: str, scopes: Sequence[str], score: Column, action: Column, matched: Column) -> tuple[DataFrame, DataFrame]:
    """Samples drawn for the same prompt, as (prompts, blocks).

    prompts: a row for each prompt with the scopes of its first sample, its samples, whether any matched, mean and population
    deviation of its scores, and its different actions (null: not valid, not counted). blocks: (scope, value) over all prompts and for
    each value of each scope: prompts, the share supported, the share with a deviation above 1e-12, mean actions and mean score. Equal
    scores have no deviation, whatever rounding does.
    """
    first = F.min_by(F.struct(*scopes), order)
    per = samples.select(prompt, order, *scopes, score.cast("double").alias("__s"), action.alias("__a"), _true(matched).alias("__m"))
    actions = per.filter(F.col("__a").isNotNull()).select(prompt, "__a").distinct().groupBy(prompt).agg(F.count("*").alias("actions"))
    groups = per.groupBy(prompt).agg(
        first.alias("__f"), F.count("*").alias("samples"), F.bool_or("__m").alias("supported"), F.avg("__s").alias("mean"),
        F.when(F.max("__s") == F.min("__s"), 0.0).otherwise(F.stddev_pop("__s")).alias("deviation"),
    ).join(actions, prompt, "left").select(prompt, *[F.col(f"__f.{s}").alias(s) for s in scopes], "samples", "supported", "mean", "deviation", F.coalesce("actions", F.lit(0)).alias("actions"))
    places = F.array(F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("value")), *[F.struct(F.lit(s).alias("scope"), F.coalesce(F.col(s).cast("string"), F.lit("")).alias("value")) for s in scopes])
    long = groups.select(F.explode(places).alias("b"), "*")
    blocks = long.groupBy("b.scope", "b.value").agg(
        F.count("*").alias("prompts"), evaluation.share(F.col("supported")).alias("support_rate"), evaluation.share(F.col("deviation") > 1e-12).alias("varied_rate"),
        F.avg("actions").alias("mean_actions"), F.avg("mean").alias("mean_score"),
    )
    return groups, blocks


def isolation(rows: DataFrame, reference: DataFrame, protected: Mapping[str, Column], shared: Mapping[str, Column] | None = None, examples: int = 10) -> DataFrame:
    """(field, protected, overlap, examples, passed): how many different values of each field both tables hold.

    Protected fields must share none; a field of the shared taxonomy may, and is only told. Null and empty values count on neither
    side. All fields take one pass over each table and one join; examples are the smallest values.
    """
    kinds = {**dict.fromkeys(protected, True), **dict.fromkeys(shared or {}, False)}
    fields = {**protected, **(shared or {})}

    def values(df: DataFrame) -> DataFrame:
        each = F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("v")) for n, c in fields.items()])
        return df.select(F.explode(each).alias("x")).select("x.*").filter("v != ''").distinct()

    both = values(rows).join(values(reference), ["field", "v"], "left_semi")
    counts = both.groupBy("field").agg(F.count("*").alias("overlap"))
    place = F.row_number().over(Window.partitionBy("field").orderBy("v"))  # cut to the first few before the shuffle
    some = both.withColumn("__p", place).filter(F.col("__p") <= examples).groupBy("field").agg(F.array_sort(F.collect_list("v")).alias("examples"))
    names = rows.sparkSession.createDataFrame(list(kinds.items()), "field string, protected boolean")
    out = names.join(counts, "field", "left").join(some, "field", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    return out.select("field", "protected", "overlap", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"), (~F.col("protected") | (F.col("overlap") == 0)).alias("passed"))


def factor_report(rows: DataFrame, order: str, entity: str, entity_factors: Sequence[str], bundle: str, bundle_factors: Sequence[str], row_factors: Sequence[str]) -> DataFrame:
    """(unit, factor, value, n): how often each value of a factor stands, over entities (their first row), bundles (their first row) and rows.

    Entities also count their factors together, joined by ``|``. A null value is the empty text.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def long(df: DataFrame, unit: str, factors: Sequence[str], joint: bool) -> DataFrame:
        pairs = [F.struct(F.lit(f).alias("factor"), text(f).alias("value")) for f in factors]
        if joint:
            pairs.append(F.struct(F.lit("|".join(factors)).alias("factor"), F.concat_ws("|", *map(text, factors)).alias("value")))
        return df.select(F.lit(unit).alias("unit"), F.explode(F.array(*pairs)).alias("x")).groupBy("unit", "x.factor", "x.value").agg(F.count("*").alias("n"))

    first = lambda key, factors: rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*factors), order).alias("f")).select("f.*")
    parts = [long(first(entity, entity_factors), "entity", entity_factors, True), long(first(bundle, bundle_factors), "bundle", bundle_factors, False), long(rows, "row", row_factors, False)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
