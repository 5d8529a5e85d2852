"""Building data sets: deduplication, splits, quotas, sampling, balancing, preference pairs, overlap audits."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import selection_key


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """One row for each key, the first in the order. Keys are ranked after a shuffle by key, as any distinct would."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


def keep_first_key(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(key, id, copies): like ``keep_first``, but by partial aggregation, for keys that may hold most of all rows."""
    return df.groupBy(key.alias("key")).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))


def numbered(rows: DataFrame, group: list[str], digest: str, *ties: str, digits: int = 3) -> DataFrame:
    """Add ``__place`` (from 1) in the order of a hexadecimal digest inside each group, and the group's size ``__size``.

    A group is cut into ranges by the digest's first digits. Their counts, a partial aggregate, tell how many rows stand before a
    range, and only ranges are sorted: a group with most of all rows is sorted in 16**digits pieces.
    """
    names = [f"__g{k}" for k in range(len(group))]
    rows = rows.withColumn("__b", F.substring(digest, 1, digits))
    sums = rows.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col("__b").alias("__gb")).agg(F.count("*").alias("__n"))
    along = Window.partitionBy(*names).orderBy("__gb").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    sums = sums.withColumns({"__before": F.coalesce(F.sum("__n").over(along), F.lit(0)), "__size": F.sum("__n").over(Window.partitionBy(*names))})
    place = F.row_number().over(Window.partitionBy(*group, "__b").orderBy(digest, *ties))
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names, strict=True)], F.col("__b") == F.col("__gb"))
    return rows.withColumn("__r", place).join(sums, same).withColumn("__place", F.col("__r") + F.col("__before")).drop(*names, "__gb", "__b", "__n", "__r", "__before")


def stratified_split(df: DataFrame, stratum: str, id_col: str, ratio: float, seed: int = 0) -> DataFrame:
    """Split by id inside each stratum: max(1, round(n * ratio)) ids to validation, ties to even; a single id stays in training.

    Ids are in order of a digest of seed and id, so the split is the same in any run.
    """
    ids = df.select(stratum, id_col).distinct().withColumn("__k", selection_key(seed, F.col(id_col)))
    val = F.when(F.col("__size") > 1, F.greatest(F.lit(1), F.bround(F.col("__size") * F.lit(ratio)).cast("int"))).otherwise(0)
    return numbered(ids, [stratum], "__k", id_col).select(stratum, id_col, F.when(F.col("__place") <= val, "val").otherwise("train").alias("split"))


def nth_digest(keys: DataFrame, digest: str, n: int, most: int = 100_000) -> str | None:
    """The n-th smallest of hexadecimal digests of one length (the largest, if there are fewer; null without rows).

    Counts by three more digits at a time, at most 4096 a step, lead to a range of up to ``most`` rows, and only that one is sorted.
    """
    prefix, left = "", n
    while True:
        inside = keys.filter(F.col(digest).startswith(prefix))
        rows = inside.groupBy(F.substring(digest, 1, len(prefix) + 3).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        if not rows:
            return None
        before = 0
        for p, size in rows:
            if before + size >= left or p == rows[-1].p:
                break
            before += size
        if p == prefix:
            return p  # rows that share a whole digest
        prefix, left = p, left - before
        if size <= most:
            return keys.filter(F.col(digest).startswith(prefix)).select(digest).orderBy(digest).limit(max(1, left)).agg(F.max(digest)).first()[0]


def hash_split(df: DataFrame, key: Column, parts: dict[str, int], seed: int = 0, rest: str = "rest") -> DataFrame:
    """The first rows in order of a digest go to the first part, and so on; what is left is ``rest``.

    No part is sorted whole: the last digest of each part is found by counts, and rows are told by comparison with it. A part of no
    rows stays empty.
    """
    keyed = df.withColumn("__k", selection_key(seed, key))
    bounds, total = [], 0
    for name, n in parts.items():
        total += n
        bounds.append((name, nth_digest(keyed, "__k", total) if total else ""))
    split = F.lit(rest)
    for name, last in reversed(bounds):
        split = F.when(F.col("__k") <= F.lit(last), name).otherwise(split)
    return keyed.withColumn("split", split).drop("__k")


def proportional_quotas(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """Rows to take from each stratum: a floor of one each, the rest in proportion by largest remainder, at most what is there."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy()
    counts = counts.withColumns({"__all": F.sum("n").over(all_), "__strata": F.count("*").over(all_)})
    exact = (F.lit(total) - F.col("__strata")) * F.col("n") / F.col("__all")
    counts = counts.withColumn("__base", F.floor(exact)).withColumn("__rem", F.round(exact - F.col("__base"), 9))
    counts = counts.withColumn("__left", F.lit(total) - F.col("__strata") - F.sum("__base").over(all_))
    order = Window.orderBy(F.desc("__rem"), stratum)  # over one row a stratum
    quota = 1 + F.col("__base") + (F.row_number().over(order) <= F.col("__left")).cast("int")
    return counts.select(stratum, "n", F.least(F.col("n"), quota).alias("quota"))


def round_robin(df: DataFrame, category: str, order: Column, n: int) -> DataFrame:
    """The first ``n`` rows when categories take turns, each in the given order. Each category is cut to n rows first."""
    place = F.row_number().over(Window.partitionBy(category).orderBy(order))
    return df.withColumn("place", place).filter(F.col("place") <= n).orderBy("place", category).limit(n)


def least_used(df: DataFrame, category: str, kind: str, entity: str, id_col: str, quotas: dict[str, int], seed: int = 0) -> DataFrame:
    """For each category in turn and each kind in order of ``quotas``, that many rows whose entities earlier cells have used least.

    Ties go by a digest of seed, category and id. The result has ``place``, 1 for the first row taken; a cell with too few rows gives
    what it has. Counters change with every cell, so the last step is a greedy in order, over a table whose size the quotas bound
    and not the data: before a cell, at most T rows are taken, so of its first T + quota entities (by their first row) ``quota`` are
    unused, and no row of a later entity, nor an entity's row beyond the quota, can be among those taken.
    """
    cells = df.filter(F.col(kind).isin(list(quotas))).select(category).distinct()
    order = Window.orderBy(F.asc_nulls_first(category))  # over one row a category
    cells = cells.select(F.col(category).alias("__c"), (F.row_number().over(order) - 1).alias("__turn"))
    step, before, total = F.lit(None), F.lit(None), sum(quotas.values())
    for i, k in enumerate(quotas):
        step, before = F.when(F.col(kind) == k, i).otherwise(step), F.when(F.col(kind) == k, sum(list(quotas.values())[:i])).otherwise(before)
    quota = F.create_map(*[x for k, n in quotas.items() for x in (F.lit(k), F.lit(n))])[F.col(kind)]
    rows = df.filter(F.col(kind).isin(list(quotas))).select(category, kind, entity, id_col, selection_key(seed, F.col(category), F.col(id_col)).alias("__k"))
    rows = rows.join(F.broadcast(cells), F.col(category).eqNullSafe(F.col("__c")))
    rows = rows.select(category, kind, entity, id_col, "__k", (F.col("__turn") * len(quotas) + step).alias("__cell"), quota.alias("__quota"), (F.col("__turn") * total + before + quota).alias("__most"))
    own = F.row_number().over(Window.partitionBy("__cell", entity).orderBy("__k", id_col))
    rows = rows.withColumn("__own", own).filter(F.col("__own") <= max(quotas.values())).filter(F.col("__own") <= F.col("__quota"))
    heads = rows.filter("__own = 1").select("__cell", F.col(entity).alias("__e"), "__most", F.row_number().over(Window.partitionBy("__cell").orderBy("__k", id_col)).alias("__at"))
    heads = heads.filter(F.col("__at") <= F.col("__most")).drop("__most")
    few = rows.alias("r").join(heads.withColumnRenamed("__cell", "__hc"), (F.col("__cell") == F.col("__hc")) & F.col(entity).eqNullSafe(F.col("__e"))).select(category, kind, entity, id_col, "__k", "__cell", "__quota")

    def take(table):
        used: dict = {}
        taken = []
        for _, cell in table.sort_values(["__cell", "__k", id_col]).groupby("__cell", sort=True):
            names = [None if e != e else e for e in cell[entity]]
            best = sorted(range(len(cell)), key=lambda i: used.get(names[i], 0))[: int(cell["__quota"].iloc[0])]  # noqa: B023
            for i in best:
                used[names[i]] = used.get(names[i], 0) + 1
            taken += cell.index[best].tolist()
        out = table.loc[taken, [category, kind, entity, id_col]]
        return out.assign(place=range(1, len(out) + 1))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return few.withColumn("__all", F.lit("one table")).groupBy("__all").applyInPandas(take, ", ".join(f"`{c}` {kinds[c]}" for c in (category, kind, entity, id_col)) + ", place long")


def block_schedule(df: DataFrame, style: str, id_col: str, mix: dict[str, int], seed: int = 0) -> DataFrame:
    """(style, id, block, value): each style's rows in blocks of as many rows as the mix has, every value as often in each block as the mix says.

    Which rows share a block and which of them get a value go by digests of seed and id, so the schedule is the same in any run and
    no style is shuffled in memory. A style's last block may be smaller; its ranks are stretched over the mix.
    """
    size = sum(mix.values())
    rows = df.select(style, id_col, selection_key(seed, F.col(id_col)).alias("__k"))
    placed = numbered(rows, [style], "__k", id_col).withColumn("block", F.floor((F.col("__place") - 1) / size))
    held = F.least(F.lit(size), F.col("__size") - F.col("block") * size)
    rank = F.row_number().over(Window.partitionBy(style, "block").orderBy(selection_key(f"{seed}:value", F.col(id_col)), id_col)) - 1
    at, value, upto = F.floor(rank * size / held), F.lit(None).cast("string"), size
    for name, n in reversed(mix.items()):
        value = F.when(at < upto, name).otherwise(value)
        upto -= n
    return placed.select(style, id_col, F.col("block").cast("long").alias("block"), value.alias("value"))


def entity_first(df: DataFrame, category: str, entity: str, ordinal: str, n: int) -> DataFrame:
    """All rows of the first ``n`` entities of each category, by where an entity first appears."""
    first = df.groupBy(category, entity).agg(F.min(ordinal).alias("__first"))
    place = F.row_number().over(Window.partitionBy(category).orderBy("__first", entity))
    return df.join(first.withColumn("__p", place).filter(F.col("__p") <= n).select(category, entity), [category, entity], "left_semi")


def balance_up(df: DataFrame, group: str, id_col: str) -> DataFrame:
    """Repeat the rows of smaller groups, whole rounds first, until each group is as large as the largest; ``copy`` tells them apart."""
    most = df.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).scalar()
    rows = numbered(df.withColumn("__k", selection_key("balance", F.col(id_col))), [group], "__k", id_col)
    copies = F.floor(most / F.col("__size")) + (F.col("__place") <= most % F.col("__size")).cast("int")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int")))).drop("__k", "__place", "__size")


def replicate(df: DataFrame, weight: Column) -> DataFrame:
    """Each row as often as its weight; none for zero."""
    return df.withColumn("__w", weight.cast("int")).filter("__w > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__w") - 1))).drop("__w")


def funnel(df: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """Why rows are dropped: the first rule that each row breaks (``kept`` if none), with counts."""
    reason = F.coalesce(*[F.when(broken, name) for name, broken in rules], F.lit("kept"))
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def field_overlap(df: DataFrame, fields: list[str], split: str) -> DataFrame:
    """For each protected field and pair of splits, how many distinct values occur in both."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    rows = df.select(split, pairs.alias("p")).select("p.*", split).filter("value IS NOT NULL")
    held = rows.groupBy("field", "value").agg(F.array_sort(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)  # as many as there are splits
    names = F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return held.select("field", F.explode(F.flatten(names)).alias("x")).groupBy("field", F.col("x.a").alias("split_a"), F.col("x.b").alias("split_b")).agg(F.count("*").alias("overlap"))


def preference_pairs(good: DataFrame, bad: DataFrame, on: list[str], id_col: str, key: list[str]) -> DataFrame:
    """A row for each pair of a chosen and a rejected answer with equal values of ``on`` (a null is equal to a null), one for each
    ``key`` (columns of the pair); ``pair_id`` is a digest of the key."""
    from loomspan.functions.text import stable_id

    a = good.select(*on, F.col(id_col).alias("chosen"))
    b = bad.select(*[F.col(c).alias(f"__{c}") for c in on], F.col(id_col).alias("rejected"))
    pairs = a.join(b, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])).drop(*[f"__{c}" for c in on])
    return pairs.dropDuplicates(key).withColumn("pair_id", stable_id(*map(F.col, key)))


def step_rows(turns: DataFrame, case: str, order: str, action: str) -> DataFrame:
    """Each step with the action before it in its case."""
    w = Window.partitionBy(case).orderBy(order)
    return turns.withColumns({"step_index": F.row_number().over(w) - 1, "previous_action": F.coalesce(F.lag(action).over(w), F.lit(""))})


def chatml(turns: DataFrame, case: str, order: str, role: str, text: str) -> DataFrame:
    """One prompt for each case: its turns in order, each between start and end marks."""
    said = F.concat(F.lit("<|im_start|>"), F.col(role), F.lit("\n"), F.coalesce(F.col(text), F.lit("")), F.lit("<|im_end|>\n"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), said.alias("t"))))
    return turns.groupBy(case).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("prompt"))


def split_pairs(names: list[str]) -> list[tuple[str, str]]:
    return list(combinations(sorted(names), 2))
