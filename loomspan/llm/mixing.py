"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import stored

#: Text between white space characters (space, tab, line feed, vertical tab, form feed, carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def uniform(seed: int, *cols: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the values only (52 bits of an MD5 digest)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """A row for each source: its size and its target words.

    Sources in order of their name (null last) weigh ``weights``, repeating; all words are shared out by weight, a source gets at
    most ``cap`` times its words, and the excess goes to the others by weight until none is above: target = min(cap * size,
    level * weight), with the level found from the sources in order of cap * size / weight. The windows here see one row a source.
    """
    order = Window.orderBy(F.col("__src").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("__w", F.element_at(pick, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumns({"__cap": F.col("__source_size") * F.lit(float(cap)), "__all": F.sum("__source_size").over(Window.partitionBy())})
    up = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__src").asc_nulls_last())
    below, above = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("__level", (F.col("__all") - F.coalesce(F.sum("__cap").over(below), F.lit(0.0))) / F.sum("__w").over(above))
    # Leaving out a full source raises the level, leaving out any other lowers it, so the level sought is the highest.
    s = s.withColumn("__final", F.max("__level").over(Window.partitionBy()))
    return s.select("__src", "__source_size", F.least(F.col("__cap"), F.col("__final") * F.col("__w")).alias("__target"))


def take_in_order(rows: DataFrame, buckets: int, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Mark (``__take``) the rows of each source that fit into ``__left`` words when taken in the order of ``__rank``.

    The order within a source is cut into ``buckets`` ranges of the rank. Their totals, made by partial aggregation, tell the
    one range in which the words run out; only that range is sorted, so a source with most of all rows is no bottleneck. ``small`` marks tables with a row for each source.
    """
    rows = rows.withColumn("__b", F.floor(F.col("__rank") / (1 + F.col("__rank")) * buckets))
    sums = rows.groupBy("__src", "__b").agg(F.sum("__size").alias("__s"), F.first("__left").alias("__left"))
    running = Window.partitionBy("__src").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("__upto", F.sum("__s").over(running))
    over = sums.filter(F.col("__upto") > F.col("__left"))
    cut = over.groupBy(F.col("__src").alias("__cs")).agg(F.min("__b").alias("__cut"), F.min_by(F.col("__upto") - F.col("__s"), "__b").alias("__before"))
    rows = rows.join(small(cut), F.col("__src").eqNullSafe(F.col("__cs")), "left").drop("__cs")
    clear = rows.filter(F.col("__cut").isNull() | (F.col("__b") != F.col("__cut"))).withColumn("__take", F.col("__cut").isNull() | (F.col("__b") < F.col("__cut")))
    inside = Window.partitionBy("__src").orderBy("__rank", F.col("__id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.filter(F.col("__b") == F.col("__cut")).withColumn("__upto", F.col("__before") + F.sum("__size").over(inside))
    edge = edge.withColumn("__take", F.col("__upto") <= F.col("__left")).drop("__upto")
    return clear.unionByName(edge).drop("__b", "__cut", "__before")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    seed: int = 20,
    buckets: int = 1024,
    rounds: int = 4,
    max_broadcast: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often each document goes into a mix whose sources have target shares of all words.

    A source's target divided by its words is the number of copies expected of each of its documents. Its whole part is taken
    for certain. For the words that are left, documents are ranked by Pareto order sampling: random odds u / (1 - u) divided by the odds
    of inclusion p / (1 - p). Inclusion is unequal: p is 0 for a document too long for the words that are left, and falls with the
    share of them that a document would use up, p = c (1 - size / left / 2), with c such that the words expected are the words
    left. So a document that would crowd out the others has lower odds, and what the end of the order leaves open is small. In
    that order documents are taken while they fit. The same is done ``rounds`` times in all with the words and documents left;
    each round has a smaller bound on size.

    Returns ``__id, __size, __src, __source_size, __target, __copies`` for each row of ``docs``. Random numbers depend on
    the seed, id, size and round only, so reruns agree. A null text has no words and is never taken more than the certain copies; null
    sources are a source of their own, the last; rows with equal ids and sizes are ranked alike and are taken one by one.
    Tables with a row for each source are broadcast up to ``max_broadcast`` sources, so that no rows are dealt out by source.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    rows = stored(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__src"), size.alias("__size")))
    per_source = rows.groupBy("__src").agg(F.sum("__size").alias("__source_size"))
    targets = source_targets(per_source, list(weights), cap)
    targets = targets.withColumn("__whole", F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("__left", F.greatest(F.lit(0.0), F.col("__target") - F.col("__whole") * F.col("__source_size")))
    targets = stored(targets)  # a row for each source
    few = targets.count() <= max_broadcast
    small = lambda df: F.broadcast(df) if few else df
    taken = rows.withColumn("__extra", F.lit(0)).withColumn("__round", F.lit(-1))
    left = targets.select(F.col("__src").alias("__ls"), "__left")
    for k in range(rounds):
        fits = (F.col("__extra") == 0) & (F.col("__size") > 0) & (F.col("__size") <= F.col("__left"))
        open_ = taken.join(small(left), F.col("__src").eqNullSafe(F.col("__ls")), "left").drop("__ls")
        square = F.sum(F.col("__size").cast("decimal(19,0)") * F.col("__size").cast("decimal(19,0)"))
        pool = stored(open_.filter(fits).groupBy(F.col("__src").alias("__ps")).agg(F.sum("__size").cast("double").alias("__pool"), square.cast("double").alias("__squares"), F.count("*").alias("__n")))
        room = F.when(F.col("__n") > 1, 1 - F.col("__size") / F.col("__left") / 2).otherwise(F.lit(1.0))
        p = F.least(F.col("__left") / (F.col("__pool") - F.col("__squares") / F.col("__left") / 2) * room, F.lit(1 - 1e-9))
        u = uniform(seed + k, F.col("__id"), F.col("__size"))
        ranked = open_.filter(fits).join(small(pool), F.col("__src").eqNullSafe(F.col("__ps")), "left").drop("__ps")
        ranked = ranked.withColumn("__rank", (u / (1 - u)) / (p / (1 - p))).drop("__pool", "__squares", "__n")
        marked = take_in_order(ranked, buckets, small).withColumn("__extra", F.col("__take").cast("int")).withColumn("__round", F.lit(k))
        rest = open_.filter(~F.coalesce(fits, F.lit(False)))
        taken = stored(rest.drop("__left").unionByName(marked.select("__id", "__src", "__size", "__extra", "__round")))
        got = taken.filter(F.col("__extra") == 1).groupBy(F.col("__src").alias("__gs")).agg(F.sum("__size").alias("__got"))
        left = targets.join(got, F.col("__src").eqNullSafe(F.col("__gs")), "left").select(F.col("__src").alias("__ls"), (F.col("__left") - F.coalesce(F.col("__got"), F.lit(0))).alias("__left"))
        left = stored(left) if k < rounds - 1 else left
    out = taken.join(small(targets.withColumnRenamed("__src", "__ts")), F.col("__src").eqNullSafe(F.col("__ts")), "left")
    return out.select("__id", "__size", "__src", "__source_size", "__target", (F.col("__whole") + F.col("__extra")).cast("int").alias("__copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix_sources`` takes it.

    Rows with equal id and size are told apart by their place in any order: they share their copies out among themselves, so the
    number of rows is exact while which of them is repeated does not matter.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    copies = mix_sources(docs, id_col=id_col, text_col=text_col, **kw)
    copies = copies.groupBy(F.col("__id").alias("__mi"), F.col("__size").alias("__ms"), F.col("__src").alias("__mr")).agg(F.sum("__copies").alias("__copies"), F.count("*").alias("__same"))
    copies = copies.filter(F.col("__copies") > 0)
    source = F.col(kw.get("source_col", "source"))
    same = F.col(id_col).eqNullSafe(F.col("__mi")) & (F.col("__size") == F.col("__ms")) & source.eqNullSafe(F.col("__mr"))
    single = docs.withColumn("__size", size).join(copies, same)
    whole, rest = F.floor(F.col("__copies") / F.col("__same")).cast("int"), F.col("__copies") % F.col("__same")
    alone = single.filter(F.col("__same") == 1).withColumn("__n", F.col("__copies").cast("int"))
    place = Window.partitionBy(id_col, "__size", source).orderBy(F.crc32(F.col(text_col).cast("binary")))
    several = single.filter(F.col("__same") > 1).withColumn("__n", whole + (F.row_number().over(place) <= rest).cast("int"))
    return alone.unionByName(several).withColumn("__k", F.explode(F.array_repeat(F.lit(0), F.col("__n")))).select(*docs.columns)
