"""Balanced contiguous shards by global prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import stored


def block_of(df: DataFrame, id_col: str, blocks: int) -> Column:
    """The id range a row lies in: a pure function of the id, so that every evaluation deals rows alike."""
    row = df.agg(F.percentile_approx(id_col, [i / blocks for i in range(1, blocks)], 10_000).alias("cuts")).first()
    cuts = sorted(set(row.cuts or []))
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(id_col))), F.lit(0))


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 1_000_000, max_broadcast_rows: int = 400_000) -> DataFrame:
    """Put rows, in the order of their id, into ``n_shards`` contiguous shards of nearly equal bytes.

    A row weighs the UTF-8 bytes of its text plus 8. Its key is its id, size and checksum. Keys with their counts are written once, a few
    numbers each, and dealt to ranges of the id: one for ``block_rows`` keys, 256 to 5000 of them (or ``blocks``). Per-block totals,
    summed up over the blocks, and a running sum inside each block give every key its global byte offset and number; the shard is the
    equal share of all bytes in which the row's middle lies. No text goes through a sort or window: rows get their place by
    a join on the key, which is broadcast up to ``max_broadcast_rows`` of about 150 bytes, and shuffled with the rows beyond. No shard misses
    its share by more than one row on either side.

    Null ids come first, a null text weighs 8, rows with equal keys are interchangeable and numbered among themselves, an empty
    input gives an empty result. Ids are numbers. All columns stay; ``__size``, ``__crc``, ``__shard`` and ``__slot`` (the position in the
    shard, gapless from 0) are added. Groups of equal texts may be cut between shards: the law is equal bytes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({"__size": F.octet_length(text).cast("long") + 8, "__crc": F.crc32(text.cast("binary"))})
    keys = stored(rows.groupBy(F.col(id_col).alias("__key"), F.col("__size").alias("__ks"), F.col("__crc").alias("__kc")).agg(F.count("*").alias("__n")))
    n_keys = keys.count()
    keys = keys.withColumn("__block", block_of(keys, "__key", blocks or min(5000, max(256, n_keys // block_rows))))
    totals = keys.groupBy("__block").agg(F.sum(F.col("__ks") * F.col("__n")).alias("__bytes"), F.sum("__n").alias("__rows"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each block
    totals = totals.select("__block", F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes_before"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"), F.sum("__bytes").over(Window.partitionBy()).alias("__all"))
    inside = Window.partitionBy("__block").orderBy(F.col("__key").asc_nulls_first(), "__ks", "__kc").rowsBetween(Window.unboundedPreceding, 0)
    placed = keys.withColumns({"__upto": F.sum(F.col("__ks") * F.col("__n")).over(inside), "__rank": F.sum("__n").over(inside)}).join(F.broadcast(totals), "__block")  # a row for each block
    placed = stored(placed.select(
        "__key", "__ks", "__kc", "__n", "__all", (F.col("__bytes_before") + F.col("__upto") - F.col("__ks") * F.col("__n")).alias("__from"), (F.col("__rows_before") + F.col("__rank") - F.col("__n")).alias("__number"),
    ))
    shard = lambda k: f"CAST(CAST(2 * (__from + {k} * __ks) - __ks AS DECIMAL(24,0)) * {n_shards} div (2 * __all) AS INT)"  # noqa: E731  of a key's k-th row
    cuts = placed.withColumn("__shard", F.explode(F.expr(f"sequence({shard('1')}, {shard('__n')})")))
    # the first k whose middle reaches the shard: 2 * from + (2 * k - 1) * size >= 2 * all * shard / shards
    need = f"CAST(2 * __all * CAST(__shard AS DECIMAL(10,0)) - CAST({n_shards} AS DECIMAL(10,0)) * (2 * __from - __ks) AS DECIMAL(38,0))"
    step = f"CAST(2 * __ks * {n_shards} AS DECIMAL(24,0))"
    first = F.col("__number") + F.greatest(F.lit(1), F.expr(f"CAST(({need} + {step} - 1) div {step} AS BIGINT)")) - 1
    firsts = cuts.groupBy("__shard").agg(F.min(first).alias("__first"))  # at most ``n_shards`` rows
    near = F.broadcast(placed) if n_keys <= max_broadcast_rows else placed
    found = rows.join(near, F.col(id_col).eqNullSafe(F.col("__key")) & (F.col("__size") == F.col("__ks")) & (F.col("__crc") == F.col("__kc")))
    same = F.row_number().over(Window.partitionBy("__key", "__ks", "__kc").orderBy("__number"))
    found = found.filter("__n = 1").withColumn("__k", F.lit(1)).unionByName(found.filter("__n > 1").withColumn("__k", same))
    out = found.withColumns({"__shard": F.expr(shard("__k")), "__number": F.col("__number") + F.col("__k") - 1}).join(F.broadcast(firsts), "__shard")
    return out.withColumn("__slot", F.col("__number") - F.col("__first")).select(*docs.columns, "__size", "__crc", "__shard", "__slot")
