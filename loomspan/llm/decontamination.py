"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import by_ids, stored

#: Token positions that count (1) and that may differ (0) in a seed.
MASKS = ("1110010111", "11011001011")
#: With these, every pattern of substitutions that the limits allow (13 tokens, 80 % equal) is hit by a seed.
MORE_MASKS = ("1111011", "1110111", "1110000100011")
#: Non-letters and non-digits part tokens; in scripts written without spaces (Thai, Lao, Burmese, Khmer, Kana, Han) every character is one.
BREAK = r"[^\p{L}\p{N}]+"
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3005}-\x{3007}\x{3041}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]"
#: Two ranges around all of these but general punctuation, told faster than they are.
NEAR_UNSPACED = r"[\x{0E00}-\x{1FFF}\x{2E80}-\x{10FFFF}]"
#: Positions of a text that one row holds.
PIECE = 256


def tokens(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    apart = F.when(low.rlike(NEAR_UNSPACED), F.regexp_replace(low, f"({UNSPACED})", " $1 ")).otherwise(low)
    return F.array_remove(F.split(apart, BREAK), "")


def seeds(df: DataFrame, words: str, pos: str, masks: tuple[str, ...], first: Column | None = None, last: Column | None = None) -> DataFrame:
    """A row for each token position (from ``first`` to ``last``, all where not given) and mask: the position, the mask's number and the hash of the tokens under the mask.

    Positions come from ``explode``, and the hash is one built-in call over array items, so the whole step stays in generated
    code and nothing but the position is made for a window that joins with no benchmark seed.
    """
    span = min(map(len, masks))
    first, last = F.lit(0) if first is None else first, F.size(words) - span if last is None else F.least(last, F.size(words) - span)
    df = df.withColumn(pos, F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))  # a filter on the size would be pushed below the split, which then runs twice
    hashes = [
        F.when(F.col(pos) + len(mask) <= F.size(words), F.xxhash64(F.lit(k), *[F.get(F.col(words), F.col(pos) + i) for i, bit in enumerate(mask) if bit == "1"]))
        for k, mask in enumerate(masks)
    ]  # past the end: no seed
    return df.select("*", F.posexplode(F.array(*hashes)).alias("__mask", "__seed"))


def pieces(words: DataFrame, least: int, left: int, right: int) -> DataFrame:
    """Texts of ``least`` tokens or more in rows of PIECE positions each, from ``__first`` on in the tokens ``__p``, with ``left`` tokens before the first of them and ``right`` from the last on where the text has them.

    The rows of a text leave generated code one at a time (``transform`` is not part of it). Generated code holds all rows that it makes
    of one row, so what it holds here follows PIECE and not the length of a text.
    """
    n = F.size("__w")
    starts = F.when(n >= least, F.sequence(F.lit(0), n - least, F.lit(PIECE))).otherwise(F.array().cast("array<int>"))
    cut = lambda s: F.struct(F.greatest(s - left, F.lit(0)).alias("__from"), F.least(s, F.lit(left)).alias("__first"), F.slice("__w", F.greatest(s - left, F.lit(0)) + 1, F.least(s, F.lit(left)) + (PIECE - 1 + right)).alias("__p"))
    return words.select("__doc", "__t", n.alias("__n"), F.inline_outer(F.transform(starts, cut)))  # outer: no filter is made of it that cuts the text a second time


def slim(df: DataFrame, name: str, tokens_: Column, *keep: str) -> DataFrame:
    """The columns ``keep`` and a part of a text as ``name``, cut while the text is at hand. The filter is true for every row; it ends generated code, so that wide columns joined later are not in the rows that this code holds."""
    return df.select(*keep, F.explode(F.array(tokens_)).alias(name)).filter(F.exists(F.array(F.size(name)), lambda n: n >= 0))


def find_leaks(
    docs: DataFrame,
    bench: DataFrame,
    masks: tuple[str, ...] = MASKS,
    more_masks: tuple[str, ...] = MORE_MASKS,
    reach: int = 5,
    min_overlap: int = 13,
    min_equal: float = 0.8,
    min_exact: int = 5,
    max_broadcast_seeds: int = 500_000,
    max_broadcast_bytes: int = 64_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Pairs of a document and a benchmark item that share a passage, substitutions allowed.

    Fixed masks over token positions ignore some of them; a document and an item with equal tokens under a mask meet in a hash
    join. Each hit is checked on the spot: in its alignment, some span of at least ``min_overlap`` tokens must have the share
    ``min_equal`` of them equal. A span of twice ``min_overlap`` tokens holds a shorter one that also does, so it is enough to look at
    spans of up to 2 * ``min_overlap`` - 1 tokens around the hit. ``matched`` and ``overlap`` are those of the best hit over the whole
    alignment of the item with the document. ``hits`` counts hits of ``masks`` whose window, widened by ``reach`` tokens to both
    sides as far as both texts go, passes as a whole; it is 0 where only a span inside or beside the window does, or only a seed of ``more_masks``.

    Documents are cut into pieces of PIECE positions, and a hit takes along the tokens around it and no more, so the memory of a task
    follows neither the length of a text nor the number of its hits. Alignments that pass are written; a second pass over the documents
    that have some compares each once as a whole.

    The benchmark's seeds are written once and broadcast in parts of about ``max_broadcast_seeds`` rows (by a hash of the seed, so that an
    item of any length is split), one pass over the documents for each part. Tokens of the items that hits need, and the alignments, are
    broadcast where they take ``max_broadcast_bytes`` at most, and joined by a shuffle beyond. The windows of the documents are never
    shuffled. Short items are broadcast by parts too.

    An item of fewer than ``min_overlap`` tokens, but ``min_exact`` or more, leaks where all its tokens stand in a row; ``hits`` counts the
    places. Shorter items are everyday phrases and no evidence.

    Null and empty texts match nothing; null ids are ids like others. Repeated items count once, repeated documents add to the hits of one pair. Returns
    doc_id, item_id, matched, overlap, hits.
    """
    items = bench.select(F.col(item_col).alias("__item"), tokens(F.col(item_text_col)).alias("__it"))
    short = stored(items.filter(F.size("__it").between(min_exact, min_overlap - 1)).select("__item", F.size("__it").alias("__k"), F.xxhash64("__it").alias("__seed"), "__it"))
    sizes = sorted(r[0] for r in short.select("__k").distinct().collect())  # fewer than ``min_overlap``
    long_ = stored(items.filter(F.size("__it") >= min_overlap).withColumn("__h", F.xxhash64("__item", "__it")).distinct())  # an item that repeats is itself
    every = (*masks, *more_masks)
    made = stored(seeds(long_, "__it", "__j", every).select("__h", "__j", "__mask", "__seed").filter("__seed IS NOT NULL"))
    parts, short_parts = (max(1, -(-df.count() // max_broadcast_seeds)) for df in (made, short))
    width = long_.agg(F.sum(F.aggregate("__it", F.lit(64).cast("long"), lambda n, t: n + F.octet_length(t) + 16))).first()[0] or 0
    texts = F.broadcast(long_) if width <= max_broadcast_bytes else long_
    row = F.xxhash64(F.col(id_col), F.col(text_col)).alias("__t")
    words = docs.select(F.col(id_col).alias("__doc"), row, tokens(F.col(text_col)).alias("__w"))
    span, most = max(map(len, masks)), 2 * min_overlap - 1
    left, right = max(most - 1, reach), max(most, span + reach, *map(len, every), *sizes)
    cut = pieces(words, min([*map(len, every), *sizes]), left, right)

    def same(lo: Column, hi: Column) -> Column:
        """1 or 0 for each place from lo to hi (exclusive), counted from the hit: whether the tokens there are equal."""
        return F.transform(F.sequence(lo, hi - 1), lambda d: F.coalesce(F.get("__s", d + F.least(F.col("__i"), F.lit(left))) == F.get("__q", d + F.least(F.col("__j"), F.lit(left))), F.lit(False)).cast("int"))

    def equal(lo: Column, hi: Column) -> Column:
        return F.when(hi > lo, F.aggregate(same(lo, hi), F.lit(0), lambda a, x: a + x)).otherwise(0)

    def spans(lo: Column, hi: Column) -> Column:
        """Whether a span of places from lo to hi (exclusive) has enough tokens and enough of them equal."""
        dense = lambda e, n, s: F.aggregate(F.slice(e, s + 1, n), F.lit(0), lambda a, x: a + x) >= n * F.lit(min_equal)
        sizes = lambda e: F.sequence(F.lit(min_overlap), F.least(F.lit(most), F.size(e)))
        within = lambda e: F.exists(sizes(e), lambda n: F.exists(F.sequence(F.lit(0), F.size(e) - n), lambda s: dense(e, n, s)))
        may = (hi - lo >= min_overlap) & (equal(lo, hi) >= min_overlap * F.lit(min_equal))
        return F.when(may, F.exists(F.array(same(lo, hi)), within)).otherwise(False)  # the outer array makes the comparison run once

    def one(part: int) -> DataFrame:
        mine = made.filter(F.pmod("__seed", F.lit(parts)) == part)
        at = seeds(cut, "__p", "__pos", every, F.col("__first"), F.col("__first") + (PIECE - 1)).drop("__mask").join(F.broadcast(mine.select("__seed")), "__seed", "left_semi")
        at = at.withColumns({"__i": F.col("__from") + F.col("__pos"), "__a": F.greatest(F.col("__pos") - left, F.lit(0))})
        hits = slim(at, "__s", F.slice("__p", F.col("__a") + 1, F.col("__pos") - F.col("__a") + right), "__doc", "__t", "__n", "__i", "__seed").join(F.broadcast(mine), "__seed").join(texts, "__h")
        b = F.greatest(F.col("__j") - left, F.lit(0))
        hits = hits.withColumn("__k", F.size("__it"))
        hits = slim(hits, "__q", F.slice("__it", b + 1, F.col("__j") - b + right), "__doc", "__t", "__n", "__i", "__s", "__h", "__item", "__j", "__mask", "__k")
        before, after = F.least("__i", "__j"), F.least(F.col("__k") - F.col("__j"), F.col("__n") - F.col("__i"))
        hits = hits.filter(spans(-F.least(before, F.lit(most - 1)), F.least(after, F.lit(most))))
        lo, hi = -F.least(before, F.lit(reach)), F.least(after, F.lit(span + reach))
        whole = (F.col("__mask") < len(masks)) & (hi - lo >= min_overlap) & (equal(lo, hi) >= (hi - lo) * F.lit(min_equal))
        return hits.select("__doc", "__t", "__item", "__h", "__k", (F.col("__i") - F.col("__j")).alias("__shift"), whole.cast("long").alias("__whole"))

    def exact(part: int) -> DataFrame:
        """Short items: every run of as many tokens as some short item has, joined by hash and compared on the spot."""
        last = F.least(F.col("__first") + (PIECE - 1), F.size("__p") - sizes[0])
        at = cut.withColumn("__pos", F.explode(F.when(last >= F.col("__first"), F.sequence(F.col("__first"), last)).otherwise(F.array().cast("array<int>"))))
        runs = F.array(*[F.when(F.col("__pos") + n <= F.size("__p"), F.xxhash64(F.slice("__p", F.col("__pos") + 1, n))) for n in sizes])
        hits = at.select("__doc", "__p", "__pos", F.explode(runs).alias("__seed")).join(F.broadcast(short.filter(F.pmod("__seed", F.lit(short_parts)) == part)), "__seed").filter(F.slice("__p", F.col("__pos") + 1, F.col("__k")) == F.col("__it"))
        return hits.select("__doc", "__item", F.struct(F.col("__k").alias("m"), F.col("__k").alias("o")).alias("__best"), F.lit(1).cast("long").alias("__whole"))

    found = reduce(DataFrame.unionByName, map(one, range(parts)))
    runs = stored(found.groupBy("__doc", "__t", "__item", "__h", "__k", "__shift").agg(F.sum("__whole").alias("__whole")))
    near = by_ids(docs.select(F.col(id_col).alias("__d"), row, F.col(text_col).alias("__text")), stored(runs.select("__t").distinct()), "__t", "left_semi")
    lines = runs.select("__doc", "__t", "__item", "__h", "__k", "__shift")
    lines = F.broadcast(lines) if lines.count() * 128 <= max_broadcast_bytes else lines
    # the condition holds for every row; with it the join gives out its rows one at a time, and not all of a text at once
    within = F.exists(F.array("__shift"), lambda s: s < F.size("__w"))
    wide = near.select("__d", "__t", tokens(F.col("__text")).alias("__w")).withColumnRenamed("__t", "__u").join(lines, (F.col("__u") == F.col("__t")) & F.col("__d").eqNullSafe(F.col("__doc")) & within)
    skipped = F.greatest(-F.col("__shift"), F.lit(0))  # tokens of the item before the text
    wide = slim(wide, "__s", F.slice("__w", F.greatest(F.col("__shift"), F.lit(0)) + 1, F.col("__k") - skipped), "__doc", "__item", "__h", "__shift").join(texts.select("__h", "__it"), "__h")
    m, o = F.size(F.filter(F.sequence(F.lit(0), F.size("__s") - 1), lambda k: F.get("__s", k) == F.get("__it", k + skipped))), F.size("__s")
    found = [runs.select("__doc", "__item", F.lit(None).cast("struct<m:int,o:int>").alias("__best"), "__whole"), wide.select("__doc", "__item", F.struct(m.alias("m"), o.alias("o")).alias("__best"), F.lit(0).cast("long").alias("__whole"))]
    found = reduce(DataFrame.unionByName, [*found, *(map(exact, range(short_parts)) if sizes else [])])
    best = found.groupBy("__doc", "__item").agg(F.max("__best").alias("__best"), F.sum("__whole").alias("hits"))
    return best.select(F.col("__doc").alias(id_col), F.col("__item").alias(item_col), F.col("__best.m").cast("long").alias("matched"), F.col("__best.o").cast("long").alias("overlap"), "hits")


def drop_leaks(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that share no passage with the benchmark; rows without an id are kept."""
    return by_ids(docs, stored(leaks.select(id_col).distinct()), id_col, "left_anti").select(*docs.columns)
