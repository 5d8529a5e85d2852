"""Lexical, vector and fused ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import text_tokens
from loomspan.sources.snapshots import stored


def token_counts(docs: DataFrame, id_col: str, tokens: Column, terms: Sequence[str]) -> DataFrame:
    """(id, length, tf): the token count of each document and how often each query term occurs.

    Each generator is a barrier: what is made before it is made once a row, however often later steps use it.
    """
    once = docs.select(id_col, F.explode(F.array(tokens)).alias("__t"))
    hits = F.struct(F.size("__t").alias("length"), F.filter("__t", lambda t: t.isin(list(terms))).alias("hits"))
    few = once.select(id_col, F.explode(F.array(hits)).alias("__h"))

    def occurrences(term: str) -> Column:
        return F.size(F.filter("__h.hits", lambda t: t == term))

    return few.select(id_col, "__h.length", F.array(*map(occurrences, terms)).cast("array<int>").alias("tf"))


def bm25(docs: DataFrame, terms: Sequence[str], id_col: str, tokens: Column, k1: float = 1.5, b: float = 0.75, keep_zero: bool = False) -> DataFrame:
    """(id, score) for the given query terms, which are taken once each.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)) with N over all documents; the average length is over documents with tokens. One pass
    over the texts writes a few numbers a document; statistics (one partial aggregate, a number for each term) and scores read
    those. Where many queries go to one corpus, ``sources.inverted`` keeps the postings.
    """
    terms = list(dict.fromkeys(terms))
    counts = stored(token_counts(docs, id_col, tokens, terms))
    df = F.array(*[F.sum((F.col("tf")[i] > 0).cast("long")) for i in range(len(terms))]).cast("array<bigint>")
    stats = counts.agg(F.count("*").alias("n"), F.avg(F.when(F.col("length") > 0, F.col("length"))).alias("avg"), df.alias("df")).first()
    score: Column = F.lit(0.0)
    norm = F.lit(k1) * (1 - b + b * F.col("length") / F.lit(stats["avg"] or 1.0))
    for i, n in enumerate(stats["df"] if stats["n"] else []):
        tf = F.col("tf")[i]
        score = score + F.when(tf > 0, F.log(F.lit(1 + (stats["n"] - n + 0.5) / (n + 0.5))) * (tf * (k1 + 1) / (tf + norm))).otherwise(0.0)
    hit = F.exists("tf", lambda x: x > 0)
    return (counts if keep_zero else counts.filter(hit)).select(id_col, score.alias("score"))


def over_max(scored: DataFrame, score: str = "score") -> DataFrame:
    """Scores divided by the largest one; as they are where that is 0."""
    best = scored.agg(F.max(score)).scalar()
    return scored.withColumn(score, F.col(score) / F.when(best != 0, best).otherwise(1.0))


def top(scored: DataFrame, k: int, id_col: str, score: str = "score") -> DataFrame:
    return scored.orderBy(F.desc(score), id_col).limit(k)


def dot(a: Column, b: Sequence[float]) -> Column:
    """Dot product with a constant vector, in doubles."""
    q = F.array(*[F.lit(float(x)) for x in b])
    return F.aggregate(F.zip_with(a, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def vector_scores(df: DataFrame, vector: str, query: Sequence[float], id_col: str, cosine: bool = False) -> DataFrame:
    """Dot product or cosine (with a guarded denominator) of each vector of the query's dimension with the query."""
    same = df.filter(F.size(vector) == len(query))
    score = dot(F.col(vector), query)
    if cosine:
        size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        score = score / F.greatest(size * F.lit(sum(float(x) ** 2 for x in query) ** 0.5), F.lit(1e-8))
    return same.select(id_col, score.alias("score"))


def ranked(lists: DataFrame, id_col: str, first: int = 1) -> DataFrame:
    """The place of each item in its list (column ``list``), by score descending and id. Lists are cut to candidates before."""
    order = Window.partitionBy("list").orderBy(F.desc("score"), id_col)
    return lists.withColumn("place", F.row_number().over(order) - 1 + first)


def rrf(lists: DataFrame, id_col: str, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + place) over the lists an item is in."""
    w = F.lit(1.0)
    for name, value in (weights or {}).items():
        w = F.when(F.col("list") == name, F.lit(float(value))).otherwise(w)
    return ranked(lists, id_col).groupBy(id_col).agg(F.sum(w / (k + F.col("place"))).alias("score"), F.count("*").alias("n_lists"))


def text_keyed_rrf(lists: DataFrame, key: str, id_col: str, k: int = 60) -> DataFrame:
    """Fusion of items with equal texts, places from 0. The fused score orders; the item kept is the best-scored one, with its own score."""
    r = ranked(lists, id_col, first=0)
    best = F.max_by(F.struct(F.col(id_col).alias("id"), F.col("score").alias("score")), F.struct(F.col("score"), -F.col(id_col)))
    out = r.groupBy(key).agg(F.sum(1.0 / (k + F.col("place"))).alias("fused"), best.alias("best"))
    return out.select(F.col("best.id").alias(id_col), F.col("best.score").alias("score"), "fused")


def local_rank_fusion(items: DataFrame, source: str, id_col: str, priority: dict[str, int], k: int = 60, limit: int = 20) -> DataFrame:
    """Items of several sources by 1 / (k + place inside their source); ties by place, source priority, score and id."""
    order = Window.partitionBy(source).orderBy(F.desc("score"), id_col)
    rank = F.coalesce(F.create_map(*[x for s, p in priority.items() for x in (F.lit(s), F.lit(p))])[F.col(source)], F.lit(99))
    out = items.withColumn("place", F.row_number().over(order)).withColumn("fused", 1.0 / (k + F.col("place"))).withColumn("__p", rank)
    return out.orderBy(F.desc("fused"), "place", "__p", F.desc("score"), id_col).limit(limit).drop("__p")


def table_keyword_scores(df: DataFrame, query: str, fields: Sequence[str], id_col: str) -> DataFrame:
    """Row score 0.7 max + 0.3 mean over matching fields: 1 if the query is in the field, 0.85 if the field is in the
    query, or the share of query tokens in the field, whichever is most."""
    q = query.lower().strip()
    words = F.array(*[F.lit(t) for t in dict.fromkeys(q.split())])

    def score(name: str) -> Column:
        value = F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))
        share = F.size(F.array_intersect(words, F.split(value, r"\s+"))) / F.lit(float(max(1, len(set(q.split())))))
        inside = F.when(value.contains(q), 1.0).otherwise(0.0)
        contained = F.when((F.length(value) >= 2) & F.contains(F.lit(q), value), 0.85).otherwise(0.0)
        return F.when(value != "", F.greatest(inside, contained, share)).otherwise(0.0)

    each = F.array(*[F.struct(F.lit(f).alias("field"), score(f).alias("s")) for f in fields])
    hit = F.filter(each, lambda x: x["s"] > 0)
    rows = df.select(id_col, hit.alias("__h")).filter(F.size("__h") > 0)
    mean = F.aggregate("__h", F.lit(0.0), lambda a, x: a + x["s"]) / F.size("__h")
    best = F.array_max(F.transform("__h", lambda x: x["s"]))
    return rows.select(id_col, F.least(F.lit(1.0), 0.7 * best + 0.3 * mean).alias("score"), F.array_join(F.transform("__h", lambda x: x["field"]), ",").alias("matched"))


def weighted_tokens(*weighted: tuple[Column, int]) -> Column:
    """Tokens of several fields, each as often as its weight says."""
    return F.flatten(F.array(*[t for c, w in weighted for t in [text_tokens(c)] * w]))
