"""Evidence work: from rows and chunks to evidence, anchored selection, grouping, facts, and data sets without leaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.rules import has_any

#: Words beside a number that make a sentence worth keeping, and what counts as a number there.
METRIC_HINTS = ("acc", "precision", "recall", "f1", "map", "auc", "threshold", "阈值", "精度", "准确率", "召回", "耗时", "%")
NUMBER = r"\d+(?:\.\d+)?\s*%?"


def without_leaks(train: DataFrame, test: DataFrame, key: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both data sets without the rows whose key occurs in both, and the keys taken out: (train, test, leaks)."""
    a, b = train.withColumn("__k", key), test.withColumn("__k", key)
    leaks = a.select("__k").distinct().join(b.select("__k").distinct(), "__k", "left_semi")
    clean = lambda df: df.join(leaks, "__k", "left_anti").drop("__k")
    return clean(a), clean(b), leaks.withColumnRenamed("__k", "key")


def best_keyword_signal(full_text: DataFrame, ranked: DataFrame, id_col: str, score: str = "score") -> DataFrame:
    """For each chunk the higher of two lexical scores, each divided by its own largest one first."""
    both = full_text.select(id_col, F.col(score).alias("a")).join(ranked.select(id_col, F.col(score).alias("b")), id_col, "full")
    top = both.agg(F.struct(F.max("a").alias("a"), F.max("b").alias("b"))).scalar()
    part = lambda c: F.coalesce(F.col(c) / F.nullif(top[c], F.lit(0.0)), F.lit(0.0))
    return both.select(id_col, F.greatest(part("a"), part("b")).alias(score))


def merged_lists(first: DataFrame, second: DataFrame, id_col: str, limit: int) -> DataFrame:
    """The items of one ranked list, then those of another that it lacks, cut at ``limit``; both come with ``place``."""
    both = first.withColumn("list", F.lit(0)).unionByName(second.withColumn("list", F.lit(1)))
    own = both.groupBy(id_col).agg(F.min(F.struct("list", "place")).alias("p"))
    return own.select(id_col, "p.list", "p.place").orderBy("list", "place", id_col).limit(limit)


def with_other_sources(selected: DataFrame, pool: DataFrame, id_col: str, source: str, score: str) -> DataFrame:
    """The selected evidence and, for each source it lacks, the best of the pool."""
    lacking = pool.join(selected.select(source).distinct(), source, "left_anti")
    best = lacking.groupBy(source).agg(F.max_by(F.struct(id_col, score), F.struct(F.col(score), -F.col(id_col))).alias("b"))
    return selected.select(id_col, source, score, F.lit(False).alias("added")).unionByName(best.select(F.col(f"b.{id_col}").alias(id_col), source, F.col(f"b.{score}").alias(score), F.lit(True).alias("added")))


def keyed_once(rows: DataFrame, keys: Sequence[Column], order: Sequence[Column], limit: int) -> DataFrame:
    """The first row of each key, the key being the first of several that a row has; rows without any are all kept. At most ``limit`` rows."""
    key = F.coalesce(*[F.when(F.trim(k.cast("string")) != "", F.concat(F.lit(f"{i}:"), k.cast("string"))) for i, k in enumerate(keys)])
    place = Window.partitionBy("__k").orderBy(*order)
    first = rows.withColumn("__k", key).withColumn("__p", F.when(F.col("__k").isNull(), F.lit(1)).otherwise(F.row_number().over(place)))
    return first.filter("__p = 1").drop("__k", "__p").orderBy(*order).limit(limit)


def anchors(requirement: str, low: int = 2, high: int = 4) -> list[str]:
    """The character runs of two to four of each word of a requirement; ASCII words stay whole."""
    out: list[str] = []
    for word in "".join(c if c.isalnum() or c in "_.-" else " " for c in requirement.lower()).split():
        out += [word] if word.isascii() else [word[i : i + n] for n in range(low, high + 1) for i in range(len(word) - n + 1)]
    return list(dict.fromkeys(w for w in out if len(w) >= low))


def anchored_packages(chunks: DataFrame, requirements: dict[str, str], text: Column, id_col: str, score: str, n: int) -> DataFrame:
    """For each field the ``n`` best chunks that have any anchor of its requirement; anchors are a bounded list a field."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.array_compact(F.array(*[F.when(has_any(low, anchors(r)), F.lit(f)) for f, r in requirements.items()]))
    rows = chunks.select(id_col, score, F.explode(hit).alias("field"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc(score), id_col))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def without_excluded(rows: DataFrame, words: Sequence[str]) -> DataFrame:
    """Rows that hold none of the words in any of their fields, without regard to case."""
    whole = F.lower(F.to_json(F.struct(*rows.columns)))
    return rows.filter(~has_any(whole, [w.lower() for w in words])) if words else rows


def asset_groups(evidence: DataFrame, keys: Sequence[str], kind: str, id_col: str, score: str, per_kind: int) -> DataFrame:
    """Groups by the first key that an item has, with their best score, items, and the best ``per_kind`` ids of each kind in order."""
    key = F.coalesce(*[F.when(F.trim(F.col(k).cast("string")) != "", F.col(k).cast("string")) for k in keys])
    rows = evidence.withColumn("asset", key)
    place = F.row_number().over(Window.partitionBy("asset", kind).orderBy(F.desc(score), id_col))
    best = rows.withColumn("__p", place).filter(F.col("__p") <= per_kind)
    ids = best.groupBy("asset", kind).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", id_col))), lambda x: x[id_col].cast("string")).alias("ids"))
    totals = rows.groupBy("asset", kind).agg(F.count("*").alias("items"), F.max(score).alias("best"))
    return totals.join(ids, ["asset", kind])


def grouped_facts(facts: DataFrame, by: Sequence[str], evidence_id: str, most: int = 100) -> DataFrame:
    """One row a fact (kind, subject, statement): how many items of evidence it has and the ``most`` first ids of them."""
    ids = facts.select(*by, evidence_id).distinct()
    place = F.row_number().over(Window.partitionBy(*by).orderBy(evidence_id))
    few = ids.withColumn("__p", place).filter(F.col("__p") <= most).groupBy(*by).agg(F.array_sort(F.collect_list(evidence_id)).alias("ids"))
    return ids.groupBy(*by).agg(F.count("*").alias("support")).join(few, list(by))


def structured_ranking(rows: DataFrame, score: str, current: Column, date: str, id_col: str, n: int) -> DataFrame:
    """The best ``n`` rows by score, then whether a row is current, then its date, newest first, then its id."""
    return rows.withColumn("current", current).orderBy(F.desc(score), F.desc("current"), F.desc(date), id_col).limit(n)


def important_values(docs: DataFrame, id_col: str, text: Column, most: int = 12, longest: int = 220) -> DataFrame:
    """Sentences with a number and a word of a metric, at most ``most`` a text, each cut at ``longest`` characters; in order."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[。；;！？!?\n]+|\.\s+")
    kept = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s.rlike(NUMBER) & has_any(F.lower(s), METRIC_HINTS))
    cut = F.transform(F.slice(F.array_distinct(kept), 1, most), lambda s: F.when(F.length(s) > longest, F.concat(F.substring(s, 1, longest - 3), F.lit("..."))).otherwise(s))
    return docs.select(id_col, F.posexplode(cut).alias("place", "value"))


def names_of_chunks(links: DataFrame, entities: DataFrame, chunk: str, entity: str, name: str, most: int = 100) -> DataFrame:
    """For each chunk its entities' names in order, the ``most`` first."""
    pairs = links.join(entities, entity).select(chunk, name).distinct()
    place = F.row_number().over(Window.partitionBy(chunk).orderBy(name))
    return pairs.withColumn("__p", place).filter(F.col("__p") <= most).groupBy(chunk).agg(F.array_sort(F.collect_list(name)).alias("names"))


def public_model_score(query: str, fields: Sequence[Column], name: Column, keywords: Sequence[str] = ()) -> Column:
    """0.2 for each query token in the fields, at most 0.8; 1 more where the query is the name, 0.15 where a keyword of the kind is in the fields."""
    import re

    tokens = [t for t in re.split(r"[^0-9a-z一-鿿]+", query.lower()) if t]
    low = F.lower(F.concat_ws("\n", *fields))
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in dict.fromkeys(tokens)), F.lit(0))
    exact = F.when(F.lower(F.trim(name)) == query.lower().strip(), 1.0).otherwise(0.0)
    return F.least(F.lit(0.8), 0.2 * hits) + exact + (F.when(has_any(low, [k.lower() for k in keywords]), 0.15).otherwise(0.0) if keywords else F.lit(0.0))


def balanced_down(rows: DataFrame, cells: Sequence[str], id_col: str, seed: int, least: int = 1) -> DataFrame:
    """Cut every cell to the size of the smallest one that has ``least`` rows or more, by a digest of the id; smaller cells stay whole. A cell
    with most of all rows is sorted in ranges of the digest, not in one task."""
    from loomspan.functions.text import selection_key
    from loomspan.operators.datasets import numbered

    sizes = rows.groupBy(*cells).agg(F.count("*").alias("n"))
    goal = sizes.filter(F.col("n") >= least).agg(F.min("n")).first()[0] or 0
    placed = numbered(rows.withColumn("__k", selection_key(seed, F.col(id_col))), list(cells), "__k", id_col)
    return placed.filter(F.col("__place") <= F.lit(int(goal))).select(*rows.columns)
