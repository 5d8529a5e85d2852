"""Entities in texts and the graph of entities that occur together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import normalize_text

#: A place with no letter, digit or underscore before it, or behind it; written out, since what ``\b`` means beside other scripts depends on the Java version.
_OPEN, _SHUT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

#: The kinds of entities and their patterns (group number after each).
PATTERNS = [
    ("model", r"([A-Za-z0-9][A-Za-z0-9_./+-]{3,}\.(?:model|onnx|pt|pth|safetensors))", 1),
    ("version", _OPEN + r"([vV]?\d+(?:\.\d+){1,3}(?:[-_][A-Za-z0-9]+)?)" + _SHUT, 1),
    ("oid", _OPEN + r"([a-fA-F0-9]{32,64})" + _SHUT, 1),
    ("deployment", "(?i)" + _OPEN + r"(?:did|rid|deployment_id|release_id)[:=\s_-]*(\d{4,})" + _SHUT, 1),
    ("platform", "(?i)" + _OPEN + r"(cuda\d+(?:\.\d+)?-trt\d+(?:\.\d+)?-[a-z0-9]+-[A-Za-z0-9]+|acl-[A-Za-z0-9]+-[a-z0-9]+|cpu-[A-Za-z0-9]+-[a-z0-9]+)" + _SHUT, 1),
    ("field", r"(输入|输出|阈值|推荐阈值|追加数据|优化点|标签|负责人|更新时间|推荐配置)", 1),
    ("scene", r"([一-鿿]{2,12}(?:检测|识别|分类|属性|特征|质量|模型|项目|场景))", 1),
]
#: Further kinds, for texts of other subjects.
EXTRA = [("email", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", 1), ("host", r"https?://([A-Za-z0-9.-]+)", 1)]

#: What a text must hold, one of them at least, for a pattern to find anything in it; others are not searched.
HOLDS = {PATTERNS[0][1]: (".model", ".onnx", ".pt", ".safetensors"), EXTRA[0][1]: ("@",), EXTRA[1][1]: ("http",)}


def mentions(docs: DataFrame, id_col: str, text_col: str, patterns: list[tuple[str, str, int]] | None = None, most: int | None = 36) -> DataFrame:
    """(id, kind, name): distinct entities of each text without regard to case, the first ``most`` by kind and place (all if None)."""
    docs = docs.select(id_col, F.explode(F.array(normalize_text(F.col(text_col)))).alias("__t"))  # made once a row
    text, none = F.col("__t"), F.array().cast("array<string>")

    def of_kind(kind: str, pattern: str, group: int):
        every = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        hold = [F.contains(text, F.lit(w)) for w in HOLDS.get(pattern, ())]
        every = F.when(reduce(Column.__or__, hold), every).otherwise(none) if hold else every
        return F.transform(every, lambda x: F.struct(F.lit(kind).alias("kind"), F.lower(x).alias("name")))

    found = [of_kind(*p) for p in patterns or PATTERNS]
    names = F.array_distinct(F.flatten(F.array(*found)))
    return docs.select(id_col, F.explode(names if most is None else F.slice(names, 1, most)).alias("e")).select(id_col, "e.kind", "e.name")


def cooccurrences(m: DataFrame, id_col: str) -> DataFrame:
    """(a, b, evidence): pairs of entities and the number of texts with both. Pairs are made one after the other, not as an array of all."""
    names = m.groupBy(id_col).agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "name"))).alias("n")).filter(F.size("n") > 1)
    one = names.select(F.posexplode("n").alias("i", "a"), "n")
    return one.select("a", F.explode(F.slice("n", F.col("i") + 2, F.size("n"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("evidence"))


def top_nodes(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` nodes with most evidence, with their degree."""
    ends = edges.select(F.col("a").alias("node"), "evidence").unionByName(edges.select(F.col("b").alias("node"), "evidence"))
    return ends.groupBy("node").agg(F.sum("evidence").alias("evidence"), F.count("*").alias("degree")).orderBy(F.desc("evidence"), "node").limit(n)


def overlap_scores(m: DataFrame, id_col: str, query: list[str]) -> DataFrame:
    """The share of the query's entities that each text mentions."""
    wanted = sorted({q.lower() for q in query})
    return m.filter(F.col("name").isin(wanted)).groupBy(id_col).agg((F.countDistinct("name") / F.lit(float(len(wanted)))).alias("score"))


def kind_counts(m: DataFrame, id_col: str) -> DataFrame:
    return m.groupBy("kind").agg(F.count("*").alias("mentions"), F.countDistinct("name").alias("entities"), F.countDistinct(id_col).alias("texts"))


def best_of(df: DataFrame, group: str, by: str, id_col: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(by), id_col)
    return df.withColumn("__p", F.row_number().over(w)).filter("__p = 1").drop("__p")


def _named(node: str) -> tuple[Column, Column]:
    """Kind and name of a node ``kind:name``."""
    return F.substring_index(node, ":", 1), F.expr(f"substring(`{node}`, instr(`{node}`, ':') + 1)")


def _chosen(kind: Column, kinds: Sequence[str], without: Sequence[str]) -> Column:
    ok = kind.isin(*kinds) if kinds else F.lit(True)
    return ok & ~kind.isin(*without) if without else ok


def _any_term(terms: Sequence[str], *fields: Column) -> Column:
    """Whether a term stands in one of the fields, without regard to case; true without terms."""
    hits = [F.contains(F.lower(f), F.lit(t.lower())) for t in terms if t for f in fields]
    return reduce(Column.__or__, hits) if hits else F.lit(True)


def node_texts(m: DataFrame, id_col: str) -> DataFrame:
    """(node, texts): every entity as ``kind:name`` and the number of texts with it."""
    return m.select(id_col, F.concat_ws(":", "kind", "name").alias("node")).distinct().groupBy("node").agg(F.count("*").alias("texts"))


def candidate_edges(edges: DataFrame, m: DataFrame, id_col: str, kinds: Sequence[str] = (), without: Sequence[str] = (), terms: Sequence[str] = (), least: int = 1, limit: int = 4000) -> DataFrame:
    """The strongest edges with both ends told: (a_kind, a_name, a_texts, b_kind, b_name, b_texts, evidence).

    Both ends must be of the ``kinds`` asked for and none of those left out; of the ``terms`` one must stand in a name or kind of either
    end. Edges go by evidence, then by the texts of both ends, then by name. Filters come before the joins with the ends' counts; the
    order needs no full sort.
    """
    a, b = _named("a"), _named("b")
    rows = edges.filter(F.col("evidence") >= least).select("a", "b", "evidence", a[0].alias("a_kind"), a[1].alias("a_name"), b[0].alias("b_kind"), b[1].alias("b_name"))
    rows = rows.filter(_chosen(F.col("a_kind"), kinds, without) & _chosen(F.col("b_kind"), kinds, without) & _any_term(terms, *map(F.col, ("a_name", "a_kind", "b_name", "b_kind"))))
    texts = node_texts(m, id_col)
    for end in "ab":
        rows = rows.join(texts.select(F.col("node").alias(end), F.col("texts").alias(f"{end}_texts")), end, "left").withColumn(f"{end}_texts", F.coalesce(f"{end}_texts", F.lit(0)))
    out = rows.orderBy(F.desc("evidence"), F.desc(F.col("a_texts") + F.col("b_texts")), F.lower("a_name"), F.lower("b_name"), "a", "b").limit(limit)
    return out.select("a_kind", "a_name", "a_texts", "b_kind", "b_name", "b_texts", "evidence")


def found_nodes(m: DataFrame, id_col: str, terms: Sequence[str], kinds: Sequence[str] = (), without: Sequence[str] = (), limit: int = 100) -> DataFrame:
    """(rank, kind, name, texts): entities with one of the terms in their name or kind, by texts and name; for a search that no edge answers. No terms give none."""
    rows = node_texts(m.filter(_chosen(F.col("kind"), kinds, without) & _any_term(terms, F.col("name"), F.col("kind"))), id_col)
    kind, name = _named("node")
    top = rows.orderBy(F.desc("texts"), F.lower(name), "node").limit(limit if any(terms) else 0)
    rank = F.row_number().over(Window.orderBy(F.desc("texts"), F.lower("name"), "node"))  # over ``limit`` rows
    return top.select("node", kind.alias("kind"), name.alias("name"), "texts").withColumn("rank", rank).select("rank", "kind", "name", "texts")


def graph_counts(texts: DataFrame, source: str, m: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, value, n, evidence): texts by source, entities and mentions by kind, edges by the kinds they connect with the sum of their evidence."""
    none = F.lit(None).cast("long").alias("evidence")
    by_source = texts.groupBy(F.col(source).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit("texts").alias("what"), "value", "n", none)
    per = m.groupBy("kind", "name").agg(F.count("*").alias("k")).groupBy("kind").agg(F.count("*").alias("entities"), F.sum("k").alias("mentions"))
    kinds = per.select(F.explode(F.array(*[F.struct(F.lit(w).alias("what"), F.col("kind").alias("value"), F.col(w).alias("n")) for w in ("entities", "mentions")])).alias("x")).select("x.*", none)
    between = F.concat_ws("-", _named("a")[0], _named("b")[0])
    links = edges.groupBy(between.alias("value")).agg(F.count("*").alias("n"), F.sum("evidence").alias("evidence")).select(F.lit("edges").alias("what"), "value", "n", "evidence")
    return by_source.unionByName(kinds).unionByName(links)
