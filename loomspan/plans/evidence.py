"""Evidence, facts, aspects and text functions; rows that the tables lack are given in the query."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import aspects as A
from loomspan.functions import rules, text
from loomspan.operators import evidence as V
from loomspan.operators import retrieval
from loomspan.plans import search
from loomspan.plans.base import Registry
from loomspan.sources.snapshots import stored

R = Registry()


@R.add("decontaminated_sets", """
WITH a AS (SELECT user_id, event_id, event_type || ':' || floor(value)::BIGINT AS k, event_id % 5 = 0 AS test FROM events), l AS (SELECT k FROM a GROUP BY 1 HAVING bool_or(test) AND NOT bool_and(test))
SELECT CASE WHEN test THEN 'test' ELSE 'train' END AS split, count(*) AS kept, min(event_id) AS first_id FROM a WHERE k NOT IN (SELECT k FROM l) GROUP BY 1""")
def decontaminated_sets(t):
    e = t("events")
    train, test, _ = V.without_leaks(e.filter("event_id % 5 != 0"), e.filter("event_id % 5 = 0"), F.concat_ws(":", "event_type", F.floor("value").cast("string")))
    both = train.select(F.lit("train").alias("split"), "event_id").unionByName(test.select(F.lit("test").alias("split"), "event_id"))
    return both.groupBy("split").agg(F.count("*").alias("kept"), F.min("event_id").alias("first_id"))


@R.add("best_keyword_signal", f"""
WITH b AS (SELECT * FROM {search._BM}), f AS (SELECT doc_id, n_chars::DOUBLE AS score FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 100)
SELECT coalesce(b.doc_id, f.doc_id) AS doc_id, round(greatest(coalesce(f.score / (SELECT max(score) FROM f), 0), coalesce(b.score / (SELECT max(score) FROM b), 0)), 6) AS score FROM b FULL JOIN f ON f.doc_id = b.doc_id""")
def best_keyword_signal(t):
    other = retrieval.top(t("documents").filter("lang = 'en'").select("doc_id", F.col("n_chars").cast("double").alias("score")), 100, "doc_id")
    return V.best_keyword_signal(other, search.bm25(t), "doc_id").withColumn("score", F.round("score", 6))


@R.add("merged_lists", """
WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part ORDER BY 2 LIMIT 30), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place FROM part ORDER BY 2 LIMIT 30)
SELECT * FROM (SELECT p_partkey, 0 AS list, place FROM a UNION ALL SELECT p_partkey, 1, place FROM b WHERE p_partkey NOT IN (SELECT p_partkey FROM a)) ORDER BY list, place LIMIT 45""")
def merged_lists(t):
    top = lambda c: retrieval.ranked(retrieval.top(t("part").select("p_partkey", F.col(c).cast("double").alias("score")), 30, "p_partkey").withColumn("list", F.lit("x")), "p_partkey").select("p_partkey", "place")
    return V.merged_lists(top("p_retailprice"), top("p_size"), "p_partkey", 45)


@R.add("cross_source_evidence", """
WITH s AS (SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 3000) SELECT doc_id, source, n_chars, false AS added FROM s UNION ALL
SELECT arg_max(doc_id, (n_chars, -doc_id)), source, max(n_chars), true FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM s WHERE source IS NOT NULL) GROUP BY source""")
def cross_source_evidence(t):
    d = t("documents").select("doc_id", "source", "n_chars")
    return V.with_other_sources(t("documents").filter("lang = 'en' AND n_chars > 3000").select("doc_id", "source", "n_chars"), d.filter("source IS NOT NULL"), "doc_id", "source", "n_chars")


@R.add("keyed_once", """
WITH k AS (SELECT *, CASE WHEN trim(lang) <> '' AND n_chars > 2000 THEN '0:' || lang || source ELSE '1:' || md5(text) END AS k FROM documents)
SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n_chars DESC, doc_id) AS r FROM k) WHERE k IS NULL OR r = 1 ORDER BY n_chars DESC, doc_id LIMIT 300""")
def keyed_once(t):
    keys = [F.when(F.col("n_chars") > 2000, F.concat("lang", "source")), F.md5("text")]
    return V.keyed_once(t("documents"), keys, [F.desc("n_chars"), F.col("doc_id")], 300).select("doc_id", "n_chars")


@R.add("anchored_packages", """
WITH h AS (SELECT p_partkey, p_retailprice, unnest(list_filter([CASE WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'bolt') THEN 'colour' END, CASE WHEN contains(lower(p_name), 'nut') THEN 'part' END], lambda x: x IS NOT NULL)) AS field FROM part)
SELECT * FROM (SELECT p_partkey, p_retailprice, field, row_number() OVER (PARTITION BY field ORDER BY p_retailprice DESC, p_partkey)::INT AS place FROM h) WHERE place <= 15""")
def anchored_packages(t):
    return V.anchored_packages(t("part"), {"colour": "red bolt", "part": "nut"}, F.col("p_name"), "p_partkey", "p_retailprice", 15)


@R.add("excluded_evidence", "SELECT p_partkey FROM part WHERE NOT (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'brand#3') OR contains(lower(p_type), 'red'))")
def excluded_evidence(t):
    return V.without_excluded(t("part").select("p_partkey", "p_name", "p_brand", "p_type"), ["RED", "brand#3"]).select("p_partkey")


@R.add("asset_groups", """
WITH r AS (SELECT coalesce(nullif(trim(source), ''), lang, doc_id::VARCHAR) AS asset, coalesce(lang, '-') AS kind, doc_id, n_chars FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY asset, kind ORDER BY n_chars DESC, doc_id) AS k FROM r)
SELECT asset, kind, count(*) AS items, max(n_chars) AS best, string_agg(doc_id::VARCHAR, ',' ORDER BY k) FILTER (k <= 3) AS ids FROM p GROUP BY 1, 2""")
def asset_groups(t):
    d = t("documents").withColumn("kind", F.coalesce("lang", F.lit("-")))
    return V.asset_groups(d, ["source", "lang", "doc_id"], "kind", "doc_id", "n_chars", 3).withColumn("ids", F.array_join("ids", ","))


@R.add("grouped_facts", """
WITH f AS (SELECT DISTINCT o_orderstatus AS kind, o_orderpriority AS subject, o_custkey % 7 AS statement, o_orderkey AS id FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY kind, subject, statement ORDER BY id) AS k FROM f)
SELECT kind, subject, statement, count(*) AS support, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (k <= 5) AS ids FROM p GROUP BY 1, 2, 3""")
def grouped_facts(t):
    f = t("orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("subject"), (F.col("o_custkey") % 7).alias("statement"), F.col("o_orderkey").alias("id"))
    return V.grouped_facts(f, ["kind", "subject", "statement"], "id", 5).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@R.add("structured_ranking", """
SELECT o_orderkey, o_orderstatus = 'O' AS current FROM orders ORDER BY o_custkey % 5 DESC, (o_orderstatus = 'O') DESC, o_orderdate DESC, o_orderkey LIMIT 40""")
def structured_ranking(t):
    o = t("orders").withColumn("score", F.col("o_custkey") % 5)
    return V.structured_ranking(o, "score", F.col("o_orderstatus") == "O", "o_orderdate", "o_orderkey", 40).select("o_orderkey", "current")


@R.add("chunk_entity_names", f"""
WITH p AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS k FROM (SELECT DISTINCT doc_id, name FROM {search._MENTIONS})) SELECT doc_id, string_agg(name, ',' ORDER BY name) AS names FROM p WHERE k <= 100 GROUP BY 1""")
def chunk_entity_names(t):
    m = stored(search.found(t))  # read twice, found once
    ids = m.select("kind", "name").distinct().withColumn("entity", F.sha1(F.concat_ws("\n", "kind", "name")))
    links = m.withColumn("entity", F.sha1(F.concat_ws("\n", "kind", "name"))).select("doc_id", "entity")
    return V.names_of_chunks(links, ids, "doc_id", "entity", "name").withColumn("names", F.array_join("names", ","))


@R.add("public_model_score", """
SELECT p_partkey, round(least(0.8, 0.2 * (contains(x, 'red')::INT + contains(x, 'bolt')::INT + contains(x, 'economy')::INT)) + CASE WHEN lower(trim(p_name)) = 'red bolt economy' THEN 1.0 ELSE 0.0 END + CASE WHEN contains(x, 'brand#3') THEN 0.15 ELSE 0.0 END, 6)::DOUBLE AS score
FROM (SELECT *, lower(p_name || chr(10) || p_type || chr(10) || p_brand) AS x FROM part)""")
def public_model_score(t):
    score = V.public_model_score("Red bolt, economy", [F.col("p_name"), F.col("p_type"), F.col("p_brand")], F.col("p_name"), ["Brand#3"])
    return t("part").select("p_partkey", F.round(score, 6).alias("score"))


@R.add("balanced_down", """
WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), g AS (SELECT min(n) AS g FROM c WHERE n >= 3)
SELECT lang, source, least(n, g) AS kept FROM c, g""")
def balanced_down(t):
    return V.balanced_down(t("documents"), ["lang", "source"], "doc_id", 3, 3).groupBy("lang", "source").agg(F.count("*").alias("kept"))


CHUNKS = [
    ("模型精度测试: acc 97.2%", "document", ""), ("算法边界: 夜间无法保证精度", "document", ""), ("输入: 图片 输出: 标签", "document", ""), ("net.onnx 特征维度 256", "table", "owner"), ("plain words", "deployment", "benchmark_info"),
    ("plain words", "document", ""), ("标签解释 label_a", "table", "labels"), ("本版本相比上版提升 0.5%", "document", ""), ("耗时 12 ms", "document", ""), ("负责人 张三 发布时间 2024", "table", "owner"), ("部署地址 did 12345", "deployment", ""),
]
_pick = lambda k: f"([{', '.join(repr(c[k]) for c in CHUNKS)}])[doc_id % {len(CHUNKS)} + 1]"
_VALUES = f"(SELECT doc_id AS i, coalesce(text, '') || ' ' || {_pick(0)} AS t, {_pick(1)} AS s, {_pick(2)} AS k FROM documents)"
_FLAT = "regexp_replace(lower(t), '\\s+', '', 'g')"
_any = lambda words: "(" + " OR ".join(f"contains(f, '{w}')" for w in words) + ")"
_re = lambda p: f"regexp_matches(t, '{p}')"
_SHOWS = {a: " OR ".join([*([_any(p)] if p else []), *map(_re, A.PATTERNS.get(a, ()))]) for a, p in A.PHRASES.items()}
_EXCUSE = ("指标", "评测", "测试结果", "模型精度", "精度测试", "无掉点", "提升", "下降")
_SHOWS["accuracy_metric"] = f"""NOT (({_SHOWS['limitation']}) AND NOT {_re(A.STRONG_METRIC)} AND NOT {_any(_EXCUSE)}) AND ({_re(A.ANY_METRIC)} OR ({_any(A.METRIC_CONTEXT)} AND ({_re(A.METRIC_VALUE)} OR {_any(A.METRIC_TEST)}))
OR (contains(f, '精度') AND {_re(A.METRIC_VALUE)} AND NOT contains(f, '无法保证')))"""
_BY_SOURCE = ["CASE WHEN s = 'deployment' THEN 'deployment' END", "CASE WHEN s = 'deployment' AND k = 'benchmark_info' THEN 'accuracy_metric' END"] + [f"CASE WHEN s = 'table' AND k IN ({', '.join(map(repr, n))}) THEN '{a}' END" for a, n in A.TABLE_FIELDS.items()]
_ASPECTS = f"""(SELECT i, t, s, f, list_filter([{', '.join(_BY_SOURCE + [f"CASE WHEN {c} THEN '{a}' END" for a, c in _SHOWS.items()])}], lambda x: x IS NOT NULL) AS a FROM (SELECT *, {_FLAT} AS f FROM {_VALUES}))"""
_has = lambda a: f"list_contains(a, '{a}')"
_SECTION = f"""CASE WHEN {_has('limitation')} AND {_any(A.BOUNDARY)} THEN 'algorithm_boundary' WHEN {_has('accuracy_metric')} AND {_any(A.EVALUATION)} THEN 'accuracy_eval' WHEN {_has('accuracy_metric')} AND {_any(A.PHRASES['release_change'])} THEN 'release_note'
WHEN {_has('accuracy_metric')} THEN 'accuracy_metric' WHEN {_has('limitation')} THEN 'algorithm_boundary' WHEN {_has('input_output')} THEN 'input_output' WHEN {_has('model_artifact')} THEN 'model_artifact' WHEN {_has('deployment')} THEN 'deployment'
WHEN {_has('label_schema')} THEN 'label_schema' WHEN {_has('performance_latency')} THEN 'performance_eval' WHEN {_has('owner_metadata')} THEN 'owner_metadata' WHEN {_has('release_change')} THEN 'release_note' ELSE 'general' END"""


def chunk_rows(t, ids=None):
    """Documents as chunks, each with a sign of one kind of chunk behind its text."""
    pick = lambda k: F.get(F.array(*[F.lit(c[k]) for c in CHUNKS]), (F.col("doc_id") % len(CHUNKS)).cast("int"))
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), pick(0))
    docs = t("documents") if ids is None else t("documents").join(ids, "doc_id", "left_semi")
    df = docs.select(F.col("doc_id").alias("i"), F.explode(F.array(said)).alias("t"), pick(1).alias("s"), F.when(pick(2) != "", F.array(pick(2))).otherwise(F.array().cast("array<string>")).alias("k"))
    t_, f = F.col("t"), F.col("f")
    for name, made in (("f", A.flat(t_)), ("signs", A.signs(t_, f)), ("a", A.chunk_aspects(t_, F.col("s"), F.col("k"), F.col("signs"))), ("sec", A.section_type(t_, F.col("a"), f))):
        df = df.withColumn(name, F.explode(F.array(made)))  # made once a row
    return df


@R.add("chunk_aspects", f"SELECT i, coalesce(nullif(array_to_string(list_filter(a, lambda x, j: list_position(a, x) = j), ','), ''), 'general') AS aspects, {_SECTION} AS section FROM {_ASPECTS}")
def chunk_aspects(t):
    return chunk_rows(t).select("i", F.array_join("a", ",").alias("aspects"), F.col("sec").alias("section"))


def _sum(parts: list[tuple[str, float]]) -> str:
    return " + ".join(f"(CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END)" for c, w in parts)


_ACC, _LIM = _has("accuracy_metric"), _has("limitation")
_ACC_SCORE = _sum([
    (_ACC, 0.7), (f"NOT {_ACC} AND {_has('release_change')}", 0.35), (f"NOT {_ACC} AND NOT {_has('release_change')}", -0.12), (_SHOWS["accuracy_metric"], 0.5), (_re(A.METRIC_VALUE), 0.2), (f"({_SECTION}) IN ('accuracy_eval', 'release_note', 'accuracy_metric')", 0.25),
    (f"{_LIM} AND NOT {_ACC}", -0.5), (f"{_LIM} AND {_ACC} AND contains(f, '无法保证')", -0.18), (f"{_has('label_schema')} AND NOT {_ACC}", -0.22), (f"{_has('model_artifact')} AND NOT {_ACC}", -0.25), (f"s IN ('table', 'deployment') AND NOT {_ACC}", -0.2),
])
_LIM_SCORE = _sum([(_LIM, 1.15), (f"NOT {_LIM}", -0.12), (_any(A.BOUNDS), 0.35), (f"{_ACC} AND NOT {_LIM}", -0.3), (f"s IN ('table', 'deployment') AND NOT {_LIM}", -0.2)])
_DEP_SCORE = _sum([(_has("deployment"), 0.7), (f"NOT {_has('deployment')}", -0.12), ("s = 'deployment'", 0.35), (_SHOWS["deployment"], 0.25)])


@R.add("answerability", f"""
WITH z AS (SELECT i, a, 'accuracy_metric' AS aspect, {_ACC_SCORE} AS score FROM {_ASPECTS} UNION ALL SELECT i, a, 'limitation', {_LIM_SCORE} FROM {_ASPECTS} UNION ALL SELECT i, a, 'deployment', {_DEP_SCORE} FROM {_ASPECTS}),
y AS (SELECT i, a, aspect, greatest(-1.0, least(1.8, score)) AS score FROM z)
SELECT i, aspect, round(score, 6)::DOUBLE AS score, CASE WHEN list_contains(a, aspect) AND round(score, 6) >= 0.7 THEN 'primary' WHEN aspect = 'accuracy_metric' AND {_LIM} AND NOT {_ACC} THEN 'caveat' WHEN aspect = 'limitation' AND {_ACC} AND NOT {_LIM} THEN 'supporting'
WHEN {_LIM} AND round(score, 6) < 0.45 THEN 'caveat' ELSE 'supporting' END AS role FROM y""")
def answerability(t):
    rows = chunk_rows(t)
    each = [F.struct(F.lit(q).alias("aspect"), F.round(A.answer_score(q, F.col("signs"), F.col("f"), F.col("s"), F.col("a"), F.col("sec")), 6).alias("score")) for q in ("accuracy_metric", "limitation", "deployment")]
    out = rows.select("i", "a", F.explode(F.array(*each)).alias("x")).select("i", "a", "x.*")  # one pass over the texts for all questions
    return out.select("i", "aspect", "score", rules.evidence_role(F.col("aspect"), F.col("a"), F.col("score")).alias("role"))


@R.add("retrieval_boosts", f"""
WITH b AS (SELECT i, t, s, lower(t) AS l, f, a, greatest(-1.0, least(1.8, {_ACC_SCORE})) AS sc FROM {_ASPECTS}), e AS (SELECT *, least(2.0, CASE WHEN contains(l, 'net.onnx') OR contains(f, 'net.onnx') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(l, 'plain') THEN 0.75 ELSE 0.0 END + CASE WHEN contains(l, 'acc') THEN 0.45 ELSE 0.0 END)::DOUBLE AS en FROM b)
SELECT i, round(CASE WHEN contains(l, '特征维度') THEN 0.32 ELSE 0.0 END + CASE WHEN contains(l, '模型文件列表') THEN 0.12 ELSE 0.0 END - CASE WHEN s = 'table' AND NOT contains(l, '特征维度') THEN 0.18 ELSE 0.0 END, 6)::DOUBLE AS lexical,
round(CASE WHEN en <= 0 THEN sc * 0.02 - 0.65 ELSE sc * 0.38 + least(en, 1.0) * 0.18 END + CASE WHEN regexp_matches(l, 'acc|precision|recall|f1|map|top1|m/prec|mprec|ma') THEN 0.1 ELSE 0.0 END - CASE WHEN contains(l, '无法保证') AND NOT regexp_matches(l, 'acc|precision|recall|f1|map|top1') THEN 0.24 ELSE 0.0 END, 6)::DOUBLE AS aspect,
round(CASE WHEN s IN ('table', 'deployment') AND (contains(l, 'plain') OR contains(l, '256') OR contains(l, 'did')) THEN least(0.18, 0.035 * (contains(l, 'plain')::INT + contains(l, '256')::INT + contains(l, 'did')::INT)) ELSE 0.0 END, 6)::DOUBLE AS structured FROM e""")
def retrieval_boosts(t):
    body, f, source = F.col("t"), F.col("f"), F.col("s")
    score = A.answer_score("accuracy_metric", F.col("signs"), f, source, F.col("a"), F.col("sec"))
    rows = chunk_rows(t).withColumn("score", F.explode(F.array(score)))
    return rows.select(
        "i", F.round(A.lexical_boost("特征维度是多少", body, source), 6).alias("lexical"), F.round(A.aspect_boost("accuracy_metric", F.col("score"), ["net.onnx", "plain", "acc"], body, f), 6).alias("aspect"),
        F.round(A.structured_boost("plain", ["plain", "256", "did", "t4"], body, body, source), 6).alias("structured"),
    )


_TAGS = [("Red  Bolt", "redbolt"), ("", ""), ("chunk:12-x y", "table-7"), ("runs on T4, not t40", "cuda11")]
_tag = lambda k: f"([{', '.join(repr(c[k]) for c in _TAGS)}])[doc_id % {len(_TAGS)} + 1]"


@R.add("text_functions", rf"""
WITH v AS (SELECT doc_id AS i, {_tag(0)} || ' ' || coalesce(text, '') AS a, {_tag(1)} || coalesce(text, '') AS b FROM documents), z AS (SELECT *, regexp_replace(lower(a), '\s+', '', 'g') AS x, regexp_replace(lower(b), '\s+', '', 'g') AS y FROM v)
SELECT i, x <> '' AND x = y AS same, md5(array_to_string(list_filter(regexp_split_to_array(lower(a), '[^0-9a-z一-鿿]+'), lambda t: t <> ''), ' ')) AS tokens, md5(trim(regexp_replace(a, '\s+', ' ', 'g'))) AS clean,
CASE lower(regexp_extract(a, '^([^:\-]*)', 1)) WHEN 'chunk' THEN 'text' WHEN 'table' THEN 'rows' ELSE 'document' END AS kind, regexp_matches(lower(a), '(^|[^a-z0-9])t4($|[^a-z0-9])') AS on_t4, contains(lower(b), 'cuda') AS on_cuda FROM z""")
def text_functions(t):
    """Whole texts behind tags that the functions look for."""
    tag = lambda k: F.get(F.array(*[F.lit(c[k]) for c in _TAGS]), (F.col("doc_id") % len(_TAGS)).cast("int"))
    body = F.coalesce("text", F.lit(""))
    df = t("documents").select(F.col("doc_id").alias("i"), F.concat(tag(0), F.lit(" "), body).alias("a"), F.concat(tag(1), body).alias("b"))
    a, b = F.col("a"), F.col("b")
    return df.select(
        "i", text.queries_equivalent(a, b).alias("same"), F.md5(F.array_join(text.split_tokens(a), " ")).alias("tokens"), F.md5(text.clean_text(a)).alias("clean"), text.source_of_id(a, {"chunk": "text", "table": "rows"}).alias("kind"),
        text.names_platform(a, "T4").alias("on_t4"), text.names_platform(b, "CUDA").alias("on_cuda"),
    )


@R.add("important_values", r"""
WITH s AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '[。；;！？!?\n]+|\.\s+'), lambda x: trim(x)) AS v FROM documents),
e AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM s) WHERE regexp_matches(x, '\d') AND regexp_matches(lower(x), 'acc|precision|recall|f1|map|auc|threshold|阈值|精度|准确率|召回|耗时|%') GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM e)
SELECT doc_id, (place - 1)::INT AS place, CASE WHEN length(x) > 220 THEN substr(x, 1, 217) || '...' ELSE x END AS value FROM p WHERE place <= 12""")
def important_values(t):
    return V.important_values(t("documents"), "doc_id", F.col("text"))
