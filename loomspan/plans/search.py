"""Ranking, fusion, entities, chunks and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions.text import playbook_query, playbook_tokens, text_tokens
from loomspan.operators import chunking, graph, playbook, retrieval, sessions
from loomspan.plans.base import Registry
from loomspan.sources.inverted import InvertedIndex
from loomspan.sources.snapshots import shared_dir

R = Registry()
QUERY = "the onanding therein with erstable thing release"
TERMS = ["the", "onanding", "therein", "with", "erstable", "thing", "release"]
_TOK = "regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.:/+-]+')"


def bm25_sql(table: str, id_col: str, tokens: str, where: str = "WHERE score > 0") -> str:
    return f"""(WITH tok AS (SELECT {id_col}, {tokens} AS tk FROM {table}), len AS (SELECT {id_col}, tk, len(tk) AS dl FROM tok),
st AS (SELECT count(*) AS n, avg(dl) FILTER (dl > 0) AS al FROM len), q AS (SELECT unnest({TERMS!r}) AS term),
tf AS (SELECT {id_col}, dl, term, len(list_filter(tk, lambda x: x = term)) AS tf FROM len, q),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY 1)
SELECT * FROM (SELECT {id_col}, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / al))) ELSE 0.0 END) AS score
FROM tf JOIN df USING (term), st GROUP BY 1) {where})"""


_BM = bm25_sql("documents", "doc_id", _TOK)


def bm25(t, keep_zero: bool = False):
    return retrieval.bm25(t("documents"), TERMS, "doc_id", text_tokens(F.col("text")), keep_zero=keep_zero)


@R.add("bm25_topk", f"SELECT doc_id, round(score / (SELECT max(score) FROM {_BM}), 6) AS score FROM {_BM} ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
def bm25_topk(t):
    scored = bm25(t).withColumn("raw", F.round("score", 9))
    return retrieval.top(retrieval.over_max(scored), 20, "doc_id", "raw").select("doc_id", F.round("score", 6).alias("score"))


def indexed(t) -> InvertedIndex:
    """A new index of all documents, in the shared folder."""
    docs = t("documents")
    index = InvertedIndex(docs.sparkSession, shared_dir(docs.sparkSession), buckets=16)
    index.upsert(docs, "doc_id", text_tokens(F.col("text")), F.lit(1))
    return index


def indexed_top(index: InvertedIndex, scope=None, k: int = 50):
    scored = index.bm25(TERMS, scope).withColumn("raw", F.round("score", 9))
    return retrieval.top(scored, k, "id", "raw").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def indexed_sql(table: str) -> str:
    return f"SELECT doc_id, round(score, 6) AS score FROM {bm25_sql(table, 'doc_id', _TOK)} ORDER BY round(score, 9) DESC, doc_id LIMIT 50"


@R.add("indexed_bm25_topk", indexed_sql("documents"))
def indexed_bm25_topk(t):
    return indexed_top(indexed(t))


_CHANGED = "(SELECT doc_id, CASE lang WHEN 'fr' THEN text || ' erstable release thing' WHEN 'de' THEN 'the release' ELSE text END AS text FROM documents WHERE coalesce(lang, '') <> 'es')"


@R.add("indexed_bm25_after_changes", indexed_sql(_CHANGED))
def indexed_bm25_after_changes(t):
    """Of French and German documents a second version, and none of the Spanish ones; a late first version changes nothing."""
    index, docs = indexed(t), t("documents")
    new = docs.withColumn("text", F.when(F.col("lang") == "fr", F.concat("text", F.lit(" erstable release thing"))).otherwise("the release"))
    index.upsert(new.filter(F.col("lang").isin("fr", "de")), "doc_id", text_tokens(F.col("text")), F.lit(2))
    index.remove(docs.filter("lang = 'es'"), "doc_id", F.lit(2))
    index.upsert(docs.filter(F.col("lang").isin("es", "de")), "doc_id", text_tokens(F.col("text")), F.lit(1))
    return indexed_top(index)


@R.add("indexed_bm25_of_a_source", indexed_sql("(SELECT * FROM documents WHERE lang = 'en' AND n_chars > 200)"))
def indexed_bm25_of_a_source(t):
    """Statistics and ranks over the documents of a scope, from the index of all."""
    return indexed_top(indexed(t), t("documents").filter("lang = 'en' AND n_chars > 200").select("doc_id"))


@R.add("bm25_topk_unnormalized_zero_kept", f"SELECT doc_id, round(score, 6) AS score FROM {bm25_sql('documents', 'doc_id', _TOK, '')} ORDER BY round(score, 9), doc_id LIMIT 20")
def bm25_zero(t):
    return bm25(t, True).orderBy(F.round("score", 9), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


_W = "list_concat({u}, list_concat({u}, list_concat({u}, {h})))".format(u="regexp_extract_all(lower(url), '[a-z0-9][a-z0-9_.:/+-]+')", h="regexp_extract_all(lower(html), '[a-z0-9][a-z0-9_.:/+-]+')")


@R.add("weighted_field_bm25", f"SELECT page_id, round(least(score / {len(TERMS)}, 1.0), 6) AS score FROM {bm25_sql('pages', 'page_id', _W)} ORDER BY 2 DESC, page_id LIMIT 20")
def weighted_field_bm25(t):
    scored = retrieval.bm25(t("pages"), TERMS, "page_id", retrieval.weighted_tokens((F.col("url"), 3), (F.col("html"), 1)))
    return retrieval.top(scored.select("page_id", F.round(F.least(F.col("score") / len(TERMS), F.lit(1.0)), 6).alias("score")), 20, "page_id")


VECTOR = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_VEC = f"list_dot_product(embedding::DOUBLE[], {VECTOR!r}::DOUBLE[])"


@R.add("vector_topk_dot", f"SELECT vec_id, round({_VEC}, 5) AS score FROM embeddings ORDER BY 2 DESC, vec_id LIMIT 20")
def vector_topk_dot(t):
    s = retrieval.vector_scores(t("embeddings"), "embedding", VECTOR, "vec_id")
    return retrieval.top(s.withColumn("score", F.round("score", 5)), 20, "vec_id")


@R.add("vector_topk_cosine", f"""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {VECTOR!r}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY 2 DESC, vec_id LIMIT 20""")
def vector_topk_cosine(t):
    s = retrieval.vector_scores(t("embeddings"), "embedding", VECTOR, "vec_id", cosine=True)
    return retrieval.top(s.withColumn("score", F.round("score", 6)), 20, "vec_id")


def two_lists(t):
    """The 50 best documents by BM25 and the 50 best vectors, with ids in common."""
    a = retrieval.top(bm25(t).withColumn("score", F.round("score", 6)), 50, "doc_id").select("doc_id", "score", F.lit("text").alias("list"))
    v = retrieval.vector_scores(t("embeddings"), "embedding", VECTOR, "vec_id").select(F.col("vec_id").alias("doc_id"), F.round("score", 5).alias("score"))
    return a.unionByName(retrieval.top(v, 50, "doc_id").withColumn("list", F.lit("vector")))


_LISTS = f"""(SELECT doc_id, score, 'text' AS list FROM (SELECT doc_id, round(score, 6) AS score FROM {_BM} ORDER BY 2 DESC, 1 LIMIT 50)
UNION ALL SELECT doc_id, score, 'vector' FROM (SELECT vec_id AS doc_id, round({_VEC}, 5) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 50))"""
_PLACED = f"(SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, doc_id) AS place FROM {_LISTS})"


@R.add("rrf_fusion", f"SELECT doc_id, round(sum(1.0 / (60 + place)), 9) AS score, count(*) AS n_lists FROM {_PLACED} GROUP BY 1")
def rrf_fusion(t):
    return retrieval.rrf(two_lists(t), "doc_id").withColumn("score", F.round("score", 9))


@R.add("weighted_rrf", f"SELECT doc_id, round(sum(CASE WHEN list = 'vector' THEN 0.28 ELSE 1.0 END / (60 + place)), 9) AS score, count(*) AS n_lists FROM {_PLACED} GROUP BY 1")
def weighted_rrf(t):
    return retrieval.rrf(two_lists(t), "doc_id", {"vector": 0.28}).withColumn("score", F.round("score", 9))


@R.add("text_keyed_rrf", f"""SELECT arg_max(doc_id, (score, -doc_id)) AS doc_id, max(score) AS score, round(sum(1.0 / (60 + place - 1)), 9) AS fused
FROM {_PLACED} GROUP BY doc_id // 3""")
def text_keyed_rrf(t):
    keyed = two_lists(t).withColumn("text_key", F.floor(F.col("doc_id") / 3))
    return retrieval.text_keyed_rrf(keyed, "text_key", "doc_id").withColumn("fused", F.round("fused", 9))


@R.add("source_local_rank_fusion", f"""SELECT doc_id, score, list, place, round(1.0 / (60 + place), 9) AS fused FROM {_PLACED}
ORDER BY 1.0 / (60 + place) DESC, place, CASE list WHEN 'text' THEN 0 ELSE 1 END, score DESC, doc_id LIMIT 20""")
def source_local(t):
    return retrieval.local_rank_fusion(two_lists(t), "list", "doc_id", {"text": 0, "vector": 1}).withColumn("fused", F.round("fused", 9))


@R.add("hybrid_weighted", f"""WITH l AS (SELECT doc_id, list, score / max(score) OVER (PARTITION BY list) AS s FROM {_LISTS})
SELECT doc_id, round(0.45 * coalesce(max(s) FILTER (list = 'text'), 0) + 0.55 * coalesce(max(s) FILTER (list = 'vector'), 0), 6) AS score FROM l GROUP BY 1""")
def hybrid_weighted(t):
    from pyspark.sql import Window

    best = F.max("score").over(Window.partitionBy("list"))  # lists of candidates, 50 rows each
    parts = two_lists(t).withColumn("s", F.col("score") / best).groupBy("doc_id").pivot("list", ["text", "vector"]).agg(F.max("s"))
    return parts.select("doc_id", F.round(0.45 * F.coalesce("text", F.lit(0.0)) + 0.55 * F.coalesce("vector", F.lit(0.0)), 6).alias("score"))


_TK = """CASE WHEN {v} = '' THEN 0.0 ELSE greatest(CASE WHEN contains({v}, 'red bolt economy') THEN 1.0 ELSE 0.0 END, CASE WHEN length({v}) >= 2 AND contains('red bolt economy', {v}) THEN 0.85 ELSE 0.0 END,
len(list_intersect(['red', 'bolt', 'economy'], string_split({v}, ' '))) / 3.0) END"""


@R.add("table_keyword_score", f"""WITH s AS (SELECT p_partkey, {_TK.format(v='lower(p_name)')}::DOUBLE AS a, {_TK.format(v='lower(p_type)')}::DOUBLE AS b FROM part),
m AS (SELECT *, (a > 0)::INT + (b > 0)::INT AS n FROM s WHERE a > 0 OR b > 0)
SELECT p_partkey, round(least(1.0, 0.7 * greatest(a, b) + 0.3 * (a + b) / n), 6) AS score, array_to_string(list_filter([CASE WHEN a > 0 THEN 'p_name' END, CASE WHEN b > 0 THEN 'p_type' END], lambda x: x IS NOT NULL), ',') AS matched FROM m""")
def table_keyword_score(t):
    return retrieval.table_keyword_scores(t("part"), "red bolt economy", ["p_name", "p_type"], "p_partkey").withColumn("score", F.round("score", 6))


@R.add("structured_row_score", """
SELECT p_partkey, score FROM (SELECT p_partkey, CASE WHEN p_size > 45 THEN 0.0 ELSE round((CASE WHEN lower(p_brand) = 'brand#3' THEN 4.0 ELSE 0.0 END) + (CASE WHEN contains(lower(p_name), 'red') THEN 1.5 ELSE 0.0 END)
+ (CASE WHEN contains(lower(p_name), 'bolt') THEN 1.5 ELSE 0.0 END) + (CASE WHEN lower(p_type) = 'economy' THEN 0.8 ELSE 0.0 END), 6) END AS score FROM part) WHERE score > 0""")
def structured_row_score(t):
    rule = lambda cond, w: F.when(cond, w).otherwise(0.0)
    name = F.lower("p_name")
    total = rule(F.lower("p_brand") == "brand#3", 4.0) + rule(name.contains("red"), 1.5) + rule(name.contains("bolt"), 1.5) + rule(F.lower("p_type") == "economy", 0.8)
    return t("part").select("p_partkey", F.when(F.col("p_size") > 45, 0.0).otherwise(F.round(total, 6)).alias("score")).filter("score > 0")


_PT = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_./+-]{1,80}'))"


@R.add("playbook_style_score", f"""WITH c AS (SELECT conv_id, turn, {_PT} AS tk, trim(regexp_replace(lower(text), '[^a-z0-9_./+-]+', ' ', 'g')) AS body FROM conversations WHERE role = 'user')
SELECT conv_id, turn, round(0.23 * len(list_filter(['the', 'thing', 'with', 'zzz'], lambda q: contains(body, q))) / 4.0 + 0.15 * len(list_intersect(tk, ['the', 'thing', 'with', 'zzz'])) / 4.0, 6) AS score
FROM c WHERE len(list_intersect(tk, ['the', 'thing', 'with', 'zzz'])) > 0 OR len(list_filter(['the', 'thing', 'with', 'zzz'], lambda q: contains(body, q))) > 0""")
def playbook_style_score(t):
    q = F.array(*map(F.lit, ("the", "thing", "with", "zzz")))
    c = t("conversations").filter("role = 'user'").select("conv_id", "turn", playbook_tokens(F.col("text")).alias("tk"), playbook_query(F.col("text")).alias("body"))
    keyword, token = F.size(F.filter(q, lambda x: F.contains(F.col("body"), x))), F.size(F.array_intersect("tk", q))
    return c.filter((token > 0) | (keyword > 0)).select("conv_id", "turn", F.round(0.23 * keyword / 4.0 + 0.15 * token / 4.0, 6).alias("score"))


_PT = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9_./+-]{{1,80}}|[一-鿿]{{2,}}'))"
_PN = "trim(regexp_replace(lower({x}), '[^a-z0-9一-鿿_./+-]+', ' ', 'g'))"


def playbook_items(t):
    """Turns as items: what a user says is feedback on a question, an assistant's turn binds fields, a system's one routes."""
    c = t("conversations")
    word = lambda n: F.coalesce(F.get(F.split(F.coalesce("text", F.lit("")), " "), n), F.lit(""))
    user = F.col("role") == "user"
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"),
        F.when(user, "online_feedback").when(F.col("role") == "assistant", "field_binding").otherwise("source_routing").alias("section"), F.coalesce("text", F.lit("")).alias("content"),
        F.when(F.length("text") % 9 == 0, "inactive").otherwise("active").alias("status"), F.array(F.col("role"), word(0)).alias("tags"), F.array(F.when(user, "table").otherwise("document")).alias("source_hints"),
        F.when(F.col("role") == "assistant", F.array(F.lit("field_lookup"), F.lit("x"))).otherwise(F.array(F.lit("aggregate"))).alias("query_intents"), F.array(word(1), word(2)).alias("expansion_terms"),
        (F.lit(0.5) + F.coalesce(F.length("text"), F.lit(0)) % 5 / 10.0).alias("confidence"), F.col("turn").cast("double").alias("updated_at"),
        F.when(user, F.when(F.contains("text", F.lit("the")), F.lit(QUERY)).otherwise(F.col("text"))).alias("source_query"), F.when(F.col("turn") % 4 == 0, "correction").otherwise("comment").alias("feedback_type"),
    )


_PW = lambda n: f"coalesce(string_split(coalesce(text, ''), ' ')[{n}], '')"
_PITEMS = f"""it AS (SELECT conv_id || '-' || turn AS item_id, CASE role WHEN 'user' THEN 'online_feedback' WHEN 'assistant' THEN 'field_binding' ELSE 'source_routing' END AS section, coalesce(text, '') AS content, role || ' ' || {_PW(1)} AS tags,
CASE role WHEN 'assistant' THEN 'field_lookup x' ELSE 'aggregate' END AS intents, {_PW(2)} || ' ' || {_PW(3)} AS exps, [lower(role), lower({_PW(1)}), lower({_PW(2)}), lower({_PW(3)}), CASE role WHEN 'assistant' THEN 'field_lookup' ELSE 'aggregate' END, CASE role WHEN 'assistant' THEN 'x' END] AS exact,
0.5::DOUBLE + coalesce(length(text), 0) % 5 / 10.0::DOUBLE AS confidence, turn::DOUBLE AS updated_at, CASE WHEN role = 'user' THEN CASE WHEN contains(text, 'the') THEN '{QUERY}' ELSE text END END AS sq, CASE WHEN turn % 4 = 0 THEN 0.08::DOUBLE ELSE 0 END AS fix FROM conversations WHERE coalesce(length(text) % 9, 1) <> 0)"""


def playbook_sql(limit: int) -> str:
    tok, norm, q = lambda x: _PT.format(x=x), lambda x: _PN.format(x=x), [x for x in dict.fromkeys(QUERY.split())]
    times = lambda x, n: ", ".join([tok(x)] * n)
    return f"""WITH {_PITEMS}, w AS (SELECT *, flatten([{tok('section')}, {tok('content')}, {times('tags', 3)}, {times('intents', 3)}, {times('exps', 4)}, {times("coalesce(sq, '')", 3)}]) AS tk, {norm("concat_ws(' ', section, content, tags, exps, sq)")} AS body, {norm("coalesce(sq, '')")} AS nsq FROM it),
s AS (SELECT count(*) AS n, greatest(sum(len(tk)) / count(*), 1.0)::DOUBLE AS mean FROM w), q AS (SELECT unnest({q!r}) AS t), f AS (SELECT item_id, t, len(list_filter(tk, lambda x: x = t)) AS tf, len(tk) AS dl, CASE WHEN list_contains(exact, t) THEN 1.4::DOUBLE WHEN contains(body, t) THEN 1.0 ELSE 0 END AS kw FROM w, q),
d AS (SELECT t, count(*) FILTER (tf > 0) AS df FROM f GROUP BY 1), g AS (SELECT item_id, least(sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))) ELSE 0.0 END) / {len(q)}, 1.0) AS bm25, least(sum(kw) / {len(q)}, 1.0) AS keyword, count(*) FILTER (tf > 0) / {len(q)}.0::DOUBLE AS token FROM f JOIN d USING (t), s GROUP BY 1),
r AS (SELECT w.*, bm25, keyword, token, CASE WHEN section = 'field_binding' THEN 0.5::DOUBLE ELSE 0 END AS intent, CASE section WHEN 'source_routing' THEN 0.15::DOUBLE WHEN 'field_binding' THEN 0.12::DOUBLE ELSE 0 END AS sb, CASE WHEN section = 'online_feedback' THEN fix + CASE WHEN nsq = '{QUERY}' THEN 0.9::DOUBLE ELSE 0 END ELSE 0 END AS fb
FROM w JOIN g USING (item_id) WHERE section <> 'online_feedback' OR nsq IN ('', '{QUERY}'))
SELECT item_id, round(0.42 * bm25 + 0.23 * keyword + 0.15 * token + 0.3 * intent + sb + fb + 0.15 * confidence, 6) AS score, round(bm25, 6) AS bm25, round(keyword, 6) AS keyword, round(token, 6) AS token, intent, sb AS section_bonus, fb AS feedback_bonus FROM r
WHERE token > 0 OR intent > 0 OR sb > 0 OR fb > 0 OR keyword > 0 ORDER BY 2 DESC, confidence DESC, updated_at DESC, item_id LIMIT {limit}"""


@R.add("playbook_search", playbook_sql(40))
def playbook_search(t):
    hits = playbook.search(playbook_items(t), QUERY, 40, ["deployment", "field_lookup"])
    return hits.select("item_id", "score", *[F.round(c, 6).alias(c) for c in ("bm25", "keyword", "token")], "intent", "section_bonus", "feedback_bonus")


@R.add("playbook_upkeep", f"""WITH {_PITEMS.replace("WHERE coalesce(length(text) % 9, 1) <> 0", "")}, a AS (SELECT item_id, section, content, coalesce(length(nullif(content, '')) % 9, 1) <> 0 AS active, confidence FROM it),
n AS (SELECT * FROM a WHERE section = 'field_binding' AND length(content) % 2 = 0)
SELECT section, count(*) AS items, count(*) FILTER (active) AS active, round(sum(confidence), 6) AS confidence FROM (SELECT item_id, section, active AND NOT (section = 'source_routing' OR length(content) % 5 = 0) AS active, confidence FROM a WHERE item_id NOT IN (SELECT item_id FROM n) UNION ALL SELECT item_id, section, true, 0.25::DOUBLE FROM n) GROUP BY 1""")
def playbook_upkeep(t):
    """Some items come in again under their ids with another confidence while others retire, in one snapshot."""
    items = playbook_items(t)
    table = playbook.PlaybookTable(items.sparkSession, shared_dir(items.sparkSession))
    table.upsert(items)
    again = items.filter((F.col("section") == "field_binding") & (F.length("content") % 2 == 0)).withColumns({"status": F.lit("active"), "confidence": F.lit(0.25)})
    table.apply(again, items.filter((F.col("section") == "source_routing") | (F.length("content") % 5 == 0)))
    return table.items().groupBy("section").agg(F.count("*").alias("items"), F.count_if(F.col("status") == "active").alias("active"), F.round(F.sum("confidence"), 6).alias("confidence"))


_SQ = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_KINDS = [("model", r"([A-Za-z0-9][A-Za-z0-9_./+-]{3,}\.(?:model|onnx|pt|pth|safetensors))"), ("version", r"\b([vV]?\d+(?:\.\d+){1,3}(?:[-_][A-Za-z0-9]+)?)\b"), ("oid", r"\b([a-fA-F0-9]{32,64})\b"), ("email", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")]
_MENTIONS = "(SELECT DISTINCT doc_id, kind, name FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, lower(unnest(regexp_extract_all({_SQ}, '{p}', 1))) AS name FROM documents" for k, p in _KINDS) + "))"


def found(t, ids=None):
    docs = t("documents") if ids is None else t("documents").join(ids, "doc_id", "left_semi")
    patterns = [p for p in graph.PATTERNS if p[0] in ("model", "version", "oid")] + graph.EXTRA[:1]
    return graph.mentions(docs, "doc_id", "text", patterns, None)


@R.add("entity_mentions", f"SELECT doc_id, kind, name FROM {_MENTIONS}")
def entity_mentions(t):
    return found(t)


_PAIRS = f"(WITH m AS (SELECT doc_id, kind || ':' || name AS n FROM {_MENTIONS}) SELECT x.n AS a, y.n AS b, count(*) AS evidence FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.n < y.n GROUP BY 1, 2)"


@R.add("entity_cooccurrence", f"SELECT * FROM {_PAIRS}")
def entity_cooccurrence(t):
    return graph.cooccurrences(found(t), "doc_id")


@R.add("entity_graph_topk", f"SELECT node, sum(evidence)::BIGINT AS evidence, count(*) AS degree FROM (SELECT a AS node, evidence FROM {_PAIRS} UNION ALL SELECT b, evidence FROM {_PAIRS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def entity_graph_topk(t):
    return graph.top_nodes(graph.cooccurrences(found(t), "doc_id"), 20)


@R.add("entity_overlap", f"SELECT doc_id, round(count(DISTINCT name) / 3.0, 6) AS score FROM {_MENTIONS} WHERE name IN ('34@mail7.example.com', '55@mail4.example.com', '90@mail2.example.com') GROUP BY 1")
def entity_overlap(t):
    scores = graph.overlap_scores(found(t), "doc_id", ["34@mail7.example.com", "55@mail4.example.com", "90@mail2.example.com"])
    return scores.withColumn("score", F.round("score", 6))


@R.add("entity_kind_counts", f"SELECT kind, count(*) AS mentions, count(DISTINCT name) AS entities, count(DISTINCT doc_id) AS texts FROM {_MENTIONS} GROUP BY 1")
def entity_kind_counts(t):
    return graph.kind_counts(found(t), "doc_id")


_LINKED = "(SELECT l_orderkey AS doc_id, 'flag' AS kind, l_returnflag AS name FROM lineitem UNION SELECT l_orderkey, 'part', 'p' || (l_partkey % 50) FROM lineitem UNION SELECT l_orderkey, 'supplier', 's' || (l_suppkey % 30) FROM lineitem)"
_LINKS = f"(SELECT a.kind AS ak, a.name AS an, b.kind AS bk, b.name AS bn, count(*) AS evidence FROM {_LINKED} a JOIN {_LINKED} b ON a.doc_id = b.doc_id AND a.kind || ':' || a.name < b.kind || ':' || b.name GROUP BY 1, 2, 3, 4)"
_TEXTS = f"(SELECT kind, name, count(*) AS texts FROM {_LINKED} GROUP BY 1, 2)"


def linked(t):
    """Orders as texts; flags, parts and suppliers of their lines as entities."""
    numbered = lambda letter, c, n: F.concat(F.lit(letter), (F.col(c) % n).cast("string"))
    e = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in (("flag", F.col("l_returnflag")), ("part", numbered("p", "l_partkey", 50)), ("supplier", numbered("s", "l_suppkey", 30)))])
    return t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.explode(e).alias("e")).select("doc_id", "e.kind", "e.name").distinct()


@R.add("candidate_edges", f"""
SELECT ak AS a_kind, an AS a_name, x.texts AS a_texts, bk AS b_kind, bn AS b_name, y.texts AS b_texts, evidence FROM {_LINKS} JOIN {_TEXTS} x ON x.kind = ak AND x.name = an JOIN {_TEXTS} y ON y.kind = bk AND y.name = bn
WHERE evidence >= 2 AND ak <> 'flag' AND bk <> 'flag' AND (contains(an, 'p1') OR contains(bn, 'p1') OR contains(an, 's2') OR contains(bn, 's2')) ORDER BY evidence DESC, x.texts + y.texts DESC, an, bn, ak, bk LIMIT 200""")
def candidate_edges(t):
    m = linked(t)
    return graph.candidate_edges(graph.cooccurrences(m, "doc_id"), m, "doc_id", without=["flag"], terms=["P1", "s2"], least=2, limit=200)


@R.add("found_nodes", f"SELECT row_number() OVER (ORDER BY texts DESC, name, kind)::INT AS rank, kind, name, texts FROM {_TEXTS} WHERE kind IN ('part', 'supplier') AND (contains(name, '7') OR contains(kind, 'upp')) ORDER BY 1 LIMIT 25")
def found_nodes(t):
    return graph.found_nodes(linked(t), "doc_id", ["7", "UPP"], kinds=["part", "supplier"], limit=25)


@R.add("graph_counts", f"""
SELECT 'texts' AS what, o_orderstatus AS value, count(*) AS n, NULL::BIGINT AS evidence FROM orders GROUP BY 2 UNION ALL SELECT 'entities', kind, count(*), NULL FROM {_TEXTS} GROUP BY 2 UNION ALL SELECT 'mentions', kind, sum(texts)::BIGINT, NULL FROM {_TEXTS} GROUP BY 2
UNION ALL SELECT 'edges', ak || '-' || bk, count(*), sum(evidence)::BIGINT FROM {_LINKS} GROUP BY 2""")
def graph_counts(t):
    m = linked(t)
    return graph.graph_counts(t("orders"), "o_orderstatus", m, graph.cooccurrences(m, "doc_id"))


@R.add("text_chunks")
def text_chunks(t):
    return chunking.chunks(t("documents"), "doc_id", "text")


@R.add("chunk_stats")
def chunk_stats(t):
    c = chunking.chunks(t("documents"), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("text")).alias("longest"))


_LINES = "(SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


def lines(t):
    return sessions.lines_of(t("documents"), "doc_id", "text")


@R.add("heading_ffill", f"SELECT doc_id, line_no::INT AS line_no, last_value(CASE WHEN length(line) < 20 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading FROM {_LINES}")
def heading_ffill(t):
    return sessions.fill_forward(lines(t), "doc_id", "line_no", F.when(F.length("line") < 20, F.col("line")), "heading").select("doc_id", "line_no", "heading")


@R.add("island_merge", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS o FROM {_LINES}), m AS (SELECT *, o - row_number() OVER (PARTITION BY doc_id ORDER BY o) AS run FROM l WHERE length(line) < 60)
SELECT doc_id, min(line_no)::INT AS first, max(line_no)::INT AS last, count(*) AS n FROM m GROUP BY doc_id, run""")
def island_merge(t):
    return sessions.islands(lines(t), "doc_id", "line_no", F.length("line") < 60)


@R.add("group_text", f"""WITH g AS (SELECT *, sum((length(line) < 20)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS grp FROM {_LINES})
SELECT doc_id, grp::BIGINT AS "group", count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text FROM g GROUP BY doc_id, grp""")
def group_text(t):
    return sessions.titled_groups(lines(t), "doc_id", "line_no", F.length("line") < 20, "line").withColumn("text", F.md5("text"))
