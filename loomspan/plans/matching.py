"""Hybrid fusion, parents, lookups, nearest texts, organised items, budgets; comparison over arms and seeds; data set rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.functions import aspects as A
from loomspan.functions.text import selection_key, squash_query, text_tokens
from loomspan.operators import graph, matching, resampling, retrieval
from loomspan.plans import evidence, search
from loomspan.plans.base import Registry
from loomspan.sources.snapshots import stored

R = Registry()


@R.add("hashing_embedding_topk")
def hashing_embedding_topk(t):
    query = matching.hashed_vectors(t("documents").sparkSession.createDataFrame([(0, search.QUERY)], "doc_id long, text string"), "doc_id", text_tokens(F.col("text"))).first().embedding
    v = matching.hashed_vectors(t("documents"), "doc_id", text_tokens(F.col("text")))
    return retrieval.top(retrieval.vector_scores(v, "embedding", query, "doc_id").withColumn("score", F.round("score", 6)), 20, "doc_id")


_GRAPH = f"(SELECT doc_id, count(DISTINCT name) / 1.0 AS score FROM {search._MENTIONS} WHERE kind IN ('email', 'version') GROUP BY 1)"


_REL_SCORE = evidence._sum([
    (evidence._has("release_change"), 0.7), (f"NOT {evidence._has('release_change')} AND {evidence._has('accuracy_metric')}", 0.35), (f"NOT {evidence._has('release_change')} AND NOT {evidence._has('accuracy_metric')}", -0.12),
    (evidence._SHOWS["release_change"], 0.35), (evidence._SHOWS["accuracy_metric"], 0.12), (f"s IN ('table', 'deployment') AND NOT {evidence._has('release_change')}", -0.2),
])
_NAMED = "least(2.0, CASE WHEN contains(l, 'onanding') OR contains(f, 'onanding') THEN 0.75 ELSE 0 END + CASE WHEN contains(l, 'with') OR contains(f, 'with') THEN 0.45 ELSE 0 END)::DOUBLE"
_ROWS_HIT = "contains(l, 'onanding')::INT + contains(l, 'with')::INT + contains(l, 'release')::INT"
_BOOST = f"""(SELECT i AS doc_id, CASE WHEN en <= 0 THEN sc * 0.02 - 0.65 ELSE sc * 0.38 + least(en, 1.0) * 0.18 END + CASE WHEN s IN ('table', 'deployment') THEN least(0.18, 0.035 * ({_ROWS_HIT})) ELSE 0 END AS boost
FROM (SELECT *, greatest(-1.0, least(1.8, {_REL_SCORE})) AS sc, {_NAMED} AS en FROM (SELECT *, lower(t) AS l FROM {evidence._ASPECTS})))"""


@R.add("hybrid_retrieve", f"""
WITH l AS (SELECT doc_id, CASE list WHEN 'text' THEN 1.0 ELSE 1.0 END / (60 + place) AS s FROM {search._PLACED}),
st AS (SELECT doc_id, 0.45 / (20 + row_number() OVER (ORDER BY n_chars DESC, doc_id)) AS s FROM (SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 50)),
gp AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM {_GRAPH} WHERE doc_id IN (SELECT doc_id FROM l)),
u AS (SELECT * FROM l UNION ALL SELECT * FROM st UNION ALL SELECT doc_id, 0.28 / (60 + place) FROM gp),
f AS (SELECT doc_id, sum(s) AS score, count(*) AS n_lists FROM u GROUP BY 1),
z AS (SELECT f.doc_id, f.score + 0.28 * coalesce(g.score, 0) + coalesce(b.boost, 0) AS score, n_lists, coalesce(g.score, 0)::DOUBLE AS graph FROM f LEFT JOIN {_GRAPH} g ON g.doc_id = f.doc_id AND f.doc_id IN (SELECT doc_id FROM l) LEFT JOIN {_BOOST} b ON b.doc_id = f.doc_id)
SELECT doc_id, round(score, 9)::DOUBLE AS score, n_lists, graph FROM z WHERE score >= 0.005 ORDER BY round(score, 9) DESC, doc_id LIMIT 20""")
def hybrid_retrieve(t):
    """Lists of words, vectors, rows and the graph; what is found is boosted by how well its text answers the aspect that the question is about,
    by the entities it names, and as a row by the words of the question in its fields."""
    lists = stored(search.two_lists(t))  # a hundred rows
    d = t("documents")
    rows = retrieval.top(d.filter("lang = 'en'").select("doc_id", F.col("n_chars").cast("double").alias("score")), 50, "doc_id").withColumn("list", F.lit("structured"))
    mentions = search.found(t, F.broadcast(lists.select("doc_id").distinct())).filter(F.col("kind").isin("email", "version"))
    g = mentions.groupBy("doc_id").agg(F.countDistinct("name").cast("double").alias("score"))
    every = stored(lists.unionByName(rows).unionByName(g.withColumn("list", F.lit("graph"))))  # candidates of every list
    chunks = evidence.chunk_rows(t, F.broadcast(every.select("doc_id").distinct()))
    terms, body, aspect = ["onanding", "with"], F.col("t"), "release_change"
    answer = A.answerability(aspect, body, F.col("s"), F.col("a"), F.col("sec"))
    boost = A.lexical_boost(search.QUERY, body, F.col("s")) + A.aspect_boost(aspect, F.col("answer"), terms, body) + A.structured_boost(search.QUERY, [*terms, "release"], body, F.lit(None).cast("string"), F.col("s"))
    boosts = chunks.withColumn("answer", F.explode(F.array(answer))).select(F.col("i").alias("doc_id"), boost.alias("score"))
    out = matching.hybrid(every, "doc_id", {"graph": 0.28, "structured": 0.45}, {"structured": 20}, g, 0.28, boosts, 0.005)
    return out.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id")


@R.add("hits_to_parents", """
SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber))::INT AS child, max(l_extendedprice) AS score, count(*) AS n_hits FROM lineitem GROUP BY 1""")
def hits_to_parents(t):
    hits = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("score"), F.count("*").alias("c"))
    out = matching.to_parents(hits, "l_orderkey", "l_linenumber")
    n = hits.groupBy("l_orderkey").agg(F.sum("c").alias("n_hits"))
    return out.drop("n_hits").join(n, "l_orderkey").select("l_orderkey", "child", "score", "n_hits")


@R.add("unseen_hits", """
WITH s AS (SELECT doc_id, text FROM documents WHERE lang = 'fr') SELECT min(doc_id) AS doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s) AND text NOT IN (SELECT text FROM s) GROUP BY text, lang QUALIFY row_number() OVER (PARTITION BY text ORDER BY min(doc_id)) = 1""")
def unseen_hits(t):
    d = t("documents").select("doc_id", "lang", "text")
    return matching.unseen(d, d.filter("lang = 'fr'"), "doc_id", F.col("text")).select("doc_id", "lang")


@R.add("keep_preferred", """
SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value > 100) DESC, event_id) AS r FROM events) WHERE r = 1""")
def keep_preferred(t):
    e = t("events").select("event_id", "user_id", "event_type", "value")
    return matching.keep_preferred(e, [F.concat_ws("-", F.col("user_id").cast("string"), F.col("event_type"))], F.col("value") > 100, "event_id").select("event_id", "user_id", "event_type")


@R.add("two_key_lookup", """
WITH a AS (SELECT o_orderkey AS k, arg_max(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o.o_orderkey, CASE WHEN a.k IS NOT NULL THEN a.v ELSE b.v END AS fact, CASE WHEN a.k IS NOT NULL THEN 'first' WHEN b.k IS NOT NULL THEN 'second' ELSE 'none' END AS found_by FROM orders o LEFT JOIN a ON a.k = o.o_orderkey LEFT JOIN b ON b.k = o.o_custkey""")
def two_key_lookup(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    facts = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("f1"), F.col("o_custkey").alias("f2"), F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("fact"))
    return matching.lookup(o, facts, ("o_orderkey", "f1"), ("o_custkey", "f2"), "o", "fact").select("o_orderkey", "fact", "found_by")


def sharing_runs(t):
    """(item_id, item, text): each item with the documents that have four of its words in a row, at any place of both.

    Items under four words are looked for as a whole. Runs carry ids only; texts come last, for pairs that share one. An item
    without such a document has a null text.
    """
    b = t("benchmark").select("item_id", matching.without_breaks(F.col("text")).alias("item"), "text")
    docs = t("documents").select("doc_id", F.xxhash64("text").alias("th"), "text")
    bw = matching.word_runs(b.select("item_id", F.xxhash64("text").alias("ih"), "text"), "text", 4, "g").select("item_id", "ih", "g")
    d = matching.word_runs(docs, "text", 4, "g", [1, 2, 3, 4]).select("doc_id", "th", "g")
    pairs = d.join(bw, "g").select("item_id", "ih", "doc_id", "th").distinct()
    found = pairs.join(docs.withColumn("text", matching.without_breaks(F.col("text"))).dropDuplicates(["doc_id", "th"]), ["doc_id", "th"]).select(F.col("item_id").alias("id"), "ih", F.col("text").alias("found"))
    same = F.col("item_id").eqNullSafe(F.col("id")) & (F.xxhash64(b["text"]) == F.col("ih"))
    return b.join(found, same, "left").select("item_id", "item", F.col("found").alias("text"))


@R.add("chunk_recall")
def chunk_recall(t):
    return matching.chunk_recall(sharing_runs(t), "item_id", "item", "text")


@R.add("chunk_recall_subsequence")
def chunk_recall_subsequence(t):
    return matching.chunk_recall(sharing_runs(t), "item_id", "item", "text", method="subsequence")


@R.add("nearest_same_group")
def nearest_same_group(t):
    c = t("conversations").filter("role = 'user'").select((F.col("turn") % 2).alias("g"), (F.col("conv_id") * 1000 + F.col("turn")).alias("cand"), "text")
    q = t("benchmark").select((F.col("item_id") % 2).alias("g"), F.col("item_id"), F.col("text").alias("q"))
    return matching.nearest_texts(q, c, "g", "item_id", "q", "cand", "text").withColumn("ratio", F.round("ratio", 6))


@R.add("evidence_scores", """
WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM conversations), m AS (SELECT *, role = 'system' OR (length(role) >= 8 AND contains('the assistant', role)) AS h FROM r),
g AS (SELECT conv_id, count(*) AS k, count(*) FILTER (h) AS matches, min(p) FILTER (h) AS f FROM m GROUP BY 1)
SELECT conv_id, k, matches, round(matches / k, 6) AS "precision", (matches > 0)::INT::DOUBLE AS recall, round(coalesce(1.0 / f, 0), 6)::DOUBLE AS mrr FROM g""")
def evidence_scores(t):
    r = t("conversations").withColumn("p", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    out = matching.retrieval_scores(r, "conv_id", "p", F.array(F.lit("system"), F.lit("the assistant")), F.array("role"))
    return out.withColumns({"precision": F.round("precision", 6), "mrr": F.round("mrr", 6)})


@R.add("organised_items", """
WITH i AS (SELECT d.doc_id, source, lang, (quality + 0.5 * toxic)::DOUBLE AS c FROM documents d JOIN labels l USING (doc_id)), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, doc_id DESC) AS o FROM i),
v AS (SELECT source, lang, min(o) AS pl FROM o GROUP BY 1, 2), u AS (SELECT source, string_agg(lang, ',' ORDER BY pl) AS tags FROM v GROUP BY 1)
SELECT source AS group_key, 'org-' || substr(sha1(string_agg(doc_id::VARCHAR, '|' ORDER BY o)), 1, 16) AS candidate_id, count(*) AS n_items, round(avg(c), 6) AS confidence, any_value(tags) AS tags FROM o JOIN u USING (source) GROUP BY 1""")
def organised_items(t):
    i = t("documents").select("doc_id", "source", F.array("lang").alias("tags")).join(t("labels"), "doc_id")
    i = i.withColumn("c", F.col("quality") + 0.5 * F.col("toxic"))
    out = matching.organised(i, F.col("source"), "doc_id", "c", "doc_id", ["tags"])
    return out.withColumns({"confidence": F.round("confidence", 6), "tags": F.array_join("tags", ",")})


@R.add("budgeted_graph")
def budgeted_graph(t):
    return matching.budgeted_graph(graph.cooccurrences(search.found(t), "doc_id"), "a", "b", "evidence", 30, 40)


# Arms and seeds: the type of a lineitem's flag is the arm, the supplier the trial.
_TRIALS = "(SELECT l_returnflag AS arm, l_suppkey AS trial, round(avg(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1, 2)"


@R.add("ratio_bootstrap", f"""
WITH k AS (SELECT arm, row_number() OVER (PARTITION BY arm ORDER BY trial) - 1 AS no, v, count(*) OVER (PARTITION BY arm) AS m FROM {_TRIALS} WHERE arm IN ('A', 'N')), c AS (SELECT DISTINCT arm, m FROM k),
d AS (SELECT arm, r.range AS rep, ('0x' || substr(md5('11:' || arm || ':' || r.range || ':' || d.range), 1, 8))::BIGINT % m AS no FROM c, range(200) r, range(1000000) d WHERE d.range < m),
b AS (SELECT arm, rep, avg(v) AS mean FROM d JOIN k USING (arm, no) GROUP BY 1, 2), q AS (SELECT round(a.mean / n.mean, 9) AS x FROM b a JOIN b n ON a.rep = n.rep AND a.arm = 'A' AND n.arm = 'N')
SELECT round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, round((SELECT avg(v) FROM k WHERE arm = 'A') / (SELECT avg(v) FROM k WHERE arm = 'N'), 6) AS ratio FROM q""")
def ratio_bootstrap(t):
    k = t("lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_suppkey").alias("trial")).agg(F.round(F.avg("l_extendedprice"), 4).alias("v"))
    return resampling.ratio_interval(k, "arm", "trial", "v", "A", "N", 200)


@R.add("mean_over_seeds", """
WITH s AS (SELECT user_id, event_type, event_id % 3 AS seed, avg(value) AS v FROM events GROUP BY 1, 2, 3) SELECT user_id, event_type, round(avg(v), 6) AS score FROM s GROUP BY 1, 2 HAVING count(*) = 3""")
def mean_over_seeds(t):
    s = t("events").groupBy("user_id", "event_type", (F.col("event_id") % 3).alias("seed")).agg(F.avg("value").alias("v"))
    return resampling.mean_over_seeds(s, ["user_id", "event_type"], "seed", "v", 3).withColumn("score", F.round("score", 6))


@R.add("review_merge", """
WITH r AS (SELECT doc_id, CASE quality WHEN 1 THEN 'approve' ELSE 'reject' END AS s, toxic AS o FROM labels), l AS (SELECT doc_id, arg_max(s, o) AS s FROM r GROUP BY 1)
SELECT coalesce(s, 'missing') AS status, count(*) AS n FROM documents LEFT JOIN l USING (doc_id) GROUP BY 1""")
def review_merge(t):
    reviews = t("labels").select("doc_id", F.when(F.col("quality") == 1, "approve").otherwise("reject").alias("status"), F.col("toxic").alias("o"))
    return resampling.reviewed(t("documents").select("doc_id"), reviews, "doc_id", "status", "o", ["approve", "reject", "todo"]).groupBy("status").agg(F.count("*").alias("n"))


@R.add("merged_step_rows", """
SELECT md5(role || chr(10) || text) AS k, min(conv_id * 1000 + turn) AS first_id, array_to_string(list_sort(list(DISTINCT conv_id)), ',') AS sources, count(*) AS n FROM conversations GROUP BY 1""")
def merged_step_rows(t):
    rows = t("conversations").select(F.md5(F.concat_ws("\n", "role", "text")).alias("k"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id")
    return resampling.merged_rows(rows, "k", "id", "conv_id").withColumn("sources", F.array_join("sources", ","))


@R.add("replaced_rows", """
SELECT d.doc_id, coalesce(l.quality::VARCHAR, d.lang) AS value, l.doc_id IS NOT NULL AS replaced FROM documents d LEFT JOIN labels l USING (doc_id)""")
def replaced_rows(t):
    new = t("labels").select("doc_id", F.col("quality").cast("string").alias("value"))
    return resampling.replaced(t("documents").select("doc_id", F.col("lang").alias("value")), new, "doc_id", "value")


@R.add("capped_selection", """
WITH q AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY regexp_replace(lower(text), '\\s+', '', 'g') ORDER BY doc_id) AS k FROM documents), u AS (SELECT * FROM q WHERE k = 1)
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM u) WHERE lang IN ('en', 'fr') OR (lang = 'de' AND r <= 20)""")
def capped_selection(t):
    return resampling.focused(t("documents"), squash_query(F.col("text")), "doc_id", "lang", ["en", "fr"], {"de": 20}).select("doc_id", "lang")


@R.add("telemetry_summary", """
WITH g AS (SELECT l_suppkey AS unit, avg(l_quantity) AS mean, max(l_quantity) AS peak, bool_and(l_quantity IS NOT NULL) AS full FROM lineitem GROUP BY 1)
SELECT count(*) AS units, round(sum(mean), 4) AS total_mean, max(peak) AS peak, round(sum(mean) * 7200 / 3600, 4) AS energy FROM g""")
def telemetry_summary(t):
    out = resampling.telemetry(t("lineitem"), "l_suppkey", "l_quantity", 7200)
    return out.select("units", F.round("total_mean", 4).alias("total_mean"), "peak", F.round("energy", 4).alias("energy"))


@R.add("benchmark_items", """
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('5' || chr(10) || doc_id)) AS r FROM documents)
SELECT doc_id, source, ((r - 1) % 4)::INT AS template FROM r WHERE r <= 8""")
def benchmark_items(t):
    return resampling.templated(t("documents").select("doc_id", "source"), "source", selection_key(5, F.col("doc_id")), 8, 4)
