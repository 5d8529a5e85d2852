"""A playbook of rules for answering: search with six weighted terms, expansion terms, items from feedback, and upkeep by whole snapshots."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.rules import QUERY_INTENTS, all_rules
from loomspan.functions.text import PLAYBOOK_TOKEN, lexical_tokens, playbook_query, playbook_tokens
from loomspan.sources.snapshots import Snapshots, stored

#: Columns of an item, weights of the score's terms, bonuses of sections and phrases of feedback items; and the kinds of sources.
ITEM = "item_id string, section string, content string, status string, tags array<string>, source_hints array<string>, query_intents array<string>, expansion_terms array<string>, confidence double, updated_at double, source_query string, feedback_type string"
WEIGHTS = {"bm25": 0.42, "keyword": 0.23, "token": 0.15, "intent": 0.3, "confidence": 0.15}
SECTION_BONUS = [("deployment", ("source_routing",), 0.15), ("field_lookup", ("field_binding", "answer_strategy"), 0.12), ("aggregate", ("aggregate_semantics",), 0.16)]
EXACT_FEEDBACK, CORRECTION = 0.9, 0.08
REPEATS = {"tags": 2, "expansion_terms": 3, "query_intents": 2}
SOURCES = ("document", "table", "deployment")
ASKED, ANSWERED, CHECKED, NOTED = "用户针对问题“", "”提交了在线反馈，后续遇到相同或高度相似的问题应优先纠正。", "优先核对证据：", "备注："
CORRECTED = "修正答案："


def query_tokens(query: str) -> list[str]:
    """Tokens of a query, each once, with the runs of two and three characters of longer CJK ones."""
    out: dict[str, None] = {}
    for t in dict.fromkeys(re.findall(PLAYBOOK_TOKEN, query.lower())):
        out[t] = None
        if re.fullmatch(r"[一-鿿]{3,}", t):
            out |= dict.fromkeys(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1))
    return list(out)


def _words(name: str) -> Column:
    return F.array_join(F.coalesce(name, F.array().cast("array<string>")), " ")


def search_tokens() -> Column:
    """An item's tokens: of its section, content and lists once each, and again for lists and the query it came from, by their weights."""
    once = [lexical_tokens(c) for c in (F.col("section"), F.col("content"), *map(_words, ("tags", "query_intents", "expansion_terms")))]
    again = [lexical_tokens(_words(c)) for c, n in REPEATS.items() for _ in range(n)] + [lexical_tokens(F.col("source_query"))] * 3
    return F.flatten(F.array(*once, *again))


def scored_items(items: DataFrame, query: str, intents: Sequence[str] = (), k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Active items with the parts of their score for a query: bm25, keyword, token, intent, section_bonus, feedback_bonus, exact_query_match, score.

    An item of online feedback counts for the query it came from only. Items without any sign of the query are left out. Tokens
    are made in one pass that writes a few numbers an item; statistics are one aggregate of these.
    """
    tokens, asked = query_tokens(query), playbook_norm(query)
    n = max(len(tokens), 1)
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    body = playbook_query(F.concat_ws(" ", "section", "content", _words("tags"), _words("expansion_terms"), "source_query"))
    exact = F.concat(low("expansion_terms"), low("tags"), low("query_intents"))
    made = F.struct(search_tokens().alias("tokens"), body.alias("body"), exact.alias("exact"))
    rows = items.filter("status = 'active'").select("*", F.explode(F.array(made)).alias("__m"))

    def times(token: str) -> Column:
        return F.size(F.filter("__m.tokens", lambda x: x == token))

    tf = F.array(*map(times, tokens)).cast("array<int>")
    keyword = sum([F.when(F.array_contains("__m.exact", F.lit(t)), 1.4).when(F.contains("__m.body", F.lit(t)), 1.0).otherwise(0.0) for t in tokens], F.lit(0.0))
    rows = stored(rows.select(*items.columns, F.size("__m.tokens").alias("__n"), tf.alias("__tf"), F.least(keyword / n, F.lit(1.0)).alias("keyword")))
    df = F.array(*[F.sum((F.col("__tf")[i] > 0).cast("long")) for i in range(len(tokens))]).cast("array<bigint>")
    stats = rows.agg(F.count("*").alias("n"), F.sum("__n").alias("length"), df.alias("df")).first()
    mean = max((stats["length"] or 0) / max(stats["n"], 1), 1.0)
    bm25 = F.lit(0.0)
    for i, found in enumerate(stats["df"] if stats["n"] else []):
        f = F.col("__tf")[i]
        idf = F.log(F.lit(1 + (stats["n"] - found + 0.5) / (found + 0.5)))
        bm25 = bm25 + F.when(f > 0, idf * (f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("__n") / mean)))).otherwise(0.0)
    source, feedback = playbook_query(F.col("source_query")), F.col("section") == "online_feedback"
    same = feedback & (source == asked) if asked else F.lit(False)
    shared = F.size(F.array_intersect(F.coalesce("query_intents", F.array().cast("array<string>")), F.array(*map(F.lit, intents)).cast("array<string>")))
    bonus = sum([F.when(F.col("section").isin(*names), w).otherwise(0.0) for intent, names, w in SECTION_BONUS if intent in intents], F.lit(0.0))
    told = F.when(same, EXACT_FEEDBACK).otherwise(0.0) + F.when(feedback & (F.col("feedback_type") == "correction"), CORRECTION).otherwise(0.0)
    parts = {
        "bm25": F.least(bm25 / n, F.lit(1.0)), "token": F.least(F.size(F.filter("__tf", lambda x: x > 0)) / n, F.lit(1.0)),
        "intent": F.least(shared / max(len(intents), 1), F.lit(1.0)), "section_bonus": bonus, "feedback_bonus": told, "exact_query_match": same.cast("int").cast("double"),
    }
    rows = rows.filter(~feedback | (source == "") | (source == asked)).withColumns(parts)
    sign = reduce_any([F.col(c) > 0 for c in ("token", "intent", "section_bonus", "feedback_bonus", "keyword")])
    total = sum([w * F.coalesce(c, F.lit(0.0)) for c, w in WEIGHTS.items()], F.col("section_bonus") + F.col("feedback_bonus"))
    return rows.filter(sign).withColumn("score", F.round(total, 6)).drop("__n", "__tf")


def reduce_any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def playbook_norm(query: str) -> str:
    return re.sub(r"[^a-z0-9一-鿿_./+-]+", " ", query.lower()).strip()


def search(items: DataFrame, query: str, k: int, intents: Sequence[str] = ()) -> DataFrame:
    """The k best items by score, then confidence, then date, newest first."""
    return scored_items(items, query, intents).orderBy(F.desc("score"), F.desc("confidence"), F.desc_nulls_last("updated_at"), "item_id").limit(k)


def in_order_once(rows: DataFrame, value: str, order: Sequence[str | Column], most: int | None = None) -> DataFrame:
    """(value, place): values that hold something, each once without regard to case, in order of their first place. For the few values of hits."""
    rows = rows.withColumn(value, F.trim(value)).filter(F.col(value) != "")
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(F.lower(value)).orderBy(*order))).filter("__r = 1")
    out = first.withColumn("place", F.row_number().over(Window.orderBy(*order))).select(value, "place")
    return out.filter(F.col("place") <= most) if most else out


def expansion_terms(hits: DataFrame, query: str, explicit: Sequence[str] = (), generic: Sequence[str] = (), aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(term, place): terms that hits of expansion and feedback sections add to a query, in order of the hits, then ``explicit`` ones.

    A feedback item adds its terms if the query left a sign on it; an expansion item if a trigger stands in the query: a term that is
    not ``generic``, one of its ``aliases``, or a word of three characters or more of its content that no term holds.
    """
    compact = re.sub(r"\s+", "", playbook_norm(query))
    plain = lambda c: ~c.isin(*generic) if generic else F.lit(True)
    inside = lambda x: F.contains(F.lit(compact), F.regexp_replace(F.lower(x), r"\s+", ""))
    terms = F.filter(F.transform("expansion_terms", lambda x: F.lower(F.trim(x))), lambda x: (x != "") & plain(x))
    named = F.exists(terms, inside)
    for name, words in (aliases or {}).items():
        if any(re.sub(r"\s+", "", w.lower()) in compact for w in words if w.strip()):
            named = named | F.array_contains(terms, F.lit(name))
    told = F.exists(F.filter(lexical_tokens(F.col("content")), lambda x: (F.length(x) >= 3) & plain(x) & ~F.exists("expansion_terms", lambda t: F.contains(F.lower(t), x))), inside)
    sign = reduce_any([F.coalesce(c, F.lit(0.0)) > 0 for c in ("bm25", "keyword", "token", "feedback_bonus", "exact_query_match")])
    use = F.when(F.col("section") == "online_feedback", sign).otherwise(named | told) if compact else F.lit(False)
    own = hits.filter(F.col("section").isin("query_expansion", "online_feedback")).filter(use).select("score", "confidence", "item_id", F.posexplode("expansion_terms").alias("at", "term"))
    given = hits.sparkSession.createDataFrame([(None, None, None, i, t) for i, t in enumerate(explicit)], "score double, confidence double, item_id string, at int, term string")
    return in_order_once(own.unionByName(given), "term", [F.desc_nulls_last("score"), F.desc_nulls_last("confidence"), F.asc_nulls_last("item_id"), "at"])


def source_hints(hits: DataFrame) -> DataFrame:
    """(hint, place): the sources that hits point to, in order of the hits."""
    rows = hits.select("score", "confidence", "item_id", F.posexplode("source_hints").alias("at", "hint"))
    return in_order_once(rows, "hint", [F.desc("score"), F.desc("confidence"), "item_id", "at"])


def feedback_items(feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """An item for each question that got feedback with a correction, a comment or evidence; the latest feedback of a question counts.

    Feedback: feedback_id, run_id, feedback_type, corrected_answer, comment, expected_evidence_ids, created_at; runs: run_id, query, sources.
    """
    none = F.array().cast("array<string>")
    held = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = feedback.join(runs.select("run_id", F.col("query").alias("source_query"), "sources"), "run_id").withColumn("evidence", F.coalesce("expected_evidence_ids", none))
    rows = rows.filter((held("corrected_answer") | held("comment") | (F.size("evidence") > 0)) & (playbook_query(F.col("source_query")) != ""))
    rows = rows.withColumn("item_id", F.concat(F.lit("online-feedback-"), F.substring(F.sha1(playbook_query(F.col("source_query"))), 1, 16)))
    rows = rows.groupBy("item_id").agg(F.max_by(F.struct("feedback_id", "feedback_type", "corrected_answer", "comment", "evidence", "source_query", "sources", "created_at"), F.struct("created_at", "feedback_id")).alias("f")).select("item_id", "f.*")
    content = F.concat_ws("\n", F.concat(F.lit(ASKED), F.col("source_query"), F.lit(ANSWERED)), *[F.when(ok, F.concat(F.lit(head), value)) for ok, head, value in (
        (held("corrected_answer"), CORRECTED, F.col("corrected_answer")), (F.size("evidence") > 0, CHECKED, F.array_join("evidence", ", ")), (held("comment"), NOTED, F.col("comment")),
    )])
    parts = F.transform("evidence", lambda e: F.filter(F.transform(F.split(e, "::"), lambda x: F.trim(x)), lambda x: x != ""))
    kinds = F.transform(parts, lambda p: F.lower(F.when(F.lower(F.get(p, 0)) == "structured", F.get(p, 1)).otherwise(F.get(p, 0))))
    known = lambda a: F.array_distinct(F.filter(a, lambda x: x.isin(*SOURCES)))
    words = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9_./+-]{4,120}"), F.lit(0)) for c in ("corrected_answer", "comment")]))
    every = F.concat(words, *[playbook_tokens(F.col(c)) for c in ("source_query", "corrected_answer", "comment")], F.array_compact(F.transform(parts, lambda p: F.try_element_at(p, F.lit(-1)))))
    first = lambda a: F.aggregate(a, none, lambda s, x: F.when(F.exists(s, lambda y: F.lower(y) == F.lower(x)), s).otherwise(F.concat(s, F.array(x))))
    hints = known(kinds)
    return rows.select(
        "item_id", F.lit("online_feedback").alias("section"), content.alias("content"), F.lit("active").alias("status"),
        first(F.concat(F.array(F.lit("online-feedback"), F.col("feedback_type")), F.slice(playbook_tokens(F.col("source_query")), 1, 8))).alias("tags"),
        F.when(F.size(hints) > 0, hints).otherwise(known(F.coalesce("sources", none))).alias("source_hints"), all_rules(F.col("source_query"), QUERY_INTENTS).alias("query_intents"),
        F.slice(first(every), 1, 16).alias("expansion_terms"), F.when(F.col("feedback_type") == "correction", 1.0).otherwise(0.92).alias("confidence"),
        F.col("created_at").cast("double").alias("updated_at"), "source_query", "feedback_type",
    )


def select_for_upkeep(items: DataFrame, most: int) -> DataFrame:
    """At most ``most`` active items: feedback first, newest first, then the others by confidence and date."""
    feedback = F.col("section") == "online_feedback"
    order = [F.desc(feedback), F.when(feedback, F.col("updated_at")).desc_nulls_last(), F.desc("confidence"), F.desc_nulls_last("updated_at"), "item_id"]
    return items.filter("status = 'active'").orderBy(*order).limit(most)


class PlaybookTable:
    """Items in a table of snapshots: new items come in and old ones retire at once, and a reader sees both or neither."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.tables = spark, Snapshots(spark, path)

    def items(self, number: int | None = None) -> DataFrame:
        number = self.tables.number() if number is None else number
        return self.tables.read("items", number) if number else self.spark.createDataFrame([], ITEM)

    def active(self) -> int:
        return self.items().filter("status = 'active'").count()

    def upsert(self, new: DataFrame) -> int:
        """Put items in by id. The first write sets the count that ``due`` measures from."""
        return self._put(new, None, None)

    def due(self, threshold: int) -> bool:
        """Whether active items have grown by the threshold (1 at least) since the last upkeep."""
        return self.active() - self.tables.manifest()["notes"].get("baseline", 0) >= max(threshold, 1)

    def apply(self, new: DataFrame, retire: DataFrame, status: str = "applied") -> int:
        """Upkeep in one snapshot: put items in, and make those active ones inactive whose id ``retire`` has and no new item has."""
        return self._put(new, retire, status)

    def _put(self, new: DataFrame, retire: DataFrame | None, status: str | None) -> int:
        base = self.tables.number()
        old, names = self.items(base), [c.split()[0] for c in ITEM.split(", ")]
        new = stored(new.select(*names))
        if retire is not None:
            gone = retire.select("item_id").distinct().withColumn("__gone", F.lit(True))
            old = old.join(gone, "item_id", "left").withColumn("status", F.when(F.col("__gone") & (F.col("status") == "active"), "inactive").otherwise(F.col("status"))).drop("__gone")
        rows = old.join(new.select("item_id"), "item_id", "left_anti").select(*names).unionByName(new)
        entry = self.tables.write(rows)
        active, notes = self.tables.load(entry).filter("status = 'active'").count(), dict(self.tables.manifest(base)["notes"])
        if status or "baseline" not in notes:
            notes |= {"baseline": active, "status": status}
        return self.tables.publish(base, {"items": entry}, notes | {"active": active})
