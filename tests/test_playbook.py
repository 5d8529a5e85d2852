import hashlib
import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from loomspan.functions import rules
from loomspan.functions.text import lexical_tokens
from loomspan.operators import playbook

ITEMS = [
    ("a", "field_binding", "Bind the red field to 模型文件列表", "active", ["red", "Bolt"], ["table"], ["field_lookup"], ["owner", "bolt-9"], 0.7, 3.0, None, None),
    ("b", "source_routing", "route nothing", "active", [], ["deployment", "table"], [], [], 0.9, 2.0, None, None),
    ("c", "online_feedback", "the answer was red", "active", ["red"], ["document"], [], ["red bolt"], 1.0, 5.0, "Red  BOLT, 文件列表?", "correction"),
    ("d", "online_feedback", "the answer was red", "active", ["red"], [], [], ["red bolt"], 1.0, 5.0, "another question", "correction"),
    ("e", "query_expansion", "about 安全带 things; bolt colour", "active", None, ["Table"], None, ["safetybelt", "model", "colour wheel"], 0.2, None, None, None),
    ("f", "query_expansion", "nothing to find", "active", [], [], [], ["zzz"], 0.2, 1.0, None, None),
    ("g", "field_binding", "red red red", "inactive", ["red"], [], [], [], 1.0, 9.0, None, None),
    ("h", "online_feedback", "no question of its own, 列表", "active", [], [], [], [], 0.5, 1.0, None, "comment"),
]
QUERY = "red bolt 文件列表"


def frame(spark, rows=None):
    return spark.createDataFrame(ITEMS if rows is None else rows, playbook.ITEM)


def plain(query, intents):
    """The score of each item by the words of its description."""
    grams = lambda t: [t, *(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1))] if re.fullmatch("[一-鿿]{3,}", t) else [t]
    tok = lambda s: list(dict.fromkeys(g for t in dict.fromkeys(re.findall("[a-z0-9][a-z0-9_./+-]{1,80}|[一-鿿]{2,}", (s or "").lower())) for g in grams(t)))
    norm = lambda s: re.sub("[^a-z0-9一-鿿_./+-]+", " ", (s or "").lower()).strip()
    items = [i for i in ITEMS if i[3] == "active"]
    join = lambda x: " ".join(x or [])
    tokens = {i[0]: [t for s in (i[1], i[2], join(i[4]), join(i[6]), join(i[7])) for t in tok(s)] + tok(join(i[4])) * 2 + tok(join(i[7])) * 3 + tok(join(i[6])) * 2 + tok(i[10]) * 3 for i in items}
    q, out = tok(query), {}
    mean = max(sum(map(len, tokens.values())) / len(items), 1)
    for i in items:
        told = fix = 0.0
        if i[1] == "online_feedback":
            if norm(i[10]) and norm(i[10]) != norm(query):
                continue
            told = 0.9 * (norm(query) != "" and norm(i[10]) == norm(query)) + 0.08 * (i[11] == "correction")
        fix = 0.15 * ("deployment" in intents and i[1] == "source_routing") + 0.12 * ("field_lookup" in intents and i[1] in ("field_binding", "answer_strategy")) + 0.16 * ("aggregate" in intents and i[1] == "aggregate_semantics")
        bm = 0.0
        for t in q:
            if f := tokens[i[0]].count(t):
                df = sum(t in x for x in tokens.values())
                bm += math.log(1 + (len(items) - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(tokens[i[0]]) / mean))
        exact, body = {x.lower() for x in [*(i[7] or []), *(i[4] or []), *(i[6] or [])]}, norm(" ".join([i[1], i[2], join(i[4]), join(i[7]), i[10] or ""]))
        kw, over, shared = min(sum(1.4 if t in exact else 1.0 if t in body else 0 for t in q) / max(len(q), 1), 1), len({*q} & {*tokens[i[0]]}), len({*intents} & {*(i[6] or [])})
        if kw or over or shared or fix or told:
            out[i[0]] = 0.42 * min(bm / max(len(q), 1), 1) + 0.23 * kw + 0.15 * min(over / max(len(q), 1), 1) + 0.3 * (min(shared / len(intents), 1) if intents else 0) + fix + told + 0.15 * i[8]
    return out


@pytest.mark.parametrize("query,intents", [(QUERY, ["field_lookup", "deployment"]), (QUERY, []), ("another question", ["aggregate"]), ("", ["deployment"]), ("nowhere 模型文件", [])])
def test_search_has_all_terms(spark, query, intents):
    got = playbook.search(frame(spark), query, 20, intents).collect()
    assert {r.item_id: pytest.approx(r.score, abs=2e-6) for r in got} == plain(query, intents)
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert playbook.search(frame(spark, []), query, 3, intents).count() == 0


def test_tokens_of_cjk_runs(spark):
    got = spark.createDataFrame([("Red 模型文件 模型 bolt",), (None,)], "t string").select(lexical_tokens(F.col("t")).alias("t")).collect()
    assert got[0].t == ["red", "模型文件", "模型", "型文", "文件", "模型文", "型文件", "bolt"] == playbook.query_tokens("Red 模型文件 模型 bolt") and got[1].t == []


def test_terms_and_hints_of_hits(spark):
    hits = playbook.search(frame(spark), QUERY, 20, ["field_lookup", "deployment"])
    told = lambda q, **more: [r.term for r in playbook.expansion_terms(playbook.search(frame(spark), q, 20), q, generic=["model", "bolt"], **more).orderBy("place").collect()]
    assert told(QUERY, explicit=["Extra", "RED bolt", " "]) == ["red bolt", "Extra"]
    assert told("red bolt 文件列表 colourwheel") == ["safetybelt", "model", "colour wheel"]  # a term of the item stands in the query
    assert told("things with bolt") == ["safetybelt", "model", "colour wheel"]  # a word of its content does
    assert told("bolt 安全绳带", aliases={"safetybelt": ["安全绳"]}) == ["safetybelt", "model", "colour wheel"]
    assert [r.hint for r in playbook.source_hints(hits).orderBy("place").collect()] == ["document", "table", "deployment"]


def test_feedback_becomes_items(spark):
    runs = spark.createDataFrame([("r1", "What OID, red?", ["table", "web"]), ("r2", "what oid  RED", []), ("r3", "?!", []), ("r4", "几个 red", ["deployment"])], "run_id string, query string, sources array<string>")
    feedback = spark.createDataFrame([
        ("f1", "r1", "comment", None, "see Model-77", ["x"], 1.0), ("f2", "r2", "correction", "It is Bolt/9", None, ["structured::Table::k1", "document::d::k2"], 2.0),
        ("f3", "r3", "correction", "lost", None, None, 3.0), ("f4", "r4", "harmful", None, "", [], 4.0), ("f5", "r4", "missing", None, "red red", None, 5.0), ("f6", "none", "correction", "x", None, None, 6.0),
    ], "feedback_id string, run_id string, feedback_type string, corrected_answer string, comment string, expected_evidence_ids array<string>, created_at double")
    got = {r.source_query: r for r in playbook.feedback_items(feedback, runs).collect()}
    assert set(got) == {"what oid  RED", "几个 red"}  # of two feedbacks on one question the later one
    one = got["what oid  RED"]
    assert one.item_id == "online-feedback-" + hashlib.sha1(b"what oid red").hexdigest()[:16] and one.confidence == 1.0 and one.source_hints == ["table", "document"]
    assert one.expansion_terms == ["Bolt/9", "what", "oid", "red", "it", "is", "k1", "k2"] and one.query_intents == ["release_table"] and one.tags == ["online-feedback", "correction", "what", "oid", "red"]
    assert one.content.split("\n")[1:] == [playbook.CORRECTED + "It is Bolt/9", playbook.CHECKED + "structured::Table::k1, document::d::k2"]
    two = got["几个 red"]
    assert two.confidence == 0.92 and two.source_hints == ["deployment"] and two.query_intents == ["aggregate"] and two.content.endswith(playbook.NOTED + "red red")
    assert playbook.feedback_items(feedback, runs).columns == [c.split()[0] for c in playbook.ITEM.split(", ")]


def test_upkeep_in_one_snapshot(spark, tmp_path):
    table = playbook.PlaybookTable(spark, str(tmp_path / "p"))
    assert table.items().count() == 0 and not table.due(1)
    table.upsert(frame(spark, ITEMS[:3]))
    assert table.active() == 3 and not table.due(1)
    table.upsert(frame(spark, [*ITEMS[2:5], (*ITEMS[0][:8], 0.1, *ITEMS[0][9:])]))
    assert table.active() == 5 and table.due(2) and not table.due(3)
    before = table.tables.number()
    with pytest.raises(Exception, match="boom"):
        table.apply(frame(spark, ITEMS[5:6]).withColumn("content", F.raise_error(F.lit("boom")).cast("string")), frame(spark, ITEMS[:1]))
    assert table.tables.number() == before and table.active() == 5
    table.apply(frame(spark, ITEMS[5:6]), frame(spark, [ITEMS[0], ITEMS[1], ITEMS[5], ITEMS[7]]))
    status = {r.item_id: r.status for r in table.items().collect()}
    assert status == {"a": "inactive", "b": "inactive", "c": "active", "d": "active", "e": "active", "f": "active"}
    assert table.items(before).filter("status = 'active'").count() == 5 and not table.due(1) and table.tables.manifest()["notes"]["baseline"] == 4
    assert [r.item_id for r in playbook.select_for_upkeep(table.items(), 3).collect()] == ["c", "d", "f"]


def test_role_of_every_combination(spark):
    aspects = ("general", "accuracy_metric", "limitation", "owner_metadata")
    rows = [(a, list(f), s) for a in aspects for n in range(4) for f in itertools.combinations(aspects[1:], n) for s in (0.2, 0.45, 0.69, 0.7)]
    got = spark.createDataFrame(rows, "a string, f array<string>, s double").select("*", rules.evidence_role(F.col("a"), F.col("f"), F.col("s")).alias("role")).collect()
    for a, f, s, role in got:
        primary = a != "general" and a in f and s >= 0.7
        caveat = "limitation" in f and (s < 0.45 or a == "accuracy_metric" and "accuracy_metric" not in f)
        assert role == ("primary" if primary else "caveat" if caveat else "supporting")
