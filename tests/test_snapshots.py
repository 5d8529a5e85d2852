import math

import pytest
from pyspark.sql import functions as F

from loomspan.functions.text import text_tokens
from loomspan.operators import retrieval
from loomspan.sources.inverted import InvertedIndex
from loomspan.sources.snapshots import Conflict, Snapshots


def test_readers_see_whole_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"))
    assert s.number() == 0 and s.manifest() == {"tables": {}, "notes": {}}
    a = s.write(spark.range(3))
    assert s.number() == 0
    assert s.publish(0, {"a": a, "b": s.write(spark.range(0).withColumn("p", F.lit(1)), ["p"])}, {"n": 3}) == 1
    held = s.read("a")
    assert s.publish(1, {"a": s.write(spark.range(3, 5), after=a)}, {}) == 2
    assert held.count() == 3 and s.read("a").count() == 5 and s.read("a", 1).count() == 3 and s.read("b", 1).count() == 0
    assert s.manifest(1)["notes"] == {"n": 3} and s.number() == 2


def test_of_two_writers_one_gives_way(spark, tmp_path):
    s = Snapshots(spark, "file://" + str(tmp_path / "t"))
    s.publish(0, {"a": s.write(spark.range(1))}, {})
    with pytest.raises(Conflict):
        s.publish(0, {"a": s.write(spark.range(9))}, {})
    late = Snapshots(spark, s.path)
    late.number = lambda: 0 if not seen.append(1) and len(seen) == 1 else 1  # has looked before the first came
    seen = []
    with pytest.raises(Conflict):
        late.publish(0, {"a": s.write(spark.range(9))}, {})
    assert s.read("a").count() == 1 and s.number() == 1


def test_a_failed_write_leaves_the_last_snapshot(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"))
    s.publish(0, {"a": s.write(spark.range(4))}, {})
    with pytest.raises(Exception, match="boom"):
        s.write(spark.range(4).select(F.raise_error(F.lit("boom"))))
    assert s.number() == 1 and s.read("a").count() == 4


DOCS = [(1, "red nut red"), (2, "green nut"), (3, ""), (4, None), (5, "blue bolt nut nut"), (None, "red red red"), (6, "red " * 40), (6, "red nut")]


def plain(docs, terms, scope=None):
    rows = {i: (t or "").split() for i, t in docs.items() if scope is None or i in scope}
    full = [t for t in rows.values() if t]
    avg = sum(map(len, full)) / max(len(full), 1)
    out = {}
    for t in set(terms):
        df = sum(t in x for x in rows.values())
        for i, x in rows.items():
            if f := x.count(t):
                out[i] = out.get(i, 0) + math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(x) / avg))
    return out


def scores(df):
    return {r.id: pytest.approx(r.score) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def test_index_follows_versions_and_removals(spark, tmp_path):
    index, tok = InvertedIndex(spark, str(tmp_path / "i"), buckets=4), text_tokens(F.col("text"))
    index.upsert(frame(spark, DOCS), "id", tok, F.lit(1))
    now = {i: t for i, t in DOCS if i}
    now[6] = "red " * 40  # of two rows of one version the longer one
    terms = ["red", "nut", "blue", "none", "red"]
    assert plain(now, terms) == scores(index.bm25(terms))
    index.upsert(frame(spark, [(2, "red nut green"), (7, "blue nut"), (3, "nut")]), "id", tok, F.lit(3))
    now |= {2: "red nut green", 7: "blue nut", 3: "nut"}
    assert plain(now, terms) == scores(index.bm25(terms))
    index.upsert(frame(spark, [(2, "blue blue"), (1, "blue blue")]), "id", tok, F.when(F.col("id") == 2, 2).otherwise(1))
    now[1] = "blue blue"  # 2 is there in a later version
    assert plain(now, terms) == scores(index.bm25(terms))
    index.remove(frame(spark, [(5, ""), (7, ""), (99, "")]), "id", F.lit(2))
    del now[5]  # 7 is there in version 3
    index.upsert(frame(spark, [(5, "red red"), (99, "red")]), "id", tok, F.lit(1))
    assert plain(now, terms) == scores(index.bm25(terms))
    assert plain(now, terms, {1, 2, 3}) == scores(index.bm25(terms, scope=frame(spark, [(1, ""), (2, ""), (3, ""), (3, "")])))
    before, rows = index.tables.number(), index.tables.read("postings").count()
    index.compact()
    again = InvertedIndex(spark, str(tmp_path / "i"))
    assert again.buckets == 4 and again.tables.manifest()["notes"]["dead"] == 0 and index.tables.read("postings").count() < rows
    assert plain(now, terms) == scores(again.bm25(terms)) == scores(again.bm25(terms, number=before))
    zero = again.bm25(terms, keep_zero=True).collect()
    assert {r.id for r in zero} == set(now) and sum(r.score > 0 for r in zero) == len(plain(now, terms))
    assert again.bm25([]).count() == 0


def test_a_query_reads_its_terms_only(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=32)
    words = frame(spark, [(k, f"word{k} common") for k in range(200)])
    index.upsert(words, "id", text_tokens(F.col("text")), F.lit(1))
    found = index.postings(["word7", "word8"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2 and "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "word7" in plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    every = retrieval.bm25(words, ["common", "word7"], "id", text_tokens(F.col("text")))
    assert scores(every) == scores(index.bm25(["common", "word7"]))


def test_texts_are_read_once(spark):
    docs = frame(spark, DOCS)
    plan = retrieval.over_max(retrieval.bm25(docs, ["red", "nut"], "id", text_tokens(F.col("text"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 0
    once = retrieval.token_counts(docs, "id", text_tokens(F.col("text")), ["red", "nut"])._jdf.queryExecution().optimizedPlan().toString()
    assert once.count("regexp_extract_all(lower(coalesce(text") <= 2  # words and CJK characters


def shuffled(spark, work):
    """What ``work`` gives, and the rows that it shuffled."""
    sc = spark._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        none = spark._sc._gateway.new_array(spark._jvm.double, 0)
        stages = sc.statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    return work(), total() - before


def test_an_index_is_written_without_a_shuffle_of_tokens(spark, tmp_path):
    index, tok = InvertedIndex(spark, str(tmp_path / "i"), buckets=4), text_tokens(F.col("text"))
    docs = {k: " ".join(f"word{k + j % 30}" for j in range(300)) for k in range(50)}
    _, rows = shuffled(spark, lambda: index.upsert(frame(spark, list(docs.items())), "id", tok, F.lit(1)))
    assert rows < 500  # 1,500 postings of 15,000 tokens; ids and counts are few
    _, rows = shuffled(spark, lambda: index.upsert(frame(spark, [*docs.items(), (7, "word7 " * 400)]), "id", tok, F.lit(2)))
    assert rows < 600  # of the id that comes twice two rows are brought together
    assert plain(docs | {7: "word7 " * 400}, ["word7", "word9"]) == scores(index.bm25(["word7", "word9"]))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_terms_of_odd_token_arrays(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=4)
    rows = [(1, ["b", None, "a", None, "b"]), (2, []), (3, None), (4, ["一二", "a", "averylongterm1", "averylongterm2"])]
    index.upsert(spark.createDataFrame(rows, "id long, toks array<string>"), "id", F.col("toks"), F.lit(1))
    found = {(r.term, r.id, r.tf, r.length) for r in index.tables.read("postings").collect() if r.term is not None}
    assert found == {("a", 1, 1, 5), ("b", 1, 2, 5), *((t, 4, 1, 4) for t in rows[3][1])}
    assert {(r.id, r.length) for r in index.tables.read("live").collect()} == {(1, 5), (2, 0), (3, 0), (4, 4)}
