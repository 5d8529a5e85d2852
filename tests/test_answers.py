import random

from pyspark.sql import functions as F

from loomspan.operators import answers as A

LABELS = {"family": "Family", "name": "Name", "size": "Size", "owner": "Owner"}


def walked(text):
    """The same records by a walk over the lines."""
    out, now = [], {}
    by_label = {v: k for k, v in LABELS.items()}
    for line in (text or "").splitlines():
        label, colon, value = line.partition(":")
        field = by_label.get(label.strip())
        if not colon or not field:
            continue
        opens = field == "family" and ("name" in now or "size" in now)
        again = field == "name" and now.get("name")
        if opens or again:
            out.append(now)
            now = {"family": now.get("family", "")} if again else {}
        now[field] = value.strip()
    return [r for r in [{k: v for k, v in r.items() if v} for r in [*out, now]] if r]


def test_records_equal_a_walk_over_the_lines(spark):
    rng = random.Random(3)
    line = lambda: rng.choice([" Family : f%d", "Family:", "Name: n%d", "Name: ", "Size:s%d", "Owner: o:%d", "Other: %d", "no colon %d", ": %d"]).replace("%d", str(rng.randrange(4)))
    texts = [(k, rng.choice(["\n", "\r\n", " "]).join(line() for _ in range(rng.randrange(0, 14)))) for k in range(300)] + [(1000, None), (1001, ""), (1002, "\n".join(["Family: f", *["Name: n\nSize: 1"] * 3000]))]
    docs = spark.createDataFrame(texts, "name long, text string").withColumnRenamed("name", "id")
    got: dict = {}
    for r in A.labelled_records(docs, "id", F.col("text"), LABELS, "family", "name", ["name", "size"]).orderBy("id", "record").collect():
        got.setdefault(r.id, []).append({f: r[f] for f in LABELS if r[f] is not None})
    assert got == {k: w for k, t in texts if (w := walked(t))}
    assert len(got[1002]) == 3000 and all(r == {"family": "f", "name": "n", "size": "1"} for r in got[1002])


def test_records_are_read_where_their_document_lies(spark):
    docs = spark.range(20).select("id", F.lit("Family: f\nName: a\nSize: 1\nName: b:c \nOther: x").alias("text")).repartition(3)
    out = A.labelled_records(docs, "id", F.col("text"), LABELS, "family", "name", ["name", "size"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan  # the one that deals the documents here
    assert sorted(tuple(r)[1:4] for r in out.collect()) == sorted([(0, "f", "a"), (1, "f", "b:c")] * 20)


def test_summaries_and_requested_fields(spark):
    aliases = {"size": ["dimension", "SIZE"], "owner": ["owner", "who"]}
    assert A.requested_fields("Which Size?", aliases) == ["size"] and A.requested_fields("who, what dimension", aliases) == ["size", "owner"]
    assert A.requested_fields("what is it", aliases, ["what is"], ["name"]) == ["name"] and A.requested_fields(None, aliases, ["what"], ["name"]) == []
    rows = spark.createDataFrame([(1, 0, "f", "n" * 9), (1, 1, None, None), (1, 2, "g", None), (1, 3, "h", None), (2, 0, None, None)], "id int, record int, family string, name string")
    got = {r.id: r.summary for r in A.field_summaries(rows, "id", ["family", "name"], LABELS, most=2, cuts={"name": 7}).collect()}
    assert got == {1: "- Family=f | Name=nnnn...\n- Family=g"}


def test_answers_are_completed_with_what_they_left_out(spark):
    answers = spark.createDataFrame([(1, "The AB c-1 holds 97.5 %。 ", True), (2, "none", False), (3, None, True), (4, "x", True), (5, "y", None)], "k int, t string, ok boolean")
    values = [(1, 1, False, 0, "recall 88.0"), (1, 2, True, 0, "abc-1 rose"), (1, 2, True, 1, "fp16 12"), (1, 2, True, 1, "fp16 12"), (1, 3, True, 0, "97.5%"), (1, 3, True, 1, "~ 1"), (2, 1, True, 0, "lost 55"), (3, 4, None, 0, "kept 44"), (4, 1, True, 0, None), (5, 1, True, 0, "miss 22")]
    values += [(4, p, False, 0, f"value{p}") for p in range(2, 14)]
    v = spark.createDataFrame(values, "k int, place int, primary boolean, number int, value string")
    got = {r.k: (r.missing, r.t) for r in A.completed_answers(answers, v, "k", "t", F.col("ok")).collect()}
    assert got[1] == (["fp16 12[2]"], "The AB c-1 holds 97.5 %；补充关键指标/原始标识：fp16 12[2]。")
    assert got[2] == ([], "none") and got[5] == ([], "y")
    assert got[3] == (["kept 44[4]"], "；补充关键指标/原始标识：kept 44[4]。")
    assert got[4][0] == [f"value{p}[{p}]" for p in range(2, 8)]


def test_references(spark):
    hits = [(1, 1, "Dir\\A.PDF"), (1, 2, " other/a.pdf"), (1, 3, "b.pdf"), (1, 4, None), (1, 5, "  "), (1, 6, "/"), (2, 1, "x/c.pdf"), (2, 2, "known/d.pdf")]
    known = [("dir/a.pdf", "u1", 1), ("a.pdf", "u2", 2), ("z/b.pdf", "u3", 3), ("known/d.pdf", None, 4), ("d.pdf", "u5", 5), ("c.pdf", "old", 6), ("q/C.pdf", "new", 7)]
    h, m = spark.createDataFrame(hits, "k int, p int, name string"), spark.createDataFrame(known, "file string, url string, o int")
    got = {(r.k, r.p): (r.doc_name, r.url) for r in A.references(h, "k", "p", "name", m, "file", "url", "o").collect()}
    assert got == {(1, 1): ("A.PDF", "u1"), (1, 3): ("b.pdf", "u3"), (1, 6): ("/", None), (2, 1): ("c.pdf", "new"), (2, 2): ("d.pdf", "u5")}
    assert A.references(h.limit(0), "k", "p", "name", m, "file", "url", "o").count() == 0 and A.references(h, "k", "p", "name", m.limit(0), "file", "url", "o").filter("url IS NOT NULL").count() == 0
