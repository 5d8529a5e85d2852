from pyspark.sql import functions as F

from loomspan.functions import text
from loomspan.operators import datasets, evidence, gates, retrieval


def test_bm25_reads_a_text_once(spark):
    docs = spark.createDataFrame([(1, "red bolt red"), (2, "blue nut"), (3, None), (4, "")], "id int, t string")
    scored = retrieval.over_max(retrieval.bm25(docs, ["red", "nut"], "id", text.text_tokens(F.col("t"))))
    got = {r.id: r.score for r in scored.collect()}
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan  # statistics and scores read what one pass over the texts has written
    assert set(got) == {1, 2} and max(got.values()) == 1.0
    assert retrieval.bm25(docs.limit(0), ["red"], "id", text.text_tokens(F.col("t"))).count() == 0


def test_places_in_hot_groups(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 5 else None) for i in range(200)], "id int, g string").withColumn("__k", F.sha2(F.col("id").cast("string"), 256))
    got = datasets.numbered(rows, ["g"], "__k", "id", digits=1).collect()
    for g, n in (("hot", 160), (None, 40)):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r["__k"])
        assert [r["__place"] for r in mine] == list(range(1, n + 1)) and {r["__size"] for r in mine} == {n}


def test_gates_fail_on_missing_numbers(spark):
    runs = spark.createDataFrame([("a", 3, 1.0, 0.0), ("b", 3, None, 0.0), ("c", 2, 1.0, 0.5)], "run string, n int, v double, c double")
    assert {r.run: r.valid for r in gates.operational_validity(runs, "run", F.col("n"), 3, F.col("v"), F.col("c")).collect()} == {"a": True, "b": False, "c": False}
    scores = spark.createDataFrame([("x", "base", 1.0), ("x", "new", 2.0), ("y", "base", 1.0)], "g string, arm string, s double")
    got = {(r.g, r.overall): (r.delta, r.passed) for r in gates.development_gate(scores, "g", "arm", "s", "base", "new", 0.5, 0.1).collect()}
    assert got == {("x", False): (1.0, True), ("y", False): (None, False), (None, True): (1.0, True)}
    assert gates.seed_gate(spark.createDataFrame([(1, 0.1), (2, 0.2)], "seed int, d double"), "seed", "d", 3, 0.0, 1).first().passed is False
    none = spark.createDataFrame([], "w long, m double, k boolean")
    assert gates.scoped_support(none, F.col("k"), "w", "m").first().support == 0.0


def test_evidence_selection(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    test = spark.createDataFrame([(4, "b"), (5, "c")], "id int, k string")
    a, b, leaks = evidence.without_leaks(train, test, F.col("k"))
    assert [sorted(r.id for r in x.collect()) for x in (a, b)] == [[1, 3], [5]] and [r.key for r in leaks.collect()] == ["b"]
    assert evidence.anchors("red 模型精度") == ["red", "模型", "型精", "精度", "模型精", "型精度", "模型精度"]
    rows = spark.createDataFrame([(1, "x", 5), (2, "x", 9), (3, "", 1), (4, None, 2)], "id int, u string, s int")
    assert [r.id for r in evidence.keyed_once(rows, [F.col("u")], [F.desc("s")], 10).collect()] == [2, 4, 3]
    docs = spark.createDataFrame([(1, "acc is 97%. nothing here. recall 0.5\nacc is 97%"), (2, None)], "id int, t string")
    assert [(r.place, r.value) for r in evidence.important_values(docs, "id", F.col("t")).collect()] == [(0, "acc is 97%"), (1, "recall 0.5")]


def test_text_functions(spark):
    row = spark.createDataFrame([([5, 6, 2, 7], 'say "hint: go \\" on" end', "a​ b·c  模型 精度")], "ids array<int>, h string, c string")
    got = row.select(text.eos_trimmed(F.col("ids"), 2).alias("i"), text.eos_trimmed(F.col("ids"), 9).alias("j"), text.without_prefix_hint(F.col("h"), "hint:").alias("h"), text.clean_text(F.col("c")).alias("c")).first()
    assert (got.i, got.j, got.h, got.c) == ([5, 6], [5, 6, 2, 7], 'say "" end', "a b c模型精度")


def test_more_samples_make_more_tasks(spark):
    from loomspan.operators import gates

    samples = spark.range(40_000).select((F.col("id") % 10_000).alias("k"), F.lit(2.0).alias("q"))
    steps = spark.range(5_000).select(F.col("id").alias("k"), F.lit(3.0).alias("w"))
    few, many = (gates.rescored(samples, steps, ["k"], F.col("q") * F.col("w"), most=most) for most in (40_000, 1_000))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and many.rdd.getNumPartitions() == 40
    total = many.groupBy("k").agg(F.count("*").alias("n"), F.sum("rescored").alias("s"))
    assert total.rdd.getNumPartitions() == 40  # no further shuffle
    assert {(r.n, r.s) for r in total.filter("k < 5000").collect()} == {(4, 24.0)} and {(r.n, r.s) for r in total.filter("k >= 5000").collect()} == {(4, None)}
