"""Operators of retrieval, data sets, evaluation and sessions on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions import percentiles as P
from loomspan.functions import text as T
from loomspan.operators import aggregates, chunking, datasets, evaluation, graph, retrieval, sessions


def one(spark, expr_of, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr_of(F.col("v")).alias("x")).first().x


def test_tokens_of_mixed_text(spark):
    assert one(spark, T.text_tokens, "GPU-T4 v1.2 a 模型更新") == ["gpu-t4", "v1.2", "模", "型", "更", "新", "模型", "型更", "更新"]
    assert one(spark, T.text_tokens, None) == [] and one(spark, T.text_tokens, "模") == ["模"]


def test_normal_forms(spark):
    assert one(spark, T.normalize_text, " a \n\t b ") == "a b"
    assert one(spark, T.normalize_query, "Is it, a。B?") == "isitab"
    assert one(spark, T.benchmark_text, "Été 1_x!") == "été1_x"
    assert one(spark, lambda c: T.truncated(c, 6), "abcdefgh") == "abc..."
    assert one(spark, T.valid_text, " None ") is False


def test_stable_id_is_a_digest_of_lines(spark):
    import hashlib

    row = spark.createDataFrame([("a", None)], "a string, b string").select(T.stable_id(F.col("a"), F.col("b")).alias("x")).first()
    assert row.x == hashlib.sha1(b"a\nNone").hexdigest()[:24]


@pytest.mark.parametrize(("text", "want"), [("so\n#### 1,204", "1204"), ("#### -007", "-7"), ("#### 1,20", None), ("#### 5 apples", None), ("5", None), ("#### -0", "0")])
def test_integer_answers(spark, text, want):
    assert one(spark, T.integer_answer, text) == want


def test_dates(spark):
    assert [str(one(spark, T.parsed_date, x)) for x in ("2024-01-05", "2024/01/05", "20240105", "x")] == ["2024-01-05"] * 3 + ["None"]


def test_percentile_definitions(spark):
    values = sorted(random.Random(2).random() for _ in range(37))
    row = spark.createDataFrame([(values,)], "v array<double>").select(
        P.truncating(F.col("v"), 0.95).alias("a"), P.half_even(F.col("v"), 0.95).alias("b"), P.lower(F.col("v"), 0.95).alias("c"), P.upper_half(F.col("v")).alias("d")
    ).first()
    n = len(values)
    assert tuple(row) == (values[min(n - 1, int(0.95 * n))], values[round(0.95 * (n - 1))], values[int((n - 1) * 0.95)], values[n // 2])


def test_conditions_and_counts(spark):
    rows = spark.createDataFrame([("m1", "SUCCESS"), ("m1", "SUCCESS"), ("m2", "success"), ("m3", None)], "model string, status string")
    plan = aggregates.Plan("count_unique", "model", conditions=(aggregates.Condition("status", "equals", ("success",)),))
    assert tuple(aggregates.structured_count(rows, plan).first()) == (3, 2, 2)
    assert aggregates.structured_count(rows, aggregates.Plan()).first().answer == 4
    assert aggregates.structured_count(rows, aggregates.Plan(conditions=(aggregates.Condition("", "in", ("x",)),))).first().answer == 4


def test_multivalued_fields(spark):
    rows = spark.createDataFrame([("T4, T4",), ("ascend710、T4",), (None,)], "d string")
    assert {r.value: r.n for r in aggregates.multivalue_counts(rows, "d").collect()} == {"T4": 3, "ascend710": 1}


def test_preferred_rows_fall_back_to_all(spark):
    rows = spark.range(4)
    assert aggregates.preferred_rows(rows, F.col("id") > 2).count() == 1
    assert aggregates.preferred_rows(rows, F.col("id") > 9).count() == 4


def test_mutual_information_of_independent_and_equal_columns(spark):
    rows = spark.createDataFrame([(a, b, a) for a in "xy" for b in "uv"], "a string, b string, c string")
    assert aggregates.mutual_information(rows, "a", "b").first()[0] == pytest.approx(0)
    assert aggregates.mutual_information(rows, "a", "c").first()[0] == pytest.approx(1)


def test_bm25_prefers_rarer_terms_and_shorter_texts(spark):
    docs = spark.createDataFrame([(1, "common rare words"), (2, "common words here"), (3, "common rare words and many more of them here"), (4, "")], "id long, text string")
    ranked = retrieval.top(retrieval.bm25(docs, ["rare", "common", "rare"], "id", T.text_tokens(F.col("text"))), 5, "id").collect()
    assert [r.id for r in ranked] == [1, 3, 2]
    assert retrieval.bm25(docs, ["none"], "id", T.text_tokens(F.col("text")), keep_zero=True).count() == 4


def test_rank_fusion_prefers_what_is_in_both_lists(spark):
    rows = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 2.0), ("b", "z", 9.0), ("b", "y", 8.0)], "list string, id string, score double")
    best = retrieval.top(retrieval.rrf(rows, "id"), 1, "id").first()
    assert best.id == "y" and best.score == pytest.approx(2 / 62)


def test_vectors_of_another_dimension_are_passed_over(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0])], "id long, v array<float>")
    got = {r.id: r.score for r in retrieval.vector_scores(rows, "v", [0.0, 1.0], "id", cosine=True).collect()}
    assert got == {1: 0.0, 2: 1.0}


def test_chunks_cut_at_breaks_and_overlap():
    text = "x" * 500 + "\n\n" + "y" * 700 + ". " + "z" * 300
    pieces = list(chunking.cuts(text))
    assert pieces[0] == "x" * 500 and pieces[1].startswith("x" * 118 + "\n\n")
    assert list(chunking.cuts("")) == [] and list(chunking.cuts(" a ")) == ["a"] and all(len(p) <= 900 for p in pieces)


def test_keep_first(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, o int")
    assert sorted((r.k, r.o) for r in datasets.keep_first(rows, F.col("k"), "o").collect()) == [("a", 1), ("b", 3)]


def test_splits_are_disjoint_and_sized(spark):
    rows = spark.range(200).select("id", F.when(F.col("id") < 150, "a").when(F.col("id") < 199, "b").otherwise("single").alias("s"))
    got = datasets.stratified_split(rows, "s", "id", 0.1).groupBy("s", "split").count().collect()
    assert {(r.s, r.split): r["count"] for r in got} == {("a", "val"): 15, ("a", "train"): 135, ("b", "val"): 5, ("b", "train"): 44, ("single", "train"): 1}
    sizes = {r.split: r["count"] for r in datasets.hash_split(rows, F.col("id"), {"dev": 20, "sealed": 5}).groupBy("split").count().collect()}
    assert sizes == {"dev": 20, "sealed": 5, "rest": 175}


def test_quotas_add_up(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 70, "a").when(F.col("id") < 97, "b").otherwise("c").alias("s"))
    got = {r.s: r.quota for r in datasets.proportional_quotas(rows, "s", 20).collect()}
    assert sum(got.values()) == 20 and got["c"] >= 1 and got["a"] > got["b"] > got["c"]


def test_balancing_levels_groups(spark):
    rows = spark.range(10).select("id", (F.col("id") < 7).alias("g"))
    assert {r["count"] for r in datasets.balance_up(rows, "g", "id").groupBy("g").count().collect()} == {7}


def test_field_overlap_between_splits(spark):
    rows = spark.createDataFrame([("q1", "train"), ("q1", "dev"), ("q2", "dev"), ("q2", "test"), ("q1", "test"), (None, "dev")], "q string, split string")
    got = {(r.split_a, r.split_b): r.overlap for r in datasets.field_overlap(rows, ["q"], "split").collect()}
    assert got == {("dev", "test"): 2, ("dev", "train"): 1, ("test", "train"): 1}


def test_case_macro_differs_from_step_mean(spark):
    rows = spark.createDataFrame([("a", "c", 1.0), ("a", "c", 1.0), ("b", "c", 0.0)], "case string, cat string, score double")
    row = evaluation.run_summary(rows, "case", "cat", "score", F.col("score") >= 1).first()
    assert row.step_mean == pytest.approx(2 / 3) and row.case_macro == 0.5 and row.pass_rate == 0.5


def test_uniform_improvement_is_supported(spark):
    rows = spark.createDataFrame([(k, 0.1, 1) for k in range(8)], "c int, s double, n int")
    low, high = evaluation.interval(evaluation.bootstrap(rows, "c", "s", "n", 50)).first()
    assert low == pytest.approx(0.1) and high == pytest.approx(0.1)


def test_bootstrap_agrees_with_resampling(spark):
    r = random.Random(1)
    rows = [(k, r.gauss(0.2, 1), 1) for k in range(40)]
    got = evaluation.interval(evaluation.bootstrap(spark.createDataFrame(rows, "c int, s double, n int"), "c", "s", "n", 2000)).first()
    means = sorted(sum(x[1] for x in r.choices(rows, k=40)) / 40 for _ in range(4000))
    assert got.low == pytest.approx(means[100], abs=0.06) and got.high == pytest.approx(means[3900], abs=0.06)


def test_pass_all_needs_every_run(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 1, True), ("b", 2, False), ("c", 1, True)], "case string, run int, ok boolean")
    row = evaluation.pass_all_any(rows, "case", "run", F.col("ok")).first()
    assert (row.cases, row.pass_all, row.pass_any, row.flaky) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(1 / 3))


def test_set_scores_with_empty_sets(spark):
    rows = spark.createDataFrame([([], []), ([], ["a"]), (["a"], []), (["a", "b"], ["b", "c"])], "e array<string>, p array<string>")
    got = [tuple(r.x) for r in rows.select(evaluation.set_scores(F.col("e"), F.col("p")).alias("x")).collect()]
    assert got == [(1, 1, 1, 1), (0, 1, 0, 1), (0, 0, 0, 0), (0.5, 0.5, 0.5, 1.0)]


def test_gate_fails_on_a_missing_metric(spark):
    rows = spark.createDataFrame([(0.6, None)], "a double, b double")
    assert [r.passed for r in evaluation.gate_checks(rows, [("a", ">=", 0.5), ("b", ">=", 0.5)]).collect()] == [True, False]


def test_sessions(spark):
    rows = spark.createDataFrame([("s", 1, "a"), ("s", 2, "a"), ("s", 3, "b"), ("t", 1, "a"), ("t", 2, "a"), ("t", 3, "b")], "s string, o int, a string")
    assert {(r.sequence, r.n) for r in sessions.trajectories(rows, "s", ["o"], "a").collect()} == {("a -> a -> b", 2)}
    assert {(r.s, r.repeats) for r in sessions.adjacent_repeats(rows, "s", ["o"], "a", {"b": "a"}).collect()} == {("s", 2), ("t", 2)}


def test_islands_and_fill(spark):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(["H", "aa", "bb", "cccc", "dd"])], "d int, n int, t string")
    assert {(r.first, r.last, r.n) for r in sessions.islands(rows, "d", "n", F.length("t") == 2).collect()} == {(1, 2, 2), (4, 4, 1)}
    filled = sessions.fill_forward(rows, "d", "n", F.when(F.length("t") == 1, F.col("t")), "h")
    assert {r.h for r in filled.collect()} == {"H"}


def test_entities_and_their_graph(spark):
    rows = spark.createDataFrame([(1, "see yolo.onnx v1.2 and YOLO.onnx"), (2, "yolo.onnx v1.2"), (3, "标签识别模型"), (4, None)], "id int, t string")
    m = graph.mentions(rows, "id", "t")
    assert {(r.id, r.kind, r.name) for r in m.collect() if r.kind in ("model", "version")} == {(1, "model", "yolo.onnx"), (1, "version", "v1.2"), (2, "model", "yolo.onnx"), (2, "version", "v1.2")}
    assert [(r.a, r.b, r.evidence) for r in graph.cooccurrences(m.filter("id < 3"), "id").collect()] == [("model:yolo.onnx", "version:v1.2", 2)]
