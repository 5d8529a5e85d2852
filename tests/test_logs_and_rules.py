import json

import pytest
from pyspark.sql import functions as F

from loomspan.functions import aspects as A
from loomspan.functions import rules
from loomspan.operators import audit_logs
from loomspan.sources import files


def test_session_files(spark, tmp_path):
    good = {"threads": {"t": {"last_image_path": "a.png", "query_trajectories": {"q1": {"steps": [{"action": "Search"}, {"action": "end "}]}, "q2": {"steps": []}},
            "raw_ledger": [{"event_type": "observation", "observation": "search", "payload": {"ok": True}}, {"payload": {"error": "x"}}, {"event_type": "OBSERVATION", "payload": {"action": "Rank", "error": "x"}}]}}}
    for name, text in {"codex_1.json": json.dumps(good), "b.json": "{broken", "c.json": "[1]", "d.json": "{}"}.items():
        (tmp_path / name).write_text(text)
    f = files.whole_texts(spark, str(tmp_path))
    got = {(r.what, r.name): r.n for r in audit_logs.session_counts(f).collect()}
    assert got == {
        ("file", "parsed"): 2, ("file", "unreadable"): 2, ("thread", "with image"): 1, ("step", "search"): 1, ("step", "end"): 1, ("sequence", "search -> end"): 1,
        ("event", "OBSERVATION"): 2, ("event", "UNKNOWN"): 1, ("observation", "search:success"): 1, ("observation", "rank:failure"): 1,
    }
    assert {r.cohort: r.n for r in audit_logs.cohorts(f, "path", {"codex_": "eval"}, "other").collect()} == {"eval": 1, "other": 3}


def test_aspects_intents_and_roles(spark):
    q = ["这个模型精度如何", "哪些情况 无法保证", "DID 是多少", "owner 是谁", "hello", None]
    df = spark.createDataFrame([(x,) for x in q], "q string")
    got = [tuple(r) for r in df.select(rules.first_rule(F.col("q"), rules.QUERY_ASPECTS), rules.all_rules(F.col("q"), rules.QUERY_INTENTS)).collect()]
    assert got == [("accuracy_metric", ["document_detail"]), ("limitation", []), ("deployment", ["deployment", "aggregate", "field_lookup"]), ("owner_metadata", ["release_table", "field_lookup"]), ("general", []), ("general", [])]
    rows = spark.createDataFrame([("accuracy_metric", ["accuracy_metric"], 0.7), ("accuracy_metric", ["limitation"], 0.9), ("general", ["label_schema"], 0.9), ("limitation", ["accuracy_metric"], 0.1), ("general", ["limitation"], 0.1), ("owner_metadata", ["owner_metadata"], 0.6)], "a string, f array<string>, s double")
    assert [r[0] for r in rows.select(rules.evidence_role(F.col("a"), F.col("f"), F.col("s"))).collect()] == ["primary", "caveat", "supporting", "supporting", "caveat", "supporting"]


def test_aspects_of_chunks(spark):
    texts = [
        ("模型精度测试: acc 97.2%", "document", []), ("算法边界: 夜间无法保证精度", "document", []), ("输入: 图片 输出: 标签", "document", []), ("net.onnx 特征维度 256", "table", ["owner"]),
        ("plain words", "deployment", ["benchmark_info"]), ("plain words", "document", []), (None, "table", ["labels"]), ("本版本相比上版提升 0.5%", "document", []), ("耗时 12 ms", "document", []),
    ]
    df = spark.createDataFrame(texts, "t string, s string, k array<string>").withColumn("a", A.chunk_aspects(F.col("t"), F.col("s"), F.col("k")))
    rows = df.withColumn("sec", A.section_type(F.col("t"), F.col("a"))).withColumn("score", A.answerability("accuracy_metric", F.col("t"), F.col("s"), F.col("a"), F.col("sec"))).collect()
    assert [(r.a, r.sec) for r in rows] == [
        (["accuracy_metric"], "accuracy_eval"), (["limitation"], "algorithm_boundary"), (["input_output"], "input_output"), (["owner_metadata", "model_artifact"], "model_artifact"),
        (["deployment", "accuracy_metric"], "accuracy_metric"), (["general"], "general"), (["label_schema"], "label_schema"), (["accuracy_metric", "release_change"], "release_note"), (["performance_latency"], "performance_eval"),
    ]
    assert [round(r.score, 2) for r in rows] == [1.65, -0.62, -0.12, -0.57, 0.95, -0.12, -0.54, 1.65, -0.12]


def test_query_column_and_printed_tables(spark, tmp_path):
    df = spark.createDataFrame([("1", "long words here", "b"), ("2", "more words", "c")], "n string, words string, x string")
    assert files.query_column(df) == "words" and files.query_column(df.withColumnRenamed("x", "Query")) == "Query"
    (tmp_path / "out.txt").write_text("  ID   NO\n  1   7   net   a-very-long   ok\n            er   -name\n━━━━━━\n  2   8   map   short   bad\n")
    rows = files.read_printed_tables(spark, str(tmp_path / "out.txt"), ("id", "no", "kind", "name", "state"), ("kind", "name")).collect()
    assert [r.record["id"] for r in rows] == ["1", "2"] and rows[0].record == {"id": "1", "no": "7", "kind": "neter", "name": "a-very-long-name", "state": "ok"}


def test_writers_caches_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    files.write_lines(df, f"{tmp_path}/j")
    files.write_lines(df, f"{tmp_path}/c", "csv", one_file=True)
    assert spark.read.json(f"{tmp_path}/j").count() == 2 and files.read_csv(spark, f"{tmp_path}/c").columns == ["id", "t"]
    files.write_vectors(df, f"{tmp_path}/v", ("m1", "m2"), "id")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/v").filter("embedding_model = 'm2'").collect()) == ["1_EMB_m2", "2_EMB_m2"]
    made = []

    def make(d):
        made.append(1)
        return d.withColumn("u", F.upper("t"))

    for d in (df, df.orderBy(F.desc("id")), df.filter("id = 1")):
        files.kept_table(d, f"{tmp_path}/kept", ["id", "t"], "upper", make)
    assert len(made) == 2
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "x.bin").write_bytes(b"abc")
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert files.verified(spark, f"{tmp_path}/data", {"x.bin": digest}).first().bytes == 3
    with pytest.raises(ValueError):
        files.verified(spark, f"{tmp_path}/data", {"x.bin": "0"})


def test_metrics_of_every_combination(spark):
    """A text shows metrics unless it tells of limits alone: by name, by context with a value or a test, or by a precision with a value."""
    parts = {"limit": "边界", "strong": "recall", "iou": "iou", "value": "97.2%", "bare": "召回", "told": "提升", "test": "测试", "precision": "精度", "no": "无法保证"}
    rows = [[k for i, k in enumerate(parts) if n >> i & 1] for n in range(2 ** len(parts))]
    df = spark.createDataFrame([(r, " | ".join(parts[k] for k in r)) for r in rows], "r array<string>, t string")
    got = df.select("r", A.once(F.col("t"), lambda raw, f: A.shows(raw, f)["accuracy_metric"]).alias("ok")).collect()
    for r, ok in got:
        has = set(r).__contains__
        alone = (has("limit") or has("no")) and not has("strong") and not has("told")
        spoken = (has("bare") or has("told")) and (has("value") or has("test"))
        assert ok == (not alone and (has("strong") or has("iou") or spoken or has("precision") and has("value") and not has("no")))


def test_texts_signs_are_made_once(spark, tmp_path):
    from loomspan.plans import catalog

    rows = [(1, "Acc 97.5 % of\tall\x0b\f\r\n runs", "en", "a", 9), (2, None, None, None, 0), (3, "map 0.5", "en", "a", 7), (4, "1.0 top 1", "en", "a", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = catalog.QUERIES["retrieval_boosts"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ppi|ap|iou)") == 1 and "regexp_replace" not in plan
    assert out.count() == 4
    same = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(
        (A.flat(F.col("text")) == F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", "")).alias("flat"), (A.has_value(F.coalesce("text", F.lit(""))) == F.coalesce("text", F.lit("")).rlike(A.METRIC_VALUE)).alias("value")
    )
    assert {tuple(r) for r in same.collect()} == {(True, True)}
