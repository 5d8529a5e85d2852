from pyspark.sql import functions as F

from loomspan.functions import questions as Q
from loomspan.operators import structured_search as S


def test_terms_of_questions():
    assert Q.question_terms("请问 Fire-net2 的安全绳检测, X a", ["Extra Word", " "]) == ["fire-net2", "extra word", "extra", "word", "的安全绳检测", "的安", "安全", "全绳", "绳检", "的安全", "安全绳", "全绳检", "绳检测", "的安全绳", "安全绳检", "全绳检测", "的安全绳检", "安全绳检测"]
    assert len(Q.question_terms("一二三四五六七八九十" * 9)) == 48 and Q.question_terms("") == [] and Q.question_terms("模型") == []
    assert Q.expanded_terms("red bolt", ["bolt", "x"]) == ["red bolt", "red", "bolt", "x"]
    assert Q.field_values("目标名称为安全绳的模型, 目标: red；算法名称=det-2", Q.TARGET_FIELDS) == ["安全绳", "red"]


def test_wishes_and_constraints():
    q = Q.understand("算法名称=det-2 部署在 cuda11-T4 的模型 firenet1.2.3 有多少个")
    assert q.algorithms == ["det-2"] and q.models == ["firenet1.2.3"] and q.platforms == ["cuda11-t4"] and q.wishes == {"deployment", "count"} and q.structured
    assert "count" not in Q.understand("几个模型的 oid 是多少").wishes and "oid" in Q.understand("几个模型的 oid 是多少").wishes
    assert {"recommendation", "current"} <= Q.understand("该方案现用的是哪款").wishes and not Q.understand("hello there").structured
    assert Q.understand("安全绳检测模型精度如何").mentions[0] == "安全绳检测模型" and Q.understand("安全帽检测有哪些").main() == ["安全帽"]
    assert Q.understand("red bolt").focus() == ["red", "bolt"] and Q.understand("red bolt").main() == []


ROWS = [
    (1, "安全绳", "属性识别", "det", "fire_large", "on-t4-x", "abc", "1"), (2, "安全绳", "属性识别", "det", "fire_base", "on-t40", "无", "0"), (3, "车辆", "属性", "det", "struct", "t4", "abc", "1"), (4, "", "", "x", "", "t4", "", "1"),
    (5, "安全绳", None, None, None, None, None, None),
]
COLS = ("target_name", "algorithm_name", "algorithm_type", "model_name", "platform", "oid", "count")


def scores(spark, text, source="table"):
    df = spark.createDataFrame(ROWS, "id int, " + ", ".join(f"{c} string" for c in COLS))
    got = df.select("id", F.round(Q.row_score(Q.understand(text), {c: F.col(c) for c in COLS}, source), 4).alias("s")).collect()
    return {r.id: r.s for r in got}


def test_rules_of_rows(spark):
    assert scores(spark, "hello") == dict.fromkeys(range(1, 6), 0.0)
    term = round(1.9 * (1 + 2 * 0.06), 4)
    parts = 2 * term + round(1.9 * (1 + 3 * 0.06), 4)  # 安全, 全绳, 安全绳
    by_target = scores(spark, "目标=安全绳")
    assert by_target[3] == by_target[4] == 0 and by_target[5] == by_target[1] == round(parts + 4, 4)
    on_card = scores(spark, "目标=安全绳 oid t4")
    assert on_card[2] == 0 and on_card[1] > on_card[5] == 0  # another platform, or none
    wanted = scores(spark, "目标=安全绳 oid")
    assert round(wanted[1] - by_target[1], 4) == 5.0 and round(wanted[2] - by_target[2], 4) == -3.0
    now = scores(spark, "目标=安全绳 现在")
    assert round(now[1] - by_target[1], 4) == 4.0 and round(now[2] - by_target[2], 4) == -4.0
    assert scores(spark, "目标=安全绳", "deployment")[5] == 0  # a deployment has a model
    sizes = scores(spark, "目标=安全绳 高精度")
    assert round(sizes[1] - by_target[1], 4) == 1.8 and round(sizes[2] - by_target[2], 4) == -0.8
    light, general = scores(spark, "目标=安全绳 轻量"), scores(spark, "目标=安全绳 通用")
    assert round(light[1] - by_target[1], 4) == -0.8 and round(light[2] - by_target[2], 4) == 1.3 and round(general[2] - by_target[2], 4) == 0.9 and round(general[1] - by_target[1], 4) == -0.4
    assert scores(spark, "数量 zzz")[1] == 0.0 and scores(spark, "fire 清单")[1] == round(0.85 * (1 + 4 * 0.06) + 3, 4) and scores(spark, "struct 清单")[3] > 0


def test_lists_and_values(spark):
    df = spark.createDataFrame([*ROWS, (6, "安全绳", "属性识别", "det", "fire_large", "p4", "zzz", "1")], "id int, " + ", ".join(f"{c} string" for c in COLS))
    use = {c: F.col(c) for c in COLS}
    got = S.model_list(df, Q.understand("安全绳识别模型有哪些"), use, "table", "id", [F.col("model_name")], 5).collect()
    assert [(r.id, r.found) for r in got] == [(1, 2), (2, 2)]
    assert S.model_list(df, Q.understand("安全绳"), use, "table", "id", [F.col("model_name")], 5).count() == 0
    values = S.field_lookup(df, Q.understand("目标=安全绳 fire_large oid 现在"), use, "table", F.col("oid"), "id").collect()
    assert [(r.value, r.support) for r in values] == [("abc", 1), ("zzz", 1)] and values[0].score == values[1].score
    assert [r.id for r in S.ranked_rows(df, Q.understand("目标=安全绳 fire_large oid"), use, "table", "id", F.lit(None).cast("date"), 2).collect()] == [1, 6]
