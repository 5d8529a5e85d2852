"""Questions answered from table rows: rows ranked, lists of models, values of a field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.questions import understand
from loomspan.operators import structured_search as S
from loomspan.plans.base import Registry

R = Registry()
RANKED = "目标名称为安全绳的 red bolt economy 目前 oid T4 高精度"
LISTED = "安全帽检测模型有哪些 red bolt"


def releases(part: DataFrame) -> DataFrame:
    """Parts as rows of a release table: targets, algorithms, models of several sizes, platforms, identifiers that may be missing."""
    pick = lambda c, n, *values: F.get(F.array(*map(F.lit, values)), (F.col(c) % n).cast("int"))
    model = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), pick("p_size", 4, "-large", "-base", "", "-small"))
    return part.select(
        "p_partkey", "p_retailprice", F.concat(pick("p_size", 3, "安全绳", "安全帽", "车辆"), F.lit(" "), F.col("p_name")).alias("target_name"), F.concat("p_type", F.lit("检测")).alias("algorithm_name"),
        F.col("p_brand").alias("algorithm_type"), F.when(F.col("p_partkey") % 10 == 0, "").otherwise(model).alias("model_name"), F.lower("p_type").alias("label_list"),
        pick("p_partkey", 3, "cuda11.0-trt7.1-int8-T4", "acl-ascend710", "").alias("platform"), F.when(F.col("p_partkey") % 4 == 0, "无").otherwise(F.md5(F.col("p_partkey").cast("string"))).alias("oid"),
        (F.col("p_partkey") % 3).cast("string").alias("count"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("updated"),
    )


_NAMES = ("target_name", "algorithm_name", "algorithm_type", "model_name", "label_list", "platform", "oid", "count")


def fields() -> dict:
    return {c: F.col(c) for c in _NAMES}


_REL = """r AS (SELECT p_partkey, p_retailprice, (['安全绳', '安全帽', '车辆'])[p_size % 3 + 1] || ' ' || p_name AS target_name, p_type || '检测' AS algorithm_name, p_brand AS algorithm_type, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE replace(p_name, ' ', '_') || (['-large', '-base', '', '-small'])[p_size % 4 + 1] END AS model_name,
lower(p_type) AS label_list, (['cuda11.0-trt7.1-int8-T4', 'acl-ascend710', ''])[p_partkey % 3 + 1] AS platform, CASE WHEN p_partkey % 4 = 0 THEN '无' ELSE md5(p_partkey::VARCHAR) END AS oid, (p_partkey % 3)::VARCHAR AS cnt, DATE '2024-01-01' + p_size AS updated FROM part),
l AS (SELECT *, lower(target_name) AS tn, lower(algorithm_name) AS an, lower(algorithm_type) AS ak, lower(model_name) AS mn, lower(concat_ws(chr(10), target_name, algorithm_name, algorithm_type, model_name, label_list, platform, oid, cnt)) AS f FROM r)"""
#: The terms of the ranked question, written out: words, then parts of its CJK runs of two to six characters without stop words.
_TERMS = ["red", "bolt", "economy", "oid", "目标", "标名", "名称", "称为", "为安", "安全", "全绳", "绳的", "目标名", "标名称", "名称为", "称为安", "为安全", "安全绳", "全绳的", "目标名称", "标名称为", "名称为安", "称为安全", "为安全绳", "安全绳的",
          "目标名称为", "标名称为安", "名称为安全", "称为安全绳", "为安全绳的", "目标名称为安", "标名称为安全", "名称为安全绳", "称为安全绳的", "高精度", "高精", "精度"]


def _worth(t: str) -> str:
    more = 1 + min(len(t), 8) * 0.06
    weights = [("tn", 1.9 * more), ("ak", 1.35 * more), ("an", 1.75 * more), ("mn", 0.85 * more + (3 if t.isascii() and len(t) >= 4 else 0)), ("label_list", 0.75 * more)]
    return "(" + " + ".join(f"CASE WHEN contains({c}, '{t}') THEN {w}::DOUBLE ELSE 0 END" for c, w in weights) + ")"


_MEANING = " + ".join(f"CASE WHEN {_worth(t)} > 0 THEN {_worth(t)} WHEN contains(f, '{t}') AND {len(t) >= 3} THEN 0.25 ELSE 0 END" for t in _TERMS)
_ELSE = " + ".join(f"CASE WHEN {_worth(t)} = 0 AND contains(f, '{t}') THEN 0.25::DOUBLE ELSE 0 END" for t in _TERMS if len(t) < 3)
_SCORED = f"""{_REL}, m AS (SELECT *, {_MEANING} + CASE WHEN contains(tn, '安全绳') THEN 4.0 ELSE 0 END AS meaning, {_ELSE} AS rest, mn || ' ' || an AS nm FROM l),
s AS (SELECT *, CASE WHEN NOT contains(tn, '安全绳') OR NOT regexp_matches(lower(platform), '(^|[-_/])t4($|[-_/])') OR meaning <= 0 THEN 0.0 ELSE round(greatest(0, meaning + rest + 3.0 + CASE WHEN oid NOT IN ('', '无') THEN 5.0 ELSE -3.0 END + CASE cnt WHEN '1' THEN 4.0 WHEN '0' THEN -4.0 ELSE 0 END
+ CASE WHEN contains(nm, 'large') THEN 1.8 WHEN contains(nm, 'base') THEN -0.8 ELSE 0 END), 6) END AS score FROM m)"""


@R.add("structured_rows_ranked", f"WITH {_SCORED} SELECT p_partkey, score::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, cnt = '1' DESC, updated DESC, p_partkey LIMIT 30")
def structured_rows_ranked(t):
    return S.ranked_rows(releases(t("part")), understand(RANKED), fields(), "table", "p_partkey", F.col("updated"), 30).select("p_partkey", "score")


@R.add("structured_field_lookup", f"WITH {_SCORED}, p AS (SELECT score, oid AS value, count(*) AS support FROM s WHERE score > 0 AND oid <> '' GROUP BY 1, 2) SELECT value, score::DOUBLE AS score, support FROM p WHERE score = (SELECT max(score) FROM p) ORDER BY support DESC, value LIMIT 20")
def structured_field_lookup(t):
    return S.field_lookup(releases(t("part")), understand(RANKED), fields(), "table", F.col("oid"), "p_partkey")


#: The focus terms of the question for a list, written out.
_FOCUS = ["安全帽检测模型", "安全帽", "red", "bolt", "安全", "全帽", "帽检", "测模", "型有", "有哪", "全帽检", "帽检测", "检测模", "测模型", "模型有", "型有哪", "有哪些", "安全帽检", "全帽检测", "帽检测模", "检测模型", "测模型有", "模型有哪", "型有哪些"]
_LIST = " + ".join(f"CASE WHEN contains(tn, '{x}') THEN 4.0::DOUBLE WHEN contains(an, '{x}') THEN 3.0 WHEN contains(concat_ws(chr(10), ak, mn, label_list), '{x}') THEN 0.8 ELSE 0 END" for x in _FOCUS)


@R.add("structured_model_list", f"""WITH {_REL}, s AS (SELECT *, round(7.0::DOUBLE + {_LIST} + 1.0, 6) AS score FROM l WHERE mn <> '' AND (contains(tn, '安全帽') OR contains(an, '安全帽'))),
d AS (SELECT *, row_number() OVER (PARTITION BY model_name, platform ORDER BY score DESC, p_partkey) AS r FROM s) SELECT p_partkey, score, count(*) OVER () AS found FROM d WHERE r = 1 ORDER BY score DESC, p_partkey LIMIT 12""")
def structured_model_list(t):
    return S.model_list(releases(t("part")), understand(LISTED), fields(), "table", "p_partkey", [F.col("model_name"), F.col("platform")], 12).select("p_partkey", "score", "found")
