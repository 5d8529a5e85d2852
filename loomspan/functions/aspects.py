"""What a chunk of text is about, how well it answers a question, and the boosts that follow, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.rules import has_any

#: Aspects in the order in which they are listed, and the phrases (of text without white space, lower case) that show them.
PHRASES: dict[str, tuple[str, ...]] = {
    "limitation": ("算法边界", "边界", "前提条件", "场景要求", "目标要求", "无法保证", "不能保证", "暂时无法保证", "适用场景", "要求：", "要求:"),
    "accuracy_metric": (),
    "input_output": ("输入：", "输入:", "输出：", "输出:", "模型输入", "模型输出", "预测分类结果"),
    "model_artifact": ("模型文件列表", "模型列表", "oid", "特征维度"),
    "deployment": ("部署", "did", "rid", "release_id", "deployment", "部署地址"),
    "release_change": ("release", "highlight", "优化", "追加", "提升", "相比", "版本", "掉点"),
    "label_schema": ("标签解释", "label", "类别标签", "检测类别", "分类标签"),
    "performance_latency": ("性能测试", "模型性能", "推理耗时", "耗时", "内存占用", "设备占用", "吞吐"),
    "owner_metadata": ("owner", "负责人", "发布时间", "更新时间", "最近更新时间"),
}
#: Patterns that show an aspect in the text as it is. A word stands between characters that are no letters, digits or underscores.
_WORD = r"(?i)(?:^|[^\p{L}\p{N}_])(?:%s)(?:$|[^\p{L}\p{N}_])"
STRONG_METRIC = _WORD % r"acc|accuracy|macc|mprec|ma|map|top\s*-?\s*1|top\s*-?\s*5|precision|recall|f1(?:-score)?|auc|tar|far|fppi|ap"
ANY_METRIC = _WORD % r"acc|accuracy|macc|mprec|ma|map|top\s*-?\s*1|top\s*-?\s*5|precision|recall|f1(?:-score)?|auc|tar|far|fppi|ap|iou"
METRIC_VALUE = r"(?:^|[^\p{L}\p{N}_])(?:\d+(?:\.\d+)?\s*%|0\.\d+(?:$|[^\p{L}\p{N}_])|1\.0+(?:$|[^\p{L}\p{N}_]))|\+\d+(?:\.\d+)?\s*%"
PATTERNS: dict[str, tuple[str, ...]] = {
    "model_artifact": (r"(?i)\.(?:model|onnx|pt|pth|safetensors)(?:$|[^\p{L}\p{N}_])", _WORD % "[0-9a-f]{32,}", _WORD % "cuda|trt|acl|ascend|cpu|ppl|nart|fp16|fp32|int8|t4|p4|l4"),
    "label_schema": (r'"[A-Za-z0-9_+-]{3,}"',),
    "performance_latency": (_WORD % "ms|qps",),
}
#: Phrases that tell metrics, those of them that do not by themselves make a text about limits one about metrics, and words of tests.
METRIC_CONTEXT = ("准确率", "召回", "指标", "评测", "测试集", "测试结果", "模型精度", "精度测试", "无掉点", "提升", "下降")
BARE_CONTEXT = ("准确率", "召回", "测试集")
METRIC_TEST = ("指标", "评测", "测试")
#: Fields whose presence in a table row shows an aspect.
TABLE_FIELDS = {
    "owner_metadata": ("owner", "负责人(人员)", "last_updated", "最近更新时间"),
    "model_artifact": ("oid", "OID", "model_name", "模型名称", "supported_device", "recommended_config"),
    "label_schema": ("label_list", "labels"),
}
BOUNDARY, BOUNDS, EVALUATION = ("无法保证", "算法边界", "前提条件", "场景要求", "目标要求"), ("无法保证", "边界", "前提条件", "场景要求", "目标要求"), ("精度测试", "模型精度", "测试结果", "评测")
#: An aspect that answers another one in part.
NEAR = {"accuracy_metric": "release_change", "release_change": "accuracy_metric", "model_artifact": "deployment"}


def flat(text: Column) -> Column:
    """Lower case without white space, each sign of which is taken out as it stands: a pattern takes ten times as long."""
    return reduce(lambda c, sign: F.replace(c, F.lit(sign), F.lit("")), " \t\n\x0b\f\r", F.lower(F.coalesce(text, F.lit(""))))


def once(text: Column, make: Callable[[Column, Column], Column]) -> Column:
    """``make`` of a text as it is and without white space; both are made once a row, as the item of an array of one."""
    given = F.struct(F.coalesce(text, F.lit("")).alias("raw"), flat(text).alias("flat"))
    return F.transform(F.array(given), lambda z: make(z["raw"], z["flat"]))[0]


def has_value(raw: Column) -> Column:
    """Whether a text has a metric's value; the pattern is looked for only where its signs are."""
    return has_any(raw, ("%", "0.", "1.0")) & raw.rlike(METRIC_VALUE)


def signs(raw: Column, f: Column) -> Column:
    """What all questions about a text ask of it, for a barrier to make once a row: a field for each aspect it shows, and ``value``."""
    return F.struct(*[ok.alias(name) for name, ok in shows(raw, f).items()], has_value(raw).alias("value"))


def shows(raw: Column, f: Column) -> dict[str, Column]:
    """For each aspect whether the text shows it.

    Metrics: a text that tells of limits alone shows none; any other one does by a metric's name, by a phrase that tells metrics
    with a value or a word of tests, or by a precision with a value that is not said to be beyond any guarantee.
    """
    out = {}
    for name, phrases in PHRASES.items():
        signs = [has_any(f, phrases)] if phrases else []
        signs += [raw.rlike(p) for p in PATTERNS.get(name, ())]
        out[name] = reduce(or_, signs, F.lit(False))
    value, speaks = has_value(raw), has_any(f, METRIC_CONTEXT)
    limits_alone = out["limitation"] & ~raw.rlike(STRONG_METRIC) & ~has_any(f, [p for p in METRIC_CONTEXT if p not in BARE_CONTEXT])
    precision = value & F.contains(f, F.lit("精度")) & ~F.contains(f, F.lit("无法保证"))
    out["accuracy_metric"] = F.when(limits_alone, False).when(raw.rlike(ANY_METRIC), True).when(speaks, value | has_any(f, METRIC_TEST)).otherwise(precision)
    return out


def chunk_aspects(text: Column, source: Column, fields: Column, made: Column | None = None) -> Column:
    """All aspects of a chunk, ``general`` if there is none: by its source (deployment, table, other) and the fields it holds, then by its text
    or its ``signs``, if they are made already."""
    by_source = [F.when(source == "deployment", "deployment"), F.when((source == "deployment") & F.array_contains(fields, "benchmark_info"), "accuracy_metric")]
    by_source += [F.when((source == "table") & F.arrays_overlap(fields, F.array(*map(F.lit, names))), aspect) for aspect, names in TABLE_FIELDS.items()]

    def found(raw: Column, f: Column) -> Column:
        return listed(shows(raw, f))

    def listed(shown: Mapping[str, Column]) -> Column:
        return F.array_distinct(F.array_compact(F.array(*by_source, *[F.when(ok, name) for name, ok in shown.items()])))

    none = F.array().cast("array<string>")
    named = once(text, found) if made is None else listed({name: made[name] for name in PHRASES})
    return F.transform(F.array(named), lambda a: F.when(a != none, a).otherwise(F.array(F.lit("general"))))[0]


def section_type(text: Column, aspects: Column, f: Column | None = None) -> Column:
    """The section a chunk belongs to: the first rule that holds. ``f`` is its text without white space, if that is made already."""
    has = lambda a: F.array_contains(aspects, F.lit(a))
    rules = lambda f: [
        (has("limitation") & has_any(f, BOUNDARY), "algorithm_boundary"), (has("accuracy_metric") & has_any(f, EVALUATION), "accuracy_eval"),
        (has("accuracy_metric") & has_any(f, PHRASES["release_change"]), "release_note"), (has("accuracy_metric"), "accuracy_metric"),
        (has("limitation"), "algorithm_boundary"), (has("input_output"), "input_output"), (has("model_artifact"), "model_artifact"), (has("deployment"), "deployment"),
        (has("label_schema"), "label_schema"), (has("performance_latency"), "performance_eval"), (has("owner_metadata"), "owner_metadata"), (has("release_change"), "release_note"),
    ]
    first = lambda f: F.coalesce(*[F.when(ok, name) for ok, name in rules(f)], F.lit("general"))
    return once(text, lambda _, f: first(f)) if f is None else first(f)


def answerability(aspect: str, text: Column, source: Column, aspects: Column, section: Column) -> Column:
    """How well a chunk answers a question of an aspect, -1 to 1.8: a base for having the aspect or one near it, and weighted signs."""
    if aspect == "general":
        return F.lit(0.0)
    return once(text, lambda raw, f: answer_score(aspect, {**shows(raw, f), "value": has_value(raw)}, f, source, aspects, section))


def answer_score(aspect: str, made: Column | Mapping[str, Column], f: Column, source: Column, aspects: Column, section: Column) -> Column:
    """``answerability`` from the signs of a text and the text without white space."""
    has = lambda a: F.array_contains(aspects, F.lit(a))
    base = F.when(has(aspect), 0.7).when(has(NEAR[aspect]) if aspect in NEAR else F.lit(False), 0.35).otherwise(-0.12)
    limits, measured = has("limitation"), has("accuracy_metric")
    weights: dict[str, list[tuple[Column, float]]] = {
        "accuracy_metric": [
            (made["accuracy_metric"], 0.5), (made["value"], 0.2), (section.isin("accuracy_eval", "release_note", "accuracy_metric"), 0.25),
            (limits & ~measured, -0.5), (limits & measured & F.contains(f, F.lit("无法保证")), -0.18), (has("label_schema") & ~measured, -0.22), (has("model_artifact") & ~measured, -0.25),
        ],
        "limitation": [(limits, 0.45), (has_any(f, BOUNDS), 0.35), (measured & ~limits, -0.3)],
        "deployment": [(source == "deployment", 0.35), (made["deployment"], 0.25)],
        "release_change": [(made["release_change"], 0.35), (made["accuracy_metric"], 0.12)],
        "input_output": [(made["input_output"], 0.45)],
        **{a: [(made[a], 0.35)] for a in ("model_artifact", "label_schema", "performance_latency")},
    }
    rows_miss = aspect in ("accuracy_metric", "limitation", "input_output", "label_schema", "release_change", "performance_latency")
    extra = [*weights.get(aspect, []), *([(source.isin("table", "deployment") & ~has(aspect), -0.2)] if rows_miss else [])]
    total = sum((F.when(ok, w).otherwise(0.0) for ok, w in extra), base)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.8), total))


def entity_score(terms: Sequence[str], text: Column, f: Column | None = None) -> Column:
    """How much of a question's entities a text names, at most 2: 1 for a name with a mark in it, 0.75 for five characters or more, else 0.45."""
    low, f = F.lower(F.coalesce(text, F.lit(""))), flat(text) if f is None else f
    worth = lambda t: 1.0 if set("_.-") & set(t) else 0.75 if len(t) >= 5 else 0.45
    each = [F.when(F.contains(low, F.lit(t)) | F.contains(f, F.lit(t)), worth(t)).otherwise(0.0) for t in terms]
    return F.least(F.lit(2.0), sum(each, F.lit(0.0)))


def lexical_boost(query: str, text: Column, source: Column) -> Column:
    """Boost for the field that a question names: feature dimension, model file list."""
    low, asks = F.lower(F.coalesce(text, F.lit(""))), "特征维度" in query
    has = lambda w: F.contains(low, F.lit(w))
    lists = asks or "oid" in query.lower() or "平台" in query
    rules = [(has("特征维度") & F.lit(asks), 0.32), (has("模型文件列表") & F.lit(lists), 0.12), ((source == "table") & ~has("特征维度") & F.lit(asks), -0.18)]
    return sum((F.when(ok, w).otherwise(0.0) for ok, w in rules), F.lit(0.0))


def aspect_boost(aspect: str, answer: Column, terms: Sequence[str], text: Column, f: Column | None = None) -> Column:
    """Boost by how well a chunk answers; little is left of it, and 0.65 is lost, where the question names entities and the chunk names none."""
    if aspect == "general":
        return F.lit(0.0)
    low, entity = F.lower(F.coalesce(text, F.lit(""))), entity_score(terms, text, f)
    near = answer * 0.38 + F.least(entity, F.lit(1.0)) * 0.18
    base = F.when(entity <= 0, answer * 0.02 - 0.65).otherwise(near) if terms else near
    metrics = ("acc", "precision", "recall", "f1", "map", "top1")
    extra: Mapping[str, list[tuple[Column, float]]] = {
        "accuracy_metric": [(has_any(low, (*metrics, "m/prec", "mprec", "ma")), 0.1), (F.contains(low, F.lit("无法保证")) & ~has_any(low, metrics), -0.24)],
        "limitation": [(has_any(low, BOUNDARY), 0.12)], "model_artifact": [(has_any(low, ("模型文件",)), 0.08)], "label_schema": [(has_any(low, ("标签解释", "label", "类别标签")), 0.08)],
    }
    return sum((F.when(ok, w).otherwise(0.0) for ok, w in extra.get(aspect, [])), base)


def structured_boost(query: str, terms: Sequence[str], fields: Column, platform: Column, source: Column, cards: Sequence[str] = ("t4", "p4", "l4")) -> Column:
    """Boost of table and deployment rows: 0.035 for each question term in their fields, at most 0.18, and 0.04 where both name a card."""
    low = F.lower(F.coalesce(fields, F.lit("")))
    used = [t.lower() for t in terms if t and t.lower() not in cards]
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in used), F.lit(0))
    card = has_any(F.lower(F.coalesce(platform, F.lit(""))), cards) if any(c in query.lower() for c in cards) else F.lit(False)
    boost = F.least(F.lit(0.18), 0.035 * hits) + F.when(card, 0.04).otherwise(0.0)
    return F.when(source.isin("table", "deployment") & (hits > 0), boost).otherwise(0.0)
