"""From a question to terms, field constraints and wishes, and from these to column expressions that score table rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII = r"[A-Za-z0-9][A-Za-z0-9_.:/+-]+"
#: Words of questions that are no terms of their own.
STOPWORDS = frozenset((
    "请问", "请帮", "帮我", "帮忙", "找出", "推荐", "相关", "是否", "有没有", "哪个", "哪些", "什么", "怎么", "多少", "几个", "现在", "目前", "总共", "共有", "一共",
    "适配", "支持", "平台", "模型", "算法", "识别", "检测", "分类", "记录", "信息", "部门", "实现", "我要", "能用", "检测用", "用什么",
))
#: Words that end the value of a field constraint.
VALUE_ENDS = ("算法", "模型", "记录", "数量", "多少", "几个", "几款", "哪些", "有哪些", "清单", "列表", "一共", "总共", "共有", "部署", "发布")
#: Words that tell a wish, names of fields a value is asked of, and phrases that ask for a value.
WISHES: dict[str, tuple[str, ...]] = {
    "oid": ("oid",), "deployment": ("部署", "did", "rid", "平台", "上线"),
    "recommendation": ("推荐", "识别是否", "能用", "请帮忙", "哪个模型", "用哪个", "用什么模型", "什么模型", "模型是哪一个", "模型是哪款", "该用什么"),
    "count": ("多少个", "多少款", "多少种", "有多少", "几个", "数量", "统计", "总共", "共有", "一共"),
    "list": ("哪些", "有哪些", "有什么", "找出", "清单", "列表"), "latest": ("最新", "目前", "现在"),
    "precise": ("高精度", "准确率", "更高精度"), "general": ("通用",), "light": ("轻量", "轻量一点", "小模型"),
}
CHOICE_NOUNS, CHOICE_WORDS = ("模型", "方案"), ("哪一个", "哪款", "可用", "现用", "现在用", "目前用")
VALUE_FIELDS, VALUE_PHRASES = ("特征维度", "维度", "oid", "负责人", "owner", "推荐配置", "supported_device", "平台"), ("是多少", "是什么", "是谁", "哪一个", "哪个")
CURRENT_WORDS = ("现用", "当前", "现在", "目前", "应该用", "推荐")
PLATFORM = r"(?:cuda[\w.-]*t4|t4|p4|l4|a2|710|ascend\d+|acl-[\w.-]+|cpu-[\w.-]+)"
TARGET_FIELDS, ALGORITHM_FIELDS = ("目标名称", "目标", "target_name"), ("算法名称", "算法类型", "算法", "algorithm_name", "algorithm_type")
#: What ends the part of a question that names its subject, and kinds of subjects.
HEAD_ENDS = ("在哪些情况下", "哪些情况下", "什么情况下", "精度如何", "精度怎么样", "输入输出", "用哪个模型", "是什么", "有哪些")
HEAD_TAIL, SUBJECTS = r"(的)?(精度|输入|输出|边界|限制|模型文件|oid|OID|部署|负责人).*$", ("模型", "算法", "检测", "识别", "分类", "属性", "安全绳")
MENTIONS = (r"([A-Za-z][A-Za-z0-9_.+-]*(?:\s+v?\d+(?:\.\d+){1,3})?)", r"([一-鿿A-Za-z0-9_+-]{2,}(?:模型|算法|检测|识别|分类|属性))")
#: Words without meaning as focus terms, and what is cut off terms that must stand in a row's main fields.
FOCUS_STOPS = frozenset(("模型", "算法", "检测", "识别", "分类", "属性", "哪些", "有什么", "有什", "什么", "列表", "清单", "推荐", "相关"))
MAIN_STOPS = frozenset(("检测", "识别", "分类", "模型", "算法", "有什么", "什么", "哪些", "有哪些"))
ASKING = "有什么|有哪些|哪些|什么|多少|几个|几款|推荐|用哪个|用什么"
KIND_TAIL = r"(检测|识别|分类|属性|模型|算法)+$"
#: Weights of fields that hold a term, and texts that stand for no identifier.
FIELD_WEIGHTS = {"target_name": 1.9, "algorithm_type": 1.35, "algorithm_name": 1.75, "application_scene": 0.8, "model_name": 0.85, "label_list": 0.75}
NO_OID = ("无", "null", "none", "nan", "未记录")
CARDS = ("t4", "p4", "l4", "a2")


def unique(values: Iterable[str], stops: Iterable[str] = (), least: int = 1, most: int | None = None) -> list[str]:
    """Values in order, each once, without stop words and shorter ones."""
    return [v for v in dict.fromkeys(values) if len(v) >= least and v not in stops][:most]


def expanded_terms(question: str, extra: Sequence[str] = ()) -> list[str]:
    """The question itself, its ASCII words and further terms, each once."""
    return unique(t for t in (question, *re.findall(ASCII, question), *extra) if t.strip())


def question_terms(question: str, extra: Sequence[str] = (), most: int = 48) -> list[str]:
    """Lower-case terms of a question: ASCII words, further terms with the words in them, CJK runs and their parts of two to six characters."""
    found = re.findall(ASCII, question)
    for term in extra:
        found += [term.strip(), *re.findall(ASCII, term)]
    for run in re.findall("[一-鿿]{2,}", question):
        found += [run] if len(run) <= 8 else []
        found += [run[i : i + n] for n in range(2, min(6, len(run)) + 1) for i in range(len(run) - n + 1)]
    return unique((t.lower() for t in found), STOPWORDS, 2, most)


def field_values(question: str, names: Sequence[str]) -> list[str]:
    """Values that a question sets for a field: ``name is value``. White space and punctuation around a value do not belong to it, nor
    what follows a word for the kind of thing asked for."""
    sign = rf"(?:{'|'.join(map(re.escape, names))})\s*(?:为|是|=|:|：|包含|包括)\s*([A-Za-z0-9_.:/+-]+|[一-鿿、A-Za-z0-9_.:/+-]+)"
    out = []
    for value in re.findall(sign, question, re.IGNORECASE):
        value = value.strip(" \t\n:：=,，。；;？?")
        for end in VALUE_ENDS:
            value = value[: value.find(end)].strip() if value.find(end) > 0 else value
        out.append(value.removesuffix("的").strip())
    return unique(out, STOPWORDS)


def mentioned(question: str, terms: Sequence[str]) -> list[str]:
    """Names of subjects in a question, at most eight: what stands before it asks, names with versions, CJK names of models; else its longer terms."""
    head = question.strip()
    cut = next((head.find(p) for p in HEAD_ENDS if head.find(p) > 0), len(head))
    head = re.sub(HEAD_TAIL, "", head[:cut]).strip(" 的？?，,。")
    found = [head] if 2 <= len(head) <= 40 and any(s in head for s in SUBJECTS) else []
    found += [m.strip(" 的？?，,。") for p in MENTIONS for m in re.findall(p, question.strip()) if m.strip(" 的？?，,。") not in STOPWORDS]
    return unique(found or [t for t in terms[:6] if len(t) >= 3], most=None)[:8]


@dataclass(frozen=True)
class Question:
    """A question with what it says of rows. ``terms`` count wherever they stand, ``targets``, ``algorithms``, ``models`` and ``platforms`` bind their fields."""

    text: str
    terms: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    algorithms: list[str] = field(default_factory=list)
    models: list[str] = field(default_factory=list)
    platforms: list[str] = field(default_factory=list)
    mentions: list[str] = field(default_factory=list)
    wishes: frozenset[str] = frozenset()
    extra: tuple[str, ...] = ()

    @property
    def structured(self) -> bool:
        """Whether it can be answered from table rows."""
        return bool(self.wishes & {"oid", "deployment", "recommendation", "count", "list", "latest"} or self.targets or self.algorithms or self.models or self.platforms)

    def focus(self) -> list[str]:
        """Terms that rows are looked for by, at most 24, without white space: constraints, subjects with and without their kind, terms."""
        names = [x for m in self.mentions for x in (m, re.sub("(检测|识别|分类|属性|特征)?(模型|算法)?$", "", m).strip())]
        every = (*self.targets, *self.algorithms, *self.models, *names, *self.terms, *self.extra)
        return unique((re.sub(r"\s+", "", t.lower()) for t in every), FOCUS_STOPS, 2, 24)

    def main(self) -> list[str]:
        """CJK terms one of which must stand in a table row's target, algorithm or scene, at most eight."""
        heads = [x for m in self.mentions for x in (m, re.sub(r"(有什么|有哪些|什么|哪些|模型|算法|检测|识别|分类|属性|的|吗|么|？|\?)+$", "", m))]
        asked = re.sub("(检测|识别|分类|属性|模型|算法|的)+$", "", re.split(ASKING, self.text, maxsplit=1)[0].strip(" 的？?，,。"))
        every = (re.sub(KIND_TAIL, "", re.sub(r"\s+", "", t.lower())) for t in (*self.targets, *self.algorithms, *heads, asked))
        return unique((t for t in every if re.search("[一-鿿]", t)), MAIN_STOPS, 2, 8)


def understand(text: str, extra: Sequence[str] = ()) -> Question:
    """What a question asks for."""
    low, terms = text.lower(), question_terms(text, extra)
    says = lambda words: any(w in low for w in words)
    wishes = {w for w, words in WISHES.items() if says(words)}
    if says(CHOICE_NOUNS) and says(CHOICE_WORDS):
        wishes.add("recommendation")
    if says(VALUE_FIELDS) and says(VALUE_PHRASES):
        wishes.discard("count")
    if wishes & {"latest", "recommendation"} or any(w in re.sub(r"\s+", "", low) for w in CURRENT_WORDS):
        wishes.add("current")
    version = re.search(r"([A-Za-z][A-Za-z0-9_.-]*\d+\.\d+\.\d+[A-Za-z0-9_.-]*)", text)
    return Question(
        text, terms, field_values(text, TARGET_FIELDS), field_values(text, ALGORITHM_FIELDS), [version[1]] if version else [],
        unique(re.findall(PLATFORM, low)), mentioned(text, terms), frozenset(wishes), tuple(extra),
    )


def any_of(value: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(value, F.lit(w.lower()))
    return out


def on_platform(value: Column, platforms: Sequence[str]) -> Column:
    """Whether a platform is named: a card between signs or at an end, other names anywhere."""
    out = F.lit(False)
    for p in platforms:
        out = out | (value.rlike(rf"(?:^|[-_/]){re.escape(p)}(?:$|[-_/])") if p in CARDS else F.contains(value, F.lit(p)))
    return out


def once(values: Mapping[str, Column], make: Callable[[Column], Column]) -> Column:
    """``make`` of values that are made once a row, as the item of an array of one."""
    return F.transform(F.array(F.struct(*[c.alias(name) for name, c in values.items()])), make)[0]


def term_worths(terms: Sequence[str], row: Column) -> Column:
    """For each term the weights of the fields that hold it, more for longer terms (3 more where a word of four signs or more is in the
    model's name), whether it stands anywhere, and whether it has three characters or more."""
    given = [F.struct(F.lit(t).alias("term"), F.lit(1 + min(len(t), 8) * 0.06).alias("more"), F.lit(3.0 if re.search("[a-z0-9_+-]{4,}", t) else 0.0).alias("name"), F.lit(len(t) >= 3).alias("long")) for t in terms]

    def worth(t: Column) -> Column:
        has = lambda f: F.when(t["term"] == "struct", row[f].rlike("(?<![a-z0-9])struct(?![a-z0-9])")).otherwise(F.contains(row[f], t["term"]))
        every = [F.when(has(f), t["more"] * w + (t["name"] if f == "model_name" else 0.0)).otherwise(0.0) for f, w in FIELD_WEIGHTS.items()]
        return F.struct(sum(every, F.lit(0.0)).alias("worth"), F.contains(row["full"], t["term"]).alias("stands"), t["long"].alias("long"))

    return F.transform(F.array(*given), worth) if given else F.array().cast("array<struct<worth: double, stands: boolean, long: boolean>>")


def row_score(q: Question, fields: Mapping[str, Column], source: str) -> Column:
    """How well a row answers a question, 0 if not at all.

    ``fields`` may have the fields with weights and platform, oid, count; ``full`` is all of a row's text. Terms give the weights of their
    fields, or a quarter where they stand elsewhere; bound fields give four to five; then come rules on what is wished. A row
    is worth nothing where a bound field that the wish needs is another, or where nothing of the question but a wish holds.
    """
    if not q.structured:
        return F.lit(0.0)
    none = F.lit("")
    value = lambda f: F.coalesce(fields[f].cast("string"), none) if f in fields else none
    row = {f: F.lower(value(f)) for f in (*FIELD_WEIGHTS, "platform", "full")} | {"oid": F.lower(F.trim(value("oid"))), "count": F.trim(value("count"))}
    return once(row, lambda r: score_of(q, r, source))


def score_of(q: Question, r: Column, source: str) -> Column:
    wish, says, table = q.wishes.__contains__, q.text.__contains__, source == "table"
    bound = {
        "target": (q.targets, any_of(r["target_name"], q.targets), 4.0, wish("oid") or wish("count") or wish("list")),
        "algorithm": (q.algorithms, any_of(r["algorithm_name"], q.algorithms) | any_of(r["algorithm_type"], q.algorithms), 4.0, wish("oid") or says("检测")),
        "platform": (q.platforms, on_platform(r["platform"], q.platforms), 3.0, wish("deployment") or wish("oid")),
    }
    terms = [t for t in q.terms if t != q.text.lower() and t not in ("rd", "t4", "p4", "l4")]
    held = sum((F.when(ok, w).otherwise(0.0) for words, ok, w, _ in (bound["target"], bound["algorithm"], (q.models, any_of(r["model_name"], q.models), 4.5 + 5.0, False)) if words), F.lit(0.0))
    told = lambda x: F.when(x["worth"] > 0, x["worth"]).when(x["stands"] & x["long"], 0.25).otherwise(0.0)
    short = lambda x: F.when((x["worth"] == 0) & x["stands"] & ~x["long"], 0.25).otherwise(0.0)
    total = lambda worths, of: F.aggregate(worths, F.lit(0.0), lambda s, x: s + of(x))
    sums = once({"w": term_worths(terms, r)}, lambda z: F.struct((total(z["w"], told) + held).alias("meaning"), total(z["w"], short).alias("rest")))
    known = (r["oid"] != "") & ~r["oid"].isin(*NO_OID)
    kinds, name = F.concat(r["algorithm_name"], r["algorithm_type"]), F.concat_ws(" ", r["model_name"], r["algorithm_name"])
    large, base, small = (F.contains(name, F.lit(w)) for w in ("large", "base", "small"))
    plain = wish("general") and not wish("precise")
    rules: list[tuple[bool, Column, float]] = [
        (bool(q.platforms), bound["platform"][1], 3.0), (table and says("识别"), ~F.contains(kinds, F.lit("识别")), -3.0), (table and says("特征"), ~F.contains(F.concat(kinds, r["model_name"]), F.lit("特征")), -3.0),
        (wish("oid"), known, 2.0 if says("识别") else 5.0), (wish("oid") and not says("识别"), ~known, -3.0), (wish("deployment") and not table, F.lit(True), 1.5), (wish("recommendation") and table, F.lit(True), 1.0),
        (table and wish("current"), r["count"] == "1", 4.0), (table and wish("current"), r["count"] == "0", -4.0),
        (wish("precise"), large, 1.8), (wish("precise"), base & ~large, -0.8), (plain, base, 0.9), (plain, large, -0.4), (wish("light"), small | base, 1.3), (wish("light"), large, -0.8),
    ]
    extra = sum((F.when(ok, w).otherwise(0.0) for applies, ok, w in rules if applies), F.lit(0.0))
    out = [(r["model_name"] == "") & (F.lit(not table) | ((r["target_name"] == "") & (r["algorithm_name"] == "")))]
    out += [~ok for words, ok, _, needed in bound.values() if words and needed]

    def score(m: Column) -> Column:
        wrong = any_true([*out, *([] if wish("count") else [m["s"]["meaning"] <= 0])])
        return F.when(wrong, 0.0).otherwise(F.greatest(m["s"]["meaning"] + m["s"]["rest"] + extra, F.lit(0.0)))

    return once({"s": sums}, score)


def any_true(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def list_score(q: Question, fields: Mapping[str, Column], source: str) -> Column:
    """How well a row fits a question for a list of models: 0 without a model, or in a table without any of the question's main terms in its main fields."""
    row = {f: F.lower(F.coalesce(fields[f].cast("string"), F.lit(""))) if f in fields else F.lit("") for f in FIELD_WEIGHTS}
    return once(row, lambda r: list_score_of(q, r, source)) if q.focus() else F.lit(0.0)


def list_score_of(q: Question, r: Column, source: str) -> Column:
    text, table, main = F.concat_ws("\n", *[r[f] for f in FIELD_WEIGHTS]), source == "table", q.main() if source == "table" else []
    heads = F.concat_ws("\n", r["target_name"], r["algorithm_name"], r["application_scene"])
    places = [("target_name", 4.0), ("algorithm_name", 3.0)] if table else [("model_name", 2.5), ("label_list", 2.0)]
    count = lambda terms: F.size(F.filter(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: F.contains(heads, t)))

    def worth(s: Column, t: Column) -> Column:
        best = F.when(F.contains(text, t), 0.8).otherwise(0.0)
        for f, w in reversed(places):
            best = F.when(F.contains(r[f], t), w).otherwise(best)
        return s + best

    score = F.aggregate(F.array(*map(F.lit, q.focus())), F.lit(0.0), worth) + (count(main) + 6.0 if main else 0.0)
    if table and "检测" in q.text:
        score = score + F.when(F.contains(F.concat(r["algorithm_type"], r["algorithm_name"]), F.lit("检测")), 1.0).otherwise(0.0)
    if not table:
        score = score + F.when(any_of(text, ("fire", "smoke", "firesmog")), 0.4).otherwise(0.0)
    return F.when((r["model_name"] == "") | (F.lit(bool(main)) & (count(main) == 0)), 0.0).otherwise(score)
