"""JSON in texts, decisions, scores written as text, boxed answers, boxes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a full or an empty score, keys whose values are hidden, decision kinds.
YES, NO = ("true", "1", "yes", "y"), ("false", "0", "no", "n", "")
SECRET_KEYS = ("api_key", "apikey", "authorization", "password", "secret", "token")
KINDS = ("tool", "clarify", "end")


def objects_in(text: str) -> Iterator[str]:
    """Each JSON object that starts at an opening brace outside the objects found before."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            end = at + 1
        else:
            if isinstance(value, dict):
                yield text[at:end]
        at = text.find("{", end)


def first_object(c: Column) -> Column:
    """The first JSON object inside a text, as JSON; null if there is none. Balanced braces are beyond regular expressions, hence Arrow batches."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: next(objects_in(t), None) if t else None)

    return find(c)


def mended_object(c: Column) -> Column:
    """Like ``first_object``, after code fences and commas before closing brackets are taken out."""
    bare = F.regexp_replace(c, r"```(?:json)?", "")
    return F.coalesce(first_object(c), first_object(F.regexp_replace(bare, r",(\s*[}\]])", "$1")))


def decision(c: Column) -> Column:
    """A decision from JSON: kind, action, end_reason. Unknown kinds are tools, ending has the action final_answer, clarifying none."""
    raw = F.from_json(c, "decision_type string, action string, end_reason string")
    kind = F.lower(F.trim(F.coalesce(raw["decision_type"], F.lit(""))))
    kind = F.when(kind.isin(*KINDS), kind).otherwise("tool")
    action = F.trim(F.coalesce(raw["action"], F.lit("")))
    done = F.when(kind == "end", "final_answer").when(kind == "clarify", "").otherwise(F.when(action == "final_answer", "answerer").otherwise(action))
    return F.struct(kind.alias("kind"), done.alias("action"), F.when(kind == "end", F.lower(F.trim(F.coalesce(raw["end_reason"], F.lit(""))))).otherwise("").alias("end_reason"))


def action_of(c: Column) -> Column:
    """What a decision does: clarify and end count before its action; the empty text for no decision."""
    d = decision(c)
    return F.when(c.isNull(), "").when(d["kind"].isin("clarify", "end"), d["kind"]).otherwise(d["action"])


def unit_score(c: Column) -> Column:
    """A score in [0, 1] from a number, a truth value or a word for one; 0 if it is none."""
    s = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    n = s.try_cast("double")
    return F.when(s.isin(*YES), 1.0).when(s.isin(*NO), 0.0).when(n.isNull() | F.isnan(n), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


def percent(c: Column) -> Column:
    """A percentage from a text: a range gives its middle, values up to 1 are shares, all is kept in [0, 100]; null without a number."""
    number = r"\d+(?:\.\d+)?"
    low, high = (F.regexp_extract(c, rf"({number})\s*[-~～至]\s*({number})", k) for k in (1, 2))
    found = F.when(low != "", F.array(low, high)).otherwise(F.regexp_extract_all(c, F.lit(rf"({number})"), F.lit(1)))
    values = F.transform(found, lambda x: x.try_cast("double"))
    lo, hi = F.array_min(values), F.array_max(values)
    middle = F.when(F.size(values) > 1, (lo + hi) / 2).otherwise(hi)
    return F.when(F.size(values) > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(hi <= 1, middle * 100).otherwise(middle))))


def boxed_spans(text: str) -> list[tuple[int, int, str]] | None:
    r"""(start, end, content) of each ``\boxed{...}`` with balanced braces; None if one does not close."""
    out = []
    for m in re.finditer(r"\\boxed\s*\{", text):
        depth, end = 1, None
        for b in re.finditer(r"\\.|[{}]", text[m.end() :], re.S):
            depth += {"{": 1, "}": -1}.get(b[0], 0)
            if not depth:
                end = m.end() + b.end()
                break
        if end is None:
            return None
        out.append((m.start(), end, text[m.end() : end - 1]))
    return out


def terminal_box(c: Column) -> Column:
    """The content of the only box of a text, if it stands alone on the last line; else null."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        def one(t):
            spans = boxed_spans(t) if t else None
            if not spans or len(spans) != 1 or t[spans[0][1] :].strip():
                return None
            return spans[0][2] if t[t.rfind("\n", 0, spans[0][0]) + 1 :].strip() == t[spans[0][0] : spans[0][1]] else None

        return texts.map(one)

    return find(c)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes [x1, y1, x2, y2]; 0 without area."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    union = area(a) + area(b) - width * height
    return F.when(union > 0, width * height / union).otherwise(0.0)


def box_agreement(left: Column, right: Column, least: float = 0.5) -> Column:
    """Greedy one-to-one matches of two lists of boxes, best overlap first: struct(matched, rate, mean_iou)."""
    number = lambda x: F.transform(x, lambda v, k: F.struct(v.alias("v"), k.alias("k")))
    pairs = F.flatten(F.transform(number(left), lambda a: F.transform(number(right), lambda b: F.struct(iou(a["v"], b["v"]).alias("iou"), a["k"].alias("l"), b["k"].alias("r")))))
    order = F.sort_array(F.filter(pairs, lambda p: p["iou"] >= least), asc=False)
    none = F.struct(F.array().cast("array<int>").alias("l"), F.array().cast("array<int>").alias("r"), F.array().cast("array<double>").alias("v"))

    def take(s: Column, p: Column) -> Column:
        free = ~F.array_contains(s["l"], p["l"]) & ~F.array_contains(s["r"], p["r"])
        return F.when(free, F.struct(F.array_append(s["l"], p["l"]).alias("l"), F.array_append(s["r"], p["r"]).alias("r"), F.array_append(s["v"], p["iou"]).alias("v"))).otherwise(s)

    got = F.aggregate(order, none, take)
    n = F.size(got["v"])
    mean = F.when(n > 0, F.aggregate(got["v"], F.lit(0.0), lambda s, x: s + x) / n).otherwise(0.0)
    return F.struct(n.alias("matched"), (n / F.greatest(F.size(left), F.size(right), F.lit(1))).alias("rate"), mean.alias("mean_iou"))


def decay(n: Column, budget: float) -> Column:
    """max(0, 1 - n / budget); without a budget 1 for none and 0 for some."""
    if budget <= 0:
        return F.when(n > 0, 0.0).otherwise(1.0)
    return F.greatest(F.lit(0.0), 1.0 - n / F.lit(float(budget)))


def redacted(c: Column) -> Column:
    """JSON text in which the values of secret keys are hidden."""
    return F.regexp_replace(c, r'(?i)("(?:' + "|".join(SECRET_KEYS) + r')"\s*:\s*)("(?:\\.|[^"\\])*"|[^,}\s]+)', '$1"***"')


def outcome(ok: Column, error: Column) -> Column:
    """success or failure by the flag; without one failure where there is an error; else unknown."""
    return F.when(ok, "success").when(~ok, "failure").when(F.coalesce(error, F.lit("")) != "", "failure").otherwise("unknown")


def key_values(c: Column, pair: str = r"[;,\n]", sep: str = "=") -> Column:
    """A map of ``key=value`` parts of a text; of a repeated key the last value."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pair), lambda p: F.trim(p)), lambda p: F.contains(p, F.lit(sep)))
    cut = lambda p: F.struct(F.trim(F.substring_index(p, sep, 1)).alias("k"), F.trim(F.substr(p, F.instr(p, F.lit(sep)) + 1)).alias("v"))
    made = F.transform(parts, cut)
    last = F.filter(F.transform(made, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: ~F.exists(F.slice(made, y["i"] + 2, F.size(made)), lambda z: z["k"] == y["x"]["k"]))
    return F.map_from_entries(F.transform(last, lambda y: y["x"]))


def record_list(c: Column) -> Column:
    """Records from lines of the form ``- a=1 | b=2``: an array of maps."""
    rows = F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda r: F.ltrim(r).startswith("-"))
    return F.transform(rows, lambda r: key_values(F.regexp_replace(r, r"^\s*-\s*", ""), r"\|"))


def thresholds(c: Column) -> Column:
    """Comparisons and named thresholds in a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"((?:阈值|threshold)\s*[:：=为]?\s*\d+(?:\.\d+)?|[<>≥≤]=?\s*\d+(?:\.\d+)?)"), F.lit(1)))
