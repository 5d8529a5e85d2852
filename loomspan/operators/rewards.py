"""Scores of decisions against expected ones, by step and by case, as column expressions.

An expected decision is a struct of kind, action, args (map of text) and contains (map of word lists); a decision made has kind,
action and args. Arrays of them are a case's steps in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of a step's parts and of a case without a forbidden action; actions that end a case; the argument that ends it.
STEP_WEIGHTS = {"json_valid": 0.10, "decision_type_valid": 0.10, "action_match": 0.35, "argument_match": 0.25, "finish_after_tool": 0.10}
NO_FORBIDDEN = 0.10
STOPS = ("answerer", "final_answer")
FINISH = "finish_after_tool"


def _one(cond: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), 1.0).otherwise(0.0)


def act(d: Column) -> Column:
    """What a decision does: clarify and end count before its action."""
    return F.when(d["kind"].isin("clarify", "end"), d["kind"]).otherwise(F.coalesce(d["action"], F.lit("")))


def family(name: Column, same: dict[str, str]) -> Column:
    """The class of an action: actions of one class stand for each other."""
    out = name
    for a, cls in same.items():
        out = F.when(name == a, cls).otherwise(out)
    return out


def step_detail(want: Column, got: Column, same: dict[str, str] | None = None) -> Column:
    """The parts of a step's score, each from 0 to 1; all 0 without a decision. Of listed words any one in the argument is enough."""
    same = same or {}
    none = F.create_map().cast("map<string,string>")
    args = F.coalesce(got["args"], none)
    required = F.map_filter(F.coalesce(want["args"], none), lambda k, v: k != FINISH)
    equal = F.size(F.filter(F.map_entries(required), lambda e: F.coalesce(F.lower(F.trim(args[e["key"]])) == F.lower(F.trim(e["value"])), F.lit(False))))
    lists = F.coalesce(F.map_entries(want["contains"]), F.array().cast("array<struct<key:string,value:array<string>>>"))
    within = F.size(F.filter(lists, lambda e: F.exists(e["value"], lambda w: F.coalesce(F.contains(F.lower(args[e["key"]]), F.lower(w)), F.lit(False)))))
    n = F.size(required) + F.size(lists)
    finish = want["args"][FINISH]
    parts = {
        "json_valid": F.lit(1.0),
        "decision_type_valid": _one(F.coalesce(want["kind"], F.lit("tool")) == got["kind"]),
        "action_match": _one(family(act(want), same) == family(act(got), same)),
        "argument_match": F.when(n == 0, 1.0).otherwise((equal + within) / n),
        "finish_after_tool": F.when(finish.isNull(), 1.0).otherwise(_one(F.lower(args[FINISH]) == F.lower(finish))),
    }
    return F.struct(*[F.when(got.isNull(), 0.0).otherwise(v).alias(k) for k, v in parts.items()])


def step_score(detail: Column) -> Column:
    return sum((detail[k] * w for k, w in STEP_WEIGHTS.items()), F.lit(0.0))


def stopped_early(want: Column, got: Column) -> Column:
    """Whether a tool that was expected before the last step was not reached: no decision there, an end, a stop, or a tool that finishes."""
    def missed(w: Column, i: Column) -> Column:
        g = F.get(got, i)
        ends = g.isNull() | (g["kind"] == "end") | g["action"].isin(*STOPS) | (F.lower(g["args"][FINISH]) == "true")
        return (F.coalesce(w["kind"], F.lit("tool")) == "tool") & ~F.coalesce(w["action"], F.lit("")).isin(*STOPS) & F.coalesce(ends, F.lit(False))

    before_last = F.slice(F.transform(want, missed), 1, F.greatest(F.size(want) - 1, F.lit(0)))
    return F.when(F.size(want) > 1, F.exists(before_last, lambda x: x)).otherwise(False)


def neighbours_alike(steps: Column, same: dict[str, str]) -> Column:
    """Whether two neighbouring steps do the same, stops and empty actions left out."""
    names = F.transform(steps, lambda d: family(act(d), same))
    n = F.size(names)
    pairs = F.zip_with(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), F.slice(names, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (a == b) & (a != "") & ~a.isin(*STOPS, "end"))
    return F.when(n > 1, F.exists(pairs, lambda x: x)).otherwise(False)


def repeats_a_tool(want: Column, got: Column, same: dict[str, str] | None = None) -> Column:
    """Whether a tool is used twice in a row where the expected steps change tools."""
    return (F.size(want) > 1) & ~neighbours_alike(want, same or {}) & neighbours_alike(got, same or {})


def skipped_probe(want: Column, got: Column, probes: Sequence[str], then: str) -> Column:
    """Whether the first decision is no probe where one was due: the expected steps begin with a probe followed by ``then``."""
    due = (F.size(want) > 1) & act(F.get(want, F.lit(0))).isin(*probes) & (act(F.get(want, F.lit(1))) == then)
    return F.coalesce(due & (F.size(got) > 0) & ~act(F.get(got, F.lit(0))).isin(*probes), F.lit(False))


def left_open(want: Column, got: Column, same: dict[str, str] | None = None) -> Column:
    """Whether the last expected step, which must finish, was taken by the right action without finishing."""
    w, g = F.get(want, F.size(want) - 1), F.get(got, F.size(want) - 1)
    right = family(act(w), same or {}) == family(act(g), same or {})
    must = F.lower(w["args"][FINISH]) == "true"
    done = F.coalesce(F.lower(g["args"][FINISH]) == "true", F.lit(False))
    return F.coalesce(g.isNotNull() & right & must & ~done, F.lit(False))


def online_step_score(
    want: Column, got: Column, forbidden: Column, place: Column, total: Column, previous: Column, now: Column, before: Column, probe_due: Column,
    process: dict[str, float] | None = None, same: dict[str, str] | None = None, probes: Sequence[str] = (), cap: float | None = None,
) -> Column:
    """The score of one sampled step from 0 to 1: its parts, no forbidden action, and the process terms that its place makes apply.

    ``place`` of ``total`` counts from 1; ``previous`` is the action taken before, ``now`` and ``before`` are the expected actions of
    this step and the one before it. Before the last step the decision must be a tool that goes on (``no_premature_stop``); after the
    first it must not repeat a class that the expected steps do not repeat (``no_repeated_tool``); at the first it must be a probe if
    one is due (``no_skip_required_probe``); at the last it must finish if the expected tool does (``final_tool_finish``; a step that
    need not finish has the weight for free). Terms that do not apply count in neither the sum nor what could be had. A wrong action
    has at most ``cap``. No decision gives 0.
    """
    process, same = process or {}, same or {}
    detail = step_detail(want, got, same)
    did, finish = act(got), F.lower(got["args"][FINISH])
    goes_on = (got["kind"] == "tool") & ~did.isin(*STOPS) & (finish == "false")
    fresh = (family(now, same) == family(before, same)) | (family(did, same) != family(F.coalesce(previous, F.lit("")), same))
    must_finish = (F.coalesce(want["kind"], F.lit("tool")) == "tool") & (F.lower(want["args"][FINISH]) == "true")
    closed = ~F.coalesce(must_finish, F.lit(False)) | F.coalesce(finish == "true", F.lit(False))
    terms = [
        ("no_premature_stop", place < total, goes_on), ("no_repeated_tool", place > 1, fresh),
        ("no_skip_required_probe", (place == 1) & probe_due, did.isin(*probes)), ("final_tool_finish", place == total, closed),
    ]
    gained = step_score(detail) + F.when(F.coalesce(F.array_contains(forbidden, did), F.lit(False)), 0.0).otherwise(NO_FORBIDDEN)
    most = F.lit(sum(STEP_WEIGHTS.values()) + NO_FORBIDDEN)
    for name, applies, ok in terms:
        if w := float(process.get(name, 0.0)):
            gained = gained + w * _one(applies) * _one(ok)
            most = most + w * _one(applies)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), gained / most))
    if cap is not None:
        score = F.when(detail["action_match"] >= 1, score).otherwise(F.least(score, F.lit(min(1.0, max(0.0, cap)))))
    return F.when(got.isNull() | want.isNull(), 0.0).otherwise(score)


def case_score(want: Column, got: Column, forbidden: Column, process: dict[str, float] | None = None, same: dict[str, str] | None = None, probes: Sequence[str] = (), then: str = "") -> Column:
    """struct(score, passed, forbidden_hit, stopped_early, repeated, skipped_probe, left_open): steps, no forbidden action and process terms over what could be had.

    A case without readable decisions (null) scores 0. It passes with a score of 1 at six digits. Both arrays are made once a row, as the
    item of an array of one, and not again for each step that looks into them.
    """
    pair = F.struct(want.alias("want"), F.coalesce(got, F.array().cast("array<struct<kind:string,action:string,args:map<string,string>>>")).alias("made"), got.isNull().alias("none"))
    return F.transform(F.array(pair), lambda z: _case_score(z["want"], z["made"], z["none"], forbidden, process or {}, same, probes, then))[0]


def _case_score(want: Column, made: Column, none: Column, forbidden: Column, process: dict[str, float], same: dict[str, str] | None, probes: Sequence[str], then: str) -> Column:
    steps = F.transform(want, lambda w, i: step_score(step_detail(w, F.get(made, i), same)))
    raw = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)
    hit = F.exists(made, lambda d: F.coalesce(F.array_contains(forbidden, act(d)), F.lit(False)))
    early, again = stopped_early(want, made), repeats_a_tool(want, made, same)
    skipped = skipped_probe(want, made, probes, then) if probes else F.lit(False)
    unclosed = left_open(want, made, same)
    terms = {"no_premature_stop": early, "no_repeated_tool": again, "no_skip_required_probe": skipped, "final_tool_finish": unclosed}
    weights = {name: float(process.get(name, 0.0)) for name in terms}
    most = sum(STEP_WEIGHTS.values()) * F.greatest(F.size(want), F.lit(1)) + NO_FORBIDDEN + sum(weights.values())
    gained = raw + F.when(hit, 0.0).otherwise(NO_FORBIDDEN) + sum((F.when(fault, 0.0).otherwise(weights[name]) for name, fault in terms.items() if weights[name]), F.lit(0.0))
    score = F.when(none, 0.0).otherwise(F.round(gained / most, 6))
    return F.struct(score.alias("score"), (score >= 1).alias("passed"), hit.alias("forbidden_hit"), early.alias("stopped_early"), again.alias("repeated"), skipped.alias("skipped_probe"), unclosed.alias("left_open"))


def format_score(prefix: Column, tail: Column, whole: Column, prefix_budget: int, tail_budget: int, most: int) -> Column:
    """0.20 for no words before the object, 0.55 for none behind, 0.25 for not being cut off, from token counts; null counts (no object) give 0."""
    from loomspan.functions.structured import decay

    score = 0.20 * decay(prefix, prefix_budget) + 0.55 * decay(tail, tail_budget) + 0.25 * F.when(whole >= most, 0.0).otherwise(1.0)
    return F.when(prefix.isNull() | tail.isNull() | whole.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
