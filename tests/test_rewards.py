import pytest
from pyspark.sql import functions as F

from loomspan.operators import rewards

WANT = "array<struct<kind:string,action:string,args:map<string,string>,contains:map<string,array<string>>>>"
GOT = "array<struct<kind:string,action:string,args:map<string,string>>>"


def score(spark, want, got, forbidden=(), process=None, same=None, **more):
    df = spark.createDataFrame([(want, got, list(forbidden))], f"w {WANT}, g {GOT}, f array<string>")
    return df.select(rewards.case_score(F.col("w"), F.col("g"), F.col("f"), process, same, **more).alias("x")).first().x


def test_case_scores(spark):
    want = [("tool", "probe", {"finish_after_tool": "false", "k": "1"}, {"q": ["red", "blue"]}), ("tool", "move", None, None), ("end", None, None, None)]
    right = [("tool", "probe", {"finish_after_tool": "False", "k": "1", "q": "a Blue one"}), ("tool", "move", {}), ("end", "x", None)]
    assert tuple(score(spark, want, right)) == (1.0, True, False, False, False, False, False)
    assert score(spark, want, None).score == 0 and not score(spark, want, None).passed
    half = [("tool", "probe", {"k": "2", "q": "blue"}), *right[1:]]
    assert score(spark, want, half).score == pytest.approx(round((2.8 - 0.125 - 0.10) / 2.8, 6))
    short = score(spark, want, right[:1], process={"no_premature_stop": 0.2})
    assert short.stopped_early and short.score == pytest.approx(round((0.9 + 0.1) / (2.7 + 0.1 + 0.2), 6))
    banned = score(spark, want, right, forbidden=["move"])
    assert banned.forbidden_hit and banned.score == pytest.approx(round(2.7 / 2.8, 6)) and not banned.passed
    twice = score(spark, want, [right[0], ("tool", "probe2", {}), right[2]], process={"no_repeated_tool": 0.2}, same={"probe2": "probe"})
    assert twice.repeated and score(spark, want, right, process={"no_repeated_tool": 0.2}).score == 1
    assert score(spark, [], []).score == pytest.approx(round(0.1 / 1.0, 6))


def test_equivalent_actions_and_formats(spark):
    want, got = [("tool", "a1", None, None)], [("tool", "a2", None)]
    assert score(spark, want, got, same={"a1": "a", "a2": "a"}).passed and not score(spark, want, got).passed
    rows = spark.createDataFrame([(0, 0, 10), (5, 0, 10), (0, 40, 10), (0, 0, 64), (None, None, 5)], "p int, t int, n int")
    got = [r[0] for r in rows.select(rewards.format_score(F.col("p"), F.col("t"), F.col("n"), 10, 20, 64)).collect()]
    assert got == pytest.approx([1.0, 0.9, 0.45, 0.75, 0.0])


def test_probes_and_open_ends(spark):
    step = lambda a, f=None: ("tool", a, {"finish_after_tool": f} if f else None)
    want = [(*step("probe", "false"), None), (*step("move", "true"), None)]
    seen = lambda got: score(spark, want, got, probes=("probe", "probe2"), then="move", process={"no_skip_required_probe": 0.2, "final_tool_finish": 0.3})
    good = seen([step("probe", "false"), step("move", "true")])
    assert (good.score, good.skipped_probe, good.left_open) == (1.0, False, False)
    skip = seen([step("move", "false"), step("move", "true")])
    assert skip.skipped_probe and not skip.left_open and skip.score == pytest.approx(round((2.4 - 0.35 - 0.2) / 2.4, 6))
    # one required argument (the flag is none) leaves argument_match whole; the flag itself costs 0.10 and the term 0.3
    unclosed = seen([step("probe2", "false"), step("move")])
    assert unclosed.left_open and not unclosed.skipped_probe and unclosed.score == pytest.approx(round((2.4 - 0.35 - 0.1 - 0.3) / 2.4, 6))
    assert not seen([step("probe", "false"), step("stay", "false")]).left_open and not seen([step("probe", "false")]).left_open
    assert not seen([]).skipped_probe


def online(spark, got, place, process, previous="probe", now="move", before="probe", due=True, cap=None, want=("tool", "move", {"finish_after_tool": "true"}, None), same=None):
    w, g = WANT[6:-1], GOT[6:-1]
    df = spark.createDataFrame([(want, got, ["bad"], place, 2, previous, now, before, due)], f"w {w}, g {g}, f array<string>, p int, t int, a string, b string, c string, d boolean")
    c = F.col
    return df.select(rewards.online_step_score(c("w"), c("g"), c("f"), c("p"), c("t"), c("a"), c("b"), c("c"), c("d"), process, same, ("probe",), cap)).first()[0]


def test_online_step_scores(spark):
    terms = {"no_premature_stop": 0.2, "no_repeated_tool": 0.1, "no_skip_required_probe": 0.4, "final_tool_finish": 0.3}
    assert online(spark, ("tool", "move", {"finish_after_tool": "true"}), 2, terms) == 1
    assert online(spark, None, 2, terms) == 0
    assert online(spark, ("tool", "move", None), 2, terms) == pytest.approx((1.0 - 0.10 + 0.1) / 1.4)  # does not finish
    assert online(spark, ("tool", "probe", {"finish_after_tool": "true"}), 2, terms) == pytest.approx((0.65 + 0.3) / 1.4)  # repeats
    assert online(spark, ("tool", "probe", {"finish_after_tool": "true"}), 2, terms, before="move") == pytest.approx((0.65 + 0.1 + 0.3) / 1.4)  # repeats where the expected steps do
    assert online(spark, ("tool", "probe", {"finish_after_tool": "true"}), 2, terms, cap=0.3) == pytest.approx(0.3)
    first = ("tool", "probe", {"finish_after_tool": "false"}, None)
    assert online(spark, ("tool", "probe", {"finish_after_tool": "false"}), 1, terms, want=first) == 1
    assert online(spark, ("tool", "bad", {"finish_after_tool": "false"}), 1, terms, want=first) == pytest.approx((0.55 + 0.2) / 1.6)  # no probe, forbidden
    assert online(spark, ("tool", "bad", {"finish_after_tool": "false"}), 1, terms, want=first, due=False) == pytest.approx((0.55 + 0.2) / 1.2)
    assert online(spark, ("end", "", None), 1, {"no_premature_stop": 0.2}, want=first) == pytest.approx((0.10 + 0.25 + 0.10) / 1.2)


def test_arrays_of_a_case_are_made_once(spark):
    none, lists = F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,array<string>>")
    step = lambda x: F.struct(F.lit("tool").alias("kind"), F.concat(F.lit("a"), x.cast("string")).alias("action"), none.alias("args"))
    want = F.transform("numbers", lambda x: F.struct(step(x)["kind"].alias("kind"), step(x)["action"].alias("action"), none.alias("args"), lists.alias("contains")))
    score = rewards.case_score(want, F.transform("numbers", step), F.array(F.lit("a7")))
    assert str(score).count("numbers") == 3  # the steps wanted, those made, and whether any were
    got = [tuple(r.x)[:3] for r in spark.createDataFrame([(list(range(3)),), (list(range(9)),), (None,)], "numbers array<int>").select(score.alias("x")).collect()]
    assert got[0] == (1.0, True, False) and got[1][2] and got[1][0] < 1 and got[2][0] == 0.0
