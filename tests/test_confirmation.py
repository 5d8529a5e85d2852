from pyspark.sql import functions as F

from loomspan.operators import confirmation as C


def attempts(spark, rows):
    return spark.createDataFrame(rows, "arm string, case string, family string, strict boolean, route boolean, ok boolean, cut boolean")


def outcomes(spark, rows):
    return C.case_outcomes(attempts(spark, rows), "arm", "case", "family", F.col("strict"), F.col("route"), F.col("ok"), F.col("cut"))


def trial(arm, case, strict, route=True, family="f", ok=True, cut=False):
    return arm, case, family, strict, route, ok, cut


LIMITS = C.Limits(cases=2, runs=2, candidate_least=1.0, base_least=0.0, base_most=0.5, gap_least=0.5, route_failures_least=0.5, route_share_least=1.0, argument_share_most=0.0, mix={"f": 2})


def test_a_case_holds_if_all_attempts_hold(spark):
    rows = [trial("b", "1", True), trial("b", "1", False), trial("b", "2", None), trial("c", "1", True), trial("c", "1", True, route=None)]
    got = {(r.arm, r.case): (r.runs, r.strict_all, r.route_all, r.readable, r.cut) for r in outcomes(spark, rows).collect()}
    assert got == {("b", "1"): (2, False, True, 2, 0), ("b", "2"): (1, False, True, 1, 0), ("c", "1"): (2, True, False, 2, 0)}


def passing():
    good = [trial("c", c, True) for c in "12" for _ in range(2)]
    return good + [trial("b", "1", True)] * 2 + [trial("b", "2", False, route=False)] * 2


def test_confirmation_passes_and_each_check_can_fail(spark):
    def failed(rows, limits=LIMITS):
        v = C.verdict(C.confirmation(outcomes(spark, rows), "b", "c", limits)).first()
        assert v.passed == (not v.failed)
        return v.failed

    assert failed(passing()) == []
    assert failed([*passing(), *[trial("x", "9", False)] * 3]) == []  # other arms do not count
    assert failed([r for r in passing() if r[:2] != ("c", "2")]) == ["cases"]
    assert failed([*passing(), trial("c", "1", True)]) == ["runs_at_most"]
    assert failed([*passing()[:-1]]) == ["runs"]
    assert failed([*passing()[1:], trial("c", "1", True, ok=False, cut=True)]) == ["cut", "readable"]
    assert failed([trial("c", "1", False) if r[:2] == ("c", "1") else r for r in passing()]) == ["candidate", "f/candidate", "gap"]
    assert failed([trial("b", "2", True) if r[:2] == ("b", "2") else r for r in passing()]) == ["base", "f/base", "gap", "route_failures", "route_share"]
    assert failed([trial("b", "2", False) if r[:2] == ("b", "2") else r for r in passing()]) == ["argument_share", "route_failures", "route_share"]
    assert failed([(*r[:2], "g", *r[3:]) for r in passing()]) == ["mix f", "mix g"]


def test_a_missing_arm_or_no_outcome_is_no_pass(spark):
    only = C.verdict(C.confirmation(outcomes(spark, [r for r in passing() if r[0] == "b"]), "b", "c", LIMITS)).first()
    assert not only.passed and {"candidate", "gap", "cases", "f/candidate"} <= set(only.failed)
    none = C.verdict(C.confirmation(outcomes(spark, []), "b", "c", C.Limits(cases=0, runs=0))).first()
    assert not none.passed and none.checks == 0


def test_objective(spark):
    def one(rows, **kw):
        c = spark.createDataFrame(rows, "e string, p boolean, b boolean, n boolean, l boolean, fb int, fn int")
        return C.objective(c, "e", F.col("p"), ("b", "n", "l"), {"b": "fb", "n": "fn"}, replicates=40, **kw).first()

    lead = [(str(k), True, False, True, False, 1, 1) for k in range(6)]
    strong = one([*lead, ("c", False, True, True, True, 0, 0)])
    assert strong.met and strong.strong and not strong.point_only and strong.lead_larger == 1 and strong.low_larger == 1 and strong.controls == 0
    weak = one([*[(*r[:4], r[0] != "0", *r[5:]) for r in lead], ("c", None, True, True, True, 0, 0)])
    assert weak.met and weak.point_only and not weak.strong
    assert not one([*lead, ("c", False, True, False, True, 0, 0)]).met  # controls lose
    assert not one([*lead, ("c", False, True, True, True, 0, 1)]).met  # more side effects
    assert not one([("c", False, True, True, True, 0, 0)]).met  # no primary case


def test_step_support(spark):
    rows = [("a", 2, "y", 0.5, "x", False), ("a", 1, "t", 0.5, None, None), ("b", 1, "t", 1.0, "x", True), ("b", 2, "t", 0.0, "z", False), ("b", 3, "t", 0.5, "x", None), ("c", 1, None, 0.1, None, None), ("c", 2, "t", 0.1, None, None)]
    prompts, blocks = C.step_support(spark.createDataFrame(rows, "k string, o int, t string, s double, a string, m boolean"), "k", "o", ["t"], F.col("s"), F.col("a"), F.col("m"))
    got = {r.k: (r.t, r.samples, r.supported, round(r["mean"], 6), round(r.deviation, 6), r.actions) for r in prompts.collect()}
    assert got == {"a": ("t", 2, False, 0.5, 0.0, 1), "b": ("t", 3, True, 0.5, round((0.5 / 3) ** 0.5, 6), 2), "c": (None, 2, False, 0.1, 0.0, 0)}
    got = {(r.scope, r.value): (r.prompts, round(r.support_rate, 6), round(r.varied_rate, 6), r.mean_actions, round(r.mean_score, 6)) for r in blocks.collect()}
    assert got == {("overall", "all"): (3, 0.333333, 0.333333, 1.0, 0.366667), ("t", "t"): (2, 0.5, 0.5, 1.5, 0.5), ("t", ""): (1, 0.0, 0.0, 0.0, 0.1)}


def test_isolation(spark):
    a = spark.createDataFrame([(1, "q", "r"), (2, "", "r"), (3, None, "s")], "i int, q string, t string")
    b = spark.createDataFrame([(4, "q", "r"), (5, "", "s"), (5, "q", "s"), (6, None, None)], "i int, q string, t string")
    got = {r.field: (r.protected, r.overlap, r.examples, r.passed) for r in C.isolation(a, b, {"i": F.col("i"), "q": F.col("q")}, {"t": F.col("t")}, examples=1).collect()}
    assert got == {"i": (True, 0, [], True), "q": (True, 1, ["q"], False), "t": (False, 2, ["r"], True)}
    assert all(r.passed and r.overlap == 0 for r in C.isolation(a.limit(0), b, {"i": F.col("i")}).collect())


def test_factors(spark):
    rows = spark.createDataFrame([(2, "e1", "b1", "x", 1, "u"), (1, "e1", "b1", "y", 1, "v"), (3, "e2", "b1", "y", None, "v"), (4, None, None, "z", 2, "w")], "o int, e string, b string, f string, g int, h string")
    got = {(r.unit, r.factor, r.value): r.n for r in C.factor_report(rows, "o", "e", ["f", "g"], "b", ["h"], ["h"]).collect()}
    assert got == {("entity", "f", "y"): 2, ("entity", "g", "1"): 1, ("entity", "g", ""): 1, ("entity", "f|g", "y|1"): 1, ("entity", "f|g", "y|"): 1, ("bundle", "h", "v"): 1, ("row", "h", "u"): 1, ("row", "h", "v"): 2, ("row", "h", "w"): 1}
