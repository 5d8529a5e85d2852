from loomspan.operators import graph


def test_entities_beside_other_scripts(spark):
    rows = [(1, "版本v1.2发布"), (2, "release v1.2, 2.0-rc_x"), (3, "did: 12345号 did=12345 xdid 99999"), (4, "é1.2 _1.2 1.2é"), (5, "平台 cuda11.4-trt8.4-int8-T4 和 acl-ascend310-fp16。"), (6, "a" * 32 + " " + "b" * 33 + "文"), (7, None)]
    got = {(r.id, r.kind, r.name) for r in graph.mentions(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect() if r.kind in ("version", "deployment", "platform", "oid")}
    assert got == {(2, "version", "v1.2"), (2, "version", "2.0"), (3, "deployment", "12345"), (5, "platform", "cuda11.4-trt8.4-int8-t4"), (5, "platform", "acl-ascend310-fp16"), (6, "oid", "a" * 32)} | {r for r in got if r[0] == 5 and r[1] == "version"}


def mentions(spark):
    rows = [(d, k, n) for d, names in {1: "x:A x:B y:C", 2: "x:A x:B", 3: "x:A y:C:c", 4: "y:C"}.items() for k, n in (e.split(":", 1) for e in names.split())]
    return spark.createDataFrame(rows, "doc int, kind string, name string")


def test_edges_with_their_ends(spark):
    m = mentions(spark)
    edges = graph.cooccurrences(m, "doc")
    ask = lambda **kw: [tuple(r) for r in graph.candidate_edges(edges, m, "doc", **kw).collect()]
    assert ask()[0] == ("x", "A", 3, "x", "B", 2, 2) and len(ask()) == 4
    assert ask()[1:] == [("x", "A", 3, "y", "C", 2, 1), ("x", "A", 3, "y", "C:c", 1, 1), ("x", "B", 2, "y", "C", 2, 1)]
    assert ask(kinds=["x"]) == ask(without=["y"]) == ask(least=2) == ask()[:1] == ask(limit=1)
    assert ask(terms=["c:"]) == [ask()[2]] and ask(terms=["zz"]) == [] and len(ask(terms=["Y", ""])) == 3
    assert graph.candidate_edges(edges, m.limit(0), "doc").first().a_texts == 0


def test_nodes_and_counts(spark):
    m = mentions(spark)
    assert [tuple(r) for r in graph.found_nodes(m, "doc", ["c", "b"]).collect()] == [(1, "x", "B", 2), (2, "y", "C", 2), (3, "y", "C:c", 1)]
    assert graph.found_nodes(m, "doc", []).count() == 0 and [r.name for r in graph.found_nodes(m, "doc", ["X"], limit=1).collect()] == ["A"]
    docs = spark.createDataFrame([(1, "s"), (2, "s"), (3, None)], "doc int, src string")
    got = {(r.what, r.value): (r.n, r.evidence) for r in graph.graph_counts(docs, "src", m, graph.cooccurrences(m, "doc")).collect()}
    assert got == {("texts", "s"): (2, None), ("texts", None): (1, None), ("entities", "x"): (2, None), ("entities", "y"): (2, None), ("mentions", "x"): (5, None), ("mentions", "y"): (3, None), ("edges", "x-x"): (1, 2), ("edges", "x-y"): (3, 3)}


def test_patterns_are_looked_for_where_their_signs_are(spark):
    texts = ["see net-a.onnx and biggest.safetensors", "a.MODEL v1.2.3", "x@y.org  at http://h.com/p", "none", None, "w.pth"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    patterns = [graph.PATTERNS[0], *graph.EXTRA]
    m = graph.mentions(docs, "id", "text", patterns, None)
    assert sorted(map(tuple, m.collect())) == [(0, "model", "biggest.safetensors"), (0, "model", "net-a.onnx"), (2, "email", "x@y.org"), (2, "host", "h.com")]
    assert m._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1  # the text is made once for all patterns
    assert set(graph.HOLDS) <= {p for _, p, _ in graph.PATTERNS + graph.EXTRA}


def test_questions_share_one_pass_over_the_texts(spark):
    from loomspan.plans import evidence

    docs = spark.createDataFrame([(0, "acc 97%"), (1, None)], "doc_id long, text string")
    out = evidence.answerability(lambda name: docs)
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 6
