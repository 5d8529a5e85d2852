import random

from pyspark.sql import functions as F

from loomspan.functions import structured as J
from loomspan.operators import chunking, layout


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_title_runs(spark):
    lines = [(1, k, t) for k, t in enumerate(["# A", "# B", "text", "# C", "more", "# D", "# E", "# F", "end"])]
    df = spark.createDataFrame(lines, "doc int, no int, line string")
    got = {r.no: r.header for r in layout.title_headers(df, "doc", "no", F.col("line").startswith("#"), "line").collect()}
    assert got == {0: "# A", 1: "# A", 2: "# A", 3: "# A", 4: "# A", 5: "# D\n# E\n# F", 6: "# D\n# E\n# F", 7: "# D\n# E\n# F", 8: "# D\n# E\n# F"}


def test_packing_and_growing():
    r = random.Random(1)
    for _ in range(200):
        parts = ["x" * r.choice((0, 1, 3, 9, 30)) for _ in range(r.randint(0, 12))]
        groups = layout.packed(parts, 20)
        assert groups == sorted(groups)
        for g in set(groups):
            sizes = [len(p) for p, x in zip(parts, groups, strict=True) if x == g]
            assert sum(sizes) <= 20 or sum(s > 0 for s in sizes) == 1
        grown = layout.grown(parts, 10)
        assert grown == sorted(grown)
        joined = ["\n\n".join(p for p, x in zip(parts, grown, strict=True) if x == g) for g in sorted(set(grown))]
        assert all(len(j) >= 8 for j in joined) or len(joined) <= 1


def test_continued_blocks(spark):
    rows = [(1, 1, 1, "first half", False), (1, 2, 2, "goes on", False), (1, 3, 3, "and ends.", False), (1, 4, 4, "new", False), (1, 5, 4, "same page", False), (1, 6, 5, "Title", True)]
    df = spark.createDataFrame(rows, "doc int, no int, page int, text string, title boolean")
    got = sorted((r.first, r.parts, r.text) for r in layout.merge_continued(df, "doc", "no", "page", "text", F.col("title")).collect())
    assert got == [(1, 3, "first half\ngoes on\nand ends."), (4, 1, "new"), (5, 1, "same page"), (6, 1, "Title")]


def test_whole_documents(spark):
    chunks = spark.createDataFrame([("d", 1, "text", None, " a "), ("d", 2, "text", "T", "b"), ("d", 3, "table", None, "a"), ("e", 1, "text", None, "c")], "doc string, page int, kind string, title string, text string")
    found = spark.createDataFrame([("d", "e1"), ("d", "e2")], "doc string, ev string")
    (row,) = layout.whole_documents(chunks, found, "doc", ["page"], "page", "kind", F.col("title"), "text", "ev").collect()
    assert row.content == "[page=1 block_type=text title=text]\na\n\n[page=2 block_type=text title=T]\nb"
    assert (row.n_chunks, row.evidence_ids) == (3, ["e1", "e2"])


def test_tables(spark):
    page = "<p>x</p><table><tr><th>a</th><th>b &amp; c</th></tr><tr><td>1</td><td> 2\n3 </td></tr></table><table></table>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, html string")
    assert [tuple(r) for r in layout.page_tables(df, "id", "html").collect()] == [(1, 0, "|a|b & c|\n|---|---|\n|1|2 3|")]


def test_chunk_rules():
    text = "第一段。" * 30 + "\n\n" + "二、" + "内容，" * 200 + "\n第三章 结束。"
    for rule in (chunking.sections, chunking.sentence_chunks, chunking.ahead):
        parts = list(rule(text))
        assert all(parts) and len(parts) > (rule is not chunking.ahead)
        assert list(rule("")) == [] and list(rule(None)) == []
    assert all(len(p) <= 200 for p in chunking.sentence_chunks(text))
    plain = " ".join(f"w{k}" for k in range(900))
    assert all(len(p) <= 300 + 128 for p in chunking.sections(plain))
    assert "".join(chunking.sentence_chunks("ab. " * 300, 50, 0)).replace(" ", "") == "ab." * 300
    assert all(len(p) <= 1128 for p in chunking.ahead(plain)) and " ".join(chunking.ahead("x. " * 2000)).split() == ["x."] * 2000


def test_nested_chunks_keep_parents(spark):
    df = spark.createDataFrame([(1, "One two three. " * 200), (2, None), (3, "")], "id long, text string")
    rows = chunking.nested_chunks(df, "id", "text").collect()
    assert rows and all(r.text in r.index_text for r in rows) and len({r.chunk_id for r in rows}) == len(rows)


def test_json_in_texts(spark):
    rows = [('so {"decision_type": "end", "end_reason": "DONE"} x',), ('a {b} {"action": "search {x}", }',), ('```json\n{"action": "final_answer",}\n```',), ('{"decision_type": "clarify", "action": "x"}',), (None,), ("none",)]
    got = values(spark, rows, "c string", J.mended_object(F.col("c")), J.action_of(J.mended_object(F.col("c"))))
    assert [g[1] for g in got] == ["end", "search {x}", "answerer", "clarify", "", ""]
    assert got[4][0] is None and got[5][0] is None


def test_scores_and_percentages(spark):
    rows = [("true",), ("0.7",), ("5",), ("-1",), ("NaN",), (None,), ("abc",)]
    assert [g[0] for g in values(spark, rows, "c string", J.unit_score(F.col("c")))] == [1.0, 0.7, 1.0, 0.0, 0.0, 0.0, 0.0]
    rows = [("90-96%",), ("0.8",), ("acc 97.5",), ("0.5 and 0.7",), ("none",), ("250",), (None,)]
    assert [g[0] for g in values(spark, rows, "c string", J.percent(F.col("c")))] == [93.0, 80.0, 97.5, 60.0, None, 100.0, None]


def test_boxed_answers(spark):
    rows = [(r"so \boxed{1}" + "\n\n" + r"\boxed{2}",), ("a\n" + r"\boxed{\frac{1}{2}}",), (r"x \boxed{3}",), (r"\boxed{\{a\}}  ",), (r"\boxed{4",), (None,)]
    assert [g[0] for g in values(spark, rows, "c string", J.terminal_box(F.col("c")))] == [None, r"\frac{1}{2}", None, r"\{a\}", None, None]


def test_boxes(spark):
    rows = [([[0.0, 0.0, 10.0, 10.0]], [[0.0, 0.0, 10.0, 10.0]]), ([[0.0, 0.0, 1.0, 1.0]], [[5.0, 5.0, 6.0, 6.0]]), ([[0.0, 0.0, 4.0, 4.0], [0.0, 0.0, 4.0, 5.0]], [[0.0, 0.0, 4.0, 4.0]]), ([], [])]
    got = values(spark, rows, "l array<array<double>>, r array<array<double>>", J.box_agreement(F.col("l"), F.col("r")))
    assert [(g[0].matched, g[0].rate, g[0].mean_iou) for g in got] == [(1, 1.0, 1.0), (0, 0.0, 0.0), (1, 0.5, 1.0), (0, 0.0, 0.0)]


def test_key_values_and_redaction(spark):
    rows = [("a=1; b = x=y\na=2",), ("",), (None,)]
    assert [g[0] for g in values(spark, rows, "c string", J.key_values(F.col("c")))] == [{"a": "2", "b": "x=y"}, {}, {}]
    assert values(spark, [("t\n- a=1 | b=2\n - a=3",)], "c string", J.record_list(F.col("c")))[0][0] == [{"a": "1", "b": "2"}, {"a": "3"}]
    assert values(spark, [('{"user": "u", "Token": "s\\"x", "password": 12}',)], "c string", J.redacted(F.col("c")))[0][0] == '{"user": "u", "Token": "***", "password": "***"}'
    assert values(spark, [("阈值: 0.5, > 3 and > 3",)], "c string", J.thresholds(F.col("c")))[0][0] == ["阈值: 0.5", "> 3"]
    got = values(spark, [(True, ""), (False, ""), (None, "e"), (None, None)], "ok boolean, e string", J.outcome(F.col("ok"), F.col("e")))
    assert [g[0] for g in got] == ["success", "failure", "failure", "unknown"]


def test_chunks_are_given_out_in_parts(spark):
    docs = spark.createDataFrame([(k, "word. " * (k * 40)) for k in range(6)] + [(6, None)], "id long, text string").coalesce(1)
    rows = lambda n: [tuple(r) for r in chunking.chunks(docs, "id", "text", cut=chunking.sentence_chunks, most_rows=n).orderBy("id", "chunk_no").collect()]
    assert rows(1) == rows(4) == rows(10_000) and len(rows(4)) > 20
