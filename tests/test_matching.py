import hashlib
import random
import tempfile
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions.text import text_tokens
from loomspan.operators import audits, matching, resampling


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha 检测"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.embedding for r in matching.hashed_vectors(df, "id", text_tokens(F.col("text")), 16).collect()}
    want = np.zeros(16)
    for t in ("alpha", "beta", "alpha", "检", "测", "检测"):
        d = hashlib.blake2b(t.encode(), digest_size=8).digest()
        want[int.from_bytes(d[:4], "little") % 16] += 1 if d[4] % 2 == 0 else -1
    assert np.allclose(got[1], want / np.linalg.norm(want)) and not any(got[2]) and not any(got[3])


def test_hybrid_fusion(spark):
    lists = spark.createDataFrame([(1, "text", 3.0), (2, "text", 2.0), (2, "vector", 9.0), (3, "rows", 1.0)], "id long, list string, score double")
    graph = spark.createDataFrame([(1, 0.5), (9, 1.0)], "id long, score double")
    got = {r.id: (r.score, r.n_lists) for r in matching.hybrid(lists, "id", {"rows": 0.45}, {"rows": 20}, graph, 0.28, threshold=0.02).collect()}
    assert {k: v[1] for k, v in got.items()} == {1: 1, 2: 2, 3: 1}
    assert {k: v[0] for k, v in got.items()} == pytest.approx({1: 1 / 61 + 0.14, 2: 1 / 62 + 1 / 61, 3: 0.45 / 21})


def test_longest_common_substring():
    r = random.Random(3)
    for _ in range(100):
        a, b = ("".join(r.choice("ab c") for _ in range(r.randint(0, 25))) for _ in range(2))
        want = max((n for n in range(len(a) + 1) for i in range(len(a) - n + 1) if a[i : i + n] in b), default=0)
        assert matching.longest_common(a, b) == want


def test_nearest_texts_by_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(1, 6)))
    q = [(k % 2, k, " ".join(word() for _ in range(4))) for k in range(8)]
    c = [(k % 2, 100 + k, " ".join(word() for _ in range(r.randint(0, 6)))) for k in range(60)] + [(0, 300, None)]
    got = {x.q: (x.c, x.ratio) for x in matching.nearest_texts(spark.createDataFrame(q, "g int, q long, t string"), spark.createDataFrame(c, "g int, c long, t string").repartition(5), "g", "q", "t", "c", "t").collect()}
    for g, k, text in q:
        best = max(((SequenceMatcher(None, t or "", text, autojunk=False).ratio(), -i) for h, i, t in c if h == g))
        assert got[k] == (-best[1], best[0])
    with pytest.raises(ValueError):
        matching.nearest_texts(spark.createDataFrame(q, "g int, q long, t string"), spark.createDataFrame(c, "g int, c long, t string"), "g", "q", "t", "c", "t", most_queries=3)


def test_ratios_until_they_stay_below(spark):
    r = random.Random(6)
    texts = ["", "a", "x" * 40] + ["".join(r.choice("abcde é") for _ in range(r.randint(0, 60))) for _ in range(40)]
    for a in texts:
        for b in texts:
            m = SequenceMatcher(None, a, b, autojunk=False)
            sums, full = (matching.letter_sums(a), matching.letter_sums(b)), m.ratio()
            assert matching.ratio_from(m, *sums, -1.0) == matching.ratio_from(m, *sums, full) == full
            assert matching.ratio_from(m, *sums, full + 1e-9) in (-1.0, full)
    q = spark.createDataFrame([(0, 1, "abc abd")], "g int, q long, t string")
    c = spark.createDataFrame([(0, 9, "abd"), (0, 7, "abc abd x"), (0, 8, "abc abd x"), (0, 5, "zz")], "g int, c long, t string").coalesce(1)
    out = matching.nearest_texts(q, c, "g", "q", "t", "c", "t", parts=3)
    assert [tuple(x) for x in out.select("q", "c").collect()] == [(1, 7)]
    assert "RoundRobinPartitioning(3)" in out._jdf.queryExecution().toString()  # one file of candidates is compared by several tasks


def test_texts_compared_at_once_are_as_compared_one_by_one(monkeypatch):
    r = random.Random(8)
    for letters in ("ab", "abcde ", "abcdefghijklmnop é检\U0001f600", "a"):
        for k in range(25):
            q = "".join(r.choice(letters) for _ in range(r.choice([0, 3, 60, 200])))
            texts = ["".join(r.choice(letters) for _ in range(r.randint(0, r.choice([3, 30, 150])))) for _ in range(20)] + [q, q[: len(q) // 2] + "zz" + q[len(q) // 2 :]]
            texts.sort(key=len)
            full = [SequenceMatcher(None, t, q, autojunk=False).ratio() for t in texts]
            held, asked, best = matching.Texts(list(range(22)), texts), matching.Asked(q), (max(full), full.index(max(full)))
            monkeypatch.setattr(matching, "PIECE", 80_000 if k % 2 else 100)
            some, other = np.arange(22), matching.Asked(q[::-1] + "b")
            both = held.ratios([other, asked], held.table([other, asked]), np.array([0, 1] * 22), np.repeat(some, 2), np.full(44, -1.0)).tolist()
            assert both[1::2] == full and both[::2] == [SequenceMatcher(None, t, other.text, autojunk=False).ratio() for t in texts]
            assert all(g == f or (g == -1.0 and f < best[0]) for g, f in zip(held.ratios([asked], held.table([asked]), some * 0, some, np.full(22, best[0])), full, strict=True))
            assert all(2.0 * m >= f * (len(t) + len(q)) or not t + q for m, f, t in zip(held.in_order(asked, some), full, texts, strict=True))
            assert held.best([asked] * 3, [(-1.0, None), (best[0], None), (best[0], -1)]) == [best, best, (best[0], -1)]
    same, asked = matching.Texts([1], ["ab" * 2000]), matching.Asked("ba" * 2000)
    assert same.longest(same.table([asked]), np.array([0]), same.start[:1], same.start[1:], np.array([0]), np.array([4000]), hits=1000) is None


def test_texts_that_cannot_be_nearest_are_not_compared_one_by_one(monkeypatch):
    r, one, calls = random.Random(9), matching.ratio_from, []
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(300)]
    text = lambda: " ".join(r.choice(words) for _ in range(30))
    texts, q = sorted((text() for _ in range(300)), key=len), text()
    monkeypatch.setattr(matching, "ratio_from", lambda *x: calls.append(1) or one(*x))
    best = matching.Texts(list(range(300)), texts).best([matching.Asked(q)], [(-1.0, None)])[0]
    assert best == max(((SequenceMatcher(None, t, q, autojunk=False).ratio(), k) for k, t in enumerate(texts)), key=lambda x: (x[0], -x[1]))
    assert len(calls) < 30


def test_lookup_prefers_the_first_key(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z"), (4, None, None)], "id long, k1 string, k2 string")
    facts = spark.createDataFrame([("a", "y", 1, "old"), ("a", "q", 2, "new"), (None, "y", 3, "by second")], "f1 string, f2 string, o int, v string")
    got = {r.id: (r.v, r.found_by) for r in matching.lookup(rows, facts, ("k1", "f1"), ("k2", "f2"), "o", "v").collect()}
    assert got == {1: ("new", "first"), 2: ("by second", "second"), 3: (None, "none"), 4: (None, "none")}


def test_keep_preferred_by_first_key_there(spark):
    rows = spark.createDataFrame([(1, "i", None, False), (2, "i", "u", True), (3, "", "u", False), (4, "", "u", False), (5, None, None, None)], "n int, id string, url string, ok boolean")
    got = sorted(r.n for r in matching.keep_preferred(rows, [F.col("id"), F.col("url")], F.col("ok"), "n").collect())
    assert got == [2, 3, 5]


def test_evidence_keys(spark):
    rows = spark.createDataFrame([(1, 1, ["zzz"]), (1, 2, ["doc::release-2024"]), (2, 1, ["short"]), (3, 1, [])], "q int, r int, keys array<string>")
    got = {x.q: (x.k, x.matches, x.mrr) for x in matching.retrieval_scores(rows, "q", "r", F.array(F.lit("release-2024"), F.lit("hor")), F.col("keys")).collect()}
    assert got == {1: (2, 1, 0.5), 2: (1, 0, 0.0), 3: (1, 0, 0.0)}


def test_organised_items_and_budget(spark):
    items = spark.createDataFrame([("a", "k", 0.5, 1, ["x", "y"]), ("b", "k", 0.9, 2, ["y", "z", "y"]), ("c", "m", 0.1, 1, [])], "i string, k string, c double, t int, tags array<string>")
    got = {r.group_key: (r.n_items, round(r.confidence, 6), r.tags, r.candidate_id) for r in matching.organised(items, F.col("k"), "i", "c", "t", ["tags"]).collect()}
    assert got["k"] == (2, 0.7, ["y", "z", "x"], "org-" + hashlib.sha1(b"b|a").hexdigest()[:16]) and got["m"][2] is None
    edges = spark.createDataFrame([("a", "b", 9), ("c", "d", 8), ("a", "c", 7), ("e", "a", 6), ("b", "c", 5)], "a string, b string, w long")
    assert [tuple(r) for r in matching.budgeted_graph(edges, "a", "b", "w", 4, 3).collect()] == [("a", "b", 9), ("c", "d", 8), ("a", "c", 7)]


def test_audits(spark):
    e, g = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert sorted(tuple(r) for r in audits.coverage(e, g, "id").collect()) == [(1, "missing"), (3, "unexpected")]
    shards = spark.createDataFrame([("a", 0, 5, 9), ("a", 5, 4, 9), ("b", 0, 5, 9), ("b", 6, 3, 9)], "run string, off int, n int, total int")
    assert {r.run: r.complete for r in audits.contiguous_shards(shards, "run", "off", "n", "total").collect()} == {"a": True, "b": False}
    rows = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), 2.0)], "a double, b double")
    r = audits.weighted_range(rows, {"a": 0.5, "b": 1.0}).first()
    assert (r.n, r.least, r.most) == (2, 0.5, 2.0)
    bad = audits.violations(spark.createDataFrame([(1, "x"), (2, None)], "id int, c string"), "id", [("set", F.col("c").isNotNull()), ("y", F.col("c") == "y")])
    assert sorted(tuple(x) for x in bad.collect()) == [(1, "y"), (2, "set"), (2, "y")]


def test_replacement(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    with pytest.raises(ValueError):
        resampling.replaced(rows, spark.createDataFrame([(3, "x")], "id int, v string"), "id", "v")
    out = resampling.replaced(rows, spark.createDataFrame([(2, None)], "id int, v string"), "id", "v").collect()
    assert sorted((r.id, r.v, r.replaced) for r in out) == [(1, "a", False), (2, None, True)]


def test_recall_has_every_item_and_looks_at_all_of_it(spark):
    from loomspan.plans import catalog

    path = tempfile.mkdtemp()
    docs = [(1, "some start; five six seven eight nine ten, the end"), (2, "one two"), (3, "x One Two y"), (4, None), (5, "")]
    items = [(1, "one two three four five six seven eight nine ten"), (2, "one two"), (3, "in no document at all here"), (4, None), (5, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    got = {r.item_id: (r.ratio, r.hit) for r in catalog.QUERIES["chunk_recall"](spark, path).collect()}
    part = len("fivesixseveneightnineten") / len(items[0][1].replace(" ", ""))
    assert got == {1: (pytest.approx(part), False), 2: (1.0, True), 3: (0.0, False), 4: (0.0, False), 5: (0.0, False)}


def test_hashed_vectors_in_parts(spark):
    docs = spark.createDataFrame([(k, ["a", "b", f"t{k}"] * (k % 3)) for k in range(25)], "id long, toks array<string>").coalesce(1)
    rows = lambda n: [tuple(r) for r in matching.hashed_vectors(docs, "id", F.col("toks"), 8, rows=n).orderBy("id").collect()]
    assert rows(1) == rows(7) == rows(1000) and len(rows(7)) == 25
