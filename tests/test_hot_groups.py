"""Steps that must not hold a whole group: places in sorted order, digests, blocks of queries."""

import hashlib
import random
from functools import partial

from pyspark.sql import functions as F

from loomspan.functions import percentiles as P
from loomspan.operators import aggregates, datasets, matching


def test_order_statistics_by_sorting(spark):
    r = random.Random(3)
    rows = [("hot", r.choice([1.0, 1.0, 1.0, r.random()])) for _ in range(3000)] + [(None, float(k)) for k in range(10)] + [("one", 5.0), ("one", None), ("none", None)]
    shares = (0.0, 0.5, 0.95, 1.0)
    places = {f"{name}_{k}": partial(place, f=f) for name, place in P.PLACES.items() for k, f in enumerate(shares)}
    got = {x.g: x.asDict() for x in aggregates.order_statistics(spark.createDataFrame(rows, "g string, v double"), "g", "v", places, cuts=8).collect()}
    assert set(got) == {"hot", None, "one"}
    for g, x in got.items():
        v = sorted(v for h, v in rows if h == g and v is not None)
        n = len(v)
        assert x["n"] == n
        for k, f in enumerate(shares):
            assert x[f"truncating_{k}"] == v[min(n - 1, int(f * n))] and x[f"half_even_{k}"] == v[round((n - 1) * f)]
            assert x[f"lower_{k}"] == v[int((n - 1) * f)] and x[f"upper_half_{k}"] == v[min(n - 1, n // 2)]
    assert aggregates.order_statistics(spark.createDataFrame([], "g string, v double"), "g", "v", places).count() == 0


def test_nth_digest_narrows(spark):
    keys = [hashlib.md5(str(k % 700).encode()).hexdigest() for k in range(2000)] + ["a" * 32] * 500
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for n in (1, 17, 1500, 2500, 9999):
        assert datasets.nth_digest(df, "k", n, most=3) == sorted(keys)[min(n, len(keys)) - 1]
    assert datasets.nth_digest(df.limit(0), "k", 4) is None
    split = datasets.hash_split(spark.range(300), F.col("id"), {"none": 0, "dev": 20}).groupBy("split").count().collect()
    assert {x.split: x["count"] for x in split} == {"dev": 20, "rest": 280}


def test_nearest_texts_in_blocks(spark):
    q = spark.createDataFrame([(1, k, "abc " * k) for k in range(9)], "g int, q long, t string")
    c = spark.createDataFrame([(1, 100 + k, "abc " * k + "x") for k in range(9)], "g int, c long, t string")
    ask = lambda n: sorted(map(tuple, matching.nearest_texts(q, c, "g", "q", "t", "c", "t", block_chars=n).collect()))
    assert ask(5) == ask(1_000_000) and len(ask(5)) == 9


def test_ids_of_merged_items_without_their_list(spark):
    items = spark.createDataFrame([(None if k % 3 == 0 else f"k{k % 3}", str(k), float(k % 5), k, ["a"]) for k in range(200)], "k string, i string, c double, t int, u array<string>")
    got = {x.group_key: (x.n_items, x.candidate_id) for x in matching.organised(items, F.col("k"), "i", "c", "t", ["u"]).collect()}
    for name in (None, "k1", "k2"):
        mine = sorted((k for k in range(200) if (None if k % 3 == 0 else f"k{k % 3}") == name), key=lambda k: (-(k % 5), -k))
        assert got[name] == (len(mine), "org-" + hashlib.sha1("|".join(map(str, mine)).encode()).hexdigest()[:16])


def test_cells_are_cut_alike(spark):
    from loomspan.functions.text import selection_key
    from loomspan.operators import evidence

    rows = spark.createDataFrame([(i, "hot" if i % 4 else (None, "b")[i % 8 == 0], i % 2) for i in range(160)] + [(900, "few", 0)], "id int, a string, b int")
    got = {r.id for r in evidence.balanced_down(rows, ["a", "b"], "id", 3, least=3).collect()}
    keys, cells = {r.id: r.k for r in rows.select("id", selection_key(3, F.col("id")).alias("k")).collect()}, {}
    for r in rows.collect():
        cells.setdefault((r.a, r.b), []).append(r.id)
    goal = min(len(c) for c in cells.values() if len(c) >= 3)
    assert got == {i for c in cells.values() for i in sorted(c, key=lambda i: (keys[i], i))[:goal]} and len(got) == sum(min(goal, len(c)) for c in cells.values())
