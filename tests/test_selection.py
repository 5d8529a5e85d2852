import random
import time

import pytest
from pyspark.sql import functions as F

from loomspan.functions.text import selection_key
from loomspan.operators import datasets, matching


def greedy(rows, quotas, key):
    """Cell by cell, rows sorted by use of their entity and digest."""
    used, out = {}, []
    for category in sorted({r[0] for r in rows}, key=lambda c: (c is not None, c or "")):
        for kind, quota in quotas.items():
            cell = sorted((r for r in rows if r[0] == category and r[1] == kind), key=lambda r: (used.get(r[2], 0), key[r[3], category]))
            for r in cell[:quota]:
                used[r[2]] = used.get(r[2], 0) + 1
                out.append(r)
    return [(*r, i) for i, r in enumerate(out, 1)]


@pytest.mark.parametrize("entities", [2, 9, 60])
def test_least_used_entities(spark, entities):
    r = random.Random(entities)
    rows = [(r.choice(["a", "b", "c", None]), r.choice(["m", "t", "other"]), r.choice([None, *range(entities)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "cat string, kind string, e int, id int")
    key = {(x.id, x.cat): x.k for x in df.select("id", "cat", selection_key(5, F.col("cat"), F.col("id")).alias("k")).collect()}
    for quotas in ({"m": 6, "t": 4}, {"t": 1, "none": 2}, {"m": 90}):
        got = datasets.least_used(df, "cat", "kind", "e", "id", quotas, seed=5).orderBy("place").collect()
        assert [tuple(x) for x in got] == greedy(rows, quotas, key)


def test_every_block_has_the_mix(spark):
    rows = spark.createDataFrame([(("s", "hot")[i % 4 > 0], i) for i in range(400)] + [(None, 1000), (None, 1001), (None, 1002)], "style string, id int")
    got = datasets.block_schedule(rows, "style", "id", {"x": 3, "y": 2}, seed=1).collect()
    blocks = {}
    for r in got:
        blocks.setdefault((r.style, r.block), []).append(r.value)
    assert len(got) == 403 and all(sorted(v) == list("xxxyy") for k, v in blocks.items() if k[0]) and sorted(blocks[None, 0]) == list("xxy")
    assert sorted(map(tuple, datasets.block_schedule(rows.repartition(7), "style", "id", {"x": 3, "y": 2}, seed=1).collect()), key=str) == sorted(map(tuple, got), key=str)


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(row[j - 1], old[j])
    return row[-1]


def test_subsequences_equal_the_plain_table():
    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choice("abcé漢\U0001f600 "[: r.randint(1, 7)]) for _ in range(r.randint(0, 40))) for _ in range(2))
        assert matching.common_subsequence(a, b) == subsequence(a, b)
    a, b = ("".join(r.choice("abcdefghijklmnop ") for _ in range(20_000)) for _ in range(2))
    began = time.time()
    assert matching.common_subsequence(a, b) > 5000 and time.time() - began < 1


def test_recall_by_subsequence(spark):
    pairs = spark.createDataFrame([(1, "abcdef", "axbxcxdxexf"), (1, "abcdef", "zz"), (2, "abcdef", "abzz"), (3, "abc", None), (4, "", "x")], "id int, s string, f string")
    got = {r.id: (round(r.ratio, 3), r.hit) for r in matching.chunk_recall(pairs, "id", "s", "f", method="subsequence").collect()}
    assert got == {1: (1.0, True), 2: (0.333, False), 3: (0.0, False), 4: (0.0, False)}
    text = spark.createDataFrame([("a b\\nc\nd\\",), (None,)], "t string").select(matching.without_breaks(F.col("t")).alias("t")).collect()
    assert [r.t for r in text] == ["abcd\\", ""]
