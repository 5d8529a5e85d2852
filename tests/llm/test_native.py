import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomspan.llm.decontamination import MASKS, MORE_MASKS, drop_leaks, find_leaks
from loomspan.llm.mixing import mix_sources, mixed_documents
from loomspan.llm.sharding import shard_by_bytes
from tests.llm.helpers import corpus, extra, frame, prose


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("n", [1, 3, 24])
def test_shards_are_contiguous_equal_and_gapless(spark, n):
    rows = shard_by_bytes(extra(frame(spark)), n, blocks=5).select("doc_id", "__size", "__shard", "__slot").collect()
    assert len(rows) == len(corpus())
    rows.sort(key=lambda r: (r.doc_id, r["__size"]))
    total, before, slots = sum(r["__size"] for r in rows), 0, defaultdict(list)
    for r in rows:
        assert r["__shard"] == (2 * before + r["__size"]) * n // (2 * total)
        before += r["__size"]
        slots[r["__shard"]].append(r["__slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_equal_rows_cross_shards_one_by_one(spark):
    """Rows that are equal in id, size and checksum, null ids and null texts: places are those of a plain list."""
    rows = [(7, "same words", "en", "s", 1)] * 200 + [(None, f"x{k % 3}", "en", "s", 1) for k in range(40)] + [(8, None, None, None, None)] * 5 + [(k, "a" * (k % 90), "en", "s", 1) for k in range(60)]
    for n in (2, 7, 50):
        got = shard_by_bytes(frame(spark, rows), n, blocks=3, max_broadcast_rows=(0, 10**6)[n % 2]).collect()
        got.sort(key=lambda r: (r["__shard"], r["__slot"]))
        order = [(r.doc_id is not None, r.doc_id or 0, r["__size"], r["__crc"]) for r in got]
        assert order == sorted(order) and len(got) == len(rows)
        total, before, slots = sum(r["__size"] for r in got), 0, defaultdict(list)
        for r in got:
            assert r["__shard"] == (2 * before + r["__size"]) * n // (2 * total)
            before += r["__size"]
            slots[r["__shard"]].append(r["__slot"])
        assert all(s == list(range(len(s))) for s in slots.values())


def test_no_text_in_windows_of_shards(spark, tmp_path):
    frame(spark, [(k, f"text {k}", "en", "s", 1) for k in range(50)]).write.parquet(str(tmp_path / "d"))
    plan = shard_by_bytes(spark.read.parquet(str(tmp_path / "d")), 4)._jdf.queryExecution().optimizedPlan()
    parts = [n.strip() for n in plan.toString().split("\n") if "Window" in n]
    assert len(parts) == 1 and "__n" in plan.toString()  # only rows that repeat a key are numbered, after a filter on its count


def test_sharding_of_an_empty_table(spark):
    assert shard_by_bytes(frame(spark, []), 3).count() == 0


def targets_by_rounds(sizes, cap=3.0):
    """Shares by weight; what is above the cap is dealt out again until nothing is."""
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while True:
        w = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / w > cap * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / w for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            open_.remove(s)
        left = sum(sizes.values()) - sum(out.values())


def test_mix_meets_targets(spark):
    rows = [(i, prose("en", 5 + i % 40, i), "en", f"s{i % 7}" if i % 2 else "hot", 1) for i in range(600)] + [(9000, None, None, None, None), (9001, "a b c", "en", None, 1)]
    mix = mix_sources(extra(frame(spark, rows)), buckets=16).collect()
    again = mix_sources(frame(spark, rows), buckets=16).collect()
    key = lambda r: (r["__id"], r["__copies"])
    assert sorted(map(key, mix)) == sorted(map(key, again))
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += size(text)
    want, taken = targets_by_rounds(sizes), defaultdict(int)
    for r in mix:
        assert r["__copies"] <= 3 and r["__target"] == pytest.approx(want[r["__src"]])
        taken[r["__src"]] += r["__copies"] * r["__size"]
    for s, t in want.items():
        assert t - 45 <= taken[s] <= t + 1e-6 or sizes[s] < 45


def test_odds_of_inclusion_are_unequal(spark):
    """Of one long document and many short ones the long one is taken less often than in an order of plain random numbers."""
    rows = [(i, prose("en", 90 if i == 0 else 5, i), "en", s, 1) for i in range(60) for s in ("a",)] + [(100 + i, prose("fr", 5, i), "fr", "b", 1) for i in range(20)]
    sizes = {i: size(t) for i, t, *_ in rows if i < 100}
    often = plain = 0
    for seed in range(25):
        mix = {r["__id"]: r for r in mix_sources(frame(spark, rows), seed=seed, rounds=1, weights=(1.0, 2.0)).collect()}
        left = mix[1]["__target"] % sum(sizes.values())
        order, upto, got = sorted(sizes, key=lambda i: draw(seed, i, sizes[i])), 0, set()
        for i in order:
            upto += sizes[i]
            got |= {i} if upto <= left else set()
        often += mix[0]["__copies"] > mix[0]["__target"] // sum(sizes.values())
        plain += 0 in got
        p = lambda i: left / (sum(sizes.values()) - sum(x * x for x in sizes.values()) / left / 2) * (1 - sizes[i] / left / 2)  # noqa: B023, E731
        rank = lambda i: (u := draw(seed, i, sizes[i])) / (1 - u) / (p(i) / (1 - p(i)))  # noqa: B023, E731
        upto, want = 0, set()
        for i in sorted(sizes, key=rank):
            upto += sizes[i]
            want |= {i} if upto <= left else set()
        assert {i for i in sizes if mix[i]["__copies"] > mix[i]["__target"] // sum(sizes.values())} == want
    assert often < plain


def draw(seed, i, n):
    return (int(hashlib.md5(f"{seed}:{i}:{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def test_mix_documents_repeats_rows(spark):
    docs = frame(spark)
    copies = mix_sources(docs).agg(F.sum("__copies")).first()[0]
    assert mixed_documents(docs).count() == copies
    assert mix_sources(frame(spark, [])).count() == 0


def test_equal_rows_share_their_copies(spark):
    rows = [(1, "a b c d", "en", "x", 1)] * 5 + [(2, "a b", "en", "y", 1)] * 3
    mix = mix_sources(frame(spark, rows)).collect()
    assert len(mix) == 8
    assert mixed_documents(frame(spark, rows)).count() == sum(r["__copies"] for r in mix)


def test_leaks_tolerate_substitutions_and_leave_clean_documents(spark):
    item = prose("en", 30, "item").split()
    changed = list(item)
    changed[6], changed[20] = "foo", "bar"
    other = list(item)
    for k in range(0, 30, 2):
        other[k] = f"w{k}"
    docs = [
        (1, prose("fr", 50, 1) + " " + " ".join(item).upper() + ", " + prose("fr", 20, 2), "en", "a", 1), (2, "x " + "; ".join(changed), "en", "a", 1),
        (3, " ".join(other), "en", "a", 1), (4, prose("de", 80, 4), "de", "a", 1), (5, None, None, None, None), (6, "", None, None, None), (7, " ".join(item[5:25]), "en", "b", 1),
    ]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "short one"), (12, None), (10, " ".join(item))], "item_id long, text string")
    for limit in (500_000, 3):  # in one part, and in many
        found = find_leaks(extra(frame(spark, docs)), bench, max_broadcast_seeds=limit).collect()
        assert {(r.doc_id, r.item_id) for r in found} == {(1, 10), (2, 10), (7, 10)}
        best = {r.doc_id: (r.matched, r.overlap) for r in found}
        assert best[1] == (30, 30) and best[2] == (28, 30) and best[7] == (20, 20)
    kept = drop_leaks(frame(spark, docs), find_leaks(frame(spark, docs), bench))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def leaks(doc, item):
    """Whether some alignment has a span of 13 tokens or more with 80 % equal, by brute force."""
    if len(item) < 13:
        return len(item) >= 5 and any(doc[k : k + len(item)] == item for k in range(len(doc)))
    for shift in range(-len(item) + 13, len(doc) - 12):
        same = [doc[k + shift] == item[k] for k in range(max(0, -shift), min(len(item), len(doc) - shift))]
        if any(5 * sum(same[s : s + n]) >= 4 * n for n in range(13, len(same) + 1) for s in range(len(same) - n + 1)):
            return True
    return False


def test_seeds_hit_every_allowed_pattern():
    for n in range(13, 26):  # a longer span holds one of these
        for off in itertools.combinations(range(n), n // 5):
            hit = [any(not any(bit == "1" and s + i in off for i, bit in enumerate(mask)) for s in range(n - len(mask) + 1)) for mask in MASKS + MORE_MASKS]
            assert any(hit), (n, off)


def test_short_and_much_changed_passages_leak(spark):
    item = [f"t{k}" for k in range(60)]
    docs = []
    for n in range(11, 19):  # passages inside the item, in other surroundings
        docs += [[f"x{k}" for k in range(20)] + item[at : at + n] + [f"y{k}" for k in range(20)] for at in (0, 7, 60 - n)]
    docs += [[w if k % m != at else "z" for k, w in enumerate(item)] for m in (3, 4, 5, 6) for at in range(m)]
    r = random.Random(1)
    for _ in range(150):
        n, at = r.randint(12, 26), r.randint(0, 34)
        off = set(r.sample(range(n), r.randint(n // 5, n // 5 + 1)))
        docs.append(["x"] * 9 + ["z" if k in off else item[at + k] for k in range(n)] + ["y"] * r.choice((0, 9)))
    rows = [(k, " ".join(d), "en", "a", 1) for k, d in enumerate(docs)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[20:33])), (3, " ".join(item[7:18])), (4, " ".join(item[40:45])), (5, "t1 t2 t3 t4")], "item_id long, text string")
    items = {1: item, 2: item[20:33], 3: item[7:18], 4: item[40:45], 5: item[1:5]}
    found = {(x.doc_id, x.item_id) for x in find_leaks(frame(spark, rows), bench).collect()}
    want = {(k, i) for k, d in enumerate(docs) for i, t in items.items() if leaks(d, t)}
    assert found == want and 0 < len(want) < 3 * len(docs) and {i for _, i in want} == {1, 2, 3, 4}


def test_leaks_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(frame(spark), bench).count() == 0
    assert find_leaks(frame(spark, []), bench).count() == 0


def test_leaks_equal_their_sql_on_planted_passages(spark, tmp_path):
    """Passages of 13 to 16 tokens from inside longer items with every number of substitutions, an item without spaces, short and repeated items."""
    import duckdb

    from loomspan.llm import sql

    r = random.Random(6)
    items = [(k, " ".join(f"w{k}x{i}" for i in range(30 + k))) for k in range(12)]
    unspaced = "本次评测共收录三十六个字符的中文题目并且没有任何空格或者标点符号用于测试"
    items += [(100, unspaced), (101, "five words in a row"), (102, None), (103, "too short"), (0, items[0][1])]
    docs = [(500, "前文" + unspaced + "后文"), (501, unspaced), (502, "say five words in a row, five words in a row"), (503, None), (504, ""), (505, "too short"), (506, "same " * 400), (None, items[3][1]), (500, "again")]
    for k in range(12):
        for n in (12, 13, 14, 15, 16, 20):
            words = items[k][1].split()
            at = r.randint(0, len(words) - n)
            part = words[at : at + n]
            for place in r.sample(range(n), r.randint(0, n // 5 + 1)):
                part[place] = f"other{place}"
            docs.append((k * 100 + n, f"{prose('en', 9, k)} {' '.join(part)} {prose('en', 9, n)}"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}/*.parquet'")
    d, b = (spark.read.parquet(str(tmp_path / t)) for t in ("documents", "benchmark"))
    want = sorted(con.execute(f"SELECT doc_id, item_id, matched, overlap, hits FROM ({sql.decontamination()})").fetchall(), key=str)
    for kw in ({}, {"max_broadcast_seeds": 300, "max_broadcast_bytes": 0}):
        assert sorted(map(tuple, find_leaks(d, b, **kw).collect()), key=str) == want
    pairs = {(r[0], r[1]) for r in want}
    assert {(500, 100), (501, 100), (502, 101), (None, 3)} <= pairs and not {p for p in pairs if p[1] in (102, 103)} and 20 < len(pairs) < 70
