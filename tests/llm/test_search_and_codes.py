import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspan.llm import lexical, simhash, vectors
from tests.llm.helpers import corpus, extra, frame, prose

# ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    lists = [(i, terms(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in lists), sum(len(t) for _, t in lists)
    out = []
    for item, text in items:
        scores = {}
        for x in set(terms(text)):
            df = sum(x in t for _, t in lists)
            w = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
            for row, (_, t) in enumerate(lists):
                if tf := t.count(x):
                    scores[row] = scores.get(row, 0) + w * ((10**9 * tf) // (1000 * tf + 20 * (50 + (50 * len(t) * n) // total)))
        key = lambda r: (-scores[r], lists[r][0] is None, lists[r][0] or 0)  # noqa: E731, B023
        out += [(item, place, lists[r][0], scores[r]) for place, r in enumerate(sorted((r for r in scores if scores[r] > 0), key=key)[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark):
    rows = corpus() + [(None, "the river", "en", None, 1), (None, "the river", "en", None, 1), (500, "Ärger ÄRGER ärger x1 1x", "de", "s", 1), (501, "river " * 3000 + "stone", "en", "s", 1)]
    items = [(1, rows[7][1]), (2, "THE the River stone"), (3, None), (4, "--"), (5, "nowhere9"), (6, "Ärger 1x"), (6, "ärger"), (None, prose("en", 200, 9))]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("rank", "score", "item", "doc_id")})
    for k, blocks in ((5, 4_000_000), (50, 300)):
        found = lexical.ranked_search(extra(frame(spark, rows)).repartition(5), asked, k=k, block_bytes=blocks)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, found.collect()), key=str) == ranked([(r[0], r[1]) for r in rows], items, k)
    assert lexical.ranked_search(frame(spark, []), asked).count() == 0
    assert lexical.ranked_search(frame(spark), asked.limit(0)).count() == 0


def test_wavelet_tree_finds_the_best_and_opens_few_nodes():
    r = np.random.RandomState(5)
    for docs, terms_, postings in ((1, 3, 3), (2, 4, 5), (700, 40, 9000), (5000, 60, 60000)):
        cell = np.unique(r.randint(0, docs * terms_, postings))
        doc, term = np.divmod(cell, terms_)
        impact = (1 + r.pareto(1.2, len(cell)) * 100).clip(max=900_000).astype(np.int64)
        tree = lexical.Shard(docs, doc, term, impact, terms_)
        ids = np.sort(r.randint(0, 3 * docs, docs))
        w = r.randint(0, 9000, terms_)
        for asked in (np.arange(terms_), r.choice(terms_, 3, replace=False), np.array([0])):
            for k in (1, 50):
                opened = 0

                class Counted(lexical.Best):
                    def may_change(self, bound, least):
                        nonlocal opened
                        opened += len(bound)
                        return super().may_change(bound, least)

                best = Counted(k)
                tree.search(np.sort(asked), w, ids, best)
                score = np.bincount(doc, impact * w[term] * np.isin(term, asked), minlength=docs).astype(np.int64)
                want = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if s > 0)[:k]
                assert [(-s, i) for s, i in zip(best.score.tolist(), best.id.tolist(), strict=True)] == want


def test_words_are_compared_by_bytes():
    v = lexical.Vocabulary(["red Red blue", "", "Été"])
    assert v.n == 3 and [len(x) for x in v.items] == [2, 0, 1]
    assert (v.find(lexical.Words(["green RED blau blue été Été"], ascii_only=True)) >= 0).tolist() == [False, True, False, True, False, True]


# fingerprints


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, most=4):
    """The class of each value, by all pairs."""
    root = list(range(len(values)))
    for i, j in combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= most and root[i] != root[j]:
            a, b = root[i], root[j]
            root = [a if x == b else x for x in root]
    return root


def test_any_four_positions_hold_a_triple():
    found = [set(t) for t in simhash.triples()]
    assert len(found) == 20 and all(any(t <= set(four) for t in found) for four in combinations(range(8), 4))


def test_fingerprints_and_classes_equal_brute_force(spark):
    rows = corpus() + [(600, "  x\x1fy Z", "en", "s", 1), (601, "A\tB\nc  d", "en", "s", 1), (602, "a b C D", "en", "s", 1), (603, "É é", "fr", "s", 1), (None, "a b c d", "en", "s", 1), (None, "only here", "en", "s", 1)]
    got = simhash.fingerprint_classes(extra(frame(spark, rows)))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    values = [plain_fingerprint(r[1]) for r in rows]
    root = classes(values)
    least = {c: min((r[0] for r, x in zip(rows, root, strict=True) if x == c and r[0] is not None), default=None) for c in root}
    want = [(r[0], f"{v:016x}", least[c]) for r, v, c in zip(rows, values, root, strict=True)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert len({least[c] for c, r in zip(root, rows, strict=True) if not (r[1] or "").split()}) == 1
    assert simhash.fingerprint_classes(frame(spark, [])).count() == 0


@pytest.mark.parametrize("longest,pivots", [(4096, 64), (12, 2), (6, 1)])
def test_links_connect_what_all_pairs_connect(spark, longest, pivots):
    """Also where lists are long: chunks and pivots leave classes apart, and the comparison across them finds the rest."""
    r = random.Random(longest)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    values = {r.getrandbits(64) for _ in range(40)} | {0, 2**64 - 1}
    for centre in list(values)[:3]:
        values |= {flip(centre, r.randint(1, 5)) for _ in range(40)}
    chain = [r.getrandbits(64)]
    for _ in range(25):
        chain.append(flip(chain[-1], 4))
    low = {r.getrandbits(40) << 24 | 0xABCDEF for _ in range(40)}  # one list, few links
    values = sorted(values | set(chain) | low)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), longest=longest, pivots=pivots).collect()
    at = {v: i for i, v in enumerate(values)}
    root = list(range(len(values)))
    for x, y in ((at[a % 2**64], at[b % 2**64]) for a, b in links):
        assert 0 < (values[x] ^ values[y]).bit_count() <= 4
        root = [root[x] if c == root[y] else c for c in root]
    same = lambda c: {tuple(i for i in range(len(c)) if c[i] == k) for k in c}
    assert same(root) == same(classes(values))


def test_long_lists_take_few_links():
    r = np.random.RandomState(1)
    f = np.unique((np.uint64(1) << r.randint(0, 64, (3000, 2)).astype(np.uint64)).sum(axis=1, dtype=np.uint64))
    a, b = simhash.forest(f, 4)
    assert len(a) == len(f) - 1 and np.bitwise_count(f[a] ^ f[b]).max() <= 4


# vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    good = [g for g in good if len(g[2]) == len(good[0][2])]
    w = len(good[0][2]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for *_, v in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda c: [min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)]  # noqa: E731, B023
    for _ in range(rounds):
        codes = [pick(c) for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, codes, strict=True) if k[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = [pick(c) for c in cut]
    errors = [sum(far(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes, strict=True)]
    per = {}
    for (_, lab, _), e in zip(good, errors, strict=True):
        per[lab] = per.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, bytes(k).hex(), e, per[lab], digest) for (i, lab, _), k, e in zip(good, codes, errors, strict=True)), key=str)


def vector_rows(n, size, seed):
    r = np.random.RandomState(seed)
    centres = r.randn(7, size)
    return [(i, (centres[r.randint(7)] + r.randn(size) * 0.3).astype(np.float32).tolist(), None if i % 5 == 0 else i % 3) for i in range(n)]


def test_codes_equal_plain_rounds(spark):
    rows = vector_rows(300, 32, 2)
    bad = [(900, None, 1), (901, [1.0] * 31 + [float("nan")], 1), (902, [float("inf")] + [0.0] * 31, 1), (903, [None] + [0.0] * 31, 1), (904, [], 1), (905, [0.5] * 16, 1), (-1, [None] * 32, 1)]
    same = [rows[3], rows[3], (None, rows[4][1], 2), (906, [0.0] * 32, None), (907, [-0.001] * 32, None), *[(1000 + k, rows[9][1], 2) for k in range(150)]]
    schema = "vec_id long, embedding array<float>, label int"
    for use in (rows + bad + same, rows[:10] + bad, same[3:], [rows[0]]):
        got = vectors.compress(spark.createDataFrame(use, schema).withColumns({c: F.lit("x") for c in ("code", "error", "at")}).repartition(3))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_codes(use)
    assert vectors.compress(spark.createDataFrame(bad[:4], schema)).count() == 0
    got = vectors.compress(spark.createDataFrame(rows, schema), rounds=5, entries=9, parts=4)
    assert sorted(map(tuple, got.collect()), key=str) == plain_codes(rows, parts=4, entries=9, rounds=5)
    with pytest.raises(ValueError):
        vectors.compress(spark.createDataFrame([(1, [1.0] * 15, 1)], schema))
    huge = vectors.compress(spark.createDataFrame([(1, [1e30] * 16, 1), (2, [-3e38] * 16, 1)], schema)).collect()
    assert [r.error for r in huge] == [0, 0]


def test_only_violated_bounds_are_rescanned(monkeypatch):
    """Later rounds scan a part of what plain rounds scan, and the codes stay those of plain rounds."""
    v = np.array([x for _, x, _ in vector_rows(4000, 16, 4)])
    v = np.floor(v * 256).astype(np.int64)
    books = vectors.Books(np.ascontiguousarray(v[:16].reshape(16, 4, 4).transpose(1, 0, 2)))
    scanned, plain = [], vectors.scan
    monkeypatch.setattr(vectors, "scan", lambda x, b: (scanned.append(len(x)), plain(x, b))[1])
    code, key, per_round = np.zeros((len(v), 4), np.uint8), np.zeros((len(v), 4), np.float32), []
    for k in range(8):
        scanned.clear()
        change = vectors.assign(books, v, code, key, k == 0)
        per_round.append(sum(scanned))
        for p in range(4):
            assert (code[:, p] == plain(v[:, 4 * p : 4 * p + 4], books.entries[p])[0]).all()
        books = books.updated(change)
    assert per_round[0] == 16_000 and per_round[-1] < 8_000


def test_heaps_pop_up_to_the_limit():
    r = np.random.RandomState(0)
    entry, key = r.randint(0, 5, 200), r.rand(200)
    limit = np.array([0.1, 0.9, -1.0, 2.0, 0.5])
    assert sorted(vectors.Heaps(entry, key, 5).pop(limit)) == np.flatnonzero(key <= limit[entry]).tolist()
