import hashlib
import html as html_lib
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import html, language, media, pii, substrings, tokens
from loomspan.llm.common import Words
from loomspan.llm.components import components
from loomspan.llm.jaccard import one_of_each, similarity_classes
from tests.llm.helpers import corpus, extra, frame, prose

# language


def test_viterbi_is_the_best_path():
    r = np.random.RandomState(3)
    for n, k, penalty in ((1, 3, 1.0), (7, 2, 0.5), (150, 3, 1.5), (300, 4, 3.0)):
        s = r.randn(n, k).astype(np.float32)
        got = language.viterbi(s, np.array([0, n]), penalty)
        value = lambda p: sum(s[i, p[i]] for i in range(n)) - penalty * sum(p[i] != p[i - 1] for i in range(1, n))  # noqa: E731, B023
        best = s[0].copy()
        for i in range(1, n):
            best = np.maximum(best, best.max() - penalty) + s[i]
        assert value(got) == pytest.approx(float(best.max()), abs=1e-3)


def test_language_of_texts_and_spans(spark):
    docs = frame(spark)
    model = language.fit(docs.filter(~language.held_out()))
    mixed = prose("en", 40, "a") + " " + prose("de", 40, "b")
    rows = corpus() + [(900, mixed, None, None, 1), (901, "…  — 12 😀 ²", None, None, 1), (902, "1234567890123the", None, None, 1)]
    found = {r.doc_id: r for r in language.identify(extra(frame(spark, rows)), model).collect()}
    right = [found[i].lang_pred == lang for i, text, lang, _, _ in rows if lang and text and any(c.isalpha() for c in text)]
    assert sum(right) / len(right) > 0.97
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and found[i].spans == [] for i in (400, 401, 402, 901))
    assert found[902].lang_pred != "und" and found[902].n_words == 1
    assert [s.lang for s in found[900].spans] == ["en", "de"] and abs(found[900].spans[1].first_word - 40) <= 3
    assert language.spoken(frame(spark), model).columns == docs.columns
    foreign = " ".join(random.Random(3).choice(["qzxv", "wkjh", "pqqz", "vvwx"]) + str(k) for k in range(60))
    every = [(1, " ".join(prose(x, 10, f"{x}{k}") for k in range(4) for x in ("en", "fr", "de")), None, None, 1), (2, foreign, None, None, 1), (3, "qzxv", None, None, 1)]
    assert {r.doc_id for r in language.spoken(frame(spark, every), model).collect()} == {1, 3}
    assert {r.doc_id for r in frame(spark).collect()} - {r.doc_id for r in language.spoken(frame(spark), model).collect()} == {400, 401, 402}


def test_scores_and_held_out_accuracy_by_brute_force(spark):
    rows = [(i, prose(lang, 30, f"{lang}{i}"), lang, "s", 1) for i in range(240) for lang in (("en", "fr", "de")[i % 3],)]
    docs = frame(spark, rows)
    model = language.fit(docs.filter(~language.held_out()))
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and sum(found[i].lang_pred == lang for i, _, lang, *_ in held) / len(held) > 0.97
    for i, text, *_ in rows[:40]:  # a plain path over the words one by one
        w = Words([text])
        s, lettered, _ = model.scores(w)
        best, back = s[0].copy(), []
        for x in s[1:]:
            back.append([int(np.argmax(best - 10.0 * (np.arange(len(best)) != k))) for k in range(len(best))])
            best = np.array([best[back[-1][k]] - 10.0 * (back[-1][k] != k) for k in range(len(best))]) + x
        path = [int(np.argmax(best))]
        for step in reversed(back):
            path.append(step[path[-1]])
        votes = np.bincount(np.array(path[::-1])[lettered], minlength=3)
        assert found[i].lang_pred == model.langs[int(votes.argmax())] and found[i].score == pytest.approx(votes.max() / votes.sum())


def test_language_without_training_data(spark):
    model = language.fit(frame(spark, []))
    assert {r.lang_pred for r in language.identify(frame(spark), model).collect()} == {"und"}
    assert language.identify(frame(spark, []), model).count() == 0


def test_scripts_narrow_candidates():
    w = Words(["дом Haus 漢字 42 4you"])
    script, lettered = language.word_scripts(w)
    assert [language.NAMES[s] for s in script[lettered]] == ["cyrillic", "latin", "han", "latin"] and lettered.tolist() == [True, True, True, False, True]


# n-gram join


def brute_classes(rows, n=5, threshold=0.8):
    sets = []
    for i, text, *_ in rows:
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    links = {k: [j for j, (_, b) in enumerate(sets) if j != k and a and len(a & b) >= threshold * len(a | b) - 1e-9] for k, (_, a) in enumerate(sets)}
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[k], *[label[j] for j in links[k]]], key=lambda x: sets[x][0]) for k in range(len(rows))]
    return sorted((sets[k][0], sets[label[k]][0], len(links[k])) for k in range(len(rows)))


@pytest.mark.parametrize("limit", [2000, 3])
def test_similarity_classes_by_brute_force(spark, limit):
    rows = corpus()
    got = sorted(tuple(r) for r in similarity_classes(extra(frame(spark, rows)), limit=limit).collect())
    assert got == brute_classes(rows)


def test_one_document_of_each_class_stays(spark):
    docs = frame(spark)
    left = [r.doc_id for r in one_of_each(docs, similarity_classes(docs)).collect()]
    kept = set(left)
    assert left.count(3) == 1 and left.count(400) == 1
    nulls = [(None, "a b c d e f", "en", "s", 1)] * 3 + [(None, "other words stand here for once", "en", "s", 1), (None, None, None, None, None)]
    assert sorted(r.text or "" for r in one_of_each(frame(spark, nulls), similarity_classes(frame(spark, nulls))).collect()) == ["", "a b c d e f", "other words stand here for once"]
    assert {4, 7, 400, 401, 402} <= kept and not kept & {200, 201, 205, 300, 303}
    assert similarity_classes(frame(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: y for x, y in label.items() if any(a != b and x in (a, b) for a, b in edges)}


# repeated substrings


def brute_removal(rows, length):
    first = {}
    for i, text, *_ in rows:
        b = (text or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text, *_ in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = True
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [8_000_000, 300])
def test_repeats_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "SHARD_BYTES", 3000)
    monkeypatch.setattr(substrings, "HOT_WINDOWS", hot)
    r = random.Random(2)
    passage = "".join(r.choice("ab é") for _ in range(90))
    rows = corpus() + [(500 + k, prose("en", 10, k) + passage[k : 70 + k] + "a" * (40 + 5 * k), "en", "s", 1) for k in range(12)] + [(600, "a" * 300, "en", "s", 1), (601, "\0" * 120, "en", "s", 1), (602, "\0" * 70 + "b", "en", "s", 1)]
    long = prose("en", 2500, 1)  # several shards: parts of it stand before and after a text of its own, cut at other places
    rows += [(610, long[70:5000] + "zz" + long[5100:], "en", "s", 1), (611, prose("fr", 20, 9) + long, "en", "s", 1), (3, long[:7000], "en", "s", 1)]
    r.shuffle(rows)
    found = substrings.remove_repeats(extra(frame(spark, rows)), keep_text=True).collect()
    assert sorted(tuple(x)[:5] for x in found) == brute_removal(rows, 50)
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 and len(x.kept) == x.n_bytes - x.n_removed for x in found)


def test_repeats_of_empty_tables_and_null_ids(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    rows = [(None, "x" * 60, None, None, None), (1, "x" * 60, None, None, None)]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(frame(spark, rows)).collect()}
    assert got == {None: 0, 1: 0}


def test_suffix_array_and_common_prefixes():
    r = np.random.RandomState(1)
    for n in (1, 9, 60, 700):
        text = r.randint(97, 99, n).astype(np.uint8)
        end = np.where(np.arange(n) < n // 2, n // 2, n)
        order, rank = substrings.suffix_array(text, end, 50)
        suffix = [text[i : end[i]].tobytes()[:50] for i in order]
        assert suffix == sorted(suffix)
        lcp = substrings.common_prefixes(text, end, order, rank, 50)
        for a, b, n_same in zip(suffix, suffix[1:], lcp[1:], strict=False):
            assert n_same == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


# personal data

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub(r"\D", "", s)) <= 15),
]


def test_patterns_match_plain_regular_expressions():
    r = random.Random(4)
    parts = list("ab1234567890.@-+%_ ()é") + ["4111 1111 1111 1111", "a@b.co", "10.0.0.1", "+1 (555) 123-4567"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PLAIN) for m in re.finditer(p, text) if ok(m[0]))
        assert pii.base_spans(text) == [(s, e, PLAIN[k][0]) for s, k, e in want]


def test_very_long_numbers():
    assert pii.base_spans("0" * 6000 + "1.2.3.4") == [(0, 6007, "ip")]
    assert pii.base_spans("9" * 6000 + ".2.3.4") == []
    began = time.time()
    assert pii.base_spans("7" * 1_000_000) == pii.base_spans("7." * 500_000)[:0] and time.time() - began < 20


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_terms_that_disclose_entities(spark):
    rows = [(i, f"{prose('en', 20, i)} write Zorblatt at z@q.org the {prose('en', 9, i)}", "en", "s", 1) for i in range(3)] + [(10 + i, prose("en", 60, i) + " the", "en", "s", 1) for i in range(30)] + [(99, None, None, None, None)]
    found = {r.doc_id: r for r in pii.find_personal_data(extra(frame(spark, rows))).collect()}
    text = rows[0][1]
    at, mail = text.index("Zorblatt"), text.index("z@q.org")
    assert f"term:{at}:{at + 8}" in found[0].spans.split(",") and f"email:{mail}:{mail + 7}" in found[0].spans.split(",")
    assert "term" not in found[10].spans and found[99].spans == "" and found[0].n_email == 1
    the = text.index(" the ", mail) + 1
    assert f"term:{the}:{the + 3}" not in found[0].spans
    assert found[0].base_sha256 == hashlib.sha256(f"email:{mail}:{mail + 7}".encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.sanitised(frame(spark, rows), pii.find_personal_data(frame(spark, rows))).collect()}
    assert "<email>" in clean[0] and "Zorblatt" not in clean[0] and clean[99] is None and clean[10] == rows[3][1]
    assert pii.find_personal_data(frame(spark, [])).count() == 0


def test_terms_count_wherever_they_stand(spark):
    far = f"Zorblatt 7Quuxel8 {' ' * 90} {'w' * 70} "
    rows = [(i, f"{far}{prose('en', 200, i)} write z@q.org or +49 30 1234567{i}", "en", "s", 1) for i in range(3)] + [(10 + i, prose("en", 260, i) + " write", "en", "s", 1) for i in range(60)]
    found = {r.doc_id: r for r in pii.find_personal_data(frame(spark, rows)).collect()}
    for i in range(3):
        text, spans = rows[i][1], found[i].spans.split(",")
        ends = [(int(s), int(e)) for k, s, e in (x.split(":") for x in spans) if k == "term"]
        assert {text[s:e] for s, e in ends} >= {"Zorblatt", "Quuxel", "w" * 70} and "write" not in {text[s:e] for s, e in ends}
        assert found[i].n_term == len(ends)
    assert all(found[10 + i].n_term == 0 for i in range(60))


# media


def a_png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing_confirms_structure_and_carves():
    import gzip
    import io
    import zipfile

    png, wav, gz = a_png(), media.to_wav(b"abcd"), gzip.compress(b"hello" * 20)
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    blob = b"junk" + png + b"--" + wav + gz + z.getvalue() + b"BM not a bitmap" + png[:-1]
    kinds = [(k, blob[at : at + n]) for k, at, n in media.sniff(blob)]
    assert kinds == [("png", png), ("wav", wav), ("gzip", gz), ("zip", z.getvalue())]
    began = time.time()
    assert media.sniff(b"PK\x03\x04" * 250_000) == [] and time.time() - began < 20
    assert media.sniff(b"") == [] and media.sniff(png.replace(b"IDAT", b"IDAX")) == []


def test_declared_types_are_corrected(spark):
    rows = [(1, "image/png", a_png()), (2, "image/gif", a_png() + media.to_wav(b"ab")), (3, None, None), (4, "text/plain", b"")]
    got = {r.i: r for r in media.correct_types(spark.createDataFrame(rows, "i int, said string, b binary"), "b", "said", ("i",)).collect()}
    assert (got[1].media_type, got[1].corrected) == ("image/png", False)
    assert got[2].media_type == "image/png" and got[2].corrected and bytes(got[2].embedded[0].content) == media.to_wav(b"ab")
    assert got[3].media_type == got[4].media_type == "application/octet-stream"


def test_texts_round_trip_through_media(spark):
    docs = frame(spark)
    got = media.store_texts(extra(docs), keep_media=True).collect()
    want = {i: (t or "").encode() for i, t, *_ in corpus()}
    assert len(got) == len(corpus())
    for r in got:
        raw = want[r.doc_id]
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert media.samples(bytes(r.media)) == payload and r.n_bytes == len(raw) and r.payload_bytes == len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()


# html

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>";</script></head><body><nav><ul><li>Menu</li></ul></nav><div class="ad">Buy</div>
<article><h1>Head &amp;  more</h1><p>One <b>bold<br>line.<p>Two&nbsp;x &lt;tag&gt;<div class="share">Share</div><form><p>Mail</p></form><ul><li>item</li></ul><section id="comments"><p>Nice!</p></section></article><footer>&copy; foot</footer></body></html>"""


def test_articles_are_taken_whole(spark):
    rows = [(1, "http://a.org/x/1", PAGE), (2, "http://a.org/x/2", PAGE), (3, "http://a.org/y", PAGE[: PAGE.index("<footer>")]), (4, None, None), (5, "u", "")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "Head & more\nOne bold line.\nTwo x <tag>\nitem"
    assert got == {1: text, 2: text, 3: text, 4: "", 5: ""}


def test_shared_lines_of_neighbours_are_deleted(spark):
    page = lambda k: f"<html><body><div>Site name</div><div>All rights</div><p>Story {k} of many</p><p>More {k}</p><div>Imprint</div></body></html>"
    card = "<article><p>Read us daily</p></article>"
    rows = [(k, f"https://b.org/news/{k:02d}?q=1", page(k)) for k in range(40)] + [(100, "https://c.org/", page(100)), (101, None, page(101)), (102, None, page(102))]
    rows += [(200 + k, "https://d.org/same", f"{card}<article><header class='top-header'><h1>T{k}</h1></header><p>Own {k}</p><div class='story-share-of-market'>Kept</div></article>") for k in range(3)]
    frame_ = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(1)})
    own = lambda k: f"Story {k} of many\nMore {k}"
    want = {k: own(k) for k in (*range(40), 101, 102)} | {100: f"Site name\nAll rights\n{own(100)}\nImprint"} | {200 + k: f"T{k}\nOwn {k}\nKept" for k in range(3)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 17):  # results do not depend on how the pages are cut into ranges
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert {r.page_id: r.text for r in html.extract(frame_).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert html.extract(frame_.limit(0)).count() == 0


def test_long_and_repeated_pages(spark):
    long = "<article>" + "<p>line &amp; more</p>" * 20_000 + "</article>"
    rows = [(1, "http://a.org/1", long), (1, "http://a.org/1", long), (None, "http://a.org/1", "<main><p>x</p></main>")]
    got = sorted(r.n_chars for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [1, 20_000 * 12 - 1, 20_000 * 12 - 1]


def test_longest_common_subsequence():
    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        got = html.common(a, b)
        it = iter(b)
        assert len(got) == best[-1, -1] and all(a[i] in it for i in sorted(got))


def test_entities_are_decoded_like_the_standard_library():
    for raw in ("&eacute;&#233;&#x1F600;", "a &amp;amp; b", "&notanentity; &copy"):
        assert html.main_text(html.parse(f"<article><p>{raw}</p></article>"), None) == " ".join(html_lib.unescape(raw).split())


# tokens


@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json")


def test_counts_equal_the_library(spark, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    r = random.Random(1)
    parts = list("abcsdtmrl' ’\n\t\r\x0b\x1c\x85 　019²½éßñ漢字かАБ!?.,-_́😀\x00") + ["'s", "'ll", " 've", "<|endoftext|>", "  ", "aaaa"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["ab" * 3000, "x" * 5001, "<|endoftext|>", prose("de", 3000, 1).replace(" ", ""), "漢字かな" * 2000]
    assert tokens.Counter(vocabulary).count(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    got = {(r.doc_id, r.n_tokens, r.n_bytes, r.over_limit) for r in tokens.count_tokens(extra(frame(spark)), vocabulary).collect()}
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x, *_ in corpus()}
    assert got == {(i, len(want[i]), len((x or "").encode()), len(want[i]) > 1024) for i, x, *_ in corpus()}
    assert tokens.count_tokens(frame(spark, []), vocabulary).count() == 0
    began = time.time()
    assert tokens.Counter(vocabulary).count(["a" * 1_000_000, prose("en", 200_000, 2).replace(" ", "")])[0] == 250_000 and time.time() - began < 60


# pipeline


def test_pipeline_by_brute_force(spark, tmp_path):
    """The rows that run() keeps and how often, by plain code; the language model and the order of the mix are those of the operators."""
    import corpus_pipeline
    from loomspan.llm.mixing import mix_sources

    rows = [*corpus(), (None, "a row without an id has no class of its own", "en", "s1", 1)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    leak = " ".join(corpus()[10][1].split()[:25])
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = [r for r in rows if r[0] not in (400, 401, 402)]  # without letters
    classes = {(i, c) for i, c, _ in brute_classes([r for r in rows if r[0] is not None])}
    kept = [r for r in dict.fromkeys(rows) if r[0] is None or ((r[0], r[0]) in classes and r[0] != 10)]
    want = {r["__id"]: r["__copies"] for r in mix_sources(frame(spark, kept)).collect()}
    got = {i: [r.doc_id for r in out].count(i) for i in want}
    assert got == want and sum(want.values()) == len(out) > 20
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline_of_empty_tables_and_clashing_names(spark, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([], "item_id long, text string")
    for name, docs in (("none", frame(spark, [])), ("names", extra(frame(spark)))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        out.write.parquet(str(tmp_path / name / "out.parquet"))
        assert len(set(out.columns)) == len(out.columns) and {"shard", "slot"} <= set(out.columns)
        assert (out.count() > 0) == (name == "names")
