import ast
import os
import random
import subprocess
import sys
import time

import pytest

from loomspan.llm import html, media

PAGES = {
    "items": "<ul>" + "<li>x" * 200_000, "tags": "<a " * 340_000, "cells": "<table>" + "<tr><td>x" * 110_000, "quotes": '<a href="' * 110_000, "deep": "<div>" * 200_000 + "x", "ends": "<div>" * 100_000 + "</p></td>" * 60_000,
    "comments": "<!--" * 250_000, "references": "&" * 1_000_000, "scripts": "<script>" * 120_000, "lists": "<ul>" + "<div>" * 60_000 + "<li></li>" * 60_000, "signs": "<" * 1_000_000, "spaces": "<a" + " " * 1_000_000,
}
BLOBS = {"ftyp": b"\x00\x00\x00\x08ftyp" * 125_000, "gif": b"GIF89a\x01\x00\x01\x00\x00\x00\x00," + b"\x01" * 6 + b"GIF89a!\x01\x01\x01\x01," * 70_000, "chains": (b"GIF89a" + b"!" * 20) * 40_000}


@pytest.mark.parametrize("name", PAGES)
def test_a_megabyte_of_markup_takes_seconds(name):
    began = time.time()
    html.parse(PAGES[name])
    assert time.time() - began < 5


@pytest.mark.parametrize("name", BLOBS)
def test_a_megabyte_of_signatures_takes_seconds(name):
    began = time.time()
    media.sniff(BLOBS[name])
    assert time.time() - began < 5


def test_walks_told_for_all_places_equal_single_ones(monkeypatch):
    r = random.Random(4)
    kinds = set()
    for _ in range(400):
        parts = [b"GIF89a\x01\x00\x01\x00\x00\x00\x00", b"GIF87a\x01\x00\x01\x00\x80\x00\x00123456", b",\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02", b"\x01a\x00", b"!\xfe\x02ab\x00", b"\x00", b";", b"\x00\x00\x00\x0cftypisom", b"\x00\x00\x00\x0amoovxy", b"\x00\x00\x00\x09mdatz", b"xyz"]
        blob = b"".join(r.choices(parts, k=r.randint(1, 60)))
        found = []
        for many in (10**9, -1):
            monkeypatch.setattr(media, "MANY", many)
            media._tables.clear()
            found.append(media.sniff(blob))
        assert found[0] == found[1]
        kinds |= {k for k, *_ in found[0]}
    assert kinds == {"gif", "mp4"}


def text(page, other=None):
    return html.main_text(html.parse(page), other and html.parse(other))


def test_articles_inside_boilerplate_are_none():
    assert text("<aside><article>Teaser</article></aside><article>Real</article>") == "Real"
    assert text('<section class="related-posts"><article>Teaser</article></section><article>Real</article>') == "Real"
    assert text('<article>Real<section class="comments"><article>Reader</article></section></article>') == "Real"
    assert text('<div class="nav-open"><article>Real</article></div>') == "Real"  # the only one there is
    assert text("<main><article>One</article><article>Two</article></main>") == "One\nTwo"


def test_words_of_class_names_inside_an_article():
    for name in ("ad-hoc-analysis", "notice-of-motion", "social-history", "popup-stores"):
        assert text(f'<article>A<div class="{name}">B</div></article>') == "A\nB"
        assert text(f'<p>A</p><div class="{name}">B</div>') == "A"
    for name in ("ad", "ads box", "share-buttons", "related-posts", "newsletter-signup", "ad-slot-top"):
        assert text(f'<article>A<div class="{name}">B</div></article>') == "A"


def test_elements_without_end_tags():
    assert text("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<p>f<dl><dt>g<dd>h<dt>i</dl></article>") == "a\nb\nc\nd\ne\nf\ng\nh\ni"
    assert text('<article><ul><li class="ad">a<li>b</ul><table><tr class="ad"><td>c<tr><td>d<td>e</table></article>') == "b\nd\ne"
    assert text("<article>a &lt;b&gt; <b>c</b>&amp;d &#233;<br>f<!-- <p>x</p> -->g 1 < 2 <3</article>") == "a <b> c&d é fg 1 < 2 <3"
    assert text('<article title="a > b" data-x=\'<p>\'>t<script>var a = "</p><p>";</script>u<img alt="</article>">v</article>after') == "tuv"
    assert text('<article><p>a <button>x</button> b<span class="ad">y</p><p>c</p></article>') == "a b\nc"
    assert text("<article>a<p/>b<div hidden>c</div><svg><text>d</text></svg></article><article>e") == "a\nb\ne"
    assert text("<article>a<p") == "a" and text("<article>a<!-- b") == "a" and text("") == "" and text("<p>x</p><nav>y</nav>") == "x"


def test_pages_without_and_with_several_articles():
    """Differencing by a plain longest common subsequence: lines of a page without an article, articles of one with several."""
    r = random.Random(8)
    words = [f"line {k}" for k in range(6)]

    def plain(a, b):
        best = {}
        for i in range(len(a), -1, -1):
            for j in range(len(b), -1, -1):
                best[i, j] = 0 if i == len(a) or j == len(b) else 1 + best[i + 1, j + 1] if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
        return best[0, 0]

    for _ in range(300):
        a, b = ([r.choice(words) for _ in range(r.randint(0, 8))] for _ in range(2))
        got = text("".join(f"<p>{x}</p>" for x in a), "".join(f"<p>{x}</p>" for x in b)).split("\n") if a else []
        n = plain(a, b)
        assert len([x for x in got if x]) == (len(a) - n if n < len(a) else len(a))
    two = "<article><p>{}</p></article><article><p>{}</p></article>"
    assert text(two.format("own", "shared"), "<p>shared</p>") == "own" and text(two.format("shared", "shared"), "<p>shared</p>" * 2) == "shared\nshared"
    assert text("<article><p>shared</p></article>", "<p>shared</p>") == "shared"


def test_leaks_of_a_long_text_fit_a_small_heap(tmp_path):
    """A text of 15,000 words with 50 places where a long item stands and 50 where a short one does: its hits, each with all words, took gigabytes."""
    script = """
import sys
from pyspark.sql import SparkSession
from loomspan.llm.decontamination import find_leaks
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
item, brief = " ".join(f"t{k}" for k in range(40)), "six words in a row here"
place = lambda n: " ".join(f"x{n}y{k}" for k in range(127)) + f" {item} " + " ".join(f"z{n}y{k}" for k in range(127)) + f" {brief} "
docs = spark.createDataFrame([(1, place(0)), (2, "".join(map(place, range(50)))), (3, "other " * 15000)], "doc_id long, text string")
bench = spark.createDataFrame([(7, item), (8, brief)], "item_id long, text string")
print("FOUND", sorted(map(tuple, find_leaks(docs, bench).collect())))
"""
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": "--driver-memory 700m pyspark-shell", "PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    said = subprocess.run([sys.executable, "-c", script, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND" in said.stdout, said.stderr[-1500:]
    found = {r[:2]: r[2:] for r in ast.literal_eval(said.stdout.rpartition("FOUND")[2].strip())}
    assert {k: v[:2] for k, v in found.items()} == {(1, 7): (40, 40), (1, 8): (6, 6), (2, 7): (40, 40), (2, 8): (6, 6)}
    assert [found[2, k][2] for k in (7, 8)] == [50 * found[1, k][2] for k in (7, 8)] and found[1, 8][2] == 1
