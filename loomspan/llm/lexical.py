"""Ranked lexical search with integer BM25 scores: dual-sorted wavelet trees over the postings of each shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import Words, steps, stored

#: Postings of one shard, unless a document alone has more.
SHARD = 1_000_000
#: Nodes that one step of a search opens, times terms.
STEP = 60_000
NO_ID = np.iinfo(np.int64).max


class Vocabulary:
    """The terms of a block of items, by number; words of texts are found by hash and compared byte by byte."""

    def __init__(self, texts: list[str]):
        w = Words(texts, ascii_only=True)
        _, first = np.unique(w.hash, return_index=True)
        self.hash = w.hash[first]
        self.size = w.end[first] - w.start[first]
        self.start = np.cumsum(self.size) - self.size
        self.buf = w.buf[self.spread(w.start[first], self.size)]
        self.n = len(first)
        number = self.find(w)
        if (number < 0).any():
            raise ValueError("two terms share a hash")
        self.items = [np.unique(number[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]

    @staticmethod
    def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Indexes of all bytes of ranges, one range after the other."""
        return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))

    def find(self, w: Words) -> np.ndarray:
        """The number of each word, -1 for words that no item has."""
        out = np.full(len(w.hash), -1, np.int64)
        if not self.n:
            return out
        at = np.minimum(np.searchsorted(self.hash, w.hash), self.n - 1)
        hit = np.flatnonzero((self.hash[at] == w.hash) & (self.size[at] == w.end - w.start))
        if len(hit):
            own, size = at[hit], self.size[at[hit]]
            unlike = w.buf[self.spread(w.start[hit], size)] != self.buf[self.spread(self.start[own], size)]
            wrong = np.add.reduceat(unlike, np.cumsum(size) - size)
            out[hit[wrong == 0]] = own[wrong == 0]
        return out


def postings(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(__id, n, terms, tfs) of each document: its length in terms, and which of the vocabulary it has how often.

    A row for each task carries, in ``dfs``, how many of the task's documents have each term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfs = np.zeros(vocabulary.n, np.int64)
        for part, texts in steps(batches, "__text"):
            w = Words(texts, ascii_only=True)
            term = vocabulary.find(w)
            known = term >= 0
            cell, tf = np.unique(w.doc[known] * max(vocabulary.n, 1) + term[known], return_counts=True)
            doc, term = np.divmod(cell, max(vocabulary.n, 1))
            dfs += np.bincount(term, minlength=vocabulary.n)
            ends = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(np.diff(w.first)), *lists, pa.nulls(len(texts), pa.list_(pa.int64()))], ["__id", "n", "terms", "tfs", "dfs"])
        if dfs.any():
            yield pa.RecordBatch.from_pydict({"__id": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "terms": pa.nulls(1, pa.list_(pa.int32())), "tfs": pa.nulls(1, pa.list_(pa.int32())), "dfs": pa.array([dfs.tolist()])})

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, "__id long, n long, terms array<int>, tfs array<int>, dfs array<bigint>")


class Shard:
    """A wavelet tree over the postings of some documents. In its root the postings of a term stand together, highest impact first;
    each level deals them out by one more bit of the document's place in order of ids, in the same order. A node is thus a range of ids, the
    first of a term's postings in it is the highest, and the sum of these bounds the score of every document below."""

    def __init__(self, docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        order = np.lexsort((doc, -impact, term))
        d, imp = doc[order].astype(np.int32), impact[order].astype(np.int32)
        self.first = np.searchsorted(term[order], np.arange(terms + 1))
        self.n, self.levels = len(d), max(1, int(docs - 1).bit_length())
        self.ones = np.zeros((self.levels, self.n + 1), np.int32)  # how many of the first i postings go to the upper half
        self.impact = np.empty((self.levels + 1, self.n), np.int32)
        self.zeros = np.zeros(self.levels, np.int64)
        for k in range(self.levels):
            self.impact[k] = imp
            upper = (d >> (self.levels - 1 - k)) & 1 == 1
            np.cumsum(upper, out=self.ones[k, 1:])
            order = np.concatenate([np.flatnonzero(~upper), np.flatnonzero(upper)])
            self.zeros[k] = self.n - self.ones[k, -1]
            d, imp = d[order], imp[order]
        self.impact[self.levels] = imp

    def search(self, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, best: Best) -> None:
        """Put the shard's highest-scoring documents into ``best``: the nodes of highest bound are opened first, and none whose bound
        cannot reach the place that counts. ids: of the documents, ascending."""
        lo, hi = self.first[terms], self.first[terms + 1]
        some = hi > lo
        lo, hi, w = lo[some], hi[some], weights[terms[some]]
        if not len(w):
            return
        ones, impact = self.ones.ravel(), self.impact.ravel()
        bound, level, place, lo, hi = np.array([NO_ID]), np.zeros(1, np.int64), np.zeros(1, np.int64), lo[None], hi[None]
        at_once = max(1, STEP // len(w))
        while len(bound):
            if len(bound) > at_once:
                top = np.zeros(len(bound), bool)
                top[np.argpartition(-bound, at_once)[:at_once]] = True
            else:
                top = np.ones(len(bound), bool)
            k, at, a, b = level[top], place[top], lo[top], hi[top]
            base = (k * (self.n + 1))[:, None]
            up_a, up_b, zeros = ones[base + a].astype(np.int64), ones[base + b].astype(np.int64), self.zeros[k][:, None]
            k, at = np.concatenate([k, k]) + 1, np.concatenate([2 * at, 2 * at + 1])
            a, b = np.concatenate([a - up_a, zeros + up_a]), np.concatenate([b - up_b, zeros + up_b])
            has = b > a
            high = np.where(has, impact[(k * self.n)[:, None] + np.minimum(a, self.n - 1)], 0).astype(np.int64)
            s, alive = high @ w, has.any(axis=1)
            leaf = alive & (k == self.levels)
            best.add(s[leaf], ids[at[leaf]])
            keep, old = alive & ~leaf, ~top
            bound, level, place = np.concatenate([bound[old], s[keep]]), np.concatenate([level[old], k[keep]]), np.concatenate([place[old], at[keep]])
            lo, hi = np.concatenate([lo[old], a[keep]]), np.concatenate([hi[old], b[keep]])
            open_ = best.may_change(bound, ids[np.minimum(place << (self.levels - level), len(ids) - 1)])
            bound, level, place, lo, hi = bound[open_], level[open_], place[open_], lo[open_], hi[open_]


class Best:
    """The k highest scores above 0, equal ones by ascending id."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = (score > 0) & self.may_change(score, ids)
        if good.any():
            s, i = np.concatenate([self.score, score[good]]), np.concatenate([self.id, ids[good]])
            order = np.lexsort((i, -s))[: self.k]
            self.score, self.id = s[order], i[order]

    def may_change(self, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Which documents or ranges of them, by score bound and smallest id, can still come in."""
        if len(self.score) < self.k:
            return np.ones(len(bound), bool)
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (least_id < self.id[-1]))


def search_block(docs: DataFrame, texts: list[str], k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, __id, score): each shard's k best documents for each item text by its place in the list."""
    vocabulary = Vocabulary(texts)
    held = stored(postings(docs, vocabulary, id_col, text_col))
    stats = held.filter(F.col("dfs").isNull()).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("length")).first()
    n, length = stats["docs"], max(stats["length"] or 0, 1)
    df = np.zeros(vocabulary.n, np.int64)
    for r in held.select(F.posexplode("dfs").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():  # a number for each term of the block
        df[r["at"]] = r["x"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, waiting, size = [Best(k) for _ in texts], [], 0

        def shard() -> None:
            ids = np.concatenate([x[0] for x in waiting])
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            count, term, tf, m = (np.concatenate([x[i] for x in waiting]) for i in (1, 2, 3, 4))
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, count))
            tree = Shard(len(ids), np.repeat(rank, count), term, impact, vocabulary.n)
            for terms, found in zip(vocabulary.items, best, strict=True):
                tree.search(terms, weights, ids[order], found)

        for batch in batches:
            lengths = batch.column("terms").value_lengths().to_numpy()
            upto = np.r_[0, np.cumsum(lengths)]
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + SHARD - size, "right")) - 1)
                b = batch.slice(lo, hi - lo)
                ids = b.column("__id").fill_null(NO_ID).to_numpy().astype(np.int64)
                m = 50 + (50 * b.column("n").to_numpy().astype(np.int64) * n) // length
                waiting.append((ids, lengths[lo:hi], b.column("terms").flatten().to_numpy().astype(np.int64), b.column("tfs").flatten().to_numpy().astype(np.int64), m))
                size += int(upto[hi] - upto[lo])
                lo = hi
                if size >= SHARD or lo < batch.num_rows:
                    shard()
                    waiting, size = [], 0
        if waiting:
            shard()
        for item, found in enumerate(best):
            if len(found.id):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.id), item, np.int32)), pa.array(found.id, mask=found.id == NO_ID), pa.array(found.score)], ["item", "__id", "score"])

    return held.filter(F.size("terms") > 0).select("__id", "n", "terms", "tfs").mapInArrow(run, "item int, __id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 4_000_000) -> DataFrame:
    """(item, rank, id, score): the k best documents for each row of ``items``, by score and then ascending id.

    Items are looked for in blocks of about ``block_bytes`` of their texts, a pass over the documents each; a block's texts and the
    numbers of its terms are what the driver and each task hold of them. Documents without an id come last among equals, rows that
    repeat an id rank each for itself, and so do rows that repeat an item. An item without terms, or whose terms no document has, has
    no row. Ids of documents are whole numbers below 2**63 - 1.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("__item"), F.coalesce(F.col(item_text), F.lit("")).alias("__text"))
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("__text"))).first()[0] or 0) / block_bytes))
    kind = asked.schema["__item"].dataType.simpleString()
    out = spark.createDataFrame([], f"`{item_col}` {kind}, rank int, `{id_col}` long, score long")
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("__item", "__text"), F.lit(blocks)) == b).collect()  # a block
        if not rows:
            continue
        found = search_block(docs, [r["__text"] for r in rows], k, id_col, text_col)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("__id")))
        names = F.broadcast(spark.createDataFrame([(i, r["__item"]) for i, r in enumerate(rows)], f"item int, __item {kind}"))
        best = found.withColumn("rank", place).filter(F.col("rank") <= k).join(names, "item")
        out = out.unionByName(best.select(F.col("__item").alias(item_col), "rank", F.col("__id").alias(id_col), "score"))
    return out
