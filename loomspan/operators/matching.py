"""Joins and ranking around retrieved evidence: hybrid fusion, parents, lookups with a second key, nearest texts, hashed vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import partial, reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.retrieval import ranked


def hashed_vectors(docs: DataFrame, id_col: str, tokens: Column, size: int = 384, rows: int = 200) -> DataFrame:
    """(id, embedding): each token adds +1 or -1 at a place told by its digest; vectors are scaled to length 1. A task opens ``rows`` texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            out = np.zeros((batch.num_rows, size), np.float32)
            for k, toks in enumerate(batch.column(1).to_pylist()):
                for t in toks or ():
                    if t not in known:
                        if len(known) > 50_000:
                            known.clear()
                        d = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                        known[t] = (int.from_bytes(d[:4], "little") % size, 1.0 - 2.0 * (d[4] % 2))
                    place, sign = known[t]
                    out[k, place] += sign
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            np.divide(out, norm, out=out, where=norm > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), size).cast(pa.list_(pa.float32()))], [id_col, "embedding"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, tokens.alias("__t")).mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>")


def hybrid(lists: DataFrame, id_col: str, weights: dict[str, float], k: dict[str, int], graph: DataFrame | None = None, graph_weight: float = 0.28, boosts: DataFrame | None = None, threshold: float | None = None, limit: int = 20) -> DataFrame:
    """The full fusion of ranked lists: weighted reciprocal ranks with a constant for each list, a graph score added to what was found, boosts, a threshold, the best ``limit``.

    ``lists`` has id, list, score and is cut to candidates per list; ``graph`` and ``boosts`` have id and score. Returns id, score, n_lists, graph.
    """
    w, c = F.lit(1.0), F.lit(60)
    for name, x in weights.items():
        w = F.when(F.col("list") == name, F.lit(float(x))).otherwise(w)
    for name, n in k.items():
        c = F.when(F.col("list") == name, F.lit(n)).otherwise(c)
    fused = ranked(lists, id_col).groupBy(id_col).agg(F.sum(w / (c + F.col("place"))).alias("score"), F.count("*").alias("n_lists"))
    fused = fused.withColumn("graph", F.lit(0.0)) if graph is None else fused.join(graph.select(id_col, F.col("score").alias("graph")), id_col, "left").na.fill(0.0, ["graph"])
    fused = fused.withColumn("score", F.col("score") + F.lit(graph_weight) * F.col("graph"))
    if boosts is not None:
        fused = fused.join(boosts.select(id_col, F.col("score").alias("__b")), id_col, "left").withColumn("score", F.col("score") + F.coalesce("__b", F.lit(0.0))).drop("__b")
    if threshold is not None:
        fused = fused.filter(F.col("score") >= threshold)
    return fused.orderBy(F.desc(F.round("score", 9)), id_col).limit(limit)  # sums of equal parts in another order count as equal


def to_parents(hits: DataFrame, parent: str, id_col: str) -> DataFrame:
    """The best hit of each parent, under the parent's id, with the hit's score and how many hits the parent had."""
    best = F.max_by(F.struct(F.col(id_col).alias("child"), F.col("score").alias("score")), F.struct(F.col("score"), -F.col(id_col)))
    return hits.groupBy(parent).agg(best.alias("b"), F.count("*").alias("n_hits")).select(parent, F.col("b.child").alias("child"), F.col("b.score").alias("score"), "n_hits")


def unseen(hits: DataFrame, seen: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Hits that neither by id nor by text were seen before, one for each text (the first by id)."""
    rows = hits.withColumn("__h", F.md5(F.coalesce(text, F.lit(""))))
    old = seen.withColumn("__h", F.md5(F.coalesce(text, F.lit(""))))
    rows = rows.join(old.select(id_col).distinct(), id_col, "left_anti").join(old.select("__h").distinct(), "__h", "left_anti")
    return rows.withColumn("__p", F.row_number().over(Window.partitionBy("__h").orderBy(id_col))).filter("__p = 1").drop("__p", "__h")


def keep_preferred(rows: DataFrame, keys: Sequence[Column], preferred: Column, order: str) -> DataFrame:
    """One row for each key, the first that is preferred, else the first. The key of a row is its first part that is there; rows without any stay."""
    key = F.coalesce(*[F.concat(F.lit(f"{k}:"), F.nullif(c.cast("string"), F.lit(""))) for k, c in enumerate(keys)])
    rows = rows.withColumns({"__k": key, "__f": F.coalesce(preferred, F.lit(False))})
    held = rows.filter("__k IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("__k").orderBy(F.desc("__f"), order))
    return held.withColumn("__p", place).filter("__p = 1").drop("__p").unionByName(rows.filter("__k IS NULL")).drop("__k", "__f")


def lookup(rows: DataFrame, facts: DataFrame, first: tuple[str, str], second: tuple[str, str], order: str, value: str) -> DataFrame:
    """Rows with the value a fact gives for the first key, or else for the second; of several facts for a key the last by ``order`` counts."""
    last = lambda key: facts.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max_by(value, order).alias("__v"))
    a, b = last(first[1]).withColumnsRenamed({"__k": "__k1", "__v": "__v1"}), last(second[1]).withColumnsRenamed({"__k": "__k2", "__v": "__v2"})
    out = rows.join(a, F.col(first[0]) == F.col("__k1"), "left").join(b, F.col(second[0]) == F.col("__k2"), "left")
    how = F.when(F.col("__k1").isNotNull(), "first").when(F.col("__k2").isNotNull(), "second").otherwise("none")
    return out.withColumns({value: F.when(F.col("__k1").isNotNull(), F.col("__v1")).otherwise(F.col("__v2")), "found_by": how}).drop("__k1", "__v1", "__k2", "__v2")


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring, by a suffix automaton of the shorter text: linear in both."""
    a, b = sorted((a, b), key=len)
    go: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in a:
        cur = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] > size[p] + 1:
                twin = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[cur] = q
        last = cur
    best = state = length = 0
    for c in b:
        while state and c not in go[state]:
            state = link[state]
            length = size[state]
        if c in go[state]:
            state = go[state][c]
            length += 1
        best = max(best, length)
    return best


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence. A row of the usual table is one number with a bit for each character of the longer
    text, and each character of the shorter one moves all its bits at once."""
    if len(a) < len(b):
        a, b = b, a
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes[np.isin(codes, np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32))]).tolist()}
    full = row = (1 << len(a)) - 1
    for c in b:
        if c in at:
            hit = row & at[c]
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def word_runs(df: DataFrame, text: str, n: int, out: str, sizes: Sequence[int] = ()) -> DataFrame:
    """A row for each run of ``n`` words with its hash; a text under ``n`` words gives one run of all its words. With ``sizes``, all runs of those sizes."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda x: x != "")
    df = df.withColumn("__w", words)
    starts = F.size("__w") - (F.lit(1) if sizes else F.least(F.lit(n), F.size("__w")))
    df = df.withColumn("__i", F.explode(F.when(F.size("__w") > 0, F.sequence(F.lit(0), starts)).otherwise(F.array().cast("array<int>"))))
    key = lambda k: F.xxhash64(F.lit(k), *[F.get("__w", F.col("__i") + i) for i in range(k)])
    if sizes:
        key = F.explode(F.array(*[F.when(F.col("__i") + k <= F.size("__w"), key(k)) for k in sizes]))
    else:
        key = reduce(lambda rest, k: F.when(F.size("__w") == k, key(k)).otherwise(rest), range(1, n), key(n))
    return df.withColumn(out, key).drop("__w", "__i").filter(F.col(out).isNotNull())


def without_breaks(c: Column) -> Column:
    """The text without spaces, line ends and line ends written out."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\\n|[\n ]", "")


def chunk_recall(pairs: DataFrame, key: str, source: str, found: str, threshold: float = 0.8, method: str = "substring") -> DataFrame:
    """(key, ratio, hit): the longest substring (or ``subsequence``) of the source that a retrieved text has, as a share of the source; the best over a key's texts.

    A hit is a ratio above the threshold. Pairs are given, so nothing is compared that was not retrieved.
    """
    longest = {"substring": longest_common, "subsequence": common_subsequence}[method]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = [longest(s, f) / len(s) if s and f else 0.0 for s, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ratio, pa.float64())], [key, "ratio"])

    kind = pairs.schema[key].dataType.simpleString()
    each = pairs.select(key, source, found).mapInArrow(run, f"`{key}` {kind}, ratio double")
    return each.groupBy(key).agg(F.max("ratio").alias("ratio")).withColumn("hit", F.col("ratio") > threshold)


def letter_sums(text: str, kinds: int = 64) -> np.ndarray:
    """For each place of a text how often each kind of character (its code by ``kinds``) stands before it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % kinds
    out = np.zeros((len(codes) + 1, kinds), np.int32)
    out[np.arange(1, len(codes) + 1), codes] = 1
    return np.cumsum(out, axis=0, dtype=np.int32)


def ratio_from(match: SequenceMatcher, of_a: np.ndarray, of_b: np.ndarray, least: float) -> float:
    """The ratio of two texts, or -1 as soon as it must be below ``least``.

    Blocks are found in the parts of the texts that can hold most, and what a part can hold at most is told by its characters
    (``letter_sums`` of both texts); a block leaves two smaller parts.
    """
    total = len(of_a) + len(of_b) - 2
    if not total:
        return 1.0

    def part(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int, int, int]:
        return -int(np.minimum(of_a[ahi] - of_a[alo], of_b[bhi] - of_b[blo]).sum()) if alo < ahi and blo < bhi else 0, alo, ahi, blo, bhi

    parts, had = [part(0, len(of_a) - 1, 0, len(of_b) - 1)], 0
    left = -parts[0][0]
    while parts and left:
        if 2.0 * (had + left) / total < least:
            return -1.0
        most, alo, ahi, blo, bhi = heappop(parts)
        left += most
        i, j, k = match.find_longest_match(alo, ahi, blo, bhi)
        if k:
            had += k
            for p in (part(alo, i, blo, j), part(i + k, ahi, j + k, bhi)):
                if p[0]:
                    left -= p[0]
                    heappush(parts, p)
    return 2.0 * had / total


#: Kinds of characters that bounds tell apart; bits of a word that hold places of a text where sums carry over; the run of characters that
#: words of 64 places share, and how far apart these begin; words that are compared at once, and in one piece.
KINDS, PLACES, RUN, STEP, AT_ONCE, PIECE = 64, 63, 4, 61, 4_000_000, 80_000
_FULL, _LOW = np.uint64((1 << PLACES) - 1), np.array([(1 << k) - 1 for k in range(65)], np.uint64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many each, one range after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _share(most: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The ratio of texts of ``total`` characters that match in ``most`` of either; two empty texts are equal."""
    return np.where(total > 0, 2.0 * most / np.maximum(total, 1), 1.0)


class Asked:
    """A query text, laid out to be held against many texts."""

    def __init__(self, text: str):
        self.text, self.codes, self.sums = text, _codes(text), letter_sums(text, KINDS)
        self.kinds = (self.codes % KINDS).tolist()
        self.match: SequenceMatcher | None = None

    def windows(self, letters: np.ndarray, out: np.ndarray) -> None:
        """For each of some letters (in order, a row each) the places of the query that have it, as bits of words of 64 places. A word
        begins ``STEP`` places after the one before, so that each run of ``RUN`` places lies whole in one word, and in one only."""
        row = np.searchsorted(letters, self.codes)
        at = np.flatnonzero(letters[np.minimum(row, len(letters) - 1)] == self.codes) if len(letters) else np.zeros(0, np.int64)
        np.bitwise_or.at(out, (row[at], at // STEP), np.left_shift(np.uint64(1), (at % STEP).astype(np.uint64)))
        out[:, :-1] |= out[:, 1:] << np.uint64(STEP)


class Texts:
    """Texts of one group, shortest first, laid out side by side to be held against one query after another."""

    def __init__(self, ids: Sequence[int], texts: Sequence[str]):
        self.ids, self.texts, self.size = ids, texts, np.array([len(t) for t in texts])
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        codes = _codes("".join(texts))
        self.letters, self.letter = np.unique(codes, return_inverse=True)
        self.kind = (codes % KINDS).astype(np.int64)
        self.counts = np.bincount(np.repeat(np.arange(len(texts)), self.size) * KINDS + self.kind, minlength=len(texts) * KINDS).reshape(-1, KINDS)
        self.mask = np.zeros((KINDS, -(-int(self.size[-1]) // PLACES), len(texts)), np.uint64)
        for k in range(int(self.size[-1])):  # texts longer than k are the last ones
            on = np.arange(np.searchsorted(self.size, k, "right"), len(texts))
            self.mask[self.kind[self.start[on] + k], k // PLACES, on] |= np.uint64(1 << k % PLACES)

    def in_order(self, query: Asked, some: np.ndarray) -> np.ndarray:
        """For some of the texts a bound on the characters that they have in common with the query in the same order: the longest common
        subsequence of kinds, for all texts at once, a bit for each place (see ``common_subsequence``). Matching blocks are such a
        subsequence."""
        words = -(-int(self.size[some].max()) // PLACES)
        mask = {c: np.take(self.mask[c, :words], some, axis=1) for c in set(query.kinds)}
        row, one = np.full((words, len(some)), _FULL), np.uint64(PLACES)
        hit, new, carry = np.empty_like(row), np.empty_like(row), np.empty(len(some), np.uint64)
        for c in query.kinds:
            np.bitwise_and(row, mask[c], out=hit)
            np.add(row, hit, out=new)
            for w in range(1, words):
                np.right_shift(new[w - 1], one, out=carry)
                np.add(new[w], carry, out=new[w])
            np.bitwise_xor(row, hit, out=hit)
            np.bitwise_or(new, hit, out=new)
            np.bitwise_and(new, _FULL, out=row)
        return words * PLACES - np.bitwise_count(row).sum(axis=0, dtype=np.int64)

    def ratios(self, asked: Sequence[Asked], table: np.ndarray, which: np.ndarray, some: np.ndarray, least: np.ndarray) -> np.ndarray:
        """``ratio_from`` for pairs of a query and a text, all at once: a step finds the longest block of the part of each pair that can hold most."""
        n, length = len(some), np.array([len(q.codes) for q in asked])
        sums, begin = np.concatenate([q.sums for q in asked]), np.cumsum(length + 1) - length - 1
        total, had, left = self.size[some] + length[which], np.zeros(n), np.zeros(n)
        new = self.start[some], self.start[some + 1], np.zeros(n, np.int64), length[which], np.arange(n)
        held = tuple(np.zeros(0, np.int64) for _ in range(6))
        while True:
            a0, a1, b0, b1, of = new
            size, here = a1 - a0, begin[which[of]]
            have = np.bincount(np.repeat(np.arange(len(of)) * KINDS, size) + self.kind[_ranges(a0, size)], minlength=len(of) * KINDS).reshape(-1, KINDS)
            most = np.minimum(have, sums[here + b1] - sums[here + b0]).sum(axis=1)
            left += np.bincount(of, most, n)
            held = tuple(np.concatenate(x) for x in zip(held, (*new, most), strict=True))
            sure = _share(had + left, total) >= least
            keep = (held[5] > 0) & sure[held[4]]
            if not keep.any():
                return np.where(sure, _share(had, total), -1.0)
            held = tuple(x[keep] for x in held)
            by = np.lexsort((-held[5], held[4]))
            first = by[np.append(True, held[4][by][1:] != held[4][by][:-1])]
            a0, a1, b0, b1, of, most = (x[first] for x in held)
            rest = np.ones(len(by), bool)
            rest[first] = False
            held = tuple(x[rest] for x in held)
            left -= np.bincount(of, most, n)
            cost = np.cumsum((a1 - a0) * ((b1 - b0) // STEP + 1)) // PIECE  # pieces that stay in a processor's cache
            cut = [0, *(np.flatnonzero(np.diff(cost)) + 1).tolist(), len(of)]
            found = [self.longest(table, which[of[x:y]], a0[x:y], a1[x:y], b0[x:y], b1[x:y]) for x, y in zip(cut, cut[1:], strict=False)]
            if any(x is None for x in found):
                return self.one_by_one(asked, table, which, some, least)
            i, j, k = (np.concatenate(x) for x in zip(*found, strict=True))
            had += np.bincount(of, k, n)
            new = tuple(np.concatenate(x) for x in ((a0, i + k), (i, a1), (b0, j + k), (j, b1), (of, of)))
            there = (np.concatenate([k, k]) > 0) & (new[0] < new[1]) & (new[2] < new[3])
            new = tuple(x[there] for x in new)

    def longest(self, table: np.ndarray, which: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, hits: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The longest block of each part, the first in the text and then in the query among equals: where it begins in both, and its length.
        None if there are more than so many ``hits``.

        For each place of a part in the text and each word of places in the query (``windows``) bits tell where in the query a run of k
        characters ends that ends at that place, for k up to ``RUN``. Such runs that follow each other are put together.
        """
        n, first = len(a0), b0 // STEP
        words = np.maximum((b1 - RUN) // STEP, first) - first + 1
        part = np.repeat(np.arange(n), words)
        word = _ranges(first, words)
        own = _LOW[np.clip(b1[part] - word * STEP, 0, 64)] & ~_LOW[np.clip(b0[part] - word * STEP, 0, 64)]
        size = (a1 - a0)[part]
        row, begin = _ranges(a0[part], size), np.cumsum(size) - size
        bits = np.take(table.ravel(), np.take(self.letter, row) * table.shape[2] + np.repeat(which[part] * table[0].size + word, size))
        bits &= np.repeat(own, size)
        runs = [bits]
        for _ in range(1, RUN):
            more = np.empty_like(bits)
            more[0] = 0
            np.left_shift(runs[-1][:-1], np.uint64(1), out=more[1:])
            more[begin] = 0
            more &= bits
            runs.append(more)
        long, i, j = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = np.flatnonzero(runs[-1])
        if len(at):
            left, x, y, held = runs[-1][at], [], [], 0
            lane = np.searchsorted(begin, at, "right") - 1
            who, line, col = part[lane], row[at], word[lane] * STEP
            while len(left):
                held += len(left)
                if held > hits:
                    return None
                low = left & (~left + np.uint64(1))
                x.append((who, line))
                y.append(col + np.bitwise_count(low - np.uint64(1)))
                left = left ^ low
                go = np.flatnonzero(left)
                who, line, col, left = who[go], line[go], col[go], left[go]
            who, line, y = np.concatenate([w for w, _ in x]), np.concatenate([r for _, r in x]), np.concatenate(y)
            down, across = line - a0[who], y - b0[who]
            tall, broad = int(size.max()), int((b1 - b0).max())
            by = np.argsort((who * (tall + broad) + across - down + tall) * tall + down)  # by part, diagonal and place
            who, line, y = who[by], line[by], y[by]
            end = np.flatnonzero(np.append((line[1:] != line[:-1] + 1) | (y[1:] != y[:-1] + 1) | (who[1:] != who[:-1]), True))
            run = RUN - 1 + np.diff(end, prepend=-1)
            who, line, y = who[end], line[end], y[end]
            by = np.lexsort((y, line - run, -run, who))
            by = by[np.append(True, who[by][1:] != who[by][:-1])]
            long[who[by]], i[who[by]], j[who[by]] = run[by], line[by], y[by]
        for k in range(RUN - 1, 0, -1):
            rest = np.flatnonzero((long == 0)[part])
            if not len(rest):
                break
            at = _ranges(begin[rest], size[rest])
            left = runs[k - 1][at]
            on = np.flatnonzero(left)
            at, left, lane = at[on], left[on], np.repeat(rest, size[rest])[on]
            if len(at):
                y = word[lane] * STEP + np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1))
                who = part[lane]
                lead = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                wide = table.shape[2] * STEP + 64
                key = np.minimum.reduceat(row[at] * wide + y, lead)
                long[who[lead]], i[who[lead]], j[who[lead]] = k, key // wide, key % wide
        return i - long + 1, j - long + 1, long

    def one_by_one(self, asked: Sequence[Asked], table: np.ndarray, which: np.ndarray, some: np.ndarray, least: np.ndarray) -> np.ndarray:
        out = []
        for q, k, x in zip(which.tolist(), some.tolist(), least.tolist(), strict=True):
            match = asked[q].match = asked[q].match or SequenceMatcher(None, "", asked[q].text, autojunk=False)
            match.set_seq1(self.texts[k])
            out.append(ratio_from(match, letter_sums(self.texts[k], KINDS), asked[q].sums, x))
        return np.array(out)

    def table(self, asked: Sequence[Asked]) -> np.ndarray:
        out = np.zeros((len(asked), len(self.letters), max(len(q.codes) for q in asked) // STEP + 1), np.uint64)
        for k, q in enumerate(asked):
            q.windows(self.letters, out[k])
        return out

    def in_question(self, query: Asked, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The texts whose ratio may reach ``least``, with a bound on it, highest first."""
        total = self.size + len(query.codes)
        bound = _share(np.minimum(self.counts, query.sums[-1]).sum(axis=1), total)
        some = np.flatnonzero(bound >= least)
        if len(some) > 4:
            for at in (some[k : k + 1024] for k in range(0, len(some), 1024)):
                bound[at] = np.minimum(bound[at], _share(self.in_order(query, at), total[at]))
        some = some[np.argsort(-bound[some], kind="stable")]
        return some, bound[some]

    def best(self, asked: Sequence[Asked], best: Sequence[tuple[float, int | None]]) -> list[tuple[float, int | None]]:
        """For each query the highest ratio and the smallest id that has it, among the texts and what was best before."""
        longest = max(len(q.codes) for q in asked)
        if len(asked) > 1 and (len(asked) > 128 or len(asked) * (longest // STEP + 1) * len(self.letters) > AT_ONCE):
            half = len(asked) // 2
            return self.best(asked[:half], best[:half]) + self.best(asked[half:], best[half:])
        best, order = list(best), [self.in_question(q, b[0]) for q, b in zip(asked, best, strict=True)]
        table, words, done, step = self.table(asked), np.array([len(q.codes) // STEP + 1 for q in asked]), 0, 16
        while True:
            now = [some[done : done + step][bound[done : done + step] >= best[n][0]] for n, (some, bound) in enumerate(order)]
            which, some = np.repeat(np.arange(len(now)), [len(x) for x in now]), np.concatenate(now)
            if not len(some):
                return best
            cost = self.size[some] * words[which]
            alone = cost > AT_ONCE // 4 if len(some) > 4 else np.ones(len(some), bool)
            piece = np.cumsum(np.where(alone, 0, cost)) // AT_ONCE
            for pairs, compare in [(np.flatnonzero(alone), self.one_by_one), *((np.flatnonzero(~alone & (piece == p)), self.ratios) for p in np.unique(piece[~alone]))]:
                if len(pairs):
                    found = compare(asked, table, which[pairs], some[pairs], np.array([b[0] for b in best])[which[pairs]])
                    for n, k, r in zip(which[pairs].tolist(), some[pairs].tolist(), found.tolist(), strict=True):
                        if r > best[n][0] or (r == best[n][0] and (best[n][1] is None or self.ids[k] < best[n][1])):
                            best[n] = r, self.ids[k]
            done, step = done + step, 1024


def nearest_texts(queries: DataFrame, candidates: DataFrame, group: str, query_id: str, query_text: str, cand_id: str, cand_text: str, most_queries: int = 50_000, block_chars: int = 8_000_000, parts: int | None = None) -> DataFrame:
    """For each query the candidate of its group whose text is most alike: (query_id, cand_id, ratio).

    The ratio is twice the matching characters over all characters, matched block by block. Queries are a stated set of at most
    ``most_queries`` rows (more are an error) that every block of candidates is held against. Queries are taken in blocks of about
    ``block_chars`` characters of text, one pass over the candidates each: the driver gathers one block at a time and a task
    opens one; the blocks of one call are all broadcast, which the number of queries bounds but not the length of their texts. A task holds
    about 4,000 candidates at a time against a query (``Texts``): bounds by character counts and by the longest common subsequence
    order them, and pairs are compared, many at once, only until they are sure to stay below the best. Ties go to the smallest id.
    Candidates of equal text are one, and are dealt over ``parts`` tasks whatever files they come from (three for each core if None),
    since what they cost is the comparing and not their size.
    """
    if queries.count() > most_queries:
        raise ValueError(f"more than {most_queries} queries")
    context = queries.sparkSession.sparkContext
    blocks, held, size = [], [], 0
    for r in queries.select(group, query_id, query_text).toLocalIterator():
        held.append((r[0], r[1], r[2] or ""))
        size += len(held[-1][2])
        if size >= block_chars:
            blocks.append(context.broadcast(held))
            held, size = [], 0
    blocks.append(context.broadcast(held))

    def run(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict = {}
        for n, (g, _, text) in enumerate(shared.value):
            asked.setdefault(g, []).append((n, text))
        best: dict[int, tuple[float, int | None]] = {}
        for batch in batches:
            where: dict = {}
            for g, c, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if g in asked:
                    where.setdefault(g, []).append((c, text or ""))
            for g, rows in where.items():
                rows.sort(key=lambda r: len(r[1]))
                while rows:
                    at = len(rows) - max(1, min(4096, len(rows), 1_000_000 // max(1, len(rows[-1][1]))))
                    texts = Texts([c for c, _ in rows[at:]], [x for _, x in rows[at:]])
                    for some in (asked[g][k : k + 128] for k in range(0, len(asked[g]), 128)):
                        best.update(zip((n for n, _ in some), texts.best([Asked(x) for _, x in some], [best.get(n, (-1.0, None)) for n, _ in some]), strict=True))
                    rows = rows[:at]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([shared.value[n][1] for n in best], pa.int64()), pa.array([c for _, c in best.values()], pa.int64()), pa.array([r for r, _ in best.values()], pa.float64())], [query_id, cand_id, "ratio"])

    texts = candidates.groupBy(group, cand_text).agg(F.min(cand_id).alias(cand_id)).select(group, cand_id, cand_text).repartition(parts or 3 * context.defaultParallelism)
    found = reduce(DataFrame.unionByName, [texts.mapInArrow(partial(run, x), f"`{query_id}` long, `{cand_id}` long, ratio double") for x in blocks])
    top = F.max_by(F.struct(F.col(cand_id).alias("c"), F.col("ratio").alias("r")), F.struct(F.col("ratio"), -F.col(cand_id)))
    return found.groupBy(query_id).agg(top.alias("b")).select(query_id, F.col("b.c").alias(cand_id), F.col("b.r").alias("ratio"))


def retrieval_scores(evidence: DataFrame, query: str, rank: str, expected: Column, observed: Column) -> DataFrame:
    """For each query: retrieved items, those whose keys match an expected key, precision, recall and reciprocal rank of the first match.

    Keys match when equal, or when one holds the other and the shorter has eight characters or more.
    """
    inside = lambda a, b: (F.least(F.length(a), F.length(b)) >= 8) & (F.contains(a, b) | F.contains(b, a))
    hit = F.exists(expected, lambda a: F.exists(observed, lambda b: (a != "") & (b != "") & ((a == b) | inside(a, b))))
    out = evidence.withColumn("__h", hit).groupBy(query).agg(F.count("*").alias("k"), F.count_if("__h").alias("matches"), F.min(F.when(F.col("__h"), F.col(rank))).alias("first_rank"))
    return out.select(query, "k", "matches", (F.col("matches") / F.col("k")).alias("precision"), (F.col("matches") > 0).cast("double").alias("recall"), F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr"))


def organised(items: DataFrame, key: Column, item: str, confidence: str, order: str, unions: Sequence[str], most: int = 24) -> DataFrame:
    """Items merged by key: ids and distinct list entries in order of confidence and recency, mean confidence, an id from the members' ids.

    ``unions`` are array columns. Lists of a group are exploded and ranked as rows, then cut to ``most`` entries each. The id is a
    digest over all ids in order, fed row by row: a group is sorted, but never held.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, key, out = None, None, []
        for batch in batches:
            for place, k, i in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if place == 1:
                    if running:
                        out.append((key, running.hexdigest()))
                    running, key = hashlib.sha1(), k
                elif i is not None:
                    running.update(b"|")
                running.update((i or "").encode("utf-8", "surrogatepass"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.schema.field(1).type), pa.array([x[1] for x in out])], ["__k", "__s"])
                out = []
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([key], batch.schema.field(1).type), pa.array([running.hexdigest()])], ["__k", "__s"])

    rows = items.withColumn("__k", key).withColumn("__o", F.row_number().over(Window.partitionBy("__k").orderBy(F.desc(confidence), F.desc(order), item)))
    ordered = rows.select("__o", "__k", F.col(item).cast("string")).repartition("__k").sortWithinPartitions("__k", "__o")
    signs = ordered.mapInArrow(digests, f"__k {rows.schema['__k'].dataType.simpleString()}, __s string").withColumnRenamed("__k", "__d")
    out = rows.groupBy("__k").agg(F.count("*").alias("n_items"), F.avg(confidence).alias("confidence")).join(signs, F.col("__k").eqNullSafe(F.col("__d")))
    out = out.select(F.col("__k").alias("group_key"), F.concat(F.lit("org-"), F.substring("__s", 1, 16)).alias("candidate_id"), "n_items", "confidence")
    for u in unions:
        e = rows.select("__k", "__o", F.posexplode(u).alias("__j", "__v")).groupBy("__k", "__v").agg(F.min(F.struct("__o", "__j")).alias("__at"))
        e = e.withColumn("__r", F.row_number().over(Window.partitionBy("__k").orderBy("__at"))).filter(F.col("__r") <= most)
        e = e.groupBy("__k").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__v"))), lambda x: x["__v"]).alias(u))
        out = out.join(e.withColumnRenamed("__k", "group_key"), "group_key", "left")
    return out


def budgeted_graph(edges: DataFrame, a: str, b: str, weight: str, nodes: int, most_edges: int, candidates: int = 4000) -> DataFrame:
    """Edges by weight that fit into a budget of nodes and edges: an edge is taken if its new nodes still fit.

    Only the ``candidates`` heaviest edges are looked at, which one task walks in order.
    """
    top = edges.select(a, b, weight).orderBy(F.desc(weight), a, b).limit(candidates)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for x in batches for r in zip(*(x.column(k).to_pylist() for k in range(3)), strict=True)), key=lambda r: (-r[2], r[0], r[1]))
        seen: set = set()
        kept = []
        for r in rows:
            new = {r[0], r[1]} - seen
            if len(kept) < most_edges and len(seen) + len(new) <= nodes:
                seen |= new
                kept.append(r)
        yield pa.RecordBatch.from_pydict({c: [r[k] for r in kept] for k, c in enumerate((a, b, weight))}, pa.schema([(a, pa.string()), (b, pa.string()), (weight, pa.int64())]))

    return top.select(F.col(a).cast("string"), F.col(b).cast("string"), F.col(weight).cast("long")).coalesce(1).mapInArrow(walk, f"`{a}` string, `{b}` string, `{weight}` long")
