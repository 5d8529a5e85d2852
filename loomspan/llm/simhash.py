"""Near duplicates by 64-bit fingerprints: a positional index of bytes, count filtering, and classes of linked fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import STEP_CHARS, by_ids, groups, stored
from loomspan.llm.components import components

BYTES = 8
#: Shingles whose bits are counted at once.
SHINGLES = 200_000


def triples() -> list[tuple[int, int, int]]:
    """Three-byte positions such that any four of the eight positions hold one of them: all triples inside one of three circular
    groups, and those with two positions in a group and one in the next. There are 20, the fewest known."""
    at = [range(0, 3), range(3, 6), range(6, 8)]
    inside = [t for g in at for t in combinations(g, 3)]
    across = [(a, b, c) for k, g in enumerate(at) for a, b in combinations(g, 2) for c in at[(k + 1) % 3]]
    return inside + across


def hashes(data: bytes, n: int, seed: int) -> np.ndarray:
    """XXH64 of each run of n words, joined by single spaces; of all words if there are fewer; none without words."""
    words = data.lower().split()  # for bytes: A-Z only, and the six ASCII white space characters
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, seed)] if words else [], np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.r_[0, end[:-1] + 1]
    spans = zip(start[: len(words) - n + 1].tolist(), end[n - 1 :].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - n + 1)


def majority(parts: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes the number whose bits are set in over half of them; 0 for an empty one."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(parts)), size)
    every = np.concatenate([np.zeros(0, np.uint64), *parts])
    counts = np.zeros((len(parts), 64), np.int64)
    for lo in range(0, len(every), SHINGLES):
        own = owner[lo : lo + SHINGLES]
        bits = np.unpackbits(every[lo : lo + SHINGLES].astype("<u8").view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    over = (2 * counts > size[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, seed: int = 42) -> DataFrame:
    """(id, fingerprint) of whole texts, one row each; null and blank texts have fingerprint 0. Memory follows the longest text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, held, size = batch.column(1).cast(pa.binary()), [], [], 0
            for t in texts:
                data = t.as_py() or b""
                held.append(hashes(data, n, seed))
                size += len(data)
                if size >= STEP_CHARS:
                    out.append(majority(held))
                    held, size = [], 0
            out.append(majority(held))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).view(np.int64))], ["__id", "__fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, f"__id {kind}, __fp long")


def near(x: np.ndarray, most: int) -> np.ndarray:
    """Which differences are of linked pairs. Each differing bit spoils one byte at most, so a linked pair shares 8 - most positional
    bytes or more: pairs that reach this tally are kept, and verified by all bits."""
    out = np.zeros(len(x), bool)
    kept = np.flatnonzero((x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= BYTES - most)
    out[kept] = np.bitwise_count(x[kept]) <= most
    return out


def forest(f: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what linked pairs of one list connect. A reached value is compared with those not yet reached only, so a
    dense list takes about as many comparisons as it has values."""
    a, b, left = [], [], np.arange(len(f))
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            hit = near(f[left] ^ f[i], most)
            if hit.any():
                got = left[hit]
                a.append(np.full(len(got), i))
                b.append(got)
                stack += got.tolist()
                left = left[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def list_links(key: np.ndarray, f: np.ndarray, most: int, few: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of linked values inside the lists of a sorted key: all pairs of short lists at once, a forest for longer ones."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    left = np.repeat(first + size, size) - np.arange(len(key))  # values of the list from here on
    at = np.flatnonzero((np.repeat(size, size) <= few) & (left > 1))
    a, b, d = [], [], 1
    while len(at):
        hit = near(f[at] ^ f[at + d], most)
        a.append(at[hit])
        b.append(at[hit] + d)
        d += 1
        at = at[left[at] > d]
    for lo, n in zip(first[size > few], size[size > few], strict=True):
        x, y = forest(f[lo : lo + n], most)
        a.append(x + lo)
        b.append(y + lo)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def postings(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under the values of three bytes, for each of the triples of positions."""
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255) for p in range(BYTES)]
    keys = [F.lit(k << 24).cast("long") + byte[a] * 65536 + byte[b] * 256 + byte[c] for k, (a, b, c) in enumerate(triples())]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def fingerprint_links(fps: DataFrame, most: int = 4, longest: int = 4096, pivots: int = 64) -> DataFrame:
    """(a, b): links between different fingerprints ``fp`` that connect exactly those at ``most`` differing bits or fewer, also over others.

    A list of one byte holds a 256th of all fingerprints, so the tally of shared bytes starts from lists of three bytes: pairs with
    four shared bytes or more meet in one of 20. Lists above ``longest`` are dealt into chunks with common pivots; what chunks and
    pivots have not connected is then compared with the rest of its list, so no pair of different classes is left out.
    """
    if not 0 <= most <= 4:
        raise ValueError("lists of three bytes find pairs at 4 differing bits or fewer")

    def chunk(of: str) -> Column:
        return F.pmod(F.xxhash64("fp"), F.col(of))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "key", 100_000):
            f = table.column("fp").to_numpy().view(np.uint64)
            a, b = list_links(table.column("key").to_numpy(), f, most)
            yield pa.RecordBatch.from_arrays([pa.array(f[a].view(np.int64)), pa.array(f[b].view(np.int64))], ["a", "b"])

    posts = postings(fps)
    counts = posts.groupBy("key").agg(F.count("*").alias("n"))
    hot = stored(counts.filter(F.col("n") > longest).select("key", F.ceil(F.col("n") * 2 / longest).alias("chunks")))
    if not hot.limit(1).count():
        return stored(posts.repartition("key").sortWithinPartitions("key").mapInArrow(within, "a long, b long").distinct())
    hot_posts = stored(by_ids(posts, hot, "key", "inner"))
    marks = hot_posts.groupBy("key", "chunks", F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(pivots)).alias("salt")).agg(F.min("fp").alias("fp"))
    dealt = hot_posts.select("key", chunk("chunks").alias("c"), "fp").unionByName(marks.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), "fp"))
    lists = by_ids(posts, hot.select("key"), "key", "left_anti").unionByName(dealt.select((F.shiftleft(F.col("c") + 1, 32) + F.col("key")).alias("key"), "fp").distinct())
    links = stored(lists.repartition("key").sortWithinPartitions("key").mapInArrow(within, "a long, b long").distinct())
    return links.unionByName(across(hot_posts, links, most, longest))


def across(hot_posts: DataFrame, links: DataFrame, most: int, longest: int) -> DataFrame:
    """Links between values of one long list that ``links`` do not connect yet: those outside the list's largest class against all others."""
    cols = ["key", "chunks", "fp", "label"]
    named = hot_posts.join(components(links).select(F.col("node").alias("fp"), "root"), "fp", "left")
    named = stored(named.select("key", "chunks", "fp", F.coalesce("root", "fp").alias("label")))
    per = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = per.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = stored(main.filter(F.col("all") > F.col("most")).select("key", "main", F.ceil((F.col("all") - F.col("most")) * 2 / longest).alias("blocks")))
    open_ = stored(by_ids(named, main, "key", "inner"))
    side = open_.filter(F.col("label") != F.col("main")).select(*cols, F.pmod(F.xxhash64("fp", F.lit(2)), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), F.lit(True).alias("rest"))
    other = open_.select(*cols, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("c"), F.lit(False).alias("rest"))
    cells = side.unionByName(other).select(F.xxhash64("key", "block", "c").alias("key"), "fp", "label", "rest")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "key", 100_000):
            key, rest, label = (table.column(c).to_numpy() for c in ("key", "rest", "label"))
            f, a, b = table.column("fp").to_numpy().view(np.uint64), [], []
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                every = np.arange(lo, hi)[~rest[lo:hi]]
                for i in np.arange(lo, hi)[rest[lo:hi]]:
                    other = every[label[every] != label[i]]
                    got = other[near(f[other] ^ f[i], most)]
                    got = got[np.unique(label[got], return_index=True)[1]]  # one link to each class is enough
                    a.append(np.full(len(got), f[i]))
                    b.append(f[got])
            none = np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x]).view(np.int64)) for x in (a, b)], ["a", "b"])

    return stored(cells.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct())


def fingerprint_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, most: int = 4, seed: int = 42) -> DataFrame:
    """(id, fingerprint, component_id) for each row: 16 hexadecimal digits, and the smallest id that links lead to.

    Equal fingerprints are one node of the index, however many rows have them. Rows without an id are linked like others; a class of
    such rows alone has a null component. Rows that repeat an id stay. Texts without words share fingerprint 0 and are linked.
    """
    rows = stored(fingerprints(docs, id_col, text_col, n, seed))
    heads = stored(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min("__id").alias("first")))
    roots = stored(components(fingerprint_links(heads.select("fp"), most)))
    named = stored(roots.withColumnRenamed("node", "fp").join(heads, "fp"))
    least = stored(named.groupBy("root").agg(F.min("first").alias("component_id")))
    linked = stored(by_ids(named, least, "root", "inner").select(F.col("fp"), "component_id"))
    labels = stored(by_ids(heads, linked, "fp", "left").select(F.col("fp").alias("__fp"), F.coalesce("component_id", "first").alias("component_id")))
    return by_ids(rows, labels, "__fp", "left").select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")
