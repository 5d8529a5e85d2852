"""N-gram Jaccard self-join by chosen paths: recursive splitting on sampled coordinates, brute force in small buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import MULT, Words, by_ids, groups, mix64, steps, stored
from loomspan.llm.components import components

#: Coordinates of the min-hash embedding of a set; bits of a shingle's hash that are used.
SIZE, BITS = 64, 44
FACTORS = mix64(np.arange(1, SIZE + 1, dtype=np.uint64) * np.uint64(MULT)) | np.uint64(1)
#: Estimated similarities from which sets are linked as candidates (five standard deviations below 0.8), and from
#: which a set leaves a large bucket with its pivot.
LINK, LEAVE = 0.55, 0.9


def sets_of(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by text and hash: (hash, text index)."""
    h, d = Words(texts).shingles(n)
    packed = (d.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS))
    packed.sort()
    packed = packed[np.r_[True, packed[1:] != packed[:-1]]] if len(packed) else packed
    return packed & np.uint64(2**BITS - 1), (packed >> np.uint64(BITS)).astype(np.int64)


def chosen(path: int, threshold: float, recall: float) -> list[int]:
    """The coordinates at a node of the tree: each run samples each with probability 1 / (threshold * SIZE); runs are repeated
    until a pair at the threshold agrees in one of them with probability ``recall``. Below the root a pair is mostly in several buckets,
    so that fewer runs do: with 0.95 a node has two children for each set, and sets with their paths do not multiply."""
    picked: list[int] = []
    rnd = np.random.RandomState(path % 2**32)
    enough = lambda: (1 - threshold) ** len(picked) <= 1 - recall or len(picked) == SIZE
    while not enough():
        for i in np.flatnonzero(rnd.rand(SIZE) < 1 / (threshold * SIZE)).tolist():
            if i not in picked and not enough():
                picked.append(i)
    return picked


def embed(n: int, threshold: float, recall: float):
    """Per text: a key of its set, the set's size, its paths at the root, and a byte of each of its min-hash coordinates."""
    root = chosen(1, threshold, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "__text"):
            tok, doc = sets_of(texts, n)
            has, first, size = np.unique(doc, return_index=True, return_counts=True)
            k = len(has)
            keys = np.zeros((2, k), np.uint64)
            sig = np.zeros((k, SIZE), np.uint32)
            if k:
                tok = mix64(tok)
                for j in range(2):
                    keys[j] = np.add.reduceat(mix64(tok + np.uint64(j * 77 + 1)), first)
                for i in range(SIZE):
                    sig[:, i] = np.minimum.reduceat((tok * FACTORS[i]) >> np.uint64(32), first)
            paths = mix64(sig[:, root].astype(np.uint64) + (np.array(root, np.uint64) << np.uint64(32)))
            small = sig.astype(np.uint8)
            back = np.full(len(texts), -1)
            back[has] = np.arange(k)
            take = pa.array(back, mask=back < 0)
            cols = [
                batch.column(0), pa.array(keys[0].view(np.int64)).take(take), pa.array(keys[1].view(np.int64)).take(take), pa.array(size.astype(np.int64)).take(take),
                pa.FixedSizeListArray.from_arrays(pa.array(paths.view(np.int64).ravel()), len(root)).cast(pa.list_(pa.int64())).take(take),
                pa.array([r.tobytes() for r in small], pa.binary()).take(take),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["id", "k1", "k2", "size", "paths", "sketch"])

    return run


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches along the last axis, without the agreement of bytes by chance."""
    agree = (x == y).mean(axis=-1)
    return (agree - 1 / 256) / (1 - 1 / 256)


def sketches(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIZE)


def label(link: np.ndarray) -> np.ndarray:
    """The smallest index in the component of each node of a symmetric matrix of links."""
    lab = np.arange(len(link))
    link = link | np.eye(len(link), dtype=bool)
    while True:
        new = np.where(link, lab[None, :], len(link)).min(axis=1)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return at, np.diff(np.r_[at, len(keys)])


def edges_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def small_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brute force in each bucket: links to the smallest member of each component of similar sketches."""
    for t in groups(batches, "path", 20_000):
        path, rep, sk = t.column("path").to_numpy(), t.column("rep").to_numpy(), sketches(t.column("sketch"))
        at, size = runs_of(path)
        two = at[size == 2]
        ok = estimate(sk[two], sk[two + 1]) >= LINK
        out_a, out_b = [rep[two][ok]], [rep[two + 1][ok]]
        for s, n in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            part = sk[s : s + n]
            link = np.empty((n, n), bool)
            for lo in range(0, n, 128):  # bounded memory: 128 rows against the bucket
                link[lo : lo + 128] = estimate(part[lo : lo + 128, None, :], part[None, :, :]) >= LINK
            lab = label(link)
            own = np.flatnonzero(lab != np.arange(n))
            out_a.append(rep[s + own])
            out_b.append(rep[s + lab[own]])
        yield edges_batch(np.concatenate(out_a), np.concatenate(out_b))


def pivoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets with their estimated similarity to the bucket's pivot."""
    for b in batches:
        if b.num_rows:
            near = estimate(sketches(b.column("sketch")), sketches(b.column("pivot_sketch")))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("rep"), b.column("sketch"), b.column("pivot"), pa.array(near, pa.float64())], ["path", "rep", "sketch", "pivot", "near"])


def deeper(threshold: float):
    """The next paths of rows in large buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for b in batches:
            path, rep, sk = b.column("path").to_numpy(), b.column("rep").to_numpy(), b.column("sketch").to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for p, r, s in zip(path.tolist(), rep.tolist(), sk, strict=True):
                if len(known) > 100_000:
                    known.clear()
                for i in known.get(p) or known.setdefault(p, chosen(p, threshold, 0.95)):
                    out[0].append((p * 31 + i * 257 + s[i] + 1) * MULT % 2**64)
                    out[1].append(r)
                    out[2].append(s)
            yield pa.RecordBatch.from_arrays([pa.array(mix64(np.array(out[0], np.uint64)).view(np.int64)), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["path", "rep", "sketch"])

    return run


def blocked(rows: DataFrame, group: str, item: str, blocks: str) -> DataFrame:
    """Deal each group's rows into pairs of blocks (i <= j), so that any two rows meet in exactly one task.

    Adds ``task`` (long) and ``side`` (0: block i, 1: block j; 0 in the pair of a block with itself), ``alone`` (one block).
    """
    b = F.pmod(F.xxhash64(item, F.lit(5)), F.col(blocks)).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")), lambda j: F.struct(F.least(b, j).alias("i"), F.greatest(b, j).alias("j"))))
    rows = rows.withColumn("__p", pair)
    return rows.withColumns({"task": F.xxhash64(group, "__p.i", "__p.j"), "side": (F.col("__p.i") != b).cast("int"), "halves": F.col("__p.i") != F.col("__p.j"), "alone": F.col(blocks) == 1}).drop("__p")


def block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links between the two blocks of a task (or in the one), as links to the smallest member of each component."""
    for t in groups(batches, "task", 1):
        task, rep, sk, side, halves = t.column("task").to_numpy(), t.column("rep").to_numpy(), sketches(t.column("sketch")), t.column("side").to_numpy(), t.column("halves").to_numpy(zero_copy_only=False)
        for s, n in zip(*(x.tolist() for x in runs_of(task)), strict=True):
            link = np.zeros((n, n), bool)
            cross = side[s : s + n, None] != side[None, s : s + n]
            for lo in range(0, n, 128):
                link[lo : lo + 128] = estimate(sk[s + lo : s + min(n, lo + 128), None, :], sk[None, s : s + n, :]) >= LINK
            lab = label(link & (cross | ~halves[s]))
            own = np.flatnonzero(lab != np.arange(n))
            yield edges_batch(rep[s + own], rep[s + lab[own]])


def candidate_links(sets: DataFrame, threshold: float, limit: int, depth: int) -> DataFrame:
    """Links (a, b) between sets that may reach the threshold; every such pair is connected by them.

    Buckets of up to ``limit`` sets are compared by brute force. In a larger one every set is compared with one pivot: it is
    linked if the sketches agree halfway, and leaves the bucket with the pivot if they nearly agree (what is similar to it is then close
    enough to the pivot to be linked too). The others go on to the next level of paths. What is still together at the
    last level is compared in blocks, all against all.
    """
    spark = sets.sparkSession
    paths = sets.select(F.explode("paths").alias("path"), "rep", "sketch")
    links, level = [], 0
    while True:
        sizes = paths.groupBy("path").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).filter(F.col("n") > limit)
        large = stored(sizes)
        n_large = large.count()
        small = paths if not n_large else by_ids(paths, large.select("path"), "path", "left_anti")
        dealt = small.repartition("path").sortWithinPartitions("path", "rep")
        links.append(stored(dealt.mapInArrow(small_buckets, "a long, b long")))
        if not n_large:
            break
        heavy = by_ids(paths, large, "path", "inner")
        if level == depth:
            heavy = heavy.withColumn("blocks", F.ceil(F.col("n") / limit))
            dealt = blocked(heavy, "path", "rep", "blocks").select("task", "rep", "sketch", "side", "halves")
            links.append(stored(dealt.repartition("task").sortWithinPartitions("task", "rep").mapInArrow(block_links, "a long, b long")))
            break
        pivots = stored(large.join(sets.select(F.col("rep").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot").select("path", "pivot_sketch"))
        seen = by_ids(heavy, pivots, "path", "inner").select("path", "rep", "sketch", "pivot", "pivot_sketch")
        seen = stored(seen.mapInArrow(pivoted, "path long, rep long, sketch binary, pivot long, near double"))
        links.append(seen.filter((F.col("near") >= LINK) & (F.col("rep") != F.col("pivot"))).select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
        rest = seen.filter((F.col("near") < LEAVE) & (F.col("rep") != F.col("pivot"))).select("path", "rep", "sketch")
        paths = stored(rest.mapInArrow(deeper(threshold), "path long, rep long, sketch binary"))
        level += 1
    out = spark.createDataFrame([], "a long, b long")
    for x in links:
        out = out.unionByName(x)
    return out


def exact_links(n: int, threshold: float):
    """Exact similarities in each task: links of each set, counted by rows of the other side, and its component's smallest member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "task", 1):
            task, rep, copies = (t.column(c).to_numpy() for c in ("task", "rep", "copies"))
            side, halves, alone = t.column("side").to_numpy(), t.column("halves").to_numpy(zero_copy_only=False), t.column("alone").to_numpy(zero_copy_only=False)
            tokens = t.column("tokens").combine_chunks()
            off, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
            found: list[tuple] = []
            for s, m in zip(*(x.tolist() for x in runs_of(task)), strict=True):
                sizes = off[s + 1 : s + m + 1] - off[s : s + m]
                flat_t = flat[off[s] : off[s + m]]
                if m == 2:
                    both = np.array([[0, len(np.intersect1d(flat[off[s] : off[s + 1]], flat[off[s + 1] : off[s + 2]], assume_unique=True))]] * 2)
                    both[1] = both[1, ::-1]
                else:
                    both = shared(flat_t, np.repeat(np.arange(m), sizes), m)
                union = sizes[:, None] + sizes[None, :] - both
                link = both >= threshold * union - 1e-9
                np.fill_diagonal(link, False)
                if halves[s]:
                    link &= side[s : s + m, None] != side[None, s : s + m]
                found.append((rep[s : s + m], rep[s + label(link)], link @ copies[s : s + m], alone[s : s + m]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["rep", "low", "links", "alone"])

    def shared(tok: np.ndarray, row: np.ndarray, m: int) -> np.ndarray:
        """Sizes of the intersections of all pairs of m sets, by matrix products over slices of their shared tokens."""
        order = np.argsort(tok, kind="stable")
        at, size = runs_of(tok[order])
        often = size > 1
        col = np.repeat(np.cumsum(often) - 1, size)
        keep = np.repeat(often, size)
        rows, cols = row[order][keep], col[keep]
        both = np.zeros((m, m), np.float64)
        width = max(256, 4_000_000 // m)
        for lo in range(0, int(often.sum()), width):
            a, b = np.searchsorted(cols, (lo, lo + width))
            x = np.zeros((m, width), np.float32)
            x[rows[a:b], cols[a:b] - lo] = 1
            both += x @ x.T
        return both.round().astype(np.int64)

    return run


def tokens_of(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "__text"):
            tok, doc = sets_of(texts, n)
            off = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(tok.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["rep", "tokens"])

    return run


def similarity_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99999, limit: int = 2000, depth: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row the class it belongs to, by similar word n-grams, and how many rows it links with.

    Two texts link when the Jaccard similarity of their sets of word n-grams is at least ``threshold``; a class is a connected
    component of links, named by its smallest id. Texts with equal sets are one set with a number of copies, so copies are never
    expanded into pairs; their links are counted all the same.

    Chosen paths: sets are embedded by min-hashing; each run splits all sets on sampled coordinates, and runs repeat until a pair at the
    threshold shares a bucket with probability ``recall``. Small buckets are brute-forced on sketches, large ones split on
    (``candidate_links``). The candidates' components, each set sent once, or once for each pair of blocks where a component has
    more than ``limit`` sets or very long texts, are then compared exactly, all pairs of different sets.

    Null and empty texts and texts without words link with nothing. Texts of fewer than n words have one n-gram of all their
    words. Ids are integers; a row with a null id has no class and no part in the join. Rows that repeat an id count as copies.
    Returns the id, class_id, n_links.
    """
    source = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    rows = stored(source.mapInArrow(embed(n, threshold, recall), "id long, k1 long, k2 long, size long, paths array<long>, sketch binary"))
    real = rows.filter(F.col("id").isNotNull() & F.col("k1").isNotNull())
    heads = stored(real.groupBy("k1", "k2", "size").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min_by("paths", "id").alias("paths"), F.min_by("sketch", "id").alias("sketch")))
    roots = components(candidate_links(heads.select("rep", "paths", "sketch"), threshold, limit, depth))
    members = heads.select("rep", "copies", "size").join(roots.select(F.col("node").alias("rep"), "root"), "rep")
    few = F.least(F.ceil(F.count("*") / (limit / 4)), F.lit(16))  # a middling component goes to several tasks; a large one is not cut finer than it must
    per_root = members.groupBy("root").agg(F.greatest(few, F.ceil(F.count("*") / limit), F.ceil(F.sum("size") / 4_000_000)).alias("blocks"))
    members = stored(members.join(per_root, "root").select("rep", "root", "copies", "blocks"))
    texts = by_ids(source.withColumnRenamed("__id", "rep"), members.select("rep"), "rep", "left_semi").mapInArrow(tokens_of(n), "rep long, tokens array<long>").dropDuplicates(["rep"])
    dealt = blocked(texts.join(members, "rep"), "root", "rep", "blocks").select("task", "rep", "copies", "side", "halves", "alone", "tokens")
    dealt = dealt.repartition("task").sortWithinPartitions("task", "rep")
    exact = stored(dealt.mapInArrow(exact_links(n, threshold), "rep long, low long, links long, alone boolean"))
    split = components(exact.filter(~F.col("alone")).select(F.col("rep").alias("a"), F.col("low").alias("b")))
    per_set = exact.groupBy("rep").agg(F.sum("links").alias("links"), F.min("low").alias("low")).join(split.select(F.col("node").alias("rep"), "root"), "rep", "left")
    per_set = heads.select("k1", "k2", "size", "rep", "copies").join(per_set, "rep", "left").select("k1", "k2", "size", F.coalesce("root", "low", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = real.select("id", "k1", "k2", "size").join(per_set, ["k1", "k2", "size"]).select("id", "class_id", "n_links")
    lone = rows.filter(F.col("id").isNull() | F.col("k1").isNull()).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return joined.unionByName(lone).withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of each class: the first one of the smallest id.

    Rows that repeat an id repeat its text, so one of them stays; rows without an id are told apart by their whole content. Such
    rows are few among all, so that texts stay where they are otherwise.
    """
    others = stored(classes.filter(F.col("class_id") != F.col(id_col)).select(id_col).distinct())
    left = by_ids(docs, others, id_col, "left_anti").select(*docs.columns)
    repeated = stored(classes.filter(F.col(id_col).isNotNull() & (F.col("class_id") == F.col(id_col))).groupBy(id_col).agg(F.count("*").alias("__n")).filter(F.col("__n") > 1).select(id_col))
    out = left.filter(F.col(id_col).isNotNull()).unionByName(left.filter(F.col(id_col).isNull()).distinct())
    if not repeated.count():
        return out
    again = by_ids(left, repeated, id_col, "left_semi").dropDuplicates([id_col])
    return by_ids(out, repeated, id_col, "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))
