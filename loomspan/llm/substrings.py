"""Removal of repeated 50-byte strings with per-shard suffix arrays, merged across shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Prefix, by_ids, groups, mix64, stored

#: Bytes of text in a shard (a longer text is cut into several), texts in one, and the gram that anchors are chosen from.
SHARD_BYTES, SHARD_TEXTS, GRAM = 4_000_000, 50_000, 16
#: Bytes of text for each bucket of anchors.
BUCKET_BYTES = 6_000_000
#: Windows sent to one bucket above which they are matched as rows.
HOT_WINDOWS = 8_000_000
#: Bits of a gram's place in its shard, and of a text's number there.
POS_BITS, DOC_BITS = 28, 16
KASAI_BLOCK = 64
#: Bytes of text that are hashed at a time, and windows.
HASH_BYTES, BLOCK = 500_000, 1 << 16
ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)]


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as little-endian numbers; zeros follow the text."""
    padded = np.r_[text, np.zeros(8, np.uint8)]
    return np.ndarray(len(text), "<u8", padded, strides=(1,)).astype(np.uint64)


def suffix_array(text: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes of the pieces of a text by their first ``depth`` bytes or more, and each one's rank.

    Larsson-Sadakane: suffixes are sorted by eight bytes, then groups of equal ones, and only those, by the rank of
    the suffix behind, which doubles the sorted length each time. ``end`` holds the end of the piece that each position lies in;
    a suffix ends there.
    """
    n = len(text)
    key = eights(text).byteswap()
    cut = (np.maximum(8 - (end - np.arange(n)), 0) * 8).astype(np.uint64)  # bits that lie behind the piece
    key = (key >> cut) << cut
    order = np.argsort(key).astype(np.int32)
    sorted_key = key[order]
    fresh = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1
    del key, sorted_key
    h = 8
    open_ = np.flatnonzero(~fresh | np.r_[~fresh[1:], False]) if n else np.zeros(0, np.int64)
    while h < depth and len(open_):
        pos = order[open_].astype(np.int64)
        behind = np.where(pos + h < end[pos], rank[np.minimum(pos + h, n - 1)], 0)
        both = (rank[pos].astype(np.uint64) << np.uint64(32)) | behind.astype(np.uint64)
        by = np.argsort(both, kind="stable")
        both, pos = both[by], pos[by]
        order[open_] = pos
        new = np.r_[True, both[1:] != both[:-1]]
        rank[pos] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] + 1
        open_ = open_[~new | np.r_[~new[1:], False]]
        h *= 2
    return order, rank


def common_prefixes(text: np.ndarray, end: np.ndarray, order: np.ndarray, rank: np.ndarray, cap: int) -> np.ndarray:
    """Length, up to ``cap``, that each suffix shares with the one before it in the order (Kasai's method).

    Suffixes that differ in their first eight bytes are done at once. The other positions are passed in text order, each starting
    from the length before less one. Blocks of positions advance in lockstep, so that each step is one array operation, and compare
    eight bytes at once; a block only loses what its first position would have inherited. The order is only by the first bytes:
    suffixes of equal rank agree in ``cap`` bytes, as far as they go, and pass nothing on.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    eight = eights(text)

    def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many of eight bytes are equal before the first that differs."""
        differ = eight[i] ^ eight[j]
        return np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3

    most = np.minimum(np.minimum(end - np.arange(n), end[before] - before), cap)
    most[before < 0] = 0
    out = np.minimum(same(np.arange(n), before), most).astype(np.uint8)
    tie = np.zeros(n, bool)
    tie[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    out[tie] = most[tie]
    rest = np.flatnonzero((out == 8) & (most > 8) & ~tie)
    starts = np.arange(0, len(rest), KASAI_BLOCK)
    h = np.full(len(starts), 8, np.int64)
    last = np.full(len(starts), -2, np.int64)
    for t in range(KASAI_BLOCK):
        live = starts + t < len(rest)
        starts, h, last = starts[live], h[live], last[live]
        if not len(starts):
            break
        i = rest[starts + t]
        j, m = before[i], most[i]
        h = np.minimum(np.where(last + 1 == i, np.maximum(h - 1, 8), 8), m)
        act = np.flatnonzero(h < m)
        while len(act):
            more = same(i[act] + h[act], j[act] + h[act])
            h[act] = np.minimum(h[act] + more, m[act])
            act = act[(more == 8) & (h[act] < m[act])]
        out[i] = h
        last = i
    return out[order]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == width else np.minimum(x[: len(x) - (width - span)], x[width - span :])


class Shard:
    """The texts of a shard end to end, with each 50-byte window's anchor.

    A window's anchor is its 16-byte gram of least hash, the first of equals: equal windows have equal anchors at equal places.
    Neighbouring windows mostly share one. ``lo`` and ``hi`` give the runs of windows with one anchor. ``keys`` holds the
    distinct anchors in order, ``which`` each run's place among them, and ``several`` whether more than one text of the shard has the anchor.
    """

    def __init__(self, blob: bytes, sizes: np.ndarray, length: int):
        self.text = np.frombuffer(blob, np.uint8)
        self.sizes, self.length = sizes, length
        self.first = np.r_[0, np.cumsum(sizes)]
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        n = len(self.text)
        self.keys = np.zeros(0, np.uint64)
        self.several = np.zeros(0, bool)
        self.which = self.lo = self.hi = np.zeros(0, np.int64)
        if n < length:
            return
        start = np.flatnonzero(self.doc[: n - length + 1] == self.doc[length - 1 :])
        if not len(start):
            return
        places, grams = self.anchors(n - length + 1)
        anchor = places[start]
        at = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
        self.lo, self.hi = start[at], start[np.r_[at[1:], len(start)] - 1]
        key = mix64(grams[start[at]]) >> np.uint64(DOC_BITS)  # least hashes are small: mixed again, they fill all buckets alike
        owned = np.sort(key << np.uint64(DOC_BITS) | self.doc[self.lo].astype(np.uint64))
        owned = owned[np.r_[True, owned[1:] != owned[:-1]]]
        of = owned >> np.uint64(DOC_BITS)
        fresh = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        self.keys, self.several = of[fresh], np.diff(np.r_[fresh, len(of)]) > 1
        self.which = np.searchsorted(self.keys, key)

    def anchors(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of the anchor of each of the first ``n`` windows, made in blocks that fit a processor's cache."""
        places, hashes = np.empty(n, np.int32), np.empty(n, np.uint64)
        low = np.uint64(2**POS_BITS - 1)
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            words = eights(self.text[lo : hi + self.length])
            m = hi - lo + self.length - GRAM
            grams = words[:m] * ODD[0]
            grams += words[GRAM - 8 : m + GRAM - 8] * ODD[1]
            grams ^= grams >> np.uint64(29)
            grams *= ODD[2]
            grams >>= np.uint64(POS_BITS)
            grams <<= np.uint64(POS_BITS)
            grams |= np.arange(lo, lo + m, dtype=np.uint64)
            least = sliding_min(grams, self.length - GRAM + 1)
            places[lo:hi] = least & low
            hashes[lo:hi] = least >> np.uint64(POS_BITS)
        return places, hashes


SHARD = "shard long, whole long, skip int, tail int, ids array<long>, sizes array<long>, blob binary"


def pack(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """Shards of about SHARD_BYTES of text, as rows.

    A longer text is cut into shards of its own, which overlap by ``length`` - 1 bytes on both sides, so that each holds every
    window that covers its own bytes: ``skip`` and ``tail`` count the others'. ``whole`` is the first such shard's number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, blobs, total = [], [], 0
        schema = pa.schema([("shard", pa.int64()), ("whole", pa.int64()), ("skip", pa.int32()), ("tail", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("blob", pa.binary())])

        def row(ids: list[int], blobs: list[bytes], whole: int | None = None, skip: int = 0, tail: int = 0) -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            return pa.RecordBatch.from_pydict({"shard": [part << 32 | seq], "whole": [whole], "skip": [skip], "tail": [tail], "ids": [ids], "sizes": [[len(b) for b in blobs]], "blob": [b"".join(blobs)]}, schema)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = (t or "").encode("utf-8", "surrogatepass")
                if len(b) > SHARD_BYTES:
                    whole = part << 32 | (seq + 1)
                    for at in range(0, len(b), SHARD_BYTES):
                        lo, end = max(0, at - length + 1), min(len(b), at + SHARD_BYTES)
                        hi = min(len(b), end + length - 1)
                        yield row([i], [b[lo:hi]], whole, at - lo, hi - end)
                    continue
                if blobs and (total + len(b) > SHARD_BYTES or len(ids) >= SHARD_TEXTS):
                    yield row(ids, blobs)
                    ids, blobs, total = [], [], 0
                ids.append(i)
                blobs.append(b)
                total += len(b)
        if blobs:
            yield row(ids, blobs)

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, SHARD)


def shards_in(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            row["ids"], row["sizes"] = np.array(row["ids"], np.int64), np.array(row["sizes"], np.int64)
            yield row


def buckets_of(key: np.ndarray, n: int) -> np.ndarray:
    """Buckets of anchors, whose keys have 48 bits, in the order of the keys."""
    return ((key >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def cuts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each stretch of equal numbers."""
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True)) if len(at) else []


def anchors(n_buckets: int, length: int):
    """Per shard and bucket: the distinct anchors in order, and which of them occur in several of the shard's texts.

    Of an anchor's key 32 bits are sent; two that agree by chance only make windows candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in shards_in(batches):
            s = Shard(row["blob"], row["sizes"], length)
            out = [(j, s.keys[x:y].astype(np.uint32).tobytes(), np.packbits(s.several[x:y]).tobytes()) for j, x, y in cuts(buckets_of(s.keys, n_buckets))]
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["shard", "bucket", "keys", "several"])

    return run


def answer_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard and bucket: a bit for each anchor, set if another text has it too."""
    for t in groups(batches, "bucket", 1):
        keys, several = t.column("keys").to_pylist(), t.column("several").to_pylist()
        bits: list[bytes] = []
        for _, x, y in cuts(t.column("bucket").to_numpy()):
            every = np.frombuffer(b"".join(keys[x:y]), np.uint32)
            size = np.fromiter(map(len, keys[x:y]), np.int64, y - x) // 4
            own = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=k) for b, k in zip(several[x:y], size.tolist(), strict=True)])
            merged, count = np.unique(every, return_counts=True)
            common = count > 1
            common[np.searchsorted(merged, every[own > 0])] = True
            found = common[np.searchsorted(merged, every)]  # where each falls in the merged list
            bits += [np.packbits(f).tobytes() for f in np.split(found, np.cumsum(size)[:-1])]
        yield pa.RecordBatch.from_arrays([t.column("shard").combine_chunks(), t.column("bucket").combine_chunks(), pa.array(bits, pa.binary())], ["shard", "bucket", "bits"])


SENT = "shard long, bucket long, n long, runs binary, blob binary"


def local_step(n_buckets: int, length: int):
    """Per shard: windows repeated inside it (bucket -1: a bit for each position), and per bucket the runs that others must see.

    What repeats inside a shard has an anchor that several of its texts have: the suffix array is built over such runs alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for row in shards_in(batches):
            s = Shard(row["blob"], row["sizes"], length)
            bits = np.zeros(len(s.keys), bool)
            answers = {r["bucket"]: r["bits"] for r in row["replies"] or ()}
            for j, x, y in cuts(buckets_of(s.keys, n_buckets)):
                bits[x:y] = np.unpackbits(np.frombuffer(answers[j], np.uint8), count=y - x)
            here = s.several[s.which]
            marked = repeats(s, s.lo[here], s.hi[here], row["ids"], length)
            seen = np.r_[0, np.cumsum(marked, dtype=np.int32)]
            send = np.flatnonzero(bits[s.which] & (seen[s.hi + 1] - seen[s.lo] < s.hi + 1 - s.lo))
            send = send[np.argsort(s.which[send], kind="stable")]
            lo, hi, of = s.lo[send], s.hi[send], s.which[send]
            out = [[row["shard"]], [-1], [0], [b""], [squeeze(np.packbits(marked).tobytes())]]
            for j, x, y in cuts(buckets_of(s.keys[of], n_buckets)):
                r = np.arange(x, y)[np.argsort(lo[x:y])]
                size = hi[r] - lo[r] + length
                where = np.repeat(lo[r] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                runs = squeeze(planes(np.r_[np.diff(lo[r], prepend=0), hi[r] - lo[r] + 1]))
                blob = squeeze(row["ids"][s.doc[lo[r]]].tobytes() + s.keys[of[r]].astype(np.uint32).tobytes() + s.text[where].tobytes())
                for col, v in zip(out, (row["shard"], j, int((hi[r] - lo[r] + 1).sum()), runs, blob), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "bucket", "n", "runs", "blob"])

    return run


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32 as their four bytes apart: the high ones are mostly zero and compress to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def runs_sent(runs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run."""
    raw = np.frombuffer(zstandard.decompress(runs), np.uint8).reshape(4, -1).T
    both = np.ascontiguousarray(raw).view("<u4").ravel().astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def repeats(s: Shard, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Which positions of the shard begin a window of the runs that also starts in a text of the shard with a smaller id.
    The suffix array is built over the runs' text alone."""
    n = len(s.text)
    marked = np.zeros(n + 1, bool)
    if not len(lo):
        return marked
    stop = np.maximum.accumulate(hi + length)
    new = np.r_[True, lo[1:] >= stop[:-1]]
    first = lo[new]
    size = stop[np.r_[np.flatnonzero(new)[1:] - 1, len(lo) - 1]] - first
    where, end = spread(first, size), np.repeat(np.cumsum(size), size)
    text = s.text[where]
    order, rank = suffix_array(text, end, length)
    lcp = common_prefixes(text, end, order, rank, length)
    group = np.flatnonzero(lcp < length)  # suffixes from here to the next share their first ``length`` bytes
    owner = ids[s.doc[where]][order]
    least = np.minimum.reduceat(owner, group)
    repeated = owner > np.repeat(least, np.diff(np.r_[group, len(order)]))
    marked[where[order[repeated & ((end - np.arange(len(text)))[order] >= length)]]] = True
    return marked


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``start``, range by range."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def ranges_hash(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range of a text, for ranges in the order of their start, a bounded stretch of text at a time."""
    out = np.empty(len(start), np.uint64)
    x = 0
    while x < len(start):
        y = max(x + 1, int(np.searchsorted(start, start[x] + HASH_BYTES)))
        base, stop = int(start[x]), int(end[x:y].max())
        out[x:y] = Prefix(text[base:stop]).ranges(start[x:y] - base, end[x:y] - base)
        x = y
    return out


def first_of_equals(key: np.ndarray, own: np.ndarray, equal) -> np.ndarray:
    """For each item the index of the one of least ``own`` among those equal to it.

    Keys are sorted and each item is searched for among the distinct ones; ``equal(i, j)`` then compares the items themselves, and
    items that share a key by chance only are parted, one kind after the other.
    """
    first = np.arange(len(key))
    rest = first
    while len(rest):
        by = rest[np.argsort(key[rest])]
        sorted_key, sorted_own = key[by], own[by]
        head = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
        group = np.searchsorted(sorted_key[head], sorted_key)  # in order, so that the search stays in a processor's cache
        least = np.flatnonzero(sorted_own == np.minimum.reduceat(sorted_own, head)[group])
        lead = by[least[np.searchsorted(least, head)]][group]  # the first of least owner in each group
        ok = by == lead
        todo = np.flatnonzero(~ok)
        ok[todo] = equal(by[todo], lead[todo])
        first[by[ok]] = lead[ok]
        rest = by[~ok]
    return first


def sent_runs(runs: list[bytes], blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """What shards sent, end to end: the row of each run, its first window, number of windows, text id, anchor; and the text."""
    lo, lens, own, anchor, text = [], [], [], [], []
    for r, b in zip(runs, blobs, strict=True):
        start, n = runs_sent(r)
        raw = zstandard.decompress(b)
        lo.append(start)
        lens.append(n)
        own.append(np.frombuffer(raw, np.int64, len(n)))
        anchor.append(np.frombuffer(raw, np.uint32, len(n), 8 * len(n)))
        text.append(raw[12 * len(n) :])
    row = np.repeat(np.arange(len(lo)), list(map(len, lo)))
    return row, *map(np.concatenate, (lo, lens, own, anchor)), np.frombuffer(b"".join(text), np.uint8)


def repeated_windows(own: np.ndarray, lens: np.ndarray, anchor: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Which windows of the runs, run by run, also start in a text with a smaller id.

    Whole runs are matched first, since most of a repeated passage is made of equal runs; the windows of different runs with one
    anchor are matched after that. Bytes are compared in both, so that no hash decides.
    """
    size = lens + length - 1
    start = np.cumsum(size) - size

    def same_run(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = size[i] == size[j]
        ok[ok] = same_bytes(text, start[i[ok]], start[j[ok]], size[i[ok]])
        return ok

    lead = first_of_equals(ranges_hash(text, start, start + size), own, same_run)
    leads = np.unique(lead)
    by = leads[np.argsort(anchor[leads], kind="stable")]
    alone = np.r_[True, anchor[by[1:]] != anchor[by[:-1]]]
    alone &= np.r_[alone[1:], True]
    open_ = np.sort(by[~alone])
    mark = np.zeros(int(lens.sum()), bool)
    first = np.cumsum(lens) - lens
    begin = spread(start[open_], lens[open_])
    of = np.repeat(own[open_], lens[open_])
    least = first_of_equals(ranges_hash(text, begin, begin + length), of, lambda i, j: same_bytes(text, begin[i], begin[j], np.full(len(i), length)))
    mark[spread(first[open_], lens[open_])] = of > of[least]
    copies = np.flatnonzero(lead != np.arange(len(lead)))
    mark[spread(first[copies], lens[copies])] = mark[spread(first[lead[copies]], lens[copies])] | np.repeat(own[copies] > own[lead[copies]], lens[copies])
    return mark


def same_bytes(text: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges at ``i`` and ``j`` hold the same bytes; sizes are eight or more."""
    ok = np.ones(len(i), bool)
    todo = np.arange(len(i))
    eight = np.ndarray(max(0, len(text) - 7), "<u8", text, strides=(1,))
    for k in range(0, int(size.max(initial=0)), 8):
        todo = todo[size[todo] > k]
        at = np.minimum(k, size[todo] - 8)
        same = eight[i[todo] + at] == eight[j[todo] + at]
        ok[todo[~same]] = False
        todo = todo[same]
    return ok


def stretches(place: np.ndarray) -> bytes:
    """Sorted places as starts and lengths of stretches without a gap."""
    at = np.flatnonzero(np.r_[True, place[1:] != place[:-1] + 1])
    start, stop = place[at], place[np.r_[at[1:], len(place)] - 1] + 1
    return zstandard.compress(planes(np.r_[np.diff(start, prepend=0), stop - start]), 1)


def merge_windows(length: int):
    """Per shard and bucket: the windows sent that a text with a smaller id has too; nothing where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "bucket", 1):
            shard, runs, blobs = t.column("shard").to_numpy(), t.column("runs"), t.column("blob")
            out: tuple[list, list] = ([], [])
            for _, x, y in cuts(t.column("bucket").to_numpy()):
                row, lo, lens, own, anchor, text = sent_runs(runs.slice(x, y - x).to_pylist(), blobs.slice(x, y - x).to_pylist())
                mark = repeated_windows(own, lens, anchor, text, length)
                of, place = np.repeat(row, lens)[mark], spread(lo, lens)[mark]
                for r, a, z in cuts(of):
                    out[0].append(shard[x + r])
                    out[1].append(stretches(place[a:z]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["shard", "runs"])

    return run


def as_rows(length: int):
    """The windows of hot buckets as rows, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, runs, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "runs", "blob")), strict=True):
                _, lo, lens, own, _, text = sent_runs([runs], [blob])
                size = lens + length - 1
                begin = spread(np.cumsum(size) - size, lens)
                place, of = spread(lo, lens), np.repeat(own, lens)
                for x in range(0, len(begin), 200_000):
                    b = begin[x : x + 200_000]
                    window = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(b), [None, pa.py_buffer(text[b[:, None] + np.arange(length)].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), shard)), pa.array(place[x : x + 200_000]), pa.array(of[x : x + 200_000]), window.cast(pa.binary())], ["shard", "place", "id", "window"])

    return run


def gathered_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places given for each shard, as stretches; a shard has a bounded number of places."""
    for t in groups(batches, "shard", 1):
        shard, place = t.column("shard").to_numpy(), t.column("place").to_numpy()
        found = [(s, stretches(np.unique(place[x:y]))) for s, x, y in cuts(shard)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["shard", "runs"])


def merge_hot(rows: DataFrame, length: int) -> DataFrame:
    """What ``merge_windows`` finds, for buckets that one task could not hold: windows that very many shards have.

    Windows become rows. Their least id is a partial aggregate, and rows meet it in a join whose hot keys Spark can split.
    """
    windows = stored(rows.mapInArrow(as_rows(length), "shard long, place long, id long, window binary"))
    least = stored(windows.groupBy("window").agg(F.min("id").alias("least")))
    later = windows.join(least, "window").filter("id > least").select("shard", "place")
    return later.repartition("shard").sortWithinPartitions("shard").mapInArrow(gathered_places, "shard long, runs binary")


FOUND = "shard long, whole long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, first_gone boolean, last_gone boolean, kept binary"


def finish(length: int, keep: bool):
    """What is left of each text of a shard, or of the shard's own part of a longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in shards_in(batches):
            text = np.frombuffer(row["blob"], np.uint8)
            n = len(text)
            mark = np.zeros(n + 1, bool)
            for r in row["replies"] or ():
                if r["bits"] is not None:
                    mark |= np.unpackbits(np.frombuffer(zstandard.decompress(r["bits"]), np.uint8), count=n + 1).astype(bool)
                else:
                    mark[spread(*runs_sent(r["runs"]))] = True
            upto = np.r_[np.zeros(length, np.int32), np.cumsum(mark[:n], dtype=np.int32)]
            gone = upto[length:] > upto[: len(upto) - length] if n else np.zeros(0, bool)
            out: list[list] = [[] for _ in range(10)]
            at = 0
            for i, size in zip(row["ids"].tolist(), row["sizes"].tolist(), strict=True):
                own = slice(at + row["skip"], at + size - row["tail"])
                g = gone[own]
                kept = text[own][~g].tobytes() if g.any() else text[own].tobytes()
                values = (row["shard"], row["whole"], i, len(g), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest(), bool(g[:1].any()), bool(g[-1:].any()), kept if keep else None)
                for c, v in zip(out, values, strict=True):
                    c.append(v)
                at += size
            kinds = [pa.int64()] * 6 + [pa.string(), pa.bool_(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["shard", "whole", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "first_gone", "last_gone", "kept"])

    return run


def joined_parts(parts: DataFrame) -> DataFrame:
    """One row for each text that was cut into shards: sums, spans that run over a cut counted once, kept bytes in order."""
    edges = F.array_sort(F.collect_list(F.struct("shard", "first_gone", "last_gone")))
    out = parts.groupBy("whole").agg(
        F.first("id").alias("id"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_removed").alias("n_removed"), F.sum("n_spans").alias("n_spans"),
        edges.alias("e"), F.expr("listagg(kept) WITHIN GROUP (ORDER BY shard)").alias("kept"),
    )
    over = F.filter(F.zip_with(F.slice("e", 1, F.size("e") - 1), F.slice("e", 2, F.size("e") - 1), lambda a, b: a["last_gone"] & b["first_gone"]), lambda x: x)
    kept = F.coalesce("kept", F.lit(b""))
    return out.select("id", "n_bytes", "n_removed", (F.col("n_spans") - F.size(over)).alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"), kept.alias("kept"))


def remove_repeats(docs: DataFrame, length: int = 50, max_broadcast: int = 64_000_000, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove from each text every byte covered by a ``length``-byte string that also starts in a text with a smaller id.

    Texts are packed into shards. (1) Winnowing picks an anchor gram for each window; shards send their sorted distinct anchors to
    buckets by hash, where binary search in the merged list tells which occur in several texts. Only windows with such an
    anchor can repeat. (2) Each shard builds a suffix array (Larsson-Sadakane) over the text of windows whose anchor several of its own
    texts have, with common prefixes by Kasai's method, and marks what repeats inside the shard. A run of windows that all have a smaller
    owner in the shard is not sent: a group of copies leaves a shard once. (3) The other runs with an anchor that another shard
    has meet in buckets by anchor. There runs, and then the windows of runs that differ, are searched for in the sorted list of
    distinct ones, compared byte by byte, and each shard gets the stretches of its windows that a text with a smaller id has.
    Buckets above HOT_WINDOWS are matched as rows instead (``merge_hot``). (4) Shards remove what is marked.

    Strings are judged on the input and never cross texts; equal ids are no smaller ids. Null texts are empty; a null id removes
    nothing and is removed by nothing. Ids are integers. Answers to the shards are broadcast up to ``max_broadcast`` bytes, else joined
    by a shuffle. Returns the id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (the bytes) with ``keep_text``.
    """
    shards = stored(pack(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, length), "zstd")
    total, cut = shards.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0)), F.count("whole")).first()
    n_buckets = max(32, int(total // BUCKET_BYTES))

    def reply(shards: DataFrame, rows: DataFrame, *cols: str) -> DataFrame:
        """Shards with what was answered to them."""
        per = rows.groupBy("shard").agg(F.collect_list(F.struct(*cols)).alias("replies"))
        size = rows.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in cols if c != "bucket"), F.lit(0)))).first()[0] or 0
        return shards.join(F.broadcast(per) if size <= max_broadcast else per, "shard", "left")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "shard")

    asked = shards.mapInArrow(anchors(n_buckets, length), "shard long, bucket long, keys binary, several binary")
    answers = stored(dealt(asked).mapInArrow(answer_anchors, "shard long, bucket long, bits binary"))
    local = stored(reply(shards, answers, "bucket", "bits").mapInArrow(local_step(n_buckets, length), SENT))
    others = local.filter("bucket >= 0")
    hot = stored(others.groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT_WINDOWS).select("bucket"))
    n_hot = hot.count()
    merged = dealt(by_ids(others, hot, "bucket", "left_anti") if n_hot else others).mapInArrow(merge_windows(length), "shard long, runs binary")
    if n_hot:
        merged = merged.unionByName(merge_hot(by_ids(others, hot, "bucket", "left_semi"), length))
    own = local.filter("bucket < 0").select("shard", F.lit(None).cast("binary").alias("runs"), F.col("blob").alias("bits"))
    marks = stored(merged.withColumn("bits", F.lit(None).cast("binary")).unionByName(own))

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
    whole = reply(shards.filter("whole IS NULL"), marks, "runs", "bits").mapInArrow(finish(length, keep_text), FOUND)
    out = whole.select(F.col("id").alias(id_col), *names)
    if cut:
        parts = reply(shards.filter("whole IS NOT NULL"), marks, "runs", "bits").mapInArrow(finish(length, True), FOUND)
        out = out.unionByName(joined_parts(parts).select(F.col("id").alias(id_col), *names))
    bytes_ = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    null = docs.filter(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias(id_col), F.octet_length(bytes_).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(bytes_, 256).alias("kept_sha256"), *([bytes_.alias("kept")] if keep_text else []))
    return out.unionByName(null)
