"""Shared pieces: the folder all executors see, Arrow batch handling, and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

#: Characters of text that one vectorised step holds at most, unless a single text is longer.
STEP_CHARS = 1_000_000
SEED_BYTES = np.random.RandomState(7).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
MULT = 0x9E3779B97F4A7C15
MULT_INV = pow(MULT, -1, 2**64)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, below a temporary folder in local mode and nowhere else."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or (str(sc.getCheckpointDir()) if sc.getCheckpointDir() else None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loomspan-")
        sc.setCheckpointDir(base)
    path = f"{base}/table-{uuid.uuid4().hex}"
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends, and later reads cost no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steps(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts have about ``limit`` characters, with the texts as strings (null: empty)."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text_col).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= limit or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((MULT, MULT_INV)):
            steps_ = np.full(n, base, np.uint64)
            steps_[0] = 1
            _powers[k] = np.multiply.accumulate(steps_)
    return _powers[0][:n], _powers[1][:n]


class Prefix:
    """Prefix sums of a polynomial hash over a byte buffer, which give the hash of any range at once."""

    def __init__(self, buf: np.ndarray):
        up, self.inv = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(SEED_BYTES[buf] * up[:-1], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """The hash of each window of the given length."""
        if len(self.sums) <= length:
            return np.zeros(0, np.uint64)
        return mix64((self.sums[length:] - self.sums[:-length]) * self.inv[: len(self.sums) - length])


WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words:
    """Lower-case words of many texts as flat arrays. A word is a run of ASCII letters, digits and non-ASCII characters."""

    def __init__(self, texts: list[str], ascii_only: bool = False):
        """ascii_only: lower-case A-Z and no other letter."""
        parts = [t.encode("utf-8", "surrogatepass").lower() if ascii_only else t.lower().encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        first = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(sizes + 1, out=first[1:])
        inside = WORD_BYTE[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.r_[0, edge]
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, first)  # index of each text's first word, and the end
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.first))
        self.prefix = Prefix(self.buf)
        self.hash = self.prefix.ranges(self.start, self.end)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text index of each run of n words; a text of one to n-1 words has one shingle of all of them."""
        weights = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(MULT)) | np.uint64(1)
        count = np.diff(self.first)
        m = len(self.hash) - n + 1
        if m > 0:
            h = sum((self.hash[k : k + m] * weights[k] for k in range(n)), np.zeros(m, np.uint64))
            keep = self.doc[:m] == self.doc[n - 1 : n - 1 + m]
            h, d = h[keep], self.doc[:m][keep]
        else:
            h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            extra = [np.uint64(sum(int(self.hash[self.first[i] + k]) * int(weights[k]) for k in range(count[i])) % 2**64) for i in short]
            h, d = np.r_[h, np.array(extra, np.uint64)], np.r_[d, short]
            order = np.argsort(d, kind="stable")
            h, d = h[order], d[order]
        return mix64(h), d


def by_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str, max_bytes: int = 64_000_000) -> DataFrame:
    """Semi, anti or inner join of wide rows with a narrow table of ids (stored or cheap to count).

    Up to ``max_bytes`` are broadcast, so that texts stay where they are; larger tables are joined by a shuffle of both sides. A row
    counts 24 bytes and 8 for each number or flag, 88 for any other value (the longest here is a sketch of 64 bytes).
    """
    width = 24 + sum(8 if isinstance(f.dataType, (NumericType, BooleanType)) else 88 for f in ids.schema.fields)
    return docs.join(F.broadcast(ids) if ids.count() * width <= max_bytes else ids, id_col, how)


def groups(batches: Iterator[pa.RecordBatch], key: str, limit: int) -> Iterator[pa.Table]:
    """Tables of about ``limit`` rows or more from rows sorted by ``key``; no group of equal keys is cut."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= limit:
            table = pa.Table.from_batches(held)
            keys = table.column(key).to_numpy()
            last = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
            if last:
                yield table.slice(0, last)
            held = table.slice(last).to_batches()
            n = table.num_rows - last
    if held:
        yield pa.Table.from_batches(held)
