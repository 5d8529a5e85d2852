"""Codes of vectors: one codebook for each part of a vector, by Lloyd rounds that rescan only parts whose bounds drift has violated."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from loomspan.llm.common import stored

#: Scaled components are held to this size, so that squares of whole vectors fit 64 bits.
LARGEST = 2**26
#: Vectors whose heaps are built at once.
BLOCK = 4096


def usable(df: DataFrame, id_col: str, vector: str, label: str, scale: int) -> DataFrame:
    """(__id, __label, __v) of rows whose vector is not empty and holds only finite numbers, components as floor(scale * x)."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-LARGEST).cast("long"), F.least(F.lit(LARGEST).cast("long"), F.floor(x.cast("double") * scale))))
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(~wrong).select(F.col(id_col).alias("__id"), F.col(label).alias("__label"), whole.alias("__v"))


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the first of equal ones) of each row, and the distance to the second nearest minus that to the nearest."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)
    best = d.argmin(axis=1)
    at = np.arange(len(x))
    upper = np.sqrt(d[at, best])
    d[at, best] = np.iinfo(np.int64).max
    return best, np.sqrt(d.min(axis=1)) - upper


class Heaps:
    """For one part of a block of vectors, a heap for each entry over the parts assigned to it, least key first.

    A key is lower minus upper bound plus the entry's drift when the part was put in. An ascending array is a heap whose next pops are
    its prefix, so all parts with a key up to a limit come off by one search.
    """

    def __init__(self, entry: np.ndarray, key: np.ndarray, entries: int):
        self.order = np.lexsort((key, entry))
        self.key = key[self.order]
        self.first = np.searchsorted(entry[self.order], np.arange(entries + 1))

    def pop(self, limit: np.ndarray) -> np.ndarray:
        """Members whose key is at most their entry's limit; the others are not looked at."""
        out = [self.order[lo : lo + np.searchsorted(self.key[lo:hi], top, "right")] for lo, hi, top in zip(self.first[:-1], self.first[1:], limit, strict=True) if hi > lo]
        return np.concatenate([np.zeros(0, np.int64), *out])


def held_down(key: np.ndarray) -> np.ndarray:
    """Keys as 32-bit numbers that are not above the given ones."""
    return np.nextafter(key.astype(np.float32), np.float32(-np.inf))


class Books:
    """Codebooks (part, entry, position), the drift of each entry so far, and sums and counts of the parts assigned to it."""

    def __init__(self, seeds: np.ndarray):
        self.entries = seeds
        self.drift = np.zeros(seeds.shape[:2])
        self.totals = np.zeros((*seeds.shape[:2], seeds.shape[2] + 1), np.int64)

    def updated(self, change: np.ndarray) -> Books:
        """After moving each used entry to the floor of its parts' mean. An entry's bounds drift by its own way and the longest of another's."""
        out = Books(self.entries.copy())
        out.totals = self.totals + change.reshape(self.totals.shape)
        used = out.totals[..., -1] > 0
        out.entries[used] = out.totals[..., :-1][used] // out.totals[..., -1:][used]
        way = np.sqrt(((out.entries - self.entries).astype(np.float64) ** 2).sum(axis=2))
        top = np.sort(way, axis=1)
        other = np.where(way == top[:, -1:], top[:, -2:-1] if way.shape[1] > 1 else 0.0, top[:, -1:])
        other = np.where((way == top[:, -1:]).sum(axis=1, keepdims=True) > 1, top[:, -1:], other)
        out.drift = self.drift + way + other
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def assign(books: Books, v: np.ndarray, code: np.ndarray, key: np.ndarray, fresh: bool) -> np.ndarray:
    """Bring ``code`` and ``key`` of a block up to date in place; the change of sums and counts for each entry."""
    parts, entries, width = books.entries.shape
    change = np.zeros((parts, entries, width + 1), np.int64)
    for p in range(parts):
        x = v[:, p * width : (p + 1) * width]
        # rounding of square roots, of keys and of sums of drift stays far below this margin
        limit = books.drift[p] + 1e-6 * (1 + books.drift[p])
        at = np.arange(len(x)) if fresh else Heaps(code[:, p], key[:, p], entries).pop(limit)
        if not len(at):
            continue
        best, slack = scan(x[at], books.entries[p])
        moved = at if fresh else at[best != code[at, p]]
        one = np.concatenate([x[moved], np.ones((len(moved), 1), np.int64)], axis=1)
        if not fresh:
            np.subtract.at(change[p], code[moved, p], one)
        code[at, p] = best
        np.add.at(change[p], code[moved, p], one)
        key[at, p] = held_down(slack * (1 - 1e-6) + books.drift[p][best])
    return change


def lloyd_round(rows: DataFrame, books: Books, fresh: bool, last: bool) -> DataFrame:
    """One pass of assignment. Rows: id, label, vector, code, keys; and a row for each task with the change of all sums (none if last)."""
    parts, entries, width = books.entries.shape
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                b = batch.slice(lo, BLOCK)
                n = b.num_rows
                v = b.column("__v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts * width)
                if fresh:
                    code, key = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32)
                else:
                    code, key = (np.array([np.frombuffer(x, t) for x in b.column(c).to_pylist()]) for c, t in (("__code", np.uint8), ("__key", np.float32)))
                total += assign(books, v, code, key, fresh)
                cols = {"__id": b.column("__id"), "__label": b.column("__label")}
                if last:
                    near = np.concatenate([books.entries[p][code[:, p]] for p in range(parts)], axis=1)
                    out = {"code": pa.array([x.tobytes().hex() for x in code]), "error": pa.array(((v - near) ** 2).sum(axis=1))}
                else:
                    out = {"__v": b.column("__v"), "__code": pa.array([x.tobytes() for x in code]), "__key": pa.array([x.tobytes() for x in key]), "__sums": pa.nulls(n, pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict(cols | out)
                kept = pa.RecordBatch.from_pydict(cols | out).schema
        if not last and total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()]) if f.name == "__sums" else pa.nulls(1, f.type) for f in kept], schema=kept)

    own = f"__id {kinds['__id']}, __label {kinds['__label']}, "
    return rows.mapInArrow(run, own + ("code string, error long" if last else "__v array<bigint>, __code binary, __key binary, __sums array<bigint>"))


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each usable vector.

    Codebooks start from the vectors of the smallest ids (ties by the vector, null ids last), as many as there are if below
    ``entries``. A vector of another length than that of the smallest id is left out; the length must be a multiple of ``parts``.
    Scaled components beyond 2**26 count as that. Rows that repeat an id stay. The driver holds codebooks and their sums only, tasks
    a block of vectors; each round's bounds are written to the shared folder.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits for each part")
    spark, good = df.sparkSession, usable(df, id_col, vector, label, scale)
    order = (F.asc_nulls_last("__id"), F.col("__v"))
    head = good.orderBy(*order).limit(1).collect()
    if not head:
        kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}[id_col]
        return spark.createDataFrame([], f"`{id_col}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    size = len(head[0]["__v"])
    if size % parts:
        raise ValueError(f"vectors of {size} components have no {parts} equal parts")
    good = good.filter(F.size("__v") == size)
    seeds = np.array([r["__v"] for r in good.orderBy(*order).limit(entries).collect()], np.int64)
    books, rows = Books(np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2))), good
    for k in range(rounds):
        state = stored(lloyd_round(rows, books, k == 0, False))
        summed = state.filter(F.col("__sums").isNotNull()).select(F.posexplode("__sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
        change = np.zeros(books.totals.size, np.int64)
        for r in summed.collect():  # a number for each entry and position
            change[r["at"]] = r["x"]
        books, rows = books.updated(change), state.filter(F.col("__sums").isNull()).drop("__sums")
    done = stored(lloyd_round(rows, books, not rounds, True))
    per = stored(done.groupBy("__label").agg(F.sum("error").alias("label_error")).withColumnRenamed("__label", "__of"))
    fixed = isinstance(df.schema[label].dataType, (NumericType, BooleanType))  # 16 bytes a row; other labels have no bound
    per = F.broadcast(per) if fixed and per.limit(500_001).count() <= 500_000 else per
    out = done.join(per, F.col("__label").eqNullSafe(F.col("__of")))
    return out.select(F.col("__id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
