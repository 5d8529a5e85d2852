"""Token counts by rank-synchronous merging of byte pairs in ragged arrays."""

from __future__ import annotations

import json
from heapq import heappop, heappush
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import steps

#: How byte-level vocabularies part a text before merging.
PRE_TOKEN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+")
NONE = np.int64(2**62)
#: Bytes of a piece from which it is merged by itself.
LONG = 2048


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Counter:
    """Counts the tokens of texts under a byte-level BPE vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, path: str, cache: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.start = np.array([vocab[c] for _, c in sorted(byte_symbols().items())], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = keys[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache: dict[str, int] = {}
        self.limit = cache

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols that are left of each piece (none is empty) after all merges.

        Pieces lie end to end in one array. In each round every piece finds its pair of lowest rank and replaces it wherever it
        stands, from the left; pieces without a pair that merges leave the array.
        """
        counts = np.zeros(len(pieces), np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        who = np.arange(len(pieces))
        sym = self.start[np.frombuffer(b"".join(pieces), np.uint8)]
        while len(who):
            first = np.cumsum(size) - size
            rank = np.full(len(sym), NONE)
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[first + size - 1] = NONE  # the last symbol of a piece has no right neighbour
            low = np.minimum.reduceat(rank, first)
            done = low == NONE
            counts[who[done]] = size[done]
            each = np.repeat(np.arange(len(who)), size)
            hit = np.flatnonzero((rank == low[each]) & (rank != NONE))
            if not len(hit):
                break
            head = np.r_[True, np.diff(hit) != 1]  # in a run of overlapping pairs, every second one merges
            start = np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            keep = ~done[each]
            keep[hit + 1] = False
            size = np.bincount(each[keep], minlength=len(who))[~done]
            sym, who = sym[keep], who[~done]
        return counts

    def merge_long(self, piece: bytes) -> int:
        """The same for one long piece without a break: pairs wait by rank, so that a round looks at its own pairs only.

        Symbols that have gone leave links between their neighbours. A pair that has changed since it was listed no longer has the
        round's rank and is passed over.
        """
        sym = self.start[np.frombuffer(piece, np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def rank_of(at: np.ndarray) -> np.ndarray:
            right = after[at]
            return np.where(right < n, self.ranks(sym[at], sym[np.minimum(right, n - 1)]), NONE)

        def wait(at: np.ndarray) -> None:
            rank = rank_of(at)
            at, rank = at[rank != NONE], rank[rank != NONE]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cut = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else ()
            for x, y in zip(cut, [*cut[1:], len(rank)], strict=True) if len(cut) else ():
                r = int(rank[x])
                if r not in waiting:
                    waiting[r] = []
                    heappush(order, r)
                waiting[r].append(at[x:y])

        wait(np.arange(n))
        left = n
        while order:
            r = heappop(order)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at]]
            at = at[rank_of(at) == r]
            if not len(at):
                continue
            head = np.r_[True, after[at[:-1]] != at[1:]]  # in a run of overlapping pairs, every second one merges
            start = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = after[at]
            sym[at] = self.merged[r]
            alive[gone] = False
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at[inside]]] = at[inside]
            left -= len(at)
            wait(np.unique(np.r_[at, before[at][before[at] >= 0]]))
        return left

    def count(self, texts: list[str]) -> list[int]:
        out, parts = [], []
        for t in texts:
            found = len(self.special.findall(t)) if self.special else 0
            out.append(found)
            parts.append([p for s in (self.special.split(t) if found else (t,)) for p in PRE_TOKEN.findall(s)])
        if len(self.cache) > self.limit:
            self.cache.clear()
        new = set().union(*parts).difference(self.cache)
        raw = {p: p.encode("utf-8", "surrogatepass") for p in new if len(p) * 4 >= LONG}
        self.cache.update({p: self.merge_long(b) for p, b in raw.items() if len(b) >= LONG})
        new = list(new.difference(self.cache))
        for k in range(0, len(new), 200_000):
            some = new[k : k + 200_000]
            self.cache.update(zip(some, self.merge([p.encode("utf-8", "surrogatepass") for p in some]).tolist(), strict=True))
        look = self.cache.__getitem__
        return [n + sum(map(look, p)) for n, p in zip(out, parts, strict=True)]


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The number of tokens of each whole text, as the tokenizers library counts them without added special tokens.

    ``path`` names the vocabulary, the same on every machine. A special token's string inside a text is one token, as by default
    there. Null and empty texts have 0 bytes and 0 tokens. Returns the id, n_bytes, n_tokens, over_limit (more than ``limit``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch, texts in steps(batches, "__text"):
            n = counter.count(texts)
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            cols = [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
