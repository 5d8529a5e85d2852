"""Which tokens of a training conversation carry its supervision: roles as spans of characters, aligned with spans of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def spans_of(roles: list[str], texts: list[str], supervised: str) -> tuple[str, list[tuple[int, int]], int]:
    """A conversation as one text, the character spans that are supervised (a turn's words and its end mark, without the line end behind), and where the last turn's words begin."""
    parts, spans, at, last = [], [], 0, 0
    for role, said in zip(roles, texts, strict=True):
        head = f"{START}{role}\n"
        begin = at + len(head)
        end = begin + len(said) + len(END)
        if role == supervised:
            spans.append((begin, end))
        parts += [head, said, END, "\n"]
        at, last = end + 1, begin
    return "".join(parts), spans, last


def inside(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie wholly in one of the spans, which are in order. Tokens of no width do not."""
    if not spans:
        return np.zeros(len(starts), bool)
    lo, hi = np.array(spans).T
    k = np.searchsorted(lo, starts, "right") - 1
    return (k >= 0) & (ends <= hi[np.maximum(k, 0)]) & (ends > starts)


def supervision_audit(turns: DataFrame, case: str, order: str, role: str, text: str, tokenizer_path: str, max_tokens: int, supervised: str = "assistant") -> DataFrame:
    """A row for each case: tokens in all, supervised ones and their share, supervised spans, tokens before the last turn's words, whether it is
    within the limit, whether an end mark is supervised and all supervised words are covered, and ``ok``, if there is just one span and all hold.

    A span covers a word if its tokens stand wholly inside, so a tokenizer that joins signs across its edge shows as a loss. Null texts
    count as empty, null roles as no role. A case's turns are gathered as one text, as a trainer would.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        for batch in batches:
            rows = []
            for said in batch.column("__turns").to_pylist():
                whole, spans, last = spans_of([x["r"] for x in said], [x["t"] for x in said], supervised)
                offsets = np.array(tokenizer.encode(whole, add_special_tokens=False).offsets or np.zeros((0, 2)), np.int64)
                starts, ends = offsets[:, 0], offsets[:, 1]
                mask = inside(starts, ends, spans)
                found = int((mask & ~np.r_[False, mask[:-1]]).sum())
                covered = np.zeros(len(whole) + 1, np.int64)
                np.add.at(covered, starts[mask], 1)
                np.add.at(covered, ends[mask], -1)
                held = np.r_[0, np.cumsum(np.cumsum(covered) > 0)]
                rows.append((len(mask), int(mask.sum()), found, int((starts < last).sum()), all(held[b] - held[a] == b - a for a, b in spans), bool(spans)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            n, own, found, prompt, whole_words, any_ = cols
            share = [o / t if t else 0.0 for o, t in zip(own, n, strict=True)]
            within = [t <= max_tokens for t in n]
            ok = [f == 1 and w and c and a for f, w, c, a in zip(found, within, whole_words, any_, strict=True)]
            arrays = [pa.array(n, pa.int64()), pa.array(own, pa.int64()), pa.array(share, pa.float64()), pa.array(found, pa.int64()), pa.array(prompt, pa.int64()), pa.array(within, pa.bool_()), pa.array([c and a for c, a in zip(whole_words, any_, strict=True)], pa.bool_()), pa.array(ok, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [case, "tokens", "supervised", "share", "spans", "prompt_tokens", "within", "covered", "ok"])

    said = F.struct(F.col(order).alias("o"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("t"))
    cases = turns.groupBy(case).agg(F.array_sort(F.collect_list(said)).alias("__turns"))
    kind = turns.schema[case].dataType.simpleString()
    return cases.mapInArrow(run, f"`{case}` {kind}, tokens long, supervised long, share double, spans long, prompt_tokens long, within boolean, covered boolean, ok boolean")


def audit_summary(audit: DataFrame, *by: str) -> DataFrame:
    """Counts of cases, of those that fail each rule, and token percentiles, for each group."""
    bad = lambda c: F.count_if(~c)
    cuts = [F.percentile("tokens", F.lit(p)).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"))]
    one: Column = F.col("spans") == 1
    return audit.groupBy(*by).agg(F.count("*").alias("cases"), bad(F.col("within")).alias("too_long"), bad(one).alias("not_one_span"), bad(F.col("covered")).alias("lost_words"), bad(F.col("ok")).alias("failed"), F.sum("supervised").alias("supervised"), F.max("tokens").alias("most"), *cuts)
