"""Long texts cut into overlapping chunks at natural breaks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import stable_id

#: Where a chunk is best cut, in order of preference.
BREAKS = ("\n\n", "\n", "。", "；", ". ", ", ", "，")


def cuts(text: str, size: int = 900, overlap: int = 120) -> Iterator[str]:
    """Chunks of at most ``size`` characters. A cut follows the last of the most preferred break that leaves enough text before it;
    the next chunk begins ``overlap`` characters earlier."""
    text = (text or "").strip()
    least, start = max(120, int(size * 0.45)), 0
    while start < len(text):
        stop = min(len(text), start + size)
        if len(text) > size:
            places = ((text.rfind(b, start, stop), len(b)) for b in BREAKS)
            stop = next((p + n for p, n in places if p - start >= least), stop)
        if piece := text[start:stop].strip():
            yield piece
        if stop >= len(text):
            return
        start = max(stop - overlap, start + 1)


#: Where sections begin in Chinese legal and technical texts, sentence ends and clause ends.
SECTION = re.compile(r"\n\n|(?=\n第[一二三四五六七八九十百千万零〇]+[章节条款项])|[一二三四五六七八九十百千万零〇]+、|\n（[一二三四五六七八九十百千万零〇]+）")
SENTENCE = re.compile(r"[^,.;。？！]+[,.;。？！]?|[,.;。？！]")
CLAUSE = re.compile(r"[^,，、;；]+[,，、;；]?|[,，、;；]")


def sections(text: str, least: int = 128, most: int = 300) -> Iterator[str]:
    """Parts between blank lines, list numbers, chapters and numbered parentheses. Parts above ``most`` characters are cut at
    spaces; parts below ``least`` join the one before."""
    held = None
    for part in SECTION.split(text or ""):
        while part:
            cut = len(part)
            if cut > most:
                cut = part.rfind(" ", 1, most)
                cut = most if cut < 0 else cut
            piece, part = part[:cut], part[cut:].strip()
            if held is not None and len(piece) < least:
                held += piece
            else:
                if held is not None:
                    yield held
                held = piece
    if held:
        yield held


def sentence_chunks(text: str, size: int = 200, overlap: int = 40, length: Callable[[str], int] = len) -> Iterator[str]:
    """Chunks of whole sentences, of at most ``size`` by ``length``; a longer sentence is cut into clauses, a longer clause into characters.

    A chunk begins with the last sentences of the one before, up to ``overlap``.
    """

    def pieces(t: str, level: int = 0) -> Iterator[str]:
        if length(t) <= size:
            yield t
        elif level == 3:
            raise ValueError("a single character is longer than a chunk")
        else:
            for p in (t.split("\n\n\n"), SENTENCE.findall(t), CLAUSE.findall(t))[level] if level < 2 else list(t):
                yield from pieces(p, level + 1)

    held: list[str] = []
    fresh = False
    for p in pieces(text or ""):
        if fresh and sum(map(length, held)) + length(p) > size:
            if chunk := "".join(held).strip():
                yield chunk
            keep, room = len(held), overlap
            while keep and length(held[keep - 1]) <= room:
                keep -= 1
                room -= length(held[keep])
            held, fresh = held[keep:], False
            while held and sum(map(length, held)) + length(p) > size:
                held.pop(0)
        held.append(p)
        fresh = True
    if fresh and (chunk := "".join(held).strip()):
        yield chunk


def ahead(text: str, most: int = 1000, look: int = 128) -> Iterator[str]:
    """Cuts of about ``most`` characters, each put off to the next sentence end within ``look`` characters."""
    text, start = text or "", 0
    while start < len(text):
        stop = start + most
        if stop < len(text):
            m = re.search(r"[。！？.!?\n]", text[stop - 1 : stop + look])
            stop = stop + m.start() if m else stop
        if piece := text[start:stop].strip():
            yield piece
        start = stop


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 900, overlap: int = 120, cut: Callable[[str], Iterator[str]] | None = None, most_rows: int = 2000) -> DataFrame:
    """(id, chunk_no, chunk_id, text). The cut depends on the one before, so it is a function over Arrow batches; ids are columns.
    ``cut`` is the rule (``cuts`` with size and overlap if none is given). A task opens one text at a time and gives out ``most_rows`` chunks at a time."""
    rule = cut or (lambda t: cuts(t, size, overlap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = ((i.as_py(), k, piece) for i, t in zip(batch.column(0), batch.column(1), strict=True) for k, piece in enumerate(rule(t.as_py())))
            while part := [*islice(made, most_rows)]:
                ids, numbers, texts = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], [id_col, "chunk_no", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, chunk_no int, text string")
    return made.withColumn("chunk_id", stable_id(F.col(id_col), F.col("chunk_no"), F.col("text")))


def nested_chunks(docs: DataFrame, id_col: str, text_col: str, big: int = 900, small: int = 200) -> DataFrame:
    """Small chunks for search with the big chunk around each: (chunk_id, text, parent_id, index_text)."""
    parents = chunks(docs, id_col, text_col, big, 0).select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("index_text"))
    inner = chunks(parents, "parent_id", "index_text", cut=lambda t: sentence_chunks(t, small, 0))
    return inner.select("chunk_id", "text", "parent_id").join(parents, "parent_id").select("chunk_id", "text", "parent_id", "index_text")
