"""Ordered blocks of documents: title runs, packing, merging of small parts, continuation over pages, reassembly, tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def title_headers(lines: DataFrame, doc: str, order: str, title: Column, text: str) -> DataFrame:
    """Lines with the header they stand under.

    Neighbouring titles form a run. A run of two gives its first title as header, a longer one all of them, a single title
    none of its own; other lines have the header before them.
    """
    w = Window.partitionBy(doc).orderBy(order)
    rows = lines.withColumn("__t", title)
    rows = rows.withColumn("__new", (~F.col("__t").eqNullSafe(F.lag("__t").over(w))).cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.filter("__t").groupBy(doc, "__run").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("ts"))
    header = F.when(F.size("ts") == 2, F.col("ts")[0]["t"]).when(F.size("ts") > 2, F.array_join(F.transform("ts", lambda x: x["t"]), "\n"))
    rows = rows.join(runs.select(doc, "__run", header.alias("__h")), [doc, "__run"], "left")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("header", F.last("__h", ignorenulls=True).over(upto)).drop("__t", "__new", "__run", "__h")


def merge_continued(blocks: DataFrame, doc: str, order: str, page: str, text: str, title: Column, most: int = 128) -> DataFrame:
    """Blocks joined over a page break: neighbours on consecutive pages, none a title, one shorter than ``most``, the first without a full stop.

    Chains over several pages become one block: (doc, first, page, parts, text).
    """
    w = Window.partitionBy(doc).orderBy(order)
    rows = blocks.withColumns({"__t": F.coalesce(title, F.lit(False)), "__n": F.length(text)})
    before = lambda c: F.lag(c).over(w)
    ends = F.rtrim(before(F.col(text))).rlike(r"[。.]$")
    joins = ~F.col("__t") & ~before("__t") & (before(F.col(page)) + 1 == F.col(page)) & ((before("__n") < most) | (F.col("__n") < most)) & ~ends
    rows = rows.withColumn("__new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    rows = rows.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    out = rows.groupBy(doc, "__g").agg(F.min(order).alias("first"), F.min(page).alias("page"), F.count("*").alias("parts"), parts.alias("__p"))
    return out.select(doc, "first", "page", "parts", F.array_join(F.transform("__p", lambda x: x["t"]), "\n").alias("text"))


def packed(parts: list[str], most: int) -> list[int]:
    """The group of each part when neighbours are packed up to ``most`` characters; a longer part is a group of its own."""
    out, group, size = [], 0, 0
    for p in parts:
        if size and size + len(p) > most:
            group, size = group + 1, 0
        out.append(group)
        size += len(p)
    return out


def grown(parts: list[str], least: int) -> list[int]:
    """The group of each part when a part below ``least`` characters goes with what follows it, the last one with what is before."""
    out, group, size = [], 0, 0
    for p in parts:
        out.append(group)
        size += len(p) + (2 if size else 0)
        if size >= least:
            group, size = group + 1, 0
    if group:  # the last group is short, or has nothing yet
        out = [min(g, group - 1) for g in out]
    return out


def grouped_parts(docs: DataFrame, id_col: str, parts: Column, rule: Callable[[list[str]], list[int]], sep: str = "\n") -> DataFrame:
    """(id, group, n_parts, text): neighbouring parts of each document joined by a rule that depends on the groups before.

    The rule sees the parts of one document; documents stay where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos, sizes, texts = [], [], [], []
            for i, ps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: dict[int, list[str]] = {}
                for g, p in zip(rule(ps or []), ps or [], strict=True):
                    held.setdefault(g, []).append(p)
                for g, some in held.items():
                    ids.append(i)
                    nos.append(g)
                    sizes.append(len(some))
                    texts.append(sep.join(some))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(nos, pa.int32()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string())], [id_col, "group", "n_parts", "text"])

    return docs.select(id_col, parts.alias("__p")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, group int, n_parts int, text string")


def merge_short_neighbours(lines: DataFrame, doc: str, order: str, text: str, least: int) -> DataFrame:
    """Runs of neighbouring lines below ``least`` characters become one line with each distinct text once, in order; others stay."""
    w = Window.partitionBy(doc).orderBy(order)
    rows = lines.withColumn("__s", F.length(text) < least)
    rows = rows.withColumn("__new", (~(F.col("__s") & F.coalesce(F.lag("__s").over(w), F.lit(False)))).cast("int"))
    rows = rows.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    out = rows.groupBy(doc, "__g").agg(F.min(order).alias("first"), F.count("*").alias("n"), parts.alias("__p"))
    return out.select(doc, "first", "n", F.array_join(F.array_distinct(F.transform("__p", lambda x: x["t"])), "\n").alias("text"))


def alternates(values: Column, fixed: Column, least: int = 5) -> Column:
    """Whether ``fixed`` follows another value ``least`` times or more."""
    n = F.size(values)
    pairs = F.zip_with(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.slice(values, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (a != fixed) & (b == fixed))
    return F.when(n > 1, F.size(F.filter(pairs, lambda x: x)) >= least).otherwise(False)


def whole_documents(chunks: DataFrame, found: DataFrame, doc: str, order: list[str], page: str, kind: str, title: str, text: str, evidence: str) -> DataFrame:
    """The documents of found evidence, put together from all their chunks in order.

    A text that repeats counts once, where it stands first; each part is headed by its page, kind and title. Returns doc,
    n_chunks, content, evidence_ids.
    """
    wanted = found.groupBy(doc).agg(F.array_sort(F.collect_set(evidence)).alias("evidence_ids"))
    rows = chunks.join(wanted.select(doc), doc, "left_semi").withColumn("__x", F.trim(text))
    place = F.row_number().over(Window.partitionBy(doc, F.md5("__x")).orderBy(*order))
    head = F.concat(F.lit("[page="), F.coalesce(F.nullif(F.col(page).cast("string"), F.lit("")), F.lit("-")), F.lit(" block_type="), F.col(kind), F.lit(" title="), F.coalesce(title, kind), F.lit("]\n"))
    rows = rows.withColumn("__k", place)
    part = F.when((F.col("__k") == 1) & (F.col("__x") != ""), F.struct(*[F.col(c) for c in order], F.concat(head, "__x").alias("__t")))
    out = rows.groupBy(doc).agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(part)).alias("__p")).filter(F.size("__p") > 0)
    return out.join(wanted, doc).select(doc, "n_chunks", F.array_join(F.transform("__p", lambda x: x["__t"]), "\n\n").alias("content"), "evidence_ids")


class _Tables(HTMLParser):
    """Rows of cells of the tables in a piece of HTML."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def tables_as_markdown(page: str) -> list[str]:
    """Each table of a page in Markdown; its first row is the header."""
    p = _Tables()
    p.feed(page or "")
    out = []
    for rows in p.tables:
        rows = [r for r in rows if r]
        if rows:
            line = lambda cells: "|" + "|".join(cells) + "|"
            out.append("\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])]))
    return out


def page_tables(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, table_no, markdown) of every table on the pages. A closing match in the parser is sequential, so pages go through Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos, texts = [], [], []
            for i, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, m in enumerate(tables_as_markdown(page)):
                    ids.append(i)
                    nos.append(k)
                    texts.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(nos, pa.int32()), pa.array(texts, pa.string())], [id_col, "table_no", "markdown"])

    return pages.filter(F.col(html).contains("<table")).select(id_col, html).mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, table_no int, markdown string")
