"""What surrounds an answer: records read from labelled lines, summaries of the fields asked for, values the answer left out, references of its evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Where a line ends, what counts as an identifier or number of a value, the words before and after what is added to an answer.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
VALUE_TOKEN = r"[A-Za-z_][A-Za-z0-9_./+-]{2,}|[0-9]+(?:\.[0-9]+)?%?"
#: White space as Unicode has it.
WHITE = "\t\n\u000b\u000c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Documents whose records a task makes at once.
SLICE = 500
ADDED = ("；补充关键指标/原始标识：", "；", "。")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _records(lines: Iterator[tuple[str, str]], group: str, name: str, marks: Sequence[str]) -> Iterator[dict[str, str]]:
    """The records of one document's (field, value) lines, also those without a value."""
    now: dict[str, str] = {}
    marked = False  # whether a mark came since the last line of the group field
    for field, value in lines:
        if field == group:
            opens, marked = marked or group in marks, False
            if opens:
                yield now
                now = {}
        else:
            marked = marked or field in marks
            if field == name and now.get(name):
                yield now
                now = {group: now[group]} if group in now else {}
        now[field] = value
    yield now


def labelled_records(docs: DataFrame, id_col: str, text: Column, labels: Mapping[str, str], group: str, name: str, marks: Sequence[str]) -> DataFrame:
    """(id, record, field columns): records told by lines ``label: value``; ``labels`` maps fields to their labels, other lines say nothing.

    A line of the ``group`` field begins a record if any of the ``marks`` (``name`` among them) came since the line of that field
    before; a line of ``name`` begins one if the name of the record so far is not empty, and its record keeps the group. A later value
    of a field replaces an earlier one. Records without a value are left out; a missing value is null, null and empty texts have no
    record. A document is one row, so its lines are read where it lies, in order: nothing is sorted or shuffled, and a task holds some
    ``SLICE`` documents at a time. ``id_col`` names documents.
    """
    field, names = {label: f for f, label in labels.items()}, list(labels)

    def said(document: str) -> Iterator[tuple[str, str]]:
        for line in re.split(LINE_END, document):
            label, colon, value = line.partition(":")
            if colon and (f := field.get(label.strip(WHITE))):
                yield f, value.strip(WHITE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [(k, n, *(r.get(f) or None for f in names)) for k, x in enumerate(part.column(1).to_pylist()) if x for n, r in enumerate(_records(said(x), group, name, marks)) if any(r.values())]
                columns = list(zip(*rows, strict=True)) or [()] * (2 + len(names))
                ids = part.column(0).take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1], pa.int32()), *(pa.array(c, pa.string()) for c in columns[2:])], [id_col, "record", *names])

    made = [StructField(id_col, docs.schema[id_col].dataType), StructField("record", IntegerType()), *(StructField(f, StringType()) for f in names)]
    return docs.select(id_col, text.alias("__t")).mapInArrow(run, StructType(made))


def requested_fields(question: str, aliases: Mapping[str, Sequence[str]], asks: Sequence[str] = (), default: Sequence[str] = ()) -> list[str]:
    """The fields that a question names by one of their aliases; if it names none but asks for a value, the default ones."""
    low = (question or "").lower()
    named = [f for f, words in aliases.items() if any(w.lower() in low for w in words)]
    return named or ([*default] if any(a in low for a in asks) else [])


def field_summaries(records: DataFrame, id_col: str, fields: Sequence[str], labels: Mapping[str, str], most: int = 12, longest: int = 180, cuts: Mapping[str, int] | None = None) -> DataFrame:
    """(id, summary): a line ``- label=value | ...`` for each of the first ``most`` records of a document that have one of the fields. Longer values are cut and end in three dots."""

    def part(f: str) -> Column:
        n = (cuts or {}).get(f, longest)
        v = F.when(F.length(f) > n, F.concat(F.substring(f, 1, n - 3), F.lit("..."))).otherwise(F.col(f))
        return F.concat(F.lit(f"{labels.get(f, f)}="), v)

    rows = records.select(id_col, "record", F.concat_ws(" | ", *map(part, fields)).alias("line")).filter("line != ''")
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("record"))
    kept = rows.withColumn("__p", place).filter(F.col("__p") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("__p", "line"))), lambda x: F.concat(F.lit("- "), x["line"]))
    return kept.groupBy(id_col).agg(F.array_join(lines, "\n").alias("summary"))


def completed_answers(answers: DataFrame, values: DataFrame, key: str, text: str, applies: Column, most_evidence: int = 8, most: int = 6) -> DataFrame:
    """(key, missing, text): answers with the values of their evidence that they do not mention written behind them.

    ``values`` has (key, place, primary, number, value): the place of the evidence from 1, whether it is primary, and the value's number
    in it. Where an answer has primary evidence, only that counts; the first ``most_evidence`` pieces are looked at. A value is mentioned
    if the answer, without white space and case, holds any of its identifiers or numbers of two characters or more; a value without any
    is passed over. The first ``most`` are added, each with its evidence's place. Where ``applies`` does not hold, nothing is added.
    """
    tokens = F.filter(F.regexp_extract_all("value", F.lit(VALUE_TOKEN), F.lit(0)), lambda t: F.length(t) >= 2)
    rows = values.select(key, "place", F.coalesce("primary", F.lit(False)).alias("p"), "number", "value", tokens.alias("t")).filter("value IS NOT NULL")
    rows = rows.withColumn("any", F.max("p").over(Window.partitionBy(key))).filter(F.col("p") | ~F.col("any"))
    rows = rows.withColumn("r", F.dense_rank().over(Window.partitionBy(key).orderBy("place"))).filter((F.col("r") <= most_evidence) & (F.size("t") > 0))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "number", "value", "t"))).alias("vs"))  # values of a few pieces
    whole = F.regexp_replace(F.lower(text), r"(?U)\s+", "")
    out = answers.select(key, F.coalesce(text, F.lit("")).alias(text), applies.alias("ok")).join(lists, key, "left").withColumn("w", whole)
    lacking = F.filter("vs", lambda v: ~F.exists(v["t"], lambda x: F.contains(F.col("w"), F.lower(x))))
    added = F.array_distinct(F.transform(F.slice(lacking, 1, most), lambda v: F.concat(v["value"], F.lit("["), v["place"].cast("string"), F.lit("]"))))
    out = out.withColumn("missing", F.when(F.coalesce("ok", F.lit(False)) & F.col("vs").isNotNull(), added).otherwise(F.array().cast("array<string>")))
    core = _strip(F.col(text))
    longer = F.concat(F.regexp_replace(core, f"{ADDED[2]}$", ""), F.lit(ADDED[0]), F.array_join("missing", ADDED[1]), F.lit(ADDED[2]))
    return out.select(key, "missing", F.when(F.size("missing") > 0, longer).otherwise(F.col(text)).alias(text))


def _base(path: Column) -> Column:
    clean = F.regexp_replace(path, "/+$", "")
    return F.regexp_extract(clean, "[^/]*$", 0)


def references(hits: DataFrame, key: str, place: str, name: str, mapping: DataFrame, file: str, url: str, order: str) -> DataFrame:
    """(key, place, doc_name, url): the documents behind a list of hits, each once, at its first place.

    Names are compared without case, folders and the kind of slash. A hit's whole path is looked up first, then its last part; of
    mapping rows with the same name the last by ``order`` counts. Hits without a name are left out, unknown documents have no url. Hits
    are reduced to first places before they meet the mapping.
    """
    path = lambda c: F.replace(_strip(F.col(c)), F.lit("\\"), F.lit("/"))
    rows = hits.select(key, place, path(name).alias("__p")).filter("__p != ''")
    shown = F.coalesce(F.nullif(_base(F.col("__p")), F.lit("")), F.col("__p"))
    first = rows.groupBy(key, F.lower(shown).alias("__b")).agg(F.min(F.struct(F.col(place), shown.alias("n"), F.lower("__p").alias("f"))).alias("x")).select(key, "__b", f"x.{place}", F.col("x.n").alias("doc_name"), F.col("x.f").alias("__f"))
    known = mapping.select(F.lower(path(file)).alias("__k"), url, order)
    known = known.select(F.explode(F.array_distinct(F.array("__k", _base(F.col("__k"))))).alias("__k"), F.struct(F.col(url).alias("u")).alias("u"), order).filter("__k != ''")
    known = known.groupBy("__k").agg(F.max_by("u", order).alias("u"))
    side = lambda on, out: known.select(F.col("__k").alias(on), F.col("u.u").alias(out))
    out = first.join(side("__f", "__u1"), "__f", "left").join(side("__b", "__u2"), "__b", "left")
    return out.select(key, place, "doc_name", F.coalesce("__u1", "__u2").alias("url"))
