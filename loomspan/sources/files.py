"""Readers and writers: file discovery, JSON lines, CSV, spreadsheets, whole texts, upserts."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.text import normalize_text, present, stable_id

#: File types that are read, and folders that are passed over.
SUFFIXES = ("pdf", "md", "txt", "json", "jsonl", "csv", "xlsx")
SKIPPED = ("__pycache__", "node_modules", ".git", ".venv")

CHUNK = T.StructType([T.StructField(c, T.StringType()) for c in ("chunk_id", "doc_id", "doc_name", "source_type", "title", "text", "index_text", "block_type", "page_label", "source_path", "metadata")])


def source_type(path: Column, deployment: str = "deployment") -> Column:
    """What a file holds, by words in its path."""
    low = F.lower(path)
    return F.when(low.contains(deployment), "deployment").when(low.contains("table") | low.rlike(r"\.(csv|xlsx|jsonl)$"), "table").otherwise("document")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, suffix, source_type) of every readable file below a folder, without reading contents."""
    glob = "*.{" + ",".join(SUFFIXES) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("bytes"))
    skip = "|".join(re.escape(s) for s in SKIPPED)
    files = files.filter(~F.col("path").rlike(f"/({skip})/"))
    return files.withColumns({"suffix": F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)), "source_type": source_type(F.col("path"))})


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Rows of JSON objects. Strict: a line that is no object ends the read with an error; else it is dropped and counted by ``bad_lines``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").json(path).filter("_corrupt_record IS NULL").drop("_corrupt_record")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that hold no JSON object, with their file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line")).filter("line != ''")
    return lines.filter(F.try_parse_json("line").isNull() | ~F.startswith("line", F.lit("{")))


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with a header; a byte order mark before the first name is removed."""
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def sniff_separator(sample: str) -> str:
    """The separator that parts the first lines into most, equally many fields."""
    lines = [x for x in sample.splitlines() if x][:20]
    score = {s: min((x.count(s) for x in lines), default=0) for s in (",", "\t", ";", "|")}
    return max(score, key=lambda s: (score[s], -",\t;|".index(s)))


def query_column(df: DataFrame, names: tuple[str, ...] = ("query", "question", "text", "问题")) -> str:
    """The column that holds questions: one with a usual name, or else the one with the longest texts and fewest numbers."""
    for n in names:
        if hit := next((c for c in df.columns if c.strip().lower() == n), None):
            return hit
    numeric = lambda c: F.avg(F.col(c).cast("string").try_cast("double").isNotNull().cast("double"))
    row = df.agg(*[F.struct(F.coalesce(numeric(c), F.lit(1.0)).alias("num"), F.coalesce(F.avg(F.length(F.col(c).cast("string"))), F.lit(0.0)).alias("len")).alias(f"c{k}") for k, c in enumerate(df.columns)]).first()
    return df.columns[max(range(len(df.columns)), key=lambda k: (row[k]["len"] * (1 - row[k]["num"]), -k))]


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(sheet, row number, cells by column letter) of a workbook; a merged range's value stands in all its cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        target = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet"):
            root = ET.fromstring(z.read("xl/" + target[sheet.get(_REL)].removeprefix("/xl/")))
            cells: dict[tuple[int, str], str] = {}
            for c in root.iter(f"{{{_NS['m']}}}c"):
                col, row = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
                v = c.find("m:v", _NS)
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                cells[int(row), col] = shared[int(text)] if c.get("t") == "s" and text else text
            for m in root.iter(f"{{{_NS['m']}}}mergeCell"):
                (a, lo), (b, hi) = (re.match(r"([A-Z]+)(\d+)", x).groups() for x in m.get("ref").split(":"))
                for row in range(int(lo), int(hi) + 1):
                    for k in range(letters(a), letters(b) + 1):
                        cells[row, name(k)] = cells.get((int(lo), a), "")
            for row in sorted({r for r, _ in cells}):
                yield sheet.get("name"), row, {c: v for (r, c), v in cells.items() if r == row}


def letters(col: str) -> int:
    n = 0
    for c in col:
        n = n * 26 + ord(c) - 64
    return n


def name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_number, cells) of every workbook; a workbook is read by one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(sheet_rows(bytes(content)))
                yield pd.DataFrame({"path": p, "sheet": [r[0] for r in rows], "row_number": [r[1] for r in rows], "cells": [r[2] for r in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sheet string, row_number int, cells map<string,string>")


def with_header(rows: DataFrame) -> DataFrame:
    """Rows of sheets as (path, sheet, row_number, record): the header is the first row with at least the median number of filled
    cells; later rows with under 30 % of that are dropped."""
    filled = F.size(F.filter(F.map_values("cells"), lambda v: F.trim(v) != ""))
    rows = rows.withColumn("__f", filled)
    mid = rows.groupBy("path", "sheet").agg(F.percentile("__f", F.lit(0.5)).alias("__m"))
    rows = rows.join(mid, ["path", "sheet"])
    head = rows.filter(F.col("__f") >= F.col("__m")).groupBy("path", "sheet").agg(F.min_by("cells", "row_number").alias("__names"), F.min("row_number").alias("__h"))
    body = rows.join(head, ["path", "sheet"]).filter((F.col("row_number") > F.col("__h")) & (F.col("__f") >= 0.3 * F.col("__m")))
    pairs = F.filter(F.transform(F.map_keys("cells"), lambda k: F.struct(F.coalesce(F.col("__names")[k], k).alias("k"), F.col("cells")[k].alias("v"))), lambda p: F.trim(p["v"]) != "")
    return body.select("path", "sheet", "row_number", F.map_from_entries(pairs).alias("record"))


def row_chunks(df: DataFrame, fields: list[str], id_cols: list[str], source: str) -> DataFrame:
    """Table rows as chunks: the text lists ``field: value`` of the fields that hold something."""
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{f}: "), present(normalize_text(F.col(f).cast("string")))) for f in fields])
    ids = [F.col(c) for c in id_cols]
    return df.select(stable_id(F.lit(source), *ids).alias("chunk_id"), F.lit(source).alias("doc_id"), F.lit("table").alias("source_type"), lines.alias("text"), F.to_json(F.struct(*fields)).alias("metadata"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the latest version of each key; new rows win ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new")))
    return both.withColumn("__p", place).filter("__p = 1").drop("__p", "__new")


def append_unique(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both tables' rows; an error if a new key is there already, or twice among the new ones."""
    clash = new.groupBy(key).count().filter("count > 1").select(key).unionByName(new.select(key).join(old.select(key), key, "left_semi"))
    if first := clash.limit(1).collect():
        raise ValueError(f"{key} is not unique: {first[0][0]}")
    return old.unionByName(new)


def folded_rows(lines: list[str], columns: tuple[str, ...], wrapped: tuple[str, ...], starts: str = r"\s*\d+\s+\d+\s") -> list[dict[str, str]]:
    """Records of a printed table: fields stand three spaces apart; a line that begins none goes on with the ``wrapped`` fields of the one before, in order."""
    out: list[dict[str, str]] = []
    for line in lines:
        parts = [p for p in re.split(r"\s{3,}", line.strip()) if p]
        if re.match(starts, line) and len(parts) >= len(columns):
            out.append(dict(zip(columns, parts, strict=False)))
        elif out and parts and not re.fullmatch(r"[━─=-]+", line.strip()):
            for c, p in zip(wrapped, parts, strict=False):
                out[-1][c] += p
    return out


def read_printed_tables(spark: SparkSession, path: str, columns: tuple[str, ...], wrapped: tuple[str, ...], starts: str = r"\s*\d+\s+\d+\s") -> DataFrame:
    """(path, row_no, record) of tables that a command printed into text files. Lines fold into the record before, so a file is read in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = folded_rows(text.splitlines(), columns, wrapped, starts)
                cols = [pa.array([p] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array([list(r.items()) for r in rows], pa.map_(pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["path", "row_no", "record"])

    return whole_texts(spark, path).mapInArrow(run, "path string, row_no int, record map<string,string>")


def write_lines(df: DataFrame, path: str, how: str = "json", one_file: bool = False, mode: str = "errorifexists") -> None:
    """JSON lines or CSV with a header. ``one_file`` is for reports of a few rows. The writer commits whole: a failed job leaves no result."""
    out = df.coalesce(1) if one_file else df
    (out.write.mode(mode).option("header", True).csv if how == "csv" else out.write.mode(mode).json)(path)


def write_vectors(vectors: DataFrame, path: str, models: tuple[str, ...], id_col: str) -> None:
    """A row for each vector and model, under ids that name the model, in a folder for each model, so that a search reads one folder."""
    named = vectors.withColumn("embedding_model", F.explode(F.array(*map(F.lit, models))))
    named.withColumn(id_col, F.concat_ws("_EMB_", F.col(id_col).cast("string"), "embedding_model")).write.mode("append").partitionBy("embedding_model").parquet(path)


def kept_table(df: DataFrame, root: str, key_cols: list[str], name: str, make) -> DataFrame:
    """``make(df)``, written once below ``root`` for what the key columns hold; the same content is read back instead of made again.

    The folder is named by an order-free digest over all rows: their count and the sums of two hashes.
    """
    cols = [F.col(c) for c in key_cols]
    parts = df.agg(F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.sum(F.hash(*cols).cast("long"))).first()
    spark = df.sparkSession
    path = f"{root}/{name}-" + "-".join(str(p) for p in parts).replace("--", "-m")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        make(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def manifest(spark: SparkSession, root: str, exclude: str = "") -> DataFrame:
    """(path, bytes, sha256) of every file below a folder; ``exclude`` is a pattern of paths left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.filter(~F.col("path").rlike(exclude)) if exclude else files
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, root: str, expected: dict[str, str]) -> DataFrame:
    """The manifest of a folder, after its files' digests were found as expected; else an error names the first that differs."""
    found = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in manifest(spark, root).collect()}  # a row for each source file
    for name, digest in expected.items():
        if found.get(name) != digest:
            raise ValueError(f"{name} is missing or has another content")
    return manifest(spark, root)
