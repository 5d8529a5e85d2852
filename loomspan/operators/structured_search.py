"""Answers from table rows: rows ranked for a question, lists of models, and values of a named field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.questions import Question, list_score, row_score


def ranked_rows(rows: DataFrame, q: Question, fields: Mapping[str, Column], source: str, id_col: str, date: Column, k: int) -> DataFrame:
    """The k best rows for a question: by score, rows in use before others, newest first, then by id."""
    fields = {"full": F.concat_ws("\n", *[c.cast("string") for c in fields.values()]), **fields}
    scored = rows.withColumn("score", F.round(row_score(q, fields, source), 6)).filter("score > 0")
    in_use = (F.coalesce(fields["count"].cast("string"), F.lit("")) == "1") if "count" in fields else F.lit(False)
    return scored.orderBy(F.desc("score"), F.desc(in_use), date.desc_nulls_last(), id_col).limit(k)


def model_list(rows: DataFrame, q: Question, fields: Mapping[str, Column], source: str, id_col: str, same: Sequence[Column], k: int) -> DataFrame:
    """For a question that wants a list: the rows that fit, one for each value of ``same`` (the best one), best first, at most ``k``, with
    ``found``, how many there are in all. Empty if no list is wanted."""
    scored = rows.withColumn("score", F.round(list_score(q, fields, source), 6)).filter(F.col("score") > 0 if "list" in q.wishes else F.lit(False))
    best = scored.withColumns({f"__s{i}": F.coalesce(c.cast("string"), F.lit("")) for i, c in enumerate(same)})
    keys = [f"__s{i}" for i in range(len(same))]
    first = best.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), id_col))).filter("__r = 1").drop("__r", *keys)
    found = first.agg(F.count("*").alias("found"))
    return first.orderBy(F.desc("score"), id_col).limit(k).join(F.broadcast(found))  # one row


def field_lookup(rows: DataFrame, q: Question, fields: Mapping[str, Column], source: str, wanted: Column, id_col: str, k: int = 20) -> DataFrame:
    """(value, score, support): the values that the wanted field has in rows as good as the best one, each once with how many rows have it.

    Several values mean that the question does not tell them apart.
    """
    fields = {"full": F.concat_ws("\n", *[c.cast("string") for c in fields.values()]), **fields}
    text = F.trim(F.coalesce(wanted.cast("string"), F.lit("")))
    scored = rows.select(F.round(row_score(q, fields, source), 6).alias("score"), text.alias("value")).filter((F.col("score") > 0) & (F.col("value") != ""))
    per = scored.groupBy("score", "value").agg(F.count("*").alias("support"))
    best = per.agg(F.max("score").alias("__best"))
    return per.join(F.broadcast(best), F.col("score") == F.col("__best")).drop("__best").orderBy(F.desc("support"), "value").limit(k)
