"""Records and summaries from labelled lines, completed answers, references; orders stand for documents and answers, their lines for records and hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import answers as A
from loomspan.plans.base import Registry

R = Registry()

_LABELS = {"family": "Family", "name": "Name", "size": "Size", "status": "Status"}
_ORDER = ["l_linenumber", "l_partkey", "l_extendedprice"]


def labelled_texts(t):
    """A text for each order: its lines as records, the family told only where it changes, between lines that say nothing."""
    line = lambda label, c: F.concat(F.lit(f" {label} : "), c.cast("string"))
    lines = F.array_sort(F.collect_list(F.struct(*_ORDER, "l_returnflag", "l_quantity", "l_linestatus")))  # of one order

    def said(x, was):
        parts = [F.when(F.coalesce(was != x["l_returnflag"], F.lit(True)), line("Family", x["l_returnflag"])), line("Name", x["l_partkey"]), F.lit("Note: none"), line("Size", x["l_quantity"].cast("int")), F.when(x["l_linestatus"] == "F", line("Status", x["l_linestatus"])), F.lit("--")]
        return F.concat_ws("\n", *parts)

    text = F.array_join(F.transform("ls", lambda x, k: said(x, F.get("ls", k - 1)["l_returnflag"])), "\r\n")
    return t("lineitem").groupBy("l_orderkey").agg(lines.alias("ls")).select("l_orderkey", text.alias("text"))


def records(t):
    return A.labelled_records(labelled_texts(t), "l_orderkey", F.col("text"), _LABELS, "family", "name", ["name", "size"])


@R.add("labelled_records", """
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1)::INT AS record, l_returnflag AS family, l_partkey::VARCHAR AS name, (l_quantity::INT)::VARCHAR AS size, CASE WHEN l_linestatus = 'F' THEN 'F' END AS status FROM lineitem""")
def labelled_records(t):
    return records(t)


@R.add("field_summaries", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS p FROM lineitem)
SELECT l_orderkey, string_agg('- Family=' || l_returnflag || ' | Name=' || l_partkey || CASE WHEN l_linestatus = 'F' THEN ' | Status=F' ELSE '' END, chr(10) ORDER BY p) AS summary FROM l WHERE p <= 4 GROUP BY 1""")
def field_summaries(t):
    fields = A.requested_fields("Which status has it?", {"size": ["size", "how large"], "status": ["status"]})
    return A.field_summaries(records(t), "l_orderkey", ["family", "name", *fields], _LABELS, most=4)


@R.add("completed_answers", """
WITH a AS (SELECT o_orderkey, 'Order of ' || o_custkey || ' items ' || coalesce(string_agg('p' || l_partkey, ', ' ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber <= 2), '') || '.' AS x, any_value(o_orderpriority) < '4' AS ok FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey),
v AS (SELECT l_orderkey AS o_orderkey, l_linenumber AS place, l_returnflag = 'R' AS p, l_partkey AS number, 'part p' || l_partkey AS value, CASE WHEN l_partkey > 9 THEN 'p' || l_partkey ELSE 'part' END AS t, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS h FROM lineitem),
r AS (SELECT *, dense_rank() OVER (PARTITION BY o_orderkey ORDER BY place) AS r FROM v WHERE p OR NOT h), k AS (SELECT r.*, row_number() OVER (PARTITION BY o_orderkey ORDER BY place, number) AS q FROM r JOIN a USING (o_orderkey) WHERE r <= 8 AND ok AND NOT contains(replace(lower(x), ' ', ''), t) AND NOT contains(replace(lower(x), ' ', ''), 'part')),
d AS (SELECT o_orderkey, place, number, value, min(q) AS q FROM k WHERE q <= 6 GROUP BY ALL), m AS (SELECT o_orderkey, string_agg(value || '[' || place || ']', '；' ORDER BY q) AS m FROM d GROUP BY 1)
SELECT o_orderkey, coalesce(m, '') AS missing, CASE WHEN m IS NULL THEN x ELSE x || '；补充关键指标/原始标识：' || m || '。' END AS answer FROM a LEFT JOIN m USING (o_orderkey)""")
def completed_answers(t):
    li = t("lineitem")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") <= 2, F.struct("l_linenumber", "l_partkey")))), lambda x: F.concat(F.lit("p"), x["l_partkey"].cast("string"))), ", ")
    a = t("orders").join(li.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left").groupBy("o_orderkey", "o_custkey", "o_orderpriority").agg(told.alias("x"))
    a = a.withColumn("answer", F.concat(F.lit("Order of "), F.col("o_custkey").cast("string"), F.lit(" items "), F.col("x"), F.lit(".")))
    v = li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("place"), (F.col("l_returnflag") == "R").alias("primary"), F.col("l_partkey").alias("number"), F.concat(F.lit("part p"), F.col("l_partkey").cast("string")).alias("value"))
    return A.completed_answers(a, v, "o_orderkey", "answer", F.col("o_orderpriority") < "4").withColumn("missing", F.array_join("missing", "；"))


@R.add("evidence_references", """
WITH h AS (SELECT l_orderkey, l_linenumber AS place, 'S' || (l_suppkey % 40) || '.pdf' AS n, lower(CASE l_returnflag WHEN 'A' THEN 'area/a/' WHEN 'N' THEN 'area/n/' ELSE '' END || 's' || (l_suppkey % 40) || '.pdf') AS f FROM lineitem),
i AS (SELECT l_orderkey, n, min((place, f)) AS x FROM h GROUP BY 1, 2), s AS (SELECT 's' || (s_suppkey % 50) || '.pdf' AS b, CASE WHEN s_suppkey % 2 = 0 THEN 'area/a/' ELSE '' END || 's' || (s_suppkey % 50) || '.pdf' AS f, CASE WHEN s_suppkey % 5 <> 0 THEN 'u' || s_suppkey END AS u, s_suppkey AS o FROM supplier),
k AS (SELECT k, arg_max({'u': u}, o).u AS u FROM (SELECT b AS k, u, o FROM s UNION SELECT f, u, o FROM s) GROUP BY 1)
SELECT l_orderkey, x[1] AS place, n AS doc_name, coalesce(a.u, b.u) AS url FROM (SELECT l_orderkey, n, [x[1]::VARCHAR, x[2]] AS y, x FROM i) z LEFT JOIN k a ON a.k = y[2] LEFT JOIN k b ON b.k = lower(n)""")
def evidence_references(t):
    folder = F.when(F.col("l_returnflag") == "A", "Area\\a\\").when(F.col("l_returnflag") == "N", " AREA/n/").otherwise("")
    h = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("place"), F.concat(folder, F.lit("S"), (F.col("l_suppkey") % 40).cast("string"), F.lit(".pdf")).alias("name"))
    m = t("supplier").select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "area/A/").otherwise(""), F.lit("s"), (F.col("s_suppkey") % 50).cast("string"), F.lit(".PDF")).alias("file"), F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("u"), F.col("s_suppkey").cast("string"))).alias("url"), "s_suppkey")
    return A.references(h, "l_orderkey", "place", "name", m, "file", "url", "s_suppkey")
