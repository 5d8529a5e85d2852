"""Event logs: trajectories, neighbours, recent events, joins with a ledger; islands and forward fill over ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trajectories(events: DataFrame, session: str, order: list[str], action: str) -> DataFrame:
    """How often each sequence of actions occurs as a whole session."""
    parts = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col(action).alias("__a"))))
    one = events.groupBy(session).agg(F.array_join(F.transform(parts, lambda x: x["__a"]), " -> ").alias("sequence"))
    return one.groupBy("sequence").agg(F.count("*").alias("n"))


def adjacent_repeats(events: DataFrame, session: str, order: list[str], action: str, classes: dict[str, str] | None = None) -> DataFrame:
    """Sessions with the number of steps whose action is of the same class as the one before."""
    kind = F.col(action)
    for name, cls in (classes or {}).items():
        kind = F.when(F.col(action) == name, cls).otherwise(kind)
    w = Window.partitionBy(session).orderBy(*order)
    rows = events.withColumn("__c", kind)
    rows = rows.withColumn("__r", F.col("__c").eqNullSafe(F.lag("__c").over(w)) & F.lag("__c").over(w).isNotNull())
    return rows.groupBy(session).agg(F.count_if("__r").alias("repeats"), F.count("*").alias("steps"))


def recent(events: DataFrame, session: str, order: list[Column], n: int) -> DataFrame:
    """The last ``n`` events of each session; ``age`` is 1 for the newest."""
    return events.withColumn("age", F.row_number().over(Window.partitionBy(session).orderBy(*order))).filter(F.col("age") <= n)


def ledger_join(steps: DataFrame, ledger: DataFrame, pointer: str, event_id: str, payload: str) -> DataFrame:
    """Steps with the payload their pointer names; an empty payload where it names nothing."""
    facts = ledger.select(F.col(event_id).alias("__e"), F.col(payload).alias("__p"))
    return steps.join(facts, F.col(pointer) == F.col("__e"), "left").withColumn("payload", F.coalesce("__p", F.lit(""))).drop("__e", "__p")


def fill_forward(lines: DataFrame, doc: str, order: str, value: Column, name: str) -> DataFrame:
    """The last value that is not null up to each line of its document."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(w))


def islands(lines: DataFrame, doc: str, order: str, member: Column) -> DataFrame:
    """Runs of neighbouring lines that are members: (doc, first, last, n)."""
    w = Window.partitionBy(doc).orderBy(order)
    rows = lines.withColumns({"__m": member, "__o": F.row_number().over(w)})
    rows = rows.filter("__m").withColumn("__run", F.col("__o") - F.row_number().over(Window.partitionBy(doc).orderBy("__o")))
    return rows.groupBy(doc, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__run")


def titled_groups(lines: DataFrame, doc: str, order: str, title: Column, text: str) -> DataFrame:
    """Lines grouped under the title before them: (doc, group, lines, text)."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("group", F.sum(title.cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(doc, "group").agg(F.count("*").alias("lines"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_no", "line"))
