"""Nested object schemas (JSON) as flat rows of fields, to any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.sources.snapshots import stored

RAW = "map<string,string>"


def _object(node: Column, key: str) -> Column:
    return F.from_json(F.get_json_object(node, f"$.{key}"), RAW)


def resolved(rows: DataFrame, node: str, doc: str, named: DataFrame) -> DataFrame:
    """Rows whose node is a reference get what it names; ``seen`` grows by the reference. One that names nothing, or one of those it came by, is an empty schema."""
    ref = F.get_json_object(node, "$['$ref']")
    out = rows.withColumn("__ref", ref).join(named.select(F.col(doc).alias("__d"), F.col("ref").alias("__r"), F.col("schema").alias("__s")), (F.col(doc) == F.col("__d")) & (F.col("__ref") == F.col("__r")), "left")
    new = F.when(F.col("__ref").isNull(), F.col(node)).when(F.array_contains("seen", F.col("__ref")), F.lit("{}")).otherwise(F.coalesce("__s", F.lit("{}")))
    return out.withColumns({node: new, "seen": F.when(F.col("__ref").isNotNull(), F.array_append("seen", F.col("__ref"))).otherwise(F.col("seen"))}).drop("__ref", "__d", "__r", "__s")


def kind_of(node: Column, item: Column) -> Column:
    """The type of a field: of an array that of its items with brackets, of alternatives each once; ``object`` where only properties are given, else ``any``."""
    plain = lambda n: F.coalesce(F.get_json_object(n, "$.type"), F.when(F.get_json_object(n, "$.properties").isNotNull(), "object"), F.lit("any"))
    parts = F.from_json(F.coalesce(F.get_json_object(node, "$.anyOf"), F.get_json_object(node, "$.oneOf")), "array<string>")
    either = F.array_join(F.array_distinct(F.transform(parts, plain)), " | ")
    return F.when(parts.isNotNull() & (F.size(parts) > 0), either).when(F.get_json_object(node, "$.type") == "array", F.concat(plain(item), F.lit("[]"))).otherwise(plain(node))


def flattened(schemas: DataFrame, doc: str, schema: str, references: str | None = None) -> DataFrame:
    """(doc, path, type, required, default, description, place) of every field of a schema, in order of the schema.

    Fields of objects stand below their object as ``a.b``, those of objects in arrays as ``a[].b``. ``references`` is a map from
    ``#/...`` to schemas that ``$ref`` names. Each level is one pass over the level above, written before the next; a reference to a
    schema that it stands in ends there.
    """
    none = F.array().cast("array<string>")
    named = schemas.select(doc, F.explode(references).alias("ref", "schema")) if references else schemas.select(doc, F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("schema")).limit(0)
    named = stored(named)
    level = schemas.select(doc, F.lit("").alias("prefix"), F.col(schema).alias("node"), none.alias("seen"), F.array().cast("array<int>").alias("at"))
    levels = []
    while True:
        level = resolved(level, "node", doc, named)
        fields = level.select(doc, "prefix", "seen", "at", F.from_json(F.get_json_object("node", "$.required"), "array<string>").alias("must"), F.posexplode(F.map_entries(_object(F.col("node"), "properties"))).alias("i", "e"))
        fields = fields.select(
            doc, F.concat("prefix", F.when(F.col("prefix") == "", "").otherwise("."), "e.key").alias("path"), F.array_contains(F.coalesce("must", none), F.col("e.key")).alias("required"), F.array_append("at", F.col("i")).alias("at"), "seen", F.col("e.value").alias("node"),
        )
        fields = resolved(fields, "node", doc, named).withColumn("item", F.coalesce(F.get_json_object("node", "$.items"), F.lit("{}")))
        own = F.col("seen")
        fields = resolved(fields.withColumn("outer", own), "item", doc, named)
        fields = stored(fields)
        if not fields.limit(1).count():
            break
        levels.append(fields)
        inside = fields.select(doc, F.col("path").alias("prefix"), "node", F.col("outer").alias("seen"), "at")
        items = fields.filter(F.get_json_object("node", "$.type") == "array").select(doc, F.concat("path", F.lit("[]")).alias("prefix"), F.col("item").alias("node"), "seen", "at")
        level = inside.unionByName(items).filter(F.get_json_object("node", "$.properties").isNotNull())
    if not levels:
        levels = [fields]
    rows = reduce(DataFrame.unionByName, levels)
    choices = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.from_json(F.get_json_object(n, "$.enum"), "array<string>"), none) for n in (F.col("node"), F.col("item"))])))
    told = F.array_compact(F.array(F.nullif(F.trim(F.get_json_object("node", "$.description")), F.lit("")), F.when(F.size(choices) > 0, F.concat(F.lit("one of "), F.array_join(choices, ", ")))))
    place = F.row_number().over(Window.partitionBy(doc).orderBy("at"))
    return rows.select(doc, "path", kind_of(F.col("node"), F.col("item")).alias("type"), "required", F.get_json_object("node", "$.default").alias("default"), F.array_join(told, "; ").alias("description"), place.alias("place"))
