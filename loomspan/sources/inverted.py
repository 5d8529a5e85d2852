"""A kept inverted index: postings in folders by hash of the term, changed by versions of documents, read for a query's terms only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sources.snapshots import Snapshots, stored


def term_counts(docs: DataFrame) -> DataFrame:
    """(id, version, length, term, tf, head) for each term of each row's ``tokens``, from the runs of the sorted array. A row without tokens
    gives one row without a term; ``head`` is true for one row of each. Each generator is a barrier: what is made before it is made once a row."""
    length = F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0)).alias("length")
    row = docs.select("id", "version", length, F.explode(F.array(F.sort_array("tokens"))).alias("t"))
    first = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | ~F.get("t", i).eqNullSafe(F.get("t", i - 1)))
    runs = row.select("*", F.explode(F.array(F.when(F.col("length") > 0, first))).alias("s"))
    each = runs.select("*", F.posexplode_outer("s").alias("k", "i")).withColumn("term", F.get("t", F.col("i")))
    tf = F.when(F.col("term").isNull(), 0).otherwise(F.coalesce(F.get("s", F.col("k") + 1), F.col("length")) - F.col("i"))
    return each.select("id", "version", "length", "term", tf.cast("int").alias("tf"), (F.coalesce("k", F.lit(0)) == 0).alias("head"))


class InvertedIndex:
    """Postings (term, id, tf, length) of documents, in ``buckets`` folders by the term's hash and in order of the term's first bytes inside each file.

    Tables: ``postings``, to which each change adds; ``live``, the latest version of each id with its length and the change that wrote
    it, where a removed id stays with its version; ``dead``, postings that a later version has replaced, left out by readers until
    ``compact``. Counts and the sum of lengths are notes of the snapshot, so a query reads no table of all documents. A change costs
    its own postings and one pass over ``live``, whose rows are a few numbers.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.tables = spark, Snapshots(spark, path)
        self.buckets = self.tables.manifest()["notes"].get("buckets", buckets)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write_sorted(self, posts: DataFrame) -> dict:
        """Each task's postings in a file for each bucket, by the first six bytes of the term. Bucket and bytes make one number, by which Spark
        sorts without comparing rows; with a writer for each bucket no second sort by bucket comes behind."""
        start = F.conv(F.rpad(F.hex(F.coalesce("term", F.lit(""))), 12, "0"), 16, 10).cast("long")
        ordered = posts.sortWithinPartitions(F.shiftleft(F.col("bucket").cast("long"), 48) + start)
        name, conf = "spark.sql.maxConcurrentOutputFileWriters", self.spark.conf
        before = conf.get(name)
        conf.set(name, max(int(before), self.buckets + 1))
        try:
            return self.tables.write(ordered, ["bucket"])
        finally:
            conf.set(name, before)

    def upsert(self, docs: DataFrame, id_col: str, tokens: Column, version: Column) -> int:
        """Put documents in. A row replaces the kept one of its id unless its version is lower; of several rows of an id the one of the
        highest version counts (of these, the one with the most tokens, then the greatest in order). Null ids are left out.

        ``docs`` is read twice, first for its ids. Only rows of an id that comes more than once are brought together; all others are
        counted and sorted in the task that reads them, so each task writes its documents' postings and no text or token is shuffled.
        """
        base, gen = self.tables.number(), self.tables.number() + 1
        rows = docs.filter(F.col(id_col).isNotNull()).withColumn("__id", F.col(id_col)).withColumn("__version", version.cast("long"))
        twice = stored(rows.groupBy("__id").agg(F.count("*").alias("n")).filter("n > 1").select("__id"))

        def split(part: DataFrame) -> DataFrame:
            return part.select(F.col("__id").alias("id"), F.col("__version").alias("version"), F.explode(F.array(tokens)).alias("tokens"))

        if twice.isEmpty():
            one = split(rows)
        else:
            best = F.max(F.struct("version", F.size("tokens").alias("length"), "tokens")).alias("d")
            of_many = split(rows.join(twice, "__id", "left_semi")).groupBy("id").agg(best).select("id", "d.version", "d.tokens")
            one = split(rows.join(twice, "__id", "left_anti")).unionByName(of_many)
        posts = term_counts(one).select("term", "id", "tf", "length", "version", "head", F.lit(gen).alias("gen"), self._bucket(F.coalesce("term", F.lit(""))).alias("bucket"))
        entry = self._write_sorted(posts)
        # a document's first term, or the row without a term that an empty one has, stands for it
        heads = stored(self.tables.load(entry).filter("head").select("id", "version", "gen", "length", F.lit(False).alias("gone")))
        return self._publish(base, heads, entry)

    def remove(self, ids: DataFrame, id_col: str, version: Column) -> int:
        """Take documents out whose kept version is not above the given one; a later row of a lower version does not bring them back."""
        base, gen = self.tables.number(), self.tables.number() + 1
        gone = ids.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(version.cast("long")).alias("version"))
        return self._publish(base, gone.select("id", "version", F.lit(gen).alias("gen"), F.lit(0).alias("length"), F.lit(True).alias("gone")), None)

    def _publish(self, base: int, heads: DataFrame, posts: dict | None) -> int:
        old = self.tables.manifest(base)["tables"]
        if base:
            row = F.struct("version", "gen", "length", "gone")
            per = self.tables.read("live", base).unionByName(heads).groupBy("id").agg(F.max(row).alias("best"), F.min(row).alias("other"), F.count("*").alias("n"))
            live = self.tables.write(per.select("id", "best.*"))
            dead = self.tables.write(per.filter((F.col("n") > 1) & ~F.col("other.gone")).select("id", "other.gen"), after=old.get("dead"))
        else:  # ids come once, and nothing was there that they could replace
            live, dead = self.tables.write(heads.select("id", "version", "gen", "length", "gone")), self.tables.write(heads.limit(0).select("id", "gen"))
        if posts and old:
            posts = {**posts, "folders": [*old["postings"]["folders"], *posts["folders"]]}
        return self._commit(base, {"postings": posts or old.get("postings"), "live": live, "dead": dead})

    def _commit(self, base: int, tables: dict) -> int:
        n, filled, total = self._counts(self.tables.load(tables["live"]).filter("NOT gone"))
        notes = {"buckets": self.buckets, "documents": n, "filled": filled, "tokens": total, "dead": self.tables.load(tables["dead"]).count()}
        return self.tables.publish(base, {k: v for k, v in tables.items() if v}, notes)

    @staticmethod
    def _counts(live: DataFrame) -> tuple[int, int, int]:
        """Documents, those with tokens, and all tokens."""
        row = live.agg(F.count("*"), F.count_if(F.col("length") > 0), F.coalesce(F.sum("length"), F.lit(0))).first()
        return row[0], row[1], row[2]

    def postings(self, terms: Sequence[str], number: int | None = None) -> DataFrame:
        """(term, id, tf, length) of living documents for the given terms: only their folders, and there only row groups that can hold them."""
        number = self.tables.number() if number is None else number
        meta = self.tables.manifest(number)
        wanted = [(F.col("bucket") == self._bucket(F.lit(t))) & (F.col("term") == t) for t in dict.fromkeys(terms)]
        rows = self.tables.read("postings", number).filter(reduce(lambda a, b: a | b, wanted, F.lit(False)))
        if meta["notes"]["dead"]:
            rows = rows.join(self.tables.read("dead", number), ["id", "gen"], "left_anti")
        return rows.select("term", "id", "tf", "length")

    def bm25(self, terms: Sequence[str], scope: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, keep_zero: bool = False, number: int | None = None) -> DataFrame:
        """(id, score) as of a snapshot, as ``retrieval.bm25`` has them; ``scope`` holds the ids that count and are ranked (all if None)."""
        number = self.tables.number() if number is None else number
        terms = list(dict.fromkeys(terms))
        live = self.tables.read("live", number).filter("NOT gone") if scope is not None or keep_zero else None
        notes = self.tables.manifest(number)["notes"]
        n, filled, total = notes["documents"], notes["filled"], notes["tokens"]
        posts = self.postings(terms, number)
        if scope is not None:
            ids = scope.select(F.col(scope.columns[0]).alias("id")).distinct()
            live, posts = live.join(ids, "id", "left_semi"), posts.join(ids, "id", "left_semi")
            n, filled, total = self._counts(live)
        posts = stored(posts)  # a few numbers for each document with a term of the query, read for counts and for scores
        found = {r["term"]: r["df"] for r in posts.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each term of the query
        weight = F.lit(0.0)
        for t, df in found.items():
            weight = F.when(F.col("term") == t, F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))).otherwise(weight)
        part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / (total / max(filled, 1) or 1.0)))
        scored = posts.groupBy("id").agg(F.sum(weight * part).alias("score"))
        return live.select("id").join(scored, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score")) if keep_zero else scored

    def compact(self) -> int:
        """Postings of living documents in one set of folders; what later versions have replaced is gone from the next snapshot on."""
        base = self.tables.number()
        tables = self.tables.manifest(base)["tables"]
        dead = self.tables.read("dead", base)
        posts = self.tables.read("postings", base).join(dead, ["id", "gen"], "left_anti").select(*self.tables.read("postings", base).columns)
        entry = self.tables.write(posts.repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id"), ["bucket"])
        return self._commit(base, {"postings": entry, "live": tables["live"], "dead": self.tables.write(dead.limit(0))})
