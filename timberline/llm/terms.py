"""How often every term occurs, and in how many records, kept up to date by signed deltas.

Added records count +1 and removed ones -1 (a changed record is both), summed per term before any
shuffle, and merged into a table of counts written under a path, partitioned by a hash of the term.
Where records arrive in deliveries, each is compared with its last state only, so that a record that is
delivered again unchanged counts for nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOTAL = ""  # the field whose one row counts the records themselves
BUCKETS = 64
SCHEMA = "field_name string, term string, occurrences bigint, records bigint"


def letter_runs(text: Column) -> Column:
    """The longest runs of a-z in the lower-cased text, as an array."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda t: t != "")


def delivery_changes(rows: DataFrame, key: list[str], content: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """What each delivery of a record changes: all columns of ``rows`` and ``sign``, +1 for the content that
    it adds, -1 for the record's content before it.

    The deliveries of a key, in which nulls are values, follow each other by ``order``. One that has the
    content of the one before gives no row; one whose column ``deleted`` is true only takes back. A key
    has as many rows in a task as it was delivered.
    """
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    kept = rows.select(F.struct("*").alias("now"), gone.alias("gone"), F.struct(*content).alias("has"), *[mark(c).alias(f"k{i}") for i, c in enumerate(key)], *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    keys = [f"k{i}" for i in range(len(key))]
    last = Window.partitionBy(*keys).orderBy(*[f"o{i}" for i in range(len(order))], "has")
    was = F.lag(F.when(~F.col("gone"), F.col("has"))).over(last)
    steps = kept.withColumn("was", was).filter(F.col("gone") | ~F.col("has").eqNullSafe(F.col("was")))
    signed = F.array(F.when(~F.col("gone"), F.struct(F.lit(1).alias("sign"), F.col("has").alias("has"))), F.when(F.col("was").isNotNull(), F.struct(F.lit(-1).alias("sign"), F.col("was").alias("has"))))
    out = steps.select("now", F.explode(F.array_compact(signed)).alias("x"))
    return out.select(*[(F.col("x.has") if c in content else F.col("now"))[c].alias(c) for c in rows.columns], F.col("x.sign").alias("sign"))


def term_deltas(records: DataFrame, texts: dict[str, Column], values: dict[str, Column], sign: int | Column = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., field_name, term, occurrences, records) of one row per record, times ``sign``.

    ``texts``: by field name an array of terms (null: none); ``values``: a single value, null left out.
    An empty table gives no rows.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def item(field: str, term: Column, n: Column, r: Column) -> Column:
        return F.struct(F.lit(field).alias("field_name"), term.alias("term"), n.alias("n"), r.alias("r"))

    def items(field: str, terms: Column, n: Column, r: Column) -> Column:
        return F.transform(terms, lambda t: item(field, t, n, r))

    parts = [F.array(item(TOTAL, F.lit(""), one, one))]
    for f, a in texts.items():
        parts += [items(f, a, one, none), items(f, F.array_distinct(a), none, one)]
    parts += [F.array(item(f, v.cast("string"), one, one)) for f, v in values.items()]
    empty = F.filter(parts[0], lambda x: F.lit(False))
    rows = records.select(*by, (F.lit(sign) if isinstance(sign, int) else sign).cast("bigint").alias("sign"), F.explode(F.concat(*[F.coalesce(p, empty) for p in parts])).alias("x"))
    rows = rows.filter("x.term is not null").select(*by, "sign", "x.*")
    sums = rows.groupBy(*by, "field_name", "term").agg(F.sum(F.col("sign") * F.col("n")).alias("occurrences"), F.sum(F.col("sign") * F.col("r")).alias("records"))
    return sums


def merge_counts(*tables: DataFrame) -> DataFrame:
    """Counts and deltas added up; terms that no record has any more are dropped."""
    every = reduce(DataFrame.unionByName, tables)
    sums = every.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return sums.filter("occurrences <> 0 or records <> 0")


class TermCounts:
    """The persistent counts, partitioned by a hash of the term: each update writes those partitions anew
    that its deltas touch, beside the last versions, and a list of the version of every partition."""

    def __init__(self, spark: SparkSession, path: str, version: int = 0):
        self.spark, self.path, self.version = spark, path, version

    def parts(self) -> dict[int, int]:
        """The version in which each partition that has rows was last written."""
        rows = self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/m{self.version}").collect() if self.version else []
        return {r["bucket"]: r["version"] for r in rows}  # at most BUCKETS

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        by: dict[int, list[int]] = {}
        for b, v in self.parts().items():
            if buckets is None or b in buckets:
                by.setdefault(v, []).append(b)
        none = self.spark.createDataFrame([], SCHEMA)
        tables = [self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(f"{self.path}/v{v}").filter(F.col("bucket").isin(x)).drop("bucket") for v, x in by.items()]
        return reduce(DataFrame.unionByName, tables) if tables else none

    def update(self, deltas: DataFrame) -> TermCounts:
        bucket = F.pmod(F.hash("term"), F.lit(BUCKETS)).alias("bucket")
        old, new = self.parts(), TermCounts(self.spark, self.path, self.version + 1)
        touched: set[int] = set()
        if old:
            deltas = deltas.checkpoint()
            touched = {r["bucket"] for r in deltas.select(bucket).distinct().collect()}  # at most BUCKETS
            deltas = merge_counts(self.read(touched), deltas)
        rows = deltas.filter("occurrences <> 0 or records <> 0").select("*", bucket)
        at = f"{self.path}/v{new.version}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        written = self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(at).select("bucket").distinct().collect()
        now = {b: v for b, v in old.items() if b not in touched} | {r["bucket"]: new.version for r in written}
        self.spark.createDataFrame(list(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/m{new.version}")
        return new

    def expire(self) -> None:
        """Removes what only earlier versions have; readers of those must be done."""
        used = {f"v{v}" for v in self.parts().values()} | {f"m{self.version}"}
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(hadoop):
            if f.getPath().getName() not in used:
                fs.delete(f.getPath(), True)

    def total(self) -> int:
        """Number of records: one row of the table."""
        row = self.read().filter(F.col("field_name") == TOTAL).agg(F.sum("records")).first()
        return row[0] or 0

    def marked(self, rare_below: int = 5, common_above: float = 0.1) -> DataFrame:
        """(field_name, term, occurrences, records, mark); mark is null for useful terms."""
        rare = F.col("occurrences") < rare_below
        common = F.col("records") > F.lit(common_above * self.total())
        return self.read().filter(F.col("field_name") != TOTAL).withColumn("mark", F.when(rare, "rare").when(common, "common"))


def record_changes(before: DataFrame, after: DataFrame, key: list[str], content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(removed, added) rows between two states of a table with one row per key; unchanged rows drop out."""
    tag = [F.col(c).alias(f"b_{c}") for c in key]
    digest = F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in content])
    a, b = after.withColumn("_d", digest), before.withColumn("_d", digest)
    on_b = reduce(Column.__and__, [F.col(c) == F.col(f"b_{c}") for c in key])
    added = a.join(b.select(*tag, F.col("_d").alias("_e")), on_b & (F.col("_d") == F.col("_e")), "left_anti")
    removed = b.join(a.select(*tag, F.col("_d").alias("_e")), on_b & (F.col("_d") == F.col("_e")), "left_anti")
    return removed.drop("_d"), added.drop("_d")
