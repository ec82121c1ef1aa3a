"""Tables that keep one row for each key, changed in place by buckets of keys.

A table is a folder of parquet files, dealt by a hash of the key to a fixed number of buckets. Changes
are merged into the buckets that they touch; these are written anew and replace the old ones when the
write commits, while files of other buckets stay as they are. A change has the key, a version, and
values for the columns that it sets (null: left as it is). Each column of a row keeps the version that
set it, and the largest one wins (of equal ones the larger value), so batches may arrive in any order
and more than once. A batch that changes nothing writes nothing. One writer at a time.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column with the version of each other column, and that of the bucket, which is the folder's name.
SET, BUCKET = "_set", "_bucket"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = 64, version: Column | None = None) -> None:
    """A new table with these rows, of distinct keys, as of a version (nought by default)."""
    values = [c for c in rows.columns if c not in keys]
    at = F.lit(0).cast("bigint") if version is None else version
    marked = rows.select(*keys, *values, F.struct(*[F.when(F.col(c).isNotNull(), at).alias(c) for c in values]).alias(SET), _bucket(keys, buckets).alias(BUCKET))
    marked.repartition(buckets, BUCKET).write.partitionBy(BUCKET).parquet(path)
    rows.sparkSession.createDataFrame([(keys, buckets)], "keys array<string>, buckets int").coalesce(1).write.json(f"{path}/_layout")


def layout(spark: SparkSession, path: str) -> tuple[list[str], int, list[str]]:
    """A table's keys, buckets and other columns."""
    row = spark.read.schema("keys array<string>, buckets int").json(f"{path}/_layout").first()
    columns = spark.read.parquet(path).columns
    return list(row["keys"]), row["buckets"], [c for c in columns if c not in (*row["keys"], SET, BUCKET)]


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(SET, BUCKET)


def lookup(spark: SparkSession, path: str, **key) -> DataFrame:
    """The row of a key, from its bucket alone."""
    keys, buckets, _ = layout(spark, path)
    kinds = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
    literal = spark.range(1).select(*[F.lit(key[k]).cast(kinds[k]).alias(k) for k in keys])
    bucket = literal.select(_bucket(keys, buckets)).first()[0]
    return spark.read.parquet(path).where(reduce(lambda a, k: a & (F.col(k) == F.lit(key[k])), keys, F.col(BUCKET) == bucket)).drop(SET, BUCKET)


def _newest(changes: DataFrame, keys: list[str], values: list[str], version: str) -> DataFrame:
    """One change for each key: for each column the value of the largest version, by a partial aggregation."""
    best = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(version).cast("bigint").alias("at"), F.col(c).alias("value")))).alias(c) for c in values]
    return changes.groupBy(*keys).agg(*best)


def upsert(spark: SparkSession, path: str, changes: DataFrame, version: str = "version", insert: bool = True) -> list[int]:
    """Merges changes into the table; returns the buckets that were written. Without `insert`, unknown keys are left out."""
    keys, buckets, columns = layout(spark, path)
    values = [c for c in columns if c in changes.columns]
    kinds = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
    asked = changes.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], *[F.col(c).cast(kinds[c]).alias(c) for c in values], version).where(reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True)))
    asked = _newest(asked, keys, values, version).withColumn(BUCKET, _bucket(keys, buckets))
    touched = sorted(r[0] for r in asked.select(BUCKET).distinct().collect())  # no more than the table has buckets
    now = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
    joined = now.withColumn("_there", F.lit(True)).join(asked.withColumnsRenamed({c: f"_new_{c}" for c in values}), [*keys, BUCKET], "full" if insert else "left")
    new = lambda c: F.col(f"_new_{c}.value")
    at, new_at = (lambda c: F.col(f"{SET}.{c}")), (lambda c: F.col(f"_new_{c}.at"))
    wins = {c: F.coalesce(new_at(c).isNotNull() & (at(c).isNull() | (new_at(c) > at(c)) | ((new_at(c) == at(c)) & (new(c) > F.col(c)))), F.lit(False)) for c in values}
    fresh = reduce(or_, wins.values(), F.col("_there").isNull())
    written = sorted(r[0] for r in joined.where(fresh).select(BUCKET).distinct().collect())
    if written:
        merged = {c: F.when(wins[c], new(c)).otherwise(F.col(c)) if c in values else F.col(c) for c in columns}
        versions = F.struct(*[(F.when(wins[c], new_at(c)).otherwise(at(c)) if c in values else at(c)).alias(c) for c in columns])
        rows = joined.where(F.col(BUCKET).isin(written)).select(*keys, *[v.alias(c) for c, v in merged.items()], versions.alias(SET), BUCKET)
        rows.repartition(len(written), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return written
