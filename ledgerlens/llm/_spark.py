"""Checkpoints and table reading for the text operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the folder that all executors share; recomputed by nobody, lost with no executor."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))  # one process, as in tests
    return df.checkpoint(eager=True)


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns named _0, _1 and so on, which no result has, and their own names."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns)))), df.columns


def renamed(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of `positional`, with their own names again."""
    return df.select(*(f"_{i}" for i in range(len(names)))).toDF(*names)


def without(columns: list[str], results: list[str]) -> list[str]:
    """The columns but those that a result replaces: names don't tell case apart."""
    taken = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in taken]


def quoted(*columns: str) -> list[str]:
    return ["`{}`".format(c.replace("`", "``")) for c in columns]


def with_text(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, str]:
    """The columns `keep` of docs and last its text, under a name that none of them has; and `keep` as a schema text with a comma after it."""
    name = "_text"
    while name in {c.lower() for c in keep}:
        name += "_"
    kept = ddl(docs.select(*quoted(*keep)))
    return docs.select(*quoted(*keep), F.col(quoted(text)[0]).alias(name)), kept + ", " if kept else ""


#: Rows that one key may bring to a task before its rows are dealt to several, and such keys at most: they are broadcast.
HOT_ROWS, HOT_KEYS = 1_000, 50_000


def join_dealt(rows: DataFrame, table: DataFrame, on: list[str], spread: list[str], how: str = "inner", n: str = "n") -> DataFrame:
    """rows.join(table, on), where table has a row for each key, and in column `n` how many of rows have it.

    Rows of keys with many of them are dealt to several tasks by a hash of the columns `spread`.
    The keys with more rows than a HOT_KEYS-th of all are HOT_KEYS at most.
    """
    total, most = table.agg(F.sum(n), F.max(n)).first()
    bound = max(HOT_ROWS, (total or 0) // HOT_KEYS + 1)
    if (most or 0) <= bound:
        return rows.join(table, on, how)
    hot = F.broadcast(table.where(F.col(n) > bound).select(*on, F.ceil(F.col(n) / bound).cast("int").alias("_parts")))
    rows = rows.join(hot, on, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int"))).drop("_parts")
    parts = F.when(F.col(n) > bound, F.ceil(F.col(n) / bound).cast("int")).otherwise(1)
    return rows.join(table.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))), [*on, "_part"], how).drop("_part")


#: Rows and bytes of an Arrow batch of texts (one row at least): both sides of a Python worker hold whole batches.
TEXT_ROWS, TEXT_BYTES = 2_000, 2 << 20


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow for tables with texts; from then on the session's batches have TEXT_ROWS rows at most, and end once they have TEXT_BYTES."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)):
        set_to = conf.get(name).lower().removesuffix("b")  # a size with another unit than bytes is replaced
        if not (set_to.isdigit() and 0 < int(set_to) <= most):
            conf.set(name, str(most))
    named, names = positional(df)  # mapInArrow can't tell columns whose names have dots
    return named.mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), schema)


def remainder(column: str, n: int):
    """crc32 of an id written as text, modulo n; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def ddl(df: DataFrame) -> str:
    """The columns of df as a schema text."""
    return ", ".join(f"{quoted(f.name)[0]} {f.dataType.simpleString()}" for f in df.schema.fields)


def in_chunks(keyed: DataFrame, member: str, most: int) -> DataFrame:
    """keyed (with a bigint `key`) with groups of over `most` rows cut into chunks.

    Every two chunks of a group meet under a key of their own, so that any two rows of a group still
    meet, and no new group has over about twice `most` rows. Rows are dealt to chunks by `member`.
    """
    large = keyed.groupBy("key").count().where(F.col("count") > most)
    large = cut(large.select(F.col("key").alias("_key"), F.ceil(F.col("count") / most).cast("int").alias("_chunks")))
    if large.isEmpty():
        return keyed
    columns = [c for c in keyed.columns if c != "key"]
    keyed = keyed.join(large, F.col("key") == F.col("_key"), "left").withColumn("_chunk", F.pmod(F.xxhash64(member, F.lit("chunk")), F.coalesce("_chunks", F.lit(1))))
    meets = F.transform(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1), lambda i: F.xxhash64("key", F.least(i.cast("bigint"), "_chunk"), F.greatest(i.cast("bigint"), "_chunk")))
    return keyed.select(*columns, F.explode(F.when(F.col("_chunks").isNull(), F.array("key")).otherwise(meets)).alias("key"))
