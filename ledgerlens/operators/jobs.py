"""Job tracking over append-only tables: latest state, newest jobs, detail, and inserts that ignore known ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File name endings that a batch accepts.
ACCEPTED = ["pdf", "jpg", "jpeg", "png", "webp", "tiff", "tif"]


def latest(states: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The row of the largest version of each job, by a partial aggregation; one of equal rows."""
    rest = [c for c in states.columns if c not in (key, version)]
    newest = states.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("_newest"))
    return newest.select(key, "_newest.*").select(*states.columns)


# Columns of jobs and of their records.
JOBS = "id string, status string, total_files int, processed int, failed int, output_path string, created_at string, updated_at string, error string, metadata string"
RECORDS = "job_id string, archivo string, estado string, rut string, fecha string, total bigint, proveedor string, folio bigint, doc_type string, ocr_engine string, ocr_avg_score double, missing_fields string, raw_text string"


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Tables of job states, which are appended to, and of records, by job."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.jobs ({JOBS}, version bigint) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.job_records ({RECORDS}) USING parquet PARTITIONED BY (job_id)")


def created(jobs: DataFrame, now: Column) -> DataFrame:
    """First states of jobs given by id, total_files and metadata (a map, or null)."""
    empty = F.create_map().cast("map<string,string>")
    return jobs.select("id", F.lit("queued").alias("status"), "total_files", F.lit(0).alias("processed"), F.lit(0).alias("failed"), F.lit(None).cast("string").alias("output_path"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("string").alias("error"), F.to_json(F.coalesce("metadata", empty)).alias("metadata"), F.lit(0).cast("bigint").alias("version"))


def state(changes: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Jobs after all their changes: a change holds values for the columns that it sets, and nulls for those that it leaves."""
    rest = [c for c in changes.columns if c not in (key, version)]
    return changes.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in rest], F.max(version).alias(version)).select(*changes.columns)


def decoded(jobs: DataFrame) -> DataFrame:
    """jobs with metadata as a map, empty where there is none."""
    return jobs.withColumn("metadata", F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")))


def get(jobs: DataFrame, job_id: str) -> DataFrame:
    return decoded(jobs.where(F.col("id") == job_id))


def records_of(records: DataFrame, job_id: str) -> DataFrame:
    """A job's records by file, with missing_fields as an array."""
    missing = F.coalesce(F.from_json("missing_fields", "array<string>"), F.array().cast("array<string>"))
    return records.where(F.col("job_id") == job_id).withColumn("missing_fields", missing).orderBy("archivo")


def corrected(corrections: DataFrame, records: DataFrame) -> DataFrame:
    """corrections (job_id, archivo and more) with found, and raw_text of the record that they correct: the first by its text."""
    first = records.groupBy("job_id", "archivo").agg(F.min("raw_text").alias("raw_text"), F.lit(True).alias("found"))
    return corrections.join(first, ["job_id", "archivo"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def accepted(files: DataFrame, most: int = 100) -> DataFrame:
    """The files (name, size, at) of a batch: of known endings, the first of each name and size, and the first `most` of these."""
    ending = F.lower(F.element_at(F.split("name", r"\."), -1))
    firsts = files.where(ending.isin(ACCEPTED)).withColumn("_n", F.row_number().over(Window.partitionBy("name", "size").orderBy("at")))
    return firsts.where("_n = 1").drop("_n").orderBy("at").limit(most)


def existing(paths: DataFrame, files: DataFrame) -> DataFrame:
    """paths without those that no file has."""
    return paths.join(files.select("path"), "path", "left_semi")


def newest(jobs: DataFrame, n: int = 50) -> DataFrame:
    """The n jobs created last, ties by id."""
    return jobs.orderBy(F.desc("created_at"), "id").limit(n)


def detail(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """jobs with records: their files in order of name, and empty without any."""
    rest = [c for c in records.columns if c != "job_id"]
    listed = records.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("archivo", *(c for c in rest if c != "archivo")))).alias("records"))
    joined = jobs.join(listed, F.col("id") == F.col("job_id"), "left").drop("job_id")
    return joined.withColumn("records", F.coalesce("records", F.array().cast(listed.schema["records"].dataType)))


def insert_new(known: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """known and those of more with a new key; the first by all columns of rows that share one."""
    fresh = more.join(known.select(key), key, "left_anti")
    first = Window.partitionBy(key).orderBy(*[c for c in more.columns if c != key])
    fresh = fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return known.unionByName(fresh)


def counters(records: DataFrame) -> DataFrame:
    """processed (OK and quarantined) and failed files of each job."""
    good = F.col("estado").isin("OK", "QUARANTINE")
    return records.groupBy("job_id").agg(F.count_if(good).alias("processed"), F.count_if(~good).alias("failed"))
