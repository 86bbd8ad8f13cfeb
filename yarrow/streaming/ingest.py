"""Incremental forms (an extension): ingest of new files, idempotent upserts, windowed counts with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yarrow.functions import text as T


def read_stream(spark: SparkSession, folder: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def cleaned(passages: DataFrame) -> DataFrame:
    """The same column functions as in batch: they hold no state."""
    return passages.withColumn("text", T.clean_passage(F.col("text"))).withColumn("text_cleaned", F.lit(True))


def first_copies(passages: DataFrame, at: str = "ingested_at", delay: str = "1 day") -> DataFrame:
    """The first arrival of each text; the watermark bounds how long a key is kept."""
    return passages.withWatermark(at, delay).withColumn("_k", F.xxhash64("source_id", "text")).dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def hourly_counts(events: DataFrame, at: str, by: str, delay: str = "2 hours") -> DataFrame:
    return events.withWatermark(at, delay).groupBy(F.window(at, "1 hour").alias("w"), by).agg(F.count(F.lit(1)).alias("n"))


def upsert(target: str, key: str, version: str):
    """A foreachBatch sink: the highest version of each key stays. A batch that comes again changes nothing.

    Each run writes a new numbered folder below ``target`` and readers take the highest number, so a lost executor leaves no half table.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(target)
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = sorted(int(f.getPath().getName()[2:]) for f in (fs.listStatus(fs_path) if fs.exists(fs_path) else []) if f.getPath().getName().startswith("v="))
        older = [v for v in done if v < number]
        rows = batch if not older else batch.unionByName(spark.read.parquet(f"{target}/v={older[-1]}"))
        newest = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")
        newest.write.mode("overwrite").parquet(f"{target}/v={number}")

    return write
