"""Small helpers shared by all operators: tables, parallelism, skew-proof numbering, lineage cuts."""

from __future__ import annotations

import re
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, read lazily so that filters and column pruning reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan that has too few splits for a Python stage.

    A large table already has at least one split a core and is returned as it is (no shuffle);
    only inputs smaller than one split a core, such as single-file tables, are redistributed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in spark.checkpoint.dir.

    The directory is read from the session. A local session without one (unit tests) gets a temporary folder; on a
    cluster a folder of one machine would lose the rows with it, so there its absence is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="yarrow-checkpoint-"))
    return df.checkpoint(eager=True)


def running_before(df: DataFrame, keys: list[str], order: list[Column], weight: Column, out: str = "before") -> DataFrame:
    """Sum of ``weight`` over the rows of the same key that sort before each row, skew-proof.

    A plain window would bring a hot key into one task. Here rows are range-partitioned by
    (keys, order), so that a hot key covers many partitions; a prefix sum runs inside each
    partition and the partitions' totals by key are added. Only one row for each (partition, key) goes
    through the second step. ``order`` must be a total order for unique results.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_o{i}" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(names, order)) | {"_w": weight})
    # the sample that sets range borders is made anew whenever a plan runs, so the partition ids are
    # fixed by one materialisation that both uses share
    ranged = cut(ranged.repartitionByRange(n, *keys, *names).withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p", *keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_p").agg(F.sum("_w").alias("_t"))
    offsets = totals.withColumn("_off", F.sum("_t").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
    return (
        ranged.withColumn("_in", F.sum("_w").over(inside))
        .join(offsets, on=[*keys, "_p"], how="left")
        .withColumn(out, F.coalesce("_in", F.lit(0)) + F.coalesce("_off", F.lit(0)))
        .drop("_in", "_off", "_p", "_w", *names)
    )


def bit_field(spots: DataFrame, spot: str, bits: int) -> np.ndarray:
    """Packed bits, lowest first in each byte, of the distinct numbers below ``bits`` in a column.

    The bits are set on the executors, 32,768 to a row, so at most bits / 8 bytes come to the driver, however many rows there are.
    """
    at = F.col(spot).cast("long") + 1
    rows = spots.groupBy(F.bitmap_bucket_number(at).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b"))
    field = np.zeros(-(-max(bits, 32_768) // 8), dtype=np.uint8)
    for row in rows.collect():
        part = np.frombuffer(row["b"], dtype=np.uint8)
        field[(row["n"] - 1) * 4096 :][: len(part)] = part[: len(field) - (row["n"] - 1) * 4096]
    return field
