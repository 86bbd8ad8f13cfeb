"""Problem 7: one ranking from several scores on different scales (Borda count)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yarrow.common import table

#: Groups above this many rows are ranked by the distributed path.
HOT_ROWS = 200_000


def _clean(score: str):
    """NaN is no score: it counts as missing."""
    return F.when(~F.isnan(score), F.col(score))


def _points(score: str, rank, ties, present, n) -> F.Column:
    """Borda points in [0, n-1] from the average competition rank; a missing or lone score gets the mid-rank."""
    average = rank + (ties - 1) / 2.0
    return F.when(F.col(score).isNull() | (present <= 1), (n - 1) / 2.0).otherwise((present - average) * (n - 1) / F.greatest(present - 1, F.lit(1)))


def _small(df: DataFrame, group: str, scores: list[str]) -> DataFrame:
    """One exchange by group; every score's rank is a window over that same partitioning."""
    whole = Window.partitionBy(group)
    df = df.withColumn("_n", F.count(F.lit(1)).over(whole).cast("double"))
    for s in scores:
        df = df.withColumns({f"_r_{s}": F.rank().over(whole.orderBy(F.col(s).desc_nulls_last())), f"_t_{s}": F.count(F.lit(1)).over(Window.partitionBy(group, s)), f"_p_{s}": F.count(s).over(whole)})
    return df


def _large(df: DataFrame, group: str, scores: list[str]) -> DataFrame:
    """Hot groups: each score's distinct values are pre-aggregated, then counted by value blocks.

    The values of one group are cut into blocks by hash-free quantisation: the rank of a value is
    the number of rows in higher blocks (a window over at most BLOCKS totals) plus the rows before it
    inside its block (a window over one block), so no task sees a whole hot group.
    """
    blocks = 1024
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("_n"), *[F.count(s).alias(f"_p_{s}") for s in scores])
    for s in scores:
        bounds = df.groupBy(group).agg(F.percentile_approx(s, [i / blocks for i in range(1, blocks)], 10 * blocks).alias("_q"))
        values = df.where(F.col(s).isNotNull()).groupBy(group, s).agg(F.count(F.lit(1)).alias(f"_t_{s}"))
        values = values.join(bounds, group).withColumn("_b", F.expr(f"size(filter(_q, q -> q <= {s}))")).drop("_q")
        totals = values.groupBy(group, "_b").agg(F.sum(f"_t_{s}").alias("_c"))
        higher = totals.withColumn("_h", F.sum("_c").over(Window.partitionBy(group).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1))).drop("_c")
        inside = Window.partitionBy(group, "_b").orderBy(F.col(s).desc()).rowsBetween(Window.unboundedPreceding, -1)
        ranked = (
            values.withColumn("_i", F.sum(f"_t_{s}").over(inside)).join(higher, [group, "_b"])
            .select(group, s, f"_t_{s}", (F.coalesce("_i", F.lit(0)) + F.coalesce("_h", F.lit(0)) + 1).alias(f"_r_{s}"))
        )
        df = df.join(ranked, [group, s], "left")
    return df.join(sizes, group)


def borda(df: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Weighted Borda points of each item in its group, higher scores being better.

    Returns (group, item, points), one row an item. Each score's competition ranks (ties averaged)
    are stretched to the same range [0, n-1], so that a score which few items have weighs as much as
    one that all have; a missing (null or NaN) score gets the mid-rank. Exact repeats count once; an
    item repeated with different scores keeps its highest of each. Null items or groups are ranked
    like any other value; an empty table gives an empty result; other columns are ignored.
    Groups of more than ``hot_rows`` rows take the block-wise path, which gives the same points
    without bringing a group into one task.
    """
    weights = weights or [1.0] * len(scores)
    g, it = "_group", "_item"
    base = df.select(F.col(group).alias(g), F.col(item).alias(it), *[_clean(s).cast("double").alias(f"s{i}") for i, s in enumerate(scores)])
    cols = [f"s{i}" for i in range(len(scores))]
    # null keys would be lost in the joins of the hot path
    base = base.withColumns({"_gn": F.col(g).isNull(), g: F.coalesce(F.col(g).cast("string"), F.lit(""))}).withColumn(g, F.struct("_gn", g)).drop("_gn")
    counts = base.groupBy(g).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > hot_rows).select(g)
    hot = counts.isEmpty() is False
    best = lambda x: x.groupBy(g, it).agg(*[F.max(c).alias(c) for c in cols])
    if not hot:
        # rows of a group meet in one exchange; repeats are collapsed after it, inside the partition
        parts = _small(best(base.repartition(g)), g, cols)
    else:
        once = best(base)
        parts = _small(once.join(counts, g, "left_anti"), g, cols).unionByName(_large(once.join(counts, g, "left_semi"), g, cols).select(_small(once, g, cols).columns))
    total = reduce(lambda a, b: a + b, [w * _points(c, F.col(f"_r_{c}"), F.col(f"_t_{c}"), F.col(f"_p_{c}"), F.col("_n")) for c, w in zip(cols, weights)])
    kind = df.schema[group].dataType
    return parts.select(F.when(~F.col(f"{g}._gn"), F.col(f"{g}.{g}")).cast(kind).alias(group), F.col(it).alias(item), F.round(total, 9).alias("points"))


def first_places(points: DataFrame, group: str, item: str) -> DataFrame:
    """The item with most points of each group, ties by the smaller item; a partial aggregate, no sort."""
    return points.groupBy(group).agg(F.max("points").alias("points"), F.min_by(item, F.struct(-F.col("points"), F.col(item))).alias(item))


SCORES = ["bm25_score", "vector_score", "fused_score"]


def p7_found(spark, sf_dir):
    """query_id, chunk_id in first place of the combined ranking."""
    return first_places(borda(table(spark, sf_dir, "retrieval_results"), "query_id", "chunk_id", SCORES), "query_id", "chunk_id").select("query_id", "chunk_id")


def p7_ranking(spark, sf_dir):
    """Every item's Borda points by query."""
    return borda(table(spark, sf_dir, "retrieval_results"), "query_id", "chunk_id", SCORES)


_ORACLE = """
WITH base AS (SELECT query_id, chunk_id, max(bm25_score) s0, max(vector_score) s1, max(fused_score) s2 FROM retrieval_results GROUP BY 1, 2),
r AS (SELECT *, count(*) OVER q n,
  count(s0) OVER q p0, rank() OVER (PARTITION BY query_id ORDER BY s0 DESC NULLS LAST) r0, count(*) OVER (PARTITION BY query_id, s0) t0,
  count(s1) OVER q p1, rank() OVER (PARTITION BY query_id ORDER BY s1 DESC NULLS LAST) r1, count(*) OVER (PARTITION BY query_id, s1) t1,
  count(s2) OVER q p2, rank() OVER (PARTITION BY query_id ORDER BY s2 DESC NULLS LAST) r2, count(*) OVER (PARTITION BY query_id, s2) t2
  FROM base WINDOW q AS (PARTITION BY query_id)),
pts AS (SELECT query_id, chunk_id, round(
  CASE WHEN s0 IS NULL OR p0 <= 1 THEN (n-1)/2.0 ELSE (p0-(r0+(t0-1)/2.0))*(n-1)/greatest(p0-1,1)::DOUBLE END +
  CASE WHEN s1 IS NULL OR p1 <= 1 THEN (n-1)/2.0 ELSE (p1-(r1+(t1-1)/2.0))*(n-1)/greatest(p1-1,1)::DOUBLE END +
  CASE WHEN s2 IS NULL OR p2 <= 1 THEN (n-1)/2.0 ELSE (p2-(r2+(t2-1)/2.0))*(n-1)/greatest(p2-1,1)::DOUBLE END, 9) points FROM r)
"""
QUERIES = {"p7_found": p7_found, "p7_ranking": p7_ranking}
SQL = {
    "p7_found": _ORACLE + "SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, chunk_id) k FROM pts) WHERE k = 1",
    "p7_ranking": _ORACLE + "SELECT query_id, chunk_id, points FROM pts",
}
