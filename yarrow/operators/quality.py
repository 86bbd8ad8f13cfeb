"""Heading paths, phrase restoration, Latin fragments, corpus quality reports and vector collapse checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from yarrow.common import table
from yarrow.functions import text as T


def heading_level(style: Column, given: Column) -> Column:
    """The given level, else the number of a 'Heading n' style; at least 1, null if it is no heading."""
    named = F.regexp_extract(style, r"(?i)^heading\s*(\d+)$", 1)
    return F.greatest(F.coalesce(given, F.when(F.length(named) > 0, named.cast("int"))), F.lit(1))


def heading_paths(elements: DataFrame, source: str, order: str, levels: int = 6) -> DataFrame:
    """Each element's heading path: the last heading of every level that no later higher one has closed.

    A window for each level over one partitioning of the source; a heading of level n closes all deeper ones, which is
    a reset marker (the empty text) in the deeper levels.
    """
    w = Window.partitionBy(source).orderBy(order)
    for n in range(1, levels + 1):
        mark = F.when(F.col("level") == n, F.col("text")).when(F.col("level") < n, F.lit(""))
        elements = elements.withColumn(f"_h{n}", F.last(mark, ignorenulls=True).over(w))
    path = F.concat_ws(" > ", F.filter(F.array(*[F.col(f"_h{n}") for n in range(1, levels + 1)]), lambda x: x.isNotNull() & (x != "")))
    return elements.withColumn("heading_path", path).drop(*[f"_h{n}" for n in range(1, levels + 1)])


@F.pandas_udf(StringType())
def rejoin_latin(s: pd.Series) -> pd.Series:
    """Pieces of a Latin name are joined, within a line and over a break, until nothing changes."""
    import re

    over = re.compile(r"\b([A-Za-z]{2,})\n([a-z]{1,6})\b(?=[\s.,;)]|$)")
    start = re.compile(r"\b([A-Z][a-z]{0,2}) ([a-z]{3,})\b(?= [a-z]{3,}|[.,;)]|$)")
    tail = re.compile(r"\b([a-z]{4,}) (ae|is|um|us|ana|ata|ensis|iana|ifolia|oides|osa|osum|acea)\b")

    def fix(t: str) -> str:
        t = re.sub(r" {3,}", " ", t.replace("\f", "\n\n"))
        for _ in range(8):
            new = tail.sub(r"\1\2", start.sub(r"\1\2", over.sub(r"\1\2", t)))
            if new == t:
                break
            t = new
        return t

    return s.map(fix, na_action="ignore")


def quality_report(raw: DataFrame, chunks: DataFrame, points: DataFrame) -> DataFrame:
    """One row of counts, ratios and checks; the status fails if a chunk id has no point."""
    r = raw.agg(F.count(F.lit(1)).alias("passages"), F.countDistinct("source_id").alias("sources"), F.count_if(F.col("text").isNull() | (F.length(F.trim("text")) == 0)).alias("blank"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("chunk_id").alias("unique_chunks"), F.count_if("is_noise").alias("noise"), F.round(F.count_if("is_noise") / F.count(F.lit(1)), 4).alias("noise_ratio"))
    p = points.agg(F.countDistinct("chunk_id").alias("points"))
    return r.crossJoin(c).crossJoin(p).withColumn("status", F.when(F.col("points") == F.col("unique_chunks"), "ok").otherwise("fail"))


# --- queries ------------------------------------------------------------------------------------------------------


def o4_report(spark, d):
    return quality_report(table(spark, d, "raw_passages"), table(spark, d, "chunks"), table(spark, d, "points"))


def f8_headings(spark, d):
    """Heading paths where each new section heading of a source is taken as a level 1 or 2 heading by its numbering."""
    r = table(spark, d, "raw_passages").where("doc_type = 'docx'").select("source_id", "ord", F.col("section_heading").alias("text"))
    level = F.when(F.col("text").isNull(), F.lit(None).cast("int")).when(F.col("text").contains(" của "), 2).otherwise(1)
    return heading_paths(r.withColumn("level", level), "source_id", "ord", 2).select("ord", "heading_path")


def e20_nearest_stats(spark, d):
    """Percentiles of the nearest-neighbour cosine of every twentieth vector, and the collapse check."""
    from yarrow.operators.retrieval import j5_vector_topk

    best = j5_vector_topk(spark, d).where("rank = 0")
    return best.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.percentile("vector_score", F.lit(p)), 5).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.95)], (F.percentile("vector_score", F.lit(0.95)) > 0.93).alias("near_copies"))


def b39_rejoined(spark, d):
    r = table(spark, d, "raw_passages")
    return r.select("ord", F.md5(rejoin_latin(F.col("text"))).alias("digest"))


def e8_defects(spark, d):
    """Defects before and after cleaning, by document type."""
    r = table(spark, d, "raw_passages").where("text IS NOT NULL").select("doc_type", "text", T.clean_passage(F.col("text")).alias("clean"))
    n = lambda c, p: F.sum(F.regexp_count(F.col(c), F.lit(p)).cast("bigint"))
    return r.groupBy("doc_type").agg(n("text", "[ \t]{2,}").alias("runs_before"), n("clean", "[ \t]{2,}").alias("runs_after"), n("text", "�").alias("lost_before"), n("clean", "�").alias("lost_after"))


def o12_window_hits(spark, d):
    """Whether a question's gold chunk lies within one place of a retrieved child of the same parent."""
    from yarrow.operators.evidence import _gold, _results

    kids = table(spark, d, "chunks").select("chunk_id", "parent_id", "child_index")
    around = F.explode(F.sequence(F.col("child_index") - 1, F.col("child_index") + 1)).alias("child_index")
    near = _results(spark, d).where("rank < 10").select("query_id", "parent_id", around).join(kids, ["parent_id", "child_index"]).select("query_id", F.col("chunk_id").alias("item")).distinct()
    gold = _gold(spark, d).select("query_id", F.col("chunk_id").alias("item"))
    hit = gold.join(near.withColumn("hit", F.lit(1)), ["query_id", "item"], "left").groupBy("query_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return hit.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("hit"), 6).alias("hit_rate"))


QUERIES = {f.__name__: f for f in (o4_report, f8_headings, e20_nearest_stats, b39_rejoined, e8_defects, o12_window_hits)}
SQL = {
    "o4_report": "WITH r AS (SELECT count(*) passages, count(DISTINCT source_id) sources, count(*) FILTER (text IS NULL OR length(trim(text)) = 0) blank FROM raw_passages), c AS (SELECT count(*) chunks, count(DISTINCT chunk_id) unique_chunks, count(*) FILTER (is_noise) noise, round(count(*) FILTER (is_noise) / count(*)::DOUBLE, 4) noise_ratio FROM chunks), p AS (SELECT count(DISTINCT chunk_id) points FROM points) SELECT *, CASE WHEN points = unique_chunks THEN 'ok' ELSE 'fail' END status FROM r, c, p",
    "f8_headings": "WITH r AS (SELECT source_id, ord, section_heading t, CASE WHEN section_heading IS NULL THEN NULL WHEN contains(section_heading, ' của ') THEN 2 ELSE 1 END lv FROM raw_passages WHERE doc_type = 'docx'), w AS (SELECT ord, last_value(CASE WHEN lv = 1 THEN t END IGNORE NULLS) OVER x h1, last_value(CASE WHEN lv = 2 THEN t WHEN lv < 2 THEN '' END IGNORE NULLS) OVER x h2 FROM r WINDOW x AS (PARTITION BY source_id ORDER BY ord ROWS UNBOUNDED PRECEDING)) SELECT ord, concat_ws(' > ', nullif(h1, ''), nullif(h2, '')) heading_path FROM w",
    "e20_nearest_stats": "WITH s AS (SELECT a.vec_id, max(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)) v FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY 1) SELECT count(*) n, round(quantile_cont(v, 0.25), 5) p25, round(quantile_cont(v, 0.5), 5) p50, round(quantile_cont(v, 0.95), 5) p95, quantile_cont(v, 0.95) > 0.93 near_copies FROM s",
    "o12_window_hits": "WITH r0 AS (SELECT query_id, chunk_id, max(fused_score) score, min(parent_id) parent_id, min(child_index) child_index FROM retrieval_results GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 rank FROM r0), near AS (SELECT DISTINCT query_id, c.chunk_id item FROM r JOIN chunks c USING (parent_id) WHERE rank < 10 AND c.child_index BETWEEN r.child_index - 1 AND r.child_index + 1), gc AS (SELECT DISTINCT id query_id, trim(unnest(string_split(gold_relevant_ids, '|'))) item FROM test_questions WHERE gold_relevant_ids IS NOT NULL), g AS (SELECT * FROM gc WHERE length(item) > 0), h AS (SELECT g.query_id, max(CASE WHEN n.item IS NULL THEN 0 ELSE 1 END) hit FROM g LEFT JOIN near n ON n.query_id = g.query_id AND n.item = g.item GROUP BY 1) SELECT count(*) queries, round(avg(hit), 6) hit_rate FROM h",
}
