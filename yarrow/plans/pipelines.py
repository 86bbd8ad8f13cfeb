"""Whole pipelines as one lazy plan each: the offline build, and answering many questions at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yarrow.common import cut
from yarrow.functions import text as T
from yarrow.operators import answers, chunking, evidence, retrieval


def build(documents: DataFrame, key: str = "doc_id", size: int = 120, overlap: int = 25) -> DataFrame:
    """Documents to chunks ready for search: cleaned, packed, normalised, with ids, parents and a noise flag.

    Null and empty documents give no chunks.
    """
    clean = documents.select(F.col(key), T.clean_passage(F.col("text")).alias("text")).where(F.length("text") > 0)
    kids = chunking.children(clean, key, "text", size, overlap)
    source = F.concat(F.lit("src_"), T.short_hash(F.col(key).cast("string")))
    return kids.select(
        F.concat(source, F.lit(":"), T.short_hash(F.col("text"))).alias("chunk_id"), source.alias("source_id"), F.concat(source, F.lit(":e:0")).alias("parent_id"),
        "child_index", F.xxhash64(key, "child_index").alias("ord"), F.col("text"), F.lit("txt").alias("doc_type"), T.is_noise(F.col("text")).alias("is_noise"),
    )


def ask(questions: DataFrame, chunks: DataFrame, k: int = 40) -> DataFrame:
    """(query_id, passes, reason, answer, context, evidence) for every question in one batch.

    Questions whose gate fails have no answer. Without chunks every question comes back with the reason 'no results'.
    """
    docs = retrieval.searchable(chunks)
    # gate, evidence and context all read the few best rows of each question, so these are written once, without the chunks' columns
    found = cut(retrieval.bm25_topk(questions, docs, "ord", k)).select("query_id", "ord", "rank", (1.0 / (61 + F.col("rank"))).alias("score"))
    parts = chunks.select("ord", "chunk_id", "parent_id", "source_id", "text", T.snippet(F.col("text"), 160).alias("snippet"))
    head = cut(found.where("rank < 8").join(evidence.said(parts), "ord").withColumn("snippet", F.when(F.col("rank") < 4, F.col("snippet"))))
    decided = evidence.gate(head.drop("snippet"), questions)
    cites = head.where("rank < 4").select("query_id", F.concat(F.lit("E"), (F.col("rank") + 1).cast("string")).alias("citation_id"), "chunk_id", "snippet")
    said = answers.extractive_answers(cites)
    seen = evidence.context(found.join(chunks.select("ord", "parent_id", "child_index"), "ord"), chunks.select("parent_id", "child_index", "ord", "text"))
    out = decided.join(said, "query_id", "left").join(seen, "query_id", "left")
    return out.select("query_id", "passes", "reason", F.when(F.col("passes"), F.col("answer")).alias("answer"), "context", "selected")


def ablation(questions: DataFrame, docs: DataFrame, points: DataFrame, key: str, gold: DataFrame, modes: tuple[str, ...] = ("bm25", "vector", "hybrid_rrf"), k: int = 10) -> tuple[DataFrame, DataFrame]:
    """O1, O2: (hit rates a mode, failed questions a mode). gold: (query_id, item), items being keys.

    Each branch is searched once and written; the fusion reads those lists. Questions without a vector fail in the vector mode.
    """
    lists = {"bm25": cut(retrieval.bm25_topk(questions, docs, key, 4 * k)), "vector": cut(retrieval.vector_topk(questions, points, key, 4 * k))}
    ranked = {"bm25": lists["bm25"], "vector": lists["vector"], "hybrid_rrf": retrieval.rrf(lists, key, final=k)}
    rows = reduce(DataFrame.unionByName, [ranked[m].where(F.col("rank") < k).select(F.lit(m).alias("mode"), "query_id", "rank", F.col(key).alias("item")) for m in modes])
    asked = gold.select("query_id").distinct().crossJoin(questions.sparkSession.createDataFrame([(m,) for m in modes], "mode string"))  # a row a mode
    first = rows.join(gold, ["query_id", "item"]).groupBy("mode", "query_id").agg(F.min("rank").alias("first"))
    graded = evidence._graded(asked.join(first, ["mode", "query_id"], "left"), ["mode", "query_id"])
    return evidence.hit_summary(graded, ["mode"]), graded.where("first_rank IS NULL").select("mode", "query_id")


def o1_ablation(spark, d):
    """Hit rates of the three modes over questions made of the chunks' own vectors and keywords: every twentieth vector asks for its neighbour by number."""
    from yarrow.common import table

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("v"))
    q = table(spark, d, "test_questions").where("question IS NOT NULL").select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    q = q.join(v.select(F.col("ord").alias("query_id"), F.col("v").alias("qv")), "query_id")
    docs = retrieval.searchable(table(spark, d, "chunks").select("ord", "text", "is_noise", "doc_type"))
    return ablation(q, docs, v, "ord", q.select("query_id", F.col("query_id").alias("item")))[0]


def o6_build(spark, d):
    from yarrow.common import table

    return build(table(spark, d, "documents")).groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("is_noise").alias("noise"))


def o8_ask(spark, d):
    from yarrow.common import table

    q = table(spark, d, "test_questions").where("question IS NOT NULL").select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    return ask(q, table(spark, d, "chunks")).select("query_id", "passes", "reason", F.length("answer").alias("answer_chars"), F.length("context").alias("context_chars"))


QUERIES = {f.__name__: f for f in (o1_ablation, o6_build, o8_ask)}
SQL: dict[str, str] = {}
