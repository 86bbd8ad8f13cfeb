"""Model calls behind interfaces with offline defaults, citations, question noise, parent scoring and the ask pipeline's parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yarrow.common import spread, table
from yarrow.functions import text as T

Embedder = Callable[[list[str]], list[list[float] | None]]


def hashed_embedder(dim: int = 64) -> Embedder:
    """N1's offline default: a bag of hashed words, of unit length; None for text without words."""
    def embed(texts: list[str]) -> list[list[float] | None]:
        import zlib

        out: list[list[float] | None] = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out

    return embed


def embedded(df: DataFrame, keys: list[str], text: str, embedder: Embedder | None = None, retries: int = 3, batch: int = 64) -> DataFrame:
    """(keys, vector, attempts, error). A batch that keeps failing gets null vectors and its error, for the dead letters."""
    embedder = embedder or hashed_embedder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors, tries, errors = [], [], []
            texts = pdf["_text"].tolist()
            for a in range(0, len(texts), batch):
                part, error = texts[a : a + batch], None
                for attempt in range(1, retries + 1):
                    try:
                        got, error = embedder(part), None
                        break
                    except Exception as e:  # noqa: BLE001
                        got, error = [None] * len(part), str(e)
                vectors += got
                tries += [attempt] * len(part)
                errors += [error] * len(part)
            yield pdf[keys].assign(vector=vectors, attempts=tries, error=errors)

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return spread(df.select(*keys, F.col(text).alias("_text"))).mapInPandas(run, f"{fields}, vector array<float>, attempts int, error string")


def question_noise(q: Column) -> Column:
    """Too short, Cyrillic, lost signs, mostly Chinese or hardly any Latin letters."""
    n = F.greatest(F.length(q), F.lit(1))
    share = lambda pattern: F.regexp_count(q, F.lit(pattern)) / n
    return F.coalesce((F.length(q) < 12) | q.rlike("[Ѐ-ӿ]") | (share("[�¤¦§¬±µ¶]") > 0.03) | (share(r"[\x{4e00}-\x{9fff}]") > 0.15) | (share(r"\p{IsLatin}") < 0.4), F.lit(True))


def score(fused: Column, vector: Column, bm25: Column, zero_counts: bool = True) -> Column:
    """The first score there is; with ``zero_counts`` off a zero falls through to the next."""
    cols = (fused, vector, bm25)
    return F.coalesce(*(cols if zero_counts else [F.nullif(c, F.lit(0.0)) for c in cols]), F.lit(0.0))


def enforce_citations(answer: Column, cites: Column) -> Column:
    """Every sentence without a citation mark gets the first citation before its stop."""
    first = F.element_at(cites, 1)
    parts = F.split(answer, r"(?<=[.!?])\s+")
    return F.array_join(F.transform(parts, lambda s: F.when(s.rlike(r"\[E\d+\]") | (F.length(F.trim(s)) == 0), s).otherwise(F.concat(F.regexp_replace(s, r"[.!?]$", ""), F.lit(" ["), first, F.lit("]"), F.regexp_extract(s, r"([.!?])$", 1)))), " ")


def prompt_rows(evidence: DataFrame) -> DataFrame:
    """Evidence (query_id, citation_id, chunk_id, snippet) as one block of rows a query."""
    row = F.concat_ws(" | ", "citation_id", "chunk_id", "snippet")
    return evidence.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation_id", row.alias("row")))), lambda x: x["row"]), "\n").alias("prompt"))


def overlay(evidence: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence joined to the first row of each key; a column that both have is the evidence's, even if null."""
    first = rows.groupBy(*keys).agg(*[F.min_by(c, F.struct("rank", *keys)).alias(c) for c in rows.columns if c not in keys and c not in evidence.columns])
    return evidence.join(first, keys, "left")


def parent_scores(results: DataFrame, how: str = "max") -> DataFrame:
    """The parent's score as its best child's, or as the sum of the best two."""
    best = F.max("score") if how == "max" else F.aggregate(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2), F.lit(0.0), lambda a, x: a + x)
    return results.groupBy("query_id", "parent_id").agg(F.round(best, 6).alias("score"), F.count(F.lit(1)).alias("n"))


def top_parents(scored: DataFrame, limit: int = 3, share: float = 0.9) -> DataFrame:
    """The best parents; one more if some further one has two children and nearly the best score."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "parent_id")
    r = scored.withColumn("p", F.row_number().over(w)).withColumn("best", F.max("score").over(Window.partitionBy("query_id")))
    extra = F.max((F.col("p") > limit) & (F.col("n") >= 2) & (F.col("score") >= share * F.col("best"))).over(Window.partitionBy("query_id"))
    return r.withColumn("_keep", limit + extra.cast("int")).where(F.col("p") <= F.col("_keep")).drop("_keep", "best")


def dominant_term(queries: DataFrame, evidence: DataFrame, stop: list[str]) -> DataFrame:
    """The query term that most evidence texts hold, ties and no hit by the first term."""
    terms = queries.select("query_id", F.posexplode(T.query_terms(F.col("query"), stop)).alias("i", "term"))
    texts = evidence.select("query_id", T.fold_accents(F.lower("text")).alias("t"))
    held = terms.join(texts, "query_id", "left").groupBy("query_id", "i", "term").agg(F.count_if(F.contains("t", "term")).alias("n"))
    return held.groupBy("query_id").agg(F.max("n").alias("n"), F.min_by("term", F.struct(-F.col("n"), F.col("i"))).alias("term"))


def template_questions(chunks: DataFrame, templates: list[str]) -> DataFrame:
    """A question of a chunk's keywords by the template of its number."""
    t = F.element_at(F.array(*[F.lit(x) for x in templates]), (F.pmod(F.col("ord"), F.lit(len(templates))) + 1).cast("int"))
    return chunks.select("ord", "chunk_id", F.replace(t, F.lit("{}"), F.array_join(T.keywords(F.col("text"), 3), " ")).alias("question"))


def extractive_answers(evidence: DataFrame) -> DataFrame:
    """N2's offline default: the evidence snippets in order, each with its citation; N4: none means the abstain text."""
    rows = evidence.withColumn("s", F.concat(F.regexp_replace("snippet", r"[.\s]+$", ""), F.lit(" ["), F.col("citation_id"), F.lit("].")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation_id", "s"))), lambda x: x["s"]), " ").alias("answer"), F.count(F.lit(1)).alias("n_evidence"))


# --- queries ------------------------------------------------------------------------------------------------------

TEMPLATES = ["Tài liệu nói gì về {}?", "{} có công dụng gì?", "Dùng {} như thế nào?", "What is said about {}?", "Vì sao nhắc đến {}?"]


def _results(spark, d):
    from yarrow.operators.evidence import _results as r

    return r(spark, d)


def c7_question_noise(spark, d):
    return table(spark, d, "test_questions").select("id", question_noise(F.col("question")).alias("noisy"))


def e13_parent_scores(spark, d):
    return parent_scores(_results(spark, d), "sum_top2").select("query_id", "parent_id", "score", "n")


def g3_top_parents(spark, d):
    return top_parents(parent_scores(_results(spark, d))).select("query_id", "parent_id", F.col("p").cast("bigint").alias("p"))


def b33_scores(spark, d):
    r = table(spark, d, "retrieval_results")
    return r.groupBy("query_id").agg(F.round(F.sum(score(F.col("bm25_score"), F.col("vector_score"), F.col("fused_score"))), 4).alias("s"), F.round(F.sum(score(F.col("bm25_score"), F.col("vector_score"), F.col("fused_score"), False)), 4).alias("t"))


def e25_dominant_terms(spark, d):
    from yarrow.operators.reports import STOP

    q = table(spark, d, "test_questions").where("question IS NOT NULL").select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    return dominant_term(q, _results(spark, d).where("rank < 4"), STOP)


def n1_embedded(spark, d):
    v = embedded(table(spark, d, "chunks"), ["ord"], "text")
    return v.select("ord", F.col("vector").isNull().alias("failed"), F.round(T.norm(F.col("vector")), 4).alias("norm"))


def n2_answers(spark, d):
    from yarrow.operators.evidence import n3_evidence

    a = extractive_answers(n3_evidence(spark, d))
    return a.select("query_id", F.size(T.citations(F.col("answer"))).cast("bigint").alias("cites"), "n_evidence")


def n6_questions(spark, d):
    return template_questions(table(spark, d, "chunks").where("NOT coalesce(is_noise, false) AND length(text) >= 30"), TEMPLATES)


def b34_json(spark, d):
    """Tolerant JSON: the events' properties, wrapped in prose, still parse."""
    e = table(spark, d, "events").select("event_id", T.json_object(F.concat(F.lit("Answer: "), F.col("props"), F.lit(" done"))).alias("j"))
    return e.where("j IS NOT NULL").select("event_id", F.try_variant_get("j", "$.k", "bigint").alias("k"))


def o14_kmeans(spark, d):
    """Ten clusters of the vectors with their sizes, on two principal components."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    flat = PCA(k=2, inputCol="features", outputCol="plane").fit(v).transform(v)
    return KMeans(k=10, seed=42, featuresCol="features").fit(flat).transform(flat).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


_R = """WITH r0 AS (SELECT query_id, chunk_id, max(fused_score) score, min(parent_id) parent_id FROM retrieval_results GROUP BY ALL),
b AS (SELECT query_id, parent_id, list_sort(list(score), 'DESC') l, max(score) m, count(*) n FROM r0 GROUP BY ALL) """
QUERIES = {f.__name__: f for f in (c7_question_noise, e13_parent_scores, g3_top_parents, b33_scores, e25_dominant_terms, n1_embedded, n2_answers, n6_questions, b34_json, o14_kmeans)}
_COUNT = "len(regexp_extract_all(question, '{0}')) / greatest(length(question), 1)"
_FOLD = "replace(replace(strip_accents(lower({0})), 'đ', 'd'), 'Đ', 'D')"
_TOP4 = """WITH r0 AS (SELECT query_id, chunk_id, max(fused_score) score, min(text) text FROM retrieval_results GROUP BY ALL), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 rank FROM r0) WHERE rank < 4)"""
SQL = {
    "c7_question_noise": f"SELECT id, coalesce(length(question) < 12 OR regexp_matches(question, '[Ѐ-ӿ]') OR {_COUNT.format('[�¤¦§¬±µ¶]')} > 0.03 OR {_COUNT.format('[一-鿿]')} > 0.15 OR {_COUNT.format(chr(92) + 'p{Latin}')} < 0.4, true) noisy FROM test_questions",
    "e25_dominant_terms": _TOP4 + f""", q AS (SELECT id query_id, regexp_extract_all({_FOLD.format('question')}, '[\\p{{L}}\\p{{N}}_]+') l FROM test_questions WHERE question IS NOT NULL),
t0 AS (SELECT query_id, unnest(l) term, unnest(range(len(l))) i FROM q), t AS (SELECT query_id, term, min(i) i FROM t0 WHERE length(term) >= 2 AND term NOT IN ({", ".join(repr(x) for x in ["la", "va", "cua", "cho", "co", "khong", "the", "nao", "gi", "o", "khi", "thi", "de", "voi", "cac", "mot"])}) GROUP BY 1, 2),
h AS (SELECT t.query_id, term, i, count(*) FILTER (contains({_FOLD.format('r.text')}, term)) n FROM t LEFT JOIN r USING (query_id) GROUP BY ALL)
SELECT query_id, max(n) n, arg_min(term, (-n, i)) term FROM h GROUP BY 1""",
    "n6_questions": r"""WITH c AS (SELECT ord, chunk_id, list_transform(regexp_extract_all(text, '\p{L}{3,}'), lambda x: lower(x)) l FROM chunks WHERE NOT coalesce(is_noise, false) AND length(text) >= 30),
w AS (SELECT ord, unnest(l) w, unnest(range(len(l))) i FROM c), d AS (SELECT ord, w, min(i) i FROM w GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY length(w) DESC, i) n FROM d),
s AS (SELECT ord, string_agg(w, ' ' ORDER BY n) s FROM k WHERE n <= 3 GROUP BY 1)
SELECT ord, chunk_id, replace([""" + ", ".join(f"'{t}'" for t in TEMPLATES) + "][ord % 5 + 1], '{}', coalesce(s, '')) question FROM c LEFT JOIN s USING (ord)",
    "n2_answers": _TOP4 + "SELECT query_id, count(*) cites, count(*) n_evidence FROM r GROUP BY 1",
    "e13_parent_scores": _R + "SELECT query_id, parent_id, round(l[1] + coalesce(l[2], 0), 6) score, n FROM b",
    "g3_top_parents": _R + ", p AS (SELECT *, round(m, 6) score, row_number() OVER (PARTITION BY query_id ORDER BY round(m, 6) DESC, parent_id) p, max(round(m, 6)) OVER (PARTITION BY query_id) best FROM b), x AS (SELECT *, max(CASE WHEN p > 3 AND n >= 2 AND score >= 0.9 * best THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) e FROM p) SELECT query_id, parent_id, p FROM x WHERE p <= 3 + e",
    "b33_scores": "SELECT query_id, round(sum(coalesce(bm25_score, vector_score, fused_score, 0)), 4) s, round(sum(coalesce(nullif(bm25_score, 0), nullif(vector_score, 0), nullif(fused_score, 0), 0)), 4) t FROM retrieval_results GROUP BY 1",
    "b34_json": "SELECT event_id, json_extract(props, '$.k')::BIGINT k FROM events WHERE json_valid(props)",
}
