"""Predicates and reports that judge texts, parents, vectors, runs and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yarrow.common import table
from yarrow.functions import text as T
from yarrow.operators.retrieval import vector_topk

#: Signs that hardly any clean text has.
ODD = "�¤¦§¬±µ¶"
#: What a line of a cover, a slide or a link holds.
NO_CONTENT = ["presentation title", "presen tation", "slide", "mục lục", "http://", "https://", "www."]
ENGLISH = ["the", "of", "and", "with", "is", "to", "in", "for", "what", "how", "does"]


def clean_for_evaluation(text: Column, noise: Column, key: Column, least: int = 80, most: float = 0.03) -> Column:
    """Long enough, no noise (a missing flag counts as none), with an id, without lost or Cyrillic letters and with few odd signs."""
    solid = F.greatest(F.length(F.regexp_replace(text, r"\s", "")), F.lit(1))
    bad = F.length(text) - F.length(F.translate(text, ODD, ""))
    good = (F.length(text) >= least) & ~F.coalesce(noise, F.lit(False)) & (F.length(key) > 0) & ~F.contains(text, F.lit("�")) & ~text.rlike("[Ѐ-ӿ]") & (bad / solid <= most)
    return F.coalesce(good, F.lit(False))


def meaningful_line(line: Column) -> Column:
    """18 to 180 characters with at least ten letters, and no cover, slide or link."""
    low = F.lower(line)
    none = reduce(lambda a, b: a & b, [~F.contains(low, F.lit(p)) for p in NO_CONTENT])
    return F.coalesce(F.length(line).between(18, 180) & none & (F.regexp_count(line, F.lit(r"\p{L}")) >= 10), F.lit(False))


def without_accents(t: Column) -> Column:
    """C15."""
    return F.coalesce(t.rlike("[a-z]") & (t == T.fold_accents(t)), F.lit(False))


def language(t: Column, fallback: str = "vi") -> Column:
    """B5: 'vi' by its own letters, 'en' by at least two of its small words and no such letter, else the fallback."""
    low = F.lower(t)
    small = F.size(F.filter(F.regexp_extract_all(low, F.lit(r"([a-z]+)")), lambda w: w.isin(*ENGLISH)))
    return F.when(low.rlike("[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉĩịọỏốồổỗộớờởỡợụủũứừửữựỳỵỷỹ]"), "vi").when(small >= 2, "en").otherwise(fallback)


def quality_gate(chunks: DataFrame) -> DataFrame:
    """Whether a corpus passes: shares of lost signs and noise, parents without gaps, and sizes of parents."""
    per = chunks.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), ((F.min("child_index") != 0) | (F.max("child_index") != F.count(F.lit(1)) - 1) | (F.countDistinct("child_index") != F.count(F.lit(1)))).alias("bad"))
    parents = per.agg(F.count_if("bad").alias("bad_parents"), F.percentile("n", F.lit(0.95)).alias("p95"), F.max("n").alias("largest"))
    lost = F.sum(F.length("text") - F.length(F.translate("text", "�", ""))) / F.greatest(F.sum(F.length("text")), F.lit(1))
    texts = chunks.agg(F.round(lost, 8).alias("lost_ratio"), F.round(F.avg(F.coalesce(F.col("is_noise").cast("int"), F.lit(0))), 6).alias("noise_ratio"))
    passes = (F.col("lost_ratio") <= 0.005) & (F.col("noise_ratio") <= 0.01) & (F.col("bad_parents") == 0) & (F.col("p95") <= 10) & (F.col("largest") <= 20)
    return texts.crossJoin(F.broadcast(parents)).withColumn("passes", passes)  # one row each


def vector_report(points: DataFrame, key: str, group: str, every: int = 20) -> DataFrame:
    """(norms, similarities within and across groups, nearest neighbours' share of a group, warnings).

    Pairs are those of every ``every``-th key with all others, a stated query set; similarities within a group come from sums of unit
    vectors, so no pair of all vectors is ever formed. The warnings: norms spread by more than 2, groups closer to others than 0.45
    within, less than half of the nearest five of a group, collapse (mean above 0.85 and 95th percentile above 0.93).
    """
    v = points.withColumn("_n", T.norm(F.col("v"))).where(F.col("_n") > 0)
    norms = v.agg(F.count(F.lit(1)).alias("vectors"), F.round(F.avg("_n"), 6).alias("norm_mean"), F.round(F.stddev_pop("_n"), 6).alias("norm_std"))
    unit = v.select(key, group, F.posexplode(F.transform("v", lambda x: x.cast("double") / F.col("_n"))).alias("d", "x"))
    sums = unit.groupBy(group, "d").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    # of n unit vectors the squared length of the sum is n plus twice the sum over pairs
    within = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    total = sums.groupBy("d").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    pairs = within.agg(F.sum((F.col("q") - F.col("n")) / 2).alias("inside"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside_pairs"), F.sum("n").alias("n"))
    both = pairs.crossJoin(F.broadcast(total))
    across = (F.col("q") - F.col("n")) / 2 - F.col("inside")
    count = F.col("n") * (F.col("n") - 1) / 2 - F.col("inside_pairs")
    cosines = both.select(F.round(F.col("inside") / F.nullif("inside_pairs", F.lit(0.0)), 5).alias("intra_cosine"), F.round(across / F.nullif(count, F.lit(0.0)), 5).alias("inter_cosine"))
    near = vector_topk(v.where(F.pmod(F.col(key), F.lit(every)) == 0).select(F.col(key).alias("query_id"), F.col("v").alias("qv")), v.select(key, "v"), key, 5, exclude_self=True)
    groups = v.select(key, group)
    hits = near.join(groups, key).join(groups.select(F.col(key).alias("query_id"), F.col(group).alias("_g")), "query_id").groupBy("query_id").agg(F.max((F.col(group) == F.col("_g")).cast("int")).alias("hit"), F.max("vector_score").alias("best"))
    nearest = hits.agg(F.round(F.avg("hit"), 6).alias("hit5"), F.round(F.avg("best"), 5).alias("nearest_mean"), F.round(F.percentile("best", F.lit(0.95)), 5).alias("nearest_p95"))
    out = norms.crossJoin(F.broadcast(cosines)).crossJoin(F.broadcast(nearest))  # one row each
    warnings = F.array_compact(F.array(F.when(F.col("norm_std") > 2, "norms"), F.when(F.col("intra_cosine") < 0.45, "groups"), F.when(F.col("hit5") < 0.5, "neighbours"), F.when((F.col("nearest_mean") > 0.85) & (F.col("nearest_p95") > 0.93), "collapse")))
    return out.withColumn("warnings", F.array_join(warnings, ","))


def joined_runs(runs: dict[str, DataFrame], key: str = "run_id") -> DataFrame:
    """Rows of several kinds of runs side by side, one for each id that any kind has; columns are prefixed by the kind.

    A union and one aggregate instead of a chain of full outer joins; of repeated ids the smallest row by content stays.
    """
    parts = []
    for name, df in runs.items():
        cols = [c for c in df.columns if c != key]
        parts.append(df.select(key, F.struct(*cols).alias(name)))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    one = every.groupBy(key).agg(*[F.min(name).alias(name) for name in runs])
    return one.select(key, *[F.col(f"{name}.{c}").alias(f"{name}_{c}") for name, df in runs.items() for c in df.columns if c != key])


def hits_by(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """Whether the first k results hold a query's source, parent and text (by hash), a row a query of ``expected``."""
    some = results.where(F.col("rank") < k).select("query_id", F.col("source_id").alias("_s"), F.col("parent_id").alias("_p"), F.xxhash64(T.collapse(F.lower("text"))).alias("_t"))
    rows = expected.select("query_id", "source_id", "parent_id", F.xxhash64(T.collapse(F.lower("text"))).alias("t")).join(some, "query_id", "left")
    hit = lambda a, b: F.max(F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0))).cast("bigint")
    return rows.groupBy("query_id").agg(hit("_s", "source_id").alias("source_hit"), hit("_p", "parent_id").alias("parent_hit"), hit("_t", "t").alias("text_hit"))


def last_parents(parents: DataFrame, order: str) -> DataFrame:
    """Of parents with one id the last row by ``order``."""
    rest = [c for c in parents.columns if c not in ("parent_id", order)]
    return parents.groupBy("parent_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("parent_id", "r.*")


# --- queries ------------------------------------------------------------------------------------------------------


def c6_clean_chunks(spark, d):
    c = table(spark, d, "chunks")
    return c.where(clean_for_evaluation(F.col("text"), F.col("is_noise"), F.col("chunk_id"))).select("ord")


def c8_lines(spark, d):
    """Meaningful lines of every passage."""
    r = table(spark, d, "raw_passages").where("text IS NOT NULL").select("ord", F.explode(F.split("text", "\n")).alias("line"))
    return r.where(meaningful_line(F.col("line"))).groupBy("ord").agg(F.count(F.lit(1)).alias("n"))


def c15_plain_questions(spark, d):
    q = table(spark, d, "test_questions")
    return q.where(without_accents(T.normalise_query(F.col("question")))).select("id")


def b5_language(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy(language(F.col("text")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def c16_quality_gate(spark, d):
    return quality_gate(table(spark, d, "chunks")).select("lost_ratio", "noise_ratio", "bad_parents", F.round("p95", 6).alias("p95"), "largest", "passes")


def o3_vector_report(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    return vector_report(e, "vec_id", "label").select("vectors", F.round("norm_mean", 4).alias("norm_mean"), F.round("norm_std", 4).alias("norm_std"), "intra_cosine", "inter_cosine", "hit5", "nearest_mean", "warnings")


def d12_runs(spark, d):
    """Questions, their results and their best rows side by side."""
    q = table(spark, d, "test_questions").select(F.col("id").alias("run_id"), F.length("question").cast("bigint").alias("chars"))
    r = table(spark, d, "retrieval_results")
    best = r.groupBy(F.col("query_id").alias("run_id")).agg(F.max("fused_score").alias("score"))
    bm = r.where("bm25_score IS NOT NULL").groupBy(F.col("query_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n"))
    return joined_runs({"base": q, "fused": best, "words": bm})


def o13_hits_by(spark, d):
    """Whether every question's first gold chunk's source, parent and text are among its first ten results."""
    from yarrow.operators.evidence import _results

    q = table(spark, d, "test_questions").where("gold_relevant_ids IS NOT NULL").select(F.col("id").alias("query_id"), F.element_at(T.id_list(F.col("gold_relevant_ids")), 1).alias("chunk_id"))
    c = table(spark, d, "chunks").groupBy("chunk_id").agg(F.min_by("source_id", "ord").alias("source_id"), F.min_by("parent_id", "ord").alias("parent_id"), F.min_by(F.substring("text", 1, 500), "ord").alias("text"))
    return hits_by(_results(spark, d), q.join(c, "chunk_id"))


def a30_last_parents(spark, d):
    """Every parent's last chunk by arrival."""
    return last_parents(table(spark, d, "chunks").select("parent_id", "ord", "chunk_id", "title"), "ord").select("parent_id", "chunk_id", "title")


def b26_explained(spark, d):
    """Every stage of a question's normalisation."""
    q = table(spark, d, "test_questions").where("question IS NOT NULL")
    s = T.explained(F.col("question"))
    return q.select("id", s.alias("s")).select("id", "s.*")


QUERIES = {f.__name__: f for f in (c6_clean_chunks, c8_lines, c15_plain_questions, b5_language, c16_quality_gate, o3_vector_report, d12_runs, o13_hits_by, a30_last_parents, b26_explained)}
_WS = r"[ \t\n\r\f\x0B]+"
_FLAT = f"regexp_replace(regexp_replace({{0}}, '{_WS}', ' ', 'g'), '^ | $', '', 'g')"
_R = """WITH r0 AS (SELECT query_id, chunk_id, max(fused_score) score, min(parent_id) parent_id, min(source_id) source_id, min(text) text FROM retrieval_results GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 rank FROM r0)"""
SQL = {
    "c6_clean_chunks": f"SELECT ord FROM chunks WHERE length(text) >= 80 AND NOT coalesce(is_noise, false) AND length(chunk_id) > 0 AND NOT contains(text, '�') AND NOT regexp_matches(text, '[Ѐ-ӿ]') AND (length(text) - length(translate(text, '{ODD}', ''))) / greatest(length(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]', '', 'g')), 1) <= 0.03",
    "c8_lines": "WITH l AS (SELECT ord, unnest(string_split(text, chr(10))) line FROM raw_passages WHERE text IS NOT NULL) SELECT ord, count(*) n FROM l WHERE length(line) BETWEEN 18 AND 180 AND len(regexp_extract_all(line, '\\p{L}')) >= 10" + "".join(f" AND NOT contains(lower(line), '{p}')" for p in NO_CONTENT) + " GROUP BY 1",
    "c15_plain_questions": f"WITH n AS (SELECT id, {_FLAT.format('lower(nfc_normalize(question))')} t FROM test_questions) SELECT id FROM n WHERE regexp_matches(t, '[a-z]') AND t = replace(strip_accents(t), 'đ', 'd')",
    "b5_language": "WITH l AS (SELECT lower(text) t FROM documents WHERE text IS NOT NULL) SELECT CASE WHEN regexp_matches(t, '[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉĩịọỏốồổỗộớờởỡợụủũứừửữựỳỵỷỹ]') THEN 'vi' WHEN len(list_filter(regexp_extract_all(t, '[a-z]+'), lambda w: w IN (" + ", ".join(f"'{w}'" for w in ENGLISH) + "))) >= 2 THEN 'en' ELSE 'vi' END AS language, count(*) n FROM l GROUP BY 1",
    "c16_quality_gate": """WITH p AS (SELECT parent_id, count(*) n, min(child_index) <> 0 OR max(child_index) <> count(*) - 1 OR count(DISTINCT child_index) <> count(*) bad FROM chunks GROUP BY 1),
a AS (SELECT count(*) FILTER (bad) bad_parents, round(quantile_cont(n, 0.95), 6) p95, max(n) largest FROM p), t AS (SELECT round(sum(length(text) - length(replace(text, '�', ''))) / greatest(sum(length(text)), 1), 8)::DOUBLE lost_ratio, round(avg(coalesce(is_noise::INT, 0)), 6) noise_ratio FROM chunks)
SELECT *, lost_ratio <= 0.005 AND noise_ratio <= 0.01 AND bad_parents = 0 AND p95 <= 10 AND largest <= 20 passes FROM t, a""",
    "d12_runs": """WITH q AS (SELECT id run_id, length(question) base_chars FROM test_questions), f AS (SELECT query_id run_id, max(fused_score) fused_score FROM retrieval_results GROUP BY 1), w AS (SELECT query_id run_id, count(*) words_n FROM retrieval_results WHERE bm25_score IS NOT NULL GROUP BY 1)
SELECT run_id, base_chars, fused_score, words_n FROM q FULL JOIN f USING (run_id) FULL JOIN w USING (run_id)""",
    "o13_hits_by": _R + f""", q AS (SELECT id query_id, list_distinct(list_filter(list_transform(string_split(gold_relevant_ids, '|'), lambda x: trim(x)), lambda x: length(x) > 0)) l, list_filter(list_transform(string_split(gold_relevant_ids, '|'), lambda x: trim(x)), lambda x: length(x) > 0)[1] chunk_id FROM test_questions WHERE gold_relevant_ids IS NOT NULL),
c AS (SELECT chunk_id, arg_min(source_id, ord) s, arg_min(parent_id, ord) p, arg_min(left(text, 500), ord) t FROM chunks GROUP BY 1)
SELECT query_id, max(coalesce((r.source_id = s)::INT, 0))::BIGINT source_hit, max(coalesce((r.parent_id = p)::INT, 0))::BIGINT parent_hit, max(coalesce(({_FLAT.format('lower(r.text)')} = {_FLAT.format('lower(t)')})::INT, 0))::BIGINT text_hit FROM q JOIN c USING (chunk_id) LEFT JOIN (SELECT * FROM r WHERE rank < 10) r USING (query_id) GROUP BY 1""",
    "a30_last_parents": "SELECT parent_id, arg_max(chunk_id, ord) chunk_id, arg_max(title, ord) title FROM chunks GROUP BY 1",
    "b26_explained": f"SELECT id, question AS original, nfc_normalize(question) composed, lower(nfc_normalize(question)) lowered, {_FLAT.format('lower(nfc_normalize(question))')} normalised, replace(strip_accents({_FLAT.format('lower(nfc_normalize(question))')}), 'đ', 'd') folded FROM test_questions WHERE question IS NOT NULL",
}
