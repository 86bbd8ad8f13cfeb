"""Counts, quality reports, vector statistics, lexicon mining and the scalar functions' queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yarrow.common import spread, table
from yarrow.functions import text as T

#: The part of the tables' paths behind which the category stands; a parameter of ``text.category``.
ANCHOR = "TT_DUOC"
STOP = ["la", "va", "cua", "cho", "co", "khong", "the", "nao", "gi", "o", "khi", "thi", "de", "voi", "cac", "mot"]


def diacritic_lexicon(df: DataFrame, text: str) -> DataFrame:
    """Folded word to its most frequent accented form, ties by the smaller form; two pre-aggregated counts."""
    words = df.where(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{M}]+)"))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("folded", T.fold_accents(F.col("word")))
    return counts.groupBy("folded").agg(F.max("n").alias("n"), F.min_by("word", F.struct(-F.col("n"), F.col("word"))).alias("word"))


def restore_accents(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """K6, K7: (query_id, restored, n_changed, confidence): words without accents take the lexicon's form, others stay.

    The lexicon is joined by word, never broadcast whole; K8's band is ``band``.
    """
    words = queries.select("query_id", F.posexplode(F.split(T.collapse(F.lower(F.col("query"))), " ")).alias("i", "w"))
    joined = words.join(lexicon.select(F.col("folded").alias("w"), "word"), "w", "left")
    joined = joined.withColumn("new", F.when(F.col("w") == T.fold_accents(F.col("w")), F.coalesce("word", "w")).otherwise(F.col("w")))
    changed = F.count_if(F.col("new") != F.col("w"))
    out = joined.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]), " ").alias("restored"), changed.alias("n_changed"), F.count(F.lit(1)).alias("n"))
    ratio = F.col("n_changed") / F.col("n")
    confidence = F.when(F.col("n_changed") == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.20 + 0.65 * ratio + 0.15 * F.least(ratio, F.lit(0.4))))
    return out.select("query_id", "restored", "n_changed", F.round(confidence, 6).alias("confidence"))


def band(confidence: Column) -> Column:
    """K8."""
    return F.when(confidence >= 0.65, "high").when(confidence >= 0.35, "medium").when(confidence > 0, "low").otherwise("none")


# --- queries ------------------------------------------------------------------------------------------------------


def e1_by_type(spark, d):
    return table(spark, d, "raw_passages").groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


def e5_distinct(spark, d):
    c = table(spark, d, "chunks")
    return c.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("chunk_ids"), F.countDistinct("source_id").alias("sources"), F.countDistinct("parent_id").alias("parents"))


def e6_noise(spark, d):
    c = table(spark, d, "chunks")
    return c.groupBy("doc_type").agg(F.count_if("is_noise").alias("noise"), F.round(F.count_if("is_noise") / F.count(F.lit(1)), 4).alias("noise_ratio"), F.count_if(F.col("is_noise").isNull()).alias("unknown"))


def e7_bad_ratio_top(spark, d):
    """The five files with the highest mean ratio of odd signs, over rows that have any."""
    r = table(spark, d, "raw_passages").where("text IS NOT NULL").select("file_path", T.encoding_noise(F.col("text"))["bad_ratio"].alias("x")).where("x > 0")
    return r.groupBy("file_path").agg(F.round(F.avg("x"), 6).alias("mean_bad")).orderBy(F.desc("mean_bad"), "file_path").limit(5)


def b10_encoding_noise(spark, d):
    r = table(spark, d, "raw_passages").where("text IS NOT NULL")
    n = T.encoding_noise(F.col("text"))
    return r.select("ord", F.round(n["lost_ratio"], 6).alias("lost_ratio"), n["has_cyrillic"].alias("has_cyrillic"))


def b2_hashes(spark, d):
    c = table(spark, d, "chunks")
    return c.select("ord", T.short_hash(F.col("chunk_id")).alias("short"), T.point_id(F.col("chunk_id")).cast("string").alias("point"), T.fingerprint(F.col("parent_id")).alias("print"))


def b3_point_check(spark, d):
    """Points whose stored id is not the one made from their chunk id."""
    return table(spark, d, "points").where(F.col("point_id") != T.point_id(F.col("chunk_id"))).select("chunk_id")


def b4_category(spark, d):
    s = table(spark, d, "sources")
    return s.select("source_id", T.category(F.col("file_path"), ANCHOR).alias("category"), T.doc_type(F.col("file_path")).alias("by_name"))


def b6_clean(spark, d):
    r = spread(table(spark, d, "raw_passages").select("ord", "text", "ocr_confidence"))
    return r.select("ord", F.md5(T.clean_passage(F.col("text"))).alias("digest"), (F.col("ocr_confidence") < 0.75).alias("low_confidence"))


def b8_clean_chunks(spark, d):
    c = spread(table(spark, d, "chunks").select("ord", "text", "doc_type"))
    return c.select("ord", F.md5(T.clean_chunk(F.col("text"), F.col("doc_type"))).alias("digest"), T.chunk_is_noise(F.col("text"), F.col("doc_type")).alias("is_noise"))


def b11_noise(spark, d):
    return table(spark, d, "chunks").where(T.is_noise(F.col("text"))).select("ord")


def b20_legacy_fonts(spark, d):
    return table(spark, d, "raw_passages").where(T.garbled_legacy_font(F.col("text"))).select("ord")


def b22_page_numbers(spark, d):
    r = table(spark, d, "raw_passages").where("text IS NOT NULL")
    return r.select("ord", (F.length("text") - F.length(T.strip_page_numbers(F.col("text")))).cast("bigint").alias("dropped"))


def b24_normalised(spark, d):
    q = table(spark, d, "test_questions").where("question IS NOT NULL")
    return q.select("id", T.normalise_query(F.col("question")).alias("normalised"), T.normalise_query_plain(F.col("question")).alias("plain"))


def b30_keywords(spark, d):
    q = table(spark, d, "test_questions").where("question IS NOT NULL")
    return q.select("id", F.array_join(T.keywords(F.col("question"), 5), " ").alias("keywords"))


def b31_terms(spark, d):
    q = table(spark, d, "test_questions").where("question IS NOT NULL")
    return q.select("id", F.array_join(T.query_terms(F.col("question"), STOP), " ").alias("terms"))


def b32_snippets(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


def b43_partly_folded(spark, d):
    return table(spark, d, "test_questions").where("question IS NOT NULL").select("id", T.partly_folded(F.col("question")).alias("mutated"))


def b44_gold_ids(spark, d):
    return table(spark, d, "test_questions").where("gold_relevant_ids IS NOT NULL").select("id", F.size(T.id_list(F.col("gold_relevant_ids"))).cast("bigint").alias("n_ids"))


def e10_lexicon(spark, d):
    return diacritic_lexicon(table(spark, d, "chunks"), "text")


def k6_restored(spark, d):
    q = table(spark, d, "test_questions").where("question IS NOT NULL").select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    return restore_accents(q, diacritic_lexicon(table(spark, d, "chunks"), "text")).withColumn("band", band(F.col("confidence")))


def o17_mined_pairs(spark, d):
    """Frequent pairs of words, folded and as written; counts are pre-aggregated before each exchange."""
    w = table(spark, d, "chunks").where("text IS NOT NULL").select(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{M}]+)")).alias("w"))
    pairs = w.where("size(w) > 1").select(F.explode(F.expr("transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))")).alias("accented"))
    return pairs.groupBy("accented").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select(T.fold_accents(F.col("accented")).alias("folded"), "accented", "n")


def e18_vector_norms(spark, d):
    v = table(spark, d, "embeddings").select("label", T.norm(F.col("embedding")).alias("x"))
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.round(f("x"), 6).alias(name) for name, f in (("mean_norm", F.avg), ("std_norm", F.stddev_pop), ("min_norm", F.min), ("max_norm", F.max))], F.round(F.percentile("x", F.lit(0.5)), 6).alias("median_norm"))


def e19_group_cosine(spark, d):
    """Mean cosine inside and between groups for all pairs, from group sums: no pair is ever formed.

    For unit vectors the sum of all cosines of two groups is the product of their vector sums.
    """
    v = table(spark, d, "embeddings").select("label", T.norm(F.col("embedding")).alias("n"), F.posexplode("embedding").alias("i", "x"))
    sums = v.groupBy("label", "i").agg(F.sum(F.col("x").cast("double") / F.col("n")).alias("s"))
    sizes = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    a, b = sums.alias("a"), sums.alias("b")
    dots = a.join(b, F.col("a.i") == F.col("b.i")).where("a.label <= b.label").groupBy(F.col("a.label").alias("g"), F.col("b.label").alias("h")).agg(F.sum(F.col("a.s") * F.col("b.s")).alias("dot"))
    n, m = sizes.select(F.col("label").alias("g"), F.col("k").alias("kg")), sizes.select(F.col("label").alias("h"), F.col("k").alias("kh"))
    same = F.col("g") == F.col("h")
    return dots.join(n, "g").join(m, "h").select("g", "h", F.round(F.when(same, (F.col("dot") - F.col("kg")) / (F.col("kg") * (F.col("kg") - 1))).otherwise(F.col("dot") / (F.col("kg") * F.col("kh"))), 5).alias("mean_cosine"))


def o5_coverage(spark, d):
    c = table(spark, d, "chunks").select("chunk_id").distinct().withColumn("in_chunks", F.lit(1))
    p = table(spark, d, "points").select("chunk_id").distinct().withColumn("in_points", F.lit(1))
    return c.join(p, "chunk_id", "full_outer").agg(F.count_if(F.col("in_chunks").isNotNull()).alias("chunks"), F.count_if(F.col("in_points").isNotNull()).alias("points"), F.count_if(F.col("in_chunks").isNotNull() & F.col("in_points").isNotNull()).alias("both"))


def o11_case_studies(spark, d):
    """For each label the first question that mentions a number, else the first at all."""
    q = table(spark, d, "test_questions").where("question IS NOT NULL").withColumn("label", F.coalesce(F.lower(F.trim("gold_label")), F.lit("")))
    return q.groupBy("label").agg(F.min_by("id", F.struct((~F.col("question").rlike("[0-9]")).cast("int").alias("p"), F.col("id"))).alias("id"))


def g4_sample(spark, d):
    """Seeded sample without replacement: the 50 questions with the least hash; the same on every run."""
    return table(spark, d, "test_questions").select("id", F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))).alias("h")).orderBy("h", "id").limit(50).select("id")


def g7_error_samples(spark, d):
    """The first twenty passages of each kind of defect with the text around it; the limit runs before the exchange."""
    r = table(spark, d, "raw_passages").where("text IS NOT NULL")
    kinds = F.filter(F.array(*[F.when(F.col("text").contains(sign), F.struct(F.lit(name).alias("kind"), F.locate(sign, F.col("text")).alias("at"))) for name, sign in (("lost", "�"), ("page break", "\f"), ("bar", "|"))]), lambda x: x.isNotNull())
    rows = r.select("ord", "text", F.explode(kinds).alias("k")).select("ord", "k.kind", F.substring(F.col("text"), F.greatest(F.col("k.at") - 20, F.lit(1)), F.lit(41)).alias("around"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("ord"))).where("n <= 20").select("kind", "ord", "around")


_F = "replace(replace(strip_accents({0}), 'đ', 'd'), 'Đ', 'D')"
_NQ = r"regexp_replace(regexp_replace(lower(nfc_normalize({0})), '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g')"
QUERIES = {f.__name__: f for f in (e1_by_type, e5_distinct, e6_noise, e7_bad_ratio_top, b10_encoding_noise, b2_hashes, b3_point_check, b4_category, b6_clean, b8_clean_chunks, b11_noise, b20_legacy_fonts, b22_page_numbers, b24_normalised, b30_keywords, b31_terms, b32_snippets, b43_partly_folded, b44_gold_ids, e10_lexicon, k6_restored, o17_mined_pairs, e18_vector_norms, e19_group_cosine, o5_coverage, o11_case_studies, g4_sample, g7_error_samples)}
_ODD = "�¤¦§¨©ª¬®¯°±²³´µ¶¸¹º¼½¾×÷"
_NOISE = r"^[\p{P}\p{S}\s_]*([oO0][\p{P}\p{S}\s_0oO]*)?[\p{P}\p{S}\s_]*$"
_STRIP = r"regexp_replace({0}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"
_TERMS = _F.format("lower({0})")
SQL = {
    "b11_noise": f"SELECT ord FROM (SELECT ord, {_STRIP.format('text')} t FROM chunks WHERE text IS NOT NULL) WHERE length(t) < 4 OR regexp_matches(t, '{_NOISE}')",
    "b22_page_numbers": r"""WITH l AS (SELECT ord, text, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*[-–—]*\s*[0-9]{1,4}\s*[-–—]*\s*$')) k FROM raw_passages WHERE text IS NOT NULL)
SELECT ord, (length(text) - length(regexp_replace(array_to_string(k, chr(10)), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')))::BIGINT dropped FROM l""",
    "b30_keywords": r"""WITH w AS (SELECT id, unnest(l) w, unnest(range(len(l))) i FROM (SELECT id, list_transform(regexp_extract_all(question, '\p{L}{3,}'), lambda x: lower(x)) l FROM test_questions WHERE question IS NOT NULL)),
d AS (SELECT id, w, min(i) i FROM w GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(w) DESC, i) n FROM d)
SELECT q.id, coalesce((SELECT string_agg(w, ' ' ORDER BY n) FROM k WHERE k.id = q.id AND n <= 5), '') keywords FROM test_questions q WHERE question IS NOT NULL""",
    "b31_terms": f"""WITH w AS (SELECT id, unnest(l) w, unnest(range(len(l))) i FROM (SELECT id, regexp_extract_all({_TERMS.format('question')}, '[\\p{{L}}\\p{{N}}_]+') l FROM test_questions WHERE question IS NOT NULL)),
d AS (SELECT id, w, min(i) i FROM w WHERE length(w) >= 2 AND w NOT IN ({", ".join(repr(x) for x in STOP)}) GROUP BY 1, 2)
SELECT q.id, coalesce((SELECT string_agg(w, ' ' ORDER BY i) FROM d WHERE d.id = q.id), '') terms FROM test_questions q WHERE question IS NOT NULL""",
    "g7_error_samples": "WITH k AS (" + " UNION ALL ".join(f"SELECT ord, text, '{name}' AS kind, strpos(text, {sign}) pos FROM raw_passages WHERE contains(text, {sign})" for name, sign in (("lost", "'�'"), ("page break", "chr(12)"), ("bar", "'|'"))) + "), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ord) n FROM k) SELECT kind, ord, substring(text, greatest(pos - 20, 1), 41) around FROM n WHERE n <= 20",
    "k6_restored": f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+')) word FROM chunks WHERE text IS NOT NULL), c AS (SELECT word, count(*) n, {_F.format('word')} folded FROM w GROUP BY ALL),
x AS (SELECT folded, arg_min(word, (-n, word)) word FROM c GROUP BY 1), q AS (SELECT id query_id, unnest(l) w, unnest(range(len(l))) i FROM (SELECT id, string_split(regexp_replace(regexp_replace(lower(question), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), '^ | $', '', 'g'), ' ') l FROM test_questions WHERE question IS NOT NULL)),
j AS (SELECT query_id, i, w, CASE WHEN w = {_F.format('w')} THEN coalesce(word, w) ELSE w END new FROM q LEFT JOIN x ON folded = w),
a AS (SELECT query_id, string_agg(new, ' ' ORDER BY i) restored, count(*) FILTER (new <> w) n_changed, count(*) n FROM j GROUP BY 1),
s AS (SELECT query_id, restored, n_changed, round(CASE WHEN n_changed = 0 THEN 0.0 ELSE least(1.0, 0.20 + 0.65 * n_changed / n + 0.15 * least(n_changed / n, 0.4)) END, 6)::DOUBLE confidence FROM a)
SELECT *, CASE WHEN confidence >= 0.65 THEN 'high' WHEN confidence >= 0.35 THEN 'medium' WHEN confidence > 0 THEN 'low' ELSE 'none' END band FROM s""",
    "e1_by_type": "SELECT doc_type, count(*) n FROM raw_passages GROUP BY 1",
    "e5_distinct": "SELECT count(*) n, count(DISTINCT chunk_id) chunk_ids, count(DISTINCT source_id) sources, count(DISTINCT parent_id) parents FROM chunks",
    "e6_noise": "SELECT doc_type, count(*) FILTER (is_noise) noise, round(count(*) FILTER (is_noise) / count(*)::DOUBLE, 4) noise_ratio, count(*) FILTER (is_noise IS NULL) unknown FROM chunks GROUP BY 1",
    "e7_bad_ratio_top": f"WITH x AS (SELECT file_path, (length(text) - length(translate(text, '{_ODD}', '')))::DOUBLE / greatest(length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')), 1) x FROM raw_passages WHERE text IS NOT NULL) SELECT file_path, round(avg(x), 6) mean_bad FROM x WHERE x > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "b10_encoding_noise": "SELECT ord, round((length(text) - length(translate(text, '�', '')))::DOUBLE / greatest(length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')), 1), 6) lost_ratio, regexp_matches(text, '[Ѐ-ӿ]') has_cyrillic FROM raw_passages WHERE text IS NOT NULL",
    "b2_hashes": "SELECT ord, left(sha1(chunk_id), 12) AS short, (('0x' || left(sha1(chunk_id), 16))::UBIGINT)::VARCHAR AS point, 'sha1:' || sha1(parent_id) AS print FROM chunks",
    "b3_point_check": "SELECT chunk_id FROM points WHERE point_id <> (('0x' || left(sha1(chunk_id), 16))::UBIGINT)::DECIMAL(20,0)",
    "b4_category": "SELECT source_id, CASE WHEN length(regexp_extract(file_path, '/TT_DUOC/([^/]+)/', 1)) > 0 THEN regexp_extract(file_path, '/TT_DUOC/([^/]+)/', 1) ELSE 'unknown' END category, CASE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'doc' THEN 'docx' WHEN 'txt' THEN 'txt' WHEN 'png' THEN 'image' WHEN 'jpg' THEN 'image' WHEN 'jpeg' THEN 'image' WHEN 'tif' THEN 'image' WHEN 'tiff' THEN 'image' WHEN 'bmp' THEN 'image' WHEN 'webp' THEN 'image' ELSE 'other' END by_name FROM sources",
    "b20_legacy_fonts": "WITH x AS (SELECT ord, length(text) n, length(text) - length(translate(text, 'µ¸¶·¹®©ª«¬¨' || chr(173), '')) m FROM raw_passages) SELECT ord FROM x WHERE m > 10 OR m::DOUBLE / greatest(n, 1) > 0.02",
    "b24_normalised": f"SELECT id, {_NQ.format('question')} normalised, {_F.format(_NQ.format('question'))} plain FROM test_questions WHERE question IS NOT NULL",
    "b32_snippets": r"WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g') t FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN length(t) > 360 THEN regexp_replace(array_slice(t, 1, 357), '[ \t\n\x0B\f\r]+$', '') || '...' ELSE t END snippet FROM x",
    "b43_partly_folded": f"SELECT id, array_to_string(list_transform(string_split(question, ' '), lambda w, i: CASE WHEN i % 2 = 1 THEN w ELSE {_F.format('w')} END), ' ') mutated FROM test_questions WHERE question IS NOT NULL",
    "b44_gold_ids": "SELECT id, len(list_distinct(list_filter(list_transform(string_split(gold_relevant_ids, '|'), lambda x: trim(x)), lambda x: length(x) > 0)))::BIGINT n_ids FROM test_questions WHERE gold_relevant_ids IS NOT NULL",
    "e10_lexicon": f"WITH c AS (SELECT word, count(*) n FROM (SELECT unnest(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{M}}]+)')) word FROM chunks WHERE text IS NOT NULL) GROUP BY 1), f AS (SELECT *, {_F.format('word')} folded FROM c) SELECT folded, n, word FROM (SELECT *, row_number() OVER (PARTITION BY folded ORDER BY n DESC, word) k FROM f) WHERE k = 1",
    "e18_vector_norms": "WITH v AS (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) x FROM embeddings) SELECT label, count(*) n, round(avg(x), 6) mean_norm, round(stddev_pop(x), 6) std_norm, round(min(x), 6) min_norm, round(max(x), 6) max_norm, round(quantile_cont(x, 0.5), 6) median_norm FROM v GROUP BY 1",
    "e19_group_cosine": "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings) SELECT a.label g, b.label h, round(avg(list_cosine_similarity(a.e, b.e)), 5) mean_cosine FROM v a JOIN v b ON a.label <= b.label AND a.vec_id <> b.vec_id GROUP BY 1, 2",
    "o5_coverage": "WITH c AS (SELECT DISTINCT chunk_id FROM chunks), p AS (SELECT DISTINCT chunk_id FROM points) SELECT count(c.chunk_id) chunks, count(p.chunk_id) points, count(*) FILTER (c.chunk_id IS NOT NULL AND p.chunk_id IS NOT NULL) \"both\" FROM c FULL OUTER JOIN p ON c.chunk_id = p.chunk_id",
    "o11_case_studies": "SELECT label, id FROM (SELECT coalesce(lower(trim(gold_label)), '') label, id, row_number() OVER (PARTITION BY coalesce(lower(trim(gold_label)), '') ORDER BY NOT regexp_matches(question, '[0-9]'), id) k FROM test_questions WHERE question IS NOT NULL) WHERE k = 1",
    "g4_sample": "SELECT id FROM test_questions ORDER BY md5('42:' || id), id LIMIT 50",
    "o17_mined_pairs": f"WITH w AS (SELECT regexp_extract_all(lower(text), '([\\p{{L}}\\p{{M}}]+)') w FROM chunks WHERE text IS NOT NULL), p AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) accented FROM w WHERE len(w) > 1), c AS (SELECT accented, count(*) n FROM p GROUP BY 1 HAVING count(*) >= 5) SELECT {_F.format('accented')} folded, accented, n FROM c",
}
