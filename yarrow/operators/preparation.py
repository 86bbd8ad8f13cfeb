"""Query preparation: accents restored by phrases and by a corpus lexicon, how safe that is, and the variants that are searched."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yarrow.common import table
from yarrow.functions import text as T
from yarrow.operators.reports import band, diacritic_lexicon, restore_accents

_PHRASED = "text string, ones int, twos int, threes int"
#: Words of a query that restoring needs, and the parts of them without accents above which phrases and the lexicon are tried.
LEAST_WORDS, PHRASE_SHARE, GENERAL_SHARE = 2, 0.5, 0.25


def words(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"([\p{L}\p{M}\p{N}_]+)"))


def accent_stats(t: Column) -> Column:
    """Of a normalised text's words with a letter from a to z, how many there are and how many have no accent."""
    some = F.filter(words(t), lambda w: w.rlike("[a-z]"))
    return F.struct(F.size(some).alias("total"), F.size(F.filter(some, lambda w: w == T.fold_accents(w))).alias("plain"))


def needs_restoring(stats: Column, share: float) -> Column:
    """C13."""
    return (stats["total"] >= LEAST_WORDS) & (stats["plain"] / F.greatest(stats["total"], F.lit(1)) >= share)


def phrases_restored(query: Column, phrases: dict[str, str]) -> Column:
    """K3: (text, ones, twos, threes): folded phrases of a lexicon in their accented forms, the longest first, without overlaps, and how
    many of one, two and more words were replaced. Letters are folded one by one, so that every place stays where it is."""
    @F.pandas_udf(_PHRASED)
    def run(s: pd.Series) -> pd.DataFrame:
        import re
        import unicodedata
        from functools import lru_cache

        @lru_cache(maxsize=None)
        def bare(c: str) -> str:
            base = unicodedata.normalize("NFD", c)[0].lower()
            return {"đ": "d"}.get(base, base) if len(base) == 1 else c

        def fold(t: str) -> str:
            return "".join(map(bare, t))

        known = {fold(k): v for k, v in phrases.items()}
        pattern = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, known), key=len, reverse=True)) + r")(?!\w)") if known else None

        def fix(t: str | None) -> tuple[str | None, int, int, int]:
            if t is None or pattern is None:
                return t, 0, 0, 0
            out, at, counts = [], 0, [0, 0, 0]
            for m in pattern.finditer(fold(t)):
                new = known[m.group()]
                if t[m.start() : m.end()] != new:
                    counts[min(len(new.split()), 3) - 1] += 1
                out += [t[at : m.start()], new]
                at = m.end()
            return "".join([*out, t[at:]]), *counts

        return pd.DataFrame([fix(t) for t in s], columns=["text", "ones", "twos", "threes"])

    return run(query)


def phrase_confidence(ones: Column, twos: Column, threes: Column) -> Column:
    """K4: confidence from the numbers of restored phrases of one, two and three or more words."""
    raw = 0.10 + 0.12 * F.least(ones, F.lit(3)) + 0.30 * F.least(twos, F.lit(3)) + 0.42 * F.least(threes, F.lit(2))
    floor = F.when(threes > 0, 0.70).when(twos > 0, 0.36).otherwise(0.0)
    return F.when(ones + twos + threes == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(raw, floor)), 6))


def restore_score(before: Column, after: Column) -> Column:
    """K7: how safely ``after`` restores ``before``: 0 if nothing changed or any base letter did, more for each word that got its accents."""
    old, new = words(before), words(after)
    pairs = F.zip_with(old, new, lambda a, b: F.coalesce(a != b, F.lit(False)).cast("int"))
    changed = F.aggregate(F.slice(pairs, 1, F.least(F.size(old), F.size(new))), F.lit(0), lambda s, x: s + x) + F.abs(F.size(old) - F.size(new))
    count = F.greatest(F.size(old), F.lit(1))
    was, now = accent_stats(before), accent_stats(after)
    total = F.greatest(was["total"], F.lit(1))
    improved = F.greatest(was["plain"] - now["plain"], F.lit(0))
    raw = 0.20 + 0.65 * improved / total + 0.15 * F.least(changed / count, F.lit(0.4))
    raw = raw - F.when(improved == 0, 0.15).otherwise(0.0) - F.when(changed > F.greatest(F.lit(1), F.floor(0.6 * count)), 0.20).otherwise(0.0)
    raw = F.when((now["plain"] <= F.greatest(F.lit(1), F.floor(total / 4))) & (improved >= 2), F.greatest(raw, F.lit(0.72))).when(improved >= 1, F.greatest(raw, F.lit(0.45))).otherwise(raw)
    unsafe = (before == after) | (T.fold_accents(before) != T.fold_accents(after))
    return F.round(F.when(unsafe, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))), 6)


def prepared(queries: DataFrame, phrases: dict[str, str], lexicon: DataFrame | None = None) -> DataFrame:
    """Every query with each stage of its preparation and the variants that are searched.

    The search by words takes the normalised query (bm25_query); that by vectors takes the final one, and the general restoration beside
    it where that is of medium confidence. Phrases are tried where half of the words have no accent, the corpus
    lexicon where a quarter have none and no word has any. A null query counts as empty and has no variant.
    """
    rows = queries.select("query_id", F.coalesce("query", F.lit("")).alias("original"))
    rows = rows.withColumn("normalised", T.normalise_query(F.col("original")))
    rows = rows.withColumns({"folded": T.fold_accents(F.col("normalised")), "stats": accent_stats(F.col("normalised"))})
    rows = rows.withColumn("_ph", phrases_restored(F.col("normalised"), phrases)).withColumns({
        "by_phrase": F.when(needs_restoring(F.col("stats"), PHRASE_SHARE), F.col("_ph.text")).otherwise(F.col("normalised")),
        "phrase_confidence": F.when(needs_restoring(F.col("stats"), PHRASE_SHARE), phrase_confidence(F.col("_ph.ones"), F.col("_ph.twos"), F.col("_ph.threes"))).otherwise(0.0),
    }).drop("_ph")
    bare = (F.col("by_phrase") == T.fold_accents(F.col("by_phrase"))) & needs_restoring(accent_stats(F.col("by_phrase")), GENERAL_SHARE)
    if lexicon is not None:
        rows = rows.withColumn("_bare", bare)
        general = restore_accents(rows.where("_bare").select("query_id", F.col("by_phrase").alias("query")), lexicon).select("query_id", F.col("restored").alias("_general"))
        rows = rows.join(general, "query_id", "left").withColumn("by_lexicon", F.coalesce("_general", "by_phrase")).drop("_general", "_bare")
    else:
        rows = rows.withColumn("by_lexicon", F.col("by_phrase"))
    rows = rows.withColumn("general_confidence", restore_score(F.col("by_phrase"), F.col("by_lexicon")))
    rows = rows.withColumn("general_band", band(F.col("general_confidence")))
    rows = rows.withColumn("final", F.when(F.col("general_band") == "high", F.col("by_lexicon")).otherwise(F.col("by_phrase")))
    variants = F.array("final", F.when(F.col("general_band") == "medium", F.col("by_lexicon")), F.when(F.col("final") != F.col("normalised"), F.col("normalised")))
    rows = rows.withColumns({
        "bm25_query": F.col("normalised"), "vector_variants": F.array_distinct(F.filter(variants, lambda v: v.isNotNull() & (F.length(v) > 0))), "is_restored": F.col("final") != F.col("normalised"), "strategy": F.when(F.col("general_band") == "high", "lexicon").when(F.col("by_phrase") != F.col("normalised"), "phrases").otherwise("none"),
        "words_total": F.col("stats.total"), "words_plain": F.col("stats.plain"), "left_plain": accent_stats(F.col("final"))["plain"], "phrase_band": band(F.col("phrase_confidence")),
    })
    return rows.drop("stats")


def variant_queries(ready: DataFrame) -> DataFrame:
    """(query_id, variant, query) of every vector variant."""
    return ready.select("query_id", F.posexplode("vector_variants").alias("variant", "query"))


# --- queries ------------------------------------------------------------------------------------------------------

PHRASES = {"que chi": "quế chi", "gung tuoi": "gừng tươi", "dau dau": "đau đầu", "ho khan": "ho khan", "mat ngu": "mất ngủ", "cam thao": "cam thảo", "dong y": "đông y", "bai thuoc": "bài thuốc", "co tac dung gi": "có tác dụng gì"}


def _asked(spark, d):
    return table(spark, d, "test_questions").select(F.col("id").alias("query_id"), F.col("question").alias("query"))


def k2_accents(spark, d):
    """Words and unaccented words of every question."""
    q = _asked(spark, d).where("query IS NOT NULL").select("query_id", accent_stats(T.normalise_query(F.col("query"))).alias("s"))
    return q.select("query_id", F.col("s.total").cast("bigint").alias("total"), F.col("s.plain").cast("bigint").alias("plain"), needs_restoring(F.col("s"), PHRASE_SHARE).alias("restorable"))


def k3_phrases(spark, d):
    """Every question with its phrases restored, and how many."""
    q = _asked(spark, d).where("query IS NOT NULL").select("query_id", phrases_restored(T.normalise_query(F.col("query")), PHRASES).alias("r"))
    return q.select("query_id", "r.text", (F.col("r.ones") + F.col("r.twos") + F.col("r.threes")).alias("replaced"), phrase_confidence(F.col("r.ones"), F.col("r.twos"), F.col("r.threes")).alias("confidence"))


def k7_scores(spark, d):
    """Safety of restoring every question from its folded form to its own."""
    q = _asked(spark, d).where("query IS NOT NULL").select("query_id", T.normalise_query(F.col("query")).alias("a"))
    return q.select("query_id", restore_score(T.fold_accents(F.col("a")), F.col("a")).alias("score"), band(restore_score(T.fold_accents(F.col("a")), F.col("a"))).alias("band"))


def k1_prepared(spark, d):
    """Every question's preparation."""
    ready = prepared(_asked(spark, d), PHRASES, diacritic_lexicon(table(spark, d, "chunks"), "text"))
    return ready.select("query_id", "normalised", "final", "strategy", "phrase_confidence", "general_confidence", "general_band", F.size("vector_variants").cast("bigint").alias("variants"))


QUERIES = {f.__name__: f for f in (k1_prepared, k2_accents, k3_phrases, k7_scores)}
_NORM = r"regexp_replace(regexp_replace(lower(nfc_normalize(question)), '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g')"
_FOLD = "replace(strip_accents({0}), 'đ', 'd')"
_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{M}}\p{{N}}_]+')"
_LIST = f"list_filter({_WORDS}, lambda w: regexp_matches(w, '[a-z]'))"
SQL = {
    "k2_accents": f"""WITH n AS (SELECT id query_id, {_NORM} t FROM test_questions WHERE question IS NOT NULL), s AS (SELECT query_id, len({_LIST.format('t')}) total, len(list_filter({_LIST.format('t')}, lambda w: w = {_FOLD.format('w')})) plain FROM n)
SELECT query_id, total, plain, total >= 2 AND plain / greatest(total, 1) >= 0.5 restorable FROM s""",
    "k7_scores": f"""WITH n AS (SELECT id query_id, {_NORM} b, {_FOLD.format(_NORM)} a FROM test_questions WHERE question IS NOT NULL),
s AS (SELECT *, {_WORDS.format('a')} aw, {_WORDS.format('b')} bw, greatest(len({_LIST.format('a')}), 1) total, len(list_filter({_LIST.format('a')}, lambda w: w = {_FOLD.format('w')})) p0, len(list_filter({_LIST.format('b')}, lambda w: w = {_FOLD.format('w')})) p1 FROM n),
c AS (SELECT *, greatest(p0 - p1, 0) improved, greatest(len(aw), 1) cnt, len(list_filter(range(1, least(len(aw), len(bw)) + 1), lambda i: aw[i] <> bw[i])) + abs(len(aw) - len(bw)) changed FROM s),
r AS (SELECT *, 0.20::DOUBLE + 0.65 * improved / total + 0.15 * least(changed / cnt, 0.4) - CASE WHEN improved = 0 THEN 0.15 ELSE 0 END - CASE WHEN changed > greatest(1, floor(0.6 * cnt)) THEN 0.20 ELSE 0 END raw FROM c),
f AS (SELECT *, CASE WHEN p1 <= greatest(1, total // 4) AND improved >= 2 THEN greatest(raw, 0.72) WHEN improved >= 1 THEN greatest(raw, 0.45) ELSE raw END x FROM r),
o AS (SELECT query_id, round(CASE WHEN a = b OR a <> {_FOLD.format('b')} THEN 0.0 ELSE greatest(0, least(1, x)) END, 6)::DOUBLE score FROM f)
SELECT query_id, score, CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.35 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END band FROM o""",
}
