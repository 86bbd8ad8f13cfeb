"""Context from parents and children: relevance, exclusion, windows, focus, headed blocks within a budget, final evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yarrow.common import table
from yarrow.functions import text as T
from yarrow.operators.answers import dominant_term
from yarrow.operators.reports import STOP

#: Words that mark a parent as being about something else, folded; replaceable.
OFF_TOPIC = ["muc luc", "tai lieu tham khao", "table of contents", "copyright"]


def _held(text: Column, terms: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def relevant_parents(
    results: DataFrame, queries: DataFrame, parents: DataFrame, stop: list[str] = STOP, off_topic: list[str] = OFF_TOPIC, how: str = "max", topk: int = 4, most: int = 3
) -> DataFrame:
    """M3, M4, M5, C14: the parents of each query's results that its context is made of, with position ``p`` from 1.

    results: (query_id, rank, chunk_id, parent_id, source_id, child_index, score, text); parents: (parent_id, parent_text). Relevance is
    the score of the best child (``how`` = 'max') or of the best two, plus 0.02 for each further child up to three, 0.03 times the part
    of the query's terms that the parent holds, 0.04 more or less for the dominant term, 0.1 less for an off-topic mark. Excluded are
    parents with no term at all, with a single child below 0.75 of the best score, or off topic with no more than one child; if
    that leaves none, all stay. One more than the limit stays if any beyond it has two children and 0.9 of the best
    relevance. Rows without a parent are grouped by source. The parents' texts must be bounded, as chunking makes them.
    """
    terms = queries.select("query_id", T.query_terms(F.col("query"), stop).alias("terms"))
    rows = results.withColumn("pid", F.coalesce(F.nullif("parent_id", F.lit("")), "source_id", F.lit("unknown")))
    best = F.sort_array(F.collect_list("score"), asc=False)
    score = best[0] if how == "max" else F.aggregate(F.slice(best, 1, 2), F.lit(0.0), lambda a, x: a + x)
    first_two = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "rank", F.coalesce("text", F.lit("")).alias("t")))), 1, 2)
    grouped = rows.groupBy("query_id", "pid").agg(score.alias("base"), best[0].alias("top1"), F.count(F.lit(1)).alias("support"), F.min("rank").alias("first_rank"), F.array_join(F.transform(first_two, lambda x: x["t"]), " ").alias("shown"))
    main = dominant_term(queries, results, stop).select("query_id", F.col("term").alias("main"))
    full = grouped.join(parents.select(F.col("parent_id").alias("pid"), "parent_text"), "pid", "left").join(terms, "query_id").join(main, "query_id", "left")
    text = T.fold_accents(F.lower(F.when(F.length("parent_text") > 0, F.col("parent_text")).otherwise(F.col("shown"))))
    full = full.withColumn("_t", text).withColumns({
        "hits": _held(F.col("_t"), F.col("terms")), "has_main": F.coalesce(F.contains("_t", "main"), F.lit(False)), "off": F.lit(False) if not off_topic else F.col("_t").rlike("|".join(off_topic)),
    })
    ratio = F.when(F.size("terms") > 0, F.col("hits") / F.size("terms")).otherwise(0.0)
    relevance = F.col("base") + 0.02 * F.least(F.lit(3), F.col("support") - 1) + 0.03 * ratio + F.when(F.col("has_main"), 0.04).otherwise(-0.04) - F.when(F.col("off"), 0.1).otherwise(0.0)
    whole = Window.partitionBy("query_id")
    reasons = F.array_compact(F.array(
        F.when((F.col("hits") == 0) & ~F.col("has_main"), "no query overlap"), F.when((F.col("support") == 1) & (F.col("top1") < 0.75 * F.max("base").over(whole)), "single weak support"), F.when(F.col("off") & (F.col("support") <= 1), "off topic"),
    ))
    judged = full.select("query_id", "pid", "base", "support", "first_rank", "terms", "parent_text", F.round(relevance, 6).alias("relevance"), reasons.alias("reasons"))
    judged = judged.withColumn("_any", F.max(F.size("reasons") == 0).over(whole)).where((F.size("reasons") == 0) | ~F.col("_any"))
    order = whole.orderBy(F.desc("relevance"), F.desc("base"), "first_rank", "pid")
    limit = max(1, min(topk, most))
    placed = judged.withColumn("p", F.row_number().over(order)).withColumn("_best", F.max("relevance").over(whole))
    extra = F.max((F.col("p") > limit) & (F.col("support") >= 2) & (F.col("relevance") >= 0.9 * F.col("_best"))).over(whole)
    return placed.withColumn("_keep", limit + F.when(extra, 1).otherwise(0)).where(F.col("p") <= F.col("_keep")).drop("_keep", "_best", "_any")


def _merged(ranges: Column) -> Column:
    """F5 on an array of half-open ranges."""
    kind = "array<struct<lo:int,hi:int>>"
    return F.aggregate(
        F.array_sort(ranges), F.array().cast(kind),
        lambda done, x: F.when((F.size(done) > 0) & (x["lo"] <= F.element_at(done, -1)["hi"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["lo"].alias("lo"), F.greatest(F.element_at(done, -1)["hi"], x["hi"]).alias("hi"))))).otherwise(F.concat(done, F.array(x))),
    )


def spans(parents: DataFrame, results: DataFrame, window: int = 1, centers: int = 2, focus: str = "focused") -> DataFrame:
    """M6: merged windows around each parent's best children, over the parts of its text.

    broad: from the first window to the end; focused: from the first to the last part in them that holds a term of the query, and one
    more. parent_text is children joined by blank lines, and so are the parts of a child: an index counts parts, as it always has.
    """
    at = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "rank", F.col("child_index").cast("int").alias("c")))), 1, centers)
    middle = results.withColumn("pid", F.coalesce(F.nullif("parent_id", F.lit("")), "source_id", F.lit("unknown"))).where("child_index IS NOT NULL").groupBy("query_id", "pid").agg(F.transform(at, lambda x: x["c"]).alias("centers"))
    rows = parents.join(middle, ["query_id", "pid"], "left").withColumn("parts", F.split("parent_text", "\n\n"))
    size = F.size("parts")
    around = lambda c: F.struct(F.greatest(F.lit(0), c - window).alias("lo"), F.least(size, c + window + 1).alias("hi"))
    holds = lambda i: F.exists("terms", lambda t: F.contains(T.fold_accents(F.lower(F.get("parts", i))), t))
    own = F.filter(F.transform(F.coalesce("centers", F.array().cast("array<int>")), around), lambda r: r["lo"] < r["hi"])
    by_term = F.transform(F.slice(F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), holds), 1, max(1, centers)), around)
    none = F.array(F.struct(F.lit(0).alias("lo"), F.least(size, F.lit(max(1, 2 * window + 1))).alias("hi")))
    ranges = _merged(F.when(F.size(own) > 0, own).when(F.size(by_term) > 0, by_term).otherwise(none))
    rows = rows.where(F.length("parent_text") > 0).withColumn("ranges", ranges)
    if focus == "broad":
        return rows.withColumn("ranges", F.array(F.struct(F.col("ranges")[0]["lo"].alias("lo"), size.alias("hi"))))
    inside = F.flatten(F.transform("ranges", lambda r: F.sequence(r["lo"], r["hi"] - 1)))
    rows = rows.withColumn("_hit", F.filter(inside, holds))
    narrow = F.array(F.struct(F.array_min("_hit").alias("lo"), F.least(size, F.array_max("_hit") + 1 + min(1, window)).alias("hi")))
    return rows.withColumn("ranges", F.when(F.size("_hit") > 0, narrow).otherwise(F.col("ranges"))).drop("_hit")


def blocks(placed: DataFrame, meta: DataFrame, budget: int = 3500, least: int = 50) -> DataFrame:
    """(query_id, context, words_used, blocks): headed blocks in the order of the parents, equal ones once, until the budget of words.

    The block that overflows is cut to what is left if that is more than ``least`` words; nothing follows it.
    """
    body = F.array_join(F.transform("ranges", lambda r: F.array_join(F.slice("parts", r["lo"] + 1, r["hi"] - r["lo"]), "\n\n")), "\n\n")
    rows = placed.withColumn("body", body).where(F.length(F.trim("body")) > 0).join(meta.select(F.col("parent_id").alias("pid"), "doc_type", "title"), "pid", "left")
    first = Window.partitionBy("query_id", "body").orderBy("p")
    rows = rows.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    head = F.concat(F.lit("### ["), F.coalesce("doc_type", F.lit("")), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" (parent_id="), F.col("pid"), F.lit(")\n"))
    one = rows.select("query_id", "p", head.alias("h"), F.filter(F.split("body", " "), lambda w: F.length(w) > 0).alias("w"))
    listed = one.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("p", "h", "w"))).alias("b"))
    state = "struct<t:array<string>,used:int,stop:boolean>"
    fold = f"""aggregate(b, CAST(named_struct('t', array(), 'used', 0, 'stop', false) AS {state}), (s, x) -> CASE WHEN s.stop THEN s
WHEN s.used + size(x.w) <= {budget} THEN named_struct('t', concat(s.t, array(concat(x.h, array_join(x.w, ' ')))), 'used', s.used + size(x.w), 'stop', false)
WHEN {budget} - s.used > {least} THEN named_struct('t', concat(s.t, array(concat(x.h, array_join(slice(x.w, 1, {budget} - s.used), ' ')))), 'used', {budget}, 'stop', true)
ELSE named_struct('t', s.t, 'used', s.used, 'stop', true) END)"""
    return listed.select("query_id", F.expr(fold).alias("s")).select("query_id", F.array_join("s.t", "\n\n---\n\n").alias("context"), F.col("s.used").alias("words_used"), F.size("s.t").alias("blocks"))


def final_evidence(placed: DataFrame, results: DataFrame) -> DataFrame:
    """M8: (query_id, chunk_id, p) of the results inside their parent's windows, or of all of a parent's if none is; each chunk once."""
    rows = results.withColumn("pid", F.coalesce(F.nullif("parent_id", F.lit("")), "source_id", F.lit("unknown"))).join(placed.select("query_id", "pid", "p", "ranges"), ["query_id", "pid"])
    rows = rows.withColumn("inside", F.coalesce(F.exists("ranges", lambda r: (r["lo"] <= F.col("child_index")) & (F.col("child_index") < r["hi"])), F.lit(False)))
    rows = rows.withColumn("_some", F.max("inside").over(Window.partitionBy("query_id", "pid"))).where(F.col("inside") | ~F.col("_some"))
    return rows.groupBy("query_id", "chunk_id").agg(F.min("p").alias("p"))


def parent_context(results: DataFrame, queries: DataFrame, parents: DataFrame, budget: int = 3500, focus: str = "focused", window: int = 1, centers: int = 2, **limits) -> tuple[DataFrame, DataFrame]:
    """M1: (one context a query, its final evidence). parents: (parent_id, parent_text, doc_type, title).

    Queries without results have no row; parents whose text is missing give no block.
    """
    placed = spans(relevant_parents(results, queries, parents, **limits), results, window, centers, focus)
    return blocks(placed, parents, budget), final_evidence(placed, results)


def flat_context(results: DataFrame, budget: int = 3500) -> DataFrame:
    """M2: texts by rank until the first that would overflow the budget of words."""
    rows = results.where(F.length(F.trim("text")) > 0).withColumn("_n", F.size(F.split(T.collapse(F.col("text")), " ")))
    upto = F.sum("_n").over(Window.partitionBy("query_id").orderBy("rank", "chunk_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = rows.withColumn("_u", upto).where(F.col("_u") <= budget)
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))), lambda x: x["text"]), "\n\n---\n\n").alias("context"), F.max("_u").alias("words_used"), F.count(F.lit(1)).alias("blocks"))


# --- queries ------------------------------------------------------------------------------------------------------


def _parents(spark, d):
    """The parents that some result has, with their texts; the others are left out before their texts are joined."""
    c = table(spark, d, "chunks").select("parent_id", "child_index", "ord", "text", "doc_type", "title")
    asked = table(spark, d, "retrieval_results").select("parent_id").distinct()
    kids = F.array_sort(F.collect_list(F.struct("child_index", "ord", "text")))
    return c.join(asked, "parent_id", "left_semi").groupBy("parent_id").agg(F.array_join(F.transform(kids, lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("parent_text"), F.min_by("doc_type", "ord").alias("doc_type"), F.min_by("title", "ord").alias("title"))


def _inputs(spark, d):
    from yarrow.operators.evidence import _queries, _results

    return _results(spark, d).where("rank < 8"), _queries(spark, d), _parents(spark, d)


def m3_parents(spark, d):
    """The parents that every query's context is made of."""
    return relevant_parents(*_inputs(spark, d)).select("query_id", F.col("pid").alias("parent_id"), F.col("p").cast("bigint").alias("p"), "relevance", F.col("support").cast("bigint").alias("support"))


def m6_spans(spark, d):
    """Windows of every query's parents as text."""
    r, q, p = _inputs(spark, d)
    return spans(relevant_parents(r, q, p), r).select("query_id", F.col("pid").alias("parent_id"), F.array_join(F.transform("ranges", lambda x: F.concat_ws("-", x["lo"].cast("string"), x["hi"].cast("string"))), ",").alias("ranges"))


def m7_context(spark, d):
    """Words and blocks of every query's context."""
    context, _ = parent_context(*_inputs(spark, d), budget=600)
    return context.select("query_id", F.col("words_used").cast("bigint").alias("words_used"), F.col("blocks").cast("bigint").alias("blocks"), F.md5("context").alias("digest"))


def m8_evidence(spark, d):
    """Final evidence of every query."""
    _, evidence = parent_context(*_inputs(spark, d))
    return evidence.select("query_id", "chunk_id", F.col("p").cast("bigint").alias("p"))


def m2_flat(spark, d):
    """Flat context of every query."""
    r, _, _ = _inputs(spark, d)
    return flat_context(r, 300).select("query_id", F.col("words_used").cast("bigint").alias("words_used"), F.col("blocks").cast("bigint").alias("blocks"), F.md5("context").alias("digest"))


QUERIES = {f.__name__: f for f in (m2_flat, m3_parents, m6_spans, m7_context, m8_evidence)}
_FOLD = "replace(replace(strip_accents(lower({0})), 'đ', 'd'), 'Đ', 'D')"
_STOP = ", ".join(f"'{w}'" for w in STOP)
_WS = r"[ \t\n\r\f\x0B]+"
_BASE = f"""
WITH r0 AS (SELECT query_id, chunk_id, max(fused_score) score, min(parent_id) parent_id, min(source_id) source_id, min(child_index) child_index, min(text) text FROM retrieval_results GROUP BY ALL),
r AS (SELECT *, coalesce(nullif(parent_id, ''), source_id, 'unknown') pid FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 rank FROM r0) WHERE rank < 8),
par AS (SELECT parent_id pid, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY child_index, ord) parent_text, arg_min(doc_type, ord) doc_type, arg_min(title, ord) title FROM chunks GROUP BY 1),
q AS (SELECT id query_id, list_filter(regexp_extract_all({_FOLD.format("coalesce(question, '')")}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 2 AND x NOT IN ({_STOP})) t FROM test_questions),
qt AS (SELECT query_id, term, min(i) i FROM (SELECT query_id, unnest(t) term, unnest(range(len(t))) i FROM q) GROUP BY ALL),
dom AS (SELECT query_id, term main FROM (SELECT qt.query_id, term, row_number() OVER (PARTITION BY qt.query_id ORDER BY count(*) FILTER (contains({_FOLD.format("r.text")}, term)) DESC, i) k FROM qt LEFT JOIN r USING (query_id) GROUP BY qt.query_id, term, i) WHERE k = 1),
g AS (SELECT query_id, pid, max(score) base, count(*) support, min(rank) first_rank, list(text ORDER BY score DESC, rank)[1:2] two FROM r GROUP BY ALL),
f AS (SELECT g.*, parent_text, list_distinct(q.t) terms, main, {_FOLD.format("CASE WHEN length(parent_text) > 0 THEN parent_text ELSE array_to_string(list_transform(two, lambda x: coalesce(x, '')), ' ') END")} tx FROM g JOIN q USING (query_id) LEFT JOIN dom USING (query_id) LEFT JOIN par USING (pid)),
h AS (SELECT *, len(list_filter(terms, lambda x: contains(tx, x))) hits, coalesce(contains(tx, main), false) has_main, regexp_matches(tx, '{"|".join(OFF_TOPIC)}') off FROM f),
j AS (SELECT *, round(base + 0.02 * least(3, support - 1) + 0.03 * CASE WHEN len(terms) > 0 THEN hits / len(terms) ELSE 0 END + CASE WHEN has_main THEN 0.04 ELSE -0.04 END - CASE WHEN off THEN 0.1 ELSE 0 END, 6) relevance,
  (hits = 0 AND NOT has_main) OR (support = 1 AND base < 0.75 * max(base) OVER (PARTITION BY query_id)) OR (off AND support <= 1) bad FROM h),
k AS (SELECT * FROM (SELECT *, bool_or(NOT bad) OVER (PARTITION BY query_id) anyok FROM j) WHERE NOT bad OR NOT anyok),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, base DESC, first_rank, pid) p, max(relevance) OVER (PARTITION BY query_id) best FROM k),
kept AS (SELECT * FROM (SELECT *, bool_or(p > 3 AND support >= 2 AND relevance >= 0.9 * best) OVER (PARTITION BY query_id) extra FROM o) WHERE p <= 3 + CASE WHEN extra THEN 1 ELSE 0 END)
"""
SQL = {
    "m3_parents": _BASE + "SELECT query_id, pid parent_id, p, relevance, support FROM kept",
    "m2_flat": _BASE + f""", n AS (SELECT *, len(string_split(regexp_replace(regexp_replace(text, '{_WS}', ' ', 'g'), '^ | $', '', 'g'), ' ')) n FROM r WHERE length(trim(text)) > 0),
u AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY rank, chunk_id ROWS UNBOUNDED PRECEDING) u FROM n)
SELECT query_id, max(u)::BIGINT words_used, count(*) blocks, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank, chunk_id)) digest FROM u WHERE u <= 300 GROUP BY 1""",
}
