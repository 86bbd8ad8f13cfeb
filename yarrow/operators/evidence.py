"""Answerability gate, context windows, evidence objects and retrieval evaluation, batched by query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yarrow.common import table
from yarrow.functions import text as T

# Parameters of the gate: wordings of our own, in the languages of the corpus, all replaceable.
HIGH_RISK = [
    r"(?:liều|lieu) ?(?:lượng|luong|dùng|dung)?", r"trẻ|tre em|children|enfants", r"thai|pregnan|enceinte", r"ung thư|cancer", r"(?:bao nhiêu|bao nhieu|how much|combien)",
    r"cho con bú|breast-?feed|allait", r"chống chỉ định|contraindic|contre-indic", r"tác dụng phụ|side effect|effets? secondaire", r"ngộ độc|poison|intoxic", r"quá liều|overdos|surdos",
    r"tương tác|interact", r"suy gan|liver failure|insuffisance hépatique", r"suy thận|kidney failure|insuffisance rénale", r"huyết áp|blood pressure|tension artérielle", r"tim mạch|heart|cardia",
    r"tiểu đường|diabet", r"phẫu thuật|surgery|chirurg", r"cấp cứu|emergency|urgence", r"dị ứng|allerg", r"thay thuốc|instead of medicine|à la place",
]
ABSOLUTE = [
    r"khỏi hẳn|khoi han|dứt hẳn", r"100 ?%", r"mọi bệnh|moi benh|every illness", r"always cure|guérit toujours", r"chắc chắn|certainly|certainement", r"hoàn toàn|completely|complètement",
    r"vĩnh viễn|for ever|définitive", r"không bao giờ|never|jamais", r"an toàn tuyệt đối|perfectly safe|sans aucun risque",
]
COUNTER = [
    r"có thể gặp|co the gap|sometimes reported|signalent parfois", r"kỵ với|ky voi", r"tái phát|tai phat", r"không giảm|khong giam", r"thận trọng|with caution|prudence", r"chưa rõ|unclear|mal connu",
    r"tùy (?:người|thể trạng)|depends on|selon", r"không nên|should not|ne doit pas", r"ngừng thuốc|stop taking|arrêter", r"nặng thêm|worsen|aggrav", r"chưa đủ|insufficient|insuffisant", r"đôi khi|sometimes|parfois",
]
#: Patterns of an absolute claim that one text must hold to support it.
SUPPORT = 2


def any_of(column, patterns):
    """One case-insensitive alternation, evaluated once."""
    return F.coalesce(column.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def number_of(column, patterns):
    """C11: how many of the patterns a text holds."""
    return sum(F.coalesce(column.rlike(f"(?i){p}").cast("int"), F.lit(0)) for p in patterns)


def strong_rows(results: DataFrame, topk: int = 8, ratio: float = 0.8, floor: float = 0.012) -> DataFrame:
    """Of the first topk rows of a query those near the best score; one window over the query's few rows."""
    head = results.where(F.col("rank") < topk)
    return head.withColumn("strong", F.col("score") >= F.greatest(F.max("score").over(Window.partitionBy("query_id")) * ratio, F.lit(floor)))


def said(rows: DataFrame) -> DataFrame:
    """What the gate asks of the texts, in their place: found once, before an exchange, so that no text moves for it."""
    return rows.withColumns({"claims": number_of(F.col("text"), ABSOLUTE) >= SUPPORT, "counters": any_of(F.col("text"), COUNTER)}).drop("text")


def gate(results: DataFrame, queries: DataFrame, topk: int = 8, ratio: float = 0.8, floor: float = 0.012, least: int = 2, cites: int = 4) -> DataFrame:
    """E14, F3, section L: one decision a query from (query_id, rank, chunk_id, parent_id, source_id, score, text), or with what ``said`` has for the text.

    Rows without a parent or source agree with no other. Claims are looked for in the strong rows, or in all of the first if none is
    strong: one text must hold SUPPORT of the patterns, and none a counter-signal. Queries without results fail with the reason 'no results'.
    """
    rows = strong_rows(said(results) if "text" in results.columns else results, topk, ratio, floor)
    s = F.col("strong")
    rows = rows.withColumn("seen", s | ~F.max("strong").over(Window.partitionBy("query_id")))

    def by(what: str) -> DataFrame:
        one = rows.where(s & F.col(what).isNotNull()).groupBy("query_id", what).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 9).alias("s"))
        return one.groupBy("query_id").agg(F.max("n").alias(f"most_{what}"), F.max("s").alias(f"sum_{what}"), F.min_by(what, F.struct(-F.col("s"), F.col(what))).alias(f"top_{what}"))

    facts = rows.groupBy("query_id").agg(
        F.count_if(s).alias("evidence"), F.countDistinct(F.when(s, F.col("source_id"))).alias("sources"), F.countDistinct(F.when(s, F.col("parent_id"))).alias("n_parents"),
        F.max("score").alias("top1"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top2"), F.round(F.avg(F.when(s, F.col("score"))), 6).alias("mean_strong"), F.round(F.sum(F.when(s, F.col("score"))), 9).alias("total"),
        F.max(F.col("seen") & F.col("claims")).alias("supported"), F.count_if(F.col("seen") & F.col("counters")).alias("counter"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(s, F.struct("rank", "chunk_id")))), lambda x: x["chunk_id"]), 1, cites).alias("selected"),
    )
    q = queries.select("query_id", any_of(F.col("query"), HIGH_RISK).alias("high_risk"), any_of(F.col("query"), ABSOLUTE).alias("absolute"))
    out = q.join(facts, "query_id", "left").join(by("parent_id"), "query_id", "left").join(by("source_id"), "query_id", "left")
    needed = F.greatest(F.lit(least), F.when(F.col("high_risk"), 3).otherwise(2))
    n = F.coalesce("evidence", F.lit(0))
    agree = (F.coalesce("most_parent_id", F.lit(0)) >= 2) | (F.coalesce("sources", F.lit(0)) >= 2)
    mismatch = F.col("absolute") & (~F.coalesce("supported", F.lit(False)) | (F.coalesce("counter", F.lit(0)) > 0))
    passes = (n >= needed) & (F.least(F.lit(cites), n) >= 2) & agree & ~mismatch
    reason = F.when(F.col("evidence").isNull(), "no results").when(mismatch, "claim not supported").when(passes, "pass").when(n < needed, "too little evidence").otherwise("evidence disagrees")
    return out.select(
        "query_id", passes.alias("passes"), reason.alias("reason"), n.cast("bigint").alias("evidence"), F.coalesce("sources", F.lit(0)).cast("bigint").alias("sources"), F.coalesce("n_parents", F.lit(0)).cast("bigint").alias("parents"),
        F.least(F.lit(cites), n).cast("bigint").alias("predicted_citations"), "top1", F.round(F.col("top1") - F.col("top2"), 6).alias("gap"), "mean_strong", F.round(F.col("sum_parent_id") / F.nullif("total", F.lit(0.0)), 6).alias("concentration"),
        F.col("top_parent_id").alias("top_parent"), F.col("top_source_id").alias("top_source"), F.coalesce("selected", F.array().cast("array<string>")).alias("selected"),
    )


def merged_windows(hits: DataFrame, keys: list[str], at: str, width: int = 1) -> DataFrame:
    """half-open windows around hits, overlapping or touching ones merged; gaps and islands by one window."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    ranges = hits.select(*keys, F.greatest(F.col(at) - width, F.lit(0)).alias("lo"), (F.col(at) + width + 1).alias("hi")).distinct()
    ranges = ranges.withColumn("_new", F.coalesce(F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) < F.col("lo"), F.lit(True)).cast("int"))
    ranges = ranges.withColumn("_island", F.sum("_new").over(w))
    return ranges.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def budgeted(rows: DataFrame, group: str, order: str, size, budget: int) -> DataFrame:
    """rows of a group in order until the first that would overflow the budget."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def context(results: DataFrame, children: DataFrame, width: int = 1, parents_kept: int = 3, budget: int = 600) -> DataFrame:
    """M1 to M8: the best parents' merged child windows as one text a query, within a budget of words.

    results: (query_id, rank, parent_id, child_index, score); children: (parent_id, child_index, ord, text).
    """
    scored = results.groupBy("query_id", "parent_id").agg(F.max("score").alias("s"), F.count(F.lit(1)).alias("n"))
    scored = scored.withColumn("relevance", F.round(F.col("s") + 0.02 * F.least(F.lit(3), F.col("n") - 1), 6))
    ranked = scored.withColumn("p", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "parent_id"))).where(F.col("p") <= parents_kept)
    windows = merged_windows(results, ["query_id", "parent_id"], "child_index", width).join(ranked.select("query_id", "parent_id", "p"), ["query_id", "parent_id"])
    # a window's few places are joined one by one, so a parent of many children and many windows makes no pair of each with each
    places = windows.select("query_id", "parent_id", "p", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("child_index"))
    # one exchange by query serves all that follows, as texts are the bulk of it
    texts = places.join(children.where("text IS NOT NULL"), ["parent_id", "child_index"]).repartition("query_id")
    texts = texts.withColumn("_first", F.row_number().over(Window.partitionBy("query_id", F.xxhash64("text"), "text").orderBy("p", "child_index", "ord"))).where("_first = 1")
    texts = texts.withColumn("o", F.struct("p", "child_index", "ord")).withColumn("words", F.size(F.split(T.collapse(F.col("text")), " ")))
    kept = budgeted(texts, "query_id", "o", F.col("words"), budget)
    return kept.groupBy("query_id").agg(F.concat_ws("\n\n---\n\n", F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda x: x["text"])).alias("context"), F.sum("words").alias("words_used"), F.count(F.lit(1)).alias("blocks"))


def hits(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """The first rank that hits a gold item, hit at k, reciprocal rank; a query without a hit counts with zeros."""
    first = results.join(gold, ["query_id", "item"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return _graded(gold.select("query_id").distinct().join(first, "query_id", "left"), ["query_id"], ks)


def _graded(out: DataFrame, keys: list[str], ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    return out.select(*keys, F.col("first").cast("bigint").alias("first_rank"), *[F.when(F.col("first") < k, 1.0).otherwise(0.0).alias(f"hit{k}") for k in ks], F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0)).alias("rr"))


def hit_summary(per_query: DataFrame, by: list[str]) -> DataFrame:
    names = [c for c in per_query.columns if c.startswith("hit")]
    return per_query.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names], F.round(F.avg("rr"), 6).alias("mrr"))


# --- queries ------------------------------------------------------------------------------------------------------


def _results(spark, d):
    r = table(spark, d, "retrieval_results").groupBy("query_id", "chunk_id").agg(F.max("fused_score").alias("score"), F.min_by("parent_id", "parent_id").alias("parent_id"), F.min("source_id").alias("source_id"), F.min("child_index").alias("child_index"), F.min("text").alias("text"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return r.withColumn("rank", (F.row_number().over(w) - 1).cast("bigint"))


def _queries(spark, d):
    return table(spark, d, "test_questions").select(F.col("id").alias("query_id"), F.coalesce("question", F.lit("")).alias("query"))


def l1_gate(spark, d):
    """A decision for every question over its retrieved rows."""
    return gate(_results(spark, d), _queries(spark, d)).select("query_id", "passes", "reason", "evidence", "sources", "predicted_citations")


def e14_gate_features(spark, d):
    """What every question's decision rests on."""
    g = gate(_results(spark, d), _queries(spark, d)).where("evidence > 0")
    return g.select("query_id", "evidence", "sources", "parents", F.round("top1", 6).alias("top1"), "gap", "mean_strong", "concentration", "top_parent", "top_source")


def e22_answer_rates(spark, d):
    """Percentages of answered and abstained questions, and means over the decided ones; a missing value counts in none."""
    g = gate(_results(spark, d), _queries(spark, d))
    share = lambda c: F.round(100 * F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return g.agg(
        F.count(F.lit(1)).alias("questions"), share(F.col("passes")).alias("answered_pct"), share(~F.col("passes")).alias("abstained_pct"), share(F.col("passes") & (F.col("concentration") >= 0.5)).alias("focused_pct"),
        F.round(F.avg("concentration"), 5).alias("mean_concentration"), F.round(F.avg(F.when(F.col("evidence") > 0, F.col("evidence"))), 6).alias("mean_evidence"),
    )


def e17_gate_summary(spark, d):
    g = gate(_results(spark, d), _queries(spark, d))
    return g.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("predicted_citations"), 6).alias("mean_citations"))


def c9_strong(spark, d):
    return strong_rows(_results(spark, d)).where("strong").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_strong"))


def f5_windows(spark, d):
    """Merged child windows of every query and parent."""
    r = _results(spark, d).select("query_id", "parent_id", F.col("child_index").cast("bigint").alias("child_index"))
    return merged_windows(r, ["query_id", "parent_id"], "child_index")


def m1_context(spark, d):
    kids = table(spark, d, "chunks").select("parent_id", "child_index", "ord", "text")
    return context(_results(spark, d), kids).select("query_id", F.col("words_used").cast("bigint").alias("words_used"), "blocks", F.md5("context").alias("digest"))


def d1_parent_join(spark, d):
    """Retrieved rows with their parents' number of children; rows without a parent stay."""
    p = table(spark, d, "chunks").groupBy("parent_id").agg(F.count(F.lit(1)).alias("children"))
    return _results(spark, d).join(p, "parent_id", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce("children", F.lit(0))).alias("n_children"))


def d10_neighbours(spark, d):
    """Range join: children of the same parent within one place of a retrieved child."""
    kids = table(spark, d, "chunks").select("parent_id", "child_index", "ord")
    r = _results(spark, d).where("rank < 5").select("query_id", "parent_id", F.explode(F.sequence(F.col("child_index") - 1, F.col("child_index") + 1)).alias("child_index"))
    # the range is three places, so it is an equi join on parent and place
    return r.join(kids, ["parent_id", "child_index"]).groupBy("query_id").agg(F.countDistinct("ord").alias("n_near"))


LEVELS = ("chunk_id", "parent_id", "source_id")


def _gold(spark, d):
    return table(spark, d, "test_questions").where("gold_relevant_ids IS NOT NULL").select(F.col("id").alias("query_id"), F.explode(T.id_list(F.col("gold_relevant_ids"))).alias("chunk_id")).distinct()


def e15_hits(spark, d):
    """Hit@k and MRR of chunks, parents and sources over all questions with gold items; each table is read once, the level being a column."""
    level = lambda *names: F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).alias("item")) for n in names])).alias("x")
    where = table(spark, d, "chunks").select("chunk_id", "parent_id", "source_id").distinct()
    # a gold chunk that is in no table any more still counts as a chunk
    gold = _gold(spark, d).join(where, "chunk_id", "left").select("query_id", level(*LEVELS)).select("query_id", "x.level", "x.item").where("item IS NOT NULL").distinct()
    found = _results(spark, d).select("query_id", "rank", level(*LEVELS)).select("query_id", "rank", "x.level", "x.item")
    first = found.join(gold, ["query_id", "level", "item"]).groupBy("query_id", "level").agg(F.min("rank").alias("first"))
    return hit_summary(_graded(gold.select("query_id", "level").distinct().join(first, ["query_id", "level"], "left"), ["query_id", "level"]), ["level"])


def e16_first_hits(spark, d):
    r = _results(spark, d).select("query_id", "rank", F.col("chunk_id").alias("item"))
    return hits(r, _gold(spark, d).select("query_id", F.col("chunk_id").alias("item"))).select("query_id", "first_rank", F.round("rr", 6).alias("rr"))


def o1_failures(spark, d):
    """Questions with gold chunks of which none is among the first ten."""
    return e16_first_hits(spark, d).where("first_rank IS NULL OR first_rank >= 10").select("query_id")


def o10_melt(spark, d):
    return e15_hits(spark, d).unpivot(["level"], ["hit1", "hit3", "hit5", "hit10", "mrr"], "metric", "value")


def n3_evidence(spark, d):
    """Evidence objects E1 to E4 of every query, with snippets."""
    r = _results(spark, d).where("rank < 4")
    return r.select("query_id", F.concat(F.lit("E"), (F.col("rank") + 1).cast("string")).alias("citation_id"), "chunk_id", T.snippet(F.col("text"), 120).alias("snippet"))


_R = """
WITH r0 AS (SELECT query_id, chunk_id, max(fused_score) score, min(parent_id) parent_id, min(source_id) source_id, min(child_index) child_index, min(text) text FROM retrieval_results GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 rank FROM r0)
"""
_S = _R + ", s AS (SELECT *, score >= greatest(max(score) OVER (PARTITION BY query_id) * 0.8, 0.012) strong FROM r WHERE rank < 8)"


def _sql_any(column, patterns):
    return f"coalesce(regexp_matches({column}, '(?i)" + "|".join(f"(?:{p})" for p in patterns) + "'), false)"


def _sql_number(column, patterns):
    return "(" + " + ".join(f"coalesce(regexp_matches({column}, '(?i){p}')::INT, 0)" for p in patterns) + ")"


_G = _S + f""",
bp AS (SELECT query_id, parent_id, count(*) n, round(sum(score), 9) ps FROM s WHERE strong AND parent_id IS NOT NULL GROUP BY ALL), p AS (SELECT query_id, max(n) mp, max(ps) ps, arg_min(parent_id, (-ps, parent_id)) top_parent FROM bp GROUP BY 1),
bs AS (SELECT query_id, source_id, round(sum(score), 9) ss FROM s WHERE strong AND source_id IS NOT NULL GROUP BY ALL), sr AS (SELECT query_id, arg_min(source_id, (-ss, source_id)) top_source FROM bs GROUP BY 1),
s2 AS (SELECT *, strong OR NOT bool_or(strong) OVER (PARTITION BY query_id) seen FROM s),
f AS (SELECT query_id, count(*) FILTER (strong) evidence, count(DISTINCT source_id) FILTER (strong) sources, count(DISTINCT parent_id) FILTER (strong) parents, max(score) top1, max(score) FILTER (rank = 1) top2, round(avg(score) FILTER (strong), 6) mean_strong, round(sum(score) FILTER (strong), 9) total,
  bool_or({_sql_number('text', ABSOLUTE)} >= {SUPPORT}) FILTER (seen) supported, count(*) FILTER (seen AND {_sql_any('text', COUNTER)}) counter FROM s2 GROUP BY 1),
q AS (SELECT id query_id, {_sql_any("coalesce(question, '')", HIGH_RISK)} hr, {_sql_any("coalesce(question, '')", ABSOLUTE)} ab FROM test_questions),
x AS (SELECT q.query_id, evidence IS NULL nores, coalesce(evidence, 0) n, coalesce(sources, 0) sources, CASE WHEN hr THEN 3 ELSE 2 END needed, coalesce(mp, 0) >= 2 OR coalesce(sources, 0) >= 2 agree, ab AND (NOT coalesce(supported, false) OR coalesce(counter, 0) > 0) mm FROM q LEFT JOIN f USING (query_id) LEFT JOIN p USING (query_id)),
g AS (SELECT query_id, n >= needed AND least(4, n) >= 2 AND agree AND NOT mm passes, CASE WHEN nores THEN 'no results' WHEN mm THEN 'claim not supported' WHEN n >= needed AND least(4, n) >= 2 AND agree THEN 'pass' WHEN n < needed THEN 'too little evidence' ELSE 'evidence disagrees' END reason, n evidence, sources, least(4, n) predicted_citations FROM x)
"""
_GOLD = "gc AS (SELECT DISTINCT id query_id, trim(unnest(string_split(gold_relevant_ids, '|'))) chunk_id FROM test_questions WHERE gold_relevant_ids IS NOT NULL), gold AS (SELECT DISTINCT query_id, chunk_id item FROM gc WHERE length(chunk_id) > 0)"


def _hits_sql(level):
    items = "gold" if level == "chunk_id" else f"(SELECT DISTINCT query_id, c.{level} item FROM gold JOIN chunks c ON c.chunk_id = item)"
    return f"SELECT '{level}' AS level, g.query_id, min(rank) fr FROM (SELECT DISTINCT query_id, item FROM {items}) g LEFT JOIN r ON r.query_id = g.query_id AND r.{level} = g.item GROUP BY 2"


_E15 = _R + f", {_GOLD}, h AS (" + " UNION ALL ".join(_hits_sql(x) for x in ("chunk_id", "parent_id", "source_id")) + "), e AS (SELECT level, count(*) queries, " + ", ".join(f"round(avg(CASE WHEN fr < {k} THEN 1.0 ELSE 0.0 END::DOUBLE), 6) hit{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0::DOUBLE / (fr + 1), 0)), 6) mrr FROM h GROUP BY 1)"
QUERIES = {f.__name__: f for f in (l1_gate, e14_gate_features, e22_answer_rates, e17_gate_summary, c9_strong, f5_windows, m1_context, d1_parent_join, d10_neighbours, e15_hits, e16_first_hits, o1_failures, o10_melt, n3_evidence)}
SQL = {
    "c9_strong": _S + "SELECT query_id, count(*) n_strong FROM s WHERE strong GROUP BY 1",
    "l1_gate": _G + "SELECT query_id, passes, reason, evidence, sources, predicted_citations FROM g",
    "e14_gate_features": _G + "SELECT query_id, f.evidence, f.sources, f.parents, round(top1, 6) top1, round(top1 - top2, 6) gap, mean_strong, round(ps / nullif(total, 0), 6) concentration, top_parent, top_source FROM f LEFT JOIN p USING (query_id) LEFT JOIN sr USING (query_id) WHERE f.evidence > 0 AND query_id IN (SELECT id FROM test_questions)",
    "e22_answer_rates": _G + """, c AS (SELECT g.*, round(ps / nullif(total, 0), 6) concentration FROM g LEFT JOIN f USING (query_id) LEFT JOIN p USING (query_id))
SELECT count(*) questions, round(100 * avg(CASE WHEN passes THEN 1.0 ELSE 0.0 END::DOUBLE), 4) answered_pct, round(100 * avg(CASE WHEN NOT passes THEN 1.0 ELSE 0.0 END::DOUBLE), 4) abstained_pct, round(100 * avg(CASE WHEN passes AND concentration >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE), 4) focused_pct, round(avg(concentration), 5) mean_concentration, round(avg(CASE WHEN evidence > 0 THEN evidence END), 6) mean_evidence FROM c""",
    "n3_evidence": _R + r"""SELECT query_id, 'E' || (rank + 1) citation_id, chunk_id, CASE WHEN length(t) > 120 THEN regexp_replace(left(t, 117), '\s+$', '') || '...' ELSE t END snippet
FROM (SELECT *, regexp_replace(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g') t FROM r WHERE rank < 4)""".replace("\\\\", "\\"),
    "m1_context": _R + r""", sc AS (SELECT query_id, parent_id, max(score) s, count(*) n FROM r GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s + 0.02 * least(3, n - 1), 6) DESC, parent_id) p FROM sc),
w AS (SELECT DISTINCT r.query_id, r.parent_id, p, greatest(child_index - 1, 0) lo, child_index + 2 hi FROM r JOIN rk USING (query_id, parent_id) WHERE p <= 3),
t AS (SELECT DISTINCT w.query_id, p, c.child_index ci, c.ord, c.text FROM w JOIN chunks c ON c.parent_id = w.parent_id AND c.child_index >= w.lo AND c.child_index < w.hi WHERE c.text IS NOT NULL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY p, ci, ord) k FROM t) WHERE k = 1),
u AS (SELECT *, len(string_split(regexp_replace(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g'), ' ')) words FROM f),
b AS (SELECT *, sum(words) OVER (PARTITION BY query_id ORDER BY p, ci, ord ROWS UNBOUNDED PRECEDING) used FROM u)
SELECT query_id, sum(words)::BIGINT words_used, count(*) blocks, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p, ci, ord)) digest FROM b WHERE used <= 600 GROUP BY 1""".replace("\\\\", "\\"),
    "e17_gate_summary": _G + "SELECT reason, count(*) n, round(avg(predicted_citations), 6) mean_citations FROM g GROUP BY 1",
    "f5_windows": _R + """, w AS (SELECT DISTINCT query_id, parent_id, greatest(child_index::BIGINT - 1, 0) lo, child_index::BIGINT + 2 hi FROM r),
n AS (SELECT *, CASE WHEN coalesce(max(hi) OVER (PARTITION BY query_id, parent_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < lo, true) THEN 1 ELSE 0 END nw FROM w),
i AS (SELECT *, sum(nw) OVER (PARTITION BY query_id, parent_id ORDER BY lo, hi) isl FROM n) SELECT query_id, parent_id, min(lo) lo, max(hi) hi FROM i GROUP BY query_id, parent_id, isl""",
    "d1_parent_join": _R + ", p AS (SELECT parent_id, count(*) children FROM chunks GROUP BY 1) SELECT query_id, count(*) n_rows, sum(coalesce(children, 0))::BIGINT n_children FROM r LEFT JOIN p USING (parent_id) GROUP BY 1",
    "d10_neighbours": _R + "SELECT query_id, count(DISTINCT ord) n_near FROM r JOIN chunks c USING (parent_id) WHERE rank < 5 AND c.child_index BETWEEN r.child_index - 1 AND r.child_index + 1 GROUP BY 1",
    "e15_hits": _E15 + "SELECT * FROM e",
    "e16_first_hits": _R + f", {_GOLD}, h AS ({_hits_sql('chunk_id')}) SELECT query_id, fr first_rank, round(coalesce(1.0::DOUBLE / (fr + 1), 0), 6) rr FROM h",
    "o1_failures": _R + f", {_GOLD}, h AS ({_hits_sql('chunk_id')}) SELECT query_id FROM h WHERE fr IS NULL OR fr >= 10",
    "o10_melt": _E15 + "SELECT level, metric, value FROM (UNPIVOT (SELECT level, hit1, hit3, hit5, hit10, mrr FROM e) ON hit1, hit3, hit5, hit10, mrr INTO NAME metric VALUE value)",
}
