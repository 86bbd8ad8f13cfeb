"""From passages to chunks and parents: ordered packing as folds over arrays, one row a group, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yarrow.common import running_before, table
from yarrow.functions import text as T


def token_count(t: Column) -> Column:
    """Number of words and signs, the offline token counter; another Column function can take its place."""
    return F.regexp_count(t, F.lit(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"))


def hard_split(t: Column, n: int) -> Column:
    """Pieces of n words each."""
    words = F.filter(F.split(t, T.WS + "+"), lambda x: F.length(x) > 0)
    count = F.greatest(F.ceil(F.size(words) / n).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(words, i * n + 1, n), " "))


_STATE = "struct<done:array<array<struct<t:string,n:int>>>,now:array<struct<t:string,n:int>>>"


def packed(parts: str, size: int, overlap: int) -> Column:
    """Greedy packing of parts (array of struct t, n) into groups of at most ``size`` tokens.

    A group is closed when the next part would overflow it; its trailing parts of at most ``overlap`` tokens open the
    next one. The check comes before the carry, so a group may have size + overlap tokens.
    """
    total = "aggregate({0}, 0, (s, x) -> s + x.n)"
    carry = f"aggregate(reverse(a.now), struct(CAST(array() AS array<struct<t:string,n:int>>) AS k, false AS stop), (c, x) -> IF(c.stop OR {total.format('c.k')} + x.n > {overlap}, struct(c.k AS k, true AS stop), struct(concat(array(x), c.k) AS k, false AS stop)), c -> c.k)"
    step = f"IF(size(a.now) > 0 AND {total.format('a.now')} + p.n > {size}, named_struct('done', concat(a.done, array(a.now)), 'now', concat({carry}, array(p))), named_struct('done', a.done, 'now', concat(a.now, array(p))))"
    return F.expr(f"aggregate({parts}, CAST(named_struct('done', array(), 'now', array()) AS {_STATE}), (a, p) -> {step}, a -> IF(size(a.now) > 0, concat(a.done, array(a.now)), a.done))")


def paragraphs(df: DataFrame, key: str, text: str, least: int = 30) -> DataFrame:
    """(key, para_idx from 1, text) of the paragraphs of at least ``least`` characters, white space collapsed."""
    kept = F.filter(F.transform(F.split(F.col(text), "\n[ \t]*\n"), T.collapse), lambda x: F.length(x) >= least)
    return df.select(key, F.posexplode(kept).alias("_i", "text")).select(key, (F.col("_i") + 1).alias("para_idx"), "text")


def children(df: DataFrame, key: str, text: str, size: int = 120, overlap: int = 25) -> DataFrame:
    """(key, child_index, text, n_tokens) by packing a text's paragraphs; oversized ones are split first."""
    parts = F.flatten(F.transform(F.filter(F.split(F.col(text), "\n[ \t]*\n"), lambda x: F.length(T.collapse(x)) > 0), lambda x: F.when(token_count(x) > size, hard_split(x, size)).otherwise(F.array(T.collapse(x)))))
    base = df.where(F.col(text).isNotNull()).select(key, F.transform(parts, lambda x: F.struct(x.alias("t"), token_count(x).cast("int").alias("n"))).alias("parts"))
    groups = base.select(key, F.posexplode(packed("parts", size, overlap)).alias("child_index", "g"))
    return groups.select(key, "child_index", F.array_join(F.transform("g", lambda x: x["t"]), "\n\n").alias("text"), F.aggregate("g", F.lit(0), lambda s, x: s + x["n"]).alias("n_tokens"))


def group_key(kind: Column, path: Column, heading: Column) -> Column:
    """I4: the heading that rows are grouped under."""
    empty = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    return F.coalesce(F.when(kind == "docx", empty(path)), empty(heading), F.lit("__no_heading__"))


def page_groups(df: DataFrame, keys: list[str], order: str, n: int = 2) -> DataFrame:
    """The number of the group of n consecutive rows that a row falls into; a hot source spreads over partitions."""
    numbered = running_before(df, keys, [F.col(order)], F.lit(1).cast("bigint"))
    return numbered.withColumn("page_group", F.floor(F.col("before") / n).cast("bigint")).drop("before")


def entries(t: Column, marker: str = r"(?m)(?=^(?:\d{1,3}\.|[IVX]{1,5}\.)\s)") -> Column:
    """A text cut before each entry marker; what stands before the first is an entry of its own."""
    return F.filter(F.split(t, marker), lambda x: F.length(F.trim(x)) > 0)


def parents(chunks: DataFrame) -> DataFrame:
    """Each parent's children joined in order, with their number and first metadata."""
    kids = F.array_sort(F.collect_list(F.struct("child_index", "ord", "text")))
    return chunks.groupBy("parent_id").agg(
        F.min_by("source_id", "ord").alias("source_id"), F.min_by("title", "ord").alias("title"), F.count(F.lit(1)).alias("children_count"),
        F.array_join(F.transform(kids, lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("parent_text"),
    )


# --- queries ------------------------------------------------------------------------------------------------------


def a15_paragraphs(spark, d):
    p = paragraphs(table(spark, d, "documents"), "doc_id", "text")
    return p.select("doc_id", F.col("para_idx").cast("bigint").alias("para_idx"), F.length("text").cast("bigint").alias("n_chars"))


def i3_children(spark, d):
    return children(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("child_index").cast("bigint").alias("child_index"), F.col("n_tokens").cast("bigint").alias("n_tokens"), F.md5("text").alias("digest"))


def i4_groups(spark, d):
    r = table(spark, d, "raw_passages").withColumn("g", group_key(F.col("doc_type"), F.col("heading_path"), F.col("section_heading")))
    return r.groupBy("source_id", "g").agg(F.count(F.lit(1)).alias("n"), F.min("para_idx").cast("bigint").alias("para_min"), F.max("para_idx").cast("bigint").alias("para_max"))


def f9_page_groups(spark, d):
    r = table(spark, d, "raw_passages").where("doc_type = 'pdf'").select("source_id", "ord", "page")
    return page_groups(r, ["source_id"], "ord").groupBy("source_id", "page_group").agg(F.count(F.lit(1)).alias("n"), F.min("page").cast("bigint").alias("page_min"))


def i6_entries(spark, d):
    r = table(spark, d, "raw_passages").where("text IS NOT NULL")
    return r.select("ord", F.posexplode(entries(F.col("text"))).alias("entry", "e")).select("ord", "entry", F.length("e").alias("n_chars"))


def e2_parents(spark, d):
    p = parents(table(spark, d, "chunks"))
    return p.select("parent_id", "source_id", "title", "children_count", F.md5("parent_text").alias("digest"))


def e3_children_stats(spark, d):
    """Parents, and mean, indexed 95th percentile and maximum of their children, from the few distinct numbers of children."""
    sizes = table(spark, d, "chunks").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    upto = sizes.withColumn("upto", F.sum("c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(Window.partitionBy()))
    # of n values in order, that at place int(0.95 n), counted from 0
    place = F.least((F.col("all") * 0.95).cast("bigint"), F.col("all") - 1)
    return upto.agg(F.sum("c").alias("parents"), F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 6).alias("avg_children"), F.min(F.when(F.col("upto") > place, F.col("n"))).alias("p95"), F.max("n").alias("max_children"))


def e21_integrity(spark, d):
    """Parents whose child_index does not run from 0 without gaps and repeats."""
    g = table(spark, d, "chunks").groupBy("parent_id").agg(F.min("child_index").alias("lo"), F.max("child_index").alias("hi"), F.count(F.lit(1)).alias("n"), F.countDistinct("child_index").alias("m"))
    return g.where(~((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("m") == F.col("n")))).select("parent_id", "n")


def d4_noise_sources(spark, d):
    """Left semi join: chunks of sources that have any noise."""
    c = table(spark, d, "chunks")
    noisy = c.where("is_noise").select("source_id").distinct()
    return c.join(noisy, "source_id", "left_semi").groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


def d11_not_embedded(spark, d):
    """Left anti join: chunks without a vector."""
    c = table(spark, d, "chunks")
    return c.join(table(spark, d, "points").select("chunk_id"), "chunk_id", "left_anti").groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


def h1_first_wins(spark, d):
    c = table(spark, d, "chunks")
    return c.groupBy("chunk_id").agg(F.min("ord").alias("ord"))


def h2_longest_wins(spark, d):
    """Of chunks with one id the longest text, the first of equally long ones: one aggregate, no sort."""
    c = table(spark, d, "chunks").where(F.length("text") >= 30)
    return c.groupBy("chunk_id").agg(F.max_by("ord", F.struct(F.length("text"), -F.col("ord"))).alias("ord"))


QUERIES = {f.__name__: f for f in (a15_paragraphs, i3_children, i4_groups, f9_page_groups, i6_entries, e2_parents, e3_children_stats, e21_integrity, d4_noise_sources, d11_not_embedded, h1_first_wins, h2_longest_wins)}
_WS = r"[ \t\n\r\f\x0B]+"
SQL = {
    "i6_entries": r"""WITH m AS (SELECT ord, string_split(regexp_replace(text, '(?m)^((?:[0-9]{1,3}\.|[IVX]{1,5}\.)\s)', chr(1) || '\1', 'g'), chr(1)) l FROM raw_passages WHERE text IS NOT NULL),
f AS (SELECT ord, list_filter(l, lambda x: length(trim(x)) > 0) l FROM m) SELECT ord, unnest(range(len(l)))::INT entry, unnest(list_transform(l, lambda x: length(x))) n_chars FROM f""",
    "a15_paragraphs": rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: regexp_replace(regexp_replace(x, '{_WS}', ' ', 'g'), '^ | $', '', 'g')), lambda x: length(x) >= 30) l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, unnest(range(1, len(l) + 1)) para_idx, unnest(list_transform(l, lambda x: length(x))) n_chars FROM p""",
    "i4_groups": "SELECT source_id, coalesce(CASE WHEN doc_type = 'docx' AND length(trim(heading_path)) > 0 THEN heading_path END, CASE WHEN length(trim(section_heading)) > 0 THEN section_heading END, '__no_heading__') g, count(*) n, min(para_idx)::BIGINT para_min, max(para_idx)::BIGINT para_max FROM raw_passages GROUP BY 1, 2",
    "f9_page_groups": "SELECT source_id, page_group, count(*) n, min(page)::BIGINT page_min FROM (SELECT *, (row_number() OVER (PARTITION BY source_id ORDER BY ord) - 1) // 2 page_group FROM raw_passages WHERE doc_type = 'pdf') GROUP BY 1, 2",
    "e2_parents": "SELECT parent_id, arg_min(source_id, ord) source_id, arg_min(title, ord) title, count(*) children_count, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY child_index, ord)) digest FROM chunks GROUP BY 1",
    "e3_children_stats": "SELECT count(*) parents, round(avg(n), 6) avg_children, list_sort(list(n))[least(floor(0.95 * count(*))::BIGINT, count(*) - 1) + 1] p95, max(n) max_children FROM (SELECT count(*) n FROM chunks GROUP BY parent_id)",
    "e21_integrity": "SELECT parent_id, count(*) n FROM chunks GROUP BY 1 HAVING NOT (min(child_index) = 0 AND max(child_index) = count(*) - 1 AND count(DISTINCT child_index) = count(*))",
    "d4_noise_sources": "SELECT doc_type, count(*) n FROM chunks WHERE source_id IN (SELECT source_id FROM chunks WHERE is_noise) GROUP BY 1",
    "d11_not_embedded": "SELECT doc_type, count(*) n FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.chunk_id = c.chunk_id) GROUP BY 1",
    "h1_first_wins": "SELECT chunk_id, min(ord) ord FROM chunks GROUP BY 1",
    "h2_longest_wins": "SELECT chunk_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY length(text) DESC, ord) k FROM chunks WHERE length(text) >= 30) WHERE k = 1",
}
