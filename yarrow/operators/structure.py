"""Passages of structured files to parents and children: heading groups, entries, page groups and images, in one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yarrow.common import running_before, table
from yarrow.functions import text as T
from yarrow.operators.chunking import group_key, hard_split, packed, token_count
from yarrow.operators.reports import ANCHOR

#: Tokens of a parent block, of a child, and of what children share.
PARENT, CHILD, OVERLAP = 2000, 500, 100
#: Rows of a group that are packed in one go; a block ends where a longer group is cut, so that no group grows beyond a task.
SEGMENT = 20_000
#: Markers that make a source one of entries, among its first pages.
MARKERS, PROBED = 3, 10
MARKER = r"(?m)^(?:\d{1,3}\.|[IVX]{1,5}\.)\s"

COLUMNS = ["chunk_id", "source_id", "parent_id", "child_index", "text", "n_tokens", "doc_type", "strategy", "locator", "page_min", "page_max", "para_min", "para_max"]


def _rows(passages: DataFrame, least: dict[str, int] | None = None) -> DataFrame:
    """Passages with enough text for their type, with their tokens, in reading order (element, then locator, then arrival)."""
    least = least or {"image": 5}
    floor = F.lit(30)
    for kind, n in least.items():
        floor = F.when(F.col("doc_type") == kind, n).otherwise(floor)
    rows = passages.where(F.length(T.collapse(F.col("text"))) >= floor)
    order = F.struct(F.coalesce("element_idx", F.lit(0)).alias("e"), F.coalesce("locator", F.lit("")).alias("l"), F.col("ord").alias("o"))
    return rows.select("source_id", "doc_type", "ord", "text", "page", "para_idx", "locator", group_key(F.col("doc_type"), F.col("heading_path"), F.col("section_heading")).alias("g"), order.alias("at"), token_count(F.col("text")).cast("int").alias("n"))


def _gathered(rows: DataFrame, keys: list[str], segment: int) -> DataFrame:
    """Each group's rows in order as one array, at most ``segment`` of them."""
    placed = running_before(rows, keys, [F.col("at")], F.lit(1).cast("bigint")).withColumn("seg", F.floor(F.col("before") / segment).cast("bigint")).drop("before")
    fields = F.struct("at", "text", "n", "page", "para_idx")
    return placed.groupBy(*keys, "seg").agg(F.array_sort(F.collect_list(fields)).alias("r"))


def _children(parents: DataFrame, texts: Column, size: int, overlap: int) -> DataFrame:
    """The children of each parent from its texts (an array); oversized texts are split first."""
    pieces = F.flatten(F.transform(texts, lambda x: F.when(token_count(x) > size, hard_split(x, size)).otherwise(F.array(x))))
    ready = parents.withColumn("_p", F.transform(F.filter(pieces, lambda x: F.length(F.trim(x)) > 0), lambda x: F.struct(x.alias("t"), token_count(x).cast("int").alias("n"))))
    cut_ = ready.select(*parents.columns, F.posexplode(packed("_p", size, overlap)).alias("child_index", "_c"))
    return cut_.withColumns({"text": F.array_join(F.transform("_c", lambda x: x["t"]), "\n\n"), "n_tokens": F.aggregate("_c", F.lit(0), lambda s, x: s + x["n"])}).drop("_c")


def _finished(kids: DataFrame, strategy: str, locator: Column) -> DataFrame:
    named = kids.withColumns({"chunk_id": F.concat("source_id", F.lit(":"), T.short_hash(F.col("text"))), "strategy": F.lit(strategy), "locator": locator})
    have = set(named.columns)
    return named.select(*[F.col(c) if c in have else F.lit(None).cast("int").alias(c) for c in COLUMNS])


def heading_blocks(rows: DataFrame, parent: int = PARENT, size: int = CHILD, overlap: int = OVERLAP, segment: int = SEGMENT) -> DataFrame:
    """Rows under one heading to parent blocks of at most ``parent`` tokens, and those to children; E4's ranges with them.

    parent_id: source:h:<hash of the heading>, with :b<i> where there are several blocks. A row above the limit is a block of its own.
    """
    groups = _gathered(rows, ["source_id", "doc_type", "g"], segment)
    blocks = groups.select("source_id", "doc_type", "g", "seg", "r", F.posexplode(packed("transform(r, (x, i) -> named_struct('t', CAST(i AS string), 'n', x.n))", parent, 0)).alias("b", "_b"))
    first, last = F.col("_b")[0]["t"].cast("int"), F.element_at("_b", -1)["t"].cast("int")
    blocks = blocks.select("source_id", "doc_type", "g", "seg", "b", F.slice("r", first + 1, last - first + 1).alias("r"))
    count = F.count(F.lit(1)).over(Window.partitionBy("source_id", "doc_type", "g"))
    # one row a block here, so the numbering over a heading's blocks is light
    number = F.row_number().over(Window.partitionBy("source_id", "doc_type", "g").orderBy("seg", "b")) - 1
    base = F.concat("source_id", F.lit(":h:"), T.short_hash(F.col("g")))
    named = blocks.withColumns({"parent_id": F.when(count > 1, F.concat(base, F.lit(":b"), number.cast("string"))).otherwise(base)})
    named = named.withColumns({"para_min": F.array_min(F.transform("r", lambda x: x["para_idx"])), "para_max": F.array_max(F.transform("r", lambda x: x["para_idx"]))})
    kids = _children(named.select("source_id", "doc_type", "parent_id", "para_min", "para_max", "r"), F.transform("r", lambda x: x["text"]), size, overlap)
    return _finished(kids, "heading", F.concat_ws("-", F.col("para_min").cast("string"), F.col("para_max").cast("string")))


def entry_sources(rows: DataFrame) -> DataFrame:
    """Sources whose first pages hold at least MARKERS entry markers."""
    early = rows.where((F.col("doc_type") == "pdf") & (F.col("page") <= PROBED))
    return early.groupBy("source_id").agg(F.sum(F.regexp_count("text", F.lit(MARKER))).alias("m")).where(F.col("m") >= MARKERS).select("source_id")


def pdf_entries(rows: DataFrame, size: int = CHILD, overlap: int = OVERLAP, segment: int = SEGMENT) -> DataFrame:
    """A source's pages as one text cut before each entry marker, each entry a parent with the range of pages it lies on.

    What stands before the first marker is an entry of its own.
    """
    pages = _gathered(rows.withColumn("text", T.strip_page_numbers(F.col("text"))), ["source_id", "doc_type"], segment)
    ends = F.expr("aggregate(r, named_struct('a', CAST(array() AS array<int>), 's', 0), (z, x) -> named_struct('a', concat(z.a, array(z.s + length(x.text) + 1)), 's', z.s + length(x.text) + 1), z -> z.a)")
    pages = pages.withColumns({"pages": F.transform("r", lambda x: x["page"]), "ends": ends, "whole": F.array_join(F.transform("r", lambda x: x["text"]), "\n")}).drop("r")
    parts = F.split("whole", MARKER.replace("(?m)^", "(?m)(?=^") + ")")
    cut_ = pages.select("source_id", "doc_type", "seg", "pages", "ends", parts.alias("parts"))
    placed = F.expr("aggregate(parts, named_struct('a', CAST(array() AS array<struct<t:string,lo:int>>), 's', 0), (z, x) -> named_struct('a', concat(z.a, array(named_struct('t', x, 'lo', z.s))), 's', z.s + length(x)), z -> z.a)")
    cut_ = cut_.select("source_id", "doc_type", "seg", "pages", "ends", F.posexplode(placed).alias("i", "e"))
    cut_ = cut_.where(F.length(F.trim("e.t")) > 0)
    page_at = lambda at: F.expr(f"try_element_at(pages, size(filter(ends, x -> x <= {at})) + 1)")
    number = F.row_number().over(Window.partitionBy("source_id").orderBy("seg", "i")) - 1
    named = cut_.select("source_id", "doc_type", F.concat("source_id", F.lit(":e:"), number.cast("string")).alias("parent_id"), page_at("e.lo").alias("page_min"), page_at("e.lo + length(rtrim(e.t)) - 1").alias("page_max"), F.col("e.t").alias("t"))
    kids = _children(named, F.split("t", "\n[ \t]*\n"), size, overlap).drop("t")
    return _finished(kids, "entry", F.concat_ws("-", F.col("page_min").cast("string"), F.col("page_max").cast("string")))


def pdf_pages(rows: DataFrame, pages: int = 2, size: int = CHILD, overlap: int = OVERLAP) -> DataFrame:
    """Groups of ``pages`` consecutive rows as parents; a hot source spreads over its groups."""
    placed = running_before(rows.withColumn("text", T.strip_page_numbers(F.col("text"))), ["source_id"], [F.col("at")], F.lit(1).cast("bigint"))
    groups = placed.groupBy("source_id", "doc_type", F.floor(F.col("before") / pages).alias("pg")).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("r"), F.min("page").alias("page_min"), F.max("page").alias("page_max"))
    label = F.concat_ws("-", F.coalesce("page_min", F.lit(0)).cast("string"), F.coalesce("page_max", F.lit(0)).cast("string"))
    named = groups.select("source_id", "doc_type", "page_min", "page_max", F.concat("source_id", F.lit(":p:"), label, F.lit(":"), F.col("pg").cast("string")).alias("parent_id"), "r")
    return _finished(_children(named, F.transform("r", lambda x: x["text"]), size, overlap), "pages", label)


def images(rows: DataFrame, size: int = CHILD) -> DataFrame:
    """Each image record is its own parent; one that is too long is split, its pieces numbered in the locator."""
    parts = F.when(F.col("n") > size, hard_split(F.col("text"), size)).otherwise(F.array(F.trim("text")))
    named = rows.select("source_id", "doc_type", F.concat("source_id", F.lit(":img:"), T.short_hash(F.concat_ws("|", F.coalesce("locator", F.lit("")), F.col("ord").cast("string")))).alias("parent_id"), "page", "locator", parts.alias("p"), F.size(parts).alias("k"))
    kids = named.select("source_id", "doc_type", "parent_id", F.col("page").alias("page_min"), F.col("page").alias("page_max"), "k", F.col("locator").alias("_l"), F.posexplode("p").alias("child_index", "text")).withColumn("n_tokens", token_count(F.col("text")).cast("int"))
    return _finished(kids, "image", F.when(F.col("k") > 1, F.concat(F.coalesce("_l", F.lit("")), F.lit("#part"), (F.col("child_index") + 1).cast("string"))).otherwise(F.col("_l")))


def chunked(passages: DataFrame, sources: DataFrame, anchor: str, parent: int = PARENT, size: int = CHILD, overlap: int = OVERLAP) -> DataFrame:
    """Every passage by its type's strategy, in one schema, with category and noise.

    Images are parents of their own, docx and txt go by headings, pdf by entries where a source has them, else by pages. is_noise: the
    text is noise, or all of the source's texts are. Null and too short passages give no chunks.
    """
    rows = _rows(passages)
    by_entry = entry_sources(rows)
    pdf = rows.where("doc_type = 'pdf'")
    parts = [
        images(rows.where("doc_type = 'image'"), size), heading_blocks(rows.where("doc_type IN ('docx', 'txt')"), parent, size, overlap),
        pdf_entries(pdf.join(by_entry, "source_id", "left_semi"), size, overlap), pdf_pages(pdf.join(by_entry, "source_id", "left_anti"), 2, size, overlap),
    ]
    out = reduce(DataFrame.unionByName, parts)
    clean = out.where(~T.is_noise(F.col("text"))).select("source_id").distinct().withColumn("_clean", F.lit(True))
    out = out.join(sources.select("source_id", T.category(F.col("file_path"), anchor).alias("category")), "source_id", "left").join(clean, "source_id", "left")
    return out.withColumns({"category": F.coalesce("category", F.lit("unknown")), "is_noise": T.is_noise(F.col("text")) | F.col("_clean").isNull()}).drop("_clean")


# --- queries ------------------------------------------------------------------------------------------------------


def _passages(spark, d):
    return _rows(table(spark, d, "raw_passages"))


def c12_entry_sources(spark, d):
    return entry_sources(_passages(spark, d))


def i5_heading_blocks(spark, d):
    """Tokens of every parent block of docx and txt sources."""
    kids = heading_blocks(_passages(spark, d).where("doc_type IN ('docx', 'txt')"), 300, 120, 25)
    return kids.groupBy("source_id", "parent_id").agg(F.count(F.lit(1)).alias("children"), F.max("n_tokens").alias("most_tokens"), F.min("para_min").alias("para_min"), F.max("para_max").alias("para_max"))


def i7_pdf_entries(spark, d):
    return pdf_entries(_passages(spark, d).where("doc_type = 'pdf'"), 120, 25).groupBy("parent_id").agg(F.count(F.lit(1)).alias("children"), F.min("page_min").alias("page_min"), F.max("page_max").alias("page_max"))


def i8_pdf_pages(spark, d):
    """Every page group with its pages' range."""
    kids = pdf_pages(_passages(spark, d).where("doc_type = 'pdf'"))
    return kids.select("source_id", "parent_id", F.col("page_min").cast("bigint").alias("page_min"), F.col("page_max").cast("bigint").alias("page_max")).distinct()


def i9_images(spark, d):
    """Number of pieces of every image record."""
    return images(_passages(spark, d).where("doc_type = 'image'"), 40).groupBy("parent_id").agg(F.count(F.lit(1)).alias("pieces"))


def i10_chunked(spark, d):
    """Chunks of every source by strategy."""
    c = chunked(table(spark, d, "raw_passages"), table(spark, d, "sources"), ANCHOR)
    return c.groupBy("source_id", "doc_type", "strategy", "category").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("parent_id").alias("parents"), F.count_if("is_noise").alias("noise"))


QUERIES = {f.__name__: f for f in (c12_entry_sources, i5_heading_blocks, i7_pdf_entries, i8_pdf_pages, i9_images, i10_chunked)}
_WS = r"[ \t\n\r\f\x0B]+"
_FLAT = f"regexp_replace(regexp_replace(text, '{_WS}', ' ', 'g'), '^ | $', '', 'g')"
_LONG = f"text IS NOT NULL AND length({_FLAT}) >= CASE WHEN doc_type = 'image' THEN 5 ELSE 30 END"
SQL = {
    "c12_entry_sources": f"SELECT source_id FROM raw_passages WHERE {_LONG} AND doc_type = 'pdf' AND page <= 10 GROUP BY 1 HAVING sum(len(regexp_extract_all(text, '(?m)^(?:[0-9]{{1,3}}\\.|[IVX]{{1,5}}\\.)\\s'))) >= 3",
    "i8_pdf_pages": f"""WITH p AS (SELECT *, (row_number() OVER (PARTITION BY source_id ORDER BY coalesce(element_idx, 0), coalesce(locator, ''), ord) - 1) // 2 pg FROM raw_passages WHERE {_LONG} AND doc_type = 'pdf'),
g AS (SELECT source_id, pg, min(page)::BIGINT page_min, max(page)::BIGINT page_max FROM p GROUP BY 1, 2)
SELECT source_id, source_id || ':p:' || coalesce(page_min, 0) || '-' || coalesce(page_max, 0) || ':' || pg parent_id, page_min, page_max FROM g""",
    "i9_images": f"""SELECT source_id || ':img:' || left(sha1(coalesce(locator, '') || '|' || ord), 12) parent_id, CASE WHEN len(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}]')) > 40
THEN greatest(1, ceil(len(list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: length(x) > 0)) / 40.0))::BIGINT ELSE 1 END pieces FROM raw_passages WHERE {_LONG} AND doc_type = 'image'""",
}
