"""Ingest from a manifest, word-processor files, conversion of folders, sinks of points, reports and debug rows, configuration."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yarrow.functions import text as T
from yarrow.operators.answers import Embedder, embedded
from yarrow.operators.quality import heading_level, heading_paths
from yarrow.sources.files import READERS, only_new, read_documents

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_elements(content: bytes) -> list[tuple[str, str, str]]:
    """(kind, style, text) of the paragraphs and table rows of a word-processor file, in order; cells are joined by tabs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""

    def written(p: ElementTree.Element) -> str:
        return "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else x.text or "" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"))

    out = []
    for block in root.find(f"{_W}body") if root.find(f"{_W}body") is not None else ():
        if block.tag == f"{_W}p":
            style = block.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val") if style is not None else ""
            out.append(("paragraph", names.get(key, key) or "", written(block)))
        elif block.tag == f"{_W}tbl":
            for row in block.iter(f"{_W}tr"):
                cells = [" ".join(written(p) for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc")]
                out.append(("row", "", "\t".join(cells)))
    return out


def docx_text(content: bytes) -> tuple[str | None, str | None]:
    """The paragraphs, then the table rows, of a word-processor file."""
    parts = docx_elements(content)
    return "\n".join(t for kind in ("paragraph", "row") for k, _, t in parts if k == kind and t.strip()), None


READERS.setdefault("docx", docx_text)


def read_docx_passages(spark: SparkSession, path: str, least: int = 30) -> DataFrame:
    """(path, element_idx, text, section_heading, heading_path, error) of every text element with its headings.

    A file that cannot be read has one row with its error.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(p, i, style, text, None) for i, (_, style, text) in enumerate(docx_elements(bytes(content)))]
                except Exception as e:  # noqa: BLE001
                    rows.append((p, 0, "", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "element_idx", "style", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    elements = files.mapInPandas(run, "path string, element_idx int, style string, text string, error string")
    given = F.when(F.lower("style") == "title", 1).cast("int")
    named = F.lower("style").rlike(r"^heading\s*\d+$") | given.isNotNull()
    levelled = elements.withColumn("level", F.when(named, heading_level(F.col("style"), given)))
    placed = heading_paths(levelled, "path", "element_idx")
    good = (F.col("level").isNull() & (F.length(T.collapse(F.col("text"))) >= least)) | F.col("error").isNotNull()
    heading = F.element_at(F.split("heading_path", " > "), -1)
    return placed.where(good).select("path", "element_idx", "text", F.when(F.length("heading_path") > 0, heading).alias("section_heading"), F.when(F.length("heading_path") > 0, F.col("heading_path")).alias("heading_path"), "error")


def resolved_type(given: Column, path: Column) -> Column:
    """The type that the manifest gives, else that of the extension."""
    return F.coalesce(F.when(F.length(F.trim(given)) > 0, F.lower(F.trim(given))), T.doc_type(path))


def write_manifest(sources: DataFrame, path: str) -> None:
    """A manifest as YAML, a list of mappings; values are quoted as JSON strings, which YAML reads alike."""
    item = [F.concat(F.lit("- " if i == 0 else "  "), F.lit(f"{c}: "), F.when(F.col(c).isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.struct(F.col(c).cast("string").alias("x"))), r'^\{"x":(.*)\}$', "$1"))) for i, c in enumerate(sources.columns)]
    sources.select(F.concat_ws("\n", *item).alias("value")).write.mode("overwrite").text(path)


def ingest(spark: SparkSession, manifest: DataFrame, root: str, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """A10: (passages, counts by type and source) of a manifest's files below ``root``.

    Manifest rows without a file, or of a type without a reader, and files that fail, have an error and no passages; no row stops the rest.
    """
    read = read_documents(spark, root).withColumn("_rel", F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", ""))
    rows = manifest.withColumn("doc_type", resolved_type(F.col("doc_type"), F.col("file_path"))).join(read.drop("doc_type"), F.col("file_path") == F.col("_rel"), "left")
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("path").isNull(), "missing file")))
    kept = F.filter(F.transform(F.split("text", "\n[ \t]*\n"), T.collapse), lambda x: F.length(x) >= least)
    passages = rows.where("error IS NULL").select("source_id", "doc_type", "file_path", "title", F.col("fingerprint").alias("doc_fingerprint"), F.posexplode(kept).alias("_i", "text")).withColumn("para_idx", F.col("_i") + 1).drop("_i")
    counts = rows.select("source_id", "doc_type", "error").join(passages.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")), "source_id", "left").select("source_id", "doc_type", F.coalesce("n", F.lit(0)).alias("passages"), "error")
    return passages, counts


def convert_folder(spark: SparkSession, path: str, out: str, force: bool = False, clean: bool = True) -> DataFrame:
    """Texts of a folder's files, normalised, added to a table; files converted before are left out unless ``force``. The rows that failed come back."""
    docs = read_documents(spark, path)
    try:
        done = spark.read.parquet(out).select("path")
        docs = docs if force else only_new(docs, done, "path")
    except Exception:  # noqa: BLE001  nothing converted yet
        force = True
    text = T.clean_passage(F.col("text")) if clean else F.col("text")
    docs = docs.withColumn("text", text)
    docs.where("error IS NULL").write.mode("overwrite" if force else "append").parquet(out)
    return docs.where("error IS NOT NULL").select("path", "error")


def embed_points(chunks: DataFrame, path: str, embedder: Embedder | None = None, least: int = 30, recreate: bool = False) -> dict[str, int]:
    """What is no noise and long enough, the longest text of each id, embedded and written; failed rows beside it.

    Returns the numbers of rows asked, written and failed, as read back.
    """
    spark = chunks.sparkSession
    good = chunks.where(~F.coalesce(F.col("is_noise"), F.lit(False)) & (F.length("text") >= least))
    rest = [c for c in good.columns if c not in ("chunk_id", "text")]
    once = good.groupBy("chunk_id").agg(F.max_by(F.struct("text", *rest), F.struct(F.length("text"), -F.col("ord"))).alias("r")).select("chunk_id", "r.*")
    vectors = embedded(once, [c for c in once.columns if c != "text"], "text", embedder).withColumn("point_id", T.point_id(F.col("chunk_id")))
    mode = "overwrite" if recreate else "append"
    vectors.write.mode(mode).partitionBy("doc_type").parquet(f"{path}/all")
    stored = spark.read.parquet(f"{path}/all")
    failed = stored.where("vector IS NULL").select("chunk_id", "point_id", "error")
    failed.write.mode("overwrite").json(f"{path}/failed")
    written, lost = stored.agg(F.count_if(F.col("vector").isNotNull()), F.count_if(F.col("vector").isNull())).first()
    return {"asked": written + lost, "written": written, "failed": lost}


def debug_name(mode: Column, query: Column) -> Column:
    """The name that a query's debug rows go by."""
    return F.concat(mode, F.lit("_"), F.substring(F.md5(query), 1, 8))


def write_debug(rows: DataFrame, path: str) -> None:
    """Rows (mode, query, ...) as JSON, a folder for each name."""
    rows.withColumn("name", debug_name(F.col("mode"), F.col("query"))).write.mode("append").partitionBy("name").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


@dataclass(frozen=True)
class RetrievalConfig:
    """Settings of retrieval and answering with their defaults."""

    bm25_topk: int = 40
    vector_topk: int = 40
    final_topk: int = 40
    rrf_k: int = 60
    gate_topk: int = 8
    token_budget: int = 3500
    window: int = 1
    max_context_parents: int = 3

    @classmethod
    def read(cls, text: str) -> RetrievalConfig:
        """From JSON, or from lines ``name: number`` (indented ones too); unknown names are ignored, missing ones keep their defaults."""
        try:
            given = json.loads(text)
        except ValueError:
            given = {k.strip(): v.split("#")[0].strip() for k, _, v in (line.partition(":") for line in text.splitlines()) if v.split("#")[0].strip()}
        known = {f.name for f in fields(cls)}
        return cls(**{k: int(v) for k, v in given.items() if k in known})


Converter = Callable[[bytes], tuple[str | None, str | None]]


def register_reader(extension: str, reader: Converter) -> None:
    """2.Q: a reader for a further type, such as PDF or scanned images: content to (text, error)."""
    READERS[extension.lower()] = reader
