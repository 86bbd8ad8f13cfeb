"""Sources and sinks: JSON lines, folder manifests, plain text, CSV, tables; adapters take what the box has no reader for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from yarrow.functions import text as T

SOURCES = "source_id string, file_path string, doc_type string, title string, doc_language string, url string, author string, year int, doi string, journal string"
PASSAGES = "source_id string, doc_type string, title string, author string, year int, file_path string, url string, page int, page_range string, section_heading string, heading_path string, span string, locator string, doc_fingerprint string, doc_language string, text string, element_idx int, para_idx int, bbox array<int>, ocr_engine string, ocr_confidence double"
QUESTIONS = "question string, expected_chunk_id string, expected_source_id string, expected_parent_id string, question_source string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, bad_records: bool = False) -> DataFrame:
    """A1: JSON lines with a declared schema. Blank lines are skipped, malformed ones left out, or with
    ``bad_records`` the malformed lines alone are returned; a missing path gives an empty frame."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], "_bad string" if bad_records else schema)
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    wide = StructType([*schema.fields, *StructType.fromDDL("_bad string").fields])
    rows = raw.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return rows.where("_bad IS NOT NULL").select("_bad") if bad_records else rows.where("_bad IS NULL").drop("_bad")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A2, A3: JSON lines; folders are made as needed, non-ASCII text stays readable."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A33."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def latex_table(df: DataFrame, limit: int = 200) -> str:
    """A small result as a LaTeX table; ``limit`` bounds what comes to the driver."""
    rows = df.limit(limit).collect()
    line = lambda xs: " & ".join(str("" if x is None else x).replace("&", r"\&").replace("_", r"\_").replace("%", r"\%") for x in xs) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", line(df.columns), r"\hline", *(line(r) for r in rows), r"\end{tabular}"])


def scan_folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("pdf", "docx", "doc", "txt", "png", "jpg", "jpeg"), excluded: tuple[str, ...] = ("outputs", ".git")) -> DataFrame:
    """The manifest of a folder tree; contents are not read, as the listing needs only the path and size columns."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    rel = F.regexp_replace("path", r"^.*?" + path.rstrip("/").replace(".", r"\.") + "/", "")
    files = files.withColumn("file_path", rel)
    good = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions) & ~T.excluded(F.col("file_path"), list(excluded)) & ~F.col("file_path").endswith("Zone.Identifier")
    name = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return files.where(good).select(F.concat(F.lit("src_"), T.short_hash(F.col("file_path"))).alias("source_id"), "file_path", T.doc_type(F.col("file_path")).alias("doc_type"), F.regexp_replace(name, "[_]+", " ").alias("title"), "length")


def decode(content: bytes) -> tuple[str | None, str | None]:
    """Text by the first encoding that fits; old binary office files are an error."""
    if content[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return None, "binary office file"
    for codec in ("utf-8-sig", "cp1252"):
        try:
            return content.decode(codec), None
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace"), None


def _csv_text(content: bytes) -> tuple[str | None, str | None]:
    import csv
    import io

    text, error = decode(content)
    return (None, error) if text is None else ("\n".join("\t".join(r) for r in csv.reader(io.StringIO(text))), None)


#: Reader of a document type: content to (text, error). Further types are registered by the user.
READERS: dict[str, Callable[[bytes], tuple[str | None, str | None]]] = {"txt": decode, "csv": _csv_text}


def read_documents(spark: SparkSession, path: str, pattern: str = "*", readers: dict | None = None) -> DataFrame:
    """(path, doc_type, fingerprint, text, error), one row a file; a file that fails costs only its own row."""
    readers = READERS | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                kind = p.rsplit(".", 1)[-1].lower()
                try:
                    text, error = readers[kind](bytes(content)) if kind in readers else (None, f"no reader for {kind}")
                except Exception as e:  # noqa: BLE001
                    text, error = None, f"{type(e).__name__}: {e}"
                out.append((p, kind, "sha1:" + hashlib.sha1(bytes(content)).hexdigest(), text, error))
            yield pd.DataFrame(out, columns=["path", "doc_type", "fingerprint", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "path string, doc_type string, fingerprint string, text string, error string")


def only_new(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that have no output yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def dead_letters(df: DataFrame, failed) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows with the time of failing left to the sink)."""
    return df.where(~failed), df.where(failed)


def read_questions(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """A question set checked against the chunks; missing parent and source ids are inferred by one left join."""
    q = read_jsonl(spark, path, QUESTIONS).where(F.length(F.trim("question")) > 0)
    ids = chunks.groupBy("chunk_id").agg(F.min("parent_id").alias("_p"), F.min("source_id").alias("_s"))
    known = q.join(ids, q.expected_chunk_id == ids.chunk_id, "left").drop("chunk_id")
    fill = lambda c, other: F.coalesce(F.when(F.length(F.col(c)) > 0, F.col(c)), F.col(other)).alias(c)
    return known.select("question", "expected_chunk_id", fill("expected_source_id", "_s"), fill("expected_parent_id", "_p"), "question_source", F.col("_p").isNotNull().alias("known"))


def save_points(df: DataFrame, path: str, recreate: bool = False) -> None:
    """The vector collection as Parquet, partitioned by what searches filter on; file statistics serve the rest."""
    df.write.mode("overwrite" if recreate else "append").partitionBy("doc_type").parquet(path)
