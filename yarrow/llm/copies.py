"""Problem 4: records that differ in spacing, case, punctuation or field order, by dictionary encoding."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yarrow.common import cut, spread, table

LEAST_LETTERS = 20
#: Code points that are canonicalised at once.
SLICE = 4_000_000
#: A labelled field: a label of words, a colon, an equals sign, a tab or a dash between spaces, a value.
_FIELD = re.compile(r"[\W_]*([^\W\d_][\w ./’'*()̀-ͯ-]{0,60}?)[*_ ]*(?:[:：=＝\t]|\s[–—-]\s)(.*)", re.S)
#: What parts fields, in the order in which it is tried; so a line break inside a semicolon-parted value parts nothing.
_PARTS = (re.compile("[;；]"), re.compile("[|｜]"), re.compile("[\n\r]+"))


@lru_cache(maxsize=1)
def _kept() -> np.ndarray:
    """What a record keeps of a text, by code point: letters (with their marks) and digits."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), dtype=bool, count=0x110000)


def canonical(values: list[str]) -> tuple[list[bytes], list[int]]:
    """(identifier, number of letters and digits) of each value: a 128-bit hash of its case-folded letters and digits."""
    ids: list[bytes] = []
    sizes: list[int] = []
    group: list[str] = []
    n = 0

    def flush() -> None:
        codes = np.frombuffer("\n".join([*group, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        keep = _kept()[codes]
        ends = np.cumsum(keep)[codes == 10].tolist()
        raw = codes[keep].tobytes()
        at = 0
        for end in ends:
            ids.append(xxhash.xxh3_128_digest(raw[4 * at : 4 * end]))
            sizes.append(end - at)
            at = end

    for v in values:
        group.append(v.casefold().replace("\n", " "))
        n += len(v)
        if n > SLICE:
            flush()
            group, n = [], 0
    if group:
        flush()
    return ids, sizes


def labelled_fields(text: str) -> list[tuple[str, str]]:
    """The (label, value) fields of a text that consists of labelled fields, else none.

    The part sign is the first of semicolon, vertical bar and line break by which every part starts with a label.
    """
    if not re.search("[:：=＝\t–—-]", text):
        return []
    for sign in _PARTS:
        parts = [p for p in sign.split(text) if re.search(r"\w", p)]
        if len(parts) < 2:
            continue
        fields = []
        for p in parts:
            m = _FIELD.match(p)
            if m is None:
                break
            fields.append(m.groups())
        else:
            return fields
    return []


def _encoded(texts: list[str]) -> list[tuple[bytes, int, list[bytes]]]:
    """(identifier of the whole text, its letters, sorted identifiers of its fields); each distinct value is canonicalised once."""
    fields = [labelled_fields(t) for t in texts]
    values = list(dict.fromkeys([*texts, *(v for f in fields for pair in f for v in pair)]))
    ids, sizes = canonical(values)
    at = {v: i for i, v in enumerate(values)}
    out = []
    for t, f in zip(texts, fields):
        whole = at[t]
        out.append((ids[whole], sizes[whole], sorted(xxhash.xxh3_128_digest(ids[at[label]] + ids[at[value]]) for label, value in f)))
    return out


def _integers(digests: list[bytes]) -> list[int]:
    return np.frombuffer(b"".join(digests), dtype=np.int64).tolist()


def record_keys(df: DataFrame, key: str, text: str, least: int = LEAST_LETTERS) -> DataFrame:
    """(key, letters, record) of every row; record is the tuple of integer identifiers of texts of ``least`` letters and digits or more.

    Of labelled fields it holds those of each label with its value, sorted; of any other text that of its letters
    and digits. An identifier has 128 bits, as two integers, so different values share none. Null, empty and
    shorter texts have a null record. Texts with the same letters and digits in the same order share a
    record even if only one of them shows its fields, and so do texts that such texts link. Texts are never
    shuffled: each task encodes the distinct values of its batches, and only integers cross the exchanges.
    """
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = _encoded([t for t in texts if t is not None])
            every = iter(rows)
            full = [next(every) if t is not None else (b"", 0, []) for t in texts]
            good = [n >= least for _, n, _ in full]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([n for _, n, _ in full], pa.int64()), pa.array([_integers([w]) if g else None for (w, _, _), g in zip(full, good)], pa.list_(pa.int64())),
                    pa.array([_integers(f) if g and f else None for (_, _, f), g in zip(full, good)], pa.list_(pa.int64())),
                ],
                names=["_key", "letters", "whole", "ids"],
            )

    base = spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    coded = cut(base.mapInArrow(run, f"_key {kind}, letters bigint, whole array<bigint>, ids array<bigint>"))
    shown = _shown(coded.where("ids IS NOT NULL").select("whole", "ids").distinct())
    return coded.join(shown, "whole", "left").select(F.col("_key").alias(key), "letters", F.coalesce("shown", "whole").alias("record"))


def _shown(edges: DataFrame) -> DataFrame:
    """(whole, shown): the field tuple that stands for a letter sequence, and for all that are linked with it by either."""
    edges = cut(edges)
    labels = edges.groupBy("whole").agg(F.min("ids").alias("shown"), F.max("ids").alias("_last"))
    if labels.where("shown <> _last").isEmpty():
        return labels.drop("_last")
    # letters that can be read as different fields are rare; their links are followed to the end
    labels = cut(labels.drop("_last"))
    while True:
        by_fields = edges.join(labels, "whole").groupBy("ids").agg(F.min("shown").alias("low"))
        lower = cut(edges.join(by_fields, "ids").groupBy("whole").agg(F.min("low").alias("shown")))
        if lower.join(labels.withColumnRenamed("shown", "_old"), "whole").where("shown <> _old").isEmpty():
            return lower
        labels = lower


def copies(df: DataFrame, key: str, text: str, least: int = LEAST_LETTERS) -> DataFrame:
    """(first, copy) for each record's members but the first by ``key``.

    The groups are pre-aggregated before the exchange (min and count combine on the map side), so a
    record that holds a third of all rows costs one row a task; only groups with copies are joined back.
    """
    keys = record_keys(df, key, text, least).where("record IS NOT NULL")
    groups = keys.groupBy("record").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return keys.join(groups, "record").where(F.col("_first") < F.col(key)).select(F.col("_first").alias("first"), F.col(key).alias("copy"))


def collapsed(df: DataFrame, key: str, text: str, least: int = LEAST_LETTERS) -> DataFrame:
    """(key, n_copies): one row for each record, its lowest key and its number of copies, itself included.

    Texts too short to be compared stay as they are, one row each; null texts too.
    """
    keys = record_keys(df, key, text, least)
    groups = keys.where("record IS NOT NULL").groupBy("record").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n_copies")).drop("record")
    return groups.unionByName(keys.where("record IS NULL").select(key, F.lit(1).cast("long").alias("n_copies")))


def p4_found(spark, sf_dir):
    """first_ord, copy_ord of chunks that are the same record."""
    return copies(table(spark, sf_dir, "chunks"), "ord", "text").select(F.col("first").alias("first_ord"), F.col("copy").alias("copy_ord"))


def p4_records(spark, sf_dir):
    """Each record once, by its lowest ord, with its number of copies."""
    return collapsed(table(spark, sf_dir, "chunks"), "ord", "text")


QUERIES = {"p4_found": p4_found, "p4_records": p4_records}
_CANON = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')"
_SQL_FIELD = r"(?s)^[^\p{L}\p{N}]*(\p{L}[\p{L}\p{M}\p{N}_ ./’''*()-]{0,60}?)[*_ ]*(?:[:：=＝\t]|\s[–—-]\s)(.*)$"
_SIGNS = ("[;；]", "[|｜]", r"[\n\r]+")
#: Fields by brute force: parts of each sign, all of them labelled, as canonical label and value.
_ORACLE = (
    r"WITH c AS (SELECT ord, text, " + _CANON.format("text") + " w FROM chunks WHERE text IS NOT NULL), k AS (SELECT * FROM c WHERE length(w) >= 20), p AS (SELECT ord, w, "
    + ", ".join(f"list_filter(regexp_split_to_array(text, '{sign}'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}_]')) p{n}" for n, sign in enumerate(_SIGNS)) + " FROM k), g AS (SELECT ord, w, CASE "
    + " ".join(f"WHEN len(p{n}) >= 2 AND len(list_filter(p{n}, lambda x: regexp_matches(x, '{_SQL_FIELD}'))) = len(p{n}) THEN p{n}" for n in range(3)) + " END f FROM p),\n"
    + "t AS (SELECT ord, w, CASE WHEN f IS NOT NULL THEN array_to_string(list_sort(list_transform(f, lambda x: " + _CANON.format(f"regexp_extract(x, '{_SQL_FIELD}', 1)") + " || chr(1) || " + _CANON.format(f"regexp_extract(x, '{_SQL_FIELD}', 2)") + ")), chr(2)) END r FROM g),\n"
    + "s AS (SELECT w, min(r) shown FROM t WHERE r IS NOT NULL GROUP BY 1), z AS (SELECT ord, coalesce(shown, w) r FROM t LEFT JOIN s USING (w))\n"
)
SQL = {
    "p4_found": _ORACLE + "SELECT first_ord, ord copy_ord FROM (SELECT ord, min(ord) OVER (PARTITION BY r) first_ord FROM z) WHERE first_ord < ord",
    "p4_records": _ORACLE + "SELECT min(ord) ord, count(*) n_copies FROM z GROUP BY r UNION ALL SELECT ord, 1 n_copies FROM chunks WHERE ord NOT IN (SELECT ord FROM z)",
}
