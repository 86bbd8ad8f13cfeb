"""Problem 3: content-defined splitting of oversized texts at natural boundaries."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yarrow.common import running_before, spread, table

LIMIT, LEAST, OVERLAP = 1500, 500, (100, 200)
#: Width of the rolling hash, and how far a landmark may move to a boundary.
WIDTH, SNAP = 24, 150

_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"(?:[.!?…][\"'”’»)\]]*\s+|[。！？][」』”’）]*\s*|\n)(?=\S)")
_WORD = re.compile(r"\s+(?=\S)|(?<=[぀-ヿ㐀-鿿、，；])(?=[぀-ヿ㐀-鿿])")
_JOINED = re.compile(r"[̀-ͯ‍︀-️ัิ-ฺ็-๎]")


def _landmarks(text: str) -> np.ndarray:
    """A polynomial rolling hash of the WIDTH characters before each position (uint64, wrapping)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashes = np.zeros(len(codes) + 1, dtype=np.uint64)
    for k in range(WIDTH):
        hashes[WIDTH:] += np.roll(mixed, k)[WIDTH - 1 :] * np.uint64(pow(0x100000001B3, k, 1 << 64))
    return hashes ^ (hashes >> np.uint64(29))


def _nearest(at: int, spots: np.ndarray, low: int, high: int) -> int | None:
    spots = spots[(spots >= low) & (spots <= high)]
    return int(spots[np.argmin(np.abs(spots - at))]) if len(spots) else None


def cuts(text: str, limit: int = LIMIT, least: int = LEAST, overlap: tuple[int, int] = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece; consecutive pieces share between overlap[0] and overlap[1] characters.

    The landmark of a window is the position of its smallest rolling hash: it depends on nearby
    characters only, so an edit moves the cuts of neighbouring pieces and later cuts fall back into
    place. The landmark snaps to the nearest paragraph end, else sentence end, else word end; a text
    without any is cut at the landmark.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    hashes = _landmarks(text)
    kinds = [np.array([m.end() for m in r.finditer(text)], dtype=np.int64) for r in (_PARAGRAPH, _SENTENCE, _WORD)]
    out, start, fresh = [], 0, 0
    while n - start > limit:
        low, high = max(fresh + 1, start + min(least, limit - 1)), start + limit
        if n - high < overlap[0]:  # leave enough for a last piece
            high = max(low, n - overlap[0])
        # the most characteristic place of the second half of the window, found again after edits before it
        first = min(high, max(low, high - 3 * SNAP * 2))
        mark = first + int(np.argmin(hashes[first : high + 1]))
        end = None
        for spots, reach in zip(kinds, (2 * SNAP, SNAP, SNAP)):
            end = _nearest(mark, spots, max(low, mark - reach), min(high, mark + reach))
            if end is not None:
                break
        if end is None:
            end = next((s for spots in kinds if (s := _nearest(mark, spots, low, high)) is not None), mark)
            while end > low and end < n and _JOINED.match(text[end]):
                end -= 1
        out.append((start, end))
        fresh = end
        middle = end - (overlap[0] + overlap[1]) // 2
        back = next((s for spots in kinds[1:] if (s := _nearest(middle, spots, end - overlap[1], end - overlap[0])) is not None), middle)
        while back > end - overlap[1] and _JOINED.match(text[back]):
            back -= 1
        start = back
    out.append((start, n))
    return out


def split_texts(df: DataFrame, text: str, keys: list[str], limit: int = LIMIT, least: int = LEAST, overlap: tuple[int, int] = OVERLAP) -> DataFrame:
    """Pieces (keys, piece_no, n_pieces, start_char, piece) of every row.

    Texts up to ``limit`` code points, the empty text included, stay one piece and never leave the JVM; null
    texts give one null piece. Repeated rows are cut each for itself; ties cannot occur. Columns other
    than ``keys`` are dropped, so clashing names do no harm.
    """
    base = df.select(*keys, F.col(text).alias("_text"))
    short = base.where(F.col("_text").isNull() | (F.length("_text") <= limit)).select(
        *keys, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_char"), F.col("_text").alias("piece")
    )

    def run(batches):
        for b in batches:
            rows, numbers, sizes, starts, pieces = [], [], [], [], []
            for row, t in enumerate(b.column(len(keys)).to_pylist()):
                spans = cuts(t, limit, least, overlap)
                rows += [row] * len(spans)
                numbers += range(len(spans))
                sizes += [len(spans)] * len(spans)
                starts += [a for a, _ in spans]
                pieces += [t[a:e] for a, e in spans]
            at = pa.array(rows, pa.int64())
            made = [pa.array(x, pa.int32()) for x in (numbers, sizes, starts)]
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in range(len(keys))], *made, pa.array(pieces, pa.string())], names=[*keys, "piece_no", "n_pieces", "start_char", "piece"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    long = spread(base.where(F.length("_text") > limit)).mapInArrow(run, f"{kinds}, piece_no int, n_pieces int, start_char int, piece string")
    return short.unionByName(long)


def renumbered(df: DataFrame, pieces: DataFrame, key: str, parent: str, order: list[str]) -> DataFrame:
    """Pieces with child_index numbered anew from 0 over their parent's pieces in reading order.

    Only (key, parent, order, number of pieces) takes part in the numbering, never the text; a
    parent that holds most rows covers many partitions (see running_before).
    """
    counts = pieces.where("piece_no = 0").select(key, "n_pieces")
    rows = df.select(key, parent, *[c for c in order if c not in (key, parent)]).join(counts, key)
    numbered = running_before(rows, [parent], [F.col(c) for c in order], F.col("n_pieces"))
    return pieces.join(numbered.select(key, parent, "before"), key).withColumn("child_index", (F.col("before") + F.col("piece_no")).cast("int")).drop("before")


def p3_found(spark, sf_dir):
    """ord of the chunks that the splitter cuts into several pieces, one row each."""
    return split_texts(table(spark, sf_dir, "chunks"), "text", ["ord"]).where("n_pieces > 1 AND piece_no = 0").select("ord")


def p3_rebuilt(spark, sf_dir):
    """ord, n_chars, bad of every chunk with text, from its pieces alone: bad counts pieces that are too long, overlap wrongly or are not
    what the text has there; n_chars is the length that they cover without a gap."""
    chunks = table(spark, sf_dir, "chunks")
    pieces = split_texts(chunks, "text", ["ord"]).where("piece IS NOT NULL").select("ord", "piece_no", "start_char", "piece")
    placed = pieces.join(chunks.select("ord", "text"), "ord")
    row = F.struct("piece_no", "start_char", (F.col("start_char") + F.length("piece")).alias("end_char"), ((F.length("piece") > LIMIT) | (F.col("piece") != F.expr("substring(text, start_char + 1, length(piece))"))).alias("bad"))
    state = "struct<upto:int,bad:int>"
    fold = f"aggregate(array_sort(r), CAST(named_struct('upto', 0, 'bad', 0) AS {state}), (s, x) -> named_struct('upto', x.end_char, 'bad', s.bad + IF(x.bad OR (x.piece_no = 0 AND x.start_char <> 0) OR (x.piece_no > 0 AND s.upto - x.start_char NOT BETWEEN {OVERLAP[0]} AND {OVERLAP[1]}), 1, 0)))"
    return placed.groupBy("ord").agg(F.collect_list(row).alias("r")).select("ord", F.expr(fold).alias("s")).select("ord", F.col("s.upto").cast("bigint").alias("n_chars"), F.col("s.bad").cast("bigint").alias("bad"))


def p3_pieces(spark, sf_dir):
    """All chunks after splitting, renumbered under their parent."""
    chunks = table(spark, sf_dir, "chunks")
    pieces = split_texts(chunks, "text", ["ord"])
    return renumbered(chunks, pieces, "ord", "parent_id", ["child_index", "ord"]).select("parent_id", "child_index", "ord", "piece_no", "start_char", "piece")


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_rebuilt": p3_rebuilt}
SQL = {
    "p3_found": "SELECT ord FROM chunks WHERE length(text) > 1500",
    "p3_rebuilt": "SELECT ord, length(text) n_chars, 0::BIGINT bad FROM chunks WHERE text IS NOT NULL",
}
