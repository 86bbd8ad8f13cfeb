"""Problem 10: sentence units of every document by a finite transducer over boundary symbols."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yarrow.common import cut, spread, table

#: Texts above CHUNK code points are cut, each cut before a letter or digit; the rules look back at most LEAD code points.
CHUNK, LEAD = 32_768, 64

#: Abbreviations before a name, before a number, and those after which a sentence goes on in any case.
BEFORE_NAME = frozenset("bs ths pgs gs ts tp tx ks ds lm đ/c dr prof mr mrs ms st ste mme mlle mm pr".split())
BEFORE_NUMBER = frozenset("tr p pp no nr fig figs vol ch art h q t cf số hình mục".split())
GOES_ON = frozenset("i.e e.g vs cf viz c.-à-d c-à-d ex p.ex".split())
CLOSED = frozenset("v.v etc a.m p.m al".split())

_CLOSERS = "\"'”’»)\\]}」』）】》〉"
#: The lexer that turns a text into boundary symbols: blank line, space between Thai characters, stops of both kinds.
_EVENT = re.compile(
    rf"(?P<blank>(?:\r\n?|\n)[^\S\r\n]*[\r\n])|(?P<thai>(?<=[฀-๿])[^\S\r\n]+(?=[฀-๿]))"
    rf"|(?P<wide>[。！？｡]+[{_CLOSERS}]*)|(?P<stop>[.!?…]+[{_CLOSERS}]*(?:\s+»)?)(?=\s|\Z)"
)
_SOLID = re.compile(r"\S")
_WORD = re.compile(r"[^\s(\[{\"“«‘]+\Z")
_INITIAL = re.compile(r"[^\W\d_]\Z")
_ENUMERATOR = re.compile(r"(?:[IVXLC]{1,6}|\d{1,3}|[A-Z])\Z")
_WIDE_LETTER = re.compile(r"[぀-ヿ㐀-鿿豈-﫿々]")
_WIDE_QUOTES = "」』”’"
_OPENERS = "「『“‘"

# The transducer. It reads a tape of symbols: stretches of text between the places that may end a unit, and those places.
# States: before a unit (its first solid character is due), or in a unit that began with a quotation or not, that so far
# is one bare word or not, and that so far has no letters, only small ones, or a capital.
DUE = 0
NEITHER, SMALL, CAPITAL = 0, 1, 2
_BREAKS = re.compile(r"[\s(\[{\"“«‘]")
_CUT = re.compile(r"\w")


def _unit(quoted: int, bare: int, case: int) -> int:
    return 1 + 6 * quoted + 3 * bare + case


STATES = [(None, None, None), *((q, b, c) for q in (0, 1) for b in (0, 1) for c in (NEITHER, SMALL, CAPITAL))]
#: A stretch is known by: something solid, an opening quotation first, bare from its first solid sign on, bare from end to end, case.
STRETCHES = [(s, o, f, a, c) for c in (NEITHER, SMALL, CAPITAL) for a in (0, 1) for f in (0, 1) for o in (0, 1) for s in (0, 1)]
#: What a place does: ends any unit; ends a unit that began without a quotation; neither ends one that is only its
#: enumerator; ends one without capitals; the last two together; is itself the first sign of a unit.
ENDS, MAYBE, UNLESS_BARE, IF_SMALL, IF_SMALL_UNLESS_BARE, SIGN = range(len(STRETCHES), len(STRETCHES) + 6)


def _compiled() -> list[list[int]]:
    """STEP[symbol][state]."""
    table_ = [[(_unit(o, f, c) if s else DUE) if q is None else _unit(q, b & a, max(case, c)) for q, b, case in STATES] for s, o, f, a, c in STRETCHES]
    stay = list(range(len(STATES)))
    table_.append([DUE] * len(STATES))
    table_.append([_unit(0, b, c) if q else DUE for q, b, c in STATES])
    table_.append([n if b else DUE for n, (_, b, _c) in zip(stay, STATES)])
    table_.append([DUE if c == SMALL else n for n, (_, _b, c) in zip(stay, STATES)])
    table_.append([DUE if c == SMALL and not b else n for n, (_, b, c) in zip(stay, STATES)])
    table_.append([_unit(0, 1, NEITHER), *stay[1:]])
    return table_


STEP = _compiled()


def _symbol(text: str, m: re.Match) -> int | None:
    """The symbol of a lexer match, or None if no rule makes it a boundary in any state."""
    kind = m.lastgroup
    if kind in ("blank", "thai"):
        return ENDS
    follow = _SOLID.search(text, m.end())
    c = follow.group() if follow else ""
    mark = m.group()
    if kind == "wide":
        return MAYBE if mark[-1] in _WIDE_QUOTES and follow and follow.start() == m.end() and _WIDE_LETTER.match(c) else ENDS
    stop = mark.rstrip(_CLOSERS.replace("\\", "") + " \t\r\n\xa0\u2009\u202f")
    if stop.endswith("…") or stop.endswith(".."):
        return None if not c or c.islower() or _WIDE_LETTER.match(c) or c.isdigit() else ENDS
    if stop[-1] != ".":
        return None if c.islower() else ENDS
    before = _WORD.search(text, max(0, m.start() - 24), m.start())
    word = before.group() if before else ""
    plain = word.lower()
    number = False
    if len(mark) == len(stop):
        if plain in GOES_ON or (plain in BEFORE_NAME and c.isalpha()) or (plain in BEFORE_NUMBER and c.isdigit()):
            return None
        if word == "M" and c.isupper():
            return None
        at = before.start() if before else 0
        if _INITIAL.match(word) and word.isupper() and c.isupper():
            previous = _WORD.search(text[max(0, at - 24) : at].rstrip())
            held = previous.group() if previous else ""
            # an author's initial behind a species name may end a sentence; an initial of a name never does
            if not (held and held[0].islower() and word == "L"):
                return None
        number = bool(_ENUMERATOR.match(word))
    if c.islower():
        if plain in CLOSED or plain in BEFORE_NAME or plain in BEFORE_NUMBER or len(word) < 2 or len(mark) > len(stop):
            return None
        return IF_SMALL_UNLESS_BARE if number else IF_SMALL
    return UNLESS_BARE if number else ENDS


def _stretch(text: str, inner: int, begin: int, end: int) -> tuple[int, int]:
    """(symbol, first solid position) of text[begin:end]; a unit that goes on also has text[inner:begin] behind it."""
    solid = _SOLID.search(text, begin, end)
    part = text[inner:end]
    whole = not _BREAKS.search(part)
    case = CAPITAL if part != (low := part.lower()) else SMALL if low != part.upper() else NEITHER
    if not solid:
        return 8 * whole + 16 * case, -1
    at = solid.start()
    return 1 + 2 * (solid.group() in _OPENERS) + 4 * (whole or not _BREAKS.search(text, at, end)) + 8 * whole + 16 * case, at


def tape(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """(symbol, position) of text[begin:end]. No place that may end a unit holds a letter or digit, so tapes of pieces cut before one join."""
    out: list[tuple[int, int]] = []
    at = inner = begin
    for m in _EVENT.finditer(text, begin):
        if m.start() >= end:
            break
        symbol = _symbol(text, m)
        if symbol is None:
            continue
        out.append(_stretch(text, inner, at, m.start()))
        if m.lastgroup in ("wide", "stop"):
            out.append((SIGN, m.start()))
        out.append((symbol, -1))
        at, inner = m.end(), m.start()
    out.append(_stretch(text, inner, at, end))
    return out


def run(symbols: list[tuple[int, int]], state: int) -> tuple[list[int], int]:
    """Starts of units for a state on entry, and the state on leaving."""
    starts: list[int] = []
    for symbol, at in symbols:
        new = STEP[symbol][state]
        if not state and new:
            starts.append(at)
        state = new
    return starts, state


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Of functions on states, given as rows of their values."""
    return np.take_along_axis(then, first, axis=1)


def prefix_scan(functions: np.ndarray) -> np.ndarray:
    """Row k: the composition of functions 0..k, by doubling (log n rounds, each vectorised)."""
    out, step = functions.copy(), 1
    while step < len(out):
        out[step:] = compose(out[:-step].copy(), out[step:])
        step *= 2
    return out


def unit_starts(text: str) -> list[int]:
    return run(tape(text, 0, len(text)), DUE)[0]


def pieces(text: str, chunk: int) -> list[tuple[int, int]]:
    """(begin, end) of about ``chunk`` code points each, cut before a letter or digit."""
    out, begin = [], 0
    while begin < len(text):
        m = _CUT.search(text, begin + chunk) if begin + chunk < len(text) else None
        end = m.start() if m else len(text)
        out.append((begin, end))
        begin = end
    return out


def _short(df: DataFrame, key: str, kind: str) -> DataFrame:
    def scan(batches):
        for batch in batches:
            keys, starts = [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                found = unit_starts(t)
                starts += found
                keys += [row] * len(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(starts, pa.int64())], names=[key, "start_char"])

    return spread(df).mapInArrow(scan, f"{key} {kind}, start_char bigint")


def _long(df: DataFrame, key: str, kind: str, chunk: int) -> DataFrame:
    """Each piece yields its state function and its unit starts for every state on entry; the functions of a document are
    composed by a prefix scan, which tells the state that each piece is entered in.

    Only the functions, a few bytes a piece, come together by document. A document's place in the table, not its
    key, ties its pieces together, so that repeated keys do no harm.
    """
    base = df.select(F.col(key).alias("_key"), F.xxhash64(F.xxhash64("_text"), F.monotonically_increasing_id()).alias("_doc"), "_text")

    def parted(batches):
        for b in batches:
            for row, t in enumerate(b.column(2).to_pylist()):
                for no, (begin, end) in enumerate(pieces(t, chunk)):
                    lead = min(begin, LEAD)
                    made = [pa.array([no], pa.int32()), pa.array([begin], pa.int64()), pa.array([end], pa.int64()), pa.array([t[begin - lead : end + 1]])]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(row, 1), b.column(1).slice(row, 1), *made], names=["_key", "_doc", "_no", "_begin", "_end", "_part"])

    def scan(batches):
        for b in batches:
            functions, found = [], []
            for begin, end, part in zip(*[b.column(c).to_pylist() for c in (3, 4, 5)]):
                lead = min(begin, LEAD)
                symbols = tape(part, lead, lead + end - begin)
                results = [run(symbols, s) for s in range(len(STATES))]
                functions.append([r[1] for r in results])
                found.append([[at - lead + begin for at in r[0]] for r in results])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(functions, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.list_(pa.int64())))], names=["_key", "_doc", "_no", "_f", "_starts"])

    cutting = base.mapInArrow(parted, f"_key {kind}, _doc bigint, _no int, _begin bigint, _end bigint, _part string")
    done = cut(cutting.repartition("_doc", "_no").mapInArrow(scan, f"_key {kind}, _doc bigint, _no int, _f array<int>, _starts array<array<bigint>>"))

    def enter(t: pa.Table) -> pa.Table:
        t = t.sort_by("_no")
        upto = prefix_scan(np.array(t["_f"].to_pylist(), dtype=np.int64))[:, DUE]
        return pa.table({"_doc": t["_doc"], "_no": t["_no"], "_entry": pa.array([DUE, *upto[:-1].tolist()], pa.int32())})

    entries = done.select("_doc", "_no", "_f").groupBy("_doc").applyInArrow(enter, "_doc bigint, _no int, _entry int")
    return done.join(entries, ["_doc", "_no"]).select(F.col("_key").alias(key), F.explode(F.col("_starts")[F.col("_entry")]).alias("start_char"))


def sentence_units(df: DataFrame, key: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """(key, start_char) for every sentence unit, 0-based in code points.

    Null, empty and blank texts give no rows; repeated rows give their units each. Texts of up to ``chunk``
    code points take one narrow stage without a shuffle; longer ones are cut and have the same units as if they were not, so
    that a text of any length spreads over tasks.
    """
    kind = df.schema[key].dataType.simpleString()
    base = df.select(F.col(key), F.col(text).alias("_text")).where(F.length("_text") > 0)
    short, long = base.where(F.length("_text") <= chunk), base.where(F.length("_text") > chunk)
    return _short(short, key, kind).unionByName(_long(long, key, kind, chunk))


def p10_found(spark, sf_dir):
    """doc_id, start_char of every sentence unit."""
    return sentence_units(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p10_found": p10_found}
SQL: dict[str, str] = {}
