"""Scalar text functions as Column expressions; Python runs only for Unicode normalisation forms."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as str.strip() and DuckDB's \s see it in these texts.
WS = r"[ \t\n\r\f\x0B]"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Every letter of the basic plane that decomposes to one base and marks, with its base, then the marks, which have none; built from the rule."""
    source, target = [], []
    for c in (*range(0xC0, 0xAC00), *range(0xF900, 0xFB00)):
        parts = unicodedata.normalize("NFD", chr(c))
        bases = [x for x in parts if unicodedata.category(x) != "Mn"]
        if len(parts) > 1 and len(bases) == 1:
            source.append(chr(c))
            target.append(bases[0])
    marks = (chr(c) for c in range(0x300, 0x110000) if unicodedata.category(chr(c)) == "Mn")
    return "".join(source) + "đĐ" + "".join(marks), "".join(target) + "dD"


def fold_accents(t: Column) -> Column:
    """Base letters without marks, đ as d."""
    return F.translate(t, *_folding())


def strip(t: Column) -> Column:
    return F.regexp_replace(t, f"^{WS}+|{WS}+$", "")


def collapse(t: Column) -> Column:
    return strip(F.regexp_replace(t, f"{WS}+", " "))


def short_hash(t: Column, n: int = 12) -> Column:
    """B2: the first n hex digits of SHA-1."""
    return F.substring(F.sha1(t), 1, n)


def fingerprint(t: Column) -> Column:
    """B1: sha1:<hex> of content."""
    return F.concat(F.lit("sha1:"), F.sha1(t))


def point_id(t: Column) -> Column:
    """The first 16 hex digits of SHA-1 as an unsigned 64-bit number, in decimal(20,0)."""
    return F.conv(F.substring(F.sha1(t), 1, 16), 16, 10).cast("decimal(20,0)")


def category(path: Column, anchor: str) -> Column:
    """The path part behind ``anchor``, else 'unknown'."""
    found = F.regexp_extract(path, f"/{anchor}/([^/]+)/", 1)
    return F.when(F.length(found) > 0, found).otherwise("unknown")


def doc_type(path: Column) -> Column:
    """A5: document type by file extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("doc", "docx"), "docx").when(ext.isin("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"), "image").when(ext == "txt", "txt").otherwise("other")


def excluded(path: Column, parts: list[str]) -> Column:
    """Some part of the path is an excluded folder."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in parts]))


def normalise_query(t: Column) -> Column:
    """B24 = B27: composed, lower case, white space collapsed."""
    return collapse(F.lower(nfc(t)))


def normalise_query_plain(t: Column) -> Column:
    """B24 without accents."""
    return fold_accents(normalise_query(t))


def explained(t: Column) -> Column:
    """Every stage of B25."""
    return F.struct(t.alias("original"), nfc(t).alias("composed"), F.lower(nfc(t)).alias("lowered"), normalise_query(t).alias("normalised"), normalise_query_plain(t).alias("folded"))


def tokens(t: Column) -> Column:
    """B28 without phrases: folded, split at white space, punctuation kept; an empty array for blank text."""
    return F.filter(F.split(fold_accents(F.lower(t)), f"{WS}+"), lambda x: F.length(x) > 0)


def with_phrases(words: Column, phrases: list[str], sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Words, then a_b_c for each occurrence of a known phrase, shorter phrases first."""
    known = F.array(*[F.lit(p.replace(" ", "_")) for p in phrases]) if phrases else F.array().cast("array<string>")

    def grams(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), "_"))
        return F.when(F.size(words) >= n, F.filter(every, lambda g: F.array_contains(known, g))).otherwise(F.array().cast("array<string>"))

    return F.concat(words, *map(grams, sizes))


def keywords(t: Column, n: int = 5) -> Column:
    """The n longest distinct words of three letters or more, ties in order of appearance."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"([\p{L}]{3,})")), F.lower))
    placed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(placed), 1, n), lambda s: s["w"])


def query_terms(t: Column, stop: list[str]) -> Column:
    """Folded words of two characters or more that are no stop words, distinct."""
    words = F.regexp_extract_all(fold_accents(F.lower(t)), F.lit(r"([\p{L}\p{N}_]+)"))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop)))


def snippet(t: Column, most: int = 360) -> Column:
    """White space collapsed, cut with an ellipsis."""
    flat = collapse(t)
    return F.when(F.length(flat) > most, F.concat(F.regexp_replace(F.substring(flat, 1, most - 3), r"\s+$", ""), F.lit("..."))).otherwise(flat)


def citations(t: Column) -> Column:
    """Distinct [E<n>] marks in order."""
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"\[(E\d+)\]")))


def id_list(t: Column, sign: str = r"\|") -> Column:
    """Distinct non-empty parts of a parted list."""
    return F.array_distinct(F.filter(F.transform(F.split(t, sign), strip), lambda x: F.length(x) > 0))


def partly_folded(t: Column) -> Column:
    """Every second word without accents, the first kept."""
    return F.array_join(F.transform(F.split(t, " "), lambda w, i: F.when(i % 2 == 0, w).otherwise(fold_accents(w))), " ")


def json_object(t: Column) -> Column:
    """The text as JSON, else its part from the first { to the last }; null if neither parses."""
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(inner))


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a small term that keeps zero vectors from dividing by zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b) + 1e-12)


# --- cleaning -----------------------------------------------------------------------------------------------------

_VI = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
_LOWER, _UPPER = f"a-z{_VI}", f"A-Z{_VI.upper()}"


def strip_hidden(t: Column) -> Column:
    """Zero-width characters removed."""
    return F.translate(t, "​‌‍⁠﻿", "")


def tidy_lines(t: Column) -> Column:
    """Blanks collapsed in each line, at most two blank lines in a row, trimmed."""
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^ | $", ""))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{4,}", "\n\n\n"))


def encoding_noise(t: Column) -> Column:
    """Struct of the replacement-sign ratio, the odd-sign ratio and whether Cyrillic occurs; denominators without white space."""
    solid = F.greatest(F.length(F.regexp_replace(t, r"\s", "")), F.lit(1))
    lost = F.length(t) - F.length(F.translate(t, "�", ""))
    odd = F.length(t) - F.length(F.translate(t, "�¤¦§¨©ª¬®¯°±²³´µ¶¸¹º¼½¾×÷", ""))
    return F.struct((odd / solid).alias("bad_ratio"), (lost / solid).alias("lost_ratio"), (F.regexp_count(t, F.lit("[Ѐ-ӿ]")) > 0).alias("has_cyrillic"))


def is_noise(t: Column) -> Column:
    """Fewer than four characters, or nothing but rule lines and punctuation."""
    flat = strip(t)
    return (F.length(flat) < 4) | flat.rlike(r"^[\p{P}\p{S}\s_]*(?:[oO0][\p{P}\p{S}\s_0oO]*)?[\p{P}\p{S}\s_]*$")


def join_latin_breaks(t: Column) -> Column:
    """An ASCII word cut by a line break is whole again."""
    return F.regexp_replace(t, r"(?<![^\s(])([A-Za-z][a-z]{2,})\n([a-z]{2,7})(?=[\s.,;:)]|$)", "$1$2")


def join_hyphens(t: Column) -> Column:
    """A word hyphenated over a line break is whole again."""
    return F.regexp_replace(t, rf"([{_LOWER}{_UPPER}]{{2,}})-[ \t]*\n[ \t]*([{_LOWER}]+)", "$1$2")


def join_capital_fragments(t: Column) -> Column:
    """A capitalised piece of two or three letters joins the small-letter word behind it."""
    return F.regexp_replace(t, r"(?<![\p{L}])([A-Z][a-z]{1,2}) ([a-z]{3,})(?![\p{L}])", "$1$2")


def join_page_lines(t: Column) -> Column:
    """Single line breaks are spaces, blank lines stay."""
    return F.regexp_replace(t, r"(?<!\n)\n(?!\n)", " ")


def drop_inner_signs(t: Column) -> Column:
    """| and # between word characters removed."""
    return F.regexp_replace(t, r"(?<=[\p{L}\p{N}])[|#]+(?=[\p{L}\p{N}])", "")


def strip_page_numbers(t: Column) -> Column:
    """Lines that hold only a page number are dropped, blank runs capped."""
    lines = F.filter(F.split(t, "\n"), lambda x: ~x.rlike(r"^\s*[-–—]*\s*\d{1,4}\s*[-–—]*\s*$"))
    return F.regexp_replace(F.array_join(lines, "\n"), "\n{4,}", "\n\n\n")


def garbled_legacy_font(t: Column, ratio: float = 0.02, strong: int = 10) -> Column:
    """The share of letters that legacy Vietnamese fonts show is high. A flag only: right French has some, too."""
    marks = F.length(t) - F.length(F.translate(t, "µ¸¶·¹®©ª«¬¨­", ""))
    return (marks > strong) | (marks / F.greatest(F.length(t), F.lit(1)) > ratio)


#: Vietnamese syllables: all vowels, those with a mark, marked ones that no diphthong leads on from, and what a syllable begins with.
_MARKED = "".join(c for c in _VI if c != "đ")
_VOWEL = f"[aeiouy{_MARKED}]"
_ONSET = "(?:ngh|ch|gh|gi|kh|ng|nh|ph|th|tr|qu|[bcdfghjklmnpqrstvwxzđ])"


def _family(base: str) -> str:
    """A vowel with each tone."""
    return "".join(unicodedata.normalize("NFC", base + tone) for tone in ("", "\u0301", "\u0300", "\u0309", "\u0303", "\u0323"))


#: B6's places where two words were glued together, in their order.
GLUED = (
    rf"(?<=[{_LOWER}])(?=[{_UPPER}])",
    rf"(?<=[.)\]!?;:])(?=[{_LOWER}{_UPPER}])",
    rf"(?iu)(?<=[{_MARKED}])(?={_ONSET}{_VOWEL})",
    rf"(?iu)(?<=[aeiouy])(?={_ONSET}[{_MARKED}])",
    rf"(?iu)(?<={_VOWEL}[cmnpt])(?=[bcdfghjklmnpqrstvwxzđ]{{1,2}}{_VOWEL})",
    # ươ is one sound, so a plain ư parts nothing from the ơ family
    rf"(?iu)(?<=[{_MARKED}])(?=[{_family('ă')}{_family('â')}{_family('ư')}])|(?<=[{_MARKED.replace('ư', '')}])(?=[{_family('ơ')}])",
)


def clean_passage(t: Column) -> Column:
    """Composed, control characters out, line ends unified, blanks collapsed, glued words parted, blank lines capped."""
    x = F.regexp_replace(nfc(t), r"[\p{C}&&[^\n\r\t]]", "")
    x = F.regexp_replace(F.regexp_replace(F.translate(x, "�", " "), "\r\n?", "\n"), r"[ \t]+", " ")
    for place in GLUED:
        x = F.regexp_replace(x, place, " ")
    return tidy_lines(x)


def cleaned_record(text: Column, confidence: Column, least: float = 0.75) -> list[Column]:
    """The cleaned text, whether that changed it, and whether the scan's confidence is low; a null text stays as it is."""
    clean = F.coalesce(clean_passage(text), text)
    return [clean.alias("text"), (~clean.eqNullSafe(text)).alias("text_cleaned"), F.coalesce(confidence < least, F.lit(False)).alias("low_ocr_confidence")]


def clean_chunk(t: Column, kind: Column, join_capitals: bool = True) -> Column:
    """The post-chunk normaliser; the noise flag is ``chunk_is_noise``."""
    x = F.regexp_replace(strip_hidden(nfkc(F.translate(t, "�", " "))), "\r\n?", "\n")
    x = join_hyphens(join_latin_breaks(x))
    x = join_scientific(x)
    x = join_capital_fragments(x) if join_capitals else x
    x = drop_inner_signs(F.when(kind == "pdf", join_page_lines(x)).otherwise(x))
    return F.when((kind == "image") & is_noise(t), "").otherwise(tidy_lines(x))


def chunk_is_noise(t: Column, kind: Column) -> Column:
    noise = encoding_noise(t)
    return ((kind == "image") & is_noise(t)) | (noise["bad_ratio"] > 0.03) | (noise["lost_ratio"] > 0.005)


@F.pandas_udf(StringType())
def join_scientific(s: pd.Series) -> pd.Series:
    """Small-letter pieces are joined inside the span behind a 'scientific name:' label."""
    import re

    label = re.compile(r"((?:tên khoa học|scientific name)\s*:\s*)([^\n.;()-]{3,80})", re.I)
    pieces = re.compile(r"\b([A-Za-z][a-z]{2,5}) ([a-z]{2,4})\b(?! [a-z]{5,})")
    first = re.compile(r"\b([A-Z][a-z]{1,3}) ([a-z]{4,})\b")

    def fix(m: re.Match) -> str:
        return m.group(1) + pieces.sub(r"\1\2", first.sub(r"\1\2", m.group(2)))

    return s.map(lambda t: label.sub(fix, t), na_action="ignore")
