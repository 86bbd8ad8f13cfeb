"""Problem 2: text that looks the same but differs in its characters, brought to one form."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yarrow.common import spread, table

# Letters of other alphabets, and of other Latin codes, that look like a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮҺԛԜабеѕіјкмнорстухүһԁԍԝѵ", "ABESIJKMHOPCTYXYHqWaбesijкмнopctyxyhdGwv"))
CYRILLIC = {k: v for k, v in CYRILLIC.items() if v.isascii()}
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονρυικϲαγ", "ABEZHIKMNOPTYXCjovpuikcay"))
#: Greek letters that are also signs of their own, and change only inside a word with Latin letters.
_SIGNS = frozenset("αγυικ")
LATIN = {"Ɖ": "Đ", "Ð": "Đ", "ð": "đ", "ɖ": "đ", "ı": "i", "ɡ": "g", "ɑ": "a", "ǀ": "l", "ƙ": "k", "ʋ": "v", "ɩ": "i", "ɪ": "i", "ʏ": "y", "ꞵ": "b", "ᴏ": "o", "ᴠ": "v", "ƅ": "b"}
ARMENIAN = dict(zip("ՕօՏսոհցյԼզ", "OoSunhgjLq"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"))
ALIEN = CYRILLIC | GREEK | ARMENIAN | CHEROKEE
ALIKE = ALIEN | LATIN

#: Everything that a property of Unicode calls ignorable by default, and every space but the plain one.
_IGNORED = frozenset(regex.findall(r"\p{Default_Ignorable_Code_Point}", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))))
#: Letter-like signs, which are no letters in a form of their own.
_LETTERLIKE = range(0x2100, 0x2150)


class _Compatible(dict):
    """By code point: what compatibility normalisation makes of letters and digits in a form of their own, joined letters, spaces and ignorables.

    Superscripts, fractions, circled and squared signs, ellipsis and degree signs have compatibility forms as well, but
    are signs of their own, and stay. Full-width signs depend on the script around them.
    """

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind, tag = unicodedata.category(c), unicodedata.decomposition(c).partition(" ")[0]
        whole = unicodedata.normalize("NFKC", c)
        if c in _IGNORED:
            new = ""
        elif kind == "Zs":
            new = " "
        elif tag in ("<wide>", "<font>") and kind[0] in "LN" and code not in _LETTERLIKE:
            new = whole
        elif tag == "<compat>" and kind[0] == "L" and len(whole) > 1 and unicodedata.name(c).startswith("LATIN") and whole.isalpha():
            new = whole
        else:
            new = c
        self[code] = new
        return new


_compatible = _Compatible({c: chr(c) for c in range(0x80)})
_SIGN_RUN = re.compile("[！-／：-＠［-｀｛-～]")


@lru_cache(maxsize=1)
def _any() -> re.Pattern:
    """Anything of the basic plane that the repair may change besides composition."""
    codes = (*range(0x80, 0xD800), *range(0xE000, 0x10000))
    some = [c for c in map(chr, codes) if c in ALIKE or c in _IGNORED or ((unicodedata.decomposition(c)[:1] == "<" or c.isspace()) and _compatible[ord(c)] != c)]
    return re.compile(f"[{re.escape(''.join(some))}{_SIGN_RUN.pattern[1:-1]}]")


_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]")  # on an alien letter they may hide a look-alike
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile("[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ가-힣]")
#: Emoji keep their joiners and selectors.
_EMOJI = re.compile("([‼-㊙\U0001f000-\U0001faff\U0001f3fb-\U0001f3ff#*0-9])([️‍⃣])")


_SCRIPTS = ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE")


@lru_cache(maxsize=200_000)
def _word(word: str) -> str:
    """A word's letters in the alphabet of its other letters."""
    if any(c.isascii() for c in word):  # an accent may have joined an alien letter
        word = "".join(unicodedata.normalize("NFC", ALIKE[d[0]] + d[1:]) if (d := unicodedata.normalize("NFD", c))[0] in ALIKE and len(d) > 1 else c for c in word)
    latin = sum(c.isascii() or "LATIN" in unicodedata.name(c, "") for c in word)
    alien = [c for c in word if c in ALIEN]
    others = len(word) - latin - len(alien)
    own = sum(unicodedata.name(c, "").startswith(_SCRIPTS) and c not in ALIKE for c in word)
    if alien and not own and (latin or not (len(word) == 1 and word in _SIGNS)) and not (others and not latin):
        word = "".join(ALIEN.get(c, c) for c in word)
        latin = len(word)
    if latin == len(word):
        word = "".join(LATIN.get(c, c) for c in word)
    return word


def _wide(m: re.Match) -> str:
    """A full-width sign stays between Chinese, Japanese or Korean letters and becomes plain elsewhere."""
    text, at = m.string, m.start()
    before = next((c for c in reversed(text[max(0, at - 12) : at]) if c.isalnum()), "")
    after = next((c for c in text[at + 1 : at + 13] if c.isalnum()), "")
    if _HAN.match(before) or _HAN.match(after) or not (before or after):
        return m.group()
    return chr(ord(m.group()) - 0xFEE0)


def repaired(text: str) -> str:
    """The canonical form of a text with the characters that were meant, otherwise as it is: case, dashes, quotes, fractions stay.

    Compatibility normalisation composed form and removal of ignorables, where they change letters, digits and spaces; then
    plain signs for full-width ones outside of scripts that have them, and look-alike letters by word.
    """
    if text.isascii():
        return text
    if max(text) < "\U00010000" and not _any().search(text) and not _MARKS.search(text):
        return unicodedata.normalize("NFC", text)
    held = {}
    if _EMOJI.search(text):
        def keep(m: re.Match) -> str:
            sign = chr(0x10FF00 + len(held) % 200)
            held[sign] = m.group(2)
            return m.group(1) + sign

        text = _EMOJI.sub(keep, text)
    text = unicodedata.normalize("NFC", text.translate(_compatible))
    text = _SIGN_RUN.sub(_wide, text)
    text = _WORD.sub(lambda m: m.group() if m.group().isascii() else _word(m.group()), text)
    text = unicodedata.normalize("NFC", text)
    for sign, c in held.items():
        text = text.replace(sign, c)
    return text


_BLANK = re.compile(r"\s+")


def comparable(form: str) -> str:
    """The form in which equal-looking texts are equal: of a repaired text, compatibility composed, case folded, white space mapped."""
    return _BLANK.sub(" ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", form).casefold())).strip()


def normalised(df: DataFrame, keys: list[str], text: str, compare: bool = True) -> DataFrame:
    """(keys, repaired, comparable, changed) of every row, comparable only if ``compare``.

    changed: the text is not its own canonical form: it had decomposed, full-width, invisible, joined or alien characters, or other
    spaces. Null texts have null forms and changed false; the empty text stays empty. Each batch is dictionary-encoded and
    each distinct value of it normalised once; no shuffle, so a value that a third of the rows share costs nothing.
    """
    names = ["repaired", "comparable", "changed"] if compare else ["repaired", "changed"]

    def run(batches):
        for batch in batches:
            values = batch.column(len(keys)).dictionary_encode()
            texts = values.dictionary.to_pylist()
            forms = [None if t is None else repaired(t) for t in texts]
            columns = [pa.array(forms, pa.string())] + ([pa.array([None if r is None else comparable(r) for r in forms], pa.string())] if compare else [])
            columns.append(pa.array([r != t for r, t in zip(forms, texts)], pa.bool_()))
            columns = [c.take(values.indices) for c in columns]
            columns[-1] = columns[-1].fill_null(False)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keys))], *columns], names=[*keys, *names])

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    out = ", ".join(f"{n} {'boolean' if n == 'changed' else 'string'}" for n in names)
    return spread(df.select(*keys, F.col(text).alias("_text"))).mapInArrow(run, f"{fields}, {out}")


def _both(spark, sf_dir, compare: bool) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tbl"), F.col("ord").alias("row_id"), F.col("text"))
    questions = table(spark, sf_dir, "test_questions").select(F.lit("test_questions").alias("tbl"), F.col("id").alias("row_id"), F.col("question").alias("text"))
    return normalised(chunks, ["tbl", "row_id"], "text", compare).unionByName(normalised(questions, ["tbl", "row_id"], "text", compare))


def p2_forms(spark, sf_dir):
    """Every chunk's and question's repaired and comparable form."""
    return _both(spark, sf_dir, True)


def p2_found(spark, sf_dir):
    """tbl, row_id of the texts whose characters only look like the intended ones."""
    return _both(spark, sf_dir, False).where("changed").select("tbl", "row_id")


QUERIES = {"p2_found": p2_found, "p2_forms": p2_forms}
SQL: dict[str, str] = {}
