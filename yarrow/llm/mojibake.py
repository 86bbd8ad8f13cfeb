"""Problem 1: text read in the wrong encoding, undone by the chain of least description length."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yarrow.common import spread, table

LANGUAGES = ("vi", "en", "fr", "zh")
#: The dictionaries are fitted on at most so many clean texts a language, none longer than that, and hold so many bytes.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 600, 4_000, 110_000
#: Bytes that a chain costs, one whose bytes turn out to be right UTF-8, and a sign that no clean text has; and the part of
#: its length that a stretch costs which no known words speak for.
CHAIN_COST, UTF8_COST, ESCAPE, MARGIN = 3, 0, 2, 0.12

# The letters that TCVN 5712 (3) fonts show for bytes, in the order of the bytes.
TCVN3 = dict(zip(
    "¡¢£¤¥¦§¨©ª«¬\xad®µ¶·¸¹»¼½¾ÆÇÈÉÊËÌÎÏÐÑÒÓÔÕÖ×ØÜÝÞßáâãäåæçèéêëìíîïñòóôõö÷øùúûüýþ",
    "ĂÂÊÔƠƯĐăâêôơưđàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ",
))
# VNI font pairs. A vowel is followed by the sign of its tone, or of its hat and tone together.
_TONES = dict(zip("ùøûõï", "̣́̀̉̃"))
_HAT = {"â": "̂", "á": "̂́", "à": "̂̀", "å": "̂̉", "ã": "̂̃", "ä": "̣̂"}
_BREVE = {"ê": "̆", "é": "̆́", "è": "̆̀", "ú": "̆̉", "ü": "̆̃", "ë": "̣̆"}
_VNI_LETTERS = {"ñ": "đ", "ô": "ơ", "ö": "ư", "æ": "ỉ", "ó": "ĩ", "ò": "ị", "î": "ỵ", "Ñ": "Đ", "Ô": "Ơ", "Ö": "Ư", "Æ": "Ỉ", "Ó": "Ĩ", "Ò": "Ị", "Î": "Ỵ"}


@lru_cache(maxsize=1)
def _vni() -> tuple[re.Pattern, dict[str, str]]:
    pairs = {}
    for vowel in "aeouyôö":
        signs = dict(_TONES)
        if vowel in "aeo":
            signs |= _HAT
        if vowel == "a":
            signs |= _BREVE
        for sign, marks in signs.items():
            base = _VNI_LETTERS.get(vowel, vowel)
            good = unicodedata.normalize("NFC", base + marks)
            pairs[vowel + sign] = good
            pairs[vowel.upper() + sign.upper()] = pairs[vowel.upper() + sign] = good.upper()
    table_ = pairs | _VNI_LETTERS
    return re.compile("|".join(sorted(map(re.escape, table_), key=len, reverse=True))), table_


@dataclass(frozen=True)
class Chain:
    """One wrong reading undone: convert gives the text as written for a word, or None if it can't be so read."""

    name: str
    #: A word in which something would change.
    trigger: re.Pattern
    convert: Callable[[str], str | None]
    #: So many changed words at least make a stretch.
    least: int
    #: Bytes that happen to be right UTF-8 are evidence by themselves, so that such a reading costs less.
    utf8: bool = False

    def cost(self, length: Lengths, old: list[str], new: list[str]) -> int:
        """Bytes that the chain and its stretch cost. Of other readings many fit a text, so that they cost more the longer it is;
        not where most words they change become known ones."""
        if self.utf8:
            return UTF8_COST
        pairs = [(a, b) for a, b in zip(old, new) if a != b]
        learnt = sum(b.strip(_SIGNS).lower() in length.known and a.strip(_SIGNS).lower() not in length.right for a, b in pairs)
        if learnt >= 2 and learnt >= 0.75 * len(pairs):
            return CHAIN_COST
        return CHAIN_COST + int(MARGIN * length(" ".join(old)))


def _bytes_of(codec: str) -> dict[int, bytes]:
    """Character to byte, control characters standing for bytes that the code page leaves free."""
    out = {b: bytes([b]) for b in range(0x80, 0xA0)}
    for b in range(256):
        try:
            out[ord(bytes([b]).decode(codec))] = bytes([b])
        except UnicodeDecodeError:
            pass
    return out


def _reader(shown: str, written: str) -> Callable[[str], str | None]:
    """Undo: bytes of the single-byte encoding ``written`` that were read as ``shown``."""
    known = _bytes_of(shown)

    def convert(word: str) -> str | None:
        try:
            return unicodedata.normalize("NFC", b"".join([known[ord(c)] for c in word]).decode(written))
        except (KeyError, UnicodeDecodeError):
            return None

    return convert


def _utf8_reader(shown: str) -> Callable[[str], str | None]:
    """Undo: UTF-8 that was read as ``shown``, run by run; bytes that became U+FFFD stay lost."""
    known = _bytes_of(shown) | {0xFFFD: b"\xff"}
    run = re.compile("[" + re.escape("".join(chr(c) for c in known if c > 0x7F)) + "]{2,}")

    def good(m: re.Match) -> str:
        raw = b"".join([known[ord(c)] for c in m.group()])
        try:
            text = raw.decode("utf-8")
            # one letter out of two that clean text has, too, is chance
            chance = len(m.group()) == 2 and not _ODD.search(m.group())
            return m.group() if chance or _FOREIGN.search(text) else text
        except UnicodeDecodeError:
            text = _LOST.sub("�", raw.decode("utf-8", "replace"))
            # nothing more may be lost than is lost already
            return text if text.count("�") <= m.group().count("�") and not _FOREIGN.search(text) else m.group()

    return lambda word: unicodedata.normalize("NFC", run.sub(good, word))


_LOST = re.compile("�+")
#: Scripts that no text here is written in; bytes that only happen to be right UTF-8 give such letters.
_FOREIGN = re.compile("[\u0180-\u0191\u0193-\u019f\u01a2-\u01ae\u01b1-\u024f\u0250-\u036f\u0460-\u048f\u0492-\u1dff\u1f00-\u1fff\u2440-\u24ff\u25a0-\u2fff\ua000-\udfff\ufb00-\ufdff\U00010000-\U0010ffff]")


def _from_gbk(word: str) -> str | None:
    """UTF-8 that was read as GBK; bytes without a GBK character may be lost."""
    try:
        good = word.encode("gb18030").decode("utf-8", "replace")
    except UnicodeEncodeError:
        return None
    return good if good.count("�") * 6 <= len(good) and good != word else None


def _as_gbk(shown: str) -> Callable[[str], str | None]:
    known = _bytes_of(shown)

    def convert(word: str) -> str | None:
        high = sum(c > "\x7f" for c in word)
        if high < 4 or sum("A" <= c <= "z" for c in word) > high // 2 or not all(ord(c) in known for c in word):
            return None
        good = b"".join([known[ord(c)] for c in word]).decode("gb18030", "replace")
        han = sum("一" <= c <= "鿿" for c in good)
        return good if han * 2 >= len(good) - sum(c < "\x80" for c in good) and "�" not in good[:-1] else None

    return convert


def _tcvn3(word: str) -> str | None:
    if any(c > "\x7f" and c not in TCVN3 and c not in "–—…“”‘’" for c in word):
        return None
    return "".join(TCVN3.get(c, c) for c in word)


def _vni_word(word: str) -> str | None:
    pattern, pairs = _vni()
    if any(c > "ÿ" and c not in "–—…“”‘’" for c in word):
        return None
    return pattern.sub(lambda m: pairs[m.group()], word)


@lru_cache(maxsize=1)
def chains() -> tuple[Chain, ...]:
    high = "[^\\x00-\\x7f]"
    utf8 = [Chain(f"utf-8 as {shown}", re.compile(_shows(shown, 0xC2, 0xF5) + high), _utf8_reader(shown), 1, True) for shown in ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "cp1258", "koi8_r")]
    swapped = [Chain(f"{written} as {shown}", re.compile(_shows(shown, 0x80, 0x100)), _reader(shown, written), 2) for written, shown in SWAPPED]
    return (
        *utf8,
        Chain("utf-8 as gbk", re.compile("[\u3400-\u9fff\ue000-\uf8ff]{2}"), _from_gbk, 1),
        Chain("gbk as cp1252", re.compile(_shows("cp1252", 0x81, 0xFF) + ".", re.S), _as_gbk("cp1252"), 1),
        Chain("tcvn3", re.compile("[" + re.escape("".join(TCVN3)) + "]"), _tcvn3, 2),
        Chain("vni", re.compile("[aeouyôöAEOUYÔÖ][" + "".join({*_TONES, *_HAT, *_BREVE} | {c.upper() for c in {*_TONES, *_HAT, *_BREVE}}) + "]|[ñöÑÖ]"), _vni_word, 2),
        *swapped,
    )


#: Single-byte encodings of Vietnamese and French, and those they are mistaken for.
SWAPPED = (
    ("cp1258", "cp1252"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1258"),
)


def _shows(codec: str, low: int, high: int) -> str:
    """Pattern of the characters that a code page shows for the bytes from low to high - 1."""
    return "[" + re.escape("".join(chr(c) for c, b in _bytes_of(codec).items() if low <= b[0] < high)) + "]"


#: Words end at white space, and where a script without spaces meets another.
_SPLIT = re.compile(r"([ \n\t\r]+|(?<=[\u3000-\u9fff\ue000-\uf8ff\uff00-\uffef])(?=[^\s\u2010-\u2027\u3000-\u9fff\ue000-\uf8ff\uff00-\uffef])|(?<=[^\s\u2010-\u2027\u3000-\u9fff\ue000-\uf8ff\uff00-\uffef])(?=[\u3000-\u9fff\ue000-\uf8ff\uff00-\uffef]))")
_HIGH = re.compile("[^\\x00-\\x7f]")
_SIGNS = ".,;:!?()\"“”‘’«»…•-"


class Lengths:
    """Description length: the least over the languages' dictionaries of the compressed size, plus what signs cost that no clean text has.

    Such signs are outside of what a dictionary describes; each needs an escape and its number.
    """

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.by = []
        for d in dictionaries.values():
            if len(d) >= 64:
                trained = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                trained.precompute_compress(level=9)
                self.by.append(zstandard.ZstdCompressor(dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False))
        if not self.by:
            self.by.append(zstandard.ZstdCompressor(level=9, write_content_size=False))
        text = b"\n".join(dictionaries.values()).decode("utf-8", "ignore").lower()
        self.right = frozenset(w.strip(_SIGNS) for w in text.split()) | {""}
        self.known = self.right - {""}
        self.read: dict[str, list[tuple[Chain, str]]] = {}

    def __call__(self, text: str) -> int:
        raw = text.encode("utf-8", "replace")
        return min(len(c.compress(raw)) for c in self.by) + ESCAPE * _odd(text)

    def readings(self, word: str) -> dict[int, tuple[str, bool]]:
        """By the number of each chain that can read a word: the word so read, and whether that counts as a change."""
        found = self.read.get(word)
        if found is None:
            found = {}
            for n, chain in enumerate(chains()):
                new = chain.convert(word)
                if (new is None or not (chain.utf8 or _odd(word))) and not any(map(str.isalpha, word)):
                    new = word  # signs alone belong to any reading
                if new is not None and new != word and not chain.utf8:
                    bare = word.strip(_SIGNS).lower()
                    if _odd(new) > _odd(word):
                        continue
                    if bare in self.known and (new.strip(_SIGNS).lower() not in self.known or sum(map(str.isalpha, new)) < sum(map(str.isalpha, word))):
                        new = word  # a right word amid wrongly read ones
                if new is not None:
                    found[n] = (new, new != word and bool(chain.trigger.search(word)))
            if len(self.read) > 200_000:
                self.read.clear()
            self.read[word] = found
        return found


def _odd(text: str) -> int:
    """Number of characters that clean text of no language has."""
    return len(_ODD.findall(text))


def _options(words: list[str], length: Lengths) -> list[tuple[int, str, int, int, list[str]]]:
    """(gain, chain, begin, end, words so read) of each chain's runs of words it can read, if their description gets shorter.

    Plain words belong to any reading; a word the chain can't read ends a run.
    """
    high = [(k, length.readings(words[k])) for k in range(0, len(words), 2) if _HIGH.search(words[k])]
    out = []
    for n in {n for _, r in high for n, (_, changed) in r.items() if changed}:
        chain = chains()[n]
        runs: list[list[tuple[int, str, bool]]] = [[]]
        for k, r in high:
            if n in r:
                runs[-1].append((k, *r[n]))
            elif runs[-1]:
                runs.append([])
        for run in runs:
            changed = [k for k, _, c in run if c]
            if len(changed) < chain.least:
                continue
            begin, end = changed[0], changed[-1] + 1
            good = words[begin:end]
            for k, new, _ in run:
                if begin <= k < end:
                    good[k - begin] = new
            gain = length("".join(words[begin:end])) - length("".join(good)) - chain.cost(length, words[begin:end:2], good[::2])
            if gain > 0:
                out.append((gain, chain.name, begin, end, good))
    return out


def restore(text: str, length: Lengths) -> tuple[str, list[str]]:
    """The text of least description length and the names of the chains that led to it, none if it stays.

    Readings are undone until none makes the text shorter, the one that gains most first; as each round shortens the
    description, there is a last one.
    """
    names: list[str] = []
    seen: set[str] = set()
    while _HIGH.search(text) and text not in seen:
        seen.add(text)
        words = _SPLIT.split(text)
        options = _options(words, length)
        if not options:
            break
        taken = [False] * len(words)
        for _gain, name, begin, end, good in sorted(options, key=lambda o: (-o[0], o[1], o[2])):
            if not any(taken[begin:end]):
                words[begin:end] = good
                taken[begin:end] = [True] * (end - begin)
                names.append(name)
        text = "".join(words)
    return text, names


#: Letters, digits and signs of clean text in the languages of the dictionaries.
_LETTERS = r"\x09-\x7e°•–—…“”‘’«»àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđçîûïëœÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴĐÇñ\x{4e00}-\x{9fff}，。；：？！、（）「」《》"
_CLEAN, _ODD = f"^[{_LETTERS}]+$", re.compile(f"[^{re.sub(r'.x.4e00.-.x.9fff.', '一-鿿', _LETTERS)}]")
_KIND = {"vi": r"[ạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹđ]", "zh": r"[\x{4e00}-\x{9fff}]{4}", "fr": r"\b(?:les|des|une|dans|est|qui)\b", "en": r"\b(?:the|of|and|with)\b"}


def dictionaries(df: DataFrame, key: str, text: str) -> dict[str, bytes]:
    """A dictionary a language from a bounded sample of texts that show only its own letters.

    The sample: the SAMPLE_ROWS texts of a language with the least hash of their key, the same on
    every run; at most len(LANGUAGES) * SAMPLE_ROWS rows come to the driver.
    """
    kind = F.lit(None).cast("string")
    for name in reversed(list(_KIND)):
        kind = F.when(F.col("_t").rlike(_KIND[name]), F.lit(name)).otherwise(kind)
    base = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where((F.length("_t") <= SAMPLE_CHARS) & F.col("_t").rlike(_CLEAN)).withColumn("_l", kind).where("_l IS NOT NULL")
    best = Window.partitionBy("_l").orderBy(F.xxhash64("_k"), "_k")
    # rank limits are applied before the exchange, so a language's rows never meet in one task
    rows = base.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= SAMPLE_ROWS).select("_l", "_n", "_t").collect()
    out = {}
    for name in LANGUAGES:
        texts = [r["_t"] for r in sorted(rows, key=lambda r: r["_n"]) if r["_l"] == name]
        out[name] = "\n".join(dict.fromkeys(texts)).encode("utf-8", "replace")[-DICTIONARY_BYTES:]
    return out


def restored(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restored, chains, lost) of every row.

    chains: the readings that were undone, in order, empty if the text stays; lost: the text holds U+FFFD, so
    part of it can't be restored. Null and empty texts stay as they are with no chain; repeated rows come out each.
    """
    shared = df.sparkSession.sparkContext.broadcast(dictionaries(df, key, text))

    def run(batches):
        length = Lengths(shared.value)
        for pdf in batches:
            done = [(None, []) if t is None else restore(t, length) for t in pdf["_text"]]
            yield pd.DataFrame({key: pdf[key], "restored": [d[0] for d in done], "chains": [d[1] for d in done]})

    kind = df.schema[key].dataType.simpleString()
    base = df.select(F.col(key), F.col(text).alias("_text"))
    plain = base.where(F.col("_text").isNull() | ~F.col("_text").rlike(r"[^\x00-\x7f]")).select(key, F.col("_text").alias("restored"), F.array().cast("array<string>").alias("chains"))
    other = spread(base.where(F.col("_text").rlike(r"[^\x00-\x7f]"))).mapInPandas(run, f"{key} {kind}, restored string, chains array<string>")
    return plain.unionByName(other).withColumn("lost", F.coalesce(F.instr("restored", "�") > 0, F.lit(False)))


def p1_restored(spark, sf_dir):
    """Every passage with its text as first written, as far as it is not lost."""
    return restored(table(spark, sf_dir, "raw_passages"), "ord", "text")


def p1_found(spark, sf_dir):
    """ord of the passages of which a stretch was read in another encoding than it was written in."""
    return p1_restored(spark, sf_dir).where((F.size("chains") > 0) | F.col("lost")).select("ord")


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored}
SQL: dict[str, str] = {}
