"""Problem 6: text of scanned pages repaired into continuous paragraphs."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import regex as re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yarrow.common import bit_field, cut, spread, table
from yarrow.llm import mojibake

#: A word (pair) is in the lexicon if it makes up at least this part of all words (pairs): so there are at most
#: 1 / WORD_SHARE words and 1 / PAIR_SHARE pairs, however large the corpus is.
WORD_SHARE, PAIR_SHARE, LEAST = 5e-6, 2e-6, 5
#: Deletions of the index; cost up to which a candidate repairs an unknown and a known word.
DELETIONS, UNKNOWN_COST, KNOWN_COST = 2, 0.7, 0.5
#: A repair of an unknown word was seen so often and is so many times as frequent as that word; a repair of a known word is
#: so many times as frequent in its context.
RATIO, FORM_RATIO, CONTEXT_RATIO = 20, 4, 30
#: Occurrences in texts that were never scanned which make a word genuine, most bits for such words, letters from which words
#: have no deletes, and the confidence of a sure scan.
LEAST_GENUINE, MOST_BITS, LONG, SURE_SCAN = 2, 30, 20, 0.9

# What scanners take for one another; both directions hold.
CONFUSED = [
    ("m", "rn"), ("m", "in"), ("n", "ri"), ("n", "rí"), ("h", "li"), ("h", "lí"), ("d", "cl"), ("đ", "cl"), ("u", "ii"), ("w", "vv"), ("m", "iii"), ("n", "ii"), ("m", "ni"),
    ("c", "e"), ("h", "b"), ("t", "f"), ("t", "1"), ("l", "1"), ("i", "1"), ("l", "i"), ("l", "|"), ("i", "|"), ("o", "0"), ("s", "5"), ("s", "ş"), ("s", "$"), ("g", "9"), ("g", "q"),
    ("b", "6"), ("u", "v"), ("n", "u"), ("a", "o"), ("d", "đ"), ("d", "0"), ("r", "f"), ("c", "("), ("c", "o"), ("z", "2"), ("b", "8"), ("í", "1"), ("h", "n"), ("y", "v"), ("k", "lc"), ("p", "ρ"),
]
_PAIRS = {frozenset(p) for p in CONFUSED if all(len(x) == 1 for x in p)}
_JOINED = {b: a for a, b in CONFUSED if len(b) > 1}
_JOINS: dict[str, set[str]] = {}
for _a, _b in CONFUSED:
    if len(_b) > 1:
        _JOINS.setdefault(_b, set()).add(_a)

_TOKEN = re.compile(r"[\p{L}\p{M}\p{N}]+")
#: A number below 400 in Roman letters, so not any word of these letters.
_ROMAN = r"(?=[ivxlc]{2})c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMBERED = re.compile(rf"^\W*(?:trang|tr\.?|page|p\.|第)?\s*(?:\d{{1,4}}(?:\s*/\s*\d{{1,4}})?|{_ROMAN})\s*页?\W*$", re.I)
_REST_OF_HEADER = re.compile(r"^(?:[a-z]\b)?\s*(?:\d{1,4})?\s*(?:chuong|chapter|chapitre|trang|page|tr|p|phan)?\s*(?:\d{1,4}|[ivxlc]{1,6})?\s*(?:\d{1,4})?$")
_HYPHEN = re.compile(r"(\p{L}[\p{L}\p{M}]*)([-¬‐‑\xad]) ?\n\s*(\p{L}[\p{L}\p{M}]*)")
_MARKS = re.compile(r"[|_~^`¦]|°\.|\.•|(?<=\s);:(?=\s)|(?<=\s)'(?=\s)|¬")
_IN_WORD = re.compile(r"(?<=\p{L}{2})\.(?=\p{Ll}{2})|(?<=[ôơâăêưđ])\.(?=\s?\p{Ll})|(?<=\p{L})[$(](?!\p{L}*\))(?=[\p{L}\s.,;]|$)")
_SPACED = re.compile(r"(?<!\p{L})(?:\p{L} ){3,}\p{L}(?!\p{L})")
_HAN_GAP = re.compile(r"(?<=\p{Han})[ 　]+(?=\p{Han})")
_OTHER_SCRIPT = re.compile(r"\p{Han}|\p{Thai}|\p{Hiragana}|\p{Katakana}|\p{Cyrillic}|\p{Greek}")
_VIETNAMESE = re.compile("[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉĩịọỏốồổỗộớờởỡợụủũứừửữựỳỵỷỹ]")
_APOSTROPHE = re.compile(r"(?<=\p{L})'(?=\p{Ll})")


def _fold(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn").replace("đ", "d")
    return " ".join(_TOKEN.findall(plain))


@lru_cache(maxsize=100_000)
def _bare(c: str) -> str:
    return unicodedata.normalize("NFD", c)[0].replace("đ", "d")


@lru_cache(maxsize=100_000)
def _exchange(x: str, y: str) -> float:
    """Cost of a letter for another: confusions of scanners 0.3, accents alone 0.4, both 0.45, everything else 1."""
    if frozenset((x, y)) in _PAIRS:
        return 0.3
    a, b = _bare(x), _bare(y)
    return 0.4 if a == b else 0.45 if frozenset((a, b)) in _PAIRS else 1.0


def weighted_distance(a: str, b: str, most: float) -> float:
    """Edit distance in which confusions of scanners cost 0.3, accents alone 0.4, everything else 1; above ``most`` only that it is.

    Searched from left to right within what the costs leave, so words that differ by anything dear are left at once.
    """
    best = most + 1.0

    def go(i: int, j: int, spent: float) -> None:
        nonlocal best
        n, m = len(a), len(b)
        while True:
            left = min(most, best) - spent + 1e-9
            if left < 0:
                return
            if left < 1:  # no letter may be added or left out, and equal ones stand for one another
                while i < n and j < m and a[i] == b[j]:
                    i, j = i + 1, j + 1
            if i == n and j == m:
                best = min(best, spent)
                return
            if i < n and j < m:
                for first, x, p, y, q in ((True, a, i, b, j), (False, b, j, a, i)):
                    for size in (2, 3):
                        to = _JOINS.get(x[p : p + size]) if p + size <= len(x) else None
                        if to and (y[q] in to or _bare(y[q]) in to):
                            cost = 0.3 if y[q] in to else 0.4
                            if cost <= left:
                                go(*((i + size, j + 1) if first else (i + 1, j + size)), spent + cost)
            if left >= 1:
                if i < n:
                    go(i + 1, j, spent + 1)
                if j < m:
                    go(i, j + 1, spent + 1)
            if i == n or j == m:
                return
            if a[i] != b[j]:
                spent += _exchange(a[i], b[j])
            i, j = i + 1, j + 1

    go(0, 0, 0.0)
    return round(best, 9) if best <= most + 1e-9 else most + 1


def _deletes(word: str, most: int) -> set[str]:
    out = {word}
    for k in range(1, min(most, len(word) - 1) + 1):
        for spots in combinations(range(len(word)), k):
            gone = set(spots)
            out.add("".join(c for i, c in enumerate(word) if i not in gone))
    return out


def _hashed(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


class Lexicon:
    """Corpus frequencies and the symmetric-delete index over them.

    Entry keys are deletes of the accentless word, so that accents never use up a deletion; they are kept as sorted hashes
    beside word numbers, some 12 bytes a delete. Words above LONG letters would have too many deletes: they are few, and are compared
    with one another directly. rare: frequencies of the unknown words of which a word of the lexicon may be less than
    FORM_RATIO times as frequent. genuine: bits of the words of texts that were never scanned.
    """

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], rare: dict[str, int] | None = None, genuine: np.ndarray | None = None) -> None:
        self.words, self.pairs, self.rare, self.genuine = words, pairs, rare or {}, genuine
        fit = [w for w in words if w.isalpha() and len(w) >= 2 and not re.search(r"\p{Han}", w)]
        self.listed, self.long = [w for w in fit if len(w) <= LONG], [w for w in fit if len(w) > LONG]
        spread_ = [_deletes("".join(map(_bare, w)), DELETIONS if len(w) > 3 else 1) for w in self.listed]
        keys = _hashed([d for deletes in spread_ for d in deletes])
        order = np.argsort(keys, kind="stable")
        self.keys, self.numbers = keys[order], np.repeat(np.arange(len(spread_), dtype=np.int32), [len(d) for d in spread_])[order]
        self.cache: dict[tuple[str, float], list[tuple[float, str]]] = {}
        self.seen: dict[str, tuple[bool, tuple[int, int], list[str]]] = {}

    def near(self, word: str) -> list[str]:
        """Words that share a delete."""
        if len(word) > LONG + 2 * DELETIONS:
            return self.long
        keys = _hashed(list(_deletes("".join(map(_bare, word)), DELETIONS)))
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        found = {n for a, b in zip(low.tolist(), high.tolist()) if b > a for n in self.numbers[a:b].tolist()}
        return [self.listed[n] for n in found] + (self.long if len(word) > LONG - 2 * DELETIONS else [])

    def candidates(self, word: str, most: float) -> list[tuple[float, str]]:
        """(cost, lexicon word) within the cost, cheapest first, then most frequent."""
        found = self.cache.get((word, most))
        if found is None:
            costs = [(weighted_distance(word, w, most), w) for w in self.near(word) if w != word]
            found = sorted(((c, w) for c, w in costs if c <= most), key=lambda x: (x[0], -self.words[x[1]], x[1]))
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[(word, most)] = found
        return found

    def is_genuine(self, word: str) -> bool:
        """Scanners don't misread texts that were never scanned: however rare a word of theirs is, it is one."""
        if self.genuine is None:
            return False
        h, last = xxhash.xxh3_64_intdigest(word), 8 * len(self.genuine) - 1
        return all(self.genuine[spot >> 3] >> (spot & 7) & 1 for spot in (h & last, (h >> 32) & last))

    def looked_up(self, word: str) -> tuple[bool, tuple[int, int], list[str]]:
        """(no word to judge, (frequency, place) of the best cut into two known words that follow one another, better known words
        that a known word may be misread from)."""
        found = self.seen.get(word)
        if found is None:
            apart = max(((self.pairs.get((word[:i], word[i:]), 0), i) for i in range(1, len(word)) if word[:i] in self.words and word[i:] in self.words), default=(0, 0))
            count = self.words.get(word, 0)
            better = [c for _, c in self.candidates(word, KNOWN_COST) if self.words[c] > count] if count and len(word) > 1 else []
            found = (word.isdigit() or bool(_OTHER_SCRIPT.search(word)), apart, better)
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[word] = found
        return found

    def context(self, before: str, word: str, after: str) -> int:
        return self.pairs.get((before, word), 0) + self.pairs.get((word, after), 0)


def _like(model: str, word: str) -> str:
    return word.upper() if len(model) > 1 and model.isupper() else word[:1].upper() + word[1:] if model[:1].isupper() else word


def _is_header(line: str, title: str) -> bool:
    """The line is the title with no more than a letter, a chapter and page numbers beside it."""
    folded = _fold(line)
    if not title or len(title) < 8 or len(folded) > len(title) + 30 or len(folded) < len(title) - 3:
        return False
    at = folded.find(title)
    if at >= 0:
        return bool(_REST_OF_HEADER.match(folded[:at].strip()) and _REST_OF_HEADER.match(folded[at + len(title) :].strip()))
    # a damaged title: nearly all of its words, and hardly any others
    words, known = folded.split(), title.split()
    left = [w for w in words if w not in known and not w.isdigit() and len(w) > 1 and w != "chuong"]
    hit = sum(w in words for w in known)
    return hit >= 0.7 * len(known) and len(left) <= 0.35 * len(known) and not re.search(r"[.!?。]\s*$", line)


def repair(text: str, title: str, lexicon: Lexicon, lexical: bool = True, spoiled: frozenset[str] = frozenset(), care: float = 1) -> tuple[str, list[str]]:
    """The repaired text and the kinds of damage found.

    ``lexical``: also judge signs inside words. ``spoiled``: words that wrong decoding touched; they and their neighbours are not judged. ``care``: times
    as unlikely must a known word be to be taken for misread.
    """
    kinds: set[str] = set()
    known, title = lexicon.words, _fold(title or "")
    lines, kept = re.split(r"[\n\x0c]", text), []
    for line in lines:
        if line.strip() and _NUMBERED.match(line) and not re.search(r"\d\.\s*$", line) and (len(lines) > 1):
            kinds.add("page number")
        elif line.strip() and _is_header(line, title) and len(lines) > 1:
            kinds.add("header")
        else:
            kept.append(line)
    out = "\n".join(kept)

    def join(m: re.Match) -> str:
        a, sign, b = m.groups()
        both = (a + b).lower()
        if sign == "-" and both not in known and a.lower() in known and b.lower() in known and lexicon.pairs.get((a.lower(), b.lower()), 0):
            return f"{a}-{b}"
        kinds.add("hyphen")
        return a + b

    for _ in range(2):
        out = _HYPHEN.sub(join, out)
    if _MARKS.search(out):
        kinds.add("stray mark")
        out = _MARKS.sub("", out)
    if lexical:
        def mark(m: re.Match) -> str:
            kinds.add("stray mark")
            return ""

        out = _IN_WORD.sub(lambda m: mark(m) if m.group() == "." else (kinds.add("misread"), "c" if m.group() == "(" else "s")[1], out)
        if _VIETNAMESE.search(out):
            out = _APOSTROPHE.sub(lambda m: mark(m) if _VIETNAMESE.search(out[max(0, m.start() - 8) : m.end() + 8]) else "'", out)
    if _HAN_GAP.search(out):
        kinds.add("broken word")
        out = _HAN_GAP.sub("", out)

    def close(m: re.Match) -> str:
        kinds.add("broken word")
        return m.group().replace(" ", "")

    out = _SPACED.sub(close, out)
    out = _words(out, lexicon, kinds, spoiled, care)
    # single line breaks are spaces; blank lines part paragraphs
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n[^\S\n]*\n\s*", out)]
    return "\n\n".join(re.sub(r"\s+([,.;:!?])(?=\s|$)", r"\1", p) for p in paragraphs if p), sorted(kinds)


def _words(text: str, lexicon: Lexicon, kinds: set[str], spoiled: frozenset[str] = frozenset(), care: float = 1) -> str:
    known, pairs, lost = lexicon.words, lexicon.pairs, "�" in text
    found = list(_TOKEN.finditer(text))
    low = [m.group().lower() for m in found]
    n, k = len(found), 0
    edits: list[tuple[int, int, str]] = []
    while k < n:
        w, m = low[k], found[k]
        before, after = low[k - 1] if k else "", low[k + 1] if k + 1 < n else ""
        count = known.get(w, 0)
        other, apart, forms = lexicon.looked_up(w)
        if other or (spoiled and (w in spoiled or before in spoiled or after in spoiled)) or (lost and "�" in text[max(0, m.start() - 1) : m.end() + 1]):
            k += 1
            continue
        if count:
            # damage repeats, so a damaged form may be known itself; what it stands for is then known far better
            both, beyond = w + after, low[k + 2] if k + 2 < n else ""
            if after and both in known and known[both] > CONTEXT_RATIO * pairs.get((w, after), 0) and text[m.end() : found[k + 1].start()] == " " and lexicon.context(before, both, beyond) and not (pairs.get((before, w)) and pairs.get((after, beyond))) and not after.isdigit():
                kinds.add("broken word")
                edits.append((m.start(), found[k + 1].end(), m.group() + found[k + 1].group()))
                k += 2
                continue
            if apart[0] >= CONTEXT_RATIO * count and 1 < apart[1] < len(w) - 1:
                kinds.add("run together")
                edits.append((m.start() + apart[1], m.start() + apart[1], " "))
                k += 1
                continue
            if forms:
                best = max((lexicon.context(before, c, after), c) for c in forms)
                if best[0] >= care * CONTEXT_RATIO * max(lexicon.context(before, w, after), 1) and pairs.get((before, best[1])) and pairs.get((best[1], after)):
                    kinds.add("misread")
                    edits.append((m.start(), m.end(), _like(m.group(), best[1])))
            k += 1
            continue
        # broken: the next or last piece completes a word
        if k + 1 < n and after and text[m.end() : found[k + 1].start()] == " " and (w + after) in known and known[w + after] >= LEAST and not after.isdigit():
            kinds.add("broken word")
            edits.append((m.start(), found[k + 1].end(), m.group() + found[k + 1].group()))
            k += 2
            continue
        if k and text[found[k - 1].end() : m.start()] == " " and (before + w) in known and not before.isdigit() and (not edits or edits[-1][1] <= found[k - 1].start()):
            kinds.add("broken word")
            edits.append((found[k - 1].start(), m.end(), found[k - 1].group() + m.group()))
            k += 1
            continue
        # run together: two known words that follow one another elsewhere
        if apart[0] > 0:
            kinds.add("run together")
            at = m.start() + apart[1]
            edits.append((at, at, " "))
            k += 1
            continue
        if len(w) > 1 and not lexicon.is_genuine(w):
            least = max(RATIO, FORM_RATIO * lexicon.rare.get(w, 0))
            options = [(c, -lexicon.context(before, x, after), -known[x], x) for c, x in lexicon.candidates(w, UNKNOWN_COST) if known[x] >= least]
            options.sort(key=lambda o: (o[1] == 0, o[0] + (0.2 if o[1] == 0 else 0), o[1], o[2], o[3]))
            if options and not _is_code(m.group()):
                kinds.add("misread")
                edits.append((m.start(), m.end(), _like(m.group(), options[0][3])))
        k += 1
    for a, b, new in reversed(edits):
        text = text[:a] + new + text[b:]
    return text


def _spoiled(text: str, restored: str) -> frozenset[str]:
    """The words of a restored text that its stored text does not have, and those that still look wrongly decoded."""
    left = {w.lower() for w in _TOKEN.findall(restored) if mojibake._odd(w)}
    return frozenset(left | set(_TOKEN.findall(restored.lower())) - set(_TOKEN.findall(text.lower())))


def _is_code(word: str) -> bool:
    """Letters and digits that belong together: capitals with digits, as in formulas and item codes."""
    letters = [c for c in word if c.isalpha()]
    return any(c.isdigit() for c in word) and all(c.isupper() for c in letters)


def lexicon(df: DataFrame, text: str, kind: str | None = None, scanned: tuple[str, ...] = ()) -> Lexicon:
    """Frequencies over all texts; only what passes the share thresholds, hence a bounded number, is collected.

    Of all words that texts of other kinds than ``scanned`` have at least LEAST_GENUINE times and half as often as scans do, however
    small their share, two bits are kept, in a field of at most 2 ** MOST_BITS.
    """
    clean = ~F.col(kind).isin(*scanned) if kind else F.lit(False)
    words = df.where(F.col(text).isNotNull()).select(F.coalesce(clean, F.lit(False)).alias("c"), F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{M}\p{N}]+)")).alias("w"))
    counts = cut(words.select("c", F.explode("w").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if("c").alias("m")))
    total, unscanned = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    own = counts.where((F.col("m") >= LEAST_GENUINE) & (F.col("m") / max(unscanned, 1) >= (F.col("n") - F.col("m")) / (2 * max(total - unscanned, 1)))).select("a")
    least = max(LEAST, WORD_SHARE * total)
    single = {r["a"]: r["n"] for r in counts.where(F.col("n") > least / FORM_RATIO).collect()}
    double = words.select(F.explode(F.expr("transform(sequence(1, greatest(size(w) - 1, 1)), i -> struct(get(w, i - 1) AS a, get(w, i) AS b))")).alias("p")).where("p.b IS NOT NULL").groupBy("p.a", "p.b").count().where(F.col("count") >= max(3, PAIR_SHARE * total))
    pairs = {(r["a"], r["b"]): r["count"] for r in double.collect()}
    bits = 1 << min(MOST_BITS, max(16, (256 * own.count()).bit_length()))

    def spots(batches):
        for pdf in batches:
            h = _hashed(pdf["a"].tolist())
            yield pd.DataFrame({"spot": np.unique(np.concatenate([h, h >> np.uint64(32)]) & np.uint64(bits - 1)).astype(np.int64)})

    field = bit_field(own.mapInPandas(spots, "spot bigint"), "spot", bits)
    return Lexicon({w: n for w, n in single.items() if n >= least}, pairs, {w: n for w, n in single.items() if n < least}, field)


def repaired(df: DataFrame, key: str, text: str, title: str, kind: str, scanned: tuple[str, ...] = ("image", "pdf"), confidence: str | None = None) -> DataFrame:
    """(key, repaired, damage) of the rows whose ``kind`` is scanned.

    damage: the kinds found, empty for an intact text. Null texts stay null without damage, empty ones empty;
    repeated rows come out each. The lexicon covers all rows. Text read in a wrong encoding is restored first; as wrong
    decoding is no scan damage, the restored words, words at a U+FFFD and signs inside words are then not judged. ``confidence``, null
    for many rows, is a hint: a known word of a scan that is SURE_SCAN sure must be twice as unlikely to be taken for misread.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(lexicon(df, text, kind, scanned))
    ways = spark.sparkContext.broadcast(mojibake.dictionaries(df, key, text))
    type_ = df.schema[key].dataType.simpleString()
    hint = F.col(confidence).cast("double") if confidence else F.lit(None).cast("double")
    base = df.where(F.col(kind).isin(*scanned)).select(F.col(key), F.col(text).alias("_text"), F.col(title).alias("_title"), hint.alias("_sure"))

    def run(batches):
        length, words = mojibake.Lengths(ways.value), shared.value
        for pdf in batches:
            rows = []
            for k, t, name, sure in zip(pdf[key], pdf["_text"], pdf["_title"], pdf["_sure"]):
                if not t:
                    rows.append((k, t, []))
                    continue
                good, chains = mojibake.restore(t, length)
                rows.append((k, *repair(good, name, words, not chains and "�" not in good, _spoiled(t, good) if chains else frozenset(), 2 if sure >= SURE_SCAN else 1)))
            yield pd.DataFrame(rows, columns=[key, "repaired", "damage"])

    return spread(base).mapInPandas(run, f"{key} {type_}, repaired string, damage array<string>")


def p6_repaired(spark, sf_dir):
    """Every scanned passage as continuous paragraphs, with the kinds of damage found in it."""
    return repaired(table(spark, sf_dir, "raw_passages"), "ord", "text", "title", "doc_type", confidence="ocr_confidence")


def p6_found(spark, sf_dir):
    """ord of the scanned passages with damage."""
    return p6_repaired(spark, sf_dir).where(F.size("damage") > 0).select("ord")


QUERIES = {"p6_found": p6_found, "p6_repaired": p6_repaired}
SQL: dict[str, str] = {}
