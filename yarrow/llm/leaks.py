"""Problem 9: documents that repeat evaluation items, by windows of canonical templates."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from functools import lru_cache, reduce
from operator import and_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from yarrow.common import bit_field, cut, spread, table

#: Words of a window, and the part of an item's words that slot-consistent windows must cover: half, less one word in ten of it.
WINDOW, SHARE = 5, 0.45
#: A place is dense where of the AROUND words on either side and itself at least DENSE are covered.
AROUND, DENSE = 10, 0.68
#: Changed words that a copied stretch bridges between two windows, and the words there are then at most between them.
CHANGED, GAP = 2, WINDOW + 1
#: Longest period, in words, of a text that repeats itself.
PERIOD = 8
#: Slots that must contradict, and outnumber those that agree, for a document to be another instance of a pattern.
LEAST_WRONG = 2
#: Items that are broadcast, and bits of the sieve that stands before the join of more of them.
MOST_ITEMS, SIEVE = 20_000, 28
#: Code points that are processed at once.
SLICE = 1_000_000

#: Units that become a typed placeholder, without accents.
UNITS = frozenset("g mg kg ml l cm mm m gram grams gam day days week weeks hour hours night dose doses packet packets ngay gio lan thang thuoc phut hom nam jour jours heure heures semaine semaines fois sachets ans ke 克 日 天 次 岁 年 月 分".split())
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")
_M1, _M2, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 0x100000001B3
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B))


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point to folded base letter or digit; 0 for marks, which vanish; 32 for everything that parts words."""
    lut = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind in ("Mn", "Cf") or kind == "Mc" and c < 0xE00:
            lut[c] = 0
        elif kind[0] in "LNM":
            base = unicodedata.normalize("NFKD", ch).casefold()
            base = next((x for x in base if unicodedata.category(x)[0] in "LN"), ch)
            lut[c] = ord({"đ": "d", "ð": "d", "ø": "o", "ł": "l", "ı": "i"}.get(base, base))
    lut[0x20000:0x40000] = np.arange(0x20000, 0x40000)
    return lut


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: 1 for a digit, 2 for a letter of a script without spaces, else 0."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x10000):
        out[c] = 1 if chr(c).isdigit() else 2 if _UNSPACED.match(chr(c)) else 0
    out[0x20000:0x40000] = 2
    return out


_powers: dict[str, np.ndarray] = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def words_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first code point's position, is a number) of each folded word of an array of code points.

    A letter of a script without spaces is a word of its own.
    """
    folded = _folding()[codes]
    at = np.flatnonzero(folded)
    folded = folded[at]
    solid = folded != 32
    kind = _kinds()[folded]
    alone = kind == 2
    joined = np.zeros(len(folded), dtype=bool)
    joined[1:] = solid[1:] & solid[:-1] & ~alone[1:] & ~alone[:-1]
    first = np.flatnonzero(solid & ~joined)
    if not len(first):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none.astype(bool)
    ends = solid.copy()
    ends[:-1] &= ~joined[1:]
    last = np.flatnonzero(ends)
    up, down = _power(len(folded))
    sums = np.cumsum(_mix((folded.astype(np.uint64) + np.uint64(7)) * _M1) * up)
    before = np.where(first > 0, sums[first - 1], np.uint64(0))
    digits = np.cumsum(kind == 1)
    number = digits[last] - np.where(first > 0, digits[first - 1], 0) > 0
    return _mix((sums[last] - before) * down[first]), at[first], number


def _windows(words: np.ndarray) -> np.ndarray:
    """Hash of each WINDOW consecutive words."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        out = out * _M1 + words[k : k + n]
    return _mix(out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hash(word: str) -> np.ndarray:
    return words_of(_codes(word))[0]


def names_of(texts: list[str]) -> np.ndarray:
    """Hashes of the words that stand capitalised where no sentence begins."""
    names = {w for t in texts for w in re.findall(r"(?<=[^\W\d_] )([^\W\d_]+)", t) if w[0].isupper()}
    return np.unique(np.concatenate([_hash(n) for n in names] or [np.zeros(0, np.uint64)]))


class Items:
    """The windows of items, sorted by template, with what their slots hold. names: those of all items, whichever are held here."""

    def __init__(self, rows: list[tuple[int, str]], names: np.ndarray) -> None:
        self.names = names
        self.units = np.unique(np.concatenate([_hash(u) for u in UNITS]))
        ids, lengths, templates, place = [], [], [], []
        self.words: list[list[int]] = []
        self.slots: list[np.ndarray] = []
        for n, (item, t) in enumerate(rows):
            words, _, number = words_of(_codes(t))
            signs = self.canonical(words, number)
            w = self.windows(words, signs)
            ids.append(item)
            lengths.append(len(words))
            self.words.append(words.tolist())
            self.slots.append(signs != words)
            templates.append(w)
            place.append(np.stack([np.full(len(w), n), np.arange(len(w))], axis=1))
        self.ids, self.lengths = ids, np.array(lengths, dtype=np.int64)
        t = np.concatenate(templates or [np.zeros(0, np.uint64)])
        order = np.argsort(t, kind="stable")
        self.templates = t[order]
        self.place = np.concatenate(place or [np.zeros((0, 2), np.int64)])[order]
        self.longest = int(self.lengths.max()) if len(rows) else 0
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[t >> np.uint64(42)] = True

    def canonical(self, words: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Numbers, names and units replaced by typed placeholders."""
        out = words.copy()
        for known, sign in ((self.names, _NAME), (self.units, _UNIT)):
            if len(known):
                spot = np.minimum(np.searchsorted(known, words), len(known) - 1)
                out[known[spot] == words] = sign
        out[number] = _NUMBER
        return out

    def windows(self, words: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """Template of each window. One of placeholders alone is no pattern: it stands for its own words."""
        out = _windows(signs)
        if len(out):
            typed = np.convolve(signs != words, np.ones(WINDOW, dtype=int), "valid") == WINDOW
            if typed.any():
                out[typed] = _windows(words)[typed]
        return out

    def hits(self, words: np.ndarray, number: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document window, item number, item window) of every window whose template an item has.

        Of words that a text repeats over and over those are left out that lie farther from both ends of the repetition than a
        stretch of the item can be long: each stretch there is found with the same words nearer to an end. Whether a window is left out
        hangs on its text and the item alone, not on the other texts and items that are met together.
        """
        templates = self.windows(words, self.canonical(words, number))
        maybe = np.flatnonzero(self.sieve[templates >> np.uint64(42)])
        depth = _depth(words, np.zeros(len(words), np.int64) if owner is None else owner)
        if depth is not None:
            maybe = maybe[depth[maybe] <= _reach(self.longest)]
        low = np.searchsorted(self.templates, templates[maybe], "left")
        count = np.searchsorted(self.templates, templates[maybe], "right") - low
        maybe, low, count = maybe[count > 0], low[count > 0], count[count > 0]
        rows = np.repeat(np.arange(len(maybe)), count)
        entry = low[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        at, item, window = maybe[rows], self.place[entry, 0], self.place[entry, 1]
        if depth is not None:
            kept = depth[at] <= _reach(self.lengths[item])
            at, item, window = at[kept], item[kept], window[kept]
        return at, item, window


def _reach(length):
    """Words of a document that a stretch of an item of so many words spans at most: a step of one word there is one of three here."""
    return (1 + CHANGED) * length + WINDOW + GAP + CHANGED


def _depth(words: np.ndarray, owner: np.ndarray) -> np.ndarray | None:
    """Of each window the words to the nearer end of the repetition that it lies in, less a period; None if there is no long one."""
    out, least = None, _reach(WINDOW)
    for period in range(1, min(PERIOD, len(words) - WINDOW) + 1):
        again = words[period:] == words[:-period]
        whole = again[: len(again) // least * least].reshape(-1, least)
        if not whole.all(axis=1).any():
            continue
        same = np.zeros(len(words), dtype=bool)
        same[period:] = again & (owner[period:] == owner[:-period])
        at = np.arange(len(words))
        start = np.maximum.accumulate(np.where(same, -1, at))
        end = np.minimum.accumulate(np.where(same, len(words), at)[::-1])[::-1]
        n = len(words) - WINDOW + 1
        # the words from start - period + 1 to end - 1 repeat
        deep = np.where(same[:n], np.minimum(at[:n] - start[:n] + period - 1, end[:n] - WINDOW - at[:n]) - period, -1)
        out = deep if out is None else np.maximum(out, deep)
    return out


def _covered(doc: np.ndarray, item: np.ndarray, window: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of item words that the windows cover, by (document, item)."""
    span = items.longest + WINDOW
    pair = doc.astype(np.int64) * len(items.ids) + item
    words = np.unique((pair * span + window)[:, None] + np.arange(WINDOW)[None, :])
    pairs, counts = np.unique(words // span, return_counts=True)
    return pairs // len(items.ids), pairs % len(items.ids), counts


def _bridged(a: list[int], b: list[int]) -> bool:
    """The words between two windows differ by one word changed, added or missing, or by two that do not stand side by side.

    A name of two words that was exchanged for another is no bridge.
    """
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if len(a) <= 1 and len(b) <= 1:
        return True
    # the outer words differ: a change at either end, everything between them agrees
    return any(a[x:y] and a[x:y] == b[u:v] for x in (0, 1) for u in (0, 1) if x or u for y in (len(a) - 1, len(a)) for v in (len(b) - 1, len(b)) if y < len(a) or v < len(b))


def _stretches(place: list[int], window: list[int], text: np.ndarray, words: list[int]) -> list[list[int]]:
    """The windows, by number, that follow one another in a document as they do in an item, changed words bridged."""
    order = sorted(range(len(place)), key=lambda h: (place[h], window[h]))
    out: list[list[int]] = []
    ends: dict[tuple[int, int], int] = {}  # the stretch that ends in a place and window, which only one does
    for h in order:
        a, w = place[h], window[h]
        for steps in _STEPS:
            # the first of them that began goes before; windows that overlap agree; if they overlap unevenly, a word was repeated or one of two left out
            for n in sorted(ends[a - far, w - near] for near, far in steps if (a - far, w - near) in ends):
                last = out[n][-1]
                if w - window[last] == a - place[last] <= WINDOW or _bridged(words[window[last] + WINDOW : w], text[place[last] + WINDOW : a].tolist()):
                    del ends[place[last], window[last]]
                    out[n].append(h)
                    break
            else:
                continue
            break
        else:
            n = len(out)
            out.append([h])
        ends[a, w] = n
    return out


#: (words on in the item, words on in the document) from a window to the next of a stretch, the most even first, then the shortest.
_STEPS = [[(near, near + d) for d in sorted({-drift, drift}) if near + d > 0] for drift in range(CHANGED + 1) for near in range(1, WINDOW + GAP + 1)]


class Verdict(NamedTuple):
    """What a document has of an item, in words: copied, agreeing and contradicting slots; and whether other values stand in for its own, each for one."""

    copied: int
    agree: int
    contradict: int
    renamed: bool
    template: int


def _judged(place: list[int], window: list[int], text: np.ndarray, items: Items, b: int) -> Verdict:
    """Windows that share an item's templates, chained to stretches whose slots are then compared with the item's.

    If most slots of the document hold other values, it is another instance of the pattern, and its stretches whose slots mostly
    contradict are dropped. A stretch left is copied if it is dense as a whole and no shorter than a dense place needs; it
    then counts from end to end, and dense places count wherever they are: one changed word in ten leaves
    coverage dense, while a pattern filled with other phrases, of which only the fixed words agree, is nowhere dense.
    """
    size, words, slots = int(items.lengths[b]), items.words[b], items.slots[b]
    stretches = _stretches(place, window, text, words)
    tally: list[tuple[int, int]] = []
    right: set[int] = set()
    held: dict[int, set[int]] = {}  # what stands for an item's value
    wrong: set[int] = set()
    for s in stretches:
        good: set[int] = set()
        bad: set[int] = set()
        for h in s:
            for k in range(WINDOW):
                at = window[h] + k
                if slots[at]:
                    value = int(text[place[h] + k])
                    (good if value == words[at] else bad).add(at)
                    held.setdefault(words[at], set()).add(value)
        tally.append((len(good), len(bad - good)))
        right |= good
        wrong |= bad
    wrong -= right
    other = len(wrong) >= LEAST_WRONG and len(wrong) > len(right)
    kept = [s for s, (a, c) in zip(stretches, tally) if not (other and c > a)]

    def covered_by(some: list[list[int]]) -> np.ndarray:
        mask = np.zeros(size + 1, dtype=np.int64)
        at = np.array([window[h] for s in some for h in s], dtype=np.int64)
        np.add.at(mask, at, 1)
        np.add.at(mask, at + WINDOW, -1)
        return np.concatenate([[0], np.cumsum(np.cumsum(mask[:size]) > 0)])

    covered = covered_by(kept)
    low, high = np.maximum(0, np.arange(size) - AROUND), np.minimum(size, np.arange(size) + AROUND + 1)
    copied = covered[high] - covered[low] >= DENSE * (high - low)
    for s in kept:
        x, y = window[s[0]], window[s[-1]] + WINDOW
        if covered[y] - covered[x] >= DENSE * max(y - x, min(2 * AROUND + 1, size)):
            copied[x:y] = True
    return Verdict(int(copied.sum()), len(right), len(wrong), other and all(len(v) == 1 for v in held.values()), int(covered_by(stretches)[-1]))


def _kind(v: Verdict, size: int, least: float) -> str | None:
    if v.copied >= least * size:
        return "exact" if v.copied == size and not v.contradict else "changed"
    if v.contradict >= LEAST_WRONG and v.contradict > v.agree and v.template >= least * size:
        return "renamed" if v.renamed else "pattern"
    return None


def _verdicts(doc: np.ndarray, item: np.ndarray, window: np.ndarray, place: np.ndarray, text: np.ndarray, items: Items, least: float) -> list[tuple[int, int, str, Verdict]]:
    """(document, item, kind, verdict) of the pairs of some kind."""
    d, i, n = _covered(doc, item, window, items)
    some = n >= 0.6 * least * items.lengths[i]  # less than DENSE * least
    if not some.any():
        return []
    pairs = doc.astype(np.int64) * len(items.ids) + item
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    out = []
    for a, b in zip(d[some].tolist(), i[some].tolist()):
        pair = order[slice(*np.searchsorted(pairs, [a * len(items.ids) + b, a * len(items.ids) + b + 1]))]
        v = _judged(place[pair].tolist(), window[pair].tolist(), text, items, b)
        kind = _kind(v, int(items.lengths[b]), least)
        if kind:
            out.append((a, b, kind, v))
    return out


def _slices(texts: list[str]):
    """(number of the text, code points) of stretches of at most SLICE code points; stretches of one text overlap."""
    for d, t in enumerate(texts):
        codes = _codes(t)
        for a in range(0, max(1, len(codes)), SLICE):
            yield d, codes[a : a + SLICE + 4_096]


def _scanned(texts: list[str], items: Items, share: float) -> list[tuple[int, int, str, Verdict]]:
    """(number of the text, number of the item, kind, verdict) over a batch of texts."""
    found: list[tuple[np.ndarray, ...]] = []
    read: list[np.ndarray] = []
    group: list[tuple[int, np.ndarray]] = []
    size = behind = 0

    def flush() -> None:
        nonlocal group, size, behind
        gap = np.full(1, 10, dtype=np.uint32)
        starts = np.cumsum([0] + [len(c) + 1 for _, c in group])
        words, place, number = words_of(np.concatenate([x for _, c in group for x in (c, gap)]))
        if len(words) >= WINDOW:
            owner = np.searchsorted(starts, place, "right") - 1
            at, item, window = items.hits(words, number, owner)
            inside = owner[at] == owner[np.minimum(at + WINDOW - 1, len(owner) - 1)]
            docs = np.array([d for d, _ in group])[owner[at]]
            found.append((docs[inside], item[inside], window[inside], behind + at[inside]))
            read.append(words)
            behind += len(words)
        group, size = [], 0

    for d, codes in _slices(texts) if len(items.ids) else ():
        group.append((d, codes))
        size += len(codes)
        if size >= SLICE:
            flush()
    if group:
        flush()
    if not found:
        return []
    doc, item, window, spot = (np.concatenate(x) for x in zip(*found))
    return _verdicts(doc, item, window, spot, np.concatenate(read), items, share)


_OUT = "kind string, covered double, template_covered double, slots_agreeing int, slots_contradicting int"


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, share: float = SHARE, most_items: int = MOST_ITEMS) -> DataFrame:
    """(key, item_key, kind, covered, template_covered, slots_agreeing, slots_contradicting) of every document that has the
    templates of at least ``share`` of an item.

    Numbers, names and units are replaced by typed placeholders, and windows of the templates that arise are joined by hash. kind:
    exact, all of the item with the same values; changed, at least ``share`` of it copied with some words or values changed; renamed,
    the item's pattern with other values, always the same one for a value, so a re-parameterised item; pattern, with other
    values at random. Only the first two are leaks. covered: the part of the item's words in copied stretches;
    template_covered: that in any window with its template. Case, accents, punctuation and spacing are folded. Null and
    empty texts, and items of fewer than WINDOW words, have no rows; repeated documents come out each. The
    items, a stated set, are broadcast up to ``most_items``; more of them meet the documents in a shuffled join of the window hashes,
    behind a sieve of bounded size, and only documents with enough windows of an item are read again. Both ways give the same
    rows: they only find pairs, and what is said of a pair hangs on its text, its item and the names of all items. Null
    keys, and keys that several items share, come out as they are.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.length("_text") > 0)
    wanted = items.select(F.col(item_key).alias("_item"), F.col(item_text).alias("_words")).where(F.col("_words").isNotNull())
    few = wanted.limit(most_items + 1).collect()
    if len(few) > most_items:
        return _joined(base, wanted, key, item_key, kind, item_kind, share)
    shared = spark.sparkContext.broadcast(Items([(n, r[1]) for n, r in enumerate(few)], names_of([r[1] for r in few])))
    ids = pa.array([r[0] for r in few], to_arrow_type(wanted.schema["_item"].dataType))

    def run(batches):
        for b in batches:
            got = _scanned(b.column("_text").to_pylist(), shared.value, share)
            if got:
                yield _batch(got, b.column("_key"), ids, shared.value, key, item_key)

    return spread(base).mapInArrow(run, f"{key} {kind}, {item_key} {item_kind}, {_OUT}")


def _batch(got: list[tuple[int, int, str, Verdict]], keys: pa.Array, ids: pa.Array, items: Items, key: str, item_key: str) -> pa.RecordBatch:
    size = [int(items.lengths[i]) for _, i, _, _ in got]
    columns = [keys.take(pa.array([d for d, *_ in got])), ids.take(pa.array([i for _, i, _, _ in got])), [k for _, _, k, _ in got], [v.copied / n for (*_, v), n in zip(got, size)],
               [v.template / n for (*_, v), n in zip(got, size)], pa.array([v.agree for *_, v in got], pa.int32()), pa.array([v.contradict for *_, v in got], pa.int32())]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[key, item_key, *(c.split()[0] for c in _OUT.split(", "))])


def _joined(base: DataFrame, wanted: DataFrame, key: str, item_key: str, kind: str, item_kind: str, share: float) -> DataFrame:
    """The way of any number of items: window hashes of documents, where a sieve has them, meet those of the items in a shuffled join."""
    spark = base.sparkSession

    def named(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(names_of(b.column("_words").to_pylist()).view(np.int64))], names=["name"])

    # a vocabulary: its growth with the number of items is that of distinct capitalised words
    names = np.sort(np.array([r[0] for r in wanted.mapInArrow(named, "name bigint").distinct().collect()], dtype=np.int64).view(np.uint64))
    common = spark.sparkContext.broadcast(names)

    def hashed(batches):
        for b in batches:
            items = Items(list(enumerate(b.column("_words").to_pylist())), common.value)
            at = pa.array(items.place[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(items.templates.view(np.int64)), b.column("_item").take(at), b.column("_w").take(at), pa.array(items.place[:, 1]), pa.array(items.lengths).take(at)], names=["h", "_item", "_w", "window", "size"])

    # items that share a key are told apart by a hash of their text
    wanted, base = wanted.withColumn("_w", F.xxhash64("_words")), base.withColumn("_t", F.xxhash64("_text"))
    windows = cut(wanted.mapInArrow(hashed, f"h bigint, _item {item_kind}, _w bigint, window bigint, size bigint"))
    passed = spark.sparkContext.broadcast(bit_field(windows.select(F.shiftrightunsigned("h", 64 - SIEVE).alias("spot")), "spot", 1 << SIEVE))

    def met(batches):
        empty, sieve = Items([], common.value), passed.value
        for b in batches:
            for doc, codes in _slices(b.column("_text").to_pylist()):
                words, _, number = words_of(codes)
                h = np.unique(empty.windows(words, empty.canonical(words, number)))
                spot = (h >> np.uint64(64 - SIEVE)).astype(np.int64)
                h = h[(sieve[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)]
                at = pa.array(np.full(len(h), doc))
                yield pa.RecordBatch.from_arrays([b.column("_key").take(at), b.column("_t").take(at), pa.array(h.view(np.int64))], names=["_key", "_t", "h"])

    seen = spread(base).mapInArrow(met, f"_key {kind}, _t bigint, h bigint").distinct()
    pair = ["_key", "_t", "_item", "_w"]
    enough = seen.join(windows, "h").groupBy(pair).agg(F.countDistinct("window").alias("n"), F.first("size").alias("size")).where(F.col("n") >= 0.6 * share * F.col("size") / WINDOW).select(pair).alias("e")
    same = lambda side, columns: reduce(and_, (F.col(f"{side}.{c}").eqNullSafe(F.col(f"e.{c}")) for c in columns))
    pairs = base.alias("b").join(enough, same("b", ["_key", "_t"])).join(wanted.alias("w"), same("w", ["_item", "_w"])).select("b._key", "b._text", "w._item", "w._words")

    def run(batches):
        for b in batches:
            texts, part = b.column("_text").to_pylist(), defaultdict(list)
            for n, words in enumerate(b.column("_words").to_pylist()):
                part[words].append(n)
            for words, rows in part.items():
                items, at = Items([(0, words)], common.value), pa.array(rows)
                got = _scanned([texts[n] for n in rows], items, share)
                if got:
                    # an item of these rows stands beside its document
                    own = b.column("_item").take(at).take(pa.array([d for d, *_ in got]))
                    out = _batch(got, b.column("_key").take(at), own.slice(0, 1), items, key, item_key)
                    yield pa.RecordBatch.from_arrays([out.column(0), own, *out.columns[2:]], names=out.schema.names)

    return pairs.mapInArrow(run, f"{key} {kind}, {item_key} {item_kind}, {_OUT}")


def p9_leaks(spark, sf_dir):
    """Documents with the templates of an item, what kind of repetition they are, and the parts and slots that agree."""
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_found(spark, sf_dir):
    """doc_id, item_id of every document that repeats at least half of an item with its values."""
    return p9_leaks(spark, sf_dir).where(F.col("kind").isin("exact", "changed")).select("doc_id", "item_id")


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks}
SQL: dict[str, str] = {}
