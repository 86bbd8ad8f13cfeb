"""Problem 8: token ids of every text by a tokenization automaton compiled from a public merge list."""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache
from itertools import accumulate, chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yarrow.common import spread, table

#: Fixed value: the public pattern that splits a text before the merges of a byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words kept with their ids, and transitions kept with their answers, by a worker; it starts anew beyond that.
CACHE, TABLE = 400_000, 2_000_000
FOREVER = 1 << 30


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Where a public vocabulary lies: ``folder``, else the installed collection."""
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the file: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Automaton:
    """A deterministic automaton over token labels that accepts just the merge-ordered segmentations.

    It starts with one state that every byte leads back to. The gadget of a merge (a, b), the m-th,
    copies the state that a leads to, takes the arc b out of the copy, leads a into the copy, and
    gives each state with an arc a an arc ab to the old target of b. Every arc with one label thus
    ends in one state, named by that label, and the states a copy descends from are those of the
    label's right parts, each as it stood when the next longer part arose. So the arc x leaves the
    state of t unless some gadget m took away a left part of x from a right part of t before the
    longer parts existed; ``_arc`` evaluates that, and the answers fill the transition table.
    """

    def __init__(self, file: bytes) -> None:
        model = json.loads(file)["model"]
        letters = _byte_letters()
        self.ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        raw = {t: bytes(letters[c] for c in t) for pair in merges for t in pair}
        self.gadget: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for m, (a, b) in enumerate(merges):
            x, y = self.ids[raw[a]], self.ids[raw[b]]
            both = self.ids[raw[a] + raw[b]]
            self.gadget.setdefault((x, y), m)
            if both not in self.born:
                self.born[both], self.halves[both] = m, (x, y)
        self.table: dict[tuple[int, int], bool] = {}
        self.arcs = ahocorasick.Automaton()
        self.labels = {i: t for t, i in self.ids.items()}
        for t, i in self.ids.items():
            if i in self.born or len(t) == 1:
                self.arcs.add_word(t.decode("latin-1"), (i, len(t)))
        self.arcs.make_automaton()
        #: byte pairs that stand side by side inside some label; elsewhere a word falls apart
        self.inside = {(t[k], t[k + 1]) for t in self.ids for k in range(len(t) - 1)}
        self.words = _Words(self)
        self.stretches = _Stretches(self.words)

    def _parts(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, when the next longer part arose) down one side of a label's halves."""
        out, longer = [(token, FOREVER)], token
        while longer in self.halves:
            part = self.halves[longer][side]
            out.append((part, self.born[longer]))
            longer = part
        return out

    def _arc(self, state: int, label: int) -> bool:
        for part, left_longer in self._parts(state, 1):
            for first, right_longer in self._parts(label, 0):
                m = self.gadget.get((part, first), FOREVER)
                # of overlapping pairs the left one is merged first, hence not the same bound on both sides
                if m < left_longer and m <= right_longer and m < FOREVER:
                    return False
        return True

    def run(self, word: str) -> tuple[int, ...]:
        """Labels of the one accepted path over the bytes of ``word``, given as Latin-1 characters."""
        n = len(word)
        last: list[int] = [-1] * (n + 1)
        table = self.table
        for end, (label, size) in self.arcs.iter(word):
            start = end + 1 - size
            if start:
                state = last[start]
                if state < 0:
                    continue
                allowed = table.get((state, label))
                if allowed is None:
                    if len(table) > TABLE:
                        table.clear()
                    allowed = table[(state, label)] = self._arc(state, label)
                if not allowed:
                    continue
            last[end + 1] = label
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(self.labels[last[at]])
        return tuple(reversed(out))

    def encode(self, text: str) -> bytes:
        """Ids of a text, as native 32-bit integers.

        A single space between other characters always begins a new word of PATTERN, so texts
        without two spaces in a row are cut there first, and whole stretches are looked up.
        """
        if len(self.words) + len(self.stretches) > CACHE:
            self.words.clear()
            self.stretches.clear()
        if "  " in text:
            return b"".join(map(self.words.__getitem__, _split(text)))
        first, *rest = text.split(" ")
        return b"".join(chain(map(self.words.__getitem__, _split(first)), map(self.stretches.__getitem__, rest)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


_split = regex.compile(PATTERN).findall


class _Words(dict):
    """Ids by word; a word is cut between characters that no label joins, so long runs share their parts."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton, self.pieces = automaton, {}

    def __missing__(self, word: str) -> bytes:
        if word.isascii():
            ids = array("i", self.automaton.run(word)).tobytes()
        else:
            inside, pieces = self.automaton.inside, self.pieces
            ids, piece, before = b"", "", None
            # a lone surrogate has no bytes in UTF-8; like other encoders, take the replacement sign
            for c in word:
                b = c.encode("utf-8", "replace") if not "\ud800" <= c <= "\udfff" else b"\xef\xbf\xbd"
                if before is not None and (before, b[0]) not in inside:
                    ids += pieces.get(piece) or self._piece(piece)
                    piece = ""
                piece += b.decode("latin-1")
                before = b[-1]
            ids += pieces.get(piece) or self._piece(piece)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        ids = array("i", self.automaton.run(piece)).tobytes()
        if len(piece) <= 64:
            self.pieces[piece] = ids
        return ids


class _Stretches(dict):
    """Ids of what stands behind one space, up to the next, with that space."""

    def __init__(self, words: _Words) -> None:
        self.words = words

    def __missing__(self, stretch: str) -> bytes:
        ids = b"".join(map(self.words.__getitem__, _split(" " + stretch)))
        if len(stretch) <= 48:
            self[stretch] = ids
        return ids


@lru_cache(maxsize=4)
def automaton(file: bytes) -> Automaton:
    return Automaton(file)


def vocabulary(path: str | None = None) -> bytes:
    """The file of a vocabulary, read on the driver: the tasks get its bytes, so that no other machine needs the file."""
    with open(path or tokenizer_path(), "rb") as f:
        return f.read()


def encoded(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids) of every row; null and empty texts have the empty list, repeated rows come out each.

    Marker-like strings are plain text. One narrow stage without a shuffle: the vocabulary, a few MB, is broadcast and each
    Python worker compiles the automaton once. Columns other than ``key`` and ``text`` are never read.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = df.schema[key].dataType

    def run(batches):
        machine = automaton(shared.value)
        for batch in batches:
            coded = [machine.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            ends = array("i", [0, *accumulate(len(c) // 4 for c in coded)])
            flat = b"".join(coded)
            lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)]), pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    rows = spread(df.select(F.col(key), F.col(text).alias("_text")))
    return rows.mapInArrow(run, f"{key} {kind.simpleString()}, ids array<int>")


def p8_ids(spark, sf_dir):
    """doc_id, ids by byte_bpe_50k of every document."""
    return encoded(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
