"""Problem 5: the k most similar vectors of every vector, by a k-means tree whose leaves meet in cells."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yarrow.common import cut, spread, table

K = 5
#: Rows that a leaf holds on average, whatever the collection's size: leaves grow in number, not in rows.
LEAF_ROWS = 1024
#: The tree is fitted on about so many vectors, at least LEAST_SAMPLE a leaf; a leaf that then holds more than
#: OVERFULL * LEAF_ROWS rows gets a subtree of its own, fitted on at most SUB_SAMPLE of its vectors.
SAMPLE, LEAST_SAMPLE, OVERFULL, SUB_SAMPLE = 20_000, 16, 128, 50_000
BRANCH = 32
#: Recall on the calibration queries at which widening stops, and how many queries calibrate.
RECALL, CALIBRATION = 0.99, 400
#: Every query sees about so many vectors of its own cell at least, which makes small collections exact.
SEEN = 4096
#: Rows of a leaf, and queries, that meet in one task; neighbouring leaves share a cell of about CELL_BLOCKS as many rows.
BLOCK, CELL_BLOCKS = 8192, 2
#: Numbers in the vectors of a leaf that is met whole at most, unless four times LEAF_ROWS hold more, and similarities held at once.
WHOLE, HELD = 1 << 23, 1 << 21
#: Similarities of single precision are compared with so much room; what passes is computed again in double precision.
ROOM = 1e-5
#: Keys that are broadcast at most.
FEW = 100_000
#: Range of the hash that draws samples.
_RANGE = 1 << 62


class Leaves:
    """Centroids of the leaves of a k-means tree. A vector lies in the leaf whose centroid is most similar to it, of all.

    It visits the leaves whose centroids are less similar by at most ``gap``, or the ``most`` most similar ones if that is fewer; and
    in any case leaves that hold ``least`` vectors, as ``held``, the sampled vectors of each leaf, assures.
    """

    def __init__(self, centres: np.ndarray) -> None:
        self.centres, self.gap, self.most, self.floor, self.least = centres, 0.0, 0, 1, 0
        self.held = np.zeros(len(centres), dtype=np.int64)

    @classmethod
    def fit(cls, vectors: np.ndarray, leaf_sample: float, branch: int = BRANCH, seed: int = 7) -> Leaves:
        rng, leaves = np.random.default_rng(seed), []
        todo = [(vectors[:1].mean(axis=0), np.arange(len(vectors)))]
        while todo:
            centre, rows = todo.pop()
            parts = _kmeans(vectors[rows], min(branch, max(2, len(rows) // (LEAST_SAMPLE // 2))), rng) if len(rows) > leaf_sample else None
            if parts is None:
                leaves.append(centre)
            else:
                todo += [(c, rows[parts[1] == j]) for j, c in enumerate(parts[0])]
        return cls(np.array(leaves, dtype=np.float32))

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        return np.concatenate([np.zeros(0, np.int32), *(np.argmax(vectors[a : a + 1024] @ self.centres.T, axis=1).astype(np.int32) for a in range(0, len(vectors), 1024))])

    def visits(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf of each vector; vector, leaf) of the visits, a vector's most similar leaf first, which is its own."""
        of, query, leaf = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for a in range(0, len(vectors), 1024):
            sims = vectors[a : a + 1024] @ self.centres.T
            best = np.argmax(sims, axis=1)
            top = sims[np.arange(len(sims)), best]
            least = np.partition(sims, len(self.centres) - self.most, axis=1)[:, len(self.centres) - self.most] if self.most else top - self.gap
            few = np.flatnonzero((sims >= least[:, None]) @ self.held < self.least)
            if len(few):
                near = -np.sort(-sims[few], axis=1)
                order = np.argsort(-sims[few], axis=1, kind="stable")
                enough = np.argmax(np.cumsum(self.held[order], axis=1) >= min(self.least, self.held.sum()), axis=1)
                least[few] = np.minimum(least[few], near[np.arange(len(few)), enough])
            i, j = np.nonzero(sims >= least[:, None])
            order = np.lexsort((j != best[i], -sims[i, j], i))
            of.append(best.astype(np.int32))
            query.append(a + i[order])
            leaf.append(j[order].astype(np.int32))
        return np.concatenate(of), np.concatenate(query), np.concatenate(leaf)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray] | None:
    """Spherical k-means seeded by distance; None if the vectors don't come apart (copies)."""
    centres = [x[rng.integers(len(x))]]
    far = 1 - x @ centres[0]
    for _ in range(min(k, len(x)) - 1):
        weight = np.maximum(far, 0)
        if weight.sum() < 1e-6:
            break
        centres.append(x[rng.choice(len(x), p=weight / weight.sum())])
        far = np.minimum(far, 1 - x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        of = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    of = np.argmax(x @ c.T, axis=1)
    kept = np.unique(of)
    if len(kept) < 2:
        return None
    return c[kept].astype(np.float32), np.searchsorted(kept, of)


def calibrate(leaves: Leaves, x: np.ndarray, unseen: np.ndarray, k: int = K, recall: float = RECALL, queries: int = CALIBRATION) -> None:
    """Widen the visits until vectors that the leaves were not fitted on are found at the recall, by queries that they were not fitted on either."""
    asked, held, k = [], [], min(k, len(x) - 1)
    of, picked = leaves.assign(x), _asked(unseen, queries)
    for part in np.array_split(np.arange(len(picked)), 4):
        sims = x[picked[part]] @ x.T
        sims[np.arange(len(part)), picked[part]] = -2
        true = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        i, j = np.nonzero(unseen[true])
        asked.append(part[i])
        held.append(of[true[i, j]])
    widen(leaves, x[picked], np.concatenate(asked), np.concatenate(held), recall)


def _asked(unseen: np.ndarray, queries: int = CALIBRATION) -> np.ndarray:
    picked = np.flatnonzero(unseen)
    return picked[:: max(1, -(-len(picked) // (4 * queries)))]


def widen(leaves: Leaves, queries: np.ndarray, asked: np.ndarray, held: np.ndarray, recall: float = RECALL) -> None:
    """Set the visits so that the recall's share of the pairs (query, leaf that holds a true neighbour) is met: a gap or a number of visits, whichever takes fewer."""
    if not len(asked):
        leaves.most = len(leaves.centres)
        return
    near = queries @ leaves.centres.T
    top = near.max(axis=1)
    at = near[asked, held]
    gap = np.sort(top[asked] - at)
    most = np.sort(np.concatenate([(near[asked[a : a + 1024]] > at[a : a + 1024, None]).sum(axis=1) + 1 for a in range(0, len(asked), 1024)]))
    n = min(len(gap), int(np.ceil(recall * len(gap)))) - 1
    leaves.gap, number = float(gap[n]) + ROOM, int(most[n])
    leaves.most = number if number < (near >= (top - leaves.gap)[:, None]).sum() / len(near) else 0


def usable(df: DataFrame, vector: str, dim: int) -> F.Column:
    """Of the given length, without null or NaN or infinite elements, not all zero."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _units(ids: pa.Array, column: pa.Array, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Keys and unit vectors of the rows with a key and a usable vector."""
    if not dim:
        return ids.slice(0, 0), np.zeros((0, 0), dtype=np.float32)
    kept = pc.and_(ids.is_valid(), pc.fill_null(pc.equal(pc.list_value_length(column), dim), False))
    ids, flat = ids.filter(kept), column.filter(kept).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null comes as NaN
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x = x[good]
    return ids.filter(pa.array(good)), (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    size = x.itemsize * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, size * len(x) + 1, size, dtype=np.int32)), pa.py_buffer(x)])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.float32).reshape(len(raw), -1)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest of each row; of equal ones at the border the first."""
    k = min(k, sims.shape[1])
    if k == sims.shape[1]:
        return np.tile(np.arange(k), (len(sims), 1))
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(sims, top, axis=1).min(axis=1, keepdims=True)
    tied = np.flatnonzero((sims >= least).sum(axis=1) > k)
    if len(tied):
        top[tied] = np.argsort(-sims[tied], axis=1, kind="stable")[:, :k]
    return top


def _sampled(df: DataFrame, key: str, part: float) -> DataFrame:
    """Rows that a hash of the key picks: the same at every run and partitioning."""
    return df.where(_picked(key, part))


def _picked(key: str, part: float) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_RANGE)) < F.lit(int(_RANGE * min(1.0, part)))


def _fitted(x: np.ndarray, rows: int, leaf_rows: int, k: int) -> Leaves:
    """A leaf for every ``leaf_rows`` of ``rows``, fitted on three quarters of a sample; the fourth calibrates the visits."""
    x = np.unique(x, axis=0)
    unseen = np.arange(len(x)) % 4 == 3
    leaves = Leaves.fit(x[~unseen], max(LEAST_SAMPLE, leaf_rows * (~unseen).sum() / max(rows, 1)))
    if len(leaves.centres) > 1:
        calibrate(leaves, x, unseen, k)
    leaves.held, leaves.least = np.bincount(leaves.assign(x), minlength=len(leaves.centres)), k + 1
    leaves.floor = min(len(leaves.centres), -(-SEEN * len(leaves.centres) // max(rows, 1)))
    return leaves


def _true(raw: DataFrame, queries: np.ndarray, leaves: Leaves, dim: int, k: int, sampled: Column) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) of the k vectors of the collection that are most similar to each query, without those of the sample: one pass that moves k rows a
    query and task. Equal vectors count once, the query's own not at all."""
    shared = raw.sparkSession.sparkContext.broadcast((queries, leaves))

    def run(batches):
        q, leaves = shared.value
        least, kept, step = np.full(len(q), -2, dtype=np.float32), (np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, bool)), 64
        for b in batches:
            flags, x = _units(b.column(0), b.column(1), dim)
            flags, a = flags.to_numpy(zero_copy_only=False), 0
            while a < len(x):
                there = x[a : a + step]
                sims = np.round(q @ there.T, 6)
                i, j = np.nonzero(sims > least[:, None])
                other = (q[i] != there[j]).any(axis=1)
                i, j = i[other], j[other]
                if len(i):
                    some, at = np.unique(j, return_inverse=True)
                    i, sim, leaf, flag = (np.concatenate(c) for c in zip(kept, (i, sims[i, j], leaves.assign(there[some])[at], flags[a + j])))
                    order = np.lexsort((leaf, -sim, i))
                    i, sim, leaf, flag = i[order], sim[order], leaf[order], flag[order]
                    new = np.ones(len(i), dtype=bool)
                    new[1:] = (i[1:] != i[:-1]) | (sim[1:] != sim[:-1]) | (leaf[1:] != leaf[:-1])
                    i, sim, leaf, flag = i[new], sim[new], leaf[new], flag[new]
                    n = np.arange(len(i)) - np.searchsorted(i, i, "left")
                    least[i[n == k - 1]] = sim[n == k - 1]
                    kept = tuple(c[n < k] for c in (i, sim, leaf, flag))
                a, step = a + step, min(1024, 2 * step)
        yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int32()), pa.array(-kept[1], pa.float32()), pa.array(kept[2], pa.int32()), pa.array(kept[3])], names=["q", "far", "leaf", "sampled"])

    found = raw.select(F.when(F.col("id").isNotNull(), sampled).alias("s"), "v").mapInArrow(run, "q int, far float, leaf int, sampled boolean")
    best = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_set(F.struct("far", "leaf", "sampled"))), 1, k).alias("b"))
    t = best.select("q", F.explode("b").alias("b")).where("NOT b.sampled").select("q", "b.leaf").toArrow()
    return t["q"].to_numpy(), t["leaf"].to_numpy()


def _tree(raw: DataFrame, sample: DataFrame, part: float, total: int, dim: int, leaf_rows: int, k: int) -> tuple[Leaves, np.ndarray] | None:
    """The leaves and the sample. Where the sample is not the whole collection, the visits are calibrated by neighbours among all vectors: those
    of a sample lie farther away the smaller its share, and would widen the visits of a large collection."""
    picked = sample.toArrow()
    x = _units(picked["id"].combine_chunks(), picked["v"].combine_chunks(), dim)[1]
    if not len(x):
        return None
    leaves = _fitted(x, total, leaf_rows, k)
    if len(leaves.centres) > 1 and part < 1:
        distinct = np.unique(x, axis=0)
        queries = distinct[_asked(np.arange(len(distinct)) % 4 == 3)]
        asked, held = _true(raw, queries, leaves, dim, k, _picked("id", part))
        if len(asked):
            widen(leaves, queries, asked, held)
    return leaves, x


def _cells(held: np.ndarray, most: float, cell_rows: int) -> np.ndarray:
    """The cell of each leaf, by its rows: leaves of one branch, whose numbers follow one another, together; -1 for one of more than ``most`` rows."""
    cell, rows, out = 0, 0.0, np.full(len(held), -1, dtype=np.int32)
    for leaf, n in enumerate(held.tolist()):
        if n <= most:
            if rows and rows + n > cell_rows:
                cell, rows = cell + 1, 0.0
            out[leaf], rows = cell, rows + n
    return out


def _routed(ids: pa.Array, x: np.ndarray, leaves: Leaves, cell: np.ndarray) -> pa.RecordBatch:
    """A row for each vector and each cell that it visits, its own among them, with the leaves it visits there, most similar first."""
    of, row, leaf = leaves.visits(x)
    some = cell[leaf] >= 0
    row, leaf = row[some], leaf[some]
    order = np.lexsort((np.arange(len(row)), cell[leaf], row))
    row, leaf = row[order], leaf[order]
    at = cell[leaf]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1])
    starts = np.flatnonzero(first)
    r = row[starts]
    own = np.where(cell[of[r]] == at[starts], of[r], -1)
    return pa.RecordBatch.from_arrays([pa.array(at[starts], pa.int32()), pa.array(own, pa.int32()), _lists(pa.array(leaf, pa.int32()), np.diff([*starts, len(row)])), ids.take(pa.array(r)), _binary(x[r])], names=["cell", "own", "visits", "id", "u"])


def _floored(own: np.ndarray, query: np.ndarray, leaf: np.ndarray, leaves: Leaves) -> tuple[np.ndarray, np.ndarray]:
    """The visits, and behind them those that make up a floor for the rows of a cell: the leaves of the cell nearest to their own."""
    here = np.unique(own[own >= 0])
    floor = min(len(here), leaves.floor)
    if floor < 2:
        return query, leaf
    sims = leaves.centres[here] @ leaves.centres[here].T
    near = here[np.argpartition(-sims, floor - 1, axis=1)[:, :floor]]
    mine = np.flatnonzero(own >= 0)
    query = np.concatenate([query, np.repeat(mine, floor)])
    leaf = np.concatenate([leaf, near[np.searchsorted(here, own[mine])].ravel()])
    _, first = np.unique(query.astype(np.int64) * len(leaves.centres) + leaf, return_index=True)
    first = np.sort(first)
    first = first[np.argsort(query[first], kind="stable")]
    return query[first], leaf[first]


def _met(own: np.ndarray, x: np.ndarray, query: np.ndarray, leaf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, similarity) of the k vectors most similar to each query, among those of the leaves that it visits; of equal ones the first.

    own: the leaf of each row, -1 if it is a query alone. (query, leaf) are the visits, a query's best leaf first. The k-th
    similarity there is the least that counts in the others.
    """
    order = np.argsort(own, kind="stable")
    leaves, starts = np.unique(own[order], return_index=True)
    held = {int(v): order[a:b] for v, a, b in zip(leaves, starts, [*starts[1:], len(order)]) if v >= 0}
    best = np.ones(len(query), dtype=bool)
    best[1:] = query[1:] != query[:-1]
    least = np.full(len(x), -2, dtype=np.float32)
    found = []
    for now in (True, False):
        turn = np.flatnonzero(best == now)
        turn = turn[np.argsort(leaf[turn], kind="stable")]
        for part in np.split(turn, np.flatnonzero(np.diff(leaf[turn])) + 1):
            of = held.get(int(leaf[part[0]])) if len(part) else None
            if of is None:
                continue
            there, step = x[of], max(32, min(1024, HELD // len(of)))
            for a in range(0, len(part), step):
                q = query[part[a : a + step]]
                sims = x[q] @ there.T
                spot = np.minimum(np.searchsorted(of, q), len(of) - 1)
                mine = of[spot] == q
                sims[mine, spot[mine]] = -3
                if now:
                    # the k-th of the highest of each of many stretches is no higher than the k-th of all
                    wide = len(of) // 64 if len(of) >= 64 * max(8, k) and k <= 64 else 1
                    top = sims[:, : len(of) // wide * wide].reshape(len(q), -1, wide).max(axis=2) if wide > 1 else sims
                    if top.shape[1] >= k:
                        least[q] = np.maximum(-2, np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k] - ROOM)
                i, j = np.nonzero(sims >= least[q][:, None])
                exact = np.minimum(np.einsum("ij,ij->i", x[q[i]].astype(np.float64), there[j].astype(np.float64)), 1.0)
                found.append(_first(q[i], of[j], exact, k))
    return _first(*(np.concatenate(c) for c in zip(*found)), k) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _first(query: np.ndarray, vector: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k of each query that are most similar, of equal ones the first."""
    order = np.lexsort((vector, -sim, query))
    q = query[order]
    order = order[np.arange(len(q)) - np.searchsorted(q, q, "left") < k]
    return query[order], vector[order], sim[order]


def nearest(df: DataFrame, key: str, vector: str, dim: int, k: int = K, sample: int = SAMPLE, block: int = BLOCK, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(key, neighbour, rank 1..k, cosine) for every usable vector.

    Vectors that are null, empty, of another length, all zero or hold a null or NaN have no rows and are no
    neighbours; a repeated key counts as one vector (its smallest by content). Ties go to the smaller
    key. With fewer than k others there are fewer rows; an empty table gives none.

    The tree has a leaf for about every ``leaf_rows`` vectors, so a query meets a number of vectors that
    does not grow with the collection. What is broadcast is fitted on ``sample`` vectors, hence bounded. Neighbouring leaves
    make up a cell of about CELL_BLOCKS * ``block`` rows, and a vector goes once to its own cell and to each other that it visits, rather
    than to each leaf. Leaves that would hold more than OVERFULL * ``leaf_rows``, or WHOLE numbers, are met apart: rows and visitors of such a
    leaf meet a subtree, which is fitted and calibrated in a task of its own, block by block. Vectors that are equal up
    to length are searched once, by their smallest key, so a group of copies of any size costs one vector; its members come
    back at the end.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    raw = df.select(F.col(key).alias("id"), F.col(vector).alias("v"))

    def mark(batches):
        for b in batches:
            ids, x = _units(b.column(0), b.column(1), dim)
            yield pa.RecordBatch.from_arrays([ids, pa.array([hashlib.md5(r.tobytes(), usedforsecurity=False).digest() for r in x], pa.binary())], names=["id", "h"])

    marked = lambda rows: cut(spread(rows).mapInArrow(mark, f"id {kind}, h binary"))
    marks = marked(raw)
    total, most = marks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most > 1:
        # where few keys are repeated, only their rows move
        ids = cut(marks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
        few = F.broadcast(ids) if ids.count() <= FEW else ids
        single = raw.where(F.col("id").isNotNull() & usable(raw, "v", dim))
        single = cut((single.join(few, "id", "left_semi") if few is not ids else single).groupBy("id").agg(F.min("v").alias("v")))
        raw = raw.join(few, "id", "left_anti").unionByName(single) if few is not ids else single
        marks = marked(raw)
    repeated = marks.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).where("n > 1")
    copies = repeated.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    total -= copies
    part, every_raw = sample / max(total, 1), raw
    drawn = _sampled(raw, "id", part)
    if copies:
        groups = cut(repeated.select("h", "rep"))
        every = marks.join(groups, "h").select("rep", "id")
        # the sample is drawn from keys, so that of the vectors only its own are read
        first = cut(_sampled(marks.groupBy("h").agg(F.min("id").alias("id")).select("id"), "id", part))
        drawn = raw.join(F.broadcast(first), "id", "left_semi")  # about ``sample`` keys
        rest = every.where("id <> rep").select("id")
        # the vectors themselves move only where copies are many, and then once
        raw = spread(raw.join(F.broadcast(cut(rest)), "id", "left_anti")) if copies <= FEW else raw.join(rest, "id", "left_anti")
    else:
        raw = spread(raw)
    tree = _tree(every_raw, drawn, part, total, dim, leaf_rows, k)
    if tree is None:
        return spark.createDataFrame([], f"{key} {kind}, neighbour {kind}, rank int, cosine double")
    leaves, x = tree
    whole = min(OVERFULL * leaf_rows, max(4 * leaf_rows, WHOLE // dim))
    cell = _cells(leaves.held * (total / len(x)), whole, CELL_BLOCKS * block)
    shared = spark.sparkContext.broadcast(leaves)

    def route(batches):
        for b in batches:
            yield _routed(*_units(b.column(0), b.column(1), dim), shared.value, cell)

    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        lists = t["visits"].combine_chunks()
        query = np.repeat(np.arange(len(t)), pc.list_value_length(lists).to_numpy())
        own = t["own"].to_numpy()
        q, v, sims = _met(own, _matrix(t["u"]), *_floored(own, query, lists.flatten().to_numpy(), shared.value), k)
        ids = t["id"].combine_chunks()
        pairs = pa.StructArray.from_arrays([pa.array(-sims, pa.float64()), ids.take(pa.array(v))], names=["far", "neighbour"])
        asked, sizes = np.unique(q, return_counts=True)
        return pa.table({"id": ids.take(pa.array(asked)), "found": _lists(pairs, sizes)})

    routed = raw.mapInArrow(route, f"cell int, own int, visits array<int>, id {kind}, u binary")
    found = routed.groupBy("cell").applyInArrow(gather, f"id {kind}, found array<struct<far:double,neighbour:{kind}>>")
    if (cell < 0).any():
        found = found.unionByName(_apart(raw, shared, np.flatnonzero(cell < 0), dim, kind, leaf_rows, whole, k, block))
    # a query's lists, k entries from each cell it visited: a bounded number
    ranked = found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("f"))
    if copies:
        ranked = _members(groups, every, cut(ranked), k)
    ranked = ranked.select(F.col("id").alias(key), F.posexplode("f").alias("rank", "n"))
    return ranked.select(key, F.col("n.neighbour").alias("neighbour"), (F.col("rank") + 1).alias("rank"), (-F.col("n.far")).alias("cosine"))


def _apart(raw: DataFrame, shared, big: np.ndarray, dim: int, kind: str, leaf_rows: int, whole: int, k: int, block: int) -> DataFrame:
    """(id, found) from the leaves ``big`` alone: each goes through a subtree, and rows meet visitors block by block."""

    def place(batches):
        for b in batches:
            ids, x = _units(b.column(0), b.column(1), dim)
            of, query, leaf = shared.value.visits(x)
            met = np.isin(leaf, big)
            n = np.bincount(query[met], minlength=len(x))
            mine = np.isin(of, big)
            some = mine | (n > 0)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(some)), _binary(x[some]), pa.array(np.where(mine, of, -1)[some], pa.int32()), _lists(pa.array(leaf[met], pa.int32()), n[some])], names=["id", "u", "leaf", "visits"])

    placed = cut(raw.mapInArrow(place, f"id {kind}, u binary, leaf int, visits array<int>"))
    ours = placed.where("leaf >= 0").select(F.lit(True).alias("is_x"), "leaf", F.lit(0).alias("sub"), "id", "u")
    theirs = placed.select(F.lit(False).alias("is_x"), F.explode("visits").alias("leaf"), F.lit(0).alias("sub"), "id", "u")
    rows = _deepened(ours, theirs, kind, leaf_rows, whole, k, block)
    # one row a leaf; the planner broadcasts it if it is small
    sizes = rows.groupBy("leaf", "sub").agg(F.ceil(F.count_if("is_x") / block).cast("int").alias("nx"), F.ceil(F.count_if(~F.col("is_x")) / block).cast("int").alias("nq"))
    near = F.xxhash64("id")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.array(F.pmod(near, n).cast("int"))
    met = rows.join(sizes.where("nx > 0 AND nq > 0"), ["leaf", "sub"])
    met = met.select("is_x", "leaf", "sub", "id", "u", F.when(F.col("is_x"), mine("nx")).otherwise(every("nx")).alias("_bx"), F.when(F.col("is_x"), every("nq")).otherwise(mine("nq")).alias("_bq"))
    met = met.select("is_x", "leaf", "sub", "id", "u", F.explode("_bx").alias("bx"), "_bq").select("is_x", "leaf", "sub", "id", "u", "bx", F.explode("_bq").alias("bq"))

    def meet(t: pa.Table) -> pa.Table:
        ours = t.filter(t["is_x"]).sort_by("id")
        theirs = t.filter(pc.invert(t["is_x"]))
        xs, qs = (_matrix(x["u"]).astype(np.float64) if x.num_rows else np.zeros((0, 1)) for x in (ours, theirs))
        own = pc.fill_null(pc.index_in(theirs["id"], value_set=ours["id"].combine_chunks()), -1).to_numpy() if theirs.num_rows else np.zeros(0, int)
        cols, near, sizes = [], [], []
        for a in range(0, len(qs) if len(xs) else 0, 512):
            sims = np.minimum(qs[a : a + 512] @ xs.T, 1.0)
            mine = own[a : a + 512]
            at = np.flatnonzero(mine >= 0)
            sims[at, mine[at]] = -2
            top = _best(sims, k)
            found = np.take_along_axis(sims, top, axis=1)
            good = found > -1.5
            cols.append(top[good])
            near.append(-found[good])
            sizes.append(good.sum(axis=1))
        if not cols:
            return pa.table({"id": t["id"].slice(0, 0), "found": pa.array([], out)})
        names = ours["id"].combine_chunks().take(pa.array(np.concatenate(cols)))
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(near), pa.float64()), names], names=["far", "neighbour"])
        return pa.table({"id": theirs["id"], "found": _lists(pairs, np.concatenate(sizes))})

    out = pa.list_(pa.struct([("far", pa.float64()), ("neighbour", _arrow_type(placed, "id"))]))
    return met.groupBy("leaf", "sub", "bx", "bq").applyInArrow(meet, f"id {kind}, found array<struct<far:double,neighbour:{kind}>>")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _deepened(ours: DataFrame, theirs: DataFrame, kind: str, leaf_rows: int, whole: int, k: int, block: int) -> DataFrame:
    """Rows and visits of the leaves, those of overfull leaves sent on to the leaves of a subtree.

    Leaves are fewer than the vectors that they were fitted on, so their counts fit the driver.
    """
    counts = ours.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole).collect()
    both = ours.unionByName(theirs)
    if not counts:
        return both
    spark = ours.sparkSession
    over = F.broadcast(spark.createDataFrame([(r["leaf"], r["n"], -(-r["n"] // block), min(1.0, max(SUB_SAMPLE // 4, min(SUB_SAMPLE, LEAST_SAMPLE * r["n"] // leaf_rows)) / r["n"])) for r in counts], "leaf int, n long, blocks long, part double"))

    def fit(t: pa.Table) -> pa.Table:
        leaves = _fitted(_matrix(t["u"]), t["n"][0].as_py(), leaf_rows, k)
        return pa.table({"leaf": t["leaf"].slice(0, 1), "blocks": t["blocks"].slice(0, 1), "tree": pa.array([pickle.dumps(leaves)], pa.binary())})

    drawn = ours.join(over, "leaf").where(F.pmod(F.xxhash64("id"), F.lit(_RANGE)) < (F.col("part") * float(_RANGE)))
    trees = cut(drawn.select("leaf", "n", "blocks", "u").groupBy("leaf").applyInArrow(fit, "leaf int, blocks long, tree binary"))

    def send(rows: pa.Table, trees: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(["is_x", "leaf", "sub", "id", "u"])
        is_x = rows["is_x"].to_numpy()
        of, at, sub = pickle.loads(trees["tree"][0].as_py()).visits(_matrix(rows["u"]))
        asked = ~is_x[at]
        at, sub = np.concatenate([np.flatnonzero(is_x), at[asked]]), np.concatenate([of[is_x], sub[asked]])
        t = rows.take(pa.array(at))
        return pa.table({"is_x": t["is_x"], "leaf": t["leaf"], "sub": pa.array(sub, pa.int32()), "id": t["id"], "u": t["u"]})

    blocks = trees.select("leaf", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
    many = both.join(over.select("leaf", "blocks"), "leaf").select("is_x", "leaf", "sub", "id", "u", F.pmod(F.xxhash64("id"), "blocks").cast("long").alias("b"))
    sent = many.groupBy("leaf", "b").cogroup(blocks.groupBy("leaf", "b")).applyInArrow(send, f"is_x boolean, leaf int, sub int, id {kind}, u binary")
    return cut(both.join(over.select("leaf"), "leaf", "left_anti").select("is_x", "leaf", "sub", "id", "u").unionByName(sent))


def _members(groups: DataFrame, every: DataFrame, merged: DataFrame, k: int) -> DataFrame:
    """(id, f) of every vector from those of the distinct ones: its copies come first, a neighbour stands for all of its group.

    Of a group only its k + 1 smallest keys can ever be neighbours; they are found without bringing the group together.
    """
    first = every.withColumn("_k", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("_k") <= k + 1).groupBy("rep").agg(F.collect_list("id").alias("ids"))
    flat = merged.select("id", F.explode("f").alias("n")).join(first, F.col("n.neighbour") == F.col("rep"), "left")
    flat = flat.groupBy("id").agg(F.flatten(F.collect_list(F.transform(F.coalesce("ids", F.array("n.neighbour")), lambda x: F.struct(F.col("n.far").alias("far"), x.alias("neighbour"))))).alias("f"))
    single = flat.join(groups.select(F.col("rep").alias("id")), "id", "left_anti").select("id", F.slice(F.array_sort("f"), 1, k).alias("f"))
    # with no other vector at all a group still has its own copies
    wide = every.join(first, "rep").join(flat.withColumnRenamed("id", "rep"), "rep", "left")
    own = F.transform(F.filter("ids", lambda x: x != F.col("id")), lambda x: F.struct(F.lit(-1.0).alias("far"), x.alias("neighbour")))
    none = F.array().cast(flat.schema["f"].dataType)
    return single.unionByName(wide.select("id", F.slice(F.concat(own, F.array_sort(F.coalesce("f", none))), 1, k).alias("f")))


def _points(spark, sf_dir):
    dim = table(spark, sf_dir, "h1_vector_quality_report_0").agg(F.max("vector_dim")).first()[0]
    return table(spark, sf_dir, "points"), int(dim or 0)


def p5_neighbours(spark, sf_dir):
    """Every usable vector's five most similar others."""
    points, dim = _points(spark, sf_dir)
    return nearest(points, "chunk_id", "vector", dim)


def p5_found(spark, sf_dir):
    """chunk_a < chunk_b, of which at least one has the other among its five most similar."""
    found = p5_neighbours(spark, sf_dir)
    return found.select(F.least("chunk_id", "neighbour").alias("chunk_a"), F.greatest("chunk_id", "neighbour").alias("chunk_b")).distinct()


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours}
SQL = {
    "p5_found": """
WITH u AS (SELECT chunk_id, vector FROM points, h1_vector_quality_report_0 WHERE len(vector) = vector_dim
  AND list_sum(list_transform(vector, lambda x: CASE WHEN isnan(x) OR isinf(x) THEN 1 ELSE 0 END)) = 0
  AND list_sum(list_transform(vector, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)) > 0),
n AS (SELECT chunk_id, list_transform(vector, lambda x: x::DOUBLE) v FROM u),
s AS (SELECT a.chunk_id q, b.chunk_id x, row_number() OVER (PARTITION BY a.chunk_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.chunk_id) k FROM n a, n b WHERE a.chunk_id <> b.chunk_id)
SELECT DISTINCT least(q, x) chunk_a, greatest(q, x) chunk_b FROM s WHERE k <= 5"""
}
