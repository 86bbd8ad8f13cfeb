"""Rank fusion, splitting, copies and neighbours: edge cases and brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from yarrow.llm import borda, copies, neighbours, splitting

S = "g string, item string, a double, b double, `_group` string, text string"


def _borda_model(rows):
    """Brute force by group: average competition ranks, mid-rank for missing or lone scores."""
    best = {}
    for g, i, *scores in rows:
        old = best.setdefault(g, {}).setdefault(i, [None] * len(scores))
        for k, s in enumerate(scores):
            if s is not None and s == s and (old[k] is None or s > old[k]):
                old[k] = s
    out = {}
    for g, items in best.items():
        n = len(items)
        for i, scores in items.items():
            total = 0.0
            for k, s in enumerate(scores):
                have = [v[k] for v in items.values() if v[k] is not None]
                if s is None or len(have) < 2:
                    total += (n - 1) / 2
                else:
                    rank = 1 + sum(x > s for x in have)
                    total += (len(have) - (rank + (have.count(s) - 1) / 2)) * (n - 1) / (len(have) - 1)
            out[(g, i)] = round(total, 6)
    return out


@pytest.mark.parametrize("hot", [10_000, 3])
def test_borda_against_brute_force(spark, hot):
    rnd = random.Random(5)
    rows = [(rnd.choice(["x", "y", None, ""]), f"i{rnd.randrange(12)}", rnd.choice([None, float("nan"), 1.0, 2.0, rnd.random() * 1000]), rnd.choice([None, -1.0, rnd.random()])) for _ in range(150)]
    df = spark.createDataFrame([(*r, "clash", "t") for r in rows], S)
    got = {(r.g, r.item): round(r.points, 6) for r in borda.borda(df, "g", "item", ["a", "b"], hot_rows=hot).collect()}
    assert got == _borda_model(rows)


def test_borda_empty_and_ties(spark):
    assert borda.borda(spark.createDataFrame([], S), "g", "item", ["a", "b"]).count() == 0
    df = spark.createDataFrame([("q", "b", 1.0, 5.0, "", ""), ("q", "a", 1.0, 5.0, "", ""), ("q", "a", 1.0, 5.0, "", "")], S)
    assert [r.item for r in borda.first_places(borda.borda(df, "g", "item", ["a", "b"]), "g", "item").collect()] == ["a"]


TEXTS = {
    1: None, 2: "", 3: "ngắn", 4: "a" * 1500, 5: "b" * 1501, 6: "Câu một khá dài. " * 400, 7: ("đoạn văn " * 30 + "\n\n") * 20, 8: "无空格" * 1200, 9: "x" * 100_000, 10: " \n" * 3000,
}


def test_pieces_rebuild_the_text(spark):
    rows = [(i, t, "p", 0, "clash") for i, t in TEXTS.items()] + [(6, TEXTS[6], "p", 0, "clash")]
    df = spark.createDataFrame(rows, "ord bigint, t string, parent string, child int, piece string")
    got: dict = {}
    for r in splitting.split_texts(df, "t", ["ord"]).collect():
        got.setdefault(r.ord, []).append(r)
    for i, t in TEXTS.items():
        pieces = sorted(got[i], key=lambda r: r.piece_no)
        if t is None or len(t) <= 1500:
            assert [p.piece for p in pieces] == [t]
            continue
        if i == 6:
            pieces = pieces[::2]  # the repeated row comes out each
        end = 0
        for p in pieces:
            assert 0 < len(p.piece) <= 1500 and t[p.start_char : p.start_char + len(p.piece)] == p.piece
            assert p.piece_no == 0 or 100 <= end - p.start_char <= 200
            end = p.start_char + len(p.piece)
        assert end == len(t)


def test_an_edit_moves_only_neighbouring_pieces():
    lost = []
    for seed in range(12):
        rnd = random.Random(seed)
        text = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) + rnd.choice(["", "", "."]) for _ in range(9000))
        at = rnd.randrange(1000, len(text) - 3000)
        edited = text[:at] + "một câu chen vào " + text[at:]
        before, after = [text[s:e] for s, e in splitting.cuts(text)], {edited[s:e] for s, e in splitting.cuts(edited)}
        moved = [k for k, piece in enumerate(before) if piece not in after]
        assert moved == list(range(moved[0], moved[-1] + 1))  # all others are as they were
        lost.append(len(moved))
    assert max(lost) <= 5 and sum(lost) <= 24


def test_renumbering(spark):
    df = spark.createDataFrame([(1, "p", 0, "a" * 2000), (2, "p", 1, "b"), (3, "q", 0, None), (4, "p", 0, "c")], "ord bigint, parent_id string, child_index int, text string")
    pieces = splitting.split_texts(df, "text", ["ord"])
    rows = sorted((r.parent_id, r.child_index, r.ord) for r in splitting.renumbered(df, pieces, "ord", "parent_id", ["child_index", "ord"]).collect())
    n = pieces.where("ord = 1").count()
    assert n >= 2 and rows == [*[("p", k, 1) for k in range(n)], ("p", n, 4), ("p", n + 1, 2), ("q", 0, 3)]


def test_copies(spark):
    labelled = "Tên vị thuốc: quế chi; Tính vị: vị cay; Liều sáng: 5 g; Liều tối: 9 g"
    rows = [
        (1, "Chất chiết từ quế chi làm dịu ho khan."), (2, "**CHẤT CHIẾT từ  quế chi\nlàm dịu ho khan**"), (3, "Chất chiết từ quế chi làm dịu ho khàn."), (4, None), (5, ""), (6, "ngắn"), (7, "NGẮN!"),
        (8, labelled), (9, "Liều tối: 9 g | Tính vị: vị cay | Tên vị thuốc: quế chi | Liều sáng: 5 g"), (10, labelled.replace("5 g", "9 g", 1).replace("tối: 9", "tối: 5")), (11, labelled.replace(":", "").replace(";", "")), (12, labelled),
    ]
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], "ord bigint, text string, raw int, record string")
    assert sorted((r.first, r.copy) for r in copies.copies(df, "ord", "text").collect()) == [(1, 2), (8, 9), (8, 11), (8, 12)]
    counts = {r.ord: r.n_copies for r in copies.collapsed(df, "ord", "text").collect()}
    assert counts == {1: 2, 3: 1, 8: 4, 10: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    assert copies.copies(df.limit(0), "ord", "text").count() == 0


def test_copies_of_fields_with_other_signs(spark):
    fields = [("Tên vị thuốc", "quế chi"), ("Tính vị", "vị cay, tính ấm"), ("Liều sáng", "5 g")]
    texts = ["; ".join(f"{a}: {b}" for a, b in fields), " | ".join(f"{a} = {b}" for a, b in fields[::-1]), "\n".join(f"- {b} – {a}" for b, a in (fields[1], fields[0], fields[2])), "\n".join(f"**{a}**\t{b}" for a, b in fields)]
    other = ["ab: cdefghijklmnopqrstuv; x: y", "x: y; a: bcdefghijklmnopqrstuv", "Tên vị thuốc: quế chi; Tính vị: vị cay, tính ấm; Liều sáng: 6 g"]
    rows = [*enumerate(texts), *enumerate(other, 10)]
    df = spark.createDataFrame(rows, "ord bigint, text string")
    assert sorted((r.first, r.copy) for r in copies.copies(df, "ord", "text").collect()) == [(0, 1), (0, 2), (0, 3)]


def test_copies_that_only_a_third_text_links(spark):
    # the letters of 2 can be read as the fields of 1 or of 3
    rows = [(1, "klmnopqrst: v; abcdefghij: uwx"), (2, "abcdefghij: uwx; klmnopqrst: v"), (3, "abcdefghiju: wx; klmnopqrst: v"), (4, "klmnopqrst: v; abcdefghiju: wx"), (5, "klmnopqrst: v; abcdefghij: uwy")]
    df = spark.createDataFrame(rows, "ord bigint, text string")
    assert sorted((r.first, r.copy) for r in copies.copies(df, "ord", "text").collect()) == [(1, 2), (1, 3), (1, 4)]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(60, size=1500)] + 0.15 * rng.normal(size=(1500, 16))
    rows = [(f"k{i:05d}", [float(v) for v in r], "clash") for i, r in enumerate(x)]
    rows += [("n1", None, ""), ("n2", [], ""), ("n3", [0.0] * 16, ""), ("n4", [float("nan")] * 16, ""), ("n5", [1.0] * 15, ""), ("n6", [None] * 16, "")]
    df = spark.createDataFrame(rows, "id string, vec array<float>, neighbour string")
    old = neighbours.SEEN
    neighbours.SEEN = 1
    try:
        got: dict = {}
        for r in neighbours.nearest(df, "id", "vec", 16, block=64, leaf_rows=100).collect():
            got.setdefault(r.id, set()).add(r.neighbour)
    finally:
        neighbours.SEEN = old
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    true = np.argsort(-sims, axis=1)[:, :5]
    hit = sum(f"k{j:05d}" in got[f"k{i:05d}"] for i, row in enumerate(true) for j in row)
    assert len(got) == 1500 and hit / (5 * 1500) >= 0.95
    assert neighbours.nearest(df.limit(0), "id", "vec", 16).count() == 0
    three = spark.createDataFrame(rows[:3], "id string, vec array<float>, neighbour string")
    assert neighbours.nearest(three, "id", "vec", 16).count() == 6
    same = spark.createDataFrame([(f"s{i}", [1.0, 2.0], "") for i in range(300)], "id string, vec array<float>, neighbour string")
    assert neighbours.nearest(same, "id", "vec", 2, block=64).count() == 1500


def _true_neighbours(rows, k=5):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 9)
    return {i: [ids[j] for j in sorted((j for j in range(len(ids)) if j != n), key=lambda j: (-sims[n, j], ids[j]))[:k]] for n, i in enumerate(ids)}


def test_neighbours_of_repeated_keys_and_copies(spark):
    rng = np.random.default_rng(4)
    rows = {f"k{i:03d}": rng.normal(size=8) for i in range(60)}
    for i in range(0, 40):  # a group of copies that holds much of the table, one of them longer
        rows[f"c{i:03d}"] = rows["k007"] * (1 if i else 2)
    data = [(i, [float(v) for v in r]) for i, r in rows.items()]
    again = [("k003", [9.0] * 8), ("k003", data[3][1])]
    rows["k003"] = np.array(min([9.0] * 8, data[3][1]))
    df = spark.createDataFrame(data + again, "id string, vec array<double>")
    got: dict = {}
    for r in sorted(neighbours.nearest(df, "id", "vec", 8).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == _true_neighbours(rows)


def test_overfull_leaves_get_subtrees(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(80, 16))
    x = centres[rng.integers(80, size=1200)] + 0.15 * rng.normal(size=(1200, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<float>")
    for name, value in (("SEEN", 1), ("OVERFULL", 1), ("LEAST_SAMPLE", 8)):
        monkeypatch.setattr(neighbours, name, value)
    got: dict = {}
    for r in neighbours.nearest(df, "id", "vec", 16, sample=100, block=256, leaf_rows=60).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    true = _true_neighbours({i: r for i, r in enumerate(x)})
    assert len(got) == 1200 and sum(len(got[i] & set(t)) for i, t in true.items()) / 6000 >= 0.9


@pytest.mark.parametrize("name", ["p3_found", "p3_rebuilt", "p4_found", "p4_records", "p5_found", "p7_found"])
def test_query_equals_its_sql(spark, small, name):
    import duckdb

    from yarrow import llm

    con = duckdb.connect()
    for t in ("chunks", "points", "retrieval_results", "h1_vector_quality_report_0"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    r = con.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in r.description]
    assert sorted(map(tuple, llm.queries()[name](spark, small).select(*columns).collect())) == sorted(r.fetchall())


def test_a_vector_goes_to_few_cells_and_has_all_its_neighbours():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 32))[rng.integers(150, size=12_000)] + 0.2 * rng.normal(size=(12_000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[:3] = np.eye(32, dtype=np.float32)[:3]  # far from all others
    leaves = neighbours._fitted(x[::3], len(x), 256, 5)
    cell = neighbours._cells(leaves.held * 3.0, 4096, 1024)
    rows = neighbours._routed(pa.array(range(len(x))), x, leaves, cell)
    assert cell.max() >= 10 and rows.num_rows < 1.5 * len(x)  # it went to each of the leaves visited, above ten times as many rows
    of, query, leaf = leaves.visits(x)
    q, v, _ = neighbours._met(of, x, query, leaf, 5)
    assert (np.bincount(q, minlength=len(x)) == 5).all()
    some = np.arange(1, len(x), 12)
    sims = x[some] @ x.T
    sims[np.arange(len(some)), some] = -2
    true = np.argsort(-sims, axis=1)[:, :5]
    assert np.mean([len(set(v[q == i]) & set(t)) for i, t in zip(some, true)]) >= 4.9


def test_a_small_sample_of_a_dense_collection_sends_vectors_to_few_cells(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = np.repeat(rng.normal(size=(60, 16))[rng.integers(60, size=600)] + 0.3 * rng.normal(size=(600, 16)), 20, axis=0)
    x = base + 0.01 * rng.normal(size=base.shape)  # twenty close ones each, of which the sample holds about one
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<float>")
    df = df.unionByName(df.where("id % 7 = 0").withColumn("id", F.col("id") + 100_000))  # and copies
    seen = []
    cells = neighbours._cells
    monkeypatch.setattr(neighbours, "SEEN", 1)
    monkeypatch.setattr(neighbours, "_cells", lambda held, most, rows: seen.append(cells(held, most, rows)) or seen[-1])
    trees = spark.sparkContext.broadcast
    kept = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: kept.append(value) or trees(value))
    got: dict = {}
    for r in neighbours.nearest(df, "id", "vec", 16, sample=600, block=128, leaf_rows=64).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    routed = neighbours._routed(pa.array(range(len(x))), unit, [v for v in kept if isinstance(v, neighbours.Leaves)][-1], seen[-1])
    assert seen[-1].max() >= 20 and routed.num_rows < 1.3 * len(x)
    sims = unit[1:12_000:50] @ unit.T
    sims[np.arange(len(sims)), np.arange(1, 12_000, 50)] = -2
    some = [(i, set(np.argsort(-s)[:5].tolist())) for i, s in zip(range(1, 12_000, 50), sims) if i % 7]
    assert np.mean([len({n % 100_000 for n in got[i]} & t) > 0 for i, t in some]) >= 0.99
