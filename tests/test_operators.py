"""Packing, windows, fusion, gate, pipelines, sources and streams against hand-computed or brute-force results."""

import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from yarrow import queries
from yarrow.common import bit_field, running_before
from yarrow.operators import answers, chunking, evidence, retrieval, structure
from yarrow.plans import pipelines
from yarrow.sources import files, ingest as sources_ingest
from yarrow.streaming import ingest


def _pack(parts, size, overlap):
    out, now = [], []
    for p in parts:
        if now and sum(now) + p > size:
            out.append(now)
            kept = []
            for x in reversed(now):
                if sum(kept) + x > overlap:
                    break
                kept.insert(0, x)
            now = kept
        now = [*now, p]
    return [*out, now] if now else out


def test_packing(spark):
    rnd = random.Random(4)
    cases = [([3, 4, 5, 2, 9, 1], 9, 0)] + [([rnd.randrange(1, 12) for _ in range(rnd.randrange(0, 15))], 12, rnd.choice([0, 3, 6])) for _ in range(15)]
    for parts, size, overlap in cases:
        df = spark.createDataFrame([([(str(p), p) for p in parts],)], "parts array<struct<t:string,n:int>>")
        got = df.select(chunking.packed("parts", size, overlap).alias("g")).first().g
        assert [[x.n for x in g] for g in got] == _pack(parts, size, overlap)


def test_merged_windows(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (1, 6), (2, 3)], "q int, i int")
    assert sorted((r.q, r.lo, r.hi) for r in evidence.merged_windows(df, ["q"], "i", 1).collect()) == [(1, 0, 4), (1, 5, 8), (2, 2, 5)]


def test_rrf(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "query_id int, rank int, k string")
    b = spark.createDataFrame([(1, 0, "x")], "query_id int, rank int, k string")
    got = {r.k: r.fused_score for r in retrieval.rrf({"bm25": a, "vector": b}, "k").collect()}
    assert got == {"x": 0.032787, "y": 0.016129}


def test_gate(spark):
    rows = [(1, 0, "c1", "p1", "s1", 0.03, "t"), (1, 1, "c2", "p1", "s1", 0.029, "t"), (2, 0, "c1", "p1", "s1", 0.03, "t"), (3, 0, "c1", "p1", "s1", 0.03, "khỏi hẳn"), (3, 1, "c2", "p2", "s2", 0.03, "có thể gặp ho")]
    r = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, parent_id string, source_id string, score double, text string")
    q = spark.createDataFrame([(1, "công dụng"), (2, "công dụng"), (3, "có khỏi hẳn không"), (4, "")], "query_id int, query string")
    got = {x.query_id: (x.passes, x.reason) for x in evidence.gate(r, q).collect()}
    assert got == {1: (True, "pass"), 2: (False, "too little evidence"), 3: (False, "claim not supported"), 4: (False, "no results")}


def test_citations(spark):
    got = spark.range(1).select(answers.enforce_citations(F.lit("One. Two [E2]. Three"), F.array(F.lit("E1"))).alias("a")).first().a
    assert got == "One [E1]. Two [E2]. Three [E1]"


def test_failing_embedder_goes_to_the_dead_letters(spark):
    def broken(texts):
        raise RuntimeError("down")

    df = answers.embedded(spark.createDataFrame([(1, "a")], "ord int, text string"), ["ord"], "text", broken)
    good, bad = files.dead_letters(df, F.col("error").isNotNull())
    assert good.count() == 0 and bad.first().attempts == 3


def test_pipelines_on_empty_and_odd_input(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Một đoạn văn đủ dài để thành mẩu.\n\nĐoạn hai cũng vậy thôi.", "x")], "doc_id bigint, text string, source_id string")
    chunks = pipelines.build(docs)
    assert chunks.count() == 1
    q = spark.createDataFrame([(1, "đoạn văn"), (2, "zzz")], "query_id bigint, query string")
    assert {r.query_id: r.reason for r in pipelines.ask(q, chunks).collect()}[2] == "no results"
    assert pipelines.ask(q, chunks.limit(0)).count() == 2


def test_sources(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"question": "q1", "expected_chunk_id": "c1"}\n\nnot json\n{"question": "", "expected_chunk_id": "c2"}\n', encoding="utf-8")
    assert files.read_jsonl(spark, str(p), files.QUESTIONS).count() == 2
    assert files.read_jsonl(spark, str(p), files.QUESTIONS, bad_records=True).count() == 1
    assert files.read_jsonl(spark, str(tmp_path / "none"), files.QUESTIONS).count() == 0
    chunks = spark.createDataFrame([("c1", "p1", "s1")], "chunk_id string, parent_id string, source_id string")
    row = files.read_questions(spark, str(p), chunks).first()
    assert (row.expected_parent_id, row.known) == ("p1", True)
    folder = tmp_path / "raw"
    (folder / "outputs").mkdir(parents=True)
    (folder / "a b.txt").write_bytes("caf\xe9".encode("cp1252"))
    (folder / "c.csv").write_text("x,y\n1,2\n")
    (folder / "d.pdf").write_bytes(b"%PDF")
    (folder / "outputs" / "e.txt").write_text("no")
    got = {r.path.rsplit("/", 1)[-1].replace("%20", " "): (r.text, r.error is None) for r in files.read_documents(spark, str(folder)).collect()}
    assert got["c.csv"] == ("x\ty\n1\t2", True) and got["d.pdf"] == (None, False) and got["a b.txt"][0] == "café"
    assert sorted(r.doc_type for r in files.scan_folder(spark, str(folder)).collect()) == ["pdf", "txt"]
    files.write_jsonl(chunks, str(tmp_path / "out"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "out").glob("*.json")))["chunk_id"] == "c1"
    assert "c1" in files.latex_table(chunks)


def test_stream_upserts(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    for n, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(1, "A", 2)]]):
        spark.createDataFrame(rows, "id int, text string, ver int").coalesce(1).write.mode("append").parquet(str(src))
        q = ingest.cleaned(ingest.read_stream(spark, str(src), "id int, text string, ver int")).writeStream.foreachBatch(ingest.upsert(str(out), "id", "ver")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    last = sorted(out.glob("v=*"), key=lambda p: int(p.name[2:]))[-1]
    assert sorted((r.id, r.text) for r in spark.read.parquet(str(last)).collect()) == [(1, "A"), (2, "b")]


@pytest.mark.parametrize("name", ["e1_by_type", "e5_distinct", "j7_rrf", "l1_gate", "e15_hits", "f5_windows", "m3_parents", "k7_scores", "i8_pdf_pages", "o13_hits_by", "c16_quality_gate", "j3_bm25_topk", "e14_gate_features", "h2_longest_wins", "r10_sessions", "r14_asof", "a15_paragraphs"])
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in "raw_passages chunks points sources test_questions retrieval_results documents embeddings events orders h1_vector_quality_report_0".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    r = con.execute(queries.SQL[name])
    columns = [c[0] for c in r.description]
    flat = lambda v: round(v, 5) if isinstance(v, float) else v
    want = sorted((tuple(flat(v) for v in row) for row in r.fetchall()), key=repr)
    got = sorted((tuple(flat(v) for v in row) for row in queries.QUERIES[name](spark, small).select(*columns).collect()), key=repr)
    assert got == want


def test_running_before_is_a_prefix_sum(spark):
    rnd = random.Random(1)
    rows = [(("hot" if rnd.random() < 0.6 else rnd.choice("ab")), i, rnd.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, w int")
    got = {(r.k, r.o): r.before for r in running_before(df, ["k"], [F.col("o")], F.col("w")).collect()}
    sums: dict = {}
    for k, o, w in sorted(rows, key=lambda r: (r[0], r[1])):
        assert got[(k, o)] == sums.get(k, 0)
        sums[k] = sums.get(k, 0) + w


PASSAGE = "source_id string, doc_type string, ord bigint, text string, page int, para_idx int, element_idx int, locator string, heading_path string, section_heading string"


def _tokens(t):
    import regex

    return len(regex.findall(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]", t))


def test_heading_blocks_pack_rows_and_children(spark):
    rnd = random.Random(8)
    texts = [" ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.randrange(31, 60))) for _ in range(25)]
    rows = [("s", "docx", i, t, None, i, i, None, "A" if i < 20 else "B", None) for i, t in enumerate(texts)] + [("s", "docx", 99, "ngắn", None, 99, 99, None, "A", None), ("s", "docx", 98, None, None, 98, 98, None, "A", None)]
    df = spark.createDataFrame(rows, PASSAGE)
    got = {}
    for r in structure.heading_blocks(structure._rows(df), 200, 80, 40).collect():
        got.setdefault(r.parent_id, {})[r.child_index] = (r.text, r.para_min, r.para_max)
    want = []
    for lo, hi in ((0, 20), (20, 25)):
        at = lo
        for block in _pack([_tokens(t) for t in texts[lo:hi]], 200, 0):
            part = texts[at : at + len(block)]
            want.append((at, at + len(block) - 1, _pack([_tokens(t) for t in part], 80, 40)))
            at += len(block)
    assert sorted((k[0][1], k[0][2], len(k)) for k in got.values()) == sorted((a, b, len(kids)) for a, b, kids in want)
    assert len([p for p in got if ":b" in p]) == len(want) - (1 if len(_pack([_tokens(t) for t in texts[20:]], 200, 0)) == 1 else 0)
    assert structure.heading_blocks(structure._rows(df.limit(0))).count() == 0


def test_entries_know_their_pages(spark):
    pages = ["Lời mở đầu của cuốn sách cũ này rất dài.\n1. Mục một nói về quế chi và gừng tươi.", "Vẫn còn là mục một, ở sang trang thứ hai.", "17\n2. Mục hai nói về nghệ vàng và mật ong.\n3. Mục ba nói về tía tô, kinh giới."]
    df = spark.createDataFrame([("s", "pdf", i, t, i + 5, None, i, None, None, None) for i, t in enumerate(pages)], PASSAGE)
    rows = structure._rows(df)
    assert [r.source_id for r in structure.entry_sources(rows).collect()] == ["s"]
    got = sorted((r.parent_id, r.page_min, r.page_max, r.text.split()[0]) for r in structure.pdf_entries(rows).collect())
    assert got == [("s:e:0", 5, 5, "Lời"), ("s:e:1", 5, 6, "1."), ("s:e:2", 7, 7, "2."), ("s:e:3", 7, 7, "3.")]
    assert sorted((r.page_min, r.page_max) for r in structure.pdf_pages(rows).collect()) == [(5, 6), (7, 7)]


def test_long_images_are_split_and_numbered(spark):
    df = spark.createDataFrame([("s", "image", 1, " ".join(["chữ"] * 90), 1, None, 0, "anh.png", None, None), ("s", "image", 2, "một ảnh ngắn", 1, None, 0, "b.png", None, None), ("s", "image", 3, "ab", 1, None, 0, "c.png", None, None)], PASSAGE)
    got = sorted((r.locator, r.child_index, r.n_tokens) for r in structure.images(structure._rows(df), 40).collect())
    assert got == [("anh.png#part1", 0, 40), ("anh.png#part2", 1, 40), ("anh.png#part3", 2, 10), ("b.png", 0, 3)]


def _docx(path, blocks):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:tbl>{"".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in b)}</w:tbl>' if isinstance(b, list) else f'<w:p><w:pPr><w:pStyle w:val="{b[0]}"/></w:pPr><w:r><w:t>{b[1]}</w:t></w:r></w:p>' for b in blocks)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>')


def test_word_processor_files(spark, tmp_path):
    long = "một đoạn văn đủ dài để được giữ lại"
    _docx(tmp_path / "a.docx", [("H1", "Phần một"), ("", long + " 1"), ("H2", "Mục a"), ("", long + " 2"), ("", "ngắn"), ("H1", "Phần hai"), ("", long + " 3"), [["vị thuốc quế chi", "liều dùng 5 g", "dùng buổi sáng"]]])
    (tmp_path / "b.docx").write_bytes(b"no zip")
    rows = {(r.path[-6:], r.element_idx): (r.text, r.heading_path, r.error) for r in sources_ingest.read_docx_passages(spark, str(tmp_path)).collect()}
    assert rows[("a.docx", 1)][1] == "Phần một" and rows[("a.docx", 3)][1] == "Phần một > Mục a" and rows[("a.docx", 6)][1] == "Phần hai" and "BadZipFile" in rows[("b.docx", 0)][2]
    assert rows[("a.docx", 7)][0].split("\t")[1] == "liều dùng 5 g" and len(rows) == 5
    (tmp_path / "c.txt").write_text(long + "\n\nngắn\n\n" + long)
    manifest = spark.createDataFrame([("s1", "a.docx", None, "A"), ("s2", "b.docx", "DOCX", "B"), ("s3", "c.txt", "", "C"), ("s4", "d.txt", None, "D")], "source_id string, file_path string, doc_type string, title string")
    passages, counts = sources_ingest.ingest(spark, manifest, str(tmp_path))
    assert [(r.para_idx, r.doc_type) for r in passages.where("source_id = 's3'").collect()] == [(1, "txt"), (2, "txt")]
    got = {r.source_id: (r.doc_type, r.passages, r.error) for r in counts.collect()}
    assert got["s3"] == ("txt", 2, None) and got["s4"][2] == "missing file" and got["s2"][0] == "docx" and "BadZipFile" in got["s2"][2] and got["s1"][1] == 1
    sources_ingest.write_manifest(manifest, str(tmp_path / "m"))
    assert '- source_id: "s1"\n  file_path: "a.docx"\n  doc_type: null' in "\n".join(p.read_text() for p in sorted((tmp_path / "m").glob("part*")))


def test_points_are_embedded_once_and_failures_set_aside(spark, tmp_path):
    long = "đoạn văn đủ dài để được nhúng vào"
    rows = [("c1", 1, long, False, "txt"), ("c1", 2, long + " hơn", False, "txt"), ("c2", 3, "ngắn", False, "txt"), ("c3", 4, long, True, "txt"), ("c4", 5, long + " lỗi", None, "pdf")]
    df = spark.createDataFrame(rows, "chunk_id string, ord bigint, text string, is_noise boolean, doc_type string")

    def embed(texts):
        return [None if t.endswith("lỗi") else [float(len(t))] for t in texts]

    assert sources_ingest.embed_points(df, str(tmp_path / "p"), embed) == {"asked": 2, "written": 1, "failed": 1}
    assert [r.ord for r in spark.read.parquet(str(tmp_path / "p/all")).where("vector IS NOT NULL").collect()] == [2]
    config = sources_ingest.RetrievalConfig.read("retrieval:\n  bm25_topk: 60  # more\n  other: 3\n")
    assert (config.bm25_topk, config.rrf_k) == (60, 60) and sources_ingest.RetrievalConfig.read('{"window": 2}').window == 2
    assert spark.range(1).select(sources_ingest.debug_name(F.lit("bm25"), F.lit("a")).alias("n")).first().n == "bm25_0cc175b9"


def test_stored_index_is_built_anew_only_for_other_documents(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c", "c"])], "ord bigint, tokens array<string>")
    q = spark.createDataFrame([(1, "c b"), (2, "a"), (3, "")], "query_id bigint, query string")
    want = sorted(map(tuple, retrieval.bm25_topk(q, docs, "ord").collect()))
    index = retrieval.stored_index(docs, "ord", str(tmp_path / "i"))
    assert sorted(map(tuple, retrieval.bm25_topk(q, docs, "ord", index=index).collect())) == want
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, retrieval.bm25_topk(q, docs, "ord").collect())) == want
    stamp = next((tmp_path / "i/terms").glob("part*")).stat().st_mtime_ns
    retrieval.stored_index(docs, "ord", str(tmp_path / "i"))
    assert next((tmp_path / "i/terms").glob("part*")).stat().st_mtime_ns == stamp
    more = docs.unionByName(spark.createDataFrame([(3, ["a"])], docs.schema))
    assert retrieval.stored_index(more, "ord", str(tmp_path / "i"))[0].count() == 5


def test_vector_search_against_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(60, 4)), 1)
    x[10] = x[11]
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(90, None), (91, [1.0])], "id bigint, v array<double>")
    queries = points.where("id < 20").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    sims = np.round(x @ x.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :] + 1e-12), 6)
    want = {(q, r): i for q in range(20) for r, i in enumerate(sorted((j for j in range(60) if j != q), key=lambda j: (-sims[q, j], j))[:5])}
    for values in (4_000_000, 20):
        monkeypatch.setattr(retrieval, "QUERY_VALUES", values)
        assert {(r.query_id, r.rank): r.id for r in retrieval.vector_topk(queries, points, "id", 5, exclude_self=True).collect()} == want
    assert retrieval.vector_topk(queries.limit(0), points, "id").count() == 0


def test_bit_fields(spark):
    rnd = random.Random(3)
    some = {rnd.randrange(1 << 17) for _ in range(500)} | {0, 32_767, 32_768, (1 << 17) - 1}
    field = bit_field(spark.createDataFrame([(x,) for x in [*some, *some]], "spot int"), "spot", 1 << 17)
    assert {x for x in range(1 << 17) if field[x >> 3] >> (x & 7) & 1} == some and not bit_field(spark.createDataFrame([], "spot int"), "spot", 64).any()


def test_bm25_sends_k_rows_a_query_and_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["a", "b"] if i % 4 else ["a", "c", f"t{i}"]) for i in range(1200)], "ord bigint, tokens array<string>")
    q = spark.createDataFrame([(i, f"b t{4 * i} c") for i in range(40)], "query_id int, query string")
    want = sorted(map(tuple, retrieval.bm25_topk(q, docs, "ord", 5).collect()))
    assert len(want) == 200 and all(want[5 * i][2] == 4 * i for i in range(40))  # the document of its own term is first, the rest by key
    packed = retrieval._listed(docs, "ord", "tokens")[3]
    weighted = spark.createDataFrame([(i, "b", 1.0, 2.25) for i in range(40)], "query_id int, term string, w double, avgdl double")
    sent = retrieval._scored(packed, "ord", weighted, ("int", "bigint"), 5, 1.5, 0.75).cache()  # 900 documents of equal score
    assert sent.count() <= 40 * 5 * spark.sparkContext.defaultParallelism and {r.ord for r in sent.collect()} >= {1, 2, 3, 5, 6}
    for name, value in (("BROADCAST_TERMS", 0), ("BLOCK_TERMS", 20), ("SCORES", 1), ("DENSE", 0)):
        monkeypatch.setattr(retrieval, name, value, raising=False)
    assert sorted(map(tuple, retrieval.bm25_topk(q, docs, "ord", 5).collect())) == want
    frames = [q.where("query_id < 0"), q.where("query_id = 0").withColumn("query", F.lit("zz"))]
    assert [retrieval.bm25_topk(f, docs, "ord", 5).count() for f in frames] == [0, 0] and retrieval.bm25_topk(q, docs.limit(0), "ord").count() == 0


def test_texts_move_once_or_not_at_all(spark, capsys):
    def moved(df):  # exchanges whose rows hold texts
        df.explain("formatted")
        return sum("text#" in row for row in re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", capsys.readouterr().out))

    rows = [(1, 0, "c1", "p1", "s1", 0, 0.03, "t"), (1, 1, "c2", "p1", "s1", 1, 0.029, "chắc chắn khỏi hẳn"), (2, 0, "c1", "p1", "s1", 0, 0.03, "có thể gặp ho")]
    r = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, parent_id string, source_id string, child_index int, score double, text string")
    q = spark.createDataFrame([(1, "có khỏi hẳn không"), (2, "công dụng")], "query_id int, query string")
    gate = evidence.gate(r, q)
    assert moved(gate) == 0
    assert sorted(gate.collect()) == sorted(evidence.gate(evidence.said(r), q).collect()) and gate.where("query_id = 1").first().reason == "pass"
    kids = spark.createDataFrame([("p1", 0, 1, "một"), ("p1", 1, 2, "hai"), ("p1", 2, 3, "một")], "parent_id string, child_index int, ord int, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        context = evidence.context(r, kids)
        assert moved(context) == 2  # to the places, and to the queries
        assert {(x.query_id, x.context) for x in context.collect()} == {(1, "một\n\n---\n\nhai"), (2, "một\n\n---\n\nhai")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
