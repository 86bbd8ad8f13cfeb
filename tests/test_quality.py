"""Headings as a fold in plain Python, phrases, fragments."""

from pyspark.sql import functions as F

from yarrow.operators import preparation, quality


def test_heading_paths(spark):
    rows = [("s", 1, 1, "A"), ("s", 2, None, "t"), ("s", 3, 2, "B"), ("s", 4, 3, "C"), ("s", 5, 2, "D"), ("s", 6, None, None), ("s", 7, 1, "E"), ("s", 8, None, "t"), ("r", 1, None, "t")]
    got = {(r.source, r.o): r.heading_path for r in quality.heading_paths(spark.createDataFrame(rows, "source string, o int, level int, text string"), "source", "o", 3).collect()}
    stack, want = {}, {}
    for s, o, level, text in rows:
        if s == "r":
            stack = {}
        if level:
            stack = {k: v for k, v in stack.items() if k < level} | {level: text}
        want[(s, o)] = " > ".join(stack[k] for k in sorted(stack))
    assert got == want


def test_levels_and_phrases(spark):
    df = spark.createDataFrame([("Heading 2", None), ("Normal", None), ("Heading 3", 0), (None, 4)], "style string, given int")
    assert [r.l for r in df.select(quality.heading_level(F.col("style"), F.col("given")).alias("l")).collect()] == [2, 1, 1, 4]
    q = spark.createDataFrame([("tac dung cua hoang ky va bac ha",), ("Bạc hà",), (None,), ("",)], "q string")
    got = [r.r for r in q.select(preparation.phrases_restored(F.col("q"), {"hoang ky": "hoàng kỳ", "bac ha": "bạc hà", "ha": "hạ"})["text"].alias("r")).collect()]
    assert got == ["tac dung cua hoàng kỳ va bạc hà", "bạc hà", None, ""]


def test_fragments(spark):
    q = spark.createDataFrame([("Portulaca olera\ncea L.",), (None,)], "q string")
    assert [r.r for r in q.select(quality.rejoin_latin(F.col("q")).alias("r")).collect()] == ["Portulaca oleracea L.", None]


def test_preparation(spark):
    lexicon = spark.createDataFrame([("thuoc", 5, "thuốc"), ("nay", 5, "này"), ("uong", 5, "uống")], "folded string, n bigint, word string")
    q = spark.createDataFrame([(1, "Bai thuoc QUE CHI"), (2, "uống thuoc nay"), (3, None), (4, ""), (5, "thuoc nay uong ra sao vay the"), (6, "how much is it")], "query_id bigint, query string")
    got = {r.query_id: r for r in preparation.prepared(q, {"que chi": "quế chi", "bai thuoc": "bài thuốc"}, lexicon).collect()}
    assert got[1].final == "bài thuốc quế chi" and got[1].bm25_query == "bai thuoc que chi" and got[1].vector_variants == ["bài thuốc quế chi", "bai thuoc que chi"] and got[1].phrase_confidence == 0.7
    assert got[2].final == "uống thuoc nay" and got[3].vector_variants == [] and got[4].vector_variants == [] and got[6].final == "how much is it"
    assert got[5].general_band == "medium" and got[5].vector_variants == ["thuoc nay uong ra sao vay the", "thuốc này uống ra sao vay the"]
    assert preparation.prepared(q.limit(0), {}).count() == 0
