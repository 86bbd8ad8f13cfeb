"""Text functions: vectors of the post-chunk normaliser, hashes, folding, ids, lists."""

import unicodedata
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from yarrow.functions import text as T

CASES = [
    ("pdf", "Tên khoa học: Eup horbia hirta L.", "Euphorbia"), ("pdf", "Portulaca olera\ncea L.", "oleracea"), ("pdf", "Ganoderma luci\ndum", "lucidum"), ("pdf", "Averrhoa caram\nbola", "carambola"),
    ("pdf", "Azadirac\nhta indica A. Juss.", "Azadirachta"), ("image", "Published in Oc tober 2023", "October"), ("pdf", "Cap sicum annuum", "Capsicum"), ("pdf", "cardiomy-\nopathy is common", "cardiomyopathy"),
    ("docx", "Cây thuốc chữa bệnh thường dùng", "Cây thuốc chữa bệnh thường dùng"), ("pdf", "Tên khoa học: Euphorbia hirta L. - Họ Thầu dầu", "Euphorbia hirta"), ("pdf", "THUỐ#C NAM", "THUỐC NAM"), ("pdf", "Tên khoa học: Portulaca olera cea", "oleracea"),
]


@pytest.mark.parametrize("kind,text,want", CASES)
def test_clean_chunk(spark, kind, text, want):
    row = spark.createDataFrame([(kind, text)], "k string, t string").select(T.clean_chunk(F.col("t"), F.col("k")).alias("c")).first()
    assert want in row.c


def test_noise(spark):
    rows = spark.createDataFrame([(x,) for x in ["ab", "x", "", "—o0o-—", "---", "___", ".,;:", "!!!", "Cây thuốc", "Euphorbia hirta"]], "t string").select(T.is_noise(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [True] * 8 + [False] * 2


def test_ids(spark):
    assert spark.range(1).select(T.point_id(F.lit("src_30f8061f40c5:9e7795581fbf")).alias("p")).first().p == Decimal(4357090760917511907)


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs"], max_codepoint=0x2FFF), max_size=40))
def test_folding_like_decomposition(spark, text):
    want = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").replace("đ", "d").replace("Đ", "D")
    got = spark.createDataFrame([(text,)], "t string").select(T.fold_accents(F.col("t")).alias("f")).first().f
    assert unicodedata.normalize("NFD", got) == want or unicodedata.normalize("NFC", got) == unicodedata.normalize("NFC", want)


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    t = F.col("t")
    row = df.select(T.nfc(t), T.fold_accents(t), T.normalise_query(t), T.tokens(t), T.snippet(t), T.clean_passage(t), T.id_list(t), T.clean_chunk(t, F.lit("pdf"))).first()
    assert all(x is None for x in row)


def test_lists(spark):
    row = spark.range(1).select(T.id_list(F.lit("a|b| a ||c")).alias("a"), T.citations(F.lit("x [E2] y [E1] [E2]")).alias("b"), T.with_phrases(F.array(*map(F.lit, ["cam", "thao", "cam", "thao"])), ["cam thao"]).alias("c"), T.json_object(F.lit('so: {"a": 1} end')).isNotNull().alias("d")).first()
    assert row.a == ["a", "b", "c"] and row.b == ["E2", "E1"] and row.c[4:] == ["cam_thao", "cam_thao"] and row.d


def test_glued_words_are_parted_in_order(spark):
    cases = {"rễĐem": "rễ Đem", "xong.Đem": "xong. Đem", "rễđem": "rễ đem", "phủtheo": "phủ theo", "rửasạch": "rửa sạch", "hoặcsao": "hoặc sao", "đắplên": "đắp lên", "sựẩn": "sự ẩn", "đồăn": "đồ ăn", "hương": "hương", "xuân": "xuân", "hoặc": "hoặc"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [(r.c, r.want) for r in df.select(T.clean_passage(F.col("t")).alias("c"), "want").collect() if r.c != r.want] == []
    rows = spark.createDataFrame([("a  b", 0.5), ("ab", None), (None, 0.9)], "t string, c double")
    assert [tuple(r) for r in rows.select(*T.cleaned_record(F.col("t"), F.col("c"))).collect()] == [("a b", True, True), ("ab", False, False), (None, False, False)]
