"""Encoding repair, look-alikes, scans, token ids, leaks, sentences: edge cases, round trips, brute force."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from yarrow.llm import alikes, encoding, leaks, mojibake, scans, sentences

VI = [f"Người bệnh dùng {n} g quế chi mỗi ngày thì đỡ ho khan về đêm và ăn ngon hơn trước." for n in range(2, 40)] + [f"Bài thuốc gồm hòe hoa {n} g, rễ tía tô và mật ong, sắc uống buổi sáng sớm." for n in range(2, 40)]
FR = [f"On prépare la réglisse douce avec le thé d’été, puis on laisse reposer {n} heures à l’ombre." for n in range(2, 40)]


@pytest.fixture(scope="module")
def length():
    return mojibake.Lengths({"vi": "\n".join(VI).encode(), "fr": "\n".join(FR).encode(), "zh": "旧抄本载，姜黄须熬成稠膏，方可止咳。久服五十日以上者，偶见口苦咽干。".encode()})


def _shown(text, written, shown):
    known = {b[0]: chr(c) for c, b in mojibake._bytes_of(shown).items()}
    return "".join(known[b] for b in text.encode(written))


@pytest.mark.parametrize("shown", ["cp1252", "cp1251", "mac_roman", "cp437"])
def test_utf8_read_as_single_bytes_round_trips(length, shown):
    for text in (VI[3], FR[3]):
        assert mojibake.restore(_shown(text, "utf-8", shown), length)[0] == text


def test_double_and_partial_reading(length):
    twice = _shown(_shown(VI[5], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert mojibake.restore(twice, length)[0] == VI[5]
    part = VI[5] + " " + _shown(VI[6], "utf-8", "cp1252")
    assert mojibake.restore(part, length)[0] == VI[5] + " " + VI[6]


def test_legacy_fonts_round_trip(length):
    back = {v: k for k, v in mojibake.TCVN3.items()}
    assert mojibake.restore("".join(back.get(c, c) for c in VI[7]), length)[0] == VI[7]
    pairs = {v: k for k, v in mojibake._vni()[1].items()}
    assert mojibake.restore("".join(pairs.get(c, c) for c in VI[8]), length)[0] == VI[8]
    assert mojibake.restore("¾É³­±¾ÔØ£¬½ª»ÆÐë°¾³É³í¸à£¬·½¿ÉÖ¹¿È¡£", length)[0].startswith("旧抄本载，姜黄")


def test_right_text_stays(length):
    for t in [*VI[:5], *FR[:5], "Vị Quê® đạt 9 °C ± 2, § 4 © 1953", "naïve café jalapeño São", "женьшень γλυκόριζα", "旧抄本载……方可止咳。", "", "plain"]:
        assert mojibake.restore(t, length) == (t, [])


def test_restored_frame(spark):
    rows = [(1, None), (2, ""), (3, VI[0]), (3, VI[0]), (4, _shown(VI[1], "utf-8", "cp1252")), (5, "m�t chữ")] + [(10 + i, t) for i, t in enumerate(VI)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "ord bigint, text string, restored string")
    got = {}
    for r in mojibake.restored(df, "ord", "text").collect():
        got.setdefault(r.ord, []).append((r.restored, bool(r.chains), r.lost))
    assert got[1] == [(None, False, False)] and got[2] == [("", False, False)] and len(got[3]) == 2 and got[4] == [(VI[1], True, False)] and got[5][0][2]
    assert mojibake.restored(df.limit(0), "ord", "text").count() == 0


def test_alikes():
    r = alikes.repaired
    for form in (unicodedata.normalize("NFD", VI[0]), VI[0].replace(" ", " "), VI[0].replace("o", "о"), VI[0].replace("h", "һ"), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in VI[0]), "​".join(VI[0])):
        assert r(form) == VI[0]
    for same in ["женьшень", "ЖЕНЬШЕНЬ", "γλυκόριζα", "α-Calantha và β-Ramethra", "当归、甘草，白芍（酒炒）。", "“½ thìa” – cm²… 42 ℃", "👩🏽‍🌾 vườn", "", "a\tb\nc"]:
        assert r(same) == same
    assert r("ᎪrՏenic") == "ArSenic" and r("a\u180eb\u2063c\u115fd") == "abcd" and r("𝐍gười ﬃ ｽ № ℃ ①") == "Người ffi ｽ № ℃ ①"
    assert r("siﬂora Ɖào") == "siflora Đào" and alikes.comparable(r("Ｔhuốc  ½")) == alikes.comparable(r("thuốc ½"))


def test_alikes_frame(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "tһuốc", "x"), (3, "tһuốc", "x")], "id bigint, t string, changed string")
    got = sorted((r.id, r.repaired or "", r.changed) for r in alikes.normalised(df, ["id"], "t").collect())
    assert got == [(1, "", False), (2, "", False), (3, "thuốc", True), (3, "thuốc", True)]


def test_tokens_match_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(encoding.tokenizer_path())
    library.encode_special_tokens = True
    machine = encoding.automaton(encoding.vocabulary())
    rnd = random.Random(7)
    texts = [*VI[:3], *FR[:3], "<|endoftext|> it's   we'll\n\n x", "a" * 3000, " " * 50, "日本の中ー" * 40, "👩🏽‍🌾🌿", ""]
    texts += ["".join(rnd.choice(rnd.choice(["aab ", "etaoin", "ạảấ đ", "中の", "\n\t ", "!?.…", "กขค", "0129"])) for _ in range(rnd.randrange(60))) for _ in range(500)]
    for t in texts:
        ids = memoryview(machine.encode(t)).cast("i").tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids and machine.decode(ids).decode() == t


def _merged(word, merges):
    parts = list(word)
    for a, b in merges:
        out = []
        while parts:
            x = parts.pop(0)
            out.append(x + parts.pop(0) if x == a and parts and parts[0] == b else x)
        parts = out
    return parts


def test_the_automaton_accepts_just_what_merging_in_order_gives():
    import json

    rnd = random.Random(11)
    for _ in range(60):
        labels, merges = ["a", "b", "c"], []
        while len(merges) < 7:
            a, b = rnd.choice(labels), rnd.choice(labels)
            if a + b not in labels:
                merges.append((a, b))
                labels.append(a + b)
        machine = encoding.Automaton(json.dumps({"model": {"vocab": {x: i for i, x in enumerate(labels)}, "merges": [f"{a} {b}" for a, b in merges]}}).encode())
        for _ in range(60):
            word = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9)))
            assert [machine.labels[i].decode() for i in machine.run(word)] == _merged(word, merges)


def test_tokens_frame(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "hi there", 1), (3, "hi there", 1), (4, "x" * 50_000, 1)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, len(r.ids)) for r in encoding.encoded(df, "doc_id", "text").collect())
    assert [g[:2] for g in got[:4]] == [(1, 0), (2, 0), (3, 2), (3, 2)] and got[4][1] > 1000
    assert encoding.encoded(df.limit(0), "doc_id", "text").count() == 0


ITEM = "Người bệnh từng ngã ở bến Nứa năm 1953, sau đó thi thoảng ho khan về đêm kèm lưỡi tím sẫm. Thăm khám thấy mạch sáp, lưỡi nhạt ướt, bụng mềm, da ấm, không thấy khàn tiếng chút nào. Qua 9 thang thì mệt mỏi lui hẳn, riêng ù tai còn âm ỉ mỗi khi trở trời."


LEAKS = ("exact", "changed")


def test_leaks(spark):
    rnd = random.Random(2)
    words = ITEM.split()
    noisy = " ".join(rnd.choice(["khá", w + " rất", ""]) if rnd.random() < 0.08 else w for w in words)
    other = ITEM.replace("1953", "2001").replace("bến Nứa", "hang Gió").replace("sáp", "huyền tế").replace("ho khan về đêm", "tiểu buốt").replace("khàn tiếng", "viêm lợi").replace("9 thang", "4 gói thuốc").replace("mệt mỏi", "da xanh").replace("ù tai", "đau lưng").replace("tím sẫm", "đỏ au").replace("nhạt ướt", "khô nứt")
    docs = [(1, "Mở đầu. " + ITEM), (2, ITEM.upper().replace(",", "")), (3, noisy), (4, "không"), (5, None), (6, ""), (7, other), (8, "x " * 200 + " ".join(words[: len(words) * 2 // 3]) + " y" * 200), (9, " ".join(words[:9])), (1, "Mở đầu. " + ITEM), (10, "从前 " * 30_000 + ITEM)]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id bigint, text string, covered string")
    items = spark.createDataFrame([(7, ITEM, "vi"), (8, "ngắn quá", "vi"), (9, None, "vi"), (10, "若腰膝酸软兼见鼻塞流涕，可加钩藤八克，减麦冬三克。", "zh")], "item_id bigint, text string, lang string")
    for most in (20_000, 0):  # broadcast, and joined by hash
        rows = leaks.leaks(df, "doc_id", "text", items, "item_id", "text", most_items=most).collect()
        assert sorted((r.doc_id, r.item_id) for r in rows if r.kind in LEAKS) == [(1, 7), (1, 7), (2, 7), (3, 7), (8, 7), (10, 7)]
    assert leaks.leaks(df, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_leaks_of_half_an_item(spark):
    words = ITEM.split()
    n = len(words)
    half, start = -(-n // 2), n // 4
    run = words[start : start + half]
    changed = [w if k not in (9, 20) else "khá" for k, w in enumerate(run)]
    pieces = words[: n // 4 + 1] + "rồi bà lang kể sang chuyện khác hẳn".split() + words[-(n // 4 + 1) :]
    short = words[start : start + n // 3]
    exchanged = ITEM.replace("1953", "2001").replace("9 thang", "4 thang").replace("bến Nứa", "hang Gió").replace("ho khan", "tiểu buốt").replace("tím sẫm", "đỏ au").replace("sáp", "huyền tế").replace("khàn tiếng", "viêm lợi").replace("mệt mỏi", "da xanh").replace("ù tai", "đau lưng")
    docs = [(1, " ".join(run)), (2, " ".join(words[:half])), (3, " ".join(words[-half:])), (4, " ".join(changed)), (5, " ".join(pieces)), (6, " ".join(short)), (7, exchanged)]
    df = spark.createDataFrame([(k, "Mở đầu sách. " + t + " Hết chương này.") for k, t in docs], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")
    assert sorted(r.doc_id for r in leaks.leaks(df, "doc_id", "text", items, "item_id", "text").collect() if r.kind in LEAKS) == [1, 2, 3, 4, 5]


QUESTION = "Một người bán 12 kg gừng ở chợ Bến với giá 45 nghìn một cân, rồi mua 7 kg nghệ của ông Lâm ở chợ Bến và trả 30 nghìn một cân. Hỏi sau khi bán 12 kg gừng thì người ấy còn lại bao nhiêu tiền?"


def test_slots_tell_a_renamed_item_from_a_copy(spark, monkeypatch):
    renamed = QUESTION.replace("12", "19").replace("45", "52").replace("7 kg", "8 kg").replace("30", "28").replace("Lâm", "Tùng").replace("chợ Bến", "chợ Đồn")
    random_ = renamed.replace("19", "14", 1).replace("chợ Đồn", "chợ Mai", 1)
    changed = QUESTION.replace("45", "46").replace("người ấy", "họ")
    docs = {1: QUESTION, 2: renamed, 3: random_, 4: changed, 5: "Xem bài sau. " + QUESTION.lower() + " Hết."}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, QUESTION), (2, "Ông Tùng và bà Mai ra chợ Đồn mua gừng về sắc uống.")], "item_id bigint, text string")
    for most in (20_000, 0):
        got = {r.doc_id: r.kind for r in leaks.leaks(df, "doc_id", "text", items, "item_id", "text", most_items=most).collect() if r.item_id == 1}
        assert got == {1: "exact", 2: "renamed", 3: "pattern", 4: "changed", 5: "exact"}
    monkeypatch.setattr(leaks.Items, "canonical", lambda self, words, number: words)  # without templates nothing is seen to be renamed
    plain = leaks.Items([(1, QUESTION)], leaks.names_of([QUESTION]))
    assert {d for d, *_ in leaks._scanned(list(docs.values()), plain, leaks.SHARE)} == {0, 3, 4}


def test_repeated_words_make_no_pair_of_each_with_each():
    numbers = [(k, " ".join(str(k * 1000 + n) for n in range(200))) for k in range(200)]
    items = leaks.Items(numbers, leaks.names_of([]))
    words, _, number = leaks.words_of(leaks._codes(" ".join(map(str, range(50_000, 52_000)))))
    assert len(items.hits(words, number)[0]) < 1000
    items = leaks.Items([(1, "từ xưa " * 60)], leaks.names_of([]))
    text = "từ xưa " * 20_000
    words, _, number = leaks.words_of(leaks._codes(text))
    assert len(items.hits(words, number)[0]) < 100_000 and [k for _, _, k, _ in leaks._scanned([text], items, leaks.SHARE)] == ["exact"]


def test_leaks_do_not_hang_on_what_is_met_together(spark):
    rnd = random.Random(5)
    line = lambda n: f"mỗi sáng uống {n} viên trước bữa ăn "
    drawn = rnd.sample(range(100, 1000), 420)
    dosage = "".join(line(n) for n in drawn[:12])
    table = "".join(line(n) for n in drawn[12:212]) + dosage + "".join(line(n) for n in drawn[212:])  # its template repeats, its words do not
    again = "từ xưa " * 3_000 + "đến nay người ta vẫn kể rằng gừng làm ấm bụng"
    tail = "từ xưa " * 8 + "đến nay người ta vẫn kể rằng gừng làm ấm bụng"
    big = 2**60 + 1
    docs = [(big, table), (None, "Trước. " + ITEM), (big + 2, again), (None, QUESTION), (4, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    many = df.unionByName(spark.createDataFrame([(k, f"chuyện {k} " * 3 + " ".join(rnd.choice("abcdefghij") * 3 for _ in range(2_000))) for k in range(10, 30)], df.schema)).coalesce(1)
    items = spark.createDataFrame([(1, dosage), (2, tail), (7, ITEM), (7, QUESTION), (None, QUESTION), (7, QUESTION), (big, "ngắn quá")], "item_id bigint, text string")
    want = [(-1, -1, "exact"), (-1, 7, "exact"), (-1, 7, "exact"), (-1, 7, "exact"), (big, 1, "exact"), (big + 2, 2, "exact")]
    for most in (20_000, 0):
        for some in (df, many):
            rows = leaks.leaks(some, "doc_id", "text", items, "item_id", "text", most_items=most).collect()
            assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.item_id is None else r.item_id, r.kind) for r in rows) == want, (most, some is df)


def test_leak_words_are_hashed_alike():
    a = leaks.words_of(leaks._codes("Quế CHI, 5 g"))[0]
    b = leaks.words_of(leaks._codes("quê chi 5 G"))[0]
    assert np.array_equal(a, b)


CASES = [
    ("Theo BS. Lụa, nên dùng 4.599 g. Uống lúc 5.30 ngày 6.3.1980 nhé! Xem tr. 5, mục 2.", ["Theo BS.", "Uống", "Xem"]),
    ('"Có còn ho không?" người nhà hỏi. Bà lang dặn: "uống đi." Sáng sau.', ['"Có', "Bà", "Sáng"]),
    ("Nhóm gồm sả, v.v. Vì sao? Thuốc đắng... nhưng uống. Hết… rồi lại đau.", ["Nhóm", "Vì", "Thuốc", "Hết"]),
    ("Tiêu đề\n\nMột câu bị\nngắt dòng. (Ghi chú.) 30 g là đủ.", ["Tiêu", "Một", "(Ghi", "30"]),
    ("Prof. D. G. Quenby met Dr. Senn at 8 a.m. The end, i.e. now.", ["Prof.", "The"]),
    ("« Avez-vous mal ? » demanda-t-elle. « le thé, jamais autrement. » Sur 8 cas.", ["« Avez", "« le", "Sur"]),
    ("「还有不安吗？」家人问道。老药工说：“一定要炒。”在47份中，有；味虽苦……但服。", ["「还", "老药", "在47"]),
    ("ตำราเก่า 5 กรัม บันทึกว่า\nต้องนำ ขิง", ["ตำรา", "บันทึก", "ขิง"]),
    ("   \n\n ", []), ("", []),
]


@pytest.mark.parametrize("text,starts", CASES)
def test_sentences(text, starts):
    got = sentences.unit_starts(text)
    assert len(got) == len(starts) and all(text.startswith(s, at) for at, s in zip(got, starts))


PARTS = [
    "12. ", "Xin chào. ", "abc def. ", "ngh ", "II. Mục ", "「你好。」", "他说。", "“a.” ", "... ", "\n\n", " \n \n", "BS. Lan ", "v.v. ", "ไทย ก ", "A. B. ", "e.g. ", "? ", "! » ", "(3. ", "x", "ế. ", "…và ", "。”", "L. Nó ", "dùng 12. Uống ", "." * 30 + " ", " " * 90,
]


def test_pieces_have_the_units_of_the_whole():
    rnd = random.Random(5)
    for _ in range(1000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(1, 20)))
        whole = sentences.unit_starts(text)
        for size in range(1, len(text)):
            (_, at), state, starts = sentences.pieces(text, size)[0], sentences.DUE, []
            for begin, end in ((0, at), (at, len(text))):
                lead = min(begin, sentences.LEAD)
                found, state = sentences.run(sentences.tape(text[begin - lead : end + 1], lead, lead + end - begin), state)
                starts += [s - lead + begin for s in found]
            assert starts == whole


def test_sentence_chunks_compose(spark):
    rnd = random.Random(6)
    texts = {1: "\n\n".join(t for t, _ in CASES if t.strip()) * 30, 4: "".join(rnd.choice(PARTS) for _ in range(2000)), 5: "." * 500, 6: "a " * 400 + "12. Next sentence. abcd. efgh"}
    texts[2] = texts[1]
    df = spark.createDataFrame([*((k, t, 0) for k, t in texts.items()), (2, texts[2], 0), (3, None, 0), (7, "", 0)], "doc_id bigint, text string, start_char int")
    got: dict = {}
    for r in sentences.sentence_units(df, "doc_id", "text", chunk=97).collect():
        got.setdefault(r.doc_id, []).append(r.start_char)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(sentences.unit_starts(t) * (2 if k == 2 else 1)) for k, t in texts.items()}


def test_scans(spark):
    clean = VI + [f"Cây này mọc nhiều ở bến sông vào đầu hạ, hái {n} lần mỗi mùa rồi phơi trong bóng râm." for n in range(60)]
    title = "Sổ tay cây thuốc bến sông 12"
    bad = {
        100: "Ngườibệnh dùng 5 g quếchi mỗi ngày thì đỡ ho.", 101: "Người bệ nh dùng 5 g quế chi mỗi ngày.", 102: "Người bệnh dùng 5 g quế c|hi mỗi ngày.", 103: "SỔ TAY CÂY THUỐC BẾN SÔNG 12\nNgười bệnh dùng 5 g quế chi.",
        104: "Người bệnh dùng 5 g quế\n- 17 -\nchi mỗi ngày.", 105: "Người bệnh dùng 5 g quế chi mỗi ng-\này thì đỡ.", 106: "Nguời bệrih dùng 5 g quế chi mỗi nqày thì đỡ.", 107: "Người b ệ n h dùng",
    }
    good = {200: "Người bệnh dùng 5 g\nquế chi mỗi ngày thì đỡ ho khan\nvề đêm.", 201: None, 202: "", 203: _shown(VI[1], "utf-8", "cp1252")}
    rows = [(i, t, title, "pdf", "c") for i, t in enumerate(clean)] + [(i, t, title, "image", "c") for i, t in {**bad, **good}.items()] + [(300, bad[102], title, "txt", "c")]
    df = spark.createDataFrame(rows, "ord bigint, text string, title string, doc_type string, damage string")
    got = {r.ord: (r.repaired, r.damage) for r in scans.repaired(df, "ord", "text", "title", "doc_type").collect()}
    assert {i for i, (_, d) in got.items() if d} == set(bad)
    assert got[105][0] == "Người bệnh dùng 5 g quế chi mỗi ngày thì đỡ." and got[200][0] == "Người bệnh dùng 5 g quế chi mỗi ngày thì đỡ ho khan về đêm."
    assert got[103][0] == "Người bệnh dùng 5 g quế chi." and got[201] == (None, []) and 300 not in got
    assert scans.repaired(df.where("ord < 0"), "ord", "text", "title", "doc_type").count() == 0


def test_scans_judge_alike_at_every_size():
    words, pairs = {"mỗi": 500, "ngày": 600, "nqày": 13, "thì": 400}, {("mỗi", "ngày"): 450, ("ngày", "thì"): 390, ("mỗi", "nqày"): 4, ("nqày", "thì"): 4}
    for size in (1, 10, 100):
        lexicon = scans.Lexicon({w: n * size for w, n in words.items()}, {p: n * size for p, n in pairs.items()}, {"ngáy": 200 * size, "n9ày": 6 * size})
        assert scans.repair("mỗi nqày thì", "", lexicon) == ("mỗi ngày thì", ["misread"])
        assert scans.repair("mỗi n9ày thì", "", lexicon) == ("mỗi ngày thì", ["misread"])
        assert scans.repair("mỗi ngáy thì", "", lexicon) == ("mỗi ngáy thì", [])


def test_scans_let_context_choose_among_all_candidates():
    forms = ["ma", "má", "mà", "mả", "mã", "mạ", "mâ", "mấ", "mầ", "mẩ"]
    lexicon = scans.Lexicon({"con": 400, "non": 400} | {w: 300 - k for k, w in enumerate(forms)}, {("con", "mẩ"): 50, ("mẩ", "non"): 50})
    assert scans.repair("con mẫ non", "", lexicon) == ("con mẩ non", ["misread"])


def test_scans_judge_the_words_beside_wrong_decoding(spark):
    torn = _shown(VI[1], "utf-8", "cp1252")
    bad = {100: f"Người bệnh dùng 5 g quế chi mỗi nqày thì đỡ ho khan về đêm. {torn}", 101: "Người bệnh dùng 5 g quế chi mỗi nqày thì đỡ ho khan về đ�m và ăn ngon."}
    good = {200: f"{VI[2]} {torn}", 201: "Người bệnh dùng 5 g quế chi mỗi ngày thì đỡ ho khan về đ�m và ăn ngon."}
    rows = [(i, t, "Sổ tay", "pdf") for i, t in [*enumerate(VI), *bad.items(), *good.items()]]
    df = spark.createDataFrame(rows, "ord bigint, text string, title string, doc_type string")
    got = {r.ord: (r.repaired, r.damage) for r in scans.repaired(df, "ord", "text", "title", "doc_type").collect()}
    assert {i for i, (_, d) in got.items() if d} == set(bad)
    assert got[100][0] == f"Người bệnh dùng 5 g quế chi mỗi ngày thì đỡ ho khan về đêm. {VI[1]}" and "�" in got[101][0]


def test_scans_spare_rare_words_and_words_of_roman_letters(spark):
    clean = [f"Bà lang lấy cái cân ra cân {n} g quế chi mỗi ngày." for n in range(60)]
    rows = [(i, t, "Sổ tay", "pdf") for i, t in enumerate(clean)] + [(100 + i, f"Thợ rèn sửa cái cán dao số {i}.", "Sổ tay", "txt") for i in range(3)]
    rows += [(200, "Ông lấy cái cán dao.", "Sổ tay", "image"), (201, "Droit\ncivil\nde la famille", "Sổ tay", "image"), (202, "Droit\nxiv\nde la famille", "Sổ tay", "image"), (203, None, "Sổ tay", None)]
    df = spark.createDataFrame(rows, "ord bigint, text string, title string, doc_type string")
    got = {r.ord: (r.repaired, r.damage) for r in scans.repaired(df, "ord", "text", "title", "doc_type").collect()}
    assert got[200] == ("Ông lấy cái cán dao.", []) and got[201] == ("Droit civil de la famille", []) and got[202] == ("Droit de la famille", ["page number"])


def test_the_delete_index_finds_what_a_full_comparison_finds():
    rnd = random.Random(9)
    words = {"".join(rnd.choice("aeiounrmcl") for _ in range(rnd.randrange(2, 9))): 50 for _ in range(400)} | {"a" * 12 + "rn" + "e" * 12: 9}
    lexicon = scans.Lexicon(words, {})
    for _ in range(150):
        w = list(rnd.choice(list(words)))
        w[rnd.randrange(len(w))] = rnd.choice(["rn", "ii", "o", "á", "c"])
        w = "".join(w)
        # one letter for another, or two for one, is within two deletions on either side
        near = {(scans.weighted_distance(w, x, 0.45), x) for x in words if x != w}
        assert {x for c, x in near if c <= 0.45} <= {x for _, x in lexicon.candidates(w, 0.7)}
    assert lexicon.candidates("a" * 12 + "m" + "e" * 12, 0.7) == [(0.3, "a" * 12 + "rn" + "e" * 12)]
