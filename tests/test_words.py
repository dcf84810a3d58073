import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import documents, words

SOME = ["กา", "กาแฟ", "แฟน", "น", "นา", "ตา", "ตากลม", "กลม", "ลม", "มา", "มานะ", "ไป", "น้ำ", "ใจ", "น้ำใจ", "คน", "ดี", "คนดี"]


def brute(text, dictionary):
    """Every way of cutting a Thai run at clusters; the cheapest one."""
    bounds = [m.start() for m in words.CLUSTERS.finditer(text)] + [len(text)]

    @cache
    def best(i):
        if bounds[i] == len(text):
            return (0, 0), ()
        found = []
        for j in range(i + 1, len(bounds)):
            piece = text[bounds[i] : bounds[j]]
            (unknown, count), rest = best(j)
            if piece in dictionary:
                found.append(((unknown, count + 1), ((0, -bounds[j]), *rest)))
            if j == i + 1:
                found.append(((unknown + len(piece), count), ((1, -bounds[j]), *rest)))
        return min(found)

    out, at = [], 0
    for flag, end in best(0)[1]:
        piece, at = text[at:-end], -end
        if flag and out and not out[-1][1]:
            out[-1] = (out[-1][0] + piece, False)
        else:
            out.append((piece, not flag))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_cuts_equal_brute_force(seed):
    draw = random.Random(seed)
    texts = ["".join(draw.choices([*SOME, "ก", "เ", "า", "ฮ", "่", "ๆ", "๕"], k=draw.randrange(1, 14))) for _ in range(150)]
    trie = words.Trie(SOME)
    for text, found in zip(texts, words.cut(texts, trie), strict=True):
        assert found == brute(text, set(SOME)), text
    assert words.cut(texts[:7], words.Trie([])) == [[(t, False)] for t in texts[:7]]


def test_other_characters_stay(monkeypatch):
    texts = [None, "", "abc 12,5 กาแฟ\n\nน้ำใจ😀é", "น้ำ ใจ", "\x00กา"]
    wanted = [[], [], [("abc", False), (" ", False), ("12", False), (",", False), ("5", False), (" ", False), ("กาแฟ", True), ("\n\n", False), ("น้ำใจ", True), ("😀", False), ("é", False)], [("น้ำ", True), (" ", False), ("ใจ", True)], [("\x00", False), ("กา", True)]]
    trie = words.Trie(SOME)
    assert words.cut(texts, trie) == wanted
    monkeypatch.setattr(words, "PIECE", 3)
    assert words.cut(texts, trie) == wanted


def test_pages_of_unknown_words(spark):
    dictionary = spark.createDataFrame([(w,) for w in [*SOME, None, "", "กา"]], "word string")
    rows = [(1, "น้ำใจคนดี" * 8), (2, "ฮฮฮฮ" * 5 + "กาแฟ" * 4 + "ฮ" * 8), (3, "น" * 60), (4, None), (5, "กา " * 20)]
    pages = spark.createDataFrame(rows, "id int, text string").withColumn("covered", words.covered(F.col("text"), dictionary))
    found = {r.id: (r.covered, r.reasons) for r in pages.select("id", "covered", documents.page_quality(F.col("text"), F.col("covered")).alias("reasons")).collect()}
    assert found == {1: (72, []), 2: (16, ["UNRECOGNIZED_THAI"]), 3: (0, ["UNRECOGNIZED_THAI"]), 4: (0, []), 5: (40, [])}
    own = spark.createDataFrame([("x",)], "t string").select(words.tokens(F.lit("กาแฟฮ"), dictionary).alias("t")).first().t
    assert [tuple(t) for t in own] == [("กาแฟ", True), ("ฮ", False)]


def test_long_lines_are_cut_at_words(spark):
    dictionary = spark.createDataFrame([(w,) for w in SOME], "word string")
    line = " ".join("กาแฟน้ำใจ" * 9 for _ in range(20))
    page = spark.createDataFrame([(f"short\n\n {line} \n" + "ฮ" * 2000,), (None,)], "t string")
    found = [r.p for r in page.select(words.broken_lines(F.col("t"), dictionary).alias("p")).collect()]
    assert found[1] == [] and found[0][0] == "short" and found[0][-1] == "ฮ" * 2000
    pieces = found[0][1:-1]
    assert "".join(pieces).replace(" ", "") == line.replace(" ", "") and all(700 < len(p) <= 800 for p in pieces[:-1])
    assert all(known for p in pieces for t, known in words.cut([p], words.Trie(SOME))[0] if t.strip())


def test_chunks_of_a_page_are_cut_at_words(spark):
    dictionary = spark.createDataFrame([(w,) for w in SOME], "word string")
    page = spark.createDataFrame([("หัวข้อ\n" + "กาแฟ" * 500,), ("a\n\nb",), (" ",), (None,)], "t string")
    found = [r.c for r in page.select(words.chunks(F.col("t"), dictionary).alias("c")).collect()]
    assert found[1:] == [["a\nb"], [], []] and len(found[0]) == 4 and found[0][1].startswith("หัวข้อ\nกา") and all(len(c.replace("\n", "")) % 4 in (0, 2) for c in found[0])


def test_cleaned_page(spark):
    page = "หน้า ๑๒\nเล่ม ๑๓๔ ตอนพิเศษ ๕ ราชกิจจานุเบกษา\n ข้อ   ๑ น ้ำ กํา\t เเละ \n\n"
    assert spark.range(1).select(documents.cleaned_page(F.lit(page)).alias("t")).first().t == "ข้อ ๑ น้ำ กำ และ"


def test_too_large_a_dictionary_is_refused(spark):
    with pytest.raises(ValueError, match="dictionary"):
        words.dictionary(spark.range(5).select(F.col("id").cast("string")), most=4)


@pytest.mark.parametrize(("typed", "meant"), [("เเก", "แก"), ("นํ้า", "น้ำ"), ("นํา", "นำ"), ("นำ้", "น้ำ"), ("ก่ิ", "กิ่"), ("ก่้", "ก้"), ("กาาา", "กา"), ("a​b", "ab"), ("กิ่ง", "กิ่ง"), (None, None)])
def test_marks_are_put_in_order(spark, typed, meant):
    assert spark.range(1).select(words.normalised(F.lit(typed).cast("string")).alias("t")).first().t == meant


def test_texts_without_overlaps_take_no_step_for_each_letter(monkeypatch):
    """The words of the queries never overlap, so all bounds are found at once (thai_lines and thai_quality took minutes for each letter to be looked at)."""
    monkeypatch.setattr(words, "cheapest", lambda *_: pytest.fail("a step for each letter"))
    trie = words.Trie([words.word_of(c) for c in words.KNOWN])
    text = "".join(map(words.word_of, "abcxyzabyt"))
    assert words.cut([text, None, "a b"], trie) == [[("กากม", True), ("ขาขม", True), ("ฃาฃม", True), ("ฮ" * 12, False), ("กากม", True), ("ขาขม", True), ("ฮฮฮฮ", False), (words.word_of("t"), True)], [], [("a", False), (" ", False), ("b", False)]]
    assert words.covered_of([text, None, "a b"], trie) == [24, 0, 0]


def test_letters_of_a_page_are_counted_at_once():
    texts = ["", "กิ่ ิa", "่ก�é😀", "ก", "ิ"]
    assert documents.counts_of(texts).T.tolist() == [[0, 0, 0, 0, 0, 0], [6, 4, 1, 0, 1, 0], [5, 2, 1, 1, 1, 1], [1, 1, 0, 0, 0, 0], [1, 1, 0, 0, 1, 0]]


def test_whole_texts_are_repaired_as_lines_are(spark):
    draw = random.Random(5)
    texts = [None, "", *("".join(draw.choices("กนเแา่้๊์ิีุำํๅ็​﻿a ", k=40)) for _ in range(300))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(words.repaired(F.col("t")).alias("ours"), words.normalised(F.col("t")).alias("theirs")).collect()
    assert len(rows) == 302 and all(r.ours == r.theirs for r in rows)
