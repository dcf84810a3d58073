import random
import time
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyworks.functions import numbers, text
from tallyworks.operators import assessments, checks, documents, items, listings, recurring, retrieval, risk
from tallyworks.sources import files, sinks
from tallyworks.streaming import gate, telemetry


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


# --- recurring works ---------------------------------------------------------

ROAD = "ก่อสร้างถนน คสล. หมู่ {} บ้านหนองบัว"


def projects(spark, rows):
    named = spark.createDataFrame(rows, "id string, area string, year int, name string, budget decimal(14,2), winner string")
    return recurring.placed(named)


def test_recurring_road_is_one_cluster_and_a_high_finding(spark):
    rows = [
        ("a", "s", 2566, ROAD.format(1), Decimal(90000), "ผู้รับจ้าง ก"),
        ("b", "s", 2566, ROAD.format("๑"), Decimal(10000), "ผู้รับจ้าง ก"),
        ("c", "s", 2567, "ก่อสร้างถนนคอนกรีตเสริมเหล็ก บ้านหนองบัว", Decimal(50000), "ผู้รับจ้าง ก"),
        ("d", "s", 2568, ROAD.format(2), Decimal(424050), "ผู้รับจ้าง ก"),
        ("e", "s", 2568, "ก่อสร้างถนนดิน หมู่ 1 บ้านหนองบัว", Decimal(1), None),
        ("f", "t", 2568, ROAD.format(1), Decimal(1), None),
    ]
    found = {r.id: r for r in recurring.yoy_findings(projects(spark, rows)).collect()}
    assert {found[i].cluster for i in "abcd"} == {"a"} and {found[i].status for i in "abcd"} == {"FLAG"}
    assert found["a"].growth == Decimal("7.4810") and (found["a"].from_year, found["a"].to_year) == (2567, 2568)
    assert found["a"].severity == "HIGH" and found["a"].cumulative_budget == Decimal("574050.00")
    assert found["e"].status == found["f"].status == "OK"


def test_growth_below_double_is_no_finding(spark):
    rows = [("a", "s", 2566, ROAD.format(1), Decimal(100), None), ("b", "s", 2567, ROAD.format(1), Decimal(190), None)]
    assert {r.status for r in recurring.yoy_findings(projects(spark, rows)).collect()} == {"OK"}


def test_villages_disambiguate_numbers(spark):
    rows = [("a", "s", 1, "อาคาร หมู่ 1 บ้านใหม่", None, None), ("b", "s", 1, "อาคาร หมู่ 1 บ้านเก่า", None, None), ("c", "s", 1, "อาคาร หมู่ 2 บ้านเก่า", None, None)]
    assert {r.id: r.cluster for r in recurring.clusters(projects(spark, rows)).collect()} == {"a": "a", "b": "b", "c": "b"}
    rows.append(("d", "s", 1, "อาคาร หมู่ 1", None, None))  # tells no village: goes with both
    assert {r.cluster for r in recurring.clusters(projects(spark, rows)).collect()} == {"a"}


# --- items -------------------------------------------------------------------


def tank(spark, twice=False):
    rows = [(1, "tank", 2566, Decimal(5), Decimal(22500), Decimal("4500.00"), "ก", 1), (1, "tank", 2567, Decimal(5), Decimal(34000), Decimal("6800.00"), "ก", 1)]
    return spark.createDataFrame(rows, "area int, item string, fiscal_year int, quantity decimal(18,2), total decimal(18,2), unit_price decimal(14,2), winner string, bid_count long")


def test_tank_item(spark):
    spikes = items.spikes(tank(spark)).collect()
    assert {(s.member_year, s.growth_pct, s.severity) for s in spikes} == {(2566, Decimal("51.1"), "HIGH"), (2567, Decimal("51.1"), "HIGH")}
    lock = items.vendor_lock(tank(spark)).first()
    assert (lock.fiscal_years, lock.single_bid_years, lock.cumulative_amount) == ("2566,2567", "2566,2567", Decimal("56500.00"))
    standard = spark.createDataFrame([("tank", Decimal(7000))], "item string, standard decimal(14,2)")
    rows = items.against_standard(tank(spark), standard).orderBy("fiscal_year").collect()
    assert [(r.status, r.permille) for r in rows] == [("OK", 642), ("OK", 971)]


def test_ambiguous_match_is_null(spark):
    lines = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "line int, amount int")
    candidates = spark.createDataFrame([(10, 5), (11, 6), (12, 6)], "project int, amount int")
    assert {r.line: r.project for r in items.exactly_one(lines, candidates, ["amount"], "line", "project").collect()} == {1: 10, 2: None, 3: None}


# --- checks ------------------------------------------------------------------

FACTS = "method string, reference_price decimal(18,2), budget decimal(18,2), form_reference_price decimal(18,2), boq_total decimal(18,2), contract_price decimal(18,2), winning_bid decimal(18,2), lowest_bid decimal(18,2), highest_bid decimal(18,2), n_bids int, doc_types array<string>"


@pytest.mark.parametrize(
    ("check", "facts", "status"),
    [
        ("reference_price_cross_check", {"reference_price": 101, "form_reference_price": 100}, "OK"),
        ("reference_price_cross_check", {"reference_price": 102, "form_reference_price": 100}, "FLAG"),
        ("reference_price_cross_check", {"reference_price": 102}, "NA"),
        ("reference_price_cross_check", {"reference_price": 102, "form_reference_price": 0}, "OK"),
        ("boq_vs_bk01_total", {"boq_total": 120, "form_reference_price": 100}, "WARN"),
        ("reference_within_budget", {"reference_price": 2, "budget": 1}, "FLAG"),
        ("reference_within_budget", {"reference_price": 2, "budget": 0}, "NA"),
        ("contract_within_reference", {"contract_price": 2, "reference_price": 2}, "OK"),
        ("bid_competition", {"n_bids": 0}, "NA"),
        ("bid_competition", {"n_bids": 1, "method": "E_BIDDING"}, "WARN"),
        ("bid_competition", {"n_bids": 1, "method": "SPECIFIC"}, "OK"),
        ("bid_competition", {"n_bids": 2, "winning_bid": 5, "lowest_bid": 4, "highest_bid": 5}, "WARN"),
        ("procurement_threshold", {"method": "SPECIFIC", "reference_price": 500001}, "FLAG"),
        ("procurement_threshold", {"method": "SPECIFIC", "reference_price": 500000}, "WARN"),
        ("procurement_threshold", {"method": "SPECIFIC", "reference_price": 0, "budget": 475000}, "WARN"),
        ("procurement_threshold", {"method": "E_BIDDING", "reference_price": 900000}, "OK"),
        ("expected_documents", {"method": "SELECTION", "doc_types": ["contract_summary", "bk06", "tor"]}, "OK"),
        ("expected_documents", {"method": "E_BIDDING", "doc_types": ["contract_summary", "bk06", "tor"]}, "WARN"),
    ],
)
def test_checks(spark, check, facts, status):
    names = [f.split()[0] for f in FACTS.split(", ")]
    row = tuple(Decimal(v) if isinstance(v := facts.get(n), int) and n != "n_bids" else v if n in facts else [] if n == "doc_types" else 0 if n == "n_bids" else None for n in names)
    assert spark.createDataFrame([row], FACTS).select(getattr(checks, check)().alias("f")).first().f.status == status


# --- numbers, risk -----------------------------------------------------------


def test_rounding_modes(spark):
    assert one(spark, numbers.rounded(F.lit(2.25))) == Decimal("2.3")
    assert one(spark, numbers.ratio(F.lit("1").cast("decimal(18,2)"), F.lit("80000").cast("decimal(18,2)"))) == Decimal("0.0000")
    assert [one(spark, numbers.nearest_rank(F.array(*map(F.lit, v)), 50)) for v in ([1, 2], [1, 2, 3, 4], [])] == [1, 3, None]


@pytest.mark.parametrize(("score", "high", "level"), [(10, False, "LOW"), (40, False, "MEDIUM"), (60, False, "HIGH"), (80, False, "REQUIRES_INVESTIGATION"), (5, True, "REQUIRES_INVESTIGATION")])
def test_bands(spark, score, high, level):
    assert one(spark, numbers.risk_band(F.lit(score), F.lit(high))) == level


def test_validating_and_writing_is_one_pass(spark, tmp_path):
    results = spark.createDataFrame([(1, 50, "LOW", "r1", "ok"), (2, None, "LOW", "r1", "ok"), (3, 50, "LOW", "r2", None)], "id int, score int, level string, cited string, words string")
    results.write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("r1",), ("r1",)], "code string")
    found = risk.validated(spark.read.parquet(str(tmp_path / "in")), known, "cited", "words")
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert risk.accept_and_refuse(found, "id", str(tmp_path / "out")) == {"results": 3, "accepted": 1, "broken": 3}
    good, bad = risk.outcomes(spark, str(tmp_path / "out"), found.schema)
    assert [r.id for r in good.collect()] == [1] and {(r.id, *r.violations) for r in bad.collect()} == {(2, "score_range"), (3, "citation", "lexicon")}
    empty = str(tmp_path / "none")
    assert risk.accept_and_refuse(found.limit(0), "id", empty)["results"] == 0 and risk.outcomes(spark, empty, found.schema)[0].count() == 0


def test_weights_are_shared_among_factors(spark):
    rows = [("p", f, Decimal(s)) for f, s in zip(risk.FACTORS, (100, 0, 50, 50, 50), strict=True)] + [("q", "signup", Decimal(30)), ("q", "click", Decimal(60))]
    found = {r.k: r for r in risk.assessed(spark.createDataFrame(rows, "k string, factor string, score decimal(5,2)"), "k", F.max(F.lit(False))).collect()}
    assert found["p"].overall_score == Decimal("50.00") and found["q"].overall_score == Decimal("45.00") and found["p"].top_factors == "signup,error"


def test_results_that_break_a_rule_are_turned_away(spark):
    results = spark.createDataFrame([(1, 50, "LOW", "r1", "ปกติ"), (2, 101, "LOW", "r1", "ok"), (3, 50, "WORST", "r2", "มีการทุจริต")], "id int, score int, level string, cited string, words string")
    known = spark.createDataFrame([("r1",)], "code string")
    found = risk.broken(results, "id", known, "cited", "words")
    assert {(r.id, r.rule) for r in found.collect()} == {(2, "score_range"), (3, "level"), (3, "citation"), (3, "lexicon")}
    assert [r.id for r in risk.accepted(risk.validated(results, known, "cited", "words")).collect()] == [1]
    missing = spark.createDataFrame([(1, None, None, None, None)], results.schema)
    assert {r.rule for r in risk.broken(missing, "id", known, "cited", "words").collect()} == {"score_range", "level", "citation", "lexicon"}
    weights = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 0.5)], "k string, weight double")
    assert [r.k for r in risk.unordered_weights(weights, "k").collect()] == ["b"]


# --- documents ---------------------------------------------------------------

SUMMARY = """งานประกวดราคาอิเล็กทรอนิกส์ วงเงิน 2,000,000.00 บาท ราคากลาง ๑,๙๘๐,๐๐๐.๐๐ บาท
## 6. รายชื่อ
| เลขประจำตัว | รายชื่อผู้เสนอราคา | ราคาที่เสนอ |
|---|---|---|
| 1 | ห้าง ก | 1,990,000.00 |
## 6. รายชื่อ
| 2 | บริษัท ข  จำกัด | 1,950,000.00 |
| 2 | บริษัท ขจำกัด | 1,950,000.00 |
## 7. ผู้ชนะ
| ลำดับ | ชื่อผู้ขาย | จำนวนเงิน |
|---|---|---|
| 1 | บริษัท ข จำกัด | 1,950,000.00 |"""


def test_contract_with_continued_table(spark):
    docs = spark.createDataFrame([("c", SUMMARY), ("d", "คัดเลือก ไม่มีตาราง"), ("e", "เฉพาะเจาะจง\n## 6. x\n| 9 | ร้าน ค | 10 |")], "document string, text string")
    found = {r.document: r for r in documents.contract_summaries(docs).collect()}
    c = found["c"]
    assert (c.budget, c.reference_price, c.method) == (Decimal("2000000.00"), Decimal("1980000.00"), "E_BIDDING")
    assert [b.name for b in c.bidders] == ["ห้าง ก", "บริษัท ข จำกัด"] and c.winner.name == "บริษัท ข จำกัด" and c.winner.price == Decimal("1950000.00")
    assert found["d"].winner is None and found["d"].method == "SELECTION" and found["e"].winner.name == "ร้าน ค" and found["e"].winner.price is None


def test_forms(spark):
    form = "1. วงเงินงบประมาณที่ได้รับจัดสรร บาท 2,089,600.00\nราคากลางคำนวณ ณ วันที่ 5 มีนาคม 2566 เป็นเงิน ๗๐๗,๐๐๔.๐๐ บาท"
    row = one(spark, documents.reference_form(F.lit(form)))
    assert (row.budget, row.reference_price) == (Decimal("2089600.00"), Decimal("707004.00"))
    assert one(spark, documents.boq_total(F.lit("ราคากลาง 10 บาท\nรวม 99 บาท\nราคากลาง ๒๐ บาท"))) == Decimal(20)
    assert one(spark, documents.boq_total(F.lit("ไม่มี"))) is None


def test_budget_report_counts_overlap_once(spark):
    rows = [f"| {i} | โครงการก่อสร้างที่ {i} | {i},000 งบกลาง |" for i in range(1, 12)] + ["| 12 | โครงการไม่มีงบประมาณ | - |", "| 13 | รวมทั้งสิ้นทุกโครงการ | 9,999 |", "| 14 | สั้น | 5 |"]
    chunks = spark.createDataFrame([("d", 0, "\n".join(rows[:8])), ("d", 1, "\n".join(rows[5:])), ("e", 0, rows[0])], "document string, chunk_index int, text string")
    found = documents.budget_reports(chunks).collect()
    assert len(found) == 1 and found[0].project_count == 12 and found[0].total_budget == Decimal(66000)
    assert [int(t.amount) for t in found[0].top_items] == [11000, 10000, 9000]


def test_item_lines(spark):
    chunk = "| ๑ | จัดซื้อถังน้ำพลาสติก ขนาด ๒,๐๐๐ ลิตร  จำนวน ๕ ใบ | ๒๒,๕๐๐.๐๐ | ม.ค. |\n| 2 | ถังน้ำพลาสติก 2000 ลิตร | 5 | x |"
    row = documents.item_lines(spark.createDataFrame([("d", 1, chunk)], "document string, page int, text string")).collect()
    assert [(r.quantity, r.unit, r.total) for r in row] == [(Decimal(5), "ใบ", Decimal("22500.00"))]


def test_chunks(spark):
    lines = ["a" * 300, "b" * 300, "c" * 300]
    pages = spark.createDataFrame([("d", 1, "\n".join(lines)), ("d", 2, "  \n"), ("d", 3, "z"), ("d", 4, None)], "document string, page int, text string")
    found = documents.chunked(pages).orderBy("chunk_index").collect()
    assert [(r.page, r.chunk_index) for r in found] == [(1, 0), (1, 1), (3, 2)]
    assert found[0].text == "\n".join(lines[:2]) and found[1].text == "\n".join(lines[1:])
    rebuilt = documents.reconstructed(documents.chunked(pages)).first().text
    assert rebuilt == "\n".join([*lines, "z"])
    assert [len(x) for x in documents.broken_up("word " * 400, 800, 1200)] == [799, 799, 399]


def test_sections(spark):
    act = "คำปรารภ\nหมวด ๑\nบททั่วไป\nมาตรา ๑ ชื่อ\nเนื้อความ\nมาตรา ๓ อ้างถึง\nส่วนที่ ๑\nมาตรา ๒ ใช้บังคับ\nผู้รับสนองพระราชโองการ\nนายก\nหมายเหตุ :- เหตุผล"
    found = documents.sections(spark.createDataFrame([("act", act)], "code string, text string")).collect()
    assert [(r.section_no, r.title, r.regulation_code) for r in found] == [("preamble", None, "act/preamble"), ("1", "หมวด ๑ บททั่วไป", "act/s.1"), ("2", "หมวด ๑ บททั่วไป / ส่วนที่ ๑", "act/s.2"), ("note", None, "act/note")]
    assert found[1].text == "มาตรา ๑ ชื่อ\nเนื้อความ\nมาตรา ๓ อ้างถึง" and found[3].text == "หมายเหตุ :- เหตุผล"
    assert documents.gaps(spark.createDataFrame([("x", "1"), ("x", "3")], "code string, section_no string")).count() == 1


@pytest.mark.parametrize(("page", "reasons"), [("", ["NO_TEXT_LAYER"]), ("ก" * 50 + "�", ["REPLACEMENT_CHARS"]), ("ก" * 40 + "Ã" * 9, ["MOJIBAKE"]), ("ก" * 40 + " ่ ่", ["BROKEN_COMBINING"]), ("a" * 50, ["LOW_THAI_RATIO"]), ("น้ำ" * 20, [])])
def test_page_quality(spark, page, reasons):
    assert one(spark, documents.page_quality(F.lit(page))) == reasons


def test_names(spark):
    assert one(spark, text.folder_year(F.lit(" ปี 68 "))) == 2568 and one(spark, text.folder_year(F.lit("๒๕๖๖"))) == 2566 and one(spark, text.folder_year(F.lit("ปี 3000"))) is None
    assert one(spark, text.doc_type(F.lit("แบบ บก. ๐๑.pdf"))) == "bk01" and one(spark, text.doc_type(F.lit("ปร.4.pdf"))) == "boq"
    assert one(spark, text.banned_terms(F.lit("โกงโกง FRAUD"), ("โกงโกง",))) == ["fraud"]
    assert one(spark, text.cited_labels(F.lit("[C3] x [C1] [C3]"))) == [1, 3]
    assert one(spark, text.clamped(F.lit("abcd"), 3)) == "abc…"


# --- retrieval ---------------------------------------------------------------


def test_excerpts_stop_at_the_first_that_breaks_the_budget(spark):
    rows = [("p", "a", 1, 5000), ("p", "b", 1, 10), ("q", "a", 1, 2000), ("q", "a", 2, 2000), ("q", "b", 1, 1), ("q", "a", 3, 1)]
    chunks = spark.createDataFrame(rows, "g string, kind string, n int, size int")
    assert {(r.g, r.kind, r.n) for r in retrieval.excerpts(chunks, "g", "kind", "n", "size").collect()} == {("p", "a", 1), ("q", "a", 1)}


def test_many_questions_equal_one_at_a_time(spark, monkeypatch):
    draw = random.Random(4)
    some = [(i, [draw.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, [1.0, 2.0]), (62, None), (63, [None, 1.0, 1.0])]
    vectors = spark.createDataFrame(some, "vec_id long, embedding array<float>")
    questions = vectors.filter("vec_id % 7 = 0 or vec_id = 61").selectExpr("vec_id as question", "embedding")
    monkeypatch.setattr(retrieval, "QUESTIONS", 3)
    monkeypatch.setattr(retrieval, "ROWS", 9)
    found = {}
    for r in retrieval.nearest_each(vectors, questions, 5).collect():
        found.setdefault(r.question, []).append((r.place, r.vec_id, r.score))
    whole = vectors.filter("size(embedding) = 3 and forall(embedding, x -> x is not null)")
    for question in (0, 7, 14, 56):
        wanted = retrieval.nearest(whole, some[question][1], 5).collect() if any(some[question][1]) else []
        if wanted:
            assert [(v, s) for _, v, s in sorted(found[question])] == [(r.vec_id, r.score) for r in wanted]
    assert [v for _, v, _ in found[61]] == [61] and 63 not in found
    assert retrieval.nearest_each(vectors.limit(0), questions).count() == 0 and retrieval.nearest(vectors, None).count() == 0


# --- files and sinks ---------------------------------------------------------


def test_corpus(spark, tmp_path):
    for name, content in {"ตำบล/โครงการ/ปี 67/ถนน/TOR งาน.pdf": b"%PDF-1", "ตำบล/รายงาน/รายงานงบ 67.pdf": b"%PDF-1", "พรบ": b"%PDF-1", "ตำบล/โครงการ/ปี 67/ถนน/รูป.png": b"x", ".x/.hidden": b"", "a/b.md": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = {r.source_path: r for r in files.corpus(spark, str(tmp_path)).collect()}
    assert len(found) == 4
    tor = found["ตำบล/โครงการ/ปี 67/ถนน/TOR งาน.pdf"]
    assert (tor.scope, tor.fiscal_year, tor.project_name, tor.doc_type, tor.is_pdf) == ("PROJECT", 2567, "ถนน", "tor", True)
    assert found["พรบ"].scope == "REFERENCE" and found["พรบ"].anomalies == ["extension-added"]
    assert [r.source_path for r in files.refused(files.corpus(spark, str(tmp_path))).collect()] == ["ตำบล/โครงการ/ปี 67/ถนน/รูป.png"]
    files.write_manifest(files.corpus(spark, str(tmp_path)), str(tmp_path.parent / "manifest"))
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path.parent / "manifest")).collect()] == [("โครงการ", 2567, "ถนน", ["ตำบล/โครงการ/ปี 67/ถนน/TOR งาน.pdf", "ตำบล/โครงการ/ปี 67/ถนน/รูป.png"])]


def test_manifests_are_read_and_refused(spark, tmp_path):
    entries = [{"sub_district": 'a "b"', "fiscal_year": 2567, "name": "n: # x\n'y'", "files": ["f 1.pdf", "- g"]}, {"sub_district": "null", "fiscal_year": 2500, "name": "", "files": []}]
    text = "\n".join(["# note", "projects:", *(x for e in entries for x in files.entry_lines(e))])
    assert files.parsed_manifest(text) == entries and files.parsed_manifest("") == []
    plain = "projects:\r\n- sub_district: 'it''s'\r\n  fiscal_year: 2566\r\n  name: plain name\r\n  files:\r\n  - a/b.pdf\r\n"
    assert files.parsed_manifest(plain) == [{"files": ["a/b.pdf"], "sub_district": "it's", "fiscal_year": 2566, "name": "plain name"}]
    for i, wrong in enumerate(["  name: x", "- other: x", "projects:\n- sub_district: a\n    deep: 1", text + "\n" + "\n".join(files.entry_lines(entries[0])), text.replace("2567", "2667")]):
        (tmp_path / f"{i}.yaml").write_text(wrong)
        with pytest.raises(Exception, match="manifest"):
            files.read_manifest(spark, str(tmp_path / f"{i}.yaml")).collect()
    (tmp_path / "good").mkdir()
    (tmp_path / "good/a.yaml").write_text(text)
    (tmp_path / "good/b.yaml").write_text(plain)
    assert files.read_manifest(spark, str(tmp_path / "good")).count() == 3


def test_pages_and_metrics(spark, tmp_path):
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc/page_2.md").write_text("สวัสดี\nb")
    (tmp_path / "doc/page_3.md").write_text(" ")
    assert [(r.document, r.page, r.text) for r in files.page_texts(spark, str(tmp_path)).collect()] == [("doc", 2, "สวัสดี\nb")]
    lines = spark.createDataFrame([('ttft_sum{m="a"} 1.0',), ('ttft_sum{m="b"} 0.5',), ('ttft_count{m="a"} 3',), ('ttft_count{m="b"} 1',), ("ttft_other 9",)], "value string")
    assert tuple(files.histogram_totals(lines, "ttft").first()) == (1.5, 4.0)
    assert tuple(files.histogram_totals(lines, "none").first()) == (None, None)
    assert one(spark, files.without_comments(F.lit("a<!-- x\ny -->b"))) == "ab"


def test_histogram_deltas(spark):
    snapshots = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 1.6, 4.0), ("a", 3, 1.6, 4.0), ("b", 1, 0.5, 1.0)], "source string, at int, sum double, count double")
    found = {(r.source, r.at): r.mean_ms for r in files.histogram_delta(snapshots).collect()}
    assert found[("a", 2)] == pytest.approx(300) and found[("a", 1)] is None and found[("a", 3)] is None and found[("b", 1)] is None


def test_prompts_and_keys(spark, tmp_path):
    (tmp_path / "v1.txt").write_text("Score {factor} of {project}.", encoding="utf-8")
    assert files.prompt(str(tmp_path), "v1", {"factor", "project"}) == "Score {factor} of {project}."
    with pytest.raises(ValueError, match="project"):
        files.prompt(str(tmp_path), "v1", {"factor"})
    rows = spark.createDataFrame([("a", None), ("a", ""), ("a", None), ("a\x1f", "b"), ("a", "\x1fb")], "x string, y string")
    keys = [r.k for r in rows.select(sinks.surrogate_key("x", "y").alias("k")).collect()]
    assert keys[0] == keys[2] and len(set(keys)) == 4 and all(len(k) == 64 for k in keys)
    short = rows.select(sinks.content_name(F.col("x").cast("binary")).alias("n")).first().n
    assert len(short) == 12 and keys[0] != short


def test_manifest(spark):
    good = [{"sub_district": "a", "fiscal_year": 2567, "name": "n", "files": ["f"]}]
    assert files.manifest_entries(spark, good).count() == 1
    for wrong in (good * 2, [good[0] | {"fiscal_year": 2024}]):
        with pytest.raises(ValueError, match="manifest"):
            files.manifest_entries(spark, wrong)


def test_sinks_are_idempotent(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", None)], "id int, x string, y int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(sinks.merged(old, new, ["id"])) == [(1, "a", 1), (2, "b", 5), (3, "c", None)] == rows(sinks.merged(sinks.merged(old, new, ["id"]), new, ["id"]))
    assert rows(sinks.replaced(old, new, ["id"])) == [(1, "a", 1), (2, None, 5), (3, "c", None)] == rows(sinks.replaced(sinks.replaced(old, new, ["id"]), new, ["id"]))
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.write_table(old, path, ["id"])
    sinks.write_table(sinks.merged(spark.read.parquet(path), new, ["id"]), path, ["id"])
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError, match="same"):
        sinks.write_table(old.union(old), path, ["id"])
    assert [r.id for r in sinks.pending(new, old, ["id"]).collect()] == [3] and sinks.pending(new, old, ["id"], again=True).count() == 2
    content = spark.createDataFrame([("p", bytearray(b"x"))], "path string, content binary")
    known = content.select("path", F.sha2("content", 256).alias("digest"))
    assert sinks.changed(content, known).count() == 0 and sinks.changed(content, known.withColumn("digest", F.lit("y"))).count() == 1


# --- streams -----------------------------------------------------------------


def segments(spark, deltas):
    rows = [(1, i, d, i == len(deltas) - 1) for i, d in enumerate(deltas)]
    found = gate.gated(spark.createDataFrame(rows, "request_id long, seq int, delta string, last boolean")).orderBy("segment").collect()
    return [(r.text, r.blocked) for r in found]


def test_gate(spark):
    clean = "ข้อสังเกตหนึ่ง. และ another sentence!\nend without stop"
    assert "".join(t for t, _ in segments(spark, list(clean))) == clean
    blocked = segments(spark, ["This is fine. It was cor", "ruption indeed", " and more. "])
    assert blocked[0] == ("This is fine.", False) and blocked[-1] == (gate.NOTICE, True) and len(blocked) == 2
    long = segments(spark, ["word " * 60])
    assert len(long[0][0]) <= gate.FIRST and all(len(t) <= gate.OTHERS for t, _ in long)


def test_stream_of_the_gate_equals_the_batch(spark, tmp_path):
    rows = [(k, i, d, i == 5) for k in (1, 2) for i, d in enumerate(["Hello wor", "ld. This", " goes on ", "and on", " fra", "ud."])]
    frame = spark.createDataFrame(rows, "request_id long, seq int, delta string, last boolean")
    for i in (0, 1):  # files in two parts: state goes from one batch to the next
        frame.filter((F.col("seq") >= 3 * i) & (F.col("seq") < 3 * i + 3)).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    found = gate.run_once(gate.gated(stream))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, gate.gated(frame).collect()))


SCHEMA = "request_id long, seq int, delta string, last boolean"


def batches(spark, folder, parts):
    """A stream whose micro-batches are these lists of rows."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
        time.sleep(1.1)  # files are taken by their times, which are whole seconds
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_the_gate_takes_deltas_in_their_order(spark, tmp_path):
    """Shuffled over three batches, with repeated ones and some after the last: the same as the batch of all."""
    words = ["Hello wor", "ld. This", " goes on ", "and on", " to the", " end."]
    rows = [(k, i, d, i == 5) for k in (1, 2, 3) for i, d in enumerate(words)] + [(4, i, d, i == 5) for i, d in enumerate([*words[:4], " fra", "ud."])]
    draw = random.Random(2)
    draw.shuffle(rows)
    parts = [rows[:8], rows[8:16] + rows[:3], [*rows[16:], (1, 6, "late", False), (2, 5, "other", True)]]
    wanted = sorted(map(tuple, gate.gated(spark.createDataFrame(sorted(rows), SCHEMA)).collect()))
    assert sorted(map(tuple, gate.gated(spark.createDataFrame(rows, SCHEMA)).collect())) == wanted
    found = gate.run_once(gate.gated(batches(spark, str(tmp_path), parts)))
    assert sorted(map(tuple, found.collect())) == wanted
    assert {r[0]: "".join(x[2] for x in wanted if x[0] == r[0]) for r in wanted}[3] == "".join(words)


def test_silent_requests_are_ended(spark, tmp_path):
    """A request without its last delta, and one with a gap, are let through as far as they go, and state is empty."""
    parts = [[(1, 0, "No end", False), (2, 0, "a", False), (2, 2, "c", True), (3, 0, "Whole.", True)], [(3, 1, "after", False)]]
    for folder in ("in", "out", "state"):
        (tmp_path / folder).mkdir()
    stream = gate.gated(batches(spark, str(tmp_path / "in"), parts), silence=1000)
    query = stream.writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(90):
            state = (query.lastProgress or {}).get("stateOperators") or [{}]
            if state[0].get("numRowsTotal") == 0 and spark.table("silent").count() >= 3:
                break
            time.sleep(0.5)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
        assert sorted((r.request_id, r.text) for r in spark.table("silent").collect()) == [(1, "No end"), (2, "a"), (3, "Whole.")]
    finally:
        query.stop()


def test_events_and_outcomes(spark):
    lines = spark.createDataFrame([(1, 0, ": ping"), (1, 1, 'data: {"choices":[{"delta":{"content":"hi"}}]}'), (1, 2, 'data: {"choices":[],"usage":{}}'), (1, 3, "data: [DONE]")], "request_id long, seq int, line string")
    assert [(r.delta, r.last) for r in telemetry.sse_deltas(lines).orderBy("seq").collect()] == [("hi", False), ("", True)]
    requests = spark.createDataFrame([(1, 0, False, 0), (2, 3, True, 4), (3, 3, False, 0), (4, 3, False, 9)], "request_id int, n_context int, failed boolean, n_tokens int")
    assert [r.outcome for r in telemetry.outcomes(requests).orderBy("request_id").collect()] == ["refused", "degraded", "empty", "done"]


def test_a_last_chunk_of_repeated_lines_stays(spark):
    lines = ["a" * 300] * 4
    assert documents.packed(lines, 800, 1) == ["\n".join(lines[:2])] * 3
    pages = spark.createDataFrame([("d", 1, "\n".join(lines))], "document string, page int, text string")
    assert documents.reconstructed(documents.chunked(pages)).first().text == "\n".join(lines)


def test_whole_percents_are_exact(spark):
    """A half that is none by one of many digits, halves proper to both sides, and parts of nothing."""
    rows = [("16705.00", "1000.00", 1670), ("16705.01", "1000.00", 1671), ("10000000000.49", "99999999900.02", 10), ("0.15", "1.00", 15), ("0.01", "2.00", 0), ("0.03", "2.00", 2), ("1.00", "0.00", None), ("9999999999999999.50", "9999999999999999.99", 100), ("4.999999", "1.00", 500)]
    frame = spark.createDataFrame([(str(i), a, b) for i, (a, b, _) in enumerate(rows)], "i string, part string, whole string")
    found = frame.select("i", listings.whole_percent(F.col("part").cast("decimal(18,2)"), F.col("whole").cast("decimal(18,2)")).alias("p")).collect()
    assert {r.i: r.p for r in found} == {str(i): p for i, (_, _, p) in enumerate(rows)}


def test_a_justification_near_a_half(spark, tmp_path):
    """The growth is 1670.500000012 percent, of which a quotient of few digits made an even half."""
    low = Decimal("83333333.00")
    frame = spark.createDataFrame([(1, 9131, "1.0")], "o_custkey long, d int, x string").select("o_custkey", F.date_from_unix_date("d").alias("o_orderdate"), F.explode(F.array(F.lit(low), F.lit(low + low * Decimal("16.705") + Decimal("0.01")).cast("decimal(18,2)"))).alias("o_totalprice"))
    frame.write.parquet(f"{tmp_path}/orders.parquet")
    assert listings.justifications(spark, str(tmp_path)).first().text.startswith("in 1995: up to 1671%, in all ")


def test_a_summary_tells_of_high_findings(spark, tmp_path):
    """Errors above 90 call for an investigation, though the mean of all factors is medium."""
    rows = [(1, "error", 31.0), (1, "view", 1.0), (2, "error", 20.0), (2, "view", 12.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    levels = {r.user_id: r.risk_level for r in risk.risk_aggregate(spark, str(tmp_path)).collect()}
    assert levels == {1: "REQUIRES_INVESTIGATION", 2: "MEDIUM"}
    for row in assessments.risk_summary(spark, str(tmp_path)).collect():
        assert f"จัดอยู่ในระดับ{assessments.LEVELS[levels[row.user_id]]} " in row.summary


def test_parts_of_a_contract_are_read_once():
    """The lines of a part are split once, not for each row and cell that is looked at."""
    assert str(documents.winner(F.col("t"))).count("split(t") == str(documents.bidders(F.col("t"))).count("split(t") == 1


def test_requests_go_to_python_together(spark):
    """A batch's requests aren't data frames of their own, which took milliseconds each."""
    rows = [(1, 2, "b. c", True), (1, 1, "a", False), (2, 1, None, True), (3, 2, "late", True), (None, 1, "x", True)]
    found = gate.gated(spark.createDataFrame(rows, "request_id long, seq long, delta string, last boolean"), first=1)
    assert sorted(map(tuple, found.filter("request_id is not null").collect())) == [(1, 0, "ab.", False), (1, 1, " c", False)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "FlatMapGroups" not in plan


def test_nearest_of_blocks_keeps_the_smallest_ids_of_ties():
    """Many equal scores around the last place, rows without a length, and vectors of two lengths."""
    draw = random.Random(3)
    vectors = [[float(draw.randrange(-1, 2)) for _ in range(draw.choice((2, 3)))] for _ in range(200)]
    table = lambda name, some: pa.table([pa.array(list(some), pa.int64()), pa.array([vectors[i] for i in some], pa.list_(pa.float64()))], names=[name, "embedding"])
    found = retrieval.best_of_blocks(7)(table("question", range(20)), table("vec_id", list(range(200))[::-1])).to_pylist()
    for q in range(20):
        same = [i for i in range(200) if len(vectors[i]) == len(vectors[q])]
        scores = retrieval.millionths(np.array([vectors[i] for i in same]), np.array([vectors[q]]))[0].tolist()
        wanted = sorted(zip([-s for s in scores], same, strict=True))[:7]
        assert [(-r["score"], r["vec_id"]) for r in found if r["question"] == q] == wanted
    assert retrieval.best_of_blocks(7)(table("question", range(20)), table("vec_id", [])).num_rows == 0
