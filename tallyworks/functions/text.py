"""Thai numbers, names, document types and banned terms as column expressions.

Words and patterns below are fixed values of the domain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
BAHT = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:\.-)?\s*บาท"
#: Marks that stand above or below a Thai letter.
MARKS = "ัิ-ฺ็-๎"

WORK_TYPES = (
    ("ถนนคสล", ("ถนนคสล",)),
    ("ถนนดิน", ("ถนนดิน",)),
    ("ถนนลูกรัง", ("ถนนลูกรัง", "ถนนลุกรัง")),
    ("ท่อระบายน้ำ", ("ท่อระบายน้ำ",)),
    ("ห้องน้ำ", ("ห้องน้ำ",)),
    ("อาคาร", ("อาคาร",)),
    ("กล้องวงจรปิด", ("กล้อง", "cctv")),
    ("ซ่อมรถ", ("ซ่อมรถ", "ซ่อมแซมรถ")),
    ("จัดซื้อรถ", ("จัดซื้อรถ", "รถบรรทุก")),
)
DOC_TYPES = (
    ("สาระสำคัญ", "contract_summary"),
    ("ประกาศผู้ชนะ", "winner_announcement"),
    ("อนุมัติราคากลาง", "price_approval_memo"),
    (r"boq|ปร[\s.]*[45๔๕]", "boq"),
    ("tor|ขอบเขตของงาน", "tor"),
    ("เทคนิค", "tech_spec"),
)
METHODS = (("e-bidding", "E_BIDDING"), ("ประกวดราคาอิเล็กทรอนิกส์", "E_BIDDING"), ("คัดเลือก", "SELECTION"), ("เฉพาะเจาะจง", "SPECIFIC"))
TANK = r"ถังน้ำ(?:แบบ)?พลาสติก.{0,60}?2\s*,?\s*000\s*ลิตร"
BANNED = ("ทุจริต", "ฉ้อโกง", "โกง", "คอร์รัปชัน", "fraud", "corruption")


def arabic_digits(text: Column) -> Column:
    """Thai digits as 0-9."""
    return F.translate(text, "๐๑๒๓๔๕๖๗๘๙", "0123456789")


def to_amount(number: Column) -> Column:
    """A number with thousands commas as decimal; NULL if it is empty or has none."""
    return F.replace(number, F.lit(","), F.lit("")).try_cast("decimal(38,2)")


def first_amount(text: Column) -> Column:
    """The first number of a text."""
    return to_amount(F.regexp_extract(arabic_digits(text), NUMBER, 0))


def baht_amounts(text: Column) -> Column:
    """All numbers that stand before the word for baht, in reading order."""
    return F.transform(F.regexp_extract_all(arabic_digits(text), F.lit(BAHT), F.lit(1)), to_amount)


def written_money(text: Column) -> Column:
    """All numbers written as money, that is with a comma or a fraction, in reading order."""
    tokens = F.regexp_extract_all(arabic_digits(text), F.lit(NUMBER), F.lit(0))
    return F.transform(F.filter(tokens, lambda t: t.rlike("[,.]")), to_amount)


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def match_key(name: Column) -> Column:
    """A name without white space, to match other spellings of it."""
    return F.regexp_replace(name, r"(?U)\s+", "")


def tidy_name(name: Column) -> Column:
    """A name of a path without white space at its ends, marks at its start and runs of white space."""
    stripped = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(stripped, f"^[{MARKS}]+", ""), r"(?U)\s+", " ")


def buddhist_year(digits: Column) -> Column:
    """A year of two to four digits as a year of the Buddhist era; NULL outside 2500 to 2600."""
    year = digits.try_cast("int")
    full = F.when(year < 100, year + 2500).otherwise(year)
    return F.when(full.between(2500, 2600), full)


def folder_year(folder: Column) -> Column:
    """The year that a folder is named after, with or without the word for year."""
    return buddhist_year(arabic_digits(F.regexp_extract(tidy_name(folder), r"^(?:ปี\s*)?([0-9๐-๙]{2,4})$", 1)))


def report_year(filename: Column) -> Column:
    """The year that the first two to four digits of a report's name tell."""
    return buddhist_year(F.regexp_extract(arabic_digits(filename), r"([0-9]{2,4})", 1))


def doc_type(filename: Column) -> Column:
    """What kind of document a file is by its name; the first rule that fits decides."""
    name = F.lower(tidy_name(filename))
    out = F
    for pattern, kind in DOC_TYPES:
        out = out.when(name.rlike(pattern), kind)
    number = arabic_digits(F.regexp_extract(name, r"บก[\s.]*([0-9๐-๙]{1,2})", 1)).try_cast("int")
    return out.when(number == 1, "bk01").when(number == 6, "bk06")


def procurement_method(text: Column) -> Column:
    out = F
    for word, method in METHODS:
        out = out.when(F.contains(text, F.lit(word)), method)
    return out


def work_type(name: Column) -> Column:
    """The kind of work that a project's name tells, whatever its spaces, points and spelling of reinforced concrete."""
    squeezed = F.replace(F.replace(arabic_digits(name), F.lit(" "), F.lit("")), F.lit("."), F.lit(""))
    squeezed = F.lower(F.replace(squeezed, F.lit("คอนกรีตเสริมเหล็ก"), F.lit("คสล")))
    out = F
    for label, words in WORK_TYPES:
        out = out.when(F.contains(squeezed, F.lit(words[0])) if len(words) == 1 else F.contains(squeezed, F.lit(words[0])) | F.contains(squeezed, F.lit(words[1])), label)
    return out


def moo_numbers(name: Column) -> Column:
    """The numbers of the villages that a name tells, each once."""
    return F.array_distinct(F.regexp_extract_all(arabic_digits(name), F.lit(r"หมู่\s*(?:ที่)?\s*([0-9]+)"), F.lit(1)))


def village_names(name: Column) -> Column:
    """The names of the villages that a name tells, each once."""
    found = F.regexp_extract_all(arabic_digits(name), F.lit(r"บ้าน(\S{2,})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda v: F.regexp_replace(v, "[^ก-๙a-zA-Z0-9]+$", "")))


def tracked_item(text: Column) -> Column:
    return F.when(arabic_digits(text).rlike(TANK), "water-tank-plastic-2000l")


def banned_terms(text: Column, allowed: tuple[str, ...] = (), terms: tuple[str, ...] = BANNED) -> Column:
    """The banned terms of a text, after allowed phrases have been taken out."""
    scrubbed = text
    for phrase in allowed:
        scrubbed = F.replace(scrubbed, F.lit(phrase), F.lit(" "))
    lowered = F.lower(scrubbed)
    return F.filter(F.array(*map(F.lit, terms)), lambda term: F.contains(scrubbed, term) | F.contains(lowered, term))


def cited_labels(text: Column) -> Column:
    """The numbers of the citations [C1], [C2], ... in a text, each once and in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[C([0-9]+)\]"), F.lit(1)), lambda n: n.cast("int"))))


def clamped(text: Column, most: int) -> Column:
    """The first characters of a text, with an ellipsis if there were more."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


#: Letters that are typed in the wrong order or twice, and how they belong (fixed rules of the script).
TONES, ABOVE, BELOW, AFTER = "่-๋", "ัิ-ื็ํ", "ุ-ฺ", "ะาำๅ"
ORDER = (
    ("[\u200b\u200c\ufeff]", ""), ("เเ", "แ"), (f"[{TONES}]+([{TONES}])", "$1"), (f"ํ([{TONES}])า", "$1ำ"), ("ํา", "ำ"), (f"ำ([{TONES}])", "$1ำ"),
    (f"([{TONES}์])([{ABOVE}{BELOW}]+)", "$2$1"), (f"([{ABOVE}{BELOW}{AFTER}เ-ไ์])\\1+", "$1"),
)


def normalised(text: Column) -> Column:
    """Thai with each letter's marks in their order and each of them once, without characters of no width."""
    for pattern, instead in ORDER:
        text = F.regexp_replace(text, pattern, instead)
    return text
