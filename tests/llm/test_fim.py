import hashlib
import random
import re

import numpy as np
import pytest

from tallyworks.llm import fim

from ..compare import same_rows
from ..conftest import DATA
from .cases import ODD, documents, emptied

M = fim.machine()


def brute(doc_id, text, seed=7, rate=100, spm=50):
    """The contract, by regular expressions over code points."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_query_equals_sql(spark, duck):
    same_rows(fim.op11_fill_in_middle(spark, DATA), duck.sql(fim.ORACLE))


def test_odd_rows(spark):
    rows = [*ODD, (9, "a<P>b\nc"), (10, "<S>"), (11, "x<M"), (12, "<P\n>"), (13, "\n\n\n"), (14, "é\n漢\n😀\nlast"), (15, "<<P><"), (16, "<\n<S\n<"), (None, None), (17, "a\r\nb\x85c d\n")]
    for rate, spm in ((100, 50), (40, 0), (0, 50), (100, 100)):
        found = fim.fill_in_middle(documents(spark, rows), rate=rate, spm=spm)
        assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        assert sorted(map(repr, found.collect())) == sorted(map(repr, (fim_row(found, i, t, rate, spm) for i, t in rows)))
    back = fim.fill_in_middle(documents(spark, rows)).select("doc_id", fim.restorer()("output", "form").alias("text")).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert fim.fill_in_middle(emptied(spark)).count() == 0


def fim_row(found, doc_id, text, rate, spm):
    from pyspark.sql import Row

    return Row(**dict(zip(found.columns, (doc_id, *brute(doc_id, text, 7, rate, spm)), strict=True)))


@pytest.mark.parametrize("seed", range(4))
def test_any_text_comes_back(seed):
    draw = random.Random(seed)
    letters = ["<", "P", "S", "M", ">", "\n", "a", "é", "漢", "😀", "\x00", "<P", "<S>"[: seed + 1]]
    texts = ["".join(draw.choices(letters, k=draw.choice([0, 1, 5, 60, 3000]))) for _ in range(120)] + [None, ""]
    draws = np.array([[draw.getrandbits(32) for _ in range(4)] for _ in texts])
    rows = fim.rearranged(texts, draws, M)
    assert [r["n"] for r in rows] == [len(re.findall(r"[^\n]*\n|[^\n]+", t or "")) for t in texts]
    assert [r["form"] == "plain" for r in rows] == [not t or any(s in t for s in fim.SENTINELS) for t in texts]
    assert fim.restored([r["output"] for r in rows], [r["form"] for r in rows], M) == [t or "" for t in texts]


def test_transitions_do_not_depend_on_stripes(monkeypatch):
    draw = np.random.default_rng(0)
    raw = np.frombuffer("".join(draw.choice(["<", "P", ">", "\n", "é", "漢", "😀", "x"], 4000)).encode(), np.uint8)
    wanted, state = [], 0
    for byte in raw.tolist():
        wanted.append(M.told[state << 8 | byte])
        state = int(M.after[state << 8 | byte])
    for stripe in (1, 3, 7, 64, 512, 10**5):
        monkeypatch.setattr(fim, "STRIPE", stripe)
        assert fim.transitions(raw, M).tolist() == wanted
    broken = draw.integers(0, 255, 3000).astype(np.uint8)  # not UTF-8: whatever it is, stripes don't change it
    monkeypatch.setattr(fim, "STRIPE", 10**5)
    whole = fim.transitions(broken, M).tolist()
    monkeypatch.setattr(fim, "STRIPE", 16)
    assert fim.transitions(broken, M).tolist() == whole


def test_states_that_never_meet():
    """An automaton that counts bytes modulo two has no bytes after which its state is known."""
    m = fim.Machine(np.repeat([1, 0], 256).astype(np.uint8), np.repeat([0, 1], 256).astype(np.uint8))
    raw = np.zeros(2001, np.uint8)
    assert fim.transitions(raw, m).tolist() == [i % 2 for i in range(2001)]


def test_other_sentinels_and_units(spark):
    marks, unit = ("[pre]", "[suf]", "[mid]"), b".;"
    docs = documents(spark, [(1, "a. b; c"), (2, "x[mid]y. z."), (3, "[pre [suf. ] é; ü.")])
    rows = {r.doc_id: r for r in fim.fill_in_middle(docs, sentinels=marks, unit=unit).withColumn("text", fim.restorer(marks, unit)("output", "form")).collect()}
    assert [rows[i].n for i in (1, 2, 3)] == [3, 2, 3] and rows[2].form == "plain" and rows[3].text == "[pre [suf. ] é; ü." and rows[1].text == "a. b; c"
    for wrong in (("<P>", "<P>x", "<M>"), ("<P>", "a<b", "<M>"), ("<P\n", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.machine(wrong)
