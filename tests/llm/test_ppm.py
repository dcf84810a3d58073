import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyworks.llm import ppm

from ..conftest import DATA
from .cases import ODD, documents, emptied


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), "\n"]


def held_out(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def base(rows):
    counts = Counter(t for i, text in rows if not held_out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return n, {(i, text): (len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(text))) for i, text in rows}


def checked(rows, found):
    n, wanted = base(rows)
    by_id = {i: v for (i, _), v in wanted.items()}
    assert len(found) == len(rows)
    for r in found:
        length, known, score = by_id[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (length, known, n, held_out(r.doc_id))
        assert r.base_score == pytest.approx(score, rel=1e-9, abs=1e-6) and r.score < 0


def test_base_equals_brute_force_and_the_model_is_better(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found = ppm.op6_ppm_score(spark, data).collect()
    checked(rows, found)
    ours, words = (sum(r[c] for r in found if r.held_out) for c in ("score", "base_score"))
    assert ours > 0.975 * words


def test_odd_rows(spark):
    checked(ODD, ppm.scored(documents(spark, ODD)).collect())
    assert ppm.scored(emptied(spark)).count() == 0
    alone = next(i for i in range(100) if held_out(i))
    row = ppm.scored(documents(spark, [(alone, "ab")])).first()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0) and row.score == pytest.approx(3 * math.log10(1 / 256))


def trie(texts):
    found, _ = ppm.windows([ppm.words_of(t) for t in texts])
    levels = []
    for order in range(ppm.ORDER + 1):
        keys, n = np.unique(found & ((1 << 8 * (order + 1)) - 1), return_counts=True)
        total = Counter()
        for k, c in zip(keys.tolist(), n.tolist(), strict=True):
            total[k >> 8] += c
        levels.append((keys, n, np.array([total[k >> 8] for k in keys.tolist()])))
    return ppm.Trie(levels)


def test_probabilities_of_every_context_sum_to_one():
    model = trie(["the cat sat on the mat", "the dog", "a cat ate"])
    for context in (b"he cat", b"n the ", b"zzzzzz", b"\n\n\n\n\n\n", b"zzz ca"):
        key = int.from_bytes(context, "big") << 8
        assert (10 ** model.scores(key | np.arange(256))).sum() == pytest.approx(1)


def test_longer_contexts_help():
    model = trie(["the cat sat on the mat and the cat ran"] * 5)
    seen, unseen = model.text_scores([ppm.words_of("the cat sat"), ppm.words_of("tac eht tas")])
    assert seen > unseen + 5


def dictionary_model(texts):
    """The probability of a symbol after a context, with dictionaries: context -> counts of symbols, for each length."""
    counts = [{} for _ in range(ppm.ORDER + 1)]
    for text in texts:
        raw = b"\n" * ppm.ORDER + b" ".join(ppm.words_of(text)) + b"\n"
        for at in range(ppm.ORDER, len(raw)):
            for order, own in enumerate(counts):
                own.setdefault(raw[at - order : at], Counter())[raw[at]] += 1

    def kind(total, types):
        return (total - 1 if total <= ppm.EXACT else ppm.EXACT + min(int(math.log2(total / ppm.EXACT)), ppm.DOUBLINGS - 1), min(types, ppm.TYPES_APART))

    escapes = []
    for own in counts:
        left, new = Counter(), Counter()
        for symbols in own.values():
            total = sum(symbols.values())
            for n in symbols.values():
                if total > 1:
                    left[kind(total - 1, len(symbols) - (n == 1))] += n
                    new[kind(total - 1, len(symbols) - (n == 1))] += n == 1
        escapes.append({k: (new[k] + 0.5) / (n + 1) for k, n in left.items()})

    def p(symbol, context, without=frozenset()):
        order = len(context)
        symbols = counts[order].get(context)
        shorter = (lambda s: p(s, context[1:])) if order else (lambda s: 1 / 256)
        if not symbols:
            return shorter(symbol)
        total = sum(symbols.values())
        escape = escapes[order].get(kind(total, len(symbols)), 0.5)
        if symbol in symbols:
            return symbols[symbol] / total * (1 - escape)
        return escape * shorter(symbol) / (1 - sum(map(shorter, symbols)))

    def score(text):
        raw = b"\n" * ppm.ORDER + b" ".join(ppm.words_of(text)) + b"\n"
        return sum(math.log10(p(raw[at], raw[at - ppm.ORDER : at])) for at in range(ppm.ORDER, len(raw)))

    return score


def test_scores_equal_a_model_of_dictionaries(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = list(enumerate([t and t[:1500] for t in texts] + [None, "", "ab", "漢字 é \x00"]))
    model = dictionary_model([t for i, t in rows if not held_out(i)])
    wanted = {i: model(t) for i, t in rows}
    monkeypatch.setattr(ppm, "FREQUENT", 500)
    assert {r.doc_id: r.score for r in ppm.scored(documents(spark, rows)).collect()} == pytest.approx(wanted, rel=1e-9)


def test_windows_of_texts_do_not_mix():
    both, lengths = ppm.windows([[b"ab"], [], [b"c"]])
    assert lengths.tolist() == [3, 1, 2]
    assert both.tolist() == [*ppm.windows([[b"ab"]])[0], *ppm.windows([[]])[0], *ppm.windows([[b"c"]])[0]]


def test_rare_windows_count_as_in_the_whole_trie(spark, monkeypatch):
    """Scores are those of a trie with every window of the training texts, however few windows are broadcast."""
    draw = np.random.default_rng(7)
    common = "the cat sat on the mat and the dog ran to the cat " * 300
    rare = ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz é"), 60)) for _ in range(40)]
    rows = [(i, common) for i in range(100, 200)] + [(i, text) for i, text in enumerate(rare)] + [(i, text[::-1] + text) for i, text in zip(range(200, 240), rare, strict=True)]
    whole = trie([t for i, t in rows if not held_out(i)])
    wanted = dict(zip([i for i, _ in rows], whole.text_scores([ppm.words_of(t) for _, t in rows]), strict=True))
    for most in (0, 50, 2**20):
        monkeypatch.setattr(ppm, "FREQUENT", most, raising=False)
        found = ppm.scored(documents(spark, rows)).collect()
        assert len(found) == len(rows) and {r.doc_id: r.score for r in found} == pytest.approx(wanted, rel=1e-9)
