import numpy as np

from tallyworks.llm import language

from ..conftest import DATA
from .cases import ODD, documents, emptied


def test_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = [r for r in language.op3_language_id(spark, DATA).collect() if r.held_out]
    assert len(rows) > 20 and np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.9


def test_odd_rows(spark):
    train = documents(spark, [(1, "the cat sat on the mat and ran", "en"), (2, "der hund und die katze sind nicht hier", "de"), (3, None, "fr"), (4, "qui", None)])
    rows = language.identified(documents(spark, ODD), train).collect()
    found = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == len(ODD) and found[1] == found[2] == found[3] == ("und", 0.0)
    assert found[5][0] in ("en", "de") and all(0 <= s <= 1 for _, s in found.values())
    assert language.identified(emptied(spark)).count() == 0
    assert {r.lang_pred for r in language.identified(documents(spark, ODD)).collect()} == {"und"}  # nothing to learn from
    kept = language.keep_identified(documents(spark, [(1, "the cat", "en"), (2, "12 34", "en"), (3, None, "en")]))
    assert [(r.doc_id, r.row, r.score) for r in kept.collect()] == [(1, "own", 0.5)]


def test_filters_hold_every_member_and_chance_is_corrected(spark):
    words = [f"{a}{b}{c}{d}" for a in "abcde" for b in "fghij" for c in "klmno" for d in "pqrst"]
    train = documents(spark, [(i, " ".join(words[i::70]), f"l{i:02}") for i in range(70)])  # more languages than bits
    model = language.learn(train)
    assert model.languages == [f"l{i:02}" for i in range(70)] and model.masks.shape[0] == 2
    names, _ = model.predict([" ".join(words[i::70]) for i in range(70)])
    assert names == model.languages
    assert (model.rates < 1e-4).all()


def test_short_and_mixed_texts():
    assert list(language.grams(language.cleaned("a"))) == [int.from_bytes(b" a  ", "big")]
    assert language.cleaned("É1é—x") == " é é— x ".replace(" é é— x ", " é é—x ").encode()
    assert language.has_letter("1é") and not language.has_letter("12 —") and not language.has_letter(None)


def test_every_gram_of_a_language_is_found(spark):
    """The first filter has full recall, however rare an n-gram is; beyond it only chance sets bits."""
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text and r.lang]
    model = language.learn(documents(spark, [(i, t, g) for i, (t, g) in enumerate(rows)]))
    held = {g: set() for g in model.languages}
    for text, lang in rows:
        held[lang] |= set(language.grams(language.cleaned(text)).tolist())
    every = np.array(sorted(set().union(*held.values())), np.uint64)
    places = np.uint64(32 - (model.masks.shape[2].bit_length() - 1))
    for k, lang in enumerate(model.languages):
        found = np.ones(len(every), bool)
        for factor in language.FACTORS:
            found &= (model.masks[k // 64, 0][(every * np.uint64(factor) & np.uint64(0xFFFFFFFF)) >> places] >> np.uint64(k % 64) & np.uint64(1)).astype(bool)
        own = np.isin(every, np.array(sorted(held[lang]), np.uint64))
        assert found[own].all() and abs(found[~own].mean() - model.rates[0, k]) < 0.1
