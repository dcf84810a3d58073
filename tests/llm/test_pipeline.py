import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from tallyworks.llm import bpe, mixing
from tallyworks.llm.common import checkpointed

from ..conftest import DATA
from .cases import ODD, documents, emptied
from .test_near_dedup import brute

WHITE = " \t\n\x0b\x0c\r"


def staged(spark, docs, folder="unused"):
    """What each stage leaves, as lists of rows; the last one's are (doc_id, n_tokens, ids, decoded_sha256)."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = checkpointed(stage(spark, docs, folder))
        out.append((name, docs, docs.collect()))
    return out


def exact_brute(rows):
    """One row of each group of texts that are equal without white space: the longest, then the smallest id."""
    best = {}
    for r in rows:
        text = r.text or ""
        order = (-len(text), r.doc_id is None, r.doc_id or 0)
        key = text.translate({ord(c): None for c in WHITE})
        if key not in best or order < best[key][0]:
            best[key] = (order, r)
    return [r for _, r in best.values()]


def near_brute(rows):
    """The first of each component, and texts without words."""
    component = {i: c for i, n, c in brute([(r.doc_id, r.text) for r in rows]) if n}
    return [r for r in rows if component.get(r.doc_id, r.doc_id) == r.doc_id]


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    every = docs.collect()
    language, exact, near, mix, tokens = (rows for _, _, rows in staged(spark, docs))
    ids = lambda rows: sorted(r.doc_id for r in rows)
    assert ids(language) == ids(r for r in every if r.text and any(c.isalpha() for c in r.text))
    assert ids(exact) == ids(exact_brute(language)) and ids(near) == ids(near_brute(exact))
    sizes = {r.doc_id: len((r.text or "").split()) for r in near}
    taken, of = Counter(r.doc_id for r in mix), {r.doc_id: r.source for r in near}
    assert max(taken.values()) <= 3 and set(taken) <= set(of)
    targets = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(near, docs.schema)).collect()}
    for source, target in targets.items():
        words = sum(n * sizes[i] for i, n in taken.items() if of[i] == source)
        assert abs(words - target) <= max((sizes[i] for i in of if of[i] == source), default=0) * 8
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    plain.no_truncation()
    text = {r.doc_id: r.text for r in near}
    assert Counter(r.doc_id for r in tokens) == taken
    for r in tokens:
        ids_of = plain.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids_of and r.n_tokens == len(ids_of)
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(ids_of, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_what_the_stages_give(spark):
    found = corpus_pipeline.run(spark, DATA)
    assert found.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    last = staged(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)[-1][2]
    assert sorted(map(str, found.collect())) == sorted(map(str, last))


def test_odd_rows_pass_or_go_as_the_stages_say(spark):
    """Null ids and texts, repeated rows, long texts, and columns with clashing names."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [*((i, t, "en", s) for n, (i, t) in enumerate(ODD) for s in ["a" if n % 2 else None]), (None, "a text of its own without an id", "en", "a"), (20, text, "en", "a"), (21, text + " x", "en", "a"), (22, text + " ", "en", "a")]
    docs = documents(spark, rows)
    found = staged(spark, docs)
    for _, frame, _ in found[:-1]:
        assert frame.columns == docs.columns
    language, exact, near = ([(r.doc_id, r.text) for r in rows] for _, _, rows in found[:3])
    assert len(language) == len([t for _, t, *_ in rows if t and any(c.isalpha() for c in t)])
    assert (None, "a text of its own without an id") in near and language.count((4, "a")) == 2 and exact.count((4, "a")) == 1
    # of the equal texts of 20 and 22 the longer one stays, and of those that are alike the smaller id
    assert sorted(i for i, _ in exact if i in (20, 21, 22)) == [21, 22] and [i for i, _ in near if i in (20, 21, 22)] == [21]


def test_no_documents(spark):
    assert [len(rows) for _, _, rows in staged(spark, emptied(spark))] == [0] * 5
