import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyworks.llm import bpe

from ..conftest import DATA
from .cases import ODD, documents, emptied

PATH = bpe.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.Vocabulary(PATH)


def same(texts):
    encoder = bpe.Encoder(VOCABULARY, remembered=50)
    ids, counts = encoder.encode(texts)
    ends = np.append(0, np.cumsum(counts))
    decoded = bpe.decode(ids, counts, VOCABULARY)
    for i, text in enumerate(texts):
        wanted = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert ids[ends[i] : ends[i + 1]].tolist() == wanted, text
        assert decoded[i] == LIBRARY.decode(wanted, skip_special_tokens=False) == (text or "")


def test_odd_texts():
    same([None, "", "a", "aaaa" * 300, "ab" * 5000, "!" * 5001, "<|endoftext|>x<|endoftext|>", "x<|endoftext", " \x1c\x85 y\xa0z　\n\n  x \t", "I'll 'S've 12½²³ ٣٤ éà漢字 😀", "\x00﻿​", " ", "\n", "  "])


@pytest.mark.parametrize("seed", range(3))
def test_any_text(seed):
    draw = random.Random(seed)
    letters = [chr(draw.choice([draw.randrange(32, 127), draw.randrange(1, 0x300), draw.randrange(0x300, 0x3000), draw.randrange(0x1F300, 0x1F700), 32, 10, 9, 0x85, 0xA0])) for _ in range(2000)]
    same(["".join(draw.choices(letters, k=draw.randrange(1, 200))) for _ in range(150)])


def test_unknown_ids_and_broken_bytes():
    e = VOCABULARY.of_byte[0xC3]
    assert bpe.decode(np.array([e, -1, 10**6, 50256]), np.array([3, 1]), VOCABULARY) == ["�", "<|endoftext|>"]


def test_query_equals_library(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for row in bpe.op10_bpe(spark, DATA).collect():
        ids = LIBRARY.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    rows = bpe.tokenised(documents(spark, ODD)).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in rows) == sorted((str(i), t or "") for i, t in ODD)
    assert bpe.tokenised(emptied(spark)).count() == 0
    null = spark.createDataFrame([(None,), ([1, None],)], "ids array<int>").select(bpe.decoder(PATH)("ids").alias("t")).collect()
    assert [r.t for r in null] == ["", LIBRARY.decode([1])]


def test_the_pipeline_decodes_what_it_encodes(spark):
    import corpus_pipeline

    texts = ["some words of a text", "", None]
    rows = {r.doc_id: r for r in corpus_pipeline.tokens(spark, documents(spark, list(enumerate(texts))), "").collect()}
    assert [rows[i].decoded_sha256 for i in range(3)] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
