import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyworks.llm import alignment
from tallyworks.llm.bpe import Vocabulary, tokenizer_path

from ..conftest import DATA
from .cases import ODD, documents, emptied

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
LIBRARY, MODEL, VOCABULARY = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), Vocabulary(A)
LIBRARY.encode_special_tokens = True
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def intervals(text):
    """Both lists of (id, bytes) by the libraries, or none if the bytes of one differ from the text's."""
    if not text:
        return [], []
    raw, of = (" " + text).encode(), VOCABULARY
    a = [(i, of.bytes[of.starts[i] : of.starts[i] + of.lengths[i]].tobytes()) for i in LIBRARY.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if MODEL.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, MODEL.id_to_piece(i)) for i in MODEL.encode(text))]
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def brute(texts):
    """The contract's columns of every text, by plain loops."""
    found, counts = [], Counter()
    for text in texts:
        spans = []
        for tokens in intervals(text):
            at, own = 0, []
            for i, raw in tokens:
                own.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(own)
        links, low = [], 0
        for i, s, e in spans[0]:
            while low < len(spans[1]) and spans[1][low][2] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = grouped(spans, ends)
        counts.update(links)
        found.append((len(spans[0]), len(spans[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(a, b, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest) for a, b, g, links, digest in found]


def grouped(spans, ends):
    """What both kinds of tokens have between one common end and the next."""
    lists = [[[] for _ in ends] for _ in spans]
    for own, out in zip(spans, lists, strict=True):
        for (i, _, _), g in zip(own, np.searchsorted(ends, [e for _, _, e in own]), strict=True):
            out[g].append(str(i))
    return ["|".join(",".join(x[g]) for x in lists) for g in range(len(ends))]


SOME = ["<|endoftext|> a <s> b</s> <unk>", "▁x ▁", " leading  blanks\t\tand\n\n\nlines ", "naïve Straße 漢字仮名 😀👍🏽", "12345678901234567890", "I'll've don't", "a" * 700, "trailing blank ", "two  \n", "\x00\x01", "﻿bom", "é ﬁ Ａ", " "]


@pytest.mark.parametrize(("window", "frequent", "held"), [(600_000, 1 << 21, 2_000_000), (20, 1 << 21, 10), (100, 50, 2_000_000), (600_000, 0, 100)])
def test_equals_brute_force(spark, monkeypatch, window, frequent, held):
    """Whole texts or small windows; counts broadcast, joined, or some of both."""
    rows = [*ODD[:7], *ODD[8:], *((20 + i, t) for i, t in enumerate(SOME)), (90, SOME[3]), (90, SOME[2])]
    if window > 100:
        rows.append(ODD[7])
        rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    wanted = brute([t for _, t in rows])
    of = alignment.aligning

    def smaller(*paths):
        def align(batches):
            alignment.WINDOW, alignment.HELD = window, held
            yield from of(*paths)(batches)

        return align

    monkeypatch.setattr(alignment, "aligning", smaller)
    found = alignment.align(documents(spark, rows).repartition(3), frequent=frequent).collect()
    assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in found) == sorted((str(i), *w) for (i, _), w in zip(rows, wanted, strict=True))


def test_windows_and_forgetting_give_the_same(monkeypatch):
    texts = [" ".join(SOME) * 5, "", None, *SOME, "漢字仮名" * 50, "a b  c \n", " \n x", "x ", "a\tb \u3000c\x1cd e\x85 f"]
    whole, small = alignment.Aligner(A, B), alignment.Aligner(A, B)
    wanted = whole.aligned(texts)
    for name, value in (("WINDOW", 7), ("HELD", 5), ("PIECE", 40), ("REMEMBERED", 3)):
        monkeypatch.setattr(alignment, name, value)
    assert [row for text in texts for row in small.aligned([text])] == wanted
    uncut = alignment.Aligner(A, B)
    uncut.segments = lambda text: [text]
    assert uncut.aligned(texts) == wanted
    counts = []
    for own in (whole, small, uncut):
        rows = [x for data in own.counts() for x in zip(*map(np.ndarray.tolist, alignment.unpacked(data)), strict=True)]
        counts.append(dict(rows))
        assert len(counts[-1]) == len(rows) and sum(counts[-1].values()) == sum(w[3] for w in wanted)
    assert counts[0] == counts[1] == counts[2]


def test_empty_table(spark):
    assert alignment.align(emptied(spark)).count() == 0


def test_packing():
    keys, uses = np.array([5, 1 << 40, 7, 0]), np.array([1, 2, 3, 1 << 50])
    k, u = alignment.unpacked(alignment.packed(keys, uses))
    assert k.tolist() == sorted(keys) and u.tolist() == [1 << 50, 1, 3, 2]
    assert [len(x) for x in alignment.unpacked(alignment.packed(keys[:0], uses[:0]))] == [0, 0]
