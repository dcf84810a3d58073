import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyworks.llm import near_dedup

from ..conftest import DATA
from .cases import ODD, documents, emptied


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return set(zip(*[words[i:] for i in range(5)], strict=False)) if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for at, (i, own) in enumerate(sets):
        shared = Counter(j for s in own for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(own) + len(sets[j][1]) - n):
                a, b = root(i), root(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for s in own:
            holders[s].append(at)
    return sorted((i, len(own), root(i) if own else i) for i, own in sets)


def found(spark, rows):
    return sorted(tuple(r) for r in near_dedup.grouped(documents(spark, rows)).collect())


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in near_dedup.op4_near_duplicates(spark, DATA).collect()) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_equal_brute_force(spark, seed):
    """Copies of copies, passages that many share, and short texts, with similarities around the limit."""
    draw = random.Random(seed)
    word = lambda: f"v{draw.randrange(5000)}"
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(draw.choice([3, 5, 8, 20, 60, 150]))] for _ in range(25)]
    rows = []
    for i in range(400):
        text = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
            text[draw.randrange(len(text))] = word()
        if draw.random() < 0.3:
            text = text[:5] + passage + text[5:]
        if draw.random() < 0.2:
            bases.append(text)
        rows.append((i, " ".join(text).upper() if draw.random() < 0.2 else "\n".join(text)))
    assert found(spark, rows) == brute(rows)


def test_limit_is_exact(spark):
    words = [f"w{i}" for i in range(200)]
    at_limit = words[:16] + ["x"]  # 12 and 13 shingles, 12 shared: above; without more words 9 of 12 and so on
    rows = [(1, " ".join(words[:16])), (2, " ".join(at_limit)), (3, " ".join(words[100:107])), (4, " ".join(words[100:108])), (5, " ".join(words[100:109]))]
    assert found(spark, rows) == brute(rows)
    assert {c for i, _, c in found(spark, rows) if i in (3, 4)} == {3}  # 3 of 4 shingles: just enough


def test_odd_rows(spark):
    rows = found(spark, [r for r in ODD if r[0] is not None])
    assert rows == brute([r for r in ODD if r[0] is not None])
    with_null = near_dedup.grouped(documents(spark, ODD)).collect()
    assert len(with_null) == len(ODD) and [(r.n_shingles, r.component_id) for r in with_null if r.doc_id is None] == [(1, None)]
    assert near_dedup.grouped(emptied(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = documents(spark, [(3, text), (2, text + " x"), (9, "other words that are not alike here"), (8, None), (7, "")])
    kept = near_dedup.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 8, 9] and kept.columns == docs.columns


def test_rows_without_ids_and_with_shared_ids_stay_or_go_one_by_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    alone = [f"a text {i} that is like no other one of row {i}" for i in range(3)]
    rows = [(None, alone[0]), (None, alone[1]), (None, None), (None, ""), (5, text), (5, text + " x"), (None, text + " y"), (6, text + " z"), (6, alone[2]), (7, "b c"), (7, "b c")]
    kept = [(r.doc_id, r.text) for r in near_dedup.keep_one(documents(spark, rows)).collect()]
    linked = [r for r in kept if r[1] and r[1].startswith(text)]
    assert len(linked) == 1 and linked[0][0] == 5
    assert sorted(map(str, (r for r in kept if r not in linked))) == sorted(map(str, [(None, alone[0]), (None, alone[1]), (None, None), (None, ""), (6, alone[2]), (7, "b c")]))
    copies = near_dedup.keep_one(documents(spark, [(None, text), (None, text), (None, text + " x")])).collect()
    assert len(copies) == 1


def test_prefixes_share_what_they_must():
    """Of two sets that link, the parts of the prefixes that the pair needs share enough tokens, whatever the matches."""
    draw = np.random.default_rng(3)
    for _ in range(300):
        n = int(draw.integers(1, 200))
        x = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([draw.choice(x, max(1, int(len(x) * draw.uniform(0.7, 1))), replace=False), draw.integers(0, 2**63, int(draw.integers(0, n // 4 + 1))).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 75 * (len(x) + len(y) - shared):
            continue
        codes = draw.integers(0, 40, 1 << near_dedup.SKETCH_BITS).astype(np.uint8)
        (p, l1), (q, l2) = (near_dedup.prefix_of(s, near_dedup.excess_of(codes, s)) for s in (x, y))
        t = -(-75 * (len(x) + len(y)) // 175)
        m = min(l1, l2)
        assert len(x) - t + m <= len(p) and len(y) - t + m <= len(q)
        assert len(np.intersect1d(p[: len(x) - t + m], q[: len(y) - t + m])) >= m


def test_pairs_that_link_share_a_token_that_neither_leaves_out():
    """Whatever the frequencies, enough tokens are left of what the prefixes of two sets that link share."""
    draw = np.random.default_rng(8)
    linked = 0
    for _ in range(400):
        n = int(draw.integers(1, 900))
        x = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([draw.choice(x, max(1, int(len(x) * draw.uniform(0.74, 1))), replace=False), draw.integers(0, 2**63, int(draw.integers(0, n // 4 + 1))).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 75 * (len(x) + len(y) - shared):
            continue
        linked += 1
        codes = draw.integers(0, 60, 1 << near_dedup.SKETCH_BITS).astype(np.uint8)
        classes = dict(zip(np.union1d(x, y).tolist(), draw.integers(1, 4, len(np.union1d(x, y))).tolist(), strict=True))
        t, prefixes, asked = -(-75 * (len(x) + len(y)) // 175), [], []
        for s in (x, y):
            prefix, matches = near_dedup.prefix_of(s, near_dedup.excess_of(codes, s))
            asked.append(matches)
            prefixes.append(prefix.tolist())
        need = [-(-75 * len(s) // 100) for s in (x, y)]
        m = min(t - n + asked_for for n, asked_for in zip(need, asked, strict=True))
        out = max(m - near_dedup.LEFT, 0)
        assert all(max(near_dedup.spare(n) + near_dedup.MORE[0] - near_dedup.MORE[-1], 0) <= out for n in need)
        kept = [set(sorted(prefix, key=lambda w: (classes[w], w))[: len(prefix) - out]) for prefix in prefixes]
        assert len(set(prefixes[0]) & set(prefixes[1])) >= m and len(kept[0] & kept[1]) >= m - out >= 1
    assert linked > 100


def test_passages_that_many_share_make_few_pairs(spark):
    """Texts that have a passage in common, and hardly anything else, aren't paired for it."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(500)) + " " + passage) for i in range(150)]
    docs = documents(spark, rows)
    codes = np.zeros(1 << near_dedup.SKETCH_BITS, np.uint8)
    tokens = near_dedup.in_arrow(docs.select("text"), near_dedup.tokens_of(codes, 4), near_dedup.TOKENS).repartition(4, "bucket").drop("bucket")
    postings = near_dedup.in_arrow(tokens, near_dedup.shared_tokens, near_dedup.POSTINGS).distinct()
    assert postings.count() > 1000 and near_dedup.searched(postings).count() == 0


def test_hot_tokens_are_searched_like_others(spark, monkeypatch):
    draw = random.Random(6)
    base = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(draw.choice([0, 1, 2, 8])):
            words[draw.randrange(60)] = f"u{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near_dedup, "HOT", 5)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [1, 7, 8, 15, 16, 17, 100, 1000])
def test_bitmaps_pass_every_pair_that_links(size):
    draw = np.random.default_rng(size)
    passed = []
    for lost in [0, size // 8, size // 7, size // 6, size // 4, size]:
        own = np.unique(draw.integers(0, 2**64, size, np.uint64))
        for added in [0, lost]:
            other = np.unique(np.append(own[lost:], draw.integers(0, 2**64, max(added, int(lost == size)), np.uint64)))
            passed.append(near_dedup.may_link(near_dedup.bitmap(own), near_dedup.bitmap(other)))
            assert passed[-1] or not near_dedup.similar(near_dedup.whole(own), near_dedup.whole(other))
    assert passed[0] and not passed[-1]
