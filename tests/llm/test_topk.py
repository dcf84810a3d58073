import math
import random

import numpy as np
import pytest

from tallyworks.llm import topk

from ..compare import same_rows
from ..conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, every, k):
    """All pairs: each row that is usable is a candidate, and each different row of a query's id a query."""
    good = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in e)) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    out = []
    for q, a in {(i, e) for i, e in good if i % every == 0}:
        best = sorted((-clip(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in good if i != q and len(a) == len(b))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best[:k], 1)]
    return sorted(out)


def found(spark, rows, every=5, k=5, block=3, components=200):
    vectors = spark.createDataFrame([(i, e, 0, "x") for i, e in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in topk.search(vectors, vectors.filter(f"vec_id % {every} = 0"), k, block, components).collect())


def test_query_equals_sql(spark, duck):
    same_rows(topk.op1_topk_search(spark, DATA), duck.sql(topk.ORACLE))


@pytest.mark.parametrize("dims", [1, 3, 64])
def test_equals_brute_force(spark, dims):
    draw = random.Random(dims)
    rows = [(i, [draw.choice([draw.gauss(0, 1), 0.5, -0.5]) for _ in range(dims)]) for i in range(120)]  # many ties
    assert found(spark, rows) == brute(rows, 5, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [None, 1.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0]), (10, [1.0, 2.0]), (10, [9.0, 9.0]), (11, [3e38, -3e38]), (15, [3e38, 3e38])]
    assert found(spark, rows, k=3) == brute(rows, 5, 3)
    assert found(spark, []) == found(spark, [(1, [1.0])]) == []
    repeated = [(i, [x]) for i, x in ((0, 1.0), (1, 2.0), (1, 2.0), (2, 1.0), (0, 3.0))]
    assert found(spark, repeated) == brute(repeated, 5, 5) and len(found(spark, repeated[:4])) == 3


def test_bounds_hold(spark):
    draw = np.random.default_rng(1)
    a, b = (np.floor(256 * draw.normal(size=(50, 37))) for _ in range(2))
    for segments in (1, *topk.LEVELS, 37, 99):
        assert (topk.statistics(a, segments) @ topk.statistics(b, segments).T + 1e-3 >= a @ b.T).all()


def test_few_pairs_of_the_given_vectors_reach_the_exact_score(spark):
    rows = spark.read.parquet(DATA.replace("sf0.001", "sf0.1") + "/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), topk.scaled([r.embedding for r in rows])
    asked = ids % 50 == 0
    searcher = topk.Searcher(ids[asked], vectors[asked], 5)
    searcher.add(ids, vectors)
    assert searcher.verified < 0.1 * asked.sum() * len(rows)
    scores = vectors[asked] @ vectors.T
    scores[ids[asked, None] == ids] = -np.inf
    assert (searcher.best[:, 1].reshape(-1, 5) == -np.sort(-scores, axis=1)[:, :5]).all()
