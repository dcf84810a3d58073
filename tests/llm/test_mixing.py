import re

import pytest

from tallyworks.llm import mixing

from ..compare import same_rows
from ..conftest import DATA
from .cases import ODD, documents, emptied


def targets(sizes, weights=(1, 2, 3), most=3):
    """Excess over the caps goes to the others by weight, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > most * sizes[s] + 1e-9]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        for s in over:
            capped[s] = most * sizes[s]
            left -= capped[s]


def test_query_equals_sql(spark, duck):
    same_rows(mixing.op5_source_mix(spark, DATA), duck.sql(mixing.ORACLE))


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_targets_and_copies(spark, broadcast, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = [(i, "w " * (1 + i % 7), None, f"s{min(i % 50, 6)}" if i % 11 else None) for i in range(3000)]
    found = mixing.with_copies(documents(spark, rows)).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"\S+", r[1]))
    wanted = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert len(found) == len(rows)
    for r in found:
        assert r.target == pytest.approx(wanted[r.row.source]) and r.source_size == sizes[r.row.source] and 0 <= r.copies <= 3
        taken[r.row.source] += r.size * r.copies
    assert sum(wanted.values()) == pytest.approx(sum(sizes.values()))
    assert all(taken[s] == pytest.approx(wanted[s], rel=0.1, abs=30) for s in sizes)
    again = mixing.with_copies(documents(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in found)


def test_odd_rows(spark):
    docs = documents(spark, [(*r, "en", "b" if i % 2 else None) for i, r in enumerate(ODD)])
    found = mixing.with_copies(docs).collect()
    assert len(found) == len(ODD) and {r.size for r in found if r.doc_id in (1, 2, 3)} == {0}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in found)
    assert mixing.mix(emptied(spark)).count() == 0 == mixing.with_copies(emptied(spark)).count()
    nothing = mixing.with_copies(documents(spark, [(1, None, "en", "a"), (2, " ", "en", "b")])).collect()
    assert [(r.target, r.size) for r in nothing] == [(0.0, 0)] * 2


def test_plan_has_no_python(spark):
    plan = mixing.op5_source_mix(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_totals_before_equal_brute_force_over_many_ranges(spark):
    rows = [(None if i == 7 else f"s{i * 7919 % 500:03}", i % 13) for i in range(500)]
    frame = spark.createDataFrame(rows, "source string, n long").repartition(5)
    order = [mixing.F.col("source").asc_nulls_last()]
    found = {r.source: (r.place, r.total) for r in mixing.with_totals_before(frame, order, {"place": mixing.F.lit(1), "total": mixing.F.col("n")}).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    assert found == {source: (i, sum(n for _, n in ordered[:i])) for i, (source, _) in enumerate(ordered)}
