import hashlib
import re

import pytest

from tallyworks.llm import exact_dedup

from ..compare import same_rows
from ..conftest import DATA
from .cases import ODD, documents, emptied


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest(), []).append((-len(t or ""), i is None, i))
    return {d: (min(g)[2] if not min(g)[1] else None, len(g)) for d, g in groups.items()}


def checked(rows, decided):
    assert len(decided) == len(rows)
    groups = brute(rows)
    for row in decided:
        assert (row.keep_id, row.group_size) == groups[row.digest.hex()]
    for digest in groups:
        kept = [r for r in decided if r.digest.hex() == digest and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == groups[digest][0]


def test_query_equals_sql(spark, duck):
    same_rows(exact_dedup.op7_exact_dedup(spark, DATA), duck.sql(exact_dedup.ORACLE))


@pytest.mark.parametrize("counters", [1, 3, 256])
def test_heavy_and_light_groups(spark, counters):
    rows = [*ODD, *[(100 + i, "hot  text" + " " * (i % 3)) for i in range(60)], *[(200 + i, f"t{i // 2}") for i in range(40)], (300, "hottext"), (300, "hottext")]
    docs = documents(spark, rows).repartition(5)
    checked(rows, exact_dedup.decisions(docs, counters).collect())
    kept = exact_dedup.drop_copies(docs, counters)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _ in brute(rows).values())


def test_summaries_keep_all_frequent_digests():
    digests = [b"a"] * 40 + [b"b"] * 30 + [b"%d" % i for i in range(50)]
    counts = exact_dedup._trimmed(exact_dedup.Counter(digests), 2)
    assert set(counts) == {b"a", b"b"} and counts[b"a"] == 39


def test_no_documents(spark):
    assert exact_dedup.decisions(emptied(spark)).count() == 0 == exact_dedup.drop_copies(emptied(spark)).count()
