import pytest
from pyspark.sql import functions as F

from tallyworks.streaming import ingest

GOOD = "ข้อความของเอกสารหน้าหนึ่งที่ยาวพอจะอ่านได้ทั้งหน้า " * 2
PAGES = "document long, scope string, digest string, page int, text string"


@pytest.fixture
def pages(spark, tmp_path):
    """Two files, each a micro-batch: documents of good pages, of pages to read again (with and without results), and blank ones."""
    parts = [[(1, "PROJECT", "a", p, GOOD) for p in (1, 2)] + [(2, "PROJECT", "b", 1, "short"), (2, "PROJECT", "b", 2, GOOD)], [(3, "REFERENCE", "c", 1, None), (3, "REFERENCE", "c", 2, "x"), (4, "REFERENCE", "d", 1, GOOD)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    return lambda: spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def content(spark, root):
    return {name: sorted(map(str, ingest.table_of(spark, root, name).collect())) for name in ingest.TABLES}


def results(spark, *rows):
    return spark.createDataFrame(rows, "document long, page int, text string")


def test_a_flow_that_is_stopped_anywhere_ends_as_one_that_is_not(spark, pages, tmp_path, monkeypatch):
    read = results(spark, (2, 1, GOOD + "again"))
    ingest.run(pages(), read, str(tmp_path / "whole"))
    wanted = content(spark, str(tmp_path / "whole"))
    status = {r.document: r for r in ingest.table_of(spark, str(tmp_path / "whole"), "documents").collect()}
    assert {d: r.status for d, r in status.items()} == {1: "completed", 2: "completed", 3: "needs_ocr", 4: "completed"} and status[3].unread == [1, 2] and status[3].source == "SCANNED"
    assert len(wanted["outbox"]) == 2 and any("again" in c for c in wanted["chunks"]) and not any("short" in c for c in wanted["chunks"])
    put = ingest.put
    for stop in (0, 2, 4, 5):
        root, calls = str(tmp_path / f"stop{stop}"), []

        def breaking(*args, stop=stop, calls=calls):
            calls.append(1)
            if len(calls) - 1 == stop:
                raise RuntimeError("stopped")
            put(*args)

        monkeypatch.setattr(ingest, "put", breaking)
        with pytest.raises(Exception, match="stopped"):
            ingest.run(pages(), read, root)
        monkeypatch.setattr(ingest, "put", put)
        ingest.run(pages(), read, root)
        assert content(spark, root) == wanted


def test_documents_are_done_once_and_anew_when_they_change(spark, tmp_path):
    root = str(tmp_path / "flow")
    first = spark.createDataFrame([(1, "PROJECT", "a", 1, GOOD), (2, "PROJECT", "b", 1, "short")], PAGES)
    ingest.stages(first, results(spark), root)
    once = content(spark, root)
    ingest.stages(first, results(spark), root)
    assert content(spark, root) == once and len(once["outbox"]) == 1
    ingest.stages(first, results(spark, (2, 1, GOOD)), root)
    assert content(spark, root)["outbox"] == [] and len(content(spark, root)["chunks"]) == 2
    ingest.stages(spark.createDataFrame([(1, "PROJECT", "new", 1, "x")], PAGES), results(spark), root)
    assert len(content(spark, root)["chunks"]) == 1 and {r.document: r.status for r in ingest.table_of(spark, root, "documents").collect()} == {1: "needs_ocr", 2: "completed"}
    ingest.stages(first.limit(0), results(spark), root)
    assert len(content(spark, root)["documents"]) == 2
