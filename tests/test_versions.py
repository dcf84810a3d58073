import pytest
from pyspark.sql import functions as F

from tallyworks.sources import versions

SCHEMA = "id long, name string, n int, updated_at timestamp"


def rows(df):
    return sorted((r.id, r.name, r.n) for r in df.collect())


@pytest.fixture
def people(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = spark.range(100).select("id", F.format_string("p%d", "id").alias("name"), F.col("id").cast("int").alias("n"), F.lit("2020-01-01").cast("timestamp").alias("updated_at"))
    assert versions.write(frame, path, "id", ranges=5) == 0
    return path


def updates(spark, *some):
    return spark.createDataFrame(list(some), "id long, name string, n int")


def test_a_merge_rewrites_only_its_ranges(spark, people):
    before = versions.snapshot(spark, people)
    assert len(before["files"]) == 5 and versions.read(spark, people).count() == 100
    now = F.lit("2021-06-01").cast("timestamp")
    assert versions.merge(updates(spark, (3, None, -3), (1, "new", None), (-7, "first", 7)), people, ["id"], now=now) == 1
    after = versions.snapshot(spark, people)
    assert after["files"][1:] == before["files"][1:] and after["files"][0] != before["files"][0]
    found = {r.id: r for r in versions.read(spark, people).collect()}
    assert len(found) == 101 and (found[3].name, found[3].n) == ("p3", -3) and (found[1].name, found[1].n) == ("new", 1) and found[-7].name == "first"
    assert {i for i, r in found.items() if r.updated_at.year == 2021} == {3, 1, -7}
    assert versions.merge(updates(spark, (99, None, 1)), people, ["id"], now=now, fill=False) == 2
    assert next(r for r in versions.read(spark, people).collect() if r.id == 99).name is None
    assert versions.read(spark, people, 0).count() == 100 and versions.merge(updates(spark).limit(0), people, ["id"], now=now) == 2
    with pytest.raises(ValueError, match="laid out"):
        versions.merge(updates(spark, (1, "a", 1)), people, ["name"], now=now)


@pytest.mark.parametrize("step", ["_written", "_publish", "put", "create"])
def test_a_crash_leaves_the_old_table(spark, people, monkeypatch, step):
    """Stopped before any step, or between the draft of a snapshot and its place: readers find what was there, and the next writer goes on."""
    wanted = rows(versions.read(spark, people))

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        if step == "create":
            patch.setattr(versions.Folder, "put", lambda self, name, text: (self.system.create(self.at("snapshots/.draft"), True).close(), stop()))
        else:
            patch.setattr(versions.Folder if step == "put" else versions, step, stop)
        with pytest.raises(KeyboardInterrupt):
            versions.merge(updates(spark, (3, "x", 0)), people, ["id"], now=F.current_timestamp())
    assert rows(versions.read(spark, people)) == wanted and versions.latest(spark, people) == 0
    assert versions.merge(updates(spark, (3, "x", 0)), people, ["id"], now=F.current_timestamp()) == 1
    assert (3, "x", 0) in rows(versions.read(spark, people))


def test_two_writers_at_once(spark, people, monkeypatch):
    """The second one finds its number taken and does its merge again, on what the first one has left."""
    publish, other = versions._publish, []

    def late(*rest):
        if not other:
            other.append(1)
            versions.merge(updates(spark, (4, "other", 40)), people, ["id"], now=F.current_timestamp())
        return publish(*rest)

    monkeypatch.setattr(versions, "_publish", late)
    assert versions.merge(updates(spark, (3, "mine", 30)), people, ["id"], now=F.current_timestamp()) == 2
    found = rows(versions.read(spark, people))
    assert (3, "mine", 30) in found and (4, "other", 40) in found and len(found) == 100


def test_a_snapshot_is_put_once(spark, people):
    folder = versions.Folder(spark, people)
    with pytest.raises(versions.Conflict):
        folder.put("snapshots/0000000000", "{}")
    assert versions.snapshot(spark, people)["version"] == 0 and all(not n.startswith(".") or n.endswith(".crc") for n in folder.names("snapshots"))


def test_other_keys_and_empty_tables(spark, tmp_path):
    names = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("c", 4), ("c", 5)], "k string, n int")
    path = str(tmp_path / "names")
    versions.write(names, path, "k", ranges=3)
    assert sorted(r.n for r in versions.read(spark, path).collect()) == [1, 2, 3, 4, 5]
    versions.merge(spark.createDataFrame([("c", 9), (None, 7), ("d", 8)], "k string, n int"), path, ["k"], fill=False)
    assert sorted((str(r.k), r.n) for r in versions.read(spark, path).collect()) == [("None", 3), ("None", 7), ("a", 2), ("b", 1), ("c", 9), ("d", 8)]
    empty = str(tmp_path / "none")
    versions.write(names.limit(0), empty, "k")
    assert versions.read(spark, empty).count() == 0 and versions.read(spark, empty).columns == ["k", "n"]
    versions.merge(names.filter("k = 'a'"), empty, ["k"])
    assert versions.read(spark, empty).count() == 1
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "nothing"))
