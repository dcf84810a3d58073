from tallyworks.streaming import counters, gate

SCHEMA = "source string, labels string, at long, value double"


def test_a_stream_of_scrapes_equals_the_batch(spark, tmp_path):
    """Counters that go on, begin anew, and stand still; one scrape twice, one without a value."""
    rows = [("a", "x", t, v) for t, v in enumerate([1.0, 3.0, 3.0, 0.5, 2.0, 2.5])] + [("a", "y", t, v) for t, v in enumerate([5.0, 1.0, 4.0])] + [("b", "x", 9, 2.0), ("b", "x", 10, None), ("b", None, 1, 1.0), ("a", "y", 1, 0.5)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = sorted(map(tuple, counters.changes(frame).collect()))
    assert found == [("a", "x", 1, 2.0), ("a", "x", 2, 0.0), ("a", "x", 3, 0.5), ("a", "x", 4, 1.5), ("a", "x", 5, 0.5), ("a", "y", 1, 1.0), ("a", "y", 2, 3.0)]
    parts = [frame.filter("at <= 1"), frame.filter("at > 1 and at <= 3"), frame.filter("at > 3").unionByName(spark.createDataFrame([("a", "x", 0, 99.0), ("a", "y", 2, 50.0)], SCHEMA))]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / str(i)))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*"))
    assert sorted(map(tuple, gate.run_once(counters.changes(stream)).collect())) == found
