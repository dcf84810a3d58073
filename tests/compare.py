from decimal import Decimal


def shown(value) -> str:
    if isinstance(value, Decimal):
        return str(value.normalize()) if value else "0"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(shown, value)) + "]"
    return repr(value) if isinstance(value, float) else str(value)


def same_rows(spark_df, relation) -> None:
    """The rows of both, in any order, with columns by name."""
    columns = sorted(spark_df.columns)
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    ours = sorted(tuple(shown(row[c]) for c in columns) for row in spark_df.collect())
    theirs = sorted(tuple(shown(row[i]) for i in places) for row in relation.fetchall())
    assert ours == theirs
