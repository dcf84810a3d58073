"""Documents with all that operators must get along with."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, digest string, score double, n int"


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); further columns have names that operators use themselves."""
    full = [(*r, *[None, None][len(r) - 2 :], None if r[1] is None else len(r[1]), "own", "own", "own", 0.5, 7) for r in (tuple(r) for r in rows)]
    return spark.createDataFrame(full, DOCS)


WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS * 400)
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "b c"), (5, "x" * 100_000), (6, LONG), (7, "😀 é 漢字 \x00 z"), (8, "Ünï cödé")]


def emptied(spark):
    return spark.createDataFrame([], DOCS)
