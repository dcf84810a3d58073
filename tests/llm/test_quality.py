import numpy as np
import pyarrow as pa

from tallyworks.llm import quality

from ..conftest import DATA
from .cases import ODD, documents, emptied


def test_held_out_labels_are_predicted(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in quality.op2_quality(spark, data).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0), (None, 1), (6, 5)], "doc_id long, quality int")
    rows = quality.scored(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD) and len({r.score for r in rows}) == 1
    assert quality.scored(emptied(spark), labels).count() == 0 and quality.scored(docs, labels.limit(0)).first().score == 0.5


def test_network_learns_and_is_calibrated():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(4000, quality.FEATURES))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (draw.random(4000) < p).astype(float)
    scores = quality.fit(x, y).scores(x)
    assert abs(scores.mean() - y.mean()) < 0.03 and np.corrcoef(scores, p)[0, 1] > 0.9
    for low in (0.0, 0.25, 0.5, 0.75):
        of = (scores >= low) & (scores < low + 0.25)
        assert abs(y[of].mean() - scores[of].mean()) < 0.1


def test_contexts_tell_words_apart():
    tokens = quality._Tokens()
    rows = quality.added(quality.contexts_of(*quality.token_numbers(["the cat sat . the dog sat . the cat ran . the dog ran ."] * 9 + ["1 2 3 4"] * 9, tokens)))
    v = {int(r["word"]): r["vector"] / max(np.linalg.norm(r["vector"]), 1e-9) for r in rows}
    cat, dog, two = (v[tokens[w]] for w in ("cat", "dog", "2"))
    assert cat @ dog > 0.95 > cat @ two


def test_contexts_equal_brute_force_however_they_are_summed(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()][:40] + [None, "", "a", "b a"]
    tokens, wanted = quality._Tokens(), {}
    for text in texts:
        words = [tokens[w] for w in quality.TOKEN.findall(text or "")]
        for i, w in enumerate(words):
            uses, vector = wanted.setdefault(w, [0, np.zeros(quality.DIMS, int)])
            wanted[w][0] = uses + 1
            for j in range(max(0, i - quality.REACH), min(len(words), i + quality.REACH + 1)):
                for mark in range(quality.MARKS):
                    bits = words[j] >> 8 + 8 * mark
                    vector[bits & quality.DIMS - 1] += (1 - 2 * (bits >> 6 & 1)) * (j != i)
    sums = quality.Sums()
    for text in texts[::-1]:
        sums.add(quality.contexts_of(*quality.token_numbers([text], tokens)))
    rows = sums.clear()
    assert rows["word"].tolist() == sorted(wanted) and all(wanted[int(r["word"])][0] == r["uses"] and (wanted[int(r["word"])][1] == r["vector"]).all() for r in rows)


def test_vectors_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one, other = (quality.word_vectors(docs.repartition(n)) for n in (1, 7))
    assert (one.words == other.words).all() and (one.rows == other.rows).all() and len(one.words) > 1000
    rare = np.array([8 * 12345 + 6], np.uint64)
    assert one.of(one.words[:3]).tolist() == [0, 1, 2] and one.of(rare)[0] >= len(one.words)


def test_tokens_are_those_of_the_pattern():
    every = "".join(chr(i) + ("a" if i % 3 else "") for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    texts = [r[1] for r in ODD] + [None, "a" * 300 + " " + "a" * 301 + "! !!", "end", "", "x", "\x1c\x85_a²½"] + [("ab" * 100 + " ") * 700]
    tokens = quality._Tokens()
    for some in ([every], texts, texts[::-1], [None], [], ["", None], ["a", "b"]):
        split = [quality.TOKEN.findall(t or "") for t in some]
        prints, own, counts, token = tokens.tokens(some)
        assert counts.tolist() == [len(x) for x in split] and [token(i) for i in own] == [w for x in split for w in x]
        assert len({token(i) for i in range(len(prints))}) == len(prints)
        assert quality.token_numbers(some, tokens)[0].tolist() == [quality.number_of(w) for x in split for w in x]


def test_rare_words_do_not_leave_a_task_one_by_one():
    texts = [f"the a{i} cat b{i} ." for i in range(20_000)]
    batches = [pa.RecordBatch.from_pydict({"text": texts[i : i + 500]}) for i in range(0, len(texts), 500)]
    tokens = quality._Tokens()
    prints, _, _, token = tokens.tokens(["the cat ."])
    rows = quality.added(np.concatenate(list(quality.unpacked(quality.contexts(lambda: np.sort(prints), 16)(iter(batches))))))
    assert len(rows) <= 3 + quality.SHARED and rows["uses"].sum() == 100_000
    whole = quality.added(quality.contexts_of(*quality.token_numbers(texts, tokens)))
    frequent = np.isin(whole["word"], tokens.numbers(prints, token))
    assert len(whole) == 40_003 and (rows[rows["word"] >= quality.SHARED] == whole[frequent]).all()
    others = whole[~frequent].copy()
    others["word"] = quality.rest_of(others["word"])
    assert (rows[rows["word"] < quality.SHARED] == quality.added(others)).all()


def test_frequent_words_are_exact_however_texts_are_dealt(spark):
    # 24 texts of 6,000 tokens: "often" is there twice, in two texts, and "seldom" once.
    texts = [" ".join(["w"] * 5996 + ["often"] * (i < 2) + ["seldom"] * (i == 5) + [f"x{i}"] * 2) for i in range(24)]
    words = [w for t in texts for w in t.split()]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    least = len(words) * quality.SHARE
    wanted = {w for w in set(words) if words.count(w) >= least}
    assert "often" in wanted and "seldom" not in wanted and 1 < least < 2
    prints, _, _, token = quality._Tokens().tokens(sorted(set(words)))
    for parts in (1, 5, 24):
        found, total = quality.frequent_words(docs.repartition(parts))
        assert total == len(words) and {token(i) for i in np.flatnonzero(np.isin(prints, found))} == wanted and len(found) == len(wanted)


def test_pooled_texts_do_not_depend_on_their_neighbours():
    texts = [r[1] for r in ODD] + ["the cat sat . the cat ran .", "The dog ! ! dog 12 12"] * 3
    draw = np.random.default_rng(3)
    prints, own, _, token = quality._Tokens().tokens(texts)
    numbers = np.unique(quality._Tokens().numbers(prints, token))[::2]
    vectors = quality.Vectors(numbers, draw.normal(size=(len(numbers) + quality.SHARED, quality.DIMS)).astype(np.float32))
    together = quality.pooled(texts, quality._Tokens(), vectors)
    for text, row in zip(texts, together, strict=True):
        assert (quality.pooled([text], quality._Tokens(), vectors)[0] == row).all()
        values = vectors.rows[vectors.of(quality.token_numbers([text], quality._Tokens())[0])].astype(float)
        if len(values):
            assert np.allclose(row[: 2 * quality.DIMS], np.concatenate([values.mean(axis=0), values.std(axis=0)]), atol=1e-3)


def test_contexts_of_long_texts_are_summed_piece_by_piece(monkeypatch):
    tokens = quality._Tokens()
    numbers, counts = quality.token_numbers(["a b a c d a b", None, "b", "", "c a c d d b a"] * 3, tokens)
    whole = quality.contexts_of(numbers, counts)
    for places in (1, 2, 3, 7):
        monkeypatch.setattr(quality, "PLACES", places)
        assert (quality.contexts_of(numbers, counts) == whole).all()
    assert len(quality.contexts_of(numbers[:0], np.zeros(3, np.int64))) == 0
