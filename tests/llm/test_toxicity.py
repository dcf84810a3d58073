import random

import numpy as np
import pytest

from tallyworks.llm import toxicity

from ..conftest import DATA
from .cases import ODD, documents, emptied

CLEAN = [f"{a}{b}" for a in ("mor", "tan", "vel", "sup", "ned", "ral") for b in ("a", "ise", "one", "ub", "ert", "ilo", "an")]


def corpus(count=400, seed=1):
    """Texts of plain words; every fourth is toxic by 'zorg...' words, and 'pipe zorg organ' stands in some others."""
    draw, rows, labels = random.Random(seed), [], []
    for i in range(count):
        words = draw.choices(CLEAN, k=draw.randrange(20, 120))
        toxic = i % 4 == 0
        for _ in range(draw.randrange(2, 6) if toxic else 0):
            words.insert(draw.randrange(len(words)), "zorg" + draw.choice(["let", "ish", "os", "um", "ane", "eti", "yx", "wol"]))
        if not toxic and i % 8 == 1:
            at = draw.randrange(len(words))
            words[at:at] = ["pipe", "zorg", "organ"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_labels_are_predicted(spark):
    data = DATA.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in toxicity.op12_toxicity(spark, data).collect() if r.held_out and r.doc_id in labels]
    found = [(labels[r.doc_id], r.predicted) for r in rows]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(p for y, p in found if y) > 0.85 * sum(y for y, _ in found) and sum(p for y, p in found if not y) < 0.005 * len(found)


def test_lexicon_exceptions_and_spellings(spark):
    rows, labels = corpus()
    more = [(900, "morise tanub z0rgish velan zоrgal"), (901, "morise tanub velan supa the pipe zorg organ"), (902, "a ｚｏｒｇlet ZORG zor6os"), (903, "pipe zorg organ zorgish")]
    kinds = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn(documents(spark, rows), kinds)
    assert set(lexicon.weights) == {" zorg"} and lexicon.exceptions == {" pipe zorg ", " zorg organ ", " zorg "}
    scores = {r.doc_id: r for r in toxicity.scored(documents(spark, rows + more), kinds).collect()}
    assert all((scores[i].score >= 0.7) == bool(y) for i, y in labels)
    assert scores[900].score > 0.7 > 0.3 > scores[901].score and scores[902].terms == ["zorg"] and scores[903].score > 0.7 and scores[901].terms == []
    again = {r.doc_id: r.score for r in toxicity.scored(documents(spark, rows + more).repartition(7), kinds.repartition(3)).collect()}
    assert again == {i: r.score for i, r in scores.items()}


def test_near_copies_are_learned_from_once(spark):
    """Hundreds of copies of one toxic text, each with a word changed, don't make terms of its other words."""
    rows, labels = corpus()
    words = ("zorgal " + " ".join(f"rare{c}" for c in "abcdefghijklmnopqrstuvwxyz" * 3)).split()
    draw = random.Random(3)
    for k in range(300):
        own = list(words)
        own[draw.randrange(1, len(own))] = draw.choice(CLEAN)
        rows.append((5000 + k, " ".join(own)))
        labels.append((5000 + k, 1))
    lexicon = toxicity.learn(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(lexicon.weights) == {" zorg"}


@pytest.mark.parametrize("seed", range(3))
def test_matches_equal_brute_force(seed):
    draw = random.Random(seed)
    some = ["".join(draw.choices("ab", k=draw.randrange(1, 5))) for _ in range(60)]
    weights = {f" {w}{draw.choice(['', ' '])}": draw.random() for w in draw.sample(some, 12)}
    exceptions = frozenset(f" {' '.join(draw.choices(some, k=draw.randrange(1, 3)))} " for _ in range(12))
    matcher = toxicity.Matcher(weights, exceptions)
    for _ in range(60):
        words = draw.choices(some, k=draw.randrange(0, 30))
        text, wanted = f" {' '.join(words)} ", []
        for i in range(len(text)):
            here = [t for t in weights if text.startswith(t, i)]
            if here and words:
                end = i + max(map(len, here))
                if not any(text.startswith(e, j) and end <= j + len(e) for e in exceptions for j in range(i + 1)):
                    wanted.append((i, end, weights[text[i:end]]))
        assert sorted(matcher.found(words)) == sorted(wanted)


def test_folding():
    assert toxicity.folded("1D10T idiоt Ｉｄｉｏｔ id!ot !d lost l0$t 2015 x2") == ["idiot", "idiot", "idiot", "idiot", "d", "iost", "iost", "2015", "xz"]
    assert toxicity.folded(None) == toxicity.folded("") == toxicity.folded(" .\n") == []


def test_odd_rows(spark):
    docs = documents(spark, [*ODD, (9, "zorgish " * 20_000), (10, "zorgish")])
    rows, labels = corpus()
    kinds = spark.createDataFrame([*labels, (1, 5), (None, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    learned = toxicity.scored(documents(spark, [(100 + i, t) for i, t in rows]).unionByName(docs), kinds.select((kinds.doc_id + 100).alias("doc_id"), "toxic")).collect()
    own = [r for r in learned if r.doc_id is None or r.doc_id < 100]
    assert sorted(str(r.doc_id) for r in own) == sorted([*(str(r[0]) for r in ODD), "9", "10"]) and next(r.score for r in own if r.doc_id == 9) > 0.7 and all(r.score < 0.3 for r in own if r.doc_id not in (9, 10))
    one = toxicity.scored(docs, spark.createDataFrame([(6, 1)], "doc_id long, toxic int")).collect()
    assert len(one) == len(ODD) + 2 and {round(r.score, 6) for r in one} == {0.99}
    assert toxicity.scored(emptied(spark), kinds).count() == 0 and toxicity.scored(docs, kinds.limit(0)).first().score == 0.5


def test_weights_and_shares():
    sure = toxicity.likelihood(np.array([30, 3, 0, 5]), np.array([0, 30, 0, 50]), 100, 1000)
    assert sure[0] > 100 and abs(sure[1]) < 1e-6 and sure[2] == 0 and abs(sure[3]) < 1e-6
    x = np.stack([np.ones(200), np.r_[np.zeros(100), np.ones(100)], *np.zeros((3, 200))], axis=1)
    p = 1 / (1 + np.exp(-x @ toxicity.logistic(x, np.r_[np.zeros(95), np.ones(105)])))
    assert abs(p[0] - 0.05) < 0.03 and p[-1] > 0.9
