"""Personal data in texts, with DataFrame functions only: fixed patterns, and boosted trees over more candidates.

Generators of high recall propose spans that may overlap. Boosted trees score them by their format
and by what stands around them. As there are no labels, the trees learn from the texts themselves:
spans that the base accepts are examples, also in other spellings (a phone number without its plus,
a card number in groups of four, a mail address in words); what the base rejects, and accepted
spans in wrong forms that the generators still propose (digits grouped otherwise, a digit too many
or too few, a wrong check digit, a part above 255, a domain that ends in a number), are
counterexamples. The scores are calibrated for each kind on a fourth of all spans.

The patterns run over the texts once: the spans with their surroundings are written to the shared
folder, and the trees learn from those and then score them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.common import checkpointed, table

KINDS = ("email", "ip", "card", "phone")
# The base's patterns. Runs start where no earlier match can have begun and give
# nothing back, so that they find what the plain patterns find in time in proportion to the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Shorter matches can't be valid; a text may hold very many of them.
SHORTEST = {"email": 5, "ip": 7, "card": 12, "phone": 9}
#: Other spellings that the generators propose; by kind.
PROPOSED = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+A-Za-z])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9A-Za-z])",
}
AROUND = 24
CUES = {"email": "mail|contact|write|address", "ip": r"\bip\b|host|server|addr", "card": "card|visa|credit|account|payment", "phone": "phone|call|tel|fax|mobile|cell"}
#: Accepted spans of a kind that the trees learn from, about (those with the smallest hashes), and the trees.
LEARNED, TREES, DEPTH = 10_000, 10, 4
#: A candidate is taken if its calibrated probability is this at least; scores are calibrated in so many steps.
PRECISION, STEPS = 0.9, 20
#: Values that a running total takes up at once.
RUN = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each value of an array of whole numbers what it and those before it are joined to.

    Blocks of RUN values, whose ends are joined first, keep this near the number of values.
    """

    def plain(array: Column) -> Column:
        step = lambda out, x: F.array_append(out, join(F.coalesce(F.try_element_at(out, F.lit(-1)), zero), x))
        return F.aggregate(array, F.array().cast("array<int>"), step)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda i: plain(F.slice(values, i * RUN + 1, F.lit(RUN))))
    joined = let(blocks, lambda own: let(plain(F.transform(own, lambda b: F.element_at(b, -1))), lambda ends: F.flatten(F.transform(own, lambda b, i: F.transform(b, lambda x: join(F.coalesce(F.get(ends, i - 1), zero), x))))))
    return F.when(F.size(values) > RUN, joined).otherwise(plain(values))


def running_of(values: Column, join: Callable[[Column, Column], Column], zero: Column, body: Callable[[Column], Column]) -> Column:
    """body of the running totals; both are computed once."""
    return let(values, lambda array: let(running(array, join, zero), body))


def found_spans(text: Column, pattern: str, kind: str) -> Column:
    """start, rank, end, kind, found, before and after of a pattern's matches, leftmost and not overlapping; positions are code points.

    What lies between the matches and the matches themselves, one after the other, give the positions
    and what stands around each, as far as the next match of the pattern.
    """

    def placed(matches: Column, between: Column, ends: Column) -> Column:
        def span(found: Column, i: Column) -> Column:
            end = F.get(ends, i)
            before, after = F.right(F.get(between, i), F.lit(AROUND)), F.left(F.get(between, i + 1), F.lit(AROUND))
            return F.struct((end - F.char_length(found)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), found.alias("found"), before.alias("before"), after.alias("after"))

        return F.filter(F.transform(matches, span), lambda s: s["end"] - s["start"] >= SHORTEST[kind])

    def of(matches: Column, between: Column) -> Column:
        lengths = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda gap, found: F.char_length(gap) + F.char_length(found))
        return running_of(lengths, lambda a, b: a + b, F.lit(0), lambda ends: placed(matches, between, ends))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: F.when(F.size(matches) == 0, none()).otherwise(let(F.split(text, pattern, -1), lambda between: of(matches, between))))


def apart_from(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, by one pass over both in order."""
    far = 2**31 - 1
    marked = lambda array, own: F.transform(array, lambda s: F.struct(s["start"].alias("at"), F.lit(own).alias("own"), s.alias("span")))

    def free(both: Column, ended: Column, begins: Column) -> Column:
        kept = F.filter(F.transform(both, lambda m, i: F.struct(m["span"].alias("span"), (m["own"] & (F.get(ended, i) <= m["at"]) & (F.get(begins, F.size(both) - 1 - i) >= m["span"]["end"])).alias("free"))), lambda m: m["free"])
        return F.transform(kept, lambda m: m["span"])

    def of(both: Column) -> Column:
        ends = F.transform(both, lambda m: F.when(m["own"], 0).otherwise(m["span"]["end"]))
        starts = F.reverse(F.transform(both, lambda m: F.when(m["own"], far).otherwise(m["at"])))
        return running_of(ends, F.greatest, F.lit(0), lambda ended: running_of(starts, F.least, F.lit(far), lambda begins: free(both, ended, begins)))

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(F.array_sort(F.concat(marked(others, False), marked(spans, True))), of))


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""

    def step(total: Column, place: Column) -> Column:
        digit = F.substring(number, -place, 1).cast("int")
        twice = F.when(place % 2 == 0, digit * 2).otherwise(digit)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), step) % 10 == 0


def small_parts(found: Column) -> Column:
    """Whether all numbers between points are 255 at most."""
    return F.forall(F.split(found, r"\."), lambda part: (F.char_length(F.ltrim(part, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(part, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def valid(span: Column) -> Column:
    """What the base demands of a match."""
    number = digits(span["found"])
    n = F.char_length(number)
    return (
        F.when(span["kind"] == "email", F.lit(True))
        .when(span["kind"] == "ip", small_parts(span["found"]))
        .when(span["kind"] == "card", F.when(n.between(12, 19), luhn(number)).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def none() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,found:string,before:string,after:string>>")


def matched(text: Column, patterns: dict[str, str]) -> Column:
    """The spans of all patterns in one array; patterns aren't tried on texts that can't hold them."""
    numbers = text.rlike("[0-9]")
    has = lambda part: F.contains(text, F.lit(part))

    def of(kind: str, pattern: str) -> Column:
        if patterns is BASE:
            there = has(NEEDS[kind])
        else:
            there = {"email": has("(at)") | has("[at]") | (has(" at ") & has(" dot ")), "ip": has("(") | has("[")}.get(kind, F.lit(True))
        return F.when(there if kind == "email" else there & numbers, found_spans(text, pattern, kind)).otherwise(none())

    return F.concat(*[of(kind, pattern) for kind, pattern in patterns.items()])


def features(kind: Column, found: Column, before: Column, after: Column) -> Column:
    """Numbers that describe a span's format and what stands around it."""
    number = digits(found)
    n = F.char_length(number)
    plain = F.regexp_replace(found, r"\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?", ".")

    def times(pattern: str) -> Column:
        return F.regexp_count(found, F.lit(pattern)).cast("double")

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int").cast("double")

    near = F.lower(F.concat(before, F.lit(" "), after))
    return F.array(
        *[flag(kind == k) for k in KINDS],
        F.char_length(found).cast("double"),
        n.cast("double"),
        times("[A-Za-z]"),
        times(r"[\x20().-]"),
        times("[0-9]+"),
        flag(F.when(n.between(12, 19), luhn(number))),
        flag(F.when(plain.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), small_parts(plain))),
        flag(found.rlike(r"@|\(at\)|\[at\]|\x20at\x20")),
        flag(before.rlike(r"[A-Za-z0-9_=/-]$")),
        flag(after.rlike(r"^[A-Za-z0-9_=/-]")),
        *[flag(near.rlike(CUES[k])) for k in KINDS],
        *[F.char_length(F.regexp_extract(found, p, 1)).cast("double") for p in (r"^[^0-9]*([0-9]*)", r"([0-9]*)$", r"([A-Za-z]*)$")],
        F.size(F.array_distinct(F.split(F.regexp_replace(found, r"[^\x20./_-]", ""), ""))).cast("double"),
        flag(F.contains(found, F.lit("("))),
    )


@dataclass
class Trees:
    """Trees as columns of the features, their weights, and the least score of each kind that is taken."""

    model: object
    least: dict[str, float]

    def score(self, x: Column) -> Column:
        """The probability of a span, as Spark's model gives it: from the sum of the trees."""

        def of(node) -> Column:
            if node.subtreeDepth() == 0:
                return F.lit(float(node.prediction()))
            split = node.split()
            return F.when(x[split.featureIndex()] <= float(split.threshold()), of(node.leftChild())).otherwise(of(node.rightChild()))

        margin = reduce(lambda a, b: a + b, (of(tree._java_obj.rootNode()) * float(w) for tree, w in zip(self.model.trees, self.model.treeWeights, strict=True)))
        return 1 / (1 + F.exp(-2 * margin))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, rank, end, kind, found, base, ok, before, after) of docs.

    These are the base's matches, ok if the base accepts them, and what the generators propose
    apart from accepted ones.
    """
    text = F.col("text")
    own = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).withColumns({"matches": matched(text, BASE), "proposed": matched(text, PROPOSED)})
    own = own.withColumns({"accepted": F.filter("matches", valid), "rejected": F.filter("matches", lambda s: ~valid(s))})
    own = own.withColumns({"rejected": apart_from(F.col("rejected"), F.col("accepted")), "proposed": apart_from(F.col("proposed"), F.col("accepted"))})
    return own.select("doc_id", F.concat(told(F.col("accepted"), True, True), told(F.col("rejected"), True, False), told(F.col("proposed"), False, False)).alias("spans"))


def told(spans: Column, base: bool, ok: bool) -> Column:
    return F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "found", "before", "after")], F.lit(base).alias("base"), F.lit(ok).alias("ok")))


def examples_of(found: DataFrame, most: int | None) -> DataFrame:
    """kind, label, x, draw of candidates(): accepted spans and their other spellings, rejected spans of the base and spoilt forms.

    Candidates in other spellings are no counterexamples: they are what the trees are to accept.
    Of each kind about `most` spans of the base are taken, by their hashes; all without it.
    """
    sample = found.select(F.inline("spans")).filter("base").withColumn("draw", F.xxhash64("found", "before", "after"))
    if most is not None:
        counts = {r.kind: r.n for r in sample.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        part = reduce(lambda c, k: c.when(F.col("kind") == k, min(1.0, most / counts[k])), counts, F.when(F.lit(False), 1.0))
        sample = sample.filter(F.pmod(F.shiftright("draw", 8), F.lit(1 << 30)) < part * (1 << 30))
    text, number = F.col("found"), digits(F.col("found"))
    bare = F.regexp_replace(text, r"^\+[0-9]{1,2}[\x20.-]?", "")
    wrong_digit = F.concat(F.expr("substring(found, 1, char_length(found) - 1)"), ((F.substring(text, -1, 1).try_cast("int") + 1) % 10).cast("string"))
    too_large = [F.regexp_replace(text, *x) for x in ((r"\.([0-9])[0-9]*$", ".7$15"), (r"^([0-9]+)\.([0-9])[0-9]*", "$1.6$24"), ("^([0-9])[0-9]*", "4$17"), (r"([0-9])[0-9]*(\.[0-9]+)$", "9$13$2"))]
    tail = lambda end: F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "@", " [at] "), r"\.", " [dot] "), "[A-Za-z0-9-]+$", end)
    in_fours = lambda digits_, by: F.regexp_replace(digits_, "([0-9]{4})(?=[0-9])", f"$1{by}")
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    respelt = F.array_compact(
        F.array(
            text, of("phone", bare), of("phone", F.regexp_replace(F.regexp_replace(bare, r"^\(", ""), r"[().\x20-]+", "-")), of("card", in_fours(number, " ")), of("card", in_fours(number, ".")),
            *[of("ip", F.regexp_replace(text, r"\.", dot)) for dot in ("[.]", "(.)", "[dot]")],
            of("email", F.regexp_replace(F.regexp_replace(text, "@", " at "), r"\.", " dot ")), of("email", F.regexp_replace(text, "@", "[at]")), of("email", F.regexp_replace(F.regexp_replace(text, "@", " [at] "), r"\.", " [dot] ")),
        )
    )
    spoilt = F.array_compact(
        F.array(
            of("card", wrong_digit), of("card", in_fours(digits(wrong_digit), ".")),
            *[of("ip", F.regexp_replace(x, r"\.", "[.]")) for x in too_large],
            of("phone", F.regexp_replace(number, "^([0-9]{4})([0-9]{4})([0-9]{3,4}).*$", "$1 $2 $3")), of("phone", F.regexp_replace(F.concat(number, F.substring(number, -1, 1)), "^([0-9]{4})([0-9]{4})([0-9]{3,4}).*$", "$1-$2-$3")),
            of("phone", F.regexp_replace(number, "^([0-9]{2})([0-9]{3})([0-9]{3}).*$", "$1 $2.$3")),
            *[of("email", tail(x)) for x in ("x", "", "informationabout")], of("email", F.regexp_replace(tail("x"), r"[\[\]]", "")), of("email", F.concat(F.regexp_replace(text, r"\.[A-Za-z0-9-]+$", ""), F.lit(".1"))),
        )
    )
    form = lambda rows, label: rows.select("kind", "found", "before", "after", "draw", F.lit(label).alias("label"))
    good, bad = (form(sample.filter("ok").withColumn("found", F.explode(values)), label) for values, label in ((respelt, 1.0), (spoilt, 0.0)))
    both = good.unionByName(bad).unionByName(form(sample.filter("not ok"), 0.0))
    return both.select("kind", "label", "draw", features(F.col("kind"), F.col("found"), F.col("before"), F.col("after")).alias("x"))


def examples(docs: DataFrame, most: int | None = LEARNED) -> DataFrame:
    return examples_of(candidates(docs), most)


def calibrated(counts: list[tuple[int, float, int]]) -> dict[int, float]:
    """The probability of each step of scores, from (step, right, all): rising with the scores, with half an example of either sort for each."""
    pools: list[list] = []
    for step, good, n in sorted(counts):
        pools.append([[step], good, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            steps, good, n = pools.pop()
            pools[-1] = [pools[-1][0] + steps, pools[-1][1] + good, pools[-1][2] + n]
    return {step: (good + 0.5) / (n + 1) for steps, good, n in pools for step in steps}


def learn_from(found: DataFrame, most: int = LEARNED) -> Trees | None:
    """The trees and thresholds from candidates(); None if the base accepts no span at all."""
    fitting = checkpointed(examples_of(found, most).filter("pmod(draw, 4) <> 0"))
    if {r.label for r in fitting.select("label").distinct().collect()} != {0.0, 1.0}:
        return None
    vectors = fitting.select("label", array_to_vector("x").alias("features"))
    trees = Trees(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11).fit(vectors), {})
    step = F.floor(trees.score(F.col("x")) * STEPS).cast("int")
    counts = examples_of(found, None).filter("pmod(draw, 4) = 0").groupBy("kind", step.alias("step")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    for kind in KINDS:
        taken = [step for step, p in calibrated([(r.step, r.good, r.n) for r in counts if r.kind == kind]).items() if p >= PRECISION]
        if taken:
            trees.least[kind] = min(taken) / STEPS
    return trees


def learn(docs: DataFrame, most: int = LEARNED) -> Trees | None:
    return learn_from(checkpointed(candidates(docs)), most)


def detected(docs: DataFrame, most: int = LEARNED) -> DataFrame:
    """doc_id and spans (start, end, kind, base), one row for each row of docs; other columns aren't read.

    Spans are by start, then kind. Those of the base are marked; the others are candidates that
    overlap none of the base and whose calibrated probability is PRECISION at least. The trees
    learn from about `most` spans of each kind, the calibration from a fourth of all spans. A kind
    of which the base accepts no span in docs has no candidate taken, as nothing tells what it looks
    like there. A null or empty text has no spans; rows that repeat, and null ids, stay as they are; no
    documents give no rows. Long texts are searched whole, in time about in proportion to their matches.
    """
    found = checkpointed(candidates(docs))
    trees = learn_from(found, most)
    wanted = F.col("spans")
    if trees and trees.least:
        x = lambda s: features(s["kind"], s["found"], s["before"], s["after"])
        enough = lambda s: let(x(s), lambda own: reduce(lambda a, b: a | b, [(s["kind"] == k) & (trees.score(own) >= v) for k, v in trees.least.items()]))
        spans = F.filter(wanted, lambda s: s["ok"] | enough(s))
    else:
        spans = F.filter(wanted, lambda s: s["ok"])
    marked = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["ok"].alias("base")))
    return found.select("doc_id", F.array_sort(F.array_distinct(marked)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and a digest of the base, and all spans."""
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return detected(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
