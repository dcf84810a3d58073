import hashlib
import random
import re
import time

import pytest

from tallyworks.llm import pii, secrets

from ..conftest import DATA
from .cases import ODD, documents, emptied


def luhn(number):
    digits = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in digits) % 10 == 0


def personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return listed(text, kinds)


def secret(text):
    kinds = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda s: len(re.fullmatch(kinds[0][1], s, re.I | re.A)[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda s: len(s) >= 16),
        ("hex", r"[0-9a-f]+", lambda s: len(s) >= 32),
    ]
    return listed(text, kinds)


def listed(text, kinds):
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text or "", re.A | (re.I if kind == "assign" else 0)) if good(m[0])]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def rows_of(op, texts):
    if op is pii:
        return lambda spark: {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in pii.detected(documents(spark, list(enumerate(texts)))).collect()}
    return lambda spark: {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in secrets.scanned(documents(spark, list(enumerate(texts)))).collect()}


def random_texts(pieces, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices(pieces, k=draw.randrange(1, 30))) for _ in range(400)]


PERSONAL = ["a", "é😀", " ", ".", "@", "+", "-", "1", "23", "999", "(", ")", "a.b", "x@y.z", "1.2.3.4", "4111111111111111", "+1 (375) 555-4393", "255", "%", "\n"]
SECRETS = ["a", "é😀", " ", "=", ":", '"', "'", "token", "PASSWORD", "api_key", "apikey", "secret", "AKIA", "ABCDEFGH1234", "deadbeef", "0123456789abcdef", "passwd", "\n", "x1_", ";", "ſecret"]


@pytest.mark.parametrize(("op", "base", "pieces"), [(pii, personal, PERSONAL), (secrets, secret, SECRETS)])
def test_base_equals_plain_patterns(spark, op, base, pieces):
    texts = [t for _, t in ODD if t is None or len(t) < 1000] + random_texts(pieces, 1) + random_texts(pieces, 2)
    for i, spans in rows_of(op, texts)(spark).items():
        assert [f"{k}:{a}:{b}" for k, a, b, own in spans if own] == base(texts[i]), texts[i]


@pytest.mark.parametrize(("query", "base", "counts"), [(pii.op8_pii, personal, pii.KINDS), (secrets.op9_secret_scan, secret, secrets.KINDS)])
def test_queries(spark, query, base, counts):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = query(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        wanted = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest()
        assert set(wanted) <= set(r.spans.split(",")) and [r[f"n_{k}"] for k in counts] == [sum(w.startswith(k + ":") for w in wanted) for k in counts]


@pytest.mark.parametrize("op", [pii, secrets])
def test_odd_rows(spark, op):
    run = pii.detected if op is pii else secrets.scanned
    assert run(documents(spark, ODD)).count() == len(ODD) and run(emptied(spark)).count() == 0


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 100_000, "a." * 100_000 + "@", "+1" * 100_000, "1 " * 150_000, "x@" * 100_000, "a@b" + ".c" * 100_000])
def test_long_runs_take_little_time(spark, text):
    began = time.time()
    found = pii.detected(documents(spark, [(1, text)])).first().spans
    secrets.spans_of(text)
    assert time.time() - began < 60 and (text[:3] != "a@b" or len(found) == 1)


def test_personal_data_in_other_spellings(spark):
    draw = random.Random(5)
    number = lambda n: "".join(str(draw.randrange(10)) for _ in range(n))

    def card():
        body = "4" + number(14)
        return body + next(d for d in "0123456789" if luhn(body + d))

    texts = [f"please call +1 ({number(3)}) 555-{number(4)} or write to u{number(3)}@mail{number(1)}.example.com, card {card()}, host {draw.randrange(256)}.{draw.randrange(256)}.3.4 version {number(1)}.{number(1)}" for _ in range(300)]
    n = len(texts)
    texts += ["please call (375) 555-4393 today", "write to fakol [at] mail7 [dot] example [dot] com please", "nothing to see at home. Dot", "in 2024 there were 12 of 365"]
    found = rows_of(pii, texts)(spark)
    assert [(k, texts[n][a:b]) for k, a, b, own in found[n] if not own] == [("phone", "(375) 555-4393")]
    assert [(k, texts[n + 1][a:b]) for k, a, b, own in found[n + 1]] == [("email", "fakol [at] mail7 [dot] example [dot] com")]
    assert found[n + 2] == found[n + 3] == []


def test_planted_respelt_data_is_found(spark):
    """Spellings that the base doesn't know, among numbers and words that look alike, in texts whose plain data teach the trees."""
    draw = random.Random(11)
    digits = lambda n: "".join(str(draw.randrange(10)) for _ in range(n))
    word = lambda: "".join(draw.choice("aeioustrnl") for _ in range(draw.randrange(3, 9)))

    def card():
        body = draw.choice("3456") + digits(14)
        return body + next(d for d in "0123456789" if luhn(body + d))

    def ip(dot):
        return dot.join(str(draw.randrange(256)) for _ in range(4))

    def user():
        return f"{word()}{draw.choice(['', '.', digits(2)])}{draw.choice(['', word()])}".strip(".")

    plain = [lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{user()}@{word()}{digits(1)}.{word()}.{draw.choice(['com', 'org', 'de'])}", card, lambda: ip(".")]
    respelt = [
        ("phone", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"), ("phone", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"), ("ip", lambda: ip("[.]")), ("ip", lambda: ip("[dot]")),
        ("email", lambda: f"{user()} [at] {word()}{digits(1)} [dot] {word()} [dot] com"), ("email", lambda: f"{user()}[at]{word()}{digits(1)}.{word()}.org"), ("card", lambda: re.sub("(....)(?=.)", r"\1.", card())),
    ]
    other = [lambda: f"{digits(4)} {digits(4)} {digits(4)}", lambda: f"{digits(4)}-{digits(4)}-{digits(3)}", lambda: "[.]".join(str(draw.randrange(256, 999)) for _ in range(4)), lambda: re.sub("(....)(?=.)", r"\1.", (lambda c: c[:-1] + str((int(c[-1]) + 1) % 10))(card())), lambda: f"{word()} [at] {word()} [dot] {digits(2)}"]
    texts, wanted = [], set()
    for i in range(900):
        text, kind = " ".join(word() for _ in range(6)), None
        if i % 3 == 0:
            kind, make = draw.choice(respelt)
            found = make()
        else:
            found = draw.choice(plain if i % 3 == 1 else other)()
        if kind:
            wanted.add((i, kind, len(text) + 1, len(text) + 1 + len(found)))
        texts.append(f"{text} {found} {word()}")
    got = {(i, k, a, b) for i, spans in rows_of(pii, texts)(spark).items() for k, a, b, own in spans if not own}
    assert len(got & wanted) > 0.9 * len(wanted) and len(got & wanted) > 0.9 * len(got)
    assert {k for _, k, _, _ in got & wanted} == set(pii.KINDS)


def test_running_totals_and_overlaps_in_long_arrays(spark):
    values = list(range(1000))
    row = spark.createDataFrame([(values,)], "v array<int>").select(pii.running(pii.F.col("v"), lambda a, b: a + b, pii.F.lit(0)).alias("s"), pii.running(pii.F.col("v"), pii.F.greatest, pii.F.lit(7)).alias("m")).first()
    assert row.s == [sum(values[: i + 1]) for i in range(1000)] and row.m == [max(7, i) for i in range(1000)]
    draw = random.Random(3)
    spans, others = ([(a := draw.randrange(9000), 0, a + draw.randrange(1, 9), "ip", "x") for _ in range(700)] for _ in range(2))
    kind = "array<struct<start:int,rank:int,end:int,kind:string,found:string>>"
    free = spark.createDataFrame([(spans, others)], f"a {kind}, b {kind}").select(pii.apart_from(pii.F.col("a"), pii.F.col("b")).alias("free")).first().free
    assert sorted(map(tuple, free)) == sorted(s for s in spans if not any(s[0] < o[2] and o[0] < s[2] for o in others))


def test_probabilities_rise_with_scores():
    p = pii.calibrated([(0, 0.0, 50), (5, 4.0, 10), (6, 3.0, 10), (19, 30.0, 30)])
    assert [round(p[s], 3) for s in (0, 5, 6, 19)] == [round(0.5 / 51, 3), round(7.5 / 21, 3), round(7.5 / 21, 3), round(30.5 / 31, 3)] and pii.calibrated([]) == {}


def test_candidates_in_other_spellings_are_no_counterexamples(spark):
    texts = [f"please call +1 ({375 + i}) 555-{4000 + i} today" for i in range(100)]
    rows = pii.examples(documents(spark, list(enumerate(texts))), 1000).filter("kind = 'phone'")
    bare = rows.groupBy("x").agg({"label": "min", "*": "count"}).withColumnRenamed("min(label)", "least").withColumnRenamed("count(1)", "n")
    assert {r.label for r in rows.filter("x[5] = 10").collect()} == {1.0} and bare.filter("x[5] = 10").count() > 0


@pytest.mark.parametrize(("kind", "text", "found"), [("ip", "at 10[.]0[.]3[.]4 now", "10[.]0[.]3[.]4"), ("card", "card 4111.1111.1111.1111 it is", "4111.1111.1111.1111")])
def test_generators_of_cards_and_addresses(spark, kind, text, found):
    row = documents(spark, [(1, text)]).select(pii.matched(pii.F.col("text"), pii.PROPOSED).alias("spans")).first()
    assert [s.found for s in row.spans if s.kind == kind] == [found]


def test_plan_of_personal_data_has_no_python(spark):
    plan = pii.op8_pii(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(
    ("text", "literal"),
    [
        ('db_passphrase = "Tr0ub4dor&3xyz"', "Tr0ub4dor&3xyz"),
        ("KEY_A = 'a8Fk2LmQ9z'\nlogin(x)\nauth_token = KEY_A", "a8Fk2LmQ9z"),
        ("A = 'zz81LmQx0p'; B = A; clientSecretKey: B", "zz81LmQx0p"),
        ("privateKey := Zk39dkLwpq", "Zk39dkLwpq"),
        ('credentials: "changeme123"', "changeme123"),
        ('password_hint = "your_password1"', None),
        ("colour = 'a8Fk2LmQ9z'", None),
        ("bearer = some_function", None),
        ("see https://auth:8080abcd", None),
    ],
)
def test_literals_of_sensitive_names(text, literal):
    if literal == "changeme123":
        literal = None  # a stand-in
    found = [text[a:b] for a, b, _ in secrets.assigned(text)]
    assert found == ([literal] if literal else [])


@pytest.mark.parametrize(
    ("text", "literal"),
    [
        ('apiToken: string = "aB3dE5fG7h"', "aB3dE5fG7h"),
        ('db_passphrase: str = "Tr0ub4dor&3xyz"', "Tr0ub4dor&3xyz"),
        ("auth_token: Optional[str] = 'zz81LmQx0p'", "zz81LmQx0p"),
        ('let secret_key: &\'static str = "a8Fk2LmQ9z";', "a8Fk2LmQ9z"),
        ('clientSecret?: string | null = "a8Fk2LmQ9z"', "a8Fk2LmQ9z"),
        ('var apiToken string = "a8Fk2LmQ9z"', "a8Fk2LmQ9z"),
        ("apiToken: string = KEY", None),
        ('colour: string = "a8Fk2LmQ9z"', None),
        ('db_pwd = "myS3cr3tP4ss!"', "myS3cr3tP4ss!"),
        ('secretKey = "TheX9k2LmQ0p"', "TheX9k2LmQ0p"),
        ('credentials = "testK8s7Jq2"', "testK8s7Jq2"),
        ('db_pwd = "my_secret_pass1"', None),
        ('db_pwd = "testpassword123"', None),
        ('passphrase = "correct horse battery staple"', "correct horse battery staple"),
        ('passphrase = "the quick brown fox"', "the quick brown fox"),
        ('password_text = "Enter your password"', None),
        ('db_pwd = "correcthorsebattery"', "correcthorsebattery"),
        ('DB_PASSPHRASE = "BATTERYSTAPLE"', "BATTERYSTAPLE"),
        ('bearer = "correcthorsebattery"', None),
    ],
)
def test_typed_names_phrases_and_stand_ins(text, literal):
    assert [text[a:b] for a, b, _ in secrets.assigned(text)] == ([literal] if literal else [])


@pytest.mark.parametrize(
    ("text", "literal"),
    [
        ("os.environ['API_TOKEN'] = 'zz81LmQx0p'", "zz81LmQx0p"),
        ("<db><password>zz81LmQx0p</password></db>", "zz81LmQx0p"),
        ('<add key="DbPassphrase" value="zz81LmQx0p" />', "zz81LmQx0p"),
        ('<conn authToken="zz81LmQx0p">', "zz81LmQx0p"),
        ("auth_token = (\n    'zz81LmQx0p'\n)", "zz81LmQx0p"),
        ("auth_token = 'zz81' + 'LmQx0p'", "zz81' + 'LmQx0p"),
        ("auth_token = ('zz81'\n   'LmQx0p')", "zz81'\n   'LmQx0p"),
        ('db_pwd = "zz81\\"LmQx0p"', 'zz81\\"LmQx0p'),
        ("db_pwd = \"\"\"zz81LmQx0p\"\"\"", "zz81LmQx0p"),
        ("connect(host, authToken='zz81LmQx0p', port=1)", "zz81LmQx0p"),
        ('{"client": {"secretKey": "zz81LmQx0p"}}', "zz81LmQx0p"),
        ("client:\n  signingKey: zz81LmQx0p\n", "zz81LmQx0p"),
        ("client:\n  signingKey: |\n    zz81LmQx0p\nnext: 1", "zz81LmQx0p"),
        ("[db]\npassphrase=zz81LmQx0p\n", "zz81LmQx0p"),
        ("export AUTH_TOKEN=zz81LmQx0p", "zz81LmQx0p"),
        ("run --auth-token=zz81LmQx0p now", "zz81LmQx0p"),
        ("cfg.setPassphrase(\"zz81LmQx0p\");", "zz81LmQx0p"),
        ('env.put("AUTH_TOKEN", "zz81LmQx0p")', "zz81LmQx0p"),
        ("# db_pwd = 'zz81LmQx0p'", "zz81LmQx0p"),
        ("/* db_pwd = 'zz81LmQx0p' */ x = 1", "zz81LmQx0p"),
        ('say("db_pwd = zz81LmQx0p")', "zz81LmQx0p"),
        ("# K = 'zz81LmQx0p'\nauth_token = K", None),  # a comment gives code nothing
        ("def f():\n    K = 'zz81LmQx0p'\nauth_token = K", None),  # another scope
        ("K = 'zz81LmQx0p'\ndef f():\n    auth_token = K", "zz81LmQx0p"),
        ("K = 'zz81LmQx0p'\ndef f():\n    K = g\n    x = K\nauth_token = K", "zz81LmQx0p"),
        ("function f() { var K = 'zz81LmQx0p' } authToken = K", None),
        ("K = 'zz81'\nauth_token = K + 'LmQx0p'", "LmQx0p"),
        ("auth_token = os.getenv('AUTH_TOKEN')", None),
        ("auth_token = f('zz81LmQx0p')", None),
        ("auth_token = 'zz81LmQx0p' + g(1)", None),
        ("auth_token == 'zz81LmQx0p'", None),
        ("don't say token it's zz81LmQx0p", None),
    ],
)
def test_lexer(text, literal):
    assert [text[a:b] for a, b, _ in secrets.assigned(text)] == ([literal] if literal else [])


@pytest.mark.parametrize("text", ["a:b<a:b<" * 40_000, "a:b|b" * 50_000, "a: b<c<d>c" * 30_000, "const " * 50_000, "a:b[b::b" * 40_000, "/* " * 90_000, '\\"' * 100_000, '"' + '\\"' * 100_000, "<a " * 90_000, "<a>" * 90_000, "token='a'" * 30_000, "a='" * 90_000, "(" * 200_000, "a=(" * 90_000, "x = 'a' + " * 30_000, "{k='v1'" * 40_000, "a" + ":b|" * 90_000, "a: b" + "|b" * 100_000])
def test_types_take_little_time(text):
    began = time.time()
    secrets.spans_of(text)
    assert time.time() - began < 20


def test_secrets_at_any_depth_and_with_long_keys():
    def literals(text):
        return [text[s["start"] : s["end"]] for s in secrets.spans_of(text) if not s["base"]]

    value = "aB3xY9kLmN2p"
    for text in (f"# b: 'db_pwd = {value}'", f"""# b: "'db_pwd = {value}'" """, f'''# """x '# "db_pwd = {value}"' """ ''', f"# # # // # db_pwd = {value}", f"/* // # db_pwd = {value} */ x = 1", f"<!-- /* db_pwd = {value} */ -->", f"/* /* # db_pwd = {value}", f"// a\n# db_pwd = {value}\nx = 1"):
        assert literals(text) == [value], text
    for n in (10, 107, 5000):
        assert literals(f'"{"k" * n}_pwd": "{value}"') == [value]
    assert literals(f"# pwd_name = 1\n/* a */ x = 2 /* b */ db_pwd = {value}") == [value]
    began = time.perf_counter()
    for mark in ("# ", "/* ", "<!-- ", "// ", '# "', "/* '"):
        assert literals(mark * 60_000 + f"\ndb_pwd = {value}")[-1:] in ([value], [])
    assert time.perf_counter() - began < 20
