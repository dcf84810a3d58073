"""Secrets in texts: fixed patterns, and assignments whose target's name is sensitive.

A lexer cuts source code and configuration into comments, strings, brackets, lines and targets of
assignments: names with or without a type, quoted keys, subscripts, keyword arguments, setters,
tags and attributes. The expression after a target gives a literal: a string, strings that are
joined, a bare word, or a name that was given a literal before in the same scope.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.common import python_batches, table

KINDS = ("assign", "access", "hex")
# The patterns of the base.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_LITERAL = 8

#: A declared type, maybe with arguments or a union. Single colons aren't part of it: after each the next one starts anew.
_INNER = r"""(?:[^<>\[\]:\n="';{}()]|::)*+"""
_TYPE = rf"""(?:[&*][ \t]*+)?(?:'[a-z]+[ \t]++)?(?:(?:mut|const|dyn)[ \t]++)?[A-Za-z_][A-Za-z0-9_.]*+(?:::[A-Za-z0-9_]++)*+(?:<{_INNER}(?:<{_INNER}>{_INNER})*+>|\[{_INNER}(?:\[{_INNER}\]{_INNER})*+\])*+[?!*]?"""
TYPE = rf"{_TYPE}(?:[ \t]*+\|[ \t]*+{_TYPE})*+"
_OPERATOR = r"(?::=|=>|=(?![=~])|:(?![/:]))"
#: Lexemes. Each gives nothing back and starts where no other could have, and what is never closed
#: reaches to the end, so that long texts take time in proportion to them.
LEXEME = re.compile(
    r"""(?P<escape>\\.)|(?P<comment>(?<!\S)(?:\#|//)|/\*|<!--)"""
    rf"""|(?P<quote>["'])(?P<key>[^"'\\\n]++)(?P=quote)(?P<pair>[ \t]*+,[ \t]*+(?=["'])|[ \t]*+\]?[ \t]*+{_OPERATOR})"""
    r"""|(?P<string>(?:(?<![A-Za-z0-9])[rRbBuUfF]{1,2})?+(?:\"{3}(?:[^"\\]++|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]++|\\.|'(?!''))*+'{3}|"(?:[^"\\\n]++|\\.)*+"|(?<![A-Za-z0-9])'(?:[^'\\\n]++|\\.)*+'))"""
    r"""|(?P<open>\{)|(?P<close>\})|\n(?P<indent>[ \t]*+)(?=\S)"""
    r"""|<(?P<tag>[A-Za-z_][A-Za-z0-9_.:-]*+)(?P<attributes>[ \t][^<>]*+)?(?:>(?P<inner>[^<>]++)</(?P=tag)[ \t]*+>|/?>)"""
    rf"""|(?<![A-Za-z0-9_.-])(?:--?)?+(?P<go>(?:var|const)[ \t]++)?(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)(?:(?P<call>\((?=[ \t]*+["']))|(?:[ \t]*+\??:[ \t]*+{TYPE}(?=[ \t]*+=(?![=>]))|(?(go)[ \t]++{TYPE}(?=[ \t]*+=(?![=>]))|(?!)))?[ \t]*+{_OPERATOR})""",
    re.DOTALL,
)
STRING = re.compile(r"""[rRbBuUfF]{0,2}(?:\"{3}((?:[^"\\]++|\\.|"(?!""))*+)\"{3}|'{3}((?:[^'\\]++|\\.|'(?!''))*+)'{3}|"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`([^`\n]*+)`)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([A-Za-z_][A-Za-z0-9_.:-]*+)[ \t]*+=[ \t]*+(?:"([^"\n]*+)"|'([^'\n]*+)')""")
BARE = re.compile(r"""[^\s,;"'(){}\[\]<>]++""")
#: What joins two literals, within a line or within parentheses.
JOINED = (re.compile(r"""[ \t]*+(?:\+|\.(?=[ \t]))?[ \t]*+(?=[rRbBuUfF]{0,2}["'`]|[A-Za-z_])"""), re.compile(r"""\s*+(?:\+|\.(?=\s))?\s*+(?=[rRbBuUfF]{0,2}["'`]|[A-Za-z_])"""))
BLOCK = re.compile(r"[ \t]*+[|>][+-]?[ \t]*+\n[ \t]++(?=\S)([^\n]*+)")
OPENED, BLANKS = re.compile(r"[ \t]*+(?:\(\s*+)*+"), re.compile(r"\s*+")
#: What ends a comment, by what begins it.
CLOSED = {"#": "\n", "//": "\n", "/*": "*/", "<!--": "-->"}
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How sensitive a part of a name is (fixed values); two parts that follow one another count as one too.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9,
    "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "authkey": 1.0, "bearer": 0.8, "auth": 0.6, "pin": 0.5,
}
#: Stand-ins: the words that begin them are followed by a separator, or by one of the words for a secret.
PLACEHOLDER = re.compile(
    r"^(?:\$\{.*|<.*|%.*%|x+|\*+|\.+|(?:your|my|the|some|test|dummy|example|sample|change)(?:[-_].*|(?:password|passwd|passphrase|pass|secret|token|api[-_]?key|key|value)?[0-9]*)"
    r"|change[-_ ]?(?:me|this|it)[-_!.0-9]*|your .*|none|null|true|false|todo)$",
    re.IGNORECASE,
)
THRESHOLD = 0.5


def sensitivity(name: str) -> float:
    """0 to 1: how much a name tells that its value is secret."""
    parts = [p.lower() for p in PARTS.findall(name)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *map("".join, zip(parts, parts[1:], strict=False))]), default=0.0)


def strength(literal: str) -> float:
    """0 to 1: how much a literal looks like a secret rather than a stand-in, or a sentence about secrets.

    Words and pass phrases reach the threshold with fully sensitive names only.
    """
    if len(literal) < LEAST_LITERAL or PLACEHOLDER.match(literal):
        return 0.0
    different = len(set(literal))
    if any(c.isspace() for c in literal):
        return 0.0 if sensitivity(literal) else min(1.0, different / 6) * 0.6
    kinds = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit))
    return min(1.0, different / 8) if kinds >= 2 else min(1.0, different / 6) * 0.6


@dataclass
class Literal:
    """What a literal holds, and where: from its first character to its last."""

    text: str
    start: int
    end: int


@dataclass
class Scopes:
    """Literals of names, as far as blocks and indented lines let them be seen."""

    known: dict[str, Literal | None] = field(default_factory=dict)
    entered: list[tuple[int, int, str, Literal | None]] = field(default_factory=list)
    depth: int = 0
    indent: int = 0

    def leave(self) -> None:
        """Forget what was given a literal in deeper blocks or lines; what it hid there is seen again."""
        while self.entered and (self.entered[-1][0] > self.depth or self.entered[-1][1] > self.indent):
            _, _, name, before = self.entered.pop()
            self.known[name] = before

    def give(self, name: str, literal: Literal | None) -> None:
        self.entered.append((self.depth, self.indent, name, self.known.get(name)))
        self.known[name] = literal


def string_at(text: str, at: int, end: int) -> tuple[Literal, int] | None:
    found = STRING.match(text, at, end)
    if not found:
        return None
    start, stop = found.span(found.lastindex)
    return Literal(re.sub(r"\\(.)", r"\1", text[start:stop], flags=re.DOTALL) if "\\" in found.group() else text[start:stop], start, stop), found.end()


def literal_at(text: str, at: int, end: int, scopes: Scopes) -> tuple[Literal | None, int, bool]:
    """The literal that the expression there stands for, where it ends, and whether that is a bare name that stands for none."""
    block = BLOCK.match(text, at, end)
    if block:
        return Literal(block[1].rstrip(), block.start(1), block.start(1) + len(block[1].rstrip())), block.end(), False
    opened = OPENED.match(text, at, end)
    inside = "(" in opened.group()
    at, pieces, here = opened.end(), [], []
    while True:
        string, name = string_at(text, at, end), IDENTIFIER.match(text, at, end)
        if string:
            here.append(string[0])
            pieces.append(string[0])
            at = string[1]
        elif name and scopes.known.get(name.group()) and text[name.end() : name.end() + 1] not in ("(", "["):
            pieces.append(scopes.known[name.group()])
            at = name.end()
        elif pieces:
            return None, at, False  # joined with what isn't known
        else:
            bare = BARE.match(text, at, end)
            if not bare or inside:
                return None, max(at, opened.end()), bare is not None
            unknown = IDENTIFIER.fullmatch(bare.group()) and not any(c.isdigit() for c in bare.group())
            return (None if unknown else Literal(bare.group(), *bare.span())), bare.end(), bool(unknown)
        more = JOINED[inside].match(text, at, end)
        if not more or not (more.group().strip() or string_at(text, more.end(), end)):
            break
        at = more.end()
    own = here or pieces
    return Literal("".join(p.text for p in pieces), own[0].start, own[-1].end), at, False


def assigned(text: str) -> list[tuple[int, int, float]]:
    """start, end and score of the literals that sensitive names get, straight or by way of other names.

    A name that was given a literal, or such a name, before stands for that literal where its scope
    reaches. Comments and strings are looked into as well, however deep, each as a scope of its own.
    A string within a string has other quotes, so there are few such levels; a comment that reaches
    to the end is gone on with in place, as comments within comments may be many.
    """
    found: list[tuple[int, int, float]] = []
    waiting = [(0, len(text))]

    def pair(name: str, literal: Literal) -> None:
        score = sensitivity(name) * strength(literal.text)
        if score >= THRESHOLD:
            found.append((literal.start, literal.end, score))

    while waiting:
        at, end = waiting.pop()
        scopes, stops = Scopes(), {}

        def look_into(start: int, stop: int) -> None:
            if "=" in (inner := text[start:stop]) or ":" in inner:
                waiting.append((start, stop))

        def stop_of(comment: str, start: int, end: int = end, stops: dict = stops) -> int:
            """Where the comment ends; what was found for one holds for all that begin before it."""
            mark = CLOSED[comment]
            if stops.get(mark, -1) < start:
                stops[mark] = text.find(mark, start, end) % (len(text) + 1)
            return min(stops[mark], end)

        while lexeme := LEXEME.search(text, at, end):
            at, kind = lexeme.end(), lexeme.lastgroup
            if lexeme["comment"]:
                stop = stop_of(lexeme["comment"], at)
                if stop == end:
                    scopes = Scopes()
                else:
                    look_into(at, stop)
                    at = stop + (len(CLOSED[lexeme["comment"]]) if CLOSED[lexeme["comment"]] != "\n" else 0)
            elif lexeme["string"]:
                own = string_at(text, lexeme.start(), end)
                if own:
                    look_into(own[0].start, own[0].end)
            elif lexeme["open"] or lexeme["close"]:
                scopes.depth = max(0, scopes.depth + (1 if lexeme["open"] else -1))
                scopes.leave()
            elif lexeme["indent"] is not None:
                scopes.indent = len(lexeme["indent"].expandtabs(4))
                scopes.leave()
            elif lexeme["tag"]:
                if lexeme["inner"]:
                    value = lexeme["inner"].strip()
                    start = lexeme.start("inner") + lexeme["inner"].index(value)
                    pair(lexeme["tag"], Literal(value, start, start + len(value)))
                    look_into(*lexeme.span("inner"))
                named = {m[1]: Literal(m[m.lastindex], *m.span(m.lastindex)) for m in ATTRIBUTE.finditer(text, *lexeme.span("attributes"))} if lexeme["attributes"] else {}
                for name, literal in named.items():
                    pair(name, literal)
                target = next((named[k].text for k in ("name", "key", "id") if k in named), None)
                if target and "value" in named:
                    pair(target, named["value"])
            elif kind != "escape" and (name := lexeme["key"] or lexeme["name"]):
                if lexeme["call"]:
                    own, method = string_at(text, BLANKS.match(text, at).end(), end), name.rpartition(".")[2]
                    if own and method.lower().startswith("set") and text.startswith(")", BLANKS.match(text, own[1]).end()):
                        pair(method[3:], own[0])
                    continue
                literal, at, unknown = literal_at(text, at, end, scopes)
                for inner in [literal] if literal and text[literal.start - 1 : literal.start] in ("'", '"', "`") else []:
                    look_into(inner.start, inner.end)
                if literal:
                    pair(name, literal)
                if (literal or unknown) and not lexeme["key"]:
                    scopes.give(name, literal)
    return sorted(set(found))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """start, kind and end of what the fixed patterns find, leftmost and not overlapping for each kind."""
    found = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_LITERAL]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def spans_of(text: str | None) -> list[dict]:
    """All spans of a text by start, then kind; those of the base are marked and have score 1."""
    if not text:
        return []
    base = base_spans(text)
    spans = {(start, kind, end): (True, 1.0) for start, kind, end in base}
    if "=" in text or ":" in text or "<" in text or "(" in text:
        known = sorted((start, end) for start, kind, end in base if kind == "assign")
        starts = [start for start, _ in known]
        for start, end, score in assigned(text):
            before = bisect_right(starts, start) - 1  # those of one kind don't overlap, so only the last one that starts before can hold it
            if before < 0 or known[before][1] < end:
                spans.setdefault((start, "assign", end), (False, score))
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
    return [{"kind": kind, "start": start, "end": end, "base": spans[start, kind, end][0], "score": spans[start, kind, end][1]} for start, kind, end in ordered]


SPANS = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int32(), "end": pa.int32(), "base": pa.bool_(), "score": pa.float64()}))


def secret_spans(text: Column) -> Column:
    """array<struct<kind, start, end, base, score>> of a text column; positions are code points, end exclusive."""

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([spans_of(value) for value in batch.to_pylist()], SPANS)

    return F.arrow_udf(scan, "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")(text)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and spans, one row for each row of docs; other columns aren't read.

    A null or empty text has no spans; rows that repeat, and null ids, stay as they are; no
    documents give no rows. Of spans alike in kind and place one is given, the base's if it is one of
    them. Long texts are scanned whole, in time about in proportion to them.
    """
    python_batches(docs.sparkSession)
    return docs.select("doc_id", secret_spans(F.col("text")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and a digest of the base, and all spans."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])
    counts = [F.size(F.filter(base, of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return scanned(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))
