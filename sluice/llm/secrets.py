r"""Secrets in texts, found through an inverted index of trigrams, with DataFrame functions only.

Every rule is a regular expression. From it a Boolean query is derived: an OR of
ANDs of trigrams that any match must hold, in lower case. The index has a posting
(trigram, text) for each of the rules' trigrams that a text holds; texts are
named by their key and a hash. A rule's candidates are the texts in which the
postings of all trigrams of one AND meet, and only there the expression is run.
A rule that no trigram is mandatory for is run on all texts.

Matches are leftmost and do not overlap within a rule; those whose secret part is
too short are dropped. Offsets are code points.

Null texts count as empty and hold nothing. Rows without a key, and rows that
repeat one, are looked at like any others, each with its own text. Rules do not
see each other's matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_STRINGS = 256  # alternatives spelled out while trigrams are derived


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Java and RE2 share; ``group`` must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")

#: The base rules, in the order that ties follow.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the same spans as runs of one or more that have 24
)
#: Further kinds, with the same treatment.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN[A-Z\x20]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE

Clauses = frozenset[frozenset[str]]  # an OR of ANDs of trigrams


class _Parser:
    """Reads the syntax the rules use: literals, classes, groups, alternatives and quantifiers."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def alternatives(self) -> tuple[set[str] | None, list[Clauses]]:
        """The strings a part can be, if they are few, and queries that hold whenever it matches."""
        branches = [self.sequence()]
        while self.at < len(self.text) and self.text[self.at] == "|":
            self.at += 1
            branches.append(self.sequence())
        if len(branches) == 1:
            return branches[0]
        strings = [s for s, _ in branches]
        if all(s is not None for s in strings) and sum(map(len, strings)) <= MOST_STRINGS:
            return set().union(*strings), []
        parts = [_all([*queries, *_mandatory(s)]) for s, queries in branches]
        return None, [_simplified(frozenset().union(*parts))] if all(parts) else []

    def sequence(self) -> tuple[set[str] | None, list[Clauses]]:
        so_far: set[str] = {""}
        queries: list[Clauses] = []
        whole = True
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            strings, own = self.quantified()
            queries += own
            if strings is not None and len(so_far) * len(strings) <= MOST_STRINGS:
                so_far = {a + b for a, b in product(so_far, strings)}
                continue
            whole = False
            queries += _mandatory(so_far)
            so_far = strings if strings is not None else {""}
        if whole:
            return so_far, queries
        return None, [*queries, *_mandatory(so_far)]

    def quantified(self) -> tuple[set[str] | None, list[Clauses]]:
        strings, queries = self.atom()
        mark = self.text[self.at] if self.at < len(self.text) else ""
        if mark == "?":
            self.at += 1
            return (strings | {""}, []) if strings is not None else (None, [])
        if mark == "*":
            self.at += 1
            return None, []
        if mark == "+":
            self.at += 1
            return None, [*queries, *_mandatory(strings)]
        if mark == "{":
            end = self.text.index("}", self.at)
            low = int(self.text[self.at + 1 : end].split(",")[0])
            self.at = end + 1
            return None, [*queries, *_mandatory(strings)] if low else []
        return strings, queries

    def atom(self) -> tuple[set[str] | None, list[Clauses]]:
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            found = self.alternatives()
            self.at += 1
            return found
        if c == "[":
            end = self.at
            while self.text[end] != "]":
                end += 2 if self.text[end] == "\\" else 1
            members = self.text[self.at : end]
            self.at = end + 1
            chars = {chr(i).lower() for i in range(128) if re.fullmatch(f"[{members}]", chr(i))}
            return (chars, []) if len(chars) <= 8 and not members.startswith("^") else (None, [])
        if c == ".":
            return None, []
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                c = chr(int(self.text[self.at : self.at + 2], 16))
                self.at += 2
        return {c.lower()}, []


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _mandatory(strings: set[str] | None) -> list[Clauses]:
    """What holds if one of the strings occurs; nothing if one has no trigram."""
    if not strings or any(len(s) < 3 for s in strings):
        return []
    return [_simplified(frozenset(map(_trigrams, strings)))]


def _simplified(clauses: Iterable[frozenset[str]]) -> Clauses:
    """Without clauses that ask for more than another."""
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _all(queries: Sequence[Clauses]) -> Clauses:
    """Queries that must all hold, as one OR of ANDs."""
    if not queries:
        return frozenset()
    return _simplified(frozenset().union(*combination) for combination in product(*queries))


def trigram_query(pattern: str) -> Clauses:
    """An OR of ANDs of trigrams that any match holds, in lower case; empty if none is mandatory."""
    strings, queries = _Parser(pattern).alternatives()
    return _all([*queries, *_mandatory(strings)])


def _texts(df: DataFrame, key: str, text: str, carry: str | None = None) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("key"), whole.alias("text"), *([F.col(carry)] if carry else []))
    return rows.withColumn("mark", F.xxhash64("text"))


def build_index(df: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings: ``trigram`` (its number among the rules' trigrams), and ``key`` and ``mark`` of a text that holds it."""
    return _postings(_texts(df, key, text), _vocabulary(rules))


def _vocabulary(rules: Sequence[Rule]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for t in clause})


def _postings(texts: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    small = F.lower("text")
    held = [F.when(F.contains(F.col("small"), F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary)]
    found = texts.select("key", "mark", small.alias("small")).select("key", "mark", F.explode(F.array_compact(F.array(*held))).alias("trigram"))
    return found.select("trigram", "key", "mark")


def candidates(postings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``key``, ``mark`` and the kinds of the rules that may match there, where postings meet."""
    number = {t: i for i, t in enumerate(_vocabulary(rules))}
    # 60 trigrams to a word; a text's postings meet in as many words as there are
    words = -(-len(number) // 60)
    bits = [F.bit_or(F.when(F.col("trigram").between(60 * w, 60 * w + 59), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("trigram") % 60)).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in range(words)]
    met = postings.groupBy("key", "mark").agg(*bits)

    def holds(clause: frozenset[str]) -> Column:
        test = F.lit(True)
        for w in range(words):
            mask = sum(1 << number[t] % 60 for t in clause if number[t] // 60 == w)
            if mask:
                test = test & (F.col(f"w{w}").bitwiseAND(F.lit(mask)) == F.lit(mask))
        return test

    kinds = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        if query:
            any_clause = F.lit(False)
            for clause in sorted(query, key=sorted):
                any_clause = any_clause | holds(clause)
            kinds.append(F.when(any_clause, F.lit(rule.kind)))
    return met.select("key", "mark", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def _spans(rule: Rule, rank: int) -> Column:
    """The matches of a rule in ``text`` as structs of start, rank of the kind, kind and end."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    secret = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(whole.alias("m"), secret.alias("s"), F.slice(between, F.lit(1), F.size(whole)).alias("b"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["b"])
        end = start + F.length(part["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        found = F.when(F.length(part["s"]) >= rule.least, F.concat(state["found"], span)).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda s: s["found"])
    return F.when(F.rlike(text, pattern), walked).otherwise(none)


def scan(df: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """``key``, ``text``, a column to ``carry`` along, and all ``spans`` of every row, sorted by start and then by the order of the rules."""
    texts = _texts(df, key, text, carry)
    met = candidates(build_index(df, rules, key, text), rules).select(F.col("key").alias("__key"), F.col("mark").alias("__mark"), "kinds")
    joined = texts.join(met, F.col("key").eqNullSafe(F.col("__key")) & (F.col("mark") == F.col("__mark")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    each = []
    for rank, rule in enumerate(rules):
        spans = _spans(rule, rank)
        each.append(F.when(F.array_contains(F.coalesce(F.col("kinds"), F.array().cast("array<string>")), rule.kind), spans).otherwise(none) if trigram_query(rule.pattern) else spans)
    return joined.select("key", "text", *([carry] if carry else []), F.array_sort(F.concat(*each)).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, base: Sequence[Rule] = BASE) -> DataFrame:
    """The scan as one row of figures per document."""
    kinds = [r.kind for r in base]

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    own = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(F.col("key").alias("doc_id"), *map(of, kinds), F.sha2(spans_text(own), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """A text with every span replaced; spans that overlap are replaced together."""

    def cut(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        kept = F.when(s["start"] >= state["at"], F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), kept.alias("out"))

    def close(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, close)
