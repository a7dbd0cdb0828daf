"""URL filtering by rules, and beyond them by the words in host names and paths.

A rule names a host and a path's beginning and blocks or allows; it fits its host
and all subdomains, and of the rules that fit the longest wins. Other urls are
judged by a multinomial naive Bayes classifier over the tokens of host and path.
Its examples are the urls that a rule decides, all of them.

Host labels are concatenated names (``cheap-pills``, ``spamfarm``). A unigram
model splits them: of all ways to cut a label the one with the most probable
words wins (Viterbi). Parts are the runs of letters of host and path; the words are the
beginnings and ends that several distinct parts of the table share, with their
counts over all of them. Every distinct part is cut in parallel: its substrings
are joined with the counts, and only a part's own words meet in one task. A
substring that was never seen costs its letters one by one, and a part that needs
one is left whole. Part by part the log odds of the tokens are added up, so no
vocabulary is held in memory.

Null urls, and urls without ``://``, have an empty host and path; no rule fits an
empty host. A url without tokens, or without examples of both verdicts to learn
from, gets the verdict that the examples favour, and ``allow`` on a tie. Ports
and user names stay part of the host. Repeated rows and repeated or missing
``page_id`` are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import texts as X

MOST_LETTERS = 24  # of a word
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (
    Rule("allow", "org"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule that fits as a struct of its name and verdict, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    hit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in reversed(ordered):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        hit = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(hit)
    return hit


def _parts(host: Column, path: Column) -> Column:
    """Host labels and path pieces: runs of letters, each with what it is part of."""
    labels = F.regexp_extract_all(host, F.lit("[^\\x00-\\x60\\x7B-\\x7F]+"), F.lit(0))
    pieces = F.regexp_extract_all(F.translate(path, UPPER, LOWER), F.lit("[^\\x00-\\x60\\x7B-\\x7F]+"), F.lit(0))
    return F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("h"), x)), F.transform(pieces, lambda x: F.concat(F.lit("p"), x))))


def segment(part: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable words of a part under a unigram model; the part itself if no cut gives only known words."""
    best, back = [0.0] + [-math.inf] * len(part), [0] * (len(part) + 1)
    unseen = math.log(0.5 / (total + 1))
    for end in range(1, len(part) + 1):
        for start in range(max(0, end - MOST_LETTERS), end):
            word = part[start:end]
            seen = counts.get(word)
            cost = math.log(seen / (total + 1)) if seen else unseen * len(word)
            if best[start] + cost > best[end]:
                best[end], back[end] = best[start] + cost, start
    words, at = [], len(part)
    while at:
        words.append(part[back[at] : at])
        at = back[at]
    return words[::-1] if all(w in counts for w in words) else [part]


def segmented(parts: DataFrame) -> DataFrame:
    """``part`` and ``words`` for rows ``part``, one each."""
    letters = F.length("part")
    edge = F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.least(letters, F.lit(MOST_LETTERS))),
                lambda k: F.array(F.substring(F.col("part"), F.lit(1), k), F.substring(F.col("part"), letters - k + 1, k)),
            )
        )
    )
    counted = parts.where(letters > 0).select(F.explode(edge).alias("word"), F.lit(1).alias("one")).groupBy("word").agg(F.sum("one").cast("bigint").alias("c"))
    known = X.written(counted.where((F.col("c") > 1) & (F.length("word") > 2)))
    total = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("t")).first()["t"]
    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(1), letters),
            lambda s: F.transform(F.sequence(F.lit(1), F.least(letters - s + 1, F.lit(MOST_LETTERS))), lambda k: F.substring(F.col("part"), s, k)),
        )
    )
    spelled = parts.where(letters > 0).select("part", F.explode(F.array_distinct(inside)).alias("word"))
    met = spelled.join(known, "word").groupBy("part").agg(F.collect_list(F.struct("word", "c")).alias("known"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for part, seen in zip(batch.column("part").to_pylist(), batch.column("known").to_pylist()):
                words.append(segment(part, {x["word"]: x["c"] for x in seen or []}, total))
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(words, pa.list_(pa.string()))], names=["part", "words"])

    return parts.where(letters > 0).select("part").join(met, "part", "left").mapInArrow(cut, X.schema("part string, words array<string>"))


def judge(df: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every row's ``key``, ``host``, ``path``, ``rule``, ``verdict`` and ``log_odds`` (of blocking; of the tokens)."""
    address = F.col(url).cast("string")
    rows = df.select(F.col(key).cast("long").alias("key"), host_of(address).alias("host"), path_of(address).alias("path"))
    ruled = rows.withColumn("hit", matched(F.col("host"), F.col("path"), rules)).withColumn("parts", _parts(F.col("host"), F.col("path")))
    # urls with the same parts and the same verdict are one row with a count
    kinds = X.written(ruled.groupBy("parts", F.col("hit")["verdict"].alias("verdict")).agg(F.count(F.lit(1)).alias("n")))
    each = kinds.select(F.explode("parts").alias("tagged"), "verdict", "n")
    parts = each.select(F.substring("tagged", 2, 1 << 20).alias("part")).distinct()
    words = X.written(segmented(parts))
    tokens = (
        each.groupBy("tagged")
        .agg(F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("block"), F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("allow"))
        .withColumn("part", F.substring("tagged", 2, 1 << 20))
        .join(words, "part")
        .select("tagged", "block", "allow", F.explode(F.transform("words", lambda w: F.concat(F.substring("tagged", 1, 1), w))).alias("token"))
    )
    counts = X.written(tokens.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")))
    whole = counts.agg(F.coalesce(F.sum("block"), F.lit(0)).alias("block"), F.coalesce(F.sum("allow"), F.lit(0)).alias("allow"), F.count(F.lit(1)).alias("v")).first()
    ruled_n = {r["verdict"]: r["n"] for r in kinds.where(F.col("verdict").isNotNull()).groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    prior = math.log((ruled_n.get("block", 0) + 1) / (ruled_n.get("allow", 0) + 1))
    odds = F.log((F.col("block") + 1) / F.lit(float(whole["block"] + whole["v"]))) - F.log((F.col("allow") + 1) / F.lit(float(whole["allow"] + whole["v"])))
    per_part = tokens.join(counts.select("token", odds.alias("odds")), "token").groupBy("tagged").agg(F.sum("odds").alias("odds"))
    # only distinct lists of parts are scored; rows find theirs by it
    lists = kinds.select("parts").distinct()
    open_lists = lists.select("parts", F.explode("parts").alias("tagged"))
    scored = open_lists.join(per_part, "tagged").groupBy("parts").agg(F.sum("odds").alias("odds"))
    judged = X.written(lists.join(scored, "parts", "left").select("parts", (F.coalesce("odds", F.lit(0.0)) + F.lit(prior)).alias("log_odds")))
    own = F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(judged, "parts").select("key", "host", "path", F.col("hit")["rule"].alias("rule"), F.coalesce(F.col("hit")["verdict"], own).alias("verdict"), "log_odds")
