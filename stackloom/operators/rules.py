"""Detection by rules that are a table (D1, E2): any number of them, changed without changing code.

A rule is a language, a pattern, a needle (text that each match of the pattern contains) and the place of its language, which
settles ties.  One pass over a text finds all needles it contains, whatever their number, and only the patterns of those are
tried.  Rules go to every task in groups of bounded size.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions import fixed
from stackloom.functions.language import is_plain, rule_pattern

RULE_SCHEMA = "language string, pattern string, needle string, place int"
#: Bytes of patterns and needles in a group.
GROUP_BYTES = 1 << 20


def language_rules(spark: SparkSession) -> DataFrame:
    """The fixed rules as a table."""
    place = {language: i for i, language in enumerate(fixed.LANGUAGE_PRIORITY)}
    return spark.createDataFrame([(*rule, place[rule[0]]) for rule in fixed.LANGUAGE_RULES], RULE_SCHEMA)


def _groups(rules: DataFrame, group_bytes: int) -> list[list]:
    groups: list[list] = [[]]
    size = 0
    rows = rules.select("language", "pattern", F.coalesce("needle", F.lit("")).alias("needle"), "place")
    for rule in rows.where(F.col("language").isNotNull() & F.col("pattern").isNotNull()).orderBy("place", "language", "pattern", "needle").toLocalIterator():
        own = len(rule["pattern"].encode()) + len(rule["needle"].encode())
        if groups[-1] and size + own > group_bytes:
            groups.append([])
            size = 0
        groups[-1].append(rule)
        size += own
    return groups


def _found(needles: list[str]):
    """A column function: the numbers of the needles that a text contains, and of empty ones."""
    places: dict[str, list[int]] = {}
    for number, needle in enumerate(needles):
        places.setdefault(needle, []).append(number)
    always = places.pop("", [])
    automaton = ahocorasick.Automaton()
    for needle, numbers in places.items():
        automaton.add_word(needle, tuple(numbers))
    if places:
        automaton.make_automaton()

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            text = value.as_py()
            if text is None:
                out.append([])
                continue
            hits = {numbers for _, numbers in automaton.iter(text)} if places else set()
            out.append(sorted([*always, *(n for numbers in hits for n in numbers)]))
        return pa.array(out, pa.list_(pa.int32()))

    return found


def _matched(text: Column, hits: Column, group: list) -> Column:
    """Language and place of the rules of a group that match."""
    plain = F.lit([is_plain(r["pattern"], r["needle"]) for r in group])
    patterns = F.lit([rule_pattern(r["pattern"]) for r in group])
    languages, places = F.lit([r["language"] for r in group]), F.lit([int(r["place"] or 0) for r in group])
    true = F.filter(hits, lambda i: F.get(plain, i) | F.regexp_like(text, F.get(patterns, i)))
    return F.transform(true, lambda i: F.struct(F.get(languages, i).alias("language"), F.get(places, i).alias("place")))


def score_rules(df: DataFrame, rules: DataFrame, text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``df`` with ``scores``, a map from language to the number of its rules that match, and ``language``.

    The language with the highest score wins; ties go to the smaller place, then to the smaller name; ``generic`` if no rule
    matches, also for a null text.  Repeated rules count as often as they are there.  No row is moved.
    """
    text = F.col(text_col)
    groups = [g for g in _groups(rules, group_bytes) if g]
    names = [f"_hits{i}" for i in range(len(groups))]
    searched = df.select("*", *(_found([r["needle"] for r in g])(text).alias(n) for n, g in zip(names, groups, strict=True)))
    matched = [_matched(text, F.col(n), g) for n, g in zip(names, groups, strict=True)]
    empty = F.array().cast("array<struct<language:string,place:int>>")
    # through an explode, so that the patterns are tried once however often the result is looked at
    listed = searched.select(*df.columns, F.explode_outer(F.array(F.concat(empty, *matched))).alias("_matched"))
    kinds = F.array_distinct(F.col("_matched.language"))
    counts = F.transform(kinds, lambda l: F.struct(l, F.size(F.filter("_matched", lambda m: m["language"] == l))))
    ranked = F.transform(
        kinds,
        lambda l: F.struct(
            (-F.size(F.filter("_matched", lambda m: m["language"] == l))).alias("minus"),
            F.array_min(F.transform(F.filter("_matched", lambda m: m["language"] == l), lambda m: m["place"])).alias("place"),
            l.alias("language"),
        ),
    )
    best = F.coalesce(F.array_min(ranked)["language"], F.lit(fixed.GENERIC))
    return listed.select(*df.columns, F.map_from_entries(counts).alias("scores"), best.alias("language"))
