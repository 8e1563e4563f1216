import random
import re

import pytest
from pyspark.sql import functions as F

from stackloom.functions import fixed
from stackloom.functions.language import detect_language, language_scores
from stackloom.operators import rules

TEXTS = [
    "panic: runtime error\n\ngoroutine 1 [running]:\nmain.f()\n\t/usr/local/go/src/a.go:12",
    'Traceback (most recent call last):\n  File "a.py", line 3, in f\nValueError: x',
    'Exception in thread "main" java.lang.E\n\tat a.b.C.d(C.java:3)\nCaused by: x',
    "TypeError: x\n    at f (a.js:1:2)\n    at node:internal/x:1:2",
    "a.rb:3:in 'f'",
    "thread 'main' panicked at src/main.rs:1:2:\nstack backtrace:",
    "Unhandled exception. System.IOException: x\n   at A.B() in /a.cs:line 3",
    "nothing at all",
    "",
    None,
    "Error: " * 5000,
    "é panic: x.go:1 panicked at a.rs:1:2",
]


def test_fixed_rules_as_a_table(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string").repartition(3)
    text = F.coalesce("text", F.lit(""))
    want = docs.select("doc_id", detect_language(text).alias("language"), *(s.alias(n) for n, s in language_scores(text).items())).collect()
    for size in (rules.GROUP_BYTES, 60):
        got = {r["doc_id"]: r for r in rules.score_rules(docs, rules.language_rules(spark), group_bytes=size).collect()}
        for row in want:
            assert got[row["doc_id"]]["language"] == row["language"]
            assert got[row["doc_id"]]["scores"] == {n: row[n] for n in fixed.LANGUAGE_PRIORITY if row[n]}


def test_five_thousand_rules(spark):
    rng = random.Random(2)
    table = [(f"lang{i % 300}", rf"\bcode{i}\s*=\s*\d+", f"code{i}", i % 300) for i in range(5000)]
    table += [("any", r"\d\d\d\d\d", "", 999), ("any", r"^start", None, 999), ("plain", "[x]".replace("[", r"\[").replace("]", r"\]"), "[x]", 5)]
    docs = []
    for i in range(400):
        words = [rng.choice([f"code{rng.randrange(5100)}={rng.randrange(9)}", f"code{rng.randrange(5000)}", "word", "[x]", "é", "12345"]) for _ in range(rng.randrange(60))]
        docs.append((i, rng.choice(["start ", ""]) + " ".join(words)))
    got = rules.score_rules(spark.createDataFrame(docs, "doc_id int, text string").repartition(4), spark.createDataFrame(table, rules.RULE_SCHEMA)).collect()
    compiled = [(l, re.compile(p, re.ASCII), place) for l, p, _, place in table]
    texts = dict(docs)
    for row in got:
        scores, places = {}, {}
        for language, pattern, place in compiled:
            if pattern.search(texts[row["doc_id"]]):
                scores[language] = scores.get(language, 0) + 1
                places[language] = place
        assert row["scores"] == scores
        assert row["language"] == min(((-n, places[l], l) for l, n in scores.items()), default=(0, 0, "generic"))[2]


def test_only_patterns_of_needles_that_occur_are_tried(spark):
    found = rules._found(["aa", "", "b", "aa", "zz"])
    df = spark.createDataFrame([("xaab",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(found("text")).collect()] == [[0, 1, 2, 3], [1], []]


def test_no_rules_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "panic: x")], "doc_id int, text string")
    none = spark.createDataFrame([], rules.RULE_SCHEMA)
    assert [tuple(r) for r in rules.score_rules(docs, none).collect()] == [(1, "panic: x", {}, "generic")]
    assert rules.score_rules(docs.limit(0), rules.language_rules(spark)).count() == 0


@pytest.mark.parametrize("columns", [1, 2])
def test_no_exchange(spark, columns):
    docs = spark.createDataFrame([(1, "panic: x")], "doc_id int, text string")
    plan = rules.score_rules(docs, rules.language_rules(spark), group_bytes=2000 // columns)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
