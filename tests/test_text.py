import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stackloom.functions import text as t


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for byte in data:
        h = ((h ^ byte) * 0x100000001B3) % 2**64
    return h


def test_cut_bytes_never_splits_a_character(spark):
    samples = ["é" * 20, "a" + "é" * 20, "😀" * 9, "ab😀" * 9, "日本語テキスト", "plain ascii text", "", "a" * 12, "aé😀日" * 5]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for n in (4, 5, 6, 7, 12, 13):
        rows = df.select("s", t.cut_bytes(F.col("s"), n).alias("c"), t.excerpt(F.col("s"), n).alias("e")).collect()
        for row in rows:
            want = row.s.encode()[:n].decode(errors="ignore")
            assert row.c == want
            assert row.e == (row.s if len(row.s.encode()) <= n else want + "…")


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=40), min_size=1, max_size=30))
def test_ids_and_cuts_of_any_text(spark, texts):
    texts = [s.encode("utf-8", "ignore").decode() for s in texts]
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    for row in df.select("s", t.sig_id(F.col("s")).alias("id"), t.cut_bytes(F.col("s"), 9).alias("c")).collect():
        assert int(row.id) == fnv(row.s.encode())
        assert row.c == row.s.encode()[:9].decode(errors="ignore")


def test_known_id(value):
    assert int(value(t.sig_id, "sig")) == 9387920657954420066


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2024-01-01T00:00:00Z ERROR connection refused", "ERROR connection refused"),
        ("2024-01-01 00:00:00.123 x\n2024-01-01T00:00:01Z y", "x y"),
        ("12:00:01 late", "late"),
        ("2024-01-01T00:00:00+02:00 x", "+02:00 x"),
        ("at 0xdeadBEEF [42] pid=7 goroutine 9 foo.go:12", "at 0xADDR [PID] pid=N goroutine N foo.go:N"),
        ("index out of range [5] with length 3", "index out of range [PID] with length 3"),
        ("épid=7 rapid=8", "épid=N rapid=8"),
        ("a \t b\r\n c  d", "a b c d"),
        ("2024-01-01T00:00:00Z", ""),
        ("job.py:3: [x] [12]", "job.py:N: [x] [PID]"),
    ],
)
def test_normalize(value, raw, want):
    assert value(t.normalize, raw) == want


@pytest.mark.parametrize(
    "function, want",
    [
        ("main.(*Server).Handle", "Handle"), ("main.run", "run"), ("pkg.foo", "foo"), ("Bar", "Bar"), ("foo()", "foo"), ("", ""),
        ("(*Server).Handle", "Handle"), ("(*pkg.Server)", "Server"), ("(T)", "T"), ("main.run(...)", ")"), ("  pad.x  ", "x"),
        ("main.f(0x1, 0x2)", "f(0x1, 0x2)"),
    ],
)
def test_symbol_name(value, function, want):
    assert value(t.symbol_name, function) == want


@pytest.mark.parametrize(
    "line, want",
    [
        ("WHAT HAPPENED:", "WHAT HAPPENED"), ("## probable cause", "PROBABLE CAUSE"), ("- Evidence:", "EVIDENCE"),
        ("EVIDENCE: none", None), ("**EVIDENCE**", None), ("Evidence of a leak", "EVIDENCE"), ("evidences", None), ("", None),
        ("**Potential fixes:", "POTENTIAL FIXES"), ("  * INVESTIGATE ::", "INVESTIGATE"), ("INVESTIGATE::", "INVESTIGATE"),
    ],
)
def test_marker(value, line, want):
    assert value(t.marker, line) == want


@pytest.mark.parametrize("raw, want", [("42", 42), ("", 0), ("x", 0), ("9" * 30, 0)])
def test_to_int(value, raw, want):
    assert value(t.to_int, raw) == want


def test_small_formats(spark):
    row = spark.range(1).select(
        t.join_ints(F.array(F.lit(12), F.lit(8), F.lit(12))).alias("marks"),
        t.rfc3339(F.lit(dt.datetime(2026, 8, 5, 1, 2, 3)).cast("timestamp")).alias("ts"),
        t.day(F.lit(dt.datetime(2026, 8, 5, 1, 2, 3)).cast("timestamp")).alias("day"),
        t.strip_container(F.lit("/workspace/cmd/root.go")).alias("p1"),
        t.strip_container(F.lit("/workspaces/cmd/root.go")).alias("p2"),
        t.starts_block(F.lit("Caused by: x")).alias("b1"),
        t.starts_block(F.lit(" ERROR x")).alias("b2"),
    ).first()
    assert (row.marks, row.day, row.p1, row.p2, row.b1, row.b2) == (
        "8,12", "2026-08-05", "cmd/root.go", "/workspaces/cmd/root.go", True, False,
    )
    assert row.ts == "2026-08-05T01:02:03Z"


def test_payload_coercion(spark):
    rows = [
        ('{"count": 3, "cause": "c", "first_seen": "2026-08-01T00:00:00Z"}', 3, "c", "2026-08-01T00:00:00Z"),
        ('{"count": "3", "cause": 5, "first_seen": "yesterday"}', 0, "", None),
        ('{"cause": null}', 0, "", None),
        ('{"meta": {"count": "5", "cause": 1}, "count": 7, "cause": "x"}', 7, "x", None),
        ('{"cause": {"cause": "x"}, "count": [1]}', 0, "", None),
        ("no json", 0, "", None),
        ('{"count": 2.9, "cause": "say \\"count\\": \\"9\\"", "first_seen": "2026-08-01T02:00:00+02:00"}', 2, 'say "count": "9"', "2026-08-01T00:00:00Z"),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "p string").withColumn("p", t.payload(F.col("p"))).select(
        t.payload_int(F.col("p"), "count"), t.payload_text(F.col("p"), "cause"), t.rfc3339(t.payload_time(F.col("p"), "first_seen"))
    )
    assert [tuple(r) for r in df.collect()] == [r[1:] for r in rows]


def test_ids_of_many_texts_take_no_step_a_byte(spark):
    """Ids are hashed for many texts at once; long, empty and missing ones among them."""
    texts = [None, "", "é😀" * 700, *(f"text {n} " * (n % 5) for n in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, s string").coalesce(1)
    ids = df.select("n", t.sig_id(F.col("s")).alias("id"))
    assert {r.n: r.id and int(r.id) for r in ids.collect()} == {n: None if s is None else fnv(s.encode()) for n, s in enumerate(texts)}
    assert "aggregate(" not in ids._jdf.queryExecution().optimizedPlan().toString()


def test_signature_steps_are_not_inside_each_other(spark):
    """The variable of a lambda inside a lambda has its type looked up anew through all levels."""
    plan = spark.createDataFrame([("a",)], "s string").select(t.normalize(F.col("s")).alias("n"))._jdf.queryExecution().analyzed().toString()
    depth = deepest = 0
    opened = []
    for place, sign in enumerate(plan):
        if sign == "(":
            opened.append(plan[:place].endswith("lambdafunction"))
            depth += opened[-1]
            deepest = max(deepest, depth)
        elif sign == ")" and opened:
            depth -= opened.pop()
    assert "lambdafunction(" in plan
    assert deepest == 1


def test_blank_runs_collapse(spark):
    texts = ["a b", " a  b ", "a\t b", "a \t\u00a0b", "a\u3000b\n\nc", "\u00a0 a\u00a0", "   ", ""]
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    import re

    for row in df.select("s", t.normalize(F.col("s")).alias("n")).collect():
        assert row.n == re.sub(r"\s+", " ", row.s).strip(" ")
