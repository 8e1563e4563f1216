import datetime as dt

from pyspark.sql import functions as F

from stackloom.functions import fixed
from stackloom.operators import prompts, sections


def reply(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t, "m") for i, t in enumerate(texts)], "doc_id string, content string, model string")


def parsed(spark, text):
    return [(r.title, r.body) for r in sections.parse_sections(reply(spark, text)).orderBy("pos").collect()]


def test_sections(spark):
    text = "Sure!\n## What happened:\nboom\n\n  now\n- probable cause\nx\nEvidence of a leak is lost\nkept\nEVIDENCE: not a marker\n"
    assert parsed(spark, text) == [
        ("WHAT HAPPENED", "boom\n\n  now"), ("PROBABLE CAUSE", "x"), ("EVIDENCE", "kept\nEVIDENCE: not a marker"),
    ]
    assert parsed(spark, "no markers\n**EVIDENCE**") == []
    assert parsed(spark, "EVIDENCE:\nEVIDENCE:") == [("EVIDENCE", ""), ("EVIDENCE", "")]


def test_summary(spark):
    text = "WHAT HAPPENED:\na write failed\n\nPROBABLE CAUSE:\nthe disk ran full\n\nPOTENTIAL FIXES:\n- free space\n- rotate logs\n"
    twice = "PROBABLE CAUSE:\nfirst\nPROBABLE CAUSE:\nsecond"
    long = "PROBABLE CAUSE:\n" + "é" * 600
    rows = [(r.cause, r.fixes) for r in sections.cause_fixes(reply(spark, text, twice, "nothing", long)).orderBy("doc_id").collect()]
    assert rows == [("the disk ran full", "- free space\n- rotate logs"), ("second", ""), ("", ""), ("é" * 600, "")]
    cut = sections.cause_fixes(reply(spark, long), max_bytes=1000).first()
    assert cut.cause == "é" * 500 + "…"


def priors(spark, *rows):
    schema = "doc_id string, rank int, score double, count bigint, last_seen timestamp, cause string, fixes string"
    return spark.createDataFrame([(d, r, s, n, dt.datetime(2026, 8, 5), c, f) for d, r, s, n, c, f in rows], schema)


def test_prior_block(spark):
    rows = [("d", 2, 0.9, 1, "", None), ("d", 1, 0.871, 4, "no route", "open the port"), ("e", 1, 0.9, 1, "c" * 600, "")]
    df = priors(spark, *rows)
    blocks = {r.doc_id: r.prior_block for r in prompts.prior_block(df).collect()}
    assert blocks["d"] == (
        "--- PRIOR OCCURRENCES ---\n[1] similarity 0.87, seen 4 time(s), last 2026-08-05\nPROBABLE CAUSE: no route\n"
        "POTENTIAL FIXES: open the port\n[2] similarity 0.90, seen 1 time(s), last 2026-08-05\n--- END PRIOR OCCURRENCES ---"
    )
    assert "PROBABLE CAUSE: " + "c" * 600 + "\n" in blocks["e"]
    short = {r.doc_id: r.prior_block for r in prompts.prior_block(df, max_bytes=500).collect()}
    assert "PROBABLE CAUSE: " + "c" * 500 + "…\n" in short["e"]
    never = prompts.prior_block(df.withColumn("last_seen", F.lit(None).cast("timestamp"))).first()
    assert "last unknown" in never.prior_block and "null" not in never.prior_block


def test_prompts_leave_out_what_is_empty(spark):
    errors = spark.createDataFrame(
        [("a", "boom", "inline", False, ""), ("b", "bang", "stdin", True, "{}"), ("c", "crash", "x/y.log", False, "")],
        "doc_id string, text string, origin string, truncated boolean, context_json string",
    )
    source = spark.createDataFrame([("b", "### f"), ("c", "")], "doc_id string, source_block string")
    prior = spark.createDataFrame([("b", "PRIOR"), ("z", "PRIOR")], "doc_id string, prior_block string")
    rows = {r.doc_id: r for r in prompts.build_prompts(errors, source, prior).collect()}
    assert rows["a"].user_prompt == fixed.NOTE_INLINE + "\n\n--- INPUT START ---\nboom\n--- INPUT END ---"
    assert rows["b"].user_prompt == (
        fixed.NOTE_STDIN + fixed.NOTE_TRUNCATED + "\n\n"
        "--- PARSED CONTEXT ---\n{}\n--- END CONTEXT ---\n\n--- RELEVANT SOURCE ---\n### f\n--- END SOURCE ---\n\nPRIOR\n\n"
        "--- INPUT START ---\nbang\n--- INPUT END ---"
    )
    assert rows["c"].user_prompt.startswith(fixed.NOTE_FILE + "x/y.log\n\n--- INPUT START")
    assert len(rows) == 3
    alone = prompts.build_prompts(errors).where(F.col("doc_id") == "b").first()
    assert "RELEVANT SOURCE" not in alone.user_prompt and "PARSED CONTEXT" in alone.user_prompt
    assert all(label + ":" in alone.system_prompt for label in fixed.SECTION_LABELS)
