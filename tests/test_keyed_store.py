from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_history import OCCURRENCE, occurrence, random_occurrences, shown

from stackloom.functions.text import sig_id
from stackloom.operators import history
from stackloom.sources import keyed_store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = random_occurrences(600)
    path = str(tmp_path_factory.mktemp("keyed") / "h")
    for n in range(3):
        assert keyed_store.upsert(spark.createDataFrame(rows[n * 200 : n * 200 + 200], OCCURRENCE), path, f"{n:03d}", buckets=8)
    return path, rows


@pytest.fixture
def nothing_shared(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_versions_fold_bucket_by_bucket(spark, stored):
    path, rows = stored
    got = keyed_store.read_keyed(spark, path)
    assert shown(got) == shown(history.new_history(spark.createDataFrame(rows, OCCURRENCE)))
    assert "Exchange" not in plan(got) and "Bucketed: true" in plan(got)
    two = keyed_store.read_keyed(spark, path, before="002")
    assert shown(two) == shown(history.new_history(spark.createDataFrame(rows[:400], OCCURRENCE)))
    assert keyed_store.read_keyed(spark, path, before="000").count() == 0


def test_lookup_moves_only_the_ids(spark, stored, nothing_shared):
    path, rows = stored
    whole = keyed_store.read_keyed(spark, path)
    some = [r.sig_id for r in whole.orderBy("signature").limit(4).collect()]
    ids = spark.createDataFrame([(i,) for i in [*some, some[0], None, Decimal(17)]], "sig_id decimal(20,0)").repartition(3)
    found = keyed_store.lookup(spark, path, ids)
    assert shown(found) == shown(whole.where(F.col("sig_id").isin(some)))
    # the one exchange by key is on the side of the ids: the side of the table has none
    sides = plan(found).split("SortMergeJoin")[1].split("FileScan parquet")
    assert "Exchange" not in sides[0] and plan(found).count("Exchange hashpartitioning(sig_id") == 1


def test_point_reads_only_its_buckets(spark, stored):
    path, _ = stored
    one = keyed_store.read_keyed(spark, path).where("signature = 'hot'").first()
    found = keyed_store.point(spark, path, [int(one.sig_id)])
    assert [tuple(r) for r in found.collect()] == [tuple(one)]
    assert "SelectedBucketsCount: 1 out of 8" in found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert keyed_store.point(spark, path, []).count() == 0


def test_versions_are_written_once(spark, tmp_path):
    path = str(tmp_path / "h")
    assert keyed_store.compact_keyed(spark, path) is None and keyed_store.read_keyed(spark, path).count() == 0
    assert keyed_store.lookup(spark, path, spark.createDataFrame([(1,)], "sig_id long")).count() == 0
    rows = [spark.createDataFrame([occurrence(f"d{n}", "sig-A", n)], OCCURRENCE) for n in range(4)]
    assert keyed_store.upsert(rows[0], path, "000", 4) and not keyed_store.upsert(rows[0], path, "000")
    # a version that broke off counts for nothing and is written again
    (tmp_path / "h" / "buckets=4" / "version=001").mkdir()
    (tmp_path / "h" / "buckets=4" / "version=001" / "part-x_00000.c000.snappy.parquet").write_bytes(b"broken")
    assert [r["count"] for r in keyed_store.read_keyed(spark, path).collect()] == [1]
    assert keyed_store.upsert(rows[1], path, "001") and keyed_store.upsert(rows[2], path, "002")
    before = shown(keyed_store.read_keyed(spark, path))
    assert keyed_store.compact_keyed(spark, path) == "upto=002" and shown(keyed_store.read_keyed(spark, path)) == before
    assert not keyed_store.upsert(rows[3], path, "001") and keyed_store.upsert(rows[3], path, "003")
    assert [r["count"] for r in keyed_store.read_keyed(spark, path).collect()] == [4]
    with pytest.raises(ValueError, match="has 4 buckets"):
        keyed_store.upsert(rows[3], path, "004", 5)


def test_lookup_computes_the_ids_once(spark, tmp_path):
    """ids that are made distinct first are not computed again in front of that, once a row."""
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n bigint, signature string")
    occurrences = rows.select(
        F.col("n").alias("doc_id"), F.timestamp_seconds("n").alias("ts"), "signature", *(F.lit("x").alias(c) for c in ("representative", "language", "cause", "fixes", "model")),
        F.array(F.lit(1.0)).alias("embedding"),
    )
    keyed_store.upsert(occurrences, str(tmp_path), "0", buckets=2)
    ids = rows.select("signature").distinct().select(sig_id(F.col("signature")).alias("sig_id"))
    found = keyed_store.lookup(spark, str(tmp_path), ids)
    assert sorted(r.signature for r in found.collect()) == ["a", "b"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("_unsigned(") == 1
