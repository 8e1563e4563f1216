import gzip
import random

import pytest
from pyspark.sql import functions as F

from stackloom.llm import warc


def pages(spark, n=60):
    rng = random.Random(1)
    rows = [(i, f"http://h{i}/é", "".join(rng.choice(["<p>", "\r\n\r\n", "WARC/1.0\r\n", "x" * 300, "ü"]) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    rows += [(n, None, None), (n + 1, "http://a\r\nb", ""), (None, "http://n/", "t"), (5, rows[5][1], rows[5][2]), (n + 2, "u", "y" * 200_000)]
    return rows, spark.createDataFrame([(*r, 3, "k") for r in rows], "page_id long, url string, html string, offset int, kind string")


@pytest.fixture(scope="module")
def replicas(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("warc")
    rows, df = pages(spark)
    archive = F.concat(F.lit("a-"), F.floor(F.coalesce("page_id", F.lit(0)) / 9).cast("string"))
    warc.archive_pages(df, archive, str(folder / "good"))
    return rows, folder


def test_archives_read_back(spark, replicas):
    rows, folder = replicas
    found = warc.read_records(spark, str(folder / "good"), with_bytes=True).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        head, _, rest = r["record"].partition(b"\r\n\r\n")
        assert len(r["record"]) == r["length"] and rest.endswith(b"\r\n\r\n") and head.startswith(b"WARC/1.0\r\n")
        by.setdefault(r["record_id"], []).append(rest[:-4].decode())
    for i, _, html in rows:
        assert (html or "") in by["<>" if i is None else f"<urn:page:{i}>"]
    for path in (folder / "good").glob("*/*.gz"):
        data = gzip.decompress(path.read_bytes())
        spans = list(warc.split_records(data))
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def audit(spark, folder, other):
    good, bad = (warc.read_records(spark, str(folder / x)) for x in ("good", other))
    return sorted((r["record_id"], r["kind"]) for r in warc.audit(good, bad).collect())


def test_equal_replicas(spark, replicas):
    _, folder = replicas
    warc.damaged_copy(warc.read_records(spark, str(folder / "good"), with_bytes=True), F.lit(False), str(folder / "same"))
    assert audit(spark, folder, "same") == []


def test_damage_is_located(spark, replicas, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 2000)
    monkeypatch.setattr(warc, "FAN", 2)
    _, folder = replicas
    good = warc.read_records(spark, str(folder / "good"), with_bytes=True)
    warc.damaged_copy(good, F.col("record_id").isin("<urn:page:7>", "<urn:page:30>", "<urn:page:60>"), str(folder / "hit"))
    assert audit(spark, folder, "hit") == [(f"<urn:page:{i}>", "changed") for i in (30, 60, 7)]
    monkeypatch.setattr(warc, "FAN", 16)
    assert audit(spark, folder, "hit") == [(f"<urn:page:{i}>", "changed") for i in (30, 60, 7)]


def test_lost_archives_and_damaged_headers(spark, replicas):
    _, folder = replicas
    good = warc.read_records(spark, str(folder / "good"), with_bytes=True)
    warc.write_archives(
        good.filter("archive != 'a-3'").select("archive", "offset", F.expr("substring(record, 1, length - 4)").cast("string").alias("value")).sortWithinPartitions("archive", "offset"),
        str(folder / "lost"),
    )
    assert audit(spark, folder, "lost") == sorted((f"<urn:page:{i}>", "missing") for i in range(27, 36))
    data = b"".join(r["record"] for r in good.filter("archive = 'a-1'").orderBy("offset").collect())
    spans = list(warc.split_records(data))
    a, b = spans[3]
    broken = bytearray(data)
    at = data.index(b"Content-Length: ", a) + 16
    broken[at] ^= 1
    assert [s for s in warc.split_records(bytes(broken)) if s[0] < a or s[0] >= b] == [s for s in spans if s != (a, b)]


@pytest.mark.parametrize("size", [2000, 1 << 16])
def test_lost_added_and_moved_records(spark, replicas, monkeypatch, size):
    monkeypatch.setattr(warc, "RANGE", size)
    _, folder = replicas
    rows = warc.read_records(spark, str(folder / "good"), with_bytes=True).select("archive", "offset", "record_id", F.expr("substring(record, 1, length - 4)").cast("string").alias("value"))

    def replica(name, df):
        warc.write_archives(df.select("archive", "offset", "value").sortWithinPartitions("archive", "offset"), str(folder / name))
        return audit(spark, folder, name)

    assert replica(f"without-{size}", rows.filter("NOT record_id <=> '<urn:page:10>'")) == [("<urn:page:10>", "missing")]
    new = rows.filter("record_id = '<urn:page:11>'").withColumns({"value": F.regexp_replace("value", "page:11>", "page:999>"), "offset": F.lit(1).cast("long")})
    assert replica(f"with-{size}", rows.unionByName(new)) == [("<urn:page:999>", "extra")]
    moved = rows.withColumn("offset", F.when(F.col("record_id") == "<urn:page:12>", 10**9).otherwise(F.col("offset")))
    assert replica(f"moved-{size}", moved) == []
    twice = rows.unionByName(rows.filter("record_id = '<urn:page:20>'").withColumn("offset", F.lit(10**9).cast("long")))
    both = twice.filter("NOT record_id <=> '<urn:page:21>'").withColumn("value", F.when(F.col("record_id") == "<urn:page:22>", F.regexp_replace("value", "http://h22/", "http://H22/")).otherwise(F.col("value")))
    found = replica(f"all-{size}", both)
    assert found == [("<urn:page:20>", "extra"), ("<urn:page:21>", "missing"), ("<urn:page:22>", "changed")]


def test_empty_table(spark, tmp_path):
    _, df = pages(spark, 6)
    warc.archive_pages(df.limit(0), F.lit("a"), str(tmp_path / "x"))
    none = warc.read_records(spark, str(tmp_path / "x"))
    assert none.count() == 0 and warc.audit(none, none).count() == 0
