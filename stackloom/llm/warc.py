"""WARC archives and their Merkle fixity audit.

Archives are written by Spark's text writer: a record is its header, an empty line and its payload, and the line separator is
the empty lines that end a WARC record.  They lie in one folder for each archive, gzip-compressed, and are read back as
records with offsets of the uncompressed archive.

The audit hashes records, and then ordered ranges of offsets into trees: a node is the hash of its children's offsets and
hashes, ranges grow by ``FAN`` from ``RANGE`` bytes to the whole archive, and archives are hashed in groups up to one root.
Two replicas are compared at their roots, and only children of nodes that differ are looked at, down to records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.llm.steps import written
from stackloom.llm.words import tidy

BREAK = "\r\n\r\n"
RANGE, FAN = 1 << 17, 16
_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*(\d+)[ \t]*\r?$")
_ID = re.compile(rb"(?im)^WARC-Record-ID:[ \t]*(\S+)[ \t]*\r?$")


def record_text(record_id: Column, uri: Column, payload: Column) -> Column:
    """A resource record without the empty lines at its end.  Line breaks in an address are percent-encoded."""
    payload = F.coalesce(payload, F.lit(""))
    uri = F.replace(F.replace(F.coalesce(uri, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <"), F.coalesce(record_id, F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")),
    )
    return F.concat(head, F.lit(BREAK), payload)


def write_archives(records: DataFrame, folder: str) -> None:
    """Writes (archive, value) rows, sorted within archives that lie in one partition each, to ``folder``."""
    records.select("value", "archive").write.partitionBy("archive").option("lineSep", BREAK).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder)


def archive_pages(pages: DataFrame, archive: Column, folder: str) -> None:
    """Writes (page_id, url, html) rows as archives, each in order of page_id, url and html.

    ``archive`` names a row's archive by letters, digits, ``-``, ``_`` and ``.``; it must spread rows, as an archive is written
    by one task.  Null texts are empty; a
    null id gives an empty record id; repeated rows are records of their own; other columns are ignored.
    """
    rows = pages.select(archive.cast("string").alias("archive"), "page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.repartition("archive").sortWithinPartitions("archive", "page_id", "url", "html")
    value = record_text(F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")), F.col("url"), F.col("html"))
    write_archives(rows.select("archive", value.alias("value")), folder)


def split_records(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the records of an archive, blank lines at their ends included.

    A record whose stated length does not lead to blank lines, or that has no header, reaches to the next one that begins
    after blank lines.
    """
    at, brk = 0, BREAK.encode()
    while at < len(data):
        head = data.find(brk, at)
        end = -1
        if data.startswith(b"WARC/", at) and head >= 0 and (m := _LENGTH.search(data, at, head + 2)):
            end = head + 4 + int(m[1]) + 4
        if not (end > 0 and end <= len(data) and data[end - 4 : end] == brk):
            following = data.find(brk + b"WARC/1.0\r\n", at)
            end = following + 4 if following >= 0 else len(data)
        yield at, end
        at = end


def read_records(spark: SparkSession, folder: str, with_bytes: bool = False) -> DataFrame:
    """archive, offset, length, record_id, sha256 and, if wanted, the bytes of all records of a replica."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                data = gzip.decompress(content.as_py())
                rows = []
                for start, end in split_records(data):
                    raw = data[start:end]
                    m = _ID.search(raw)
                    rows.append((archive.as_py(), start, end - start, m[1].decode("utf-8", "replace") if m else None, hashlib.sha256(raw).digest(), raw if with_bytes else None))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["archive", "offset", "length", "record_id", "sha256", "record"],
                    )

    # the archive's folder is taken from the path, as an empty replica has no folders to tell partitions from
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(folder)
    schema = "archive string, offset long, length long, record_id string, sha256 binary, record binary"
    out = files.select(F.regexp_extract("path", "/archive=([^/]+)/[^/]+$", 1).alias("archive"), "content").mapInArrow(tidy(run), schema)
    return out if with_bytes else out.drop("record")


def _levels(records: DataFrame, archives: int) -> list[DataFrame]:
    """Nodes (k1, k2, hash) from the root down to the level above records; keys of a level give those above it."""
    leaf = records.select(F.col("archive").alias("k1"), F.floor(F.col("offset") / RANGE).alias("k2"), F.col("offset").alias("place"), "length", "sha256")
    digest = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "child"))), lambda x: F.concat(x["place"].cast("string"), F.lit(":"), x["child"])), ","), 256)
    child = F.concat(F.col("length").cast("string"), F.lit(":"), F.hex("sha256")).alias("child")
    out = [written(leaf.select("k1", "k2", "place", child).groupBy("k1", "k2").agg(digest.alias("hash")))]
    top = out[0].agg(F.max("k2")).first()[0] or 0
    while top:
        top //= FAN
        up = out[0].select("k1", F.floor(F.col("k2") / FAN).alias("k2"), F.col("k2").alias("place"), F.col("hash").alias("child"))
        out.insert(0, written(up.groupBy("k1", "k2").agg(digest.alias("hash"))))
    # archives: by the digits of a hash of their name
    groups = 1
    while groups * FAN < archives:
        groups *= FAN
    first = True
    while True:
        bucket = F.pmod(F.xxhash64("k1"), F.lit(groups)).cast("string") if first else F.pmod(F.col("k1").cast("long"), F.lit(groups)).cast("string")
        up = out[0].select(bucket.alias("b"), F.lit(0).cast("long").alias("k2"), F.col("k1").alias("place"), F.col("hash").alias("child"))
        up = up.groupBy(F.col("b").alias("k1"), "k2").agg(digest.alias("hash"))
        out.insert(0, written(up))
        if groups == 1:
            return out
        groups, first = groups // FAN, False


def _parent(level: int, groups: list[int], ranges: int) -> tuple[Column, Column]:
    """Keys of the node above, for the nodes of a level (0: root)."""
    archive = len(groups)
    if level < archive:
        return F.pmod(F.col("k1").cast("long"), F.lit(groups[level - 1])).cast("string"), F.lit(0).cast("long")
    if level == archive:
        return F.pmod(F.xxhash64("k1"), F.lit(groups[-1])).cast("string"), F.lit(0).cast("long")
    return F.col("k1"), F.floor(F.col("k2") / FAN)


def audit(good: DataFrame, other: DataFrame) -> DataFrame:
    """Records in which replicas differ: archive, offset, length, record_id (those of ``good`` if it has the record), kind.

    ``good`` and ``other`` are what ``read_records`` gives, written.  ``kind`` is changed, missing or extra.  Replicas with
    equal roots, two empty ones as well, give an empty result.  Only nodes below nodes that differ are compared.  A lost or
    added record moves all that follow it in its archive, whose ranges then differ; records that only lie elsewhere in their
    archive are no findings.  Of equal records as many are missing or extra as one side has more, the last ones.
    """
    archives = max(x.select("archive").distinct().count() for x in (good, other))
    groups = [1]
    while groups[-1] * FAN < archives:
        groups.append(groups[-1] * FAN)
    a, b = _levels(good, archives), _levels(other, archives)
    # a replica with longer archives has more range levels; the other's upper ones are filled up by its archives' nodes
    depth = max(len(a), len(b))
    a, b = _filled(a, len(groups), depth), _filled(b, len(groups), depth)
    wrong = None
    for level in range(depth):
        left = a[level].withColumnRenamed("hash", "left")
        right = b[level].withColumnRenamed("hash", "right")
        if wrong is not None:
            up1, up2 = _parent(level, groups, depth)
            left, right = (
                x.withColumn("p1", up1).withColumn("p2", up2).join(wrong.select(F.col("k1").alias("p1"), F.col("k2").alias("p2")), ["p1", "p2"], "left_semi").drop("p1", "p2")
                for x in (left, right)
            )
        wrong = left.join(right, ["k1", "k2"], "full").filter(~F.col("left").eqNullSafe(F.col("right"))).select("k1", "k2")
        wrong = written(wrong)
        if level == 0 and wrong.isEmpty():
            break
    key = [F.col("archive").alias("k1"), F.floor(F.col("offset") / RANGE).alias("k2")]
    left, right = (x.select("*", *key).join(wrong, ["k1", "k2"], "left_semi").drop("k1", "k2") for x in (good, other))
    return _findings(left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))))


def _paired(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides met by ``keys`` and their order in it: those of side 0 if there are two, and ``sides``, how many there are."""
    place = F.row_number().over(Window.partitionBy("side", *keys).orderBy("offset"))
    values = F.struct(*(c for c in ("side", "offset", "length", "record_id", "sha256")))
    met = rows.withColumn("n", place).groupBy(*(F.col(k).alias(f"_{k}") for k in ("archive", *keys) if k != "archive"), "archive", "n")
    return met.agg(F.count("*").alias("sides"), F.min(values).alias("v")).select("archive", "v.*", "sides")


def _findings(rows: DataFrame) -> DataFrame:
    """What differs between the sides of ``rows``: equal records cancel wherever they lie, the others pair by id, then by place."""
    single = _paired(rows, ["archive", "record_id", "sha256"]).filter("sides = 1").drop("sides")
    by_id = written(_paired(single, ["archive", "record_id"]))
    by_place = _paired(by_id.filter("sides = 1").drop("sides"), ["archive", "offset"])
    kind = F.when(F.col("sides") == 2, "changed").when(F.col("side") == 0, "missing").otherwise("extra")
    found = by_id.filter("sides = 2").unionByName(by_place)
    return found.select("archive", "offset", "length", "record_id", kind.alias("kind"))


def _filled(levels: list[DataFrame], upper: int, depth: int) -> list[DataFrame]:
    return levels[:upper] + [levels[upper]] * (depth - len(levels)) + levels[upper:]


def damaged_copy(records: DataFrame, damaged: Column, folder: str) -> None:
    """Writes records (with bytes) as another replica in which the middle byte of some has one bit turned over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, hit in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = bytearray(raw[: -len(BREAK)] if raw.endswith(BREAK.encode()) else raw)
                if hit:
                    raw[len(raw) // 2] ^= 1
                out.append(bytes(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["archive", "offset", "raw"])

    rows = records.select("archive", "offset", "record", F.coalesce(damaged, F.lit(False)).alias("hit"))
    rows = rows.mapInArrow(tidy(run), "archive string, offset long, raw binary").sortWithinPartitions("archive", "offset")
    write_archives(rows.select("archive", F.col("raw").cast("string").alias("value")), folder)
