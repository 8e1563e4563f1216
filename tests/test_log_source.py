import os
import random

import pytest

from stackloom.operators import groups
from stackloom.sources import log_source
from stackloom.sources.log_source import LogSource


def run(spark, folder, out):
    spark.dataSource.register(LogSource)
    query = (
        spark.readStream.format("log_lines").load(str(folder)).writeStream.format("parquet").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def lines(df):
    return sorted((r.offset, r.line) for r in df.collect())


def test_growing_files_give_each_line_once(spark, tmp_path):
    folder, out = tmp_path / "logs", tmp_path / "out"
    (folder / "deep").mkdir(parents=True)
    run(spark, folder, out)  # nothing there yet
    (folder / "a.log").write_bytes("one\r\ntwo é\n\nthr".encode())
    (folder / "deep" / "b.log").write_text("b1\n")
    (folder / "open.log").write_text("no end of line")
    (folder / "_hidden").write_text("x\n")
    run(spark, folder, out)
    assert lines(spark.read.parquet(f"{out}/rows")) == [(0, "b1"), (0, "one\r"), (5, "two é"), (12, "")]
    with open(folder / "a.log", "ab") as f:
        f.write(b"ee\n\xff\nfive\nsi")
    run(spark, folder, out)
    run(spark, folder, out)
    with open(folder / "a.log", "ab") as f:
        f.write(b"x\n")
    run(spark, folder, out)
    got = spark.read.parquet(f"{out}/rows")
    assert lines(got) == lines(spark.read.format("log_lines").load(str(folder)))
    assert [r[1] for r in lines(got) if r[0] > 11] == ["", "three", "�", "five", "six"]


def test_rotated_files(spark, tmp_path):
    """Renaming, a new file of the same name, removal, and a new start all in between."""
    folder, out = tmp_path / "logs", tmp_path / "out"
    folder.mkdir()
    log = folder / "app.log"
    written = []

    def write(n, file=log):
        with open(file, "a") as f:
            for _ in range(n):
                written.append(f"line {len(written)} " + "x" * (len(written) % 50))
                f.write(written[-1] + "\n")

    write(200)
    run(spark, folder, out)
    write(50)
    os.rename(log, folder / "app.log.1")  # with 50 lines that nobody has read
    write(30)
    run(spark, folder, out)
    write(500)
    os.rename(folder / "app.log.1", folder / "app.log.2")
    os.rename(log, folder / "app.log.1")
    write(700)
    run(spark, folder, out)
    os.remove(folder / "app.log.2")
    os.rename(log, folder / "moved.log")
    write(3, folder / "moved.log")
    run(spark, folder, out)
    got = [r.line for r in spark.read.parquet(f"{out}/rows").collect()]
    assert sorted(got) == sorted(written)


def test_any_ranges(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["", "a", "line é " * rng.randint(1, 9), "z" * 90]) + "\n" for _ in range(400))
    (tmp_path / "f.log").write_text(text + "rest")
    folder = log_source.Folder(str(tmp_path))
    want = text.split("\n")[:-1]
    for split, step in ((7, 5), (100, 33), (10**6, 11), (64, 10**6)):
        monkeypatch.setattr(log_source, "SPLIT_BYTES", split)
        monkeypatch.setattr(log_source, "_STEP", step)
        place = folder.place(str(tmp_path / "f.log"), os.path.getsize(tmp_path / "f.log"))
        parts = folder.ranges({}, {str(tmp_path / "f.log"): place})
        rows = [row for part in parts for batch in folder.lines(part) for row in batch.to_pylist()]
        assert [r["line"] for r in rows] == want
        data = text.encode()
        assert all(data[r["offset"] : r["offset"] + len(r["line"].encode())].decode() == r["line"] for r in rows)
        middle = len("\n".join(want[:150]).encode()) + 1
        head = min(log_source.HEAD_BYTES, middle)
        begun = log_source.Place(middle, head, folder.digest(str(tmp_path / "f.log"), head))
        parts = folder.ranges({str(tmp_path / "f.log"): begun}, {str(tmp_path / "f.log"): place})
        assert [row["line"] for part in parts for batch in folder.lines(part) for row in batch.to_pylist()] == want[150:]


def test_what_an_earlier_run_saw_must_be_somewhere(tmp_path):
    (tmp_path / "f.log").write_text("a\nb\n")
    folder = log_source.Folder(str(tmp_path))
    seen = {str(tmp_path / "f.log"): folder.place(str(tmp_path / "f.log"), 4)}
    os.rename(tmp_path / "f.log", tmp_path / "g.log")
    (tmp_path / "f.log").write_text("other\n")
    (part,) = folder.ranges({}, seen)
    assert part.file.endswith("g.log") and part.high == 4
    (tmp_path / "g.log").unlink()
    (part,) = folder.ranges({}, seen)
    with pytest.raises(FileNotFoundError, match="4 bytes that are to be read"):
        list(folder.lines(part))


def test_lines_feed_the_operators(spark, tmp_path):
    (tmp_path / "a.log").write_text("ERROR disk full\nERROR disk full\n\nE1\n")
    spark.dataSource.register(LogSource)
    read = spark.read.format("log_lines").load(str(tmp_path))
    shaped = read.selectExpr("file", "0L AS split", "offset AS row", "line")
    rows = groups.file_groups(groups.line_blocks(shaped)).collect()
    assert [(r.signature, r["count"]) for r in rows] == [("ERROR disk full", 2)]
