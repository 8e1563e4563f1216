import numpy as np
from pyspark.sql import functions as F

from stackloom.functions.text import sig_id
from stackloom.sources import history_store
from stackloom.streaming import jobs

SCHEMA = (
    "doc_id string, ts timestamp, signature string, representative string, language string, cause string, fixes string, "
    "model string, embedding array<double>"
)


def made(spark, n=90):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(5, 8))
    rows = []
    for i in range(n):
        family = 0 if rng.random() < 0.4 else int(rng.integers(0, 10))
        vector = centers[family % 5] + rng.normal(size=8) * 0.2
        rows.append((f"d{i:03d}", i, f"family {family}", f"cause {i}", vector.tolist()))
    df = spark.createDataFrame(rows, "doc_id string, t bigint, signature string, cause string, embedding array<double>")
    more = {"ts": F.timestamp_seconds("t"), "representative": F.col("signature"), "language": F.lit("go"), "fixes": F.lit(""), "model": F.lit("m")}
    return rows, df.withColumns(more).select(*[f.split(" ")[0] for f in SCHEMA.split(", ")])


def shown(df):
    return sorted((r.doc_id, r["rank"], int(r.sig_id), round(r.score, 9), r["count"], r.cause) for r in df.collect())


def test_each_batch_recalls_what_was_recorded_before_it(spark, tmp_path):
    rows, df = made(spark)
    ids = {r.signature: int(r.id) for r in df.select("signature", sig_id(F.col("signature")).alias("id")).distinct().collect()}
    cuts = [0, 30, 31, 70, 90]
    folder = str(tmp_path / "in")
    for low, high in zip(cuts, cuts[1:]):
        names = [r[0] for r in rows[low:high]]
        df.where(F.col("doc_id").isin(names)).coalesce(1).write.mode("append").parquet(folder)

    def run(checkpoint):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        jobs.stream_recall(stream, str(tmp_path / "h"), str(tmp_path / "out"), str(tmp_path / checkpoint), k=3, threshold=0.9).awaitTermination()
        history = history_store.read_history(spark, str(tmp_path / "h"))
        return shown(spark.read.parquet(str(tmp_path / "out"))), sorted(map(str, history.collect()))

    first = run("checkpoint")
    want = []
    for low, high in zip(cuts, cuts[1:]):
        points = {}
        for _, _, sig, cause, w in rows[:low]:
            points[sig] = (points.get(sig, (0,))[0] + 1, cause, w)
        for doc, _, _, _, v in rows[low:high]:
            scored = []
            for sig, (count, cause, w) in points.items():
                score = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12)
                if score >= 0.9:
                    scored.append((-score, ids[sig], count, cause))
            want += [(doc, rank + 1, i, round(-s, 9), n, c) for rank, (s, i, n, c) in enumerate(sorted(scored)[:3])]
    assert len(want) > 50 and first[0] == sorted(want)
    # nothing is new, then all batches once more: neither changes anything
    assert run("checkpoint") == first
    assert run("another") == first


def test_versions_before_one(spark, tmp_path):
    _, df = made(spark, 30)
    path = str(tmp_path / "h")
    for n in range(3):
        history_store.write_history(jobs.new_history(df.where(F.col("doc_id").endswith(str(n)))), path, f"{n:03d}")
    counts = [history_store.read_history(spark, path, before=f"{n:03d}").agg(F.sum("count")).first()[0] for n in range(4)]
    assert counts == [None, 3, 6, 9]
    history_store.compact_history(spark, path)
    assert history_store.read_history(spark, path, before="001").agg(F.sum("count")).first()[0] == 3
