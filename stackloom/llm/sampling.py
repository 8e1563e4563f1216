"""Training rows of the classifiers: a bounded, documented sample of labelled documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.words import tidy


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def training_texts(
    docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, per_class: tuple[int, int], words: int, run: int
) -> DataFrame:
    """(doc_id, texts, label) of at most ``per_class`` documents of label 0 and 1 for which ``keep`` holds.

    A document of over ``words`` words gives evenly spread runs of ``run`` words of that length in all, others are one
    text.  So these are at most sum(per_class) * words words, whatever the input.  Rows are picked by a hash of the id; ids
    labelled twice count as their largest label, and of rows that repeat an id one is taken.
    """
    known = labels.filter(keep & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(*order).limit(per_class[value])
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                own = (text.as_py() or "").encode().split()
                if len(own) <= words:
                    out.append([text.as_py() or ""])
                    continue
                runs = max(1, words // run)
                starts = [i * (len(own) - run) // max(1, runs - 1) for i in range(runs)]
                out.append([b" ".join(own[a : a + run]).decode() for a in starts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(pa.string())), batch.column(2)], names=["doc_id", "texts", "label"]
            )

    rows = texts.select("doc_id", "text", "label").mapInArrow(tidy(shorten), "doc_id long, texts array<string>, label int")
    return rows.dropDuplicates(["doc_id"])
