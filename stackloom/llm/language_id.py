"""Language identification by compression: a text is in the language whose dictionary makes it smallest.

For each language whole training texts, joined, are a raw-content zstandard dictionary.  A text is lower-cased and cut into
blocks of ``BLOCK`` bytes, so that evidence grows with the text and what the text says of itself counts little; each block is
compressed with every dictionary, and sizes add up.  The smallest sum wins; equal sums go to the language with more training
documents, then to the smaller name.  ``margin`` is the share of bytes saved against the runner-up; a prediction with a
margin below ``MIN_MARGIN`` is not accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm.words import tidy

LEVEL, BLOCK = 7, 512
MIN_MARGIN = 0.02
#: Bounds on the training sample: documents of a language, bytes of a document, and languages (the most frequent ones).
DOCS, DOC_BYTES, LANGUAGES = 64, 1 << 14, 256
UNKNOWN = "und"


class Model(NamedTuple):
    """Names of the languages, those with more training documents first, and their dictionaries."""

    names: list[str]
    dictionaries: list[bytes]


def fit(docs: DataFrame, keep: Column, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Dictionaries from rows for which ``keep`` holds and lang and text are not null.

    A language learns from ``DOCS`` whole texts, chosen by a hash of the text among those of at most ``DOC_BYTES`` bytes; one
    that has only longer texts learns from its shortest.  At most ``LANGUAGES`` languages are learnt, those with most rows, so
    at most LANGUAGES * DOCS * DOC_BYTES bytes and one text a language reach the driver.  Equal texts count once.  Without any
    row there are no languages.
    """
    own = docs.filter(keep).select(F.col(lang_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text"))
    own = own.filter(F.col("name").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("size", F.octet_length("text"))
    too_long = F.col("size") > DOC_BYTES
    key = F.struct(too_long.alias("long"), F.when(too_long, F.col("size")).alias("size"), F.xxhash64("text").alias("mixed"))
    texts = own.groupBy("name", key.alias("key")).agg(F.count("*").alias("copies"))
    known = texts.groupBy("name").agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), "name").limit(LANGUAGES)
    ranked = texts.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("key")))
    # of long texts only the first of a language that has no other
    picked = ranked.filter((F.col("n") <= DOCS) & (~F.col("key.long") | (F.col("n") == 1))).select("name", F.col("key.mixed").alias("mixed"))
    picked = F.broadcast(picked.join(F.broadcast(known), "name"))
    chosen = own.withColumn("mixed", F.xxhash64("text")).join(picked, ["name", "mixed"])
    rows = chosen.groupBy("name", "mixed").agg(F.first("rows").alias("rows"), F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (-r["rows"], r["name"].encode(), r["mixed"]))
    found: dict[str, dict[bytes, None]] = {}
    for row in rows:
        found.setdefault(row["name"], {})[row["text"].lower().encode()] = None
    return Model(list(found), [b"\n".join(lowered) for lowered in found.values()])


def compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in model.dictionaries:
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False))
    return out


def sizes(tools: list[zstandard.ZstdCompressor], text: str) -> list[int]:
    """Bytes of the whole text with each dictionary."""
    data = text.lower().encode()
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    return [sum(len(tool.compress(block)) for block in blocks) for tool in tools]


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, and lang_pred, margin, score and accepted of every row.

    ``score`` is margin / (margin + MIN_MARGIN), so that 0.5 is where predictions begin to be ``accepted``; with one language
    only the margin is 1.  Null texts, texts without a letter, and all texts if no language was learnt, are ``und`` with a
    score of 0 and not accepted.  Rows are judged one by one: repeated rows get the same answer, ids may be null.
    """
    added = ("lang_pred", "margin", "score", "accepted")
    clash = set(added) & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tools = shared.value.names, compressors(shared.value)
        for batch in batches:
            found, margins = [], []
            for value in batch.column(len(others)):
                text = value.as_py()
                if not tools or text is None or not any(map(str.isalpha, text)):
                    found.append(UNKNOWN)
                    margins.append(0.0)
                    continue
                size = sizes(tools, text)
                best, second = (*sorted(size), 0)[:2] if len(size) > 1 else (0, size[0])
                found.append(names[size.index(min(size))])
                margins.append(1 - best / second)
            margin = pa.array(margins, pa.float64())
            score = pa.array([m / (m + MIN_MARGIN) for m in margins], pa.float64())
            accepted = pa.array([m >= MIN_MARGIN for m in margins], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.array(found, pa.string()), margin, score, accepted], names=[*others, *added]
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    schema = f"{kinds}{', ' if kinds else ''}lang_pred string, margin double, score double, accepted boolean"
    return docs.select(*(F.col(f"`{c}`") for c in others), F.col(text_col).cast("string").alias(text_col)).mapInArrow(tidy(run), schema)
