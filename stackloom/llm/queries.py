"""Queries of this package over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm import chat, collocations, graph_index, jaccard, language_id, merkle, oracles, packing, phrases, quality, tiling, toxicity, url_graph, warc
from stackloom.llm.sampling import fold
from stackloom.llm.steps import written
from stackloom.session import work_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learnt from labels of two thirds of the ids."""
    docs = _table(spark, sf_dir, "documents")
    params = toxicity.fit(docs, _table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.score(docs, params).select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one that quotes control strings, read back from their formatted form."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quote = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", quote), (-7, 1, "assistant", quote)], "conv_id long, turn long, role string, text string")
    return chat.chat_digest(rows.unionByName(more))


URL_RULES = [
    url_graph.Rule("net", "/", "block"),
    url_graph.Rule("example.net", "/en/", "allow"),
    url_graph.Rule("example.com", "/de/", "block"),
    url_graph.Rule("org", "/fr/", "allow"),
]


def op3_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by rules and else by trust and distrust of its host."""
    judged = url_graph.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", *(F.round(c, 8).alias(c) for c in url_graph.MEASURES))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which at least 60 % of a benchmark item's words are found in tiles of five words or more."""
    return tiling.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixity drill: all pages are archived, copied with a bit turned over in one record of 97, and the copy is audited."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    good, other = work_folder(spark), work_folder(spark)
    archive = F.concat(F.lit("pages-"), F.floor(F.col("page_id") / 500).cast("string"))
    warc.archive_pages(pages, archive, good)
    page = F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    warc.damaged_copy(warc.read_records(spark, good, with_bytes=True), page % 97 == 5, other)
    found = warc.audit(written(warc.read_records(spark, good)), written(warc.read_records(spark, other)))
    return found.withColumn("page_id", page)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and links of every document: five-word shingles, similarity of 0.8 or more."""
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learnt from labels of four fifths of the ids."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality.score(docs, model).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for each vector whose id is divisible by 100."""
    return graph_index.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are left once repeated windows of 13 words are removed, as a digest."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = phrases.remove_repeats(docs, rejoin=True)
    return cut.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def byte_bpe() -> str:
    """The tokenizer file that the packing query uses."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), byte_bpe())


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, whose own text decides; learnt from four fifths of the ids."""
    docs = _table(spark, sf_dir, "documents")
    known = (fold("doc_id", 5) != 0) & F.col("lang").isNotNull()
    found = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs, known))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, a tree for each language; every seventh presented row has one character more."""
    docs = _table(spark, sf_dir, "documents")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = (fold("doc_id", 7) == 0) & F.col("n_chars").isNotNull()
    leaf = merkle.leaf_digest(*(F.col(c) for c in names))
    changed = merkle.leaf_digest(*(F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in names))
    done = merkle.manifest(docs, F.col("lang"), F.col("doc_id"), leaf, F.when(tampered, changed).otherwise(leaf))
    return done.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two to five words of each language, from all documents."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_chat": op2_chat,
    "op3_url_graph": op3_url_graph,
    "op4_decontamination": op4_decontamination,
    "op5_warc_audit": op5_warc_audit,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_quality": op7_quality,
    "op8_nearest": op8_nearest,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
    "op11_language_id": op11_language_id,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op2_chat": oracles.OP2,
    "op3_url_graph": oracles.OP3,
    "op5_warc_audit": oracles.OP5,
    "op6_ngram_jaccard": oracles.OP6,
    "op9_substring_dedup": oracles.OP9,
    "op12_merkle_manifest": oracles.OP12,
    "op13_collocations": oracles.OP13,
}
