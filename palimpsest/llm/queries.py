"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import ann, byte_bpe, decontaminate, html_blocks, lang_id, line_dedup, near_dup, pii, token_orc, toxicity
from palimpsest.llm.spark_io import Scratch, doc_bucket, read_table
from palimpsest.llm.sql import DECONTAMINATE_SQL, NEAR_DUP_SQL
from palimpsest.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the recurrent block labeller."""
    pages = read_table(ship(spark), sf_dir, "pages").select("page_id", "url", "html")
    return html_blocks.extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    docs = read_table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    return pii.span_digests(pii.detect_pii(docs))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return near_dup.near_duplicates(read_table(ship(spark), sf_dir, "documents"), shingle=2)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in every document, and how many."""
    docs = read_table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("items").cast("long").alias("n_items"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that keeps a line, without the lines that repeat others."""
    docs = read_table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, least=1).select("doc_id", "text", "n_dropped")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    return byte_bpe.token_digests(read_table(ship(spark), sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learnt from labelled rows outside fold 2 of 4."""
    docs = read_table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on_documents(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    held_out = doc_bucket("doc_id", 4) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth."""
    return ann.nearest(read_table(ship(spark), sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from labelled rows outside fold 1 of 3."""
    docs = read_table(ship(spark), sf_dir, "documents")
    model = lang_id.fit_on_documents(docs)
    held_out = doc_bucket("doc_id", 3) == 1
    return lang_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, count and checksum of every document's ids, from the ORC files they were written to."""
    docs = read_table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    path = f"{Scratch(spark, 'token_orc').root}/ids"
    token_orc.write_token_orc(docs, path, vocabulary("word_bpe_49k.json"))
    return token_orc.with_crc(token_orc.read_token_orc(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict[str, Query]:
    named = (
        op1_html_main_text,
        op2_pii,
        op3_minhash_dedup,
        op4_decontaminate,
        op5_line_dedup,
        op6_byte_bpe,
        op7_toxicity,
        op8_ann,
        op9_language_id,
        op10_token_orc,
    )
    return {query.__name__: query for query in named}


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_dedup": NEAR_DUP_SQL, "op4_decontaminate": DECONTAMINATE_SQL}
