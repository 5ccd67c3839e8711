"""Registered queries of the subpackage: (spark, sf_dir) -> DataFrame, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    from surgelane.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_embedding_near_dedup")
def op2(spark, sf_dir):
    from surgelane.llm.crosspolytope import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op3_toxicity")
def op3(spark, sf_dir):
    from surgelane.llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_line_dedup")
def op4(spark, sf_dir):
    from surgelane.llm.linededup import apply_bitmaps, line_bitmaps

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_bitmaps(docs, line_bitmaps(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


@query("op5_best_fit_packing")
def op5(spark, sf_dir):
    from surgelane.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op6_html_extraction")
def op6(spark, sf_dir):
    from surgelane.llm.pagediff import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


@query("op7_sharding")
def op7(spark, sf_dir):
    from surgelane.llm.sharding import shard_by_bytes, sized
    from surgelane.session import materialise

    rows = materialise(sized(table(spark, sf_dir, "documents")), "sizes")
    return shard_by_bytes(rows, 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op8_exact_top_k")
def op8(spark, sf_dir):
    from surgelane.llm.kdtree import scaled, top_k

    return top_k(scaled(table(spark, sf_dir, "embeddings")))


@query("op9_language_id")
def op9(spark, sf_dir):
    from surgelane.llm.langid import identify_pages

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_pages(table(spark, sf_dir, "pages"), docs)


@query("op10_mixing")
def op10(spark, sf_dir):
    from surgelane.llm.mixing import mix, word_count
    from surgelane.session import materialise

    docs = table(spark, sf_dir, "documents")
    rows = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "word-counts")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    from surgelane.llm.variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_document_fingerprints")
def op12(spark, sf_dir):
    from surgelane.llm.winnowing import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op13_merkle_manifest")
def op13(spark, sf_dir):
    from surgelane.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents")).proofs()
