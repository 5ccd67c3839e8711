"""Corpus pipeline: documents to packed training sequences, five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of documents. Stages, in order: language ID, line dedup, SimHash
near-dedup, mixing sources, packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgelane.llm.langid import OTHER, identify_documents
from surgelane.llm.linededup import apply_bitmaps, line_bitmaps
from surgelane.llm.mixing import mix, take_words, word_count
from surgelane.llm.packing import pack_documents
from surgelane.llm.queries import tokenizer_path
from surgelane.llm.simhash import one_of_each_group
from surgelane.session import delete_on_exit, scratch_path

#: Shingle length and largest distance of the SimHash near-dedup operator's contract.
SHINGLE_WORDS, MAX_BITS = 4, 4
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Tokenization, hashing and fixpoints over whole texts are not SQL; the stages
#: are held against brute force in tests/llm.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; its code replaces ``lang``, which stays where the language is a rare one.

    Null and empty texts and texts without letters go; rows that repeat are each
    judged; null ids, sources and languages are judged by their text; texts of
    any length are read whole; an empty table gives an empty table.
    """
    found = identify_documents(docs)
    lang = F.when((F.col("language") == OTHER) & F.col("lang").isNotNull(), F.col("lang")).otherwise(F.col("language"))
    return found.where("accepted").select("doc_id", "text", lang.alias("lang"), "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; those left without text go.

    A null or empty text is one empty line and stays as empty text; repeated rows
    of an id count as one document; rows without an id keep their lines.
    """
    kept = apply_bitmaps(docs, line_bitmaps(docs))
    whole = (F.col("n_dropped") == 0) | (F.length(F.btrim("kept_text", F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return kept.where(whole).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id.

    Copies have SimHashes of four-word shingles that differ in four bits or fewer.
    A document is an id with a text. Rows that repeat both are one; an id that
    comes with several texts is a document for each, linked by its text alone.
    Rows without an id link with nothing and all stay. Texts without words are
    alike, as any two of one fingerprint; an empty table gives an empty table.
    """
    text_key = F.xxhash64("text")
    kept = one_of_each_group(docs, SHINGLE_WORDS, MAX_BITS).withColumnsRenamed({"doc_id": "_kept_id", "text_key": "_kept_text"})
    chosen = docs.join(kept, (F.col("doc_id") == F.col("_kept_id")) & (text_key == F.col("_kept_text")))
    # Least of the repeated rows by a grouped minimum, which is combined before its shuffle.
    once = chosen.groupBy("_kept_id", "_kept_text").agg(F.min(F.struct("text", "source", *(c for c in COLUMNS if c not in ("text", "source")))).alias("_row"))
    return once.select("_row.*").select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or cut to their source's target; those outside it go.

    Texts without words are never taken; rows that tie are ordered by a hash of
    all their columns; a null source is a source; an empty table stays empty.
    """
    taken = mix(docs.select(*COLUMNS).withColumn("size", word_count(F.col("text"))))
    epochs = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rows = taken.where(F.col("taken") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), epochs)))
    left = F.col("taken") - (F.col("_copy") - 1) * F.col("size")
    text = F.when(left >= F.col("size"), F.col("text")).otherwise(take_words(F.col("text"), left))
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences of 2048 tokens.

    A null or empty text is one piece of the closing token; repeated rows are
    packed each; longer documents are cut into whole pieces and a last one.
    """
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each one's result written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        delete_on_exit(spark, path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
