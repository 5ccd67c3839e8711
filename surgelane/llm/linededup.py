"""Line dedup by range-partitioned line hashes, DataFrame functions only.

A line's key is the stripped, ASCII-lower-cased line. Keys of some length that
many documents hold are boilerplate: their lines go everywhere but in the
document that comes first in the stream of the key, the one with the largest id.

1. Each document emits one row per distinct long key: two 64-bit hashes and the
   line numbers. The rows are range-partitioned by (hash, segment of the
   document) and sorted by document within; a hot key is thus dealt over all its
   segments. A window streams each run: its first occurrence and its length.
2. The first occurrences of the segments meet per key: documents in all, and
   the occurrence that stays.
3. Lines of other documents with such a key become a bitmap per document, 64
   lines a word, words without a dropped line left out.

Texts are read for steps 1 and for applying bitmaps only; what is shuffled
between is hashes and line numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surgelane.session import materialise

MIN_LENGTH = 40
MIN_DOCS = 5
# A key's documents are dealt over this many segments before they meet.
SEGMENTS = 64
# Second hash: with the first, 128 bits tell lines apart.
SALT = "line"


def lines_of(text: Column) -> Column:
    """The text's lines; null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """The line stripped of ASCII white space, A-Z lower-cased."""
    stripped = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.translate(stripped, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def occurrences(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(h1, h2, doc_id, th, lines): the long keys of each document, once each.

    ``th`` hashes the text and tells rows apart that repeat an id. Rows with a
    null id hold no occurrence.
    """
    lines = (
        docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_length))
        .select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .where(F.length("line") >= min_length)
        .withColumn("key", key_of(F.col("line")))
        .where(F.length("key") >= min_length)
    )
    return lines.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(SALT), "key").alias("h2"))


def repeated_keys(occ: DataFrame, min_docs: int = MIN_DOCS, partitions: int | None = None) -> DataFrame:
    """(h1, h2, keeper): keys in at least ``min_docs`` documents, and the document that keeps them."""
    n = partitions or int(occ.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        occ.select("h1", "h2", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(SEGMENTS)).cast("int").alias("segment"))
        .repartitionByRange(n, "h1", "h2", "segment")
        .sortWithinPartitions("h1", "h2", "segment", F.col("doc_id").desc())
    )
    run = Window.partitionBy("h1", "h2", "segment").orderBy(F.col("doc_id").desc())
    firsts = (
        dealt.withColumn("first", F.row_number().over(run) == 1)
        .withColumn("new_doc", F.coalesce(F.lag("doc_id").over(run) != F.col("doc_id"), F.lit(True)))
        .where("new_doc")
    )
    return (
        firsts.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max(F.when(F.col("first"), F.col("doc_id"))).alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )


def drop_bitmaps(occ: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, th, words): the dropped lines of each document that loses any.

    ``words`` maps a word number to 64 bits, bit i of word w standing for line
    64 w + i; a line is kept where its bit is 0 or its word is missing.
    """
    gone = occ.join(repeated, ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper"))
    bits = gone.groupBy("doc_id", "th", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("pos", F.lit(64)).cast("int"))).alias("bits")
    )
    return bits.groupBy("doc_id", "th").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def line_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """Bitmaps of the lines that go, for ``docs`` with ``doc_id`` and ``text``.

    Null ids and null, empty or short texts lose nothing; repeated rows of an id
    count as one document and lose the same lines; an empty table has no bitmap.
    """
    occ = materialise(occurrences(docs, min_length), "line-hashes")
    # Written, so that adaptive execution can split a hot key of the join with it.
    return drop_bitmaps(occ, materialise(repeated_keys(occ, min_docs), "repeated-lines"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    A text that loses no line stays as it is (null: empty). If all lines go, the
    kept text is empty. Columns of these names in ``docs`` are replaced.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    b = bitmaps.select(F.col("doc_id").alias("_line_doc"), F.col("th").alias("_line_th"), F.col("words").alias("_line_words"))
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn("_line_h", F.xxhash64("text")).join(
        b, (F.col("doc_id") == F.col("_line_doc")) & (F.col("_line_h") == F.col("_line_th")), "left"
    )
    n_lines = F.when(F.length(text) == 0, 1).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1)
    dense = F.transform(
        F.sequence(F.lit(0), F.floor((F.col("_line_n") - 1) / 64).cast("int")),
        lambda w: F.coalesce(F.try_element_at(F.col("_line_words"), w), F.lit(0).cast("long")),
    )

    def without(bits: Column) -> Column:
        bit = lambda i: F.getbit(F.get(bits, F.floor(i / 64).cast("int")), F.pmod(i, F.lit(64)).cast("int"))
        return F.array_join(F.filter(lines_of(F.col("text")), lambda _, i: bit(i) == 0), "\n")

    # Bound as a lambda variable, the dense bitmap is built once a document, not once a line.
    kept = F.get(F.transform(F.array(dense), without), F.lit(0))
    has = F.col("_line_words").isNotNull()
    dropped = F.aggregate(F.map_values("_line_words"), F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w))
    return marked.withColumn("_line_n", n_lines.cast("long")).select(
        *docs.columns,
        F.when(has, kept).otherwise(text).alias("kept_text"),
        F.col("_line_n").alias("n_lines"),
        F.when(has, dropped).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )
