"""Spelling variants: words one edit apart, by one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols. A word's reduced form has a small one-edit
neighbourhood (other symbols in each place, each place left out); the reduced
words of the vocabulary are joined with it, and pairs are verified on the
original words. A pair is looked for once: an insertion is the deletion seen
from the longer word, a replacement is made towards the larger symbol only, and
one between letters of a symbol leaves the reduced word as it is.

An edit in one half of a word leaves the other half alone, so a hash of that
half of the original word is part of the join key. A reduced word that many
words share is thereby split by their halves and never paired with itself as a
whole. Neighbourhoods are 64-bit hashes made from prefix and suffix hashes, so a
very long word costs as many hashes as it has places, not their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgelane.session import StateTables, materialise

SYMBOLS = 4
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 7, 2, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_every: int = 31) -> DataFrame:
    """(word, n): the vocabulary of whole texts.

    Words are runs of letters, A-Z in lower case; every ``drop_every``-th (by crc32 of id and run)
    loses one letter. Null ids count as empty.
    """
    # A letter can only be lost, so shorter runs give no word.
    pattern = f"([A-Za-zÀ-ÿ]{{{least_length},}})"
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("run"))
    run = F.translate("run", _UPPER, _LOWER)
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run"))
    words = runs.withColumn("run", run).withColumn("h", h).select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# --- reduced neighbourhoods ------------------------------------------------------

def symbol_table(symbols: int) -> np.ndarray:
    """Symbol (from 1) of each letter."""
    letters = np.arange(256, dtype=np.uint64) * np.uint64(_B1) >> np.uint64(40)
    return letters % np.uint64(symbols) + np.uint64(1)


def _prefixes(x: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the prefixes of each row, the empty one first."""
    out = np.zeros((len(x), x.shape[1] + 1), np.uint64)
    for i in range(x.shape[1]):
        out[:, i + 1] = out[:, i] * np.uint64(base) + x[:, i]
    return out


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    if n:
        out[1:] = np.multiply.accumulate(np.full(n, base, np.uint64))
    return out


def _key(code: np.ndarray, half: np.ndarray, side: int) -> np.ndarray:
    h = code * np.uint64(0xFF51AFD7ED558CCD) ^ half + np.uint64(side) * np.uint64(_B1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def neighbour_keys(words: np.ndarray, symbols: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(own, rows, keys) of words of one length (a matrix of Latin-1 letters).

    Own keys name the reduced word with each half of the word; the others name a
    reduced neighbour with the half that stays.
    """
    length = words.shape[1]
    x, letters = symbol_table(symbols)[words], words.astype(np.uint64) + np.uint64(1)
    prefix, power = _prefixes(x, _B1), _powers(length, _B1)
    first, power2 = _prefixes(letters, _B2), _powers(length, _B2)
    code, rows = prefix[:, length], np.arange(len(words))

    def last(k: int) -> np.ndarray:
        """Hash of the last k letters."""
        return first[:, length] - first[:, length - k] * power2[k]

    middle = length // 2
    for side, half in ((0, first[:, middle]), (1, last(length - middle))):
        yield True, rows, _key(code, half, side)
    shorter = (length - 1) // 2
    halves = {False: (first[:, middle], last(length - middle)), True: (first[:, shorter], last(length - 1 - shorter))}
    for i in range(length):
        for v in range(2, symbols + 1):
            chosen = x[:, i] < v
            if chosen.any():
                side = 0 if i >= middle else 1
                new = code + (np.uint64(v) - x[:, i]) * power[length - 1 - i]
                yield False, rows[chosen], _key(new, halves[False][side], side)[chosen]
        side = 0 if i >= shorter else 1
        rest = code - prefix[:, i + 1] * power[length - 1 - i]
        gone = _key(prefix[:, i] * power[length - 1 - i] + rest, halves[True][side], side)
        # A symbol like the one before it leaves the same reduced word.
        fresh = np.ones(len(words), bool) if i in (0, shorter) else x[:, i] != x[:, i - 1]
        yield False, rows[fresh], gone[fresh]


def reduced_keys(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(own, key, id) of the words (``id``, ``word``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, words = batch["id"].to_numpy(zero_copy_only=False), [w.encode("latin-1") for w in batch["word"].to_pylist()]
                lengths = np.array([len(w) for w in words])
                for length in np.unique(lengths):
                    at = np.flatnonzero(lengths == length)
                    step = max(1, (1 << 20) // (int(length) * symbols))
                    for start in range(0, len(at), step):
                        some = at[start : start + step]
                        matrix = np.frombuffer(b"".join(words[k] for k in some), np.uint8).reshape(len(some), length)
                        found, size = [], 0
                        for own, rows, keys in neighbour_keys(matrix, symbols):
                            found.append((np.full(len(rows), own), keys.view(np.int64), ids[some[rows]]))
                            size += len(rows)
                            if size >= 1 << 18:
                                yield _batch(found)
                                found, size = [], 0
                        if found:
                            yield _batch(found)

    return vocabulary.select("id", "word").mapInArrow(run, "own boolean, key long, id long")


def _batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["own", "key", "id"])


def near_pairs(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, other, other_n) of all words one edit apart, both ways, from a written vocabulary (``id``, ``word``, ``n``)."""
    keys = reduced_keys(vocabulary, symbols)
    own = keys.where("own").select("key", F.col("id").alias("b"))
    # Own keys meet each other too: words of one reduced word.
    pairs = keys.select("key", F.col("id").alias("a")).join(own.hint("shuffle_hash"), "key").where("a != b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = vocabulary.select(F.col("id").alias("a"), F.col("word").alias("wa"), F.col("n").alias("na"))
    right = vocabulary.select(F.col("id").alias("b"), F.col("word").alias("wb"), F.col("n").alias("nb"))
    verified = pairs.join(left, "a").join(right, "b").where(F.levenshtein("wa", "wb", 1) == 1)
    both = F.array(F.struct(F.col("wa").alias("word"), F.col("na").alias("n"), F.col("wb").alias("other"), F.col("nb").alias("other_n")),
                   F.struct(F.col("wb").alias("word"), F.col("nb").alias("n"), F.col("wa").alias("other"), F.col("na").alias("other_n")))
    return verified.select(F.inline(both))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that ``forms`` (word, form) lead to, by pointer jumping.

    A form is at least ten times as frequent as its word, so there is no cycle and a handful of rounds do.
    """
    with StateTables(forms.sparkSession, "roots") as tables:
        now = tables.write(forms.select("word", F.col("form").alias("root")))
        while True:
            on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
            if now.join(on, "root", "left_semi").isEmpty():
                tables.keep()
                return now
            now = tables.write(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def spelling_variants(docs: DataFrame, symbols: int = SYMBOLS, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of ``docs``.

    A word's form is its near word of largest n (ties: the smallest) if that is
    at least ``factor`` times the word's n. Null and empty texts and texts
    without words add nothing; null ids count as empty; repeated rows count
    each; an empty table gives an empty table. Other columns are left out.
    """
    words = word_counts(docs).withColumn("id", F.monotonically_increasing_id())
    vocabulary = materialise(words, "vocabulary")
    # Largest n, then the smallest word.
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = near_pairs(vocabulary, symbols).groupBy("word").agg(F.first("n").alias("own_n"), F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.minus") >= F.lit(factor) * F.col("own_n")
    near = near.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"))
    near = materialise(near, "near-words")
    roots = follow(near.where("form is not null").select("word", "form"))
    found = vocabulary.drop("id").join(near, "word", "left").join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
