"""Document fingerprints by winnowing, with positions.

Hashes of all k-grams of code points are computed by doubling (a gram of 2j from
two of j); of every ``window`` consecutive ones the least is kept, the rightmost
of equal ones. Kept hashes carry their positions. Any passage of at least
``gram + window - 1`` code points that two texts share gives both the same kept
hash at the same place of the passage.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW = 16, 16
#: Code points hashed at once: bounds memory for very long texts.
STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all ``gram`` consecutive code points."""
    n = len(points) - gram + 1
    power, width, have = _BASE, 1, points.astype(np.uint64) + np.uint64(1)
    out, done = None, 0  # hash of the first `done` code points from each place
    left = gram
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                shifted = have[done : done + n]
                out = shifted.copy() if out is None else out * np.uint64(power) + shifted
                done += width
            left >>= 1
            if left:
                have = have[:-width] * np.uint64(power) + have[width:]
                power, width = power * power % (1 << 64), 2 * width
        out ^= out >> np.uint64(33)
        out = out * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(33)
        out = out * np.uint64(0xC4CEB9FE1A85EC53)
        return out ^ (out >> np.uint64(33))


def _window_minima(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost least hash of every window, each once."""
    window = min(window, len(h))
    n = len(h) - window + 1
    at, width = np.arange(len(h)), 1  # rightmost least of the `width` hashes from each place
    best, done, left = None, 0, window
    while left:
        if left & 1:
            other = at[done : done + n]
            best = other if best is None else np.where(h[other] <= h[best], other, best)
            done += width
        left >>= 1
        if left:
            first, second = at[:-width], at[width:]
            at, width = np.where(h[second] <= h[first], second, first), 2 * width
    return np.unique(best)


def winnow(text: str | None, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) kept of a text, by position.

    A text shorter than ``gram`` is one gram, one of fewer than ``window`` grams
    has one window; a null or empty text has none.
    """
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    gram = min(gram, len(points))
    n = len(points) - gram + 1
    found, hashes = [], []
    for start in range(0, max(1, n - window + 1), STEP):
        h = _gram_hashes(points[start : start + STEP + window - 1 + gram - 1], gram)
        places = _window_minima(h, window)
        found.append(places + start)
        hashes.append(h[places])
    positions, first = np.unique(np.concatenate(found), return_index=True)
    return positions, np.concatenate(hashes)[first]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes over the mean number of distinct hashes of both; 1 for two texts without any."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) + len(b):
        return 1.0
    return 2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def digest(positions: np.ndarray, hashes: np.ndarray) -> str:
    """128 bits (hex) of the kept hashes and their positions."""
    return hashlib.blake2b(positions.astype("<i8").tobytes() + hashes.astype("<u8").tobytes(), digest_size=16).hexdigest()


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, positions, hashes) of every whole text; a null or empty text has empty arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kept = [winnow(t, gram, window) for t in part["text"].to_pylist()]
                lists = [pa.array([k[0] for k in kept], pa.list_(pa.int64())), pa.array([k[1].view(np.int64) for k in kept], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *lists], ["doc_id", "positions", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, positions array<long>, hashes array<long>")


# --- edited texts ----------------------------------------------------------------

def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(keyed: DataFrame) -> list[tuple[int, int, int]]:
    """First keys of the ranges that Spark's range partitioning gives; one a shuffle partition at most."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = keyed.repartitionByRange(n, "k0", "k1", "k2").groupBy(F.spark_partition_id()).agg(F.min(F.struct("k0", "k1", "k2")).alias("k"))
    return sorted(tuple(r["k"]) for r in parts.collect())


def with_following(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows in ranges of descending id, each range followed by the next one's first row (``context``).

    Returns the partitioned and sorted (bucket, context, doc_id, text) and the
    number of ranges. Texts are shuffled once; the ranges come from ids and text
    hashes alone. Rows without an id come last, rows that repeat an id are
    ordered by a hash of their text.
    """
    keys = {
        "k0": F.col("doc_id").isNull().cast("int"),
        # Descending order of the id, without overflow.
        "k1": F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).cast("long"),
        "k2": F.xxhash64("text"),
    }
    keyed = docs.select(F.col("doc_id").cast("long"), "text").withColumns(keys)
    bounds = _ranges(keyed.select("k0", "k1", "k2"))
    n = max(1, len(bounds))

    @F.pandas_udf("int")
    def place(k0: pd.Series, k1: pd.Series, k2: pd.Series) -> pd.Series:
        """Twice the range's number, and one more for its first key."""
        found = []
        for key in zip(k0.tolist(), k1.tolist(), k2.tolist()):
            at = max(0, bisect_right(bounds, key) - 1)
            found.append(2 * at + (bounds[at] == key))
        return pd.Series(found, dtype="int32")

    placed = keyed.withColumn("place", place("k0", "k1", "k2"))
    bucket = F.floor(F.col("place") / 2).cast("int")
    before = F.pmod(bucket - 1, F.lit(n)).cast("int")
    copies = F.array_compact(F.array(
        F.struct(bucket.alias("bucket"), F.lit(False).alias("context")),
        F.when(F.col("place") % 2 == 1, F.struct(before.alias("bucket"), F.lit(True).alias("context"))),
    ))
    rows = placed.select("doc_id", "text", "k0", "k1", "k2", F.inline(copies))
    rows = rows.repartitionById(n, "bucket").sortWithinPartitions("bucket", "context", "k0", "k1", "k2")
    return rows.select("bucket", "context", "doc_id", "text"), n


def edited_fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The next document is the one of the next smaller id, after the last the
    first; a table of one row follows itself. A null text is empty; rows
    without an id come last, rows that repeat an id are ordered by a hash of
    their text and each follows the other. Very long texts are hashed in steps.
    An empty table gives an empty table. Other columns are left out.
    """
    rows, _ = with_following(docs)
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, skip, out = None, None, []

        def close(text: str, kept: tuple) -> None:
            _, doc_id, own, mine = held
            new = edited(own, text)
            changed = winnow(new, gram, window)
            sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, len(own), sha, digest(*mine), digest(*changed), likeness(mine[1], changed[1]), likeness(mine[1], kept[1])))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))
            out.clear()
            return batch

        for batch in batches:
            for bucket, context, doc_id, text in zip(*[batch[c] for c in ("bucket", "context", "doc_id", "text")]):
                bucket = bucket.as_py()
                if bucket == skip:
                    continue
                text = text.as_py() or ""
                kept = winnow(text, gram, window)
                if held and held[0] == bucket:
                    close(text, kept)
                # The first row of the next range ends this one.
                held, skip = (None, bucket) if context.as_py() else ((bucket, doc_id.as_py(), text, kept), None)
            if out:
                yield flush()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema)
