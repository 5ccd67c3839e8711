"""Packing token pieces into fixed-length sequences by minimum bin slack.

Texts are tokenized in tasks; only documents longer than a sequence are cut.
All that the packing depends on is how many pieces there are of each length, a
histogram of at most ``capacity`` entries whatever the input. Over it, bin by
bin, a bitset subset-sum finds the fullest combination of available lengths
that holds the longest one; the combination is used as often as its lengths
last and removed. One of its lengths then has fewer pieces left than the
combination takes, so the plan has at most ``capacity * ln(capacity)`` entries.
Pieces then take their places by rank within their
length, from prefix sums over hash buckets, so one common length is spread
over all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgelane.session import materialise

CAPACITY = 2048
# Pieces of a length are ranked in this many buckets.
BUCKETS = 1024
# Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 250_000


def byte_alphabet() -> dict[int, str]:
    """The byte-level BPE's letters: printable Latin-1 bytes stand for themselves, the others for 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """Ids (little-endian uint32 bytes) of white-space separated chunks of text.

    A chunk of plain letters and ASCII signs is cut further where the tokenizer
    cuts by its pattern anyway, between letters and signs, so that fewer
    different strings have to be encoded. The apostrophe, whose contractions the
    pattern treats on its own, and any other character leave the chunk whole. A
    run of plain lower-case letters is one word of the model, which encodes it
    without the passes that find words.
    """

    import re as _re

    _plain = _re.compile(r"[a-zß-öø-ɏ!-&(-;=-@\[-`{-~]+")
    _runs = _re.compile(r"[a-zß-öø-ɏ]+|[^a-zß-öø-ɏ]+")
    _letters = _re.compile(r"[a-zß-öø-ɏ]+")
    _alphabet = byte_alphabet()
    # Python's split() takes these for white space, the tokenizer doesn't.
    _odd = _re.compile(r"[\x1c-\x1f]")

    def __init__(self, tokenizer):
        self.tokenizer, self.old, self.runs, self.old_runs = tokenizer, {}, {}, {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, text: str) -> bytes:
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self._alphabet)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(text)])

    def run(self, text: str) -> bytes:
        ids = self.runs.get(text)
        if ids is None:
            ids = self.old_runs.get(text)
            if ids is None:
                ids = self.word(text) if self._letters.fullmatch(text) else self.encode(text)
            if len(self.runs) >= REMEMBERED:
                self.old_runs, self.runs = self.runs, {}
            self.runs[text] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            low = chunk.lower()
            if self._letters.fullmatch(low):
                ids = self.run(low)
            elif self._plain.fullmatch(low):  # some capitals of the range have their small letter elsewhere
                ids = b"".join(map(self.run, self._runs.findall(low)))
            else:
                ids = self.encode(chunk)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        if self._odd.search(text):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's tokenizer and what it remembers, kept between tasks."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = WordIds(Tokenizer.from_file(path))
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut only if too long.

    ``tokenizer_path`` names a vocabulary file that every executor can open.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = words.of(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> list[int]:
    """The combination with ``lengths[0]`` that leaves the least slack.

    ``lengths`` descend. Bit s of a set says that sum s is reachable; powers of
    two of a length stand for its copies. The walk back prefers few, long pieces.
    """
    first = lengths[0]
    room = capacity - first
    full = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for n in lengths:
        if n > room:
            continue
        left, k = min(counts[n] - (n == first), room // n), 1
        while left > 0:
            use = min(k, left)
            steps.append((n, use, sums))
            sums |= (sums << (n * use)) & full
            left -= use
            k *= 2
        if sums >> room & 1:
            break
    at, chosen = sums.bit_length() - 1, [first]
    for n, use, before in reversed(steps):
        if not before >> at & 1:
            chosen += [n] * use
            at -= n * use
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths, number of bins) until no piece is left."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    plan = []
    while counts:
        chosen = fullest(sorted(counts, reverse=True), counts, capacity)
        need = {n: chosen.count(n) for n in set(chosen)}
        times = min(counts[n] // k for n, k in need.items())
        plan.append((chosen, times))
        for n, k in need.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return plan


def places(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, copies a sequence, offset of the first copy).

    Ranks of a length from ``first rank`` on go to that combination's sequences,
    ``copies`` to each, one behind the other.
    """
    out, used, sequence = [], {}, 0
    for chosen, times in plan:
        at = 0
        for n in sorted(set(chosen), reverse=True):
            k = chosen.count(n)
            out.append((n, used.get(n, 0), k * times, sequence, k, at))
            used[n] = used.get(n, 0) + k * times
            at += k * n
        sequence += times
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id``, ``piece``, ``length``.

    Other columns pass through. Null ids and repeated rows are pieces like any
    others; an empty table gives an empty table. Columns named like the two are
    replaced.
    """
    spark = cut.sparkSession
    cut = cut.drop("sequence_id", "offset")
    bucketed = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    cells = materialise(bucketed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "length-counts")
    # One row a length: no more than the capacity.
    histogram = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum("_n")).collect()}
    table = spark.createDataFrame(
        places(plan_bins(histogram, capacity)), "_len long, _first long, _ranks long, _seq long, _copies long, _at long"
    )
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", *[c for c in ("start", "ids_crc32") if c in cut.columns])
    ranked = (
        bucketed.join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_start") + F.row_number().over(inside) - 1)
    )
    placed = ranked.join(
        F.broadcast(table),  # a row for each length of each combination: bounded by the histogram
        (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_ranks")),
    )
    nth = F.col("_rank") - F.col("_first")
    return placed.select(
        *cut.columns,
        (F.col("_seq") + F.floor(nth / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(nth, F.col("_copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of ``docs`` (``doc_id``, ``text``) with their places; a null or empty text is its end id alone."""
    return pack(materialise(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
