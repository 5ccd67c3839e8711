"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are lower-case letter runs and the runs' beginnings, which stand for all
inflected and compound forms of a stem. A bounded sample of labelled documents fixes
the vocabulary (terms that speak for the toxic class) and gives the examples;
document frequencies, class sizes and the rate for texts without any vocabulary
term are counted over all rows. Examples with equal vectors are one entry that
carries the weight of both classes.

The inverted index keeps entries in blocks; for every term it knows the largest
weight in each block. A text's terms bound the cosine that a block can reach;
blocks are scored exactly in the order of their bounds until no block can hold
one of the nearest entries. Votes weighted by closeness give a raw score, and an
isotonic fit on left-out examples makes it a probability.

The index is bounded by the sample's size and goes to the tasks with the code.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgelane.session import materialise

# Labelled rows of each class that the model is fitted on at most.
SAMPLE = 4096
# Terms of the vocabulary at most; least standard score (root of the log likelihood ratio) and log odds of a term.
TERMS, MIN_Z, MIN_LOG_ODDS = 2048, 4.0, 1.1
# Toxic examples that a term occurs in at least: the ratio is too sure of fewer.
MIN_TOXIC = 5
NEAREST = 15
BLOCK = 64
# Closeness 1 / (SOFT + distance): how fast a vote fades.
SOFT = 0.1
THRESHOLD = 0.7
# Words, and scores of different texts, that a task remembers.
REMEMBERED = 100_000

_LETTERS = re.compile(r"[^\W\d_]+")


# Lengths of beginnings that are terms of their own.
STEMS = (3, 4, 5, 6)


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def terms_of(word: str) -> list[str]:
    """The word and its beginnings (marked, so that they differ from words)."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


class Known(dict):
    """Words to the numbers of their terms in a vocabulary."""

    def __init__(self, number: dict[str, int]):
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = tuple(self.number[t] for t in terms_of(word) if t in self.number)
        return found


class Index:
    """Block-max inverted index over unit vectors {term: weight} with (toxic, clean) weights."""

    def __init__(self, vectors: list[dict[int, float]], votes: list[tuple[float, float]], ids: list[int], n_terms: int):
        # Entries with the same strongest term stand together, so bounds differ between blocks.
        order = sorted(range(len(vectors)), key=lambda i: (max(vectors[i], key=lambda t: (vectors[i][t], -t)), sorted(vectors[i].items())))
        self.vectors = [vectors[i] for i in order]
        self.votes = np.array([votes[i] for i in order], dtype=float).reshape(-1, 2)
        self.ids = [ids[i] for i in order]
        n = -(-len(order) // BLOCK)
        self.top = np.zeros((n_terms, max(1, n)))
        self.postings: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        for b in range(n):
            lists: dict[int, list[tuple[int, float]]] = {}
            for k, v in enumerate(self.vectors[b * BLOCK : (b + 1) * BLOCK]):
                for t, w in v.items():
                    lists.setdefault(t, []).append((k, w))
                    self.top[t, b] = max(self.top[t, b], w)
            self.postings.append({t: (np.array([k for k, _ in p]), np.array([w for _, w in p])) for t, p in lists.items()})

    def nearest(self, query: dict[int, float], k: int = NEAREST, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) of the k most similar entries with any common term, best first."""
        terms = list(query)
        bound = np.array([query[t] for t in terms]) @ self.top[terms]
        entries, cosines, kth = np.empty(0, np.int64), np.empty(0), 0.0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(entries) == k and bound[b] < kth - 1e-12):
                break
            score = np.zeros(BLOCK)
            for t in terms:
                if t in self.postings[b]:
                    at, w = self.postings[b][t]
                    score[at] += query[t] * w
            at = np.flatnonzero(score > 0)
            at = at[at + b * BLOCK != skip]
            entries, cosines = np.concatenate([entries, at + b * BLOCK]), np.concatenate([cosines, score[at]])
            best = np.lexsort((entries, -cosines))[:k]
            entries, cosines = entries[best], cosines[best]
            kth = cosines[-1] if len(cosines) == k else 0.0
        return entries, cosines

    def raw(self, query: dict[int, float], skip: int = -1, less: tuple[float, float] = (0.0, 0.0)) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of toxic votes by closeness. ``less`` is taken out of the entry ``skip`` (-1: nothing)."""
        entries, cosines = self.nearest(query)
        votes = self.votes[entries]
        if skip >= 0 and (entries == skip).any():
            votes = votes.copy()
            votes[entries == skip] = np.maximum(0.0, votes[entries == skip] - less)
        # An entry votes with the square root of its examples' weight.
        size = votes.sum(axis=1)
        near = 1.0 / (SOFT + 1.0 - np.minimum(1.0, cosines))
        share = np.divide(votes[:, 0], size, out=np.zeros(len(size)), where=size > 0)
        weight = near * np.sqrt(size)
        total = weight.sum()
        return (float((weight * share).sum() / total) if total > 0 else 0.0), entries, cosines


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a non-decreasing weighted fit of y on x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # x sum, y sum, weight
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist()):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def training_labels(labels: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, toxic): one label per document that is not held out (the larger, if several)."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def choose(train: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of each class with the least id hashes, ``sample`` of each at most."""
    hashed = train.withColumn("_h", F.xxhash64("doc_id"))
    parts = [hashed.where(F.col("toxic") == c).orderBy("_h", "doc_id").limit(sample) for c in (1, 0)]
    return parts[0].union(parts[1]).drop("_h")


def vocabulary(chosen: DataFrame, docs: DataFrame) -> list[str]:
    """Terms of the chosen rows that are more frequent in toxic documents, strongest first."""
    ids = F.broadcast(chosen.withColumnRenamed("doc_id", "_id"))  # twice the sample at most
    texts = docs.join(ids, F.col("doc_id") == F.col("_id")).select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for toxic, text in zip(batch["toxic"].to_pylist(), batch["text"]):
                seen[toxic].update({t for w in set(words_of(text.as_py())) for t in terms_of(w)})
            terms = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], ["term", "t", "c"]
            )

    sizes = {r[0]: r[1] for r in chosen.groupBy("toxic").count().collect()}
    n_t, n_c = sizes.get(1, 0), sizes.get(0, 0)
    half = F.lit(0.5)
    odds = F.log((F.col("t") + half) / (F.lit(n_t) - F.col("t") + half)) - F.log((F.col("c") + half) / (F.lit(n_c) - F.col("c") + half))
    counted = texts.mapInArrow(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    scored = counted.where((F.col("t") <= n_t) & (F.col("c") <= n_c)).withColumn("odds", odds)
    # Observed against expected counts of the four cells; unlike the odds' standard error, it doesn't punish terms of no clean example.
    seen, n = F.col("t") + F.col("c"), float(max(1, n_t + n_c))
    cells = [(F.col("t"), seen * (n_t / n)), (F.col("c"), seen * (n_c / n)), (n_t - F.col("t"), (n - seen) * (n_t / n)), (n_c - F.col("c"), (n - seen) * (n_c / n))]
    ratio = sum((F.when(x > 0, x * F.log(x / e)).otherwise(0.0) for x, e in cells), F.lit(0.0))
    scored = scored.withColumn("z", F.sqrt(F.greatest(F.lit(0.0), 2 * ratio)))
    kept = scored.where((F.col("t") >= MIN_TOXIC) & (F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_LOG_ODDS)).orderBy(F.col("z").desc(), "term").limit(TERMS)
    return [r["term"] for r in kept.select("term").collect()]


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, terms, counts): vocabulary terms of every whole text and how often each occurs."""
    number = {t: k for k, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(number)
        for batch in batches:
            found = []
            for text in batch["text"]:
                counts = Counter(chain.from_iterable(filter(None, map(known.__getitem__, words_of(text.as_py())))))
                found.append(sorted(counts.items()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([[t for t, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32()))],
                ["doc_id", "terms", "counts"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, terms array<int>, counts array<int>")


def unit(terms: list[int], counts: list[int], idf: np.ndarray) -> dict[int, float]:
    w = (1.0 + np.log(counts)) * idf[terms]
    w = w / np.sqrt((w * w).sum())
    return dict(zip(terms, w.tolist()))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, nearest_ids, nearest_cosines) for every row of ``docs``.

    Documents whose ``crc32(doc_id as text) % 3`` is 1 are held out: their labels
    are never read. Null and empty texts and texts without a vocabulary term get
    the toxic rate of training documents without one; with no labels at all,
    everything scores 0. A null id is not held out; repeated rows are each scored,
    and of the texts of a labelled id the one with the least terms is the example.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    train = training_labels(labels, held)
    chosen = choose(train, sample).cache()
    terms = vocabulary(chosen, docs)
    counted = materialise(term_counts(docs, terms), "term-counts")

    n_docs = counted.count()
    df = np.zeros(max(1, len(terms)))
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term
        df[r[0]] = r[1]
    idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1.0

    # Of rows that repeat an id, the least; whatever their order.
    single = counted.groupBy("doc_id").agg(F.min(F.struct("terms", "counts")).alias("r")).select("doc_id", "r.*")
    known = single.join(train, "doc_id")
    empty = F.size("terms") == 0
    by_class = {(r["toxic"], r["empty"]): r["count"] for r in known.groupBy("toxic", empty.alias("empty")).count().collect()}
    n_empty = by_class.get((0, True), 0) + by_class.get((1, True), 0)
    base = (by_class.get((1, True), 0) + 0.5) / (n_empty + 1.0) if by_class else 0.0

    # The examples: bounded by the sample, texts reduced to their vocabulary terms.
    examples = single.where(~empty).join(F.broadcast(chosen), "doc_id").collect()
    chosen.unpersist()
    share = {c: by_class.get((c, False), 0) / max(1, sum(r["toxic"] == c for r in examples)) for c in (0, 1)}
    entries: dict[tuple, list] = {}
    for r in sorted(examples, key=lambda r: r["doc_id"]):
        entry = entries.setdefault((tuple(r["terms"]), tuple(r["counts"])), [[0.0, 0.0], r["doc_id"]])
        entry[0][0 if r["toxic"] == 1 else 1] += share[1 if r["toxic"] == 1 else 0]
    keys = list(entries)
    index = Index([unit(list(t), list(c), idf) for t, c in keys], [tuple(entries[k][0]) for k in keys], [entries[k][1] for k in keys], max(1, len(terms)))

    # Calibration: each entry's toxic and clean examples, scored without one of their own.
    raws, ys, ws = [], [], []
    for e, vector in enumerate(index.vectors):
        for c in (1, 0):
            weight = index.votes[e, 0 if c else 1]
            if weight > 0:
                less = (share[1], 0.0) if c else (0.0, share[0])
                raws.append(index.raw(vector, e, less)[0])
                ys.append(float(c))
                ws.append(weight)
    # One pseudo example on either side keeps probabilities off 0 and 1.
    knots = isotonic(np.array([0.0, *raws, 1.0]), np.array([0.0, *ys, 1.0]), np.array([0.5, *ws, 0.5])) if raws else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple] = {}
        for batch in batches:
            out = []
            for t, c in zip(batch["terms"].to_pylist(), batch["counts"].to_pylist()):
                if not t or knots is None:
                    out.append((base, [], []))
                    continue
                key = (*t, -1, *c)
                if key not in seen:
                    raw, near, cosines = index.raw(unit(t, c, idf))
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    score = float(np.interp(raw, *knots)) if len(near) else base
                    seen[key] = (score, [index.ids[i] for i in near[:3].tolist()], cosines[:3].tolist())
                out.append(seen[key])
            scores, ids, cosines = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(scores, pa.float64()), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))],
                ["doc_id", "score", "nearest_ids", "nearest_cosines"],
            )

    scored = counted.mapInArrow(run, "doc_id long, score double, nearest_ids array<long>, nearest_cosines array<double>")
    return scored.select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "nearest_ids", "nearest_cosines"
    )
