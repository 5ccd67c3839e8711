"""Language ID by Bayesian fusion of text, markup, address and host evidence.

The text's likelihood comes from a character-trigram model, fitted on a bounded
sample of documents with a language. The text alone gives every row a first
posterior; grouped sums of these over all rows then say how often a language
occurs overall, under an address suffix, and on a host, each level smoothed
towards the one above, and how often a language is declared as another. The
row's own share is taken out of its host's and suffix's sums. The final
posterior multiplies text likelihood, host prior and declaration likelihood.

Hosts may be hot: sums are combined before their shuffle, and priors are a
written table that joins the rows under adaptive skew handling.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surgelane.session import materialise

# Documents the trigram model is fitted on at most (one of each language at least), and hashed trigrams it has.
SAMPLE = 4000
TRIGRAMS = 1 << 15
# Codes that fewer labelled rows than this share carry are one class, OTHER: at most
# 1 / LEAST_SHARE classes and one more, whatever strings the column holds.
LEAST_SHARE = 1 / 256
OTHER = "other"
# Overlapping trigrams are not independent: their log likelihoods count a third.
TEMPER = 1 / 3
# Pseudo counts of the level above in a host's, a suffix's and a declaration's sums.
SMOOTH = 5.0
# Rows whose best language is less likely, or whose text has no letter, are rejected.
MIN_POSTERIOR = 0.5
# A text is of a known language if its trigrams are likelier than in a model that has seen
# nothing, by this part of what texts of the language are, short of some standard errors.
KNOWN_SHARE = 0.25
KNOWN_ERRORS = 2.0

_TAGS = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^<>]*>", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)


def _trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashed trigrams of the letters and gaps of a text, in blocks."""
    step = 1 << 18
    text = f" {text.lower()} "
    for at in range(0, len(text), step):
        c = np.frombuffer(text[at : at + step + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        # Of ASCII only letters count; all else there is a gap.
        c = np.where((c < 128) & ~((c >= 97) & (c <= 122)), 0, c).astype(np.uint64)
        if len(c) < 3:
            continue
        a, b, d = c[:-2], c[1:-1], c[2:]
        some = (b != 0) | ((a != 0) & (d != 0))
        key = (a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA6B) + d * np.uint64(0xC2B2AE35)) >> np.uint64(7)
        yield (key[some] & np.uint64(TRIGRAMS - 1)).astype(np.int64)


def visible(page: str) -> str:
    """A page's text without markup, scripts and styles, references decoded."""
    return html.unescape(_TAGS.sub(" ", page))


class Model(NamedTuple):
    """Languages, log P(trigram | language), and how texts of a language score that the model hasn't seen.

    ``floors`` are the least mean log likelihoods of a text of each language,
    ``spreads`` the standard deviations of a trigram's.
    """

    languages: list[str]
    table: np.ndarray
    floors: list[float]
    spreads: list[float]


def chosen_rows(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text) that the model is fitted on: of every language the rows with the least id hashes.

    Languages are counted over all rows; rare ones are taken together as ``OTHER``.
    Each class gets an equal part of ``sample``, one row at least, and a repeated id
    gives its least text. Rows without id, text or language teach nothing.
    """
    usable = labelled.where("doc_id is not null and lang is not null and text is not null").withColumn("lang", F.lower("lang"))
    total = usable.count()
    sizes = usable.groupBy("lang").count().where(F.col("count") >= F.lit(LEAST_SHARE * total)).collect()  # 1 / LEAST_SHARE rows at most
    rest = total - sum(r["count"] for r in sizes)
    if rest:
        known = labelled.sparkSession.createDataFrame([(r["lang"],) for r in sizes], "_known string")
        usable = usable.join(F.broadcast(known), F.col("lang") == F.col("_known"), "left")
        usable = usable.withColumn("lang", F.coalesce("_known", F.lit(OTHER))).drop("_known")
        sizes = [{"lang": r["lang"], "count": r["count"]} for r in sizes if r["lang"] != OTHER] + [
            {"lang": OTHER, "count": rest + sum(r["count"] for r in sizes if r["lang"] == OTHER)}
        ]
    part = max(1, sample // max(1, len(sizes)))
    # Twice the part and some are expected under the limit, so that only these few are ranked.
    limits = [(r["lang"], 1.0 if r["count"] <= 4 * part + 100 else (2 * part + 50) / r["count"]) for r in sizes]
    limits = labelled.sparkSession.createDataFrame(limits, "_lang string, _limit double")
    hashed = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    few = hashed.join(F.broadcast(limits), F.col("lang") == F.col("_lang")).where(F.pmod("_h", F.lit(1 << 32)) < F.col("_limit") * (1 << 32))
    order = Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 32)), "_h", "doc_id")
    ranked = few.dropDuplicates(["lang", "doc_id"]).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= part)
    ids = ranked.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    found = usable.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    return found.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of ``doc_id``, ``text``, ``lang`` (see ``chosen_rows``).

    Counting is done in tasks; the model is all that returns.
    """
    rows = materialise(chosen_rows(labelled, sample), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                total = sums.setdefault(lang, np.zeros(TRIGRAMS, np.int64))
                for grams in _trigrams(text.as_py()):
                    total += np.bincount(grams, minlength=TRIGRAMS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], ["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.full((TRIGRAMS, len(languages)), 0.5, np.float32)
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        table[own["gram"].to_numpy(), k] += own["n"].to_numpy()
    if not languages:
        return Model([], table, [], [])
    sizes, place = table.sum(axis=0, dtype=np.float64), {lang: k for k, lang in enumerate(languages)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trigrams, and sums of their log likelihoods and squares, each text by what the others teach."""
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                own = np.zeros(TRIGRAMS, np.int64)
                for grams in _trigrams(text.as_py()):
                    own += np.bincount(grams, minlength=TRIGRAMS)
                at, n = np.flatnonzero(own), int(own.sum())
                if n:
                    k = place[lang]
                    ll = np.log((table[at, k] - own[at]).clip(0.5) / (sizes[k] - n))
                    out.append((lang, n, float(own[at] @ ll), float(own[at] @ (ll * ll))))
            lang, n, s, q = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(n, pa.int64()), pa.array(s, pa.float64()), pa.array(q, pa.float64())], ["lang", "n", "s", "q"])

    scored = rows.mapInArrow(score, "lang string, n long, s double, q double").groupBy("lang").agg(*[F.sum(c).alias(c) for c in "nsq"]).collect()
    means = {r["lang"]: (r["s"] / r["n"], r["q"] / r["n"]) for r in scored}
    unseen = -float(np.log(TRIGRAMS))
    floors = [min(means[x][0], unseen + KNOWN_SHARE * (means[x][0] - unseen)) for x in languages]
    spreads = [max(0.0, means[x][1] - means[x][0] ** 2) ** 0.5 for x in languages]
    return Model(languages, np.log(table / sizes).astype(np.float32), floors, spreads)


def text_evidence(rows: DataFrame, model: Model, markup: bool) -> DataFrame:
    """(id, host, suffix, declared, grams, ll): ``ll`` has a tempered log likelihood per language.

    ``rows`` has id, text, host, suffix, declared. With ``markup`` the text is a
    page: its language attribute is the declaration and its visible text counts.
    """
    languages, table = model.languages, model.table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared, grams, lls = batch["declared"].to_pylist(), [], []
            for k, text in enumerate(batch["text"]):
                text = text.as_py() or ""
                if markup:
                    found = _DECLARED.search(text)
                    declared[k] = found[1].lower() if found else None
                    text = visible(text)
                ll, n = np.zeros(len(languages)), 0
                for g in _trigrams(text):
                    ll += table[g].sum(axis=0, dtype=np.float64)
                    n += len(g)
                grams.append(n)
                lls.append((ll * TEMPER).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["host"], batch["suffix"], pa.array(declared, pa.string()), pa.array(grams, pa.int64()), pa.array(lls, pa.list_(pa.float64()))],
                ["id", "host", "suffix", "declared", "grams", "ll"],
            )

    return rows.select(F.col("id").cast("long"), "text", "host", "suffix", F.col("declared").cast("string")).mapInArrow(
        run, "id long, host string, suffix string, declared string, grams long, ll array<double>"
    )


def _normal(logs: Column) -> Column:
    """Probabilities from logs, by the largest."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def fuse(evidence: DataFrame, model: Model, smooth: float = SMOOTH, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """(id, host, declared, language, posterior, text_language, accepted) for every row of evidence.

    Rows without trigrams have the prior alone and are rejected, as are texts whose
    trigrams no language makes likely; null hosts, suffixes and declarations are
    values of their own.
    """
    languages = model.languages
    width = len(languages)
    names = F.array(*[F.lit(x) for x in languages]) if width else F.array().cast("array<string>")
    if not width:
        return evidence.select(
            "id", "host", "declared", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"),
            F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("accepted"),
        )
    # Rows without text say nothing on hosts and declarations.
    rows = evidence.withColumns(
        {
            "host": F.coalesce("host", F.lit("")),
            "suffix": F.coalesce("suffix", F.lit("")),
            "said": F.coalesce("declared", F.lit("")),
            "p": F.when(F.col("grams") > 0, _normal(F.col("ll"))).otherwise(F.array(*[F.lit(0.0)] * width)),
        }
    )
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(width)]

    def total(name: str, *by: str) -> DataFrame:
        grouped = rows.groupBy(*by).agg(*sums).select(*by, F.array(*[f"s{i}" for i in range(width)]).alias(name))
        return materialise(grouped, "language-sums")

    overall = [float(x or 0.0) for x in rows.agg(*sums).first()]
    n = sum(overall)
    base = F.array(*[F.lit((x + 1.0) / (n + width)) for x in overall])
    joined = (
        rows.join(total("suffix_sums", "suffix"), "suffix")
        .join(total("host_sums", "suffix", "host"), ["suffix", "host"])
        .join(total("said_sums", "said"), "said")
    )

    def without_own(sums: Column) -> Column:
        return F.zip_with(sums, F.col("p"), lambda s, p: F.greatest(s - p, F.lit(0.0)))

    def level(rest: Column, above: Column) -> Column:
        size = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(rest, above, lambda s, q: (s + smooth * q) / (size + smooth))

    # P(declaration | language): how often texts of the language carry it, smoothed
    # towards its share of all rows; the same total for every language cancels out.
    said = without_own(F.col("said_sums"))
    share = (F.aggregate(said, F.lit(0.0), lambda a, x: a + x) + 1.0) / F.lit(n + 1.0)
    per_language = F.array(*[F.lit(x) for x in overall])
    declares = F.zip_with(said, without_own(per_language), lambda s, o: (s + smooth * share) / (o + smooth))
    fused = (
        joined.withColumn("suffix_prior", level(without_own(F.col("suffix_sums")), base))
        .withColumn("prior", level(without_own(F.col("host_sums")), F.col("suffix_prior")))
        .withColumn("declares", declares)
        .withColumn("q", _normal(F.zip_with("ll", F.zip_with("prior", "declares", lambda a, b: F.log(a * b)), lambda x, y: x + y)))
    )
    doubt = KNOWN_ERRORS / F.sqrt(F.col("grams"))
    known = F.greatest(F.lit(float("-inf")), *[F.col("ll")[i] / (TEMPER * F.col("grams")) + model.spreads[i] * doubt - model.floors[i] for i in range(width)]) >= 0
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return fused.select(
        "id",
        F.when(F.col("host") != "", F.col("host")).alias("host"),
        "declared",
        best(F.col("q")).alias("language"),
        F.round(F.array_max("q"), 6).alias("posterior"),
        F.when(F.col("grams") > 0, best(F.col("p"))).alias("text_language"),
        F.when(F.col("grams") > 0, known & (F.array_max("q") >= min_posterior)).otherwise(False).alias("accepted"),
    )


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """(page_id, url, host, declared, language, posterior, text_language, accepted) of every page.

    A null page or one without letters has its priors' language and is rejected, and
    so is one whose text is in no language of the labelled documents;
    a null address has neither host nor suffix; repeated rows are each judged.
    """
    model = fit(labelled)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(
        F.struct("page_id", "url").alias("row"), F.xxhash64("page_id", "url", "html").alias("id"), F.col("html").alias("text"),
        host.alias("host"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"), F.lit(None).cast("string").alias("declared"),
    )
    evidence = materialise(text_evidence(rows, model, markup=True), "page-evidence")
    judged = fuse(evidence, model).dropDuplicates(["id"]).withColumnRenamed("id", "_id")
    named = rows.select("id", "row.page_id", "row.url")
    return named.join(judged, F.col("id") == F.col("_id")).drop("id", "_id")


def identify_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``language``, ``posterior`` and ``accepted`` added.

    Their ``lang`` is the declaration, their ``source`` the host. Null and empty
    texts, texts without letters and texts in none of the languages declared are
    rejected; texts like those of rare codes are in the language ``OTHER``;
    repeated rows are each judged;
    columns named like the three are replaced.
    """
    docs = docs.drop("language", "posterior", "accepted")
    model = fit(docs.select("doc_id", "text", "lang"))
    rows = docs.select(
        F.xxhash64("doc_id", "text", "lang", "source").alias("id"), "text", F.col("source").alias("host"),
        F.lit(None).cast("string").alias("suffix"), F.lower("lang").alias("declared"),
    )
    evidence = materialise(text_evidence(rows, model, markup=False), "document-evidence")
    judged = fuse(evidence, model).dropDuplicates(["id"]).select(F.col("id").alias("_lang_id"), "language", "posterior", "accepted")
    keyed = docs.withColumn("_lang_key", F.xxhash64("doc_id", "text", "lang", "source"))
    return keyed.join(judged, F.col("_lang_key") == F.col("_lang_id")).drop("_lang_key", "_lang_id")
