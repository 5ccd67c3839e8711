"""Documents for the llm tests, and components by brute force."""

from __future__ import annotations

LONG = "a line that is long enough to count as boilerplate, repeated"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra: bool = False):
    """Documents from (doc_id, text[, lang[, source]]); with ``extra``, columns of clashing names."""
    from pyspark.sql import functions as F

    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA)
    if extra:
        for name in ("fp", "id", "node", "label", "h1", "pos", "words", "n_lines", "kept_text", "taken", "target", "shard", "slot",
                     "piece", "sequence_id", "score", "terms", "language", "accepted", "component_id", "_bucket", "t", "g"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def awkward():
    """Nulls in every column, empty, very short and very long texts, ties and repeated rows."""
    words = " ".join(f"word{i % 977} thing{i % 31}" for i in range(30_000))
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "one", "en", "b"), (4, "one", "en", "b"),
        (5, words, "en", "b"), (6, words, "de", None), (None, "a text without an id", "en", "a"), (None, None, None, None),
        (7, f"head\n{LONG}\ntail", "en", "a"), (8, f"{LONG}\n{LONG.upper()}  ", "fr", "a"), (9, f"\t{LONG}\nx", "en", "a"),
        (10, f"y\n{LONG}", "en", "c"), (11, f"z\n{LONG}", "en", "c"), (12, "ß́ ퟿'tis <|endoftext|> \x1c it's", "xx", "c"),
    ]


def least_reachable(ids, links):
    """id -> least id in its component."""
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
