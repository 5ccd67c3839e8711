"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op4_line_dedup"] = r"""
WITH docs AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
    SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs
), keyed AS (
    SELECT doc_id, line, pos,
        translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone
    FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SQL["op10_mixing"] = r"""
WITH sized AS (
    SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
    FROM documents
), totals AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), listed AS (
    SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
        list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) AS w,
        row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
    FROM totals
), levels AS (
    SELECT *, ((SELECT sum(source_size) FROM totals) * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM listed
), targets AS (
    SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, (cap / w, rank)) FROM levels WHERE cap / w > level) * w, cap)) AS target
    FROM levels
), placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), epochs AS (
    SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS full_epochs FROM placed
)
SELECT doc_id, size, source_size, target,
    CAST(full_epochs * size + greatest(0, least(size, budget - full_epochs * source_size - start)) AS BIGINT) AS taken
FROM epochs
"""

SQL["op8_exact_top_k"] = r"""
WITH fit AS (
    SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 64) AS BIGINT)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
    FROM fit q JOIN fit c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

SQL["op2_embedding_near_dedup"] = r"""
WITH RECURSIVE fit AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL
        AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
        AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
    SELECT a AS vec_id, a AS other FROM links
    UNION
    SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
    SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), degrees AS (
    SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(d.n_links, 0) AS BIGINT) AS n_links,
    coalesce(l.component_id, e.vec_id) AS component_id, coalesce(l.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degrees d ON e.vec_id = d.vec_id LEFT JOIN least l ON e.vec_id = l.vec_id
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a string expression whose code points are below 2048, bit by bit over its UTF-8 bytes."""
    points = f"list_transform(string_split({text}, ''), lambda c: unicode(c))"
    utf8 = f"flatten(list_transform({points}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END))"
    step = "lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], {step})"
    return f"xor(list_reduce(list_prepend(4294967295, ({utf8})::BIGINT[]), {byte}), 4294967295)"


SQL["op11_spelling_variants"] = rf"""
WITH RECURSIVE runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents
), counted AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
    SELECT run, n, {crc32_sql("id || ':' || run")} AS h FROM counted
), vocabulary AS (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word,
        CAST(sum(n) AS BIGINT) AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
), gaps AS (
    SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)
), near AS (
    SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word FROM gaps a JOIN vocabulary b ON a.rest = b.word
    UNION SELECT b.word, a.word FROM gaps a JOIN vocabulary b ON a.rest = b.word
), best AS (
    SELECT near.word, any_value(v.n) AS n, CAST(count(*) AS BIGINT) AS n_near, max(o.n) AS best_n, min(struct_pack(m := -o.n, w := near.other)).w AS best
    FROM near JOIN vocabulary v ON near.word = v.word JOIN vocabulary o ON near.other = o.word GROUP BY near.word
), forms AS (
    SELECT word, best AS form, best_n AS form_n FROM best WHERE best_n >= 10 * n
), ways AS (
    SELECT word, form AS root FROM forms
    UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON ways.root = forms.word
), roots AS (
    SELECT word, root FROM ways WHERE root NOT IN (SELECT word FROM forms)
)
SELECT v.word, f.form, coalesce(r.root, v.word) AS root, v.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM vocabulary v LEFT JOIN best b ON v.word = b.word LEFT JOIN forms f ON v.word = f.word LEFT JOIN roots r ON v.word = r.word
"""


def _tree_sql(name: str, levels: int) -> str:
    """CTEs {name}1.. (grp, i, h, n) over {name}0, and the runs {name}_run0.. (grp, run, hs, n) of siblings."""
    out = []
    for k in range(levels):
        out.append(f"""{name}_run{k} AS (
    SELECT grp, i // 16 AS run, list(h ORDER BY i) AS hs, max(n) AS n FROM {name}{k} GROUP BY ALL
), {name}{k + 1} AS (
    SELECT grp, run AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 15) // 16 AS n FROM {name}_run{k}
)""")
    return ", ".join(out)


def _climb_sql(source: str, tree: str, levels: int, grp: str, at: str) -> str:
    """CTEs that take rows (grp, rank, proof, folded) of ``source`` up a tree, one level each."""
    out, before = [], source
    for k in range(levels):
        place = f"({at} // {16**k}) % 16"
        left, right = f"array_to_string(r.hs[1:{place}], '')", f"array_to_string(r.hs[{place} + 2:], '')"
        out.append(f"""{source}_{k} AS (
    SELECT d.* REPLACE (
        CASE WHEN r.n = 1 THEN proof ELSE proof || {left} || {right} END AS proof,
        CASE WHEN r.n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded)
    FROM {before} d JOIN {tree}_run{k} r ON r.grp = {grp} AND r.run = {at} // {16 ** (k + 1)}
)""")
        before = f"{source}_{k}"
    return ", ".join(out)


def _leaf_sql(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


#: Levels of the SQL's trees: 16 ** 6 leaves a source, 16 ** 4 sources.
_LEVELS, _TOP = 6, 4
SQL["op13_merkle_manifest"] = f"""
WITH digests AS (
    SELECT doc_id, coalesce('=' || source, '') AS grp, {_leaf_sql("text")} AS leaf,
        CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered
    FROM documents
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY grp) AS n FROM digests
), t0 AS (SELECT grp, rank AS i, leaf AS h, n FROM leaves), {_tree_sql("t", _LEVELS)},
subroots AS (
    SELECT grp AS name, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM t{_LEVELS}
), s0 AS (SELECT '' AS grp, place AS i, subroot AS h, n FROM subroots), {_tree_sql("s", _TOP)},
low AS (
    SELECT l.doc_id, l.leaf, l.grp, l.rank, s.place, s.subroot, (SELECT h FROM s{_TOP}) AS root, '' AS proof, coalesce(l.tampered, l.leaf) AS folded
    FROM leaves l JOIN subroots s ON l.grp = s.name
), {_climb_sql("low", "t", _LEVELS, "d.grp", "d.rank")},
high AS (SELECT * FROM low_{_LEVELS - 1}), {_climb_sql("high", "s", _TOP, "''", "d.place")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM high_{_TOP - 1}
"""
