"""DuckDB SQL for what SQL can express of the registered queries."""

from __future__ import annotations

from sluice.llm.secrets import BASE, RULES

OP5 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, list_slice(w, p, p + least(13, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT len(g) AS k FROM windows
), grams AS (
  SELECT doc_id, p, k, list_slice(w, p, p + k - 1) AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)
), found AS (
  SELECT doc_id, p, k, item_id FROM grams JOIN windows USING (g)
), hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""



def _secrets() -> str:
    """Spans by cutting each text at a rule's matches and adding up the lengths of what comes before."""
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
  SELECT id, {rank} AS rank, '{rule.kind}' AS kind,
    unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': CAST(coalesce(list_sum(list_transform(b[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS BIGINT), 'n': length(m[i]), 'g': length(g[i])}})) AS u, {rule.least} AS least
  FROM (SELECT id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS b FROM d)""")
    base = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
spans AS (SELECT id, rank, kind, u.s AS s, kind || ':' || u.s || ':' || (u.s + u.n) AS x FROM found WHERE u.g >= least),
docs AS (
  SELECT id, {base}, string_agg(x, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(x, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY id
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN docs USING (id)
"""


OP8 = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q, e c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_SHINGLES = r"""
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM {source}
), sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {k} THEN w ELSE list_slice(w, p, p + {k} - 1) END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k} + 1, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, component_id) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.component_id FROM reach r JOIN edges e ON e.a = r.doc_id
), least AS (
  SELECT doc_id, min(component_id) AS component_id FROM reach GROUP BY doc_id
)"""

OP10 = f"""
WITH RECURSIVE {_SHINGLES.format(source="documents", k=4)}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
"""

# fixed values: the table of the reflected CRC-32 polynomial, by its rule
def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


OP12 = rf"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT {_crc_table()}::BIGINT[] AS t
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS w
  FROM documents
), counted AS (
  SELECT k, w, count(*) AS n FROM runs GROUP BY k, w
), bytes AS (
  SELECT w, n, flatten(list_transform(string_split(k || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END))::BIGINT[] AS b FROM counted
), hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1
), vocab AS MATERIALIZED (
  SELECT word, n FROM words WHERE length(word) >= 6 AND n >= 5
), places AS (
  SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocab
), holes AS (
  SELECT word, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS g, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM places
), pairs AS (
  SELECT x.word, y.word AS near FROM holes x JOIN holes y ON x.g = y.g AND x.word <> y.word
  UNION SELECT h.word, v.word FROM holes h JOIN vocab v ON h.d = v.word
  UNION SELECT v.word, h.word FROM holes h JOIN vocab v ON h.d = v.word
), ranked AS (
  SELECT p.word, p.near, v.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.near) AS rank
  FROM pairs p JOIN vocab v ON v.word = p.near
), formed AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
  FROM vocab v LEFT JOIN ranked r ON r.word = v.word AND rank = 1
), steps(word, root) AS (
  SELECT word, word FROM formed UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL
), roots AS (
  SELECT s.word, s.root FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NULL
)
SELECT word, n, CAST(n_near AS BIGINT) AS n_near, form, CAST(form_n AS BIGINT) AS form_n, root FROM formed JOIN roots USING (word)
"""


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment and mean, one after the other."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, p, min(list_sum(list_transform(range(1, len(c) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT * {entries} + k) AS best
  FROM pieces JOIN c{r} USING (p) GROUP BY vec_id, p
)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT p, best % {entries} AS k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN pieces USING (vec_id, p), unnest(range(1, len(x) + 1)) AS u(i) GROUP BY p, k, i
), n{r} AS (
  SELECT p, k, list((s - ((s % n + n) % n)) // n ORDER BY i) AS c FROM m{r} GROUP BY p, k
), c{r + 1} AS MATERIALIZED (
  SELECT o.p, o.k, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN n{r} n ON n.p = o.p AND n.k = o.k
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({4096} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
), pieces AS MATERIALIZED (
  SELECT vec_id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, unnest(range({parts})) AS u(p)
), c0 AS MATERIALIZED (
  SELECT p, CAST(rank - 1 AS BIGINT) AS k, x AS c FROM pieces JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM kept) USING (vec_id) WHERE rank <= {entries}
),{",".join(steps)}, coded AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(best % {entries})), 2, '0'), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id
), books AS (
  SELECT sha256(coalesce(string_agg(array_to_string(c, ','), ',' ORDER BY p, k), '')) AS codebooks_sha256 FROM c{rounds}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books
"""


OP11 = f"""
WITH RECURSIVE {_SHINGLES.format(source="documents", k=5)}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN n USING (doc_id)
"""

SQL: dict[str, str] = {
    "op5_decontamination": OP5,
    "op6_secret_scan": _secrets(),
    "op8_exact_top_k": OP8,
    "op10_near_duplicates": OP10,
    "op11_jaccard_join": OP11,
    "op12_spelling_variants": OP12,
    "op13_vector_codes": _codes(),
}
