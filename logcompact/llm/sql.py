"""SQL that states some operators' results."""

EXACT_DEDUP = r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents
)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    doc_id = first_value(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm ORDER BY cp DESC, doc_id)
"""


def _vector_codes(rounds: int = 2) -> str:
    """Codebooks and codes by plain joins; cells and books have a row per component."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS (
    SELECT vec_id, part, min(d * 64 + entry) % 64 AS entry, min(d * 64 + entry) // 64 AS d
    FROM (
        SELECT vec_id, part, entry, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d
        FROM cells c JOIN book{k} b USING (part, j) GROUP BY vec_id, part, entry
    ) GROUP BY vec_id, part
),
book{k + 1} AS (
    SELECT part, entry, j, coalesce((s - ((s % n) + n) % n) // n, b.x) AS x
    FROM book{k} b LEFT JOIN (
        SELECT part, entry, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM cells JOIN near{k} USING (vec_id, part) GROUP BY ALL
    ) USING (part, entry, j)
)""")
    return f"""
WITH kept AS (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS place, len(embedding) // 16 AS width, embedding
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
each AS (SELECT vec_id, place, width, unnest(embedding) AS x, unnest(range(len(embedding))) AS k FROM kept),
cells AS (
    SELECT vec_id, place, k // width AS part, k % width AS j, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM each
),
book0 AS (SELECT part, place AS entry, j, x FROM cells WHERE place < 64),{",".join(steps)},
coded AS (
    SELECT vec_id, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM near{rounds} GROUP BY vec_id
)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, j)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


VECTOR_CODES = _vector_codes()

DIVERGENCE = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'
        ) AS terms
    FROM documents
),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
sizes AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM groups LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
    SELECT lang, source, term, coalesce(c.n, 0) AS n,
        1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (totals.n + 5 * v) AS p, 1 + (1000000000 * (total + 5)) // (sizes.n + 5 * v) AS q
    FROM totals JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN c USING (lang, source, term)
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
        SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL
    ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank
FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank
FROM terms QUALIFY rank <= 50
"""
