"""DuckDB SQL for the queries that SQL can express."""

OP9 = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
h AS (
    SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM s),
r AS (
    SELECT h FROM h GROUP BY h HAVING count(*) > 1),
m AS (
    SELECT doc_id, list(p) AS ps FROM h WHERE h IN (SELECT h FROM r) GROUP BY doc_id),
c AS (
    SELECT doc_id, list_distinct(flatten(list_transform(ps, lambda x: range(x, x + 35)))) AS gone FROM m),
k AS (
    SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
           CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
                ELSE (SELECT coalesce(string_agg(x.w, ' ' ORDER BY x.i), '')
                      FROM (SELECT unnest(d.w) AS w, unnest(range(1, len(d.w) + 1)) AS i) x
                      WHERE NOT list_contains(c.gone, x.i)) END AS kept
    FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM k
"""

OP8 = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
    FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
    SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (
    SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""
