"""DuckDB statements that give the rows of queries SQL can express."""

#: Words of a text: A-Z to lower case, runs of anything but ASCII white space.
WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def _shingles(size: int) -> str:
    return (
        f"CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] "
        f"ELSE list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' '))) END"
    )


NEAR_DUP_SQL = f"""
WITH RECURSIVE sets AS (SELECT doc_id, {_shingles(2)} AS s FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM sets),
sim AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.v = b.v AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, s.b FROM reach r JOIN sim s ON r.b = s.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM sets s JOIN comp c USING (doc_id)
"""

DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, unnest({_shingles(5)}) AS v FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
i AS (SELECT item_id, {_shingles(5)} AS s FROM (SELECT item_id, {WORDS} AS w FROM benchmark)),
f AS (SELECT item_id, len(s) AS n, unnest(s) AS v FROM i),
hit AS (SELECT d.doc_id, f.item_id FROM d JOIN f USING (v) GROUP BY d.doc_id, f.item_id, f.n HAVING 100 * count(*) >= 80 * f.n),
per AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items FROM documents LEFT JOIN per USING (doc_id)
"""
