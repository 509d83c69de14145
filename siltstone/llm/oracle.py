"""DuckDB SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs of shingle sets, and the closure of the links.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)]) END AS s
    FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
    SELECT a.doc_id AS i, b.doc_id AS j FROM members a JOIN members b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS i, doc_id AS j FROM documents UNION SELECT r.i, p.j FROM reach r JOIN pairs p ON r.j = p.i),
least AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l ON s.doc_id = l.i
"""

_WORDS9 = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: BM25 of all documents for every query.
TOP_K = f"""
WITH words AS (SELECT doc_id, {_WORDS9} AS w FROM documents),
n AS (SELECT count(*) AS n, avg(len(w)) AS length FROM words),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, ln(1 + (n.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY term, n.n),
scores AS (
    SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * d.len / n.length))), 6) AS score
    FROM tf q JOIN df USING (term) JOIN tf d USING (term), n WHERE q.doc_id % 20 = 0 GROUP BY q.doc_id, d.doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

#: All windows of items against all stretches of documents of their lengths.
DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_WORDS9} AS w FROM documents),
items AS (SELECT item_id, {_WORDS9} AS w FROM benchmark),
wins AS (SELECT item_id, unnest([w[k:k + 12] FOR k IN range(1, greatest(len(w) - 12, 1) + 1)]) AS win FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS size FROM wins),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM docs, sizes WHERE len(w) >= size),
found AS (SELECT DISTINCT p.doc_id, p.pos, p.size, x.item_id FROM places p JOIN wins x ON p.w[p.pos:p.pos + p.size - 1] = x.win),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(i.ids), 0) AS BIGINT) AS n_items,
    sha256(coalesce(array_to_string(i.ids, ','), '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN named i USING (doc_id)
"""

_ROUND = """
near{r} AS (
    SELECT rid, CAST(min(d * 16 + c) % 16 AS BIGINT) AS c, min(d) AS d FROM (
        SELECT p.rid, q.c, sum((p.x - q.x) * (p.x - q.x)) AS d FROM parts p JOIN at{r} q USING (i) GROUP BY p.rid, q.c) GROUP BY rid)"""
_MOVE = """
means{r} AS (SELECT n.c, p.i, CAST(floor(CAST(sum(p.x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM near{r} n JOIN parts p USING (rid) GROUP BY n.c, p.i),
at{s} AS (SELECT a.c, a.i, coalesce(m.x, a.x) AS x FROM at{r} a LEFT JOIN means{r} m USING (c, i))"""

#: Three rounds, each with all distances.
CENTROIDS = f"""
WITH kept AS (
    SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, unnest(v) AS x, unnest(range(64)) AS i FROM kept),
firsts AS (SELECT v, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM kept QUALIFY c < 16),
at0 AS (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM firsts),{",".join(_ROUND.format(r=r) + "," + _MOVE.format(r=r, s=r + 1) for r in range(3))},{_ROUND.format(r=3)},
digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM at3 GROUP BY c)
SELECT k.vec_id, CAST(n.c AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(n.d) OVER () AS BIGINT) AS inertia, g.centroid_sha256
FROM kept k JOIN near3 n USING (rid) JOIN digests g ON n.c = g.c
"""

#: CRC-32 byte by byte, over a table made from its polynomial.
RESAMPLING = f"""
WITH tab AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), list_transform(range(8), lambda k: CAST(k AS BIGINT))),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT doc_id, {_WORDS9} AS w, row_number() OVER () AS rid FROM documents),
uses AS (SELECT rid, unnest(w) AS word FROM docs),
aims AS (SELECT unnest({_WORDS9}) AS word FROM benchmark),
vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM uses UNION SELECT word FROM aims)),
buckets AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda k: CAST('0x' || h[2 * k + 1:2 * k + 2] AS BIGINT))),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM vocabulary, tab),
s AS (SELECT bucket, count(*) AS s FROM uses JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aims JOIN buckets USING (word) GROUP BY bucket),
gain AS (
    SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM uses) + 10000 AS DOUBLE))
        / (CAST(s + 1 AS DOUBLE) * CAST((SELECT count(*) FROM aims) + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT rid, sum(g) AS g FROM uses JOIN buckets USING (word) JOIN gain USING (bucket) GROUP BY rid),
scores AS (
    SELECT d.doc_id, d.rid, CAST(len(w) AS BIGINT) AS n_features, coalesce(CAST(g // len(w) - CASE WHEN g < 0 AND g % len(w) <> 0 THEN 1 ELSE 0 END AS BIGINT), 0) AS weight,
        CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
    FROM docs d LEFT JOIN sums USING (rid)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS BIGINT) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scores)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked
"""

ORACLE_SQL = {
    "op1_near_duplicates": NEAR_DUPLICATES,
    "op3_top_k_search": TOP_K,
    "op9_decontamination": DECONTAMINATION,
    "op11_centroid_clustering": CENTROIDS,
    "op12_importance_resampling": RESAMPLING,
}
