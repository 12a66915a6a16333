"""DuckDB SQL for the queries that SQL expresses."""

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SOLID = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"

OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS o FROM w GROUP BY s),
hit AS (SELECT DISTINCT doc_id, i FROM w JOIN m USING (s) WHERE o < doc_id),
b AS (SELECT doc_id, j, p, coalesce(j - max(i) OVER (PARTITION BY doc_id ORDER BY j) < 50, false) AS gone
  FROM (SELECT doc_id, j, substr(h, 2 * j + 1, 2) AS p FROM (SELECT *, unnest(range(0, n)) AS j FROM d)) x LEFT JOIN (SELECT doc_id, i, i AS j FROM hit) USING (doc_id, j)),
e AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY j) AS begins FROM b),
a AS (SELECT doc_id, CAST(count(CASE WHEN gone THEN 1 END) AS BIGINT) AS n_removed, count(CASE WHEN begins THEN 1 END) AS n_spans, coalesce(string_agg(CASE WHEN NOT gone THEN p END, '' ORDER BY j), '') AS kept FROM e GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(t=_LOWER.format(t='text'))} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM.format(t=_LOWER.format(t='text'))} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i + 1:i + least(len(w), 13)], ' ') AS g FROM (SELECT *, unnest(range(0, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, size, array_to_string(w[i + 1:i + size], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
hit AS (SELECT doc_id, item_id, i, size FROM dw JOIN iw USING (size, g)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SOLID.format(t=_LOWER.format(t='text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT *, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1, 2
"""

OP9 = """
WITH d AS (SELECT DISTINCT coalesce(doc_id, 9223372036854775807) AS doc, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS row, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc, row, no - 1 AS no, x FROM (SELECT doc, row, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM d) WHERE regexp_matches(x, '[^\\x00-\\x20]')),
f AS (SELECT x, length(x) AS n, min((doc, row, no)) AS place FROM l GROUP BY 1),
m AS (SELECT *, unnest([n, n - 1]) AS m FROM f WHERE n >= 20),
k AS (SELECT x, n, place, m, left(x, m // 2) AS h, 1 AS side FROM m UNION ALL SELECT x, n, place, m, right(x, m - m // 2), 2 FROM m),
c AS (SELECT DISTINCT a.x AS x, a.n AS n, b.x AS y, b.n AS k FROM k a JOIN k b ON a.m = b.m AND a.h = b.h AND a.side = b.side AND b.place < a.place AND abs(a.n - b.n) <= 1),
near AS (SELECT DISTINCT x FROM c WHERE len(list_filter(range(0, greatest(n, k)), lambda i: left(x, i) = left(y, i) AND substr(x, i + 1 + CASE WHEN n >= k THEN 1 ELSE 0 END) = substr(y, i + 1 + CASE WHEN k >= n THEN 1 ELSE 0 END))) > 0),
g AS (SELECT doc, row, list_sort(list(no)) AS removed FROM l JOIN f USING (x) LEFT JOIN (SELECT x, true AS near FROM near) USING (x) WHERE near OR (doc, row, no) > place GROUP BY 1, 2),
t AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS doc, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS row, coalesce(len(string_split(text, chr(10))), 0) AS n_lines FROM documents)
SELECT doc_id, n_lines, coalesce(len(removed), 0) AS n_removed, coalesce(removed, []::BIGINT[]) AS removed FROM t LEFT JOIN g USING (doc, row)
"""


def _op11(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    near = """a{r} AS MATERIALIZED (SELECT row, vec_id, x, j, d FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY d, j) AS best FROM (
  SELECT row, vec_id, x, j, CAST(list_sum(list_transform(range(1, {n}), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d FROM v, c{r})) WHERE best = 1)"""
    mean = """c{r} AS MATERIALIZED (SELECT o.j, coalesce(m.c, o.c) AS c FROM c{p} o LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
  SELECT j, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{p}, (SELECT unnest(range(1, {n})) AS i) GROUP BY j, i) GROUP BY j) m USING (j))"""
    steps = [near.format(r=0, n=dim + 1)]
    for r in range(1, rounds + 1):
        steps += [mean.format(r=r, p=r - 1, n=dim + 1), near.format(r=r, n=dim + 1)]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x AS c FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {k})),
{", ".join(steps)}
SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} USING (j)
"""


OP11 = _op11()

OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT *, sha1(t) AS h FROM p),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""

SQL = {"op4_suffix_array_dedup": OP4, "op7_benchmark_decontamination": OP7, "op8_ngram_jaccard_join": OP8, "op9_line_dedup": OP9, "op11_centroid_clustering": OP11, "op12_warc": OP12}
