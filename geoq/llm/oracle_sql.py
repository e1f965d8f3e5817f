"""DuckDB SQL of the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op8_top_k_inner_product"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""


def _op1() -> str:
    from geoq.llm.url_filter import BUCKETS, DECAY, LABELLED_URLS, RULES, STEP, STEPS
    labelled = ", ".join(f"('{u}', {y})" for u, y in LABELLED_URLS)
    rules = ", ".join(f"({k}, '{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}', '{v}')" for k, (r, v) in enumerate(RULES))
    # buckets of one text field: code points a, b, c of every three characters
    grams = f"""list_transform(range(1, greatest(length(TEXT) - 1, 1)), lambda i:
      ((((((FIELD * 1009 + ord(substr(TEXT, i, 1))) % 1000003) * 1009 + ord(substr(TEXT, i + 1, 1))) % 1000003)
        * 1009 + ord(substr(TEXT, i + 2, 1))) % 1000003) % {BUCKETS})"""
    both = "list_concat(" + grams.replace("FIELD", "1").replace("TEXT", "('^' || host || '$')") + ", " + \
        grams.replace("FIELD", "2").replace("TEXT", "path") + ")"
    return f"""
WITH RECURSIVE labelled(url, y) AS (VALUES {labelled}),
rules(k, rule, host, path, verdict) AS (VALUES {rules}),
urls AS (SELECT page_id, url, CAST(NULL AS INTEGER) AS y FROM pages UNION ALL SELECT NULL, url, y FROM labelled),
cut AS (
  SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM urls
), named AS (
  SELECT page_id, url, y,
    translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), featured AS (SELECT *, {both} AS grams FROM named),
train AS (SELECT row_number() OVER (ORDER BY url) AS i, y, grams FROM featured WHERE y IS NOT NULL),
x AS (
  SELECT i, b, count(*) / sqrt(any_value(n)) AS x
  FROM (SELECT i, len(grams) AS n, unnest(grams) AS b FROM train) GROUP BY i, b
), products AS (
  SELECT p.i, q.i AS j, sum(p.x * q.x) AS k FROM x p JOIN x q ON p.b = q.b GROUP BY p.i, q.i
), matrix_rows AS (
  SELECT a.i, list(1 + coalesce(k, 0) ORDER BY c.i) AS ks
  FROM train a CROSS JOIN train c LEFT JOIN products p ON p.i = a.i AND p.j = c.i GROUP BY a.i
), matrix AS (SELECT list(ks ORDER BY m.i) AS k, list(CAST(y AS DOUBLE) ORDER BY m.i) AS ys
  FROM matrix_rows m JOIN train t ON m.i = t.i),
descent(t, a) AS (
  SELECT 0, list_transform(ys, lambda y: CAST(0 AS DOUBLE)) FROM matrix
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(ys) + 1), lambda i:
    {1 - STEP * DECAY!r} * a[i] + {STEP!r} * (ys[i] - 1 / (1 + exp(-list_dot_product(k[i], a)))))
  FROM descent, matrix WHERE t < {STEPS}
), solved AS (SELECT a FROM descent WHERE t = {STEPS}),
weights AS (SELECT b, sum(x * a[i]) AS w FROM x, solved GROUP BY b),
page_rows AS (SELECT row_number() OVER () AS r, page_id, host, path, grams FROM featured WHERE y IS NULL),
margins AS (
  SELECT r, sum(coalesce(w, 0)) / sqrt(any_value(n)) AS m
  FROM (SELECT r, len(grams) AS n, unnest(grams) AS b FROM page_rows) LEFT JOIN weights USING (b) GROUP BY r
), ruled AS (
  SELECT r, rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC, k) AS best
  FROM page_rows p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path)
)
SELECT p.page_id, p.host, p.path, u.rule,
  coalesce(u.verdict, CASE WHEN coalesce(m, 0) + (SELECT list_sum(a) FROM solved) >= 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM page_rows p LEFT JOIN margins USING (r) LEFT JOIN ruled u ON u.r = p.r AND u.best = 1
"""


ORACLE["op1_url_filter"] = _op1()

ORACLE["op4_decontamination"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2),
    lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s FROM items WHERE len(w) > 0
), sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
lengths AS (SELECT DISTINCT k FROM item_shingles),
doc_shingles AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM docs, lengths WHERE len(w) >= k
)
SELECT doc_id, item_id, n_shingles, count(*) AS shared, count(*) / n_shingles AS containment
FROM doc_shingles JOIN item_shingles USING (k, s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) / n_shingles >= 0.75
"""

ORACLE["op7_jaccard_join"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2),
    lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s FROM docs WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id GROUP BY d.doc_id
"""

# crc32 bit by bit: a byte is mixed in (an element of 0 and up), then eight shifts (-1 each)
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(TEXT) + 1), lambda i:
    CASE WHEN ord(substr(TEXT, i, 1)) < 128 THEN list_prepend(CAST(ord(substr(TEXT, i, 1)) AS BIGINT), SHIFTS)
      ELSE list_concat(list_prepend(CAST(192 + (ord(substr(TEXT, i, 1)) >> 6) AS BIGINT), SHIFTS),
                       list_prepend(CAST(128 + (ord(substr(TEXT, i, 1)) & 63) AS BIGINT), SHIFTS)) END))),
    lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END),
    CAST(4294967295 AS BIGINT))""".replace("SHIFTS", "list_transform(range(8), lambda s: CAST(-1 AS BIGINT))")

ORACLE["op11_spelling_forms"] = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (SELECT run, k, CRC AS h FROM (SELECT *, concat(doc_id, ':', run) AS named FROM counted)),
cut AS (
  SELECT k, CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word FROM hashed
), words AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), shorter AS (
  SELECT DISTINCT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
         CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk(word, root, form) AS (
  SELECT word, word, form FROM forms
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON f.word = w.form
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, w.root
FROM forms f JOIN walk w ON w.word = f.word AND w.form IS NULL
""".replace("CRC", _CRC32.replace("TEXT", "named"))

ORACLE["op12_lexical_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), sizes AS MATERIALIZED (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
asked AS (SELECT item_id, term, count(*) AS repeats FROM i GROUP BY item_id, term),
held AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d),
postings AS MATERIALIZED (
  SELECT r, doc_id, n, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, n, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, sizes GROUP BY term, docs
), scored AS (
  SELECT a.item_id, p.r, p.doc_id,
         CAST(sum(a.repeats * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * s.docs) // s.total)))) AS BIGINT) AS score
  FROM asked a JOIN postings p USING (term) JOIN weights w USING (term) CROSS JOIN sizes s GROUP BY a.item_id, p.r, p.doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
