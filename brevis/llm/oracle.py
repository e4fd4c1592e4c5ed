"""SQL counterparts, for DuckDB, of the numbered queries that SQL can express."""

#: The rules as the query has them, longest first; a rule fits its host and all subdomains.
_URLS = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), named AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM named
"""

#: Bits are value > mean of the dimension; every query row against every row.
_NEIGHBOURS = """
WITH long AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings
), centre AS (SELECT i, avg(x) AS m FROM long GROUP BY i),
bits AS (SELECT vec_id, list(x > m ORDER BY i) AS b FROM long JOIN centre USING (i) GROUP BY vec_id),
apart AS (
  SELECT q.vec_id AS query_id, r.vec_id,
    list_sum(list_transform(range(1, 65), lambda k: (q.b[k] <> r.b[k])::INTEGER))::INTEGER AS distance
  FROM bits q JOIN bits r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM apart
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

#: Every order is run as sets of letters failed before; the counts per part and set of failures are few.
_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
tested AS (
  SELECT doc_id, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, t,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS capitals, coalesce(doc_id > first, false) AS copy
  FROM texts JOIN firsts USING (t)
), failed AS (
  SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * capitals > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN copy THEN 'E' ELSE '' END AS fails
  FROM tested
), marks AS (
  SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS filter,
    CASE WHEN step = 1 THEN '^$' ELSE '[' || substr(filter_order, 1, step - 1) || ']' END AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), told AS (
  SELECT *, contains(fails, filter) AS fails_it, step > 1 AND regexp_matches(fails, earlier) AS gone FROM counted, steps
), summed AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN NOT fails_it AND NOT gone THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails_it AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails_it AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails_it AND NOT gone THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails_it AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM summed
"""

#: crc32 by its table of 256 numbers, which follow from the polynomial; every word's bucket is found once.
_RESAMPLE = r"""
WITH places AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT unnest(range(256))::BIGINT AS i)
), texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT side, id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts
), hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
named AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h)::BIGINT, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, places
), held AS (SELECT side, id, bucket FROM words JOIN named USING (w)),
counted AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM held GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM counted)::DOUBLE + 10000)
    / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM counted)::DOUBLE + 10000))))::BIGINT AS gain FROM counted
), weighed AS (
  SELECT id AS doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM held JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM ranked) * 10 // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

_COPIES = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

STATEMENTS: dict[str, str] = {
    "op2_url_cascade": _URLS, "op4_multi_index": _NEIGHBOURS, "op11_filter_audit": _AUDIT, "op12_segment_resample": _RESAMPLE,
    "op13_chunk_recipes": _COPIES,
}
