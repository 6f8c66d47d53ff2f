"""SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {
    "op4_decontaminate": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
starts AS (
  SELECT item, w, least(len(w), 13) AS n, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM starts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
found AS (
  SELECT r, i, places.n, item FROM places JOIN windows ON places.n = windows.n AND array_to_string(w[i:i + places.n - 1], ' ') = p),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM found) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item)) AS l FROM found WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(l), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
""",
    "op5_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
cut AS (
  SELECT r, unnest(list_distinct(list_transform(
    generate_series(1, greatest(len(w) - 2, 1)), lambda i: md5(array_to_string(w[i:i + 2], ' '))))) AS t FROM d WHERE len(w) > 0),
sets AS (SELECT r, count(*) AS n, md5(string_agg(t, '' ORDER BY t)) AS h FROM cut GROUP BY r),
classes AS (
  SELECT h, any_value(n) AS n, min(r) AS r, min(doc_id) AS rep, count(*) AS size FROM sets JOIN d USING (r) GROUP BY h),
tokens AS (SELECT h, n, t FROM classes JOIN cut USING (r)),
shared AS (
  SELECT x.h AS a, y.h AS b, any_value(x.n) AS m, any_value(y.n) AS n, count(*) AS k
  FROM tokens x JOIN tokens y ON x.t = y.t AND x.h < y.h AND 100 * x.n >= 90 * y.n AND 100 * y.n >= 90 * x.n GROUP BY x.h, y.h),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 90 * (m + n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT h AS a, h AS b FROM classes UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
least AS (SELECT a AS h, min(rep) AS component_id FROM reach JOIN classes ON reach.b = classes.h GROUP BY a)
SELECT doc_id, CAST(coalesce(sets.n, 0) AS BIGINT) AS n_shingles,
  CASE WHEN sets.h IS NULL THEN doc_id ELSE component_id END AS component_id, CAST(coalesce(size, 1) AS BIGINT) AS class_size
FROM d LEFT JOIN sets USING (r) LEFT JOIN classes ON sets.h = classes.h LEFT JOIN least ON sets.h = least.h
""",
}
