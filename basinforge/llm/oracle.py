"""SQL (DuckDB) that gives the same rows as a query, from the definition and not by its method."""

#: A line goes if it lies in a run of 50 words or more that stands earlier.
LINE_WINNOWING = r"""
WITH d AS (SELECT DISTINCT doc_id, text, md5(text) AS th FROM documents),
split AS (SELECT doc_id, th, string_split(text, chr(10)) AS lines FROM d WHERE text IS NOT NULL),
line AS (
  SELECT doc_id, th, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
worded AS (
  SELECT * FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM line) WHERE words > 0),
placed AS (
  SELECT *, sum(words) OVER w - words AS before, row_number() OVER w AS nth FROM worded
  WINDOW w AS (PARTITION BY doc_id, th ORDER BY pos)),
windows AS (
  SELECT * FROM (
    SELECT doc_id, th, pos, nth, before, max(pos) OVER w AS last, max(nth) OVER w AS last_nth,
           max(before + words) OVER w AS stop, list(md5(line)) OVER w AS content
    FROM placed
    WINDOW w AS (PARTITION BY doc_id, th ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING))
  WHERE stop >= before + 50),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS o_id, first_value(th) OVER w AS o_th, first_value(last) OVER w AS o_last,
         row_number() OVER w AS rank
  FROM windows WINDOW w AS (PARTITION BY content ORDER BY doc_id NULLS FIRST, th, pos)),
later AS (
  SELECT * FROM ranked
  WHERE rank > 1 AND (o_id IS DISTINCT FROM doc_id OR o_th <> th OR pos > o_last)),
gone AS (
  SELECT DISTINCT l.doc_id, l.th, p.pos, p.words, 1 AS worded
  FROM later l JOIN placed p ON l.doc_id IS NOT DISTINCT FROM p.doc_id AND l.th = p.th AND p.pos BETWEEN l.pos AND l.last),
flagged AS (
  SELECT x.doc_id, x.th, x.pos, x.line, p.nth, p.words, g.pos IS NOT NULL AS gone
  FROM line x LEFT JOIN placed p ON x.doc_id IS NOT DISTINCT FROM p.doc_id AND x.th = p.th AND x.pos = p.pos
  LEFT JOIN gone g ON x.doc_id IS NOT DISTINCT FROM g.doc_id AND x.th = g.th AND x.pos = g.pos),
near AS (
  SELECT *, last_value(CASE WHEN nth IS NOT NULL THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id, th ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS left_gone,
         first_value(CASE WHEN nth IS NOT NULL THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id, th ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS right_gone
  FROM flagged),
kept AS (
  SELECT doc_id, th,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (gone OR (nth IS NULL AND coalesce(left_gone, false) AND coalesce(right_gone, false)))), '') AS text,
         count(*) FILTER (WHERE gone) AS n, coalesce(sum(words) FILTER (WHERE gone), 0) AS w
  FROM near GROUP BY doc_id, th)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_deleted_lines, CAST(coalesce(k.w, 0) AS BIGINT) AS n_deleted_words,
       sha256(k.text) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND md5(d.text) = k.th
"""

#: The capture log made of pages, joined by ASOF JOIN.
REVISIT_RESOLUTION = r"""
WITH p AS (
  SELECT page_id, url, sha256(html) AS sha, strlen(html) AS size,
         1700000000 + (page_id * 7919) % 100003 * 60 AS start,
         '"' || substr(md5(html), 1, 16) || '"' AS tag,
         CAST(1700000000 + (page_id * 7919) % 100003 * 60 - page_id % 977 * 3600 AS VARCHAR) AS modified
  FROM pages),
r AS (
  SELECT page_id * 3 AS record_id, url, start AS captured, 'response' AS kind, tag, modified, sha, size, start, page_id FROM p
  UNION ALL
  SELECT page_id * 3 + 1, regexp_replace(url, '^https?://', 'http://') || '#again', start + 3600, 'by_tag',
         CASE WHEN page_id % 5 = 0 THEN '"stale"' ELSE tag END, NULL, NULL, NULL, start, page_id FROM p
  UNION ALL
  SELECT page_id * 3 + 2, regexp_replace(url, '^https?://', 'HTTPS://www.'), start + 86400 * (page_id % 40), 'by_date',
         NULL, modified, NULL, NULL, start, page_id FROM p),
s AS (
  SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM r),
t AS (
  SELECT *, regexp_extract(bare, '^[^/?]*', 0) AS authority, regexp_extract(substr(bare, length(regexp_extract(bare, '^[^/?]*', 0)) + 1), '^[^?]*', 0) AS path,
         regexp_replace(regexp_extract(bare, '\?.*$', 0), '^\?', '') AS query FROM s),
u AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(authority, '^[^@]*@', '')), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
         list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|gclid|fbclid|msclkid|mc_eid|sessionid|phpsessid|jsessionid)(=|$)'))) AS params FROM t),
c AS (
  SELECT *, host || regexp_replace(path, '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM u),
full_response AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical, captured ORDER BY record_id DESC) AS k FROM c WHERE kind = 'response') WHERE k = 1),
j AS (
  SELECT v.*, f.record_id AS f_id, f.tag AS f_tag, f.modified AS f_modified, f.sha AS f_sha, f.size AS f_size, f.start AS f_start, f.page_id AS f_page
  FROM (SELECT * FROM c WHERE kind <> 'response') v ASOF LEFT JOIN full_response f ON v.canonical = f.canonical AND v.captured > f.captured),
k AS (
  SELECT *, CASE WHEN f_id IS NULL THEN 'no response'
                 WHEN kind = 'by_tag' THEN CASE WHEN tag = f_tag THEN 'resolved' ELSE 'changed' END
                 ELSE CASE WHEN modified = f_modified THEN 'resolved' ELSE 'changed' END END AS resolution FROM j)
SELECT record_id, canonical AS canonical_url, captured, resolution,
       CASE WHEN resolution = 'resolved' THEN f_id END AS response_id,
       CASE WHEN resolution = 'resolved' THEN f_sha END AS payload_sha256,
       CASE WHEN resolution = 'resolved' THEN f_size END AS payload_bytes,
       CASE WHEN resolution = 'resolved' THEN
         CASE WHEN kind = 'by_tag'
              THEN 'Content-Type=text/html;Last-Modified=' || f_modified || ';Server=s' || (f_page % 9) || ';etag=W/' || tag || ';Date=' || (start + 3600)
              ELSE 'Content-Type=text/html;ETag=' || f_tag || ';Date=' || f_start || ';Server=s' || (f_page % 9) || ';last-modified=' || modified || ';Expires=' || (start + 90000) END END AS headers
FROM k
"""

#: The manifest's trees level by level; crc32 bit by bit.
MERKLE_TRAVERSAL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, text, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: [ascii(c)::UBIGINT + 1000000, 0, 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, b: CASE WHEN b >= 1000000 THEN xor(a, b - 1000000) ELSE xor(a >> 1, 3988292384::UBIGINT * (a & 1)) END) AS crc,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents),
h AS (
  SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295::UBIGINT) % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM d),
o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
t AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM o)),
q AS (SELECT o.*, tree FROM o JOIN t ON o.lang IS NOT DISTINCT FROM t.lang),
low AS (
  SELECT tree, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM q
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 7) // 8) FROM low WHERE n > 1 GROUP BY tree, level, pos // 8),
sub AS (SELECT tree, node AS subroot FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, tree AS pos, subroot AS node, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 7) // 8) FROM high WHERE n > 1 GROUP BY level, pos // 8),
run AS (  -- each level's runs: low ones of a tree, then those over the subroots
  SELECT tree, level, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM low WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT NULL, level, pos // 8, list(node ORDER BY pos) FROM high WHERE n > 1 GROUP BY ALL),
step AS (
  SELECT r, 0 AS part, level, (pos // CAST(pow(8, level) AS BIGINT)) % 8 AS k, nodes FROM q JOIN run ON q.tree = run.tree AND run.run = pos // CAST(pow(8, level + 1) AS BIGINT)
  UNION ALL
  SELECT r, 1, level, (q.tree // CAST(pow(8, level) AS BIGINT)) % 8, nodes FROM q JOIN run ON run.tree IS NULL AND run.run = q.tree // CAST(pow(8, level + 1) AS BIGINT)),
path AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY part, level) AS s FROM step),
proof AS (SELECT r, sha256(string_agg(array_to_string(list_concat(nodes[:k], nodes[k + 2:]), ''), '' ORDER BY s)) AS proof_sha256, max(s) AS steps FROM path GROUP BY r),
folded AS (
  SELECT r, 0 AS s, coalesce(changed, leaf) AS node FROM q
  UNION ALL
  SELECT f.r, p.s, sha256(array_to_string(nodes[:k], '') || node || array_to_string(nodes[k + 2:], '')) FROM folded f JOIN path p ON p.r = f.r AND p.s = f.s + 1)
SELECT doc_id, leaf, subroot, high.node AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = high.node AS verified
FROM q JOIN sub USING (tree) JOIN high ON high.n = 1 LEFT JOIN proof USING (r) JOIN folded f ON f.r = q.r AND f.s = coalesce(steps, 0)
"""
