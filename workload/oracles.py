"""The same results as SQL over the source tables, without any page parsing of ours."""

from __future__ import annotations

from workload.templates import (
    BASE,
    BRANDS_PER_PAGE,
    LETTER_BRANDS_PER_PAGE,
    PAGER_LINKS,
    PRODUCTS_PER_PAGE,
    URLS_PER_SITEMAP,
)

_NOW = "2024-06-01 12:00:00"

_PART = f"""
parts AS (
  SELECT *, p_partkey % 4 AS kind,
         p_name || ' & Co ' || p_partkey AS full_name,
         '{BASE}/products/p-' || p_partkey AS url,
         '/brand/' || lower(replace(p_brand, '#', '-')) AS brand_href,
         replace(p_brand, '#', ' ') AS brand_words,
         p_partkey // {URLS_PER_SITEMAP} AS chunk
  FROM part)"""

_PAIRS = """
pairs AS (
  SELECT p_partkey, kind, s_suppkey, s_name
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  JOIN supplier ON l_suppkey = s_suppkey JOIN parts ON l_partkey = p_partkey)"""

_ROSTER = f"""
entries AS (
  SELECT p_partkey, 0 AS block, s_suppkey AS place,
         CASE WHEN s_suppkey % 5 = 0 THEN 'Alt ' || s_name ELSE s_name END AS name,
         '{BASE}/ingredients/s-' || s_suppkey AS url
  FROM pairs
  UNION ALL
  SELECT p_partkey, 1, s_suppkey, lower(s_name), '' FROM pairs
  WHERE kind IN (0, 1) AND s_suppkey % 10 = 0
  UNION ALL
  SELECT p_partkey, 2, 0, 'Base Oil', '' FROM parts WHERE kind IN (0, 1)),
roster AS (
  SELECT p_partkey, name, url,
         row_number() OVER (PARTITION BY p_partkey ORDER BY block, place) AS position
  FROM entries)"""

_STORED = f"""
stored AS (
  SELECT parts.url, full_name AS name,
         CASE WHEN kind = 2 THEN brand_words ELSE p_brand END AS brand,
         p_type AS description,
         CASE WHEN kind < 2 THEN p_retailprice END AS rating_value,
         CASE kind WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS categories,
         CAST(coalesce(n, 0) AS INTEGER) AS n, first_ingredient, last_ingredient, chunk
  FROM parts LEFT JOIN (
    SELECT p_partkey AS k, count(*) AS n, arg_min(name, position) AS first_ingredient,
           arg_max(name, position) AS last_ingredient
    FROM roster GROUP BY p_partkey) ON k = p_partkey)"""

_BRANDS = """
brands AS (
  SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS n,
         '/brand/' || lower(replace(p_brand, '#', '-')) AS href
  FROM (SELECT DISTINCT p_brand FROM part))"""

_OLD_BRANDS = """
old AS (
  SELECT c_custkey + 1 AS id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS name,
         '/b/' || c_custkey AS url, '2024-01-01 00:00:00' AS discovered_at,
         CASE WHEN c_custkey % 5 = 0 THEN '2024-02-01 00:00:00' END AS processed_at
  FROM customer WHERE c_custkey % 3 <> 0)"""

_OLD_PRODUCTS = """
old AS (
  SELECT c_custkey + 1 AS id, CASE WHEN c_custkey % 2 = 0 THEN 1000 + c_custkey % 25 END AS brand_id,
         '/p/' || c_custkey AS url,
         CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_name END AS name,
         CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS brand_name,
         'old' AS description, 'old' AS image_url, c_acctbal AS rating_value,
         c_custkey AS rating_count, c_mktsegment AS categories, '{"old":1}' AS json_ld,
         '2024-01-01 00:00:00' AS discovered_at,
         CASE WHEN c_custkey % 5 = 0 THEN '2024-02-01 00:00:00' END AS scraped_at
  FROM customer WHERE c_custkey % 4 <> 0)"""

_ORDER_TEXT = """CASE o_orderstatus WHEN 'F' THEN '' WHEN 'P' THEN NULL
  ELSE o_orderpriority || ' ' || o_orderkey END"""

_HREFS = """regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', {group}, 's')"""

_FETCH_LOG = """
log AS (
  SELECT 'h' || user_id || '/' || event_id % 50 AS url, 'h' || user_id AS host,
         CAST(event_id % 5 + 1 AS INTEGER) AS attempt,
         CAST(CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404
              WHEN 'purchase' THEN 204 WHEN 'click' THEN 200 END AS INTEGER) AS status,
         ts, event_id
  FROM events)"""

ORACLES = {
    "token_kinds": """
SELECT page_id,
       len(regexp_extract_all(html,
         '<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>|[^<]+', 0, 's')) AS tokens,
       length(html) AS chars,
       len(regexp_extract_all(html, '<a[ >]')) AS anchors,
       len(regexp_extract_all(html, '<p[ >]')) AS paragraphs
FROM pages""",
    "collect_links": f"""
WITH raw AS (
  SELECT page_id, unnest({_HREFS.format(group=1)}) AS h,
         unnest(range(len({_HREFS.format(group=1)}))) AS i FROM pages),
firsts AS (
  SELECT page_id, split_part(replace(h, '&amp;', '&'), '#', 1) AS href, min(i) AS i
  FROM raw WHERE h LIKE '/%' GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, href FROM firsts""",
    "named_links": f"""
WITH raw AS (
  SELECT page_id, unnest({_HREFS.format(group=1)}) AS h, unnest({_HREFS.format(group=2)}) AS t,
         unnest(range(len({_HREFS.format(group=1)}))) AS i FROM pages),
firsts AS (
  SELECT page_id, split_part(replace(h, '&amp;', '&'), '#', 1) AS href, min(i) AS i,
         arg_min(trim(replace(t, '&amp;', '&')), i) AS text
  FROM raw WHERE h LIKE '/%' GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, href, text FROM firsts""",
    "h1_title": """
SELECT page_id, nullif(trim(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&amp;', '&')), '') AS title
FROM pages""",
    "meta_map": f"""
WITH {_PART}
SELECT p_partkey AS page_id, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 2 END AS n,
       CASE WHEN kind = 2 THEN full_name END AS og_title,
       CASE WHEN kind = 2 THEN p_type END AS og_description,
       CASE WHEN kind = 2 THEN 'https://cdn.example/' || p_partkey END AS og_image,
       CASE WHEN kind IN (1, 3) THEN p_type END AS description,
       CASE WHEN kind = 3 THEN 'https://cdn.example/' || p_partkey END AS twitter_image
FROM parts""",
    "jsonld_blocks": f"""
WITH {_PART}
SELECT p_partkey AS page_id, kind AS pos,
       CASE kind WHEN 0 THEN 'Product' ELSE 'ProductGroup' END AS type, full_name AS name
FROM parts WHERE kind < 2
UNION ALL
SELECT p_partkey, 0, 'BreadcrumbList', NULL FROM parts WHERE kind = 1""",
    "page_titles": """
SELECT page_id, url,
       nullif(trim(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&amp;', '&')), '') AS name,
       CAST(NULL AS VARCHAR) AS brand, 0 AS ingredients, CAST(NULL AS VARCHAR) AS extract_error
FROM pages""",
    "page_decode": """
SELECT page_id, CASE WHEN page_id % 10 <> 9 THEN md5(html) END AS digest FROM pages""",
    "page_lookup": """
SELECT url, CASE WHEN page_id % 4 = 0 THEN page_id + 10000000 ELSE page_id END AS page_id,
       true AS found, length(html) AS chars FROM pages
UNION ALL SELECT url || '#missing', NULL, false, NULL FROM pages""",
    "url_functions": f"""
WITH p AS (SELECT page_id, url, regexp_replace(url, '^https?://[^/]*', '') AS path FROM pages)
SELECT page_id, url AS absolute,
       '{BASE}/' || ltrim(path, '/') AS joined,
       regexp_extract(url, '^[^?#]*') || '?page=3' AS paged,
       split_part(url, '#', 1) AS bare,
       path LIKE '/en/%' OR path LIKE '/fr/%' AS en_or_fr,
       lower(url) AS key,
       '{BASE}/brands?letter=0-9' || CASE WHEN page_id % 3 > 1 THEN '&page=' || page_id % 3 ELSE '' END AS letter
FROM p""",
    "humanize_slug": """
WITH s AS (
  SELECT p_partkey, regexp_replace(lower(p_brand || '-' || p_name || '-' || p_type), '[# -]', ' ', 'g') AS words
  FROM part),
t AS (
  SELECT p_partkey, array_to_string(list_transform(string_split(words, ' '),
           lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM s)
SELECT p_partkey, title AS link, title AS brand, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE title END AS mention
FROM t""",
    "product_core": f"""
WITH {_PART}
SELECT p_partkey AS page_id, url, full_name AS name,
       CASE WHEN kind = 2 THEN brand_words ELSE p_brand END AS brand, p_type AS description,
       CASE WHEN kind <> 1 THEN 'https://cdn.example/' || p_partkey END AS image_url,
       kind < 2 AS has_node, CAST(NULL AS VARCHAR) AS extract_error
FROM parts""",
    "product_rating": f"""
WITH {_PART}
SELECT p_partkey AS page_id, CASE WHEN kind < 2 THEN p_retailprice END AS rating_value,
       CASE WHEN kind < 2 THEN p_size END AS rating_count FROM parts""",
    "product_categories": f"""
WITH {_PART}
SELECT p_partkey AS page_id, CASE kind WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n,
       CASE kind WHEN 0 THEN p_type || '|Size ' || p_size WHEN 1 THEN p_type ELSE '' END AS categories
FROM parts""",
    "ingredient_mentions": f"""
WITH {_PART}, {_PAIRS}
SELECT p_partkey AS page_id, '{BASE}/ingredients/s-' || s_suppkey AS key, 'text' AS kind,
       CASE WHEN s_suppkey % 3 = 0 THEN 'S ' || s_suppkey ELSE s_name END AS name,
       '{BASE}/ingredients/s-' || s_suppkey AS url FROM pairs
UNION ALL
SELECT p_partkey, '{BASE}/ingredients/s-' || s_suppkey, 'label', s_name,
       '{BASE}/ingredients/s-' || s_suppkey FROM pairs WHERE s_suppkey % 3 = 0
UNION ALL
SELECT p_partkey, '{BASE}/ingredients/s-' || s_suppkey, 'text', 'Alt ' || s_name,
       '{BASE}/ingredients/S-' || s_suppkey FROM pairs WHERE s_suppkey % 5 = 0""",
    "ingredients_resolved": f"""
WITH {_PART}, {_PAIRS}, {_ROSTER}
SELECT p_partkey AS page_id, position, name, url FROM roster""",
    "brand_mentions": f"""
WITH {_PART}
SELECT p_partkey AS page_id, '{BASE}' || brand_href AS url, CASE WHEN kind = 3 THEN p_brand END AS text
FROM parts WHERE kind > 1""",
    "sitemap_children": f"""
WITH {_PART}, chunks AS (SELECT DISTINCT chunk FROM parts)
SELECT row_number() OVER (ORDER BY chunk) AS pos, '{BASE}/sitemap-Products-' || chunk || '.xml' AS loc FROM chunks
UNION ALL SELECT count(*) + 1, '{BASE}/sitemap-products-gone.xml' FROM chunks""",
    "sitemap_products": f"""
WITH {_PART}
SELECT row_number() OVER (PARTITION BY chunk ORDER BY p_partkey) - 1 AS pos, url
FROM parts WHERE chunk % 4 <> 1""",
    "letter_seeds": f"""
WITH {_BRANDS}, tokens AS (
  SELECT unnest(range(1, 29)) AS token_no,
         unnest(list_concat(string_split('abcdefghijklmnopqrstuvwxyz', ''), ['0-9', 'other'])) AS token)
SELECT token_no, token,
       token = 'z' OR token IN (SELECT substr('abcde', CAST(n % 5 + 1 AS INTEGER), 1) FROM brands) AS found
FROM tokens""",
    "brand_directory": f"""
WITH {_BRANDS}
SELECT n // {BRANDS_PER_PAGE} * {BRANDS_PER_PAGE} AS "offset", n % {BRANDS_PER_PAGE} AS pos,
       CASE WHEN n % 3 = 0 THEN p_brand ELSE replace(p_brand, '#', ' ') END AS name, '{BASE}' || href AS url
FROM brands""",
    "brand_letters": f"""
WITH {_BRANDS}
SELECT n % 5 + 1 AS token_no, n // 5 // {LETTER_BRANDS_PER_PAGE} + 1 AS page,
       n // 5 % {LETTER_BRANDS_PER_PAGE} AS pos, '{BASE}' || href AS url
FROM brands""",
    "brand_products": f"""
WITH {_PART}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place FROM parts)
SELECT '{BASE}' || brand_href AS brand_id,
       (place // {PRODUCTS_PER_PAGE} + {PAGER_LINKS} - 1) // {PAGER_LINKS} AS level,
       place % {PRODUCTS_PER_PAGE} AS pos, url,
       CASE WHEN p_partkey % 7 = 0 THEN 'P ' || p_partkey ELSE full_name END AS name
FROM placed""",
    "discover_auto": f"""
WITH {_PART}
SELECT url, CASE WHEN chunk % 4 <> 1 THEN 'sitemap' ELSE 'brands' END AS source FROM parts""",
    "merge_brands": f"""
WITH {_OLD_BRANDS}, incoming AS (
  SELECT o_orderkey AS ord, '/b/' || o_custkey AS url, coalesce({_ORDER_TEXT}, '') AS name FROM orders),
batch AS (
  SELECT url, min(ord) AS ord, arg_min(name, ord) AS first_name,
         arg_max(name, ord) FILTER (name <> '') AS new_name
  FROM incoming GROUP BY url)
SELECT id, coalesce(new_name, name) AS name, url, discovered_at, processed_at,
       CASE WHEN new_name <> name THEN 'update' ELSE 'keep' END AS action
FROM old LEFT JOIN batch USING (url)
UNION ALL
SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY ord), coalesce(new_name, first_name), url,
       '{_NOW}', NULL, 'insert'
FROM batch ANTI JOIN old USING (url)""",
    "merge_inserted": f"""
WITH {_OLD_BRANDS}
SELECT count(DISTINCT '/b/' || o_custkey) AS inserted FROM orders
WHERE '/b/' || o_custkey NOT IN (SELECT url FROM old)""",
    "merge_queued": f"""
WITH {_OLD_PRODUCTS}, incoming AS (
  SELECT o_orderkey AS ord, o_orderkey % 25 AS brand_id, '/p/' || o_custkey AS url, {_ORDER_TEXT} AS name,
         CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END AS brand_name
  FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 25),
batch AS (
  SELECT url, min(ord) AS ord,
         (list(name ORDER BY ord))[1] AS first_name,
         arg_min(name, ord) FILTER (name <> '') AS new_name,
         arg_max(brand_id, ord) AS new_brand_id, arg_min(brand_name, ord) AS first_brand_name,
         arg_max(brand_name, ord) FILTER (brand_name <> '') AS new_brand_name
  FROM incoming GROUP BY url)
SELECT id, coalesce(new_brand_id, brand_id) AS brand_id, url,
       coalesce(nullif(name, ''), new_name, name) AS name,
       coalesce(new_brand_name, brand_name) AS brand_name, description, image_url, rating_value,
       rating_count, discovered_at, scraped_at,
       CASE WHEN new_brand_id IS NULL THEN 'keep' ELSE 'update' END AS action
FROM old LEFT JOIN batch USING (url)
UNION ALL
SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY ord), new_brand_id, url,
       coalesce(new_name, first_name), coalesce(new_brand_name, first_brand_name), NULL, NULL, NULL, NULL,
       '{_NOW}', NULL, 'insert'
FROM batch ANTI JOIN old USING (url)""",
    "merge_products": f"""
WITH {_OLD_PRODUCTS}, incoming AS (
  SELECT o_orderkey AS ord, '/p/' || o_custkey AS url, {_ORDER_TEXT} AS name,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS brand, o_orderpriority, o_totalprice
  FROM orders),
batch AS (
  SELECT url, min(ord) AS first_ord, max(ord) AS ord, arg_max(name, ord) FILTER (name IS NOT NULL) AS new_name,
         arg_max(brand, ord) FILTER (brand IS NOT NULL) AS new_brand,
         arg_max(o_orderpriority, ord) AS priority, arg_max(o_totalprice, ord) AS price
  FROM incoming GROUP BY url),
batch2 AS (
  SELECT *, CASE WHEN ord % 2 = 0 THEN priority END AS new_description,
         CASE WHEN ord % 5 <> 0 THEN ord END AS new_count FROM batch)
SELECT id, brand_id, url, coalesce(new_name, name) AS name, coalesce(new_brand, brand_name) AS brand_name,
       CASE WHEN ord IS NULL THEN description ELSE new_description END AS description,
       CASE WHEN ord IS NULL THEN image_url END AS image_url,
       CASE WHEN ord IS NULL THEN rating_value ELSE price END AS rating_value,
       CASE WHEN ord IS NULL THEN rating_count ELSE new_count END AS rating_count,
       CASE WHEN ord IS NULL THEN categories ELSE priority END AS categories,
       CASE WHEN ord IS NULL THEN json_ld END AS json_ld, discovered_at,
       CASE WHEN ord IS NULL THEN scraped_at ELSE '{_NOW}' END AS scraped_at,
       CASE WHEN ord IS NULL THEN 'keep' ELSE 'update' END AS action
FROM old LEFT JOIN batch2 USING (url)
UNION ALL
SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY first_ord), NULL, url, new_name, new_brand,
       new_description, NULL, price, new_count, priority, NULL, '{_NOW}', '{_NOW}', 'insert'
FROM batch2 ANTI JOIN old USING (url)""",
    "replace_ingredients": """
SELECT l_orderkey AS product_id, l_partkey * 10 + l_linenumber AS position,
       '/i/' || l_suppkey AS ingredient_url, 'I ' || l_partkey AS ingredient_name
FROM lineitem ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') USING (l_orderkey)
UNION ALL
SELECT o_orderkey, unnest(range(1, len(string_split(o_orderpriority, '-')) + 1)), '',
       unnest(string_split(o_orderpriority, '-'))
FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0""",
    "mark_processed": f"""
WITH {_OLD_BRANDS}
SELECT id, name, url, discovered_at,
       CASE WHEN id IN (SELECT o_custkey + 1 FROM orders WHERE o_orderstatus = 'F') THEN '{_NOW}'
            ELSE processed_at END AS processed_at
FROM old""",
    "mark_scraped": f"""
WITH {_OLD_PRODUCTS}
SELECT id, url,
       CASE WHEN id IN (SELECT o_custkey + 1 FROM orders WHERE o_orderstatus = 'P') THEN '{_NOW}'
            ELSE scraped_at END AS scraped_at
FROM old""",
    "pending_brands": f"""
WITH {_OLD_BRANDS} SELECT id, name, url FROM old WHERE processed_at IS NULL ORDER BY id""",
    "product_queue": """
SELECT o_orderkey AS id, '/p/' || o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS discovered_at
FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey""",
    "take_success": """
SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderstatus <> 'F'
ORDER BY o_orderdate, o_orderkey LIMIT 100""",
    "skip_done": """
SELECT DISTINCT '/p/' || l_orderkey AS url FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O')""",
    "read_products": """
SELECT o_orderkey AS id, o_orderpriority AS name, o_totalprice AS rating_value, 0 AS categories,
       coalesce(n, 0) AS n, coalesce(ingredients, '') AS ingredients
FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n,
         string_agg('I ' || l_partkey, '|' ORDER BY l_partkey * 10 + l_linenumber) AS ingredients
  FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
WHERE o_orderstatus <> 'O'""",
    "storage_json": """
SELECT p_partkey,
       CASE WHEN p_size % 5 = 0 THEN '[]'
            ELSE '["' || p_type || '", "Gr\\u00f6\\u00dfe \\"\\ud83d\\ude00\\" ' || p_size || '"]' END AS categories,
       CASE WHEN p_size % 2 <> 0 THEN '{"p_name":"' || p_name || '"}' END AS json_ld,
       CASE WHEN p_size % 5 = 0 THEN 0 ELSE 2 END AS n,
       CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type || '|Größe "😀" ' || p_size END AS read_back
FROM part""",
    "brand_catalogue": f"""
WITH {_PART}, {_PAIRS}, {_ROSTER}, {_STORED}
SELECT * EXCLUDE (chunk), true AS queued FROM stored""",
    "sitemap_catalogue": f"""
WITH {_PART}, {_PAIRS}, {_ROSTER}, {_STORED}
SELECT * EXCLUDE (chunk) FROM stored WHERE chunk % 4 <> 1""",
    "stream_ingest": f"""
WITH {_PART}, {_PAIRS}, {_ROSTER}, {_STORED}
SELECT * EXCLUDE (chunk) FROM stored""",
    "fetch_triage": f"""
WITH {_FETCH_LOG}, last AS (
  SELECT url, count(*) AS requests, max((attempt, ts)) AS m, arg_max(attempt, (attempt, ts)) AS attempt
  FROM log GROUP BY url),
final AS (
  SELECT last.url, requests, last.attempt, status
  FROM last JOIN log ON log.url = last.url AND (log.attempt, log.ts) = m)
SELECT url, requests, attempt, status,
       CASE WHEN (status IS NULL OR status = 503) AND attempt <= 3 THEN 'retry'
            WHEN status = 200 THEN 'ok' ELSE 'gave_up' END AS state,
       CASE WHEN (status IS NULL OR status = 503) AND attempt <= 3
            THEN least(60.0, pow(2.0, attempt - 1)) END AS backoff_seconds
FROM final""",
    "politeness_gaps": f"""
WITH {_FETCH_LOG}, gaps AS (
  SELECT host, event_id,
         (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY host ORDER BY ts, event_id))) / 1000000.0 AS gap
  FROM log)
SELECT host, event_id, round(gap, 6) AS gap_seconds FROM gaps WHERE gap < 3600""",
}
