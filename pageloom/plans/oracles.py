"""DuckDB SQL oracles for the registered queries.

Written independently of the Spark expressions: regular-expression routes
over the raw html, list functions over the source columns, ASOF joins and
window functions over the event table.
"""

from __future__ import annotations

from ..operators.windows import config_digest
from ..sources.pages import LISTING_SQL

ORACLES: dict = {}


def decode(x: str) -> str:
    return (f"replace(replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), "
            f"'&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")


HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def valid(c: str) -> str:
    """scheme://netloc test via strpos and substrings (not one regex)."""
    t = f"ltrim({c})"
    return (f"(coalesce(strpos({t}, ':') > 1 AND substr({t}, strpos({t}, ':'), 3) = '://' "
            f"AND regexp_full_match(substr({t}, 1, strpos({t}, ':') - 1), '[A-Za-z][A-Za-z0-9+.-]*') "
            f"AND length(regexp_extract(substr({t}, strpos({t}, ':') + 3), '^[^/?#]*')) > 0 "
            f"AND (contains(regexp_extract(substr({t}, strpos({t}, ':') + 3), '^[^/?#]*'), '[') = "
            f"contains(regexp_extract(substr({t}, strpos({t}, ':') + 3), '^[^/?#]*'), ']')), false))")


VARIANTS = """(SELECT page_id, unnest(generate_series(0, 8)) AS variant,
  unnest([url, '  ' || url, ns, '//' || ns, 'mailto:' || ns, regexp_replace(url, '://', ':///'),
          regexp_replace(url, '://', '://['), '1' || url, regexp_replace(url, '^https?', 'ftp')]) AS candidate
  FROM (SELECT *, regexp_replace(url, '^[A-Za-z]+://', '') AS ns FROM pages))"""

WORDS = "list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"
STRIP_TAGS = "regexp_replace(html, '<[^>]+>', '', 'g')"


def words(x: str) -> str:
    return WORDS.format(x=x)


def _tag_counts(src: str) -> str:
    return (f"SELECT page_id, lower(t) AS tag, count(*) AS n FROM (SELECT page_id, "
            f"unnest(regexp_extract_all(h, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS t FROM {src}) GROUP BY ALL")


def _drop_blocks(x: str, paired, void=()) -> str:
    for t in paired:
        x = f"regexp_replace({x}, '(?is)<{t}(\\s[^>]*)?>.*?</{t}>', '', 'g')"
    for t in void:
        x = f"regexp_replace({x}, '(?i)<{t}(\\s[^>]*)?/?>', '', 'g')"
    return x


_REMOVE_PAIRED = ["script", "style", "noscript", "title", "nav", "footer", "header", "aside", "form", "button",
                  "select", "textarea", "iframe", "object", "audio", "video", "canvas", "svg"]
_REMOVE_VOID = ["link", "meta", "input", "embed"]

ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"


def _article_text() -> str:
    inner = f"regexp_replace({ARTICLE}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({decode(inner)}, '\\s+', ' ', 'g'))"


FETCHES = "(SELECT page_id, url, html, contains(html, '</html>') AS success FROM pages)"


ORACLES.update({
    "a1_read_pages": """SELECT page_id, url, html IS NOT NULL AS success,
        CASE WHEN html IS NULL THEN 'No HTML content found' END AS error, length(html) AS html_length FROM pages""",
    "a2_lookup_urls": """WITH r AS (SELECT page_id AS batch_id, unnest([url, url || '/missing', url]) AS url,
                unnest(generate_series(0, 2)) AS batch_pos FROM pages),
        one AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url)
        SELECT r.batch_id, r.batch_pos, r.url, one.page_id, one.page_id IS NOT NULL AS found,
               CASE WHEN one.page_id IS NULL THEN 'No HTML content found' END AS error
        FROM r LEFT JOIN one ON r.url = one.url""",
    "a3_fail_rows": f"""SELECT page_id, url, success,
        CASE WHEN NOT success THEN 'Content extraction failed' END AS error FROM {FETCHES}""",
    "a4_validate_url": f"SELECT page_id, variant, candidate, {valid('candidate')} AS valid FROM {VARIANTS}",
    "a5_validate_requests": f"""SELECT page_id, kind, CASE
          WHEN kind = 3 THEN 'Request body is required'
          WHEN kind = 1 THEN 'URL is required'
          WHEN NOT {valid('u')} THEN 'Invalid URL format' END AS error
        FROM (SELECT page_id, unnest([0, 1, 2, 3]) AS kind,
                     unnest([url, NULL, regexp_replace(url, '^[A-Za-z]+://', ''), NULL]) AS u FROM pages)""",
    "a6_validate_batches": f"""WITH h AS (SELECT {HOST} AS host, page_id // 60 AS batch, list(url ORDER BY page_id) AS l FROM pages GROUP BY 1, 2),
        b AS (SELECT host, batch, CASE WHEN len(l) % 2 = 0
                 THEN l[1:len(l) - 1] || [regexp_replace(l[len(l)], '^[A-Za-z]+://', '')] ELSE l END AS urls FROM h)
        SELECT host, batch, len(urls) AS n_urls, CASE
          WHEN len(urls) = 0 THEN 'At least one URL is required'
          WHEN len(urls) > 5 THEN 'Maximum 5 URLs allowed per batch'
          WHEN len(list_filter(urls, lambda u: NOT {valid('u')})) > 0
            THEN 'Invalid URL format: ' || list_filter(urls, lambda u: NOT {valid('u')})[1] END AS error FROM b""",
    "a7_with_scheme": f"""SELECT page_id, variant, CASE WHEN starts_with(candidate, 'http://')
        OR starts_with(candidate, 'https://') THEN candidate ELSE 'https://' || candidate END AS url FROM {VARIANTS}""",
    "a8_parse_selector_list": """SELECT page_id, array_to_string(list_filter(list_transform(string_split(
        translate(regexp_replace(url, '^[A-Za-z]+://[^/]*', ''), '/?&=', ',,,,'), ','), lambda x: trim(x)),
        lambda x: x <> ''), '|') AS selectors FROM pages""",
    "a9_to_result_json": f"""SELECT url, json_object('success', true, 'url', url, 'title', '', 'content', c,
        'word_count', len({words('c')}), 'images', json('[]'),
        'links', json_object('internal', json('[]'), 'external', json('[]')),
        'metadata', json_object('content_length', length(c)), 'error', NULL)::VARCHAR AS json
        FROM (SELECT url, CASE WHEN length(s) > 120 THEN substr(s, 1, 120) ELSE s END AS c
              FROM (SELECT url, {STRIP_TAGS} AS s FROM pages))""",

    "b1_explode_nodes": _tag_counts("(SELECT page_id, html AS h FROM pages)"),
    "b2_drop_tags": _tag_counts(f"(SELECT page_id, {_drop_blocks('html', _REMOVE_PAIRED, _REMOVE_VOID)} AS h FROM pages)"),
    "b3_excluded_tags": _tag_counts(f"(SELECT page_id, {_drop_blocks('html', ['form', 'header', 'nav', 'footer'])} AS h FROM pages)"),
    "b4_drop_images": _tag_counts(f"(SELECT page_id, {_drop_blocks('html', [], ['img'])} AS h FROM {LISTING_SQL})"),
    "b5_unwrap_links": f"""SELECT page_id, len(l) AS n_links, array_to_string(l, '|') AS texts, 0::BIGINT AS n_elem
        FROM (SELECT page_id, list_transform(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1),
              lambda x: {decode('x')}) AS l FROM pages) WHERE len(l) > 0""",
    "b6_exclude": _tag_counts(
        "(SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<div class=\"ad\">.*?</div>', '', 'g'), "
        "'(?s)<nav>.*?</nav>', '', 'g') AS h FROM pages)"),
    "b7_css": f"""SELECT page_id, unnest(['article p', 'li > a[href]', '.ad', 'nav a', 'html[lang]', 'meta[charset]',
              'h1', '#nothing', 'div.ad, nav', 'body > article > h1', '[href]']) AS selector,
        unnest([len(regexp_extract_all({ARTICLE}, '<p[\\s>]')), len(regexp_extract_all(html, '<li><a href=')),
                len(regexp_extract_all(html, 'class="ad"')),
                len(regexp_extract_all(regexp_extract(html, '(?s)<nav>.*</nav>'), '<a[\\s>]')),
                len(regexp_extract_all(html, '<html lang=')), len(regexp_extract_all(html, '<meta charset')),
                len(regexp_extract_all(html, '<h1[\\s>]')), 0,
                len(regexp_extract_all(html, 'class="ad"')) + len(regexp_extract_all(html, '<nav[\\s>]')),
                len(regexp_extract_all(html, '<article><h1[\\s>]')),
                len(regexp_extract_all(html, 'href='))])::BIGINT AS n FROM pages""",
    "b9_select": f"""SELECT page_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS href
        FROM (SELECT page_id, list_transform(regexp_extract_all(html, '<li><a href="([^"]*)"', 1),
              lambda x: {decode('x')}) AS l FROM pages) WHERE len(l) > 0""",
    "b10_main_root": f"""SELECT page_id,
          CASE WHEN regexp_matches(html, '<main[\\s>]') THEN 'main' WHEN regexp_matches(html, '<article[\\s>]')
               THEN 'article' WHEN regexp_matches(html, '<body[\\s>]') THEN 'body' ELSE '[document]' END AS root_tag,
          CASE WHEN regexp_matches(html, '<main[\\s>]') THEN 0 WHEN regexp_matches(html, '<article[\\s>]') THEN 1
               WHEN regexp_matches(html, '<body[\\s>]') THEN 12 ELSE 13 END::BIGINT AS root_rank
        FROM (SELECT page_id, html FROM pages UNION ALL SELECT page_id, html FROM {LISTING_SQL})""",

    "c1_regex_text": """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '<script.*?</script>', '', 'gis'), '<style.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))
        AS text FROM pages""",
    "c2_strip_tags": f"SELECT page_id, {STRIP_TAGS} AS text FROM pages",
    "c3_basic_content": f"""SELECT url, true AS success, c AS content, len({words('c')}) AS word_count
        FROM (SELECT url, substr({STRIP_TAGS}, 1, 5000) AS c FROM pages)""",
    "c4_page_title": f"""SELECT page_id, substr(trim({decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}),
        1, 200) AS title FROM pages""",
    "c5_element_text": f"SELECT page_id, {_article_text()} AS text FROM pages WHERE contains(html, '<article>')",
    "c8_collapse_ws": "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents",
    "c9_truncate": """SELECT doc_id,
        CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS cut_ellipsis,
        CASE WHEN length(text) > 100 THEN substr(text, 1, 100) ELSE text END AS cut FROM documents""",
    "c10_word_count": f"SELECT doc_id, len({words('text')}) AS words FROM documents",
    "c11_char_count": "SELECT doc_id, length(text) AS chars FROM documents",
    "c14_preview": """SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END
        AS preview FROM documents""",
    "c15_original_html_length": "SELECT page_id, length(html) AS original_html_length FROM pages",
    "c16_min_words": f"""SELECT doc_id, len(k) AS kept, coalesce(list_sum(list_transform(k, lambda b: length(b))), 0)::BIGINT
        AS kept_chars FROM (SELECT doc_id, list_filter(string_split(text, chr(10)),
        lambda b: len({words('b')}) >= 5) AS k FROM documents)""",

    "g1_batch_summary": f"""SELECT count(*) AS total_processed, count(*) FILTER (WHERE success) AS successful,
        count(*) FILTER (WHERE NOT success) AS failed FROM {FETCHES}""",
    "g3_batch_content_stats": f"""SELECT coalesce(sum(length(c)) FILTER (WHERE success), 0)::BIGINT AS total_content_extracted,
        round_even(coalesce(sum(length(c)) FILTER (WHERE success), 0) / greatest(count(*) FILTER (WHERE success), 1), 0)::DOUBLE
        AS average_content_per_url FROM (SELECT success, {STRIP_TAGS} AS c FROM {FETCHES})""",
    "g4_content_analysis": f"""SELECT doc_id, len(w) AS total_words,
        len(list_distinct(list_filter(list_transform(w, lambda x: lower(x)), lambda x: length(x) > 3))) AS unique_words,
        round_even(len(list_distinct(list_filter(list_transform(w, lambda x: lower(x)), lambda x: length(x) > 3)))
                   / greatest(len(w), 1), 3)::DOUBLE AS vocabulary_ratio,
        length(text) AS content_length FROM (SELECT doc_id, text, {words('text')} AS w FROM documents)""",
    "g6_host_rollup": f"""SELECT host, success, count(*) AS n, sum(CASE WHEN success THEN length(c) ELSE 0 END)::BIGINT AS chars
        FROM (SELECT {HOST} AS host, success, {STRIP_TAGS} AS c FROM {FETCHES})
        GROUP BY ROLLUP (host, success)""",

    "t1_rate_windows": """SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
        count(*) AS n FROM events GROUP BY ALL""",
    "t2_rate_verdict": """SELECT event_id, n_hour, n_day, n_hour <= 1 AND n_day <= 8 AS allowed,
          greatest(1 - n_hour, 0) AS remaining_hour,
          CASE WHEN NOT (n_hour <= 1 AND n_day <= 8) THEN greatest(
            CASE WHEN n_hour > 1 THEN CAST(epoch(date_trunc('hour', ts) + INTERVAL 1 HOUR) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) END,
            CASE WHEN n_day > 8 THEN CAST(epoch(date_trunc('day', ts) + INTERVAL 1 DAY) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) END)
          END AS retry_after
        FROM (SELECT event_id, ts,
          row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS n_hour,
          row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS n_day FROM events)""",
    "t3_rate_exempt": """SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n
        FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 140) GROUP BY ALL""",
    "t4_cache_key": f"""SELECT page_id, 'crawl:' || url || ':{config_digest({"mode": "content", "max_length": 5000})}' AS cache_key,
        md5('crawl:' || url || ':{config_digest({"mode": "content", "max_length": 5000})}') AS lookup_key FROM pages""",
    "t5_cache_lookup": """WITH s AS (SELECT user_id AS key, ts FROM events WHERE event_type = 'view'),
        g AS (SELECT user_id AS key, ts, event_id AS get_id FROM events WHERE event_type <> 'view')
        SELECT g.get_id, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS set_ts,
               coalesce(s.ts + INTERVAL 24 HOUR > g.ts, false) AS hit
        FROM g ASOF LEFT JOIN s ON g.key = s.key AND g.ts >= s.ts""",
    "t6_cache_upsert": """SELECT key, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT user_id AS key,
        event_type AS value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
        FROM events) WHERE rn = 1""",
    "t7_cache_expire": """SELECT user_id AS key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events
        WHERE event_type = 'view' AND ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-20 00:00:00'""",
    "t8_cache_misses": """SELECT page_id FROM pages WHERE url NOT IN (SELECT p.url FROM pages p JOIN events e
        ON p.page_id = e.user_id WHERE e.event_type = 'view' AND e.ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-20 00:00:00')""",
    "t9_paginate": """SELECT page_id, url, (SELECT count(*) FROM pages) AS total,
        CAST(ceil((SELECT count(*) FROM pages) / 20) AS BIGINT) AS pages FROM pages ORDER BY page_id LIMIT 20 OFFSET 40""",
    "t9_all_pages": """SELECT page_id, (row_number() OVER (ORDER BY url, page_id) - 1) // 20 + 1 AS page_no, count(*) OVER () AS total,
        CAST(ceil(count(*) OVER () / 20) AS BIGINT) AS pages FROM pages""",
    "t8_cache_delete": """SELECT event_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events
        WHERE event_type = 'error' AND value > 140)""",
    "t10_leading_n": f"""SELECT host, page_id, rn FROM (SELECT {HOST} AS host, page_id,
        row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) AS rn FROM pages) WHERE rn <= 5""",
    "t11_union_results": f"""SELECT page_id, url, length(html) AS html_length, NULL::VARCHAR AS error, page_id AS position, 0 AS kind
        FROM {FETCHES} WHERE success
        UNION ALL SELECT page_id, url, NULL::BIGINT AS html_length, 'Content extraction failed' AS error, page_id, 1
        FROM {FETCHES} WHERE NOT success""",
})


# --- round trip over the listing pages (read back from ``part``) ------------------

ITEMS = """(SELECT 1000000000 + CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT)
                 + CAST(floor(p_partkey / 200) AS BIGINT) * 100 AS page_id,
        row_number() OVER (PARTITION BY p_brand, floor(p_partkey / 200) ORDER BY p_partkey) - 1 AS elem_pos,
        p_partkey, p_brand, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS name, p_name,
        trim(regexp_replace(p_type, '\\s+', ' ', 'g')) AS ptype, p_size, printf('%.2f', p_retailprice) AS price,
        'https://shop.example.com/brand/' || replace(p_brand, '#', '') || '/' || CAST(CAST(floor(p_partkey / 200) AS BIGINT) AS VARCHAR)
          || '/index.html' AS url,
        trim(regexp_replace(trim(p_name) || ' [Image: ' || trim(p_name) || '] ' || printf('%.2f', p_retailprice) || ' '
          || p_type || ' size ' || CAST(p_size AS VARCHAR), '\\s+', ' ', 'g')) AS main_content
    FROM part)"""

IMG = "'https://shop.example.com/brand/' || replace(p_brand, '#', '') || '/img/' || CAST(p_partkey AS VARCHAR) || '.jpg'"
LINK = "'https://shop.example.com/p/' || CAST(p_partkey AS VARCHAR)"
TAGJ = "CASE WHEN ptype = 'size ' || CAST(p_size AS VARCHAR) THEN ptype ELSE ptype || ' | size ' || CAST(p_size AS VARCHAR) END"
LISTING_PAGES = f"(SELECT DISTINCT page_id, url FROM {ITEMS})"
ORIGIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
PAGE_LINKS = f"""(SELECT page_id, url, unnest(generate_series(0, len(h) - 1)) AS pos, unnest(h) AS raw_href, unnest(t) AS raw_text
    FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h,
                 regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages) WHERE len(h) > 0)"""


def e1(t: str) -> str:
    x = f"regexp_extract_all({t}, '(?s)\\s*(\\S.{{9,}}?[.!?]|\\S.*$)', 1)"
    return (f"CASE WHEN length({t}) < 50 THEN {t} ELSE "
            f"array_to_string(list_filter({x}, lambda v, i: list_position({x}, v) = i), ' ') END")


def ws_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def norm(x: str) -> str:
    return f"regexp_replace({ws_strip(f'lower({x})')}, '\\s+', ' ', 'g')"


AD_TEXT = f"trim(regexp_replace({decode(chr(34).join(['regexp_extract(html, ' + chr(39) + '<div class=', 'ad', '>([^<]*)</div>' + chr(39) + ', 1)']))}, '\\s+', ' ', 'g'))"
H1_TEXT = f"trim(regexp_replace({decode('regexp_extract(html, ' + chr(39) + '<h1>([^<]*)</h1>' + chr(39) + ', 1)')}, '\\s+', ' ', 'g'))"
SECTIONS = f"""(SELECT page_id, sel_pos, section_key, selector, content, element_count FROM (
      SELECT page_id, 0 AS sel_pos, 'selector_1_article' AS section_key, 'article' AS selector,
             {e1('a')} AS content, 1 AS element_count FROM (SELECT page_id, {_article_text()} AS a FROM pages)
      UNION ALL SELECT page_id, 1, 'selector_2_.ad', '.ad', {e1('a')}, 1 FROM (SELECT page_id, {AD_TEXT} AS a FROM pages)
      UNION ALL SELECT page_id, 2, 'selector_3_h1', 'h1', {e1('a')}, 1 FROM (SELECT page_id, {H1_TEXT} AS a FROM pages))
    WHERE content <> '')"""
BLOCKS_E2 = """CASE WHEN len(b1) > 1 THEN b1 WHEN len(b2) > 1 THEN b2 ELSE b3 END"""
BLOCK_SRC = f"""(SELECT doc_id, text,
      list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {ws_strip('x')}), lambda x: x <> '') AS b1,
      list_filter(list_transform(string_split(text, chr(10)), lambda x: {ws_strip('x')}), lambda x: x <> '') AS b2,
      list_filter(list_transform(string_split(text, '.'), lambda x: {ws_strip('x')}), lambda x: x <> '' AND length(x) > 20) AS b3
    FROM documents)"""
TEXT_VOLUME = """list_sum(list_transform(list_filter(regexp_extract_all({src}, '>([^<]+)<', 1), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(12)) <> ''), lambda x: length({dx})))"""


def _volume(src: str) -> str:
    return f"coalesce({TEXT_VOLUME.format(src=src, dx=decode('x'))}, 0)"


NO_SCRIPT = "regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', '', 'g')"

ORACLES.update({
    "f1_array_items": f"SELECT page_id, elem_pos, main_content, len({words('main_content')}) AS word_count, length(main_content) AS char_count FROM {ITEMS}",
    "f2_limit_per_page": f"SELECT page_id, elem_pos, main_content FROM {ITEMS} WHERE elem_pos < 5",
    "f3_min_item_text": f"SELECT page_id, count(*) AS kept_items, 0::BIGINT AS kept_prices FROM {ITEMS} GROUP BY page_id",
    "f4_sub_text": f"SELECT page_id, elem_pos, name AS title, {TAGJ} AS tag FROM {ITEMS}",
    "f5_sub_image": f"SELECT page_id, elem_pos, {IMG} AS image FROM {ITEMS}",
    "f6_image_src": f"SELECT page_id, 11 + 11 * elem_pos AS nid, '../img/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS src FROM {ITEMS}",
    "f7_sub_link": f"SELECT page_id, elem_pos, {LINK} AS link FROM {ITEMS}",
    "f8_absolute_url": f"SELECT page_id, pos, {ORIGIN} || {decode('raw_href')} AS href FROM {PAGE_LINKS}",
    "f10_flatten_field": f"SELECT page_id, elem_pos, {TAGJ} AS tag_join, ptype AS tag_first FROM {ITEMS}",
    "f11_pivot_fields": f"SELECT page_id, elem_pos AS index, name AS title, {IMG} AS image, {LINK} AS link, {TAGJ} AS tag, price FROM {ITEMS}",
    "f13_page_array_summary": f"""SELECT page_id, 2::BIGINT AS total_selectors, count(*) AS total_items_extracted,
          'items' AS successful_selectors, sum(len({words('main_content')}))::BIGINT AS total_words FROM {ITEMS} GROUP BY page_id""",
    "f15_format_flat": f"SELECT page_id, string_agg(main_content, chr(10) || chr(10) ORDER BY elem_pos) AS content FROM {ITEMS} GROUP BY page_id",
    "f16_format_summary": f"""SELECT page_id, 'items: ' || CAST(count(*) AS VARCHAR) || ' items found with selector ''.it'' (order preserved)'
          || chr(10) || 'none: 0 items found with selector ''.none'' (order preserved)' AS content FROM {ITEMS} GROUP BY page_id""",
    "l1_extract_links": f"SELECT page_id, pos, {ORIGIN} || {decode('raw_href')} AS href, trim({decode('raw_text')}) AS text FROM {PAGE_LINKS}",
    "l4_extract_images": f"SELECT page_id, elem_pos AS pos, {IMG} AS src, p_name AS alt, '' AS title FROM {ITEMS}",
    "l6_link_graph": f"""WITH e AS (SELECT url AS source, {ORIGIN} || {decode('raw_href')} AS target, count(*) AS weight FROM {PAGE_LINKS} GROUP BY ALL)
        SELECT source, target, weight, (sum(weight) OVER (PARTITION BY source))::BIGINT AS out_degree,
               (sum(weight) OVER (PARTITION BY target))::BIGINT AS in_degree, count(*) OVER (PARTITION BY target) AS referring_pages FROM e""",

    "d1_sections": f"SELECT page_id, sel_pos, content, element_count, len({words('content')}) AS word_count FROM {SECTIONS}",
    "d2_section_key": f"SELECT page_id, section_key, selector FROM {SECTIONS}",
    "d3_fallback_section": f"""SELECT page_id, CASE WHEN fr THEN 'selector_1_html[lang="fr"] h1' ELSE 'fallback' END AS section_key,
          CASE WHEN fr THEN {e1('h')} ELSE {e1('a')} END AS content, 1::BIGINT AS element_count
        FROM (SELECT page_id, {_article_text()} AS a, {H1_TEXT} AS h, contains(html, '<html lang="fr">') AS fr FROM pages)""",
    "d5_order_sections": f"""SELECT page_id, section_key, CASE WHEN contains(selector, '#') THEN 3
          WHEN contains(selector, '.') OR contains(selector, '[') THEN 2 ELSE 1 END AS priority,
        row_number() OVER (PARTITION BY page_id ORDER BY length(content) DESC,
          CASE WHEN contains(selector, '#') THEN 3 WHEN contains(selector, '.') OR contains(selector, '[') THEN 2 ELSE 1 END DESC,
          sel_pos) AS rank FROM {SECTIONS}""",
    "d11_selector_coverage": f"""WITH p AS (SELECT {HOST} AS host, len({words(_article_text())}) AS a, len({words(AD_TEXT)}) AS d,
            len({words(H1_TEXT)}) AS h, contains(html, '<html lang="en">') AS en, contains(html, '<html lang="fr">') AS fr FROM pages),
        c AS (SELECT host, unnest(['main', 'html[lang="en"] article', '.ad', 'h1', 'html[lang="fr"] h1']) AS selector,
                     unnest([0, 1, 2, 3, 4]) AS pos,
                     unnest([NULL, CASE WHEN en THEN a END, d, h, CASE WHEN fr THEN h END]) AS w FROM p),
        g AS (SELECT host, selector, pos, count(*) AS pages, count(w) AS m, avg(w) AS mw FROM c GROUP BY ALL)
        SELECT host, selector, m AS pages_matched, round_even(m / pages, 4)::DOUBLE AS share, round_even(mw, 4)::DOUBLE AS mean_words,
               row_number() OVER (PARTITION BY host ORDER BY m DESC, pos) AS suggested_rank FROM g""",
    "d12_exclude_coverage": f"""WITH p AS (SELECT {HOST} AS host, {_volume(NO_SCRIPT)} AS total,
          {_volume("regexp_extract(html, '(?s)<nav>.*</nav>')")} AS nav,
          {_volume("regexp_extract(html, '(?s)<footer>.*</footer>')")} AS foot FROM pages),
        h AS (SELECT host, sum(total) AS total, sum(nav) AS nav, sum(foot) AS foot FROM p GROUP BY host)
        SELECT host, unnest(['nav', '.sidebar', '.advertisement', 'footer', '.comments']) AS selector,
               unnest([nav, 0, 0, foot, 0])::BIGINT AS removed, total::BIGINT AS total FROM h""",

    "e1_dedup_sentences": f"SELECT doc_id, {e1('t')} AS text FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)",
    "e2_split_blocks": f"SELECT doc_id, len({BLOCKS_E2}) AS n_blocks, array_to_string({BLOCKS_E2}, ' || ') AS blocks FROM {BLOCK_SRC}",
    "e3_dedup_blocks_exact": f"""SELECT doc_id, pos, block FROM (SELECT doc_id, pos, block,
          row_number() OVER (PARTITION BY doc_id, {norm('block')} ORDER BY pos) AS rn
        FROM (SELECT doc_id, unnest(generate_series(0, len(bl) - 1)) AS pos, unnest(bl) AS block
              FROM (SELECT doc_id, {BLOCKS_E2} AS bl FROM {BLOCK_SRC}) WHERE len(bl) > 0)
        WHERE length({norm('block')}) >= 15) WHERE rn = 1""",
    "e10_exact_duplicates": f"""SELECT doc_id, min(doc_id) OVER (PARTITION BY {norm('text')}) AS rep,
        count(*) OVER (PARTITION BY {norm('text')}) AS copies FROM documents""",
    "e11_duplicate_blocks_corpus": f"""SELECT source, md5(n) AS h, n AS block, count(DISTINCT doc_id) AS docs
        FROM (SELECT source, doc_id, {norm('line')} AS n FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line
              FROM documents)) WHERE length(n) >= 15 GROUP BY source, n HAVING count(DISTINCT doc_id) >= 3""",
})

ORACLES.update({
    "s2_stream_rate_windows": ORACLES["t1_rate_windows"],
    "s6_stream_batch_summary": ORACLES["g1_batch_summary"],
})

TITLES = ORACLES["c4_page_title"]
ORACLES.update({
    "s1_stream_content_only": f"SELECT page_id, true AS success, title FROM ({TITLES})",
    "s3_stream_sliding": """SELECT user_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n
        FROM (SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTE, ts),
                                      time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL""",
    "s3_stream_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
          < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
        g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e),
        w AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS z, count(*) AS n FROM g GROUP BY user_id, s)
        SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(z, '%Y-%m-%d %H:%M:%S') AS session_end, n
        FROM w WHERE z <= (SELECT max(ts) FROM events)""",
    "s4_stream_dedup": """WITH RECURSIVE k AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL
        UNION ALL SELECT k.user_id, k.event_type, (SELECT min(e.ts) FROM events e WHERE e.user_id = k.user_id AND e.event_type = k.event_type
            AND e.ts >= k.ts + INTERVAL 48 HOUR) FROM k WHERE k.ts IS NOT NULL)
        SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM k WHERE ts IS NOT NULL""",
    "a10_error_json": """SELECT page_id, '{"success":false,"error":"Content extraction failed"'
        || CASE WHEN page_id % 2 = 0 THEN ',"details":{"url":"' || url || '"}' ELSE '' END || '}' AS json
        FROM pages WHERE NOT contains(html, '</html>')""",
    "a11_write_results": "SELECT page_id, url, contains(html, '</html>') AS success FROM pages",
    "a12_flatten_envelope": "SELECT page_id, true AS success, 'Success' AS message, url, length(html) AS size FROM pages",
    "d8_return_sections": f"""SELECT page_id, count(*) AS n_sections, max(CASE WHEN selector = '.ad' THEN content END) AS ad
        FROM {SECTIONS} WHERE selector IN ('article', '.ad') GROUP BY page_id""",
    "d2_repeated_selector": f"""SELECT page_id, 'selector_1_h1' AS section_key, 0::BIGINT AS sel_pos FROM {SECTIONS} WHERE selector = 'h1'
        UNION ALL SELECT page_id, 'selector_2_.ad', 1 FROM {SECTIONS} WHERE selector = '.ad'
        UNION ALL SELECT page_id, 'selector_3_h1', 2 FROM {SECTIONS} WHERE selector = 'h1'""",
    "l5_skip_switches": f"""SELECT page_id, count(*) AS links, 0::BIGINT AS no_images, count(*) AS images, 0::BIGINT AS no_links
        FROM {ITEMS} GROUP BY page_id""",
    "c7_failures": """SELECT page_id, page_id % 3 <> 0 AND page_id % 5 <> 0 AS success,
          CASE WHEN page_id % 5 = 0 THEN 'timeout' WHEN page_id % 3 = 0 THEN 'No HTML content found' END AS error,
          page_id % 3 = 0 OR page_id % 5 = 0 AS empty FROM pages""",
    "g2_batch_timing": """SELECT round_even(sum(value), 2) AS total_time,
        round_even(sum(value) / count(*), 2) AS average_time_per_url FROM events""",
    "g5_result_metadata": "SELECT page_id, length(html) AS original_html_length, 'content_only' AS extraction_mode FROM pages",
})


# --- ordered folds as list folds ----------------------------------------------------

def _e2(col: str) -> str:
    """Blocks of a text, as a CASE over three splits."""
    para = f"list_filter(list_transform(string_split({col}, chr(10) || chr(10)), lambda x: {ws_strip('x')}), lambda x: x <> '')"
    line = f"list_filter(list_transform(string_split({col}, chr(10)), lambda x: {ws_strip('x')}), lambda x: x <> '')"
    dot = f"list_filter(list_transform(string_split({col}, '.'), lambda x: {ws_strip('x')}), lambda x: length(x) > 20)"
    return f"CASE WHEN len({para}) > 1 THEN {para} WHEN len({line}) > 1 THEN {line} ELSE {dot} END"


def _e4(src: str, col: str, out: str) -> str:
    """``src`` with column ``out``: E4 of ``col``, folded block by block."""
    inside = "contains(k.n, y[1].n) AND length(y[1].n) > length(k.n) * 0.7"
    holds = "contains(y[1].n, k.n) AND length(k.n) > length(y[1].n) * 0.7"
    return f"""(SELECT * EXCLUDE (bl, ks), CASE WHEN len(ks) > 0 THEN array_to_string(list_transform(ks, lambda k: k.r), chr(10) || chr(10))
        ELSE {col} END AS {out} FROM (SELECT *, list_reduce(list_transform(bl, lambda x: [x]), lambda acc, y:
          CASE WHEN len(list_filter(acc, lambda k: {inside})) > 0 THEN acc
               ELSE list_concat(list_filter(acc, lambda k: NOT ({holds})), y) END, bl[1:0]) AS ks
        FROM (SELECT *, list_filter(list_transform({_e2(col)}, lambda x: {{'n': {norm('x')}, 'r': x}}),
                                    lambda z: length(z.n) >= 15) AS bl FROM {src})))"""


def _kept(src: str) -> str:
    """Rows (page_id, rank, section_key, selector, content) that stay. The similarity ratio is left out: lengths or
    words that are not alike decide every pair of these sections."""
    dup = ("k.n = y[1].n OR (contains(k.n, y[1].n) AND length(y[1].n) > length(k.n) * 0.5) "
           "OR (contains(y[1].n, k.n) AND length(k.n) > length(y[1].n) * 0.5)")
    return f"""(SELECT page_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, y:
          CASE WHEN len(list_filter(acc, lambda k: {dup})) > 0 THEN acc ELSE list_concat(acc, y) END, l[1:0]), recursive := true)
        FROM (SELECT page_id, list({{'n': {norm('content')}, 'rank': rank, 'section_key': section_key, 'selector': selector,
                                     'content': content}} ORDER BY rank) AS l
              FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(content) DESC,
                CASE WHEN contains(selector, '#') THEN 3 WHEN contains(selector, '.') OR contains(selector, '[') THEN 2 ELSE 1 END DESC,
                sel_pos) AS rank FROM {src}) GROUP BY page_id))"""


def _sections(*parts: tuple[str, str]) -> str:
    """Sections of the pages: (selector, text before E1) in request order."""
    return "(SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT page_id, {i} AS sel_pos, 'selector_{i + 1}_{sel}' AS section_key, '{sel}' AS selector, {text} AS content FROM "
        f"(SELECT page_id, {_article_text()} AS art, {AD_TEXT} AS ad, {H1_TEXT} AS h1 FROM pages)"
        for i, (sel, text) in enumerate(parts)) + ") WHERE content <> '')"


_ART, _AD, _H1 = ("article", e1("art")), (".ad", e1("ad")), ("h1", e1("h1"))
_BOTH = ("body > div.ad, article > h1", f"trim({e1('ad')} || ' ' || {e1('h1')})")
_D9 = _e4(_kept(_sections(_ART, _AD, _H1)), "content", "d")
_D9_BODY = f"""(SELECT page_id, count(*) AS total_sections, CASE WHEN count(*) = 1 THEN max(d)
      ELSE string_agg('[' || selector || ']' || chr(10) || d, chr(10) || chr(10) ORDER BY rank) END AS body FROM {_D9} GROUP BY page_id)"""
_CUT = "CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END"

# The article's elements in document order. A paragraph opened by ``<p><b>`` is never closed, so it holds the rest of the article.
_TOKENS = f"regexp_extract_all({ARTICLE}, '<h1>[^<]*</h1>|<p><b>[^<]*<br>|<p>[^<]*</p>')"
_BLOCKS = f"""(SELECT page_id, trim(regexp_replace(array_to_string(list_transform(t, lambda x, i: CASE WHEN starts_with(x, '<p><b>')
        THEN array_to_string(s[i:], '') ELSE s[i] END || ' ' || s[i]), ' '), '\\s+', ' ', 'g')) AS text FROM (SELECT page_id, {_TOKENS} AS t,
        list_transform({_TOKENS}, lambda x: {ws_strip(decode("regexp_replace(x, '<[^>]+>', '', 'g')"))}) AS s FROM pages))"""

_TURN = "CASE WHEN text IS NULL THEN '' ELSE text END"
TURNS = f"""(SELECT conv_id AS page_id, 'https://talk.example.com/c/' || CAST(conv_id AS VARCHAR) AS url, pos, role,
        trim(regexp_replace({_TURN}, '\\s+', ' ', 'g')) AS body, trim(regexp_replace(role || ' ' || {_TURN}, '\\s+', ' ', 'g')) AS main
      FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations
            UNION ALL SELECT conv_id, upper(role), text, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
              count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE k = 1))"""
ITEMS_KEPT = f"""(SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS idx FROM (SELECT *,
        row_number() OVER (PARTITION BY page_id, {norm('main')} ORDER BY pos) AS copy, count(*) OVER (PARTITION BY page_id) AS n
      FROM {TURNS} WHERE length(main) >= 15) WHERE n = 1 OR (copy = 1 AND length(main) >= 20))"""
TURN_PAGES = "(SELECT DISTINCT conv_id AS page_id, 'https://talk.example.com/c/' || CAST(conv_id AS VARCHAR) AS url FROM conversations)"
_NL = "chr(10)"

ORACLES.update({
    "b8_css": f"""WITH a AS (SELECT page_id, html, {_TOKENS} AS t FROM pages),
        p AS (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS li, list_transform(t, lambda x: x[2:3]) AS tags,
                     list_transform(t, lambda x: starts_with(x, '<p><b>')) AS opens FROM a),
        q AS (SELECT page_id, li, tags, opens, coalesce(list_position(opens, true), len(tags) + 1) AS o,
                     len(list_filter(opens, lambda x: x)) AS n_open FROM p),
        i AS (SELECT page_id, count(*) AS n FROM {ITEMS} GROUP BY page_id)
        SELECT page_id, unnest(['li:nth-child(2)', 'li:last-child', 'h1 + p', 'h1 ~ p', 'p:first-of-type', 'article > :first-child',
            'div.it:nth-child(2n+1)', 'div.it + div.it', 'span.price ~ span.tag', 'span.tag + span.tag', 'div.it:not(:first-child) h2',
            'div.it > :nth-last-child(-n+2)']) AS selector,
          unnest([(li > 1)::INT, (li > 0)::INT, (len(tags) > 1)::INT, least(o, len(tags)) - 1,
                  (len(tags) > 1)::INT + n_open - (n_open > 0 AND opens[len(opens)])::INT, 1, 0, 0, 0, 0, 0, 0])::BIGINT AS n FROM q
        UNION ALL SELECT page_id, unnest(['li:nth-child(2)', 'li:last-child', 'h1 + p', 'h1 ~ p', 'p:first-of-type', 'article > :first-child',
            'div.it:nth-child(2n+1)', 'div.it + div.it', 'span.price ~ span.tag', 'span.tag + span.tag', 'div.it:not(:first-child) h2',
            'div.it > :nth-last-child(-n+2)']), unnest([0, 0, 0, 0, 0, 0, (n + 1) // 2, n - 1, 2 * n, n, n - 1, 2 * n])::BIGINT FROM i""",
    "c6_block_text": f"SELECT page_id, text FROM {_BLOCKS}",
    "c7_content_only": f"""SELECT page_id, title, content, len({words('content')}) AS word_count, n AS original_html_length FROM (
          SELECT page_id, title, {_CUT.format(c='text', n=10000)} AS content, length(html) AS n
          FROM {_BLOCKS} JOIN ({TITLES}) USING (page_id) JOIN pages USING (page_id))""",
    "d6_drop_nested_sections": f"""SELECT page_id, section_key, rank FROM {_kept(_sections(
        _ART, _H1, ('body > article', e1('art')), _AD, ('div', e1('ad')), _BOTH))}""",
    "d9_selective": f"""SELECT page_id, title, content, len({words('content')}) AS word_count, total_sections,
          'custom_selectors_deduplicated' AS extraction_method FROM (
          SELECT page_id, total_sections, {_CUT.format(c=ws_strip('f'), n=5000)} AS content FROM {_e4(_D9_BODY, 'body', 'f')})
        JOIN ({TITLES}) USING (page_id)""",
    "d10_dedup_stats": f"""SELECT page_id, 2::BIGINT AS selectors_provided, count(*) AS unique_sections_found, true AS deduplication_applied
        FROM {_kept(_sections(_ART, _H1))} GROUP BY page_id""",
    "e4_dedup_blocks": f"SELECT doc_id, CASE WHEN text = '' THEN text ELSE f END AS text FROM {_e4('documents', 'text', 'f')}",
    "e9_dedup_items": f"SELECT page_id, 'turns' AS array_name, idx AS index, main AS main_content FROM {ITEMS_KEPT}",
    "e10_near_duplicates": f"""WITH RECURSIVE d AS (SELECT doc_id, {words(norm("coalesce(text, '')"))} AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 10 * i >= 8 * (a.c + b.c - i)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN e ON r.other = e.x)
        SELECT doc_id, min(other) AS rep FROM reach GROUP BY doc_id""",
    "e11_drop_boilerplate": f"""WITH l AS (SELECT doc_id, source, unnest(generate_series(1, len(s))) AS pos, unnest(s) AS line
            FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents)),
        m AS (SELECT *, {norm('line')} AS n FROM l),
        b AS (SELECT source, n FROM m WHERE length(n) >= 15 GROUP BY source, n HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, source, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.n IS NULL), '') AS text
        FROM m LEFT JOIN b USING (source, n) GROUP BY doc_id, source""",
    "f9_auto_fields": f"""SELECT page_id, idx AS index, role AS title, '' AS image, '' AS link, '' AS date, '' AS author,
        CASE WHEN body <> '' THEN body ELSE main END AS content FROM {ITEMS_KEPT}""",
    "f12_array_summary": f"""SELECT page_id, 'turns' AS array_name, coalesce(c, 0) AS count, 'title,text' AS sub_selectors_used,
          coalesce(c, 0) < coalesce(b, 0) AS deduplication_applied FROM {TURN_PAGES}
          LEFT JOIN (SELECT page_id, count(*) AS b FROM {TURNS} WHERE length(main) >= 15 GROUP BY page_id) USING (page_id)
          LEFT JOIN (SELECT page_id, count(*) AS c FROM {ITEMS_KEPT} GROUP BY page_id) USING (page_id)
        UNION ALL SELECT page_id, 'none', 0, '', false FROM {TURN_PAGES}""",
    "f14_format_structured": f"""SELECT page_id, '=== TURNS (' || CAST(count(*) AS VARCHAR) || ' items - order preserved) ===' || {_NL}
          || string_agg({_NL} || '[Item ' || CAST(idx + 1 AS VARCHAR) || ']' || {_NL} || main || {_NL} || 'title: ' || role
               || CASE WHEN body <> '' THEN {_NL} || 'text: ' || body ELSE '' END, {_NL} ORDER BY idx) || {_NL} AS content
        FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS idx) FROM {ITEMS_KEPT}) GROUP BY page_id""",
    "f18_array_batch": f"""SELECT url, c IS NOT NULL AS success, coalesce(c, 0) AS total_found, items FROM (
          SELECT url, count(idx) AS c, coalesce(string_agg(CAST(idx AS VARCHAR) || ' ' || role || ' ' || body, '|' ORDER BY idx), '') AS items
          FROM {TURN_PAGES} LEFT JOIN (SELECT page_id, idx, role, body FROM {ITEMS_KEPT}) USING (page_id) GROUP BY url)
        UNION ALL SELECT url || '?missing', false, 0, NULL FROM {TURN_PAGES}""",
    "f18_batch_totals": f"""SELECT 2 * p AS total_urls_processed, p AS successful_extractions, p AS failed_extractions, c AS total_items_found
        FROM (SELECT count(*) AS p FROM {TURN_PAGES}), (SELECT count(*) AS c FROM {ITEMS_KEPT})""",
    "g5_metadata_modes": f"""SELECT page_id, 'array_based_ordered' AS extraction_mode, coalesce(c, 0) AS total_items,
          'turns' AS successful_selectors, coalesce(w, 0)::BIGINT AS word_count
        FROM {TURN_PAGES} JOIN (SELECT page_id, count(*) AS c, sum(len({words('main')})) AS w FROM {ITEMS_KEPT} GROUP BY page_id) USING (page_id)""",
    "l2_split_internal_external": f"""SELECT page_id, pos, CASE WHEN pos % 2 = 0 THEN href
          ELSE regexp_replace(href, '^[A-Za-z]+://[^/]*', 'https://www.far.example.org') END AS href,
        CASE WHEN pos % 2 = 0 THEN '' ELSE 'https://www.far.example.org' END AS origin, pos % 2 = 0 AS internal
        FROM (SELECT page_id, pos, {ORIGIN} || {decode('raw_href')} AS href FROM {PAGE_LINKS}
              UNION ALL SELECT page_id, elem_pos, {LINK} FROM {ITEMS})""",
    "l3_exclude_external_links": f"SELECT page_id, count(*) AS internal_links FROM {PAGE_LINKS} WHERE pos % 2 = 0 GROUP BY page_id",
})
ORACLES["g4_corpus_vocabulary"] = f"""SELECT source, len_ AS total_words, 0::BIGINT AS level FROM (
    SELECT source, sum(len({words('text')}))::BIGINT AS len_ FROM documents GROUP BY source)
    UNION ALL SELECT NULL, sum(len({words('text')}))::BIGINT, 1 FROM documents"""
ORACLES["s1_stream_selective"] = ORACLES["d9_selective"]
ORACLES["s1_stream_arrays"] = ORACLES["f14_format_structured"]
