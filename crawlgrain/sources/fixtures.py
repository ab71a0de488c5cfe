"""Derived input tables: one SQL statement each over the given tables.

The same text runs in Spark SQL and in DuckDB, so a query and its check read identical rows.
"""

from __future__ import annotations

NOW = 1000000.0

PAGES_PLUS = """
SELECT page_id, url, replace(html, '</body>',
     '<div id="content-' || page_id || '" class="content product-grid">'
  || repeat('<div class="item card"><h2 class="title">Item name</h2><span class="price">9.99</span></div>', CAST(page_id % 7 AS INT))
  || '</div><table>' || repeat('<tr><td>cell</td></tr>', CAST(page_id % 6 AS INT)) || '</table>'
  || repeat('<form><button data-id="1" aria-label="go">Load more</button></form>', CAST(page_id % 3 AS INT))
  || CASE WHEN page_id % 4 = 0 THEN '<div class="pagination"><a href="/list?page=1">1</a><a href="/list?page=2" data-page="2">2</a></div><p>Page 1</p>' ELSE '' END
  || CASE WHEN page_id % 5 = 0 THEN '<script src="/js/React.min.js"></script>' WHEN page_id % 5 = 1 THEN '<script src="/js/vue.js"></script>' ELSE '' END
  || CASE WHEN page_id % 3 = 0 THEN '<script type="application/ld+json">{"@type":"Product","n":' || page_id || '}</script>'
          WHEN page_id % 3 = 1 THEN '<script type="application/ld+json">{bad</script>' ELSE '' END
  || '<meta name="description" content="d' || page_id || '"><meta property="og:title">'
  || '<div class="modal popup" ng-if="x" data-role="dialog"></div><iframe></iframe>'
  || CASE WHEN page_id % 9 = 0 THEN '<p data-a="1" data-b="2" data-c="3" data-d="4">x</p>' ELSE '' END
  || '</body>') AS html
FROM pages
"""

PAGES_RENDERED = """
SELECT page_id, url, replace(html, '</article>',
  CASE WHEN page_id % 2 = 0 THEN repeat('<div class="result">rendered text block</div>', 40) ELSE '' END || '</article>') AS html
FROM pages_plus
"""

ROBOTS = """
SELECT host,
  CASE WHEN length(host) % 3 = 0 THEN 200 WHEN length(host) % 3 = 1 THEN 404 END AS status,
  CASE WHEN length(host) % 3 = 0 THEN 'User-agent: *' END AS body,
  CASE WHEN length(host) % 3 = 2 THEN 'timeout' END AS error
FROM (SELECT DISTINCT regexp_extract(url, 'https?://([^/]+)', 1) AS host FROM pages) h
"""

RESPONSE_HEADERS = """
SELECT page_id, 'content-security-policy' AS name, 'default-src self' AS value FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'X-Frame-Options', 'DENY' FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'STRICT-TRANSPORT-SECURITY', 'max-age=1' FROM pages WHERE page_id % 5 = 0
"""

ANALYSIS_CACHE = """
SELECT md5(url) AS cache_key, url,
  CASE WHEN page_id % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(1000000 - (page_id % 50) * 3600 AS DOUBLE) END AS cache_time,
  CAST(length(html) AS BIGINT) AS size_bytes, page_id % 11 <> 0 AS readable, CAST(page_id AS BIGINT) AS version,
  '{"stored":' || page_id || '}' AS analysis
FROM pages WHERE page_id % 3 < 2
"""

ANALYSIS_CACHE_NEW = """
SELECT md5(url) AS cache_key, url, CAST(1000000 AS DOUBLE) AS cache_time, CAST(length(html) + 1 AS BIGINT) AS size_bytes,
  TRUE AS readable, CAST(page_id + 100000 AS BIGINT) AS version, '{"stored":"anew"}' AS analysis
FROM pages WHERE page_id % 4 = 0
"""

REQUESTS = """
SELECT doc_id AS request_id,
  CASE WHEN doc_id % 10 = 9 THEN 'ftp://bad/x' WHEN doc_id % 10 = 8 THEN NULL ELSE 'https://example.org/' || doc_id END AS url,
  CASE doc_id % 8 WHEN 0 THEN 'Product prices and review scores' WHEN 1 THEN 'List of news headlines'
    WHEN 2 THEN 'My career journey and university degree' WHEN 3 THEN 'Portfolio' WHEN 4 THEN 'Multiple job posts with comments and profile'
    WHEN 5 THEN 'Weather' WHEN 6 THEN 'list of everything' ELSE 'article, news, review, profile' END
    || chr(10) || coalesce(text, '') AS expected_data,
  CASE doc_id % 9 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3-opus' WHEN 2 THEN 'gemini-1.5-pro' WHEN 3 THEN 'mistral-small' WHEN 4 THEN 'command-r'
    WHEN 5 THEN 'j2-ultra' WHEN 6 THEN 'qwen-72b' WHEN 7 THEN 'llama-3-8b' ELSE 'mystery-1' END AS llm_model
FROM documents
"""

ATTEMPT_LOG = """
SELECT user_id || '-' || CAST(floor(event_id / 2000) AS BIGINT) AS request_id,
  CAST(row_number() OVER (PARTITION BY user_id, floor(event_id / 2000) ORDER BY event_id) AS INT) AS attempt_no,
  event_type <> 'error' AS success,
  CASE event_type WHEN 'view' THEN coalesce(props, '') WHEN 'click' THEN 'Done: ' || coalesce(props, '[]') || ' ok'
    WHEN 'purchase' THEN substr(coalesce(props, ''), 1, 4 + CAST(event_id % 5 AS INT)) WHEN 'signup' THEN '  ' ELSE '' END AS stdout,
  CASE WHEN event_type <> 'error' THEN '' ELSE CASE event_id % 8 WHEN 0 THEN 'Connection refused by host' WHEN 1 THEN 'httperror: 403 Forbidden'
    WHEN 2 THEN 'HTTPError: 429 timeout' WHEN 3 THEN 'Timeout reached' WHEN 4 THEN 'NoSuchElementException: x' WHEN 5 THEN 'ElementNotVisibleException'
    WHEN 6 THEN 'solve the CAPTCHA' ELSE 'SyntaxError: bad' END || ' in ' || coalesce(props, '') END AS stderr,
  value AS execution_time, event_type = 'error' AND event_id % 16 = 15 AS timed_out,
  'import requests' || chr(10) || 'x = ' || event_id AS code,
  event_type = 'view' AND value > 50 AS is_valid
FROM events
"""

LLM_CALLS = """
SELECT conv_id * 100 + turn AS call_id, conv_id AS request_id, CASE WHEN turn % 2 = 0 THEN 'helper' ELSE 'coding' END AS role,
  CASE WHEN turn % 2 = 0 THEN 'gemini-2.0-flash-lite' ELSE CASE conv_id % 6 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3-haiku' WHEN 2 THEN 'mistral-large'
    WHEN 3 THEN 'deepseek-coder' WHEN 4 THEN 'Falcon-180b' ELSE 'mystery-1' END END AS model,
  turn % 4 <> 3 AS has_response_metadata, turn % 8 = 3 AS has_usage_metadata,
  CASE WHEN turn % 3 = 0 THEN 0 ELSE CAST(length(text) AS BIGINT) END AS prompt_tokens,
  CASE WHEN turn % 3 = 1 THEN NULL ELSE CAST(length(text) AS BIGINT) END AS completion_tokens,
  CAST(length(text) + 7 AS BIGINT) AS input_tokens, CAST(length(text) + 3 AS BIGINT) AS output_tokens, text AS content
FROM conversations
"""

STAGE_EVENTS = """
SELECT event_id, user_id AS request_id,
  CASE event_id % 8 WHEN 0 THEN 'setup' WHEN 1 THEN 'prompt_formatting' WHEN 2 THEN 'code_generation' WHEN 3 THEN 'code_extraction'
    WHEN 4 THEN 'code_execution' WHEN 5 THEN 'data_validation' WHEN 6 THEN 'refinement' ELSE 'website_analysis' END AS stage,
  CASE WHEN event_type IN ('signup', 'view') THEN 'start' WHEN event_type IN ('click', 'purchase') THEN 'complete' ELSE 'fail' END AS action,
  CAST(event_id * 60 AS DOUBLE) AS ts_s, ts, props AS details
FROM events
"""

RESOURCE_LOG = """
SELECT event_id AS seq, user_id % 50 AS page_id, 'https://api.example.org/' || event_id AS url,
  CASE event_type WHEN 'click' THEN 'xhr' WHEN 'view' THEN 'fetch' WHEN 'purchase' THEN 'script' WHEN 'signup' THEN 'image' ELSE 'document' END AS resource_type,
  CASE event_type WHEN 'click' THEN 'xmlhttprequest' WHEN 'view' THEN 'fetch' ELSE 'other' END AS initiator_type,
  CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method
FROM events
"""

NAVIGATION = """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE CAST(page_id * 10 AS DOUBLE) + (page_id % 2) / 2 END AS nav_load_end,
  CASE WHEN page_id % 3 = 0 THEN NULL ELSE CAST(page_id * 9 AS DOUBLE) END AS nav_dom_end,
  CAST(page_id + 900 AS DOUBLE) AS timing_load_end, CAST(page_id + 800 AS DOUBLE) AS timing_dom_end,
  CAST(page_id AS DOUBLE) AS navigation_start
FROM pages WHERE page_id % 7 <> 6
"""

CODE_ROWS = """
SELECT doc_id, CASE doc_id % 6
  WHEN 0 THEN 'import requests, json' || chr(10) || 'from bs4 import BeautifulSoup' || chr(10) || 'x = 1'
  WHEN 1 THEN 'from selenium import webdriver' || chr(10) || 'def f():' || chr(10) || '    pass'
  WHEN 2 THEN 'import playwright.sync_api as p' || chr(10) || 'class A:' || chr(10) || '    pass'
  WHEN 3 THEN 'import scrapy' || chr(10) || 'import torch'
  WHEN 4 THEN 'import os.path' || chr(10) || 'from .parts.items import z' || chr(10) || 'y = requests.get(1)'
  ELSE 'plain words only' END || chr(10) || coalesce(text, '') AS code
FROM documents
"""

LLM_RESPONSES = """
SELECT conv_id, turn, CASE turn % 3
  WHEN 0 THEN 'Sure:' || chr(10) || '```python' || chr(10) || 'x = ' || turn || chr(10) || coalesce(text, '') || chr(10) || '```' || chr(10) || '```python' || chr(10) || 'second' || chr(10) || '```'
  WHEN 1 THEN 'See ```' || chr(10) || 'y = ' || turn || chr(10) || coalesce(text, '') || '``` end' ELSE text END AS response
FROM conversations
"""

VERDICTS = """
SELECT doc_id, CASE WHEN quality = 1 THEN ' yes, fine ' WHEN toxic = 1 THEN 'NO - Missing price - and name'
  ELSE 'no - ' || replace(coalesce(text, ''), 'ß', 'ss') END AS response
FROM (SELECT doc_id, quality, toxic FROM labels) l JOIN (SELECT doc_id, text FROM documents) d USING (doc_id)
"""

ACCESS_LOG = """
SELECT event_id, user_id AS client, CASE WHEN event_id % 4 = 0 THEN '/api/status/' || user_id ELSE '/submit' END AS path, CASE WHEN event_id % 12 = 0 THEN 2 ELSE 5 END AS n_args FROM events
"""

FIXTURES = {
    "pages_plus": PAGES_PLUS,
    "pages_rendered": PAGES_RENDERED,
    "robots": ROBOTS,
    "response_headers": RESPONSE_HEADERS,
    "analysis_cache": ANALYSIS_CACHE,
    "analysis_cache_new": ANALYSIS_CACHE_NEW,
    "requests": REQUESTS,
    "attempt_log": ATTEMPT_LOG,
    "llm_calls": LLM_CALLS,
    "stage_events": STAGE_EVENTS,
    "resource_log": RESOURCE_LOG,
    "navigation": NAVIGATION,
    "code_rows": CODE_ROWS,
    "llm_responses": LLM_RESPONSES,
    "verdicts": VERDICTS,
    "access_log": ACCESS_LOG,
}
