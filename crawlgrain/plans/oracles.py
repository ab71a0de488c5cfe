"""SQL twins of the registered queries, written for DuckDB and independent of the Spark code.

Element trees are rebuilt in SQL: markup is cut into tokens by a regex and a recursive query replays the tokens
against a stack of open elements. The given pages are regular enough for that (no '>' inside attribute values).
"""

from __future__ import annotations

import re
import sys

from crawlgrain import fixed_values as V
from crawlgrain.functions.expr import WHITESPACE
from crawlgrain.sources.fixtures import FIXTURES, NOW

STATUS_NOW = 30000.0


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(items) -> str:
    return "(" + ", ".join(quoted(i) for i in items) + ")"


def strip(expr: str) -> str:
    return f"trim({expr}, '{WHITESPACE}')"


def fixture_ctes(*names: str) -> str:
    """The derived tables as CTEs, each after the derived tables it reads."""
    ordered: list[str] = []

    def add(name):
        for inner in re.findall(r"\bFROM (\w+)", FIXTURES[name]):
            if inner in FIXTURES:
                add(inner)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return ",\n".join(f"{name} AS ({FIXTURES[name]})" for name in ordered)


def over(*names: str) -> str:
    return "WITH " + fixture_ctes(*names) + "\n"


# -- element trees -------------------------------------------------------------------------------
# References in the given pages; the last one of a cut-off text may lack its semicolon.
VISIBLE_DECODED = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(tok, '&quot;?', '\"', 'g'), "
                   "'&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g')")

TREE = r"""
parts AS (SELECT page_id, url, length(html) AS html_len, regexp_extract_all(html,
  '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>|[^<]+') AS parts FROM @SOURCE@),
toks AS MATERIALIZED (
  SELECT page_id, k, tok,
    CASE WHEN tok LIKE '<!--%' THEN 'comment' WHEN tok LIKE '<!%' THEN 'decl'
         WHEN regexp_matches(tok, '^<(script|style)') THEN 'leaf' WHEN tok LIKE '</%' THEN 'end'
         WHEN regexp_matches(tok, '^<(meta|br|link|img|input|hr)[ >/]') THEN 'void'
         WHEN tok LIKE '<%' THEN 'start' ELSE 'text' END AS kind,
    lower(regexp_extract(tok, '^</?([a-zA-Z0-9]+)', 1)) AS tag
  FROM (SELECT page_id, unnest(parts) AS tok, generate_subscripts(parts, 1) AS k FROM parts)),
numbered AS MATERIALIZED (
  SELECT *, CAST(sum(CASE WHEN kind IN ('start', 'void', 'leaf') THEN 1 ELSE 0 END)
    OVER (PARTITION BY page_id ORDER BY k) - 1 AS INT) AS node_id FROM toks),
walk AS (
  SELECT page_id, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS ids, CAST([] AS VARCHAR[]) AS names,
    CAST([] AS INT[]) AS above FROM parts
  UNION ALL
  SELECT w.page_id, t.k,
    CASE WHEN t.kind = 'start' THEN list_append(ids, t.node_id)
         WHEN t.kind = 'end' AND list_contains(names, t.tag)
         THEN ids[1:len(names) - list_position(list_reverse(names), t.tag)] ELSE ids END,
    CASE WHEN t.kind = 'start' THEN list_append(names, t.tag)
         WHEN t.kind = 'end' AND list_contains(names, t.tag)
         THEN names[1:len(names) - list_position(list_reverse(names), t.tag)] ELSE names END,
    ids
  FROM walk w JOIN numbered t ON t.page_id = w.page_id AND t.k = w.k + 1),
placed AS MATERIALIZED (
  SELECT n.page_id, n.k, n.node_id, n.tag, n.tok, n.kind, w.above, coalesce(w.above[-1], -1) AS parent_id,
    len(w.above) AS depth,
    nullif(regexp_extract(n.tok, '^<[^>]* id="([^"]*)"', 1), '') AS id,
    list_filter(string_split(regexp_extract(n.tok, '^<[^>]* class="([^"]*)"', 1), ' '), lambda c: c <> '') AS classes,
    regexp_extract(n.tok, '^(<[^>]*>)', 1) AS head
  FROM numbered n JOIN walk w ON w.page_id = n.page_id AND w.k = n.k),
nodes AS MATERIALIZED (
  SELECT a.*, row_number() OVER (PARTITION BY page_id, parent_id ORDER BY node_id) AS elem_idx,
    row_number() OVER (PARTITION BY page_id, parent_id, tag ORDER BY node_id) AS tag_idx,
    count(*) OVER (PARTITION BY page_id, parent_id, tag) AS tag_total,
    coalesce((SELECT count(*) FROM placed c WHERE c.page_id = a.page_id AND c.parent_id = a.node_id
      AND c.kind IN ('start', 'void', 'leaf')), 0) AS n_children,
    coalesce((SELECT min(b.node_id) FROM placed b WHERE b.page_id = a.page_id AND b.node_id > a.node_id
      AND b.depth <= a.depth AND b.kind IN ('start', 'void', 'leaf')) - 1,
      (SELECT max(b.node_id) FROM placed b WHERE b.page_id = a.page_id)) AS subtree_end,
    coalesce('#' || id, '.' || classes[1], tag) AS selector
  FROM placed a WHERE kind IN ('start', 'void', 'leaf')),
strings AS MATERIALIZED (
  SELECT page_id, k, above, CASE WHEN regexp_matches(tok, '^[ \n\t\f\r]*$')
    THEN CASE WHEN contains(tok, chr(10)) THEN chr(10) ELSE ' ' END ELSE @DECODED@ END AS s
  FROM placed WHERE kind = 'text'),
page_strings AS MATERIALIZED (
  SELECT p.page_id, p.url, p.html_len, coalesce(string_agg(s.s, '' ORDER BY s.k), '') AS body,
    coalesce(sum(length(@STRIP_S@)), 0) AS text_len
  FROM parts p LEFT JOIN strings s ON s.page_id = p.page_id GROUP BY ALL),
texts AS MATERIALIZED (
  SELECT n.page_id, n.node_id, coalesce(CASE WHEN n.kind = 'leaf' THEN regexp_extract(n.tok, '(?s)^<[^>]*>(.*)</', 1)
    ELSE t.s END, '') AS txt
  FROM nodes n LEFT JOIN (SELECT page_id, anc, string_agg(s, '' ORDER BY k) AS s
    FROM (SELECT page_id, k, s, unnest(above) AS anc FROM strings) GROUP BY ALL) t
  ON t.page_id = n.page_id AND t.anc = n.node_id)
"""


def tree(source: str = "pages_plus") -> str:
    """CTEs nodes, strings, page_strings and texts of a page table."""
    body = TREE.replace("@SOURCE@", source).replace("@DECODED@", VISIBLE_DECODED).replace("@STRIP_S@", strip("s.s"))
    before = fixture_ctes(source) + ",\n" if source in FIXTURES else ""
    return "WITH RECURSIVE " + before + body


def has_class(pattern: str, alias: str = "") -> str:
    return f"len(list_filter({alias}classes, lambda c: regexp_matches(c, {quoted(pattern)}))) > 0"


def attr(name: str) -> str:
    """Value of an attribute of the start tag, null when absent."""
    return f"CASE WHEN regexp_matches(head, ' {name}=\"') THEN regexp_extract(head, ' {name}=\"([^\"]*)\"', 1) END"


def preview(expr: str, chars: int = 50) -> str:
    return f"left({strip(expr)}, {chars})"


def count_if(test: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {test}) AS INT)"


COMPONENT_TESTS = {
    "navigation": "tag IN ('nav', 'header')", "forms": "tag = 'form'", "buttons": "tag = 'button'",
    "modals": has_class("modal|popup"), "tables": "tag = 'table'", "iframes": "tag = 'iframe'",
}
FRAMEWORK_TESTS = {
    name: f"coalesce(bool_or(tag = 'script' AND contains(lower(coalesce({attr('src')}, '')), '{name}')), FALSE)"
    for name in V.FRAMEWORKS}
RATIO = "coalesce(round(text_len * 100.0 / nullif(html_len, 0)) / 100.0, 0.0)"
DYNAMIC_NAMES = r"""
attribute_names AS (SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(regexp_replace(head, '="[^"]*"', '=', 'g'),
  ' ((?:data-|aria-|ng-)[a-z-]*)', 1))) AS attribute FROM nodes)"""
LIKELY = ", " + DYNAMIC_NAMES + f""",
likely AS (SELECT p.page_id, f.react OR f.angular OR f.vue OR coalesce(d.n, 0) > 5 OR {RATIO} < 0.1 AS likely_dynamic
  FROM page_strings p
  JOIN (SELECT page_id, {", ".join(f"{t} AS {n}" for n, t in FRAMEWORK_TESTS.items())} FROM nodes GROUP BY page_id) f
    ON f.page_id = p.page_id
  LEFT JOIN (SELECT page_id, count(*) AS n FROM attribute_names GROUP BY page_id) d ON d.page_id = p.page_id)"""
KEYWORDS = r"""
words AS (SELECT page_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT page_id, regexp_extract_all(lower(body), '[\p{L}\p{N}_]{4,}') AS ws FROM page_strings)),
keywords AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, pos) AS rank, word, n
  FROM (SELECT page_id, word, count(*) AS n, min(pos) AS pos FROM words GROUP BY ALL) QUALIFY rank <= 20)"""
PATTERNS = f"""
content AS (
  SELECT p.page_id, p.node_id, 0 AS part, p.selector, k.tag AS child_tag, p.n_children AS n,
    CASE WHEN k.classed THEN 'high' ELSE 'medium' END AS confidence
  FROM nodes p JOIN (
    SELECT page_id, parent_id, min(tag) AS tag, count(DISTINCT tag) AS n_tags, bool_and(len(classes) > 0) AS classed,
      list(classes ORDER BY elem_idx) AS cl, max(subtree_end - node_id) - min(subtree_end - node_id) AS spread
    FROM nodes WHERE elem_idx <= 3 GROUP BY ALL HAVING count(*) = 3) k
  ON k.page_id = p.page_id AND k.parent_id = p.node_id
  WHERE p.tag IN {in_list(V.PATTERN_PARENT_TAGS)} AND n_tags = 1 AND spread <= 2
    AND (NOT classed OR len(list_intersect(list_intersect(cl[1], cl[2]), cl[3])) > 0)),
listed AS (
  SELECT p.page_id, c.node_id, 1 AS part, p.selector, 'li' AS child_tag, c.tag_total AS n, 'high' AS confidence
  FROM nodes c JOIN nodes p ON p.page_id = c.page_id AND p.node_id = c.parent_id
  WHERE c.tag = 'li' AND c.tag_idx = 1 AND c.tag_total >= 5),
patterns AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY part, node_id) - 1 AS INT) AS ord
  FROM (SELECT * FROM content UNION ALL SELECT * FROM listed))"""
PATTERN_COLUMNS = ("selector AS parent_selector, selector || ' > ' || child_tag AS child_selector, "
                   "CAST(n AS INT) AS count, confidence")


def ordinal(order: str, by: str = "page_id") -> str:
    return f"CAST(row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS INT)"


def heuristics() -> str:
    branches = []
    for i, (name, tags, class_re, more_than, sample, selector) in enumerate(V.HEURISTICS):
        tests = ([f"tag IN {in_list(tags)}"] if tags else []) + ([has_class(class_re)] if class_re else [])
        branches.append(f"""SELECT page_id, {i} AS i, {quoted(name)} AS pattern, {quoted(selector)} AS selector,
  coalesce(string_agg(p, '|' ORDER BY node_id) FILTER (WHERE rn <= {sample} AND p <> ''), '') AS sample,
  CAST(count(*) AS INT) AS count
  FROM (SELECT n.page_id, n.node_id, {preview('txt')} AS p,
    row_number() OVER (PARTITION BY n.page_id ORDER BY n.node_id) AS rn
    FROM nodes n JOIN texts t USING (page_id, node_id) WHERE {' AND '.join(tests)}) GROUP BY page_id
  HAVING count(*) > {more_than}""")
    return "hits AS (" + "\nUNION ALL\n".join(branches) + ")"


STRATEGIES = f"""
targets AS (SELECT * FROM (SELECT *, {ordinal('node_id')} AS target FROM nodes
  WHERE tag IN {in_list(V.STRATEGY_TAGS)} AND {has_class(V.STRATEGY_CLASS)}) WHERE target < 5),
sole AS (SELECT n.page_id, n.node_id, min(s.s) AS s FROM nodes n
  JOIN (SELECT page_id, k, s, unnest(above) AS anc FROM strings) s ON s.page_id = n.page_id AND s.anc = n.node_id
  WHERE n.n_children = 0 GROUP BY ALL HAVING count(*) = 1),
uses AS (SELECT t.page_id, t.node_id, count(*) AS n FROM targets t JOIN nodes m ON m.page_id = t.page_id
  AND len(list_intersect(list_distinct(t.classes), m.classes)) = len(list_distinct(t.classes)) GROUP BY ALL),
candidates AS (
  SELECT page_id, node_id, target, tag, 0.9 AS score, 0 AS ord, 0 AS pos, '#' || id AS selector, 'id' AS method,
    NULL AS count FROM targets WHERE id IS NOT NULL
  UNION ALL SELECT page_id, node_id, target, tag, CASE WHEN n < 5 THEN 0.8 WHEN n < 20 THEN 0.6 ELSE 0.4 END, 1, 0,
    '.' || array_to_string(classes, '.'), 'class', n FROM targets JOIN uses USING (page_id, node_id)
  UNION ALL SELECT t.page_id, t.node_id, target, t.tag, CASE WHEN p.id IS NOT NULL THEN 0.8 ELSE 0.7 END,
    CASE WHEN p.id IS NOT NULL THEN 2 ELSE 3 END, 0,
    coalesce('#' || p.id, '.' || array_to_string(p.classes, '.')) || ' > ' || t.tag || ':nth-child(' || t.tag_idx || ')',
    CASE WHEN p.id IS NOT NULL THEN 'parent-child-id' ELSE 'parent-child-class' END, NULL
    FROM targets t JOIN nodes p ON p.page_id = t.page_id AND p.node_id = t.parent_id
    WHERE p.id IS NOT NULL OR len(p.classes) > 0
  UNION ALL SELECT page_id, node_id, target, tag, 0.5, 4, 0, tag || ':contains(''' || left({strip('s')}, 20) || ''')',
    'text-content', NULL FROM targets JOIN sole USING (page_id, node_id) WHERE length({strip('s')}) > 10
  UNION ALL SELECT page_id, node_id, target, tag, 0.7, 5, pos, tag || '[' || a || '=''' || v || ''']', 'attribute', NULL
    FROM (SELECT *, unnest(regexp_extract_all(head, ' ([a-z-]+)="', 1)) AS a,
      unnest(regexp_extract_all(head, '="([^"]*)"', 1)) AS v,
      generate_subscripts(regexp_extract_all(head, ' ([a-z-]+)="', 1), 1) AS pos FROM targets)
    WHERE a NOT IN ('class', 'id', 'style') AND length(v) < 50)"""
BUTTONISH = (f"tag = 'button' OR coalesce({attr('role')} = 'button', FALSE) OR list_contains(classes, 'btn') OR "
             f"(tag = 'a' AND coalesce({attr('href')} = '#', FALSE)) OR coalesce(contains({attr('class')}, 'load'), FALSE) "
             f"OR coalesce(contains({attr('class')}, 'more'), FALSE)")
INTERACTIVE = f"""
class_uses AS (SELECT page_id, c, count(DISTINCT node_id) AS n
  FROM (SELECT page_id, node_id, unnest(classes) AS c FROM nodes) GROUP BY ALL),
rare AS (SELECT page_id, node_id, min_by(c, pos) AS c FROM (SELECT page_id, node_id, unnest(classes) AS c,
  generate_subscripts(classes, 1) AS pos FROM nodes) JOIN class_uses USING (page_id, c) WHERE n < 5 GROUP BY ALL),
pagers AS (SELECT page_id, node_id, subtree_end FROM nodes WHERE coalesce(contains({attr('class')}, 'pag'), FALSE)),
chosen AS (
  SELECT n.page_id, n.node_id, 0 AS part, 'button' AS type FROM nodes n JOIN texts t USING (page_id, node_id)
    WHERE ({BUTTONISH}) AND regexp_matches(txt, '(?i){V.LOADING_BUTTON_TEXT}')
  UNION ALL SELECT page_id, node_id, 1, 'pagination' FROM nodes n
    WHERE coalesce(contains({attr('aria-label')}, 'page'), FALSE) OR (tag = 'a' AND EXISTS (SELECT 1 FROM pagers g
      WHERE g.page_id = n.page_id AND g.node_id < n.node_id AND n.node_id <= g.subtree_end))),
interactive AS (SELECT n.page_id, {ordinal('part, n.node_id', 'n.page_id')} AS ord,
  coalesce('#' || n.id, '.' || r.c, '#' || p.id || ' > ' || n.tag || ':nth-child(' || n.elem_idx || ')', n.tag) AS selector,
  {preview('t.txt', 30)} AS text, ch.type
  FROM chosen ch JOIN nodes n USING (page_id, node_id) JOIN texts t USING (page_id, node_id)
  LEFT JOIN rare r USING (page_id, node_id)
  LEFT JOIN nodes p ON p.page_id = n.page_id AND p.node_id = n.parent_id)"""
SUGGESTIONS = f"""
long_ids AS (SELECT page_id, string_agg(id, ', #' ORDER BY node_id) AS ids FROM (SELECT n.page_id, n.node_id, n.id,
  row_number() OVER (PARTITION BY n.page_id ORDER BY n.node_id) AS rn FROM nodes n JOIN texts t USING (page_id, node_id)
  WHERE id IS NOT NULL AND length(txt) > 100) WHERE rn <= 5 GROUP BY page_id),
main_names AS (SELECT page_id, node_id, 0 AS pos, '#' || id AS name FROM nodes
    WHERE tag IN {in_list(V.SUGGESTION_TAGS)} AND regexp_matches(coalesce(id, ''), {quoted(V.SUGGESTION_PATTERN)})
  UNION ALL SELECT page_id, node_id, pos, '.' || c FROM (SELECT page_id, node_id, id, tag, unnest(classes) AS c,
    generate_subscripts(classes, 1) AS pos FROM nodes) WHERE tag IN {in_list(V.SUGGESTION_TAGS)}
    AND NOT regexp_matches(coalesce(id, ''), {quoted(V.SUGGESTION_PATTERN)})
    AND regexp_matches(c, {quoted(V.SUGGESTION_PATTERN)})),
suggestions AS (SELECT page_id, {ordinal('part')} AS ord, suggestion FROM (
  SELECT page_id, 0 AS part, 'High-content IDs: #' || ids AS suggestion FROM long_ids
  UNION ALL SELECT page_id, 1, 'Main content containers: ' || string_agg(name, ', ' ORDER BY node_id, pos) FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY node_id, pos) AS rn FROM main_names)
    WHERE rn <= 5 GROUP BY page_id))"""
SIGNALS = f"""
signals AS (SELECT page_id, {ordinal('i')} AS ord, signal FROM (
  SELECT DISTINCT page_id, 0 AS i, 'page_numbers' AS signal FROM placed
    WHERE kind IN ('text', 'comment', 'leaf') AND regexp_matches(CASE WHEN kind = 'text' THEN {VISIBLE_DECODED} ELSE
      regexp_replace(tok, '^<[^>]*>', '') END, 'Page \\p{{Nd}}+')
  UNION ALL SELECT DISTINCT page_id, 1, 'next_buttons' FROM nodes
    WHERE regexp_matches(coalesce({attr('href')}, ''), 'page|next')
  UNION ALL SELECT DISTINCT page_id, 2, 'data_attributes' FROM nodes WHERE regexp_matches(head, ' data-page[= >]')))"""
MEASURES = f"""SELECT p.page_id, p.html_len, p.text_len, n.* EXCLUDE (page_id) FROM page_strings p JOIN (SELECT page_id,
  {count_if(has_class(V.SNAPSHOT_CONTAINER_CLASS))} AS n_containers,
  {count_if(f"tag IN {in_list(V.SNAPSHOT_ITEM_TAGS)} AND {has_class(V.SNAPSHOT_ITEM_CLASS)}")} AS n_items,
  {count_if("tag = 'form'")} AS forms, {count_if("tag = 'table'")} AS tables, {count_if("tag = 'iframe'")} AS iframes,
  {count_if("tag = 'button'")} AS buttons,
  {count_if(f"tag = 'button' OR list_contains(classes, 'btn') OR coalesce({attr('role')} = 'button', FALSE)")} AS clickables
  FROM nodes GROUP BY page_id) n USING (page_id)"""


def outline() -> str:
    return f"""
body AS (SELECT page_id, min(node_id) AS node_id FROM nodes WHERE tag = 'body' GROUP BY page_id),
inside AS (SELECT n.*, n.depth - b.depth AS level, b.node_id AS body_id FROM nodes n
  JOIN (SELECT n.* FROM nodes n JOIN body USING (page_id, node_id)) b ON b.page_id = n.page_id
  AND n.node_id BETWEEN b.node_id AND b.subtree_end),
late AS (SELECT i.page_id, i.node_id, count(*) AS n FROM (SELECT page_id, node_id, unnest(above) AS anc, body_id FROM inside) i
  JOIN nodes a ON a.page_id = i.page_id AND a.node_id = i.anc WHERE a.node_id > i.body_id AND a.elem_idx > 10 GROUP BY ALL),
lines AS (
  SELECT i.page_id, i.node_id, repeat(' ', CAST(level AS INT)) || '|_ ' || CASE WHEN level > 0 AND i.elem_idx = 11
    THEN '... (' || (p.n_children - 10) || ' more)' ELSE i.tag || coalesce('#' || i.id, '') ||
      CASE WHEN len(i.classes) > 0 THEN '.' || array_to_string(i.classes, '.') ELSE '' END END AS line
  FROM inside i LEFT JOIN nodes p ON p.page_id = i.page_id AND p.node_id = i.parent_id
  LEFT JOIN late l ON l.page_id = i.page_id AND l.node_id = i.node_id
  WHERE l.n IS NULL AND (level = 0 OR (level <= 3 AND i.elem_idx <= 11) OR (level = 4 AND i.elem_idx = 11)))"""


def page_queries() -> dict[str, str]:
    plus, plain = tree(), tree("pages")
    node = "page_id, node_id, tag"
    best = ("SELECT page_id, " + PATTERN_COLUMNS + " FROM patterns QUALIFY row_number() OVER (PARTITION BY page_id "
            "ORDER BY n DESC, ord) = 1")
    return {
        "dom_nodes": plus + """SELECT page_id, node_id, parent_id, CAST(depth AS INT) AS depth, tag,
            CAST(elem_idx AS INT) AS elem_idx, CAST(n_children AS INT) AS n_children, subtree_end, id,
            array_to_string(classes, ' ') AS classes FROM nodes""",
        "dom_tag_counts": plain + "SELECT page_id, tag, count(*) AS n FROM nodes GROUP BY ALL",
        "page_text": plain + "SELECT page_id, CAST(length(body) AS INT) AS n_chars, md5(body) AS digest FROM page_strings",
        "select_by_class": plus + f"""SELECT {node} FROM nodes WHERE tag IN ('div', 'li', 'span')
            AND {has_class('item|card|price')}""",
        "select_by_attribute": plus + f"SELECT {node} FROM nodes WHERE regexp_matches({attr('href')}, 'page|next')",
        "node_text": plus + f"""SELECT {node}, txt AS text, {preview('txt')} AS preview FROM nodes
            JOIN texts USING (page_id, node_id) WHERE tag IN ('div', 'li', 'h1', 'nav')""",
        "css_selector": plus + "SELECT page_id, node_id, selector FROM nodes",
        "structured_data": plus + f"""SELECT page_id, {ordinal('node_id')} AS ord, j->>'$."@type"' AS type,
            CAST(j->>'$.n' AS BIGINT) AS n FROM (SELECT page_id, node_id, txt AS j FROM nodes
            JOIN texts USING (page_id, node_id) WHERE tag = 'script' AND {attr('type')} = 'application/ld+json'
            AND json_valid(txt))""",
        "frameworks": plus + "SELECT page_id, " + ", ".join(
            f"{t} AS {n}" for n, t in FRAMEWORK_TESTS.items()) + " FROM nodes GROUP BY page_id",
        "parent_child": plus + """SELECT p.page_id, p.node_id AS parent_id, p.tag AS parent_tag,
            CAST(p.n_children AS INT) AS n_children, c.node_id AS child_id, c.tag AS child_tag,
            CAST(c.elem_idx AS INT) AS child_order, c.subtree_end - c.node_id AS n_descendants
            FROM nodes p JOIN nodes c ON c.page_id = p.page_id AND c.parent_id = p.node_id""",
        "has_ancestor": plus + f"""SELECT {node} FROM nodes n WHERE tag = 'a' AND EXISTS (SELECT 1 FROM nodes a
            WHERE a.page_id = n.page_id AND list_contains(n.above, a.node_id)
            AND (a.tag = 'ul' OR {has_class('pag', 'a.')}))""",
        "sibling_position": plus + """SELECT page_id, node_id, parent_id, tag, CAST(tag_idx AS INT) AS tag_idx,
            CAST(elem_idx AS INT) AS elem_idx FROM nodes""",
        "components": plus + "SELECT page_id, " + ", ".join(
            f"{count_if(t)} AS {n}" for n, t in COMPONENT_TESTS.items()) + " FROM nodes GROUP BY page_id",
        "content_hierarchy": plus + "SELECT page_id, " + ", ".join(
            f"""{count_if(f"tag = '{tag}'")} AS {tag}""" for tag in V.SEMANTIC_TAGS) + f""",
            {count_if(has_class(V.CONTENT_CONTAINER_CLASS))} AS content_containers FROM nodes GROUP BY page_id""",
        "text_ratio": plain + f"""SELECT page_id, CAST(text_len AS INT) AS text_length, CAST(html_len AS INT) AS html_len,
            {RATIO} AS text_ratio FROM page_strings""",
        "keyword_density": plain + "," + KEYWORDS + """ SELECT page_id, CAST(rank AS INT) AS rank, word,
            CAST(n AS INT) AS n FROM keywords""",
        "seo_meta": plus + f"""SELECT page_id, key, arg_max_null(content, node_id) AS content FROM (SELECT page_id, node_id,
            coalesce(nullif({attr('name')}, ''), nullif({attr('property')}, ''), nullif({attr('itemprop')}, '')) AS key,
            {attr('content')} AS content FROM nodes WHERE tag = 'meta') WHERE key IS NOT NULL GROUP BY ALL""",
        "dynamic_attributes": plus + "," + DYNAMIC_NAMES + " SELECT page_id, attribute FROM attribute_names",
        "pagination_patterns": plus + "," + SIGNALS + " SELECT page_id, ord, signal FROM signals",
        "extraction_heuristics": plus + "," + heuristics() + """ SELECT page_id, CAST(row_number() OVER (
            PARTITION BY page_id ORDER BY count DESC, i) AS INT) AS rank, pattern, selector, sample, count FROM hits""",
        "content_patterns": plus + "," + PATTERNS + f""" SELECT page_id, {ordinal('node_id')} AS ord,
            {PATTERN_COLUMNS} FROM content""",
        "list_patterns": plus + "," + PATTERNS + f""" SELECT page_id, {ordinal('node_id')} AS ord,
            {PATTERN_COLUMNS} FROM listed""",
        "all_patterns": plus + "," + PATTERNS + f" SELECT page_id, ord, {PATTERN_COLUMNS} FROM patterns",
        "best_pattern": plus + "," + PATTERNS + best,
        "dom_outline": plus + "," + outline() + f""" SELECT page_id, {ordinal('node_id')} AS line_no, line FROM lines""",
        "selector_strategies": plus + "," + STRATEGIES + """ SELECT page_id, target, tag AS element,
            CAST(row_number() OVER (PARTITION BY page_id, target ORDER BY score DESC, ord, pos) AS INT) AS rank, selector,
            CAST(score AS DOUBLE) AS reliability, method, CAST(count AS INT) AS count FROM candidates
            QUALIFY row_number() OVER (PARTITION BY page_id, target ORDER BY score DESC, ord, pos) <= 3""",
        "selector_suggestions": plus + "," + SUGGESTIONS + " SELECT page_id, ord, suggestion FROM suggestions",
        "interactive_elements": plus + "," + INTERACTIVE + " SELECT page_id, ord, selector, text, type FROM interactive",
        "template_selectors": plus + " UNION ALL ".join(
            f"""SELECT page_id, '{role}' AS role, min_by(selector, node_id) AS selector FROM nodes
            WHERE tag IN {in_list(tags)} AND {has_class(pattern)} GROUP BY page_id"""
            for role, tags, pattern in V.TEMPLATE_ROLES),
        "likely_dynamic": plus + LIKELY + " SELECT page_id, likely_dynamic FROM likely",
        "site_archetype": plus + LIKELY + "," + KEYWORDS + """ SELECT l.page_id, CASE WHEN likely_dynamic
            THEN 'dynamic_content' WHEN shop THEN 'e-commerce' WHEN news THEN 'news' ELSE 'dynamic_content' END AS archetype
            FROM likely l LEFT JOIN (SELECT page_id, bool_or(regexp_matches(word, 'product|price|shop|cart|store|buy')) AS shop,
            bool_or(regexp_matches(word, 'article|news|post|blog|story')) AS news FROM keywords GROUP BY page_id) k
            USING (page_id)""",
    }


def snapshot_sql(columns: str) -> str:
    static, rendered = (f"({tree(name)} {MEASURES})" for name in ("pages_plus", "pages_rendered"))
    return f"""SELECT page_id, {columns} FROM {static} s JOIN {rendered} r USING (page_id)"""


GROWN = ("CASE WHEN r.html_len > s.html_len * 1.2 THEN 'html' WHEN r.text_len > s.text_len * 1.2 THEN 'text' "
         "WHEN r.n_containers > s.n_containers * 1.2 THEN 'containers' WHEN r.n_items > s.n_items * 1.1 THEN 'items' END")
LARGER = ("greatest(s.forms, r.forms) AS forms, greatest(s.tables, r.tables) AS tables, "
          "greatest(s.iframes, r.iframes) AS iframes, greatest(s.buttons, r.clickables) AS buttons")

ROBOTS = """SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/robots.txt' AS robots_url,
  CASE WHEN error IS NOT NULL THEN 'Error fetching' WHEN status = 200 THEN body ELSE 'Not found' END AS robots_txt,
  CASE WHEN error IS NOT NULL THEN 'Could not fetch robots.txt: ' || error END AS warning
  FROM pages LEFT JOIN robots ON host = regexp_extract(url, 'https?://([^/]+)', 1)"""
HEADERS = "SELECT p.page_id, " + ", ".join(
    f"max(CASE WHEN lower(name) = '{h.lower()}' THEN value END) AS {h.lower().replace('-', '_')}"
    for h in V.SECURITY_HEADERS) + " FROM pages p LEFT JOIN response_headers h ON h.page_id = p.page_id GROUP BY p.page_id"
API_CALLS = """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY seq) AS INT) AS rank, url, method
  FROM resource_log WHERE resource_type IN ('xhr', 'fetch') QUALIFY rank <= 10"""
PERFORMANCE = """SELECT p.page_id, coalesce(nav_load_end, timing_load_end - navigation_start, 0) AS load_time,
  coalesce(nav_dom_end, timing_dom_end - navigation_start, 0) AS dom_content_loaded,
  CAST(length(html) AS INT) AS dom_size, coalesce(r.n, 0) AS resource_count, coalesce(r.x, 0) AS ajax_count
  FROM pages p LEFT JOIN navigation n ON n.page_id = p.page_id LEFT JOIN (SELECT page_id, count(*) AS n,
  count(*) FILTER (WHERE initiator_type = 'xmlhttprequest') AS x FROM resource_log GROUP BY page_id) r
  ON r.page_id = p.page_id WHERE n.page_id IS NOT NULL OR r.page_id IS NOT NULL"""
AGE = f"({NOW} - coalesce(cache_time, 0))"
EXPIRED = f"(NOT readable OR {AGE} >= 86400)"
CACHE = "cache_key, url, cache_time, size_bytes, readable, version, analysis"
NEWEST = "row_number() OVER (PARTITION BY cache_key ORDER BY coalesce(cache_time, 0) DESC, version DESC) = 1"

REJECT = """CASE WHEN url IS NULL THEN 'missing url' WHEN NOT regexp_matches(url, '(?i)^https?:') THEN
  'url is not http or https' WHEN NOT regexp_matches(url, '(?i)^https?://[^/?#]+') THEN 'url has no host'
  WHEN expected_data IS NULL THEN 'missing expected_data' WHEN llm_model IS NULL THEN 'missing llm_model' END"""


# Fields read back from a stored analysis.
STORED_FIELDS = f"""SELECT p.page_id, {RATIO} AS text_ratio, navigation, CAST(coalesce(k.n, 0) AS INT) AS n_patterns
  FROM page_strings p JOIN (SELECT page_id, {count_if(COMPONENT_TESTS["navigation"])} AS navigation FROM nodes GROUP BY page_id) c
  USING (page_id) LEFT JOIN (SELECT page_id, count(*) AS n FROM patterns GROUP BY page_id) k USING (page_id)"""


def source_queries() -> dict[str, str]:
    return {
        "page_scan": "SELECT page_id, url, CAST(length(html) AS INT) AS html_len FROM pages",
        "request_valid": over("requests") + f"SELECT * FROM requests WHERE {REJECT} IS NULL",
        "request_rejected": over("requests") + f"""SELECT request_id, {REJECT} AS reject_reason FROM requests
            WHERE {REJECT} IS NOT NULL""",
        "robots_lookup": over("robots") + ROBOTS,
        "security_headers": over("response_headers") + HEADERS,
        "cache_fresh": over("analysis_cache") + f"""SELECT {CACHE} FROM (SELECT * FROM analysis_cache QUALIFY {NEWEST})
            WHERE readable AND {AGE} < 86400""",
        "cache_upsert": over("analysis_cache", "analysis_cache_new") + f"""SELECT {CACHE} FROM (SELECT * FROM analysis_cache
            UNION ALL SELECT * FROM analysis_cache_new) QUALIFY {NEWEST}""",
        "cache_store_upsert": over("analysis_cache", "analysis_cache_new") + f"""SELECT {CACHE} FROM (SELECT * FROM analysis_cache
            UNION ALL SELECT * FROM analysis_cache_new) QUALIFY {NEWEST}""",
        "cache_store_fresh": over("analysis_cache") + f"""SELECT {CACHE} FROM (SELECT * FROM analysis_cache QUALIFY {NEWEST})
            WHERE readable AND {AGE} < 86400""",
        "cache_clear_urls": over("analysis_cache", "analysis_cache_new") + f"""SELECT {CACHE} FROM analysis_cache c
            WHERE NOT EXISTS (SELECT 1 FROM analysis_cache_new n WHERE n.url = c.url)""",
        "cache_expire_kept": over("analysis_cache") + f"SELECT {CACHE} FROM analysis_cache WHERE NOT {EXPIRED}",
        "cache_expire_count": over("analysis_cache") + f"""SELECT count(*) FILTER (WHERE {EXPIRED}) AS removed
            FROM analysis_cache""",
        "cache_stats": over("analysis_cache") + f"""SELECT count(*) AS total_entries,
            count(*) FILTER (WHERE {EXPIRED}) AS expired_entries, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
            round(sum({AGE}) FILTER (WHERE readable) / count(*) / 3600, 6) AS average_age_hours FROM analysis_cache""",
        "json_rows": over("attempt_log") + """SELECT CAST(to_json(struct_pack(request_id, attempt_no, success, code, stdout))
            AS VARCHAR) AS value FROM attempt_log""",
        "access_log_filter": over("access_log") + """SELECT * FROM access_log
            WHERE NOT (n_args >= 3 AND contains(path, '/api/status/'))""",
        "page_performance": over("resource_log", "navigation") + PERFORMANCE,
        "api_calls": over("resource_log") + API_CALLS,
        "snapshot_diff": snapshot_sql(f"""{GROWN} IS NOT NULL AS is_dynamic, {GROWN} AS grown_by, {LARGER},
            r.forms > s.forms * 1.5 OR r.tables > s.tables * 1.5 OR r.iframes > s.iframes * 1.5
            OR r.clickables > s.buttons * 1.5 AS grew_50pct"""),
        **dict.fromkeys(("incremental_analysis", "incremental_bucketed"), tree("pages") + "," + PATTERNS + ", " + fixture_ctes("analysis_cache") + f""",
            live AS (SELECT * FROM (SELECT * FROM analysis_cache QUALIFY {NEWEST}) WHERE readable AND {AGE} < 86400),
            a AS ({STORED_FIELDS})
            SELECT page_id, CASE WHEN l.cache_key IS NULL THEN 'fresh' ELSE 'cache' END AS origin, analysis AS stored,
              CASE WHEN l.cache_key IS NULL THEN text_ratio END AS text_ratio,
              CASE WHEN l.cache_key IS NULL THEN navigation END AS navigation,
              CASE WHEN l.cache_key IS NULL THEN n_patterns END AS n_patterns
            FROM a JOIN pages p USING (page_id) LEFT JOIN live l ON l.cache_key = md5(p.url)"""),
        "stream_page_analysis": tree("pages") + "," + PATTERNS + " " + STORED_FIELDS,
    }


# -- whole analysis ------------------------------------------------------------------------------
def advice_sql() -> str:
    """Ordered recommendation lines of every page, from the page features and the context tables."""
    tests = {
        0: ("TRUE", "CASE WHEN likely_dynamic THEN 'Use Playwright/Selenium for JavaScript rendering' ELSE "
                    "'Static content: Use Requests + BeautifulSoup for efficient scraping' END"),
        1: ("likely_dynamic AND (react OR angular OR vue)", "concat_ws(', ', CASE WHEN react THEN 'React' END, CASE WHEN "
            "angular THEN 'Angular' END, CASE WHEN vue THEN 'Vue' END) || ' framework detected: Wait for dynamic content to load'"),
        2: ("forms > 0", "'Found ' || forms || ' forms: Consider form submission handling'"),
        3: ("tables > 0", "'Found ' || tables || ' tables: Use pandas for structured data extraction'"),
        4: ("secured", "'Security headers detected: Consider using proper headers in requests'"),
        5: ("paginated", "'Pagination detected: Implement pagination handling'"),
        6: ("pagers > 0", "'Interactive pagination detected: Implement pagination navigation'"),
        7: ("buttons > 0 AND loads_more",
            "'Load more functionality detected: Implement click interaction to get all content'"),
        8: ("child_selector IS NOT NULL", "'Repeating content pattern detected: Use selector ''' || child_selector || "
            "''' for content items'"),
        9: ("pattern IS NOT NULL", "'Extraction pattern ''' || pattern || ''' found ' || count || ' items with selector ''' "
            "|| selector || ''''"),
    }
    lines = " UNION ALL ".join(
        f"SELECT page_id, {i} AS part, 0 AS pos, {text} AS recommendation FROM facts WHERE {test}"
        for i, (test, text) in tests.items())
    lines += " UNION ALL SELECT page_id, 10, ord, 'Selector suggestion: ' || suggestion FROM suggestions"
    return f"""
frame AS (SELECT page_id, {", ".join(f"{t} AS {n}" for n, t in FRAMEWORK_TESTS.items())},
  {count_if("tag = 'form'")} AS forms, {count_if("tag = 'table'")} AS tables FROM nodes GROUP BY page_id),
best AS (SELECT page_id, {PATTERN_COLUMNS} FROM patterns QUALIFY row_number() OVER (PARTITION BY page_id
  ORDER BY n DESC, ord) = 1),
top_hit AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY count DESC, i) = 1),
facts AS (SELECT f.page_id, l.likely_dynamic, f.react, f.angular, f.vue, f.forms, f.tables,
    h.content_security_policy IS NOT NULL OR h.x_frame_options IS NOT NULL OR h.strict_transport_security IS NOT NULL AS secured,
    s.page_id IS NOT NULL AS paginated, coalesce(e.pagers, 0) AS pagers, coalesce(e.buttons, 0) AS buttons,
    coalesce(e.loads_more, FALSE) AS loads_more, b.child_selector, t.pattern, t.count, t.selector
  FROM frame f JOIN likely l USING (page_id) LEFT JOIN ({HEADERS}) h USING (page_id)
  LEFT JOIN (SELECT DISTINCT page_id FROM signals) s USING (page_id)
  LEFT JOIN (SELECT page_id, count(*) FILTER (WHERE type = 'pagination') AS pagers,
    count(*) FILTER (WHERE type = 'button') AS buttons, bool_or(regexp_matches(lower(text), 'load|more')) AS loads_more
    FROM interactive GROUP BY page_id) e USING (page_id)
  LEFT JOIN best b USING (page_id) LEFT JOIN top_hit t USING (page_id)),
advice AS ({lines})"""


def brief_sql() -> str:
    """The lines of every page's brief, numbered by section."""
    def counted(names, prefix=""):
        return "concat_ws(', ', " + ", ".join(
            f"CASE WHEN {prefix}{n} > 0 THEN '{n} (' || {prefix}{n} || ')' END" for n in names) + ")"

    def bullets(part, label, table, order, limit, text):
        return f"""SELECT page_id, {part}, '- {label}: ' || string_agg(chr(10) || '  * ' || {text}, '' ORDER BY {order})
            FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS nth FROM {table})
            WHERE nth <= {limit} GROUP BY page_id"""

    def row(part, label, table, order, limit, text):
        return f"""SELECT page_id, {part}, '- {label}: ' || string_agg({text}, ', ' ORDER BY {order})
            FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS nth FROM {table})
            WHERE nth <= {limit} GROUP BY page_id"""

    headers = " UNION ALL ".join(
        f"SELECT page_id, {i} AS pos, '{h}' AS name FROM ({HEADERS}) WHERE {h.lower().replace('-', '_')} IS NOT NULL"
        for i, h in enumerate(V.SECURITY_HEADERS))
    roles = " UNION ALL ".join(
        f"""SELECT page_id, {i} AS pos, '{role}: ' || min_by(selector, node_id) AS name FROM nodes
            WHERE tag IN {in_list(tags)} AND {has_class(pattern)} GROUP BY page_id"""
        for i, (role, tags, pattern) in enumerate(V.TEMPLATE_ROLES))
    hierarchy = [*V.SEMANTIC_TAGS, "content_containers"]
    structure = ", ".join([f"""{count_if(f"tag = '{tag}'")} AS {tag}""" for tag in V.SEMANTIC_TAGS]
                          + [f"{count_if(has_class(V.CONTENT_CONTAINER_CLASS))} AS content_containers"])
    flags = "concat_ws(', ', " + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in V.FRAMEWORKS) + ")"
    return f"""
sections AS (
  SELECT page_id, 1 AS part, '- Dynamic content: ' || CASE WHEN likely_dynamic THEN 'Yes' ELSE 'No' END AS line FROM likely
  UNION ALL SELECT page_id, 2, '- Components detected: ' || {counted(COMPONENT_TESTS)} FROM (SELECT page_id,
    {", ".join(f"{count_if(t)} AS {n}" for n, t in COMPONENT_TESTS.items())} FROM nodes GROUP BY page_id)
  UNION ALL SELECT page_id, 3, '- Frameworks: ' || coalesce(nullif({flags}, ''), 'None detected') FROM frame
  UNION ALL SELECT page_id, 4, '- Text ratio: ' || printf('%.2f', {RATIO}) FROM page_strings
  UNION ALL SELECT page_id, 5, '- Language: ' || coalesce(nullif(language, ''), 'Not detected') FROM languages
  UNION ALL SELECT page_id, 6, '- Content structure: ' || {counted(hierarchy)}
    FROM (SELECT page_id, {structure} FROM nodes GROUP BY page_id)
  UNION ALL {bullets(7, 'Technical recommendations', 'advice', 'part, pos', 5, 'recommendation')}
  UNION ALL {bullets(8, 'Suggested selectors', 'suggestions', 'ord', 3, 'suggestion')}
  UNION ALL {bullets(9, 'Content patterns detected', 'patterns', 'n DESC, ord', 3,
                     "selector || ' > ' || child_tag || ' (' || n || ' items, ' || confidence || ' confidence)'")}
  UNION ALL SELECT page_id, 10, '- Best extraction pattern: ' || pattern || ' using ''' || selector || ''' found ' || count
    || ' items' FROM top_hit
  UNION ALL SELECT page_id, 11, '- Interactive buttons detected: ' || count(*) || ' (e.g., ' || min_by(text, ord) || ')'
    FROM interactive WHERE type = 'button' GROUP BY page_id
  UNION ALL SELECT page_id, 12, '- Pagination elements detected: ' || count(*) FROM interactive WHERE type = 'pagination'
    GROUP BY page_id
  UNION ALL {row(13, 'Pagination detected', 'signals', 'ord', 3, 'signal')}
  UNION ALL SELECT page_id, 14, '- Dynamic attributes: ' || string_agg(attribute, ', ' ORDER BY attribute)
    FILTER (WHERE nth <= 5) || CASE WHEN count(*) > 5 THEN '...' ELSE '' END FROM (SELECT *, row_number() OVER (
    PARTITION BY page_id ORDER BY attribute) AS nth FROM attribute_names) GROUP BY page_id
  UNION ALL SELECT page_id, 15, '- APIs detected: ' || count(*) FROM ({API_CALLS}) GROUP BY page_id
  UNION ALL SELECT page_id, 16, '- Load time: ' || CASE WHEN load_time = floor(load_time)
    THEN CAST(CAST(load_time AS BIGINT) AS VARCHAR) ELSE CAST(round(load_time, 3) AS VARCHAR) END || 'ms' FROM ({PERFORMANCE})
  UNION ALL {row(17, 'Top keywords', 'keywords', 'rank', 5, "word || ' (' || n || ')'")}
  UNION ALL {row(18, 'Security headers', f'({headers})', 'pos', 3, 'name')}
  UNION ALL {bullets(19, 'Recommended selectors for extraction', f'({roles})', 'pos', 4, 'name')})"""


def analysis_lists(everything: str) -> str:
    page = page_queries()

    def gathered(name: str, source: str, text: str, order: str, between: str = "'|'") -> str:
        return f"""LEFT JOIN (SELECT page_id, string_agg({text}, {between} ORDER BY {order}) AS {name} FROM {source} GROUP BY page_id) USING (page_id)"""

    of = lambda *fields: "concat_ws('~', " + ", ".join(fields) + ")"
    lists = {
        "dynamic_attributes": ("attribute_names", "attribute", "attribute"),
        "pagination_patterns": ("signals", "signal", "ord"),
        "selector_suggestions": ("suggestions", "suggestion", "ord"),
        "content_patterns": (f"(SELECT page_id, ord, {PATTERN_COLUMNS} FROM patterns)",
                             of("parent_selector", "child_selector", "count", "confidence"), "ord"),
        "keyword_density": ("keywords", of("word", "n"), "rank"),
        "interactive_elements": ("interactive", of("selector", "text", "type"), "ord"),
        "extraction_test_results": ("hits", of("pattern", "selector", "sample", "count"), "count DESC, i"),
    }
    own = {
        "template_selectors": (f"(SELECT *, list_position({[r[0] for r in V.TEMPLATE_ROLES]}, role) AS pos FROM ({page['template_selectors']}))",
                               of("role", "selector"), "pos"),
        "seo_meta": (f"({page['seo_meta']})", of("key", "content"), "key"),
    }
    strategies = f"""(SELECT page_id, target, concat_ws('~', first(element), string_agg(concat_ws('^', selector, method, count), '~'
        ORDER BY rank)) AS text FROM ({page['selector_strategies']}) GROUP BY page_id, target)"""
    names = [*lists, *own, "selector_strategies", "dom_visualization"]
    return everything + "," + KEYWORDS + "," + outline() + f"""
        SELECT f.*, h.* EXCLUDE (page_id), {", ".join(f"coalesce({n}, '') AS {n}" for n in names)}
        FROM ({page['frameworks']}) f JOIN ({page['content_hierarchy']}) h USING (page_id)
        {" ".join(gathered(n, *v) for n, v in {**lists, **own}.items())}
        {gathered("selector_strategies", strategies, "text", "target")}
        {gathered("dom_visualization", "lines", "line", "node_id", "chr(10)")}"""


def analysis_queries() -> dict[str, str]:
    everything = tree() + LIKELY + "," + ",".join([PATTERNS, heuristics(), SIGNALS, INTERACTIVE, SUGGESTIONS]) + ", " \
        + fixture_ctes("response_headers", "robots", "resource_log", "navigation")
    growth = snapshot_sql(f"{GROWN} IS NOT NULL AS is_dynamic, {LARGER}")
    profiles, languages = language_ctes()
    return {
        "page_brief": everything + "," + ",".join([KEYWORDS, advice_sql(), profiles, f"languages AS ({languages})",
                                                   brief_sql()]) + f"""
            SELECT p.page_id, p.url, {strip("string_agg(line, chr(10) ORDER BY part)")} AS brief
            FROM page_strings p JOIN sections s USING (page_id) GROUP BY ALL""",
        "recommendations": everything + "," + advice_sql() + f"""
            SELECT page_id, {ordinal('part, pos')} AS ord, recommendation FROM advice""",
        "page_analysis_lists": analysis_lists(everything),
        "page_analysis": everything + "," + KEYWORDS + f"""
            SELECT p.page_id, p.url, g.is_dynamic, {RATIO} AS text_ratio, rb.robots_txt,
              CASE WHEN g.is_dynamic THEN 'dynamic_content' WHEN k.shop THEN 'e-commerce' WHEN k.news THEN 'news'
                ELSE 'dynamic_content' END AS archetype,
              c.navigation, g.forms, g.buttons, c.modals, g.tables, g.iframes,
              CAST(coalesce(d.n, 0) AS INT) AS n_attributes, CAST(coalesce(pt.n, 0) AS INT) AS n_patterns,
              CAST(coalesce(i.n, 0) AS INT) AS n_interactive, CAST(a.n AS INT) AS n_apis, m.load_time,
              concat_ws('|', rb.warning, 'Language detection not available') AS warnings
            FROM page_strings p JOIN ({growth}) g USING (page_id)
            JOIN (SELECT page_id, {", ".join(f"{count_if(t)} AS {n}" for n, t in COMPONENT_TESTS.items())}
              FROM nodes GROUP BY page_id) c USING (page_id)
            LEFT JOIN ({ROBOTS}) rb USING (page_id)
            LEFT JOIN (SELECT page_id, bool_or(regexp_matches(word, 'product|price|shop|cart|store|buy')) AS shop,
              bool_or(regexp_matches(word, 'article|news|post|blog|story')) AS news FROM keywords GROUP BY page_id) k
              USING (page_id)
            LEFT JOIN (SELECT page_id, count(*) AS n FROM attribute_names GROUP BY page_id) d USING (page_id)
            LEFT JOIN (SELECT page_id, count(*) AS n FROM patterns GROUP BY page_id) pt USING (page_id)
            LEFT JOIN (SELECT page_id, count(*) AS n FROM interactive GROUP BY page_id) i USING (page_id)
            LEFT JOIN (SELECT page_id, count(*) AS n FROM ({API_CALLS}) GROUP BY page_id) a USING (page_id)
            LEFT JOIN ({PERFORMANCE}) m USING (page_id)""",
    }


# -- language ------------------------------------------------------------------------------------
def language_ctes() -> tuple[str, str]:
    """(profile CTEs, statement giving page_id and language)."""
    profiles = r"""
doc_words AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word
  FROM documents) GROUP BY ALL),
doc_grams AS (SELECT lang, gram, sum(n) AS n FROM (SELECT lang, n, substr(' ' || word || ' ', i, size) AS gram
  FROM doc_words, range(1, 4) s(size), LATERAL range(1, length(word) + 4 - size) r(i)) GROUP BY ALL),
profiles AS (SELECT lang, gram, greatest(CAST(round((ln(n / sum(n) OVER (PARTITION BY lang)) - ln(1e-7)) * 1000) AS BIGINT), 1) AS weight
  FROM doc_grams),
page_words AS (SELECT page_id, unnest(regexp_extract_all(lower(left(body, 1000)), '\p{L}+')) AS word FROM page_strings),
page_grams AS (SELECT page_id, substr(' ' || word || ' ', i, size) AS gram
  FROM page_words, range(1, 4) s(size), LATERAL range(1, length(word) + 4 - size) r(i)),
scores AS (SELECT page_id, lang, sum(weight) AS score FROM page_grams JOIN profiles USING (gram) GROUP BY ALL)"""
    return profiles, r"""SELECT p.page_id, coalesce(lang, '') AS language FROM page_strings p LEFT JOIN (SELECT page_id,
  lang FROM scores QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, lang) = 1) b ON b.page_id = p.page_id"""


def language_queries() -> dict[str, str]:
    profiles, languages = language_ctes()
    return {
        "language_profiles": tree("pages") + "," + profiles
        + " SELECT lang, gram, weight FROM profiles",
        "page_language": tree("pages") + "," + profiles + " " + languages,
    }


# -- extraction jobs -----------------------------------------------------------------------------
CODE_OK = f"(success AND {strip('stdout')} <> '')"


def parsed_sql(text: str) -> tuple[str, str]:
    """(kind, data) expressions of an output text."""
    whole = f"(starts_with({text}, '{{') OR starts_with({text}, '['))"
    inner = f"nullif(regexp_extract({text}, '(?s)(\\{{.*\\}}|\\[.*\\])', 1), '')"
    kind = (f"CASE WHEN {whole} AND json_valid({text}) THEN 'json' WHEN NOT {whole} AND coalesce(json_valid({inner}), FALSE) "
            f"THEN 'embedded_json' ELSE 'text' END")
    return kind, f"CASE WHEN {kind} = 'embedded_json' THEN {inner} ELSE {text} END"


def values_table(rows, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(
        quoted(v) if isinstance(v, str) else repr(v) for v in row) + ")" for row in rows) + f") AS v({columns})"


SCRIPT_TYPE = """CASE WHEN contains(code, 'selenium') OR contains(code, 'webdriver') THEN 'selenium'
  WHEN contains(code, 'playwright') THEN 'playwright' WHEN contains(code, 'scrapy') THEN 'scrapy'
  WHEN contains(code, 'beautifulsoup') OR contains(code, 'bs4') THEN 'beautifulsoup'
  WHEN contains(code, 'requests') THEN 'requests' ELSE 'unknown' END"""
IMPORTS = r"""
lines AS (SELECT doc_id, unnest(string_split(code, chr(10))) AS line FROM code_rows),
imports AS (SELECT DISTINCT doc_id, module FROM (
  SELECT doc_id, regexp_extract(unnest(string_split(regexp_extract(line, '^\s*import\s+(.*)$', 1), ',')), '^\s*(\w+)', 1) AS module
    FROM lines WHERE regexp_matches(line, '^\s*import\s')
  UNION ALL SELECT doc_id, regexp_extract(line, '^\s*from\s+\.*(\w+)', 1) FROM lines
    WHERE regexp_matches(line, '^\s*from\s+\.*\w[\w.]*\s+import')) WHERE module <> '')"""


def job_queries() -> dict[str, str]:
    kind, data = parsed_sql(strip("stdout"))
    out_kind, out_data = parsed_sql("output")
    errors = values_table([(i, *p) for i, p in enumerate(V.ERROR_PATTERNS)],
                          "i, error_type, explanation, recommendation")
    text = "lower(expected_data)"
    types = values_table([(i, w, w) for i, w in enumerate(V.DATA_TYPES)] + [
        (len(V.DATA_TYPES) + i, name, word) for i, (name, words) in enumerate(V.DATA_TYPE_SYNONYMS) for word in words],
        "i, data_type, word")
    verdict = strip(f"upper({strip('response')})")
    issue = ", ".join(f"{quoted(v)} AS {c}" for v, c in zip(
        V.TIMEOUT_ISSUE, ("error_type", "explanation", "recommendation")))
    return {
        "classify_errors": over("attempt_log") + f"""SELECT request_id, attempt_no,
            {ordinal('i', 'request_id, attempt_no')} AS ord, error_type, explanation, recommendation
            FROM attempt_log JOIN {errors} ON contains(lower(stderr), lower(error_type))""",
        "timeout_issues": over("attempt_log") + f"""SELECT request_id, attempt_no, {SCRIPT_TYPE} AS scraper_type,
            'Execution timed out after ' || CAST(trunc(execution_time) AS BIGINT) || 's' || CASE
            WHEN {SCRIPT_TYPE} IN ('selenium', 'playwright') THEN {quoted(V.TIMEOUT_BROWSER_HINT)}
            WHEN {SCRIPT_TYPE} = 'requests' THEN {quoted(V.TIMEOUT_REQUESTS_HINT)} ELSE '' END AS message, {issue}
            FROM attempt_log WHERE timed_out""",
        "import_census": over("code_rows") + "," + IMPORTS + """ SELECT module, count(*) AS n_rows FROM imports
            GROUP BY module""",
        "blocked_imports": over("code_rows") + "," + IMPORTS + f""" SELECT doc_id, module FROM imports
            WHERE module NOT IN {in_list(sorted(sys.stdlib_module_names) + V.ALLOWED_MODULES)}""",
        "code_checks": over("code_rows") + rf"""SELECT doc_id, {SCRIPT_TYPE} AS script_type,
            regexp_matches(code, '(?m)^\s*(import|from)\s+\w+') AND (regexp_matches(code, '(?m)^\s*def\s+\w+')
            OR regexp_matches(code, '(?m)^\s*class\s+\w+') OR regexp_matches(code, '(?m)^\s*\w+\s*=')) AS looks_like_code
            FROM code_rows""",
        "extract_code": over("llm_responses") + rf"""SELECT conv_id, turn, CASE
            WHEN regexp_matches(response, '(?s)```python\s*(.*?)\s*```')
              THEN {strip(r"regexp_extract(response, '(?s)```python\s*(.*?)\s*```', 1)")}
            WHEN regexp_matches(response, '(?s)```\s*(.*?)\s*```')
              THEN {strip(r"regexp_extract(response, '(?s)```\s*(.*?)\s*```', 1)")} END AS code FROM llm_responses""",
        "parse_output": over("attempt_log") + f"""SELECT request_id, attempt_no, {kind} AS kind, {data} AS data
            FROM attempt_log WHERE {CODE_OK}""",
        "parse_verdicts": over("verdicts") + f"""SELECT doc_id, starts_with(v, 'YES') AS is_valid,
            CASE WHEN NOT starts_with(v, 'YES') AND contains(v, '-') THEN {strip("substr(v, instr(v, '-') + 1)")}
            ELSE '' END AS reason, contains(v, 'YES') AS loose_success
            FROM (SELECT doc_id, {verdict} AS v FROM verdicts)""",
        "match_data_types": over("requests") + f""", found AS (SELECT request_id, data_type,
              row_number() OVER (PARTITION BY request_id ORDER BY i) AS rn FROM (
              SELECT request_id, data_type, min(i) AS i FROM requests JOIN {types} ON contains({text}, word) GROUP BY ALL)
              QUALIFY rn <= 3),
            sized AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n FROM found),
            listed AS (SELECT request_id, rn, data_type FROM sized
              UNION ALL SELECT s.request_id, 2, data_type FROM sized s JOIN requests r USING (request_id)
                WHERE n = 1 AND regexp_matches({text}, 'list|multiple')
              UNION ALL SELECT request_id, 1, 'generic' FROM requests r
                WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.request_id = r.request_id))
            SELECT request_id, CAST(rn - 1 AS INT) AS ord, data_type FROM listed""",
        "resolve_attempts": over("attempt_log") + f""", tries AS (SELECT request_id, attempt_no, {CODE_OK} AS ok,
              {CODE_OK} AND is_valid AS valid, code, {strip('stdout')} AS output,
              min(CASE WHEN {CODE_OK} AND is_valid THEN attempt_no END) OVER (PARTITION BY request_id) AS stop
              FROM attempt_log WHERE attempt_no <= 5),
            done AS (SELECT request_id, CAST(count(*) AS INT) AS attempts, bool_or(valid) AS success,
              max_by(code, attempt_no) FILTER (WHERE ok) AS final_code,
              max_by(output, attempt_no) FILTER (WHERE ok) AS output
              FROM tries WHERE stop IS NULL OR attempt_no <= stop GROUP BY request_id)
            SELECT request_id, attempts, success, final_code,
              CASE WHEN final_code IS NOT NULL THEN {out_kind} END AS data_kind,
              CASE WHEN final_code IS NOT NULL THEN {out_data} END AS final_data,
              CASE WHEN final_code IS NOT NULL THEN 'Code OK' ELSE 'No Code' END AS code_flag,
              CASE WHEN final_code IS NOT NULL THEN 'Data OK' ELSE 'No Data' END AS data_flag,
              attempts || ' of 5 attempts' AS attempts_label FROM done""",
    }


# -- model ledger --------------------------------------------------------------------------------
PREFIX_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(model), '{rule}') THEN '{provider}'" for provider, rule in V.PROVIDER_PREFIXES) + " END"
SUBSTRING_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(model), '{'|'.join(words)}') THEN '{provider}'"
    for provider, words in V.PROVIDER_SUBSTRINGS) + " END"
PRICED = f"""
usage AS (SELECT call_id, request_id, role, model, content,
    CAST(CASE WHEN has_response_metadata THEN coalesce(nullif(prompt_tokens, 0), input_tokens, 0)
      WHEN has_usage_metadata THEN coalesce(input_tokens, 0) ELSE 0 END AS BIGINT) AS tokens_in,
    CAST(CASE WHEN has_response_metadata THEN coalesce(nullif(completion_tokens, 0), output_tokens, 0)
      WHEN has_usage_metadata THEN coalesce(output_tokens, 0) ELSE coalesce(length(content) // 4, 0) END AS BIGINT) AS tokens_out
  FROM llm_calls),
priced AS (SELECT u.*, tokens_in / 1000 * coalesce(p_in, {V.DEFAULT_PRICE[0]})
    + tokens_out / 1000 * coalesce(p_out, {V.DEFAULT_PRICE[1]}) AS cost
  FROM usage u LEFT JOIN {values_table([(m, a, b) for m, a, b in V.PRICES], "name, p_in, p_out")} ON name = model)"""


def ledger_queries() -> dict[str, str]:
    calls = over("llm_calls")

    def routed(case):
        return calls + f"""SELECT call_id, model, {case} AS provider, CASE WHEN {case} IS NULL
            THEN 'Unknown model provider: ' || model END AS reason FROM llm_calls"""

    def role_sum(value, role):
        return f"coalesce(sum({value}) FILTER (WHERE role = '{role}'), 0)"

    totals = ", ".join(
        f"CAST({role_sum('tokens_in', r)} AS BIGINT) AS {r}_input, CAST({role_sum('tokens_out', r)} AS BIGINT) AS {r}_output, "
        f"CAST({role_sum('tokens_in + tokens_out', r)} AS BIGINT) AS {r}_total, round({role_sum('cost', r)}, 8) AS {r}_cost"
        for r in ("helper", "coding"))
    totals_cte = f"totals AS (SELECT request_id, {totals}, round(sum(cost), 8) AS total_cost FROM priced GROUP BY request_id)"

    def running(keys):
        frame = f"OVER (PARTITION BY {keys} ORDER BY call_id ROWS UNBOUNDED PRECEDING)"
        return calls + "," + PRICED + f""" SELECT call_id, request_id, role,
            CAST(sum(tokens_in) {frame} AS BIGINT) AS running_tokens_in,
            CAST(sum(tokens_out) {frame} AS BIGINT) AS running_tokens_out,
            CAST(sum(tokens_in + tokens_out) {frame} AS BIGINT) AS running_total,
            round(sum(cost) {frame}, 8) AS running_cost FROM priced"""

    names = values_table(V.MODEL_API_NAMES, "name, api")
    listed = [m for models in V.MODEL_CATALOG.values() for m in models]
    total = "nullif(helper_total + coding_total, 0)"
    return {
        "route_models_regex": routed(PREFIX_CASE),
        "route_models_substring": routed(SUBSTRING_CASE),
        "map_model_names": calls + f"""SELECT call_id, model, coalesce(api, model) AS api_name FROM llm_calls
            LEFT JOIN {names} ON name = model""",
        "unlisted_models": calls + f"SELECT call_id, model FROM llm_calls WHERE model NOT IN {in_list(listed)}",
        "normalise_usage": calls + "," + PRICED + """ SELECT call_id, request_id, role, model, tokens_in, tokens_out,
            left(content, 500) || CASE WHEN length(content) > 500 THEN '...' ELSE '' END AS preview FROM usage""",
        "price_calls": calls + "," + PRICED + """ SELECT call_id, request_id, role, model, tokens_in, tokens_out,
            round(cost, 8) AS cost FROM priced""",
        "usage_totals": calls + "," + PRICED + "," + totals_cte + " SELECT * FROM totals",
        "usage_report": calls + "," + PRICED + "," + totals_cte + f""" SELECT request_id,
            round(round(helper_total * 1000.0 / {total}) / 10.0, 1) AS helper_percent,
            round(round(coding_total * 1000.0 / {total}) / 10.0, 1) AS coding_percent,
            CASE WHEN total_cost > 0.1 THEN 'danger' WHEN total_cost > 0.05 THEN 'warning' ELSE 'success' END AS cost_band
            FROM totals""",
        "running_usage_request": running("request_id, role"),
        "running_usage_log": running("role"),
        "running_usage_incremental": running("role"),
    }


# -- status --------------------------------------------------------------------------------------
PROGRESS_CASE = "CASE stage " + " ".join(
    f"WHEN '{name}' THEN least(95.0, {i} / 7.0 * 100)" for i, name in enumerate(V.STAGES)) + " END"
EVENTS_IN_ORDER = f"""
firsts AS (SELECT request_id, stage, min(event_id) AS first_id FROM stage_events WHERE action = 'start' GROUP BY ALL),
seen AS (SELECT e.*, f.first_id, action = 'start' OR coalesce(e.event_id > f.first_id, FALSE) AS applies
  FROM stage_events e LEFT JOIN firsts f USING (request_id, stage)),
ended AS (SELECT request_id, first_id, max_by(ts_s, event_id) AS end_time, max_by(action, event_id) AS ended_as,
    max_by(details, event_id) FILTER (WHERE action = 'fail' OR details <> '') AS note
  FROM seen WHERE applies AND action <> 'start' GROUP BY ALL),
entries AS (SELECT s.request_id, s.event_id, s.stage, s.ts_s AS start_time, e.end_time, e.end_time - s.ts_s AS duration,
    CASE e.ended_as WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'in_progress' END AS status,
    coalesce(e.note, s.details) AS details
  FROM seen s LEFT JOIN ended e ON e.request_id = s.request_id AND e.first_id = s.event_id WHERE s.action = 'start'),
verdicts_at AS (SELECT request_id, event_id, stage, action, details FROM seen WHERE applies
  AND (action = 'fail' OR (action = 'complete' AND stage IN {in_list(V.FINAL_STAGES)}))),
states AS (SELECT q.request_id,
    coalesce((SELECT max_by(CASE action WHEN 'fail' THEN 'failed' ELSE 'completed' END, event_id) FROM verdicts_at v
      WHERE v.request_id = q.request_id), 'initializing') AS status,
    (SELECT max_by(stage, event_id) FROM entries e WHERE e.request_id = q.request_id) AS current_stage,
    coalesce((SELECT max_by(p, event_id) FROM (
      SELECT request_id, event_id, {PROGRESS_CASE} AS p FROM entries WHERE stage IN {in_list(V.STAGES)}
      UNION ALL SELECT request_id, event_id, 100.0 FROM verdicts_at WHERE action = 'complete') g
      WHERE g.request_id = q.request_id), 0) AS progress,
    (SELECT count(*) FROM entries e WHERE e.request_id = q.request_id) AS n_stages,
    coalesce((SELECT max_by(CASE action WHEN 'fail' THEN 'Failed during ' || stage || ': ' || details
      ELSE 'Processing completed' END, event_id) FROM verdicts_at v WHERE v.request_id = q.request_id),
      'Request initialized') AS message,
    (SELECT max_by(details, event_id) FROM verdicts_at v WHERE v.request_id = q.request_id AND action = 'fail') AS error,
    (SELECT min_by(start_time, event_id) FROM entries e WHERE e.request_id = q.request_id) AS first_started,
    (SELECT arg_max_null(end_time, event_id) FROM entries e WHERE e.request_id = q.request_id) AS last_ended
  FROM (SELECT DISTINCT request_id FROM stage_events) q)"""
STATE_COLUMNS = ("request_id, status, current_stage, round(CAST(progress AS DOUBLE), 6) AS progress, n_stages, message, "
                 "error, first_started, last_ended")


def alive(now: str) -> str:
    return (f"NOT (n_stages > 0 AND first_started < {now} - 300) AND NOT coalesce(n_stages > 0 AND "
            f"status IN ('completed', 'failed') AND last_ended < {now} - 60, FALSE)")


ALIVE = alive(str(STATUS_NOW))


WATERMARK = "(SELECT max(ts_s) - 3600 FROM stage_events)"
SESSIONS = "sessions AS (SELECT * REPLACE (event_id // 1000 * 1000000 + request_id AS request_id) FROM stage_events)"


def status_queries() -> dict[str, str]:
    states = over("stage_events") + "," + EVENTS_IN_ORDER
    all_states = states + f" SELECT {STATE_COLUMNS} FROM states"
    cache_left = f"NOT (NOT readable OR {STATUS_NOW} - coalesce(cache_time, 0) >= 86400)"
    return {
        "stage_state": all_states,
        "stream_stage_status": states + f" SELECT {STATE_COLUMNS} FROM states WHERE coalesce({ALIVE}, TRUE)",
        "stream_status_expiry": over("stage_events") + f", {SESSIONS}," + EVENTS_IN_ORDER.replace("stage_events", "sessions") + f" SELECT {STATE_COLUMNS} FROM states WHERE coalesce({alive(WATERMARK)}, TRUE)",
        "stage_entries": states + " SELECT * FROM entries",
        "status_expiry": states + f" SELECT {STATE_COLUMNS} FROM states WHERE coalesce({ALIVE}, TRUE)",
        "latest_status": over("stage_events") + """SELECT l.doc_id AS request_id, max_by(stage, event_id) AS stage,
            max_by(action, event_id) AS action, max_by(details, event_id) FILTER (WHERE action = 'fail') AS details
            FROM labels l LEFT JOIN stage_events e ON e.request_id = l.doc_id GROUP BY l.doc_id""",
        "maintenance_run": over("stage_events", "analysis_cache") + "," + EVENTS_IN_ORDER + f"""
            SELECT 'status' AS store, CAST(request_id AS VARCHAR) AS key FROM states WHERE coalesce({ALIVE}, TRUE)
            UNION ALL SELECT 'cache', cache_key FROM analysis_cache WHERE {cache_left}""",
    }


#: Queries that give the same rows in another way.
SAME = {"classify_errors_table": "classify_errors", "match_data_types_table": "match_data_types"}
PATTERN_SEARCH = "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text[1:30]))"


def oracle_queries() -> dict[str, str]:
    found = {**source_queries(), **page_queries(), **analysis_queries(), **language_queries(), **job_queries(),
             **ledger_queries(), **status_queries()}
    return found | {name: found[other] for name, other in SAME.items()} | {"pattern_search": PATTERN_SEARCH}
