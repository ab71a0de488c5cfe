"""Page features: each is one expression on a DOM row, so a whole page is analysed without a shuffle.

Functions ending in ``_sql`` give the expression (``plans.analysis`` puts them in one select); the functions named
after the feature return it as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from crawlgrain import fixed_values as V
from crawlgrain.functions import nodes as N
from crawlgrain.functions.sql import (
    any_of, counted_runs, drop_nulls, first_of_runs, in_list, let, lit, non_empty, strip, struct,
)


def count_nodes(**tests) -> str:
    return f"size({N.select(**tests)})"


def spread_struct(dom: DataFrame, expression: str) -> DataFrame:
    return dom.selectExpr("page_id", f"{expression} AS s").select("page_id", "s.*")


def listed(dom: DataFrame, expression: str, ordinal: str = "ord", start: int = 0) -> DataFrame:
    """One row per struct of an array, numbered in its order."""
    rows = dom.selectExpr("page_id", f"posexplode({expression}) AS (pos, item)")
    return rows.selectExpr("page_id", f"pos + {start} AS {ordinal}", "item.*")


def listed_values(dom: DataFrame, expression: str, name: str, ordinal: str = "ord") -> DataFrame:
    return dom.selectExpr("page_id", f"posexplode({expression}) AS ({ordinal}, {name})")


# -- structure counts ----------------------------------------------------------------------------
def components_sql() -> str:
    return struct(
        navigation=count_nodes(tags=V.NAVIGATION_TAGS), forms=count_nodes(tags=["form"]),
        buttons=count_nodes(tags=["button"]), modals=count_nodes(class_re=V.MODAL_CLASS),
        tables=count_nodes(tags=["table"]), iframes=count_nodes(tags=["iframe"]))


def components(dom: DataFrame) -> DataFrame:
    return spread_struct(dom, components_sql())


def content_hierarchy_sql() -> str:
    return struct(**{tag: count_nodes(tags=[tag]) for tag in V.SEMANTIC_TAGS},
                  content_containers=count_nodes(class_re=V.CONTENT_CONTAINER_CLASS))


def content_hierarchy(dom: DataFrame) -> DataFrame:
    return spread_struct(dom, content_hierarchy_sql())


# -- text ----------------------------------------------------------------------------------------
def text_length_sql() -> str:
    """Length of the page text with every string trimmed."""
    return f"aggregate(segs, 0, (total, s) -> total + length({strip('s')}))"


def text_ratio_sql() -> str:
    """Text length over html length, two decimals; whole percents are rounded so that ties do not depend on
    how an engine prints doubles."""
    return f"coalesce(round({text_length_sql()} * 100.0D / nullif(html_len, 0)) / 100.0D, 0.0D)"


def text_ratio(dom: DataFrame) -> DataFrame:
    return dom.selectExpr("page_id", f"{text_length_sql()} AS text_length", "html_len", f"{text_ratio_sql()} AS text_ratio")


def words_sql() -> str:
    """Words of at least four word characters of the lower-cased page text (strings joined without separator)."""
    return f"regexp_extract_all(lower(array_join(segs, '')), {lit(V.KEYWORD)}, 0)"


def keyword_density_sql(k: int = V.KEYWORD_LIMIT) -> str:
    """array<struct<word, n>>: the k most frequent words, ties by first appearance."""
    ranked = f"sort_array(transform({counted_runs(words_sql())}, r -> {struct(neg='-r.n', pos='r.pos', word='r.word')}))"
    return f"transform(slice({ranked}, 1, {k}), r -> {struct(word='r.word', n='-r.neg')})"


def keyword_density(dom: DataFrame, k: int = V.KEYWORD_LIMIT) -> DataFrame:
    return listed(dom, keyword_density_sql(k), "rank", 1)


def language_sample_sql() -> str:
    return f"left(array_join(segs, ''), {V.LANGUAGE_SAMPLE_CHARS})"


# -- metadata ------------------------------------------------------------------------------------
def seo_entries_sql() -> str:
    """array<struct<key, content>>, one per key, the last tag winning, ordered by key."""
    key = "coalesce(" + ", ".join(non_empty(N.attr("n", name)) for name in ("name", "property", "itemprop")) + ")"
    entry = struct(key=key, neg="-n.node_id", content=N.attr("n", "content"))
    ordered = f"sort_array(transform(filter(nodes, n -> n.tag = 'meta' AND {key} IS NOT NULL), n -> {entry}))"
    return f"transform({first_of_runs(ordered, 'key')}, e -> {struct(key='e.key', content='e.content')})"


def seo_meta_sql() -> str:
    return f"map_from_entries({seo_entries_sql()})"


def seo_meta(dom: DataFrame) -> DataFrame:
    return dom.selectExpr("page_id", f"inline({seo_entries_sql()})")


def frameworks_sql() -> str:
    sources = (f"filter(transform(filter(nodes, n -> n.tag = 'script'), n -> lower({N.attr('n', 'src')})), "
               "s -> coalesce(s <> '', FALSE))")
    return let("ss", sources, struct(**{name: f"exists(ss, s -> contains(s, '{name}'))" for name in V.FRAMEWORKS}))


def frameworks(dom: DataFrame) -> DataFrame:
    return spread_struct(dom, frameworks_sql())


def structured_data_sql() -> str:
    """Bodies of the JSON-LD scripts that parse, as JSON text in document order."""
    scripts = N.select(tags=["script"], attr_eq={"type": "application/ld+json"})
    return f"filter(transform({scripts}, n -> {N.only_string('n')}), b -> try_parse_json(b) IS NOT NULL)"


def structured_data(dom: DataFrame) -> DataFrame:
    """One row per parsed JSON-LD body, as VARIANT."""
    return listed_values(dom, structured_data_sql(), "body").selectExpr("page_id", "ord", "try_parse_json(body) AS data")


def dynamic_attributes_sql() -> str:
    """Distinct data-/aria-/ng- attribute names, sorted."""
    dynamic = any_of(*[f"startswith(k, {lit(p)})" for p in V.DYNAMIC_ATTRIBUTE_PREFIXES])
    return f"sort_array(array_distinct(flatten(transform(nodes, n -> filter(map_keys(n.attrs), k -> {dynamic})))))"


def dynamic_attributes(dom: DataFrame) -> DataFrame:
    return dom.selectExpr("page_id", f"explode({dynamic_attributes_sql()}) AS attribute")


def pagination_sql() -> str:
    numbered = lit(V.PAGE_NUMBER_TEXT)
    return drop_nulls(
        f"CASE WHEN exists(segs, s -> rlike(s, {numbered})) OR exists(hidden, h -> rlike(h.text, {numbered})) "
        "THEN 'page_numbers' END",
        f"CASE WHEN exists(nodes, n -> {N.matches('n', attr_re={'href': V.PAGE_LINK})}) THEN 'next_buttons' END",
        f"CASE WHEN exists(nodes, n -> {N.matches('n', has_attr='data-page')}) THEN 'data_attributes' END")


def pagination_patterns(dom: DataFrame) -> DataFrame:
    return listed_values(dom, pagination_sql(), "signal")


# -- repeating structure -------------------------------------------------------------------------
def _pattern(parent: str, child_tag: str, count: str, confidence: str) -> str:
    return let("selector", f"coalesce({N.css_selector(parent)}, '[document]')", struct(
        parent_selector="selector", child_selector=f"selector || ' > ' || {child_tag}", count=count,
        confidence=confidence))


def content_patterns_sql() -> str:
    """Parents whose first three element children look alike. In document order the first child directly follows
    its parent and each next sibling follows the previous subtree, so the three are array look-ups."""
    trio = let("a", "get(nodes, p.node_id + 1)", let("b", "get(nodes, a.subtree_end + 1)", let(
        "c", "get(nodes, b.subtree_end + 1)", struct(p="p", a="a", b="b", c="c"))))
    classed = "(size(t.a.classes) > 0 AND size(t.b.classes) > 0 AND size(t.c.classes) > 0)"
    shared = "size(array_intersect(array_intersect(t.a.classes, t.b.classes), t.c.classes)) > 0"
    sizes = ", ".join(f"t.{k}.subtree_end - t.{k}.node_id" for k in "abc")
    alike = (f"t.a.tag = t.b.tag AND t.b.tag = t.c.tag AND (NOT {classed} OR {shared}) "
             f"AND greatest({sizes}) - least({sizes}) <= 2")
    parents = f"filter(nodes, p -> p.tag IN {in_list(V.PATTERN_PARENT_TAGS)} AND p.n_children >= 3)"
    pattern = _pattern("t.p", "t.a.tag", "t.p.n_children", f"CASE WHEN {classed} THEN 'high' ELSE 'medium' END")
    return f"transform(filter(transform({parents}, p -> {trio}), t -> {alike}), t -> {pattern})"


def list_patterns_sql() -> str:
    """Parents holding at least five li, ordered by their first li."""
    firsts = "filter(nodes, n -> n.tag = 'li' AND n.tag_idx = 1 AND n.tag_total >= 5)"
    return f"transform({firsts}, n -> {let('p', N.parent('n'), _pattern('p', lit('li'), 'n.tag_total', lit('high')))})"


def all_patterns_sql() -> str:
    return f"concat({content_patterns_sql()}, {list_patterns_sql()})"


def by_count(patterns: str) -> str:
    """Patterns with the highest count first, ties in their given order: array<struct<neg, ord, p>>."""
    return f"sort_array(transform({patterns}, (p, i) -> {struct(neg='-p.count', ord='i', p='p')}))"


def best_pattern_of(patterns: str) -> str:
    return f"get({by_count(patterns)}, 0).p"


def content_patterns(dom: DataFrame) -> DataFrame:
    return listed(dom, content_patterns_sql())


def list_patterns(dom: DataFrame) -> DataFrame:
    return listed(dom, list_patterns_sql())


def all_patterns(dom: DataFrame) -> DataFrame:
    return listed(dom, all_patterns_sql())


def best_pattern(dom: DataFrame) -> DataFrame:
    return dom.selectExpr("page_id", f"inline(array_compact(array({best_pattern_of(all_patterns_sql())})))")


def extraction_heuristics_sql() -> str:
    """The extraction patterns with enough hits, most hits first."""
    def heuristic(order, name, tags, class_re, over, samples, selector):
        sample = f"filter(transform(slice(hs, 1, {samples}), n -> {N.preview('n')}), s -> s <> '')"
        found = struct(neg="-size(hs)", ord=str(order), pattern=lit(name), selector=lit(selector), sample=sample)
        return let("hs", N.select(tags=tags, class_re=class_re), f"CASE WHEN size(hs) > {over} THEN {found} END")

    ranked = f"sort_array({drop_nulls(*[heuristic(i, *h) for i, h in enumerate(V.HEURISTICS)])})"
    return f"transform({ranked}, r -> {struct(pattern='r.pattern', selector='r.selector', sample='r.sample', count='-r.neg')})"


def extraction_heuristics(dom: DataFrame) -> DataFrame:
    return listed(dom, extraction_heuristics_sql(), "rank", 1)


# -- outline -------------------------------------------------------------------------------------
def dom_outline_sql(max_depth: int = 3, k: int = 10) -> str:
    """Indented tag lines from body down to ``max_depth``; at the place of child k+1 a line counts the rest.

    An element shows when neither it nor an ancestor below body comes after the k-th child of its parent. Child k+1
    itself passes, since the count line takes its place.
    """
    ancestor, in_first_k = "n", []
    for step in range(max_depth + 1):
        in_first_k.append(f"(n.depth - {step} <= b.depth OR {ancestor}.elem_idx <= {k if step else k + 1})")
        ancestor = N.parent(ancestor)
    level = "(n.depth - b.depth)"
    shown = " AND ".join(in_first_k) + (
        f" AND ({level} <= {max_depth} OR ({level} = {max_depth + 1} AND n.elem_idx = {k + 1}))")
    line = f"n.tag || coalesce('#' || {non_empty('n.id')}, '') || coalesce({N.class_selector('n')}, '')"
    rest = f"'... (' || ({N.parent('n')}.n_children - {k}) || ' more)'"
    text = f"repeat(' ', {level}) || '|_ ' || CASE WHEN {level} > 0 AND n.elem_idx = {k + 1} THEN {rest} ELSE {line} END"
    inside = "slice(nodes, b.node_id + 1, b.subtree_end - b.node_id + 1)"
    lines = f"transform(filter({inside}, n -> {shown}), n -> {text})"
    body = "get(filter(nodes, n -> n.tag = 'body'), 0)"
    return f"coalesce({let('b', body, f'CASE WHEN b IS NOT NULL THEN {lines} END')}, CAST(array() AS array<string>))"


def dom_outline(dom: DataFrame) -> DataFrame:
    return listed_values(dom, dom_outline_sql(), "line", "line_no")


# -- site verdicts -------------------------------------------------------------------------------
def likely_dynamic_of(frameworks: str, dynamic_attributes: str, text_ratio: str) -> str:
    return any_of(*[f"{frameworks}.{name}" for name in V.FRAMEWORKS], f"size({dynamic_attributes}) > 5",
                  f"{text_ratio} < 0.1D")


def archetype_of(is_dynamic: str, keywords: str) -> str:
    def mentions(terms):
        return f"exists({keywords}, k -> {any_of(*[f'contains(k.word, {lit(t)})' for t in terms])})"

    return (f"CASE WHEN {is_dynamic} THEN 'dynamic_content' WHEN {mentions(V.SHOP_TERMS)} THEN 'e-commerce' "
            f"WHEN {mentions(V.NEWS_TERMS)} THEN 'news' ELSE 'dynamic_content' END")


def _judged(dom: DataFrame, *more: str) -> DataFrame:
    parts = dom.selectExpr("page_id", f"{frameworks_sql()} AS f", f"{dynamic_attributes_sql()} AS d",
                           f"{text_ratio_sql()} AS r", *more)
    return parts.selectExpr("*", f"{likely_dynamic_of('f', 'd', 'r')} AS likely_dynamic")


def likely_dynamic(dom: DataFrame) -> DataFrame:
    return _judged(dom).select("page_id", "likely_dynamic")


def site_archetype(dom: DataFrame) -> DataFrame:
    judged = _judged(dom, f"{keyword_density_sql()} AS keywords")
    return judged.selectExpr("page_id", f"{archetype_of('likely_dynamic', 'keywords')} AS archetype")


# -- snapshot comparison -------------------------------------------------------------------------
def snapshot_sql() -> str:
    """The few numbers of a page that two snapshots are compared on."""
    return struct(
        html_len="html_len", text_len=text_length_sql(), n_containers=count_nodes(class_re=V.SNAPSHOT_CONTAINER_CLASS),
        n_items=count_nodes(tags=V.SNAPSHOT_ITEM_TAGS, class_re=V.SNAPSHOT_ITEM_CLASS),
        forms=count_nodes(tags=["form"]), tables=count_nodes(tags=["table"]), iframes=count_nodes(tags=["iframe"]),
        buttons=count_nodes(tags=["button"]), clickables=f"size(filter(nodes, n -> {N.is_clickable('n')}))")


# Which count of the rendered page each static count is compared with.
RENDERED_COUNTS = {"forms": "forms", "tables": "tables", "iframes": "iframes", "buttons": "clickables"}


def grown_by(s: str, r: str) -> str:
    """The first measure in which the rendered page clearly exceeds the static one, or null."""
    def over(name, factor):
        return f"{r}.{name} > {s}.{name} * {factor}D"

    return (f"CASE WHEN {over('html_len', 1.2)} THEN 'html' WHEN {over('text_len', 1.2)} THEN 'text' "
            f"WHEN {over('n_containers', 1.2)} THEN 'containers' WHEN {over('n_items', 1.1)} THEN 'items' END")


def snapshot_diff(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """Is the rendered page materially larger than the static one, and the larger component counts. Only the
    numbers are joined, never the pages."""
    pairs = static.selectExpr("page_id", f"{snapshot_sql()} AS s").join(
        rendered.selectExpr("page_id", f"{snapshot_sql()} AS r"), "page_id")
    counts = RENDERED_COUNTS.items()
    return pairs.selectExpr(
        "page_id", f"{grown_by('s', 'r')} IS NOT NULL AS is_dynamic", f"{grown_by('s', 'r')} AS grown_by",
        *[f"greatest(s.{a}, r.{b}) AS {a}" for a, b in counts],
        f"{any_of(*[f'r.{b} > s.{a} * 1.5D' for a, b in counts])} AS grew_50pct")
