"""Which selectors to use on a page: ranked strategies, suggestions, template roles, interactive elements."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crawlgrain import fixed_values as V
from crawlgrain.functions import nodes as N
from crawlgrain.functions.sql import any_of, drop_nulls, in_list, let, lit, non_empty, strip, struct
from crawlgrain.operators.page_features import listed, listed_values

# Attributes that are no stable selector; the last two hold lists rather than one value.
UNSTABLE_ATTRIBUTES = ["class", "id", "style", "accesskey", "dropzone"]


# -- strategies ----------------------------------------------------------------------------------
def _candidate(order: int, selector: str, score: str, method: str, count: str = "CAST(NULL AS INT)", pos: str = "0") -> str:
    """A sortable candidate: best score first, then the given order."""
    return struct(neg=f"-{score}", ord=str(order), pos=pos, selector=selector, method=lit(method), count=count)


def _candidate_if(order: int, selector: str, score: str, method: str) -> str:
    return let("sel", selector, f"CASE WHEN sel IS NOT NULL THEN {_candidate(order, 'sel', score, method)} END")


def strategies_sql(n: str) -> str:
    """Up to three selector strategies of one element, best first."""
    nth = f"' > ' || {n}.tag || ':nth-child(' || {n}.tag_idx || ')'"
    by_parent_id = f"'#' || {non_empty('p.id')} || {nth}"
    by_parent_class = f"CASE WHEN {non_empty('p.id')} IS NULL THEN {N.class_selector('p')} || {nth} END"
    anchor = let("alone", strip(N.only_string(n)), f"CASE WHEN length(alone) > 10 THEN {n}.tag || ':contains(\\'' || "
                 "left(alone, 20) || '\\')' END")
    uses = f"size(filter(nodes, m -> size(array_except({n}.classes, m.classes)) = 0))"
    score = "(CASE WHEN uses < 5 THEN 0.8D WHEN uses < 20 THEN 0.6D ELSE 0.4D END)"
    by_class = let("uses", uses, f"CASE WHEN size({n}.classes) > 0 THEN "
                   f"{_candidate(1, N.class_selector(n), score, 'class', 'uses')} END")
    stable = f"filter(map_entries({n}.attrs), e -> e.key NOT IN {in_list(UNSTABLE_ATTRIBUTES)} AND length(e.value) < 50)"
    by_attribute = (f"transform({stable}, (e, i) -> " + _candidate(
        5, f"{n}.tag || '[' || e.key || '=\\'' || e.value || '\\']'", "0.7D", "attribute", pos="i") + ")")
    named = let("p", N.parent(n), drop_nulls(
        _candidate_if(0, f"'#' || {non_empty(n + '.id')}", "0.9D", "id"), by_class,
        _candidate_if(2, by_parent_id, "0.8D", "parent-child-id"),
        _candidate_if(3, by_parent_class, "0.7D", "parent-child-class"),
        _candidate_if(4, anchor, "0.5D", "text-content")))
    strategy = struct(selector="s.selector", reliability="-s.neg", method="s.method", count="s.count",
                      note="CASE WHEN s.method = 'text-content' THEN 'Requires jQuery or XPath' END")
    return f"transform(slice(sort_array(concat({named}, {by_attribute})), 1, 3), s -> {strategy})"


def selector_strategies_sql() -> str:
    """For the first five content containers: array<struct<element, strategies>>."""
    targets = f"slice({N.select(tags=V.STRATEGY_TAGS, class_re=V.STRATEGY_CLASS)}, 1, 5)"
    return f"transform({targets}, t -> {struct(element='t.tag', strategies=strategies_sql('t'))})"


def selector_strategies(dom: DataFrame) -> DataFrame:
    """One row per page, target element and rank."""
    return listed(dom, selector_strategies_sql(), "target").selectExpr(
        "page_id", "target", "element", "posexplode(strategies) AS (pos, s)").selectExpr(
        "page_id", "target", "element", "pos + 1 AS rank", "s.*")


# -- suggestions ---------------------------------------------------------------------------------
def selector_suggestions_sql() -> str:
    """At most two sentences: ids of long elements, and main content containers, five of each."""
    pattern = lit(V.SUGGESTION_PATTERN)
    long_ids = f"slice(transform(filter(nodes, n -> n.id IS NOT NULL AND n.text_len > 100), n -> n.id), 1, 5)"
    names = (f"CASE WHEN {N.truth('rlike(' + non_empty('n.id') + ', ' + pattern + ')')} THEN array('#' || n.id) "
             f"ELSE transform(filter(n.classes, c -> rlike(c, {pattern})), c -> '.' || c) END")
    mains = f"slice(flatten(transform({N.select(tags=V.SUGGESTION_TAGS)}, n -> {names})), 1, 5)"
    return let("ids", long_ids, let("ms", mains, drop_nulls(
        "CASE WHEN size(ids) > 0 THEN 'High-content IDs: #' || array_join(ids, ', #') END",
        "CASE WHEN size(ms) > 0 THEN 'Main content containers: ' || array_join(ms, ', ') END")))


def selector_suggestions(dom: DataFrame) -> DataFrame:
    return listed_values(dom, selector_suggestions_sql(), "suggestion")


# -- template roles ------------------------------------------------------------------------------
def template_selectors_sql() -> str:
    """array<struct<role, selector>>: the first element of each role that exists."""
    def role(name, tags, class_re):
        return let("r", f"get({N.select(tags=tags, class_re=class_re)}, 0)",
                   f"CASE WHEN r IS NOT NULL THEN {struct(role=lit(name), selector=N.css_selector('r'))} END")

    return drop_nulls(*[role(*r) for r in V.TEMPLATE_ROLES])


def template_selectors(dom: DataFrame) -> DataFrame:
    return dom.selectExpr("page_id", f"inline({template_selectors_sql()})")


# -- interactive elements ------------------------------------------------------------------------
def common_classes_sql(uses: int = 5) -> str:
    """Classes carried by at least ``uses`` elements: in the sorted list of all class uses such a class equals
    the entry ``uses - 1`` places further on."""
    ordered = "sort_array(flatten(transform(nodes, n -> array_distinct(n.classes))))"
    return let("cs", ordered, f"array_distinct(filter(cs, (c, i) -> coalesce(c = get(cs, i + {uses - 1}), FALSE)))")


def interactive_elements_sql() -> str:
    """Buttons that load content, then pagination links, each in document order."""
    def class_attr(n):
        return f"coalesce({N.attr(n, 'class')}, '')"

    button = any_of(N.is_clickable("n"), f"(n.tag = 'a' AND {N.matches('n', attr_eq={'href': '#'})})",
                    f"contains({class_attr('n')}, 'load')", f"contains({class_attr('n')}, 'more')")
    buttons = f"filter(nodes, n -> {button} AND rlike({N.text('n')}, {lit('(?i)' + V.LOADING_BUTTON_TEXT)}))"
    link = any_of("(n.tag = 'a' AND n.in_pager)", N.truth(f"contains({N.attr('n', 'aria-label')}, 'page')"))
    links = f"filter(nodes, n -> {link})"
    selector = let("p", N.parent("n"), (
        f"coalesce('#' || {non_empty('n.id')}, '.' || get(filter(n.classes, c -> NOT array_contains(common, c)), 0), "
        f"'#' || {non_empty('p.id')} || ' > ' || n.tag || ':nth-child(' || n.elem_idx || ')', n.tag)"))

    def elements(hits, kind):
        return f"transform({hits}, n -> {struct(selector=selector, text=N.preview('n', 30), type=lit(kind))})"

    return let("common", common_classes_sql(), f"concat({elements(buttons, 'button')}, {elements(links, 'pagination')})")


def interactive_elements(dom: DataFrame) -> DataFrame:
    return listed(dom, interactive_elements_sql())
