"""Pages -> DOM rows (one per page), and node-level views of them.

A DOM row holds its nodes as an array in document order, so ``nodes[parent_id]`` is the parent and no join is
needed to walk the tree. Everything after ``parse_pages`` is JVM-side expressions on those rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from crawlgrain.functions import dom_kernel
from crawlgrain.functions import nodes as N
from crawlgrain.functions.sql import counted_runs, let, lit, struct

# The kernel travels with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(dom_kernel)


def parse_pages(pages: DataFrame, *parts: str) -> DataFrame:
    """(page_id, url, html) -> page_id, url, html_len, nodes, segs, hidden, warning. A failing page has no nodes.

    With ``parts`` named, only those of nodes, segs and hidden are filled: text features need no nodes."""
    work = dom_kernel.parser(parts or dom_kernel.PARTS)
    return pages.select("page_id", "url", "html").mapInArrow(work, dom_kernel.DOM_SCHEMA)


def dom_nodes(dom: DataFrame) -> DataFrame:
    """One row per element."""
    return dom.select("page_id", F.inline("nodes"))


def tag_counts(dom: DataFrame) -> DataFrame:
    """How often each tag occurs on a page, counted within its row."""
    counts = f"transform({counted_runs('transform(nodes, n -> n.tag)')}, r -> {struct(tag='r.word', n='CAST(r.n AS LONG)')})"
    return dom.selectExpr("page_id", f"inline({counts})")


def page_text(dom: DataFrame) -> DataFrame:
    """Visible and hidden strings per page."""
    return dom.select("page_id", "segs", "hidden", "html_len", "warning")


def select_nodes(nodes: DataFrame, **tests) -> DataFrame:
    """Element select: keep the node rows for which every given test holds (see ``nodes.matches``)."""
    return nodes.filter(N.matches("", **tests))


def node_text(dom: DataFrame, **tests) -> DataFrame:
    """Text and 50-char preview of the selected elements. Only chosen nodes become rows."""
    row = struct(node_id="n.node_id", tag="n.tag", text=N.text("n"), preview=N.preview("n"))
    return dom.selectExpr("page_id", f"inline(transform({N.select(**tests)}, n -> {row}))")


def with_selector(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("selector", F.expr(N.css_selector("")))


def with_children(dom: DataFrame) -> DataFrame:
    """Parent-child pairs: child order, the parent's child count and the child's descendant count. The parent is an
    array look-up, so the self join needs no shuffle."""
    pair = struct(parent_id="p.node_id", parent_tag="p.tag", n_children="p.n_children", child_id="c.node_id",
                  child_tag="c.tag", child_order="c.elem_idx", n_descendants="c.subtree_end - c.node_id")
    pairs = f"transform(filter(nodes, c -> c.parent_id >= 0), c -> {let('p', N.parent('c'), pair)})"
    return dom.selectExpr("page_id", f"inline({pairs})")


def has_ancestor(dom: DataFrame, node: Callable[[str], str], ancestor: Callable[[str], str]) -> DataFrame:
    """Interval semi-join inside the page: nodes passing ``node`` below a node passing ``ancestor``."""
    return dom.selectExpr("page_id", f"inline({_below(node, ancestor)})")


def has_ancestors(dom: DataFrame, rules: dict[str, tuple[Callable[[str], str], Callable[[str], str]]]) -> DataFrame:
    """Several such rules in one pass over the pages: page_id, rule and the nodes that pass it."""
    found = ", ".join(f"transform({_below(*tests)}, n -> {struct(rule=lit(rule), n='n')})" for rule, tests in rules.items())
    return dom.selectExpr("page_id", f"inline(concat({found}))").select("page_id", "rule", "n.*")


def _below(node: Callable[[str], str], ancestor: Callable[[str], str]) -> str:
    """The nodes of a row that pass ``node`` and lie in the subtree of one that passes ``ancestor``.

    A node lies in as many subtrees as have begun before it and not ended before it. Sorted in between the beginnings, and in
    between the ends, the k-th hit stands at k plus their number, so two sorts within the row answer it for all hits."""
    def places(at: str) -> str:
        hits = f"transform(hits, n -> {struct(pos='n.node_id', of='0')})"
        others = f"transform(above, n -> {struct(pos=at, of='1')})"
        return f"filter(transform(sort_array(concat({hits}, {others})), (x, i) -> CASE WHEN x.of = 0 THEN i END), i -> i IS NOT NULL)"

    inside = f"transform(hits, (n, k) -> {struct(n='n', inside='get(begun, k) > get(ended, k)')})"
    body = let("begun", places("n.node_id"), let("ended", places("n.subtree_end"), f"transform(filter({inside}, x -> x.inside), x -> x.n)"))
    return let("hits", f"filter(nodes, n -> {node('n')})", let("above", f"filter(nodes, n -> {ancestor('n')})", body))


def sibling_position(nodes: DataFrame) -> DataFrame:
    """1-based position among same-tag siblings and among all element siblings."""
    return nodes.select("page_id", "node_id", "parent_id", "tag", "tag_idx", "elem_idx")
