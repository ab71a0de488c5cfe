"""SQL fragments on one DOM element. ``n`` is a lambda variable, or '' for an exploded node row."""

from __future__ import annotations

from crawlgrain.functions.dom_kernel import HIDDEN_TEXT_TAGS
from crawlgrain.functions.sql import any_of, in_list, lit, non_empty, strip

PREVIEW_CHARS = 50


def field(n: str, name: str) -> str:
    return f"{n}.{name}" if n else name


def class_like(n: str, pattern: str) -> str:
    """Some class of the element matches the regex."""
    return f"exists({field(n, 'classes')}, c -> rlike(c, {lit(pattern)}))"


def attr(n: str, name: str) -> str:
    return f"try_element_at({field(n, 'attrs')}, {lit(name)})"


def truth(test: str) -> str:
    return f"coalesce({test}, FALSE)"


def matches(n: str, tags=None, class_re=None, has_attr=None, attr_re=None, attr_eq=None, has_id=False) -> str:
    """All of the given tests hold; tests left out do not restrict."""
    tests = []
    if tags is not None:
        tests.append(f"{field(n, 'tag')} IN {in_list(tags)}")
    if class_re is not None:
        tests.append(class_like(n, class_re))
    if has_attr is not None:
        tests.append(f"{attr(n, has_attr)} IS NOT NULL")
    for name, pattern in (attr_re or {}).items():
        tests.append(truth(f"rlike({attr(n, name)}, {lit(pattern)})"))
    for name, value in (attr_eq or {}).items():
        tests.append(truth(f"{attr(n, name)} = {lit(value)}"))
    if has_id:
        tests.append(f"{field(n, 'id')} IS NOT NULL")
    return "(" + (" AND ".join(tests) or "TRUE") + ")"


def select(**tests) -> str:
    """The matching nodes of the page."""
    return f"filter(nodes, n -> {matches('n', **tests)})"


def parent(n: str) -> str:
    return f"get(nodes, {field(n, 'parent_id')})"


def css_selector(n: str) -> str:
    """#id, else .first-class, else the tag."""
    return (f"coalesce('#' || {non_empty(field(n, 'id'))}, '.' || get({field(n, 'classes')}, 0), {field(n, 'tag')})")


def class_selector(n: str) -> str:
    """.a.b for class="a b"; null without classes."""
    return f"CASE WHEN size({n}.classes) > 0 THEN '.' || array_join({n}.classes, '.') END"


def text(n: str) -> str:
    """Concatenated text below the element, no separator. Script, style and template show their own content."""
    own = (f"array_join(transform(filter(hidden, h -> h.kind = {n}.tag AND h.node_id BETWEEN {n}.node_id AND "
           f"{n}.subtree_end), h -> h.text), '')")
    visible = f"array_join(slice(segs, {n}.t0 + 1, {n}.t1 - {n}.t0), '')"
    return f"CASE WHEN {n}.tag IN {in_list(sorted(HIDDEN_TEXT_TAGS))} THEN {own} ELSE {visible} END"


def preview(n: str, chars: int = PREVIEW_CHARS) -> str:
    return f"left({strip(text(n))}, {chars})"


def only_string(n: str) -> str:
    """The element's single string when it holds nothing else, else null."""
    return f"coalesce(get(segs, {n}.only_seg), get(hidden, {n}.only_hidden).text)"


def is_clickable(n: str) -> str:
    return any_of(f"{n}.tag = 'button'", matches(n, attr_eq={"role": "button"}), f"array_contains({n}.classes, 'btn')")
