"""Hand-made documents with known node tables."""

import pytest

from crawlgrain.functions.dom_kernel import NODE_FIELDS, parse_html

NAMES = [name for name, _ in NODE_FIELDS]


def parse(html):
    columns, segs, hidden, warning = parse_html(html)
    nodes = [dict(zip(NAMES, row)) for row in zip(*map(list, columns))]
    return nodes, segs, hidden, warning


def tags(html):
    return [(n["tag"], n["parent_id"]) for n in parse(html)[0]]


@pytest.mark.parametrize("html, expected", [
    ("<p>a<br>b<img src=x></p>", [("p", -1), ("br", 0), ("img", 0)]),
    ("</i><p>a</i></p>", [("p", -1)]),
    ("<p><b>a<br><p>b</p></div>", [("p", -1), ("b", 0), ("br", 1), ("p", 1)]),
    ("<ul><li>a<ul><li>b</li></ul></li></ul>", [("ul", -1), ("li", 0), ("ul", 1), ("li", 2)]),
    ("<DIV><Br/><SPAN/>x</DIV>", [("div", -1), ("br", 0), ("span", 0)]),
    ('<script>var a = "</p><b>";</script><p>', [("script", -1), ("p", -1)]),
    ("", []),
])
def test_tree_shape(html, expected):
    assert tags(html) == expected


def test_end_tag_closes_nearest_of_its_name():
    nodes = parse("<div><p><b>x</div><i>y</i>")[0]
    assert [(n["tag"], n["parent_id"], n["subtree_end"]) for n in nodes] == [
        ("div", -1, 2), ("p", 0, 2), ("b", 1, 2), ("i", -1, 3)]


def test_strings():
    nodes, segs, hidden, _ = parse("<p>a&amp;b&copy;&#65;&#x42;&nope;c<!--k-->d \n <b> \t </b></p>")
    assert segs == ["a&b©AB&nopec", "d \n ", " "]
    assert hidden == [(0, "comment", "k")]
    assert (nodes[0]["t0"], nodes[0]["t1"], nodes[1]["t0"], nodes[1]["t1"]) == (0, 3, 2, 3)


def test_blank_strings_collapse_outside_pre():
    assert parse("<div> \n  <p>   </p><pre>  \n </pre></div>")[1] == ["\n", " ", "  \n "]


def test_windows_and_bad_character_references():
    assert parse("<p>&#150;&#1114112;&#55296;</p>")[1] == ["–\N{REPLACEMENT CHARACTER}\N{REPLACEMENT CHARACTER}"]


def test_hidden_text():
    nodes, segs, hidden, _ = parse("<style>s</style><template>t<p>u</p></template><!DOCTYPE html><p>v</p>")
    assert segs == ["v"]
    assert hidden == [(0, "style", "s"), (1, "template", "t"), (2, "template", "u"), (-1, "doctype", "DOCTYPE html")]


def test_attributes():
    node = parse('<p ID=a class=" x  y\n" hidden data-k="1" data-k="2">')[0][0]
    assert list(node["attrs"]) == [("id", "a"), ("class", " x  y\n"), ("hidden", ""), ("data-k", "2")]
    assert node["id"] == "a" and list(node["classes"]) == ["x", "y"]


def test_sibling_numbers_and_lone_strings():
    nodes, segs, hidden, _ = parse("<div><p>a</p><i>b</i><p><b>c</b></p>d</div><script>e</script>")
    assert [(n["elem_idx"], n["tag_idx"], n["tag_total"], n["n_children"]) for n in nodes] == [
        (1, 1, 1, 3), (1, 1, 2, 0), (2, 1, 1, 0), (3, 2, 2, 1), (1, 1, 1, 0), (2, 1, 1, 0)]
    lone = [segs[n["only_seg"]] if n["only_seg"] is not None else None for n in nodes]
    assert lone == [None, "a", "b", "c", "c", None]
    assert hidden[nodes[5]["only_hidden"]][2] == "e"


def test_intervals_nest():
    nodes = parse("<div>" + "<p><b>x<i>y</p>" * 50 + "<ul><li>a<li>b</ul></div>")[0]
    for n in nodes:
        assert n["subtree_end"] >= n["node_id"]
        if n["parent_id"] >= 0:
            parent = nodes[n["parent_id"]]
            assert parent["node_id"] < n["node_id"] <= n["subtree_end"] <= parent["subtree_end"]
            assert parent["t0"] <= n["t0"] <= n["t1"] <= parent["t1"]
    roots = sum(n["parent_id"] < 0 for n in nodes)
    assert sum(n["n_children"] for n in nodes) == len(nodes) - roots


def test_large_page():
    nodes, segs, _, warning = parse("<div>" + "<p>some words here</p>" * 50_000 + "</div>")
    assert (len(nodes), len(segs), warning) == (50_001, 50_000, None)


def test_null_and_failing_pages_give_a_warning():
    assert parse(None)[0] == [] and parse(None)[3] == "no html"
    assert parse(3)[0] == [] and "Error" in parse(3)[3]


def test_dom_rows_survive_spark(dom_of):
    rows = dom_of("<div id=a class='x y'><p>t</p></div>", None).orderBy("page_id").collect()
    assert rows[0].nodes[0].attrs == {"id": "a", "class": "x y"} and rows[0].nodes[0].classes == ["x", "y"]
    assert rows[0].segs == ["t"] and rows[0].warning is None
    assert rows[1].nodes == [] and rows[1].warning == "no html" and rows[1].html_len == 0
