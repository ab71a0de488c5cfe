"""Thresholds, order and ties of the page features."""

import random
import time

import pytest
from pyspark.sql import functions as F

from crawlgrain.operators import dom as D, page_features as P, selectors as S


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or ("page_id",))).collect()]


def test_keyword_order_and_limit(dom_of):
    text = "beta alpha beta gamma_1 été_x abc " + " ".join(f"word{i:02d}" for i in range(30))
    got = rows(P.keyword_density(dom_of(f"<p>{text}</p>")), "rank")
    assert [r[2:] for r in got[:4]] == [("beta", 2), ("alpha", 1), ("gamma_1", 1), ("été_x", 1)]
    assert len(got) == 20 and got[-1][2] == "word15"


def test_words_join_across_elements(dom_of):
    assert rows(P.keyword_density(dom_of("<li>The</li><li>and</li>")))[0][2] == "theand"


def test_keywords_of_a_page_without_words(dom_of):
    assert rows(P.keyword_density(dom_of("<p>a b</p>", "", None))) == []


def test_text_ratio(dom_of):
    got = rows(P.text_ratio(dom_of("<p> ab </p>", "", None)))
    assert got == [(1, 2, 11, 0.18), (2, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_components_and_hierarchy(dom_of):
    dom = dom_of("<header></header><nav></nav><div class='a-modal'></div><div class='popup x'></div><main class=body></main>")
    assert rows(P.components(dom)) == [(1, 2, 0, 0, 2, 0, 0)]
    assert rows(P.content_hierarchy(dom)) == [(1, 0, 0, 1, 0, 0, 1, 1)]


def test_seo_last_tag_wins(dom_of):
    html = ("<meta name=a content=1><meta property=b><meta name=a content=2><meta name='' itemprop=c content=3>"
            "<meta charset=u>")
    assert rows(P.seo_meta(dom_of(html)), "key") == [(1, "a", "2"), (1, "b", None), (1, "c", "3")]


def test_frameworks_need_a_source(dom_of):
    dom = dom_of("<script src='/x/ReAct.js'></script><script>vue</script><script src=''></script>")
    assert rows(P.frameworks(dom)) == [(1, True, False, False)]


def test_structured_data_skips_bad_json(dom_of):
    ld = "<script type='application/ld+json'>{}</script>"
    dom = dom_of(ld.format('{"@type": "A"}') + ld.format("{bad") + ld.format("[1, 2]") + ld.format(""))
    got = P.structured_data(dom).select("ord", F.to_json("data")).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(0, '{"@type":"A"}'), (1, "[1,2]")]


def test_pagination_sees_comments_and_scripts(dom_of):
    got = rows(P.pagination_patterns(dom_of("<!-- Page 3 --><a href='/next'></a><i data-page></i>",
                                            "<script>Page 12</script>", "<p>Page x</p>")), "page_id", "ord")
    assert got == [(1, 0, "page_numbers"), (1, 1, "next_buttons"), (1, 2, "data_attributes"), (2, 0, "page_numbers")]


@pytest.mark.parametrize("piece, name, least", [
    ("<li>x</li>", "list_items", 6), ("<b class=cardbox>x</b>", "cards", 4), ("<tr><td>x</td></tr>", "table_rows", 4),
    ("<div class='post'>x</div>", "articles", 3), ("<h2>x</h2>", "headings", 4)])
def test_extraction_thresholds(dom_of, piece, name, least):
    got = P.extraction_heuristics(dom_of(piece * (least - 1), piece * least)).collect()
    assert [(r.page_id, r.pattern, r["count"]) for r in got] == [(2, name, least)]


def test_extraction_order_and_sample(dom_of):
    html = "<h1> </h1><h1>b</h1><h2>c</h2><h3>" + "d" * 60 + "</h3><tr>e</tr><tr>f</tr><tr>g</tr><tr></tr>"
    got = rows(P.extraction_heuristics(dom_of(html)), "rank")
    assert [(r[1], r[2], r[4], r[5]) for r in got] == [
        (1, "table_rows", ["e", "f", "g"], 4), (2, "headings", ["b", "c", "d" * 50], 4)]


def test_content_patterns(dom_of):
    kids = "<p class='a b'></p><p class='b'></p><p class='c b'></p>"
    htmls = [
        f"<div id=x>{kids}<i></i></div>",                                   # shared class b
        "<div><p class=a></p><p class=b></p><p class=a></p></div>",         # no shared class
        "<div><p class=a></p><p></p><p></p></div>",                         # not all classed
        "<div><p><i></i><i></i></p><p></p><p></p></div>",                   # sizes differ by 2
        "<div><p><i></i><i></i><i></i></p><p></p><p></p></div>",            # by 3
        "<span><p></p><p></p><p></p></span><div><p></p><i></i><p></p></div>",
    ]
    got = rows(P.content_patterns(dom_of(*htmls)), "page_id", "ord")
    assert got == [(1, 0, "#x", "#x > p", 4, "high"), (3, 0, "div", "div > p", 3, "medium"),
                   (4, 0, "div", "div > p", 3, "medium")]


def test_list_patterns_group_by_node(dom_of):
    lis = "<li>a</li>" * 5
    got = rows(P.list_patterns(dom_of(f"<ul>{lis}</ul><ul>{lis}</ul>", "<ul>" + "<li>a</li>" * 4 + "</ul>" + "<li>b</li>",
                                      lis)), "page_id", "ord")
    assert got == [(1, 0, "ul", "ul > li", 5, "high"), (1, 1, "ul", "ul > li", 5, "high"),
                   (3, 0, "[document]", "[document] > li", 5, "high")]


def test_best_pattern_prefers_the_first(dom_of):
    lis = "<li>a</li>" * 5
    assert rows(P.best_pattern(dom_of(f"<ul id=u>{lis}</ul>"))) == [(1, "#u", "#u > li", 5, "medium")]


def test_outline_limits(dom_of):
    deep = "<div>" + "<p><b></b></p>" * 12 + "</div>"
    fourth = "<a><b><i>" + "<u></u>" * 12 + "</i></b></a>"
    lines = [r.line for r in P.dom_outline(dom_of(f"<body class='k l'>{deep}{fourth}</body>")).orderBy("line_no").collect()]
    assert lines == (["|_ body.k.l", " |_ div"] + ["  |_ p", "   |_ b"] * 10 + ["  |_ ... (2 more)"]
                     + [" |_ a", "  |_ b", "   |_ i", "    |_ ... (2 more)"])


def test_outline_cuts_late_branches(dom_of):
    html = "<body>" + "<p></p>" * 10 + "<div><i></i></div><div></div></body>"
    lines = [r.line for r in P.dom_outline(dom_of(html, "<p>no body</p>")).orderBy("line_no").collect()]
    assert lines == ["|_ body"] + [" |_ p"] * 10 + [" |_ ... (2 more)"]


def test_has_ancestor(dom_of):
    html = "<div class=pages><p><a>1</a></p></div><a>2</a><div class=pages><a>3</a></div>"
    hits = D.has_ancestor(dom_of(html), lambda n: f"{n}.tag = 'a'", lambda n: f"array_contains({n}.classes, 'pages')")
    assert [r.node_id for r in hits.orderBy("node_id").collect()] == [2, 5]


def below(dom):
    """Ids of ``a`` nodes below a ``ul`` or ``.pages``, by walking up from each."""
    nodes = dom.first().nodes
    up = lambda n: [] if n.parent_id < 0 else [nodes[n.parent_id], *up(nodes[n.parent_id])]
    return [n.node_id for n in nodes if n.tag == "a" and any(p.tag == "ul" or "pages" in p.classes for p in up(n))]


A, LIST, PAGED = (lambda n: f"{n}.tag = 'a'"), (lambda n: f"{n}.tag = 'ul'"), (lambda n: f"array_contains({n}.classes, 'pages')")


@pytest.mark.parametrize("seed", range(6))
def test_has_ancestor_equals_a_walk(dom_of, seed):
    rng = random.Random(seed)
    html = "".join(rng.choice(["<ul>", "</ul>", "<a>", "</a>", "<div class=pages>", "</div>", "<p>", "</p>"]) for _ in range(80))
    dom = dom_of(html)
    hits = D.has_ancestor(dom, A, lambda n: f"({LIST(n)} OR {PAGED(n)})")
    assert [r.node_id for r in hits.orderBy("node_id").collect()] == below(dom)


def test_has_ancestor_with_repeated_and_null_page_ids(spark):
    rows = [(1, "u", "<div><p><i></i></p><a>x</a></div>"), (1, "u", "<ul><li></li><li></li><li></li><li></li></ul>"),
            (None, "u", "<ul><a>in</a></ul>"), (None, "u", "<a>out</a>")]
    dom = D.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = D.has_ancestor(dom, A, LIST).collect()
    assert [(r.page_id, r.node_id) for r in got] == [(None, 1)]


def test_several_ancestor_rules_in_one_pass(dom_of):
    dom = dom_of("<ul><a>1</a><div class=pages><a>2</a></div></ul><a>3</a>")
    found = D.has_ancestors(dom, {"list": (A, LIST), "paged": (A, PAGED), "none": (PAGED, PAGED)})
    assert sorted((r.rule, r.node_id) for r in found.collect()) == [("list", 1), ("list", 3), ("paged", 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and plan.count("MapInArrow") == 1


def test_has_ancestor_grows_with_the_nodes(dom_of):
    def seconds(n):
        dom = dom_of("<ul><li><a>x</a></li></ul>" * n)
        times = []
        for _ in range(3):
            start = time.perf_counter()
            assert D.has_ancestor(dom, A, LIST).count() == n
            times.append(time.perf_counter() - start)
        return min(times)

    seconds(500)
    assert seconds(8000) < 2.5 * seconds(4000) + 0.3


def test_element_text(dom_of):
    got = rows(D.node_text(dom_of("<div> a <b>b</b><script>c</script></div>"), tags=["div", "script"]), "node_id")
    assert got == [(1, 0, "div", " a b", "a b"), (1, 2, "script", "c", "c")]


def test_snapshot_reasons(dom_of):
    def pair(static, later):
        return P.snapshot_diff(dom_of(static), dom_of(later)).collect()[0]

    pad = "<!--" + "x" * 4000 + "-->"
    assert pair(pad, pad).is_dynamic is False
    assert pair("<p>a</p>", "<p>a</p>" + pad).grown_by == "html"
    assert pair(pad + "<p>aaaa</p>", pad + "<p>aaaaa</p>").grown_by == "text"
    assert pair(pad, pad + "<p class=grid></p>").grown_by == "containers"
    assert pair(pad, pad + "<li class=post></li>").grown_by == "items"
    assert pair(pad + "<form></form>", pad + "<form></form><form></form>").grew_50pct is True


# -- selectors -----------------------------------------------------------------------------------
def strategies(dom):
    return [(r.selector, r.reliability, r["count"]) for r in S.selector_strategies(dom).orderBy("target", "rank").collect()]


@pytest.mark.parametrize("uses, score", [(4, 0.8), (5, 0.6), (19, 0.6), (20, 0.4)])
def test_class_strategy_score(dom_of, uses, score):
    html = "<main class=list></main>" + "<i class='list z'></i>" * (uses - 1)
    assert strategies(dom_of(html)) == [(".list", score, uses)]


def test_strategy_order(dom_of):
    html = "<body id=b><p></p><div id=d class='content' role=main title=t style=s>a long enough text here</div></body>"
    assert strategies(dom_of(html)) == [
        ("#d", 0.9, None), (".content", 0.8, 1), ("#b > div:nth-child(1)", 0.8, None)]


def test_parent_class_text_and_attribute_strategies(dom_of):
    html = "<body class='k l'>" + "<u class=list></u>" * 4 + "<main class=list lang=en>a long enough text here</main></body>"
    assert strategies(dom_of(html)) == [
        (".k.l > main:nth-child(1)", 0.7, None), ("main[lang='en']", 0.7, None), (".list", 0.6, 5)]


def test_suggestions(dom_of):
    html = (f"<p id=long>{'x' * 101}</p><p id=short>{'x' * 100}</p><article class='main-a b content-c'></article>"
            "<main id=content class=main></main>")
    assert [r.suggestion for r in S.selector_suggestions(dom_of(html)).orderBy("ord").collect()] == [
        "High-content IDs: #long", "Main content containers: .main-a, .content-c, #content"]


def test_interactive_elements(dom_of):
    html = ("<button class='many'>Load more of it all, please, right now!</button>" + "<i class=many></i>" * 4
            + "<div id=p><a href='#'>View</a><span role=button class='many rare'>Next</span></div>"
            "<button>Stop</button><div class=pagination><a>1</a></div><b aria-label='page 2'>2</b>")
    got = [tuple(r)[2:] for r in S.interactive_elements(dom_of(html)).orderBy("ord").collect()]
    assert got == [("button", "Load more of it all, please, r", "button"), ("#p > a:nth-child(1)", "View", "button"),
                   (".rare", "Next", "button"), ("a", "1", "pagination"), ("b", "2", "pagination")]
