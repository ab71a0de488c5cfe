"""URL filter, licence scan and quality rules: odd rows against their SQL, plus what the methods promise."""

import random

import duckdb
import pytest

from crawlgrain.llm import licenses as L, quality as Q, registry, url_filter as U

PARTS = ["documents", "pages", "benchmark", "labels"]


def duck(**tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def same(df, con, sql):
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert key(map(tuple, df.select(*names).collect())) == key(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_and_sql_agree(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    same(registry.QUERIES[name](spark, folder), duck(**{t: f"{folder}/{t}.parquet" for t in PARTS}), registry.ORACLES[name])


# -- urls ----------------------------------------------------------------------------------------
URLS = [None, "", "no scheme/net/", "http://", "http://A.NET/x", "http://a.net", "HTTP://a.net?q=/net/", "ftp://user@Example.NET/en/1",
        "http://sub.example.net/en", "http://notexample.net/en/1", "http://example.com/de/", "http://www.example.com/de/a/b/c/d/e/f",
        "http://x.org/fr/1#f", "http://x.org/fr", "http://x.org//fr/", "http://ÄB.org/é/1", "http://x.org/" + "a/" * 3000, "://x.net/", "a://b://c.net/",
        "http://x.network/", "http://example.com/en/1", "http://example.com/en/2", "http://example.com/en/3"]


def pages(spark, tmp_path, urls):
    rows = [(k if k != 3 else None, u, None) for k, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def test_odd_urls(spark, tmp_path):
    folder = pages(spark, tmp_path, URLS + URLS[:9])
    found = U.op3_url_filter(spark, folder)
    same(found, duck(pages=f"{folder}/pages.parquet/*.parquet"), registry.ORACLES["op3_url_filter"])
    got = {r.page_id: r for r in found.collect()}
    assert (got[0].host, got[0].path, got[2].host, got[3] if 3 in got else None) == ("", "", "", None)
    assert (got[4].host, got[4].rule, got[4].verdict) == ("a.net", "net/", "block")
    assert (got[5].path, got[5].rule, got[6].path) == ("", None, "")
    assert (got[7].host, got[7].rule, got[7].verdict) == ("user@example.net", "net/", "block")
    assert (got[8].rule, got[9].rule, got[11].rule, got[12].rule, got[13].rule) == ("net/", "net/", "example.com/de/", "org/fr/", None)
    assert got[16].template.endswith("/**") and got[19].rule is None


def test_templates_merge_and_are_rejected(spark, tmp_path):
    """A host whose labelled branches are blocked drags the branch that looks like them, not the one that differs."""
    bad = [f"http://h.example.com/{lang}/{k}" for lang in ("de", "en") for k in range(60)]
    rules = {"example.com/de/": "block"}
    docs = spark.createDataFrame([(k, u) for k, u in enumerate(bad)], "page_id long, url string")
    got = {(r.template, r.rule, r.verdict) for r in U.filter_urls(docs, rules).collect()}
    assert got == {("/de/*", "example.com/de/", "block"), ("/en/*", None, "allow")}
    one = spark.createDataFrame([(k, f"http://h.net/{s}/{k}") for s in ("p", "q") for k in range(200)], "page_id long, url string")
    assert {r.template for r in U.filter_urls(one, {"net/p/": "block", "net/q/": "block"}).collect()} == {"/p+q/*"}
    mostly = spark.createDataFrame([(k, f"http://h.net/a/{'x' if k % 10 else 'y'}{k}") for k in range(400)], "page_id long, url string")
    assert {r.verdict for r in U.filter_urls(mostly, {"net/a/x": "block"}).collect()} == {"block"}


def judged(spark, urls, rules):
    docs = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {u: r for r in U.filter_urls(docs, rules).collect() for u in [urls[r.page_id]]}


def test_urls_without_a_label_are_rejected_by_their_template(spark):
    """A rule names a few sections; the tree finds the rest of them, and leaves what looks otherwise."""
    shops = [f"http://h.net/shop/{name}/buy/{k}" for name in ("ab", "cd", "ef") for k in range(40)]
    strays = [f"http://h.net/shop/x{k}q/buy/{k}" for k in range(12)]
    news = [f"http://h.net/news/story-of-{k}" for k in range(40)]
    got = judged(spark, shops + strays + news, {"h.net/shop/ab/": "block", "h.net/shop/cd/": "block", "h.net/shop/x1": "block"})
    assert {got[u].template for u in shops[:80]} == {"/shop/ab+cd/buy/*"}
    assert {(got[u].verdict, got[u].rule) for u in strays if not u.startswith("http://h.net/shop/x1")} == {("allow", None)}
    assert {got[u].verdict for u in news} == {"allow"} and {got[u].template for u in news} == {"/news/*"}
    found = judged(spark, [f"http://h.net/s/{'x' if k % 5 else 'y'}{k}/{k}" for k in range(100)], {"h.net/s/x": "block"})
    assert {r.verdict for u, r in found.items() if r.rule is None} == {"block"} and {r.template for r in found.values()} == {"/s/*/*"}


def test_few_labels_reject_nothing(spark):
    urls = [f"http://h.net/s/{'x' if k < 4 else 'y'}{k}" for k in range(50)]
    assert {r.verdict for u, r in judged(spark, urls, {"h.net/s/x": "block"}).items() if r.rule is None} == {"allow"}


def test_paths_that_differ_at_level_six_are_told_apart(spark):
    urls = [f"http://h.net/a/b/c/d/e/{end}/{k}" for end in ("bad", "good") for k in range(30)]
    got = judged(spark, urls, {"h.net/a/b/c/d/e/bad/": "block"})
    assert {r.template for r in got.values()} == {"/a/b/c/d/e/bad/*", "/a/b/c/d/e/good/*"}
    assert {r.verdict for u, r in got.items() if "good" in u} == {"allow"}


def test_deep_paths_equal_the_sql(spark, tmp_path):
    rng = random.Random(9)
    urls = ["http://" + rng.choice(["a.net", "b.org", "example.com"]) + "".join(
        "/" + rng.choice(["de", "fr", "en", "p", str(rng.randrange(9)), f"x{rng.randrange(3)}"]) for _ in range(rng.randrange(8))) for _ in range(900)]
    folder = pages(spark, tmp_path, urls + urls[:200])
    same(U.op3_url_filter(spark, folder), duck(pages=f"{folder}/pages.parquet/*.parquet"), registry.ORACLES["op3_url_filter"])


def test_urls_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "http://a.b/c", 5, "t")], "page_id long, url string, host int, template string")
    assert [tuple(r)[:5] for r in U.filter_urls(docs).collect()] == [(1, "a.b", "/c", None, "allow")]
    assert U.filter_urls(docs.limit(0)).collect() == []


def test_judged_paths_are_not_broadcast_and_only_hot_ones_copied(spark, tmp_path):
    """Sixteen copies of all paths used to be broadcast where the file of the paths was small enough by itself."""
    urls = ["http://a.net/hot/1"] * 200 + [f"http://h{k % 7}.net/{'xyz'[k % 3]}/{k}" for k in range(300)]
    folder = pages(spark, tmp_path, urls)
    found = U.op3_url_filter(spark, folder)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    same(found, duck(pages=f"{folder}/pages.parquet/*.parquet"), registry.ORACLES["op3_url_filter"])
    paths = spark.createDataFrame([("a", ["p"], 200), ("a", ["q"], 63), ("b", ["p"], 64), ("", [], 1)], "host string, segments array<string>, n long")
    assert sorted((r.host, *r.segments) for r in paths.where(U._hot_sql(paths)).collect()) == [("a", "p"), ("b", "p")]
    assert paths.where(U._hot_sql(paths.limit(0))).collect() == []


def test_url_plan_is_native(spark):
    plan = U.op3_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# -- licences ------------------------------------------------------------------------------------
def test_odd_texts_of_licences(spark, table):
    rows = [(1, None), (2, ""), (3, " \n \n"), (4, "released UNDER the mit--license"), (5, "x\n\nReleased under\nthe MIT License.\n\ny"),
            (6, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."), (6, "Released under the MIT License."),
            (7, "word " * 20000), (8, "This work is licensed under the GNU General Public License, version 3"), (9, "license"),
            (10, "the the the the the the the"), (None, "Licensed under CC BY-NC 4.0."), (11, L.TEMPLATES["ISC"].replace(" ", "\n"))]
    folder = table(*rows)
    found = L.op7_licenses(spark, folder)
    same(found, duck(documents=f"{folder}/documents.parquet/*.parquet"), registry.ORACLES["op7_licenses"])
    got = {r.doc_id: (r.license, r.licenses) for r in found.collect() if r.doc_id != 6}
    assert got[4] == got[5] == ("MIT", "MIT") and got[8][0] == "GPL-3.0" and got[None][0] == "CC-BY-NC-4.0" and got[11][0] == "ISC"
    assert got[1] == got[2] == got[3] == got[7] == got[9] == got[10] == (None, "")
    assert ("Apache-2.0", "Apache-2.0,MIT") in {(r.license, r.licenses) for r in found.collect()}


def test_licence_columns_and_plan(spark, docs_of):
    found = L.scan(docs_of((1, "Released under the MIT License.")).selectExpr("*", "1 AS License", "2 AS `a b`", "3 AS __x"))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "a b", "__x", "license", "dice", "licenses"]
    assert found.first().dice == 1.0
    plan = L.op7_licenses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert L.scan(docs_of()).collect() == []


# -- quality -------------------------------------------------------------------------------------
PROSE = " ".join(f"wor{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))


def test_odd_texts_of_quality(spark, table):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c a b c"), (5, "é\xa0ü x\u2003y"), (6, "line\nline\n \nline \n\nline"), (7, "$$$ ### " * 40),
            (8, "same words again " * 30), (9, PROSE), (9, PROSE),
            (10, "1 2 3 4 " * 200), (11, "x" * 5000), (12, " ".join(f"w{k}" for k in range(30000))), (None, "a"), (13, "a\x0bb\x0cc\x1cd")]
    folder = table(*rows)
    found = Q.op9_quality(spark, folder)
    same(found, duck(documents=f"{folder}/documents.parquet/*.parquet"), registry.ORACLES["op9_quality"])
    got = {r.doc_id: r for r in found.collect()}
    assert got[9].kept and not got[1].kept and got[4].n_repeat_words == 6 and got[6].n_dup_lines == 2


def test_rules_run_by_rejection_per_cost(docs_of):
    rules = {"dear": lambda d: True, "cheap": lambda d: True, "never": lambda d: False}
    measured = {"dear": (1e-3, 1.0), "cheap": (1e-6, 0.5), "never": (1e-9, 0.0)}
    assert Q.order_rules(measured, rules) == ["cheap", "dear", "never"]
    assert Q.order_rules({}, rules) == list(rules)
    found = Q.measure(docs_of(*[(k, f"text {k}") for k in range(50)]), Q.RULES)
    assert set(found) == set(Q.RULES) and found["few_words"][1] == 1.0 and found["symbols"][1] == 0.0


def test_a_cascade_stops_at_the_first_rejection(docs_of):
    def never_reached(d):
        raise AssertionError("asked although an earlier rule rejected")

    docs = docs_of((1, "a b")).selectExpr("*", "1 AS k0", "2 AS KEPT")
    order = Q.order_rules
    try:
        Q.order_rules = lambda measured, rules: ["first", "second"]
        measure, Q.measure = Q.measure, lambda docs, rules: {}
        out = Q.cascade(docs, {"second": never_reached, "first": lambda d: True})
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "k0", "kept"] and not out.first().kept
    finally:
        Q.order_rules, Q.measure = order, measure
    assert Q.cascade(docs_of()).collect() == []
