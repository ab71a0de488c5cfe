"""Whole-page analysis, briefs, incremental runs, language, page stream."""

import time

import pytest
from pyspark.sql import functions as F

from crawlgrain.operators import cache, language, selectors as S
from crawlgrain.operators.cache import cache_key
from crawlgrain.plans import analysis as A
from crawlgrain.sources import tables
from crawlgrain.streaming import pages as page_streams

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"
CACHE = page_streams.CACHE_SCHEMA

RICH = (
    "<html><head><title>Shop</title><meta name=description content=d><script src=/react.js></script>"
    "<script type='application/ld+json'>{\"a\": 1}</script></head><body><main id=main class=content>"
    + "<div class='item card' data-x=1><h2 class=title>Product name</h2><span class=price>9</span></div>" * 4
    + "</main><form></form><table></table><button>Load more</button><div class=pagination><a href='?page=2'>2</a></div>"
    "<p>" + "some product words to make the text long enough " * 8 + "</p></body></html>")


def test_rich_page(spark):
    pages = spark.createDataFrame([(1, "http://h/1", RICH)], PAGES)
    robots = spark.createDataFrame([("h", 200, "User-agent: *", None)], "host string, status int, body string, error string")
    headers = spark.createDataFrame([(1, "X-Frame-Options", "DENY")], "page_id long, name string, value string")
    analysed = A.analyze_pages(pages, robots=robots, headers=headers)
    row = analysed.collect()[0]
    assert row.is_dynamic and row.frameworks.react and row.archetype == "dynamic_content"
    assert row.robots_txt == "User-agent: *" and row.seo_meta == {"description": "d"} and row.structured_data == ['{"a": 1}']
    assert row.recommendations == [
        "Use Playwright/Selenium for JavaScript rendering",
        "React framework detected: Wait for dynamic content to load",
        "Found 1 forms: Consider form submission handling",
        "Found 1 tables: Use pandas for structured data extraction",
        "Security headers detected: Consider using proper headers in requests",
        "Pagination detected: Implement pagination handling",
        "Interactive pagination detected: Implement pagination navigation",
        "Load more functionality detected: Implement click interaction to get all content",
        "Repeating content pattern detected: Use selector '#main > div' for content items",
        "Extraction pattern 'cards' found 4 items with selector '[class*=\"card\"], [class*=\"item\"], [class*=\"box\"], "
        "[class*=\"tile\"], [class*=\"product\"]'",
        "Selector suggestion: Main content containers: #main",
    ]
    assert row.warnings == ["Language detection not available", "Dynamic analysis skipped: no rendered snapshot"]
    brief = A.page_brief(analysed).collect()[0].brief.split("\n")
    assert brief[:3] == ["- Dynamic content: Yes", "- Components detected: forms (1), buttons (1), tables (1)",
                         "- Frameworks: react"]
    assert "- Interactive buttons detected: 1 (e.g., Load more)" in brief and "- Security headers: X-Frame-Options" in brief
    assert "  * #main > div (4 items, high confidence)" in brief and "  * price: .price" in brief
    assert not any(line.startswith(("- APIs", "- Load time")) for line in brief)


def test_failed_page_keeps_a_default_row(spark):
    pages = spark.createDataFrame([(1, "http://h/1", None), (2, "http://h/2", "<p>plain words only, static page</p>")], PAGES)
    bad, good = A.analyze_pages(pages).orderBy("page_id").collect()
    assert bad.recommendations == [A.FAILED_PAGE] and bad.warnings[0] == "Static analysis error: no html"
    assert bad.components.forms == 0 and bad.text_ratio == 0.0 and bad.is_dynamic and bad.keyword_density == []
    assert good.recommendations == ["Static content: Use Requests + BeautifulSoup for efficient scraping"]
    briefs = A.page_brief(A.analyze_pages(pages)).orderBy("page_id").collect()
    assert briefs[0].brief.startswith("- Dynamic content: Yes\n- Components detected:")


def test_rendered_page_decides_and_raises_counts(spark):
    static = spark.createDataFrame([(1, "u1", "<p>a</p>"), (2, "u2", "<p>some static text</p>")], PAGES)
    later = spark.createDataFrame([(1, "u1", "<p>a</p>" + "<form></form>" * 3)], PAGES)
    one, two = A.analyze_pages(static, rendered=later).orderBy("page_id").collect()
    assert one.is_dynamic and one.components.forms == 3
    assert not two.is_dynamic and "Dynamic analysis skipped: no rendered snapshot" in two.warnings


def entries(pages, analysis="stored"):
    return pages.select(
        cache_key(F.col("url")).alias("cache_key"), "url", F.lit(50.0).alias("cache_time"), F.lit(1).cast("long").alias("size_bytes"),
        F.lit(True).alias("readable"), F.lit(1).cast("long").alias("version"), F.lit(analysis).alias("analysis"))


def test_incremental_is_complete(spark):
    pages = tables.load_pages(spark, SF)
    got = A.analyze_incremental(pages, entries(pages.filter("page_id % 2 = 0")), 100.0).collect()
    assert sorted(r.page_id for r in got) == sorted(r.page_id for r in pages.select("page_id").collect())
    assert all(r.origin == ("fresh" if r.page_id % 2 else "cache") for r in got)
    assert {r.analysis for r in got if r.origin == "cache"} == {"stored"}
    whole = {r.page_id: r.analysis for r in A.as_stored(A.analyze_pages(pages)).collect()}
    assert all(r.analysis == whole[r.page_id] and "selector_strategies" in r.analysis for r in got if r.origin == "fresh")


def test_incremental_after_the_cache_was_rewritten(spark, tmp_path):
    """Another writer replaces the cache between calls: each call answers for the cache it finds."""
    pages = spark.createDataFrame([(1, "u1", "<p>a</p>"), (2, "u2", "<p>b</p>")], PAGES)
    path = str(tmp_path / "cache")
    for ids in ([1], [1, 2], [2]):
        entries(pages.filter(F.col("page_id").isin(ids))).write.mode("overwrite").parquet(path)
        got = A.analyze_incremental(pages, spark.read.parquet(path), 100.0).collect()
        assert sorted((r.page_id, r.origin) for r in got) == [(i, "cache" if i in ids else "fresh") for i in (1, 2)]


def test_cache_round_trip_with_pruned_buckets(spark, tmp_path):
    pages = tables.load_pages(spark, SF)
    path = str(tmp_path / "cache")
    cache.write_cache(entries(pages), path, buckets=16, files_per_bucket=1)
    keys = entries(pages.filter("page_id < 3")).select("cache_key")
    read = cache.read_cache(spark, path, keys, buckets=16)
    assert keys.join(read, "cache_key").count() == 3 and read.count() < pages.count()
    assert cache.read_cache(spark, path).count() == pages.count()
    assert cache.clear_cache(read).count() == 0


def test_language_on_unseen_documents(spark):
    docs = tables.base_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang", "text")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(5)) > 0
    guesses = language.detect_language(
        docs.filter(~seen).select(F.col("doc_id").alias("page_id"), F.left("text", F.lit(1000)).alias("sample")),
        language.train_profiles(docs.filter(seen)))
    joined = guesses.join(docs, guesses.page_id == docs.doc_id)
    right, total = joined.agg(F.count_if(F.col("lang") == F.col("language")), F.count("*")).collect()[0]
    assert total > 100 and right / total > 0.95


def plain_scores(samples, weights):
    """The language of each sample by one sum per word and gram."""
    names = sorted({lang for lang, _, _ in weights})
    table = {(lang, gram): w for lang, gram, w in weights}
    out = []
    for sample in samples:
        total, known = dict.fromkeys(names, 0), False
        for word in (sample or "").split():
            padded = f" {word} "
            for size in (1, 2, 3):
                for i in range(len(padded) - size + 1):
                    for lang in names:
                        w = table.get((lang, padded[i : i + size]), 0)
                        total[lang], known = total[lang] + w, known or w > 0
        out.append(max(names, key=lambda n: (total[n], [-ord(c) for c in n])) if known else "")
    return out


def test_hashed_scores_equal_plain_sums(spark):
    import random
    rng = random.Random(4)
    letters = "abcéü中\U0001d538"
    grams = sorted({"".join(rng.choices(letters + " ", k=rng.randint(1, 3))) for _ in range(150)} - {"  ", "   "})
    weights = [(lang, g, rng.randint(1, 9)) for lang in ("aa", "bb", "cc") for g in grams if rng.random() < 0.6]
    samples = ["", None, "a", "zzz", *[" ".join("".join(rng.choices(letters + "x", k=rng.randint(1, 7))) for _ in range(rng.randint(1, 9))) for _ in range(60)]]
    languages, table = language.weight_table(spark.createDataFrame(weights, "lang string, gram string, weight long"))
    assert table.shape == (3, 1 << language.BUCKET_BITS)
    assert language.score_samples([s or "" for s in samples], languages, table) == plain_scores(samples, weights)
    assert language.score_samples([], languages, table) == []


def test_buckets_agree_between_engines(spark):
    import numpy as np
    grams = [" a", "b", "xyz", "é中 ", "\U0001d538b", "中"]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(language.bucket_of(F.col("g"))).collect()]
    codes = [np.array([ord(c) for c in g], dtype=np.uint64) for g in grams]
    assert got == [int(language.buckets_of(c, len(c))[0]) for c in codes]


def test_no_profiles_give_no_language(spark):
    none = spark.createDataFrame([], "lang string, gram string, weight long")
    assert language.score_samples(["abc", ""], *language.weight_table(none)) == ["", ""]


def test_language_of_texts_without_words(spark):
    profiles = spark.createDataFrame([("xx", "a", 5)], "lang string, gram string, weight long")
    samples = spark.createDataFrame([(1, ""), (2, "12 34"), (3, "a"), (4, "zzz"), (5, None)], "page_id long, sample string")
    got = {r.page_id: r.language for r in language.detect_language(samples, profiles).collect()}
    assert got == {1: "", 2: "", 3: "xx", 4: "", 5: ""}


def test_grams_stay_inside_words(spark):
    grams = spark.createDataFrame([("Ab, c",)], "t string").select(language.grams_of(F.col("t")).alias("g")).collect()[0].g
    assert sorted(grams) == sorted([" ", "a", "b", " ", " ", "c", " ", " a", "ab", "b ", " c", "c ", " ab", "ab ", " c "])


def test_network_tables_are_independent(spark):
    pages = spark.createDataFrame([(k, f"u{k}", "<p>a</p>") for k in (1, 2, 3)], PAGES)
    resources = spark.createDataFrame(
        [(1, 1, "r1", "xhr", "xmlhttprequest", "GET"), (2, 2, "r2", "image", "img", "GET")],
        "seq long, page_id long, url string, resource_type string, initiator_type string, method string")
    times = spark.createDataFrame(
        [(1, 90.5, 40.0, None, None, None), (3, None, None, 300.0, 250.0, 100.0)],
        "page_id long, nav_load_end double, nav_dom_end double, timing_load_end double, timing_dom_end double, navigation_start double")

    def found(**given):
        return {r.page_id: r for r in A.analyze_pages(pages, **given).collect()}

    both = found(resources=resources, navigation=times)
    assert [tuple(both[k].performance_metrics) for k in (1, 2, 3)] == [(90.5, 40.0, 8, 1, 1), (0.0, 0.0, 8, 1, 0), (200.0, 150.0, 8, 0, 0)]
    only = found(resources=resources)
    assert [a.url for a in only[1].apis] == ["r1"] and only[1].performance_metrics.ajax_count == 1 and only[3].performance_metrics is None
    timed = found(navigation=times)
    assert timed[1].apis is None and timed[1].performance_metrics.load_time == 90.5 and timed[2].performance_metrics is None
    briefs = {r.page_id: r.brief for r in A.page_brief(A.analyze_pages(pages, resources=resources, navigation=times)).collect()}
    assert "- Load time: 90.5ms" in briefs[1] and "- Load time: 200ms" in briefs[3]


def test_rendered_page_gives_elements_and_size(spark):
    static = spark.createDataFrame([(1, "u1", "<p>a</p>")], PAGES)
    html = "<p>a</p><button>Load more</button><div class=pager><a href=x>2</a></div>"
    times = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0, 1.0)], "page_id long, nav_load_end double, nav_dom_end double, "
                                  "timing_load_end double, timing_dom_end double, navigation_start double")
    row = A.analyze_pages(static, rendered=spark.createDataFrame([(1, "u1", html)], PAGES), navigation=times).first()
    assert [e.type for e in row.interactive_elements] == ["button", "pagination"]
    assert row.performance_metrics.dom_size == len(html) and row.html_len == 8


def nested(kind, n):
    if kind == "links":
        return "<span class=pag></span>" * n + "<a href=x>1</a>" * n
    return "".join(f"<div id=i{k}>" for k in range(n)) + "some words" * 20 + "</div>" * n


@pytest.mark.parametrize("kind, sql", [("links", S.interactive_elements_sql), ("ids", S.selector_suggestions_sql)])
def test_row_operators_are_linear(spark, kind, sql):
    from crawlgrain.functions.dom_kernel import parser  # noqa: F401
    from crawlgrain.operators.dom import parse_pages

    def seconds(n):
        dom = parse_pages(spark.createDataFrame([(1, "u", nested(kind, n))], PAGES)).localCheckpoint()
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            dom.selectExpr(f"size({sql()}) AS n").collect()
            best = min(best, time.perf_counter() - start)
        return best

    seconds(500)
    assert seconds(8000) < 2.5 * seconds(4000) + 0.5


def test_page_stream_equals_batch(spark, tmp_path):
    pages = tables.load_pages(spark, SF)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    pages.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(source)
    query = page_streams.stream_analyze(stream, out, str(tmp_path / "checkpoint"), clock=lambda: 5.0)
    query.awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("page_id", "analysis").collect()))
    assert key(spark.read.parquet(f"{out}/analysis")) == key(A.as_stored(A.analyze_pages(pages)))
    assert spark.read.parquet(f"{out}/analysis").select("batch").distinct().count() == 3
    assert spark.read.parquet(f"{out}/cache").count() == pages.count()


def test_page_stream_skips_pages_of_earlier_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def land(*rows):
        spark.createDataFrame(list(rows), PAGES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PAGES).parquet(source)
        page_streams.stream_analyze(stream, out, str(tmp_path / "checkpoint"), clock=lambda: 5.0).awaitTermination()

    land((1, "u1", "<p>a</p>"), (2, "u2", "<p>b</p>"))
    land((2, "u2", "<p>b</p>"), (3, "u3", "<p>c</p>"))
    got = spark.read.parquet(f"{out}/analysis").select("batch", "page_id").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (0, 2), (1, 3)]


def test_page_stream_uses_its_clock_and_context_and_compacts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(page_streams, "COMPACT_EVERY", 2)
    source, out, now = str(tmp_path / "in"), str(tmp_path / "out"), [5.0]
    robots = spark.createDataFrame([("h", 200, "all welcome", None)], "host string, status int, body string, error string")

    def land(*rows):
        spark.createDataFrame(list(rows), PAGES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PAGES).parquet(source)
        page_streams.stream_analyze(stream, out, str(tmp_path / "checkpoint"), lambda: now[0],
                                    context=lambda: {"robots": robots}).awaitTermination()

    page = lambda k: (k, f"http://h/{k}", "<p>a</p>")
    land(page(1), (9, "http://h/1", "<p>the same url</p>"))
    land(page(2))
    land(page(1), page(3))                       # page 1 is known, also after the compaction of this batch
    now[0] += 2 * 86_400
    land(page(1))                                # by now its entry is stale
    land(page(1), page(2))
    got = spark.read.parquet(f"{out}/analysis").select("batch", "page_id", "analysis").collect()
    assert sorted((r.batch, r.page_id) for r in got) == [(0, 1), (1, 2), (2, 3), (3, 1), (4, 2)]
    assert all('"robots_txt":"all welcome"' in r.analysis for r in got)


def test_page_stream_keeps_pages_without_url_or_id(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, None, "<p>a</p>"), (2, None, "<p>b</p>"), (3, "u3", "<p>c</p>"), (4, "u3", "<p>d</p>"), (None, "u5", "<p>e</p>"), (None, None, "<p>f</p>")]
    spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(PAGES).parquet(source)
    page_streams.stream_analyze(stream, out, str(tmp_path / "checkpoint"), clock=lambda: 5.0).awaitTermination()
    got = spark.read.parquet(f"{out}/analysis").select("page_id", "url")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, None), (2, None), (3, "u3"), (None, "u5"), (None, None)], key=repr)
    assert spark.read.parquet(f"{out}/cache").count() == 5
