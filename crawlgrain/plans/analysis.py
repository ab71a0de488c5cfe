"""The whole analysis of a page: all features in one pass over its DOM row, then joins with small per-page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crawlgrain import fixed_values as V
from crawlgrain.functions.expr import any_contains, drop_nulls, strip
from crawlgrain.functions.sql import struct
from crawlgrain.operators import page_features as P
from crawlgrain.operators import selectors as S
from crawlgrain.operators.cache import cache_key, fresh_cache
from crawlgrain.operators.cache_store import CacheStore
from crawlgrain.operators.context import HEADER_COLUMNS, api_calls, header_table, load_metrics, with_robots
from crawlgrain.operators.dom import parse_pages
from crawlgrain.operators.language import language_of

FAILED_PAGE = "Static analysis failed, using basic scraping approach"


def page_features(dom: DataFrame) -> DataFrame:
    """One row per page with every feature that needs the page alone. No shuffle."""
    features = {
        "components": P.components_sql(),
        "snapshot": P.snapshot_sql(),
        "content_hierarchy": P.content_hierarchy_sql(),
        "text_ratio": P.text_ratio_sql(),
        "sample": P.language_sample_sql(),
        "keyword_density": P.keyword_density_sql(),
        "seo_meta": P.seo_meta_sql(),
        "structured_data": P.structured_data_sql(),
        "frameworks": P.frameworks_sql(),
        "dynamic_attributes": P.dynamic_attributes_sql(),
        "pagination_patterns": P.pagination_sql(),
        "content_patterns": P.all_patterns_sql(),
        "extraction_test_results": P.extraction_heuristics_sql(),
        "dom_visualization": P.dom_outline_sql(),
        "interactive_elements": S.interactive_elements_sql(),
        "selector_strategies": S.selector_strategies_sql(),
        "selector_suggestions": S.selector_suggestions_sql(),
        "template_selectors": S.template_selectors_sql(),
    }
    return dom.selectExpr("page_id", "url", "html_len", "warning AS parse_error",
                          *[f"{sql} AS {name}" for name, sql in features.items()])


def recommendations_column() -> Column:
    """Advice in fixed order, each line only where its condition holds."""
    forms, tables = F.col("components.forms"), F.col("components.tables")
    loaded = [F.when(F.col(f"frameworks.{name}"), name.title()) for name in V.FRAMEWORKS]
    interactive = F.col("interactive_elements")
    has_type = lambda kind: F.exists(interactive, lambda e: e["type"] == kind)
    loads_more = F.exists(interactive, lambda e: any_contains(F.lower(e["text"]), ["load", "more"]))
    best = F.expr(P.best_pattern_of("content_patterns"))
    extraction = F.get("extraction_test_results", F.lit(0))
    advice = drop_nulls(
        F.when(F.col("is_dynamic"), "Use Playwright/Selenium for JavaScript rendering").otherwise(
            "Static content: Use Requests + BeautifulSoup for efficient scraping"),
        F.when(F.col("is_dynamic") & F.coalesce(*loaded).isNotNull(), F.concat(
            F.concat_ws(", ", *loaded), F.lit(" framework detected: Wait for dynamic content to load"))),
        F.when(forms > 0, F.concat(F.lit("Found "), forms.cast("string"),
                                   F.lit(" forms: Consider form submission handling"))),
        F.when(tables > 0, F.concat(F.lit("Found "), tables.cast("string"),
                                    F.lit(" tables: Use pandas for structured data extraction"))),
        F.when(F.exists(F.map_values("security_headers"), lambda v: F.coalesce(v != "", F.lit(False))),
               "Security headers detected: Consider using proper headers in requests"),
        F.when(F.size("pagination_patterns") > 0, "Pagination detected: Implement pagination handling"),
        F.when(has_type("pagination"), "Interactive pagination detected: Implement pagination navigation"),
        F.when(has_type("button") & loads_more,
               "Load more functionality detected: Implement click interaction to get all content"),
        F.concat(F.lit("Repeating content pattern detected: Use selector '"), best["child_selector"],
                 F.lit("' for content items")),
        F.concat(F.lit("Extraction pattern '"), extraction["pattern"], F.lit("' found "),
                 extraction["count"].cast("string"), F.lit(" items with selector '"), extraction["selector"],
                 F.lit("'")),
    )
    suggested = F.transform("selector_suggestions", lambda s: F.concat(F.lit("Selector suggestion: "), s))
    return F.when(F.col("parse_error").isNotNull(), F.array(F.lit(FAILED_PAGE))).otherwise(F.concat(advice, suggested))


def analyze_pages(
    pages: DataFrame,
    robots: DataFrame | None = None,
    headers: DataFrame | None = None,
    rendered: DataFrame | None = None,
    resources: DataFrame | None = None,
    navigation: DataFrame | None = None,
    profiles: DataFrame | None = None,
) -> DataFrame:
    """One analysis row per page. Optional tables fill the fields a page's HTML cannot give.

    The features are one narrow pass; joins carry one row per page.
    """
    features = page_features(parse_pages(pages))
    language = F.lit("") if profiles is None else language_of(profiles)(F.col("sample"))
    features = features.withColumn("language", language)
    joined = _with_robots(features.drop("sample"), pages, robots)
    joined = _with_headers(joined, headers)
    joined = _with_snapshot(joined, rendered)
    joined = _with_network(joined, resources, navigation)

    likely = P.likely_dynamic_of("frameworks", "dynamic_attributes", "text_ratio")
    judged = joined.withColumn("is_dynamic", F.expr(f"coalesce(rendered_dynamic, {likely})"))
    warnings = drop_nulls(
        F.col("robots_warning"),
        F.concat(F.lit("Static analysis error: "), "parse_error"),
        F.lit("Language detection not available") if profiles is None else F.lit(None).cast("string"),
        F.when(F.col("rendered_dynamic").isNull(), "Dynamic analysis skipped: no rendered snapshot"))
    keywords = F.map_from_entries("keyword_density")
    advised = judged.select(
        "*", recommendations_column().alias("recommendations"), warnings.alias("warnings"),
        F.expr(P.archetype_of("is_dynamic", "keyword_density")).alias("archetype"))
    return advised.withColumn("keyword_counts", keywords).select(
        "page_id", "url", "html_len", "is_dynamic", "content_hierarchy", "components", "dynamic_attributes", "text_ratio",
        "language", "keyword_density", "keyword_counts", "structured_data", "frameworks", "apis",
        "pagination_patterns", "performance_metrics", "seo_meta", "security_headers", "robots_txt",
        "content_patterns", "extraction_test_results", "interactive_elements", "selector_strategies",
        "dom_visualization", "template_selectors", "selector_suggestions", "archetype", "recommendations", "warnings")


def _with_robots(df, pages, robots):
    if robots is None:
        return df.withColumns({"robots_txt": F.lit(""), "robots_warning": F.lit(None).cast("string")})
    found = with_robots(pages, robots).select("page_id", "robots_txt", F.col("warning").alias("robots_warning"))
    return df.join(found, "page_id", "left")


def _with_headers(df, headers):
    if headers is None:
        return df.withColumn("security_headers", F.lit(None).cast("map<string,string>"))
    pairs = [part for header, column in HEADER_COLUMNS.items() for part in (F.lit(header), F.col(column))]
    return df.join(header_table(headers), "page_id", "left").withColumn("security_headers", F.create_map(*pairs))


def _with_snapshot(df, rendered):
    """Compare against the rendered page: it decides on dynamic content, raises component counts and gives the
    interactive elements and the DOM size, which only a browser knows."""
    if rendered is None:
        return df.withColumns({"rendered_dynamic": F.lit(None).cast("boolean"), "rendered_len": F.lit(None).cast("int")})
    seen = parse_pages(rendered).selectExpr(
        "page_id", f"{P.snapshot_sql()} AS r", "html_len AS rendered_len", f"{S.interactive_elements_sql()} AS rendered_elements")
    larger = {name: f"greatest(components.{name}, r.{P.RENDERED_COUNTS[name]})" if name in P.RENDERED_COUNTS
              else f"components.{name}" for name in V.COMPONENTS}
    return df.join(seen, "page_id", "left").withColumns({
        "rendered_dynamic": F.expr(f"CASE WHEN r IS NOT NULL THEN {P.grown_by('snapshot', 'r')} IS NOT NULL END"),
        "components": F.expr(struct(**larger)),
        "interactive_elements": F.coalesce("rendered_elements", "interactive_elements")})


def _with_network(df, resources, navigation):
    """API calls from the resource log, load metrics from either table. A table that is not given leaves its fields null."""
    if resources is None:
        df = df.withColumn("apis", F.lit(None).cast("array<struct<url:string,method:string>>"))
    else:
        calls = api_calls(resources).groupBy("page_id").agg(F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "url", "method"))),
            lambda c: F.struct(c["url"].alias("url"), c["method"].alias("method"))).alias("apis"))
        df = df.join(calls, "page_id", "left")
    if resources is None and navigation is None:
        return df.withColumn("performance_metrics", F.lit(None).cast(
            "struct<load_time:double,dom_content_loaded:double,dom_size:int,resource_count:bigint,ajax_count:bigint>"))
    metrics = load_metrics(resources, navigation).select("page_id", F.struct("*").alias("m"))
    metric = F.struct("m.load_time", "m.dom_content_loaded", F.coalesce("rendered_len", "html_len").alias("dom_size"),
                      "m.resource_count", "m.ajax_count")
    return df.join(metrics, "page_id", "left").withColumn("performance_metrics", F.when(F.col("m").isNotNull(), metric))


def analyze_incremental(pages: DataFrame, cache: DataFrame | CacheStore, now: float, **context) -> DataFrame:
    """page_id, url, origin and analysis (JSON) of every page: the stored analysis where the cache has a fresh entry
    (origin 'cache'), else a new one ('fresh'), so only pages without an entry are parsed.

    ``cache`` may hold its analyses in a column ``analysis``; without one, hits carry null. Hits are joined on narrow rows. To
    leave the misses, html meets the live keys: with a table as cache that join, and whether html is shuffled for it, is left to
    adaptive execution. With a ``CacheStore`` and pages bucketed as it is (``bucket_pages``), both lie in the same buckets: no
    html is shuffled or sorted.
    """
    keyed = pages if "cache_key" in pages.columns else pages.withColumn("cache_key", cache_key(F.col("url")))
    small = lambda df: df.hint("shuffle_hash") if isinstance(cache, CacheStore) else df
    if isinstance(cache, CacheStore):
        live = cache.fresh(now).select("cache_key", "analysis")
    else:
        stored = F.col("analysis") if "analysis" in cache.columns else F.lit(None).cast("string")
        live = fresh_cache(cache, now).select("cache_key", stored.alias("analysis"))
    hits = live.join(small(keyed.select("page_id", "url", "cache_key")), "cache_key").select(
        "page_id", "url", F.lit("cache").alias("origin"), "analysis")
    misses = keyed.join(small(live.select("cache_key")), "cache_key", "left_anti").drop("cache_key")
    return hits.unionByName(as_stored(analyze_pages(misses, **context)).withColumn("origin", F.lit("fresh")))


def as_stored(analysis: DataFrame) -> DataFrame:
    """page_id, url and the whole analysis row as one JSON text, the form the cache keeps."""
    return analysis.select("page_id", "url", F.to_json(F.struct("*")).alias("analysis"))


def cache_entries(stored: DataFrame, now: float) -> DataFrame:
    """Cache rows for analyses in stored form; the page id serves as the version."""
    return stored.select(
        cache_key(F.col("url")).alias("cache_key"), "url", F.lit(now).alias("cache_time"),
        F.length("analysis").cast("long").alias("size_bytes"), F.lit(True).alias("readable"),
        F.col("page_id").alias("version"), "analysis")


# -- brief ---------------------------------------------------------------------------------------
def _listed(items: Column, limit: int | None = None) -> Column:
    """'  * a' lines; null for an empty list."""
    chosen = items if limit is None else F.slice(items, 1, limit)
    return F.when(F.size(items) > 0, F.concat(F.lit("\n  * "), F.array_join(chosen, "\n  * ")))


def _counts(struct: str, names: list[str]) -> Column:
    return F.concat_ws(", ", *[F.when(F.col(f"{struct}.{n}") > 0, F.concat(
        F.lit(f"{n} ("), F.col(f"{struct}.{n}").cast("string"), F.lit(")"))) for n in names])


def plain_number(value: Column) -> Column:
    """Whole numbers without a fraction, others with up to three places."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(
        F.call_function("format_number", value, F.lit("0.###")))


def page_brief(analysis: DataFrame) -> DataFrame:
    """A readable summary per page; sections without content are left out."""
    patterns = F.transform(F.slice(F.expr(P.by_count("content_patterns")), 1, 3), lambda r: F.concat(
        r["p"]["child_selector"], F.lit(" ("), r["p"]["count"].cast("string"), F.lit(" items, "),
        r["p"]["confidence"], F.lit(" confidence)")))
    best = F.get("extraction_test_results", F.lit(0))
    of_type = lambda kind: F.filter("interactive_elements", lambda e: e["type"] == kind)
    attributes = F.col("dynamic_attributes")
    present = F.map_keys(F.map_filter("security_headers", lambda k, v: F.coalesce(v != "", F.lit(False))))
    keywords = F.transform(F.slice("keyword_density", 1, 5), lambda k: F.concat(
        k["word"], F.lit(" ("), k["n"].cast("string"), F.lit(")")))
    roles = F.transform("template_selectors", lambda t: F.concat(t["role"], F.lit(": "), t["selector"]))
    flags = F.concat_ws(", ", *[F.when(F.col(f"frameworks.{name}"), name) for name in V.FRAMEWORKS])

    def line(label, value):
        return F.concat(F.lit(f"- {label}: "), value)

    def joined(label, items):
        return F.when(F.size(items) > 0, line(label, F.array_join(items, ", ")))

    hierarchy = [*V.SEMANTIC_TAGS, "content_containers"]
    sections = [
        line("Dynamic content", F.when(F.coalesce("is_dynamic", F.lit(False)), "Yes").otherwise("No")),
        line("Components detected", _counts("components", V.COMPONENTS)),
        line("Frameworks", F.when(flags == "", "None detected").otherwise(flags)),
        line("Text ratio", F.format_string("%.2f", "text_ratio")),
        line("Language", F.when(F.coalesce("language", F.lit("")) == "", "Not detected").otherwise(F.col("language"))),
        line("Content structure", _counts("content_hierarchy", hierarchy)),
        line("Technical recommendations", _listed(F.col("recommendations"), 5)),
        line("Suggested selectors", _listed(F.col("selector_suggestions"), 3)),
        line("Content patterns detected", _listed(patterns)),
        F.concat(F.lit("- Best extraction pattern: "), best["pattern"], F.lit(" using '"), best["selector"],
                 F.lit("' found "), best["count"].cast("string"), F.lit(" items")),
        F.when(F.size(of_type("button")) > 0, line("Interactive buttons detected", F.concat(
            F.size(of_type("button")).cast("string"), F.lit(" (e.g., "), F.get(of_type("button"), F.lit(0))["text"],
            F.lit(")")))),
        F.when(F.size(of_type("pagination")) > 0, line(
            "Pagination elements detected", F.size(of_type("pagination")).cast("string"))),
        joined("Pagination detected", F.slice("pagination_patterns", 1, 3)),
        F.when(F.size(attributes) > 0, line("Dynamic attributes", F.concat(
            F.array_join(F.slice(attributes, 1, 5), ", "), F.when(F.size(attributes) > 5, "...").otherwise("")))),
        F.when(F.size("apis") > 0, line("APIs detected", F.size("apis").cast("string"))),
        F.when(F.col("performance_metrics").isNotNull(), line("Load time", F.concat(
            plain_number(F.coalesce(F.col("performance_metrics.load_time"), F.lit(0.0))), F.lit("ms")))),
        joined("Top keywords", keywords),
        joined("Security headers", present),
        line("Recommended selectors for extraction", _listed(roles)),
    ]
    return analysis.select("page_id", "url", strip(F.concat_ws("\n", *sections)).alias("brief"))
