"""Every operator as a named query over the tables of one folder. Results are flat, ordered fields only."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlgrain import fixed_values as V
from crawlgrain.functions import nodes as N
from crawlgrain.operators.cache_store import CacheStore, bucket_pages
from crawlgrain.operators.running_log import RunningLog
from crawlgrain.operators import (
    attempts, cache, context, dom, job_logs, language, ledger, page_features as P, patterns, selectors as S, status,
)
from crawlgrain.plans import analysis
from crawlgrain.session import configure, is_folder, new_folder
from crawlgrain.sources import tables
from crawlgrain.sources.fixtures import NOW
from crawlgrain.streaming import maintenance, pages as page_streams, stages

STATUS_NOW = 30000.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Tables:
    """The given and derived tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        read = tables.base_table if name in tables.BASE_TABLES else tables.derived_table
        return read(self.spark, self.folder, name)

    def dom(self, name: str = "pages_plus", *parts: str) -> DataFrame:
        return dom.parse_pages(tables.spread(getattr(self, name), "page_id"), *parts)


def query(fn):
    QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
    return fn


def joined(items, sep: str = "|"):
    return F.array_join(items, sep)


# -- sources, cache, sinks -----------------------------------------------------------------------
@query
def page_scan(t):
    return t.pages.select("page_id", "url", F.length("html").alias("html_len"))


@query
def request_valid(t):
    return tables.split_requests(t.requests)[0]


@query
def request_rejected(t):
    return tables.split_requests(t.requests)[1].select("request_id", "reject_reason")


@query
def robots_lookup(t):
    return context.with_robots(t.pages, t.robots)


@query
def security_headers(t):
    return context.security_headers(t.pages, t.response_headers)


@query
def cache_fresh(t):
    return cache.fresh_cache(t.analysis_cache, NOW)


@query
def cache_upsert(t):
    return cache.upsert_cache(t.analysis_cache, t.analysis_cache_new)


def _store(t, *entries):
    """A new store of the given tables, one commit each."""
    store = CacheStore(t.spark, f"{new_folder(t.spark, 'cache-store')}/cache", buckets=8)
    for rows in entries:
        store.upsert(rows)
    return store


@query
def cache_store_upsert(t):
    """The newest entries after an upsert of deltas."""
    return _store(t, t.analysis_cache, t.analysis_cache_new).read()


@query
def cache_store_fresh(t):
    """Fresh entries after the folders of dead ones were dropped and the rest was compacted."""
    store = _store(t, t.analysis_cache)
    store.expire(NOW)
    store.compact(NOW)
    return store.fresh(NOW)


@query
def cache_clear_urls(t):
    return cache.clear_cache(t.analysis_cache, t.analysis_cache_new)


@query
def cache_expire_kept(t):
    return cache.expire_cache(t.analysis_cache, NOW)[0]


@query
def cache_expire_count(t):
    return cache.expire_cache(t.analysis_cache, NOW)[1]


@query
def cache_stats(t):
    return cache.cache_stats(t.analysis_cache, NOW)


@query
def json_rows(t):
    return tables.to_json_rows(t.attempt_log.select("request_id", "attempt_no", "success", "code", "stdout"))


@query
def access_log_filter(t):
    return tables.filter_access_log(t.access_log)


# -- DOM -----------------------------------------------------------------------------------------
@query
def dom_nodes(t):
    return dom.dom_nodes(t.dom()).select(
        "page_id", "node_id", "parent_id", "depth", "tag", "elem_idx", "n_children", "subtree_end", "id",
        joined("classes", " ").alias("classes"))


@query
def dom_tag_counts(t):
    return dom.tag_counts(t.dom("pages", "nodes"))


@query
def page_text(t):
    text = joined("segs", "")
    return dom.page_text(t.dom("pages", "segs", "hidden")).select("page_id", F.length(text).alias("n_chars"), F.md5(text).alias("digest"))


@query
def select_by_class(t):
    return dom.select_nodes(dom.dom_nodes(t.dom()), tags=["div", "li", "span"], class_re="item|card|price").select(
        "page_id", "node_id", "tag")


@query
def select_by_attribute(t):
    return dom.select_nodes(dom.dom_nodes(t.dom()), has_attr="href", attr_re={"href": "page|next"}).select(
        "page_id", "node_id", "tag")


@query
def node_text(t):
    return dom.node_text(t.dom(), tags=["div", "li", "h1", "nav"])


@query
def css_selector(t):
    return dom.with_selector(dom.dom_nodes(t.dom())).select("page_id", "node_id", "selector")


@query
def structured_data(t):
    return P.structured_data(t.dom()).select(
        "page_id", "ord", F.try_variant_get("data", "$['@type']", "string").alias("type"),
        F.try_variant_get("data", "$.n", "long").alias("n"))


@query
def frameworks(t):
    return P.frameworks(t.dom())


@query
def parent_child(t):
    return dom.with_children(t.dom())


@query
def has_ancestor(t):
    hits = dom.has_ancestor(t.dom(), lambda n: f"{n}.tag = 'a'", lambda n: f"({n}.tag = 'ul' OR {N.class_like(n, 'pag')})")
    return hits.select("page_id", "node_id", "tag")


@query
def sibling_position(t):
    return dom.sibling_position(dom.dom_nodes(t.dom()))


# -- page features -------------------------------------------------------------------------------
@query
def components(t):
    return P.components(t.dom())


@query
def content_hierarchy(t):
    return P.content_hierarchy(t.dom())


@query
def text_ratio(t):
    return P.text_ratio(t.dom("pages", "segs"))


@query
def keyword_density(t):
    return P.keyword_density(t.dom("pages", "segs"))


@query
def seo_meta(t):
    return P.seo_meta(t.dom())


@query
def dynamic_attributes(t):
    return P.dynamic_attributes(t.dom())


@query
def pagination_patterns(t):
    return P.pagination_patterns(t.dom())


@query
def extraction_heuristics(t):
    return P.extraction_heuristics(t.dom()).withColumn("sample", joined("sample"))


@query
def content_patterns(t):
    return P.content_patterns(t.dom())


@query
def list_patterns(t):
    return P.list_patterns(t.dom())


@query
def all_patterns(t):
    return P.all_patterns(t.dom())


@query
def best_pattern(t):
    return P.best_pattern(t.dom())


@query
def dom_outline(t):
    return P.dom_outline(t.dom())


@query
def selector_strategies(t):
    return S.selector_strategies(t.dom()).select(
        "page_id", "target", "element", "rank", "selector", "reliability", "method", "count")


@query
def selector_suggestions(t):
    return S.selector_suggestions(t.dom())


@query
def interactive_elements(t):
    return S.interactive_elements(t.dom())


@query
def template_selectors(t):
    return S.template_selectors(t.dom())


@query
def likely_dynamic(t):
    return P.likely_dynamic(t.dom())


@query
def snapshot_diff(t):
    return P.snapshot_diff(t.dom(), t.dom("pages_rendered"))


@query
def site_archetype(t):
    return P.site_archetype(t.dom())


@query
def page_performance(t):
    return context.page_performance(t.resource_log, t.navigation, t.pages)


@query
def api_calls(t):
    return context.api_calls(t.resource_log)


# -- language ------------------------------------------------------------------------------------
def _profiles(t):
    return language.train_profiles(tables.spread(t.documents.select("doc_id", "lang", "text"), "doc_id"))


@query
def language_profiles(t):
    return _profiles(t)


@query
def page_language(t):
    samples = t.dom("pages", "segs").selectExpr("page_id", f"{P.language_sample_sql()} AS sample")
    return language.detect_language(samples, _profiles(t))


# -- whole analysis ------------------------------------------------------------------------------
def _context(t):
    return {"robots": t.robots, "headers": t.response_headers, "resources": t.resource_log,
            "navigation": t.navigation}


def _analysis(t, **more):
    return analysis.analyze_pages(tables.spread(t.pages_plus, "page_id"), **_context(t), **more)


@query
def page_analysis(t):
    rows = _analysis(t, rendered=tables.spread(t.pages_rendered, "page_id"))
    return rows.select(
        "page_id", "url", "is_dynamic", "text_ratio", "robots_txt", "archetype", "components.*",
        F.size("dynamic_attributes").alias("n_attributes"), F.size("content_patterns").alias("n_patterns"),
        F.size("interactive_elements").alias("n_interactive"), F.size("apis").alias("n_apis"),
        "performance_metrics.load_time", joined("warnings").alias("warnings"))


@query
def page_analysis_lists(t):
    """The list and group fields of the analysis, each as one text, and its remaining structs."""
    rows = _analysis(t)
    items = lambda name, *fields: F.array_join(F.transform(name, lambda x: F.concat_ws("~", *[
        x[f].cast("string") for f in fields])), "|").alias(name)
    return rows.select(
        "page_id", "frameworks.*", "content_hierarchy.*", joined(F.array_sort("dynamic_attributes")).alias("dynamic_attributes"),
        joined("pagination_patterns").alias("pagination_patterns"), joined("selector_suggestions").alias("selector_suggestions"),
        items("content_patterns", "parent_selector", "child_selector", "count", "confidence"),
        items("keyword_density", "word", "n"), items("interactive_elements", "selector", "text", "type"),
        items("template_selectors", "role", "selector"), joined("dom_visualization", "\n").alias("dom_visualization"),
        F.array_join(F.transform("extraction_test_results", lambda e: F.concat_ws(
            "~", e["pattern"], e["selector"], joined(e["sample"]), e["count"].cast("string"))), "|").alias("extraction_test_results"),
        F.array_join(F.transform("selector_strategies", lambda e: F.concat_ws(
            "~", e["element"], F.array_join(F.transform(e["strategies"], lambda s: F.concat_ws(
                "^", s["selector"], s["method"], s["count"].cast("string"))), "~"))), "|").alias("selector_strategies"),
        F.array_join(F.transform(F.array_sort(F.map_entries("seo_meta")), lambda e: F.concat_ws("~", e["key"], e["value"])), "|").alias("seo_meta"))


@query
def recommendations(t):
    return _analysis(t).select("page_id", F.posexplode("recommendations").alias("ord", "recommendation"))


@query
def page_brief(t):
    return analysis.page_brief(_analysis(t, profiles=_profiles(t)))


@query
def incremental_analysis(t):
    rows = analysis.analyze_incremental(tables.spread(t.pages, "page_id"), t.analysis_cache, NOW)
    return rows.select("page_id", "origin", F.when(F.col("origin") == "cache", F.col("analysis")).alias("stored"), *_stored_fields())


@query
def incremental_bucketed(t):
    """The same with pages and cache in the same buckets, so that no page is moved."""
    store = _store(t, t.analysis_cache)
    folder = new_folder(t.spark, "bucketed-pages")
    pages = bucket_pages(t.pages, f"pages_{uuid.uuid4().hex}", folder, store.buckets)
    rows = analysis.analyze_incremental(pages, store, NOW)
    return rows.select("page_id", "origin", F.when(F.col("origin") == "cache", F.col("analysis")).alias("stored"), *_stored_fields())


def _stored_fields():
    """Some fields of a stored analysis; the text itself holds the whole row."""
    field = lambda path, kind: F.get_json_object("analysis", path).cast(kind)
    return [field("$.text_ratio", "double").alias("text_ratio"), field("$.components.navigation", "int").alias("navigation"),
            F.json_array_length(F.get_json_object("analysis", "$.content_patterns")).alias("n_patterns")]


# -- extraction jobs -----------------------------------------------------------------------------
@query
def classify_errors(t):
    return job_logs.classify_errors(t.attempt_log)


@query
def timeout_issues(t):
    return job_logs.timeout_issues(t.attempt_log)


@query
def import_census(t):
    return job_logs.import_census(t.code_rows)


@query
def blocked_imports(t):
    return job_logs.blocked_imports(t.code_rows)


@query
def code_checks(t):
    return job_logs.code_checks(t.code_rows)


@query
def extract_code(t):
    return job_logs.extract_code(t.llm_responses)


@query
def parse_output(t):
    return job_logs.parse_output(t.attempt_log)


@query
def parse_verdicts(t):
    return job_logs.parse_verdicts(t.verdicts)


@query
def match_data_types(t):
    return job_logs.match_data_types(t.requests)


def _table(t, rows, columns: str):
    """A catalogue as a stored table, with its order as ``priority``."""
    folder = new_folder(t.spark, "catalogue")
    t.spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"priority long, {columns}").write.parquet(folder)
    return t.spark.read.parquet(folder)


@query
def classify_errors_table(t):
    catalogue = _table(t, V.ERROR_PATTERNS, "error_type string, explanation string, recommendation string")
    return patterns.classify_errors_by(t.attempt_log, catalogue)


@query
def match_data_types_table(t):
    words = [(w, w) for w in V.DATA_TYPES] + [(name, word) for name, words in V.DATA_TYPE_SYNONYMS for word in words]
    return patterns.match_data_types_by(t.requests, _table(t, words, "data_type string, word string"))


@query
def pattern_search(t):
    """Documents that contain the first thirty characters of a benchmark item, in any case."""
    items = t.benchmark.select("item_id", F.substring("text", 1, 30).alias("pattern"))
    return patterns.find_patterns(t.documents, ["doc_id"], "text", items).select("doc_id", "item_id")


@query
def resolve_attempts(t):
    return attempts.resolve_attempts(t.attempt_log)


# -- model ledger --------------------------------------------------------------------------------
@query
def route_models_regex(t):
    return ledger.route_models(t.llm_calls, "regex")


@query
def route_models_substring(t):
    return ledger.route_models(t.llm_calls, "substring")


@query
def map_model_names(t):
    return ledger.map_model_names(t.llm_calls)


@query
def unlisted_models(t):
    return ledger.unlisted_models(t.llm_calls)


@query
def normalise_usage(t):
    return ledger.normalise_usage(t.llm_calls)


@query
def price_calls(t):
    return ledger.price_calls(t.llm_calls).withColumn("cost", F.round("cost", ledger.COST_DECIMALS))


@query
def usage_totals(t):
    return ledger.usage_totals(t.llm_calls)


@query
def usage_report(t):
    return ledger.usage_report(ledger.usage_totals(t.llm_calls))


@query
def running_usage_request(t):
    return ledger.running_usage(t.llm_calls, "request")


@query
def running_usage_log(t):
    return ledger.running_usage(t.llm_calls, "log")


@query
def running_usage_incremental(t):
    """The same over a kept log that grew by three appends, the last of which comes late."""
    calls = ledger.priced_calls(t.llm_calls)
    held = RunningLog(t.spark, f"{new_folder(t.spark, 'running-log')}/log", ["role"], "call_id", ledger.RUNNING_VALUES, bits=12)
    for part in (1, 2, 0):
        held.append(calls.where(f"request_id % 3 = {part}"))
    return ledger.running_columns(held.totals())


# -- status --------------------------------------------------------------------------------------
@query
def stage_state(t):
    return _rounded(status.stage_state(t.stage_events))


def _rounded(df):
    return df.withColumn("progress", F.round("progress", 6))


@query
def stage_entries(t):
    return status.stage_entries(t.stage_events)


@query
def latest_status(t):
    updates = t.stage_events.withColumn("details", F.when(F.col("action") == "fail", F.col("details")))
    ids = t.labels.select(F.col("doc_id").alias("request_id"))
    return status.latest_status(updates, ["stage", "action", "details"], ids)


@query
def status_expiry(t):
    return _rounded(status.expire_status(status.stage_state(t.stage_events), STATUS_NOW))


@query
def maintenance_run(t):
    """Statuses and cache entries left after a clean-up at a time when both are due."""
    kept = maintenance.maintain(status.stage_state(t.stage_events), t.analysis_cache, STATUS_NOW)
    return kept[0].select(F.lit("status").alias("store"), F.col("request_id").cast("string").alias("key")).unionByName(
        kept[1].select(F.lit("cache").alias("store"), F.col("cache_key").alias("key")))


# -- streaming -----------------------------------------------------------------------------------
def _finish(stream):
    stream.awaitTermination()
    return stream


def _table_stream(t, name: str, read, *schema):
    """The rows of a given table as a stream, whether the table is one file or a folder of files by any names."""
    path = tables.table_path(t.folder, name)
    return read(t.spark, path, *schema, "*") if is_folder(t.spark, path) else read(t.spark, t.folder, *schema, f"{name}.parquet")


@query
def stream_stage_status(t):
    work = new_folder(t.spark, "stage-stream")
    schema = t.events.select("event_id", "user_id", "event_type", "props").schema
    raw = _table_stream(t, "events", stages.stage_event_stream, schema)
    run = _finish(stages.stream_stages(stages.as_stage_events(raw), f"{work}/state", f"{work}/checkpoint", lambda _: STATUS_NOW))
    return _rounded(stages.stored_status(t.spark, run, f"{work}/state"))


@query
def stream_status_expiry(t):
    """Statuses that the stream itself has not removed once its watermark is an hour behind the last event. A request is
    what a user does within a thousand events."""
    work = new_folder(t.spark, "expiry-stream")
    schema = t.events.select("event_id", "user_id", "event_type", "props").schema
    raw = _table_stream(t, "events", stages.stage_event_stream, schema)
    events = stages.as_stage_events(raw).withColumn("request_id", F.expr("event_id div 1000 * 1000000 + request_id"))
    run = _finish(stages.stream_stages(events, f"{work}/state", f"{work}/checkpoint", late="1 hour"))
    return _rounded(stages.stored_status(t.spark, run, f"{work}/state"))


@query
def stream_page_analysis(t):
    work = new_folder(t.spark, "page-stream")
    source = _table_stream(t, "pages", page_streams.page_stream)
    _finish(page_streams.stream_analyze(source, f"{work}/out", f"{work}/checkpoint", lambda: NOW, context=lambda: _context(t)))
    return t.spark.read.parquet(f"{work}/out/analysis").select("page_id", *_stored_fields())
