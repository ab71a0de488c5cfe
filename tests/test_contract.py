"""Every registered query against its SQL twin, and the plans the design relies on."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from crawlgrain.plans.oracles import oracle_queries
from crawlgrain.operators.dom import parse_pages
from crawlgrain.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["pages", "documents", "conversations", "events", "labels", "benchmark"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 7)
        return v

    return [columns[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def test_names():
    assert set(oracle_queries()) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries())


def test_entry(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 50
    assert rows[0].text_ratio > 0 and rows[0].top_keyword


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = E.queries()[name](spark, SF)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(E.oracle_sql()[name])
    assert got == normal([c[0] for c in cursor.description], cursor.fetchall())


# -- plans ---------------------------------------------------------------------------------------
def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


PER_PAGE = ["components", "content_hierarchy", "text_ratio", "keyword_density", "seo_meta", "frameworks", "content_patterns",
            "extraction_heuristics", "dom_outline", "selector_strategies", "interactive_elements", "likely_dynamic"]


@pytest.mark.parametrize("name", PER_PAGE)
def test_page_features_parse_once_and_do_not_shuffle(spark, name):
    text = plan(E.queries()[name](spark, SF))
    assert text.count("MapInArrow") == 1
    assert "Exchange" not in text


@pytest.mark.parametrize("name", ["map_model_names", "price_calls", "unlisted_models"])
def test_fixed_tables_are_broadcast(spark, name):
    text = plan(E.queries()[name](spark, SF))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_stage_status", "stream_status_expiry", "stream_page_analysis"}))
def test_no_cartesian_products(spark, name):
    text = plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["page_language", "page_brief", "dom_tag_counts", "keyword_density", "best_pattern", "all_patterns"])
def test_features_are_computed_once_a_page(spark, name):
    text = plan(E.queries()[name](spark, SF))
    assert text.count("MapInArrow") == 1
    if name != "page_brief":                                                 # joins its small tables
        assert "Exchange" not in text and "Filter (" not in text.replace("*", "")


def test_text_features_ship_no_nodes(spark):
    dom = parse_pages(spark.createDataFrame([(1, "u", "<p class=a>x</p><script>y</script>")], "page_id long, url string, html string"), "segs")
    row = dom.first()
    assert row.nodes == [] and row.segs == ["x"] and row.hidden == [] and row.html_len == 34


def test_no_query_leaves_cached_tables(spark):
    for name in ("incremental_analysis", "page_language", "page_brief", "language_profiles"):
        E.queries()[name](spark, SF).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_scans_read_only_needed_columns(spark):
    text = plan(E.queries()["robots_lookup"](spark, SF))
    assert "html" not in text


def test_row_log_queries_do_not_shuffle(spark):
    for name in ("classify_errors", "code_checks", "extract_code", "match_data_types", "route_models_regex",
                 "parse_verdicts", "normalise_usage"):
        if name not in ("classify_errors", "parse_verdicts"):                # their tables are ranked and joined themselves
            assert "Exchange" not in plan(E.queries()[name](spark, SF)), name


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(E.queries()["api_calls"](spark, SF))
