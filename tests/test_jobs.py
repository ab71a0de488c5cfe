"""Job logs, attempts, ledger, cache and context on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from crawlgrain.operators import attempts, cache, context, job_logs as J, ledger
from crawlgrain.sources import tables


def one(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def column(df, expr, *order):
    df = df.withColumn("out", expr)
    return [r.out for r in (df.orderBy(*order) if order else df).collect()]


# -- sources -------------------------------------------------------------------------------------
def test_request_reasons(spark):
    schema = "request_id long, url string, expected_data string, llm_model string"
    df = one(spark, schema, (1, "https://a/x", "d", "m"), (2, None, "d", "m"), (3, "ftp://a", "d", "m"),
             (4, "HTTP://a", None, "m"), (5, "nonsense", "d", "m"), (6, "http://a", "d", None))
    valid, rejected = tables.split_requests(df)
    assert [r.request_id for r in valid.collect()] == [1]
    assert {r.request_id: r.reject_reason for r in rejected.collect()} == {
        2: "missing url", 3: "url is not http or https", 4: "missing expected_data", 5: "url is not http or https",
        6: "missing llm_model"}


def test_access_log(spark):
    df = one(spark, "path string, n_args int", ("/api/status/1", 3), ("/api/status/1", 2), ("/x", 5), (None, 5))
    assert [(r.path, r.n_args) for r in tables.filter_access_log(df).collect()] == [
        ("/api/status/1", 2), ("/x", 5), (None, 5)]


def test_result_sink(spark, tmp_path):
    df = one(spark, "a int, b string", (1, "x"), (2, None))
    assert [r.value for r in tables.to_json_rows(df).orderBy("value").collect()] == ['{"a":1,"b":"x"}', '{"a":2}']
    tables.write_results(df, str(tmp_path / "out"))
    assert sorted(r.a for r in spark.read.schema(df.schema).json(str(tmp_path / "out")).collect()) == [1, 2]


def test_spread_moves_rows_only_when_asked(spark):
    rows = spark.range(10, numPartitions=1)
    assert "Exchange" not in tables.spread(rows, "id")._jdf.queryExecution().toString()
    spark.conf.set(tables.SPREAD, "3")
    try:
        assert "Exchange hashpartitioning(id" in tables.spread(rows, "id")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset(tables.SPREAD)


# -- logs ----------------------------------------------------------------------------------------
def test_every_error_pattern(spark):
    df = one(spark, "request_id int, attempt_no int, stderr string",
             (1, 1, "CONNECTION REFUSED; httperror: 403 and HTTPERROR: 429 TimeOut nosuchelementexception "
                    "ELEMENTNOTVISIBLEEXCEPTION Captcha"), (2, 1, "fine"), (3, 1, None))
    got = J.classify_errors(df).orderBy("ord").collect()
    assert [r.error_type for r in got] == ["Connection refused", "HTTPError: 403", "HTTPError: 429", "timeout",
                                           "NoSuchElementException", "ElementNotVisibleException", "captcha"]
    assert got[1].recommendation.startswith("Try adding request headers")


@pytest.mark.parametrize("code, kind, shaped", [
    ("from selenium import webdriver\nrequests", "selenium", False), ("import playwright\nx = 1", "playwright", True),
    ("scrapy bs4", "scrapy", False), ("  import bs4\n  def f(): pass", "beautifulsoup", True), ("Requests", "unknown", False),
    ("import requests\nclass A: pass", "requests", True), ("x = 1", "unknown", False)])
def test_code_checks(spark, code, kind, shaped):
    row = J.code_checks(one(spark, "doc_id int, code string", (1, code))).collect()[0]
    assert (row.script_type, row.looks_like_code) == (kind, shaped)


def test_imports(spark):
    code = "import os.path, numpy as np\nfrom a.b import c\n  import torch\nfrom . import z\nx = 'import y'\nimport os"
    df = one(spark, "doc_id int, code string", (1, code), (2, "import torch"), (3, None))
    assert {r.module: r.n_rows for r in J.import_census(df).collect()} == {"os": 1, "numpy": 1, "a": 1, "torch": 2}
    assert sorted((r.doc_id, r.module) for r in J.blocked_imports(df).collect()) == [(1, "a"), (1, "torch"), (2, "torch")]


def test_code_blocks(spark):
    df = one(spark, "id int, r string", (1, "a\n```\nx\n```\n```python\n y \n```\n```python\nz```"), (2, "```sh\nls\n```"),
             (3, "no block"), (4, "``` ```"))
    assert column(df, J.code_block(F.col("r")), "id") == ["y", "sh\nls", None, ""]


def test_outputs(spark):
    df = one(spark, "id int, o string", (1, '{"a": 1}'), (2, "[1"), (3, 'x {"a": [1]} y'), (4, "x {bad} y"), (5, "plain"),
             (6, 'x {"a"} [1] {"b"} y'))
    got = [(o.kind, o.data) for o in column(df, J.parsed_output(F.col("o")), "id")]
    assert got == [("json", '{"a": 1}'), ("text", "[1"), ("embedded_json", '{"a": [1]}'), ("text", "x {bad} y"),
                   ("text", "plain"), ("text", 'x {"a"} [1] {"b"} y')]


def test_verdicts(spark):
    df = one(spark, "doc_id int, response string", (1, " yes - ok"), (2, "no - a - b "), (3, "oh yes"), (4, "No"))
    assert [tuple(r)[1:] for r in J.parse_verdicts(df).orderBy("doc_id").collect()] == [
        (True, "", True), (False, "A - B", False), (False, "", True), (False, "", False)]


@pytest.mark.parametrize("wish, types", [
    ("Product and review and comment and job", ["product", "review", "comment"]), ("weather list", ["generic"]),
    ("list of news", ["news", "news"]), ("multiple jobs and posts", ["post", "job"]), ("my career", ["experience"]),
    ("experience and career, degree", ["experience", "education"]), ("Portfolio", ["project"])])
def test_data_types(spark, wish, types):
    assert column(one(spark, "w string", (wish,)), J.data_types_of(F.col("w"))) == [types]


# -- attempts ------------------------------------------------------------------------------------
def test_attempt_resolution(spark):
    schema = ("request_id string, attempt_no int, success boolean, stdout string, is_valid boolean, code string")
    rows = [("late", n, True, f"o{n}", n == 6, f"c{n}") for n in range(1, 8)]              # valid only past the limit
    rows += [("hit", 1, True, "  ", True, "c1"), ("hit", 2, True, '["x"]', True, "c2"), ("hit", 3, True, "o", True, "c3")]
    rows += [("none", 1, False, "o", None, "c1"), ("none", 2, None, None, None, "c2")]
    got = {r.request_id: r for r in attempts.resolve_attempts(spark.createDataFrame(rows, schema)).collect()}
    assert (got["late"].attempts, got["late"].success, got["late"].final_code) == (5, False, "c5")
    assert (got["hit"].attempts, got["hit"].success, got["hit"].final_code, got["hit"].data_kind) == (2, True, "c2", "json")
    assert (got["none"].attempts, got["none"].final_code, got["none"].data_kind, got["none"].code_flag) == (
        2, None, None, "No Code")
    assert got["hit"].attempts_label == "2 of 5 attempts"


# -- ledger --------------------------------------------------------------------------------------
def test_token_fallbacks(spark):
    schema = ("call_id long, request_id long, role string, model string, has_response_metadata boolean, "
              "has_usage_metadata boolean, prompt_tokens long, completion_tokens long, input_tokens long, "
              "output_tokens long, content string")
    df = one(spark, schema, (1, 1, "r", "m", True, False, 0, None, 7, 8, "x"), (2, 1, "r", "m", True, True, 3, 4, 7, 8, "x"),
             (3, 1, "r", "m", False, True, 3, 4, None, 8, "x"), (4, 1, "r", "m", False, False, 3, 4, 7, 8, "y" * 501))
    got = ledger.normalise_usage(df).orderBy("call_id").collect()
    assert [(r.tokens_in, r.tokens_out) for r in got] == [(7, 8), (3, 4), (0, 8), (0, 125)]
    assert got[3].preview == "y" * 500 + "..." and got[0].preview == "x"


@pytest.mark.parametrize("model, by_prefix, by_substring", [
    ("GPT-4o", "openai", "openai"), ("my-gpt-4", None, "openai"), ("command-r", "cohere", "cohere"),
    ("Falcon-7b", "together", "together"), ("other", None, None)])
def test_routing(spark, model, by_prefix, by_substring):
    calls = one(spark, "call_id int, model string", (1, model))
    regex, substring = (ledger.route_models(calls, m).collect()[0] for m in ("regex", "substring"))
    assert (regex.provider, substring.provider) == (by_prefix, by_substring)
    assert (substring.reason is None) == (by_substring is not None)


@pytest.mark.parametrize("total, band", [(0.05, "success"), (0.0501, "warning"), (0.1, "warning"), (0.1001, "danger")])
def test_cost_bands(spark, total, band):
    totals = one(spark, "request_id int, helper_total long, coding_total long, total_cost double", (1, 1, 2, total))
    row = ledger.usage_report(totals).collect()[0]
    assert (row.helper_percent, row.coding_percent, row.cost_band) == (33.3, 66.7, band)


@pytest.mark.parametrize("bits", [1, 2, 16])
def test_running_sums_match_a_plain_loop(spark, bits):
    random.seed(bits)
    ids = random.sample(range(500), 200)
    data = [("hot" if random.random() < 0.7 else f"k{i % 5}", i, random.randrange(100)) for i in ids]
    want, sums = {}, {}
    for key, i, v in sorted(data, key=lambda r: r[1]):
        sums[key] = sums.get(key, 0) + v
        want[i] = sums[key]
    df = spark.createDataFrame(data, "key string, id long, v long")
    got = {r.id: r.running_v for r in ledger.running_sums(df, ["key"], "id", ["v"], bits=bits).collect()}
    assert got == want


# -- cache and context ---------------------------------------------------------------------------
CACHE = "cache_key string, url string, cache_time double, size_bytes long, readable boolean, version long"


def entry(key, time, readable=True, version=1):
    return (key, "u" + key, time, 10, readable, version)


def test_cache_lifetime_and_versions(spark):
    now = 100_000.0
    df = one(spark, CACHE, entry("a", now - 86399), entry("b", now - 86400), entry("c", None), entry("d", now, False, 2),
             entry("d", now - 5, True, 1), entry("e", now, True, 1), entry("e", now, True, 2))
    fresh = {r.cache_key: r.version for r in cache.fresh_cache(df, now).collect()}
    assert fresh == {"a": 1, "e": 2}
    kept, removed = cache.expire_cache(df, now)
    assert (kept.count(), removed.collect()[0].removed) == (4, 3)
    again, removed_again = cache.expire_cache(kept, now)
    assert (again.count(), removed_again.collect()[0].removed) == (4, 0)


def test_cache_stats_of_an_empty_cache(spark):
    row = cache.cache_stats(spark.createDataFrame([], CACHE), 1.0).collect()[0]
    assert tuple(row) == (0, 0, 0, 0.0)


def test_cache_write_is_partitioned(spark, tmp_path):
    df = one(spark, CACHE, *[entry(str(i), 1.0) for i in range(50)])
    cache.write_cache(df, str(tmp_path / "cache"), buckets=4)
    back = spark.read.parquet(str(tmp_path / "cache"))
    assert back.count() == 50 and {r.bucket for r in back.select("bucket").distinct().collect()} <= {0, 1, 2, 3}


def test_first_api_calls(spark):
    df = one(spark, "page_id int, seq int, resource_type string, url string, method string",
             *[(1, i, "xhr" if i % 2 else "image", f"u{i}", "GET") for i in range(40)])
    assert [(r.rank, r.url) for r in context.api_calls(df).orderBy("rank").collect()] == [
        (n, f"u{2 * n - 1}") for n in range(1, 11)]


def test_headers_ignore_case_and_other_names(spark):
    pages = one(spark, "page_id int", (1,), (2,))
    heads = one(spark, "page_id int, name string, value string", (1, "x-frame-OPTIONS", "DENY"), (1, "Server", "x"))
    assert [tuple(r) for r in context.security_headers(pages, heads).orderBy("page_id").collect()] == [
        (1, None, "DENY", None), (2, None, None, None)]
