"""What surrounds a page: robots.txt, response headers, network log, load timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from crawlgrain import fixed_values as V


def site_host(url: Column) -> Column:
    return F.regexp_extract(url, "https?://([^/]+)", 1)


def with_robots(pages: DataFrame, robots: DataFrame) -> DataFrame:
    """Robots text of each page's host. Only (page_id, url) is moved; ``robots`` has one row per host and grows
    with the crawl, so the join strategy and the splitting of popular hosts are left to adaptive execution."""
    answers = robots.select(F.col("host").alias("robots_host"), "status", "body", "error").dropDuplicates(["robots_host"])
    joined = pages.select("page_id", "url").join(answers, site_host(F.col("url")) == F.col("robots_host"), "left")
    failed = F.col("error").isNotNull()
    return joined.select(
        "page_id",
        F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit("/robots.txt")).alias("robots_url"),
        F.when(failed, "Error fetching").when(F.col("status") == 200, F.col("body"))
        .otherwise("Not found").alias("robots_txt"),
        F.when(failed, F.concat(F.lit("Could not fetch robots.txt: "), F.col("error"))).alias("warning"),
    )


HEADER_COLUMNS = {header: header.lower().replace("-", "_") for header in V.SECURITY_HEADERS}


def header_table(headers: DataFrame) -> DataFrame:
    """One row per page that sent a security header. Other headers are dropped before the shuffle."""
    wanted = headers.withColumn("name", F.lower("name")).filter(
        F.col("name").isin([h.lower() for h in V.SECURITY_HEADERS]))
    return wanted.groupBy("page_id").agg(
        *[F.max(F.when(F.col("name") == h.lower(), F.col("value"))).alias(c) for h, c in HEADER_COLUMNS.items()])


def security_headers(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """The three security headers of every page, null if absent."""
    return pages.select("page_id").join(header_table(headers), "page_id", "left")


def load_metrics(resources: DataFrame | None, navigation: DataFrame | None) -> DataFrame:
    """Load times and resource counts of every page that has a navigation entry or resources."""
    counts = None if resources is None else resources.groupBy("page_id").agg(
        F.count("*").alias("resource_count"),
        F.count_if(F.col("initiator_type") == "xmlhttprequest").alias("ajax_count"))
    times = None if navigation is None else navigation.select(
        "page_id",
        F.coalesce("nav_load_end", F.col("timing_load_end") - F.col("navigation_start")).alias("load_time"),
        F.coalesce("nav_dom_end", F.col("timing_dom_end") - F.col("navigation_start")).alias("dom_content_loaded"))
    if times is None:
        both = counts.withColumns({"load_time": F.lit(0.0), "dom_content_loaded": F.lit(0.0)})
    elif counts is None:
        both = times.withColumns({c: F.lit(0).cast("long") for c in ("resource_count", "ajax_count")})
    else:
        both = times.join(counts, "page_id", "full")
    return both.select("page_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("load_time", "dom_content_loaded")],
                       *[F.coalesce(c, F.lit(0)).alias(c) for c in ("resource_count", "ajax_count")])


def page_performance(resources: DataFrame | None, navigation: DataFrame | None, pages: DataFrame) -> DataFrame:
    """Load metrics with the html size. Only the length of the html is moved."""
    sizes = pages.select("page_id", F.length("html").alias("dom_size"))
    return load_metrics(resources, navigation).join(sizes, "page_id").select(
        "page_id", "load_time", "dom_content_loaded", "dom_size", "resource_count", "ajax_count")


def api_calls(resources: DataFrame, k: int = 10) -> DataFrame:
    """The first k xhr/fetch requests of each page. The rank filter is applied below the shuffle too, so a page
    with most of the log sends at most k rows per task."""
    calls = resources.filter(F.col("resource_type").isin("xhr", "fetch"))
    order = Window.partitionBy("page_id").orderBy("seq")
    return calls.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "page_id", "rank", "url", "method")
