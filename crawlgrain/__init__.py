"""Crawl and extraction-job analytics as Spark DataFrame jobs."""
