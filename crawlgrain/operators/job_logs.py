"""Row-level readings of extraction-job logs: errors, generated code, outputs, verdicts, data types."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, functions as F

from crawlgrain import fixed_values as V
from crawlgrain.functions.expr import drop_nulls, let, non_empty, strip


# -- errors --------------------------------------------------------------------------------------
def issue(error_type: str, explanation: str, recommendation: str) -> Column:
    return F.struct(F.lit(error_type).alias("error_type"), F.lit(explanation).alias("explanation"),
                    F.lit(recommendation).alias("recommendation"))


def scraping_issues(stderr: Column) -> Column:
    """array<struct>: every known error pattern contained in the text, ignoring case, in catalogue order."""
    return drop_nulls(*[F.when(F.lower(stderr).contains(p[0].lower()), issue(*p)) for p in V.ERROR_PATTERNS])


def classify_errors(attempts: DataFrame) -> DataFrame:
    """One row per attempt and recognised error. The fixed patterns are plain predicates, so nothing is joined."""
    return attempts.select("request_id", "attempt_no", F.posexplode(scraping_issues(F.col("stderr"))).alias(
        "ord", "issue")).select("request_id", "attempt_no", "ord", "issue.*")


def timeout_issues(attempts: DataFrame) -> DataFrame:
    """The message and issue of attempts that ran out of time, with a hint for the kind of script."""
    kind = script_type(F.col("code"))
    hint = F.when(kind.isin("selenium", "playwright"), V.TIMEOUT_BROWSER_HINT).when(
        kind == "requests", V.TIMEOUT_REQUESTS_HINT).otherwise("")
    seconds = F.col("execution_time").cast("long").cast("string")
    return attempts.filter("timed_out").select(
        "request_id", "attempt_no", kind.alias("scraper_type"),
        F.concat(F.lit("Execution timed out after "), seconds, F.lit("s"), hint).alias("message"),
        issue(*V.TIMEOUT_ISSUE).alias("issue")).select("request_id", "attempt_no", "scraper_type", "message", "issue.*")


# -- generated code ------------------------------------------------------------------------------
def script_type(code: Column) -> Column:
    return (
        F.when(code.contains("selenium") | code.contains("webdriver"), "selenium")
        .when(code.contains("playwright"), "playwright")
        .when(code.contains("scrapy"), "scrapy")
        .when(code.contains("beautifulsoup") | code.contains("bs4"), "beautifulsoup")
        .when(code.contains("requests"), "requests")
        .otherwise("unknown")
    )


# Line shapes that make a text look like Python code.
IMPORT_LINE = r"(?m)^\s*(import|from)\s+\w+"
STRUCTURE_LINES = [r"(?m)^\s*def\s+\w+", r"(?m)^\s*class\s+\w+", r"(?m)^\s*\w+\s*="]


def looks_like_code(code: Column) -> Column:
    """An import and at least one definition or assignment."""
    structured = code.rlike(STRUCTURE_LINES[0]) | code.rlike(STRUCTURE_LINES[1]) | code.rlike(STRUCTURE_LINES[2])
    return code.rlike(IMPORT_LINE) & structured


def code_checks(code_rows: DataFrame) -> DataFrame:
    return code_rows.select("doc_id", script_type(F.col("code")).alias("script_type"),
                            looks_like_code(F.col("code")).alias("looks_like_code"))


def imported_modules(code: Column) -> Column:
    """Distinct top-level modules of ``import a.b, c as d`` and ``from a.b import c`` lines; dots in front are skipped."""
    plain = F.flatten(F.transform(
        F.regexp_extract_all(code, F.lit(r"(?m)^[ \t]*import[ \t]+([\w., \t]+)"), F.lit(1)),
        lambda names: F.split(names, ",")))
    froms = F.regexp_extract_all(code, F.lit(r"(?m)^[ \t]*from[ \t]+\.*(\w[\w.]*)[ \t]+import"), F.lit(1))
    tops = F.transform(F.concat(plain, froms), lambda m: F.regexp_extract(m, r"^\s*(\w+)", 1))
    return F.array_distinct(F.filter(tops, lambda m: m != ""))


def import_census(code_rows: DataFrame) -> DataFrame:
    """How many code rows import each top-level module."""
    return code_rows.select(F.explode(imported_modules(F.col("code"))).alias("module")).groupBy("module").agg(
        F.count("*").alias("n_rows"))


def blocked_imports(code_rows: DataFrame) -> DataFrame:
    """Imports that are neither standard library nor on the allow list."""
    known = sorted(sys.stdlib_module_names) + V.ALLOWED_MODULES
    return code_rows.select("doc_id", F.explode(imported_modules(F.col("code"))).alias("module")).filter(
        ~F.col("module").isin(known))


def code_block(response: Column) -> Column:
    """First python block, else first fenced block, trimmed; null without one."""
    def block(pattern):
        return F.when(response.rlike(pattern), strip(F.regexp_extract(response, pattern, 1)))

    return F.coalesce(block(r"(?s)```python\s*(.*?)\s*```"), block(r"(?s)```\s*(.*?)\s*```"))


def extract_code(responses: DataFrame) -> DataFrame:
    return responses.select("conv_id", "turn", code_block(F.col("response")).alias("code"))


# -- outputs and verdicts ------------------------------------------------------------------------
def parsed_output(stdout: Column) -> Column:
    """struct<kind, data>: JSON text of the whole output, else of the widest {..} or [..] in it, else raw text."""
    whole = stdout.startswith("{") | stdout.startswith("[")
    inner = non_empty(F.regexp_extract(stdout, r"(?s)(\{.*\}|\[.*\])", 1))
    is_json = lambda text: F.try_parse_json(text).isNotNull()
    kind = F.when(whole & is_json(stdout), "json").when(~whole & is_json(inner), "embedded_json").otherwise("text")
    return let(kind, lambda k: F.struct(
        k.alias("kind"), F.when(k == "embedded_json", inner).otherwise(stdout).alias("data")))


def parse_output(attempts: DataFrame) -> DataFrame:
    """Kind and data of every attempt whose code ran and printed something."""
    ran = attempts.filter(code_ok())
    return ran.select("request_id", "attempt_no", parsed_output(strip(F.col("stdout"))).alias("o")).select(
        "request_id", "attempt_no", "o.*")


def code_ok() -> Column:
    return F.coalesce(F.col("success") & (strip(F.col("stdout")) != ""), F.lit(False))


def parse_verdicts(verdicts: DataFrame) -> DataFrame:
    """Validity and reason of yes/no answers; ``loose_success`` accepts a yes anywhere."""
    text = strip(F.upper(strip(F.col("response"))))
    valid = text.startswith("YES")
    dash = F.instr(text, "-")
    reason = F.when(~valid & (dash > 0), strip(F.substring(text, dash + 1, F.length(text)))).otherwise("")
    return verdicts.select("doc_id", valid.alias("is_valid"), reason.alias("reason"),
                           text.contains("YES").alias("loose_success"))


# -- requested data types ------------------------------------------------------------------------
def data_types_of(description: Column) -> Column:
    """Catalogue words in the description, then synonyms; at most three. Nothing found gives generic; a wish for
    several items repeats a lone match."""
    text = F.lower(description)

    def found(words):
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        return hit

    direct = [F.when(text.contains(word), F.lit(word)) for word in V.DATA_TYPES]
    implied = [F.when(found(words), F.lit(name)) for name, words in V.DATA_TYPE_SYNONYMS]
    named = F.slice(F.array_distinct(drop_nulls(*direct, *implied)), 1, 3)
    several = text.contains("list") | text.contains("multiple")
    return let(named, lambda ns: F.when(F.size(ns) == 0, F.array(F.lit("generic")))
               .when(several & (F.size(ns) == 1), F.concat(ns, ns)).otherwise(ns))


def match_data_types(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", F.posexplode(data_types_of(F.col("expected_data"))).alias(
        "ord", "data_type"))
