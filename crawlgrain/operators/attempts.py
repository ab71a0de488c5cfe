"""Outcome of a request from its log of attempts."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, functions as F

from crawlgrain.functions.expr import strip
from crawlgrain.operators.job_logs import code_ok, parsed_output


def resolve_attempts(attempts: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Attempts count up to the first valid one or ``max_attempts``. Code is the last that ran, data its output.

    A valid attempt has run, so the last that ran is the first valid one, or else the last of all. Attempts past the limit
    are filtered before the shuffle, and a request keeps two candidates and one count per number: nothing is collected,
    also where attempt numbers repeat.
    """
    number, result = F.col("attempt_no"), F.struct("code", strip(F.col("stdout")).alias("output"))
    valid = code_ok() & F.coalesce("is_valid", F.lit(False))
    ran, stop = F.when(code_ok(), number), F.when(valid, number)
    counts = [F.count_if(F.when(F.lit(k == 0), number <= 0).otherwise(number == k)).alias(f"n{k}") for k in range(max_attempts + 1)]
    grouped = attempts.filter(number <= max_attempts).groupBy("request_id").agg(
        F.min(stop).alias("stop"), F.min_by(result, stop).alias("first_valid"), F.max_by(result, ran).alias("last_ran"), *counts)
    tried = reduce(add, [F.when(F.coalesce("stop", F.lit(max_attempts)) >= k, F.col(f"n{k}")).otherwise(0) for k in range(max_attempts + 1)])
    resolved = grouped.select(
        "request_id", tried.cast("int").alias("attempts"), F.col("stop").isNotNull().alias("success"),
        F.coalesce("first_valid", "last_ran").alias("last_ok"))
    return resolved.select(
        "request_id", "attempts", "success", F.col("last_ok.code").alias("final_code"),
        parsed_output(F.col("last_ok.output")).alias("o")).select(
        "request_id", "attempts", "success", "final_code",
        F.when(F.col("final_code").isNotNull(), F.col("o.kind")).alias("data_kind"),
        F.when(F.col("final_code").isNotNull(), F.col("o.data")).alias("final_data"),
        F.when(F.col("final_code").isNotNull(), "Code OK").otherwise("No Code").alias("code_flag"),
        F.when(F.col("final_code").isNotNull(), "Data OK").otherwise("No Data").alias("data_flag"),
        F.concat(F.col("attempts").cast("string"), F.lit(f" of {max_attempts} attempt"),
                 F.lit("s" if max_attempts != 1 else "")).alias("attempts_label"))
