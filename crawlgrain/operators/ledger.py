"""Model routing, token normalisation, prices and running usage of a call log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from crawlgrain import fixed_values as V
from crawlgrain.functions.expr import or_zero
from crawlgrain.functions.sql import lit

COST_DECIMALS = 8  # prices have five decimals per 1000 tokens, so every cost is a multiple of 1e-8


# -- models --------------------------------------------------------------------------------------
def provider_by_prefix(model: Column) -> Column:
    name = F.lower(model)
    return F.coalesce(*[F.when(name.rlike(rule), provider) for provider, rule in V.PROVIDER_PREFIXES])


def provider_by_substring(model: Column) -> Column:
    name = F.lower(model)
    contains = lambda words: reduce(lambda a, b: a | b, [name.contains(w) for w in words])
    return F.coalesce(*[F.when(contains(words), provider) for provider, words in V.PROVIDER_SUBSTRINGS])


def route_models(calls: DataFrame, mode: str = "regex") -> DataFrame:
    """Provider of each call by the first rule that fits; a call no rule fits keeps a null and the reason."""
    provider = {"regex": provider_by_prefix, "substring": provider_by_substring}[mode](F.col("model"))
    return calls.select("call_id", "model", provider.alias("provider")).withColumn(
        "reason", F.when(F.col("provider").isNull(), F.concat(F.lit("Unknown model provider: "), "model")))


def fixed_table(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A broadcast side whose size is fixed in the source code, as an inline table: no Python task reads it."""
    value = lambda v: lit(v) if isinstance(v, str) else f"{v!r}D"
    listed = ", ".join("(" + ", ".join(map(value, row)) + ")" for row in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(names)})"))


def map_model_names(calls: DataFrame) -> DataFrame:
    names = fixed_table(calls.sparkSession, V.MODEL_API_NAMES, "model", "api_name")
    return calls.join(names, "model", "left").select(
        "call_id", "model", F.coalesce("api_name", "model").alias("api_name"))


def model_catalog(spark: SparkSession) -> DataFrame:
    """provider, model."""
    return fixed_table(spark, [(p, m) for p, models in V.MODEL_CATALOG.items() for m in models], "provider", "model")


def unlisted_models(calls: DataFrame) -> DataFrame:
    """Calls to models the catalogue does not list."""
    return calls.join(model_catalog(calls.sparkSession), "model", "left_anti").select("call_id", "model")


# -- tokens and cost -----------------------------------------------------------------------------
def input_tokens() -> Column:
    reported = F.coalesce(F.nullif("prompt_tokens", F.lit(0)), "input_tokens", F.lit(0))
    return F.when(F.col("has_response_metadata"), reported).when(
        F.col("has_usage_metadata"), or_zero(F.col("input_tokens"))).otherwise(F.lit(0)).cast("long")


def output_tokens() -> Column:
    reported = F.coalesce(F.nullif("completion_tokens", F.lit(0)), "output_tokens", F.lit(0))
    estimate = F.floor(F.length("content") / 4)
    return F.when(F.col("has_response_metadata"), reported).when(
        F.col("has_usage_metadata"), or_zero(F.col("output_tokens"))).otherwise(or_zero(estimate)).cast("long")


def normalise_usage(calls: DataFrame) -> DataFrame:
    """Tokens per call from whichever metadata is there, and a 500-character preview of the answer."""
    preview = F.concat(F.left("content", F.lit(500)), F.when(F.length("content") > 500, "...").otherwise(""))
    return calls.select("call_id", "request_id", "role", "model", input_tokens().alias("tokens_in"),
                        output_tokens().alias("tokens_out"), preview.alias("preview"))


def price_calls(calls: DataFrame) -> DataFrame:
    """Cost per call; a model without a price pays the default."""
    prices = fixed_table(calls.sparkSession, V.PRICES, "model", "price_in", "price_out")
    usage = normalise_usage(calls).join(prices, "model", "left")
    cost = (F.col("tokens_in") / 1000 * F.coalesce("price_in", F.lit(V.DEFAULT_PRICE[0]))
            + F.col("tokens_out") / 1000 * F.coalesce("price_out", F.lit(V.DEFAULT_PRICE[1])))
    return usage.select("call_id", "request_id", "role", "model", "tokens_in", "tokens_out", cost.alias("cost"))


def exact(cost: Column) -> Column:
    return cost.cast("decimal(38,14)")


def usage_totals(calls: DataFrame) -> DataFrame:
    """Tokens and cost per request for both roles, and the request's total cost. Costs are added as decimals: their sums
    do not depend on the order in which partial sums meet."""
    def total(role, value, name):
        return or_zero(F.sum(F.when(F.col("role") == role, value))).alias(f"{role}_{name}")

    columns = []
    for role in ("helper", "coding"):
        columns += [total(role, F.col("tokens_in"), "input"), total(role, F.col("tokens_out"), "output"),
                    total(role, F.col("tokens_in") + F.col("tokens_out"), "total"), total(role, exact(F.col("cost")), "cost")]
    sums = price_calls(calls).groupBy("request_id").agg(*columns)
    money = ["helper_cost", "coding_cost"]
    return sums.withColumn("total_cost", F.round(F.col(money[0]) + F.col(money[1]), COST_DECIMALS).cast("double")).withColumns(
        {m: F.round(m, COST_DECIMALS).cast("double") for m in money})


def usage_report(totals: DataFrame) -> DataFrame:
    """Token share of each role in percent and the cost band of the request."""
    tokens = F.col("helper_total") + F.col("coding_total")
    share = lambda c: F.when(tokens > 0, F.round(F.round(F.col(c) * 1000.0 / tokens) / 10.0, 1))
    return totals.select(
        "request_id", share("helper_total").alias("helper_percent"), share("coding_total").alias("coding_percent"),
        F.when(F.col("total_cost") > 0.1, "danger").when(F.col("total_cost") > 0.05, "warning")
        .otherwise("success").alias("cost_band"))


# -- running totals ------------------------------------------------------------------------------
def running_sums(df: DataFrame, keys: list[str], order: str, values: list[str], bits: int = 16) -> DataFrame:
    """Running sums of ``values`` in ``order`` per ``keys``, without putting a whole key into one task.

    ``order`` is a unique non-negative whole number; keys are not null. Rows fall into blocks of 2**bits consecutive order values,
    blocks into super-blocks likewise. Each window sees one block, the blocks of one super-block, or the
    super-blocks of one key, so a key holding most of the log still spreads over all tasks.
    """
    frame = (Window.unboundedPreceding, Window.currentRow)
    before = (Window.unboundedPreceding, -1)

    def sums(names, window):
        return [F.sum(v).over(window).alias(n) for n, v in names.items()]

    # Not nullable, so that every branch below reads the same blocks and Spark reuses their shuffle.
    blocked = df.withColumn("_block", or_zero(F.shiftright(order, bits)))
    blocks = blocked.groupBy(*keys, "_block").agg(*[F.sum(v).alias(v) for v in values]).withColumn(
        "_super", or_zero(F.shiftright("_block", bits)))
    supers = blocks.groupBy(*keys, "_super").agg(*[F.sum(v).alias(v) for v in values])
    in_super = Window.partitionBy(*keys, "_super").orderBy("_block").rowsBetween(*before)
    in_key = Window.partitionBy(*keys).orderBy("_super").rowsBetween(*before)
    block_offsets = blocks.select(*keys, "_super", "_block", *sums({f"_b_{v}": v for v in values}, in_super))
    super_offsets = supers.select(*keys, "_super", *sums({f"_s_{v}": v for v in values}, in_key))
    offsets = block_offsets.join(super_offsets, [*keys, "_super"]).select(
        *keys, "_block", *[(or_zero(F.col(f"_b_{v}")) + or_zero(F.col(f"_s_{v}"))).alias(f"_o_{v}") for v in values])
    in_block = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(*frame)
    local = blocked.select("*", *sums({f"_l_{v}": v for v in values}, in_block))
    return local.join(offsets, [*keys, "_block"]).select(
        *df.columns, *[(F.col(f"_l_{v}") + F.col(f"_o_{v}")).alias(f"running_{v}") for v in values])


RUNNING_VALUES = ["tokens_in", "tokens_out", "cost"]


def priced_calls(calls: DataFrame) -> DataFrame:
    """Calls with exact costs, as running totals add them up."""
    return price_calls(calls).withColumn("cost", exact(F.col("cost")))


def running_columns(running: DataFrame) -> DataFrame:
    return running.select(
        "call_id", "request_id", "role", "running_tokens_in", "running_tokens_out",
        (F.col("running_tokens_in") + F.col("running_tokens_out")).alias("running_total"),
        F.round("running_cost", COST_DECIMALS).cast("double").alias("running_cost"))


def running_usage(calls: DataFrame, scope: str = "request") -> DataFrame:
    """Cumulative tokens and cost after each call, per role: within its request, or over the whole log.

    The calls of a request are few, so one window sums them; the log goes through blocks. A log that grows is kept in a
    ``running_log.RunningLog`` of ``priced_calls``."""
    priced = priced_calls(calls)
    if scope == "request":
        window = Window.partitionBy("request_id", "role").orderBy("call_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = priced.withColumns({f"running_{v}": F.sum(v).over(window) for v in RUNNING_VALUES})
    else:
        running = running_sums(priced, ["role"], "call_id", RUNNING_VALUES)
    return running_columns(running)
