"""Token usage and cost of model calls."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.literals import constant

MILLION = 1_000_000


@dataclass(frozen=True)
class Price:
    """Rates per million tokens; without a cached rate the input rate applies."""

    input: float
    cached_input: float | None
    output: float
    currency: str = "USD"


# List prices per million tokens, for estimates only.
PRICES = {
    "gpt-4o-mini": Price(0.15, 0.075, 0.6),
    "gpt-5.4-nano": Price(0.2, 0.02, 1.25),
    "gpt-5.4-mini": Price(0.75, 0.075, 4.5),
    "gpt-5.4": Price(2.5, 0.25, 15.0),
}


def with_overrides(prices: Mapping[str, Price], overrides: Mapping[str, Mapping]) -> dict[str, Price]:
    return {name: replace(p, **overrides.get(name, {})) for name, p in prices.items()}


def match_price(model: Column, prices: Mapping[str, Price] = PRICES) -> Column:
    """The price whose name equals the model or is its longest prefix before a dash (null if none)."""
    rows = [
        {"model": n, "input": p.input, "cached_input": p.input if p.cached_input is None else p.cached_input,
         "output": p.output, "currency": p.currency}
        for n, p in sorted(prices.items(), key=lambda x: (-len(x[0]), x[0]))
    ]
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(model, F.lit("")))), r"\s+", "-")
    fits = F.filter(constant(rows), lambda p: (name == p["model"]) | F.startswith(name, F.concat(p["model"], F.lit("-"))))
    return F.get(fits, F.lit(0))


def call_costs(calls: DataFrame, prices: Mapping[str, Price] = PRICES) -> DataFrame:
    """Add price, uncached and cached tokens and costs; costs are null without a price or a token count."""
    prompt, completion = F.col("prompt_tokens"), F.col("completion_tokens")
    cached = F.least(prompt, F.greatest(F.lit(0), F.coalesce("cached_tokens", F.lit(0))))
    priced = calls.withColumn("price", match_price(F.col("model"), prices))
    known = F.col("price").isNotNull() & prompt.isNotNull() & completion.isNotNull()
    rate = lambda n: F.col(f"price.{n}")
    costed = priced.withColumn("cached_prompt_tokens", F.when(known, cached)).withColumn(
        "uncached_prompt_tokens", F.when(known, prompt - cached))
    input_cost = (F.col("uncached_prompt_tokens") / MILLION) * rate("input") + (
        F.col("cached_prompt_tokens") / MILLION) * rate("cached_input")
    costed = costed.withColumn("input_cost", F.round(input_cost, 12)).withColumn(
        "output_cost", F.when(known, F.round((completion / MILLION) * rate("output"), 12)))
    return costed.withColumn("total_cost", F.round(F.col("input_cost") + F.col("output_cost"), 12)).withColumn(
        "currency", F.when(known, rate("currency")))


def usage_totals(calls: DataFrame, *by: str) -> DataFrame:
    """Token totals of the calls that report both counts."""
    prompt, completion, cached = F.col("prompt_tokens"), F.col("completion_tokens"), F.col("cached_tokens")
    both = calls.filter(prompt.isNotNull() & completion.isNotNull())
    return both.groupBy(*by).agg(
        F.sum(prompt).alias("prompt_tokens"), F.sum(completion).alias("completion_tokens"),
        F.sum(F.coalesce(F.col("total_tokens"), prompt + completion)).alias("total_tokens"),
        F.sum(F.when(cached.isNotNull(), F.least(prompt, F.greatest(F.lit(0), cached)))).alias("cached_tokens"),
    )


def cost_totals(costed: DataFrame, *by: str) -> DataFrame:
    """Cost totals; a group with more than one currency is an error when it is read."""
    money = lambda c: F.sum(F.col(c).cast("decimal(24,12)")).cast("double").alias(c)
    known = costed.filter(F.col("total_cost").isNotNull())
    summed = known.groupBy(*by).agg(
        F.min("currency").alias("currency"), F.max("currency").alias("other"),
        money("input_cost"), money("output_cost"), money("total_cost"), F.count("*").alias("calls"))
    mixed = F.raise_error(F.concat(F.lit("cannot add "), F.col("currency"), F.lit(" and "), F.col("other")))
    return summed.withColumn("currency", F.when(F.col("currency") != F.col("other"), mixed.cast("string")).otherwise(F.col("currency"))).drop("other")


def cached_percentage(cached: Column, prompt: Column) -> Column:
    return F.round(F.when(prompt > 0, cached / prompt * 100), 2)
