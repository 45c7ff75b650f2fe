"""Usage and cost of calls: pre-aggregated sums over the ledger."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.specs import Model, Pricing, need

KEYS = ("model", "llm_role", "is_fallback")


def price_table(path: str) -> dict[str, Pricing]:
    """Prices from a JSON file in the widely used form {model: {"input_cost_per_token": x, "output_cost_per_token": y}}; models without both are left out."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f, parse_float=Decimal)
    per = lambda v: Decimal(str(v)) * 1_000_000
    return {m: Pricing(per(v["input_cost_per_token"]), per(v["output_cost_per_token"])) for m, v in held.items() if isinstance(v, dict) and v.get("input_cost_per_token") is not None and v.get("output_cost_per_token") is not None}


def priced(model: Model, table: dict[str, Pricing] | None = None) -> Pricing | None:
    """A model's own pricing, or with ``auto_pricing`` the table's, under its whole name or the one behind the provider's."""
    if not model.auto_pricing:
        return model.pricing
    need(table is not None, "auto_pricing needs a price table")
    found = table.get(model.model) or table.get(model.model.partition("/")[2])
    need(found, f"the price table has no {model.model}")
    return found


def prices(spark, models, table: dict[str, Pricing] | None = None) -> DataFrame:
    """(model, llm_role, is_fallback, price_in, price_out) of models and their fallbacks; null where none is set."""
    rows = []
    for m in models:
        for x in (m, m.fallback):
            if x is not None:
                price = priced(x, table)
                rows.append((x.model, x.role, x.is_fallback, price and price.input, price and price.output))
    return spark.createDataFrame(rows, "model string, llm_role string, is_fallback boolean, price_in decimal(18,6), price_out decimal(18,6)")


def reset(ledger: DataFrame, role: str | None = None) -> DataFrame:
    """The ledger without the calls of a role, or of any: usage and cost of these begin anew."""
    return ledger.where(F.lit(False) if role is None else F.col("llm_role") != role)


def usage(ledger: DataFrame, priced: DataFrame | None = None) -> DataFrame:
    """Per model, role and fallback: calls, and tokens of those with a price (all tokens without a price table)."""
    if priced is None:
        return ledger.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"))
    counted = ledger.join(F.broadcast(priced), list(KEYS), "left")
    known = F.col("price_in").isNotNull()
    tokens = lambda c: F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0)).alias(c)
    return counted.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("calls"), tokens("in_tokens"), tokens("out_tokens"))


def side_cost(tokens: Column, price: Column) -> Column:
    """Exact decimal cost of tokens at a price for a million, before rounding."""
    return (tokens.cast("decimal(20,0)") * price.cast("decimal(12,6)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(38,12)")


def cost(ledger: DataFrame, priced: DataFrame) -> DataFrame:
    """Per model, role and fallback: in, out (each rounded half up to 5 places) and their sum."""
    sums = usage(ledger, priced).join(F.broadcast(priced), list(KEYS)).where("price_in IS NOT NULL")
    a, b = F.round(side_cost(F.col("in_tokens"), F.col("price_in")), 5), F.round(side_cost(F.col("out_tokens"), F.col("price_out")), 5)
    return sums.select(*KEYS, a.alias("cost_in"), b.alias("cost_out"), (a + b).alias("cost_total"))


def of_role(report: DataFrame, role: str | None) -> DataFrame:
    """Rows of one role; an error if there are none."""
    if role is None:
        return report
    found = report.where(F.col("llm_role") == role)
    if not found.limit(1).count():
        raise ValueError(f"nothing for the role {role!r}")
    return found


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two usage reports as one."""
    return a.unionByName(b).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("calls", "in_tokens", "out_tokens")])
