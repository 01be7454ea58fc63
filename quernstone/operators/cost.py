"""Costs of model calls: prices, the ledger, budgets, and the response cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions.text import safe, tokens_by_chars

# Prices for a thousand tokens, in and out, and alert levels of a budget.
PRICES = {"gpt-3.5-turbo": (0.0015, 0.002), "gpt-4": (0.03, 0.06), "gpt-4-turbo": (0.01, 0.03)}
DEFAULT_MODEL = "gpt-3.5-turbo"
ALERTS = (0.5, 0.8, 0.9)


def price_table(spark: SparkSession, prices: dict[str, tuple[float, float]] = PRICES) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in prices.items()], "model string, price_in double, price_out double")


def with_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (model, tokens_in, tokens_out) with cost; models without a price cost as the
    default one. The prices are a handful of rows."""
    fallback = PRICES[DEFAULT_MODEL]
    joined = calls.join(F.broadcast(prices), "model", "left")
    price = lambda name, k: F.coalesce(F.col(name), F.lit(fallback[k]))
    return joined.withColumn("cost", F.col("tokens_in") / 1000 * price("price_in", 0) + F.col("tokens_out") / 1000 * price("price_out", 1)).drop("price_in", "price_out")


def text_tokens(text: Column) -> Column:
    return tokens_by_chars(text)


def daily_estimate(texts_per_day: int, chars: int, classify: str | None, enhance: str | None, limit: float, prices: dict = PRICES) -> dict[str, float | bool]:
    """Costs of a day: a short classification of each text, and a rewrite of three in ten."""
    tokens = chars // 4
    price = lambda m: prices.get(m, prices[DEFAULT_MODEL])
    first = (tokens / 1000 * price(classify)[0] + tokens // 10 / 1000 * price(classify)[1]) * texts_per_day if classify else 0.0
    second = (tokens / 1000 * sum(price(enhance))) * texts_per_day * 0.3 if enhance else 0.0
    return {"classification": first, "enhancement": second, "total": first + second, "within_limit": first + second <= limit}


def ledger(calls: DataFrame, time_col: str = "ts") -> DataFrame:
    """date, model, cost, tokens, requests, with a total over models for each date (null
    model) and over all (null date)."""
    rows = calls.withColumn("date", F.to_date(time_col))
    return rows.rollup("date", "model").agg(F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("requests"))


def cost_report(calls: DataFrame, last_day: Column, days: int = 7, time_col: str = "ts") -> DataFrame:
    """One row for each model and one for all (null): sums of the days up to last_day, and
    the mean for a day, over all days whether they have calls or not."""
    day = F.to_date(time_col)
    recent = calls.where((day <= last_day) & (day > F.date_sub(last_day, days)))
    return recent.rollup("model").agg(F.sum("cost").alias("total_cost"), F.sum("tokens").alias("total_tokens"), F.count(F.lit(1)).alias("total_requests"), (F.sum("cost") / days).alias("average_daily_cost"))


def budget_alerts(calls: DataFrame, daily_limit: float, time_col: str = "ts", order: str = "event_id") -> DataFrame:
    """date, threshold, order's value and spent of the call that first reached each alert
    level of its day."""
    # two levels, so that no task takes a whole day: minutes of a day, and calls of a minute
    rows = calls.withColumn("date", F.to_date(time_col)).withColumn("_minute", F.date_trunc("minute", time_col))
    earlier = Window.partitionBy("date").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("date", "_minute").agg(F.sum("cost").alias("_total")).select("date", "_minute", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_offset"))
    inside = Window.partitionBy("date", "_minute").orderBy(time_col, order).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("_inside", F.sum("cost").over(inside)).join(offsets, ["date", "_minute"]).withColumn("spent", F.col("_offset") + F.col("_inside"))
    levels = F.array(*(F.lit(a) for a in ALERTS))
    crossed = F.filter(levels, lambda a: (F.col("spent") >= a * daily_limit) & (F.col("spent") - F.col("cost") < a * daily_limit))
    return running.select("date", order, "spent", F.explode(crossed).alias("threshold"))


def within_budget(calls: DataFrame, limit: float, order: str, groups: int = 64) -> DataFrame:
    """Calls in order while what was spent before them is below the limit.

    The running total has two levels, so that no task takes all calls: hashes of the order
    deal calls into so many ordered groups, whose totals (so many rows) are summed first.
    It takes calls in the order of that hash, which is fixed but favours no key.
    """
    at = F.xxhash64(order)
    rows = calls.withColumn("_at", at).withColumn("_group", F.floor((F.shiftrightunsigned(at, 1) / F.lit(float(1 << 63))) * groups).cast("int"))
    totals = rows.groupBy("_group").agg(F.sum("cost").alias("_total"))
    earlier = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_group", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_offset"))
    inside = Window.partitionBy("_group").orderBy(F.shiftrightunsigned("_at", 1), order).rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumn("_inside", F.coalesce(F.sum("cost").over(inside), F.lit(0.0))).join(F.broadcast(offsets), "_group")
    return running.where(F.col("_offset") + F.col("_inside") < limit).select(*calls.columns)


def normalised_prompt(prompt: Column) -> Column:
    """White space collapsed; short prompts in lower case."""
    bare = F.trim(F.regexp_replace(safe(prompt), r"\s+", " "))
    return F.when(F.length(bare) < 200, F.lower(bare)).otherwise(bare)


def cache_key(prompt: Column, model: Column, kind: Column | None = None) -> Column:
    """SHA-256 of the call as JSON with sorted keys."""
    kind = F.lit("general") if kind is None else kind
    return F.sha2(F.to_json(F.struct(model.alias("model"), normalised_prompt(prompt).alias("prompt"), kind.alias("type"))), 256)


def cached(calls: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """calls with the response of the cache, null where there is none or it has expired."""
    alive = cache.where(F.col("expires_at") > now).select("cache_key", "response")
    return calls.join(alive, "cache_key", "left").withColumn("is_hit", F.col("response").isNotNull())


def cache_store(cache: DataFrame, new: DataFrame) -> DataFrame:
    """cache with new entries in place of older ones of the same key."""
    rows = cache.unionByName(new)
    order = Window.partitionBy("cache_key").orderBy(F.desc("created_at"))
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def cache_optimise(cache: DataFrame, now: Column, large: int = 10_000) -> DataFrame:
    """cache without expired entries and, once it is large, without week-old entries that
    were used once and are of low quality."""
    n = cache.count()
    weak = (F.col("usage_count") == 1) & (F.col("quality_score") < 0.5) & (F.col("created_at") < now - F.expr("INTERVAL 7 DAYS"))
    return cache.where((F.col("expires_at") >= now) & (F.lit(n <= large) | ~weak))


def cache_analytics(cache: DataFrame, now: Column) -> DataFrame:
    """One row: entries, uses, cost, mean quality, entries that haven't expired."""
    return cache.agg(F.count(F.lit(1)).alias("total_entries"), F.sum("usage_count").alias("total_usage"), F.sum("cost").alias("total_cost"), F.avg("quality_score").alias("avg_quality"), F.count_if(F.col("expires_at") > now).alias("active_entries"))


def popular(cache: DataFrame, now: Column, k: int = 10) -> DataFrame:
    return cache.where(F.col("expires_at") > now).orderBy(F.desc("usage_count"), "cache_key").limit(k)


def batch_order(calls: DataFrame, kind_col: str = "kind") -> DataFrame:
    """calls with priority: classification first, then enhancement, then others."""
    return calls.withColumn("priority", F.when(F.col(kind_col) == "classification", 0).when(F.col(kind_col) == "enhancement", 1).otherwise(2))


def rate(calls: DataFrame, time_col: str = "ts", window: str = "60 seconds", slide: str = "1 second") -> DataFrame:
    """start, n: calls in each sliding window, to see where a rate limit would bite."""
    return calls.groupBy(F.window(time_col, window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def advice(totals: Column, hit_rate: Column, spent_share: Column, costly_share: Column) -> Column:
    """Codes of what would lower costs."""
    return F.array_compact(F.array(F.when(hit_rate < 0.3, "raise_cache_use"), F.when(spent_share > 0.8, "near_budget"), F.when(costly_share > 0.5, "use_cheaper_models"), F.when(totals < 10, "batch_more")))
