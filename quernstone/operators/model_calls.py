"""Calls to a language model behind an interface, with cache, budget and retries.

A client is any callable from a list of prompts to a list of replies. Nothing here talks
to a network; tests use a client that computes its replies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.quality import compliance, parsed_model_scores
from quernstone.functions.text import safe
from quernstone.operators import cost
from quernstone.operators.conversation import hybrid_role, rule_confidence, rule_role


class Client(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


# Models and options of each mode of work.
MODES = {
    "cost_optimized": {"classify": "gpt-3.5-turbo", "enhance": None, "daily_limit": 1.0},
    "balanced": {"classify": "gpt-3.5-turbo", "enhance": "gpt-3.5-turbo", "daily_limit": 5.0},
    "quality_focused": {"classify": "gpt-4-turbo", "enhance": "gpt-4-turbo", "daily_limit": 20.0},
    "offline": {"classify": None, "enhance": None, "daily_limit": 0.0},
}


def classify_prompt(text: Column) -> Column:
    return F.concat(F.lit("Answer with one word, user or assistant. Who says this?\n"), safe(text))


def enhance_prompt(text: Column, kind: Column) -> Column:
    return F.concat(F.lit("Improve the "), kind, F.lit(" of the text below. Keep its meaning.\n"), safe(text))


def score_prompt(text: Column) -> Column:
    return F.concat(F.lit("Score the text below from 0 to 100 as JSON with accuracy, fluency, personality_depth, coherence, training_readiness, overall, confidence.\n"), safe(text))


def template(text: str, *slots: str) -> Callable[[Column], Column]:
    """A prompt with {slot} marks, filled from a map column of values; missing ones are
    empty. Its hash names its version."""

    def fill(values: Column) -> Column:
        out = F.lit(text)
        for slot in slots:
            out = F.replace(out, F.lit("{" + slot + "}"), F.coalesce(F.try_element_at(values, F.lit(slot)), F.lit("")))
        return out

    return fill


def call(prompts: DataFrame, client: Client, id_col: str = "id", prompt_col: str = "prompt", batch: int = 5) -> DataFrame:
    """id, prompt, response, error: replies in small batches from within the tasks. A batch
    that fails gives its error's name and no response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                some = rows.slice(at, batch)
                try:
                    replies, error = client(some.column(1).to_pylist()), None
                except Exception as problem:  # whatever a client raises is this batch's result
                    replies, error = [None] * some.num_rows, type(problem).__name__
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(replies, pa.string()), pa.array([error] * some.num_rows, pa.string())], names=["id", "prompt", "response", "error"])

    rows = prompts.select(F.col(id_col).cast("string").alias("id"), F.col(prompt_col).alias("prompt"))
    return rows.mapInArrow(run, "id string, prompt string, response string, error string")


def call_cached(prompts: DataFrame, client: Client, cache: DataFrame, model: str, now: Column, budget: float | None = None) -> DataFrame:
    """id, response, error, is_hit: from the cache where it has an answer; of the rest each
    distinct prompt is called once, within the budget in a fixed order of keys. What is over
    budget has the error over_budget."""
    keyed = prompts.withColumn("cache_key", cost.cache_key(F.col("prompt"), F.lit(model)))
    found = cost.cached(keyed, cache, now)
    misses = found.where(~F.col("is_hit")).groupBy("cache_key").agg(F.min("prompt").alias("prompt"))
    if budget is not None:
        price = cost.PRICES.get(model, cost.PRICES[cost.DEFAULT_MODEL])
        tokens = F.floor(F.length("prompt") / 4)
        misses = cost.within_budget(misses.withColumn("cost", tokens / 1000 * sum(price)), budget, "cache_key").drop("cost")
    replies = call(misses, client, "cache_key").select(F.col("id").alias("cache_key"), F.col("response").alias("_response"), "error")
    joined = found.join(replies, "cache_key", "left")
    response = F.coalesce("response", "_response")
    return joined.select("id", response.alias("response"), F.when(response.isNull(), F.coalesce("error", F.lit("over_budget"))).alias("error"), "is_hit")


def hybrid_classify(rows: DataFrame, client: Client, id_col: str = "id", text_col: str = "text", model_confidence: float = 0.85) -> DataFrame:
    """id, role, confidence, method by rules and a model together."""
    replies = call(rows.select(F.col(id_col).cast("string").alias("id"), classify_prompt(F.col(text_col)).alias("prompt")), client)
    said = F.when(F.contains(F.lower("response"), F.lit("assistant")), "assistant").when(F.contains(F.lower("response"), F.lit("user")), "user")
    joined = rows.withColumn("_id", F.col(id_col).cast("string")).join(replies.select(F.col("id").alias("_id"), said.alias("_said")), "_id")
    text = F.col(text_col)
    merged = hybrid_role(rule_role(text), rule_confidence(text), F.coalesce("_said", rule_role(text)), F.when(F.col("_said").isNull(), 0.0).otherwise(model_confidence))
    return joined.select(id_col, merged.alias("m")).select(id_col, "m.role", "m.confidence", "m.method")


def best_of(rows: DataFrame, client: Client, target: str, attempts: int = 3, id_col: str = "id", prompt_col: str = "prompt") -> DataFrame:
    """id, response, score, attempt: up to so many calls for each prompt, until a reply keeps
    to the format entirely; else the best, ties to the earlier. Only what isn't settled
    yet is called again."""
    waiting, tried = rows.select(F.col(id_col).cast("string").alias("id"), F.col(prompt_col).alias("prompt")), None
    for k in range(1, attempts + 1):
        replies = call(waiting, client).select("id", "prompt", "response", F.coalesce(compliance(F.col("response"), target), F.lit(0.0)).alias("score"), F.lit(k).alias("attempt")).persist()
        tried = replies if tried is None else tried.unionByName(replies)
        waiting = replies.where("score < 100").select("id", "prompt")
    return tried.groupBy("id").agg(F.max_by(F.struct("response", "score", "attempt"), F.struct("score", -F.col("attempt"))).alias("best")).select("id", "best.response", "best.score", "best.attempt")


def score_with_model(rows: DataFrame, client: Client, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id and the scores that a model's replies hold."""
    replies = call(rows.select(F.col(id_col).cast("string").alias("id"), score_prompt(F.col(text_col)).alias("prompt")), client)
    return replies.select("id", parsed_model_scores(F.col("response")).alias("s")).select("id", "s.*")
