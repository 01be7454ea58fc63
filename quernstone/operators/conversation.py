"""From documents and rows of turns to conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import formats
from quernstone.functions.normalise import preprocess
from quernstone.functions.text import ANSWER_PATTERNS, QUESTION_PATTERNS, answer_score, input_problem, pattern_score, question_score, segments, strip


def _ends_as_question(text: Column) -> Column:
    return F.endswith(strip(text), F.lit("?"))


def _looks_like_user(text: Column) -> Column:
    return _ends_as_question(text) | (question_score(text) > answer_score(text))


def classified_role(text: Column, previous: Column) -> Column:
    """user or assistant for a segment, given the one before it (null at the start).

    Seven tenths score and three tenths patterns each way; after a question answers gain
    0.3, after an answer questions gain 0.2; a question mark adds 0.5. Scores count in
    hundredths, so that thresholds are exact.
    """
    after_user, has_context = _looks_like_user(previous), previous.isNotNull()
    hundredths = lambda score, weight: F.round(score * weight)
    ask = hundredths(question_score(text), 70) + hundredths(pattern_score(text, QUESTION_PATTERNS), 30) + F.when(has_context & ~after_user, 20).otherwise(0) + F.when(_ends_as_question(text), 50).otherwise(0)
    tell = hundredths(answer_score(text), 70) + hundredths(pattern_score(text, ANSWER_PATTERNS), 30) + F.when(has_context & after_user, 30).otherwise(0)
    fallback = F.when(has_context & after_user, "assistant").otherwise("user")
    return F.when((ask > tell) & (ask > 40), "user").when(tell > 30, "assistant").otherwise(fallback)


def rule_role(text: Column) -> Column:
    """user if a segment looks more like a question than an answer."""
    return F.when(question_score(text) > answer_score(text), "user").otherwise("assistant")


def classify_segments(rows: DataFrame, key: str, order: str, text_col: str = "text") -> DataFrame:
    """rows with role; only the segment just before counts as context."""
    previous = F.lag(text_col).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_previous", previous).withColumn("role", classified_role(F.col(text_col), F.col("_previous"))).drop("_previous")


def context_window(rows: DataFrame, key: str, order: str, text_col: str = "text", size: int = 5) -> DataFrame:
    """rows with context, the texts of the size segments before each, in order."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(-size, -1)
    return rows.withColumn("context", F.collect_list(text_col).over(before))


def document_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, text: segments of documents that can be formatted."""
    usable = docs.where(input_problem(F.col(text_col)) == "")
    return usable.select(id_col, F.posexplode(segments(preprocess(F.col(text_col)))).alias("pos", "text"))


def documents_to_conversations(docs: DataFrame, target: str = "qwen", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, segments, formatted: documents split, classified and rendered."""
    rows = classify_segments(document_segments(docs, id_col, text_col), id_col, "pos")
    grouped = rows.groupBy(id_col).agg(formats.turns(F.col("role"), F.col("text"), F.col("pos")).alias("segments"))
    return grouped.withColumn("formatted", formats.render(F.col("segments"), target))


def conversations(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, segments: rows of turns as one array each. A conversation is bounded by what a
    model can take in; turns of all of them meet in one shuffle by key."""
    return rows.groupBy(key).agg(formats.turns(F.col(role), F.coalesce(F.col(text), F.lit("")), F.col(order)).alias("segments"))


def render_conversations(rows: DataFrame, target: str, key: str = "conv_id", order: str = "turn") -> DataFrame:
    return conversations(rows, key, order).select(key, formats.render(F.col("segments"), target).alias("formatted"))


def question_answer_rows(pairs: DataFrame, target: str = "qwen", question: str = "question", answer: str = "answer") -> DataFrame:
    """pairs with formatted: each question and answer as a user's and an assistant's turn."""
    both = F.array(F.struct(F.lit("user").alias("role"), F.col(question).alias("content")), F.struct(F.lit("assistant").alias("role"), F.col(answer).alias("content")))
    return pairs.withColumn("formatted", formats.render(both, target))


def hybrid_role(rule_role: Column, rule_confidence: Column, model_role: Column, model_confidence: Column) -> Column:
    """Struct role, confidence, method: a confident model wins (over 0.8), then confident
    rules (over 0.6); else agreement blends 0.7 to 0.3 and otherwise the surer one counts."""
    blend = model_confidence * 0.7 + rule_confidence * 0.3
    role = F.when(model_confidence > 0.8, model_role).when(rule_confidence > 0.6, rule_role).when(model_role == rule_role, model_role).when(model_confidence * 0.7 >= rule_confidence * 0.3, model_role).otherwise(rule_role)
    confidence = F.when(model_confidence > 0.8, model_confidence).when(rule_confidence > 0.6, rule_confidence).otherwise(blend)
    method = F.when(model_confidence > 0.8, "model").when(rule_confidence > 0.6, "rules").otherwise("hybrid")
    return F.struct(role.alias("role"), confidence.alias("confidence"), method.alias("method"))


def rule_confidence(text: Column) -> Column:
    """How far question and answer scores are apart, 0.1 to 0.95."""
    return F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.abs(question_score(text) - answer_score(text))))
