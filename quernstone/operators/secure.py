"""Secure processing: sanitise, analyse, validate markup, decide, then format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import markup, sanitise, threats
from quernstone.functions.text import safe
from quernstone.operators.conversation import documents_to_conversations


def secure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", aggressive: bool = False, form: str | None = "NFKC") -> DataFrame:
    """id, threat_level, threats, threat_score (null for clean texts), markup, action and
    sanitised_text. The wider analysis is made only of texts that aren't clean."""
    text = safe(F.col(text_col))
    base = docs.select(id_col, text.alias("_text"), sanitise.sanitise(text, aggressive, form).alias("s"))
    score = F.when(F.col("s.threat_level") != "clean", threats.threat_score(F.col("_text"), forms=False))
    kinds = F.when(markup.looks_like_markup(F.col("_text")), markup.markup_kinds(F.col("_text"))).otherwise(F.array().cast("array<string>"))
    issues = F.array_contains(kinds, "html") & (markup.html_result(F.col("_text"))["n_security_issues"] > 0)
    rows = base.withColumn("threat_score", score).withColumn("markup", kinds)
    action = threats.final_action(F.col("s.action"), F.col("threat_score"), issues, aggressive)
    clean = sanitise.latin_homoglyphs(sanitise.without_invisible(F.col("_text")))
    rows = rows.withColumn("action", action)
    return rows.select(id_col, "s.threat_level", "s.threats", "threat_score", "markup", "action", F.when(F.col("action").isin("accept", "accept_with_warning"), F.coalesce("s.sanitised_text", clean)).alias("sanitised_text"))


def secure_conversations(docs: DataFrame, target: str = "qwen", id_col: str = "doc_id", text_col: str = "text", aggressive: bool = False) -> DataFrame:
    """Conversations of the documents that secure accepts."""
    accepted = secure(docs, id_col, text_col, aggressive).where("sanitised_text is not null")
    return documents_to_conversations(accepted.select(id_col, F.col("sanitised_text").alias("text")), target, id_col, "text")
