"""The filter cascade: gate, semantics, duplicates, policy; the first failure decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import filters
from quernstone.functions.text import let, safe
from quernstone.operators.dedup import content_hash
from quernstone.operators.skew import join_groups
from quernstone.operators.store import Work

LAYERS = ("gate", "semantic", "dedup", "policy")


def cascade(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, compat: bool = False) -> DataFrame:
    """id, failed_layer (null if it passed all) and reasons.

    Only documents that pass gate and semantics count as earlier copies. A text's own
    size stands in for its file's.
    """
    text = F.col(text_col)
    size = F.octet_length(safe(text)).cast("long")

    def layers(gate):
        # each layer looks only at what the one before lets through
        semantic = F.when(gate["passed"], filters.semantic_result(text, compat))
        policy = lambda s: F.struct(gate.alias("gate"), s.alias("semantic"), F.when(s["passed"], filters.policy_result(text)).alias("policy"))
        return let(semantic, policy)

    verdicts = let(filters.gate_result(F.lit("a.txt"), size), layers)
    # narrow, and read twice
    checked = Work(docs.sparkSession, "cascade").table(docs.select(id_col, verdicts.alias("v"), content_hash(text).alias("content_hash")).select(id_col, "v.*", "content_hash"), "verdicts")
    alive = F.coalesce(F.col("semantic.passed"), F.lit(False))
    groups = checked.where(alive).groupBy("content_hash").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = join_groups(checked, groups, "content_hash", F.col(id_col))
    layer = F.when(~F.col("gate.passed"), "gate").when(~F.col("semantic.passed"), "semantic").when(F.col("first_id") != F.col(id_col), "dedup").when(~F.col("policy.passed"), "policy")
    reasons = F.when(layer == "gate", F.col("gate.errors")).when(layer == "semantic", F.col("semantic.errors")).when(layer == "dedup", F.array(F.lit("duplicate"))).when(layer == "policy", F.col("policy.errors")).otherwise(F.array().cast("array<string>"))
    return joined.select(id_col, layer.alias("failed_layer"), reasons.alias("reasons"))
