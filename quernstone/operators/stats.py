"""Aggregates over scores, segments and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.quality import RULE_METRICS, grade, recommendations, tier


def quality_averages(scored: DataFrame) -> DataFrame:
    """One row: means of the rule metrics and overall, the grade, and recommendations."""
    names = [*RULE_METRICS, "overall"]
    means = scored.agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in names))
    return means.withColumn("grade", grade(F.col("overall"))).withColumn("recommendations", recommendations({m: F.col(m) for m in names}))


def tier_distribution(scores: DataFrame, score_col: str = "overall") -> DataFrame:
    """tier, n."""
    return scores.groupBy(tier(F.col(score_col)).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def halves(scores: DataFrame, order: list[str], score_col: str, group: list[str] | None = None) -> DataFrame:
    """Means of the first and second half of each group's scores in order, and direction.
    Groups of fewer than ten have none."""
    group = group or []
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    rows = scores.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_at", F.row_number().over(by.orderBy(*order))).where("_n >= 10")
    first = F.col("_at") <= F.floor(F.col("_n") / 2)
    means = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(first, F.col(score_col))).alias("first_half"), F.avg(F.when(~first, F.col(score_col))).alias("second_half"), F.avg(F.when(F.col("_at") > F.col("_n") - 100, F.col(score_col))).alias("current"))
    return means.withColumn("direction", F.when(F.col("second_half") > F.col("first_half"), "improving").otherwise("declining"))


def drift(scores: DataFrame, at: Column, score_col: str, time_col: str = "ts", hours: int = 24, threshold: float = 5.0, group: list[str] | None = None) -> DataFrame:
    """Mean score of the hours before a moment against that before them; drift if they
    differ by more than the threshold and each has ten scores."""
    recent = F.col(time_col) >= at - F.expr(f"INTERVAL {hours} HOURS")
    means = scores.groupBy(*(group or [])).agg(F.count_if(recent).alias("n_recent"), F.count_if(~recent).alias("n_before"), F.avg(F.when(recent, F.col(score_col))).alias("recent"), F.avg(F.when(~recent, F.col(score_col))).alias("before"))
    enough = (F.col("n_recent") >= 10) & (F.col("n_before") >= 10)
    amount = F.abs(F.col("recent") - F.col("before"))
    return means.withColumn("drift", enough & (amount > threshold)).withColumn("direction", F.when(enough, F.when(F.col("recent") < F.col("before"), "decline").otherwise("improvement")))


def classification_stats(rows: DataFrame) -> DataFrame:
    """role, method, n, mean confidence of classified segments; null marks a total."""
    return rows.rollup("role", "method").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: items, passed, pass_rate, cost, cost_per_passed of results with passed, cost."""
    totals = results.agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"), F.sum("cost").alias("cost"))
    return totals.withColumn("pass_rate", F.col("n_passed") / F.greatest(F.lit(1), F.col("n"))).withColumn("cost_per_passed", F.when(F.col("n_passed") > 0, F.col("cost") / F.col("n_passed")))


def common_corrections(results: DataFrame, k: int = 10) -> DataFrame:
    """prefix (up to the colon) and n of the k most frequent corrections."""
    rows = results.select(F.explode("corrections").alias("c")).groupBy(F.split_part("c", F.lit(":"), F.lit(1)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "prefix").limit(k)


def counts(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows for each combination of the columns, ordered by nothing."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def progress(rows: DataFrame, success: Column) -> DataFrame:
    """One row: processed, succeeded, failed, success_rate."""
    totals = rows.agg(F.count(F.lit(1)).alias("processed"), F.count_if(success).alias("succeeded"))
    return totals.withColumn("failed", F.col("processed") - F.col("succeeded")).withColumn("success_rate", F.col("succeeded") / F.greatest(F.lit(1), F.col("processed")))


def head_sample(rows: DataFrame, share: float, *order: Column) -> DataFrame:
    """The first max(1, share * n) rows in order, a sample that the reporting phase scores.
    Only the order's columns are sorted before the limit joins back."""
    n = rows.count()
    return rows.orderBy(*order).limit(max(1, int(n * share)))


def strided(rows: DataFrame, most: int, *order: Column, by: list[str] | None = None) -> DataFrame:
    """At most `most` rows of each group, spread evenly over its order."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    numbered = rows.withColumn("_i", F.row_number().over(group.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(group))
    stride = F.greatest(F.lit(1.0), F.col("_n") / most)
    chosen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.floor(j * stride).cast("int"))
    return numbered.where(F.array_contains(chosen, F.col("_i"))).drop("_i", "_n")


def search(rows: DataFrame, columns: list[str], phrase: str) -> DataFrame:
    """Rows in which any column contains the phrase, whatever its case."""
    found = F.lit(False)
    for column in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(phrase.lower()))
    return rows.where(found)


def suggest(rows: DataFrame, name_col: str, phrase: str, k: int = 5) -> DataFrame:
    """The k most used rows whose name contains the phrase (needs usage_count)."""
    return search(rows, [name_col], phrase).orderBy(F.desc("usage_count"), name_col).limit(k)
