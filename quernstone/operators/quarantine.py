"""The quarantine: rows of rejected content, their search, review, statistics and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import safe

LEVELS = ("clean", "suspicious", "dangerous", "corrupted", "critical")
STATUSES = ("pending", "approved", "rejected", "needs_review")


def entries(rows: DataFrame, text_col: str, level: Column, threats: Column, at: Column, source: Column, action: Column) -> DataFrame:
    """rows as quarantine entries: entry_id, content_hash, content, threat_level, threats,
    source_file, timestamp, action_taken, review_status."""
    content = safe(F.col(text_col))
    digest = F.sha2(content, 256)
    return rows.select(
        F.concat(F.lit("q_"), F.substring(digest, 1, 16)).alias("entry_id"),
        digest.alias("content_hash"),
        content.alias("content"),
        level.alias("threat_level"),
        threats.alias("threats"),
        source.alias("source_file"),
        at.alias("timestamp"),
        action.alias("action_taken"),
        F.lit("pending").alias("review_status"),
    )


def store(table: DataFrame | None, new: DataFrame) -> DataFrame:
    """table with new entries; of one content_hash the latest stays, ties by entry_id."""
    rows = new if table is None else table.unionByName(new)
    order = Window.partitionBy("content_hash").orderBy(F.desc("timestamp"), "entry_id")
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def search(table: DataFrame, threat_level: str | None = None, review_status: str | None = None, start: Column | None = None, end: Column | None = None, source_file: str | None = None, limit: int = 100) -> DataFrame:
    """Latest entries that meet all given conditions; they are pushed to the scan."""
    for condition in (
        threat_level and (F.col("threat_level") == threat_level),
        review_status and (F.col("review_status") == review_status),
        F.col("timestamp") >= start if start is not None else None,
        F.col("timestamp") <= end if end is not None else None,
        source_file and F.contains("source_file", F.lit(source_file)),
    ):
        if condition is not None:
            table = table.where(condition)
    return table.orderBy(F.desc("timestamp"), "entry_id").limit(limit)


def pending(table: DataFrame, limit: int = 50) -> DataFrame:
    return search(table, review_status="pending", limit=limit)


def high_threats(table: DataFrame, limit: int = 50) -> DataFrame:
    """Half of the limit of critical entries, then of dangerous ones."""
    parts = [search(table, threat_level=level, limit=limit // 2).withColumn("rank", F.lit(k)) for k, level in enumerate(("critical", "dangerous"))]
    return parts[0].unionByName(parts[1])


def review(table: DataFrame, decisions: DataFrame) -> DataFrame:
    """table with review_status and reviewer_notes of decisions (entry_id, review_status,
    reviewer_notes); only pending entries and those that need review change."""
    named = decisions.select("entry_id", F.col("review_status").alias("_status"), F.col("reviewer_notes").alias("_notes")).where(F.col("review_status").isin(*STATUSES))
    joined = table.join(named, "entry_id", "left")
    may = F.col("review_status").isin("pending", "needs_review") & F.col("_status").isNotNull()
    notes = F.col("reviewer_notes") if "reviewer_notes" in table.columns else F.lit(None).cast("string")
    return joined.withColumn("review_status", F.when(may, F.col("_status")).otherwise(F.col("review_status"))).withColumn("reviewer_notes", F.when(may, F.col("_notes")).otherwise(notes)).drop("_status", "_notes")


def statistics(table: DataFrame, now: Column) -> DataFrame:
    """measure (total, level, status, recent), key, n: all counts in one pass by grouping
    sets; recent is the last seven days."""
    rows = table.withColumn("recent", F.when(F.col("timestamp") >= now - F.expr("INTERVAL 7 DAYS"), "recent"))
    grouped = rows.groupingSets([[], ["threat_level"], ["review_status"], ["recent"]], "threat_level", "review_status", "recent").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    measure = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "level").when(F.col("g") == 5, "status").otherwise("recent")
    return grouped.select(measure.alias("measure"), F.coalesce("threat_level", "review_status", "recent").alias("key"), "n").where("measure != 'recent' or key is not null")


def threat_report(table: DataFrame, now: Column, days: int = 7, k: int = 10) -> DataFrame:
    """threat, n, n_distinct, n_total of the k most frequent threats of the last days."""
    recent = table.where(F.col("timestamp") >= now - F.expr(f"INTERVAL {days} DAYS"))
    counted = recent.select(F.explode("threats").alias("threat")).groupBy("threat").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_total"))
    return counted.orderBy(F.desc("n"), "threat").limit(k).crossJoin(F.broadcast(totals))


def export(table: DataFrame, limit: int = 10_000, preview: int = 100) -> DataFrame:
    """The latest entries with a preview of their content and threats as one string."""
    rows = table.orderBy(F.desc("timestamp"), "entry_id").limit(limit)
    short = F.when(F.length("content") > preview, F.concat(F.substring("content", 1, preview), F.lit("..."))).otherwise(F.col("content"))
    return rows.select("entry_id", "timestamp", "threat_level", F.array_join("threats", ";").alias("threats"), "source_file", "review_status", short.alias("content_preview"))


def purge(table: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """table without reviewed entries older than the days; pending ones stay."""
    old = (F.col("timestamp") < now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("review_status") != "pending")
    return table.where(~old)


def remediation_next(queue: DataFrame) -> DataFrame:
    """The pending item with the lowest score, ties by item_id."""
    return queue.where("status = 'pending'").orderBy("score", "item_id").limit(1)


def remediation_stats(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


def transition(queue: DataFrame, changes: DataFrame) -> DataFrame:
    """queue with status of changes (item_id, status) where the step is allowed: pending to
    processing, processing to completed or failed, failed to pending."""
    allowed = F.create_map(F.lit("pending"), F.array(F.lit("processing")), F.lit("processing"), F.array(F.lit("completed"), F.lit("failed")), F.lit("failed"), F.array(F.lit("pending")))
    joined = queue.join(changes.select("item_id", F.col("status").alias("_to")), "item_id", "left")
    may = F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("status")), F.col("_to")), F.lit(False))
    return joined.withColumn("status", F.when(may, F.col("_to")).otherwise(F.col("status"))).drop("_to")
