"""Writers: JSON lines, text parts, reports, audit logs and chat files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.normalise import cap
from quernstone.operators.chunk import chat_records, export_chunks
from quernstone.operators.structure import furniture_audit


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line; nulls are written, other scripts stay as they are."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    write_json(export_chunks(chunks), path)


def write_chat(chunks: DataFrame, path: str, system_prompt: str | None = None) -> None:
    """Chat fine-tuning records, one a line."""
    records = chat_records(chunks, system_prompt) if system_prompt else chat_records(chunks)
    records.select("record").write.mode("overwrite").text(path)


def text_parts(docs: DataFrame, limit: int, strategy: str = "split", id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """id, part_no (from 1), n_parts, n_bytes, name, text: documents within a size limit."""
    rows = docs.select(id_col, cap(F.col(text_col), limit, strategy).alias("parts"))
    exploded = rows.select(id_col, F.size("parts").alias("n_parts"), F.posexplode("parts").alias("pos", "text"))
    single = F.concat(F.col(id_col).cast("string"), F.lit("_sanitized"))
    name = F.when(F.col("n_parts") > 1, F.concat(single, F.format_string("_part%03d", F.col("pos") + 1))).otherwise(single)
    return exploded.select(id_col, (F.col("pos") + 1).alias("part_no"), "n_parts", F.octet_length("text").alias("n_bytes"), F.concat(name, F.lit(".txt")).alias("name"), "text")


def write_text_parts(parts: DataFrame, path: str, id_col: str = "document_id") -> None:
    """Texts as JSON lines with their names, and the manifest of their sizes beside them."""
    write_json(parts.select(id_col, "part_no", "name", "text"), f"{path}/parts")
    write_json(parts.select(id_col, "part_no", "n_parts", "n_bytes", "name"), f"{path}/manifest")


def write_structure(blocks: DataFrame, cleaned: DataFrame, path: str) -> None:
    """Blocks and the audit of what was removed."""
    write_json(blocks, f"{path}/structure")
    write_json(furniture_audit(cleaned), f"{path}/furniture_audit")


def write_validation(report: DataFrame, fates: DataFrame, issues: DataFrame, path: str) -> None:
    for name, rows in (("validation", report), ("manifest", fates), ("issues", issues)):
        write_json(rows, f"{path}/{name}")


def write_combined(records: DataFrame, path: str, column: str = "formatted", order: str | None = None) -> None:
    """One file of lines. It is for what one reader takes as a whole; large sets should be
    left in parts."""
    rows = records.orderBy(order) if order else records
    rows.select(column).coalesce(1).write.mode("overwrite").text(path)


def canonical_payload(row: Column) -> Column:
    """A struct as compact JSON, nulls included."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def append_log(events: DataFrame, path: str, time_col: str = "timestamp") -> None:
    """Events as JSON lines, appended in a folder for each day."""
    events.withColumn("date", F.to_date(time_col)).write.mode("append").partitionBy("date").json(path)


def split_outcome(rows: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """What goes to the archive and what to the error folder."""
    return rows.where(~failed), rows.where(failed)


def failed_outcomes(outcomes: DataFrame) -> DataFrame:
    """The names of outcomes (name, success) that failed."""
    return outcomes.where("not success").select("name")


def batch_report(outcomes: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed, success_rate and, of outcomes (name, success), all
    names that failed. The names are one value; failed_outcomes has them as rows."""
    totals = outcomes.agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("succeeded"))
    names = failed_outcomes(outcomes).agg(F.sort_array(F.collect_list("name")).alias("failed_names"))
    return totals.withColumn("failed", F.col("total") - F.col("succeeded")).withColumn("success_rate", F.col("succeeded") / F.greatest(F.lit(1), F.col("total"))).crossJoin(F.broadcast(names))
