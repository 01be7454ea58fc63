"""The record contract, payload linting, uniform formatting and dataset sign-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.formats import FORMATS, format_errors, has_markers
from quernstone.functions.normalise import tidy_content
from quernstone.functions.quality import tier

# Fields of the contract in their canonical order, and their domains.
FIELDS = ("id", "format", "content", "quality_score", "accuracy_score", "personality", "source_file", "processing_timestamp", "validation_passed", "tier", "metadata")
DOMAINS = {"format": ("qwen", "alpaca", "chatml", "sharegpt", "llama2"), "personality": ("professional", "casual", "technical", "educational", "friendly"), "tier": ("premium", "standard", "basic", "remediation")}
LENGTHS = {"id": (8, 64), "content": (10, 8192), "source_file": (1, 255)}
RANGES = {"quality_score": (0.0, 100.0), "accuracy_score": (95.0, 100.0)}
PATTERNS = {"id": r"^[a-zA-Z0-9_-]+$", "processing_timestamp": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"}
MIN_ACCURACY = 95.0

SCHEMA = T.StructType(
    [
        *(T.StructField(f, T.StringType()) for f in FIELDS[:3]),
        *(T.StructField(f, T.DoubleType()) for f in FIELDS[3:5]),
        *(T.StructField(f, T.StringType()) for f in FIELDS[5:8]),
        T.StructField("validation_passed", T.BooleanType()),
        T.StructField("tier", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def violations(columns: list[str]) -> Column:
    """Codes field:problem of a record with these columns: missing, too_short, too_long,
    too_small, too_large, bad_pattern, not_allowed."""
    found = [F.when(F.col(f).isNull(), F.lit(f"{f}:missing")) if f in columns else F.lit(f"{f}:missing") for f in FIELDS]
    present = [f for f in FIELDS if f in columns]
    for name in present:
        value = F.col(name)
        if name in LENGTHS:
            least, most = LENGTHS[name]
            found += [F.when(F.length(value) < least, F.lit(f"{name}:too_short")), F.when(F.length(value) > most, F.lit(f"{name}:too_long"))]
        if name in RANGES:
            least, most = RANGES[name]
            found += [F.when(value < least, F.lit(f"{name}:too_small")), F.when(value > most, F.lit(f"{name}:too_large"))]
        if name in PATTERNS:
            found.append(F.when(~F.rlike(value, F.lit(PATTERNS[name])), F.lit(f"{name}:bad_pattern")))
        if name in DOMAINS:
            found.append(F.when(~value.isin(*DOMAINS[name]), F.lit(f"{name}:not_allowed")))
    return F.array_compact(F.array(*found))


def validate(records: DataFrame) -> DataFrame:
    """records with violations and is_valid."""
    return records.withColumn("violations", violations(records.columns)).withColumn("is_valid", F.size("violations") == 0)


def lint(records: DataFrame) -> DataFrame:
    """records in canonical order (other fields after them) with lint, codes of what is
    wrong with their schema and content: missing fields, fields out of order, names that
    aren't snake_case, empty content, metadata that can't be JSON."""
    present = [f for f in FIELDS if f in records.columns]
    schema_issues = [f"missing:{f}" for f in FIELDS if f not in records.columns]
    schema_issues += ["order"] * ([c for c in records.columns if c in FIELDS] != present)
    schema_issues += [f"naming:{c}" for c in records.columns if c != c.lower() or " " in c or "-" in c]
    rows = [F.when(F.col(f).isNull(), F.lit(f"null:{f}")) for f in present]
    if "content" in present:
        rows.append(F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty_content"))
    issues = F.concat(F.array(*map(F.lit, schema_issues)).cast("array<string>"), F.array_compact(F.array(*rows).cast("array<string>")))
    others = [c for c in records.columns if c not in FIELDS]
    return records.select(*present, *others, issues.alias("lint"))


def uniform(records: DataFrame) -> DataFrame:
    """records in canonical order with tidy content, payload (JSON of the fields, in order),
    and is_final: nothing missing, accuracy of 95 at least and the format's markers."""
    tidied = records.withColumn("content", tidy_content(F.col("content"))).select(*FIELDS)
    marked = F.lit(True)
    for name in set(DOMAINS["format"]) & set(FORMATS):
        marked = F.when(F.col("format") == name, has_markers(F.col("content"), name)).otherwise(marked)
    whole = F.lit(True)
    for name in FIELDS:
        whole = whole & F.col(name).isNotNull()
    return tidied.withColumn("is_final", F.coalesce(whole & (F.col("accuracy_score") >= MIN_ACCURACY) & marked, F.lit(False))).withColumn("payload", F.to_json(F.struct(*FIELDS)))


def with_scores(records: DataFrame, quality: Column, accuracy: Column) -> DataFrame:
    """records with both scores and the tier set, before they are validated."""
    return records.withColumn("quality_score", quality).withColumn("accuracy_score", accuracy).withColumn("tier", tier(quality)).withColumn("validation_passed", accuracy >= MIN_ACCURACY)


def sign_off(records: DataFrame) -> DataFrame:
    """One row: records, contract failures, those below 95 per cent accuracy, mean, least
    and largest quality, and whether the set is signed off."""
    totals = validate(records).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(~F.col("is_valid")).alias("contract_failures"),
        F.count_if(F.coalesce(F.col("accuracy_score") < MIN_ACCURACY, F.lit(True))).alias("below_95"),
        F.avg("quality_score").alias("mean_quality"),
        F.min("quality_score").alias("min_quality"),
        F.max("quality_score").alias("max_quality"),
    )
    return totals.withColumn("signed_off", F.coalesce((F.col("contract_failures") == 0) & (F.col("below_95") == 0) & (F.col("mean_quality") >= MIN_ACCURACY), F.lit(False)))


def strict_errors(content: Column, target: str, preservation: Column) -> Column:
    """Struct of errors and score: 15 off for each missing marker, and an error if less
    than 90 per cent of the original's words remain; valid from 95 without errors."""
    structural = format_errors(content, target)
    lost = F.when(preservation < 90, F.array(F.lit("content not preserved"))).otherwise(F.array().cast("array<string>"))
    score = F.greatest(F.lit(0), 100 - 15 * F.size(structural))
    errors = F.concat(structural, lost)
    return F.struct(errors.alias("errors"), score.alias("score"), ((score >= 95) & (F.size(errors) == 0)).alias("is_valid"))


def slot_errors(slots: Column, definitions: dict[str, dict]) -> Column:
    """Errors of the values in a prompt's map of slots, by definitions: required, pattern,
    allowed, max_tokens (a quarter of the characters)."""
    found = []
    for name, d in definitions.items():
        value = F.try_element_at(slots, F.lit(name))
        if d.get("required"):
            found.append(F.when(F.coalesce(value, F.lit("")) == "", F.lit(f"{name}:missing")))
        if "pattern" in d:
            found.append(F.when(~F.rlike(value, F.lit(d["pattern"])), F.lit(f"{name}:bad_pattern")))
        if "allowed" in d:
            found.append(F.when(~value.isin(*d["allowed"]), F.lit(f"{name}:not_allowed")))
        if "max_tokens" in d:
            found.append(F.when(F.floor(F.length(value) / 4) > d["max_tokens"], F.lit(f"{name}:too_long")))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
