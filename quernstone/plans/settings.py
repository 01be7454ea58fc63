"""Settings of the phases and security profiles, with their checks."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.formats import PROTOCOLS
from quernstone.functions.sanitise import entropy, non_ascii_ratio, top_char_share
from quernstone.functions.text import contained, safe


@dataclass(frozen=True)
class SecurityProfile:
    normalise_homoglyphs: bool
    entropy_low: float
    entropy_high: float
    non_ascii_ratio: float
    repetition: float
    advanced_detection: bool
    homoglyph_sensitivity: float
    quarantine_score: float
    rejection_score: float
    retention_days: int


# The four profiles, and the rules of the content filter.
PROFILES = {
    "permissive": SecurityProfile(False, 1.0, 8.0, 0.8, 0.5, False, 0.3, 50.0, 80.0, 30),
    "balanced": SecurityProfile(True, 2.0, 7.0, 0.5, 0.3, True, 0.1, 30.0, 60.0, 90),
    "strict": SecurityProfile(True, 2.5, 6.5, 0.3, 0.2, True, 0.05, 20.0, 40.0, 180),
    "paranoid": SecurityProfile(True, 3.0, 6.0, 0.1, 0.1, True, 0.01, 10.0, 25.0, 365),
}
BLOCKED = (r"<script[^>]*>.*?</script>", r"javascript:", r"eval\s*\(", r"document\.write", r"innerHTML\s*=", r";\s*DROP\s+TABLE", r"UNION\s+SELECT", r"<iframe[^>]*>", r"<object[^>]*>", r"<embed[^>]*>")
SUSPICIOUS = ("eval", "exec", "compile", "import", "__import__", "script", "iframe", "object", "embed", "form", "onclick", "onload", "onerror", "javascript", "vbscript", "data:", "file://", "ftp://", "drop table", "delete from", "union select", "xss", "csrf", "injection", "payload")
ALLOWED_EXTENSIONS = ("txt", "md", "json", "csv", "tsv", "xml", "html", "htm", "yaml", "yml")
BLOCKED_EXTENSIONS = ("exe", "bat", "cmd", "scr", "com", "pif", "vbs", "js", "jar", "app")
MIN_LENGTH, MAX_LENGTH = 10, 1_000_000


def profile_threats(text: Column, profile: SecurityProfile) -> Column:
    """Codes of what a text exceeds of a profile's thresholds."""
    bits = entropy(text)
    return F.array_compact(
        F.array(
            F.when(bits < profile.entropy_low, "low_entropy"),
            F.when(bits > profile.entropy_high, "high_entropy"),
            F.when(non_ascii_ratio(text) > profile.non_ascii_ratio, "non_ascii"),
            F.when(top_char_share(text) > profile.repetition, "repetition"),
        )
    )


def profile_action(score: Column, profile: SecurityProfile) -> Column:
    return F.when(score >= profile.rejection_score, "reject").when(score >= profile.quarantine_score, "quarantine").otherwise("accept")


def rule_violations(text: Column, path: Column | None = None, blocked: tuple[str, ...] = BLOCKED) -> Column:
    """Codes of the content rules: blocked patterns, length, and the file's extension."""
    found = [F.when(F.rlike(safe(text), F.lit("(?is)" + p)), F.lit(f"pattern:{p}")) for p in blocked]
    found += [F.when(F.length(safe(text)) < MIN_LENGTH, "too_short"), F.when(F.length(safe(text)) > MAX_LENGTH, "too_long")]
    if path is not None:
        extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
        found += [F.when(extension.isin(*BLOCKED_EXTENSIONS), "blocked_extension").when(~extension.isin(*ALLOWED_EXTENSIONS), "unknown_extension")]
    return F.array_compact(F.array(*found))


def suspicious_keywords(text: Column) -> Column:
    return contained(F.lower(safe(text)), SUSPICIOUS)


@dataclass(frozen=True)
class Settings:
    """What the four phases do. from_env reads QUERNSTONE_<NAME> variables."""

    min_chars: int = 10
    size_limit: int = 0
    size_strategy: str = "split"
    normal_form: str = "NFKC"
    max_line_ends: int = 2
    target_tokens: int = 500
    max_tokens: int = 800
    min_tokens: int = 40
    training_target: str = "qwen"
    voice: str = "professional"
    voice_strength: float = 0.5
    strict_markers: bool = True
    sample_share: float = 1.0

    def problems(self) -> list[str]:
        """What is wrong with the settings; empty if nothing is."""
        out = [] if self.training_target in PROTOCOLS else ["training_target"]
        out += [] if self.size_strategy in ("split", "truncate", "summarize", "reject") else ["size_strategy"]
        out += [] if self.normal_form in ("NFC", "NFD", "NFKC", "NFKD") else ["normal_form"]
        out += [] if 0 < self.min_tokens <= self.target_tokens <= self.max_tokens else ["tokens"]
        out += [] if 0 < self.sample_share <= 1 else ["sample_share"]
        return out + ([] if 0 <= self.voice_strength <= 1 else ["voice_strength"])

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env, found = dict(os.environ) if env is None else env, {}
        for field in fields(cls):
            value = env.get(f"QUERNSTONE_{field.name.upper()}")
            if value is not None:
                kind = type(field.default)
                found[field.name] = value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
        return replace(cls(), **found)


def migrated(saved: dict) -> dict:
    """Saved chunk settings of before structure-aware chunking: without a target, the
    target is set, and a limit of 150 tokens or less is raised."""
    if "target_tokens" in saved:
        return dict(saved)
    limit = int(saved.get("max_chunk_tokens", 0) or 0)
    return {**saved, "target_tokens": 500, "max_chunk_tokens": limit if limit > 150 else 800}
