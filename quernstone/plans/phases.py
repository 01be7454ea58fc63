"""The four phases as one chain of DataFrames, and the structured pipeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import formats, personality, quality
from quernstone.functions.normalise import cap, fine_tune_clean
from quernstone.operators import chunk, stats, structure, validate
from quernstone.operators.store import Work
from quernstone.plans.settings import Settings


@dataclass
class Structured:
    """What the structured pipeline gives. Blocks, and of structured() titles, what chunks
    are checked for and units, are tables written once; the rest is read from them."""

    blocks: DataFrame
    cleaned: DataFrame
    sections: DataFrame
    chunks: DataFrame
    issues: DataFrame | None = None
    fates: DataFrame | None = None
    report: DataFrame | None = None


def chunked(docs: DataFrame, id_col: str = "document_id", text_col: str = "text", max_tokens: int = 800, min_tokens: int = 40, document_version: str = "1.0", work: Work | None = None) -> tuple[Structured, DataFrame]:
    """Extract, clean, find sections and chunk; and the titles."""
    work = work or Work(docs.sparkSession, "structured")
    blocks = work.table(structure.plain_text_blocks(docs, id_col, text_col), "blocks", tidy=True)
    cleaned = structure.clean_furniture(blocks)
    titles = work.table(structure.document_titles(cleaned), "titles", tidy=True)
    sections = structure.assign_sections(cleaned, titles)
    return Structured(blocks, cleaned, sections, chunk.chunk_sections(sections, document_version, max_tokens, min_tokens)), titles


def structured(docs: DataFrame, id_col: str = "document_id", text_col: str = "text", target_tokens: int = 500, max_tokens: int = 800, min_tokens: int = 40, document_version: str = "1.0") -> Structured:
    """Extract, clean, find sections, chunk and validate."""
    work = Work(docs.sparkSession, "structured")
    out, titles = chunked(docs, id_col, text_col, max_tokens, min_tokens, document_version, work)
    checked = work.table(validate.checked(out.chunks), "checked", tidy=True)
    units = work.table(validate.expected_units(out.cleaned, titles), "units", tidy=True)
    gaps = validate.numbering_gaps(out.cleaned, titles, units)
    out.issues = validate.chunk_issues(checked).unionByName(validate.coverage_issues(validate.coverage(out.cleaned, titles, checked, units=units), gaps))
    excluded = out.cleaned.where("removal_type is not null").select("document_id", "block_id", F.col("removal_type").alias("reason"))
    out.fates = validate.manifest(out.cleaned, checked, excluded)
    out.report = validate.report(checked, out.issues, out.fates)
    return out


def extract(docs: DataFrame, settings: Settings) -> DataFrame:
    """Phase 1: document_id, part, text, cleaned and within the size limit; short ones go."""
    cleaned = docs.select("document_id", fine_tune_clean(F.col("text"), settings.max_line_ends, settings.normal_form)["text"].alias("text"))
    # a plain filter would be moved before the cleaning, which would then be done twice
    cleaned = cleaned.select("document_id", F.explode_outer(F.filter(F.array("text"), lambda t: F.length(t) >= settings.min_chars)).alias("text")).where("text is not null")
    if not settings.size_limit:
        return cleaned.select("document_id", F.lit(0).alias("part"), "text")
    return cleaned.select("document_id", F.posexplode(cap(F.col("text"), settings.size_limit, settings.size_strategy)).alias("part", "text"))


def split(texts: DataFrame, settings: Settings) -> DataFrame:
    """Phase 2: chunks of the sanitised text, by its structure."""
    named = texts.select(F.when(F.col("part") > 0, F.concat_ws("_part", "document_id", "part")).otherwise(F.col("document_id")).alias("document_id"), "text")
    return chunked(named, max_tokens=settings.max_tokens, min_tokens=settings.min_tokens)[0].chunks


def render(chunks: DataFrame, settings: Settings, prompt: str = "Please explain this information:") -> DataFrame:
    """Phase 3: chunk_id, content, formatted in the target's format; with strict markers,
    only what has them."""
    content = personality.rewrite(F.col("source_text"), F.lit(settings.voice), settings.voice_strength)
    target, _, _ = formats.protocol(settings.training_target)
    single = target in ("qwen", "alpaca", "chatml", "sharegpt", "llama2", "gpt_jsonl", "instruct")
    both = F.array(F.struct(F.lit("user").alias("role"), F.lit(prompt).alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("content").alias("content")))
    rows = chunks.select("document_id", "chunk_id", content.alias("content"))
    text = formats.render_single(F.lit(prompt), F.col("content"), target) if single else formats.render(both, target)
    rows = rows.withColumn("formatted", text)
    if not settings.strict_markers or target == "gpt_jsonl":
        return rows
    # as in extract: a plain filter would have the rewriting done twice
    made = F.explode_outer(F.filter(F.array(F.struct("content", "formatted")), lambda m: formats.has_markers(m["formatted"], settings.training_target)))
    return rows.select("document_id", "chunk_id", made.alias("m")).where("m is not null").select("document_id", "chunk_id", "m.content", "m.formatted")


def assess(rendered: DataFrame, settings: Settings) -> DataFrame:
    """Phase 4: averages, grade and recommendations of the first share of the outputs."""
    sample = rendered if settings.sample_share == 1 else stats.head_sample(rendered, settings.sample_share, F.col("chunk_id"))
    return stats.quality_averages(sample.select(quality.rule_scores(F.col("content")).alias("s")).select("s.*"))


PHASES: tuple[tuple[str, Callable[[DataFrame, Settings], DataFrame]], ...] = (("extract", extract), ("split", split), ("render", render), ("assess", assess))


@dataclass
class Run:
    """Frames by phase, and where a run stopped and why."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    stopped: str | None = None
    problem: str | None = None


def run(docs: DataFrame, settings: Settings | None = None, phases: tuple[str, ...] = tuple(n for n, _ in PHASES), store: Callable[[str, DataFrame], DataFrame] | None = None, abort: Callable[[], bool] = lambda: False) -> Run:
    """The named phases in their order, each over what the one before gives.

    store(name, frame) can write a phase's output and give it back read. A run keeps no
    state between calls: it can be made again. It stops on settings with problems, when
    abort() says so, or at the first phase with no input. What is there is looked up in
    stored frames and before the last phase, as frames that aren't stored are made anew.
    """
    settings, out, frame = settings or Settings(), Run(), docs
    if problems := settings.problems():
        return Run(stopped="settings", problem=", ".join(problems))
    chosen = [(name, phase) for name, phase in PHASES if name in phases]
    inputs, stored = [], False
    for name, phase in chosen:
        if abort():
            out.stopped, out.problem = name, "aborted"
            return out
        inputs.append((name, frame))
        if (stored or name == chosen[-1][0]) and frame.isEmpty():
            out.stopped, out.problem = next(n for n, f in inputs if n == name or f.isEmpty()), "no input"
            first = [n for n, _ in inputs].index(out.stopped)
            out.frames = {n: out.frames[n] for n, _ in inputs[:first]}
            return out
        given = phase(frame, settings)
        frame = store(name, given) if store else given
        stored = frame is not given
        out.frames[name] = frame
    return out
