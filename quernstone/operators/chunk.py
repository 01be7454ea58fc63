"""Structure-aware chunks: no chunk crosses a section, and labels stay with their text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import safe, tokens_by_ratio
from quernstone.operators.batches import SLICE_BYTES, SLICE_ROWS, slices

TARGET_TOKENS, MAX_TOKENS, MIN_TOKENS = 500, 800, 40
#: What is left for text however long the heading is.
LEAST_ROOM = 100

# Labels that belong to the block after them, and sentence ends.
_LABEL = re.compile(r"(?:Tip\s+\d+|[1-4]\.\s+[A-Z]|Step\s+[0-9A-Za-z]+)")
_SENTENCE = re.compile(r"(?<=[.?!])(?<!\w\.\w.)(?<![A-Z][a-z]\.)\s+")

# What the packing reads of each block, and what it gives for each chunk.
BLOCK = ("text", "document_id", "section_id", "section_path", "parent_section_id", "section_type", "section_order.top", "section_order.sub", "block_id", "page_num")
CHUNK = "document_id string, section_id string, section_path string, parent_section_id string, top int, sub int, n int, source_text string, page_start int, page_end int, quality_flags array<string>, source_block_ids array<string>, has_continuation boolean"
_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
_CHUNK = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split(" ") for f in CHUNK.split(", "))])


def heading_prefix(path: Column) -> Column:
    """Document, Section and Subsection lines of a path's first three parts."""
    parts = F.filter(F.transform(F.split(path, " > "), F.trim), lambda x: x != "")
    named = F.zip_with(F.slice(parts, 1, 3), F.array(F.lit("Document: "), F.lit("Section: "), F.lit("Subsection: ")), lambda p, n: F.when(p.isNotNull(), F.concat(n, p)))
    return F.array_join(F.array_compact(named), "\n")


def embedding(path: Column, text: Column) -> Column:
    """A chunk's text under the lines of its path."""
    return F.trim(F.concat_ws("\n\n", heading_prefix(path), text))


def n_tokens(text: str) -> int:
    return max(1, int(len(text.split()) * 1.33)) if text else 0


def units(blocks: list[tuple[str, str, int]]) -> Iterator[tuple[str, list[str], int]]:
    """Blocks (id, text, page) as (text, ids, page), a label together with the next one."""
    rest = iter(blocks)
    for block_id, text, page in rest:
        follows = next(rest, None) if _is_label(text) else None
        yield (f"{text}\n{follows[1]}", [block_id, follows[0]], page) if follows else (text, [block_id], page)


def _is_label(text: str) -> bool:
    parts = text.split("\n")
    return len(parts) <= 2 and bool(_LABEL.match(parts[0].strip()) or (len(text) < 60 and not text.endswith(".")))


def sentence_groups(text: str, room: int) -> Iterator[tuple[str, bool]]:
    """Sentences packed into room tokens, with whether more follow; each continuation
    begins with the last sentence of the group before, if that had more than one."""
    held: list[str] = []
    total = last = 0
    for sentence in (s.strip() for s in _SENTENCE.split(text) if s.strip()):
        size = n_tokens(sentence)
        if held and total + size > room:
            yield " ".join(held), True
            held, total = (held[-1:], last) if len(held) > 1 else ([], 0)
        held.append(sentence)
        total, last = total + size, size
    if held:
        yield " ".join(held), False


def section_pieces(blocks: list[tuple[str, str, int]], room: int, flags: list[str], min_tokens: int) -> Iterator[tuple[str, list[str], list[int], list[str], bool]]:
    """A section's chunks: (text, block ids, pages, flags, has continuation)."""
    parts = list(units(blocks))
    if not parts:
        return
    whole = "\n\n".join(p[0] for p in parts)
    if min_tokens <= n_tokens(whole) <= room:
        clean = [] if any(f.startswith("is_") for f in flags) else ["clean"]
        yield whole, [b for p in parts for b in p[1]], [p[2] for p in parts], flags + clean + ["complete_subsection"], False
        return
    held: list[tuple[str, list[str], int]] = []

    def flush():
        yield "\n\n".join(p[0] for p in held), [b for p in held for b in p[1]], [p[2] for p in held], [*flags, "clean"], False

    total = 0
    for part in parts:
        size = n_tokens(part[0])
        large = size > room
        if held and (large or total + size > room):
            yield from flush()
            held, total = [], 0
        if large:
            for text, more in sentence_groups(part[0], room):
                yield text, part[1], [part[2]], flags + ["has_continuation"] * more, more
        else:
            held.append(part)
            total += size
    if held:
        yield from flush()


def _packed(rows: Iterator[tuple], max_tokens: int, min_tokens: int) -> Iterator[tuple]:
    """Rows of CHUNK from rows of BLOCK and their number, those of a section one after another."""
    for (document_id, section_id), section in groupby(rows, key=lambda r: r[1:3]):
        section = list(section)
        _, _, _, section_path, parent, kind, top, sub, *_ = section[0]
        path = [p.strip() for p in section_path.split(" > ") if p.strip()]
        prefix = "\n".join(f"{name}: {p}" for name, p in zip(("Document", "Section", "Subsection"), path, strict=False))
        flags = [f"is_{kind}"] if kind in ("toc", "biography", "promotional") else []
        blocks = [(r[8], r[0], r[9]) for r in section]
        for n, (text, ids, pages, own, more) in enumerate(section_pieces(blocks, max(LEAST_ROOM, max_tokens - n_tokens(prefix)), flags, min_tokens)):
            yield document_id, section_id, section_path, parent, top, sub, n, text, min(pages), max(pages), own, ids, more


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _CHUNK.types, strict=True)], schema=_CHUNK)


def chunk_sections(assigned: DataFrame, document_version: str = "1.0", max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS, created_at: str | None = None) -> DataFrame:
    """Chunks of the blocks that structure.assign_sections gives.

    A section that fits is one chunk; else its units are packed in order, and a unit that
    doesn't fit is packed by sentence, one of which each continuation repeats. Packing is
    sequential: the blocks of each section come sorted, in one stream for each task, of
    which a worker holds a section at a time.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for part in slices(batch, 0) for r in zip(*(c.to_pylist() for c in part.columns), strict=True))
        held, size = [], 0
        for row in _packed(rows, max_tokens, min_tokens):
            held.append(row)
            size += len(row[7])
            if size > SLICE_BYTES or len(held) == SLICE_ROWS:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    # the window brings a section's rows together in order; where documents are together already, nothing moves
    content = assigned.where("is_content").select("reading_order_idx", *BLOCK).withColumn("at", F.row_number().over(Window.partitionBy("document_id", "section_id").orderBy("reading_order_idx")))
    packed = content.drop("reading_order_idx").mapInArrow(pack, CHUNK)
    emb = embedding(F.col("section_path"), F.col("source_text"))
    order = Window.partitionBy("document_id").orderBy("top", "sub", "n")
    return packed.select(
        F.concat("section_id", F.format_string("_c%03d", F.col("n") + 1)).alias("chunk_id"),
        "document_id",
        F.lit(document_version).alias("document_version"),
        "section_path",
        "parent_section_id",
        (F.row_number().over(order) - 1).alias("chunk_index"),
        "source_text",
        emb.alias("embedding_text"),
        tokens_by_ratio(emb).alias("token_count"),
        "page_start",
        "page_end",
        "quality_flags",
        "source_block_ids",
        "has_continuation",
        F.lit(created_at).alias("created_at"),
    )


EXPORT = ("document_id", "document_version", "chunk_id", "section_path", "page_start", "page_end", "chunk_index", "parent_section_id", "token_count", "quality_flags", "source_text", "embedding_text", "created_at")


def export_chunks(chunks: DataFrame) -> DataFrame:
    """The thirteen fields that other systems read, in their order."""
    return chunks.select(*EXPORT)


def chat_records(chunks: DataFrame, system_prompt: str = "You are a helpful expert assistant.") -> DataFrame:
    """chunk_id and record, a chat fine-tuning JSON line of system, user and assistant;
    contents lists and promotion are left out."""
    kept = chunks.where(~F.arrays_overlap("quality_flags", F.array(F.lit("is_toc"), F.lit("is_promotional"))))
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    prompt = F.concat(F.lit("Explain the key principles and actionable steps for: "), F.col("section_path"))
    meta = F.struct("chunk_id", "document_id", "section_path", "token_count", "page_start", "page_end")
    messages = F.array(say("system", F.lit(system_prompt)), say("user", prompt), say("assistant", F.col("source_text")))
    return kept.select("chunk_id", F.to_json(F.struct(messages.alias("messages"), meta.alias("metadata"))).alias("record"))


def naive_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1000, overlap: int = 100) -> DataFrame:
    """id, chunk_no, text: windows of size characters that overlap; blank ones left out."""
    step, text = max(1, size - overlap), safe(F.col(text_col))
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    piece = lambda at: F.regexp_replace(F.substring(text, at + 1, F.lit(size)), r"^\s+|\s+$", "")
    # cut before they become rows, each of which would else carry the whole text
    return docs.select(id_col, F.posexplode(F.transform(starts, piece)).alias("chunk_no", "text")).where("text != ''")
