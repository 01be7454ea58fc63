"""Chunkers of plain text: sentences, facts, tokens, paragraphs, headings, topics, marks.

Greedy packing depends on what was packed before, so it runs in Arrow-batched Python, one
call for each batch of documents; what is row by row stays in the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.text import contained, contains_any, hits, let, safe, sentences, strip, tokens_by_words, words

CHUNK_TOKENS, OVERLAP = 150, 1

# Words that the topic and heading chunkers look for.
TRANSITIONS = ("however", "moreover", "furthermore", "additionally", "meanwhile", "on the other hand", "in contrast", "similarly", "likewise", "first", "second", "third", "finally", "next", "then")
CONCEPTS = ("concept", "principle", "theory", "method", "approach", "technique", "strategy", "process", "system", "framework", "model")
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
QUESTION_MARKS, ANSWER_MARKS = ("Q:", "Question:", "QUESTION:", "?"), ("A:", "Answer:", "ANSWER:", "Response:")
HEADING_STARTS = (("benefit", "advantage", "pro"), "What are the benefits of {}?"), (("how", "method", "process", "step"), "How does {} work?"), (("why", "reason", "cause"), "Why is {} important?"), (("what", "definition", "meaning"), "What is {}?")
PARAGRAPH_STARTS = (("define", "definition", "is", "are"), "What is {}?"), (("how", "process", "method", "step"), "How does {} work?"), (("why", "because", "reason"), "Why is {} important?")
TOPIC_STARTS = (("how", "process", "method"), "How does {} work?"), (("what", "concept", "definition"), "What is {}?"), (("why", "benefit", "advantage"), "Why is {} important?")


def _size(text: str) -> int:
    return int(len(text.split()) * 0.75)


def _sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


def _facts(text: str) -> list[str]:
    return [s for s in _sentences(text) if len(s) > 10]


def _packed(pieces: list[str], room: int, overlap: int = 0) -> list[str]:
    """Pieces in runs of at most room tokens, of one piece at least; the last overlap
    pieces of a run of more open the next."""
    out, at = [], 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + _size(pieces[end]) <= room):
            size += _size(pieces[end])
            end += 1
        out.append(" ".join(pieces[at:end]))
        at = end if end == len(pieces) else max(at + 1, end - overlap)
    return out


def _token_runs(text: str, room: int, overlap: int) -> list[str]:
    """Runs of words of room tokens, each sharing about ten words for each unit of overlap
    with the one before."""
    every, per = text.split(), max(1, int(room / 0.75))
    step = max(1, per - min(overlap * 10, per // 2))
    return [" ".join(every[at : at + per]) for at in range(0, max(1, len(every) - (per - step)), step)] if every else []


def _fitted(pieces: list[str], target: int) -> list[str]:
    """Neighbours joined up to 1.2 of target; what is over 1.5 of it cut by sentence."""
    out, held = [], ""
    for piece in pieces:
        if _size(held) + _size(piece) <= target * 1.2:
            held = f"{held} {piece}".strip()
            continue
        out += [held] if held else []
        large = _size(piece) > target * 1.5
        out += _packed(_sentences(piece), target) if large else []
        held = "" if large else piece
    return out + ([held] if held else [])


MODES = {
    "sentences": lambda t, room, overlap: _packed(_sentences(t), room, overlap),
    "facts": lambda t, room, overlap: _packed(_facts(t), room),
    "tokens": _token_runs,
}


def chunk_arrays(mode: str, room: int = CHUNK_TOKENS, overlap: int = OVERLAP, target: int | None = None):
    """A UDF from text to its chunks in a mode of MODES; with target, fitted to it."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(text: pd.Series) -> pd.Series:
        found = [MODES[mode](t or "", room, overlap) for t in text]
        return pd.Series([_fitted(x, target) if target else x for x in found])

    return run


def chunks(docs: DataFrame, mode: str = "sentences", room: int = CHUNK_TOKENS, overlap: int = OVERLAP, target: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk_no, text, n_tokens, n_words, start (place in the text, -1 if white space
    was changed), has_overlap (its first hundred characters are in the chunk before),
    has_fact."""
    rows = docs.select(id_col, safe(F.col(text_col)).alias("_text"), F.posexplode(chunk_arrays(mode, room, overlap, target)(safe(F.col(text_col)))).alias("chunk_no", "text"))
    before = F.lag("text").over(Window.partitionBy(id_col).orderBy("chunk_no"))
    return rows.select(
        id_col,
        "chunk_no",
        "text",
        tokens_by_words(F.col("text")).alias("n_tokens"),
        F.size(words(F.col("text"))).alias("n_words"),
        (F.position(F.col("text"), F.col("_text")) - 1).alias("start"),
        F.coalesce(F.contains(before, F.substring("text", 1, 100)), F.lit(False)).alias("has_overlap"),
        (F.length("text") > 10).alias("has_fact"),
    )


def chunk_stats(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, total_chunks, mean length and tokens, smallest and largest, chunks with overlap."""
    return found.groupBy(id_col).agg(F.count(F.lit(1)).alias("total_chunks"), F.avg(F.length("text")).alias("average_chunk_length"), F.avg("n_tokens").alias("average_tokens"), F.min("n_tokens").alias("min_tokens"), F.max("n_tokens").alias("max_tokens"), F.count_if("has_overlap").alias("chunks_with_overlap"))


def _asked(subject: Column, where: Column, starts) -> Column:
    """A question about the subject, by the first group of words that where contains."""
    fill = lambda template: F.concat(F.lit(template.partition("{}")[0]), subject, F.lit(template.partition("{}")[2]))
    out = fill("Can you explain {}?")
    for group, template in reversed(starts):
        out = F.when(contains_any(F.lower(where), group), fill(template)).otherwise(out)
    return out


def heading_question(heading: Column) -> Column:
    bare = strip(heading)
    return F.when(F.endswith(bare, F.lit("?")), bare).otherwise(_asked(F.lower(bare), bare, HEADING_STARTS))


def main_topic(sentence: Column) -> Column:
    """Up to three of the first five words that carry meaning."""
    meaning = F.filter(F.slice(words(sentence), 1, 5), lambda w: ~F.lower(w).isin(*STOP_WORDS))
    return F.when(F.size(meaning) > 0, F.array_join(F.slice(meaning, 1, 3), " ")).otherwise(F.substring(sentence, 1, 50))


def paragraph_question(text: Column) -> Column:
    return _asked(main_topic(strip(F.split(text, r"\.")[0])), text, PARAGRAPH_STARTS)


def paragraph_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """id, pos, question, answer: paragraphs of over min_chars, or lines if there is only
    one paragraph, under one and the same question."""
    text = safe(F.col(text_col))
    cut = lambda by: F.filter(F.transform(F.split(text, by), strip), lambda p: p != "")
    parts = F.when(F.size(cut("\n\n")) > 1, cut("\n\n")).otherwise(cut("\n"))
    rows = docs.select(id_col, F.posexplode(F.filter(parts, lambda p: F.length(p) > min_chars)).alias("pos", "answer"))
    return rows.select(id_col, "pos", F.lit("Please explain the following information:").alias("question"), "answer")


def _pack_chars(text: str, most: int) -> list[str]:
    out, held = [], ""
    for sentence in _sentences(text):
        if held and len(held) + len(sentence) > most:
            out, held = [*out, held], sentence
        else:
            held = f"{held} {sentence}".strip()
    return out + ([held] if held else [])


def long_paragraph_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 50, max_chars: int = 500) -> DataFrame:
    """id, pos, question, answer: paragraphs of min_chars at least, packed by sentence where
    they are over max_chars, with a question made from each."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def parts(text: pd.Series) -> pd.Series:
        found = [[p.strip() for p in (t or "").split("\n\n")] for t in text]
        return pd.Series([[c for p in ps if len(p) >= min_chars for c in (_pack_chars(p, max_chars) if len(p) > max_chars else [p])] for ps in found])

    rows = docs.select(id_col, F.posexplode(parts(safe(F.col(text_col)))).alias("pos", "answer"))
    return rows.select(id_col, "pos", paragraph_question(F.col("answer")).alias("question"), "answer")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(id_col, F.posexplode(F.split(safe(F.col(text_col)), "\n")).alias("line_no", "line"))
    return rows.withColumn("line", strip(F.col("line"))).where("line != ''")


def _grouped_lines(lines: DataFrame, id_col: str, starts: Column) -> DataFrame:
    """lines with block, a running count of those that start one."""
    return lines.withColumn("block", F.sum(starts.cast("int")).over(Window.partitionBy(id_col).orderBy("line_no")))


def _joined(at: str, line: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, line))), lambda x: x[line]), " ")


def heading_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, question, answer: the lines under each heading (# marks, numbers, all
    capitals, or a colon at the end), carried forward by a running count."""
    line = F.col("line")
    heading = (
        F.when(F.rlike(line, F.lit(r"^#{1,6}\s+.+$")), F.regexp_replace(line, r"^#{1,6}\s+", ""))
        .when(F.rlike(line, F.lit(r"^\d+\.\s+.+$")), F.regexp_replace(line, r"^\d+\.\s+", ""))
        .when(F.rlike(line, F.lit(r"^[A-Z][A-Z\s]+$")), line)
        .when(F.rlike(line, F.lit(r"^.+:$")), F.regexp_replace(line, ":$", ""))
    )
    rows = _grouped_lines(_lines(docs, id_col, text_col).withColumn("heading", heading), id_col, F.col("heading").isNotNull()).where("block > 0")
    # collect_list leaves nulls out, so the heading's own line isn't part of the text
    body = F.when(F.col("heading").isNull(), line)
    packed = rows.withColumn("body", body).groupBy(id_col, "block").agg(F.max("heading").alias("heading"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("line_no", "body")))), lambda x: x["body"]), " ").alias("answer"))
    return packed.where("answer != ''").select(id_col, (F.col("block") - 1).cast("int").alias("pos"), heading_question(F.col("heading")).alias("question"), "answer")


def marker_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, question, answer: lines under each Q: mark; an A: mark starts the answer
    anew; lines before the first question are left out."""
    line = F.col("line")
    starts = lambda marks: F.rlike(line, F.lit("^(?:" + "|".join(map(re.escape, marks)) + ")\\s*\\S"))
    cut = lambda marks: strip(F.regexp_replace(line, "^(?:" + "|".join(map(re.escape, marks)) + ")", ""))
    kind = F.when(starts(QUESTION_MARKS), "q").when(starts(ANSWER_MARKS), "a").otherwise("t")
    rows = _lines(docs, id_col, text_col).withColumn("kind", kind)
    rows = rows.withColumn("body", F.when(F.col("kind") == "q", cut(QUESTION_MARKS)).when(F.col("kind") == "a", cut(ANSWER_MARKS)).otherwise(line))
    rows = _grouped_lines(rows, id_col, F.col("kind") == "q").where("block > 0")
    anew = F.max(F.when(F.col("kind") == "a", F.col("line_no"))).over(Window.partitionBy(id_col, "block"))
    rows = rows.withColumn("anew", F.coalesce(anew, F.lit(-1))).where((F.col("kind") == "q") | (F.col("line_no") >= F.col("anew")))
    packed = rows.groupBy(id_col, "block").agg(F.max(F.when(F.col("kind") == "q", F.col("body"))).alias("question"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") != "q", F.struct("line_no", "body")))), lambda x: x["body"]), " ").alias("answer"))
    return packed.where("answer != ''").select(id_col, (F.col("block") - 1).cast("int").alias("pos"), "question", "answer")


def topic_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, question, answer: sentences up to the next that contains a transition word."""
    found = F.filter(F.transform(F.split(safe(F.col(text_col)), r"(?<=[.!?])\s+"), strip), lambda s: s != "")
    rows = docs.select(id_col, F.posexplode(found).alias("line_no", "line"))
    turns = contains_any(F.lower(F.col("line")), TRANSITIONS) & (F.col("line_no") > 0)
    rows = _grouped_lines(rows, id_col, turns)
    packed = rows.groupBy(id_col, "block").agg(F.min_by("line", "line_no").alias("first"), _joined("line_no", "line").alias("answer"))
    return packed.select(id_col, F.col("block").cast("int").alias("pos"), _asked(topic(F.col("first")), topic(F.col("first")), TOPIC_STARTS).alias("question"), "answer")


def _has(part: str):
    return lambda word: F.contains(F.lower(word), F.lit(part))


def topic(sentence: Column) -> Column:
    """Two words each side of the first word with a concept in it, else the first six."""
    all_words = words(sentence)
    out = F.array_join(F.slice(all_words, 1, 6), " ")
    for concept in reversed(CONCEPTS):
        at = F.array_position(F.transform(all_words, _has(concept)), True)
        start = F.greatest(F.lit(1), at - 2).cast("int")
        near = F.array_join(F.slice(all_words, start, (at + 2 - start + 1).cast("int")), " ")
        out = F.when(F.contains(F.lower(sentence), F.lit(concept)) & (at > 0), near).otherwise(out)
    return out


STRATEGIES = {"heading": heading_pairs, "paragraph": long_paragraph_pairs, "topic": topic_pairs, "manual": marker_pairs}


def pairs(docs: DataFrame, strategy: str, **options) -> DataFrame:
    """Pairs by one of STRATEGIES."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    return STRATEGIES[strategy](docs, **options)


# Optimised chunks of one subject

PARAMETERS = {"symbolic_interpretation": (150, 400, 800), "esoteric_text": (100, 300, 600), "instructional": (200, 500, 1000), "conversational": (50, 200, 400)}
BREAKS = (
    (0.9, re.compile(r"^[A-Z\s\-]{3,}$|^Chapter \d+|^Book [A-Z]|^Part \d+")),
    (0.8, re.compile(r"Adeptus|Theoricus|Practicus|Philosophus|Neophyte", re.I)),
    (0.7, re.compile(r"^\d+\.|^[A-Z]\.|^[IVX]+\.")),
    (0.9, re.compile(r"---+|===+|\*\*\*+")),
    (0.8, re.compile(r"Opening|Closing|Invocation|Banishing|Consecration", re.I)),
    (0.7, re.compile(r"The (Fool|Magician|High Priestess|Empress|Emperor|Hierophant|Lovers|Chariot|Strength|Hermit|Wheel|Justice|Hanged Man|Death|Temperance|Devil|Tower|Star|Moon|Sun|Judgement|World)", re.I)),
    (0.7, re.compile(r"Kether|Chokmah|Binah|Chesed|Geburah|Tiphareth|Netzach|Hod|Yesod|Malkuth", re.I)),
)
MIN_BREAK = 0.6
SYMBOL_WORDS = ("symbol", "meaning", "represent", "divine", "sacred", "mystical", "spiritual", "archetype", "wisdom", "enlightenment", "transformation")
ELEMENTS = {
    "colors": ("red", "blue", "gold", "silver", "white", "black", "crimson", "emerald"),
    "numbers": ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "twelve"),
    "directions": ("north", "south", "east", "west", "above", "below", "center"),
    "celestial": ("sun", "moon", "star", "planet", "heaven", "sky"),
    "elements": ("fire", "water", "air", "earth", "spirit"),
    "geometric": ("circle", "triangle", "square", "cross", "pentagram", "hexagram"),
}
SUBJECTS = {
    "tarot": ("tarot", "arcana", "card", "divination", "spread"),
    "qabalah": ("sephiroth", "tree of life", "kether", "malkuth", "path"),
    "alchemy": ("transmutation", "prima materia", "philosopher", "stone", "solve"),
    "hermetic": ("hermetic", "golden dawn", "adept", "initiation", "grade"),
    "astrology": ("planet", "zodiac", "house", "aspect", "chart"),
    "mythology": ("myth", "god", "goddess", "hero", "legend"),
}


def _subject_chunks(text: str, least: int, best: int, most: int) -> list[str]:
    one_line = re.sub(r"\s+", " ", text).strip()
    parts, held = [], []
    for line in re.sub(r"([.!?])\s*([A-Z])", r"\1\n\2", one_line).split("\n"):
        if held and next((q for q, p in BREAKS if p.search(line)), 0) > MIN_BREAK:
            parts, held = [*parts, "\n".join(held)], []
        held.append(line)
    parts += ["\n".join(held)] if held and held != [""] else []
    if len(parts) == 1:
        every = one_line.split()
        parts = [" ".join(every[at : at + best]) for at in range(0, len(every), best)]
    out: list[str] = []
    for part in parts:
        n = len(part.split())
        if n < least and out:
            out[-1] += "\n\n" + part
        elif n > most:
            held, size = [], 0
            for sentence in _sentences(part):
                k = len(sentence.split())
                if held and size + k > best:
                    out, held, size = [*out, " ".join(held)], [], 0
                held, size = [*held, sentence], size + k
            out += [" ".join(held)] if held else []
        else:
            out.append(part)
    return out


def adjacent_overlap(text: Column) -> Column:
    """Mean Jaccard overlap of each sentence with the next; one half for fewer than two."""
    return let(F.transform(sentences(text), lambda s: F.array_distinct(words(F.lower(s)))), _adjacent_overlap)


def _adjacent_overlap(sets: Column) -> Column:
    n = F.size(sets)
    ratio = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
    found = F.zip_with(F.slice(sets, 1, F.greatest(n - 1, F.lit(1))), F.slice(sets, 2, F.greatest(n - 1, F.lit(1))), ratio)
    return F.when(n < 2, 0.5).otherwise(F.aggregate(found, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / (n - 1))


def elements(text: Column) -> Column:
    """kind:word of the symbolic words that a text contains."""
    low = F.lower(safe(text))
    named = lambda kind: lambda w: F.concat(F.lit(kind + ":"), w)
    return F.concat(*(F.transform(contained(low, ws), named(kind)) for kind, ws in ELEMENTS.items()))


def subject(text: Column) -> Column:
    """The subject with the most keywords, ties to the first; general without any."""
    low = F.lower(safe(text))
    counts = {k: hits(low, ws) for k, ws in SUBJECTS.items()}
    best = F.greatest(*counts.values())
    out = F.lit("general")
    for name in reversed(SUBJECTS):
        out = F.when((counts[name] == best) & (best > 0), name).otherwise(out)
    return out


def subject_chunks(docs: DataFrame, kind: str = "symbolic_interpretation", id_col: str = "doc_id", text_col: str = "text", keep_all: bool = False) -> DataFrame:
    """id, chunk_no, text, n_words, n_sentences, density, completeness, coherence,
    optimal_size, elements, subject, priority (1 to 10); those that pass three of four
    checks, or all."""
    least, best, most = PARAMETERS.get(kind, PARAMETERS["symbolic_interpretation"])

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(text: pd.Series) -> pd.Series:
        return pd.Series([_subject_chunks(t or "", least, best, most) for t in text])

    rows = docs.select(id_col, F.posexplode(cut(safe(F.col(text_col)))).alias("chunk_no", "text"))
    text, n = F.col("text"), F.size(words(F.col("text")))
    symbolic = F.size(F.filter(words(F.lower(text)), lambda w: w.isin(*SYMBOL_WORDS)))
    whole = (~F.endswith(text, F.lit("..."))).cast("int") + (~F.endswith(text, F.lit("1."))).cast("int") + (~F.rlike(text, F.lit(r"\[.*?\]"))).cast("int") + (F.size(F.split(text, r"[.!?]+")) > 1).cast("int") + (n > 50).cast("int")
    rows = rows.select(id_col, "chunk_no", "text", n.alias("n_words"), F.size(sentences(text)).alias("n_sentences"), F.when(n > 0, symbolic / n).otherwise(0.0).alias("density"), (whole / 5).alias("completeness"), adjacent_overlap(text).alias("coherence"), n.between(150, 800).alias("optimal_size"), elements(text).alias("elements"), subject(text).alias("subject"))
    density, complete = F.col("density"), F.col("completeness")
    priority = 5 + F.when(density > 0.1, 2).when(density > 0.05, 1).otherwise(0) + F.when(complete > 0.8, 1).when(complete < 0.5, -2).otherwise(0) + (F.size("elements") > 5).cast("int") + F.col("optimal_size").cast("int")
    rows = rows.withColumn("priority", F.greatest(F.lit(1), F.least(F.lit(10), priority)))
    passed = (complete >= 0.7).cast("int") + (F.col("n_words") >= 50).cast("int") + (F.col("coherence") >= 0.3).cast("int") + ((F.size("elements") > 0) | (density > 0.02)).cast("int")
    return rows if keep_all else rows.where(passed >= 3)


# Symbolic analysis

SYMBOL_DOMAINS = {
    "hermetic": ("golden dawn", "qabalah", "tree of life", "sephiroth", "hermetic"),
    "tarot": ("major arcana", "minor arcana", "divination", "archetypal"),
    "alchemical": ("transmutation", "prima materia", "philosopher's stone", "solve et coagula"),
    "mythological": ("archetype", "hero's journey", "divine", "sacred"),
    "jungian": ("collective unconscious", "shadow", "anima", "individuation"),
    "esoteric": ("initiation", "mystery", "occult", "gnosis", "enlightenment"),
}
COMPLEXITY = {
    "archaic_language": r"\b(thou|thee|thy|hath|doth|unto|whereof)\b",
    "esoteric_terms": r"\b(gnosis|initiation|adept|mystery|occult|hermetic)\b",
    "symbolic_numbers": r"\b(seven|three|four|twelve|twenty-two)\b",
    "mystical_concepts": r"\b(divine|sacred|holy|eternal|infinite|transcendent)\b",
}


def symbolic_analysis(text: Column) -> Column:
    """Struct: share of each domain's keywords, and counts of complexity patterns; only
    those that occur."""
    low = F.lower(safe(text))
    some = lambda items: F.map_filter(F.create_map(*[x for k, v in items.items() for x in (F.lit(k), v)]), lambda _, v: v > 0)
    return F.struct(some({d: hits(low, ws) / F.lit(len(ws)) for d, ws in SYMBOL_DOMAINS.items()}).alias("domains"), some({k: F.regexp_count(low, F.lit(p)) for k, p in COMPLEXITY.items()}).alias("complexity"))


def interpretation_quality(text: Column, consistent: Column, deep: Column) -> Column:
    """Weighted share of five checks of a written interpretation, 0 to 1."""
    cut = F.lit(False)
    for end in ("...", "1.", "2.", "etc."):
        cut = cut | F.endswith(safe(text), F.lit(end))
    points = (F.length(safe(text)) >= 200).cast("int") * 20 + (~F.rlike(safe(text), F.lit(r"\[.*?\]|<.*?>|\{.*?\}"))).cast("int") * 30 + (~cut).cast("int") * 20 + consistent.cast("int") * 15 + deep.cast("int") * 15
    return points / F.lit(100)
