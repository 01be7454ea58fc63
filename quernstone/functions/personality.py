"""Voices for text by rules, repair of unfinished text, and checks of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import hits, safe, sentences, strip

# Rewrites of each voice, and signs of unfinished text.
CASUAL = ((r"(?i)\bdo not\b", "don't"), (r"(?i)\bcannot\b", "can't"), (r"(?i)\bwill not\b", "won't"))
CASUAL_STRONG = ((r"\bHello\b", "Hey"), (r"\bThank you\b", "Thanks"))
FORMAL = ((r"(?i)\bdon't\b", "do not"), (r"(?i)\bcan't\b", "cannot"), (r"(?i)\bwon't\b", "will not"))
FORMAL_STRONG = ((r"\bHey\b", "Hello"), (r"\bThanks\b", "Thank you"))
FRIENDLY_STRONG = ((r"\bThis is\b", "This is really"), (r"\bYou can\b", "You can definitely"))
PLACEHOLDERS = (r"\[.*?\]", r"<.*?>", r"\{.*?\}", r"PLACEHOLDER", r"TODO", r"FIXME", r"SYMBOLIC MEANING HERE", r"INSERT.*HERE", r"REPLACE.*WITH")
UNFINISHED = (r"\.\.\.+$", r"\d+\.\s*$", r"^[A-Z]\.\s*$", r"continued\.\.\.", r"more\.\.\.", r"etc\.\s*$")
FORMAL_WORDS, CASUAL_WORDS = ("therefore", "furthermore", "consequently", "thus"), ("really", "pretty", "kind of", "sort of")
DEPTH_WORDS = ("symbol", "represent", "meaning", "significance", "archetype", "tradition", "spiritual", "mystical", "esoteric", "divine", "transformation", "journey", "wisdom", "enlightenment")
PROFILES = ("professional", "casual", "technical", "educational", "friendly", "formal")
STRENGTHS = ((0.3, "subtle"), (0.7, "moderate"), (1.01, "strong"))


def _chain(text: Column, steps) -> Column:
    for pattern, into in steps:
        text = F.regexp_replace(text, pattern, into)
    return text


def resolve_name(name: Column) -> Column:
    """A voice's name without the prefix of custom ones; professional if there is none."""
    bare = strip(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"^custom:\s*", ""))
    return F.when(bare == "", "professional").otherwise(bare)


def rewrite(text: Column, voice: Column, strength: float = 0.5) -> Column:
    """The text in a casual, formal (or professional) or friendly voice, by which of these
    the voice's name contains; other voices leave it."""
    text, voice, strong = safe(text), F.lower(F.coalesce(voice, F.lit(""))), strength > 0.5
    friendly = text
    if strong:
        friendly = _chain(F.when(F.rlike(text, F.lit(r"[.!?]\z")), text).otherwise(F.concat(text, F.lit("!"))), FRIENDLY_STRONG)
    return (
        F.when(F.contains(voice, F.lit("casual")), _chain(text, CASUAL + CASUAL_STRONG * strong))
        .when(F.contains(voice, F.lit("formal")) | F.contains(voice, F.lit("professional")), _chain(text, FORMAL + FORMAL_STRONG * strong))
        .when(F.contains(voice, F.lit("friendly")), friendly)
        .otherwise(text)
    )


def literal_rewrite(text: Column, voice: Column) -> Column:
    """The fallback of literal replacements: casual and formal contractions, a greeting for
    friendly, a lead for technical."""
    text = safe(text)
    swap = lambda pairs: _literal(text, pairs)
    contractions = (("do not", "don't"), ("cannot", "can't"), ("It is", "It's"), ("You are", "You're"))
    return (
        F.when(voice == "casual", swap(contractions))
        .when(voice == "formal", swap(tuple((b, a) for a, b in contractions)))
        .when(voice == "friendly", F.concat(F.lit("Hey there! "), text, F.lit(" Hope this helps!")))
        .when(voice == "technical", F.concat(F.lit("Technical analysis: "), text))
        .otherwise(text)
    )


def _literal(text: Column, pairs) -> Column:
    for before, after in pairs:
        text = F.replace(text, F.lit(before), F.lit(after))
    return text


def has_placeholder(text: Column) -> Column:
    out = F.lit(False)
    for pattern in PLACEHOLDERS:
        out = out | F.rlike(safe(text), F.lit("(?i)" + pattern))
    return out


def is_complete(text: Column) -> Column:
    """No sign of being cut off, a hundred characters, two sentences of over ten."""
    cut = F.lit(False)
    for pattern in UNFINISHED:
        cut = cut | F.rlike(safe(text), F.lit("(?i)" + pattern))
    return ~cut & (F.length(strip(text)) >= 100) & (F.size(sentences(text, 11)) >= 2)


def is_consistent(text: Column) -> Column:
    """Not both formal and casual words."""
    low = F.lower(safe(text))
    return ~((hits(low, FORMAL_WORDS) > 0) & (hits(low, CASUAL_WORDS) > 0))


def is_deep(text: Column) -> Column:
    return hits(F.lower(safe(text)), DEPTH_WORDS) >= 5


def weakness_report(text: Column, compliant: Column) -> Column:
    """Struct of five checks and overall, their mean."""
    checks = {"no_placeholders": ~has_placeholder(text), "complete": is_complete(text), "consistent": is_consistent(text), "deep": is_deep(text), "compliant": compliant}
    return F.struct(*(c.alias(k) for k, c in checks.items()), (sum(c.cast("int") for c in checks.values()) / F.lit(len(checks))).alias("overall"))


def fill_placeholders(text: Column, filler: str) -> Column:
    """The text with each placeholder replaced by the filler."""
    return _chain(safe(text), tuple(("(?i)" + p, filler) for p in PLACEHOLDERS))


def finish(text: Column, expansion: str, least: int = 200) -> Column:
    """The text without signs of being cut off, expanded if it is shorter than least."""
    bare = _chain(safe(text), tuple(("(?i)" + p, "") for p in UNFINISHED))
    return strip(F.when(F.length(strip(bare)) < least, F.concat(bare, F.lit("\n\n" + expansion))).otherwise(bare))


def repair_format(text: Column, target: str) -> Column:
    """Missing marks of qwen, alpaca or chatml put in, truncation marks out, and a full stop
    at the end."""
    bare = strip(F.regexp_replace(safe(text), r"\[truncated\]|\.{3,}\s*\z", ""))
    ended = F.when(F.rlike(bare, F.lit(r"[.!?>}\]\"]\z")), bare).otherwise(F.concat(bare, F.lit(".")))
    marks = {"qwen": ("<|user|>\nPlease explain this information:\n<|assistant|>\n", "<|assistant|>", ""), "alpaca": ("### Instruction:\nPlease explain this information:\n\n### Response:\n", "### Response:", ""), "chatml": ("<|im_start|>assistant\n", "<|im_start|>", "\n<|im_end|>")}
    if target not in marks:
        return ended
    lead, mark, end = marks[target]
    return F.when(F.contains(ended, F.lit(mark)), ended).otherwise(F.concat(F.lit(lead), ended, F.lit(end)))


def strength_name(strength: float) -> str:
    return next(name for limit, name in STRENGTHS if strength < limit)


def voice_prompt(text: Column, description: str, strength: float = 0.5) -> Column:
    """The prompt that asks a model for a text in a voice."""
    return F.concat(F.lit(f"Rewrite the text below in this voice, with {strength_name(strength)} changes. Keep all facts.\nVoice: {description}\nText:\n"), safe(text))


# Descriptions of the voices that come with the engine.
VOICES = {
    "neutral": "Maintain neutral, balanced tone without adding personality",
    "casual": "Casual, friendly language with modern expressions",
    "professional": "Professional but approachable business communication",
    "technical": "Precise technical language with detailed explanations",
    "creative": "Imaginative language with metaphors and storytelling",
    "friendly": "Warm, encouraging, and supportive tone",
    "humorous": "Light-hearted with appropriate humor and wit",
    "educational": "Clear explanations with step-by-step guidance",
    "conversational": "Natural dialogue-like language as if speaking with a friend",
    "formal": "Professional but approachable business communication",
}


def with_description(rows: DataFrame, custom: DataFrame, voice_col: str = "voice") -> DataFrame:
    """rows with voice_description: that of the custom voice of this name (name,
    description), else the name itself if it is over twenty characters, else that of the
    built-in voice, else the name."""
    named = custom.select(F.col("name").alias("_name"), F.col("description").alias("_description")).dropDuplicates(["_name"])
    known = F.create_map(*[F.lit(x) for kv in VOICES.items() for x in kv])
    voice = F.col(voice_col)
    joined = rows.join(named, voice == F.col("_name"), "left")
    described = F.coalesce("_description", F.when(F.length(voice) > 20, voice), F.try_element_at(known, F.lower(voice)), voice)
    return joined.withColumn("voice_description", described).drop("_name", "_description")
