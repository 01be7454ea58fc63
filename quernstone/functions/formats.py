"""Conversations as text: renderers, parsers, detection and target protocols.

A conversation is an array of structs (role, content) in order of its turns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.text import safe, strip

SEGMENTS = "array<struct<role:string,content:string>>"
DEFAULT_SYSTEM = "You are a helpful assistant."
FORMATS = ("qwen", "alpaca", "chatml", "sharegpt", "llama2", "zephyr", "instruct", "openai", "claude", "minimalist")

# Output format and required markers of each training target.
PROTOCOLS = {
    "qwen": ("qwen", ".txt", ("<|user|>", "<|assistant|>")),
    "llama2": ("llama2", ".jsonl", ("[INST]", "[/INST]")),
    "alpaca": ("alpaca", ".txt", ("### Instruction:", "### Response:")),
    "chatml": ("chatml", ".jsonl", ("<|im_start|>", "<|im_end|>")),
    "sharegpt": ("sharegpt", ".jsonl", ("human", "gpt")),
    "openai": ("gpt_jsonl", ".jsonl", ('"messages"', '"role": "user"', '"role": "assistant"')),
    "gpt_jsonl": ("gpt_jsonl", ".jsonl", ('"messages"', '"role": "user"', '"role": "assistant"')),
    "instruct": ("instruct", ".txt", ("Question:", "Answer:")),
    "claude": ("claude", ".txt", ("Human:", "Assistant:")),
    "zephyr": ("zephyr", ".txt", ("- role: user", "- role: assistant")),
    "minimalist": ("minimalist", ".txt", ("User:", "Assistant:")),
    "mistral": ("chatml", ".jsonl", ("<|im_start|>", "<|im_end|>")),
    "gemma": ("alpaca", ".txt", ("### Instruction:", "### Response:")),
}


def turns(role: Column, content: Column, order: Column) -> Column:
    """Aggregate: the segments of a conversation in order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("at"), role.alias("role"), content.alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))


def pairs(segments: Column) -> Column:
    """Structs (user, assistant): each answer with the last question before it that is
    still open. A later question replaces an open one; other roles don't count."""
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<struct<user:string,assistant:string>>").alias("done"))

    def step(state, x):
        answers = (x["role"] == "assistant") & (F.coalesce(state["open"], F.lit("")) != "")
        opened = F.when(x["role"] == "user", x["content"]).when(answers, F.lit(None)).otherwise(state["open"])
        done = F.when(answers, F.concat(state["done"], F.array(F.struct(state["open"].alias("user"), x["content"].alias("assistant"))))).otherwise(state["done"])
        return F.struct(opened.alias("open"), done.alias("done"))

    return F.aggregate(segments, start, step, lambda s: s["done"])


def _lines(segments: Column, line, separator: str) -> Column:
    return F.array_join(F.transform(segments, line), separator)


def _json_messages(segments: Column) -> Column:
    return F.to_json(segments)


def render(segments: Column, target: str, system: str = DEFAULT_SYSTEM, dialect: str = "role") -> Column:
    """A conversation in one of FORMATS. JSON comes without line breaks; sharegpt's dialect
    is role (role, content) or from (human or gpt, value)."""
    both = pairs(segments)
    say = lambda x, human, other: F.concat(F.when(x["role"] == "user", human).otherwise(other), F.lit(": "), x["content"])
    if target == "qwen":
        return _lines(segments, lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|> "), x["content"]), "\n\n")
    if target == "alpaca":
        return _lines(both, lambda x: F.concat(F.lit("### Instruction:\n"), x["user"], F.lit("\n\n### Response:\n"), x["assistant"]), "\n\n---\n\n")
    if target == "chatml":
        return _lines(segments, lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["content"], F.lit("\n<|im_end|>")), "\n")
    if target == "sharegpt":
        if dialect == "from":
            named = lambda x: F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"])
            return F.to_json(F.transform(segments, lambda x: F.struct(named(x).alias("from"), x["content"].alias("value"))))
        return _json_messages(segments)
    if target == "llama2":
        return _lines(both, lambda x: F.concat(F.lit("<s>[INST] "), x["user"], F.lit(" [/INST] "), x["assistant"], F.lit(" </s>")), " ")
    if target == "zephyr":
        return _lines(segments, lambda x: F.concat(F.lit("- role: "), x["role"], F.lit("\n  content: "), x["content"]), "\n")
    if target == "instruct":
        return _lines(both, lambda x: F.concat(F.lit("Question: "), x["user"], F.lit("\nAnswer: "), x["assistant"]), "\n\n")
    if target in ("openai", "gpt_jsonl"):
        first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
        messages = F.concat(first, segments)
        return _json_messages(messages) if target == "openai" else F.to_json(F.struct(messages.alias("messages")))
    if target == "claude":
        return _lines(segments, lambda x: say(x, "Human", "Assistant"), "\n\n")
    if target == "minimalist":
        return _lines(segments, lambda x: say(x, "User", "Assistant"), "\n")
    raise ValueError(f"unknown format {target!r}")


def render_single(user: Column, assistant: Column, target: str, system: Column | None = None) -> Column:
    """One question and answer in the writing of the single-turn formatter: tags on lines
    of their own, an optional system message, unknown formats as qwen."""
    message = lambda tag, text, end="": F.concat(F.lit(tag), text, F.lit(end))
    if target == "alpaca":
        return F.concat(F.lit("### Instruction:\n"), user, F.lit("\n\n### Response:\n"), assistant)
    if target == "chatml":
        parts = [("system", system)] * (system is not None) + [("user", user), ("assistant", assistant)]
        return F.concat_ws("\n", *(message(f"<|im_start|>{role}\n", text, "\n<|im_end|>") for role, text in parts))
    if target == "sharegpt":
        entry = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
        return F.to_json(F.array(entry("human", user), entry("gpt", assistant)))
    if target == "llama2":
        return F.concat(F.lit("[INST] "), user, F.lit(" [/INST] "), assistant)
    if target == "instruct":
        return F.concat(F.lit("Question: "), user, F.lit("\n\nAnswer: "), assistant)
    entry = lambda who, text: F.struct(F.lit(who).alias("role"), text.alias("content"))
    if target == "gpt_jsonl":
        first = [entry("system", system)] if system is not None else []
        return F.to_json(F.struct(F.array(*first, entry("user", user), entry("assistant", assistant)).alias("messages")))
    parts = [("<|system|>\n", system)] * (system is not None) + [("<|user|>\n", user), ("<|assistant|>\n", assistant)]
    return F.concat_ws("\n", *(message(tag, text) for tag, text in parts))


def render_multi(both: Column, target: str, system: Column | None = None) -> Column:
    """Pairs (user, assistant) in the multi-turn writing of that formatter."""
    if target == "alpaca":
        turn = lambda x, i: F.concat(F.lit("Turn "), (i + 1).cast("string"), F.lit(" - User: "), x["user"], F.lit("\nTurn "), (i + 1).cast("string"), F.lit(" - Assistant: "), x["assistant"], F.lit("\n"))
        return F.concat(F.lit("### Instruction:\nMulti-turn conversation:\n"), F.array_join(F.transform(both, turn), ""), F.lit("\n\n### Response:\nI understand this multi-turn conversation."))
    if target == "sharegpt":
        entry = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
        return F.to_json(F.flatten(F.transform(both, lambda x: F.array(entry("human", x["user"]), entry("gpt", x["assistant"])))))
    if target in ("qwen", "chatml"):
        body = F.array_join(F.transform(both, lambda x: render_single(x["user"], x["assistant"], target)), "\n")
        tag, end = ("<|system|>\n", "") if target == "qwen" else ("<|im_start|>system\n", "\n<|im_end|>")
        return body if system is None else F.concat(F.lit(tag), system, F.lit(end + "\n"), body)
    return F.array_join(F.transform(both, lambda x: render_single(x["user"], x["assistant"], target, system)), "\n\n")


def _segments(roles: Column, contents: Column) -> Column:
    return F.zip_with(roles, contents, lambda r, c: F.struct(r.alias("role"), c.alias("content")))


def _alternating(first: Column, second: Column) -> Column:
    both = F.zip_with(first, second, lambda u, a: F.array(F.struct(F.lit("user").alias("role"), strip(u).alias("content")), F.struct(F.lit("assistant").alias("role"), strip(a).alias("content"))))
    return F.flatten(both)


def _tagged(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), strip)


def parse(text: Column, source: str) -> Column:
    """Segments of a rendered conversation; roles other than user and assistant are left
    out, and so are empty turns. Null if sharegpt isn't JSON."""
    text = safe(text)
    if source == "qwen":
        roles, contents = _tagged(text, r"(?s)<\|(user|assistant)\|>(.*?)(?=<\|[a-z]+\|>|\z)")
        return F.filter(_segments(roles, contents), lambda x: x["content"] != "")
    if source == "alpaca":
        parts = F.filter(F.transform(F.split(text, "---+"), strip), lambda p: F.rlike(p, F.lit(r"(?s)### Instruction:\s*.+?### Response:\s*.+")))
        ask = F.transform(parts, lambda p: F.regexp_extract(p, r"(?s)### Instruction:\s*(.+?)(?=### Response:|$)", 1))
        tell = F.transform(parts, lambda p: F.regexp_extract(p, r"(?s)### Response:\s*(.+?)\z", 1))
        return _alternating(ask, tell)
    if source == "chatml":
        return _segments(*_tagged(text, r"(?s)<\|im_start\|>(user|assistant)\s*\n(.*?)\n<\|im_end\|>"))
    if source == "llama2":
        pattern = r"(?s)<s>\[INST\]\s*(.*?)\s*\[/INST\]\s*(.*?)\s*</s>"
        return _alternating(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2)))
    if source in ("claude", "minimalist"):
        human = "Human" if source == "claude" else "User"
        pattern = r"(?s)(?:\A|\n\n)(Human|Assistant):\s*(.*?)(?=\n\n(?:Human|Assistant|System):|\z)" if source == "claude" else r"(?m)^\s*(User|Assistant): (.*)$"
        roles, contents = _tagged(text, pattern)
        named = F.transform(roles, lambda r: F.when(r == human, "user").otherwise("assistant"))
        return F.filter(_segments(named, contents), lambda x: x["content"] != "")
    if source == "sharegpt":
        rows = F.from_json(text, "array<struct<role:string,content:string,`from`:string,value:string>>")
        roles = {"user": "user", "human": "user", "assistant": "assistant", "gpt": "assistant"}
        named = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
        found = F.transform(rows, lambda x: F.struct(F.try_element_at(named, F.coalesce(x["role"], x["from"], F.lit(""))).alias("role"), F.coalesce(x["content"], x["value"]).alias("content")))
        return F.filter(found, lambda x: x["role"].isNotNull() & x["content"].isNotNull())
    raise ValueError(f"no parser for {source!r}")


PARSERS = ("qwen", "alpaca", "chatml", "sharegpt", "llama2", "claude", "minimalist")


def detect(text: Column) -> Column:
    """Which format a text is in, from its first thousand characters; for JSON the whole
    text must parse. Null if none fits."""
    head = F.substring(safe(text), 1, 1000)
    has = lambda *marks: _all(head, marks)
    json_like = F.rlike(head, F.lit(r"^\s*[\[{]"))
    return (
        F.when(has("<|user|>") | has("<|assistant|>"), "qwen")
        .when(has("<|im_start|>", "<|im_end|>"), "chatml")
        .when(has("[INST]", "[/INST]"), "llama2")
        .when(has("### Instruction:", "### Response:"), "alpaca")
        .when(has("Human:", "Assistant:"), "claude")
        .when(has("User:", "Assistant:"), "minimalist")
        .when(json_like & F.try_parse_json(safe(text)).isNotNull(), "sharegpt")
    )


def _all(text: Column, marks) -> Column:
    out = F.lit(True)
    for mark in marks:
        out = out & F.contains(text, F.lit(mark))
    return out


def parse_detected(text: Column) -> Column:
    """Segments by the detected format; empty if none is."""
    found = detect(text)
    out = F.lit(None).cast(SEGMENTS)
    for source in PARSERS:
        out = F.when(found == source, parse(text, source)).otherwise(out)
    return F.coalesce(out, F.array().cast(SEGMENTS))


def convert(text: Column, target: str, source: str | None = None, system: str = DEFAULT_SYSTEM) -> Column:
    """Struct of the text in the target format and an error, where nothing was parsed."""
    found = F.coalesce(parse(text, source), F.array().cast(SEGMENTS)) if source else parse_detected(text)
    some = F.size(found) > 0
    return F.struct(F.when(some, render(found, target, system)).alias("text"), F.when(~some, "no segments found").alias("error"))


def protocol(target: str) -> tuple[str, str, tuple[str, ...]]:
    """Format, extension and markers of a training target; unknown ones are as qwen."""
    return PROTOCOLS.get(str(target).lower(), PROTOCOLS["qwen"])


def has_markers(text: Column, target: str) -> Column:
    """Does the text have what the training target needs? Chat JSON must hold messages of
    a user and an assistant; others their markers."""
    kind, _, marks = protocol(target)
    if kind == "gpt_jsonl":
        roles = F.transform(F.from_json(safe(text), "messages array<struct<role:string>>")["messages"], lambda m: m["role"])
        return F.coalesce((F.size(roles) >= 2) & F.array_contains(roles, "user") & F.array_contains(roles, "assistant"), F.lit(False))
    return _all(safe(text), marks)


def format_errors(text: Column, target: str) -> Column:
    """What a text lacks of qwen, alpaca, chatml or sharegpt; empty for others."""
    text = safe(text)
    if target == "sharegpt":
        rows = F.from_json(text, "array<struct<`from`:string,value:string,role:string,content:string>>")
        good = (F.size(rows) > 0) & F.forall(rows, lambda x: (x["from"].isNotNull() & x["value"].isNotNull()) | (x["role"].isNotNull() & x["content"].isNotNull()))
        return F.when(F.coalesce(good, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("invalid JSON conversation")))
    marks = {"qwen": ("<|user|>", "<|assistant|>"), "alpaca": ("### Instruction:", "### Response:"), "chatml": ("<|im_start|>", "<|im_end|>")}.get(target, ())
    if not marks:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(~F.contains(text, F.lit(m)), F.lit(f"Missing {m} delimiter")) for m in marks)))
