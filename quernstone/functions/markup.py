"""Validation of markup and code, as column functions."""

from __future__ import annotations

import ast
import json
import re
import xml.etree.ElementTree as ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.text import contains_any, let, safe, strip

# Names and patterns of risky markup.
TAGS = ("script", "iframe", "object", "embed", "applet", "form", "input", "button", "textarea", "select", "option")
ATTRIBUTES = ("onclick", "onload", "onerror", "onmouseover", "onfocus", "onblur", "onchange", "onsubmit", "href", "src", "action")
URL_SCHEMES = ("javascript:", "data:", "vbscript:", "file://", "ftp://")
INJECTIONS = (r"<script[^>]*>.*?</script>", r"javascript:", r"eval\s*\(", r"setTimeout\s*\(", r"setInterval\s*\(", r"Function\s*\(", r"document\.write", r"innerHTML\s*=", r"outerHTML\s*=")
SQL_INJECTIONS = (r";\s*DROP\s+TABLE", r";\s*DELETE\s+FROM", r"UNION\s+SELECT", r"--\s*", r"/\*.*?\*/")
LANGUAGES = {"python": ("def ", "import ", "print(", "if __name__"), "javascript": ("function ", "var ", "const ", "let ", "console.log"), "sql": ("SELECT ", "FROM ", "WHERE ", "INSERT ", "UPDATE")}
PYTHON_RISKS, SCRIPT_RISKS = ("eval", "exec", "compile", "__import__"), ("eval", "setTimeout", "setInterval", "Function")
MARKUP_SIGNS = ("<", ">", "{", "}", "[", "]", "```", "---")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(safe(text), F.lit(pattern))


def _char(text: Column, mark: str) -> Column:
    return ((F.length(safe(text)) - F.length(F.replace(safe(text), F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def tag_counts(text: Column) -> Column:
    """Map of risky tags to how often they open; only those that do."""
    return F.map_filter(F.create_map(*[x for t in TAGS for x in (F.lit(t), _count(text, rf"(?i)<{t}[^>]*>"))]), lambda _, n: n > 0)


def attribute_counts(text: Column) -> Column:
    return F.map_filter(F.create_map(*[x for a in ATTRIBUTES for x in (F.lit(a), _count(text, rf"(?i){a}\s*="))]), lambda _, n: n > 0)


def injections(text: Column) -> Column:
    """The injection patterns that a text has."""
    return F.array_compact(F.array(*(F.when(F.rlike(safe(text), F.lit("(?is)" + p)), F.lit(p)) for p in INJECTIONS)))


def suspicious_urls(text: Column) -> Column:
    """The risky URL schemes that occur."""
    return F.array_compact(F.array(*(F.when(F.contains(F.lower(safe(text)), F.lit(s)), F.lit(s)) for s in URL_SCHEMES)))


def unbalanced_tags(text: Column) -> Column:
    """Structs (tag, balance) of names that open and close unequally often, by name."""
    opened = F.transform(F.regexp_extract_all(safe(text), F.lit(r"<([a-zA-Z][^\s>]*)[^>]*>"), F.lit(1)), F.lower)
    closed = F.transform(F.regexp_extract_all(safe(text), F.lit(r"</([a-zA-Z][^>]*)>"), F.lit(1)), F.lower)
    times = lambda items, name: F.size(F.filter(items, lambda x: x == name))

    def balances(both):
        names = F.array_distinct(F.concat(both["o"], both["c"]))
        return F.transform(names, lambda t: F.struct(t.alias("tag"), (times(both["o"], t) - times(both["c"], t)).alias("balance")))

    found = let(F.struct(opened.alias("o"), closed.alias("c")), balances)
    return F.sort_array(F.filter(found, lambda s: s["balance"] != 0))


def html_result(text: Column) -> Column:
    tags, attributes, found = tag_counts(text), attribute_counts(text), injections(text)
    return F.struct(
        tags.alias("dangerous_tags"),
        attributes.alias("dangerous_attributes"),
        found.alias("injections"),
        (F.cardinality(tags) + F.cardinality(attributes) + F.size(found)).alias("n_security_issues"),
        _count(text, r"<[a-zA-Z][^>]*>").alias("open_tags"),
        _count(text, r"</[a-zA-Z][^>]*>").alias("close_tags"),
        unbalanced_tags(text).alias("unbalanced_tags"),
        suspicious_urls(text).alias("suspicious_urls"),
    )


def json_issues(text: Column) -> Column:
    """What may be wrong with text that is no JSON: unbalanced braces, brackets or quotes,
    trailing commas, single quotes."""
    return F.array_compact(
        F.array(
            F.when(_char(text, "{") != _char(text, "}"), "unbalanced_braces"),
            F.when(_char(text, "[") != _char(text, "]"), "unbalanced_brackets"),
            F.when(_char(text, '"') % 2 != 0, "unbalanced_quotes"),
            F.when(F.rlike(safe(text), F.lit(r",\s*[}\]]")), "trailing_comma"),
            F.when(F.contains(safe(text), F.lit("'")), "single_quotes"),
        )
    )


def json_result(text: Column) -> Column:
    """Struct is_valid, issues (if it isn't), suspicious (path: pattern of string leaves)."""
    valid = F.try_parse_json(safe(text)).isNotNull()
    return F.struct(valid.alias("is_valid"), F.when(valid, F.array().cast("array<string>")).otherwise(json_issues(text)).alias("issues"), json_suspicions(safe(text)).alias("suspicious"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_suspicions(text: pd.Series) -> pd.Series:
    """Paths of string leaves with an injection pattern; none if the text is no JSON."""
    patterns = [re.compile(p, re.I) for p in INJECTIONS]

    def leaves(value):
        stack = [("", value)]
        while stack:
            path, item = stack.pop()
            if isinstance(item, dict):
                stack += reversed([(f"{path}.{k}" if path else k, v) for k, v in item.items()])
            elif isinstance(item, list):
                stack += reversed([(f"{path}[{k}]", v) for k, v in enumerate(item)])
            elif isinstance(item, str):
                yield path, item

    def found(value: str) -> list[str]:
        try:
            parsed = json.loads(value)
        except (ValueError, RecursionError):
            return []
        return [f"{path}: {p.pattern}" for path, leaf in leaves(parsed) for p in patterns if p.search(leaf)]

    return text.map(found)


@F.pandas_udf(T.StructType([T.StructField("is_valid", T.BooleanType()), T.StructField("root_tag", T.StringType()), T.StructField("n_elements", T.LongType()), T.StructField("max_depth", T.LongType()), T.StructField("suspicious", T.ArrayType(T.StringType()))]))
def xml_result(text: pd.Series) -> pd.DataFrame:
    """Validity, root, size, depth and injections in text or attributes of XML. Document
    type declarations, which can expand without bound, make it invalid."""
    patterns = [re.compile(p, re.I) for p in INJECTIONS]

    def one(value: str | None):
        try:
            if value is None or "<!DOCTYPE" in value.upper() or "<!ENTITY" in value.upper():
                raise ValueError
            root = ElementTree.fromstring(value)
        except (ElementTree.ParseError, ValueError):
            return False, None, None, None, []
        n, deepest, found, stack = 0, 0, [], [(root, 0)]
        while stack:
            item, depth = stack.pop()
            n, deepest = n + 1, max(deepest, depth)
            for part in [item.text or "", *item.attrib.values()]:
                found += [p.pattern for p in patterns if p.search(part)]
            stack += [(child, depth + 1) for child in item]
        return True, root.tag, n, deepest, found

    return pd.DataFrame([one(x) for x in text], columns=["is_valid", "root_tag", "n_elements", "max_depth", "suspicious"])


def markdown_result(text: Column) -> Column:
    """Struct of counts, embedded HTML, links with risky schemes, and unbalanced ticks."""
    text = safe(text)
    urls = F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]\(([^)]+)\)"), F.lit(2))
    return F.struct(
        _count(text, r"(?m)^#{1,6}\s+(.+)$").alias("headers"),
        F.size(urls).alias("links"),
        _count(text, r"(?s)```.*?```").alias("code_blocks"),
        _count(text, r"`[^`]+`").alias("inline_code"),
        _count(text, r"(?s)<[^>]+>.*?</[^>]+>|<[^>]+/>").alias("embedded_html"),
        F.size(F.filter(urls, lambda u: contains_any(F.lower(u), URL_SCHEMES))).alias("suspicious_links"),
        F.array_compact(F.array(F.when(_char(text, "```") % 2 != 0, "unbalanced_code_block"), F.when(_char(text, "`") % 2 != 0, "unbalanced_inline_code"))).alias("errors"),
    )


def code_language(text: Column) -> Column:
    out = F.lit("unknown")
    for language in ("sql", "javascript", "python"):
        out = F.when(contains_any(safe(text), LANGUAGES[language]), language).otherwise(out)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def code_errors(text: pd.Series, language: pd.Series) -> pd.Series:
    """Errors of syntax or brackets. Python is parsed, never run."""

    def brackets(value: str) -> list[str]:
        closes, stack, errors = {")": "(", "]": "[", "}": "{"}, [], []
        for char in value:
            if char in "([{":
                stack.append(char)
            elif char in closes:
                if not stack:
                    errors.append(f"unmatched {char}")
                elif (last := stack.pop()) != closes[char]:
                    errors.append(f"mismatched {last} {char}")
        return errors + [f"unclosed {''.join(stack)}"] * bool(stack)

    def one(value: str | None, kind: str) -> list[str]:
        value = value or ""
        if kind == "python":
            try:
                ast.parse(value)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return ["syntax"]
            return []
        if kind == "javascript":
            return [f"unbalanced {a}{b}" for a, b in ("{}", "()") if value.count(a) != value.count(b)]
        return [] if kind == "sql" else brackets(value)

    return pd.Series([one(t, k) for t, k in zip(text, language, strict=True)])


def code_warnings(text: Column, language: Column) -> Column:
    """Names of risky functions, or SQL injection patterns, by language."""
    named = lambda names: F.array_compact(F.array(*(F.when(F.contains(safe(text), F.lit(n)), F.lit(n)) for n in names)))
    sql = F.array_compact(F.array(*(F.when(F.rlike(safe(text), F.lit("(?i)" + p)), F.lit(p)) for p in SQL_INJECTIONS)))
    return F.when(language == "python", named(PYTHON_RISKS)).when(language == "javascript", named(SCRIPT_RISKS)).when(language == "sql", sql).otherwise(F.array().cast("array<string>"))


def looks_like_markup(text: Column) -> Column:
    return contains_any(safe(text), MARKUP_SIGNS)


def markup_kinds(text: Column) -> Column:
    """Which validators a text should go to: html or xml, json, markdown, code."""
    text = safe(text)
    angled = F.contains(text, F.lit("<")) & F.contains(text, F.lit(">"))
    page = F.contains(F.upper(text), F.lit("<!DOCTYPE")) | F.contains(F.lower(text), F.lit("<html"))
    return F.array_compact(
        F.array(
            F.when(angled & page, "html").when(angled, "xml"),
            F.when(F.rlike(strip(text), F.lit(r"^[{\[]")), "json"),
            F.when(contains_any(text, ("```", "#")), "markdown"),
            F.when(contains_any(text, ("def ", "function ", "SELECT ", "import ")), "code"),
        )
    )
