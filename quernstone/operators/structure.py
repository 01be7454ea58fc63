"""Blocks of documents: scanning, headings, reading order, furniture and sections.

Blocks are rows of document_id, block_id, page_num, bbox (x0, y0, x1, y1), text,
is_heading, heading_level, font_size, is_bold and reading_order_idx; functions need only
the columns that they name.
"""

from __future__ import annotations

import difflib
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.text import contains_any, let, safe, squeeze, strip, words

# What headings, page furniture and special sections look like.
NUMBERED_HEADING = r"(?i)^(Step\s+(?:[0-9]+|One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten)|Chapter\s+[0-9]+)"
PLAIN_HEADING = r"(?i)^(Step\s+[0-9A-Za-z]+|Chapter\s+[0-9]+)"
HEADING_KEYWORDS = ("four tips for goal setting", "tools & resources", "tools and resources", "checklist", "action items", "key takeaways", "summary", "overview", "the destination", "the audience", "content strategy", "execution plan")
TIP = r"^(?:Tip\s+\d+|[1-4]\.\s+[A-Z])"
PAGE_NUMBERS = (r"(?i)^\s*page\s+\d+(\s+of\s+\d+)?\s*$", r"^\s*[-—–~]\s*\d+\s*[-—–~]\s*$", r"^\s*\d+\s*/\s*\d+\s*$", r"^\s*\d{1,4}\s*$")
TAGS = {
    "toc": (r"(?i)\b(table\s+of\s+contents|table\s+of\s+content|contents|index)\b", r"\.{3,}\s*\d+"),
    "biography": (r"(?i)\b(about\s+the\s+author|about\s+us|author\s+bio|biography|who\s+we\s+are|meet\s+the\s+team)\b",),
    "promotional": (r"(?i)\b(subscribe\s+to|visit\s+our\s+website|follow\s+us\s+on|special\s+offer|discount\s+code|call\s+to\s+action|contact\s+us\s+at|for\s+more\s+information\s+visit)\b", r"(?i)https?://[^\s]+|www\.[^\s]+"),
}
SECTION_HEADINGS = (
    r"(?i)^(Step\s+(?:[0-9]+|One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten)(?:\s*[:—–\-]\s*.+)?)$",
    r"(?i)^(Chapter\s+[0-9]+(?:\s*[:—–\-]\s*.+)?)$",
    r"(?i)^(Part\s+[0-9IVX]+(?:\s*[:—–\-]\s*.+)?)$",
    r"(?i)^(Module\s+[0-9]+(?:\s*[:—–\-]\s*.+)?)$",
)
SUBSECTION_HEADINGS = (
    r"(?i)^(Four Tips for Goal Setting|Tools\s*(?:&|and)\s*Resources|Action Items|Checklist|Overview|Key Takeaways|Strategy Blueprint)$",
    r"(?i)^(Define Your Goals|Identify Your Audience|Audience Persona|Choose Your Channels|Content Strategy|Measurement & Analytics)$",
    r"^##\s+(.+)$",
)
TOC_LINE = r"(?i)\.{3,}\s*\d+|\bpage\s+\d+\b|^\s*Step\s+[A-Za-z0-9]+\s*\.{3,}"
# The first four letters of what the patterns match, which are quicker to look at.
SECTION_STARTS, SUBSECTION_STARTS = ("step", "chap", "part", "modu"), ("four", "tool", "acti", "chec", "over", "key ", "stra", "defi", "iden", "audi", "choo", "cont", "meas")
# For each pattern of TAGS, parts of which a match holds one, in lower case.
TAG_PARTS = {"toc": (("content", "index"), ("...",)), "biography": (("about", "author", "biography", "who", "meet"),), "promotional": (("subscribe", "visit", "follow", "special", "discount", "call", "contact", "information"), ("http", "www."))}
BIO_PHRASES = ("about the author", "about us")
SPECIAL = {"toc": ("toc", "Table of Contents"), "biography": ("bio", "About & Biography"), "promotional": ("promo", "Promotional & External Links")}
GLYPH_JUNK = r"[`\^\\\[\]_~]{2,}|[0-9][a-zA-Z]`[V\^\\PSILM]+"
BROKEN_WORDS = r"\b[a-zA-Z]\s+[a-zA-Z]{1,2}\s+[a-zA-Z]\b|\b[a-zA-Z]\s+[a-zA-Z]{2,4}\b"
ODD_SYMBOL = r"[^a-zA-Z0-9\s.,!?:;'\"()/\-–—]"
SIMILAR = 0.88


def _any(text: Column, patterns) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | F.rlike(text, F.lit(pattern))
    return out


def starts(text: Column, beginnings: tuple[str, ...]) -> Column:
    """Does the text begin with one of these four letters, whatever their case? A pattern is
    tried at every place of a text, even one that can match at its start only."""
    return F.lower(F.substring(text, 1, 4)).isin(*beginnings)


def lines(text: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(safe(text), "\n"), strip), lambda x: x != "")


def plain_text_blocks(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """Blocks of plain text or Markdown: paragraphs between blank lines, in order. Lines
    that start with # are headings of that level, 3 at most; Step x and Chapter n of
    level 1. Places on a page are made up, 50 units for each block."""
    parts = F.filter(F.transform(F.split(safe(F.col(text_col)), "\n\n"), strip), lambda x: x != "")
    rows = docs.select(F.col(id_col).alias("document_id"), F.posexplode(parts).alias("reading_order_idx", "text"))
    hashes = F.length(F.regexp_extract("text", r"^#+", 0))
    level = F.when(F.startswith("text", F.lit("#")), F.least(hashes, F.lit(3))).when(starts(F.col("text"), ("step", "chap")) & F.rlike("text", F.lit(PLAIN_HEADING)), 1).otherwise(0)
    rows = rows.withColumn("_level", level)
    level = F.col("_level")
    top = F.col("reading_order_idx") * 50.0
    return rows.select(
        "document_id",
        F.format_string("txt_b%03d", "reading_order_idx").alias("block_id"),
        F.lit(1).alias("page_num"),
        F.struct(F.lit(0.0).alias("x0"), top.alias("y0"), F.lit(600.0).alias("x1"), (top + 50.0).alias("y1")).alias("bbox"),
        "text",
        F.when(level > 0, "heading").otherwise("paragraph").alias("block_type"),
        F.when(level > 0, 16.0).otherwise(12.0).alias("font_size"),
        (level > 0).alias("is_bold"),
        (level > 0).alias("is_heading"),
        level.alias("heading_level"),
        "reading_order_idx",
    )


def median_font_size(spans: DataFrame) -> DataFrame:
    """document_id and median_font: the upper median of the sizes of spans with text."""
    sizes = F.sort_array(F.collect_list("font_size"))
    found = spans.where(strip(F.col("text")) != "").groupBy("document_id").agg(sizes.alias("sizes"))
    return found.select("document_id", F.col("sizes")[(F.size("sizes") / 2).cast("int")].alias("median_font"))


def classify_heading(text: Column, font: Column, median: Column, bold: Column) -> Column:
    """Level of a heading by wording and font: 1 or 2; 0 for none."""
    n, first, low, size = F.size(lines(text)), F.coalesce(F.get(lines(text), F.lit(0)), F.lit("")), F.lower(strip(text)), F.length(text)
    keyword = F.lit(False)
    for word in HEADING_KEYWORDS:
        keyword = keyword | F.contains(low, F.lit(word))
    return (
        F.when((n == 0) | (n > 4), 0)
        .when(F.rlike(first, F.lit(NUMBERED_HEADING)), 1)
        .when(keyword & (F.length(low) < 80), 2)
        .when(F.rlike(first, F.lit(TIP)) & (size < 100), 2)
        .when((font >= median * 1.25) & (size < 120), 1)
        .when(((font >= median * 1.10) | bold) & (size < 100) & ~F.endswith(text, F.lit(".")), 2)
        .otherwise(0)
    )


def reading_order(blocks: DataFrame, page_width: float = 612.0) -> DataFrame:
    """blocks with reading_order_idx within their page: spanning blocks, left column, right
    column where a page has two of each; otherwise top to bottom in bands of five units,
    then left to right."""
    page = Window.partitionBy("document_id", "page_num")
    box, middle = F.col("bbox"), page_width / 2
    side = F.when(box["x1"] - box["x0"] > page_width * 0.7, 0).when(box["x1"] <= middle + 20, 1).when(box["x0"] >= middle - 20, 2).otherwise(0)
    rows = blocks.withColumn("_side", side)
    two = (F.sum((F.col("_side") == 1).cast("int")).over(page) >= 2) & (F.sum((F.col("_side") == 2).cast("int")).over(page) >= 2)
    rows = rows.withColumn("_two", two)
    order = [F.when(F.col("_two"), F.col("_side")).otherwise(0), F.when(F.col("_two"), box["y0"]).otherwise(F.bround(box["y0"] / 5) * 5), box["x0"], F.col("block_id")]
    return rows.withColumn("reading_order_idx", F.row_number().over(page.orderBy(*order)) - 1).drop("_side", "_two")


def garbled_reason(text: Column) -> Column:
    """Why text looks broken by extraction; null if it doesn't. The first reason counts."""
    bare = strip(text)
    size, n_words = F.length(bare), F.size(words(bare))
    controls = F.regexp_count(bare, F.lit(r"[[^\x20-\x7E]&&[\p{C}&&[^\n\r\t]]]"))
    # the commonest characters first and one by one, which are looked up in a table; ranges are asked in turn
    symbols = F.regexp_count(bare, F.lit(f"[[^{string.ascii_letters}{string.digits} .,]&&{ODD_SYMBOL}]")) / size
    return (
        F.when(size < 4, F.lit(None))
        .when(F.rlike(bare, F.lit(GLYPH_JUNK)), "unmapped_glyph_sequence")
        .when(controls > 0, F.concat(F.lit("contains_"), controls.cast("string"), F.lit("_control_chars")))
        .when((n_words > 3) & (F.regexp_count(bare, F.lit(BROKEN_WORDS)) >= F.greatest(F.lit(2), F.floor(n_words / 3))), "excessive_broken_word_spacing")
        .when((size > 15) & (symbols > 0.35), F.concat(F.lit("high_symbol_ratio_"), F.format_string("%.2f", symbols)))
    )


def is_page_number(text: Column) -> Column:
    """Is a block nothing but a page number?"""
    bare = strip(text)
    return (F.length(bare) < 20) & _any(bare, PAGE_NUMBERS)


def tags(text: Column) -> Column:
    """Which of toc, biography and promotional a block looks like."""
    def found(low: Column, tag: str) -> Column:
        out = F.lit(False)
        for parts, pattern in zip(TAG_PARTS[tag], TAGS[tag], strict=True):
            out = out | (contains_any(low, parts) & F.rlike(safe(text), F.lit(pattern)))
        return out

    return let(F.lower(safe(text)), lambda low: F.array_compact(F.array(*(F.when(found(low, tag), F.lit(tag)) for tag in TAGS))))


def repeated_furniture(blocks: DataFrame, margin: float = 0.15) -> DataFrame:
    """document_id, zone (header or footer) and furniture: normalised texts in the top or
    bottom of the page on two pages at least. The page's height is the largest y1 of the
    document, 800 at least; documents of one page have none."""
    heights = blocks.groupBy("document_id").agg(F.greatest(F.lit(800.0), F.max("bbox.y1")).alias("height"), F.count_distinct("page_num").alias("pages"))
    rows = blocks.join(heights.where("pages > 1"), "document_id").withColumn("furniture", squeeze(F.lower(F.col("text"))))
    zone = F.when(F.col("bbox.y0") <= F.col("height") * margin, "header").when(F.col("bbox.y1") >= F.col("height") * (1 - margin), "footer")
    found = rows.where(F.length("furniture") >= 3).withColumn("zone", zone).where("zone is not null")
    return found.groupBy("document_id", "zone", "furniture").agg(F.count_distinct("page_num").alias("n_pages")).where("n_pages >= 2").drop("n_pages")


@F.pandas_udf(T.BooleanType())
def resembles(text: pd.Series, furniture: pd.Series) -> pd.Series:
    """Is the text like any of the furniture by the ratio of matching blocks? Lengths
    rule most pairs out before that."""

    def like(a: str, known) -> bool:
        for b in [] if known is None else known:
            if len(b) >= 6 and 2 * min(len(a), len(b)) >= SIMILAR * (len(a) + len(b)) and difflib.SequenceMatcher(None, a, b).ratio() >= SIMILAR:
                return True
        return False

    return pd.Series([like(t or "", f) for t, f in zip(text, furniture, strict=True)])


def _matches(norm: Column, furniture: Column) -> Column:
    """Exactly, as a part either way of furniture of six characters or more, or nearly."""
    near = F.exists(furniture, lambda f: (f == norm) | ((F.length(f) >= 6) & (norm != "") & (F.contains(norm, f) | F.contains(f, norm))))
    return near | resembles(norm, furniture)


def clean_furniture(blocks: DataFrame, margin: float = 0.15, extra_headers: tuple[str, ...] = ()) -> DataFrame:
    """blocks with removal_type (null for those that stay), clean_text, stripped_line
    (furniture cut from the top of a block that stays) and tags.

    In order: empty_block, page_number, running_header, running_footer. extra_headers
    count as repeated in documents of more than one page.
    """
    none = F.array().cast("array<string>")
    if blocks.groupBy("document_id").agg(F.min("page_num").alias("least"), F.max("page_num").alias("most")).where("least < most").isEmpty():
        # nothing can repeat: no furniture to look for
        bare = strip(F.col("text"))
        removal = F.when(bare == "", "empty_block").when(is_page_number(F.col("text")), "page_number")
        rows = blocks.withColumn("removal_type", removal).withColumn("clean_text", bare).withColumn("stripped_line", F.lit(None).cast("string"))
        return rows.withColumn("tags", F.when(F.col("removal_type").isNull(), tags(F.col("clean_text"))).otherwise(none))
    found = repeated_furniture(blocks, margin).groupBy("document_id").pivot("zone", ["header", "footer"]).agg(F.sort_array(F.collect_set("furniture")))
    pages = blocks.groupBy("document_id").agg(F.count_distinct("page_num").alias("_pages"))
    extra = F.when(F.col("_pages") > 1, F.array(*map(F.lit, extra_headers)).cast("array<string>")).otherwise(none)
    known = pages.join(found, "document_id", "left").select("document_id", F.concat(F.coalesce("header", none), extra).alias("_headers"), F.coalesce("footer", none).alias("_footers"))
    rows = blocks.join(known, "document_id").withColumn("_norm", squeeze(F.lower(F.col("text"))))
    removal = (
        F.when(F.col("_norm") == "", "empty_block")
        .when(is_page_number(F.col("text")), "page_number")
        .when(F.col("_in_headers"), "running_header")
        .when(F.col("_in_footers"), "running_footer")
    )
    rows = rows.withColumn("_in_headers", _matches(F.col("_norm"), F.col("_headers"))).withColumn("_in_footers", _matches(F.col("_norm"), F.col("_footers")))
    rows = rows.withColumn("removal_type", removal).withColumn("_first", squeeze(F.lower(F.regexp_extract(strip(F.col("text")), r"^([^\n]*)\n", 1))))
    both = F.array_union("_headers", "_footers")
    inline = F.col("removal_type").isNull() & (F.col("_first") != "") & (F.exists(both, lambda f: (F.length(f) >= 6) & F.contains(F.col("_first"), f)) | resembles(F.col("_first"), both))
    rows = rows.withColumn("_inline", inline)
    clean = F.when(F.col("_inline"), strip(F.regexp_replace(strip(F.col("text")), r"^[^\n]*\n", ""))).otherwise(strip(F.col("text")))
    rows = rows.withColumn("clean_text", clean).withColumn("stripped_line", F.when(F.col("_inline"), F.regexp_extract(strip(F.col("text")), r"^([^\n]*)\n", 1)))
    return rows.withColumn("tags", F.when(F.col("removal_type").isNull(), tags(F.col("clean_text"))).otherwise(none)).drop("_headers", "_footers", "_norm", "_first", "_inline", "_in_headers", "_in_footers")


def furniture_audit(cleaned: DataFrame) -> DataFrame:
    """What clean_furniture took away: document_id, page_num, block_id, removal_type,
    removed_text, reason."""
    reason = F.when(F.col("removal_type") == "empty_block", "Empty text block").when(F.col("removal_type") == "page_number", F.concat(F.lit("Standalone page number on page "), F.col("page_num").cast("string"))).otherwise(F.concat_ws(" ", F.lit("Repeated"), F.replace("removal_type", F.lit("_"), F.lit(" "))))
    whole = cleaned.where("removal_type is not null").select("document_id", "page_num", "block_id", "removal_type", strip(F.col("text")).alias("removed_text"), reason.alias("reason"))
    inline = cleaned.where("stripped_line is not null").select("document_id", "page_num", "block_id", F.lit("running_header").alias("removal_type"), F.col("stripped_line").alias("removed_text"), F.lit("Repeated line at the top of a block").alias("reason"))
    return whole.unionByName(inline)


def clean_title(title: Column) -> Column:
    return F.regexp_replace(squeeze(title), r"^#+\s*", "")


def title_from_id(document_id: Column) -> Column:
    """A readable name from a file's: leading number off, words in title case."""
    name = F.translate(F.regexp_replace(document_id, r"^\d+[\-_]?", ""), "-_", "  ")
    return F.when(strip(name) == "", "Document").otherwise(F.initcap(name))


def document_titles(blocks: DataFrame, text_col: str = "text") -> DataFrame:
    """document_id, title: of the first five blocks, the first on page 1 that is a heading
    or large, of 6 to 99 characters, opens no section and has no body text of 80 or more
    characters after it on the page; else the name from the id."""
    order = Window.partitionBy("document_id").orderBy("reading_order_idx")
    body = (F.col("page_num") == 1) & ~F.col("is_heading") & (F.length(strip(F.col(text_col))) >= 80)
    first = strip(F.substring_index(F.col(text_col), "\n", 1))
    # narrow rows; what follows is all less what came, as a frame that ends open is summed anew for each row
    rows = blocks.select("document_id", "reading_order_idx", F.when(F.length(first).between(6, 99), first).alias("first"), body.cast("int").alias("body"), ((F.col("page_num") == 1) & (F.col("is_heading") | (F.col("font_size") > 14))).alias("large"))
    later = F.coalesce(F.sum("body").over(Window.partitionBy("document_id")), F.lit(0)) - F.coalesce(F.sum("body").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = rows.select("document_id", "reading_order_idx", "first", "large", F.row_number().over(order).alias("n"), later.alias("later"))
    fits = F.col("large") & (F.col("n") <= 5) & F.length("first").between(6, 99) & (F.col("later") == 0) & ~_any(F.col("first"), SECTION_HEADINGS + SUBSECTION_HEADINGS)
    return rows.groupBy("document_id").agg(F.min_by(F.when(fits, F.col("first")), F.when(fits, F.col("reading_order_idx"))).alias("title")).select("document_id", F.coalesce("title", title_from_id(F.col("document_id"))).alias("title"))


def assign_sections(blocks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Blocks with their section: document_id, reading_order_idx, block_id, text (the body
    of a heading block, as <block>_body), page_num, section_id, parent_section_id,
    section_path, section_title, section_type, level, is_content (false for a heading
    with no body) and section_order, by which sections of a document sort.

    Contents lists, biographies and promotion go to a section of their own each. Others
    follow the headings before them: running counts of headings over the reading order
    number sections and, within each, subsections, which hang off the document while
    there is no section yet. Needs clean_text and tags, as clean_furniture gives; what it
    removed (removal_type) is in no section.
    """
    if "removal_type" in blocks.columns:
        blocks = blocks.where("removal_type is null")
    titles = document_titles(blocks) if titles is None else titles
    rows = blocks.withColumn("text", F.col("clean_text")).where(strip(F.col("text")) != "").withColumn("own", lines(F.col("text")))
    low = F.lower(F.col("text"))
    # one line is no list
    toc_lines = F.when(F.contains("text", F.lit("\n")), F.size(F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(TOC_LINE))))).otherwise(0)
    bio = F.lit(False)
    for phrase in BIO_PHRASES:
        bio = bio | F.contains(low, F.lit(phrase))
    special = (
        F.when(F.array_contains("tags", "toc") | (toc_lines >= 2) | F.contains(low, F.lit("table of contents")), "toc")
        .when(F.array_contains("tags", "biography") | bio, "biography")
        .when(F.array_contains("tags", "promotional"), "promotional")
    )
    rows = rows.withColumn("special", special).withColumn("n_lines", F.size("own")).withColumn("first", F.col("own")[0])
    short = F.col("special").isNull() & (F.col("n_lines") <= 4)
    is_section = short & ((starts(F.col("first"), SECTION_STARTS) & _any(F.col("first"), SECTION_HEADINGS)) | (F.col("is_heading") & (F.col("heading_level") == 1)))
    is_sub = short & ~is_section & (((starts(F.col("first"), SUBSECTION_STARTS) | F.startswith("first", F.lit("##"))) & _any(F.col("first"), SUBSECTION_HEADINGS)) | (F.col("is_heading") & (F.col("heading_level") == 2)))
    rows = rows.withColumn("kind", F.when(F.col("special").isNotNull(), "special").when(is_section, "section").when(is_sub, "subsection").otherwise("content"))
    opens = F.col("kind").isin("section", "subsection")
    body = F.array_join(F.slice("own", 2, 1000), "\n")
    rows = rows.select(
        "document_id",
        "reading_order_idx",
        F.when(opens, F.concat("block_id", F.lit("_body"))).otherwise(F.col("block_id")).alias("block_id"),
        F.when(opens, body).otherwise(strip(F.col("text"))).alias("text"),
        "page_num",
        "special",
        "kind",
        F.when(opens, clean_title(F.col("first"))).alias("heading"),
    )
    # running values over one order, so that texts are sorted once
    order = Window.partitionBy("document_id").orderBy("reading_order_idx").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("kind").isin("section", "subsection"), F.struct("kind", "heading", F.col("reading_order_idx").alias("at")))
    rows = rows.select(
        "*",
        F.count_if(F.col("kind") == "section").over(order).cast("long").alias("sec"),
        F.count_if(F.col("kind") == "subsection").over(order).cast("long").alias("_subs"),
        F.last(F.when(F.col("kind") == "section", F.struct("heading", F.col("reading_order_idx").alias("at"))), ignorenulls=True).over(order).alias("_section"),
        F.last(opened, ignorenulls=True).over(order).alias("_opened"),
        *(F.min(F.when(F.col("special") == name, F.col("reading_order_idx"))).over(order).alias(f"_{name}_at") for name in SPECIAL),
    )
    before = F.last(F.when(F.col("kind") == "section", F.col("_subs")), ignorenulls=True).over(order)
    under = F.when(F.col("_opened.kind") == "subsection", F.col("_opened"))
    rows = (
        rows.withColumn("sub", F.col("_subs") - F.coalesce(before, F.lit(0)))
        .withColumn("sec_title", F.col("_section.heading"))
        .withColumn("sec_at", F.col("_section.at"))
        .withColumn("sub_title", under["heading"])
        .withColumn("sub_at", under["at"])
        .withColumn("special_at", F.coalesce(*(F.when(F.col("special") == name, F.col(f"_{name}_at")) for name in SPECIAL)))
        .join(titles, "document_id")
    )
    root_id = F.concat("document_id", F.lit("_root"))
    sec_id = F.when(F.col("sec") > 0, F.concat("document_id", F.lit("_sec_"), F.format_string("%02d", "sec"))).otherwise(root_id)
    special_id = F.concat("document_id", F.lit("_"), *[_switch({k: v[0] for k, v in SPECIAL.items()})])
    in_sub, in_special = F.col("sub") > 0, F.col("special").isNotNull()
    section_id = F.when(in_special, special_id).when(in_sub, F.concat(sec_id, F.lit("_sub_"), F.format_string("%02d", "sub"))).otherwise(sec_id)
    own_title = F.when(in_special, _switch({k: v[1] for k, v in SPECIAL.items()})).when(in_sub, F.col("sub_title")).when(F.col("sec") > 0, F.col("sec_title")).otherwise(F.col("title"))
    path = F.when(in_special, F.concat_ws(" > ", "title", own_title)).otherwise(F.concat_ws(" > ", "title", "sec_title", "sub_title"))
    is_root = ~in_special & ~in_sub & (F.col("sec") == 0)
    opens = F.col("kind").isin("section", "subsection")
    return rows.select(
        "document_id",
        "reading_order_idx",
        "block_id",
        "text",
        "page_num",
        section_id.alias("section_id"),
        F.when(is_root, F.lit(None)).when(in_special | ~in_sub, root_id).otherwise(sec_id).alias("parent_section_id"),
        path.alias("section_path"),
        own_title.alias("section_title"),
        F.when(in_special, F.col("special")).when(in_sub, "subsection").when(F.col("sec") > 0, "section").otherwise("document").alias("section_type"),
        F.when(is_root, 0).when(in_special, 1).when(in_sub, 2).otherwise(1).alias("level"),
        (~opens | (F.col("text") != "")).alias("is_content"),
        F.struct(F.when(in_special, F.col("special_at")).when(is_root, -1).when(F.col("sec") > 0, F.col("sec_at")).otherwise(F.col("sub_at")).alias("top"), F.when(in_special | ~in_sub, -1).otherwise(F.col("sub")).alias("sub")).alias("section_order"),
    )


def _switch(values: dict[str, str]) -> Column:
    out = None
    for key, value in values.items():
        out = (F if out is None else out).when(F.col("special") == key, value)
    return out


def section_table(assigned: DataFrame) -> DataFrame:
    """One row for each section: ids, path, type, level, pages, blocks and characters."""
    keys = ["document_id", "section_id", "parent_section_id", "section_path", "section_title", "section_type", "level", "section_order"]
    return assigned.groupBy(*keys).agg(F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"), F.count_if("is_content").alias("n_blocks"), F.sum(F.when(F.col("is_content"), F.length("text")).otherwise(0)).alias("n_chars"))
