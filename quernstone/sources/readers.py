"""Readers of text, CSV, JSON, JSON lines, FAQ and dialogue files, and of documents with
layout by a parser that the caller gives."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.formats import SEGMENTS
from quernstone.functions.normalise import preprocess
from quernstone.functions.text import safe, segments, strip

# Extensions of each kind of file, and names of columns and keys.
KINDS = {"pdf": ("pdf",), "csv": ("csv",), "json": ("json",), "jsonl": ("jsonl", "ndjson"), "text": ("txt", "md", "markdown")}
QUESTION_NAMES = ("question", "q", "query", "prompt", "input", "instruction")
ANSWER_NAMES = ("answer", "a", "response", "output", "completion", "reply", "solution")
TEXT_FIELDS = ("text", "content", "message", "description", "body", "prompt", "response", "answer", "question")
MIN_SEGMENT = 20


def kind_of(path: Column) -> Column:
    """Which reader a file goes to by its extension; null if none."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, extensions in KINDS.items():
        out = F.when(extension.isin(*extensions), kind).otherwise(out)
    return out


def preparation_kind(path: Column) -> Column:
    """csv, json, faq (by the file's name) or text."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]+)$", 1))
    return F.when(F.endswith(name, F.lit(".csv")), "csv").when(F.endswith(name, F.lit(".json")), "json").when(F.contains(name, F.lit("faq")), "faq").otherwise("text")


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, modified, length, kind of the files in a folder; contents aren't read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    return files.withColumn("kind", kind_of(F.col("path")))


def with_checksum(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length, sha256, content_hash (MD5) of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("content_hash"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """document_id (file name without extension), path, text: a file is a row."""
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.withColumn("document_id", F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)).select("document_id", "path", "text")


def text_segments(texts: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """id, pos, segment of over MIN_SEGMENT characters: preprocessed, then split."""
    found = F.filter(segments(preprocess(F.col(text_col))), lambda s: F.length(s) > MIN_SEGMENT)
    return texts.select(id_col, F.posexplode(found).alias("pos", "segment"))


def plain_segments(texts: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """id, pos, segment: paragraphs, or lines if there is but one, of over MIN_SEGMENT."""
    text = strip(F.col(text_col))
    cut = lambda by: F.filter(F.transform(F.split(text, by), strip), lambda s: s != "")
    parts = F.when(F.size(cut("\n\n")) > 1, cut("\n\n")).otherwise(cut("\n"))
    return texts.select(id_col, F.posexplode(F.filter(parts, lambda s: F.length(s) > MIN_SEGMENT)).alias("pos", "segment"))


# CSV


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter of a CSV, from its first line; a comma if in doubt."""
    head = spark.read.text(path).limit(5).collect()
    try:
        return csv.Sniffer().sniff("\n".join(r[0] for r in head)[:1024], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A CSV with a header; all columns are strings, quoted line ends stay."""
    return spark.read.option("header", True).option("sep", delimiter or sniff_delimiter(spark, path)).option("multiLine", True).option("escape", '"').csv(path)


def find_column(columns: list[str], names: tuple[str, ...], taken: str | None = None) -> str | None:
    """The column named like one of the names: as a whole first, then as a word in it. Names
    of one letter only count as whole columns or words."""
    free = [c for c in columns if c != taken]
    for column in free:
        if column.strip().lower() in names:
            return column
    for column in free:
        parts = re.split(r"[^a-z0-9]+", column.strip().lower())
        if any(n in parts or (len(n) > 1 and n in column.lower()) for n in names):
            return column
    return None


def csv_pairs(rows: DataFrame, question: str | None = None, answer: str | None = None) -> DataFrame:
    """question, answer of rows in which neither is blank; columns are found by name, else
    they are the first and second."""
    question = question or find_column(rows.columns, QUESTION_NAMES) or rows.columns[0]
    others = [c for c in rows.columns if c != question]
    answer = answer or find_column(rows.columns, ANSWER_NAMES, question) or (others[0] if others else None)
    if answer is None:
        raise ValueError("no column for answers")
    return rows.select(strip(F.col(f"`{question}`")).alias("question"), strip(F.col(f"`{answer}`")).alias("answer")).where("question != '' and answer != ''")


def csv_segments(rows: DataFrame) -> DataFrame:
    """segments of each row: a user's and an assistant's where both columns are known, else
    one of all columns that aren't blank, "name: value | name: value"."""
    question = find_column(rows.columns, QUESTION_NAMES)
    answer = find_column(rows.columns, ANSWER_NAMES, question)
    if question and answer:
        return csv_pairs(rows, question, answer).select(F.array(F.concat(F.lit("<|user|> "), "question"), F.concat(F.lit("<|assistant|> "), "answer")).alias("segments"))
    parts = F.array_compact(F.array(*(F.when(strip(F.col(f"`{c}`")) != "", F.concat(F.lit(f"{c}: "), strip(F.col(f"`{c}`")))) for c in rows.columns)))
    return rows.select(F.array(F.array_join(parts, " | ")).alias("segments")).where("segments[0] != ''")


def csv_cells(rows: DataFrame) -> DataFrame:
    """column, segment of every cell of over MIN_SEGMENT characters."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), strip(F.col(f"`{c}`")).alias("segment")) for c in rows.columns))
    return rows.select(F.explode(cells).alias("c")).select("c.*").where(F.length("segment") > MIN_SEGMENT)


# JSON

_MESSAGES = "array<struct<role:string,content:string,`from`:string,value:string,messages:array<struct<role:string,content:string,`from`:string,value:string>>>>"
_OBJECT = "conversations " + _MESSAGES + ", messages " + _MESSAGES + ", " + ", ".join(f"`{k}` string" for k in dict.fromkeys(QUESTION_NAMES + ANSWER_NAMES))


def read_json_objects(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, object (JSON text) of each object of JSON files: the file itself or the
    items of its list. Files that aren't JSON give no row."""
    texts = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("text"))
    parsed = texts.withColumn("parsed", F.try_parse_json("text")).where("parsed is not null")
    items = F.when(F.startswith("text", F.lit("[")), F.from_json("text", "array<string>")).otherwise(F.array("text"))
    return parsed.select("path", F.posexplode(items).alias("pos", "object"))


def read_json_lines(spark: SparkSession, path: str, keep_bad: bool = False) -> DataFrame:
    """path, object of each line that is JSON; with keep_bad, path and line of the others."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("object")).where("object != ''")
    good = F.try_parse_json("object").isNotNull()
    return lines.where(~good).withColumnRenamed("object", "line") if keep_bad else lines.where(good)


def json_conversation(text: Column) -> Column:
    """Segments of a JSON object with conversations (from and value, or role and content,
    or lists of such), messages, or a question and an answer; empty if it has none."""
    record = F.from_json(safe(text), _OBJECT)
    human = lambda m: F.coalesce(m["role"], m["from"])
    role = lambda m: F.when(human(m).isin("human", "user"), "user").when(human(m).isin("assistant", "gpt") | m["from"].isNotNull(), "assistant")
    named = lambda ms: F.filter(F.transform(ms, lambda m: F.struct(role(m).alias("role"), F.coalesce(m["content"], m["value"]).alias("content"))), lambda s: s["role"].isNotNull() & s["content"].isNotNull())
    nested = F.flatten(F.filter(F.transform(record["conversations"], lambda c: named(c["messages"])), lambda x: x.isNotNull()))
    flat = named(record["conversations"])
    listed = F.when(F.size(flat) > 0, flat).otherwise(nested)
    first = lambda names: F.coalesce(*(F.when(record[n] != "", record[n]) for n in names))
    question, answer = first(QUESTION_NAMES), first(ANSWER_NAMES)
    pair = F.array(F.struct(F.lit("user").alias("role"), question.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    none = F.array().cast(SEGMENTS)
    return F.when(record["conversations"].isNotNull(), F.coalesce(listed, none)).when(record["messages"].isNotNull(), F.coalesce(named(record["messages"]), none)).when(question.isNotNull() & answer.isNotNull(), pair).otherwise(none)


def json_texts(text: Column, depth: int = 3) -> Column:
    """String values of over MIN_SEGMENT characters down to a depth, in no set order. A
    value's own level counts; each level is one pass over maps and lists of strings."""
    level = F.array(safe(text))
    found = F.array().cast("array<string>")
    for k in range(depth):
        values = F.flatten(F.transform(level, lambda x: F.coalesce(F.map_values(F.from_json(x, "map<string,string>")), F.from_json(x, "array<string>"), F.array().cast("array<string>"))))
        values = F.filter(values, lambda x: x.isNotNull())
        nested = lambda x: F.rlike(x, F.lit(r"^\s*[\[{]")) & F.try_parse_json(x).isNotNull()
        found = F.concat(found, F.filter(F.transform(F.filter(values, lambda x: ~nested(x)), strip), lambda x: F.length(x) > MIN_SEGMENT))
        level = F.filter(values, nested)
        if k == depth - 1:
            break
    return found


def json_fields(text: Column) -> Column:
    """Values of the known text fields of an object, of over MIN_SEGMENT characters."""
    record = F.from_json(safe(text), ", ".join(f"`{f}` string" for f in TEXT_FIELDS))
    return F.array_compact(F.array(*(F.when(F.length(strip(record[f])) > MIN_SEGMENT, strip(record[f])) for f in TEXT_FIELDS)))


def json_pairs(objects: DataFrame, question: str | None = None, answer: str | None = None) -> DataFrame:
    """question, answer of objects: by the keys given, else the first known names, else a
    value with a question mark and the first longer value."""
    fields = F.from_json("object", "map<string,string>")
    known = lambda key, names: F.try_element_at(fields, F.lit(key)) if key else F.coalesce(*(F.try_element_at(fields, F.lit(n)) for n in names))
    asks = F.get(F.filter(F.map_values(fields), lambda v: F.contains(v, F.lit("?"))), F.lit(0))
    longer = F.get(F.filter(F.map_values(fields), lambda v: F.length(v) > F.length(asks)), F.lit(0))
    q = F.coalesce(known(question, QUESTION_NAMES), asks)
    a = F.coalesce(known(answer, ANSWER_NAMES), longer)
    return objects.select(strip(q).alias("question"), strip(a).alias("answer")).where("question != '' and answer != ''")


# Questions and answers in running text

# How questions, answers and speakers are marked.
FAQ_PATTERNS = (
    r"(?is)Q:\s*(.+?)\s*A:\s*(.+?)(?=Q:|$)",
    r"(?is)Question:\s*(.+?)\s*Answer:\s*(.+?)(?=Question:|$)",
    r"(?is)(\d+\.\s*.+?\?)\s*(.+?)(?=\d+\.|$)",
    r"(?is)(.+?\?)\s*(.+?)(?=.+?\?|$)",
)
QA_PATTERNS = ((r"(?is)Q:\s*(.+?)\s*A:\s*(.+?)(?=Q:|$)", 1, 2), (r"(?is)(\d+)\.\s*(.+?)\s*(?:Answer|A):\s*(.+?)(?=\d+\.|$)", 2, 3))
SPEAKER = r"(?s)([A-Z][a-z]+|User|Assistant|Human|AI):\s*(.+?)(?=[A-Z][a-z]+:|User:|Assistant:|Human:|AI:|$)"


def _found(text: Column, pattern: str, first: int, second: int) -> Column:
    return F.zip_with(F.regexp_extract_all(safe(text), F.lit(pattern), F.lit(first)), F.regexp_extract_all(safe(text), F.lit(pattern), F.lit(second)), lambda q, a: F.struct(strip(q).alias("question"), strip(a).alias("answer")))


def faq_pairs(text: Column) -> Column:
    """Pairs by all four patterns, one after the other; what two of them find comes twice.
    Numbers of questions go; both sides have over ten characters."""
    every = F.concat(*(_found(text, p, 1, 2) for p in FAQ_PATTERNS))
    bare = F.transform(every, lambda x: F.struct(F.regexp_replace(x["question"], r"^\d+\.\s*", "").alias("question"), x["answer"].alias("answer")))
    return F.filter(bare, lambda x: (F.length(x["question"]) > 10) & (F.length(x["answer"]) > 10))


def qa_pairs(text: Column) -> Column:
    """Pairs of "Q: A:" and of numbered questions with "Answer:"."""
    return F.filter(F.concat(*(_found(text, *p) for p in QA_PATTERNS)), lambda x: (x["question"] != "") & (x["answer"] != ""))


def dialogue_pairs(text: Column) -> Column:
    """Each turn of a user (or human) with the next of an assistant (or AI)."""
    turns = F.filter(_found(text, SPEAKER, 1, 2), lambda t: t["answer"] != "")
    who = lambda t: F.when(F.lower(t["question"]).isin("user", "human"), "user").when(F.lower(t["question"]).isin("assistant", "ai"), "assistant")
    named = F.filter(F.transform(turns, lambda t: F.struct(who(t).alias("role"), t["answer"].alias("content"))), lambda t: t["role"].isNotNull())
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<struct<question:string,answer:string>>").alias("done"))

    def step(state, t):
        answers = (t["role"] == "assistant") & state["open"].isNotNull()
        done = F.when(answers, F.concat(state["done"], F.array(F.struct(state["open"].alias("question"), t["content"].alias("answer"))))).otherwise(state["done"])
        return F.struct(F.when(t["role"] == "user", t["content"]).when(answers, F.lit(None)).otherwise(state["open"]).alias("open"), done.alias("done"))

    return F.aggregate(named, start, step, lambda s: s["done"])


# Documents with layout

BLOCK = "document_id string, block_id string, page_num int, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string, block_type string, font_size double, is_bold boolean, is_heading boolean, heading_level int, reading_order_idx int, extraction_source string"


def read_layout(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[dict]], pattern: str = "*.pdf") -> DataFrame:
    """Blocks of files by a parser from bytes to rows of BLOCK (but document_id). A file
    that it can't read gives one block without text whose source is the error's name."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [{"document_id": name, **block} for block in parse(content)]
                except Exception as error:  # a parser's own errors are of any kind
                    rows.append({"document_id": name, "text": "", "extraction_source": f"error:{type(error).__name__}"})
            struct = pa.struct([("x0", pa.float64()), ("y0", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64())])
            kinds = {"page_num": pa.int32(), "bbox": struct, "font_size": pa.float64(), "is_bold": pa.bool_(), "is_heading": pa.bool_(), "heading_level": pa.int32(), "reading_order_idx": pa.int32()}
            names = ["document_id", "block_id", "page_num", "bbox", "text", "block_type", "font_size", "is_bold", "is_heading", "heading_level", "reading_order_idx", "extraction_source"]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    named = files.select(F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1).alias("document_id"), "content")
    return named.mapInArrow(run, BLOCK)


def best_text(*candidates: Column, garbled: Callable[[Column], Column]) -> Column:
    """The first of several extractions of a page that isn't garbled, else the last that
    isn't blank."""
    good = F.coalesce(*(F.when((strip(c) != "") & garbled(c).isNull(), c) for c in candidates))
    return F.coalesce(good, *(F.when(strip(c) != "", c) for c in reversed(candidates)))
