"""Readers: plain text, Markdown, chat logs in JSON lines, page texts, SQLite chunks; and sinks.

Every reader takes a DataFrame of (source_id, content) or paths and gives segments with ordinal, offsets and type. Rows are
sources, so the parse of one source is one row's work; nothing is collected.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEGMENTS = "source_id string, ordinal int, segment_type string, parent_ordinal int, title string, text string, char_start long, char_end long"


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, content) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("content"))


def plain_text(df: DataFrame) -> DataFrame:
    """Paragraphs of (source_id, content): split at blank lines, trimmed, empty ones dropped; offsets and 1-based lines."""
    every = F.regexp_extract_all("content", F.lit(r"(?s)(?:(?!\n{2,}).)+|\n{2,}"), 0)
    pieces = df.where(F.col("content").isNotNull()).select("source_id", "content", every.alias("every")).select("source_id", "content", "every", F.posexplode("every").alias("at", "raw"))
    ahead = F.aggregate(F.slice("every", F.lit(1), F.col("at")), F.lit(0), lambda a, x: a + F.length(x))
    text = F.regexp_replace("raw", r"^\s+|\s+$", "")
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    rows = pieces.select("source_id", "content", "at", text.alias("text"), (ahead + lead).cast("long").alias("char_start")).where("text <> ''")
    rows = rows.withColumn("char_end", F.col("char_start") + F.length("text"))
    lines = lambda c: F.length(F.substring("content", F.lit(1), c.cast("int"))) - F.length(F.replace(F.substring("content", F.lit(1), c.cast("int")), F.lit("\n"), F.lit(""))) + 1
    order = Window.partitionBy("source_id").orderBy("at")
    return rows.select("source_id", (F.row_number().over(order) - 1).alias("ordinal"), "text", "char_start", "char_end", lines(F.col("char_start")).alias("line_start"), lines(F.col("char_end")).alias("line_end"))


HEADING = re.compile(r"^(#{1,6})\s+(.+)$")


def parse_markdown(text: str) -> list[tuple]:
    """(ordinal, type, parent ordinal, title, text, start, end): headings as sections, fenced blocks and paragraphs."""
    out: list[tuple] = []
    stack: list[tuple[int, int, str]] = []
    held: list[str] = []
    start = at = 0
    fence = None

    def flush(kind: str, end: int) -> None:
        body = "\n".join(held).strip("\n")
        if body.strip():
            out.append((len(out), kind, stack[-1][1] if stack else None, stack[-1][2] if stack else None, body.strip() if kind == "paragraph" else body, start, end))
        held.clear()

    for line in text.split("\n"):
        end = at + len(line)
        bare = line.strip()
        if fence is not None:
            held.append(line)
            if bare.startswith(fence):
                flush("code_block", end)
                fence, start = None, end + 1
        elif bare.startswith(("```", "~~~")):
            flush("paragraph", max(start, at - 1))
            fence, start = bare[:3], at
            held.append(line)
        elif m := HEADING.match(line):
            flush("paragraph", max(start, at - 1))
            level, title = len(m.group(1)), m.group(2).strip()
            while stack and stack[-1][0] >= level:
                stack.pop()
            out.append((len(out), "section", stack[-1][1] if stack else None, title, title, at, end))
            stack.append((level, len(out) - 1, title))
            start = end + 1
        elif not bare:
            flush("paragraph", max(start, at - 1))
            start = end + 1
        else:
            held.append(line)
        at = end + 1
    flush("paragraph" if fence is None else "code_block", len(text))
    return out


def _by_row(parse: Callable[[str], list[tuple]], columns: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, *r) for s, t in zip(batch["source_id"], batch["content"], strict=True) if t for r in parse(t)]
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns if c.endswith("ordinal")})

    return run


def markdown(df: DataFrame) -> DataFrame:
    columns = [c.split()[0] for c in SEGMENTS.split(", ")]
    return df.select("source_id", "content").mapInPandas(_by_row(parse_markdown, columns), SEGMENTS)


NOISE = ("queue-operation", "file-history-snapshot", "progress", "summary")


def chat_lines(df: DataFrame) -> DataFrame:
    """Messages of (source_id, line_no, line) JSON lines: blocks become segments of their own; malformed lines are skipped.

    A content that is a string is a message; blocks of type text, thinking, tool_use and tool_result become message,
    thinking, tool_call and tool_result. Times are ISO strings or epoch milliseconds.
    """
    block = "array<struct<type:string,text:string,thinking:string,name:string,input:string,content:string>>"
    get = lambda p: F.get_json_object("line", p)
    rows = df.where(F.try_parse_json("line").isNotNull() & ~F.coalesce(get("$.type"), F.lit("")).isin(*NOISE) & (F.coalesce(get("$.isMeta"), F.lit("false")) != "true"))
    content = F.coalesce(get("$.message.content"), get("$.content"))
    stamp = get("$.timestamp")
    at = F.when(stamp.rlike(r"^\d{12,}$"), F.timestamp_millis(F.expr("try_cast(get_json_object(line, '$.timestamp') as bigint)"))).otherwise(F.try_to_timestamp(stamp))
    blocks = F.when(content.startswith("["), F.from_json(content, block)).otherwise(F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("thinking", "name", "input", "content")])))
    role = F.coalesce(get("$.message.role"), get("$.role"), get("$.type"))
    each = rows.where(content.isNotNull()).select("source_id", "line_no", role.alias("role"), at.alias("message_timestamp"), F.posexplode(blocks).alias("part", "b"))
    kind = F.when(F.col("b.type") == "text", "message").when(F.col("b.type") == "thinking", "thinking").when(F.col("b.type") == "tool_use", "tool_call").when(F.col("b.type") == "tool_result", "tool_result")
    text = F.coalesce("b.text", "b.thinking", F.when(F.col("b.type") == "tool_use", F.concat_ws(" ", "b.name", "b.input")), "b.content")
    order = Window.partitionBy("source_id").orderBy("line_no", "part")
    return each.select("source_id", "line_no", "part", "role", "message_timestamp", kind.alias("segment_type"), text.alias("text")).where("segment_type is not null and trim(text) <> ''").select(
        "source_id", (F.row_number().over(order) - 1).alias("ordinal"), "role", "message_timestamp", "segment_type", "text")


def repeated_page_lines(df: DataFrame, least_pages: int = 5, share: float = 0.6, most: int = 100) -> DataFrame:
    """Pages (source_id, page, text) without running heads: first and last lines that most pages of a source share."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = df.withColumn("lines", lines).withColumn("n", F.count("*").over(Window.partitionBy("source_id")))
    ends = rows.where((F.size("lines") > 0) & (F.col("n") >= least_pages)).select("source_id", "n", F.explode(F.array_distinct(F.array(F.trim(F.element_at("lines", 1)), F.trim(F.element_at("lines", -1))))).alias("line"))
    heads = ends.where(F.length("line") < most).groupBy("source_id", "line", "n").agg(F.count("*").alias("c")).where(F.col("c") > share * F.col("n"))
    drop = heads.groupBy("source_id").agg(F.collect_list("line").alias("drop"))
    out = rows.join(drop, "source_id", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<string>")))
    kept = F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), F.trim(x)) & ~F.trim(x).rlike(r"^\d{1,4}$"))
    return out.select("source_id", "page", F.array_join(kept, "\n").alias("text"))


def sqlite_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a memory database (tables chunks and files), ordered by path and line, embeddings parsed from JSON."""
    import sqlite3  # noqa: PLC0415

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        rows = pd.read_sql_query("SELECT c.id, c.path, c.start_line, c.end_line, c.text, c.embedding, f.hash FROM chunks c LEFT JOIN files f ON c.path = f.path ORDER BY c.path, c.start_line", con)
    rows["ordinal"] = range(len(rows))
    df = spark.createDataFrame(rows.astype({"embedding": "object"}))
    return df.withColumn("embedding", F.from_json(F.col("embedding").cast("string"), "array<float>"))


READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"text/plain": plain_text, "text/markdown": markdown, "application/jsonl": chat_lines}


def reader_for(mime: str) -> Callable[[DataFrame], DataFrame]:
    """The reader of a type; plain text for other text types."""
    if mime in READERS:
        return READERS[mime]
    if mime.startswith("text/"):
        return plain_text
    raise ValueError(f"no reader for {mime}")


def new_sources(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming (source_id, tenant, content) with their checksum, without those whose checksum the tenant has."""
    rows = incoming.withColumn("checksum", F.sha2("content", 256)).dropDuplicates(["checksum", "tenant"])
    return rows.join(known.select("checksum", "tenant").distinct(), ["checksum", "tenant"], "left_anti")


def with_parents(segments: DataFrame) -> DataFrame:
    """Segments with ids, parents resolved from ordinals, and token counts."""
    ident = lambda o: F.concat(F.lit("SEG_"), F.col("source_id"), F.lit("_"), o)
    out = segments.withColumn("segment_id", ident(F.col("ordinal"))).withColumn("parent_segment_id", F.when(F.col("parent_ordinal").isNotNull(), ident(F.col("parent_ordinal"))))
    return out.withColumn("token_count", F.floor(F.length("text") / 4).cast("int"))


def archive(df: DataFrame, last_used: str, as_of: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows that go cold at a time, and those that stay; write the first with partitionBy('storage_tier')."""
    cold = F.col(last_used) < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return df.where(F.coalesce(cold, F.lit(False))).withColumn("storage_tier", F.lit("cold")), df.where(~F.coalesce(cold, F.lit(False)))
