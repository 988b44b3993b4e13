"""Greedy chunks of paragraphs and sentences, and topic episodes of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.functions.text import jaccard

#: Tokens that a chunk aims at, the most that a segment may have uncut, and the cost of joining two pieces.
AIM, LARGEST, JOIN = 800, 1000, 3


def tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def pieces(text: Column) -> Column:
    """Paragraphs; those above the largest size are split into sentences."""
    paragraphs = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")
    sentences = lambda p: F.filter(F.split(p, r"(?<=[.!?])\s+(?=[A-Z])|\n"), lambda s: F.trim(s) != "")
    return F.flatten(F.transform(paragraphs, lambda p: F.when(tokens(p) > LARGEST, sentences(p)).otherwise(F.array(p))))


def greedy(parts: Column, aim: int = AIM) -> Column:
    """Parts joined in order while they fit the aim; a part above it stays alone. A fold over the array."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, part: Column) -> Column:
        joined = F.concat(state["open"], F.lit("\n\n"), part)
        fits = tokens(state["open"]) + tokens(part) + JOIN <= aim
        return F.when(state["open"] == "", F.struct(state["done"].alias("done"), part.alias("open"))).when(fits, F.struct(state["done"].alias("done"), joined.alias("open"))).otherwise(
            F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), part.alias("open")))

    return F.aggregate(parts, empty, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def chunks(df: DataFrame, key: str, text: str, ordinal: str) -> DataFrame:
    """(key, ordinal, chunk_index, chunk_total, text): small rows unchanged, larger as chunks numbered ordinal * 1000 + index."""
    cut = F.when(tokens(F.col(text)) <= LARGEST, F.array(text)).otherwise(greedy(pieces(F.col(text))))
    rows = df.where(F.col(text).isNotNull()).select(key, F.col(ordinal).alias("_o"), F.size(cut).alias("chunk_total"), F.posexplode(cut).alias("chunk_index", "text"))
    number = F.when(F.col("chunk_total") == 1, F.col("_o")).otherwise(F.col("_o") * 1000 + F.col("chunk_index"))
    return rows.select(key, number.alias("ordinal"), "chunk_index", "chunk_total", "text")


# Openings of a new topic.
MARKERS = (
    r"(?i)\bnow let'?s\b|\bmoving on to\b|\bcan you look at\b|\blet'?s switch to\b|\blet'?s move on\b|\bnext,?\s+(let'?s|we|I)\b|\bchanging topic\b|\bon a different note\b|\bseparately\b|"
    r"\banother thing\b|\blet'?s talk about\b|\bnew task\b|\blet me ask\b|\bactually,?\s+(can|could|let)\b|\bBuild Phase\b|\bPhase \d+\b|\bI need you to\b"
)
ENTITY = r"\b(?:/[\w/.-]{4,}|(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+))\b|(?:\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"


def episodes(df: DataFrame, source: str, order: str, at: str, role: str, text: str, gap_minutes: int = 30) -> DataFrame:
    """Each message with its episode from 1: a new one after a gap, at an opening of the user, or where entities change.

    Entities are compared with the last non-empty set of a message that no gap or opening had flagged.
    """
    w = Window.partitionBy(source).orderBy(order)
    gap = F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(F.lag(at).over(w).cast("timestamp"))
    flagged = (gap > gap_minutes * 60) | ((F.col(role) == "user") & F.substring(text, 1, 500).rlike(MARKERS))
    rows = df.withColumn("_e", F.array_distinct(F.regexp_extract_all(F.substring(text, 1, 2000), F.lit(ENTITY), 0))).withColumn("_f", F.coalesce(flagged, F.lit(False)))
    carried = F.last(F.when((F.size("_e") > 0) & ~F.col("_f"), F.col("_e")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_c", carried)
    moved = (F.size("_e") > 0) & F.col("_c").isNotNull() & (jaccard(F.col("_e"), F.col("_c")) < 0.1)
    first = F.row_number().over(w) == 1
    start = F.when(first | F.col("_f") | F.coalesce(moved, F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("_s", start)
    return rows.withColumn("episode", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_e", "_f", "_c", "_s")


def episode_titles(df: DataFrame, source: str, order: str, role: str, text: str) -> DataFrame:
    """(source, episode, title): the first line of the episode's first user message, cut to 80 characters."""
    first = df.where(F.col(role) == "user").groupBy(source, "episode").agg(F.min_by(text, order).alias("t"))
    line = F.split("t", "\n")[0]
    return first.select(source, "episode", F.when(F.length(line) > 80, F.concat(F.substring(line, 1, 77), F.lit("..."))).otherwise(line).alias("title"))
