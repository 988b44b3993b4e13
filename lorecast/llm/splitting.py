"""Problem 3: splitting oversized texts at natural boundaries by content-defined chunking.

A rolling hash over the characters marks landmarks that depend only on the text around them. From each cut, the next
landmark between a smallest and a largest distance is taken and moved to the nearest natural boundary, so an edit
changes the pieces near it and leaves the others as they were. Consecutive pieces share `overlap` characters.

Defined cases: a null, empty or blank text and any text within the limit gives no piece rows (it is not oversized);
repeated rows of one key and text give their pieces once; rows with a null key are kept, told apart by their text; text
without any boundary is cut at the landmark itself; extra columns are ignored. Sizes count Unicode characters; a limit
of `max_size` units is `unit * max_size + unit - 1` characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecast.io import table

#: Characters of the rolling window, and how many low bits of the hash are zero at a landmark (one in 512 places).
WINDOW, LANDMARK_BITS = 32, 9
#: A landmark moves at most this many characters to a boundary of each class: paragraph, line, sentence, clause, word.
REACH = (600, 400, 300, 150, 80)
SENTENCE_ENDS, WIDE_ENDS = ".!?;:…", "。！？；：．"
PIECES = "key string, piece int, start long, stop long, n_pieces int, text string"


def rolling_hash(codes: np.ndarray) -> np.ndarray:
    """The hash of the WINDOW characters ending at each place: sum of mixed codes, each shifted by its distance."""
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    out = np.zeros_like(mixed)
    for back in range(WINDOW):
        out[back:] += mixed[: len(mixed) - back] << np.uint64(back)
    return out >> np.uint64(WINDOW - 1)


def boundaries(codes: np.ndarray) -> list[np.ndarray]:
    """Places where a piece may begin, by class, strongest first."""
    line = codes == 10
    space = np.isin(codes, [9, 10, 11, 12, 13, 32, 0xA0, 0x3000])
    ends = np.isin(codes, [ord(c) for c in SENTENCE_ENDS])
    wide = np.isin(codes, [ord(c) for c in WIDE_ENDS])
    comma = np.isin(codes, [ord(c) for c in ",、，"])
    before, after = slice(None, -1), slice(1, None)
    starts = [
        line[before] & ~line[after] & np.concatenate([[False], line[:-2]]),
        line[before] & ~line[after],
        (space[before] & ~space[after] & np.concatenate([[False], ends[:-2]])) | (wide[before] & ~wide[after]),
        (space[before] & ~space[after] & np.concatenate([[False], comma[:-2]])) | (comma[before] & (codes[before] > 127)),
        space[before] & ~space[after],
    ]
    return [np.flatnonzero(x) + 1 for x in starts]


def cuts(text: str, largest: int, overlap: int) -> list[int]:
    """The places where new content begins after the first piece. Every piece, overlap included, is at most `largest`."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(codes)
    if n <= largest:
        return []
    hashes = rolling_hash(codes)
    marks = np.flatnonzero((hashes & np.uint64((1 << LANDMARK_BITS) - 1)) == 0) + 1
    places = boundaries(codes)
    out, at = [], 0
    while n - at > largest - (overlap if at else 0):
        room = largest - (overlap if at else 0)
        low, high = at + max(1, min(room // 2, room - 1)), at + room
        k = np.searchsorted(marks, low)
        if k < len(marks) and marks[k] <= high:
            mark = int(marks[k])
        else:  # no landmark: the place with the largest hash, which depends on content as well
            mark = low + int(np.argmax(hashes[low - 1 : high]))
        at = _snap(places, mark, low, high)
        out.append(at)
    return out


def _snap(places: list[np.ndarray], mark: int, low: int, high: int) -> int:
    for found, reach in zip(places, REACH, strict=True):
        k = np.searchsorted(found, mark)
        near = [int(p) for p in found[max(0, k - 1) : k + 1] if low <= p <= high and abs(p - mark) <= reach]
        if near:
            return min(near, key=lambda p: (abs(p - mark), p))
    return mark


def split_oversized(
    df: DataFrame, key: str, text: str, max_size: int, overlap_size: int, unit: int = 4
) -> DataFrame:
    """Pieces (key, piece from 0, start and stop in characters from 0, n_pieces, text) of the oversized texts of df.

    Only oversized rows leave the JVM; rows are independent, so any skew of keys or sources is without effect.
    """
    largest, overlap = unit * max_size + unit - 1, unit * overlap_size
    if not 0 <= overlap < largest - 1:
        raise ValueError("the overlap must be smaller than the limit")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"], strict=True):
                at = [0, *cuts(t, largest, overlap), len(t)]
                for i in range(len(at) - 1):
                    start = max(0, at[i] - overlap) if i else 0
                    rows.append((k, i, start, at[i + 1], len(at) - 1, t[start : at[i + 1]]))
            yield pd.DataFrame(rows, columns=["key", "piece", "start", "stop", "n_pieces", "text"])

    large = (
        df.select(df[key].cast("string").alias("key"), df[text].alias("text"))
        .where(F.floor(F.length("text") / F.lit(unit)) > max_size)
        .dropDuplicates(["key", "text"])
    )
    return large.mapInPandas(pieces, PIECES)


def limits(spark: SparkSession, folder: str, name: str) -> tuple[int, int]:
    """max_size and overlap_size of one row of size_limits, a table of fixed size."""
    row = table(spark, folder, "size_limits").where(F.col("limit_name") == name).select("max_size", "overlap_size").first()
    if row is None:
        raise ValueError(f"size_limits has no row {name}")
    return row[0], row[1]


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    most, overlap = limits(spark, folder, "segment_chunk")
    found = split_oversized(table(spark, folder, "segments"), "segment_id", "text", most, overlap)
    return found.withColumnRenamed("key", "segment_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pieces(spark, folder).where((F.col("piece") == 0) & (F.col("n_pieces") > 1)).select("segment_id").distinct()


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
ORACLE = {
    "p3_found": """SELECT DISTINCT segment_id FROM segments
        WHERE length(text) // 4 > (SELECT max_size FROM size_limits WHERE limit_name = 'segment_chunk')""",
}
