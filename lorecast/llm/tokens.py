"""Problem 6: encoding a corpus with a public byte-level BPE tokenizer.

Texts are split into words by the JVM, whose regular expressions know Unicode's classes. The words of an Arrow batch are
numbered by their distinct values, each distinct word is merged once, and the ids of the documents are put together from
those of the words by arrays; a task keeps the ids of at most FREQUENT words for its next batches. The vocabulary is
broadcast, so it stands in no plan, and nothing is shuffled or written.

A word is merged through a heap of pairs over a linked list, in n log n steps. Words of more than LONG bytes are not kept.

Defined cases: a null or empty text gives an empty list; repeated rows and repeated keys each give their own row; a null
key is kept; a text of any length is encoded as a whole; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecast.io import table

TOKENIZERS = "/opt/tokenizers"
#: Words whose ids a task keeps, and bytes from which a word is too long to be kept.
FREQUENT, LONG = 131072, 256
#: The pattern that splits a text into words before byte-level BPE, as published with the vocabulary.
#: (?U) makes \s the Unicode property White_Space.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a .tiktoken file; read by the driver only."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), 0)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word by ranked merges: a heap of pairs over a linked list, in n log n steps."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) < len(parts) and (rank := ranks.get(both := parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (rank, i, both))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or parts[i] + parts[j] != both:
            continue  # one of the two was merged since
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p is not None]


def encode(df: DataFrame, key: str, text: str, ranks: dict[bytes, int], frequent: int = FREQUENT, long: int = LONG) -> DataFrame:
    """(key, ids) of every row of df, without special tokens."""
    sent = df.sparkSession.sparkContext.broadcast(ranks)
    words = F.when(F.length(df[text]) > 0, split_words(df[text])).otherwise(F.array().cast("array<string>"))
    rows = df.select(df[key].alias("key"), words.alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, kept = sent.value, {}

        def ids_of(word: str) -> list[int]:
            found = kept.get(word)
            if found is None:
                data = word.encode()
                found = [ranks[data]] if data in ranks else merge_long(data, ranks)
                if len(kept) < frequent and len(data) <= long:
                    kept[word] = found
            return found

        for batch in batches:
            column = batch.column(1)
            of = column.flatten().dictionary_encode()
            each = [ids_of(w) for w in of.dictionary.to_pylist()]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            values, starts = np.fromiter(chain.from_iterable(each), np.int32, sizes.sum()), np.cumsum(sizes) - sizes
            word = of.indices.to_numpy()
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[word])])
            place = np.arange(ends[-1]) + np.repeat(starts[word] - ends[:-1], sizes[word])
            offsets = column.offsets.to_numpy() - column.offsets[0].as_py() if len(column) else np.zeros(1, np.int64)
            ids = pa.ListArray.from_arrays(pa.array(ends[offsets], pa.int32()), pa.array(values[place], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>")


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The text of a list of ids: their byte pieces, one after the other; empty for an empty list, null for null."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("iso-8859-1")
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    joined = F.array_join(F.transform(ids, lambda i: F.get(literal, i)), "")
    return F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8")


def encoded_documents(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    ranks = read_ranks(f"{tokenizers}/byte_bpe_50k.tiktoken")
    return encode(table(spark, folder, "documents"), "doc_id", "text", ranks).withColumnRenamed("key", "doc_id")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoded_documents(spark, folder)


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and ids by language, and how many documents don't decode to their own text (none)."""
    ranks = read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    ids = encoded_documents(spark, folder)
    texts = table(spark, folder, "documents").select("doc_id", "lang", "text")
    back = ids.join(texts, "doc_id").withColumn("back", decode(F.col("ids"), ranks))
    return back.groupBy("lang").agg(
        F.count("*").alias("documents"), F.sum(F.size("ids")).alias("ids"),
        F.count_if(F.col("back") != F.coalesce("text", F.lit(""))).alias("differing"),
    )


QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip}
ORACLE: dict[str, str] = {}
