"""Problem 7: filling containers of fixed capacity with items, by Karmarkar-Karp multiway differencing.

Items larger than the capacity are cut into pieces of at most the capacity; nothing else is cut. Items are dealt by hash
into groups of about `windows` containers, whose number follows from the totals, so a group is bounded whatever the
keys are. In a group the differencing method merges partial partitions, the fullest window of one with the emptiest of
the other, always the two partitions with the largest imbalance; that leaves windows that are nearly equal. If the
fullest exceeds the capacity, the group is divided again with more windows, until all fit.

Defined cases: items of size 0 are put into a window like the others and take no room; a null key or repeated keys are
kept as rows of their own; a null or negative size counts as 0; no rows give no rows; sizes that tie are ordered by key.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecast.io import table
from lorecast.llm.splitting import limits
from lorecast.llm.tokens import encoded_documents
from lorecast.plans.materialize import cut

#: Windows and items of a group, about; a group is one task's work.
WINDOWS, ITEMS = 96, 4096
PACKS = "key string, piece int, start long, size long, pack string, pack_size long"


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item: Karmarkar-Karp over partitions into `windows` sums."""
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums = np.zeros(windows, dtype=np.int64)
        sums[-1] = size
        heap.append((-size, i, sums, [None] * (windows - 1) + [i]))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = a + b[::-1]
        held = [(p, q) if p is not None and q is not None else q if p is None else p for p, q in zip(x, reversed(y), strict=True)]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), serial, sums, [held[k] for k in order]))
        serial += 1
    out = np.zeros(len(sizes), dtype=np.int64)
    for window, tree in enumerate(heap[0][3] if heap else []):
        todo = [tree]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo.extend(node)
            elif node is not None:
                out[node] = window
    return out


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, no window above the capacity; the number of windows starts at the least possible."""
    large = int((sizes * 2 > capacity).sum())
    windows = max(1, math.ceil(int(sizes.sum()) / capacity), large)
    while True:
        found = differencing(sizes, windows)
        if len(sizes) == 0 or np.bincount(found, weights=sizes, minlength=windows).max() <= capacity:
            return found
        windows += 1


def pack(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, start, size, pack, pack_size) for every row of df; pieces of one row follow each other from start."""
    items = df.select(df[key].cast("string").alias("key"), F.greatest(F.coalesce(df[size].cast("long"), F.lit(0)), F.lit(0)).alias("total"))
    pieces = items.select(
        "key", "total", F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(capacity))).alias("piece", "start")
    ).withColumn("size", F.least(F.lit(capacity), F.col("total") - F.col("start")))
    pieces = cut(pieces)
    n, total = pieces.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = max(1, round(total / (capacity * WINDOWS)), math.ceil(n / ITEMS))

    def one(group: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["size", "key", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sizes = batch["size"].to_numpy(dtype=np.int64)
        window = fill(sizes, capacity)
        sums = np.bincount(window, weights=sizes).astype(np.int64)
        batch["pack"] = [f"{group[0]}-{w}" for w in window]
        batch["pack_size"] = sums[window]
        return batch[["key", "piece", "start", "size", "pack", "pack_size"]]

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("key", "piece", "size"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(one, PACKS)


def packs(spark: SparkSession, folder: str) -> DataFrame:
    capacity, _ = limits(spark, folder, "context_pack")
    sizes = encoded_documents(spark, folder).select("doc_id", F.size("ids").alias("n"))
    return pack(sizes, "doc_id", "n", capacity).withColumn("key", F.col("key").cast("long")).withColumnRenamed("key", "doc_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be cut."""
    return packs(spark, folder).where(F.col("piece") == 1).select("doc_id").distinct()


def p7_packs(spark: SparkSession, folder: str) -> DataFrame:
    return packs(spark, folder)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the packs are: packs, tokens, the least number of packs possible, and packs above the capacity (none)."""
    capacity, _ = limits(spark, folder, "context_pack")
    by_pack = packs(spark, folder).groupBy("pack").agg(F.sum("size").alias("n"))
    return by_pack.agg(
        F.count("*").alias("packs"), F.sum("n").alias("tokens"), F.ceil(F.sum("n") / capacity).alias("least"),
        F.count_if(F.col("n") > capacity).alias("over"), F.round(F.sum("n") / (F.count("*") * capacity), 6).alias("fill"),
    )


QUERIES = {"p7_found": p7_found, "p7_packs": p7_packs, "p7_fill": p7_fill}
ORACLE: dict[str, str] = {}
