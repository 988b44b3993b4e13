"""Batch operators over memories, claims and entities: leader clusters, proposals, verification, compression, enrichment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns of leader_clusters.
LEADERS = "tenant string, member string, leader string, similarity double"


def leader_clusters(df: DataFrame, tenant: str, key: str, vector: str, least: float = 0.8, most: int = 50) -> DataFrame:
    """(tenant, member, leader, similarity): greedy leader clusters of each whole tenant in order of key.

    A row joins the most similar leader with a cosine of at least `least` and fewer than `most` members, else it leads. Each row depends
    on those before it, so a tenant is one stream of rows, sorted with spilling; held are the vectors of leaders that are not full.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(tenant).cast("string").alias("tenant"), F.col(key).cast("string").alias("member"), F.col(vector).alias("v"))
    dealt = rows.repartition("tenant").sortWithinPartitions("tenant", "member")

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = lead  # no tenant yet
        for batch in batches:
            x = np.array(batch["v"].tolist(), dtype=np.float64).reshape(len(batch), -1)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            out = []
            for i, (group, member) in enumerate(zip(batch["tenant"], batch["member"], strict=True)):
                if group != now:
                    now, names, held, open_ = group, [], [], np.empty((16, x.shape[1]))
                score = open_[: len(names)] @ x[i]
                j = int(np.argmax(score)) if names else -1
                if j >= 0 and score[j] >= least:
                    held[j] += 1
                    out.append((names[j], round(float(score[j]), 6)))
                    if held[j] >= most:
                        open_[j : len(names) - 1] = open_[j + 1 : len(names)].copy()
                        del names[j], held[j]
                else:
                    out.append((member, 1.0))
                    if most > 1:
                        if len(names) == len(open_):
                            open_ = np.concatenate([open_, np.empty_like(open_)])
                        open_[len(names)] = x[i]
                        names.append(member)
                        held.append(1)
            yield pd.DataFrame({"tenant": batch["tenant"], "member": batch["member"], "leader": [n for n, _ in out], "similarity": [s for _, s in out]})

    return dealt.mapInPandas(lead, LEADERS)


def stability(n: Column, mean_distance: Column, least: int = 3) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - mean_distance) + F.least(F.lit(0.2), (n - least) * 0.02))


def merge_proposals(pairs: DataFrame, entities: DataFrame, key: str, weight: list[str]) -> DataFrame:
    """(keep, drop, similarity): of each similar pair (a, b, similarity) the entity with more mentions stays; one proposal a drop."""
    strong = lambda side: F.struct(*[F.coalesce(F.col(f"{side}.{c}"), F.lit(0)) for c in weight], F.col(f"{side}.{key}"))
    rows = pairs.join(entities.alias("x"), F.col("a") == F.col(f"x.{key}")).join(entities.alias("y"), F.col("b") == F.col(f"y.{key}"))
    first = strong("x") >= strong("y")
    out = rows.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("drop"), "similarity")
    w = Window.partitionBy("drop").orderBy(F.col("similarity").desc(), "keep")
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def approve(proposals: DataFrame, confidence: str, text: str, least: float = 0.85) -> DataFrame:
    """Proposals that may be applied without review: confident, and without a credential in their text."""
    from lorecast.functions.scores import is_credential  # noqa: PLC0415

    return proposals.where((F.col(confidence) >= least) & ~F.coalesce(is_credential(F.col(text)), F.lit(False)))


def grouped_texts(df: DataFrame, group: str, order: str, text: str, size: int = 20) -> DataFrame:
    """(group, chunk, n, text): runs of `size` texts of a group in order, joined for a summary."""
    w = Window.partitionBy(group).orderBy(order)
    rows = df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))
    return rows.groupBy(group, "chunk").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def poorly_described(entities: DataFrame, mentions: DataFrame, key: str, k: int, short: int = 60) -> DataFrame:
    """The k most mentioned entities with a description that is missing or short, with their mention counts."""
    n = mentions.groupBy(F.col("target_id").alias(key)).agg(F.count_distinct("segment_id").alias("segments"))
    rows = entities.where(F.col("description").isNull() | (F.length("description") < short)).join(n.where("segments >= 2"), key)
    return rows.orderBy(F.col("segments").desc(), key).limit(k)


def expired(df: DataFrame, at: str, as_of: str, hours: int) -> DataFrame:
    return df.where(F.col(at) < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours)))


def within_budget(spent: DataFrame, budgets: DataFrame, key: str, used: str, budget: str) -> DataFrame:
    """(key, used, budget, left): what each key has left of its budget; a missing budget is unlimited."""
    total = spent.groupBy(key).agg(F.sum(used).alias("used"))
    return budgets.join(total, key, "left").select(key, F.coalesce("used", F.lit(0)).alias("used"), F.col(budget).alias("budget"), (F.col(budget) - F.coalesce("used", F.lit(0))).alias("left"))
