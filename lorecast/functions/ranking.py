"""Normalisation and fusion of ranked lists, and selection under a token budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tokens that a citation adds to an item, and the room below which no item is cut to fit.
CITATION, LEAST_CUT = 25, 75


def minmax(score: str, by: list[str] | None = None, equal: float = 1.0) -> Column:
    """(s - min) / (max - min) within a list; `equal` if all scores are equal."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(equal)).otherwise(F.try_divide(F.col(score) - low, high - low))


def position_percentile(order: list[Column], by: list[str] | None = None) -> Column:
    """rank / (n - 1) by position: ties get different values in list order; 0.5 for a list of one."""
    keys = by or [F.lit(1)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(*keys))
    return F.when(n == 1, 0.5).otherwise(F.try_divide(rank - 1, n - 1))


def blend_rerank(score: str, original: str, alpha: float = 0.7, by: list[str] | None = None) -> Column:
    """A reranker's score, min-max normalised (0 if all are equal), blended with the original."""
    return alpha * minmax(score, by, 0.0) + (1 - alpha) * F.col(original)


def top(df: DataFrame, score: Column, keys: list[str], k: int) -> DataFrame:
    """The k best rows by score, ties by key: a partial top-k in each task and one merge."""
    return df.orderBy(score.desc(), *[F.col(c).asc() for c in keys]).limit(k)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; groups are cut down before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def fuse(lists: dict[str, tuple[DataFrame, float]], key: str, score: str) -> DataFrame:
    """Weighted sum of scores over the union of lists, 0 where a list lacks an item: key, score, one column per list."""
    parts = [df.select(key, F.lit(name).alias("_list"), F.col(score).alias("_s")) for name, (df, _) in lists.items()]
    whole = reduce(DataFrame.unionByName, parts)
    by_list = {n: F.coalesce(F.max(F.when(F.col("_list") == n, F.col("_s"))), F.lit(0.0)) for n in lists}
    fused = sum((w * by_list[n] for n, (_, w) in lists.items()), F.lit(0.0))
    return whole.groupBy(key).agg(fused.alias(score), *[c.alias(f"{n}_score") for n, c in by_list.items()])


def evidence_fusion(parts: dict[str, float], signals: dict[str, float], penalties: dict[str, float]) -> Column:
    """sum of alpha * part + sum of beta * signal - sum of beta * penalty, at least 0; missing values count as 0."""
    value = lambda d: sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in d.items()), F.lit(0.0))
    return F.greatest(value(parts) + value(signals) - value(penalties), F.lit(0.0))


def effective_score(score: Column, importance: Column, recency: Column, priority: Column) -> Column:
    return 0.5 * score + 0.2 * importance + 0.1 * recency + 0.2 * F.greatest(F.lit(0), 5 - priority) * 0.1


def fill_budget(df: DataFrame, order: list[Column], tokens: str, budget: int, by: list[str] | None = None) -> DataFrame:
    """Items in order while tokens + CITATION fit the budget; the first that doesn't is cut if more than LEAST_CUT are left.

    Adds `taken_tokens` and `running`. A ranking over a whole corpus would be one task's work; so it is meant for a
    query's candidates, a bounded list, or for lists by group.
    """
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)
    running = F.sum(F.col(tokens) + CITATION).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("running", running).withColumn("_before", F.coalesce(F.lag("running").over(w), F.lit(0)))
    left = F.lit(budget) - F.col("_before") - CITATION
    whole, first_over = F.col("running") <= budget, (F.col("running") > budget) & (F.col("_before") <= budget)
    taken = F.when(whole, F.col(tokens)).when(first_over & (left + CITATION > LEAST_CUT), left)
    return rows.withColumn("taken_tokens", taken).where(F.col("taken_tokens").isNotNull()).drop("_before")


def cut_text(text: Column, tokens: Column, unit: int = 4) -> Column:
    """A text cut to a number of tokens: at the last sentence end after 60 %, else at the last space after 80 %."""
    room = tokens * unit
    head = F.substring(text, F.lit(1), room)
    last = lambda mark: F.length(head) - F.locate(mark, F.reverse(head)) + 1
    has = lambda mark: F.locate(mark, head) > 0
    sentence = F.when(has(". "), F.length(head) - F.locate(" .", F.reverse(head)))
    return (
        F.when(F.length(text) <= room, text)
        .when(sentence > room * 0.6, F.substring(head, F.lit(1), sentence))
        .when(has(" ") & (last(" ") > room * 0.8), F.concat(F.rtrim(F.substring(head, F.lit(1), last(" ") - 1)), F.lit("...")))
        .otherwise(F.concat(head, F.lit("...")))
    )
