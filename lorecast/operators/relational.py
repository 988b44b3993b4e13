"""Joins, aggregations and windows that queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.functions.text import trigrams
from lorecast.plans.materialize import cut


def bitemporal(event_time: str, ingested_at: str, event: tuple | None = None, ingested: tuple | None = None) -> Column:
    """Rows within inclusive bounds of event time and ingestion time; a row with an unknown time falls out of a bound."""
    keep = F.lit(True)
    for column, limits in ((event_time, event), (ingested_at, ingested)):
        if limits:
            c = F.col(column)
            low, high = limits
            if low:
                keep = keep & c.isNotNull() & (c >= F.lit(low).cast("timestamp"))
            if high:
                keep = keep & c.isNotNull() & (c <= F.lit(high).cast("timestamp"))
    return keep


def stale(df: DataFrame, as_of: Column, days: int, confirmations: int = 3) -> DataFrame:
    """Memories that are old, hardly confirmed, and not confirmed lately; least important and oldest first."""
    before = as_of - F.make_dt_interval(F.lit(days))
    old = F.col("status").isin("active", "provisional", "confirmed") & (F.col("created_at") < before) & (F.coalesce("confirmation_count", F.lit(0)) < confirmations)
    return df.where(old & (F.col("last_confirmed_at").isNull() | (F.col("last_confirmed_at") < before))).orderBy("importance_score", "created_at")


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge in both directions, as (src, dst)."""
    return edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst")))


def undirected_neighbours(edges: DataFrame, a: str, b: str, seeds: DataFrame) -> DataFrame:
    """Distinct neighbours of the seeds (node), seeds excluded: a disjunctive join as a union of equi-joins."""
    near = undirected(edges, a, b).join(seeds.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return near.join(seeds, "node", "left_anti")


def contradicting(df: DataFrame, key: str, subject: str, predicate: str, obj: str, at: str) -> DataFrame:
    """(earlier, later): pairs of claims on one subject and predicate with different objects, ordered by time and key."""
    a = df.select(F.col(subject).alias("s"), F.col(predicate).alias("p"), F.col(obj).alias("o1"), F.struct(at, key).alias("t1"), F.col(key).alias("earlier"))
    b = df.select(F.col(subject).alias("s"), F.col(predicate).alias("p"), F.col(obj).alias("o2"), F.struct(F.col(at).alias(at), F.col(key).alias(key)).alias("t2"), F.col(key).alias("later"))
    return a.join(b, ["s", "p"]).where((F.col("o1") != F.col("o2")) & (F.col("t1") < F.col("t2"))).select("earlier", "later")


def similar_pairs(df: DataFrame, key: str, by: list[str], text: str, least: float) -> DataFrame:
    """(a, b, similarity): pairs of a group with trigram Jaccard above `least`, by prefix filtering.

    A pair above the threshold shares one of the first n - ceil(least * n) + 1 trigrams of each side in order of rarity, so
    only those are joined on, and no block of all pairs of a group is built.
    """
    rows = df.where(F.col(text).isNotNull()).select(key, *by, trigrams(F.col(text)).alias("tri")).where(F.size("tri") > 0)
    each = rows.select(key, F.explode("tri").alias("_g"))
    rare = each.groupBy("_g").agg(F.count("*").alias("df"))
    ordered = each.join(rare, "_g").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("df", "_g"))).alias("o"))
    keep = F.size("o") - F.ceil(F.lit(least) * F.size("o")).cast("int") + 1
    heads = ordered.select(key, F.explode(F.slice("o", F.lit(1), keep)).alias("h")).select(key, F.col("h._g").alias("_g")).join(rows, key)
    a = heads.select(F.col(key).alias("a"), "_g", *by, F.col("tri").alias("ta"))
    b = heads.select(F.col(key).alias("b"), "_g", *by, F.col("tri").alias("tb"))
    pairs = a.join(b, ["_g", *by]).where("a < b").dropDuplicates(["a", "b"])
    both = F.size(F.array_intersect("ta", "tb"))
    score = both / (F.size("ta") + F.size("tb") - both)
    return pairs.select("a", "b", score.alias("s")).where(F.col("s") > least).select("a", "b", F.round("s", 6).alias("similarity"))


def cooccurrence(df: DataFrame, group: str, item: str, least: int) -> DataFrame:
    """(a, b, support): pairs a < b of items that share at least `least` groups, over distinct (group, item)."""
    a, b = df.select(group, F.col(item).alias("a")), df.select(group, F.col(item).alias("b"))
    return a.join(b, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def ranked(df: DataFrame, key: str, by: str, name: str) -> DataFrame:
    """(key, name): the place of each row in order of `by`, greatest first, then key.

    Rows are sorted by range; a row's place is its place in its range plus the rows of the ranges before, so no task sorts them all.
    """
    rows = cut(df.select(key, by).orderBy(F.col(by).desc(), key)).select(key, F.monotonically_increasing_id().alias("_i"))
    rows = rows.select(key, F.shiftright("_i", 33).alias("_p"), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    size = rows.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a partition
    before = size.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_p").select(key, (F.col("_before") + F.col("_i") + 1).alias(name))


def rank_correlation(left: DataFrame, right: DataFrame, key: str, by_left: str, by_right: str) -> DataFrame:
    """(n, rho): Spearman's correlation of two lists over common keys; null below three."""
    gap = F.col("x").cast("double") - F.col("y")  # squares of long ranks would overflow
    n = F.count("*")
    d, m = F.sum(gap * gap), n.cast("double")
    both = ranked(left, key, by_left, "x").join(ranked(right, key, by_right, "y"), key)
    return both.agg(n.alias("n"), F.when(n >= 3, F.round(1 - 6 * F.try_divide(d, m * (m * m - 1)), 6)).alias("rho"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Current rows with the incoming put over them: of each key the row of the highest version."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    both = current.unionByName(incoming)
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def sessions(df: DataFrame, key: str, at: str, gap_seconds: int, tie: str) -> DataFrame:
    """(key, session, events, started, ended): runs of events of a key with gaps of at most gap_seconds."""
    w = Window.partitionBy(key).orderBy(at, tie)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    rows = df.withColumn("_new", F.when(gap <= gap_seconds * 1_000_000, 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.count("*").alias("events"), F.min(at).alias("started"), F.max(at).alias("ended"))
