"""Batch phases over memories, entities and segments: verification, samples, duplicates, caches, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.functions.ranking import position_percentile, top, top_per_group


def contains_join(left: DataFrame, subject: str, right: DataFrame, name: str) -> DataFrame:
    """Rows of both sides where the name holds the subject, whatever the case: left columns, then right columns.

    An equi-join by trigrams instead of a comparison of all pairs: a name that holds a subject holds its first trigram.
    Subjects under three characters match nothing.
    """
    low = F.lower(F.col(name))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substr(low, i, F.lit(3))))
    keyed = right.where(F.length(name) >= 3).withColumn("_gram", F.explode(grams))
    asked = left.where(F.length(subject) >= 3).withColumn("_gram", F.substring(F.lower(subject), 1, 3))
    return asked.join(keyed, "_gram").where(F.contains(F.lower(name), F.lower(subject))).drop("_gram")


def verify_memories(memories: DataFrame, key: str, subject: str, at: str, claims: DataFrame, name: str, claimed: str) -> DataFrame:
    """(key, latest, stale): memories with a claim about their subject, and whether the latest is newer than the memory."""
    met = contains_join(memories.select(key, subject, at), subject, claims.select(name, claimed), name)
    latest = met.groupBy(key).agg(F.max(claimed).alias("latest"), F.first(at).alias("_at"))
    return latest.select(key, "latest", (F.col("latest") > F.col("_at")).alias("stale"))


def systematic(df: DataFrame, order: list[Column], by: list[str], size: int, start: int = 0) -> DataFrame:
    """Every n-th row of each group in an order, so that about `size` rows of each come out; whole groups if they are smaller."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    stride = F.greatest(F.lit(1), F.floor(n / size))
    rows = df.withColumn("_r", rank).withColumn("_stride", stride)
    return rows.where((F.pmod("_r", "_stride") == F.pmod(F.lit(start), F.col("_stride"))) & (F.floor(F.col("_r") / F.col("_stride")) < size)).drop("_r", "_stride")


def mixed(parts: list[tuple[DataFrame, float]], key: str, size: int, order: list[Column]) -> DataFrame:
    """A sample of `size` rows from several lists by shares; a row that several lists have counts for the first."""
    out = None
    for place, (df, share) in enumerate(parts):
        one = df.orderBy(*order).limit(round(size * share)).select("*", F.lit(place).alias("_place"))
        out = one if out is None else out.unionByName(one)
    first = Window.partitionBy(key).orderBy("_place")
    return out.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_place")


def _subsets(c: Column, least: float) -> Column:
    """Of a set of few words, all subsets that hold more than the share `least` of it."""
    n = F.size(c)
    masks = F.filter(F.sequence(F.lit(1), (F.pow(F.lit(2), F.least(n, F.lit(10))) - 1).cast("int")), lambda m: F.bit_count(m) / n > least)
    return F.transform(masks, lambda m: F.filter(c, lambda _, i: F.pmod(F.floor(m / F.pow(F.lit(2), i)), F.lit(2)) == 1))


def without_repeats(new: DataFrame, key: str, words: str, known: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of new of which no known row has a word set with a Jaccard above `least`; repeated word sets are compared once.

    Two sets of n and m words are that near if they have a subset of i words in common and i / (n + m - i) is above `least`. So sets of
    up to 10 words are asked by their subsets and the other's size, as a semi-join: its work doesn't grow with how often a word occurs.
    Of larger sets, candidates share a word, and only such as the smaller set can't do without.
    """
    small = 10
    sets = lambda df, name: df.select(F.array_sort(F.array_distinct(words)).alias(name)).where(F.size(name) > 0).distinct()
    prefix = lambda c: F.slice(c, F.lit(1), (F.size(c) - F.ceil(F.size(c) * least) + 1).cast("int"))
    a, b = sets(new, "a"), sets(known, "b")
    parts = a.where(F.size("a") <= small).withColumn("s", F.explode(_subsets(F.col("a"), least)))
    fit = F.filter(F.sequence(F.size("s"), F.lit(small)), lambda m: F.size("s") / (F.size("a") + m - F.size("s")) > least)
    held = b.where(F.size("b") <= small).select(F.explode(_subsets(F.col("b"), least)).alias("s"), F.size("b").alias("m"))
    few = parts.withColumn("m", F.explode(fit)).join(held, ["s", "m"], "left_semi").select("a")
    wide = lambda df, c: df.where(F.size(c) > small * least).withColumn("w", F.explode(prefix(F.col(c))))
    met = wide(a, "a").join(wide(b, "b"), "w").where(F.greatest(F.size("a"), F.size("b")) > small).select("a", "b").distinct()
    many = met.where(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")) > least).select("a")
    return new.withColumn("_a", F.array_sort(F.array_distinct(words))).join(few.union(many), F.col("_a") == F.col("a"), "left_anti").drop("_a")


def orchestrate(scores: DataFrame, key: str, spaces: dict[str, float], k: int, least: float = 0.05) -> DataFrame:
    """(key, score): of wide scores by space, candidates are the 3 k best of every space that weighs more than `least`; each space is
    turned into percentiles over all candidates, those that score 0 included, and the weighted sum ranks them."""
    anchors = [c for c, w in spaces.items() if w > least]
    found = None
    for c in anchors:
        one = top(scores.where(F.col(c) > 0), F.col(c), [key], 3 * k).select(key)
        found = one if found is None else found.unionByName(one)
    rows = scores.join(found.distinct(), key, "left_semi")  # a bounded list: spaces * 3 k
    for c in spaces:
        rows = rows.withColumn(f"_{c}", position_percentile([F.col(c).asc(), F.col(key).asc()]))
    fused = sum((w * F.col(f"_{c}") for c, w in spaces.items()), F.lit(0.0))
    return top(rows.select(key, fused.alias("score")), F.round("score", 9), [key], k)


def one_hop(found: DataFrame, key: str, score: str, edges: DataFrame, k: int = 5, factor: float = 1.1) -> DataFrame:
    """The k best neighbours (key, score) of found items by `factor` times the best score that leads to them, found items left out."""
    near = found.join(edges, F.col(key) == F.col("src")).groupBy(F.col("dst").alias(key)).agg((F.max(score) * factor).alias(score))
    return top(near.join(found.select(key), key, "left_anti"), F.col(score), [key], k)


def remember(similar: DataFrame, importance: str, similarity: str, floor: float = 0.3, same: float = 0.92) -> Column:
    """What becomes of a new memory: rejected under the floor, a confirmation of its nearest if that is the same, else inserted as provisional."""
    return F.when(F.col(importance) < floor, "rejected").when(F.col(similarity) >= same, "confirmed").otherwise("provisional")


def by_priority(parts: list[DataFrame], key: str, order: list[Column], limit: int) -> DataFrame:
    """Rows of the first list, filled up to the limit from the next ones."""
    out = None
    for place, df in enumerate(parts):
        one = df.select("*", F.lit(place).alias("priority"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("priority", *order, key).limit(limit)


def context_text(df: DataFrame, by: list[str], order: list[Column], tier: str, text: str, k: int) -> DataFrame:
    """(by, context): the k first texts of a group, numbered and with their tier before them, one a line."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = top_per_group(df.withColumn("_place", rank), by, order, k)
    line = F.concat(F.lit("["), F.col("_place").cast("string"), F.lit("] ("), F.coalesce(tier, F.lit("none")), F.lit(") "), F.col(text))
    lines = F.array_sort(F.collect_list(F.struct("_place", line.alias("line"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


def envelope(kind: Column, at: Column, payload: Column, source: str = "lorecast") -> Column:
    """An event as JSON: its type, time, source and payload (a struct)."""
    return F.to_json(F.struct(kind.alias("type"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.lit(source).alias("source"), payload.alias("payload")))


def publish(df: DataFrame, value: str, path: str, query: str) -> object:
    """Appends a stream of envelopes to text files of a folder, with its own checkpoint; the started query."""
    return df.select(F.col(value).alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", f"{path}/_checkpoint_{query}").trigger(availableNow=True).start()


def export(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Results as lines of JSON, and their summary as one JSON file, each written once."""
    rows.write.mode("errorifexists").json(f"{path}/rows")
    summary.coalesce(1).write.mode("errorifexists").json(f"{path}/summary")
