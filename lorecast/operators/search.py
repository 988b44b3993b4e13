"""Retrieval operators: vector, lexical, hybrid, multi-space and product-space search, multi-index fusion, verification.

A query's arms are cut to their top k before anything is joined, so fusion, normalisation and reranking work on lists
of bounded size; only the scans see the corpus, and their top k is kept per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.functions import vector as V
from lorecast.functions.ranking import fuse, minmax, position_percentile, top
from lorecast.functions.text import words

K1, B = 1.2, 0.75


def vector_search(df: DataFrame, key: str, embedding: str, query: list[float], k: int) -> DataFrame:
    """(key, score): the k rows of largest cosine similarity."""
    rows = df.where(F.col(embedding).isNotNull()).select(key, V.cosine(F.col(embedding), V.literal(query)).alias("score"))
    return top(rows, F.col("score"), [key], k)


def tokens(text: Column) -> Column:
    return words(text)


def lexical_search(df: DataFrame, key: str, text: str, terms: list[str], k: int, require_all: bool = True) -> DataFrame:
    """(key, score): rows with all terms (or any), by BM25; statistics are over all rows with a text."""
    count = lambda t: F.size(F.filter(F.col("_t"), lambda x: x == t))
    rows = df.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("_t"))
    rows = rows.select(key, F.size("_t").alias("_n"), *[count(t).alias(f"_f{i}") for i, t in enumerate(terms)])
    stats = rows.agg(F.count("*").alias("_rows"), F.avg("_n").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(terms))])
    hit = reduce(lambda a, b: (a & b) if require_all else (a | b), [F.col(f"_f{i}") > 0 for i in range(len(terms))])
    idf = lambda i: F.log(1 + (F.col("_rows") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
    bm25 = sum(
        (idf(i) * F.col(f"_f{i}") * (K1 + 1) / (F.col(f"_f{i}") + K1 * (1 - B + B * F.col("_n") / F.col("_avg"))) for i in range(len(terms))), F.lit(0.0)
    )
    scored = rows.where(hit).crossJoin(F.broadcast(stats)).select(key, bm25.alias("score"))  # stats is one row
    return top(scored, F.col("score"), [key], k)


def web_query(text: Column, query: str) -> Column:
    """A filter from a web search string: words are required, OR joins two, a minus excludes, quotes ask for a phrase."""
    import re  # noqa: PLC0415

    parts = re.findall(r'-?"[^"]+"|\S+', query)
    low = F.lower(text)
    groups: list[Column] = []
    join_next = False
    for part in parts:
        if part == "OR":
            join_next = bool(groups)
            continue
        minus, word = part.startswith("-"), part.lstrip("-").strip('"').lower()
        phrase = " ".join(re.findall(r"[a-z0-9]+", word))
        has = F.array_join(tokens(low), " ").rlike(rf"(^| ){phrase}( |$)")
        test = ~has if minus else has
        if join_next:
            groups[-1] = groups[-1] | test
            join_next = False
        else:
            groups.append(test)
    return reduce(lambda a, b: a & b, groups, F.lit(True))


def hybrid(vector: DataFrame, lexical: DataFrame, key: str, k: int, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """(key, score, vector_score, lexical_score): both lists min-max normalised, then their weighted sum."""
    norm = lambda df: df.select(key, minmax("score").alias("score"))
    fused = fuse({"vector": (norm(vector), weights[0]), "lexical": (norm(lexical), weights[1])}, key, "score")
    return top(fused, F.col("score"), [key], k)


def multi_space(df: DataFrame, key: str, spaces: dict[str, tuple[Column, list[float], float]], k: int, least: float = 0.05) -> DataFrame:
    """(key, score, spaces): weighted position percentiles over spaces, each a (vector, query, weight).

    Spaces below the least weight are skipped. All others come from one scan: rows are stacked by space and cut to 2k a
    space. `spaces` maps each space to its raw, percentile and weighted score.
    """
    used = {n: s for n, s in spaces.items() if s[2] >= least}
    stacked = df.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("space"), F.lit(w).alias("w"), V.cosine(c, V.literal(q)).alias("raw")) for n, (c, q, w) in used.items()])).alias("s")).select(key, "s.*")
    first = Window.partitionBy("space").orderBy(F.col("raw").desc(), F.col(key).asc())
    cut = stacked.withColumn("at", F.row_number().over(first)).where(F.col("at") <= 2 * k)
    ranked = cut.withColumn("pct", position_percentile([F.col("raw").asc(), F.col("at").asc()], ["space"]))
    fused = ranked.groupBy(key).agg(
        F.sum(F.col("w") * F.col("pct")).alias("score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("space", F.struct("raw", F.col("pct").alias("percentile"), (F.col("w") * F.col("pct")).alias("weighted")).alias("v"))))).alias("spaces"),
    )
    return top(fused, F.col("score"), [key], k)


def percentile_fusion(lists: dict[str, tuple[DataFrame, float]], key: str, k: int) -> DataFrame:
    """(key, score, ...): lists position-percentile normalised in their own order (score descending, key), then fused."""
    rank = lambda df: df.withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("score").desc(), F.col(key))))
    norm = {n: (rank(df).select(key, position_percentile([F.col("score").asc(), F.col("_at").asc()]).alias("score")), w) for n, (df, w) in lists.items()}
    return top(fuse(norm, key, "score"), F.col("score"), [key], k)


def product_search(
    df: DataFrame, key: str, spaces: tuple[Column, Column, Column], query: tuple[list[float], list[float], list[float]], prefilter: int, k: int,
    weights: tuple[float, float, float] = V.SEARCH_WEIGHTS,
) -> DataFrame:
    """(key, distance, score): the nearest `prefilter` in flat space, reranked by the product distance; 1 / (1 + d)."""
    (h, s, e), (qh, qs, qe) = spaces, query
    rows = df.select(key, h.alias("_h"), s.alias("_s"), V.euclidean(e, V.literal(qe)).alias("_e"))
    near = rows.orderBy("_e", key).limit(prefilter)
    d = V.combined(V.poincare(F.col("_h"), V.literal(qh)), V.spherical(F.col("_s"), V.literal(qs)), F.col("_e"), weights)
    found = near.select(key, d.alias("distance")).orderBy("distance", key).limit(k)
    return found.withColumn("score", 1 / (1 + F.col("distance")))


def multi_index(indexes: dict[str, tuple[DataFrame, float]], k: int, least: float = 0.1) -> DataFrame:
    """(item, score, indexes): the best score of an item over indexes of (item, score), raised 10 % for each of several."""
    parts = [df.select("item", (F.col("score") * w).alias("score"), F.lit(n).alias("index")) for n, (df, w) in indexes.items() if w >= least]
    merged = reduce(DataFrame.unionByName, parts).groupBy("item").agg(F.max("score").alias("best"), F.count_distinct("index").alias("indexes"))
    scored = merged.withColumn("score", F.when(F.col("indexes") > 1, F.col("best") * (1 + 0.1 * F.col("indexes"))).otherwise(F.col("best")))
    return top(scored.select("item", "score", "indexes"), F.col("score"), ["item"], 2 * k)


def index_score(similarity: Column, factor: Column | None = None, default: float = 0.5) -> Column:
    """max(0, similarity) times a factor; a factor that is missing or 0 counts as the default."""
    base = F.greatest(similarity, F.lit(0.0))
    return base if factor is None else base * F.when(factor.isNull() | (factor == 0), default).otherwise(factor)


def verdict(found: DataFrame, score: str = "score", support: float = 0.2) -> DataFrame:
    """One row: supporting items, best score and verdict on a claim."""
    return found.agg(F.count_if(F.col(score) > support).alias("supporting"), F.coalesce(F.max(score), F.lit(0.0)).alias("best")).withColumn(
        "verdict", F.when((F.col("supporting") >= 3) & (F.col("best") > 0.6), "supported").when(F.col("supporting") >= 1, "partially_supported").otherwise("unsupported")
    )


def duplicate_class(similarity: Column, same: float = 0.95, near: float = 0.75) -> Column:
    """What to do with a new memory: NOOP beside an equal one, REVIEW beside a near one, else ADD."""
    return F.when(similarity >= same, "NOOP").when(similarity >= near, "REVIEW").otherwise("ADD")
