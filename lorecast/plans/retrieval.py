"""Registered retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecast.functions import vector as V
from lorecast.functions.ranking import blend_rerank, fill_budget, minmax, position_percentile
from lorecast.io import table
from lorecast.operators import search as S

#: Weights of the six spaces of a search, and those of a verification.
SPACES = {"topic": 0.40, "claim": 0.20, "procedure": 0.15, "relation": 0.10, "time": 0.10, "evidence": 0.05}
VERIFY = {"topic": 0.20, "claim": 0.35, "procedure": 0.05, "relation": 0.10, "time": 0.05, "evidence": 0.25}
TERMS = ["recall", "segments"]


def query_vector(spark: SparkSession, folder: str) -> list[float]:
    """The stored vector that stands for the question."""
    return list(table(spark, folder, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def bands(query: list[float], weights: dict[str, float]) -> dict:
    """Six bands of ten dimensions as six spaces."""
    return {n: (F.slice("embedding", 1 + 10 * i, 10), query[10 * i : 10 * i + 10], w) for i, (n, w) in enumerate(weights.items())}


def _six(c: str, name: str):  # noqa: ANN202
    return F.round(F.col(c), 6).alias(name)


def _vector(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return S.vector_search(table(spark, folder, "embeddings"), "vec_id", "embedding", query_vector(spark, folder), k)


def _lexical(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return S.lexical_search(table(spark, folder, "documents"), "doc_id", "text", TERMS, k).withColumnRenamed("doc_id", "vec_id")


def _hybrid(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return S.hybrid(_vector(spark, folder, 2 * k), _lexical(spark, folder, 2 * k), "vec_id", k)


def _spaces(spark: SparkSession, folder: str, k: int, weights: dict[str, float] = SPACES) -> DataFrame:
    return S.multi_space(table(spark, folder, "embeddings"), "vec_id", bands(query_vector(spark, folder), weights), k)


def _product(spark: SparkSession, folder: str, prefilter: int, k: int) -> DataFrame:
    q = query_vector(spark, folder)
    e = F.col("embedding")
    spaces = (F.slice(e, 1, 32), F.slice(e, 33, 16), e)
    return S.product_search(table(spark, folder, "embeddings"), "vec_id", spaces, (q[:32], q[32:48], q), prefilter, k)


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _vector(spark, folder, 20).select("vec_id", _six("score", "similarity"))


def lexical_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _lexical(spark, folder, 20).select("vec_id", _six("score", "score"))


def web_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where(F.col("text").isNotNull())
    return docs.where(S.web_query(F.col("text"), 'recall OR drift "golden questions" -snapshot')).select("doc_id")


def minmax_list(spark: SparkSession, folder: str) -> DataFrame:
    return _vector(spark, folder, 40).select("vec_id", F.round(minmax("score"), 6).alias("normalised"))


def percentile_list(spark: SparkSession, folder: str) -> DataFrame:
    ordered = _vector(spark, folder, 40)
    return ordered.select("vec_id", F.round(position_percentile([F.col("score").asc(), F.col("vec_id").desc()]), 6).alias("percentile"))


def rerank_blend(spark: SparkSession, folder: str) -> DataFrame:
    q = query_vector(spark, folder)
    near = S.top(table(spark, folder, "embeddings").select("vec_id", V.cosine(F.col("embedding"), V.literal(q)).alias("score"), V.dot(F.slice("embedding", 1, 16), V.literal(q[:16])).alias("second")), F.col("score"), ["vec_id"], 50)
    out = near.select("vec_id", blend_rerank("second", "score").alias("blended"))
    return S.top(out, F.col("blended"), ["vec_id"], 15).select("vec_id", _six("blended", "blended"))


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder, 20).select("vec_id", _six("score", "score"), _six("vector_score", "vector_score"), _six("lexical_score", "lexical_score"))


def multi_manifold(spark: SparkSession, folder: str) -> DataFrame:
    found = _spaces(spark, folder, 20)
    return found.select("vec_id", _six("score", "score"), F.size("spaces").alias("n_spaces"))


def hybrid_manifold(spark: SparkSession, folder: str) -> DataFrame:
    fused = S.percentile_fusion({"hybrid": (_hybrid(spark, folder, 40), 0.5), "spaces": (_spaces(spark, folder, 40).select("vec_id", "score"), 0.5)}, "vec_id", 20)
    return fused.select("vec_id", _six("score", "score"))


def product_manifold(spark: SparkSession, folder: str) -> DataFrame:
    return _product(spark, folder, 100, 20).select("vec_id", _six("distance", "distance"), _six("score", "score"))


def coords_search(spark: SparkSession, folder: str) -> DataFrame:
    """Product-space search over the stored coordinates, from the coordinates of id 1; copies of a target count once."""
    coords = table(spark, folder, "product_manifold_coords").where(F.size("euclidean_coords") == 64)
    q = coords.orderBy("id").select("hyperbolic_coords", "spherical_coords", "euclidean_coords").first()
    once = coords.groupBy("target_id").agg(F.min("id").alias("id")).join(coords.drop("target_id"), "id")
    found = S.product_search(once, "id", (F.col("hyperbolic_coords"), F.col("spherical_coords"), F.col("euclidean_coords")), (list(q[0]), list(q[1]), list(q[2])), 200, 20)
    return found.select("id", _six("distance", "distance"), _six("score", "score"))


def product_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    product = _product(spark, folder, 100, 40).select("vec_id", "score")
    fused = S.fuse({"hybrid": (_hybrid(spark, folder, 40).select("vec_id", "score"), 0.6), "product": (product, 0.4)}, "vec_id", "score")
    return S.top(fused, F.col("score"), ["vec_id"], 20).select("vec_id", _six("score", "score"))


def multi_index(spark: SparkSession, folder: str) -> DataFrame:
    """Seven indexes over bands of the vectors; items of several indexes rise."""
    rows = table(spark, folder, "embeddings").where(F.col("embedding").isNotNull())
    q = query_vector(spark, folder)
    names = {"memories": 0.3, "claims": 0.25, "entities": 0.15, "causal": 0.12, "procedures": 0.1, "relations": 0.08}
    indexes = {}
    for i, (n, w) in enumerate(names.items()):
        score = S.index_score(V.cosine(F.slice("embedding", 1 + 10 * i, 10), V.literal(q[10 * i : 10 * i + 10])), F.col("label") / 10)
        indexes[n] = (S.top(rows.select(F.col("vec_id").alias("item"), score.alias("score")), F.col("score"), ["item"], 15), w)
    return S.multi_index(indexes, 10).select("item", _six("score", "score"), "indexes")


def verify_claim(spark: SparkSession, folder: str) -> DataFrame:
    fused = S.percentile_fusion({"hybrid": (_hybrid(spark, folder, 20), 0.5), "spaces": (_spaces(spark, folder, 20, VERIFY).select("vec_id", "score"), 0.5)}, "vec_id", 10)
    return S.verdict(fused).select("supporting", _six("best", "best"), "verdict")


def budget_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the lexical list within a budget of 800 tokens, in order of score."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), F.floor(F.length("text") / 4).cast("int").alias("tokens"))
    found = _lexical(spark, folder, 20).join(docs, "vec_id")
    return fill_budget(found, [F.col("score").desc(), F.col("vec_id").asc()], "tokens", 800).select("vec_id", "tokens", "running", "taken_tokens")


def dedup_200(spark: SparkSession, folder: str) -> DataFrame:
    """One document for each beginning: the first 200 characters, trimmed and in lower case."""
    docs = table(spark, folder, "documents").where(F.col("text").isNotNull())
    return docs.groupBy(F.lower(F.trim(F.substring("text", 1, 200))).alias("head")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def assign_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest of ten centroids for each vector, if its cosine is above 0.2. The centroids are ten rows."""
    rows = table(spark, folder, "embeddings").where(F.col("embedding").isNotNull())
    means = rows.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    centroids = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("c"))
    scored = rows.crossJoin(F.broadcast(centroids.withColumnRenamed("label", "cluster"))).select("vec_id", "cluster", F.round(V.cosine(F.col("embedding"), F.col("c")), 6).alias("cos"))
    best = scored.groupBy("vec_id").agg(F.max(F.struct("cos", (-F.col("cluster")).alias("c"))).alias("b"))
    return best.select("vec_id", (-F.col("b.c")).alias("cluster"), F.col("b.cos").alias("similarity")).where("similarity > 0.2")


def medoids(spark: SparkSession, folder: str) -> DataFrame:
    """Of each label the vector nearest to the centroid, the mean distance, and the stability of the cluster."""
    rows = table(spark, folder, "embeddings").where(F.col("embedding").isNotNull())
    means = rows.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    centroids = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("c"))
    far = rows.join(F.broadcast(centroids), "label").select("label", "vec_id", F.round(V.euclidean(F.col("embedding"), F.col("c")), 6).alias("d"))
    by = far.groupBy("label").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.min(F.struct("d", "vec_id")).alias("m"))
    stable = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("mean"))) + F.least(F.lit(0.2), (F.col("n") - 3) * 0.02)
    return by.select("label", "n", F.col("m.vec_id").alias("medoid"), _six("mean", "mean_distance"), F.round(F.least(F.lit(1.0), stable), 6).alias("stability"))


def duplicate_memory(spark: SparkSession, folder: str) -> DataFrame:
    """For the nearest three vectors to the question: what a new memory beside each would be."""
    return _vector(spark, folder, 60).select("vec_id", S.duplicate_class(F.col("score"), 0.95, 0.25).alias("action"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, lexical_topk, web_search, minmax_list, percentile_list, rerank_blend, hybrid_search, multi_manifold, hybrid_manifold, product_manifold,
        coords_search, product_hybrid, multi_index, verify_claim, budget_fill, dedup_200, assign_cluster, medoids, duplicate_memory,
    )
}

_Q = "q AS (SELECT embedding::DOUBLE[] v FROM embeddings WHERE vec_id = 0)"
_VEC = "SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v) score FROM embeddings, q WHERE embedding IS NOT NULL ORDER BY score DESC, vec_id LIMIT {k}"
_TOK = "list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"
_LEX = f"""SELECT doc_id vec_id, {' + '.join(f"ln(1 + (nd - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / av))" for i in range(len(TERMS)))} score
    FROM (SELECT doc_id, len(t) n, {', '.join(f"len(list_filter(t, lambda x: x = '{w}')) f{i}" for i, w in enumerate(TERMS))} FROM (SELECT doc_id, {_TOK} t FROM documents WHERE text IS NOT NULL)) x,
    (SELECT count(*) nd, avg(len(t)) av, {', '.join(f"count(*) FILTER (WHERE list_contains(t, '{w}')) d{i}" for i, w in enumerate(TERMS))} FROM (SELECT {_TOK} t FROM documents WHERE text IS NOT NULL)) s
    WHERE {' AND '.join(f'f{i} > 0' for i in range(len(TERMS)))} ORDER BY score DESC, vec_id LIMIT {{k}}"""
_MM = "CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END"


def _hybrid_sql(k: int) -> str:
    return f"""SELECT vec_id, 0.7 * coalesce(a.s, 0) + 0.3 * coalesce(b.s, 0) score, coalesce(a.s, 0) vector_score, coalesce(b.s, 0) lexical_score
        FROM (SELECT vec_id, {_MM} s FROM ({_VEC.format(k=2 * k)})) a FULL JOIN (SELECT vec_id, {_MM} s FROM ({_LEX.format(k=2 * k)})) b USING (vec_id) ORDER BY score DESC, vec_id LIMIT {k}"""


def _spaces_sql(k: int, weights: dict[str, float]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT vec_id, '{n}' space, {w} w, list_cosine_similarity((embedding::DOUBLE[])[{1 + 10 * i}:{10 * i + 10}], v[{1 + 10 * i}:{10 * i + 10}]) raw FROM embeddings, q WHERE embedding IS NOT NULL"
        for i, (n, w) in enumerate(weights.items())
        if w >= 0.05
    )
    return f"""SELECT vec_id, sum(w * pct) score, count(*) n_spaces FROM (
            SELECT *, CASE WHEN count(*) OVER (PARTITION BY space) = 1 THEN 0.5 ELSE (row_number() OVER (PARTITION BY space ORDER BY raw, rk) - 1) / (count(*) OVER (PARTITION BY space) - 1) END pct
            FROM (SELECT *, row_number() OVER (PARTITION BY space ORDER BY raw DESC, vec_id) rk FROM ({parts}) QUALIFY rk <= {2 * k}))
        GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT {k}"""


def _pct_sql(source: str) -> str:
    return f"""SELECT vec_id, CASE WHEN count(*) OVER () = 1 THEN 0.5 ELSE (row_number() OVER (ORDER BY score, rk) - 1) / (count(*) OVER () - 1) END p
        FROM (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) rk FROM ({source}))"""


def _fused_pct_sql(k: int, inner: int, weights: dict[str, float]) -> str:
    return f"""SELECT vec_id, 0.5 * coalesce(a.p, 0) + 0.5 * coalesce(b.p, 0) score FROM ({_pct_sql(_hybrid_sql(inner))}) a FULL JOIN ({_pct_sql(_spaces_sql(inner, weights))}) b USING (vec_id)
        ORDER BY score DESC, vec_id LIMIT {k}"""


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def _product_sql(h: str, s: str, e: str, qh: str, qs: str, qe: str, source: str, key: str, prefilter: int, k: int) -> str:
    hyper = f"""acosh(greatest(1.0, 1 + 2 * list_sum(list_transform(list_zip(h, {qh}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))
        / greatest((1 - least({_dot('h', 'h')}, 1 - 1e-5)) * (1 - least({_dot(qh, qh)}, 1 - 1e-5)), 1e-5)))"""
    return f"""SELECT {key}, distance, 1 / (1 + distance) score FROM (SELECT {key}, 0.3 * {hyper} + 0.2 * acos(greatest(-1.0, least(1.0, list_cosine_similarity(s, {qs})))) + 0.5 * de distance
        FROM (SELECT {key}, {h} h, {s} s, list_distance({e}, {qe}) de, {qh} qh_, {qs} qs_ FROM {source} ORDER BY de, {key} LIMIT {prefilter}), q) ORDER BY distance, {key} LIMIT {k}"""


_PRODUCT = lambda prefilter, k: _product_sql("(embedding::DOUBLE[])[1:32]", "(embedding::DOUBLE[])[33:48]", "embedding::DOUBLE[]", "v[1:32]", "v[33:48]", "v", "embeddings, q", "vec_id", prefilter, k)
_MI = {"memories": 0.3, "claims": 0.25, "entities": 0.15, "causal": 0.12, "procedures": 0.1}
ORACLE = {
    "vector_topk": f"WITH {_Q} SELECT vec_id, round(score, 6) similarity FROM ({_VEC.format(k=20)})",
    "lexical_topk": f"SELECT vec_id, round(score, 6) score FROM ({_LEX.format(k=20)})",
    "web_search": r"""SELECT doc_id FROM (SELECT doc_id, array_to_string(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda t: t <> ''), ' ') t FROM documents WHERE text IS NOT NULL)
        WHERE (regexp_matches(t, '(^| )recall( |$)') OR regexp_matches(t, '(^| )drift( |$)')) AND regexp_matches(t, '(^| )golden questions( |$)') AND NOT regexp_matches(t, '(^| )snapshot( |$)')""",
    "minmax_list": f"WITH {_Q} SELECT vec_id, round({_MM}, 6) normalised FROM ({_VEC.format(k=40)})",
    "percentile_list": f"WITH {_Q} SELECT vec_id, round((row_number() OVER (ORDER BY score, vec_id DESC) - 1) / (count(*) OVER () - 1), 6) percentile FROM ({_VEC.format(k=40)})",
    "rerank_blend": f"""WITH {_Q}, n AS (SELECT vec_id, score, list_dot_product((embedding::DOUBLE[])[1:16], v[1:16]) snd FROM ({_VEC.format(k=50)}) JOIN embeddings USING (vec_id), q)
        SELECT vec_id, round(b, 6) blended FROM (SELECT vec_id, 0.7 * CASE WHEN max(snd) OVER () = min(snd) OVER () THEN 0 ELSE (snd - min(snd) OVER ()) / (max(snd) OVER () - min(snd) OVER ()) END + (1 - 0.7) * score b FROM n)
        ORDER BY b DESC, vec_id LIMIT 15""",
    "hybrid_search": f"WITH {_Q} SELECT vec_id, round(score, 6) score, round(vector_score, 6) vector_score, round(lexical_score, 6) lexical_score FROM ({_hybrid_sql(20)})",
    "multi_manifold": f"WITH {_Q} SELECT vec_id, round(score, 6) score, n_spaces::INT n_spaces FROM ({_spaces_sql(20, SPACES)})",
    "hybrid_manifold": f"WITH {_Q} SELECT vec_id, round(score, 6) score FROM ({_fused_pct_sql(20, 40, SPACES)})",
    "product_manifold": f"WITH {_Q} SELECT vec_id, round(distance, 6) distance, round(score, 6) score FROM ({_PRODUCT(100, 20)})",
    "coords_search": "WITH c AS (SELECT * FROM product_manifold_coords WHERE len(euclidean_coords) = 64), q AS (SELECT hyperbolic_coords::DOUBLE[] qh, spherical_coords::DOUBLE[] qs, euclidean_coords::DOUBLE[] qe FROM c ORDER BY id LIMIT 1) SELECT id, round(distance, 6) distance, round(score, 6) score FROM ("
    + _product_sql("hyperbolic_coords::DOUBLE[]", "spherical_coords::DOUBLE[]", "euclidean_coords::DOUBLE[]", "qh", "qs", "qe", "(SELECT * FROM c WHERE id IN (SELECT min(id) FROM c GROUP BY target_id)), q", "id", 200, 20) + ")",
    "product_hybrid": f"""WITH {_Q} SELECT vec_id, round(s, 6) score FROM (SELECT vec_id, 0.6 * coalesce(a.score, 0) + 0.4 * coalesce(b.score, 0) s
        FROM ({_hybrid_sql(40)}) a FULL JOIN ({_PRODUCT(100, 40)}) b USING (vec_id) ORDER BY s DESC, vec_id LIMIT 20)""",
    "multi_index": f"WITH {_Q}, u AS (" + " UNION ALL ".join(
        f"(SELECT vec_id item, s * {w} score FROM (SELECT vec_id, greatest(0, list_cosine_similarity((embedding::DOUBLE[])[{1 + 10 * i}:{10 * i + 10}], v[{1 + 10 * i}:{10 * i + 10}])) * CASE WHEN label = 0 THEN 0.5 ELSE label / 10 END s FROM embeddings, q WHERE embedding IS NOT NULL) ORDER BY s DESC, vec_id LIMIT 15)"
        for i, (n, w) in enumerate(_MI.items())
    ) + ") SELECT item, round(s, 6) score, n indexes FROM (SELECT item, count(*) n, max(score) * CASE WHEN count(*) > 1 THEN 1 + 0.1 * count(*) ELSE 1 END s FROM u GROUP BY item ORDER BY s DESC, item LIMIT 20)",
    "verify_claim": f"""WITH {_Q} SELECT count(*) FILTER (WHERE score > 0.2) supporting, round(coalesce(max(score), 0), 6) best,
        CASE WHEN count(*) FILTER (WHERE score > 0.2) >= 3 AND max(score) > 0.6 THEN 'supported' WHEN count(*) FILTER (WHERE score > 0.2) >= 1 THEN 'partially_supported' ELSE 'unsupported' END verdict
        FROM ({_fused_pct_sql(10, 20, VERIFY)})""",
    "budget_fill": f"""WITH r AS (SELECT vec_id, score, (length(text) // 4)::INT tokens, sum(length(text) // 4 + 25) OVER (ORDER BY score DESC, vec_id) running FROM ({_LEX.format(k=20)}) JOIN documents ON doc_id = vec_id),
        b AS (SELECT *, coalesce(lag(running) OVER (ORDER BY score DESC, vec_id), 0) prev FROM r)
        SELECT vec_id, tokens, running::BIGINT running, (CASE WHEN running <= 800 THEN tokens ELSE 800 - prev - 25 END)::BIGINT taken_tokens FROM b WHERE running <= 800 OR (prev <= 800 AND 800 - prev > 75)""",
    "dedup_200": "SELECT min(doc_id) doc_id, count(*) copies FROM documents WHERE text IS NOT NULL GROUP BY lower(trim(substring(text, 1, 200), ' '))",
    "assign_cluster": """WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) m FROM embeddings, range(1, 65) t(i) WHERE embedding IS NOT NULL GROUP BY 1, 2), c AS (SELECT label cluster, list(m ORDER BY i) c FROM m GROUP BY 1)
        SELECT vec_id, cluster, similarity FROM (SELECT vec_id, cluster, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) similarity FROM embeddings, c WHERE embedding IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, cluster) = 1) WHERE similarity > 0.2""",
    "medoids": """WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) m FROM embeddings, range(1, 65) t(i) WHERE embedding IS NOT NULL GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) c FROM m GROUP BY 1),
        d AS (SELECT label, vec_id, round(list_distance(embedding::DOUBLE[], c), 6) d FROM embeddings JOIN c USING (label) WHERE embedding IS NOT NULL)
        SELECT label, count(*) n, arg_min(vec_id, (d, vec_id)) medoid, round(avg(d), 6) mean_distance, round(least(1.0, greatest(0.0, least(1.0, 1 - avg(d))) + least(0.2, (count(*) - 3) * 0.02)), 6) stability FROM d GROUP BY 1""",
    "duplicate_memory": f"WITH {_Q} SELECT vec_id, CASE WHEN score >= 0.95 THEN 'NOOP' WHEN score >= 0.25 THEN 'REVIEW' ELSE 'ADD' END AS action FROM ({_VEC.format(k=60)})",
}
