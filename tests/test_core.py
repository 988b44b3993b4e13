from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lorecast.functions import ranking, scores, text, vector
from lorecast.operators import graph, relational, search
from lorecast.plans.components import connected_components


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vector_functions(spark):
    assert one(spark, vector.cosine(arr(1, 0), arr(1, 1))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, vector.cosine(arr(0, 0), arr(1, 1))) == 0
    assert one(spark, vector.cosine(arr(1), arr(1, 1))) == 0
    assert one(spark, vector.euclidean(arr(0, 3), arr(4, 0))) == 5
    assert one(spark, vector.spherical(arr(0, 0), arr(1, 0))) == pytest.approx(math.pi)
    x, y = (0.1, 0.2), (-0.3, 0.4)
    apart = sum((a - b) ** 2 for a, b in zip(x, y))
    want = math.acosh(1 + 2 * apart / ((1 - 0.05) * (1 - 0.25)))
    assert one(spark, vector.poincare(arr(*x), arr(*y))) == pytest.approx(want)
    back = one(spark, vector.log_map_zero(vector.exp_map_zero(arr(0.3, -0.2))))
    assert back == pytest.approx([0.3, -0.2])
    assert one(spark, vector.mobius_add(arr(0, 0), arr(0.3, 0.1))) == pytest.approx([0.3, 0.1])
    assert sum(v * v for v in one(spark, vector.linear(arr(1, 2), [[1.0, 0.0], [0.0, 1.0]]))) == pytest.approx(1)
    assert len(one(spark, vector.fingerprint(arr(1, 2), arr(3), arr(1), arr(0.5)))) == 64


def test_normalisation_of_ties_and_single_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 3.0)], "k string, score double")
    got = {r.k: (r.m, r.p) for r in df.select("k", ranking.minmax("score").alias("m"), ranking.position_percentile([F.col("score"), F.col("k")]).alias("p")).collect()}
    assert got == {"a": (0.0, 0.0), "b": (0.0, 0.5), "c": (1.0, 1.0)}
    single = df.where("k = 'a'").select(ranking.minmax("score").alias("m"), ranking.position_percentile([F.col("score")]).alias("p")).first()
    assert (single.m, single.p) == (1.0, 0.5)


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 100), (2, 300), (3, 10)], "k int, tokens int")
    got = {r.k: r.taken_tokens for r in ranking.fill_budget(df, [F.col("k")], "tokens", 300).collect()}
    assert got == {1: 100, 2: 150}


def test_cut_text(spark):
    t = "One sentence here. " * 3 + "tail"
    assert one(spark, ranking.cut_text(F.lit(t), F.lit(10))).endswith(".")
    assert one(spark, ranking.cut_text(F.lit("short"), F.lit(10))) == "short"


def test_scores(spark):
    lit = lambda x: F.lit(float(x))
    want = 0.25 * 0.8 + 0.30 * min(1, math.log1p(3) / 1.8) + 0.15 * 0.5 + 0.10 * 0.6 + 0.20
    assert one(spark, scores.evidence(lit(0.8), lit(3), lit(60), lit(0.6), lit(0), lit(4))) == pytest.approx(want)
    assert one(spark, scores.evidence(lit(0.8), lit(3), lit(60), lit(0.6), lit(4), lit(4))) == 0
    assert one(spark, scores.decay_linear(lit(0.5), lit(6))) == 0.5
    assert one(spark, scores.decay_linear(lit(0.5), lit(10))) == pytest.approx(0.47)
    assert one(spark, scores.decay_linear(lit(0.05), lit(100))) == 0
    assert one(spark, scores.hot(lit(0), lit(3))) == 0
    assert one(spark, scores.recency_bucket(F.lit(None).cast("double"))) == 0.3
    assert one(spark, scores.bandit_adjustment(lit(1), lit(0))) == pytest.approx(0.04)
    assert one(spark, scores.promotion_step(lit(0.7), F.lit(0))) == "promote"
    assert one(spark, scores.source_diversity(lit(1), lit(5))) == 0.5
    assert one(spark, scores.success_rate(lit(0), lit(0))) == 0.5
    assert one(spark, scores.adaptive_threshold(lit(0.5), lit(1), lit(10))) == pytest.approx(0.55)
    assert one(spark, scores.legacy_tier(lit(0.8))) == "promoted"
    edge = F.array(F.struct(F.lit("SUPPORTS").alias("type"), lit(1).alias("weight"), lit(0.5).alias("confidence")))
    assert one(spark, scores.path_score(lit(0.5), edge, F.lit(1), lit(0), F.lit(0))) == pytest.approx(0.85)


def test_text_functions(spark):
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1
    assert set(one(spark, text.trigrams(F.lit("cat")))) == {"  c", " ca", "cat", "at "}
    assert one(spark, text.first_match(F.lit("Do you remember it?"), text.MODES_V1, "factual")) == "assistant_memory"
    assert one(spark, text.first_match(F.lit("nginx 1.2"), text.MODES_V1, "factual")) == "factual"
    assert one(spark, text.best_state(F.lit("There is an error, please debug the stack trace"))) == "debugging"
    assert one(spark, text.best_state(F.lit("xyz"))) == "idle"
    assert one(spark, text.clean_page_text(F.lit("hyphen-\nated ﬁle\n\n\n\n12\nend"))) == "hyphenated file\n\nend"
    assert one(spark, text.mime_type(F.lit("a/b.MD"))) == "text/markdown"


def test_graph_operators(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hop) for r in graph.neighbourhood(edges, "a", "b", seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert [r.node for r in graph.shortest_path(edges, "a", "b", "a", "d").orderBy("place").collect()] == ["a", "b", "c", "d"]
    assert graph.shortest_path(edges, "a", "b", "a", "y").count() == 0
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    ranks = {r.node: r["rank"] for r in graph.page_rank(edges.toDF("src", "dst"), 20).collect()}
    assert sum(ranks.values()) == pytest.approx(1)
    assert ranks["d"] > ranks["a"]


def test_components_match_a_union_find(spark):
    import random

    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, k) for k in range(100, 160)]
    up = list(range(300))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert all(c == top(n) for n, c in got.items())
    assert set(got) == {n for a, b in pairs if a != b for n in (a, b)}


def test_similar_pairs_match_brute_force(spark):
    rows = [(i, "g", n) for i, n in enumerate(["alpha beta", "alpha betta", "gamma", "gama", "alpha beta gamma", "gamma ray", None, ""])]
    df = spark.createDataFrame(rows, "k int, g string, name string")
    got = {(r.a, r.b) for r in relational.similar_pairs(df, "k", ["g"], "name", 0.3).collect()}

    def tri(s):
        return {("  " + w + " ")[i : i + 3] for w in s.split() for i in range(len(w) + 1)}

    live = [(i, tri(n)) for i, _, n in rows if n]
    want = {(a, b) for a, x in live for b, y in live if a < b and len(x & y) / len(x | y) > 0.3}
    assert got == want


def test_web_query(spark):
    df = spark.createDataFrame([(1, "night cycle stopped"), (2, "cycle of night"), (3, "recall of drift")], "k int, t string")
    find = lambda q: {r.k for r in df.where(search.web_query(F.col("t"), q)).collect()}
    assert find('"night cycle"') == {1}
    assert find("night OR drift") == {1, 2, 3}
    assert find("cycle -stopped") == {2}


def test_routing(spark):
    from lorecast.functions import routing

    q = lambda t: F.lit(t)
    assert one(spark, routing.intent(q("Please fix the bug, the build is broken"))) == "debugging"
    assert one(spark, routing.intent(q("hello"))) == "default"
    assert one(spark, routing.primary_index(q("why did it stop"))) == "causal"
    weights = one(spark, routing.index_weights(q("why did it stop")))
    assert sum(weights.values()) == pytest.approx(1)
    assert one(spark, routing.temporal_hint(q("the latest run"))) == "recent"
    ids = lambda *xs: F.array(*[F.lit(x) for x in xs])
    assert one(spark, routing.feedback(q("that's wrong"), ids("a"), ids("a"))).outcome == "corrected"
    assert one(spark, routing.feedback(q("next question"), ids("a"), ids("a"))).outcome == "used"
    assert one(spark, routing.supports(q("a b c d"), q("A b c. D")))
    assert one(spark, routing.contradicts(q("the disk is full"), q("The disk is not full")))
    assert not one(spark, routing.contradicts(q("the disk is not full"), q("The disk is not full")))
    assert len(one(spark, routing.space_weights(q("planning")))) == 6
