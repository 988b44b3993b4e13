"""Findings of round 2."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lorecast.operators import graph
from lorecast.operators import phases as P
from lorecast.streaming import sessions

FOLDER = "/root/testdata/sf0.001"


def test_drained_rows_are_files_and_not_a_table_in_the_driver(spark, tmp_path):
    got = sessions.drain(sessions.session_windows(sessions.read_events(spark, FOLDER)), "t_files", str(tmp_path / "c"))
    assert got.inputFiles() and got.count() > 0
    assert not spark.catalog.tableExists("t_files")
    none = sessions.drain(sessions.session_windows(sessions.read_events(spark, FOLDER).where("false")), "t_none", str(tmp_path / "d"))
    assert none.columns == got.columns and none.count() == 0


@pytest.mark.parametrize("least", [0.3, 0.5, 0.7, 0.75])
def test_repeats_of_small_and_large_sets(spark, least):
    rng = random.Random(3)
    sets = [rng.sample("abcdefghijklmnop", 9 + i % 5) if i % 2 else rng.choices("abcdefg", k=i % 8) for i in range(120)] + [["a", None], ["a", None, "b"]]
    new, known = sets[::2] + sets[1::4], sets[1::2] + sets[::4]
    df = lambda rows: spark.createDataFrame(list(enumerate(rows)), "k int, w array<string>")
    far = lambda a, b: not a or not b or len(set(a) & set(b)) / len(set(a) | set(b)) <= least
    want = [i for i, a in enumerate(new) if all(far(a, b) for b in known)]
    assert sorted(r.k for r in P.without_repeats(df(new), "k", "w", df(known), least).collect()) == want


def test_repeats_of_few_words_are_not_compared_pair_by_pair(spark):
    """All sets share their first words, so a join by words compares 288 million pairs; a join by subsets compares none."""
    df = lambda odd: spark.range(12000).select("id", F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.concat(F.lit("x"), "id"), F.concat(F.lit("y"), 2 * F.col("id") + odd)).alias("w"))
    began = time.monotonic()
    assert P.without_repeats(df(1), "id", "w", df(0)).count() == 12000
    assert time.monotonic() - began < 25


def test_fingerprints_of_any_graph_across_blocks(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(60) * 10**15 - 7, rng.randrange(60) * 10**15 - 7) for _ in range(150)}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    kinds = [(n, k) for n in near for k in ("x", "y", "z") if rng.random() < 0.4]
    want = {n: (sum(b == n for _, b in edges), sum(a == n for a, _ in edges), len(set().union(*[near[x] for x in near[n]]) - near[n] - {n}), Counter(k for m, k in kinds if m in near[n])) for n in near}
    some = next(iter(edges))[0]
    want[some] = (want[some][0], want[some][1] + 1, *want[some][2:])
    want[None] = (0, 0, 0, {})
    df = spark.createDataFrame([*edges, (some, None)], "src long, dst long")
    types = spark.createDataFrame([*kinds, (5, "x"), (None, "x")], "node long, kind string")
    for frame, named, block in ((df, types, 60), (df.select(*[F.col(c).cast("string").alias(c) for c in ("src", "dst")]), types.withColumn("node", F.col("node").cast("string")), 10**6)):
        got = {r.node and int(r.node): (r.in_degree, r.out_degree, r.two_hop, r.kinds or {}) for r in graph.fingerprints(frame, named, block).collect()}
        assert got == want


def test_two_hops_shuffle_edges_and_not_paths(spark):
    edges = spark.range(200_000).select((F.col("id") % 40_000).alias("src"), (40_000 + F.pmod(F.xxhash64("id"), F.lit(40_000))).alias("dst"))
    both = edges.union(edges.select("dst", "src")).distinct()
    written = lambda: sum(x.totalShuffleWrite() for x in [spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0)])
    before = written()
    assert graph.two_hop_counts(both).count() > 70_000
    assert written() - before < 60_000_000
