"""Queries that once did a part of the job: whole tables, checked against plain Python or SQL of the whole."""

from __future__ import annotations

import re
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorecast.functions import extraction
from lorecast.llm.personal import find_items
from lorecast.operators import graph, memory
from lorecast.operators.relational import ranked
from lorecast.plans import graphs, relational, texts

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def near():
    """Neighbours of each node of the whole graph of parts and suppliers."""
    out = defaultdict(set)
    for a, b in duckdb.sql(f"SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM '{FOLDER}/lineitem.parquet'").fetchall():
        out[a].add(b)
        out[b].add(a)
    return out


def hops(near, seeds, depth):
    seen = dict.fromkeys(seeds, 0)
    for hop in range(1, depth + 1):
        for node in [n for n, h in seen.items() if h == hop - 1]:
            for x in near[node]:
                seen.setdefault(x, hop)
    return seen


def test_hops_are_those_of_the_whole_graph(spark, near):
    assert {r.node: r.hop for r in graphs.neighbours2(spark, FOLDER).collect()} == hops(near, ["s1", "s2"], 2)
    want = pd.Series(hops(near, ["s3"], 4)).value_counts().to_dict()
    assert {r.hop: r.n for r in graphs.explore4(spark, FOLDER).collect()} == want
    path = [r.node for r in graphs.shortest_path(spark, FOLDER).orderBy("place").collect()]
    assert path[0] == "s1" and path[-1] == "s7" and len(path) == hops(near, ["s1"], 6)["s7"] + 1
    assert all(b in near[a] for a, b in zip(path, path[1:], strict=False))


def test_fingerprints_are_those_of_the_whole_graph(spark, near):
    got = {r.node: (r.in_degree, r.out_degree, r.two_hop) for r in graphs.fingerprint(spark, FOLDER).collect()}
    far = {n: len(set().union(*[near[x] for x in near[n]]) - near[n] - {n}) for n in near}
    assert got == {n: (len(near[n]) * (n[0] == "s"), len(near[n]) * (n[0] == "p"), far[n]) for n in near}


def test_two_hop_counts_across_blocks(spark):
    edges = {(f"n{i}", f"n{i * i % 17}") for i in range(40)} | {("n0", f"n{i}") for i in range(20, 40)}
    both = {(a, b) for x, y in edges for a, b in ((x, y), (y, x))}
    near = defaultdict(set)
    for a, b in both:
        near[a].add(b)
    want = {n: len(set().union(*[near[x] for x in near[n]]) - near[n] - {n}) for n in near}
    got = graph.two_hop_counts(spark.createDataFrame(sorted(both), "src string, dst string"), 7)
    assert {r.node: r.two_hop for r in got.collect()} == {n: k for n, k in want.items() if k}


def test_paths_and_ranks_use_the_whole_graph(spark, near):
    first = near["s1"] | near["s2"]
    rows = graphs.beam_paths(spark, FOLDER).collect()
    weight = {frozenset(r[:2]): r[2] for r in duckdb.sql(f"SELECT 'p' || l_partkey, 's' || l_suppkey, sum(l_quantity) / 500 FROM '{FOLDER}/lineitem.parquet' GROUP BY 1, 2").fetchall()}
    assert any(weight[frozenset(r.path.split(">")[-2:])] <= 0.15 for r in rows if ">" in r.path)
    assert all(r.path.split(">")[1] in first for r in rows if ">" in r.path)
    ranks, n = dict.fromkeys(near, 1 / len(near)), len(near)
    for _ in range(3):
        loose = sum(v for k, v in ranks.items() if k[0] == "s")
        got = defaultdict(float)
        for k, v in ranks.items():
            for x in near[k] if k[0] == "p" else ():
                got[x] += v / len(near[k])
        ranks = {k: 0.15 / n + 0.85 * loose / n + 0.85 * got[k] for k in near}
    best = sorted(((k, round(v, 12)) for k, v in ranks.items()), key=lambda x: (-x[1], x[0]))[:50]
    assert {r.node: r["rank"] for r in graphs.page_rank(spark, FOLDER).collect()} == pytest.approx({k: v for k, v in best}, abs=2e-6)


def test_similarity_compares_every_supplier(spark):
    rows = duckdb.sql(f"SELECT l_suppkey, p_brand, count(*) FROM '{FOLDER}/lineitem.parquet' JOIN '{FOLDER}/part.parquet' ON l_partkey = p_partkey GROUP BY 1, 2").fetchall()
    names = [r[0] for r in duckdb.sql(f"SELECT s_suppkey FROM '{FOLDER}/supplier.parquet'").fetchall()]
    counts = defaultdict(dict)
    for node, key, n in rows:
        counts[node][key] = n

    def score(a, b):
        x, y = counts[a], counts[b]
        most = sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)
        return sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y) / most if most else 1.0

    want = {}
    for a in names:
        near = sorted(((-score(a, b), b) for b in names if b != a and score(a, b) >= 0.3))[:20]
        want |= {(a, b): round(-x, 6) for x, b in near}
    assert {(r.a, r.b): r.similarity for r in graphs.fp_similarity(spark, FOLDER).collect()} == pytest.approx(want, abs=1e-6)
    small = spark.createDataFrame([(i, k, i % 3 + k % 2 + 1) for i in range(12) for k in range(i % 5)], "node int, k int, n int")
    nodes = spark.createDataFrame([(i,) for i in range(14)], "node int")
    runs = [{tuple(r) for r in graph.most_similar(small, nodes, "node", "k", "n", 0.3, 3, block).collect()} for block in (100, 3)]
    assert runs[0] == runs[1] and (12, 0, 1.0) in runs[0]


def test_leaders_are_shared_by_a_whole_tenant(spark):
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(40, 8))[rng.integers(0, 40, 1500)] + 0.2 * rng.normal(size=(1500, 8))).tolist()
    names = [f"m{i:05d}" for i in rng.permutation(1500)]
    df = spark.createDataFrame([("t" if i % 5 else None, n, v) for i, (n, v) in enumerate(zip(names, x, strict=True))], "tenant string, id string, v array<double>")
    want = {}
    for tenant in ("t", None):
        rows = sorted((n, np.array(v) / np.linalg.norm(v)) for i, (n, v) in enumerate(zip(names, x, strict=True)) if (i % 5 > 0) == (tenant == "t"))
        leaders = []
        for n, v in rows:
            score, _, one = max(((float(u @ v), -j, g) for j, (u, g) in enumerate(leaders) if len(g) < 50), default=(-1, 0, None), key=lambda s: s[:2])
            if score < 0.8:
                leaders.append((v, one := []))
            one.append(n)
            want[n] = one[0]
    assert {r.member: r.leader for r in memory.leader_clusters(df, "tenant", "id", "v").collect()} == want


def test_claims_of_every_sentence(spark):
    row = spark.range(1).select(F.transform(extraction.sentences(F.lit("The store uses a major disk, a full one. It is not empty!  Ann was here in June 2021")), extraction.claim).alias("c")).first()
    assert [(c.subject, c.predicate, c.modality, c.qualifiers, c.temporal_scope) for c in row.c] == [
        ("The store", "uses", "asserted", ["major", "full"], None), ("It", "is", "negated", [], None), ("Ann", "was", "asserted", [], "in June 2021")]
    memories = duckdb.sql(f"SELECT min(normalized_text) FROM '{FOLDER}/assistant_memories.parquet' WHERE normalized_text IS NOT NULL GROUP BY memory_id").fetchall()
    assert texts.claims_spo(spark, FOLDER).count() == sum(bool(x.strip()) for (t,) in memories for x in re.split(r"(?<=[.!?])\s", t))


def test_spearman_ranks_all_customers(spark):
    want = duckdb.sql(f"""WITH o AS (SELECT o_custkey k, count(*) n, sum(o_totalprice) v FROM '{FOLDER}/orders.parquet' GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY n DESC, k) x, row_number() OVER (ORDER BY v DESC, k) y FROM o)
        SELECT count(*), 1 - 6 * sum((x - y) * (x - y)) / (count(*) * (count(*) * count(*) - 1)) FROM r""").fetchall()[0]
    assert tuple(relational.spearman(spark, FOLDER).first()) == pytest.approx(want, abs=1e-6)
    rows = [(i, i * 7919 % 1000) for i in range(5000)]
    got = {r.k: r.r for r in ranked(spark.createDataFrame(rows, "k int, v int"), "k", "v", "r").collect()}
    assert got == {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("Er wohnt Unter den Linden 77 in Berlin.", "address", "Unter den Linden 77"), ("Is it 12 Oak Street?", "address", "12 Oak Street"), ('"12 Oak Lane"', "address", "12 Oak Lane"),
    ("DNI: 12345678Z", "idno", "12345678Z"), ("Write to jane at host (dot) org today.", "email", "jane at host (dot) org"), ("Write to jane@host.museum today.", "email", "jane@host.museum"),
])
def test_no_search_for_personal_data_is_switched_off(text, kind, found):
    assert (kind, found) in {(k, text[a:b]) for a, b, k, _ in find_items(text)}
