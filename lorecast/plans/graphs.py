"""Registered graph queries and their SQL: parts and suppliers as nodes, provenance as mentions, events as a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecast.io import table
from lorecast.operators import graph as G
from lorecast.plans.components import connected_components


def supply(spark: SparkSession, folder: str) -> DataFrame:
    """Part to supplier edges with a weight (share of quantity), one row per pair."""
    rows = table(spark, folder, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return rows.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), "n", (F.col("q") / 500).alias("weight"))


def seeds(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


def neighbours2(s: SparkSession, d: str) -> DataFrame:
    return G.neighbourhood(supply(s, d), "src", "dst", seeds(s, "s1", "s2"), 2)


def explore4(s: SparkSession, d: str) -> DataFrame:
    return G.neighbourhood(supply(s, d), "src", "dst", seeds(s, "s3"), 4).groupBy("hop").agg(F.count("*").alias("n"))


def shortest_path(s: SparkSession, d: str) -> DataFrame:
    return G.shortest_path(supply(s, d), "src", "dst", "s1", "s7")


def fingerprint(s: SparkSession, d: str) -> DataFrame:
    """Parts are even numbers and suppliers odd ones until the end, as numbers take less to send than names."""
    number = lambda c, odd: (2 * F.col(c) + odd).cast("bigint")
    edges = table(s, d, "lineitem").select(number("l_partkey", 0).alias("src"), number("l_suppkey", 1).alias("dst")).distinct()
    types = table(s, d, "part").select(number("p_partkey", 0).alias("node"), F.substring("p_brand", 1, 7).alias("kind")).unionByName(
        table(s, d, "supplier").select(number("s_suppkey", 1).alias("node"), F.lit("supplier").alias("kind")))
    name = F.concat(F.when(F.pmod("node", F.lit(2)) == 0, "p").otherwise("s"), F.shiftright("node", 1))
    return G.fingerprints(edges, types).select(name.alias("node"), "in_degree", "out_degree", "two_hop", F.size("kinds").alias("n_kinds"))


def fp_similarity(s: SparkSession, d: str) -> DataFrame:
    """Similarity of suppliers by the brands they sell: of each supplier the 20 most similar of all, from 0.3."""
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = li.groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n")).withColumnRenamed("l_suppkey", "s_suppkey")
    return G.most_similar(counts, table(s, d, "supplier"), "s_suppkey", "p_brand", "n").select("a", "b", F.round("similarity", 6).alias("similarity"))


def causal_chain(s: SparkSession, d: str) -> DataFrame:
    edges = supply(s, d)
    both = edges.select("src", "dst", F.round("weight", 6).alias("strength")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.round("weight", 6).alias("strength")))
    return G.strongest_chain(both, seeds(s, "s1", "s2", "s3"), 2, 10)


def provenance_chain(s: SparkSession, d: str) -> DataFrame:
    """For each memory its latest provenance, and the latest of an entity in the same segment."""
    prov = table(s, d, "provenance").dropDuplicates(["provenance_id"]).where("segment_id is not null")
    last = lambda t: prov.where(F.col("target_type") == t).groupBy("target_id" if t == "memory" else "segment_id").agg(F.max(F.struct("created_at", "provenance_id", "segment_id", "target_id")).alias("m"))
    memory = last("memory").select(F.col("target_id").alias("memory_id"), F.col("m.segment_id").alias("segment_id"))
    entity = last("entity").select("segment_id", F.col("m.target_id").alias("entity_id"))
    return memory.join(entity, "segment_id", "left")


def beam_paths(s: SparkSession, d: str) -> DataFrame:
    e = supply(s, d).select("src", "dst", F.lit("USES").alias("type"), "weight", F.lit(0.9).alias("confidence"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight", "confidence"))
    anchors = s.createDataFrame([("s1", 1.0), ("s2", 0.9)], "node string, score double")
    return G.beam(both, anchors, 2, 20, 5).select(F.array_join("path", ">").alias("path"), F.round("score", 6).alias("score"))


def components(s: SparkSession, d: str) -> DataFrame:
    """Components of entities that share segments."""
    prov = table(s, d, "provenance").where("target_type = 'entity' and segment_id is not null")
    edges = prov.select(F.col("target_id").alias("a"), F.concat(F.lit("#"), "segment_id").alias("b"))
    found = connected_components(edges)
    return found.where("node not like '#%'").groupBy("component").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("components"))


def page_rank(s: SparkSession, d: str) -> DataFrame:
    return G.page_rank(supply(s, d).select("src", "dst"), 3).select("node", F.round("rank", 12).alias("r")).orderBy(F.col("r").desc(), "node").limit(50).select("node", F.round("r", 6).alias("rank"))


def connected_entities(s: SparkSession, d: str) -> DataFrame:
    """Predicted segments: segments of entities that share a segment with the entities of a seed segment."""
    prov = table(s, d, "provenance").where("target_type = 'entity' and segment_id is not null").select("segment_id", "target_id").distinct()
    first = prov.orderBy("segment_id").limit(1).select("segment_id")
    one = prov.join(first, "segment_id", "left_semi").select("target_id").distinct()
    near = prov.join(one, "target_id", "left_semi").select("segment_id").distinct()
    two = prov.join(near, "segment_id", "left_semi").select("target_id").distinct()
    return prov.join(two, "target_id", "left_semi").groupBy("segment_id").agg(F.count("*").alias("support"))


QUERIES = {f.__name__: f for f in (neighbours2, explore4, shortest_path, fingerprint, fp_similarity, causal_chain, provenance_chain, beam_paths, components, page_rank, connected_entities)}

_S = "e0 AS (SELECT 'p' || l_partkey src, 's' || l_suppkey dst, sum(l_quantity) / 500 weight FROM lineitem GROUP BY 1, 2)"
_R = f"{_S}, e AS (SELECT * FROM e0), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def _bfs(start: str, depth: int) -> str:
    return f"{_R}, r AS (SELECT node, 0 hop FROM (VALUES {start}) t(node) UNION SELECT u.dst, r.hop + 1 FROM r JOIN u ON r.node = u.src WHERE r.hop < {depth})"


ORACLE = {
    "neighbours2": f"WITH RECURSIVE {_bfs("('s1'), ('s2')", 2)} SELECT node, min(hop) hop FROM r GROUP BY 1",
    "explore4": f"WITH RECURSIVE {_bfs("('s3')", 4)} SELECT hop, count(*) n FROM (SELECT node, min(hop) hop FROM r GROUP BY 1) GROUP BY 1",
    "fingerprint": f"""WITH {_R}, k AS (SELECT 'p' || p_partkey node, substring(p_brand, 1, 7) kind FROM part UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier),
        n AS (SELECT DISTINCT src node FROM u), f AS (SELECT DISTINCT x.src, y.dst FROM u x JOIN u y ON x.dst = y.src WHERE x.src <> y.dst),
        t AS (SELECT src node, count(*) c FROM (SELECT * FROM f EXCEPT SELECT * FROM u) GROUP BY 1)
        SELECT n.node, (SELECT count(*) FROM e WHERE dst = n.node) in_degree, (SELECT count(*) FROM e WHERE src = n.node) out_degree, coalesce(t.c, 0) two_hop, (SELECT count(DISTINCT kind) FROM u JOIN k ON u.dst = k.node WHERE u.src = n.node)::INT n_kinds
        FROM n LEFT JOIN t USING (node)""",
    "fp_similarity": """WITH c AS (SELECT l_suppkey s, p_brand k, count(*) n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), t AS (SELECT s_suppkey s, coalesce(sum(n), 0) t FROM supplier LEFT JOIN c ON s = s_suppkey GROUP BY 1),
        m AS (SELECT x.s a, y.s b, sum(least(x.n, y.n)) m FROM c x JOIN c y USING (k) GROUP BY 1, 2), f AS (SELECT x.s a, y.s b, CASE WHEN x.t + y.t = 0 THEN 1.0 ELSE coalesce(m, 0) / (x.t + y.t - coalesce(m, 0)) END v FROM t x JOIN t y ON x.s <> y.s LEFT JOIN m ON a = x.s AND b = y.s)
        SELECT a, b, round(v, 6) similarity FROM f WHERE v >= 0.3 QUALIFY row_number() OVER (PARTITION BY a ORDER BY v DESC, b) <= 20""",
    "causal_chain": f"""WITH {_S}, b AS (SELECT src, dst, round(weight, 6) w FROM e0 UNION ALL SELECT dst, src, round(weight, 6) FROM e0), t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 10),
        h1 AS (SELECT src root, dst node, max(w) strength FROM t WHERE src IN ('s1', 's2', 's3') GROUP BY 1, 2), h2 AS (SELECT h1.root, t.dst node, max(w) strength FROM h1 JOIN t ON h1.node = t.src GROUP BY 1, 2)
        SELECT root, node, 1 hop, strength FROM h1 WHERE root <> node UNION ALL SELECT root, node, 2, strength FROM h2 WHERE root <> node AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.root = h2.root AND h1.node = h2.node)""",
    "provenance_chain": """WITH p AS (SELECT DISTINCT ON (provenance_id) * FROM provenance WHERE segment_id IS NOT NULL), m AS (SELECT target_id memory_id, arg_max(segment_id, (created_at, provenance_id)) segment_id FROM p WHERE target_type = 'memory' GROUP BY 1),
        x AS (SELECT segment_id, arg_max(target_id, (created_at, provenance_id)) entity_id FROM p WHERE target_type = 'entity' GROUP BY 1) SELECT segment_id, memory_id, entity_id FROM m LEFT JOIN x USING (segment_id)""",
    "beam_paths": f"""WITH {_R}, w AS (SELECT src, dst, 0.6 * weight * 0.9 g FROM e UNION ALL SELECT dst, src, 0.6 * weight * 0.9 FROM e), t AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY src ORDER BY g DESC, dst) <= 5),
        p0 AS (SELECT ['s1'] path, 1.0::DOUBLE score UNION ALL SELECT ['s2'], 0.9), p1 AS (SELECT list_append(path, dst) path, greatest(0.0, score + g - 0.15) score FROM p0 JOIN t ON src = path[-1] WHERE NOT list_contains(path, dst) ORDER BY score DESC, path LIMIT 20),
        p2 AS (SELECT list_append(path, dst) path, greatest(0.0, score + g - 0.15) score FROM p1 JOIN t ON src = path[-1] WHERE NOT list_contains(path, dst) ORDER BY score DESC, path LIMIT 20)
        SELECT array_to_string(path, '>') path, round(score, 6) score FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2) ORDER BY score DESC, path LIMIT 20""",
    "shortest_path": f"""WITH RECURSIVE {_R}, r AS (SELECT 's1' node, ['s1'] path UNION ALL SELECT node, path FROM (SELECT u.dst node, min(list_append(r.path, u.dst)) path FROM r JOIN u ON r.node = u.src WHERE len(r.path) < 3 GROUP BY 1))
        SELECT (unnest(range(len(path))))::INT place, unnest(path) node FROM (SELECT path FROM r WHERE node = 's7' ORDER BY len(path), path LIMIT 1)""",
    "page_rank": f"""WITH {_R}, n AS (SELECT DISTINCT src node FROM u), o AS (SELECT src, count(*) k FROM e GROUP BY 1), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) r FROM n)"""
    + "".join(f""", r{i} AS (SELECT n.node, 0.15 / (SELECT count(*) FROM n) + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE node NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM n) + 0.85 * coalesce(g, 0) r
        FROM n LEFT JOIN (SELECT dst node, sum(r / k) g FROM e JOIN o USING (src) JOIN r{i - 1} x ON x.node = e.src GROUP BY 1) USING (node))""" for i in (1, 2, 3))
    + " SELECT node, round(round(r, 12), 6) rank FROM r3 ORDER BY round(r, 12) DESC, node LIMIT 50",
    "connected_entities": """WITH p AS (SELECT DISTINCT segment_id s, target_id t FROM provenance WHERE target_type = 'entity' AND segment_id IS NOT NULL), a AS (SELECT t FROM p WHERE s = (SELECT min(s) FROM p)), b AS (SELECT DISTINCT s FROM p WHERE t IN (SELECT t FROM a)), c AS (SELECT DISTINCT t FROM p WHERE s IN (SELECT s FROM b))
        SELECT s segment_id, count(*) support FROM p WHERE t IN (SELECT t FROM c) GROUP BY 1""",
}
