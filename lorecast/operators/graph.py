"""Graph operators over edge lists. Frontiers and paths are DataFrames; each hop is one equi-join, cut from its lineage.

Only the number of rows of a frontier reaches the driver. Depths are bounded as parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from lorecast.functions.scores import RELATION_PRIORS, lookup
from lorecast.operators.relational import undirected
from lorecast.plans.materialize import cut


def neighbourhood(edges: DataFrame, a: str, b: str, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, hop): nodes within `depth` undirected hops of the seeds (node), with the least number of hops."""
    both = undirected(edges, a, b)
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, depth + 1):
        step = front.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, a: str, b: str, start: str, goal: str, depth: int = 6) -> DataFrame:
    """(place, node) of one shortest undirected path, the smallest by node names; no rows beyond `depth` hops."""
    both = undirected(edges, a, b).distinct()
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    front = seen
    for _ in range(depth):
        if not front.where(F.col("node") == goal).isEmpty():
            break
        step = front.join(both, F.col("node") == F.col("src")).groupBy(F.col("dst")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = cut(step.select(F.col("dst").alias("node"), "path").join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return front.where(F.col("node") == goal).select(F.posexplode("path").alias("place", "node"))


#: Numbers of an edge piece that a task sends at once, and edges (each way) of a block of nodes.
_PIECE, _BLOCK = 1_000_000, 6_000_000
_PACK = "names binary, out binary, into binary, ends binary, near binary, code binary, kinds array<string>, typed binary, kind binary"


def _bytes(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(x).tobytes() for x in arrays]


def _narrow(x: np.ndarray) -> bytes:
    """Numbers as their least one and offsets of four or eight bytes."""
    low = int(x.min())
    wide = int(x.max()) - low >= 1 << 32
    return np.int64(low).tobytes() + (x - low).astype(np.uint64 if wide else np.uint32).tobytes() + bytes([wide])


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b[8:-1], np.uint64 if b[-1] else np.uint32).astype(np.int64) + np.frombuffer(b[:8], np.int64)[0]


def _deal(blocks: int, typed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deals edges, or (node, kind) rows, to the blocks of their nodes: pieces (block, way, a, b, kinds) of many at once."""

    def pieces(a: np.ndarray, other: np.ndarray, way: int) -> Iterator[tuple]:
        of = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(blocks)
        order = np.argsort(of, kind="stable")
        a, other, cuts = a[order], other[order], np.searchsorted(of[order], np.arange(blocks + 1, dtype=np.uint64))
        for r, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if y > x:
                yield (r, way, _narrow(a[x:y]), b"", other[x:y].tolist()) if typed else (r, way, _narrow(a[x:y]), _narrow(other[x:y]), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                n += batch.num_rows
            if n and (batch is None or n >= _PIECE):
                a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                rows = [*pieces(a, b, 0), *(() if typed else pieces(b, a, 1))]
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["r", "way", "a", "b", "kinds"])
                held, n = [], 0

    return run


def _codes(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, and the place of each; with less memory than np.unique takes for both."""
    whole = np.concatenate(parts)
    parts.clear()
    names = np.unique(whole)
    return names, np.concatenate([np.searchsorted(names, part).astype(np.int32) for part in np.array_split(whole, len(whole) // _PIECE + 1)])


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a block, sorted, with their degrees, their distinct neighbours as codes, and their kinds."""
    edges = group[group["way"] < 2]
    a = [_wide(x) for x in edges["a"]]
    if not a:
        return pd.DataFrame(columns=[c.split()[0] for c in _PACK.split(", ")])
    out = np.repeat(edges["way"].to_numpy() == 0, [len(x) for x in a])
    names, a = _codes(a)
    near, b = _codes([_wide(x) for x in edges["b"]])
    degree = [np.bincount(a[way], minlength=len(names)) for way in (out, ~out)]
    both = a.astype(np.int64)
    del a
    both *= len(near)
    both += b
    del b
    both.sort()
    both = both[np.append(True, both[1:] != both[:-1])]
    ends = np.cumsum(np.bincount(both // len(near), minlength=len(names)))
    types = group[group["way"] == 2]
    typed = np.concatenate([np.zeros(0, np.int64), *map(_wide, types["a"])])
    at = np.minimum(np.searchsorted(names, typed), len(names) - 1)
    kind, kinds = pd.factorize(np.array([k for some in types["kinds"] for k in some], dtype=object))
    held = (names[at] == typed) & (kind >= 0)
    row = [*_bytes(names, *degree, ends, near, (both % len(near)).astype(np.int32)), list(kinds), *_bytes(at[held].astype(np.int32), kind[held].astype(np.int32))]
    return pd.DataFrame([row], columns=[c.split()[0] for c in _PACK.split(", ")])


def _at(names: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of sorted numbers in sorted names; the number of names for those that aren't there."""
    at = np.searchsorted(names, asked)
    at[at < len(names)] = np.where(names[at[at < len(names)]] == asked[at < len(names)], at[at < len(names)], len(names))
    return at


def _meet(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """For the nodes of one block: how many nodes of another are two hops away, and the kinds of their neighbours in it."""
    get = lambda c, kind=np.int64: np.frombuffer(row.column(c)[0].as_buffer(), kind)
    names, ends, near, code = get("names"), get("ends"), get("near"), get("code", np.int32)
    there, theirs, shared, other = get("names2"), get("ends2"), get("near2"), get("code2", np.int32)
    size, kinds = len(there), row.column("kinds2")[0].as_py()
    # the other block by the nodes in the middle
    stops = np.cumsum(np.bincount(other, minlength=len(shared)))
    starts = np.append(stops - np.diff(stops, prepend=0), 0)
    by = other.astype(np.int64)
    by <<= 32
    by |= np.repeat(np.arange(size, dtype=np.int32), np.diff(theirs, prepend=0))
    by.sort()
    cols = by.astype(np.int32)  # the lower half
    del by
    middle = _at(shared, near)
    starts, stops = starts[middle], np.append(stops, 0)[middle]
    # direct neighbours in the other block
    of = _at(there, near).astype(np.int32)[code]
    edge = np.flatnonzero(of < size)
    of = of[edge]
    first, far, own = np.searchsorted(edge, ends).tolist(), np.zeros(len(names), np.int64), _at(there, names).astype(np.int32)
    home = own < size
    begin = start = 0
    for i, (end, stop) in enumerate(zip(ends.tolist(), first, strict=True)):
        ks = code[begin:end]
        begin = end
        some = [cols[x:y] for x, y in zip(starts[ks].tolist(), stops[ks].tolist(), strict=True) if y > x]
        if some:
            # what is near counts in and is taken off again
            off = of[start:stop]
            if home[i] and own[i] not in off:
                off = np.append(off, own[i])
            one = np.concatenate([*some, off])
            one.sort()
            far[i] = np.count_nonzero(one[1:] != one[:-1]) + 1 - len(off)
        start = stop
    typed, kind = get("typed2", np.int32), get("kind2", np.int32)
    kind = kind[np.argsort(typed, kind="stable")]
    held = np.bincount(typed, minlength=size)  # kinds of each node there
    many = held[of]
    node = np.repeat(np.searchsorted(ends, edge, "right"), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat((np.cumsum(held) - held)[of], many)
    keys, n = np.unique(node * np.int64(max(1, len(kinds))) + kind[place], return_counts=True)
    zero = lambda k: pa.array(np.zeros(k, np.int64))
    at_home = names[:1].tolist() == there[:1].tolist()  # each pair of blocks is met once: degrees count at their own
    columns = ["id", "kind", "n", "two", "out", "into"]
    degrees = [pa.array(get(c)) if at_home else zero(len(names)) for c in ("out", "into")]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.nulls(len(names), pa.string()), zero(len(names)), pa.array(far), *degrees], columns)
    if len(keys):
        of = pa.array(kinds, pa.string()).take(pa.array(keys % len(kinds)))
        yield pa.RecordBatch.from_arrays([pa.array(names[keys // len(kinds)]), of, pa.array(n), zero(len(keys)), zero(len(keys)), zero(len(keys))], columns)


def _neighbours(edges: DataFrame, types: DataFrame, block: int) -> DataFrame:
    """(id, kind, n, two, out, into), several rows a node to be added up, of edges (src, dst) and types (node, kind) by long keys.

    Nodes are dealt to blocks of about `block` edges. A block is one row: its nodes and their neighbours as numbers. Each pair of blocks
    is met by a task that reads both from where they are stored, so only the edges and the sums are shuffled, never paths.
    """
    edges = edges.where("src is not null and dst is not null").select("src", "dst")
    blocks = max(1, -(-2 * edges.count() // block))
    piece = "r int, way int, a binary, b binary, kinds array<string>"
    dealt = edges.mapInArrow(_deal(blocks, False), piece)
    if types is not None:
        kinds = types.where("node is not null and kind is not null").select("node", "kind")
        dealt = dealt.unionByName(kinds.mapInArrow(_deal(blocks, True), piece).withColumn("way", F.lit(2)))
    packs = cut(dealt.groupBy("r").applyInPandas(_pack, _PACK))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _meet(batch.slice(i, 1))

    pairs = packs.hint("shuffle_replicate_nl").crossJoin(packs.toDF(*[f"{c}2" for c in packs.columns]))
    return pairs.mapInArrow(meet, "id bigint, kind string, n bigint, two bigint, out bigint, into bigint")


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges (src, dst) by long keys, and the (node, id) that name them; nodes that are long numbers are their own keys."""
    if edges.schema["src"].dataType == edges.schema["dst"].dataType == LongType():
        return edges.select("src", "dst"), None
    nodes = cut(undirected(edges, "src", "dst").select(F.col("src").alias("node")).where("node is not null").distinct().withColumn("id", F.monotonically_increasing_id()))
    ids = edges.join(nodes.select(F.col("node").alias("src"), F.col("id").alias("a")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("id").alias("b")), "dst")
    return ids.select(F.col("a").alias("src"), F.col("b").alias("dst")), nodes


def two_hop_counts(both: DataFrame, block: int = _BLOCK) -> DataFrame:
    """(node, two_hop): distinct nodes two hops away that are neither the node nor next to it, of distinct (src, dst) in both directions."""
    edges, nodes = _numbered(both)
    found = _neighbours(edges, None, block).groupBy("id").agg(F.sum("two").alias("two_hop")).where("two_hop > 0")
    return found.withColumnRenamed("id", "node") if nodes is None else found.join(nodes, "id").select("node", "two_hop")


def fingerprints(edges: DataFrame, types: DataFrame, block: int = _BLOCK) -> DataFrame:
    """(node, in_degree, out_degree, two_hop, kinds): of (src, dst, type) edges and (node, kind) nodes.

    `kinds` counts the kinds of direct neighbours, `two_hop` the nodes two hops away that are neither the node nor next to it. Nodes that
    are long numbers are cheapest; others are numbered by two joins.
    """
    numbers, nodes = _numbered(edges)
    keyed = types if nodes is None else types.join(nodes, "node").select(F.col("id").alias("node"), "kind")
    rows = _neighbours(numbers, keyed, block)
    rows = rows.withColumnRenamed("id", "node") if nodes is None else rows.join(nodes, "id").drop("id")
    loose = edges.where("src is null or dst is null")  # such edges lead nowhere, but count as degrees
    ends = [loose.select(F.col(c).alias("node"), *[F.when(F.col(c).isNotNull() & F.lit(x), 1).otherwise(0).cast("bigint").alias(n) for n, x in (("out", c == "src"), ("into", c == "dst"))]) for c in ("src", "dst")]
    rows = rows.unionByName(ends[0].unionByName(ends[1]), allowMissingColumns=True)
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    some = rows.repartition("node").groupBy("node", "kind").agg(*[F.sum(c).alias(c) for c in ("n", "two", "out", "into")])
    kinds = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n")))))
    found = some.groupBy("node").agg(F.sum("into").alias("in_degree"), F.sum("out").alias("out_degree"), F.sum("two").alias("two_hop"), kinds.alias("kinds"))
    return found.select("node", z("in_degree"), z("out_degree"), z("two_hop"), "kinds")


def multiset_jaccard(counts: DataFrame, node: str, key: str, n: str, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity): sum of least over sum of greatest counts for given pairs; 1 if both are empty, 0 if one is."""
    one = pairs.join(counts.select(F.col(node).alias("a"), F.col(key).alias("k"), F.col(n).alias("x")), "a").select("a", "b", "k", "x", F.lit(0).alias("y"))
    two = pairs.join(counts.select(F.col(node).alias("b"), F.col(key).alias("k"), F.col(n).alias("y")), "b").select("a", "b", "k", F.lit(0).alias("x"), "y")
    by = one.unionByName(two).groupBy("a", "b", "k").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    found = by.groupBy("a", "b").agg((F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y"))).alias("s"))
    return pairs.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("s", F.lit(1.0)).alias("similarity"))


def fingerprint_similarity(out: DataFrame, into: DataFrame, types: DataFrame, node: str, key: str, n: str, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity): 0.3 of the multiset Jaccard of outgoing edge types, 0.3 of incoming ones, and 0.4 of the types of neighbours."""
    parts = [multiset_jaccard(c, node, key, n, pairs).withColumn("similarity", w * F.col("similarity")) for c, w in ((out, 0.3), (into, 0.3), (types, 0.4))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("a", "b").agg(F.sum("similarity").alias("similarity"))


def most_similar(counts: DataFrame, nodes: DataFrame, node: str, key: str, n: str, least: float = 0.3, most: int = 20, block: int = 2048) -> DataFrame:
    """(a, b, similarity): of each of the nodes the `most` others with the highest multiset Jaccard of at least `least`, ties by b.

    All pairs are compared, as in multiset_jaccard, one matrix a pair of blocks of about `block` nodes; a block keeps its best only.
    """
    kind = nodes.schema[node].dataType.simpleString()
    held = counts.groupBy(node).agg(F.collect_list(key).alias("keys"), F.collect_list(n).alias("ns"))
    rows = cut(nodes.select(node).distinct().join(held, node, "left"))
    blocks = max(1, -(-rows.count() // block))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(node), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    left = rows.select(F.col("part").alias("r"), every.alias("c"), F.lit(True).alias("left"), node, "keys", "ns")
    right = rows.select(every.alias("r"), F.col("part").alias("c"), F.lit(False).alias("left"), node, "keys", "ns")

    def best(group: pd.DataFrame) -> pd.DataFrame:
        a, b = (group[group["left"] == side].sort_values(node, ignore_index=True) for side in (True, False))
        flat = [side[[node, "keys", "ns"]].dropna().explode(["keys", "ns"]).reset_index(names="at") for side in (a, b)]
        total = [np.bincount(f["at"].astype(int), f["ns"].astype(float), len(side)) for f, side in zip(flat, (a, b), strict=True)]
        both = np.zeros((len(a), len(b)))
        by = [{k: (g["at"].to_numpy(int), g["ns"].to_numpy(float)) for k, g in f.groupby("keys")} for f in flat]
        for k in by[0].keys() & by[1].keys():
            (i, x), (j, y) = by[0][k], by[1][k]
            both[i[:, None], j] += np.minimum(x[:, None], y)
        union = total[0][:, None] + total[1] - both
        score = np.where(union > 0, both / np.where(union > 0, union, 1), 1.0)
        out = []
        names = b[node].to_numpy()
        for i, one in enumerate(a[node]):
            kept = np.flatnonzero((score[i] >= least) & (names != one))
            kept = kept[np.argsort(-score[i][kept], kind="stable")[:most]]
            out.append(pd.DataFrame({"a": [one] * len(kept), "b": names[kept], "similarity": score[i][kept]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "similarity": []})

    found = left.unionByName(right).groupBy("r", "c").applyInPandas(best, f"a {kind}, b {kind}, similarity double")
    w = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def strongest_chain(edges: DataFrame, start: DataFrame, depth: int, width: int) -> DataFrame:
    """(root, node, hop, strength): from each start node the `width` strongest edges (src, dst, strength) a hop and node.

    Breadth first: a node is kept at its least hop, with its strongest edge.
    """
    best = Window.partitionBy("src").orderBy(F.col("strength").desc(), "dst")
    top = edges.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= width).drop("_r")
    seen = start.select(F.col("node").alias("root"), "node", F.lit(0).alias("hop"), F.lit(1.0).alias("strength"))
    front = seen
    for hop in range(1, depth + 1):
        step = front.select("root", F.col("node").alias("src")).join(top, "src").groupBy("root", F.col("dst").alias("node")).agg(F.max("strength").alias("strength"))
        front = cut(step.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(hop).alias("hop"), "strength"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def beam(edges: DataFrame, anchors: DataFrame, depth: int = 3, width: int = 20, fanout: int = 12) -> DataFrame:
    """(path, score): the best paths from anchors (node, score) over edges (src, dst, type, weight, confidence).

    Each hop follows the `fanout` best edges of a node and keeps the `width` best paths of all; a path gains prior * weight *
    confidence and loses 0.15 a hop.
    """
    gain = lookup(F.col("type"), RELATION_PRIORS, 0.35) * F.col("weight") * F.col("confidence")
    best = Window.partitionBy("src").orderBy(F.col("gain").desc(), "dst")
    top = edges.select("src", "dst", gain.alias("gain")).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= fanout).drop("_r")
    paths = anchors.select(F.array("node").alias("path"), "score").orderBy(F.col("score").desc(), "path").limit(width)
    whole = front = paths
    for _ in range(depth):
        grown = front.withColumn("src", F.element_at("path", -1)).join(top, "src").where(~F.array_contains("path", F.col("dst")))
        front = cut(grown.select(F.concat("path", F.array("dst")).alias("path"), F.greatest(F.lit(0.0), F.col("score") + F.col("gain") - 0.15).alias("score")).orderBy(F.col("score").desc(), "path").limit(width))
        whole = whole.unionByName(front)
    return whole.orderBy(F.col("score").desc(), "path").limit(width)


def page_rank(edges: DataFrame, rounds: int = 5, damping: float = 0.85) -> DataFrame:
    """(node, rank): PageRank of (src, dst) by joins; nodes without outgoing edges share with all."""
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = cut(edges.join(out, "src"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        loose = ranks.join(out.withColumnRenamed("src", "node"), "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = links.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        base = (1 - damping) / max(n, 1) + damping * loose / max(n, 1)
        ranks = cut(nodes.join(sent, "node", "left").select("node", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return ranks
