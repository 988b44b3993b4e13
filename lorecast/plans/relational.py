"""Registered filters, joins, aggregations, set operations and windows over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.functions import scores as X
from lorecast.io import table
from lorecast.operators import relational as R


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name)


AS_OF = "2001-08-02"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def scan_filter_project(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "orders").where(F.col("o_orderstatus").isin("O", "P") & F.col("o_totalprice").between(1000, 150000) & ~F.col("o_orderpriority").isin("1-URGENT"))
    return rows.select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


def name_search(s: SparkSession, d: str) -> DataFrame:
    p = _t(s, d, "part")
    return p.where(p.p_name.ilike("%e%") & (F.lower("p_brand") == "brand#11")).select("p_partkey", "p_name")


def array_and_json_filters(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "assistant_memories").dropDuplicates(["memory_id"])
    linked = F.from_json("linked_entity_ids", "array<string>")
    return rows.where((F.size(linked) >= 1) & ~F.array_contains(linked, "ENT_none") & F.get_json_object("canonical_form_json", "$.x").isNull()).select("memory_id", F.size(linked).alias("links"))


def credential_flags(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", X.is_credential(F.col("text")).alias("sensitive"))


def bitemporal_filter(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "orders").join(_t(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    keep = R.bitemporal("o_orderdate", "l_shipdate", event=("1996-01-01", "1997-12-31"), ingested=("1996-06-01", "1998-06-30"))
    return rows.where(keep).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def stale_rows(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "assistant_memories").dropDuplicates(["memory_id"])
    return R.stale(rows, F.lit("2025-10-01").cast("timestamp"), days=30).select("memory_id")


def inner_join_topk(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "customer").join(_t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(50).select("c_custkey", "n_name", F.round("c_acctbal", 2).alias("balance"))


def chained_left_joins(s: SparkSession, d: str) -> DataFrame:
    li = _t(s, d, "lineitem").where("l_quantity >= 45")
    rows = li.join(_t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(_t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    rows = rows.join(_t(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("n_name", "p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


def or_join_expand(s: SparkSession, d: str) -> DataFrame:
    """Undirected neighbours of seed parts and suppliers, the OR of two equalities as two equi-joins."""
    edges = _t(s, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()
    seeds = _t(s, d, "supplier").where("s_suppkey <= 5").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return R.undirected_neighbours(edges, "a", "b", seeds)


def anti_unprocessed(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "part").join(_t(s, d, "lineitem").where("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


def semi_processed(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "part").join(_t(s, d, "lineitem").where("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


def provenance_lineage(s: SparkSession, d: str) -> DataFrame:
    """Segments, their provenance and entities: mentions by entity type and extraction method."""
    least = lambda *names: [F.min(c).alias(c) for c in names]  # copies count once, whichever comes first
    prov = _t(s, d, "provenance").where("target_type = 'entity'").groupBy("provenance_id").agg(*least("segment_id", "target_id", "extraction_method", "confidence"))
    ent = _t(s, d, "entities").groupBy("entity_id").agg(*least("entity_type"))
    seg = _t(s, d, "segments").select("segment_id").distinct()
    rows = prov.join(seg, "segment_id").join(ent, F.col("target_id") == F.col("entity_id"))
    return rows.groupBy("entity_type", "extraction_method").agg(F.count("*").alias("n"), F.round(F.sum(F.col("confidence").cast("decimal(20,9)")).cast("double") / F.count("confidence"), 6).alias("confidence"))


def unextracted_segments(s: SparkSession, d: str) -> DataFrame:
    seg = _t(s, d, "segments").where(F.length("text").between(200, 3000) & ~F.col("segment_type").isin("tool_call", "tool_result", "chunk")).select("segment_id").distinct()
    return seg.join(_t(s, d, "provenance").where("segment_id is not null"), "segment_id", "left_anti")


def lateral_counts(s: SparkSession, d: str) -> DataFrame:
    """Sources by type with their segments counted; sources without segments count 0."""
    seg = _t(s, d, "segments").groupBy("source_id").agg(F.count_distinct("segment_id").alias("n"))
    src = _t(s, d, "sources").select("source_id", "source_type").distinct().join(seg, "source_id", "left")
    return src.groupBy("source_type").agg(F.count("*").alias("sources"), F.sum(F.coalesce("n", F.lit(0))).alias("segments"))


def latest_per_group(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("m"))
    return rows.select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"), F.col("m.o_orderstatus").alias("o_orderstatus"))


def contradictions(s: SparkSession, d: str) -> DataFrame:
    """Claims of one subject and predicate that differ in their object: later against earlier."""
    o = _t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    return R.contradicting(o, "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")


def contradiction_groups(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("objects"), F.count("*").alias("n"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("latest")
    )
    return rows.where(F.col("objects").contains(","))


def similar_names(s: SparkSession, d: str) -> DataFrame:
    """Entities of one type and tenant with similar names: trigram similarity above 0.6, by shared rare trigrams."""
    rows = _t(s, d, "entities").where("canonical_name is not null").groupBy("entity_id").agg(F.min("entity_type").alias("t"), F.min("owner_tenant_id").alias("o"), F.min("canonical_name").alias("name"))
    return R.similar_pairs(rows, "entity_id", ["t", "o"], "name", 0.6)


def table_counts(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "assistant_memories").dropDuplicates(["memory_id"])
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("importance_score") >= 0.5).alias("important"), F.count_if(F.col("last_confirmed_at").isNotNull()).alias("confirmed"))


def tier_breakdown(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "segments").select("segment_id", "storage_tier").distinct()
    return rows.groupBy("storage_tier").agg(F.count("*").alias("n"))


def tier_rollup(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "segments").select("segment_id", "storage_tier", "owner_tenant_id").distinct()
    out = rows.rollup("owner_tenant_id", "storage_tier").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return out


def tenant_stats(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "segments").groupBy("segment_id").agg(F.min("owner_tenant_id").alias("tenant"), F.max(F.col("embedding").isNotNull()).alias("embedded"), F.max(F.length("text")).alias("n"))
    return rows.groupBy("tenant").agg(F.count("*").alias("segments"), F.count_if("embedded").alias("embedded"), F.sum("n").alias("characters"), F.round(F.sum("n") / 1048576, 2).alias("megabytes"))


def op_stats_view(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity"), F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.count_if(F.col("l_tax") > 0.04).alias("taxed"), F.max("l_shipdate").alias("last_ship"),
    )


def union_max(s: SparkSession, d: str) -> DataFrame:
    """The greatest score of each key over two lists, then the top 25."""
    li = _t(s, d, "lineitem")
    a = li.orderBy(F.col("l_quantity").desc(), "l_orderkey", "l_linenumber").limit(200).select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("a"), F.lit(0.0).alias("b"))
    b = li.orderBy(F.col("l_discount").desc(), "l_orderkey", "l_linenumber").limit(200).select(F.col("l_partkey").alias("k"), F.lit(0.0).alias("a"), (F.col("l_discount") * 500).alias("b"))
    best = a.unionByName(b).groupBy("k").agg(F.greatest(F.max("a"), F.max("b")).alias("score"))
    return best.orderBy(F.col("score").desc(), "k").limit(25).select("k", F.round("score", 6).alias("score"))


def degree_centrality(s: SparkSession, d: str) -> DataFrame:
    edges = _t(s, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()
    deg = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return deg.select("node", "degree", F.round(F.least(F.lit(1.0), F.col("degree") / 20), 6).alias("centrality"), F.round(X.log_centrality(F.col("degree")), 6).alias("log_centrality"))


def having_sources(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "segments").groupBy("source_id").agg(F.count_distinct("segment_id").alias("n"), F.count_distinct("segment_type").alias("types"))
    return rows.where(F.col("n").between(5, 500))


def signal_buckets(s: SparkSession, d: str) -> DataFrame:
    signal = X.event_signal(F.col("event_type"))
    kind = F.when(signal > 0, "positive").when(signal < 0, "negative").otherwise("neutral")
    return _t(s, d, "events").groupBy(kind.alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("position")).agg(F.count("*").alias("n"))


def promoted(total: Column, matched: Column, improved: Column, latency: Column, least: int = 100, match: float = 0.70, gain: float = 0.40, slower: float = 2.0) -> Column:
    """Whether a new path may replace the old one: enough comparisons, matches and improvements, and at most `slower` times the time."""
    return (total >= least) & (matched >= match) & (improved >= gain) & (latency <= slower)


def shadow_stats(s: SparkSession, d: str) -> DataFrame:
    """Totals, match share and sums of a comparison log by mode, and whether it may be promoted (by lower thresholds than usual, as the log is of noise)."""
    rows = _t(s, d, "events").groupBy(F.col("event_type").alias("mode")).agg(
        F.count("*").alias("total"), F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 6).alias("match_rate"), F.sum(F.when(F.col("value") > 90, 1).otherwise(0)).alias("improved"))
    return rows.withColumn("promote", promoted(F.col("total"), F.col("match_rate"), F.col("improved") / F.col("total"), F.lit(1.0), match=0.4, gain=0.05))


def hourly_trend(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return rows.orderBy(F.col("hour").desc()).limit(12)


def query_frequency(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "events").where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return rows.orderBy(F.col("n").desc(), "user_id", "event_type").limit(30)


def term_freq(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "documents").where("text is not null").select(F.explode(F.split(F.lower("text"), " ")).alias("term"))
    return rows.where("term <> ''").groupBy("term").agg(F.count("*").alias("n")).where("n > 50")


def bandit(s: SparkSession, d: str) -> DataFrame:
    """Learning from outcomes: each item's signals, their positive and negative means, and the adjustment they give."""
    signal = X.event_signal(F.col("event_type"))
    rows = _t(s, d, "events").select(F.get_json_object("props", "$.k").cast("int").alias("item"), signal.alias("s"))
    by = rows.groupBy("item").agg(F.count("*").alias("n"), F.coalesce(F.avg(F.when(F.col("s") > 0, F.col("s"))), F.lit(0.0)).alias("pos"), F.coalesce(F.avg(F.when(F.col("s") < 0, F.col("s"))), F.lit(0.0)).alias("neg"))
    return by.where("n >= 5").select("item", "n", F.round(X.bandit_adjustment(F.col("pos"), F.col("neg")), 6).alias("adjustment"))


def importance_by_tenant(s: SparkSession, d: str) -> DataFrame:
    """Entity importance from logarithms of mentions, sources and retrievals, each over its maximum in the tenant."""
    rows = _t(s, d, "entities").groupBy("entity_id").agg(*[F.max(c).alias(c) for c in ("owner_tenant_id", "mention_count", "source_count", "retrieval_count", "ambiguity_score")])
    tops = rows.groupBy("owner_tenant_id").agg(*[F.max(c).alias(f"top_{c}") for c in ("mention_count", "source_count", "retrieval_count")])
    rows = rows.join(F.broadcast(tops), "owner_tenant_id")  # tenants are a table of fixed size
    part = lambda c: F.coalesce(F.try_divide(F.log1p(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))), F.log1p(f"top_{c}")), F.lit(0.0))
    score = 0.30 * part("mention_count") + 0.25 * part("source_count") + 0.25 * part("retrieval_count") + 0.20 * (1 - F.coalesce("ambiguity_score", F.lit(0.0)))
    return rows.select("entity_id", F.round(score, 6).alias("importance"))


def cooccurrence_pairs(s: SparkSession, d: str) -> DataFrame:
    """Entities that share segments: support of each pair of at least 2."""
    rows = _t(s, d, "provenance").where("target_type = 'entity' and segment_id is not null").select("segment_id", "target_id").distinct()
    return R.cooccurrence(rows, "segment_id", "target_id", 2)


def spearman(s: SparkSession, d: str) -> DataFrame:
    """Rank correlation of customers' order counts and totals; ranks are positions in the full lists."""
    by = _t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    return R.rank_correlation(by, by, "o_custkey", "n", "v")


def p_at_k(s: SparkSession, d: str) -> DataFrame:
    """Precision at 1, 5, 10 and 20, and the miss rate, over a log of ranks."""
    rank = F.get_json_object("props", "$.k").cast("int")
    rows = _t(s, d, "events").select("event_type", rank.alias("rank"))
    hit = lambda k: F.round(F.avg(F.when(F.col("rank").between(1, k), 1.0).otherwise(0.0)), 6).alias(f"p{k}")
    return rows.groupBy("event_type").agg(*[hit(k) for k in (1, 5, 10, 20)], F.round(F.avg(F.when(F.col("rank") > 20, 1.0).otherwise(0.0)), 6).alias("missed"))


def checksum_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Sources whose checksum an earlier source has, whatever the tenant."""
    rows = _t(s, d, "sources").where("checksum is not null").groupBy("source_id").agg(F.min("checksum").alias("checksum"), F.min("owner_tenant_id").alias("tenant"), F.min("ingested_at").alias("at"))
    first = Window.partitionBy("checksum").orderBy("at", "source_id")
    return rows.withColumn("r", F.row_number().over(first)).where("r > 1").select("source_id", "checksum")


def upsert_latest(s: SparkSession, d: str) -> DataFrame:
    """Last writer wins: of each memory the row of the highest version."""
    rows = _t(s, d, "assistant_memories")
    return R.upsert(rows.where("version <= 2"), rows.where("version > 2"), ["memory_id"], "version").select("memory_id", "version")


def paged_sources(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "sources").select("source_id", "ingested_at").distinct()
    return rows.orderBy(F.col("ingested_at").desc(), "source_id").offset(20).limit(20).select("source_id")


def set_operations(s: SparkSession, d: str) -> DataFrame:
    """Tenants of segments that have or lack entities, by set operations."""
    seg, ent = _t(s, d, "segments").select("owner_tenant_id"), _t(s, d, "entities").select("owner_tenant_id")
    both = seg.intersect(ent).withColumn("side", F.lit("both"))
    only = seg.exceptAll(seg.intersect(ent)).distinct().join(ent, "owner_tenant_id", "left_anti").withColumn("side", F.lit("segments"))
    return both.unionByName(only)


def systematic_sample(s: SparkSession, d: str) -> DataFrame:
    """Every seventh document in order of its hash: a sample that a rerun draws again."""
    rows = _t(s, d, "documents").select("doc_id")
    return rows.where(F.pmod(F.col("doc_id") * 2654435761 % 4294967296, F.lit(7)) == 0)


def trust_scores(s: SparkSession, d: str) -> DataFrame:
    """Trust of extraction methods: share of records believed, disputed ones counting half against."""
    rows = _t(s, d, "provenance").dropDuplicates(["provenance_id"]).groupBy("extraction_method").agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.7).alias("v"), F.count_if(F.col("confidence") < 0.4).alias("x"))
    return rows.select("extraction_method", "n", F.round(X.trust(F.col("v"), F.col("x"), F.col("n")), 6).alias("trust"))


def last_n_context(s: SparkSession, d: str) -> DataFrame:
    """The last five event types of each user up to each event of type error."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _t(s, d, "events").withColumn("context", F.array_join(F.collect_list("event_type").over(w.rowsBetween(-4, 0)), ","))
    return rows.where("event_type = 'error'").select("event_id", "context")


def state_changes(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _t(s, d, "events").withColumn("before", F.lag("event_type").over(w))
    return rows.where(F.col("before").isNull() | (F.col("before") != F.col("event_type"))).select("event_id", "user_id", "before", "event_type")


def sessions_1h(s: SparkSession, d: str) -> DataFrame:
    return R.sessions(_t(s, d, "events"), "user_id", "ts", 3600, "event_id")


QUERIES = {
    f.__name__: f
    for f in (
        scan_filter_project, name_search, array_and_json_filters, credential_flags, bitemporal_filter, stale_rows, inner_join_topk, chained_left_joins, or_join_expand, anti_unprocessed,
        semi_processed, provenance_lineage, unextracted_segments, lateral_counts, latest_per_group, contradictions, contradiction_groups, similar_names, table_counts, tier_breakdown,
        tier_rollup, tenant_stats, op_stats_view, union_max, degree_centrality, having_sources, signal_buckets, shadow_stats, hourly_trend, query_frequency, term_freq, bandit,
        importance_by_tenant, cooccurrence_pairs, spearman, p_at_k, checksum_duplicates, upsert_latest, paged_sources, set_operations, systematic_sample, trust_scores, last_n_context,
        state_changes, sessions_1h,
    )
}

_SIG = "CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.8 WHEN 'view' THEN 0.3 WHEN 'signup' THEN 0.2 WHEN 'error' THEN -1.0 ELSE 0.0 END"
_EDGES = "(SELECT DISTINCT 'p' || l_partkey a, 's' || l_suppkey b FROM lineitem)"
_MEM = "(SELECT memory_id, any_value(status) status, any_value(importance_score) importance_score, any_value(last_confirmed_at) last_confirmed_at, any_value(created_at) created_at, any_value(confirmation_count) confirmation_count, any_value(linked_entity_ids) linked_entity_ids, any_value(canonical_form_json) canonical_form_json FROM assistant_memories GROUP BY 1)"
_PROV = "(SELECT DISTINCT ON (provenance_id) * FROM provenance)"
ORACLE = {
    "scan_filter_project": "SELECT o_orderkey, round(o_totalprice, 2) price FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice BETWEEN 1000 AND 150000 AND o_orderpriority NOT IN ('1-URGENT')",
    "name_search": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%e%' AND lower(p_brand) = 'brand#11'",
    "array_and_json_filters": f"SELECT memory_id, json_array_length(linked_entity_ids)::INT links FROM {_MEM} WHERE json_array_length(linked_entity_ids) >= 1 AND NOT list_contains(from_json(linked_entity_ids, '[\"VARCHAR\"]'), 'ENT_none') AND json_extract(canonical_form_json, '$.x') IS NULL",
    "credential_flags": "SELECT doc_id, regexp_matches(lower(text), 'password|passwd|api key|api_key|apikey|secret|credential|private key|access token|bearer') AS sensitive FROM documents WHERE text IS NOT NULL",
    "bitemporal_filter": "SELECT o_orderstatus, count(*) n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate BETWEEN '1996-01-01' AND '1997-12-31' AND l_shipdate BETWEEN '1996-06-01' AND '1998-06-30' GROUP BY 1",
    "stale_rows": f"SELECT memory_id FROM {_MEM} WHERE status IN ('active', 'provisional', 'confirmed') AND created_at < TIMESTAMPTZ '2025-09-01' AND coalesce(confirmation_count, 0) < 3 AND (last_confirmed_at IS NULL OR last_confirmed_at < TIMESTAMPTZ '2025-09-01')",
    "inner_join_topk": "SELECT c_custkey, n_name, round(c_acctbal, 2) balance FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 50",
    "chained_left_joins": "SELECT n_name, p_brand, count(*) n, round(sum(l_extendedprice), 2) total FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity >= 45 GROUP BY 1, 2",
    "or_join_expand": f"SELECT DISTINCT CASE WHEN a IN (SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey <= 5) THEN b ELSE a END node FROM {_EDGES} WHERE (a IN (SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey <= 5) OR b IN (SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey <= 5))",
    "anti_unprocessed": "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)",
    "semi_processed": "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)",
    "provenance_lineage": f"SELECT entity_type, extraction_method, count(*) n, round(sum(confidence::DECIMAL(20,9))::DOUBLE / count(confidence), 6) confidence FROM (SELECT provenance_id, min(segment_id) segment_id, min(target_id) target_id, min(extraction_method) extraction_method, min(confidence) confidence FROM provenance WHERE target_type = 'entity' GROUP BY 1) p JOIN (SELECT DISTINCT segment_id FROM segments) USING (segment_id) JOIN (SELECT entity_id, min(entity_type) entity_type FROM entities GROUP BY 1) ON target_id = entity_id GROUP BY 1, 2",
    "unextracted_segments": "SELECT DISTINCT segment_id FROM segments s WHERE length(text) BETWEEN 200 AND 3000 AND segment_type NOT IN ('tool_call', 'tool_result', 'chunk') AND NOT EXISTS (SELECT 1 FROM provenance p WHERE p.segment_id = s.segment_id)",
    "lateral_counts": "SELECT source_type, count(*) sources, sum(coalesce(n, 0))::BIGINT segments FROM (SELECT DISTINCT source_id, source_type FROM sources) LEFT JOIN (SELECT source_id, count(DISTINCT segment_id) n FROM segments GROUP BY 1) USING (source_id) GROUP BY 1",
    "latest_per_group": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "contradictions": "SELECT a.o_orderkey earlier, b.o_orderkey later FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderstatus <> b.o_orderstatus AND (a.o_orderdate < b.o_orderdate OR (a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey))",
    "contradiction_groups": "SELECT o_custkey, o_orderpriority, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) objects, count(*) n, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) latest FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) > 1",
    "table_counts": f"SELECT status, count(*) n, count(*) FILTER (WHERE importance_score >= 0.5) important, count(last_confirmed_at) confirmed FROM {_MEM} GROUP BY 1",
    "tier_breakdown": "SELECT storage_tier, count(*) n FROM (SELECT DISTINCT segment_id, storage_tier FROM segments) GROUP BY 1",
    "tier_rollup": "SELECT owner_tenant_id, storage_tier, count(*) n, grouping_id(owner_tenant_id, storage_tier) AS level FROM (SELECT DISTINCT segment_id, storage_tier, owner_tenant_id FROM segments) GROUP BY ROLLUP (owner_tenant_id, storage_tier)",
    "tenant_stats": "SELECT tenant, count(*) segments, count(*) FILTER (WHERE e) embedded, sum(n)::BIGINT characters, round(sum(n) / 1048576, 2) megabytes FROM (SELECT segment_id, min(owner_tenant_id) tenant, bool_or(embedding IS NOT NULL) e, max(length(text)) n FROM segments GROUP BY 1) GROUP BY 1",
    "op_stats_view": "SELECT l_returnflag, l_linestatus, count(*) n, round(avg(l_quantity), 6) avg_quantity, round(avg(l_discount), 6) avg_discount, count(*) FILTER (WHERE l_tax > 0.04) taxed, max(l_shipdate) last_ship FROM lineitem GROUP BY 1, 2",
    "union_max": "WITH u AS ((SELECT l_partkey k, l_quantity a, 0.0 b FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 200) UNION ALL (SELECT l_partkey, 0.0, l_discount * 500 FROM lineitem ORDER BY l_discount DESC, l_orderkey, l_linenumber LIMIT 200)) SELECT k, round(greatest(max(a), max(b)), 6) score FROM u GROUP BY k ORDER BY greatest(max(a), max(b)) DESC, k LIMIT 25",
    "degree_centrality": f"SELECT node, count(*) AS degree, round(least(1.0, count(*) / 20), 6) centrality, round(ln(1 + count(*)) / ln(101), 6) log_centrality FROM (SELECT a node FROM {_EDGES} UNION ALL SELECT b FROM {_EDGES}) GROUP BY 1",
    "having_sources": "SELECT source_id, count(DISTINCT segment_id) n, count(DISTINCT segment_type) types FROM segments GROUP BY 1 HAVING count(DISTINCT segment_id) BETWEEN 5 AND 500",
    "signal_buckets": f"SELECT CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END kind, p AS position, count(*) n FROM (SELECT {_SIG} s, CAST(json_extract_string(props, '$.k') AS INT) p FROM events) GROUP BY 1, 2",
    "shadow_stats": "SELECT *, total >= 100 AND match_rate >= 0.4 AND improved / total >= 0.05 promote FROM (SELECT event_type AS mode, count(*) total, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) match_rate, sum(CASE WHEN value > 90 THEN 1 ELSE 0 END)::BIGINT improved FROM events GROUP BY 1)",
    "hourly_trend": "SELECT date_trunc('hour', ts) AS hour, count(*) n, round(avg(value), 6) mean FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 12",
    "query_frequency": "SELECT user_id, event_type, count(*) n, round(avg(value), 6) mean FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1, 2 ORDER BY n DESC, user_id, event_type LIMIT 30",
    "term_freq": "SELECT term, count(*) n FROM (SELECT unnest(string_split(lower(text), ' ')) term FROM documents WHERE text IS NOT NULL) WHERE term <> '' GROUP BY 1 HAVING count(*) > 50",
    "bandit": f"WITH r AS (SELECT CAST(json_extract_string(props, '$.k') AS INT) item, {_SIG} s FROM events), b AS (SELECT item, count(*) n, coalesce(avg(s) FILTER (WHERE s > 0), 0) p, coalesce(avg(s) FILTER (WHERE s < 0), 0) g FROM r GROUP BY 1 HAVING count(*) >= 5) SELECT item, n, round(greatest(-0.3, least(0.3, (p * 1.0 + g * 1.5) / 2.5 * 0.1)), 6) adjustment FROM b",
    "importance_by_tenant": """WITH e AS (SELECT entity_id, max(owner_tenant_id) t, max(mention_count) m, max(source_count) c, max(retrieval_count) r, max(ambiguity_score) a FROM entities GROUP BY 1), x AS (SELECT t, max(m) tm, max(c) tc, max(r) tr FROM e GROUP BY 1)
        SELECT entity_id, round(0.30 * coalesce(ln(1 + greatest(coalesce(m, 0), 0)) / nullif(ln(1 + tm), 0), 0) + 0.25 * coalesce(ln(1 + greatest(coalesce(c, 0), 0)) / nullif(ln(1 + tc), 0), 0) + 0.25 * coalesce(ln(1 + greatest(coalesce(r, 0), 0)) / nullif(ln(1 + tr), 0), 0) + 0.20 * (1 - coalesce(a, 0)), 6) importance FROM e JOIN x USING (t)""",
    "cooccurrence_pairs": "WITH r AS (SELECT DISTINCT segment_id, target_id t FROM provenance WHERE target_type = 'entity' AND segment_id IS NOT NULL) SELECT a.t a, b.t b, count(*) support FROM r a JOIN r b ON a.segment_id = b.segment_id AND a.t < b.t GROUP BY 1, 2 HAVING count(*) >= 2",
    "spearman": "WITH o AS (SELECT o_custkey k, count(*) n, sum(o_totalprice) v FROM orders GROUP BY 1), a AS (SELECT k, row_number() OVER (ORDER BY n DESC, k) r FROM o), b AS (SELECT k, row_number() OVER (ORDER BY v DESC, k) r FROM o), j AS (SELECT a.r x, b.r y FROM a JOIN b USING (k)) SELECT count(*) n, CASE WHEN count(*) >= 3 THEN round(1 - 6 * sum((x - y) * (x - y)) / (count(*) * (count(*) * count(*) - 1)), 6) END rho FROM j",
    "p_at_k": "SELECT event_type, " + ", ".join(f"round(avg(CASE WHEN r BETWEEN 1 AND {k} THEN 1.0 ELSE 0.0 END), 6) p{k}" for k in (1, 5, 10, 20)) + ", round(avg(CASE WHEN r > 20 THEN 1.0 ELSE 0.0 END), 6) missed FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) r FROM events) GROUP BY 1",
    "checksum_duplicates": "WITH s AS (SELECT source_id, min(checksum) checksum, min(owner_tenant_id) tenant, min(ingested_at) t FROM sources WHERE checksum IS NOT NULL GROUP BY 1) SELECT source_id, checksum FROM s QUALIFY row_number() OVER (PARTITION BY checksum ORDER BY t, source_id) > 1",
    "upsert_latest": "SELECT memory_id, max(version) AS version FROM assistant_memories WHERE version IS NOT NULL GROUP BY 1",
    "paged_sources": "SELECT source_id FROM (SELECT DISTINCT source_id, ingested_at FROM sources) ORDER BY ingested_at DESC, source_id LIMIT 20 OFFSET 20",
    "set_operations": "SELECT owner_tenant_id, 'both' side FROM (SELECT owner_tenant_id FROM segments INTERSECT SELECT owner_tenant_id FROM entities) UNION ALL SELECT owner_tenant_id, 'segments' FROM (SELECT owner_tenant_id FROM segments EXCEPT SELECT owner_tenant_id FROM entities)",
    "systematic_sample": "SELECT doc_id FROM documents WHERE ((doc_id * 2654435761) % 4294967296) % 7 = 0",
    "trust_scores": f"SELECT extraction_method, count(*) n, round(greatest(0, least(1, 0.5 * (count(*) FILTER (WHERE confidence >= 0.7) - 0.5 * count(*) FILTER (WHERE confidence < 0.4)) / count(*) + 0.5)), 6) trust FROM {_PROV} GROUP BY 1",
    "last_n_context": "SELECT event_id, context FROM (SELECT event_id, event_type, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') context FROM events) WHERE event_type = 'error'",
    "state_changes": "SELECT event_id, user_id, before, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) before FROM events) WHERE before IS NULL OR before <> event_type",
    "sessions_1h": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END brk FROM events), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM g)
        SELECT user_id, n::BIGINT AS session, count(*) events, min(ts) started, max(ts) ended FROM s GROUP BY 1, 2""",
    "similar_names": r"""WITH e AS (SELECT entity_id, min(entity_type) t, min(owner_tenant_id) o, min(canonical_name) nm FROM entities WHERE canonical_name IS NOT NULL GROUP BY 1),
        w AS (SELECT *, list_filter(string_split(lower(regexp_replace(nm, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') ws FROM e),
        g AS (SELECT entity_id, t, o, list_distinct(flatten(list_transform(ws, lambda x: list_transform(range(1, len(x) + 2), lambda i: substring('  ' || x || ' ', i, 3))))) tg FROM w)
        SELECT a.entity_id a, b.entity_id b, round(len(list_intersect(a.tg, b.tg)) / (len(a.tg) + len(b.tg) - len(list_intersect(a.tg, b.tg))), 6) similarity FROM g a JOIN g b ON a.t = b.t AND a.o = b.o AND a.entity_id < b.entity_id
        WHERE len(list_intersect(a.tg, b.tg)) / (len(a.tg) + len(b.tg) - len(list_intersect(a.tg, b.tg))) > 0.6""",
}
