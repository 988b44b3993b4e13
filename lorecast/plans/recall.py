"""The recall plan: a question's arms over memories, entities, segments and vectors, scored, fused and filled into a budget."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.functions import scores as C
from lorecast.functions import vector as V
from lorecast.functions.extraction import citation
from lorecast.functions.ranking import effective_score, fill_budget, top, top_per_group
from lorecast.functions.text import words
from lorecast.io import table
from lorecast.operators import memory as M
from lorecast.operators import relational as R
from lorecast.operators import search as S
from lorecast.plans.retrieval import query_vector

#: Boost and priority of each kind of item.
KINDS = {"memory": (1.5, 0), "claim": (1.4, 1), "entity": (1.3, 1), "neighbour": (1.1, 1), "segment": (1.0, 3)}


@dataclass(frozen=True)
class Question:
    terms: tuple[str, ...]
    vector: tuple[float, ...] = ()
    tenants: tuple[str, ...] = ()
    as_of: str = "2026-06-01"
    budget: int = 1200
    k: int = 15
    event: tuple[str, str] | None = None
    weights: dict[str, float] = field(default_factory=lambda: {"share": 1.0})

    def __post_init__(self) -> None:
        if not self.terms or sum(map(len, self.terms)) > 2000:
            raise ValueError("a question has between one word and 2000 characters")
        if not 1 <= self.k <= 100:
            raise ValueError("k is from 1 to 100")


def word_share(text: Column, terms: tuple[str, ...]) -> Column:
    """The share of the question's words of three letters or more that a text holds."""
    long = [t for t in terms if len(t) >= 3] or list(terms)
    return sum((F.coalesce(F.array_contains(words(text), t), F.lit(False)).cast("int") for t in long), F.lit(0)) / len(long)


def _scope(df: DataFrame, q: Question) -> DataFrame:
    return df.where(F.col("owner_tenant_id").isin(*q.tenants, "shared")) if q.tenants else df


def arms(spark: SparkSession, folder: str, q: Question) -> DataFrame:
    """(kind, id, title, text, score, importance, recency): the best k items of each kind."""
    age = lambda c: (F.unix_micros(F.lit(q.as_of).cast("timestamp")) - F.unix_micros(c)) / 86400e6
    mem = _scope(table(spark, folder, "assistant_memories").where(F.col("status").isin("active", "confirmed", "provisional")), q)
    mem = mem.groupBy("memory_id").agg(F.min("normalized_text").alias("text"), F.max("importance_score").alias("i"), F.max("created_at").alias("t"))
    ent = _scope(table(spark, folder, "entities"), q).groupBy("entity_id").agg(F.min("canonical_name").alias("title"), F.min("description").alias("text"), F.max("importance_score").alias("i"), F.max("last_seen_at").alias("t"))
    seg = _scope(table(spark, folder, "segments"), q).where(F.length("text") >= 50)
    if q.event:
        seg = seg.where(R.bitemporal("message_timestamp", "created_at", event=q.event))
    vec = F.max("embedding") if q.vector else F.lit(None).cast("array<float>")
    seg = seg.groupBy("segment_id").agg(F.min("title_or_heading").alias("title"), F.min("text").alias("text"), F.min("segment_type").alias("k"), F.max("message_timestamp").alias("t"), F.max("retrieval_count").alias("r"), vec.alias("v"))
    near = V.cosine(F.col("v"), V.literal(list(q.vector))) if q.vector else F.lit(None).cast("double")
    parts = [
        mem.select(F.lit("memory").alias("kind"), F.col("memory_id").alias("id"), F.lit(None).cast("string").alias("title"), "text", word_share(F.col("text"), q.terms).alias("s"), F.coalesce("i", F.lit(0.5)).alias("importance"), C.recency_bucket(age("t")).alias("recency"), F.lit(1.0).alias("f")),
        ent.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), "title", "text", word_share(F.concat_ws(" ", "title", "text"), q.terms).alias("s"), F.coalesce("i", F.lit(0.5)).alias("importance"), C.recency_bucket(age("t")).alias("recency"), F.lit(1.0).alias("f")),
        seg.select(F.lit("segment").alias("kind"), F.col("segment_id").alias("id"), "title", "text", F.greatest(word_share(F.col("text"), q.terms), F.coalesce(near, F.lit(0.0))).alias("s"), C.segment_importance(F.col("k"), F.col("text")).alias("importance"), C.recency_bucket(age("t")).alias("recency"),
                   ((1 + 0.15 * C.hot(F.coalesce("r", F.lit(0)), age("t"))) * F.when(F.col("k").isin("tool_call", "tool_result"), 0.4).otherwise(1.0)).alias("f")),
    ]
    best = [top(p.where(F.col("s") >= 0.2).withColumn("score", F.col("s") * KINDS[k][0] * F.col("f")), F.col("score"), ["id"], q.k) for p, k in zip(parts, ("memory", "entity", "segment"), strict=True)]
    return best[0].unionByName(best[1]).unionByName(best[2]).drop("s", "f")


def recall(spark: SparkSession, folder: str, q: Question) -> DataFrame:
    """(place, kind, id, effective, taken_tokens, citation): the items that answer a question, within its budget of tokens."""
    priority = F
    for k, (_, p) in KINDS.items():
        priority = priority.when(F.col("kind") == k, p)
    items = arms(spark, folder, q).withColumn("priority", priority.otherwise(3)).withColumn("tokens", F.coalesce(F.floor(F.length("text") / 4).cast("int"), F.lit(0)))
    items = items.withColumn("effective", effective_score(F.col("score"), F.col("importance"), F.col("recency"), F.col("priority")))
    order = [F.col("priority").asc(), F.col("effective").desc(), F.col("id").asc()]
    head = items.withColumn("_h", F.coalesce(F.lower(F.trim(F.substring("text", 1, 200))), "id"))
    once = top_per_group(head, ["_h"], order, 1)
    filled = fill_budget(once, order, "tokens", q.budget)
    place = F.row_number().over(Window.orderBy(*order))
    return filled.select(place.alias("place"), "kind", "id", F.round("effective", 6).alias("effective"), "taken_tokens", citation(F.col("kind"), F.col("title"), F.col("id")).alias("citation"))


def recall_context(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: what the engine recalls about merges and thresholds."""
    return recall(spark, folder, Question(("threshold", "merges", "lowered")))


def recall_with_vector(spark: SparkSession, folder: str) -> DataFrame:
    return recall(spark, folder, Question(("night", "cycle"), tuple(query_vector(spark, folder)), event=("2025-01-01", "2025-12-31")))


def leader_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of greedy leader clusters of the vectors by label."""
    found = M.leader_clusters(table(spark, folder, "embeddings"), "label", "vec_id", "embedding", 0.3)
    return found.groupBy("tenant", "leader").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("similarity"))


def merge_proposals(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entities").where("canonical_name is not null").groupBy("entity_id").agg(F.min("entity_type").alias("t"), F.min("owner_tenant_id").alias("o"), F.min("canonical_name").alias("name"), F.max("mention_count").alias("m"), F.max("source_count").alias("c"))
    return M.merge_proposals(R.similar_pairs(rows, "entity_id", ["t", "o"], "name", 0.6), rows, "entity_id", ["m", "c"])


def poorly_described(spark: SparkSession, folder: str) -> DataFrame:
    ent = table(spark, folder, "entities").groupBy("entity_id").agg(F.min("description").alias("description"))
    prov = table(spark, folder, "provenance").where("target_type = 'entity'")
    return M.poorly_described(ent, prov, "entity_id", 50).select("entity_id", "segments")


def grouped_summaries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "segments").where("text is not null").groupBy("source_id", "segment_id").agg(F.min("text").alias("text"))
    return M.grouped_texts(rows, "source_id", "segment_id", "text").select("source_id", F.col("chunk").cast("long").alias("chunk"), "n", F.length("text").alias("characters"))


def tenant_budgets(spark: SparkSession, folder: str) -> DataFrame:
    seg = table(spark, folder, "segments").groupBy("segment_id").agg(F.min("owner_tenant_id").alias("tenant_id"), F.max(F.floor(F.length("text") / 4)).alias("tokens"))
    return M.within_budget(seg, table(spark, folder, "tenants").select("tenant_id", "token_budget"), "tenant_id", "tokens", "token_budget")


def unembedded(spark: SparkSession, folder: str) -> DataFrame:
    """Segments that wait for a vector, by tenant: rows for the embedding hook."""
    rows = table(spark, folder, "segments").groupBy("segment_id").agg(F.min("owner_tenant_id").alias("tenant"), F.max(F.col("embedding").isNotNull()).alias("done"), F.max(F.length("text")).alias("n"))
    return rows.where(~F.col("done") & (F.col("n") >= 50)).groupBy("tenant").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (recall_context, recall_with_vector, leader_clusters, merge_proposals, poorly_described, grouped_summaries, tenant_budgets, unembedded)}
_SHARE = lambda text: "(" + " + ".join(f"CASE WHEN list_contains(string_split(lower(regexp_replace({text}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), '{t}') THEN 1 ELSE 0 END" for t in ("threshold", "merges", "lowered")) + ") / 3"
_AGE = "(epoch_us(TIMESTAMPTZ '2026-06-01 00:00:00+00') - epoch_us(t)) / 86400e6"
_REC = f"CASE WHEN {_AGE} < 1 THEN 1.0 WHEN {_AGE} < 7 THEN 0.9 WHEN {_AGE} < 30 THEN 0.7 WHEN {_AGE} < 90 THEN 0.5 ELSE 0.3 END"
ORACLE = {
    "recall_context": f"""WITH m AS (SELECT memory_id id, min(normalized_text) text, max(importance_score) i, max(created_at) t FROM assistant_memories WHERE status IN ('active', 'confirmed', 'provisional') GROUP BY 1),
        e AS (SELECT entity_id id, min(canonical_name) title, min(description) text, max(importance_score) i, max(last_seen_at) t FROM entities GROUP BY 1),
        g AS (SELECT segment_id id, min(title_or_heading) title, min(text) text, min(segment_type) k, max(message_timestamp) t, coalesce(max(retrieval_count), 0) r FROM segments WHERE length(text) >= 50 GROUP BY 1),
        a AS ((SELECT 'memory' kind, id, NULL title, text, s * 1.5 score, coalesce(i, 0.5) imp, {_REC} rec, 0 priority FROM (SELECT *, {_SHARE('text')} s FROM m) WHERE s >= 0.2 ORDER BY score DESC, id LIMIT 15)
            UNION ALL (SELECT 'entity', id, title, text, s * 1.3 score, coalesce(i, 0.5), {_REC}, 1 FROM (SELECT *, {_SHARE("concat_ws(' ', title, text)")} s FROM e) WHERE s >= 0.2 ORDER BY score DESC, id LIMIT 15)
            UNION ALL (SELECT 'segment', id, title, text, s * (1 + 0.15 * CASE WHEN r = 0 THEN 0 ELSE ln(1 + r) / (1 + 0.1 * coalesce({_AGE}, 30)) END) * CASE WHEN k IN ('tool_call', 'tool_result') THEN 0.4 ELSE 1.0 END score,
                CASE k WHEN 'heading' THEN 0.8 WHEN 'summary' THEN 0.9 WHEN 'claim' THEN 0.95 WHEN 'paragraph' THEN 0.5 WHEN 'code_block' THEN 0.6 WHEN 'list_item' THEN 0.4 WHEN 'table_row' THEN 0.5 WHEN 'message' THEN 0.6 ELSE 0.5 END
                    * CASE WHEN length(text) < 100 THEN 0.7 ELSE 1.0 END, {_REC}, 3 FROM (SELECT *, {_SHARE('text')} s FROM g) WHERE s >= 0.2 ORDER BY score DESC, id LIMIT 15)),
        f AS (SELECT *, coalesce(length(text) // 4, 0) tok, 0.5 * score + 0.2 * imp + 0.1 * rec + 0.2 * (5 - priority) * 0.1 eff FROM a),
        o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY coalesce(lower(trim(substring(text, 1, 200), ' ')), id) ORDER BY priority, eff DESC, id) = 1),
        r AS (SELECT *, sum(tok + 25) OVER (ORDER BY priority, eff DESC, id) run FROM o), p AS (SELECT *, coalesce(lag(run) OVER (ORDER BY priority, eff DESC, id), 0) prev FROM r)
        SELECT row_number() OVER (ORDER BY priority, eff DESC, id) place, kind, id, round(eff, 6)::DOUBLE effective, (CASE WHEN run <= 1200 THEN tok ELSE 1200 - prev - 25 END)::BIGINT taken_tokens, '[' || kind || ': ' || coalesce(title, id) || ']' citation
        FROM p WHERE run <= 1200 OR (prev <= 1200 AND 1200 - prev > 75)""",
    "poorly_described": "WITH e AS (SELECT entity_id, min(description) d FROM entities GROUP BY 1), p AS (SELECT target_id, count(DISTINCT segment_id) n FROM provenance WHERE target_type = 'entity' GROUP BY 1) SELECT entity_id, n segments FROM e JOIN p ON entity_id = target_id WHERE (d IS NULL OR length(d) < 60) AND n >= 2 ORDER BY n DESC, entity_id LIMIT 50",
    "grouped_summaries": "WITH s AS (SELECT source_id, segment_id, min(text) text FROM segments WHERE text IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, (row_number() OVER (PARTITION BY source_id ORDER BY segment_id) - 1) // 20 chunk FROM s) SELECT source_id, chunk, count(*) n, (sum(length(text)) + 2 * (count(*) - 1))::INT AS characters FROM r GROUP BY 1, 2",
    "tenant_budgets": "WITH s AS (SELECT segment_id, min(owner_tenant_id) tenant_id, max(length(text) // 4) k FROM segments GROUP BY 1), u AS (SELECT tenant_id, sum(k)::BIGINT used FROM s GROUP BY 1) SELECT tenant_id, coalesce(used, 0) used, token_budget AS budget, token_budget - coalesce(used, 0) AS \"left\" FROM tenants LEFT JOIN u USING (tenant_id)",
    "unembedded": "WITH s AS (SELECT segment_id, min(owner_tenant_id) tenant, bool_or(embedding IS NOT NULL) d, max(length(text)) n FROM segments GROUP BY 1) SELECT tenant, count(*) n FROM s WHERE NOT d AND n >= 50 GROUP BY 1",
}
