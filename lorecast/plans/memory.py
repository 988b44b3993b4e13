"""Registered queries of the batch phases, further joins and selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.functions import vector as V
from lorecast.functions.ranking import top_per_group
from lorecast.io import table
from lorecast.operators import memory as M
from lorecast.operators import phases as P


def _one(s: SparkSession, d: str, name: str, key: str, *columns: str) -> DataFrame:
    """One row a key, with the least of each column: copies count once, whichever comes first."""
    return table(s, d, name).where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(c).alias(c) for c in columns])


def _item() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def causal_segments(s: SparkSession, d: str) -> DataFrame:
    """Rows with the text of their segment; those without one are dropped."""
    prov, seg = _one(s, d, "provenance", "provenance_id", "segment_id", "extraction_method"), _one(s, d, "segments", "segment_id", "text")
    rows = prov.join(seg, "segment_id", "left").where("text is not null")
    return rows.groupBy("extraction_method").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


def verify_memories(s: SparkSession, d: str) -> DataFrame:
    """Entities as memories of what their name begins with, mentions of entities as claims: which memories are older than the latest."""
    ent = _one(s, d, "entities", "entity_id", "canonical_name", "last_seen_at")
    claims = _one(s, d, "provenance", "provenance_id", "target_id", "created_at").join(ent.select("entity_id", "canonical_name"), F.col("target_id") == F.col("entity_id")).select("canonical_name", "created_at")
    memories = ent.where("last_seen_at is not null").select("entity_id", F.trim(F.substring("canonical_name", 1, 7)).alias("subject"), "last_seen_at")
    return P.verify_memories(memories, "entity_id", "subject", "last_seen_at", claims, "canonical_name", "created_at").select("entity_id", "stale")


def uncompressed(s: SparkSession, d: str) -> DataFrame:
    """Sources with three segments or more that aren't compressed yet."""
    status = table(s, d, "provenance").where("segment_id is not null").groupBy("segment_id").agg(F.when(F.max("confidence") > 0.8, "compressed").otherwise("raw").alias("status"))
    seg = _one(s, d, "segments", "segment_id", "source_id", "text")
    rows = seg.join(status, "segment_id", "left").where("status is null or status = 'raw'")
    return rows.groupBy("source_id").agg(F.count("*").alias("members"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("characters")).where("members >= 3")


def space_vectors(s: SparkSession, d: str) -> DataFrame:
    """Six vectors of each item in long form, with their norms."""
    bands = F.array(*[F.struct(F.lit(i).alias("space"), F.slice("embedding", 1 + 10 * i, 10).alias("v")) for i in range(6)])
    rows = table(s, d, "embeddings").select("vec_id", F.explode(bands).alias("x")).select("vec_id", "x.space", "x.v")
    return rows.select("vec_id", "space", F.round(F.sqrt(F.aggregate(F.transform("v", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x)), 5).alias("norm"))


WEIGHTS = [[((7 * i + 3 * j) % 11 - 5) / 10 for i in range(64)] for j in range(4)]


def projected_coords(s: SparkSession, d: str) -> DataFrame:
    """Vectors projected by a matrix to four numbers of unit length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(s, d, "embeddings").select("vec_id", V.linear(v, WEIGHTS, [0.0] * 4).alias("p")).select("vec_id", *[F.round(F.get("p", j), 5).alias(f"p{j}") for j in range(4)])


def recent_items(s: SparkSession, d: str) -> DataFrame:
    """The last 20 different items of each user, the latest first."""
    last = table(s, d, "events").groupBy("user_id", _item().alias("item")).agg(F.max("ts").alias("ts"))
    rows = top_per_group(last, ["user_id"], [F.col("ts").desc(), F.col("item")], 20)
    lists = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "item")))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(lists, lambda x: x["item"].cast("string")), ",").alias("items"))


def sample_by_type(s: SparkSession, d: str) -> DataFrame:
    """Every n-th document of each type in order of a hash, about 20 of each."""
    h = F.pmod(F.col("doc_id") * F.lit(2654435761), F.lit(4294967296))
    return P.systematic(table(s, d, "documents").where("doc_type is not null"), [h, F.col("doc_id")], ["doc_type"], 20, 3).select("doc_id", "doc_type")


def sample_mix(s: SparkSession, d: str) -> DataFrame:
    """60 long, 20 new and 20 short documents, each once."""
    docs = table(s, d, "documents").where("n_chars is not null").select("doc_id", "n_chars", "created_at")
    h = F.pmod(F.col("doc_id") * F.lit(2654435761), F.lit(4294967296))
    parts = [(docs.where("n_chars > 500"), 0.6), (docs.where("created_at >= '2026-01-01'"), 0.2), (docs.where("n_chars < 200"), 0.2)]
    return P.mixed(parts, "doc_id", 100, [h, F.col("doc_id")]).select("doc_id", "n_chars")


def approved(s: SparkSession, d: str) -> DataFrame:
    """Memories confident enough to be applied without review, and without credentials."""
    rows = _one(s, d, "assistant_memories", "memory_id", "importance_score", "normalized_text")
    return M.approve(rows, "importance_score", "normalized_text", 0.7).select("memory_id")


def expired_events(s: SparkSession, d: str) -> DataFrame:
    return M.expired(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2024-01-20", 72).groupBy("event_type").agg(F.count("*").alias("n"))


def tool_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sources with six or more replies or tool records of which no segment has provenance yet."""
    seg = _one(s, d, "segments", "segment_id", "source_id", "speaker_role")
    busy = seg.where(F.lower(F.trim("speaker_role")).isin("assistant", "tool")).groupBy("source_id").agg(F.count("*").alias("n")).where("n >= 6")
    done = table(s, d, "provenance").where("source_id is not null and target_type = 'memory'").select("source_id").distinct()
    return busy.join(done, "source_id", "left_anti")


def warm_entities(s: SparkSession, d: str) -> DataFrame:
    """What a cache is filled with: the 200 most mentioned entities with their neighbours by shared segments and their mentions."""
    ent = _one(s, d, "entities", "entity_id", "canonical_name", "mention_count").orderBy(F.coalesce("mention_count", F.lit(-1)).desc(), "entity_id").limit(200)
    prov = table(s, d, "provenance").where("target_type = 'entity' and segment_id is not null").select("segment_id", "target_id").distinct()
    near = prov.join(ent.select(F.col("entity_id").alias("target_id")), "target_id", "left_semi").withColumnRenamed("target_id", "entity_id")
    counts = near.join(prov, "segment_id").where("entity_id <> target_id").groupBy("entity_id").agg(F.count_distinct("target_id").alias("neighbours"))
    mentions = near.groupBy("entity_id").agg(F.count("*").alias("mentions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return ent.join(counts, "entity_id", "left").join(mentions, "entity_id", "left").select("entity_id", F.lower("canonical_name").alias("name"), zero("neighbours"), zero("mentions"))


def cluster_members(s: SparkSession, d: str) -> DataFrame:
    """Clusters with their size and their first 50 members."""
    rows = table(s, d, "embeddings").select("label", "vec_id")
    first = top_per_group(rows, ["label"], [F.col("vec_id")], 50).groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("vec_id")), ",").alias("members"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).join(first, "label")


def seed_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Entities whose name holds a word of the question, and what shares segments with them."""
    ent = _one(s, d, "entities", "entity_id", "canonical_name")
    asked = s.createDataFrame([("data",), ("bank",), ("mar",)], "word string")
    seeds = P.contains_join(asked, "word", ent, "canonical_name").select("entity_id").distinct()
    prov = table(s, d, "provenance").where("target_type = 'entity' and segment_id is not null").select("segment_id", F.col("target_id").alias("entity_id")).distinct()
    shared = prov.join(seeds, "entity_id", "left_semi").select("segment_id").distinct()
    near = prov.join(shared, "segment_id", "left_semi").join(seeds, "entity_id", "left_anti")
    return near.groupBy("entity_id").agg(F.count("*").alias("support"))


def remembered(s: SparkSession, d: str) -> DataFrame:
    """Vectors with an id divisible by 20 as new memories, against all others: what becomes of them."""
    e = table(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    new = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.col("label").alias("own"), F.col("v").alias("q"))
    best = new.join(e, F.col("id") != F.col("vec_id")).select("id", "own", "vec_id", F.round(V.cosine(F.col("q"), F.col("v")), 6).alias("sim"))  # a stated set of queries against all rows
    top = best.groupBy("id", "own").agg(F.max(F.struct("sim", -F.col("vec_id"))).alias("m")).select("id", (F.col("own") / 10.0).alias("importance"), F.col("m.sim").alias("sim"))
    return top.select("id", "sim", P.remember(top, "importance", "sim", 0.3, 0.8).alias("outcome"))


def suggestions(s: SparkSession, d: str) -> DataFrame:
    """Memories of workflows first, then procedures among documents, 40 in all."""
    memories = _one(s, d, "assistant_memories", "memory_id", "memory_type").where("memory_type = 'workflow'").select(F.col("memory_id").alias("id"))
    runbooks = table(s, d, "documents").where("doc_type = 'runbook'").select(F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("id"))
    return P.by_priority([memories, runbooks], "id", [], 40)


def neighbours_of_found(s: SparkSession, d: str) -> DataFrame:
    """One hop from the ten most important entities: the five best neighbours at 1.1 times the score."""
    ent = _one(s, d, "entities", "entity_id", "importance_score").where("importance_score is not null").orderBy(F.col("importance_score").desc(), "entity_id").limit(10)
    prov = table(s, d, "provenance").where("target_type = 'entity' and segment_id is not null").select("segment_id", "target_id").distinct()
    edges = prov.select("segment_id", F.col("target_id").alias("src")).join(prov.select("segment_id", F.col("target_id").alias("dst")), "segment_id").where("src <> dst").select("src", "dst").distinct()
    return P.one_hop(ent, "entity_id", "importance_score", edges).select("entity_id", F.round("importance_score", 6).alias("score"))


SPACES = {"topic": 0.4, "claim": 0.25, "procedure": 0.15, "relation": 0.15, "time": 0.05}


def orchestrator_recall(s: SparkSession, d: str) -> DataFrame:
    """Recall over five spaces at once for vector 0: anchors by space, percentiles over all candidates, fused by the weights of a mode."""
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    asked = e.where("vec_id = 0").select(F.col("v").alias("q"))  # one row
    band = lambda c, i: F.slice(c, 1 + 10 * i, 10)
    wide = e.where("vec_id <> 0").crossJoin(F.broadcast(asked)).select("vec_id", *[F.round(F.greatest(F.lit(0.0), V.cosine(band("v", i), band("q", i))), 6).alias(n) for i, n in enumerate(SPACES)])
    return P.orchestrate(wide, "vec_id", SPACES, 5).select("vec_id", F.round("score", 6).alias("score"))


def new_causes(s: SparkSession, d: str) -> DataFrame:
    """Descriptions of parts with odd keys that none with an even key repeats in nearly all words."""
    parts = table(s, d, "part").select("p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))), " ").alias("words"))
    return P.without_repeats(parts.where("p_partkey % 2 = 1"), "p_partkey", "words", parts.where("p_partkey % 2 = 0")).select("p_partkey")


def appended_links(s: SparkSession, d: str) -> DataFrame:
    """Memories with one more linked entity appended to their list."""
    rows = _one(s, d, "assistant_memories", "memory_id", "linked_entity_ids")
    links = F.coalesce(F.from_json("linked_entity_ids", "array<string>"), F.array().cast("array<string>"))
    return rows.select("memory_id", F.size(F.concat(links, F.array(F.lit("ENT_new")))).alias("links"), F.element_at(F.concat(links, F.array(F.lit("ENT_new"))), -1).alias("last"))


def tenant_contexts(s: SparkSession, d: str) -> DataFrame:
    """The five most important memories of each tenant as a numbered text."""
    rows = _one(s, d, "assistant_memories", "memory_id", "owner_tenant_id", "importance_score", "status", "memory_type").where("owner_tenant_id is not null")
    return P.context_text(rows, ["owner_tenant_id"], [F.coalesce("importance_score", F.lit(-1.0)).desc(), F.col("memory_id")], "status", "memory_type", 5)


def event_envelopes(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select("event_id", P.envelope(F.col("event_type"), F.col("ts").cast("timestamp"), F.struct("user_id", "value")).alias("e"))
    return rows.select("event_id", F.get_json_object("e", "$.type").alias("type"), F.get_json_object("e", "$.at").alias("at"), F.get_json_object("e", "$.payload.user_id").cast("long").alias("user_id"))


def stats_windows(s: SparkSession, d: str) -> DataFrame:
    """Counts of each five minutes; the same expression serves a stream with a watermark."""
    w = F.window(F.col("ts").cast("timestamp"), "5 minutes")
    return table(s, d, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "n", "users")


def last_claims(s: SparkSession, d: str) -> DataFrame:
    """Feedback events carried into the context of a session: of each user the last outcome before each error."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(s, d, "events").withColumn("last", F.last(F.when(F.col("event_type").isin("purchase", "click"), F.col("event_type")), ignorenulls=True).over(w))
    return rows.where("event_type = 'error'").select("event_id", "last")


QUERIES = {f.__name__: f for f in (
    causal_segments, verify_memories, uncompressed, space_vectors, projected_coords, recent_items, sample_by_type, sample_mix, approved, expired_events, tool_sessions, warm_entities, cluster_members,
    seed_neighbours, remembered, suggestions, neighbours_of_found, orchestrator_recall, new_causes, appended_links, tenant_contexts, event_envelopes, stats_windows, last_claims,
)}


def _least(name: str, key: str, *columns: str) -> str:
    return f"(SELECT {key}, {', '.join(f'min({c}) {c}' for c in columns)} FROM {name} WHERE {key} IS NOT NULL GROUP BY 1)"


_H = "(doc_id * 2654435761) % 4294967296"
_P = "p AS (SELECT DISTINCT segment_id s, target_id t FROM provenance WHERE target_type = 'entity' AND segment_id IS NOT NULL)"
_PROJ = ", ".join("list_sum(list_transform(v, lambda x, i: x * ([" + ", ".join(map(str, w)) + f"]::DOUBLE[])[i])) q{j}" for j, w in enumerate(WEIGHTS))
_WIDE = ", ".join(f"round(greatest(0, list_cosine_similarity(v[{1 + 10 * i}:{10 + 10 * i}], q[{1 + 10 * i}:{10 + 10 * i}])), 6) {n}" for i, n in enumerate(SPACES))
ORACLE = {
    "causal_segments": f"SELECT extraction_method, count(*) n, sum(length(text))::BIGINT AS characters FROM {_least('provenance', 'provenance_id', 'segment_id', 'extraction_method')} JOIN {_least('segments', 'segment_id', 'text')} USING (segment_id) WHERE text IS NOT NULL GROUP BY 1",
    "verify_memories": f"""WITH e AS {_least('entities', 'entity_id', 'canonical_name', 'last_seen_at')}, c AS (SELECT canonical_name n, p.created_at t FROM {_least('provenance', 'provenance_id', 'target_id', 'created_at')} p JOIN e ON target_id = entity_id), m AS (SELECT entity_id, trim(substring(canonical_name, 1, 7), ' ') w, last_seen_at a FROM e WHERE last_seen_at IS NOT NULL)
        SELECT entity_id, max(t) > any_value(a) stale FROM m JOIN c ON contains(lower(n), lower(w)) AND length(w) >= 3 GROUP BY 1""",
    "uncompressed": f"""WITH t AS (SELECT segment_id, CASE WHEN max(confidence) > 0.8 THEN 'compressed' ELSE 'raw' END status FROM provenance WHERE segment_id IS NOT NULL GROUP BY 1)
        SELECT source_id, count(*) members, sum(coalesce(length(text), 0))::BIGINT AS characters FROM {_least('segments', 'segment_id', 'source_id', 'text')} LEFT JOIN t USING (segment_id) WHERE status IS NULL OR status = 'raw' GROUP BY 1 HAVING count(*) >= 3""",
    "space_vectors": "SELECT vec_id, i AS space, round(sqrt(list_sum(list_transform(embedding[1 + 10 * i:10 + 10 * i], lambda x: x::DOUBLE * x::DOUBLE))), 5) norm FROM embeddings, (SELECT unnest(range(6))::INT i)",
    "projected_coords": f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), q AS (SELECT vec_id, {_PROJ} FROM e) SELECT vec_id, " + ", ".join(f"round(q{j} / sqrt(q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3), 5) p{j}" for j in range(4)) + " FROM q",
    "recent_items": "WITH l AS (SELECT user_id, json_extract_string(props, '$.k')::INT item, max(ts) t FROM events GROUP BY 1, 2) SELECT user_id, string_agg(item::VARCHAR, ',' ORDER BY t DESC, item) items FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, item) <= 20) GROUP BY 1",
    "sample_by_type": f"WITH r AS (SELECT doc_id, doc_type, row_number() OVER (PARTITION BY doc_type ORDER BY {_H}, doc_id) - 1 r, greatest(1, count(*) OVER (PARTITION BY doc_type) // 20) k FROM documents WHERE doc_type IS NOT NULL) SELECT doc_id, doc_type FROM r WHERE r % k = 3 % k AND r // k < 20",
    "sample_mix": f"WITH d AS (SELECT doc_id, n_chars, created_at, {_H} h FROM documents WHERE n_chars IS NOT NULL) SELECT DISTINCT doc_id, n_chars FROM ((SELECT * FROM d WHERE n_chars > 500 ORDER BY h, doc_id LIMIT 60) UNION ALL (SELECT * FROM d WHERE created_at >= TIMESTAMP '2026-01-01' ORDER BY h, doc_id LIMIT 20) UNION ALL (SELECT * FROM d WHERE n_chars < 200 ORDER BY h, doc_id LIMIT 20))",
    "approved": f"SELECT memory_id FROM {_least('assistant_memories', 'memory_id', 'importance_score', 'normalized_text')} WHERE importance_score >= 0.7 AND NOT coalesce(regexp_matches(lower(normalized_text), 'password|passwd|api key|api_key|apikey|secret|credential|private key|access token|bearer'), false)",
    "expired_events": "SELECT event_type, count(*) n FROM events WHERE ts < TIMESTAMP '2024-01-17' GROUP BY 1",
    "tool_sessions": f"SELECT source_id, count(*) n FROM {_least('segments', 'segment_id', 'source_id', 'speaker_role')} WHERE lower(trim(speaker_role, ' ')) IN ('assistant', 'tool') AND source_id NOT IN (SELECT source_id FROM provenance WHERE source_id IS NOT NULL AND target_type = 'memory') GROUP BY 1 HAVING count(*) >= 6",
    "warm_entities": f"""WITH {_P}, e AS (SELECT * FROM {_least('entities', 'entity_id', 'canonical_name', 'mention_count')} ORDER BY coalesce(mention_count, -1) DESC, entity_id LIMIT 200)
        SELECT entity_id, lower(canonical_name) AS name, (SELECT count(DISTINCT y.t) FROM p x JOIN p y ON x.s = y.s AND x.t <> y.t WHERE x.t = entity_id) neighbours, (SELECT count(*) FROM p WHERE t = entity_id) mentions FROM e""",
    "cluster_members": "SELECT label, count(*) n, array_to_string(list(vec_id ORDER BY vec_id)[1:50], ',') members FROM embeddings GROUP BY 1",
    "seed_neighbours": f"WITH {_P}, e AS (SELECT entity_id FROM {_least('entities', 'entity_id', 'canonical_name')} WHERE canonical_name ILIKE '%data%' OR canonical_name ILIKE '%bank%' OR canonical_name ILIKE '%mar%') SELECT t entity_id, count(*) support FROM p WHERE s IN (SELECT s FROM p WHERE t IN (SELECT entity_id FROM e)) AND t NOT IN (SELECT entity_id FROM e) GROUP BY 1",
    "remembered": "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings), m AS (SELECT a.vec_id id, a.label / 10 i, max(round(list_cosine_similarity(a.v, b.v), 6)) sim FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1, 2) SELECT id, sim, CASE WHEN i < 0.3 THEN 'rejected' WHEN sim >= 0.8 THEN 'confirmed' ELSE 'provisional' END outcome FROM m",
    "suggestions": f"SELECT id, priority FROM (SELECT memory_id id, 0 priority FROM {_least('assistant_memories', 'memory_id', 'memory_type')} WHERE memory_type = 'workflow' UNION ALL SELECT 'doc-' || lpad(doc_id::VARCHAR, 9, '0'), 1 FROM documents WHERE doc_type = 'runbook') ORDER BY priority, id LIMIT 40",
    "neighbours_of_found": f"WITH {_P}, f AS (SELECT * FROM {_least('entities', 'entity_id', 'importance_score')} WHERE importance_score IS NOT NULL ORDER BY importance_score DESC, entity_id LIMIT 10), g AS (SELECT y.t entity_id, max(importance_score) * 1.1 v FROM f JOIN p x ON x.t = entity_id JOIN p y ON x.s = y.s AND x.t <> y.t WHERE y.t NOT IN (SELECT entity_id FROM f) GROUP BY 1) SELECT entity_id, round(v, 6) score FROM g ORDER BY v DESC, entity_id LIMIT 5",
    "orchestrator_recall": f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), w AS (SELECT vec_id, {_WIDE} FROM e, (SELECT v q FROM e WHERE vec_id = 0) WHERE vec_id <> 0),
        c AS ({' UNION '.join(f"(SELECT vec_id FROM w WHERE {n} > 0 ORDER BY {n} DESC, vec_id LIMIT 15)" for n, x in SPACES.items() if x > 0.05)}), r AS (SELECT w.* FROM w JOIN c USING (vec_id)),
        f AS (SELECT vec_id, {' + '.join(f"{x} * (row_number() OVER (ORDER BY {n}, vec_id) - 1) / (count(*) OVER () - 1)" for n, x in SPACES.items())} v FROM r) SELECT vec_id, round(v, 6)::DOUBLE score FROM f ORDER BY round(v, 9) DESC, vec_id LIMIT 5""",
    "new_causes": "WITH x AS (SELECT p_partkey k, list_distinct(string_split(lower(concat_ws(' ', p_name, p_brand, p_type, p_size::VARCHAR)), ' ')) w FROM part) SELECT k p_partkey FROM x a WHERE k % 2 = 1 AND NOT EXISTS (SELECT 1 FROM x b WHERE b.k % 2 = 0 AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) > 0.7)",
    "appended_links": f"SELECT memory_id, (coalesce(json_array_length(linked_entity_ids), 0) + 1)::INT links, 'ENT_new' AS last FROM {_least('assistant_memories', 'memory_id', 'linked_entity_ids')}",
    "tenant_contexts": f"""WITH m AS {_least('assistant_memories', 'memory_id', 'owner_tenant_id', 'importance_score', 'status', 'memory_type')}, r AS (SELECT *, row_number() OVER (PARTITION BY owner_tenant_id ORDER BY coalesce(importance_score, -1) DESC, memory_id) r FROM m WHERE owner_tenant_id IS NOT NULL)
        SELECT owner_tenant_id, string_agg('[' || r || '] (' || coalesce(status, 'none') || ') ' || coalesce(memory_type, ''), chr(10) ORDER BY r) context FROM r WHERE r <= 5 GROUP BY 1""",
    "event_envelopes": "SELECT event_id, event_type AS type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, user_id FROM events",
    "stats_windows": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) n, count(DISTINCT user_id) users FROM events GROUP BY 1",
    "last_claims": "SELECT event_id, last FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type IN ('purchase', 'click') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events) WHERE event_type = 'error'",
}
