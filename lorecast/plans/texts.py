"""Registered text, scoring, ingest and streaming queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecast.functions import extraction as X
from lorecast.functions import routing as Q
from lorecast.functions import scores as C
from lorecast.functions import text as T
from lorecast.io import table
from lorecast.plans.materialize import checkpoint_dir
from lorecast.sources import chunking, parsers
from lorecast.streaming import sessions as S


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null")


def _messages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "segments").where("text is not null").groupBy("segment_id").agg(F.min("text").alias("text"))


def classify_v1(s: SparkSession, d: str) -> DataFrame:
    return _messages(s, d).groupBy(T.first_match(F.col("text"), T.MODES_V1, "factual").alias("mode")).agg(F.count("*").alias("n"))


def classify_v2(s: SparkSession, d: str) -> DataFrame:
    return _messages(s, d).groupBy(T.first_match(F.col("text"), T.MODES_V2, "synthesis").alias("mode")).agg(F.count("*").alias("n"))


def intents(s: SparkSession, d: str) -> DataFrame:
    return _messages(s, d).groupBy(Q.intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


def index_routes(s: SparkSession, d: str) -> DataFrame:
    rows = _messages(s, d).select(Q.primary_index(F.col("text")).alias("index"), Q.temporal_hint(F.col("text")).alias("hint"), F.round(F.element_at(Q.index_weights(F.col("text")), "segments"), 6).alias("segments"))
    return rows.groupBy("index", "hint", "segments").agg(F.count("*").alias("n"))


def corroborations(s: SparkSession, d: str) -> DataFrame:
    """Claims (first sentences of memories) and the texts of a stated claim that support or contradict it."""
    rows = table(s, d, "assistant_memories").where("normalized_text is not null").groupBy("memory_id").agg(F.min("normalized_text").alias("t"))
    claim = F.lit("Restart the decay job during office hours.")
    return rows.select("memory_id", Q.supports(claim, F.col("t"), 0.6).alias("supports"), Q.contradicts(claim, F.col("t")).alias("contradicts")).where("supports or contradicts")


def session_states(s: SparkSession, d: str) -> DataFrame:
    return _messages(s, d).groupBy(T.best_state(F.col("text")).alias("state")).agg(F.count("*").alias("n"))


def causal_pairs(s: SparkSession, d: str) -> DataFrame:
    found = X.causes(_messages(s, d), "segment_id", "text")
    return found.groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("segment_id").alias("segments"))


def causal_merge(s: SparkSession, d: str) -> DataFrame:
    """Causes merged by (cause, effect): corroborations and the strength they give."""
    found = X.causes(_messages(s, d), "segment_id", "text").where("relation = 'because'")
    by = found.groupBy(F.md5(F.lower(F.concat_ws("|", "cause", "effect"))).alias("causal_id")).agg(F.count_distinct("segment_id").alias("n"), F.max("confidence").alias("c"))
    return by.select("causal_id", "n", F.round(C.causal_strength(F.col("c"), F.lit(0.5), F.col("n")), 6).alias("strength"))


def claims_spo(s: SparkSession, d: str) -> DataFrame:
    """One claim a sentence of each memory, with the sentence's place."""
    rows = table(s, d, "assistant_memories").where("normalized_text is not null").groupBy("memory_id").agg(F.min("normalized_text").alias("t"))
    each = rows.select("memory_id", F.posexplode(X.sentences(F.col("t"))).alias("place", "t"))
    return each.select("memory_id", "place", X.claim(F.col("t")).alias("c")).select("memory_id", "place", "c.*")


def procedure_steps(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.size(X.steps(F.col("text"))).alias("steps")).where("steps > 0")


def text_dates(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", X.dates(F.col("text")).alias("dates")).where(F.size("dates") > 0).select("doc_id", F.size("dates").alias("n"), F.element_at("dates", 1).alias("first"), F.element_at("dates", -1).alias("last"))


def temporal_vector(s: SparkSession, d: str) -> DataFrame:
    rows = _docs(s, d).where("created_at is not null").select("doc_id", X.temporal_features(F.col("created_at"), F.lit("2026-06-01").cast("timestamp"), F.col("text"), F.col("doc_id") % 10, F.lit(10), F.lit("2020-01-01").cast("timestamp")).alias("v"))
    return rows.select("doc_id", *[F.round(F.element_at("v", i + 1), 6).alias(f"f{i}") for i in range(12)])


def evidence_scores(s: SparkSession, d: str) -> DataFrame:
    """Evidence of entities from their provenance: confidence, sources, age, contradictions."""
    prov = table(s, d, "provenance").where("target_type = 'entity'").dropDuplicates(["provenance_id"])
    by = prov.groupBy("target_id").agg(F.avg("confidence").alias("a"), F.count_distinct("source_id").alias("n"), F.max("created_at").alias("t"), F.count_if(F.col("confidence") < 0.3).alias("x"), F.count("*").alias("m"))
    days = (F.unix_micros(F.lit("2026-06-01").cast("timestamp")) - F.unix_micros("t")) / 86400e6
    return by.select("target_id", F.round(C.evidence(F.coalesce("a", F.lit(0.3)), F.col("n"), days, F.lit(0.5), F.col("x"), F.col("m")), 6).alias("evidence"))


def memory_decay(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "assistant_memories").groupBy("memory_id").agg(F.max("importance_score").alias("i"), F.max("stability_score").alias("st"), F.max("created_at").alias("t"), F.max("confirmation_count").alias("c"))
    days = F.floor((F.unix_micros(F.lit("2026-06-01").cast("timestamp")) - F.unix_micros("t")) / 86400e6)
    return rows.select("memory_id", F.round(C.decay_rate(F.col("i"), days, 0.001, 0.05), 6).alias("decayed"), C.decay_linear(F.col("st"), days).alias("linear"), F.round(C.hot(F.coalesce("c", F.lit(0)), days.cast("double")), 6).alias("hot"), C.recency_bucket(days).alias("recency"))


def entity_promotion(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "entities").groupBy("entity_id").agg(*[F.max(c).alias(c) for c in ("importance_score", "ambiguity_score", "retrieval_count", "mention_count", "source_count")])
    z = lambda c: F.coalesce(c, F.lit(0))
    score = C.promotion(
        F.coalesce("importance_score", F.lit(0.0)), C.retrieval_frequency(z("retrieval_count") / 30), C.source_diversity(z("source_count"), z("mention_count")),
        F.lit(0.5), 1 - F.coalesce("ambiguity_score", F.lit(0.0)), C.graph_centrality(z("source_count"), F.lit(0.0)), F.lit(0.5),
    )
    return e.select("entity_id", F.round(score, 6).alias("promotion"), C.promotion_step(score, F.lit(0)).alias("step"))


def segment_importance(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "segments").groupBy("segment_id").agg(F.min("segment_type").alias("k"), F.max(F.length("text")).alias("n"))
    base = C.lookup(F.col("k"), C.SEGMENT_IMPORTANCE, 0.5)
    value = base * F.when(F.coalesce("n", F.lit(0)) < 20, 0.1).when(F.col("n") < 50, 0.3).when(F.col("n") < 100, 0.7).otherwise(1.0)
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("importance"))


def chunk_segments(s: SparkSession, d: str) -> DataFrame:
    """Segments in chunks of about 800 tokens; small ones unchanged."""
    rows = table(s, d, "segments").where("text is not null").groupBy("segment_id").agg(F.min("text").alias("text"), F.min("ordinal").alias("ordinal"))
    return chunking.chunks(rows, "segment_id", "text", "ordinal").groupBy("segment_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"))


def topic_episodes(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "segments").where("message_timestamp is not null and text is not null").dropDuplicates(["segment_id"]).withColumn("_k", F.struct("message_timestamp", "segment_id"))
    return chunking.episodes(rows, "source_id", "_k", "message_timestamp", "speaker_role", "text").groupBy("source_id").agg(F.max("episode").alias("episodes"))


def plain_paragraphs(s: SparkSession, d: str) -> DataFrame:
    rows = _docs(s, d).select(F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("content"))
    return parsers.plain_text(rows).select("source_id", "ordinal", "char_start", "char_end", "line_start", "line_end")


def markdown_segments(s: SparkSession, d: str) -> DataFrame:
    rows = _docs(s, d).select(F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("content"))
    return parsers.with_parents(parsers.markdown(rows)).groupBy("segment_type").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


def _drained(s: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    checkpoint_dir(s)
    name = f"{name}_{uuid.uuid4().hex}"
    return S.drain(stream, name, f"{s.sparkContext.getCheckpointDir()}/streams/{name}")


def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    """Closed sessions of the event stream, read to its present end."""
    return _drained(s, S.session_windows(S.read_events(s, d)), "sessions")


def stream_hours(s: SparkSession, d: str) -> DataFrame:
    return _drained(s, S.tumbling(S.read_events(s, d)), "hours")


QUERIES = {
    f.__name__: f
    for f in (
        classify_v1, classify_v2, intents, index_routes, corroborations, session_states, causal_pairs, causal_merge, claims_spo, procedure_steps, text_dates, temporal_vector, evidence_scores, memory_decay,
        entity_promotion, segment_importance, chunk_segments, topic_episodes, plain_paragraphs, markdown_segments, stream_sessions, stream_hours,
    )
}


_DAYS = "epoch_us(TIMESTAMPTZ '2026-06-01 00:00:00+00') - epoch_us(t)"
_WORDS = "list_distinct(list_filter(string_split(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))"
ORACLE = {
    "corroborations": f"""WITH m AS (SELECT memory_id, min(normalized_text) t FROM assistant_memories WHERE normalized_text IS NOT NULL GROUP BY 1), c AS (SELECT {_WORDS.format("'Restart the decay job during office hours.'")} c),
        x AS (SELECT memory_id, t, {_WORDS.format("t")} w, c FROM m, c), y AS (SELECT memory_id, len(list_intersect(c, w)) / (len(c) + len(w) - len(list_intersect(c, w))) >= 0.6 supports, len(list_intersect(c, w)) / len(c) > 0.3 AND regexp_matches(t, '(?i)\\b(?:not|never|no longer|doesn''t|don''t|isn''t|wasn''t|false|incorrect)\\b') contradicts FROM x)
        SELECT * FROM y WHERE supports OR contradicts""",
    "evidence_scores": f"""WITH p AS (SELECT DISTINCT ON (provenance_id) * FROM provenance WHERE target_type = 'entity'), b AS (SELECT target_id, coalesce(avg(confidence), 0.3) a, count(DISTINCT source_id) n, max(created_at) t, count(*) FILTER (WHERE confidence < 0.3) x, count(*) m FROM p GROUP BY 1),
        f AS (SELECT *, greatest(0.0, least(1.0, 1 - x / greatest(m, 1))) q, greatest(({_DAYS}) / 86400e6, 0) dd FROM b)
        SELECT target_id, round(greatest(0.0, least(1.0, (0.25 * a + 0.30 * least(1.0, ln(1 + n) / 1.8) + 0.15 * exp(-dd * ln(2) / 60) + 0.10 * 0.5 + 0.20 * q) * pow(q, 1.5))), 6) evidence FROM f""",
    "memory_decay": f"""WITH m AS (SELECT memory_id, max(importance_score) i, max(stability_score) st, max(created_at) t, max(confirmation_count) c FROM assistant_memories GROUP BY 1), x AS (SELECT *, floor(({_DAYS}) / 86400e6)::BIGINT dd FROM m)
        SELECT memory_id, round(CASE WHEN i IS NULL THEN 0.05 ELSE greatest(0.05, i * (1 - 0.001 * dd)) END, 6) decayed, CASE WHEN dd < 7 THEN st ELSE round(CASE WHEN st IS NULL THEN 0 ELSE greatest(0, st - least(0.1, 0.01 * (dd - 7))) END, 4) END linear,
            round(CASE WHEN coalesce(c, 0) = 0 THEN 0 ELSE ln(1 + c) / (1 + 0.1 * dd) END, 6) hot, CASE WHEN dd < 1 THEN 1.0 WHEN dd < 7 THEN 0.9 WHEN dd < 30 THEN 0.7 WHEN dd < 90 THEN 0.5 ELSE 0.3 END::DOUBLE recency FROM x""",
    "entity_promotion": f"""WITH e AS (SELECT entity_id, coalesce(max(importance_score), 0) i, coalesce(max(ambiguity_score), 0) a, coalesce(max(retrieval_count), 0) r, coalesce(max(mention_count), 0) m, coalesce(max(source_count), 0) s FROM entities GROUP BY 1),
        p AS (SELECT entity_id, greatest(0.0, least(1.0, 0.20 * i + 0.15 * least(1.0, ln(1 + 10 * (r / 30)) / ln(11)) + 0.10 * CASE WHEN s <= 1 THEN 0.5 ELSE least(1.0, coalesce(ln(1 + s) / nullif(ln(1 + least(10, m)), 0), 0)) END
            + 0.20 * 0.5 + 0.10 * (1 - a) + 0.10 * 0.6 * least(1.0, ln(1 + s) / 4) + 0.15 * 0.5)) v FROM e) SELECT entity_id, round(v, 6) promotion, CASE WHEN v >= 0.65 THEN 'promote' ELSE 'keep' END step FROM p""",
    "segment_importance": """WITH s AS (SELECT segment_id, min(segment_type) k, max(length(text)) n FROM segments GROUP BY 1)
        SELECT k, count(*) n, round(avg(CASE k WHEN 'heading' THEN 0.8 WHEN 'summary' THEN 0.9 WHEN 'claim' THEN 0.95 WHEN 'paragraph' THEN 0.5 WHEN 'code_block' THEN 0.6 WHEN 'list_item' THEN 0.4 WHEN 'table_row' THEN 0.5 WHEN 'message' THEN 0.6 ELSE 0.5 END
            * CASE WHEN coalesce(s.n, 0) < 20 THEN 0.1 WHEN s.n < 50 THEN 0.3 WHEN s.n < 100 THEN 0.7 ELSE 1.0 END), 6) importance FROM s GROUP BY 1""",
    "text_dates": r"""WITH d AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\b(\d{4}-\d{2}-\d{2})\b', 1), lambda x: try_cast(x AS DATE)), lambda y: y IS NOT NULL))) l FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, len(l)::INT n, l[1] AS first, l[-1] AS last FROM d WHERE len(l) > 0""",
    "procedure_steps": r"""SELECT doc_id, (CASE WHEN a >= 2 THEN a ELSE b END)::INT steps FROM (SELECT doc_id, len(regexp_extract_all(text, '(?m)^\s*(?:\d+[.)]|Step \d+:?)\s+(.+)$')) a, len(regexp_extract_all(text, '(?m)^\s*[-*•]\s+(.+)$')) b FROM documents WHERE text IS NOT NULL) WHERE a >= 2 OR b >= 2""",
}

#: Letters beyond ASCII are letters for the queries' word boundaries, but not for those of SQL.
_MESSAGES = "(SELECT regexp_replace(min(text), '[À-ÖØ-öø-ɏ぀-ヿ一-鿿]', 'q', 'g') AS text FROM segments WHERE text IS NOT NULL GROUP BY segment_id)"


def _first(patterns: list[tuple[str, str]], default: str, of: str = "trim(text, ' ')") -> str:
    cases = " ".join(f"WHEN regexp_matches({of}, '(?i-s){p.replace(chr(39), chr(39) * 2)}') THEN '{name}'" for name, p in patterns)
    return f"CASE {cases} ELSE '{default}' END"


_ROUTE = _first([(next(iter(extra)), p) for p, extra in Q.ROUTES], "segments", "text")
_SHARES = [round((Q.BASE | extra).get("segments", 0) / sum((Q.BASE | extra).values()), 6) for _, extra in Q.ROUTES]
_COUNTS = ", ".join("(" + " + ".join(f"regexp_matches(text, '(?i-s){p.replace(chr(39), chr(39) * 2)}')::INT" for p in ps) + f") {k}" for k, ps in Q.INTENTS.items())
_ALL = " + ".join(Q.INTENTS)
ORACLE |= {
    "classify_v1": f"SELECT {_first(T.MODES_V1, 'factual')} AS mode, count(*) n FROM {_MESSAGES} GROUP BY 1",
    "classify_v2": f"SELECT {_first(T.MODES_V2, 'synthesis')} AS mode, count(*) n FROM {_MESSAGES} GROUP BY 1",
    "intents": f"""WITH c AS (SELECT {_COUNTS} FROM {_MESSAGES}), b AS (SELECT *, {_ALL} AS whole, greatest({', '.join(Q.INTENTS)}) best FROM c)
        SELECT CASE WHEN whole = 0 OR best / whole < 0.4 THEN 'default' {' '.join(f"WHEN {k} = best THEN '{k}'" for k in Q.INTENTS)} END intent, count(*) n FROM b GROUP BY 1""",
    "index_routes": f"""SELECT {_ROUTE} AS index, CASE WHEN regexp_matches(text, '(?i-s){Q.RECENT}') THEN 'recent' WHEN regexp_matches(text, '(?i-s){Q.HISTORICAL}') THEN 'historical' ELSE 'any' END hint,
        (CASE {' '.join(f"WHEN regexp_matches(text, '(?i-s){p.replace(chr(39), chr(39) * 2)}') THEN {x}" for (p, _), x in zip(Q.ROUTES, _SHARES, strict=True))} ELSE {round(Q.BASE['segments'] / sum(Q.BASE.values()), 6)} END)::DOUBLE segments, count(*) n FROM {_MESSAGES} GROUP BY 1, 2, 3""",
}
