"""Registered queries of single scoring and text functions over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecast.functions import extraction as X
from lorecast.functions import ranking, routing
from lorecast.functions import scores as C
from lorecast.functions import text as T
from lorecast.io import table
from lorecast.operators import graph as G


def _events(s: SparkSession, d: str) -> DataFrame:
    """Events as counters: c (0 and up), u, v (0 to 100), and a flag."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    return table(s, d, "events").select("event_id", k.alias("c"), F.col("user_id").alias("u"), F.col("value").alias("v"), (k % 3 == 0).alias("flag"))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null")


def _r(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


def specificity(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", _r(T.specificity(F.col("text")), "specificity"))


def promotion_scores(s: SparkSession, d: str) -> DataFrame:
    """Novelty, confidence, relevance, importance, promotion from counters, and the older weights with their tiers."""
    c, u, v = F.col("c"), F.col("u"), F.col("v")
    legacy = C.legacy_promotion([v / 100, C.unit(c / 50), F.lit(0.5), v / 100, F.lit(0.5), C.unit(u / 150), F.lit(1.0)])
    return _events(s, d).select(
        "event_id", _r(C.novelty(v, c.cast("double"), F.col("flag")), "novelty"), _r(C.confidence(v / 100, c, F.col("flag")), "confidence"), _r(C.user_relevance(c, u, F.when(F.col("flag"), v / 50 - 1).otherwise(0.0)), "relevance"),
        _r(C.promotion_importance(u, c, v, F.lit(0.5)), "importance"), _r(C.metric_promotion(c, u, c % 7, v, c), "metric"), _r(legacy, "legacy"), C.legacy_tier(F.round(legacy, 6)).alias("tier"),
    )


def relation_scores(s: SparkSession, d: str) -> DataFrame:
    c = F.col("c")
    return _events(s, d).select("event_id", _r(C.relation_score(F.col("v") / 100, c, c + 1), "relation", 8), _r(C.log_centrality(F.col("u")), "centrality"), _r(F.least(F.lit(1.0), F.col("u") / 50), "hub"))


def evidence_vectors(s: SparkSession, d: str) -> DataFrame:
    """The five factors of evidence and the authority of a source by its type, confidence, citations and whether it is primary."""
    kind = F.get(F.array(*[F.lit(k) for k in C.AUTHORITY]), F.col("c") % len(C.AUTHORITY))
    factors = C.evidence_factors(F.lit(0.5), F.col("c"), F.col("v"), F.lit(0.3), F.lit(1.0))
    return _events(s, d).select("event_id", _r(C.source_authority(kind, F.col("v") / 100, F.col("c"), F.col("flag")), "authority"), _r(F.get(factors, 1), "corroboration"), _r(F.get(factors, 2), "recency"))


def reinforcement(s: SparkSession, d: str) -> DataFrame:
    """Reinforced scores, thresholds moved towards their target acceptance, and success rates."""
    c, u, v = F.col("c"), F.col("u"), F.col("v")
    return _events(s, d).select("event_id", _r(C.reinforce(v / 100), "reinforced"), _r(C.adaptive_threshold(v / 100, F.least(c, u), u), "threshold"), _r(C.success_rate(F.least(c, u), u % 20 * c), "success"))


def entity_importance(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "entities").groupBy("entity_id").agg(*[F.max(c).alias(c) for c in ("mention_count", "source_count", "retrieval_count")])
    return rows.select("entity_id", _r(C.entity_importance(F.col("mention_count"), F.col("source_count"), F.col("retrieval_count"), F.lit(0.25)), "importance"))


def embedding_spaces(s: SparkSession, d: str) -> DataFrame:
    """The spaces of objects by status and type."""
    status, kind = (F.get(F.array(*[F.lit(x) for x in xs]), F.col(c) % len(xs)) for xs, c in ((["raw", "provisional", "promoted", "manifold"], "c"), (["claim", "procedure", "entity", "memory", "segment"], "u")))
    return _events(s, d).select(status.alias("status"), kind.alias("kind"), F.array_join(C.spaces_of(status, kind), ",").alias("spaces")).groupBy("status", "kind", "spaces").agg(F.count("*").alias("n"))


EDGE_NAMES = ["USES", "Depends-On", "caused by", "owns", "similar_to", "mentions", "replaces", "triggers", "part_of"]


def edge_categories(s: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*[F.lit(x) for x in EDGE_NAMES]), (F.col("event_id") % len(EDGE_NAMES)).cast("int"))
    return _events(s, d).groupBy(C.edge_category(name).alias("category")).agg(F.count("*").alias("n"))


def type_fit(s: SparkSession, d: str) -> DataFrame:
    """How well segments fit modes of questions, and the penalty for what says nothing."""
    mode = F.get(F.array(*[F.lit(m) for m in C.TYPE_FIT]), (F.col("doc_id") % len(C.TYPE_FIT)).cast("int"))
    kind = F.get(F.array(*[F.lit(k) for k in ("memory", "claim", "entity", "segment", "summary", "tool_call", "event")]), (F.col("doc_id") % 13 % 7).cast("int"))
    return _docs(s, d).select("doc_id", C.type_fit(mode, kind).alias("fit"), _r(C.noise_penalty(F.col("text"), kind), "noise"))


def comparisons(s: SparkSession, d: str) -> DataFrame:
    """Outcomes of comparing the results of two paths, and the winner."""
    c, u, v = F.col("c"), F.col("u"), F.col("v")
    outcome = C.compared(v / 100, (c % 5).cast("double"), (u % 5).cast("double"))
    won = C.winner(c % 4, u % 4, F.least(c % 4, u % 4), v / 100, u.cast("double"), v)
    return _events(s, d).groupBy(outcome.alias("outcome"), won.alias("winner")).agg(F.count("*").alias("n"))


def injected(s: SparkSession, d: str) -> DataFrame:
    """Scores of segments for the state of a session."""
    seg = table(s, d, "segments").groupBy("segment_id").agg(F.min("segment_type").alias("segment_type"), F.min("source_id").alias("source_id"), F.min("ordinal").alias("ordinal"))
    src = table(s, d, "sources").groupBy("source_id").agg(F.min("source_type").alias("source_type"))
    state = F.get(F.array(*[F.lit(x) for x in C.STATE_WORDS]), (F.coalesce("ordinal", F.lit(0)) % len(C.STATE_WORDS)).cast("int"))
    rows = seg.join(src, "source_id", "left")
    return rows.select("segment_id", _r(C.injection_score(state, F.lit(None).cast("double"), F.col("segment_type"), F.col("source_type")), "score"))


def feedback_outcomes(s: SparkSession, d: str) -> DataFrame:
    """What messages say about what was retrieved (three texts, of which some are cited)."""
    cited = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("x")), 1, (F.col("doc_id") % 4).cast("int"))
    got = routing.feedback(F.col("text"), F.array(F.lit("a"), F.lit("b"), F.lit("c")), cited)
    return _docs(s, d).select(got.alias("o")).groupBy("o.outcome", "o.confidence").agg(F.count("*").alias("n"))


def evidence_fused(s: SparkSession, d: str) -> DataFrame:
    """Weighted spaces and signals less penalties."""
    rows = _events(s, d).select("event_id", (F.col("v") / 100).alias("topic"), (F.col("c") / 50).alias("claim"), (F.col("u") / 150).alias("lexical"), F.when(F.col("flag"), 1.0).alias("noise"))
    return rows.select("event_id", _r(ranking.evidence_fusion({"topic": 0.4, "claim": 0.2}, {"lexical": 0.15}, {"noise": 0.25}), "score"))


def text_time(s: SparkSession, d: str) -> DataFrame:
    v = X.text_time_features(F.col("text"))
    return _docs(s, d).select("doc_id", F.transform(v, lambda x: F.round(x, 6)).alias("v")).select("doc_id", *[F.get("v", i).alias(f"f{i}") for i in range(12)])


def mined(s: SparkSession, d: str) -> DataFrame:
    rows = _docs(s, d).select("doc_id", X.mined_claims(F.col("text")).alias("c"), X.mined_steps(F.col("text")).alias("s"), X.mined_questions(F.col("doc_type"), F.col("text")).alias("q"))
    return rows.select("doc_id", F.size("c").alias("claims"), F.get("c", 0).alias("claim"), F.size("s").alias("steps"), F.get("s", 0).alias("step"), F.size("q").alias("questions"), F.get("q", 0).alias("question"))


def plain_paths(s: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/api/tenant/"), F.coalesce("owner_tenant_id", F.lit("none")), F.lit("/SEG_"), F.regexp_replace("segment_id", "[^A-Za-z0-9]", ""), F.lit("/view"))
    return table(s, d, "segments").select(X.plain_path(path).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def answers_json(s: SparkSession, d: str) -> DataFrame:
    """Lists read out of answers with words around them and a comma too many."""
    answer = F.concat(F.lit('Here it is: [{"id": '), F.col("doc_id").cast("string"), F.lit(', "ok": true,}, ] and that is all.'))
    found = X.repaired_json(answer)
    return _docs(s, d).select("doc_id", F.get_json_object(found, "$[0].id").cast("long").alias("id"), found.alias("json"))


def ordered_causes(s: SparkSession, d: str) -> DataFrame:
    """Causes with times: whether they come first, the hours between, and the confidence."""
    rows = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).where("l_linenumber = 1")
    got = X.in_order(F.lit(0.9), F.col("l_shipdate").cast("timestamp"), F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(30)))
    return rows.select("o_orderkey", got.alias("g")).select("o_orderkey", "g.valid", _r(F.col("g.gap_hours"), "gap_hours", 3), "g.confidence")


def nation_fingerprints(s: SparkSession, d: str) -> DataFrame:
    """Similarity of nodes by what goes out of them, comes in, and is next to them: 0.3, 0.3 and 0.4 of three multiset Jaccards."""
    people = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("node"), "c_mktsegment")
    orders = table(s, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    count = lambda df, c: df.groupBy("node", F.col(c).alias("key")).agg(F.count("*").alias("n"))
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("a"))
    pairs = n.join(n.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))  # 25 nations, a table of fixed size
    return G.fingerprint_similarity(count(orders, "o_orderpriority"), count(orders, "o_orderstatus"), count(people, "c_mktsegment"), "node", "key", "n", pairs).select("a", "b", _r(F.col("similarity"), "similarity"))


QUERIES = {f.__name__: f for f in (
    specificity, promotion_scores, relation_scores, evidence_vectors, reinforcement, entity_importance, embedding_spaces, edge_categories, type_fit, comparisons, injected, feedback_outcomes,
    evidence_fused, text_time, mined, plain_paths, answers_json, ordered_causes, nation_fingerprints,
)}

_E = "e AS (SELECT event_id, coalesce(json_extract_string(props, '$.k')::INT, 0) c, user_id u, value v FROM events)"
_UNIT = "greatest(0.0, least(1.0, {}))"


def _case(key: str, values: dict, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


def _names(names: list, at: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + f"][({at}) % {len(names)} + 1]"


def _has(pattern: str, weight: float) -> str:
    return f"CASE WHEN regexp_matches(text, '{pattern}') THEN {weight} ELSE 0.0 END"


def _pick(words: list, of: str = "w") -> str:
    return f"len(list_filter({of}, lambda x: x IN (" + ", ".join(f"'{x}'" for x in words) + ")))"


def _stack(parts: list[str], least: int, most: int) -> str:
    kept = f"list_filter(list_transform(flatten([{', '.join(parts)}]), lambda x: trim(x)), lambda x: length(x) > {least})"
    return f"list_filter({kept}, lambda x, i: list_position(list_transform({kept}, lambda y: lower(y)), lower(x)) = i)[1:{most}]"


_FEED = lambda ws: "(" + " OR ".join(f"contains(lower(text), '{w.replace(chr(39), chr(39) * 2)}')" for w in ws) + ")"
_BOOST = "CASE " + " ".join(f"WHEN st = '{k}' THEN " + " + ".join(f"CASE WHEN contains(lower(coalesce(segment_type, '')), '{w}') OR contains(lower(coalesce(source_type, '')), '{w}') THEN {x} ELSE 0 END" for w, x in ws.items()) for k, ws in C.STATE_WORDS.items()) + " END"
_LEGACY = "round(0.25 * v / 100 + 0.20 * greatest(0, least(1, c / 50)) + 0.15 * 0.5 + 0.15 * v / 100 + 0.10 * 0.5 + 0.10 * greatest(0, least(1, u / 150)) + 0.05, 6)"
_GRAIN = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN {x}" for p, x in X.GRANULARITY) + " ELSE 0 END"
_DATED = " OR ".join(f"regexp_matches(text, '{p}')" for p in (X.ISO_TIME, X.ISO_DATE, X.DATE_MDY, X.DATE_DMY))
ORACLE = {
    "temporal_vector": f"""WITH d AS (SELECT doc_id, text, created_at t, epoch(TIMESTAMP '2026-06-01' - created_at) ago, hour(created_at) + minute(created_at) / 60 h, isodow(created_at) - 1 w, regexp_extract(text, '{X.DURATION}', 1) n, lower(regexp_extract(text, '{X.DURATION}', 2)) u FROM documents WHERE text IS NOT NULL AND created_at IS NOT NULL)
        SELECT doc_id, round(greatest(0, least(1, epoch(t - TIMESTAMP '2020-01-01') / epoch(TIMESTAMP '2026-06-01' - TIMESTAMP '2020-01-01'))), 6)::DOUBLE f0, round(exp(-ago / 86400 / 43.3), 6) f1, round(sin(2 * pi() * h / 24), 6) f2, round(cos(2 * pi() * h / 24), 6) f3, round(sin(2 * pi() * w / 7), 6) f4, round(cos(2 * pi() * w / 7), 6) f5,
        (hour(t) BETWEEN 9 AND 16 AND w < 5)::INT::DOUBLE f6, ({_GRAIN})::DOUBLE f7, round(CASE WHEN n = '' OR length(n) > 16 THEN 0 ELSE least(1, ln(1 + n::DOUBLE * CASE WHEN starts_with(u, 'sec') THEN 1 WHEN starts_with(u, 'min') THEN 60 WHEN starts_with(u, 'h') THEN 3600 WHEN starts_with(u, 'd') THEN 86400 ELSE 604800 END) / ln(1 + 31536000)) END, 6)::DOUBLE f8,
        round(doc_id % 10 / 9, 6)::DOUBLE f9, ({_DATED})::INT::DOUBLE f10, round(exp(-abs(ago) / 86400 / 30), 6) f11 FROM d""",
    "specificity": "SELECT doc_id, round(" + _UNIT.format("0.3 + " + " + ".join(_has(p, w) for p, w in T.SPECIFIC) + " - (" + " + ".join(_has(f"(?i)(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])", 0.05) for w in T.VAGUE) + ")") + ", 6)::DOUBLE specificity FROM documents WHERE text IS NOT NULL",
    "promotion_scores": f"""WITH {_E} SELECT event_id, round({_UNIT.format("0.5 * greatest(0.2, 1 - v / 60) + CASE WHEN c > 0 THEN least(0.3, c / 10) ELSE 0 END + CASE WHEN c % 3 = 0 THEN 0.2 ELSE 0 END")}, 6) novelty,
        round({_UNIT.format("greatest(0, least(1, v / 100)) + least(0.2, ln(1 + c) / 9) - CASE WHEN c % 3 = 0 THEN 0.3 ELSE 0 END")}, 6) confidence,
        round({_UNIT.format("CASE WHEN c % 3 = 0 AND v / 50 - 1 <> 0 THEN 0.5 * least(1, (ln(1 + c) + ln(1 + u)) / 6) + 0.5 * (v / 50) / 2 ELSE least(1, (ln(1 + c) + ln(1 + u)) / 6) END")}, 6) relevance,
        round(0.3 * least(1, ln(1 + u) / 5) + 0.3 * least(1, ln(1 + c) / 4) + 0.2 * exp(-greatest(v, 0) * ln(2) / 30) + 0.1, 6) importance,
        round({_UNIT.format("0.20 * least(1, c / 10) + 0.15 * least(1, u / 50) + 0.05 + 0.20 * greatest(0, 1 - 0.2 * (c % 7)) + 0.10 * greatest(0, 1 - v / 365) + 0.05 + 0.15 * least(1, c / 5)")}, 6) metric,
        {_LEGACY} legacy, CASE WHEN {_LEGACY} >= 0.85 THEN 'manifold' WHEN {_LEGACY} >= 0.70 THEN 'promoted' WHEN {_LEGACY} >= 0.45 THEN 'provisional' ELSE 'raw' END tier FROM e""",
    "relation_scores": f"WITH {_E} SELECT event_id, round(0.4 * (v / 100) + 0.3 * least(1, ln(1 + c) / 1.8) + 0.3 / (c + 1), 8) relation, round(ln(1 + u) / ln(101), 6) centrality, round(least(1.0, u / 50), 6) hub FROM e",
    "evidence_vectors": f"WITH {_E} SELECT event_id, round(least(1, {_case(_names(list(C.AUTHORITY), 'c'), C.AUTHORITY, '0.3')} * (0.8 + 0.2 * v / 100) * (1 + 0.1 * least(1, ln(1 + c) / 3)) * CASE WHEN c % 3 = 0 THEN 1.1 ELSE 1 END), 6)::DOUBLE authority, round(least(1, ln(1 + c) / 2), 6) corroboration, round(exp(-v / 60), 6) recency FROM e",
    "reinforcement": f"""WITH {_E} SELECT event_id, round(least(1, v / 100 + 0.2), 6) reinforced, round(greatest(0.3, least(0.95, CASE WHEN u < 5 THEN v / 100 WHEN least(c, u) / u < 0.7 - 0.1 THEN v / 100 + 0.05 WHEN least(c, u) / u > 0.7 + 0.1 THEN v / 100 - 0.05 ELSE v / 100 END)), 6) threshold,
        round(CASE WHEN u % 20 * c = 0 THEN 0.5 ELSE least(c, u) / (u % 20 * c) END, 6)::DOUBLE success FROM e""",
    "entity_importance": "SELECT entity_id, round(least(1, 0.3 * ln(greatest(coalesce(max(mention_count), 1), 1)) / ln(100) + 0.3 * ln(greatest(coalesce(max(source_count), 1), 1)) / ln(50) + 0.2 * ln(greatest(coalesce(max(retrieval_count), 1), 1)) / ln(100) + 0.05), 6) importance FROM entities GROUP BY 1",
    "embedding_spaces": f"""WITH {_E}, x AS (SELECT {_names(["raw", "provisional", "promoted", "manifold"], "c")} status, {_names(["claim", "procedure", "entity", "memory", "segment"], "u")} kind FROM e)
        SELECT status, kind, CASE WHEN status = 'raw' THEN '' WHEN status IN ('promoted', 'manifold') AND kind IN ('claim', 'procedure', 'entity') THEN 'topic,' || replace(kind, 'entity', 'relation') ELSE 'topic' END spaces, count(*) n FROM x GROUP BY 1, 2, 3""",
    "edge_categories": f"SELECT CASE {' '.join(f'''WHEN t IN ({', '.join(chr(39) + x + chr(39) for x in ts)}) THEN '{k}' ''' for k, ts in C.EDGE_CATEGORIES.items())} ELSE 'other' END category, count(*) n FROM (SELECT translate(lower({_names(EDGE_NAMES, 'event_id')}), '- ', '__') t FROM events) GROUP BY 1",
    "type_fit": f"""WITH d AS (SELECT doc_id, text, {_names(list(C.TYPE_FIT), "doc_id")} m, {_names(["memory", "claim", "entity", "segment", "summary", "tool_call", "event"], "doc_id % 13")} k FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, (CASE {" ".join(f"WHEN m = '{m}' THEN {_case('k', fits, '0.5')}" for m, fits in C.TYPE_FIT.items())} END)::DOUBLE fit,
        round(least(1, CASE WHEN length(text) < 20 THEN 0.5 WHEN length(text) < 50 THEN 0.2 ELSE 0 END + CASE WHEN k = 'tool_call' THEN 0.3 ELSE 0 END + CASE WHEN lower(trim(text)) IN ({", ".join(f"'{x}'" for x in C.NOISE)}) THEN 0.4 ELSE 0 END), 6)::DOUBLE noise FROM d""",
    "comparisons": f"""WITH {_E}, x AS (SELECT v / 100 o, c % 5 p, u % 5 q, c % 4 a, u % 4 b, u, v FROM e) SELECT CASE WHEN o >= 0.9 THEN 'match' WHEN o >= 0.5 THEN 'partial_match' WHEN o < 0.2 THEN CASE WHEN p > q * 1.1::DOUBLE THEN 'new_better' WHEN q > p * 1.1::DOUBLE THEN 'old_better' ELSE 'divergent' END ELSE 'divergent' END outcome,
        CASE WHEN a = 0 AND b = 0 THEN 'tie' WHEN a = 0 THEN 'new' WHEN b = 0 THEN 'old' WHEN o > 0.8 THEN 'tie' WHEN v < u * 0.7::DOUBLE THEN 'new' WHEN u < v * 0.7 THEN 'old' ELSE 'unknown' END winner, count(*) n FROM x GROUP BY 1, 2""",
    "injected": f"""WITH g AS (SELECT segment_id, min(segment_type) segment_type, min(source_id) source_id, min(ordinal) o FROM segments GROUP BY 1), c AS (SELECT source_id, min(source_type) source_type FROM sources GROUP BY 1), x AS (SELECT *, {_names(list(C.STATE_WORDS), "coalesce(o, 0)")} st FROM g LEFT JOIN c USING (source_id))
        SELECT segment_id, round(least(1, 0.5 + {_BOOST}), 6)::DOUBLE score FROM x""",
    "feedback_outcomes": f"""SELECT outcome, confidence::DOUBLE confidence, count(*) n FROM (SELECT CASE WHEN {_FEED(routing.NEGATIVE)} THEN 'corrected' WHEN {_FEED(routing.POSITIVE)} THEN 'confirmed' WHEN doc_id % 4 >= 2 THEN 'used' WHEN doc_id % 4 = 1 THEN 'continued' ELSE 'ambiguous' END outcome,
        CASE WHEN {_FEED(routing.NEGATIVE)} THEN 0.85 WHEN {_FEED(routing.POSITIVE)} THEN 0.75 WHEN doc_id % 4 >= 2 THEN 0.7 WHEN doc_id % 4 = 1 THEN 0.5 ELSE 0.3 END confidence FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2""",
    "evidence_fused": f"WITH {_E} SELECT event_id, round(greatest(0, 0.4 * v / 100 + 0.2 * c / 50 + 0.15 * u / 150 - CASE WHEN c % 3 = 0 THEN 0.25 ELSE 0 END), 6) score FROM e",
    "text_time": f"""WITH d AS (SELECT doc_id, lower(text) t, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') w FROM documents WHERE text IS NOT NULL),
        n AS (SELECT *, {_pick(X.TENSES["future"])} fu, {_pick(X.TENSES["past"])} pa, {_pick(X.TENSES["present"])} pr FROM d)
        SELECT doc_id, regexp_matches(t, '{X.STAMP}')::INT::DOUBLE f0, round(least(1, {_pick(X.NOW_WORDS)} / 3), 6)::DOUBLE f1, round(fu / (fu + pa + pr + 1), 6) f2, round(pa / (fu + pa + pr + 1), 6) f3, round(pr / (fu + pa + pr + 1), 6) f4,
        round(least(1, {_pick(X.TIME_WORDS)} / 5), 6)::DOUBLE f5, regexp_matches(t, '{X.SPAN}')::INT::DOUBLE f6, regexp_matches(t, '{"|".join(X.OFTEN)}')::INT::DOUBLE f7, round(least(1, {_pick(X.ORDER_WORDS)} / 3), 6)::DOUBLE f8,
        regexp_matches(t, '{"|".join(X.DUE)}')::INT::DOUBLE f9, regexp_matches(t, '{"|".join(X.PAST)}')::INT::DOUBLE f10, round(least(1, len(w) / 500), 6)::DOUBLE f11 FROM n""",
    "mined": f"""WITH d AS (SELECT doc_id, {_stack([f"regexp_extract_all(text, '{p}', 1)" for p in X.STATEMENTS], 20, 10)} c,
        {_stack([f"regexp_extract_all(text, '{p}', 1)" for p in (r"(?:^|\n)[ \t]*[0-9]+[.):][ \t]*([^\n]+)", r"(?:^|\n)[ \t]*[-•*][ \t]*([^\n]+)", X.COMMANDS)], 5, 20)} s,
        list_filter([CASE WHEN length(doc_type) > 5 THEN 'What is ' || doc_type || '?' END, CASE WHEN regexp_matches(text, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') THEN 'What is at ' || regexp_extract(text, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') || '?' END,
            CASE WHEN length(substring(string_split(trim(text, ' '), chr(10))[1], 1, 200)) > 20 THEN substring(string_split(trim(text, ' '), chr(10))[1], 1, 200) END], lambda x: x IS NOT NULL) q FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, len(c)::INT claims, c[1] claim, len(s)::INT steps, s[1] step, len(q)::INT questions, q[1] question FROM d""",
    "plain_paths": "SELECT '/api/tenant/{tenant_id}/{segment_id}/view' AS path, count(*) n FROM segments WHERE segment_id IS NOT NULL",
    "answers_json": "SELECT doc_id, doc_id id, '[{\"id\": ' || doc_id || ', \"ok\": true}]' AS json FROM documents WHERE text IS NOT NULL",
    "ordered_causes": "SELECT o_orderkey, l_shipdate < o_orderdate + INTERVAL 30 DAY AS valid, CASE WHEN l_shipdate < o_orderdate + INTERVAL 30 DAY THEN round(epoch(o_orderdate + INTERVAL 30 DAY - l_shipdate) / 3600, 3) END gap_hours, CASE WHEN l_shipdate < o_orderdate + INTERVAL 30 DAY THEN 0.9 ELSE 0.45 END::DOUBLE confidence FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1",
    "nation_fingerprints": "WITH p AS (SELECT c_custkey, c_nationkey n, c_mktsegment FROM customer), o AS (SELECT n, o_orderpriority, o_orderstatus FROM orders JOIN p ON o_custkey = c_custkey), k AS (SELECT 1 part, n, o_orderpriority k, count(*) c FROM o GROUP BY 2, 3 UNION ALL SELECT 2, n, o_orderstatus, count(*) FROM o GROUP BY 2, 3 UNION ALL SELECT 3, n, c_mktsegment, count(*) FROM p GROUP BY 2, 3),"
    " x AS (SELECT a.n_nationkey a, b.n_nationkey b, part, k FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey, (SELECT DISTINCT part, k FROM k)), j AS (SELECT x.a, x.b, x.part, sum(least(coalesce(u.c, 0), coalesce(v.c, 0))) / nullif(sum(greatest(coalesce(u.c, 0), coalesce(v.c, 0))), 0) s FROM x LEFT JOIN k u ON u.part = x.part AND u.k = x.k AND u.n = x.a LEFT JOIN k v ON v.part = x.part AND v.k = x.k AND v.n = x.b GROUP BY 1, 2, 3)"
    " SELECT a, b, round(sum(CASE part WHEN 3 THEN 0.4 ELSE 0.3 END * coalesce(s, 1)), 6)::DOUBLE similarity FROM j GROUP BY 1, 2",
}
