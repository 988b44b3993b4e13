"""Problem 4: rebuilding conversations from message rows.

Rows are an event log: every row with the key of a message is a create, an edit or a retry of it, the version tells
which is the last, and a tombstone deletes it. The fold keeps one final turn per message; conversations are ordered and
validated afterwards, by aggregates that are combined before the shuffle, so one source may hold any share of the rows.

A conversation is dropped if it has no message; no user or no assistant message that isn't blank; no such assistant
message after the last such user message; a message that isn't blank without one of the four roles; ordinals that
aren't 0, 1, 2 ... without gap or repetition; or no ordinal at all and some missing timestamp.

Defined cases: a null text is blank; a null message key makes each distinct row a message of its own; rows whose source
is null or no conversation are ignored; a null version is older than any other; equal versions are settled by the
content, so the result doesn't depend on the order of rows; an empty table gives every conversation as one to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.io import table

ROLES = {
    "user": ["user", "human", "usr", "customer", "client", "enduser", "person", "prompter", "asker", "me"],
    "assistant": ["assistant", "bot", "model", "ai", "chatbot", "agent", "llm", "aiassistant", "gpt", "asst", "assistent"],
    "system": ["system", "developer", "sys", "systemprompt", "dev"],
    "tool": ["tool", "function", "toolresult", "toolcall", "tooluse", "functioncall", "functionresult", "plugin", "toolresponse"],
}
CONVERSATION_TYPES = ("conversation", "conversation_session")
#: A text of white space only, no-break spaces included.
BLANK = r"^[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\u001C-\u001F]*\z"


def is_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(BLANK), F.lit(True))


def canonical_role(role: Column) -> Column:
    """user, assistant, system or tool; null for a role that is missing or names none of them."""
    plain = F.lower(F.regexp_replace(role, r"[^\p{L}]", ""))
    out = F
    for name, spellings in ROLES.items():
        out = out.when(plain.isin(spellings), name)
    return out


def final_turns(segments: DataFrame, payload: list[str], tombstone: Column | None = None) -> DataFrame:
    """The log folded by message key: source_id, segment_id and the payload of each message's last version."""
    key = F.coalesce("segment_id", F.concat(F.lit("\0"), F.xxhash64(*[F.col(c) for c in payload]).cast("string")))
    version = F.struct(F.col("created_at"), *[F.col(c) for c in payload])
    rows = segments.where(F.col("source_id").isNotNull())
    gone = tombstone if tombstone is not None else F.lit(False)
    folded = rows.groupBy("source_id", key.alias("message")).agg(
        F.max(F.struct(version.alias("v"), gone.alias("gone"))).alias("last"), F.first("segment_id").alias("segment_id")
    )
    return folded.where(~F.coalesce("last.gone", F.lit(False))).select(
        "source_id", "segment_id", *[F.col(f"last.v.{c}").alias(c) for c in payload]
    )


def conversation_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("source_type").isin(*CONVERSATION_TYPES) & F.col("source_id").isNotNull()).select("source_id").distinct()


def verdicts(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per conversation: source_id, n_messages, ordered_by and faults (array of names, empty if it is whole)."""
    light = segments.select(
        "source_id", "segment_id", "created_at", "ordinal", "message_timestamp",
        canonical_role(F.col("speaker_role")).alias("role"), is_blank(F.col("text")).alias("blank"),
    )
    turns = final_turns(light, ["ordinal", "message_timestamp", "role", "blank"])
    says = lambda role: ~F.col("blank") & (F.col("role") == role)
    by_ordinal = turns.groupBy("source_id", "ordinal").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("message_timestamp").isNull()).alias("no_time"),
        F.count_if(~F.col("blank") & F.col("role").isNull()).alias("bad_role"),
        *[F.max(F.when(says(r), F.col("message_timestamp"))).alias(f"{r}_time") for r in ("user", "assistant")],
        *[F.max(says(r)).alias(r) for r in ("user", "assistant")],
    )
    whole = by_ordinal.groupBy("source_id").agg(
        F.sum("n").alias("n"), F.sum("no_time").alias("no_time"), F.sum("bad_role").alias("bad_role"),
        F.count("ordinal").alias("places"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"),
        *[F.max(f"{r}_time").alias(f"{r}_time") for r in ("user", "assistant")],
        *[F.max(F.when(F.col(r), F.col("ordinal"))).alias(f"{r}_place") for r in ("user", "assistant")],
        *[F.max(r).alias(r) for r in ("user", "assistant")],
    )
    timed = F.col("places") == 0
    sequence = (F.col("places") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    answered = F.when(timed, F.col("assistant_time") > F.col("user_time")).otherwise(F.col("assistant_place") > F.col("user_place"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    faults = {
        "no_message": F.col("n").isNull(),
        "no_user": F.col("n").isNotNull() & ~yes(F.col("user")),
        "no_assistant": F.col("n").isNotNull() & ~yes(F.col("assistant")),
        "no_reply": yes(F.col("user")) & yes(F.col("assistant")) & ~yes(answered),
        "bad_role": yes(F.col("bad_role") > 0),
        "broken_order": yes(~timed & ~sequence),
        "no_time": yes(timed & (F.col("no_time") > 0)),
    }
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in faults.items()]))
    return conversation_sources(sources).join(whole, "source_id", "left").select(
        "source_id", F.coalesce("n", F.lit(0)).alias("n_messages"),
        F.when(timed, "message_timestamp").otherwise("ordinal").alias("ordered_by"), named.alias("faults"),
    )


def dialogues(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """The messages of whole conversations: source_id, turn from 0, role, text, message_timestamp, segment_id.

    Blank messages keep their turn. Turns by time are numbered within hours, and the hours are added up, so that no
    task has to sort all messages of a source.
    """
    good = verdicts(segments, sources).where(F.size("faults") == 0).select("source_id", "ordered_by")
    payload = segments.select(
        "source_id", "segment_id", "created_at", "ordinal", "message_timestamp", "text",
        canonical_role(F.col("speaker_role")).alias("role"),
    )
    turns = final_turns(payload, ["ordinal", "message_timestamp", "role", "text"]).join(good, "source_id")
    out = ["source_id", "turn", "role", "text", "message_timestamp", "segment_id"]
    placed = turns.where(F.col("ordered_by") == "ordinal").withColumn("turn", F.col("ordinal"))
    timed = turns.where(F.col("ordered_by") == "message_timestamp").withColumn("hour", F.date_trunc("hour", "message_timestamp"))
    before = (
        timed.groupBy("source_id", "hour").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("source_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)))
        .select("source_id", "hour", F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("source_id", "hour").orderBy("message_timestamp", "segment_id")
    by_time = timed.withColumn("rank", F.row_number().over(within)).join(before, ["source_id", "hour"]).withColumn("turn", F.col("before") + F.col("rank") - 1)
    return placed.select(*out).unionByName(by_time.select(*out))


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "segments"), table(spark, folder, "sources")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(*_tables(spark, folder)).where(F.size("faults") > 0).select("source_id")


def p4_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(*_tables(spark, folder)).withColumn("faults", F.array_join("faults", ","))


def p4_dialogues(spark: SparkSession, folder: str) -> DataFrame:
    return dialogues(*_tables(spark, folder))


QUERIES = {"p4_found": p4_found, "p4_verdicts": p4_verdicts, "p4_dialogues": p4_dialogues}

_IN = {role: ", ".join(f"'{s}'" for s in spellings) for role, spellings in ROLES.items()}
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"
_TURNS = f"""
    t AS (SELECT DISTINCT g.source_id, segment_id, ordinal, message_timestamp ts, text,
            coalesce(regexp_full_match(text, '{_SPACE}'), true) blank,
            CASE {' '.join(f"WHEN plain IN ({names}) THEN '{role}'" for role, names in _IN.items())} END role
        FROM (SELECT *, lower(regexp_replace(speaker_role, '[^A-Za-z]', '', 'g')) plain FROM segments) g
        WHERE source_id IN (SELECT source_id FROM sources WHERE source_type IN ('conversation', 'conversation_session'))),
    v AS (SELECT s.source_id,
            count(t.source_id) n, count(ordinal) placed, count(DISTINCT ordinal) places, min(ordinal) low, max(ordinal) high,
            count(*) FILTER (WHERE ts IS NULL) no_time,
            count(*) FILTER (WHERE NOT blank AND role = 'user') users,
            count(*) FILTER (WHERE NOT blank AND role = 'assistant') assistants,
            count(*) FILTER (WHERE NOT blank AND role IS NULL) bad,
            max(ordinal) FILTER (WHERE NOT blank AND role = 'user') uo, max(ordinal) FILTER (WHERE NOT blank AND role = 'assistant') ao,
            max(ts) FILTER (WHERE NOT blank AND role = 'user') utime, max(ts) FILTER (WHERE NOT blank AND role = 'assistant') atime
        FROM (SELECT DISTINCT source_id FROM sources WHERE source_type IN ('conversation', 'conversation_session')) s
        LEFT JOIN t USING (source_id) GROUP BY 1),
    d AS (SELECT *, n = 0 OR users = 0 OR assistants = 0 OR bad > 0
            OR (placed > 0 AND NOT (placed = n AND places = n AND low = 0 AND high = n - 1))
            OR (placed = 0 AND no_time > 0)
            OR NOT coalesce(CASE WHEN placed = 0 THEN atime > utime ELSE ao > uo END, false) faulty FROM v)"""
ORACLE = {
    "p4_found": f"WITH {_TURNS} SELECT source_id FROM d WHERE faulty",
    "p4_dialogues": f"""WITH {_TURNS} SELECT t.source_id,
            CASE WHEN placed > 0 THEN t.ordinal ELSE row_number() OVER (PARTITION BY t.source_id ORDER BY ts, segment_id) - 1 END turn,
            role, text, ts AS message_timestamp, segment_id
        FROM t JOIN d USING (source_id) WHERE NOT faulty""",
}
