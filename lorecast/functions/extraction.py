"""Claims, causes, procedures and dates found in texts by ordered patterns. All are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Connectives of cause and effect: pattern, relation, confidence, and whether the effect comes first.
CAUSES = [
    ("because", "because", 0.95, True), ("since", "because", 0.85, True), (r"caused\s+by", "caused_by", 0.95, True), (r"resulted\s+in", "resulted_in", 0.90, False),
    (r"results\s+in", "resulted_in", 0.90, False), (r"led\s+to", "led_to", 0.85, False), (r"leads\s+to", "led_to", 0.85, False), (r"due\s+to", "due_to", 0.90, True),
    ("triggered", "triggered", 0.90, False), ("triggers", "triggered", 0.90, False), ("enabled", "enabled", 0.85, False), ("enables", "enabled", 0.85, False),
    ("prevented", "prevented", 0.85, False), ("prevents", "prevented", 0.85, False),
]
# Patterns that open with a condition or a time.
CONDITIONS = [(r"\bonce\s+([^,]+),\s*(.+)$", "temporal_effect", 0.65), (r"\bif\s+([^,]+),\s+then\s+(.+)$", "conditional", 0.60)]
# Words that qualify a claim, and phrases that say when it holds.
QUALIFIERS = r"\b(significant|major|minor|partial|complete|total|substantial|considerable|limited|extensive|moderate|strong|weak|full|primary|secondary|key|critical|essential|fundamental)\b"
SCOPES = (
    r"\b(in \d{4}|during \d{4}s?|since \d{4}|from \d{4}|until \d{4}|before \d{4}|after \d{4}|through \d{4}|by \d{4}|in the \d{4}s|during the \w+ century|"
    r"in (?:january|february|march|april|may|june|july|august|september|october|november|december)(?: \d{4})?|"
    r"during the (?:first|second|third) (?:world war|war)|in (?:early|mid|late) \d{4}s?|beginning in \d{4}|ending in \d{4})\b"
)


def causes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, relation, confidence, cause, effect): the last match of each pattern in each sentence; sides of 5 characters or more.

    Texts are cut into sentences first, as no side crosses one; a sentence without a connective is dropped before the
    patterns run, and those are anchored, so the work is in proportion to the text.
    """
    cue = "(?i)\\b(?:" + "|".join(c for c, *_ in CAUSES) + "|once|if)\\b"
    sentences = df.where(F.col(text).rlike(cue)).select(key, F.explode(F.split(text, "[.!?]+")).alias("_s")).where(F.col("_s").rlike(cue))

    def side(pattern: str, group: int) -> Column:
        return F.trim(F.regexp_extract("_s", f"(?is){pattern}", group))

    found = []
    for word, relation, confidence, effect_first in CAUSES:
        whole = rf"^(.+)\s+{word}\s+(.+)$"
        one, two = side(whole, 1), side(whole, 2)
        found.append(_cause(relation, confidence, *((two, one) if effect_first else (one, two))))
    found += [_cause(relation, confidence, side(p, 1), side(p, 2)) for p, relation, confidence in CONDITIONS]
    rows = sentences.select(key, F.explode(F.array(*found)).alias("m")).select(key, "m.*")
    return rows.where((F.length("cause") >= 5) & (F.length("effect") >= 5))


def _cause(relation: str, confidence: float, cause: Column, effect: Column) -> Column:
    return F.struct(F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), cause.alias("cause"), effect.alias("effect"))


def modality(text: Column) -> Column:
    out = F
    for name, pattern in (("negated", r"\b(?:not|never|no longer|cannot)\b"), ("possible", r"\b(?:may|might|could|possibly|perhaps)\b"), ("obligatory", r"\b(?:must|should|shall|required)\b"), ("planned", r"\b(?:will|plans? to|going to)\b")):
        out = out.when(text.rlike(f"(?i){pattern}"), name)
    return out.otherwise("asserted")


def qualifiers(text: Column) -> Column:
    """The first five qualifying words of a text, in lower case, once each."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(QUALIFIERS), 1)), 1, 5)


def temporal_scope(text: Column) -> Column:
    """The first phrase of a text that states a time, as it stands there; null without one."""
    return F.nullif(F.regexp_extract(text, f"(?i){SCOPES}", 1), F.lit(""))


def sentences(text: Column) -> Column:
    """The sentences of a text, without empty ones."""
    return F.filter(F.split(text, r"(?<=[.!?])\s"), lambda x: F.trim(x) != "")


def claim(text: Column) -> Column:
    """Subject, predicate and object by ordered verbs, with modality, confidence (0.7 if a verb was found, else 0.3), qualifiers and temporal scope."""
    one = F.regexp_replace(F.trim(text), r"[.!?]+$", "")
    patterns = [r"^(.+?) (is|are|was|were) (.+)$", r"^(.+?) (has|have|had|holds|keeps) (.+)$", r"^(.+?) (uses|runs|needs|sends|depends on|replaced|replaces) (.+)$", r"^(.+?) (\w+(?:s|ed)) (.+)$"]
    part = lambda g: F.coalesce(*[F.nullif(F.regexp_extract(one, f"(?i){p}", g), F.lit("")) for p in patterns])
    subject = part(1)
    return F.struct(subject.alias("subject"), F.lower(part(2)).alias("predicate"), part(3).alias("object"), modality(text).alias("modality"), F.when(subject.isNotNull(), 0.7).otherwise(0.3).alias("confidence"), qualifiers(text).alias("qualifiers"), temporal_scope(text).alias("temporal_scope"))


def steps(text: Column) -> Column:
    """Steps of a procedure: numbered lines, else bullets; an empty list below two."""
    numbered = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:\d+[.)]|Step \d+:?)\s+(.+)$"), 1)
    bullets = F.regexp_extract_all(text, F.lit(r"(?m)^\s*[-*•]\s+(.+)$"), 1)
    none = F.array().cast("array<string>")
    found = F.when(F.size(numbered) >= 2, numbered).when(F.size(bullets) >= 2, bullets).otherwise(none)
    return F.transform(found, lambda s: F.trim(s))


def dates(text: Column) -> Column:
    """All ISO dates and English month dates of a text, sorted, once each."""
    iso = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9A-Za-z_])(\d{4}-\d{2}-\d{2})(?![0-9A-Za-z_])"), 1), lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).cast("date"))
    month = r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})\b"
    long = F.transform(F.regexp_extract_all(text, F.lit(month), 1), lambda d: F.try_to_timestamp(d, F.lit("MMMM d, yyyy")).cast("date"))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(iso, long))))


_MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
# Patterns of times in texts.
ISO_TIME, ISO_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?", r"(^|[^A-Za-z0-9_])[0-9]{4}-[0-9]{2}-[0-9]{2}($|[^A-Za-z0-9_])"
DATE_MDY, DATE_DMY = rf"(?i){_MONTHS} [0-9]{{1,2}},? [0-9]{{4}}", rf"(?i)[0-9]{{1,2}}(?:st|nd|rd|th)? {_MONTHS} [0-9]{{4}}"
CLOCK = r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s*(?:AM|PM|am|pm)|(^|[^0-9])[0-9]{2}:[0-9]{2}(?::[0-9]{2})?($|[^0-9])"
_EDGE = "(^|[^A-Za-z0-9_])", "($|[^A-Za-z0-9_])"
NEAR_DAY, NEAR_WEEK, NEAR_MONTH = (f"(?i){_EDGE[0]}(?:{p}){_EDGE[1]}" for p in ("today|yesterday|tomorrow|tonight", f"(?:last|this|next) (?:week|{_DAYS})", "(?:last|this|next) (?:month|year)"))
DURATION = r"(?i)([0-9]+)\s*(seconds?|secs?|minutes?|mins?|hours?|hrs?|days?|weeks?)"
# How specific a time is by what is given, in the order in which it is looked for.
GRANULARITY = [(ISO_TIME, 1.0), (CLOCK, 0.9), (ISO_DATE, 0.5), (DATE_MDY, 0.5), (DATE_DMY, 0.5), (NEAR_DAY, 0.4), (NEAR_WEEK, 0.3), (NEAR_MONTH, 0.2)]


def time_specificity(text: Column) -> Column:
    out = F
    for pattern, value in GRANULARITY:
        out = out.when(text.rlike(pattern), F.lit(value))
    return out.otherwise(F.lit(0.0))


def duration(text: Column) -> Column:
    """The first duration of a text, as a logarithm of its seconds over that of a year; 0 without one."""
    value, unit = F.regexp_extract(text, DURATION, 1), F.lower(F.regexp_extract(text, DURATION, 2))
    of = F.when(unit.startswith("sec"), 1).when(unit.startswith("min"), 60).when(unit.startswith("h"), 3600).when(unit.startswith("d"), 86400).otherwise(604800)
    return F.when(value == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.log1p(F.try_to_number(value, F.lit("9999999999999999")).cast("double") * of) / F.log1p(F.lit(31536000.0))))


def temporal_features(at: Column, as_of: Column, text: Column, place: Column, length: Column, start: Column, asked: Column | None = None) -> Column:
    """Twelve features: place in the corpus' time, recency, hour and weekday as angles, office hours, specificity, duration, place in a
    sequence, explicit date, distance from the time that is asked for. Those of an unknown time are 0."""
    seconds = lambda t: F.unix_micros(t) / 1e6
    days = lambda t: F.abs(seconds(at) - seconds(t)) / 86400
    hour, day = F.hour(at) + F.minute(at) / 60, F.weekday(at)
    turn = lambda x, n: (F.sin(2 * F.pi() * x / n), F.cos(2 * F.pi() * x / n))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    known = lambda c: F.coalesce(c, F.lit(0.0))
    explicit = text.rlike(ISO_TIME) | text.rlike(ISO_DATE) | text.rlike(DATE_MDY) | text.rlike(DATE_DMY)
    return F.array(
        known(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (seconds(at) - seconds(start)) / (seconds(as_of) - seconds(start))))), known(F.exp(-(seconds(as_of) - seconds(at)) / 86400 / 43.3)),
        *map(known, turn(hour, 24)), *map(known, turn(day, 7)), yes(F.hour(at).between(9, 16) & (day < 5)), known(time_specificity(text)), known(duration(text)),
        known(F.when(length > 1, place / (length - 1))), yes(explicit), known(F.exp(-days(as_of if asked is None else asked) / 30)),
    )


# Words of the tense and of the time of a text.
TENSES = {"future": ["will", "shall"], "past": ["was", "were", "had", "did", "went", "said", "been"], "present": ["is", "are", "has", "does", "do"]}
TIME_WORDS = "yesterday tomorrow ago later before after during when while until since always never sometimes often rarely weekly monthly yearly".split()
NOW_WORDS, ORDER_WORDS = ["now", "today", "currently", "recently", "just", "latest"], ["first", "then", "next", "finally", "lastly"]
OFTEN, DUE, PAST = ["daily", "weekly", "monthly", "yearly", "hourly", "every"], ["deadline", "due", "by", "before", "until"], ["history", "historical", "originally", "formerly", "in the past"]
STAMP, SPAN = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{1,2}:[0-9]{2}", r"[0-9]+\s*(second|minute|hour|day|week|month|year)"


def text_time_features(text: Column) -> Column:
    """Twelve features of the words of a text: time stamps, words of now, shares of the tenses, words of time, durations, frequencies, order, deadlines, history, length."""
    low = F.lower(text)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    n = lambda ws: F.size(F.filter(words, lambda w: w.isin(ws))).cast("double")
    part = lambda ws, most: F.least(F.lit(1.0), n(ws) / most)
    holds = lambda ws: F.when(low.rlike("|".join(ws)), 1.0).otherwise(0.0)
    tense = {t: n(ws) for t, ws in TENSES.items()}
    total = sum(tense.values(), F.lit(1.0))
    return F.array(
        F.when(low.rlike(STAMP), 1.0).otherwise(0.0), part(NOW_WORDS, 3), *[tense[t] / total for t in ("future", "past", "present")], part(TIME_WORDS, 5), F.when(low.rlike(SPAN), 1.0).otherwise(0.0),
        holds(OFTEN), part(ORDER_WORDS, 3), holds(DUE), holds(PAST), F.least(F.lit(1.0), F.size(words) / 500.0),
    )


# Patterns of statements and of commands that are mined for embeddings.
STATEMENTS = [
    r"(?:^|\. )([A-Z][^.!?]+(?:is|are|was|were|has|have|does|do)\s+[^.!?]+)[.!?]", r"(?:^|\. )([A-Z][^.!?]+(?:can|will|should|must)\s+[^.!?]+)[.!?]", r"(?:^|\. )(The\s+[^.!?]+(?:is|are|was|were)\s+[^.!?]+)[.!?]",
]
COMMANDS = r"(?i)(?:^|\. )((?:Run|Execute|Install|Create|Add|Remove|Set|Configure|Enable|Disable|Click|Open|Close|Enter|Type|Press|Go to)\s+[^.!?]+)[.!?]"


def _first_of_each(found: Column, least: int, most: int) -> Column:
    """Trimmed texts longer than `least`, the first of those that differ in case only, `most` at most."""
    kept = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) > least)
    low = F.transform(kept, lambda x: F.lower(x))
    return F.slice(F.filter(kept, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, most)


def mined_claims(text: Column) -> Column:
    return _first_of_each(F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in STATEMENTS]), 20, 10)


def mined_steps(text: Column) -> Column:
    """Numbered lines, bullets, then sentences that command."""
    patterns = (r"(?:^|\n)[ \t]*[0-9]+[.):][ \t]*([^\n]+)", r"(?:^|\n)[ \t]*[-•*][ \t]*([^\n]+)", COMMANDS)
    return _first_of_each(F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in patterns]), 5, 20)


def mined_questions(title: Column, text: Column) -> Column:
    """Questions that a text answers: about its title, its first address, and its first line."""
    address = F.regexp_extract(text, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 0)
    line = F.substring(F.split(F.trim(text), "\n")[0], 1, 200)
    found = F.array(F.when(F.length(title) > 5, F.concat(F.lit("What is "), title, F.lit("?"))), F.when(address != "", F.concat(F.lit("What is at "), address, F.lit("?"))), F.when(F.length(line) > 20, line))
    return F.array_compact(found)


# Parts of paths that are replaced in metrics.
PATHS = [
    (r"/[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "/{uuid}"), (r"/SEG_[a-zA-Z0-9]+", "/{segment_id}"), (r"/ENT_[a-zA-Z0-9]+", "/{entity_id}"), (r"/tenant/[^/]+", "/tenant/{tenant_id}"),
]


def plain_path(path: Column) -> Column:
    for pattern, name in PATHS:
        path = F.regexp_replace(path, pattern, name)
    return path


def repaired_json(text: Column) -> Column:
    """The JSON object or list in an answer: what stands between the outermost brackets, without fences and without commas before a closing bracket."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.nullif(F.regexp_replace(inner, r",\s*([}\]])", "$1"), F.lit(""))


def in_order(confidence: Column, cause_at: Column, effect_at: Column) -> Column:
    """(valid, gap_hours, confidence) of a cause and an effect with times; half the confidence where the cause isn't earlier."""
    valid = cause_at < effect_at
    gap = F.when(valid, (F.unix_micros(effect_at) - F.unix_micros(cause_at)) / 3600e6)
    return F.struct(valid.alias("valid"), gap.alias("gap_hours"), F.when(valid | valid.isNull(), confidence).otherwise(confidence * 0.5).alias("confidence"))


def temporal_similarity(a: Column, b: Column, weights: list[float] | None = None) -> Column:
    """1 - min(1, root of the weighted squared differences)."""
    w = F.array(*[F.lit(x) for x in (weights or [1 / 12] * 12)])
    square = F.zip_with(w, F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda x, y: x * y)
    return 1 - F.least(F.lit(1.0), F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x)))


def citation(kind: Column, title: Column, ident: Column, level: str = "brief") -> Column:
    brief = F.concat(F.lit("["), kind, F.lit(": "), F.coalesce(title, ident), F.lit("]"))
    return brief if level == "brief" else F.concat(brief, F.lit(" ("), ident, F.lit(")"))
