r"""Problem 2: finding personal information in free text and replacing it by typed placeholders.

Regular expressions propose spans, validators confirm or doubt them (numbering plans of telephone numbers, Luhn,
mod 97, mod 11, mod 23), and words nearby raise or lower the score; a span is kept from THRESHOLD on. Names come from
given names (a parameter, found by one Aho-Corasick pass over the text) next to a family name, or from an initial.

Texts are processed whole and row by row, without a shuffle; found items are made distinct by (record, type, place), so
redelivered rows count once. Overlaps are settled by score, then length, then place.

Defined cases: a null, empty or blank text has no items and comes out unchanged; the result keeps each row once in the
redacted form; records with a null key are kept; places count Unicode characters from 1; texts of any length are read
to their end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecast.io import table

THRESHOLD = 0.5
NEAR = 48
#: Given names that are recognised; a parameter of the operator.
GIVEN = """
aaron abigail adam agnes ahmed aisha alan albert alejandro alexander alexandra alice alicia amanda amelia amy ana andrea
andreas andrew angela anita ann anna anne anthony antonio arjun arthur barbara beatrice benjamin bernard beth brian
carlos carmen carol caroline catherine cecilia charles charlotte christina christine christopher claire claudia clara
daniel david deborah dennis diana diego dmitri donald dorothy douglas edward eleanor elena elias elizabeth emeka emily
emma eric esra esther eva fatima felix fernando francis francesca frederick gabriel gabriela george gerald geoffrey greta
gregory gustavo hannah harold harriet heather helen helena henrik henry hiroshi hugo ibrahim ingrid irene isabel isabella
ivan jacob jacqueline james janet jason javier jennifer jeremy jessica joaquin johannes john jonas jonathan jorge jose
joseph joshua juan judith julia juliana julie kamala karen karl katarzyna katherine kathleen kenneth kevin kwame laura
lawrence leonard leon linda lucas lucia ludwig luis magdalena manuel marcus margaret maria marie marina mario marta martha
martin mary matthew mehmet melissa michael michelle miguel mohammed monica nadia nancy natalia nathan nicholas nicole
nikolai noor nora olga oliver olivia olufemi omar oscar oskar pablo pamela patricia patrick paul pedro peter philip pierre
priya rachel rafael ralph raymond rebecca ricardo richard robert roberto roger ronald ruth ryan samantha samuel sandra
sara sarah scott sebastian sergio sharon simon sofia sonia sophia stefan stephanie stephen steven susan susanne sven
tamara teresa theodore theresa thomas timothy tobias ursula valentina vanessa vera veronica victor victoria vincent
virginia walter wilhelmina william wolfgang yusuf yuki yvonne zoltan zoe
""".split()
#: Given names that are common words as well; they need a title or an introduction before them.
AMBIGUOUS = "april art bill faith frank grace hope jack june mark may max rich rose sky will".split()
#: Words that stand next to a given name without being a family name.
NO_FAMILY = frozenset("""
about after again agrees also alone already always and answers antes apparaît are asked asks at auf back because been
before bei belongs bis busca but calls came can cannot complete con could cree dans dashboard de del depuis der deputy des
desde did die dit does done each elle encore end erhält está este et even every fand fanden for found from für gateway
gave gets gibt goes got habe had hand has hat hatte have he her here him his how however ihr im in index into is ist it its
joined just keeps kept knows later ledger left likes lives made makes mit mode moved moves must nach near needs never next
noch not now nur of off on only or oder our out over owns para pero period por pour prefers puis qui quiere reads release
replaced replaces replied reports runs said says schreibt sees sends sent she should signed since so some sometimes son
soon still suggested sur than thanks that the their them then there they this to today told tomorrow too took tras until
two three four five six seven eight nine ten each show raising lowering merged query trust how who which every one our release import
update used uses und une us vers very via von vor want wanted wants war was we weitergeben well went were what when where
which while who why will with without wird with works would writes wrote xxx yesterday you your zu zum zur dit ask asked
please team tenant store queue cache report table archive service number phone mail email address passport
monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october
november december montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi
""".split())
INTRODUCED = re.compile(
    r"(?:\b(?:mrs?|ms|miss|dr|prof|sir|herr|frau|mme|m|mlle|sr|sra|don|doña|señora?)\.?|contact:?|signed:?|owner:?|name:?|"
    r"by|ask|for|reviewer.{0,20} is|deputy is|applicant|replaces|of|to|an|pour|a|with|frau|reporter=|according to)[ ]*$",
    re.I,
)
_L, _U = r"[^\W\d_]", r"[A-ZÀ-ÖØ-ÞŁŚŠŽĀ-Ž]"
_FAMILY = rf"{_L}(?:{_L}|['’-](?={_L}))+"
AFTER = re.compile(rf"(?:[  ]{{1,3}}{_L}\.)?[  ]{{1,3}}({_FAMILY})")
BEFORE = re.compile(rf"(?<![\w@.])({_FAMILY}),[  ]{{1,3}}$")
INITIAL = re.compile(rf"(?<![\w.&@-]){_U}\.[  ]({_U}{_L}{{4,}})(?![\w@]|[ ](?:St|Street|Road|Rd|Lane|Close|Ave|Avenue)\b)")
INITIAL_NEAR = re.compile(
    r"(?:\b(?:replaces|contact(?: is)?:?|signed:?|an|is|to|for|of|from|with|according to|applicant|spoke with|deputy is|pour|a|"
    r"de|to|dr\.?|prof\.?|mr\.?|mrs\.?|ms\.?|herr|frau|care of|ask|and|by|row of)|[.!?:,]|reporter=|\n|^)[ ]*$",
    re.I,
)
INITIAL_AFTER = re.compile(
    r"^(?:[ ]?(?:from|weitergeben|signed|is|wants|prefers|owns|about|on|moved|lives|and)\b|[ ]?[;,.\n(]|$)", re.I
)

_TLD = r"[A-Za-z]{2,}"
_BOX = r"[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ_%+'-]|\.(?=[A-Za-z0-9_+-]))*"
_AT = r"(?:@|＠|[ ]?[(\[{<](?:at|arobase|arroba|AT|At|ät)[)\]}>][ ]?|[ ](?:at|AT|arobase|arroba)[ ])"
_DOT = r"(?:\.|．|[ ]?[(\[{<](?:dot|punkt|point|punto|DOT|Dot)[)\]}>][ ]?|[ ](?:dot|DOT|punkt|point|punto)[ ])"
MAIL = re.compile(rf"(?<![\w.@+%-])({_BOX})({_AT})([A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*?{_DOT}{_TLD}(?:\.[a-z]{{2}})?)(?![\w-]|\.\w)", re.I)
SPOKEN = re.compile(_AT, re.I)

NUMBER = re.compile(r"(?<![\w.,:/@=#+-])(?<![+(]\b)(?:\+\d{1,3}|\(\d{2,5}\)|\d)(?:[ . /-]?(?:\(\d{1,4}\)|\d)){6,15}(?![\w@]|[.,:/-]\d)|(?<==)(?:\+\d{1,3}|\(\d{2,5}\)|\d)(?:[ . -]?(?:\(\d{1,4}\)|\d)){6,15}(?![\w@]|[.,:/-]\d)")
PHONES = [  # (form, score)
    (re.compile(r"\+\d[\d (). /-]{6,20}"), 0.75),
    (re.compile(r"\([2-9]\d\d\) ?[2-9]\d\d[ .-]\d{4}"), 0.7),
    (re.compile(r"1?[ .-]?[2-9]\d\d([ .-])[2-9]\d\d\1\d{4}"), 0.45),
    (re.compile(r"0\d([ .])\d\d\1\d\d\1\d\d\1\d\d"), 0.6),
    (re.compile(r"020 \d{4} \d{4}|07\d{3} \d{3} ?\d{3}|01\d{3} \d{6}|01\d{2} \d{3} \d{4}"), 0.65),
    (re.compile(r"0\d{2,4}[ /-]\d{3,5}[ -]?\d{2,5}"), 0.5),
    (re.compile(r"\(0\d{2,4}\) ?\d{3,5}[ -]?\d{2,5}"), 0.65),
]
PHONE_WORDS = re.compile(
    r"\b(?:phone|tel|telephone|telefon|tél|téléphone|teléfono|mobile|mobil|handy|cell|call(?:ed|back)?|text|sms|fax|number is|erreichbar|"
    r"appeler|llamar|rufnummer|contact|reach|on-call|anruf\w*|ext|durchwahl|whatsapp)\b",
    re.I,
)
NOT_PHONE = re.compile(
    r"\b(?:build|batch|part(?: no\.?)?|run(?: id)?|trace|counter|stood at|section|table|range|version|offset|key|hash|rows|row|seg|"
    r"snapshot|shard|ticket|order|invoice|serial|mean|spread|took|peer|ip|checks on|port|release|id|page|lot|line)\b[^.;]{0,14}$",
    re.I,
)
IDNO = re.compile(
    r"(?<![\w.,:/@#+-])(?:\d{3}([ -])\d{2}\1\d{4}|\d{2} \d{3} \d{3} \d{3}|\d{6}/\d{3,4}|\d{7,8}-?[A-Za-z](?![A-Za-z])|[XYZ]-?\d{7}-?[A-Z]?|"
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,2}\d{6,9}|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?|\d{2} ?\d{6} ?[A-Z] ?\d{3}|"
    r"\d{3} \d{3} \d{3}|\d{4} \d{4} \d{4}(?: \d{4})?|\d{8,12})(?![\w@]|[/.-]\d)"
)
ID_WORDS = re.compile(
    r"passport|passeport|reisepass|pasaporte|licen[cs]e|permis|führerschein|licencia|social (?:security|insurance)|sécurité sociale|"
    r"seguridad social|sozialversicherung|insurance (?:number|no)|steuer|tax (?:id|number|no|ref)|tax payer|fiscal|ident\w* (?:card|number|no|document)|"
    r"national (?:id|insurance)|\bID\b|id (?:document|card|no|number)|ausweis|personalausweis|\bssn\b|\bnino\b|\bdni\b|\bnie\b|\bnif\b|documento|"
    r"carte d'identité|numéro national|aadhaar|applicant|maynumber|マイナンバー|旅券|免許",
    re.I,
)
NOT_ID = re.compile(
    r"\b(?:batch|part(?: no\.?)?|build|run(?: id)?|trace|counter|offset|snapshot|hash|key|ticket|order|serial|rows|range|version|release|lot|"
    r"seg(?:ment)?|query|import|request|session|job)\b[^.;:]{0,12}$",
    re.I,
)

_STREET = (
    r"Street|St|Road|Rd|Lane|Ln|Close|Avenue|Ave|Drive|Dr|Court|Ct|Way|Terrace|Place|Pl|Square|Sq|Crescent|Cres|Row|Hill|Gardens|"
    r"Boulevard|Blvd|Mews|Grove|Walk|Parade|Quay|Alley|Highway|Hwy|Parkway|Pkwy|Circle|Cir|Rise|Green"
)
ADDRESSES = [
    re.compile(
        rf"(?<![\w.,:/#-])\d{{1,5}}(?: ?[a-z](?![\w])| ?½)?,?[  ](?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West)\.?[ ])?"
        rf"(?:[A-Z][\w'’-]+[ ]){{1,3}}(?:{_STREET})\b",
    ),
    re.compile(r"(?<![\w.,:/#-])\d{1,5}(?: ?(?:bis|ter|[a-z](?!\w)))?,?[  ](?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours|passage|square)[ ](?:de la |de l['’]|des |du |de |d['’])?\w+(?:[ -][A-ZÉ]\w+)*", re.I),
    re.compile(r"(?<!\w)(?:calle|avenida|avda\.?|plaza|paseo|camino|carrera|ronda|travesía|c/)[ ]?(?:de la |del |de los |de las |de )?\w+(?:[ ]\w+){0,2}?,?[ ](?:n\.?º ?)?\d{1,4}(?![\d.-]|\w{2})", re.I),
    re.compile(r"(?<![\w-])(?:(?:Am|An der|Auf dem|Im|In der|Zum|Zur|Unter den)[ ][A-ZÄÖÜ][\w-]+|(?:(?:Alte|Neue|Große|Kleine|Obere|Untere)[ ])?[A-ZÄÖÜ][\w-]*?(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring|steig|stieg|chaussee|Straße|Strasse|Weg|Platz|Allee))[ ]\d{1,4}(?: ?[a-z](?!\w))?(?![\d:.-]\d)"),
    re.compile(r"(?<![\w-])[A-ZÄÖÜ]{3,}(?:STRASSE|STRAßE|STR\.|GASSE|WEG|PLATZ|ALLEE|UFER|DAMM|RING)[ ]\d{1,4}"),
]
ADDRESS_UPPER = re.compile(rf"(?<![\w.,:/#-])\d{{1,5}}[A-Za-z]?[ ](?:[NSEW]\.?[ ])?(?:[A-Z][A-Z'’-]+[ ]){{1,3}}(?:{_STREET.upper()})\b")
ADDRESS_WORDS = re.compile(r"address|adresse|lives|live at|moved|deliver|flat|office|ship|posted|home|badge|wohn|direcci|domicil|post|meeting|visit|care of", re.I)
_DIGIT = re.compile(r"\d")
#: The six digits that every form of a document number has.
_SHORT_ID = re.compile(r"\d(?:[ /-]?\d){5}")
#: Seven digits with at most one sign between two of them.
_DIGITS = re.compile(r"\d(?:[ .()/-]{0,3}\d){6}")

ITEMS = "record_id string, pii_type string, start_pos long, stop_pos long, score double"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(digits: str) -> bool:
    """The check of national numbers that end in a two digit key: 97 less the rest of what stands before it.

    Of 11 digits, the number may stand for one with a 2 before it (births from 2000 on).
    """
    body, key = digits[:-2], int(digits[-2:])
    return 97 - int(body) % 97 == key or len(digits) == 11 and 97 - int("2" + body) % 97 == key


def id_check(text: str) -> float:
    """What the checksums of known numbers add to the score of a candidate."""
    plain = re.sub(r"[\s./-]", "", text).upper()
    if re.fullmatch(r"\d{8}[A-Z]", plain):
        return 0.2 if "TRWAGMYFPDXBNJZSQVHLCKE"[int(plain[:8]) % 23] == plain[8] else 0.1
    if plain.isdigit():
        if len(plain) in (11, 15) and mod97(plain):
            return 0.2
        if len(plain) == 10 and "/" in text and int(plain) % 11 == 0:
            return 0.2
        if len(plain) in (9, 11, 12, 16) and luhn(plain):
            return 0.1
    return 0.0


def phone_check(text: str) -> float:
    digits = re.sub(r"\D", "", text)
    if not 7 <= len(digits) <= 15:
        return -1.0
    return -0.3 if len(set(digits)) < 3 else 0.0


@lru_cache(maxsize=4)
def _names(given: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for name in (*given, *AMBIGUOUS):
        found.add_word(name, (len(name), name))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _mails(text: str) -> Iterator[tuple[int, int, str, float]]:
    if not SPOKEN.search(text):
        return
    for m in MAIL.finditer(text):
        box, sign, host = m.groups()
        plain_sign = sign in "@＠"
        score = 0.8 if plain_sign else 0.7
        if re.fullmatch(r"v?\d+(?:\.\d+)*", host) or m.end() < len(text) and text[m.end()] == ":" and text[m.end() + 1 : m.end() + 2] == "/":
            score -= 0.6
        if not plain_sign and sign.strip().lower() == "at" and not re.search(r"[ (\[](?:dot|punkt|point|punto)[ )\]]", host, re.I):
            continue  # "at" as a word, before an ordinary name of a host
        start = m.start() + (7 if box.lower().startswith("mailto:") else 0)
        yield start, m.end(), "email", score


def _phones(text: str) -> Iterator[tuple[int, int, str, float]]:
    for m in NUMBER.finditer(text):
        s = m.group()
        score = max((x for form, x in PHONES if form.fullmatch(s)), default=0.0)
        if not score:
            continue
        score += phone_check(s)
        before, after = text[max(0, m.start() - NEAR) : m.start()], text[m.end() : m.end() + 16]
        if NOT_PHONE.search(before):
            score -= 0.5
        if PHONE_WORDS.search(before) or re.match(r"\s*(?:ext\b|x\d|durchwahl)", after, re.I):
            score += 0.3
        elif re.search(r"[;,=(:]\s*$", before) or re.match(r"\s*[;,)]", after):
            score += 0.15
        yield m.start(), m.end(), "phone", score


def _ids(text: str) -> Iterator[tuple[int, int, str, float]]:
    if not _DIGITS.search(text) and not _SHORT_ID.search(text):
        return  # every form has six digits with at most one sign between two of them
    for m in IDNO.finditer(text):
        before = text[max(0, m.start() - NEAR) : m.start()]
        near = None
        for near in ID_WORDS.finditer(before):
            pass
        score = 0.3 + id_check(m.group())
        if near is not None:
            score += 0.4 if not re.search(r"[.!?]\s+[A-Z]", before[near.end() :].replace("no. ", "no ")) else 0.0
        elif re.match(r"[^.!?\n]{0,30}(?:" + ID_WORDS.pattern + ")", text[m.end() : m.end() + 40], re.I):
            score += 0.1
        if NOT_ID.search(before) and not re.search(r"(?:passport|licen[cs]e|security|insurance|tax|ident)[^.]{0,14}$", before, re.I):
            score -= 0.5
        yield m.start(), m.end(), "idno", score


def _addresses(text: str) -> Iterator[tuple[int, int, str, float]]:
    for form in (*ADDRESSES, ADDRESS_UPPER):
        for m in form.finditer(text):
            before = text[max(0, m.start() - NEAR) : m.start()]
            yield m.start(), m.end(), "address", 0.65 + 0.2 * bool(ADDRESS_WORDS.search(before))


def _agree(given: str, family: str) -> bool:
    if family.lower() in NO_FAMILY or len(family) < 3:
        return False
    if given[0].islower():
        return family[0].islower() and len(family) >= 6
    return family[0].isupper()


def _people(text: str, hits: list[tuple[int, str]]) -> Iterator[tuple[int, int, str, float]]:
    for end, name in hits:
        start = end - len(name) + 1
        if start and (text[start - 1].isalnum() or text[start - 1] in "@_.-+/\\") and not (start > 1 and text[start - 1] in ".-" and text[start - 2] in " \n"):
            continue
        if end + 1 < len(text) and (text[end + 1].isalnum() or text[end + 1] in "@_+"):
            continue
        word, score = text[start : end + 1], 0.7
        if name in AMBIGUOUS:
            score = 0.6 if word[0].isupper() and INTRODUCED.search(text[max(0, start - 30) : start]) else 0.2
        after, low = AFTER.match(text, end + 1), max(0, start - 60)
        after = after if after and _agree(word, after.group(1)) and text[after.end() : after.end() + 1] != "@" else None
        before = BEFORE.search(text[low:start]) if text[max(0, start - 3) : start].strip() == "," or "," in text[max(0, start - 3) : start] else None
        before = before if before and _agree(word, before.group(1)) and len(before.group(1)) > 4 else None
        if before and (after is None or INTRODUCED.search(text[low : low + before.start(1)])):
            yield low + before.start(1), end + 1, "name", score - 0.1
        elif after:
            yield start, after.end(), "name", score
    if ". " in text:
        for m in INITIAL.finditer(text):
            if m.group(1).lower() in NO_FAMILY:
                continue
            before = bool(INITIAL_NEAR.search(text[max(0, m.start() - 24) : m.start()]))
            after = bool(INITIAL_AFTER.search(text[m.end() : m.end() + 14]))
            yield m.start(), m.end(), "name", 0.3 + 0.2 * before + 0.2 * after


def find_items(text: str | None, given: tuple[str, ...] = tuple(GIVEN)) -> list[tuple[int, int, str, float]]:
    """The items of a text: start and end (from 0), type, score; none overlaps another."""
    if not text:
        return []
    hits: list[tuple[int, str]] = []
    for end, (_, cue) in _names(given).iter(_lower(text)):
        hits.append((end, cue))
    found = [*_mails(text), *_people(text, hits), *_ids(text)]
    if _DIGITS.search(text):
        found += _phones(text)
    if _DIGIT.search(text):  # every form of an address has a number
        found += _addresses(text)
    found = sorted((x for x in found if x[3] >= THRESHOLD), key=lambda x: (-x[3], x[0] - x[1], x[0]))
    kept: list[tuple[int, int, str, float]] = []
    for x in found:
        if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
            kept.append(x)
    return sorted(kept)


def items(df: DataFrame, key: str, text: str, given: tuple[str, ...] = tuple(GIVEN)) -> DataFrame:
    """(record_id, pii_type, start_pos, stop_pos, score) of the items of df; places from 1, stop_pos inclusive."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, kind, a + 1, b, round(score, 4))
                for k, t in zip(batch["key"], batch["text"], strict=True)
                for a, b, kind, score in find_items(t, given)
            ]
            yield pd.DataFrame(rows, columns=["record_id", "pii_type", "start_pos", "stop_pos", "score"])

    rows = df.select(df[key].cast("string").alias("key"), df[text].alias("text")).where(F.length("text") > 0)
    return rows.mapInPandas(scan, ITEMS).dropDuplicates(["record_id", "pii_type", "start_pos"])


def redact(df: DataFrame, key: str, text: str, placeholders: dict[str, str], given: tuple[str, ...] = tuple(GIVEN)) -> DataFrame:
    """(key, text) of every row of df, items replaced by their placeholders and the rest unchanged."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch["text"]:
                parts, at = [], 0
                for a, b, kind, _ in find_items(t, given):
                    parts += [t[at:a], placeholders.get(kind, f"<{kind.upper()}>")]
                    at = b
                out.append("".join(parts) + t[at:] if parts else t)
            yield pd.DataFrame({"key": batch["key"], "text": pd.Series(out, dtype=object)})

    return df.select(df[key].cast("string").alias("key"), df[text].alias("text")).mapInPandas(scan, "key string, text string")


FIELDS = {"segments": ("segment_id", "text"), "assistant_memories": ("memory_id", "normalized_text")}


def p2_items(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        items(table(spark, folder, name), key, text).select(F.lit(name).alias("record_table"), "record_id", "pii_type", "start_pos", "stop_pos", "score")
        for name, (key, text) in FIELDS.items()
    ]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_items(spark, folder).select("record_table", "record_id", "pii_type", "start_pos")


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    placeholders = {r.pii_type: r.placeholder for r in table(spark, folder, "pii_types").collect()}  # five rows
    parts = [
        redact(table(spark, folder, name), key, text, placeholders).select(F.lit(name).alias("record_table"), F.col("key").alias("record_id"), "text")
        for name, (key, text) in FIELDS.items()
    ]
    return parts[0].unionByName(parts[1])


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
ORACLE: dict[str, str] = {}
