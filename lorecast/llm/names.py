"""Problem 5: linking the spellings of one person or organisation.

A name is parsed into its kind, its core (family name, or the coined part of an organisation's name) and its second part
(given name or line of business, nicknames and abbreviations resolved, legal forms and titles dropped). Distinct cores
are joined within an edit radius by their deletion neighbourhoods:

* an edit is undone by one letter less in each word, so two cores within d edits have a string in common that is made
  from each by leaving out at most d letters. Each core is a key for every such string, as a hash; cores of more than
  LONG letters have the pieces of their length as keys instead, of which two edits leave one as it was;
* keys are shuffled as blocks of numbers; cores with a key in common are candidates, and the Damerau-Levenshtein metric
  decides.

So the work grows with the names and with the pairs that are near, not with the square of the names.

Nicknames come from a list, which is a parameter, and from the data: an unknown given name that stands mostly beside one
known given name of the same family name is learned as its nickname. Notes in brackets are no part of a name.

Second parts decide which forms with equal or near cores are the same. Each link is a row of a join, and the classes are
the connected components. An initial, an abbreviation that fits several words or a missing second part is linked only
where one class with an equal or near core fits it.

Defined cases: null or empty names and types, and names without a core, link to nothing; copies of an entity count once
(the smallest name that has a core); entities with equal names link whatever their tenant; other kinds are left out.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecast.io import table
from lorecast.llm.personal import AMBIGUOUS, GIVEN
from lorecast.plans.components import connected_components
from lorecast.plans.materialize import cut

RADIUS = 2
#: Letters below which one edit may make another name: cores that short need equal second parts to be linked by it.
SHORTEST = 5
#: Families in which an unknown given name must stand for a known one, and the share of its families, to be learned.
SEEN, MOSTLY = 3, 0.5
#: Letters from which the keys of a core are its pieces; keys of a group that is one step of a task, about.
LONG, GROUP = 26, 250_000
KINDS = {
    "person": ["person", "people", "persons", "human", "individual", "per", "name"],
    "organisation": ["organization", "organisation", "org", "company", "organizations", "organisations", "companies", "firm", "corporation", "business", "enterprise", "orgs"],
}
TITLES = frozenset("mr mrs ms miss dr prof professor sir madam herr frau mme mlle sr sra jr phd md dipl ing hon rev".split())
#: Nicknames by given name.
NICKNAMES = {
    "abigail": "abby abbie gail", "alexander": "alex alec sandy xander sasha", "amelia": "millie amy mel", "anthony": "tony ant", "barbara": "barb babs barbie",
    "benjamin": "ben benny benji", "caroline": "carrie caro lina", "catherine": "cathy kate cat katie", "charles": "charlie chuck chas", "christopher": "chris kit topher",
    "daniel": "dan danny", "deborah": "deb debbie debby", "dmitri": "dima mitya", "dorothy": "dot dottie dolly", "edward": "ed eddie ned ted", "eleanor": "ellie nell nora ella",
    "elizabeth": "liz beth betty lizzie eliza betsy", "francis": "frank fran frankie", "frederick": "fred freddie freddy", "gabriela": "gaby gabi gabby",
    "geoffrey": "geoff jeff", "gustavo": "gus", "harriet": "hattie harry", "henrik": "hen rik", "ibrahim": "ibi ibra", "isabella": "bella izzy isa", "jacqueline": "jackie jacqui",
    "jennifer": "jen jenny jenn", "joaquin": "quino", "jonathan": "jon jonny johnny", "katarzyna": "kasia", "kenneth": "ken kenny", "lawrence": "larry laurie",
    "leonard": "leo len lenny", "magdalena": "magda lena", "margaret": "maggie meg peg peggy marge greta", "matthew": "matt matty", "michael": "mike mick mikey",
    "nicholas": "nick nicky", "olufemi": "femi", "patricia": "pat patty tricia trish", "rebecca": "becky becca", "richard": "rick dick rich richie", "robert": "rob bob bobby robbie bert",
    "samantha": "sam sammy", "stephen": "steve stevie steph", "tamara": "tammy", "theodore": "theo teddy", "thomas": "tom tommy", "ursula": "uschi",
    "victoria": "vicky tori vic", "wilhelmina": "mina willa minnie", "william": "bill will billy liam willy", "joseph": "joe joey", "james": "jim jimmy jamie",
    "john": "jack johnny", "david": "dave davey", "andrew": "andy drew", "susan": "sue susie", "peter": "pete", "gregory": "greg", "timothy": "tim", "ronald": "ron",
    "donald": "don donnie", "raymond": "ray", "samuel": "samy", "katherine": "kathy kitty", "judith": "judy", "pamela": "pam", "cynthia": "cindy",
}
LEGAL = frozenset("inc incorporated ltd limited llc plc gmbh ag sa co corp corporation company kg kgaa bv nv oy ab as spa srl sarl pty se ltda llp lp ohg ev sas sl and und et y the of".split())
#: Words for a line of business; the words after a colon only follow another word.
BUSINESS = (
    "aerospace agency airlines analytics architects automotive bakery bank biotech brewery capital chemicals cloud clothing communications construction consulting cosmetics "
    "data dairy design education electronics energy engineering farming films finance foods foundation furniture games glass health holdings hotels industries instruments "
    "institute insurance investments laboratories logistics materials media medical metals mining motors museum networks optics packaging paper pharma plastics power printing "
    "properties publishing railways recycling research robotics school security shipping software solar steel technologies telecom textiles timber tools toys transport travel "
    "university ventures water wines : associates center club college council group international partners school services solutions studio supplies systems team trust union works"
)
SHORT = {
    "sw": "software", "labs": "laboratories", "lab": "laboratories", "svcs": "services", "svc": "services", "tech": "technologies", "techs": "technologies", "mfg": "manufacturing",
    "intl": "international", "pharmaceuticals": "pharma", "mgmt": "management", "sys": "systems", "grp": "group", "bros": "brothers", "assoc": "associates", "eng": "engineering",
    "comm": "communications", "fdn": "foundation", "hldgs": "holdings", "ins": "insurance", "edu": "education", "res": "research", "med": "medical", "ind": "industries",
    "logistic": "logistics", "inst": "institute", "instr": "instruments",
}
_MAIN, _TAIL = (part.split() for part in BUSINESS.split(":"))
_EXACT = frozenset((*_MAIN, *_TAIL))


def radius(length: int | np.ndarray) -> int | np.ndarray:
    """The edits that two spellings of a core may differ by: one under 8 letters (under SHORTEST, with equal second parts)."""
    return np.where(np.asarray(length) < 8, 1, RADIUS)


def distance(a: str, b: str, most: int = 99) -> int:
    """The Damerau-Levenshtein distance, with unrestricted transpositions (a true metric); most + 1 if it exceeds most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            same = a[i - 1] == b[j - 1]
            if same:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return min(d[len(a) + 1][len(b) + 1], most + 1)


def _letters(words: list[str]) -> np.ndarray:
    """Words as rows of character codes, 0 after the end."""
    wide = max(map(len, words), default=0) or 1
    return np.array(words, dtype=f"U{wide}").view(np.uint32).reshape(len(words), wide)


def adjacent_distance(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Edit distances, with transpositions of adjacent letters only, of many pairs at once (rows of _letters).

    It is never below the true metric, and at most one above it where that is 3 or less; so it serves as a filter.
    """
    n, wide_a, wide_b = len(a), int(la.max(initial=0)), int(lb.max(initial=0))
    rows = [np.tile(np.arange(wide_b + 1, dtype=np.int8)[:, None], (1, n))]
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    out = np.where(la == 0, lb, 0).astype(np.int8)
    for i in range(1, wide_a + 1):
        row = np.empty_like(rows[-1])
        row[0] = i
        for j in range(1, wide_b + 1):
            best = np.minimum(rows[-1][j - 1] + (a[i - 1] != b[j - 1]), np.minimum(rows[-1][j], row[j - 1]) + 1)
            if i > 1 and j > 1:
                swapped = (a[i - 1] == b[j - 2]) & (a[i - 2] == b[j - 1])
                best = np.where(swapped, np.minimum(best, rows[-2][j - 2] + 1), best)
            row[j] = best
        ends = la == i
        out[ends] = row[lb[ends], np.flatnonzero(ends)]
        rows = [rows[-1], row]
    return out


_NOTE = re.compile(r"\s*(?:\([^()]*\)|\[[^\[\]]*\])")


def plain(name: str) -> str:
    """Lower case, without notes in brackets, accents and ligatures, letters and digits only, dots of initials and legal forms closed."""
    bare = _NOTE.sub(" ", name)
    name = bare if re.search(r"\w", bare) else name
    text = unicodedata.normalize("NFKD", name.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("đ", "d"))
    text = "".join(c for c in text if not unicodedata.combining(c)).casefold()
    text = re.sub(r"\b(\w)\.(?=\w\.)", r"\1", text)
    return re.sub(r"[^\w,]|_", " ", text.replace("'", "").replace("’", ""))


_KNOWN = {g: g for g in (*GIVEN, *NICKNAMES)} | {n: g for g, names in NICKNAMES.items() for n in names.split() if n not in GIVEN}
_KNOWN |= {n: n for n in AMBIGUOUS if n not in _KNOWN}


@lru_cache(maxsize=4096)
def _known_mask(word: str) -> int:
    return _mask(word)


def _near(word: str, words: dict[str, str] | list[str]) -> str | None:
    """The only or nearest of the words within the edits allowed for its length; the first letters settle ties."""
    most, own = 0 if len(word) < 4 else 1 if len(word) < 6 else 2, _mask(word)
    close = (w for w in words if abs(len(w) - len(word)) <= most and len(w) >= 4 and (own & ~_known_mask(w)).bit_count() <= most)
    found = sorted((d, w[:1] != word[:1], w) for w in close if (d := distance(word, w, most)) <= most)
    if len(found) > 1 and found[0][:2] == found[1][:2] and isinstance(words, dict) and words[found[0][2]] != words[found[1][2]]:
        return word  # as near to two: what stands beside it in its family decides
    return found[0][2] if found else None


class Parser:
    """Parses names; keeps what it found for each word."""

    def __init__(self) -> None:
        self.given: dict[str, str | None] = {}
        self.business: dict[str, tuple[str, ...] | None] = {}

    def given_name(self, word: str) -> str | None:
        if word not in self.given:
            found = _KNOWN.get(word)
            if found is None:
                near = _near(word, _KNOWN)
                found = _KNOWN.get(near, near) if near else None
            self.given[word] = found
        return self.given[word]

    def business_word(self, word: str) -> tuple[str, ...] | None:
        """The lines of business that a word may stand for; ("",) for a word that says nothing by itself."""
        if word not in self.business:
            found: tuple[str, ...] | None = None
            full = SHORT.get(word, word)
            if full in _TAIL or full in ("management", "manufacturing", "brothers"):
                found = ("",)
            elif full in _MAIN:
                found = (full,)
            elif len(word) >= 3 or len(word) == 2 and sum(w.startswith(word) for w in _MAIN) == 1:
                found = tuple(w for w in _MAIN if w.startswith(word)) or (("",) if any(w.startswith(word) for w in _TAIL) else None)
                if found is None and len(word) >= 4:
                    near = _near(word, [*_MAIN, *_TAIL])
                    found = ((near,) if near in _MAIN else ("",)) if near else None
            self.business[word] = found
        return self.business[word]

    def person(self, name: str) -> tuple[str, str] | None:
        """Core and second part: a given name, one letter with a star for an initial, or nothing."""
        text = plain(name)
        comma = "," in text
        words = [w for w in text.replace(",", " ").split() if w not in TITLES]
        letters = [w for w in words if len(w) == 1]
        words = [w for w in words if len(w) > 1]
        if not words:
            return None
        known = [i for i, w in enumerate(words) if w in _KNOWN] or [i for i, w in enumerate(words) if self.given_name(w)]
        if len(known) == len(words):  # the family name looks like a given name too
            known = [len(words) - 1 if comma else 0] if len(words) > 1 else []
        at = known[0] if known else None
        if at is None and len(words) > 1 and not letters:
            shortest = len(words) - 1 if comma else 0
            if all(len(w) >= 3 for w in words):
                at = shortest
        core = "".join(w for i, w in enumerate(words) if i != at)
        if at is None:
            return core, f"{letters[0]}*" if letters else "*"
        return core, self.given_name(words[at]) or words[at]

    def organisation(self, name: str) -> tuple[str, str] | None:
        """Core and second part: a line of business, several with a star where an abbreviation fits all, or nothing."""
        words = [w for w in plain(name).replace(",", " ").split() if w not in LEGAL]
        main: tuple[str, ...] = ()
        rest = []
        for w in words:
            found = self.business_word(w) if rest or len(w) != 4 or SHORT.get(w, w) in _EXACT else None  # the coined part comes first mostly
            if found is None:
                rest.append(w)
            elif found != ("",) and not main:
                main = found
        core = "".join(rest)
        if not core:
            return None
        return core, main[0] if len(main) == 1 else "|".join(main) + "*"


def parse(df: DataFrame, key: str, kind: str, name: str) -> DataFrame:
    """(id, kind, core, second) of the entities of the two kinds; one row per id."""
    label = F.lower(F.trim(F.col(kind)))
    of = F
    for k, labels in KINDS.items():
        of = of.when(label.isin(labels), k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser()
        for batch in batches:
            rows = []
            for i, k, n in zip(batch["id"], batch["kind"], batch["name"], strict=True):
                found = parser.person(n) if k == "person" else parser.organisation(n)
                if found and found[0]:
                    rows.append((i, k, *found))
            yield pd.DataFrame(rows, columns=["id", "kind", "core", "second"])

    rows = df.select(df[key].cast("string").alias("id"), of.alias("kind"), df[name].alias("name"))
    rows = rows.where("id is not null and kind is not null and length(name) > 0").groupBy("id").agg(F.min(F.struct("kind", "name")).alias("s"))
    tasks = 3 * df.sparkSession.sparkContext.defaultParallelism  # the parser works more than its bytes tell
    return rows.select("id", "s.kind", "s.name").repartition(tasks, "id").mapInPandas(run, "id string, kind string, core string, second string")


def _mask(word: str) -> int:
    """A bit for each letter that a word has, and one for each that it has twice."""
    seen = 0
    for c in word:
        bit = 1 << (ord(c) - 97 if "a" <= c <= "z" else 26)
        seen |= bit << 27 if seen & bit else bit
    return seen


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers whose bits all depend on all bits of x (the end of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _left_out(words: list[str], most: int) -> np.ndarray:
    """A row for each of the words, all of one length: the hashes of what is left without 0 to `most` (at most 2) of the letters."""
    n, size = len(words), len(words[0])
    codes = _mixed(_letters(words).astype(np.uint64) * _ODD)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _ODD)]))
    sums = []  # of the letters before a place, moved to the left by as many places as letters are left out before them
    for moved in range(most + 1):
        part = np.zeros((n, size + 1), np.uint64)
        np.cumsum(codes[:, moved:] * powers[: max(0, size - moved)], axis=1, out=part[:, moved + 1 :]) if size > moved else None
        sums.append(part)
    out = [sums[0][:, size:]]
    if most > 0:
        i = np.arange(size)
        out.append(sums[0][:, i] + sums[1][:, size:] - sums[1][:, i + 1])
    if most > 1:
        i, j = np.triu_indices(size, 1)
        out.append(sums[0][:, i] + sums[1][:, j] - sums[1][:, i + 1] + sums[2][:, size:] - sums[2][:, j + 1])
    return _mixed(np.concatenate(out, axis=1))


def _piece_keys(word: str) -> list[int]:
    """Keys of a long word: its five pieces, and what may be one of a word that is as long or shorter by up to RADIUS.

    RADIUS edits touch at most four pieces, as a transposition touches two, and move the others by at most RADIUS.
    """
    found = set()
    for size in range(len(word) - RADIUS, len(word) + 1):
        ends = [size * k // 5 for k in range(6)]
        for k in range(5):
            for at in range(max(0, ends[k] - RADIUS), min(len(word), ends[k] + RADIUS) + 1):
                text = f"{size} {k} {word[at : at + ends[k + 1] - ends[k]]}"
                found.add(int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little"))
    return sorted(found)


def _keys(kind: str, words: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ids) of some cores of a kind: equal keys for any two within the radius."""
    keys, owners = [], []
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        if size <= LONG:
            found = _left_out([words[i] for i in own], int(radius(size)))
            keys.append(found.ravel())
            owners.append(np.repeat(ids[own], found.shape[1]))
        if size > LONG - RADIUS:
            for i in own:
                found = np.array(_piece_keys(words[i]), np.uint64)
                keys.append(found)
                owners.append(np.repeat(ids[i : i + 1], len(found)))
    seed = np.uint64(int.from_bytes(hashlib.blake2b(kind.encode(), digest_size=8).digest(), "little"))
    return np.concatenate(keys) ^ seed, np.concatenate(owners)


def _equal_keys(keys: np.ndarray, ids: np.ndarray) -> Iterator[pd.DataFrame]:
    """(i, j), i < j: ids that have a key in common; a pair comes once in each frame."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    at, step, kept, size = np.arange(len(keys)), 0, [], 0
    while len(at):
        step += 1
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        kept.append(np.stack([np.minimum(ids[at], ids[at + step]), np.maximum(ids[at], ids[at + step])]))
        size += len(at)
        if size > 1_000_000 or not len(at):
            both = np.concatenate(kept, axis=1)
            both = both[:, both[0] < both[1]]
            both = both[:, np.lexsort(both[::-1])]
            new = np.ones(both.shape[1], bool)
            new[1:] = (both[:, 1:] != both[:, :-1]).any(axis=0)
            yield pd.DataFrame({"i": both[0, new], "j": both[1, new]})
            kept, size = [], 0


def _distances(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """The Damerau-Levenshtein distances of pairs; more than `most` (at most RADIUS) where they exceed it."""
    la, lb = np.array([len(w) for w in a]), np.array([len(w) for w in b])
    out = np.full(len(a), 99)
    short = np.flatnonzero((la <= 100) & (lb <= 100))
    for at in range(0, len(short), 16384):
        own = short[at : at + 16384]
        out[own] = adjacent_distance(_letters([a[i] for i in own]), la[own], _letters([b[i] for i in own]), lb[own])
    for i in np.flatnonzero((out > most) & ((out == most + 1) | (la > 100) | (lb > 100))):
        out[i] = distance(a[i], b[i], int(most[i]))
    return out


def radius_join(cores: DataFrame) -> DataFrame:
    """(kind, a, b, d): all pairs a < b of distinct cores of a kind within the radius of the shorter one."""
    tasks = 3 * cores.sparkSession.sparkContext.defaultParallelism  # few bytes, much work: not to be coalesced by size
    words = cut(cores.select("kind", "core").distinct().repartition(tasks, "core").withColumn("id", F.monotonically_increasing_id()))
    groups = max(tasks, words.count() * 60 // GROUP)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, part in batch.groupby("kind"):
                for at in range(0, len(part), 5000):
                    some = part.iloc[at : at + 5000]
                    keys, ids = _keys(kind, some["core"].tolist(), some["id"].to_numpy(np.int64))
                    group = (keys >> np.uint64(32)) % np.uint64(groups)
                    order = np.argsort(group, kind="stable")
                    keys, ids, group = keys[order], ids[order], group[order]
                    ends = np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64))
                    rows = [(g, keys[x:y].tobytes(), ids[x:y].tobytes()) for g, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if y > x]
                    yield pd.DataFrame(rows, columns=["g", "keys", "ids"])

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, keys, ids = None, [], []
        for batch in batches:
            for g, k, i in zip(batch["g"], batch["keys"], batch["ids"], strict=True):
                if g != last and keys:
                    yield from _equal_keys(np.concatenate(keys), np.concatenate(ids))
                    keys, ids = [], []
                last = g
                keys.append(np.frombuffer(k, np.uint64))
                ids.append(np.frombuffer(i, np.int64))
        if keys:
            yield from _equal_keys(np.concatenate(keys), np.concatenate(ids))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = batch["a"].tolist(), batch["b"].tolist()
            most = np.minimum(radius(batch["a"].str.len().to_numpy()), radius(batch["b"].str.len().to_numpy())) if a else np.zeros(0, int)
            batch = batch.assign(d=_distances(a, b, most).astype(np.int32))
            yield batch[batch["d"] <= most]

    sent = words.mapInPandas(blocks, "g int, keys binary, ids binary")
    met = sent.repartition(tasks, "g").sortWithinPartitions("g").mapInPandas(pairs, "i long, j long")
    first, second = (words.select(F.col("id").alias(i), "kind", F.col("core").alias(c)) for i, c in (("i", "x"), ("j", "y")))
    spelled = met.distinct().join(first, "i").join(second.drop("kind"), "j")
    ordered = spelled.select("kind", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return ordered.mapInPandas(near, "kind string, a string, b string, d int")


def learned(forms: DataFrame) -> DataFrame:
    """(second, full): unknown given names that mostly stand beside one known given name of the same family name.

    A nickname that no list has shows in the data: of the families it stands in, at least SEEN and the share MOSTLY have
    the same other given name. Families with many given names say little and are counted like the others.
    """
    people = forms.where("kind = 'person' and second not like '%*'").select("core", "second").distinct()
    known = F.col("second").isin(sorted(set(_KNOWN.values())))
    new, full = people.where(~known), people.where(known).select("core", F.col("second").alias("full"))
    both = new.join(full, "core").groupBy("second", "full").agg(F.count("*").alias("n"))
    seen = new.join(full.select("core").distinct(), "core", "left_semi").groupBy("second").agg(F.count("*").alias("of"))
    best = both.join(seen, "second").where((F.col("n") >= SEEN) & (F.col("n") >= MOSTLY * F.col("of")))
    return best.groupBy("second").agg(F.min_by("full", F.struct(-F.col("n"), F.col("full"))).alias("full"))


def _fits(kind: str, a: str, b: str) -> bool:
    """Whether two full second parts mean the same: within edits, or one of them the start or end of the other."""
    if a == b:
        return True
    if kind == "organisation":
        return False
    if a in _KNOWN and b in _KNOWN:
        return False
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and (long.startswith(short) or long.endswith(short)):
        return True
    return distance(a, b, 2) <= (1 if min(len(a), len(b)) < 6 else 2)


def _open_fits(kind: Column, part: Column, full: Column) -> Column:
    """Whether an initial, an ambiguous abbreviation or a missing part can stand for a full second part."""
    stem = F.substring_index(part, "*", 1)
    return F.when(stem == "", True).when(kind == "person", F.startswith(full, stem)).otherwise(F.array_contains(F.split(stem, r"\|"), full))


def classes(forms: DataFrame, near: DataFrame) -> DataFrame:
    """(kind, core, second, class) of the distinct forms; `near` has the pairs of near cores.

    A full second part is linked to one that fits it, an equal one also where two edits are between the cores. A class of
    those is a candidate for an open second part (it ends in a star). Where there is no candidate at all, the form is
    linked to the first one with the same open part, in order of the cores.
    """
    rows = cut(forms.select("kind", "core", "second").distinct().withColumn("id", F.monotonically_increasing_id()))
    near = cut(near)
    both = near.select("kind", F.col("a").alias("core"), F.col("b").alias("other"), "d").unionByName(near.select("kind", F.col("b").alias("core"), F.col("a").alias("other"), "d"))
    sure = F.when(F.least(F.length("core"), F.length("other")) >= SHORTEST, 2).otherwise(1)
    both = both.withColumn("sure", sure)
    is_open = F.col("second").endswith("*")
    full, partial = rows.where(~is_open), rows.where(is_open)
    to = full.select("kind", F.col("core").alias("other"), F.col("second").alias("name"), F.col("id").alias("to"))

    equal = full.join(near.select("kind", F.col("a").alias("core"), F.col("b").alias("other")), ["kind", "core"])
    equal = equal.join(to.withColumnRenamed("name", "second"), ["kind", "other", "second"]).select(F.col("id").alias("a"), F.col("to").alias("b"))

    @F.pandas_udf("boolean")
    def fits(kind: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_fits(*x) for x in zip(kind, a, b, strict=True)], dtype=bool)

    def around(some: DataFrame) -> DataFrame:
        """Full forms with a core that is equal, or near."""
        other = some.join(both, ["kind", "core"]).select("id", "kind", "second", "other", "d", "sure")
        own = some.select("id", "kind", "second", F.col("core").alias("other"), F.lit(0).alias("d"), F.lit(1).alias("sure"))
        return own.unionByName(other).join(to, ["kind", "other"])

    # two known names fit only if they are equal; the test by letters and the built-in distance spare most calls
    new = full.where((F.col("kind") == "person") & ~F.col("second").isin(sorted(_KNOWN)))
    like = F.startswith("name", "second") | F.endswith("name", "second") | F.startswith("second", "name") | F.endswith("second", "name") | (F.levenshtein("name", "second") <= 2 * RADIUS)
    similar = around(new).where((F.col("d") < F.col("sure")) & (F.col("second") != F.col("name")) & like).where(fits("kind", "second", "name"))
    edges = equal.unionByName(similar.select(F.col("id").alias("a"), F.col("to").alias("b")))
    found = connected_components(edges).withColumnRenamed("node", "to").withColumnRenamed("component", "top")
    tops = cut(full.select(F.col("id").alias("to")).join(found, "to", "left").select("to", F.coalesce("top", "to").alias("top")))

    open_to = around(partial).where((F.col("d") <= F.col("sure")) & _open_fits(F.col("kind"), F.col("second"), F.col("name"))).join(tops, "to")
    nearest = F.col("d") < F.col("sure")
    seen = open_to.groupBy("id").agg(F.min(F.when(nearest, F.col("top"))).alias("n1"), F.max(F.when(nearest, F.col("top"))).alias("n2"), F.min("top").alias("f1"), F.max("top").alias("f2"))
    seen = cut(seen.select("id", F.coalesce("n1", "f1").alias("low"), F.coalesce("n2", "f2").alias("high")))
    alone = partial.join(seen, "id", "left_anti").join(both.where("d < sure and other < core"), ["kind", "core"])
    earlier = partial.select("kind", F.col("core").alias("other"), "second", F.col("id").alias("to"))
    parents = alone.join(earlier, ["kind", "other", "second"]).groupBy("id").agg(F.min_by("to", "other").alias("to"))
    trees = connected_components(seen.where("low = high").select(F.col("id").alias("a"), F.col("low").alias("b")).unionByName(parents.select(F.col("id").alias("a"), F.col("to").alias("b"))))

    one = rows.join(tops.withColumnRenamed("to", "id"), "id", "left").withColumn("node", F.coalesce("top", "id")).join(trees, "node", "left")
    first = F.coalesce("component", "node").alias("class")
    return one.select("kind", "core", "second", F.concat_ws("\0", "kind", first).alias("class"))


def entity_classes(entities: DataFrame) -> DataFrame:
    """(id, class) of every person and organisation with a usable name."""
    forms = cut(parse(entities, "entity_id", "entity_type", "canonical_name"))
    forms = forms.join(learned(forms), "second", "left").select("id", "kind", "core", F.when(F.col("kind") == "person", F.coalesce("full", "second")).otherwise(F.col("second")).alias("second"))
    linked = classes(forms, radius_join(forms))
    return forms.join(linked, ["kind", "core", "second"]).select("id", "class")


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per entity: its class and how many other spellings of it there are."""
    found = entity_classes(table(spark, folder, "entities"))
    sizes = found.groupBy("class").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return found.join(sizes, "class").select(F.col("id").alias("entity_id"), F.col("first").alias("class_id"), (F.col("n") - 1).alias("links"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = cut(entity_classes(table(spark, folder, "entities")))
    a = found.select(F.col("id").alias("entity_id_a"), "class")
    b = found.select(F.col("id").alias("entity_id_b"), "class")
    return a.join(b, "class").where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b")


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes}
ORACLE: dict[str, str] = {}
