r"""Problem 8: template residue, filler, error pages and demands for scripts.

A text is cut into passages (lines, then sentences, markup and speaker labels removed; an unfilled field with its
neighbours is a passage of its own, since the sentence around it is ordinary). A positive-unlabelled naive Bayes model
scores passages: those of trusted records (records of which at least half the passages match the seeding patterns, that
is error replies, notices and placeholders as a whole) that match are the positives, all other passages are unlabelled,
and expectation-maximization re-estimates which of those are residue. Features are hashed words, pairs of words, and
the shape of a passage; what is quoted is masked, and code says that it is code, so that the model can tell text that
shows residue from residue. The seeding patterns are used for the sample only: what decides is the model, over all
passages. A record is residue if the probability that any of its passages is reaches one half.

The model is fitted on the passages of at most SAMPLE records, drawn by hash; every passage of every text is scored.
Scoring needs no shuffle.

Defined cases: null, empty and blank texts aren't residue; rows with a null key are judged like others; repeated rows
are judged alike; without any trusted passage nothing is residue.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecast.io import table

#: Most records that the model is fitted on, hashed features, and rounds of EM.
SAMPLE, FEATURES, ROUNDS = 12_000, 1 << 18, 2
#: Counts that the common distribution of features stands for in either class.
PRIOR = 10.0

_NAME = r"[A-Za-z][A-Za-z _]{1,30}"
#: Unfilled fields, by style. A field stands free: white space or punctuation around it, no path or assignment.
FIELD = re.compile(
    r"(?:^|(?<=[\s(:,;：。、]))(?:"
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\{{%\s*{_NAME}\s*%\}}|\$\{{{_NAME}\}}|#\{{{_NAME}\}}|<%=?\s*{_NAME}\s*%>|<<\s*{_NAME}\s*>>|\[\[\s*{_NAME}\s*\]\]|@@{_NAME}@@|"
    rf"%[A-Z][A-Z_]{{2,30}}%|__[A-Z][A-Z_]{{2,30}}__|XX-{_NAME}-XX|&lt;\s*{_NAME}\s*&gt;|<[a-z][a-z _-]*-goes-here>|\{{{_NAME}\}}|"
    r"\[(?:insert|enter|add|your|type|put|fill in|einfügen|insérer|insertar)\b[^\]\n]{1,50}\]|\[(?!ERROR|INFO|WARN|DEBUG|OK|USER|ASSISTANT|SYSTEM|TOOL|TABLE|FATAL|TRACE|CRITICAL|WARNING|NOTE|DONE)[A-Z][A-Z_]{2,}(?: [A-Z_]{2,})*\]|"
    r"\((?:fill in|insert|enter|add|to be filled in:?)\s[^)\n]{2,40}\)|<(?:your|insert|enter)[ _-][^>\n]{1,40}>"
    r")(?=$|[\s,.;:!?)様さ、。：]|の|</)",
    re.I,
)
_MARKS = re.compile(r"[{<\[%@&(]|__|XX-")
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur consectur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "aucto donec erat facilo ferum ligula magnis morbi nisl nullam pellens porta praesto quam sagit sodalis tristi turpa velit vestibulo viverum vestibulum pellentesque "
    "sagittis tristique turpis viverra fermentum auctor facilisis vitae nunc mauris".split()
)
MASH = frozenset("asdf asdfasdf qwer qwerty foo bar baz bla blah blabla test testtest testing xxx xxxx aaa abc hjkl jkl zxcv lalala dummy yxcv".split())
FILLER = re.compile(
    r"\b(?:your|the|add|insert|put)? ?(?:text|title|caption|content|headline|copy|description) (?:goes|comes|will go|will be) here\b|\b(?:this is|just|only) (?:a )?(?:placeholder|filler|dummy|sample|example)\b|"
    r"\bplaceholder (?:copy|text|content)\b|\b(?:replace|remove|change) (?:it|this|me|this text) (?:before|with|later)\b|\blorem ipsum\b|\b(?:sample|dummy|filler|example) text\b|\btexto de (?:ejemplo|relleno|prueba|muestra)\b|"
    r"\btexte (?:provisoire|d['’]exemple|fictif|de remplissage|à remplacer)\b|\b(?:blindtext|platzhalter(?:text)?|beispieltext|mustertext|fülltext)\b|\bhier (?:steht|kommt|folgt|erscheint)\b.{0,40}\b(?:text|inhalt)\b|"
    r"\bvotre texte ici\b|\bsu texto aquí\b|\bihr text hier\b|^\W*(?:another |a )?(?:sample|example|test) (?:paragraph|sentence|heading|title|page|post|entry|content)\W*$|^\W*(?:content|body|text|details|description)(?: of .{1,30})? (?:to follow|follows|pending)\W*$|"
    r"^\W*(?:empty (?:section|page|note|document)|no content(?: yet)?|n/?a yet|to be (?:written|completed|filled in|continued)|nothing here yet)\W*$|ここに(?:本文|テキスト|文章|文)|ダミーテキスト|サンプルテキスト|^\W*(?:\w+ ){0,3}coming soon\W*$|^\W*(?:another )?(?:heading|paragraph|item|title|bullet|column|cell|slide) (?:one|two|three|four|five|\d)\W*$|\bunder construction\b|\bclick to (?:add|edit)\b",
    re.I,
)
ONLY = re.compile(r"^\W*(?:tbd|tba|tbc|todo|to be (?:done|determined|defined|added|announced|written|completed|filled in)|n\.?n\.?|à (?:compléter|définir)|por definir|folgt|xxx+)\W*$", re.I)
#: Reason phrases of HTTP status codes.
REASONS = (
    r"bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|not acceptable|proxy authentication required|request time-?out|conflict|gone|length required|"
    r"precondition failed|payload too large|request entity too large|uri too long|unsupported media type|range not satisfiable|expectation failed|i'm a teapot|misdirected request|"
    r"unprocessable (?:content|entity)|locked|failed dependency|too early|upgrade required|precondition required|too many requests|request header fields too large|"
    r"unavailable for legal reasons|internal server error|server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|http version not supported|"
    r"variant also negotiates|insufficient storage|loop detected|network authentication required|unknown error|web server is down|connection timed out|access denied"
)
ERROR = re.compile(
    rf"^\W*(?:http(?:/\d(?:\.\d)?)?[\s:]+)?[45]\d\d\b\s*[-–—:|]?\s*(?:{REASONS})\b(?! (?:for|in|from|when|errors?|pages?|responses?|replies|count|because|calls)\b)|"
    r"^\W*(?:(?:http|server|system|proxy|application|error code|status)[\s:]+)*(?:error|fehler|erreur|errore|エラー|http error|http)\s*[:#-]?\s*[45]\d\d\s*(?:$|[-–—:;,.|(（：。]|\s(?-i:(?=[A-Z]))|\s(?=we |the (?:server|service|link|origin|page)|an? |this |your |you |se ha |une |leider |please ))|"
    rf"^\W*(?:{REASONS})\W*(?:$|[.:|–—-]\s|(?=leider|we |an |se |une |the |your |time|reference|back))|"
    r"^\W*[\w .-]{0,30}\|\s*[45]\d\d\W*$|"
    r"\b(?:bad gateway|gateway time-?out|service unavailable): |^\s*traceback: .{0,80}\bstatus [45]\d\d\b|^\W*\w+ \| [45]\d\d\b|\bcertificate of this (?:site|server|page) is not trusted|"
    r"^\W*(?:status|error|code)\W{1,4}[45]\d\d\b.{0,20}\b(?:detail|message|error|title)\b|"
    r"^\W*(?:(?:the )?(?:requested )?(?:page|url|site|document|file|resource)) (?:you (?:requested|were looking for) )?(?:was |were |is |could |can |does |has |that )?(?:not (?:be )?(?:found|exist|available|displayed)|cannot be (?:found|displayed)|been (?:moved|removed|deleted))|"
    r"\bpage not found\b\W*$|^\W*this (?:document|page|file|site|content|link) (?:could not|cannot|can't|is (?:no longer|not|currently|temporarily)|has (?:been|expired)|isn't)\b|"
    r"^\W*we could ?n[o']t find (?:what|the page|that)|^\W*we can'?t (?:find|seem)|^\W*an unexpected (?:condition|error)|^\W*(?:sorry|oops|ups|uh)\b|^\W*something went wrong|"
    r"\b(?:the )?origin took too long to answer|^\W*your (?:request|access|address|ip|session|connection) .{0,20}(?:was|has|is|could)(?: been)? (?:blocked|limited|denied|expired|rejected|refused|banned|timed|not)|"
    r"^\W*too many requests\b|^\W*(?:we are|this site is|the (?:site|service|system|server) is|.{0,20}is (?:currently )?)\s*(?:currently )?(?:down|offline|unavailable) (?:for|due)|\bdown for (?:scheduled )?maintenance\b|"
    r"^\W*access (?:to .{0,30} )?(?:is |was |has been )?(?:denied|forbidden)\W*(?:$|you)|^\W*you (?:do not|don't) have (?:the )?(?:permission|access|rights?)|^\W*the administrator has been informed|"
    r"\bthe (?:server|request) (?:encountered|could not be|failed to|did not|timed out)|^\W*please try again (?:later|in)|"
    r"\bleider ist ein fehler aufgetreten|\b(?:angeforderte|gewünschte|aufgerufene) seite\b.{0,30}(?:nicht|existiert)|^\W*zugriff verweigert|\bseite nicht gefunden\b|\bdienst ist (?:zurzeit|derzeit|momentan) nicht|^\W*wartungsarbeiten|"
    r"\bune erreur est survenue|\bpage (?:demandée |est )?(?:est )?introuvable|\bn['’]avez pas (?:le droit|l['’]autorisation|accès)|^\W*accès (?:refusé|interdit)|\bservice (?:est )?(?:momentanément )?indisponible|en cours de maintenance|"
    r"\bse ha producido un error|\b(?:el )?servidor no pud?o\b|\bpágina (?:solicitada )?(?:no (?:se )?(?:ha sido )?(?:encontr|exist)\w*)|^\W*acceso denegado|\bservicio no (?:está )?disponible|"
    r"ページ(?:が|は)(?:見つかり|存在し|表示でき)|エラーが発生|アクセスが(?:拒否|禁止)|メンテナンス中|サーバー?(?:エラー|が応答)",
    re.I,
)
#: An error reply as a record of its own.
REPLY = re.compile(r"^\s*\{\s*\"(?:status|code|error|statusCode|error_code)\"\s*:\s*(?:[45]\d\d|\{|\"[^\"]*\").{0,40}\"(?:detail|message|error|reason|title|error_description)\"\s*:", re.I)
SCRIPT = re.compile(
    r"\b(?:enabl\w+|activat\w+|turn(?:ed)? on|switch(?:ed)? on|allow\w*|permit)\b.{0,30}\b(?:javascript|scripts?|scripting|cookies)\b|\b(?:javascript|scripts?|scripting|cookies)\b.{0,20}\b(?:is|are|was|must be|have to be|needs? to be|to be|has been)\b.{0,12}\b"
    r"(?:disabled|required|needed|allowed|enabled|blocked|off|turned off|switched off|deactivated|activated|not supported)\b|\b(?:needs|requires) (?:scripts|scripting|javascript|cookies) (?:to|in order)\b|\bchecking (?:your|the) browser\b|\bchecking if the site connection\b|"
    r"\b(?:your )?browser (?:is out of date|does not support|doesn't support|is not supported|blocks|has scripts)|\bverif\w+ (?:that )?you are (?:a )?human\b|\bare you a robot\b|\bmade sure you are not a robot\b|\bjust a moment\b|\bwithout (?:javascript|scripts)\b|"
    r"\b(?:aktivier\w*|einschalten|erlauben|zulassen)\b.{0,30}\b(?:javascript|skripte?|cookies)\b|\b(?:javascript|skripte?)\b.{0,30}\b(?:aktivier\w+|deaktiviert|erforderlich|benötigt|eingeschaltet)\b|\bbrowser wird (?:geprüft|überprüft)\b|"
    r"\b(?:activ\w+|autoris\w+)\b.{0,20}\b(?:javascript|scripts?|cookies)\b|\bjavascript\b.{0,20}\b(?:désactivé|requis|nécessaire|activé|desactivado|necesario|activado)\b|\b(?:habilit\w+|active|activar|permit\w+)\b.{0,20}\b(?:javascript|scripts?)\b|"
    r"JavaScript\s*を?\s*(?:有効|オン)|ブラウザ(?:ー)?(?:を)?(?:確認|チェック)|スクリプトを(?:有効|許可)",
    re.I,
)
CODE = re.compile(
    r"^\s*(?:\$ |>>> |export |cp |mv |rm |cd |sudo |curl |if .*[:{]\s*$|for .*[:{]\s*$|while .*:|return\b|def |class |import |from \w+ import|raise |except|try:|print\(|select |insert into|-- |// |/\*|#!|# |@\w+\(|"
    r"[\w.\[\]'\"]+\s*(?:=|\+=|:=)\s*\S|\{\"|\"\w+\":)|--\w[\w-]*[ =]|\w=\S|\w\([^)]*[\"'][^)]*\)|^\s*\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d|^\s*\[\d\d:\d\d\]"
)
#: Words of texts that write about residue.
ABOUT = re.compile(
    r"\b(?:usually|fell from|rose (?:from|to)|per day|answered|calls because|runbook covers|style guide|forbids?|treats?|we filter|filter(?:s|ed)? pages|pages? that say|"
    r"logs? them|tutorial|label of|the string|means? that|the check in|mark open fields|keeps `|maps `|for example|rejects?|e\.g\.|such as|so the|whenever|returns? a|returned|"
    r"alert(?:s|ed)? on|dashboard|counts? of|we corrected|was misspelt|in the logs?)\b",
    re.I,
)
QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]{3,}\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」|(?<!\w)'[^'\n]{3,}'(?!\w)|‘[^’\n]*’")
LABEL = re.compile(r"^\s*(?:\[(?:user|assistant|system|tool|human|bot)\]|(?:user|assistant|system|tool|human|bot)\s*:|[-*•]\s|\d{1,3}[.)]\s)\s*", re.I)
TAG = re.compile(r"</?(?:html|head|title|body|h[1-6]|p|div|span|noscript|b|i|em|strong|br|hr|center|a|ul|li|script|pre|center)(?:\s[^>]*)?/?>", re.I)
FENCE = re.compile(r"^\s*(?:```|~~~)")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\s\d])|(?<=[。！？])")
_TOKEN = re.compile(r"<\w+>|[^\W\d_]+|\d+|[^\w\s]")
_QUOTES = re.compile("[`\"“„«「'‘]")
_DIGIT = re.compile(r"\d")
_CJK = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]")
_ASCII = re.compile(r"[a-z]+|\d+|<(?:q|field)>|[^\w\s]", re.A)
_KEY = re.compile(r"\"(\w+)\"(?=\s*:)")
#: An unfilled field with the signs next to it.
SNIPPET = re.compile(r"[^\s\w]?\s*<field>\s*[^\s\w]?")
#: Parts of words without which the patterns below can only match at the start of a passage.
FILLER_CUES = (
    "here", "placeholder", "filler", "dummy", "sample", "example", "replace", "remove", "change", "ipsum", "texto", "texte", "text", "platzhalter", "mustertext", "hier ",
    "ここ", "ダミー", "サンプル", "construction", "click to",
)
SCRIPT_CUES = ("script", "skript", "browser", "cookies", "human", "robot", "moment", "スクリプト", "ブラウザ", "有効", "オン")
ERROR_CUES = (
    "gateway", "unavailable", "certificate", "page", "origin", "maintenance", "the server", "the request", "leider", "seite", "dienst", "erreur", "introuvable", "avez pas",
    "service", "error", "servidor", "servicio", "página", "ページ", "エラー", "アクセス", "メンテ", "サーバ",
)
VERDICT = "key string, passages int, passage string, score double"


def passages(text: str) -> Iterator[tuple[str, bool]]:
    """The passages of a text, each with whether it stands in a fenced block of code."""
    fenced = False
    for line in re.split(r"[\r\n\u2028\u2029\x0b\x0c\x85]+", text):
        if FENCE.match(line):
            fenced = not fenced
            continue
        bare = TAG.sub("\n", line) if "<" in line else line
        for part in bare.split("\n"):
            part = LABEL.sub("", part)
            if part.strip():
                for s in SENTENCE.split(part):
                    if s.strip():
                        yield s.strip(), fenced


def field(passage: str) -> bool:
    return bool(_MARKS.search(passage) and FIELD.search(passage))


def masked(passage: str) -> str:
    """The passage in lower case, with marks in place of quotations and of unfilled fields."""
    text = passage
    if _QUOTES.search(text):
        text = QUOTED.sub(" <q> ", _KEY.sub(r"\1", text) if '":' in text or '" :' in text else text)
    if _MARKS.search(text):
        text = FIELD.sub(" <field> ", text)
    return text.lower()


def code(passage: str) -> bool:
    """Whether a passage is code or a line of a log."""
    return CODE.match(passage) is not None or ("=" in passage or "(" in passage or "--" in passage) and CODE.search(passage) is not None


def words_of(text: str) -> list[str]:
    """Words and signs; numbers by kind, scripts without spaces by pairs of characters."""
    plain = text.isascii()
    words = (_ASCII if plain else _TOKEN).findall(text)
    if _DIGIT.search(text):
        words = [w if not w[0].isdigit() else f"#{w[0]}xx" if len(w) == 3 and w[0] in "45" else "#" for w in words]
    if plain or not _CJK.search(text):
        return words
    out: list[str] = []
    for w in words:
        if _CJK.match(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w)
    return out


def shapes(passage: str, fenced: bool = False) -> list[set[str]]:
    """The features of a passage, and of each unfilled field in it."""
    text, is_code = masked(passage), fenced or code(passage)
    parts = [text, *SNIPPET.findall(text)] if "<field>" in text and not is_code else [text]
    out = []
    for part in parts:
        words = words_of(part)
        found = set(words)
        found.update(map(" ".join, zip(["^", *words], [*words, "$"], strict=True)))
        found.add(f"n{min(len(words), 40).bit_length()}")
        if is_code:
            found.add("<code>")
        out.append(found)
    return out


def hashed(found: set[str]) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & (FEATURES - 1) for f in found]


def nonsense(passage: str) -> bool:
    """Whether a passage is words of filler Latin or of keyboard mash, for the most part."""
    words = re.findall(r"[^\W\d_]+", passage.lower())
    if len(words) < 3:
        return False
    return sum(w in LATIN for w in words) >= max(3, 0.6 * len(words)) or sum(w in MASH for w in words) >= max(3, 0.7 * len(words))


def seeds(passage: str, fenced: bool = False) -> str | None:
    """The kind of residue that a passage is by the seeding patterns, if it is and isn't quoted, code or about such things."""
    if fenced:
        return None
    if REPLY.search(passage):
        return "error"
    if code(passage):
        return None
    bare = QUOTED.sub(" ", passage) if _QUOTES.search(passage) else passage
    if field(bare) and not (bare != passage and ABOUT.search(bare)):
        return "field"
    if not re.search(r"\w", bare):
        return None
    plain = html.unescape(bare) if "&" in bare else bare
    if nonsense(plain) or ONLY.match(plain):
        return "filler"
    low = plain.lower()

    def shown(pattern: re.Pattern, cues: tuple[str, ...]) -> bool:
        return pattern.match(plain) is not None or any(c in low for c in cues) and pattern.search(plain) is not None

    kind = "filler" if shown(FILLER, FILLER_CUES) else "script" if shown(SCRIPT, SCRIPT_CUES) else "error" if shown(ERROR, ERROR_CUES) else None
    return None if kind and ABOUT.search(plain) else kind


def examples(text: str) -> Iterator[tuple[set[str], bool]]:
    """The features of the passages of a record, each with whether it is trusted to be residue."""
    found, sure = list(passages(text)), set()
    for i, (p, fenced) in enumerate(found):
        if seeds(p, fenced):
            sure.add(i)
        if 2 * (i + 1 - len(sure)) > len(found):  # no half any more
            sure = set()
            break
    for i, (p, fenced) in enumerate(found):
        for one in shapes(p, fenced):
            yield one, i in sure


def fit(rows: list[list[int]], sure: np.ndarray, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Log odds of the features and, last, of residue as such, by EM over the passages that aren't sure."""
    if not sure.any():
        return np.append(np.zeros(FEATURES), -30.0)
    feature, row = np.fromiter((f for r in rows for f in r), np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weight = sure.astype(float)
    common = np.bincount(feature, minlength=FEATURES) + 0.1
    common *= prior / common.sum()  # a feature that neither class has says nothing
    for left in range(rounds, -1, -1):
        one = np.bincount(feature, weights=weight[row], minlength=FEATURES) + common
        zero = np.bincount(feature, weights=(1 - weight)[row], minlength=FEATURES) + common
        n = weight.sum()
        odds = np.append(np.log(one / (n + prior)) - np.log(zero / (len(rows) - n + prior)), np.log(n) - np.log(max(len(rows) - n, 1.0)))
        if left:
            score = np.bincount(row, weights=odds[feature], minlength=len(rows)) + odds[-1]
            weight = np.where(sure, 1.0, 1 / (1 + np.exp(-np.clip(score, -30, 30))))
    return odds


def model(df: DataFrame, key: str, text: str, sample: int = SAMPLE) -> np.ndarray:
    """The model of a corpus, fitted on the passages of at most `sample` of its records, drawn by the hash of key and text.

    Records that share a text are drawn one by one, so a form that is repeated word for word is as likely seen as others.
    """
    texts = df.select(df[text].alias("text"), F.xxhash64(df[key].cast("string"), df[text]).alias("h")).where(F.length("text") > 0)
    share = max(1, texts.count() // sample)
    drawn = texts.where(F.pmod("h", F.lit(share)) == 0).orderBy("h", "text").limit(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(np.array(hashed(found), np.int32).tobytes(), sure) for t in batch["text"] for found, sure in examples(t)]
            yield pd.DataFrame(rows, columns=["features", "sure"])

    tasks = 3 * df.sparkSession.sparkContext.defaultParallelism
    got = drawn.repartition(tasks, "h").mapInPandas(run, "features binary, sure boolean").toPandas()  # of at most `sample` records
    return fit([np.frombuffer(x, np.int32).tolist() for x in got["features"]], got["sure"].to_numpy(bool))


class Scorer:
    """Scores passages with the log odds of a model; remembers the odds of features and the scores of passages."""

    def __init__(self, odds: np.ndarray) -> None:
        self.odds, self.known, self.seen = odds, {}, {}

    def one(self, found: set[str]) -> float:
        total, known = float(self.odds[-1]), self.known
        for f in found:
            x = known.get(f)
            if x is None:
                x = known[f] = float(self.odds[zlib.crc32(f.encode("utf-8", "surrogatepass")) & (FEATURES - 1)])
            total += x
        return total

    def passage(self, passage: str, fenced: bool) -> float:
        """The log odds that a passage, or an unfilled field in it, is residue."""
        key = (passage, fenced)
        score = self.seen.get(key)
        if score is None:
            if len(self.seen) > 1 << 17 or len(self.known) > 1 << 20:
                self.seen, self.known = {}, {}
            score = self.seen[key] = max(map(self.one, shapes(passage, fenced)))
        return score

    def record(self, text: str) -> tuple[int, str | None, float]:
        """How many passages are residue, the surest, and the log odds that any is."""
        clean, best, n = 0.0, (-1e9, None), 0
        for p, fenced in passages(text):
            score = self.passage(p, fenced)
            if score > -30:
                clean -= np.logaddexp(0.0, min(score, 30.0))  # log of the probability that none is
                n += score > 0
                best = max(best, (score, p))
        some = -np.expm1(clean)
        return n, best[1], float(np.log(some) - clean) if some > 0 else -1e9


def find_residue(df: DataFrame, key: str, text: str, odds: np.ndarray | None = None) -> DataFrame:
    """(key, passages, passage, score) of the rows of df that are or hold residue, with the passage that shows it best."""
    odds = model(df, key, text) if odds is None else odds
    sent = df.sparkSession.sparkContext.broadcast(odds)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"], strict=True):
                n, passage, score = scorer.record(t)
                if score >= 0:
                    rows.append((k, n, passage, score))
            yield pd.DataFrame(rows, columns=["key", "passages", "passage", "score"])

    rows = df.select(df[key].cast("string").alias("key"), df[text].alias("text")).where(F.length("text") > 0)
    return rows.mapInPandas(judge, VERDICT)


def p8_residue(spark: SparkSession, folder: str) -> DataFrame:
    found = find_residue(table(spark, folder, "documents"), "doc_id", "text")
    return found.withColumn("key", F.col("key").cast("long")).withColumnRenamed("key", "doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_residue(spark, folder).select("doc_id").distinct()


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The clean corpus: every document that isn't residue."""
    documents = table(spark, folder, "documents")
    return documents.join(p8_found(spark, folder), "doc_id", "left_anti").select("doc_id", "text", "lang", "source", "doc_type")


QUERIES = {"p8_found": p8_found, "p8_residue": p8_residue, "p8_clean": p8_clean}
ORACLE: dict[str, str] = {}
