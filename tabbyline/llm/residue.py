"""Problem 6: template residue, filler text, error pages and notices that scripts are required.

Method: each message (a sentence of a line) is masked - numbers, codes, addresses, paths, dates and names -
and grouped by the exact hash of what remains, across sources. Phrase rules say which messages could be
residue; such a message counts wherever it stands if its mask recurs in `least_documents` documents of
`least_sources` sources. What doesn't recur so widely counts only where it can't be ordinary text: as a
placeholder by its syntax, as words of the customary filler text, or as a phrase in a line of nothing but such wordings.

Rules look at a masked message alone, so they are applied before the grouping: messages that no rule could
ever take aren't hashed. An automaton of all words without which no rule matches finds the others in one pass.
A message in a third of all documents is one group, counted before the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tabbyline.llm.encode import slices
from tabbyline.session import ensure_shipped, materialise

#: Placeholders that a template engine or an editor left behind, by their syntax. Case matters where it tells.
PLACEHOLDERS = (
    r"\{\{\{?[-~#/>&^!]?\s*[A-Za-z_][\w\s.|()'\":,=\[\]-]{0,80}\}\}|\{%-?\s*[a-z]{2,}\b[^{}%]{0,80}%\}|[$#]\{[A-Za-z_][A-Za-z0-9_.]*\}"
    r"|<%[=#@-]?\s*[A-Za-z][^<>%]{2,80}%>|%%[A-Za-z][A-Za-z0-9_]+%%|@@[A-Za-z][A-Za-z0-9_.-]*@@|(?<![A-Za-z0-9])__[A-Za-z][A-Za-z0-9]*(_[A-Za-z0-9]+)+__"
    r"|\[\[[A-Z][A-Z0-9_ ]+\]\]|\[\[[a-z]+(?:[._][a-z0-9]+)+\]\]|<<[A-Z][A-Z0-9_ ]+>>|\*\|[A-Z][A-Z0-9_:]+\|\*|%\([a-z_]+\)[sdf]\b"
    r"|#(?:if|foreach|set) ?\(|\$[a-z][a-z0-9]*\.[a-z][a-z0-9_.]*|(?i:\[object object\])"
    r"|(?i:\[(?:insert|your|enter|replace|add)\b[^\]]{0,80}\])|(?i:\b(?:todo|tbd|fixme) ?:)"
    r"|(?i:(?<![a-z] )\bnan (?:kg|g|cm|mg|years|weeks|%))|\bNaN\b"
    r"|(?i:\b(?:born in|weighs|is|was|from|by|called|named|breeder:|:) (?:undefined|null)\b(?! [a-z]+ of))"
)
#: Wordings of filler text, error pages, blocked access and script notices.
PHRASES = (
    r"lorem ipsum|dolor sit amet|\bplaceholder (?:copy|text|content|title|image)\b|\b(?:sample|dummy|filler) text\b|\breplace (?:it|this) before publishing"
    r"|\byour (?:headline|title|text|content|logo|tagline)\b.{0,60}\bhere\b|\bclick (?:here )?to edit\b|\btext about\b.{0,80}\bgoes here\b"
    r"|\b[45]\d\d (?:not found|forbidden|unauthorized|gone|bad request|bad gateway|internal server error|service (?:temporarily )?unavailable|gateway time-?out|too many requests)\b"
    r"|\b(?:http )?error (?:code:? )?[45]\d\d\b|\binternal server error\b|\bpage (?:not found|cannot be (?:found|displayed))\b"
    r"|\bthe (?:page|url|document|resource) you(?: are|'re|’re)? (?:looking for|requested)\b|\brequested url\b.{0,160}\b(?:rejected|not found|could not)"
    r"|\byour support number is\b|\byou do(?:n't|n’t| not) have permission to (?:access|view)\b|^access denied\b"
    r"|\bverify (?:that )?you are (?:a )?(?:human|not a robot)\b|\bcomplete the captcha\b"
    r"|\b(?:enable|turn on|activate|allow|switch on) (?:java)?scripts?\b|\b(?:needs|requires) (?:java)?scripts?\b(?: to| in| for|\.|$)|\bjavascript (?:is|must be|has to be) (?:disabled|required|enabled|turned|switched|not)"
    r"|\berror establishing a database connection\b|\bfatal error: |\bstack trace: ?#|\buncaught \w*error\b|\bsomething went wrong while\b|\bis down for maintenance\b"
    r"|\btoo many requests\b|\bsession\b.{0,120}\bhas expired\b|\bwe could(?: not|n.t) find [“\"«]|^oops\b.{0,20}\bcould(?: not|n't|n’t) find\b"
    r"|\bpage introuvable\b|\bactivez (?:les scripts|javascript)\b|\bpágina\b.{0,160}\bno (?:existe|se encuentra|se encontró|encontrada)(?!\w)|\bactive (?:los scripts|javascript)\b"
    r"|\bseite\b.{0,160}\bnicht gefunden\b|\b(?:aktivieren sie|bitte aktivieren) .{0,20}(?:javascript|skripte)|страниц[а-яё]* .{0,160}не (?:найдена|существует)|включите (?:javascript|скрипты)"
    r"|ページ.{0,80}(?:見つかりません|存在しません)|javascript.{0,12}(?:有効|オン)"
)
#: Wordings that ordinary text may have as well: such a message counts only if it recurs widely.
WEAK_PHRASES = (
    r"\bnot found\b|\bunavailable\b|\bunder (?:construction|maintenance)\b|\bcoming soon\b|\baccess (?:is|was|has been)? ?(?:denied|blocked)\b|\bforbidden\b"
    r"|\bwent wrong\b|\btry again later\b|^oops\b|\bplaceholder\b|\bjavascript\b|\bscripts?\b|\bplease (?:reload|refresh)\b|\bexpired\b|\bundefined\b"
)
#: Words of the customary filler text (fixed values); those that no other text has, and short ones that other languages have too.
FILLER = frozenset(
    "lorem ipsum dolor amet consectetur adipiscing eiusmod tempor incididunt labore dolore magna aliqua veniam nostrud exercitation ullamco laboris aliquip"
    " commodo consequat duis aute irure reprehenderit voluptate cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident officia deserunt mollit laborum".split()
)
FILLER_SHORT = frozenset("sit elit sed do ut et enim ad minim quis nisi ex ea in velit esse eu non sunt culpa qui anim id est".split())
#: Signs and words, in lower case and with single blanks, without one of which a message is not looked at any further.
#: Every branch of the patterns above needs one of them (a test has an example of each).
HINTS = (
    "{{", "{%", "${", "#{", "<%", "%%", "@@", "[[", "<<", "*|", "%(", "__", "#if", "#foreach", "#set", "$", "[object", "[insert", "[your", "[enter", "[replace", "[add", "nan",
    "sit amet", "placeholder", "sample text", "dummy text", "filler text", "before publishing", "your headline", "your title", "your text", "your content",
    "your logo", "your tagline", "to edit", "text about", "todo",
    "tbd", "fixme", "undefined", "null", "error", "not found", "page you", "url you", "document you", "resource you", "requested url", "support number",
    "permission to", "access denied", "access is", "access was", "access has", "access blocked", "verify", "captcha", "script", "went wrong",
    "maintenance", "too many", "could not find", "couldn", "expired", "oops", "stack trace", "introuvable", "página", "seite", "страниц", "скрипт",
    "ページ", "unavailable", "unauthorized", "bad request", "bad gateway", "time-out", "timeout", "construction", "coming soon", "forbidden",
    "try again", "reload", "refresh", "page cannot be", "skript", *(f"{digit} gone" for digit in range(10)), *sorted(FILLER),
)
_SENTENCE = re.compile(r"(?<=[.!?。])\s+")
_PLACEHOLDER = re.compile(PLACEHOLDERS)
_PHRASE = re.compile(PHRASES, re.I)
_WEAK = re.compile(WEAK_PHRASES, re.I)
_WORD = re.compile(r"[^\W\d_]+")
#: "nan" counts as a word only: many words have it inside.
_INSIDE_WORD = re.compile(r"[a-z0-9_]")

#: How sure a message is: by itself; a phrase; a wording that ordinary text may have as well.
SURE, PHRASE, WEAK = 3, 2, 1

_MASKS = (
    (re.compile(r"\b(?:https?://|www\.)\S+|\b[\w.+-]+@[\w-]+\.[\w.]+", re.I), "<url>"),
    (re.compile(r"(?:(?<=\s)|^)/[^\s.,;()]+(?:\.\w+)?(?::\d+)?"), "<path>"),
    (re.compile(r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b|\b\d{1,2}:\d{2}(?::\d{2})?\b"), "<date>"),
    (re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b", re.I), "<code>"),
    (re.compile(r"(?<![\d.,])(?![45]\d\d\b)\d+(?:[.,]\d+)*"), "0"),  # status codes tell, and are kept
    (re.compile(r"(?<=.)(?<![^\W\d_])[^\W\d_a-zß-öø-ÿа-яё][^\W\d_]+(?:['’-][^\W\d_]+)*"), "<name>"),
)


def masked(message: str, names: bool = True) -> str:
    """The message with numbers, codes, addresses, paths and dates made alike, and names if asked, in lower case."""
    for pattern, sign in _MASKS if names else _MASKS[:-1]:
        message = pattern.sub(sign, message)
    return " ".join(message.lower().split())


def is_filler(message: str) -> bool:
    """Whether most words are of the filler text, three at least of those that no other text has."""
    words = _WORD.findall(message.lower())
    telling = sum(map(FILLER.__contains__, words))
    return telling >= 3 and 2 * (telling + sum(map(FILLER_SHORT.__contains__, words))) > len(words)


def judge(message: str) -> int:
    """SURE, PHRASE, WEAK or 0 for a message by itself; short ones, which recur, are remembered."""
    return _remembered(message) if len(message) <= 200 else _judge(message)


def _judge(message: str) -> int:
    if not _hinted(_single(message)):
        return 0
    if _PLACEHOLDER.search(message) or is_filler(message):
        return SURE
    single = " ".join(message.split())
    return PHRASE if _PHRASE.search(single) else WEAK if _WEAK.search(single) else 0


_remembered = lru_cache(maxsize=50_000)(_judge)


def is_residue(message: str) -> bool:
    """Whether a line or message has a placeholder, filler text or an unmistakable wording."""
    return judge(message) >= PHRASE


@lru_cache(maxsize=1)
def _hints() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for hint in HINTS:
        automaton.add_word(hint, hint)
    automaton.make_automaton()
    return automaton


def _single(text: str) -> str:
    """The text in lower case, with single blanks; lines stay lines."""
    low = text.lower()
    for blank in "\t\r\x0b\f\xa0\u3000":
        low = low.replace(blank, " ")
    while "  " in low:
        low = low.replace("  ", " ")
    return low


def _hinted(low: str) -> bool:
    for end, hint in _hints().iter(low):
        if hint != "nan" or not (_INSIDE_WORD.match(low, end + 1) or end > 2 and _INSIDE_WORD.match(low, end - 3)):
            return True
    return False


def hinted_lines(text: str | None) -> list[list[str]]:
    """The messages of each line that holds a hint, found in one pass over texts that have none."""
    if not text or not _hinted(low := _single(text)):
        return []
    return [_SENTENCE.split(line.strip()) for line, lowered in zip(text.split("\n"), low.split("\n"), strict=True) if _hinted(lowered)]


def residue_messages(text: str | None) -> list[str]:
    """The messages of `text` that are residue by themselves, phrases included."""
    return [m for line in hinted_lines(text) for m in line if judge(m) >= PHRASE]


def findings(text: str | None) -> tuple[bool, list[str]]:
    """Whether a text has residue that needs no recurrence, and the masks of its phrases."""
    certain, masks = False, set()
    for line in hinted_lines(text):
        kinds = list(map(judge, line))
        certain |= SURE in kinds or PHRASE in kinds and min(kinds) > 0
        # sentences of ordinary text recur as well but for the names in them, so weak wordings keep their names
        masks |= {masked(m, kind == PHRASE) for m, kind in zip(line, kinds) if kind in (PHRASE, WEAK)}
    return certain, sorted(masks)


def residue_documents(df: DataFrame, key: str = "id", source: str = "source", text: str = "content", least_documents: int = 5, least_sources: int = 2) -> DataFrame:
    """`(key)` of the documents whose text has residue anywhere, each once.

    least_documents, least_sources: how widely a masked message has to recur for a phrase inside of a line, or
    a weak wording, to count. Null keys and texts are no case; a null source is one of its own; rows repeated
    under a key count once, also in the groups. One narrow pass over the texts; only rows of masks are shuffled.
    """
    ensure_shipped(df.sparkSession)
    chosen = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("k"), F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("s"), F.col(text).cast("string").alias("t")
    )
    schema = StructType([*chosen.schema.fields[:2], StructField("certain", BooleanType()), StructField("mask", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                rows, certain, masks = [], [], []
                for n, value in enumerate(batch.column(2)):
                    sure, found = findings(value.as_py())
                    told = found or [None] * sure
                    rows += [n] * len(told)
                    certain += [sure] * len(told)
                    masks += told
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(certain, pa.bool_()), pa.array(masks, pa.string())], schema.names)

    told = materialise(chosen.mapInArrow(run, schema).select("k", "s", "certain", F.xxhash64("mask").alias("h"), F.col("mask").isNotNull().alias("phrase")), "residue")
    once = told.filter("phrase").select("k", "s", "h").distinct()
    wide = once.groupBy("h").agg(F.count_distinct("k").alias("n"), F.count_distinct("s").alias("sources"))
    wide = wide.filter((F.col("n") >= least_documents) & (F.col("sources") >= least_sources)).select("h")
    recurring = once.join(wide, "h", "left_semi").select("k")
    return told.filter("certain").select("k").unionByName(recurring).distinct().withColumnRenamed("k", key)


def without_residue(df: DataFrame, key: str = "id", **options) -> DataFrame:
    """The rows of `df` whose document has no residue; rows of a null key are kept."""
    return df.join(residue_documents(df, key, **options), key, "left_anti")
