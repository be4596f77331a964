"""Problem 7: the main body of a page against its furniture.

Method: line-block distribution. Markup is stripped, each line gets the length of its text, and lengths are
summed over a sliding window of lines. The first line of text whose window reaches `SURGE` is where the text
surges, the last one is where it dives. Where a line stands decides on it first: outside of surge and dive it
is furniture, inside it is text. What it says or looks like corrects that:
  outside, kept: the page's own heading, rows of a table, messages of problem 6, and what adjoins the text
    without a break (closed sentences, items, the caption of a list, one stranded heading);
  at the edges: a line of listed wording (consents, notices, menus) neither surges nor dives;
  inside, taken out: interruptions (advertisements, sharing, signing up, links to other pages) and lists of
    other pages under their heading.
Only pages without running text (records, tables, messages of errors) have no surge; there the wording and form of
every line decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tabbyline.llm.encode import slices
from tabbyline.llm.residue import is_residue
from tabbyline.session import ensure_shipped

#: Forms of lines, and marks of lines of a page without running text.
BLANK, TEXT, ROW, ITEM, SENTENCE, OTHER = range(6)
BODY, OWN, SHORT, HEAD, PART = range(6, 11)
#: Characters in a window of lines from which on the text surges, and those of a line that is text by its length alone.
SURGE, EDGE = 120, 100

_MARKUP = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>", re.I)
_TRIM = " \t\r\n\u3000\xa0"
_BULLET = re.compile(r"^(?:[-*+•·–—▪◦>]|>>|»|→)\s+")
#: What stands between the items of a menu.
_SEPARATOR = re.compile(r"\s*(?:»|›|·|•|\||::|\s/\s|\s>\s|\s-\s|\s–\s)\s*|\s{2,}|\u3000+")
#: What stands before the last step of a breadcrumb.
_STEP = ("»", "›", "::", "/", ">", "→", "|")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_CLOSERS = "\"'”’»)]」』"
_ENDS = tuple(".!?…。！？:;")
_TABLE = re.compile(r"^\||\t|^[\[{\"<]")
_RECORD = re.compile(r"^[|\[{\"<]|\t|\w: [^;]+; \w+: |\w=\S|^\d{4}-\d\d-\d\d|^https?://")
_SETTING = re.compile(r"\w=\S")
_NUMBERED = re.compile(r"^\d{1,4}[.)] ")
_NO_ITEM = re.compile(r"[\d.,;:()]")

#: Furniture that interrupts a text: sharing, signing up, advertisements, links to other pages.
_INTERRUPTIONS = [
    # sharing
    r"share (this|on|via|the (page|article|story))\b[^.]*$|print (this|the) (article|page|story)\b[^.]*$",
    r"(send|e-?mail) (this )?to a friend\b|save for later$|copy link$",
    r"(share|tweet|pin|send|print|mail|like|post|save)( (share|tweet|pin|send|print|mail|like|post|save))+$",
    r"(teilen|partager|compartir|поделиться|シェアする?)( [^\s.]+){0,4}$",
    # signing up
    r"follow us\b|(enter|type) your e-?mail\b|subscribe( (now|here|today|to (our|the))\b.*)?$",
    r"sign up (for|to)\b|become a (member|supporter|patron)\b|(download|get) (our|the) app\b|join [\d.,]+\b|join (us|our)\b",
    # advertisements
    r"\[? ?(ad|ads|advert|advertisement|anzeige|werbung|publicidad|publicité|реклама|広告|pr) ?\]?$|ad ?: |(sponsored|promoted)\b[^.]{0,30}$",
    r"(story|article|text) continues (below|after)\b",
    # links to other pages
    r"((see|read) also|related|read (more|next)|more on this|lee también|lire aussi|siehe auch|lesen sie auch|читайте также|関連(記事)?) ?[:：]",
    r">> ",
]
_INTERRUPTION = re.compile("|".join(_INTERRUPTIONS))
#: Wordings with which furniture begins; matched on the lower-case line with single blanks.
_FRONT = re.compile(
    "|".join(
        [
            # consents
            r"we (value|respect|care about) your privacy|your (consent|privacy)\b.*(asked|matters|settings|choices)",
            r"by (staying|continuing|browsing|using)\b.*\b(site|agree|accept)",
            # bylines and dates
            r"(text|words|story|photos?|pictures?)( and (pictures?|photos?|words|text))?\s?: ?\D{3,60}$",
            r"(medically |fact[- ]?)?(checked|reviewed|edited|written|posted|published|compiled) by [^.]{3,90}$",
            r"by [^\d.:]{3,40},[^.\d]{0,30}\b(editor|writer|staff|reporter|correspondent|contributor|author|team)\b[^.]*$",
            r"by [^\d\s.,:]+ [^\d\s.,]+$",
            r"(last )?(updated|changed|modified|revised|published|posted)\b( on| at|:)? ?[^.]{0,12}\d[^.]{0,80}$",
            r"[^.|]{3,50} \| (staff|senior|guest)? ?(writer|editor|reporter|author)\b",
            r"\d+ ?(min|minutes?) read\b|reading time\b|\d+ (views|shares)\b",
            r"(por|par|von|автор:?|autor:?|auteur ?:?) [^\d\s.,]+ [^\d\s.,]+$",
            *_INTERRUPTIONS,
            # comments and tags
            r"(\d+|no) comments?\b|leave a (reply|comment)\b|(tags?|topics?|labels?|keywords|categories) ?: |filed under\b|\d+ (readers?|people|users) (found|like)\b",
            # notices
            r"©|\(c\)|copyright\b|no part of\b.*\b(may|must)\b",
            r"(impressum|datenschutz|aviso legal|mentions légales|правовая информация|お問い合わせ|著作権) ?[:：]|все права\b|tous droits\b|todos los derechos\b|alle rechte vorbehalten",
            # footers
            r"\^? ?((back|go|return) to )?(the )?top( of (the )?page)?$|(nach oben|volver arriba|haut de page|наверх)$|\^ ?[^\W\d_]+( [^\W\d_]+)?$",
            r"(terms|privacy|imprint|contact|sitemap|accessibility|press|careers|help|about us)( (and|&) (terms|privacy|conditions))?$",
        ]
    )
)
#: Words without which no wording below is tried.
_HINTS = (
    "cookie", "クッキー", "куки", "small files", "never miss", "inbox", "a friend", "rights reserved", "permission", "terms", "licence", "license", "registered", "replace", "substitute",
)
#: Wordings that furniture has anywhere.
_INSIDE = re.compile(
    "|".join(
        [
            r"\b(uses?|cookie policy|accept( all)?|which) cookies\b|\bcookies? (policy|settings|preferences|notice)\b|\bcookies you allow\b",
            r"\bcookies to (remember|improve|give|analy|measure|personal|offer|ensure|provide)|\bstores? small files on your device\b",
            r"\butilise des cookies\b|\butiliza cookies\b|\bverwende[tn] cookies\b|использу\w+ (файлы )?(cookie|куки)|(クッキー|cookie)を使用",
            r"\bnever miss\b.{0,30}[.!]$|\bfree in your inbox\b|\btell a friend\b",
            r"\ball rights reserved\b|\bwritten permission\b|\bopen content terms\b|\bunder (the|a) [^.]{0,60}\b(licen[cs]e|terms)\b.*(version|\d)",
            r"\bregistered (trade ?(name|mark)|trademark)\b|\b(does|do) not (replace|substitute)\b.*\b(visit|advice|vet\w*|doctor)\b|\bnot a substitute for\b",
        ]
    )
)
#: Headings of lists of other pages.
_HEAD = re.compile(
    r"(related|more|other|similar|recommended|popular|latest|recent|further|trending)\b( (pages?|stories|articles|posts|reading|topics|news|links|content|on|in|from|for)\b[^.:?]{0,50})?$"
    r"|you (may|might) (also )?(like|enjoy)\b[^.]{0,20}$|editor(['’]s|s['’]?|ial) (picks?|choices?)$|most (read|popular|viewed|shared)\b[^.:]{0,40}$"
    r"|(what|where) to read next$|read (next|more)$|(también te puede interesar|à lire aussi|das könnte sie auch interessieren|похожие статьи|関連記事)$"
)
_ADDRESS = re.compile(r"[^,\d]{3,60}, \d+[a-z]? [^,.\d]{3,40}, [^,.\d]{3,40}$")


def _menu(raw: str, least: int = 4) -> bool:
    """Items of a few words each, divided by one of the usual signs or by gaps."""
    bare = raw.strip("|·• ")
    first = _SEPARATOR.search(bare, 0, 30)
    if first is None or first.start() > 24:
        return False  # the first item is too long already
    items = [i for i in _SEPARATOR.split(bare) if i]
    return len(items) >= least and all(len(i) <= 24 and i.count(" ") < 3 and _WORD.search(i) and not _NO_ITEM.search(i) for i in items)


def _glued(line: str) -> bool:
    """A menu whose items have lost the gaps between them."""
    return len(line) >= 20 and " " not in line and bool(re.fullmatch(r"[^\W\d_]+(?:[-&][^\W\d_]+)*", line)) and not _WIDE.search(line)


def _plain(raw: str) -> str:
    """The line without markup, with single blanks."""
    if raw.isascii() and raw.isprintable() and "  " not in raw and "<" not in raw:
        return raw.strip()
    return " ".join((_MARKUP.sub(" ", raw) if "<" in raw else raw).split())


def _closed(line: str) -> bool:
    return line.rstrip(_CLOSERS).endswith(_ENDS)


def _listed(low: str) -> int:
    """HEAD or PART if the lower-case line has a listed wording, else 0."""
    if _HEAD.match(low):
        return HEAD
    return PART if _FRONT.match(low) or any(map(low.__contains__, _HINTS)) and _INSIDE.search(low) else 0


class Line(NamedTuple):
    """What a trimmed line is by itself."""

    length: int  # of its text: wide scripts twice, no markup, no bullet
    form: int
    listed: int  # HEAD or PART by its wording, else 0
    interrupts: bool = False
    menu: bool = False  # several items of a menu
    item: bool = False  # may be one item of a menu
    address: bool = False
    names_a_page: bool = False
    words: int = 0


def _measure(raw: str) -> Line:
    line = _plain(raw)
    if not line:
        return Line(0, BLANK, 0)
    bare = _BULLET.sub("", line)
    wide = 0 if line.isascii() else len(_WIDE.findall(bare))
    length, low = len(bare) + wide, line.lower()
    listed = _listed(low)
    interrupts = listed == PART and _INTERRUPTION.match(low) is not None
    closed = _closed(line)
    menu = not closed and (_menu(raw) or _glued(line))
    if length >= EDGE:
        row = raw[0] in "|[{\"<" or "\t" in raw or "=" in raw and _SETTING.search(raw) is not None
        return Line(length, ROW if row else TEXT, listed, interrupts, menu)
    words = _WORD.findall(bare)
    count = len(words)
    if _RECORD.search(raw) or sum(map(len, words)) < 0.6 * len(bare.replace(" ", "")):
        form = ROW
    elif wide >= 30 or count >= 14 and not closed:
        form = TEXT
    elif closed and (count >= 6 or wide >= 12):
        form = SENTENCE
    elif line != bare or _NUMBERED.match(line):
        form = ITEM
    else:
        form = OTHER
    return Line(length, form, listed, interrupts, menu, _menu_item(raw), _ADDRESS.match(low) is not None, _names_a_page(line), count)


_remembered = lru_cache(maxsize=100_000)(_measure)


def measure(raw: str) -> Line:
    """`_measure`, remembered for short lines, as these recur."""
    return _remembered(raw) if len(raw) < EDGE else _measure(raw)


def blocks(lengths: Sequence[int], width: int = 3) -> list[int]:
    """For each line the largest sum of lengths of the windows of `width` lines that hold it."""
    padded = [0] * (width - 1) + list(lengths) + [0] * (width - 1)
    sums = list(map(sum, zip(*(padded[k:] for k in range(width)))))
    return list(map(max, zip(*(sums[k:] for k in range(width)))))


def surge_and_dive(lengths: Sequence[int], forms: Sequence[int], width: int = 3, surge: int = SURGE) -> tuple[int, int]:
    """First and last line of the main text, (0, -1) if there is none: lines of text, or rows and items beside
    others such, whose block reaches `surge`. A row or item counts as a third of a surge at least."""
    rows = [f == ROW or f == ITEM for f in forms]
    sums = blocks([max(n, surge // width) if row else n for n, row in zip(lengths, rows)], width)
    beside = blocks(rows, width) if any(rows) else rows
    inside = [k for k, (form, row) in enumerate(zip(forms, rows)) if sums[k] >= surge and (form == TEXT or row and beside[k] > 1)]
    return (inside[0], inside[-1]) if inside else (0, -1)


def has_running_text(text: str) -> bool:
    """Whether a text surges anywhere."""
    measured = [measure(line) for line in (raw.strip(_TRIM) for raw in text.split("\n")) if line]
    return surge_and_dive([m.length for m in measured], [m.form for m in measured])[1] >= 0


def _heading(lines: list[str], title: str | None) -> tuple[list[bool], list[bool]]:
    """Which lines are the page's heading, and which are a breadcrumb that ends with it."""
    own = " ".join(title.split()).lower() if title else ""
    heading, crumb = [False] * len(lines), [False] * len(lines)
    for n, line in enumerate(lines):
        if own and len(line) <= len(own) + 120 and line[-1].lower() == own[-1]:
            low = " ".join(line.split()).lower()
            if low.endswith(own):
                heading[n] = len(low) == len(own)
                crumb[n] = not heading[n] and low[: -len(own)].rstrip().endswith(_STEP)
    return heading, crumb


def furniture(content: str | None, title: str | None = None) -> list[int]:
    """Numbers of the lines of `content` that are page furniture; none for null and empty contents."""
    if not content:
        return []
    raw = [line.strip(_TRIM) for line in content.split("\n")]
    filled = [k for k, line in enumerate(raw) if line and measure(line)[1] != BLANK]
    lines = [raw[k] for k in filled]
    if not lines:
        return []
    measured = list(map(measure, lines))
    heading, crumb = _heading(lines, title)
    wording, linked = _by_wording(lines, measured, heading, crumb)
    start, stop = surge_and_dive([m.length for m in measured], [OTHER if w else m.form for w, m in zip(wording, measured)])
    if stop < 0:
        return [k for k, m in zip(filled, _without_surge(lines, heading, crumb)) if m in (PART, HEAD)]
    first, last = _adjoining(lines, measured, wording, heading, start, stop)
    return [
        filled[n]
        for n, m in enumerate(measured)
        if (linked[n] or m.interrupts if first <= n <= last else wording[n] or m.form != ROW) and not heading[n] and not is_residue(lines[n])
    ]


def _by_wording(lines: list[str], measured: list[Line], heading: list[bool], crumb: list[bool]) -> tuple[list[bool], list[bool]]:
    """Which lines name themselves as furniture (listed wordings, menus, breadcrumbs, pages listed under a heading),
    and which of them are such a heading or list."""
    out, linked = crumb.copy(), [False] * len(lines)
    listing, last = False, len(lines) - 1
    for n, m in enumerate(measured):
        if m.listed == HEAD:
            listing = out[n] = linked[n] = True
        elif listing and m.names_a_page and m.form in (ITEM, OTHER) and not heading[n] and not m.listed:
            out[n] = linked[n] = True
        else:
            listing = False
            if m.listed:
                out[n] = True
            elif m.menu and not heading[n]:
                row = m.form == ROW and (lines[n][0] == "|" == lines[n][-1] or n > 0 and measured[n - 1].form == ROW or n < last and measured[n + 1].form == ROW)
                out[n] |= not row
            elif m.item and not heading[n]:
                out[n] |= m.form == ITEM or n > 0 and measured[n - 1].item
    if last and measured[last].address and sum(m.address for m in measured) == 1:
        out[last] = True  # the address of the site; records have more than one
    return out, linked


def _adjoining(lines: list[str], measured: list[Line], wording: list[bool], heading: list[bool], first: int, last: int) -> tuple[int, int]:
    """Surge and dive widened by what adjoins the text without a break other than an interruption."""

    def belongs(n: int) -> bool:
        if heading[n] or measured[n].interrupts:
            return True
        if wording[n]:
            return False
        if measured[n].form in (TEXT, ROW, SENTENCE, ITEM) or measured[n].words >= 5:  # the last: a heading without text of its own
            return True
        caption = n + 1 < len(lines) and measured[n + 1].form in (ROW, ITEM) and not wording[n + 1]
        return caption or is_residue(lines[n])

    at = first - 1
    while at >= 0 and not heading[first] and belongs(at):
        first = first if wording[at] else at
        at -= 1
    at = last + 1
    while at < len(lines) and belongs(at):
        last = last if wording[at] else at
        at += 1
    return first, last


def _without_surge(lines: list[str], heading: list[bool], crumb: list[bool]) -> list[int]:
    """Marks of the lines of a page that has no running text, by wording and form alone."""
    marks = [OWN if h else PART if c else _mark(line) for line, h, c in zip(lines, heading, crumb)]
    # a menu with one item to a line, or with its gaps lost, before everything else
    run = 0
    while run < len(lines) and marks[run] != OWN and _menu_item(lines[run]):
        run += 1
    if run >= 3 or run and run < len(lines) and marks[run] == OWN:
        marks[:run] = [PART] * run
    for n in range(min(2, len(lines))):
        if marks[n] in (SHORT, BODY) and len(lines) > 2 and _glued(_plain(lines[n])):
            marks[n] = PART
    own = [n for n, m in enumerate(marks) if m in (BODY, OWN)]
    start, stop = (own[0], own[-1]) if own else (0, -1)
    listing, before = False, BLANK
    addresses = [n for n, m in enumerate(marks) if m == SHORT and _ADDRESS.match(_plain(lines[n]).lower())]
    for n, line in enumerate(lines):
        if marks[n] == HEAD:
            listing = True
        elif marks[n] in (BODY, OWN):
            listing = False
        elif marks[n] == SHORT:
            if listing and _names_a_page(_plain(line)):
                marks[n] = PART
            elif addresses == [n] and (before in (PART, HEAD) or n == len(lines) - 1 and n > 0):
                marks[n] = PART
            else:
                listing = False
        before = marks[n]
    # short lines at the ends of the page, shut in by furniture
    for n, line in enumerate(lines):
        if marks[n] == SHORT and stop >= 0 and not start <= n <= stop and not _NO_ITEM.search(_plain(line)):
            if all(m in (PART, HEAD) for m in marks[max(0, n - 2) : n]) and all(m in (PART, HEAD, OWN) for m in marks[n + 1 : n + 2]):
                marks[n] = PART
    return marks


def _mark(raw: str) -> int:
    """The mark of a line of a page without running text."""
    low = _plain(raw).lower()
    listed = _listed(low)
    if listed or _TABLE.search(raw):
        return listed or BODY
    gaps, closed = low.count(" "), _closed(low)
    if closed and gaps >= 6:
        return BODY
    if _menu(raw):
        return PART
    if not low.isascii() and (wide := len(_WIDE.findall(low))):
        return BODY if wide >= 12 and closed else SHORT
    words = len(_WORD.findall(low))
    return BODY if closed and words >= 6 or words <= 1 and not _BULLET.match(low) and not _glued(low) else SHORT


def _menu_item(raw: str) -> bool:
    line = _plain(raw)
    bare = _BULLET.sub("", line)
    return 1 < len(bare) <= 24 and bare.count(" ") < 3 and not _NO_ITEM.search(bare) and bool(_WORD.search(bare)) and not _WIDE.search(bare)


def _names_a_page(line: str) -> bool:
    """The form of a title: some words, no record or list of names, not a closed sentence."""
    bare = _BULLET.sub("", line)
    return not bare.endswith(".") and not re.search(r"[;{}|=\t]|, [^ ]+$", bare) and (len(bare.split()) >= 3 or bool(_WIDE.search(bare)))


def _lines(df: DataFrame, key: str, text: str, title: str, with_body: bool) -> DataFrame:
    ensure_shipped(df.sparkSession)
    schema = StructType([StructField("k", df.schema[key].dataType), StructField("lines", ArrayType(IntegerType()))])
    if with_body:
        schema.add(StructField("body", StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                texts, titles = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                found = list(map(furniture, texts, titles))
                columns = [batch.column(0), pa.array(found, pa.list_(pa.int32()))]
                if with_body:
                    columns.append(pa.array(list(map(without, texts, found)), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    chosen = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(title).cast("string").alias("h"))
    return chosen.mapInArrow(run, schema)


def without(content: str | None, lines: list[int]) -> str | None:
    """`content` without the lines of these numbers."""
    if content is None or not lines:
        return content
    gone = set(lines)
    return "\n".join(line for k, line in enumerate(content.split("\n")) if k not in gone)


def furniture_lines(df: DataFrame, key: str = "id", text: str = "content", title: str = "title") -> DataFrame:
    """`(key, line_no)` of each line of page furniture, once for rows repeated under one key.

    Null keys, null and empty texts have none; a null title only means that the page's heading is judged
    as any other line. Each document is judged by itself: no shuffle but for the last distinct.
    """
    lines = _lines(df.filter(F.col(key).isNotNull()), key, text, title, False)
    return lines.select(F.col("k").alias(key), F.explode("lines").alias("line_no")).distinct()


def main_body(df: DataFrame, key: str = "id", text: str = "content", title: str = "title") -> DataFrame:
    """`(key, text)`: only the lines of the main body, for each row of `df`. Null texts stay null. Narrow."""
    return _lines(df, key, text, title, True).select(F.col("k").alias(key), F.col("body").alias(text))
