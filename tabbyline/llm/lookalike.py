"""Problem 10: one consistent form for texts that look alike but differ in their characters.

Method: normalisation with quick checks. A character is *unstable* if the form may change it or what
stands before it: its NFC quick check isn't "yes", it has a look-alike of another script, is a width,
ligature or blank variant, or can't be seen. A text without unstable characters is passed through after
one scan. In others only the unstable segments are rewritten, each with the boundary before it (the
starter that a combining mark may join), and spliced into the untouched rest.

The form: NFC; widths, ligatures and Roman-numeral signs as plain letters; every blank variant as a
blank; \\r\\n and \\r as \\n; characters without a glyph removed, but for a joiner inside an emoji sequence;
letters of Cyrillic and Greek that can't be told from a Latin one as that letter. Case, accents, digits,
fractions, superscripts and the number of blanks are kept: they can be seen.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tabbyline.session import ensure_shipped, materialise

#: Letters that can't be told from a Latin one (fixed values, after the public table of confusables): Cyrillic, Greek,
#: Armenian, Latin variants, Lisu, Cherokee.
LOOKALIKES = dict(
    zip(
        "АВЕІЈКМНОРЅТХаеорсухіјѕԁһԛԝүҮԌԜԚСѴѵӀӏ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳνµϹͿϜ" + "ՕՍօսհոց" + "ɑɡ" + "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ" + "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ",
        "ABEIJKMHOPSTXaeopcyxijsdhqwyYGWQCVvIl" + "ABEZHIKMNOPTYXocjvμCJF" + "OUouhng" + "ag" + "BPdDTGKJCZFMNLSRVHWXYAEIOU" + "ABCDEGHJKLMPRSTVWZ",
        strict=True,
    )
)
#: Kinds of compatibility mappings under which the character looks like what it is mapped to.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>")
_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Controls of direction that change the order of what is seen, and so stay.
_VISIBLE_FORMAT = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
_EMOJI = "[\u2190-\u21ff\u2300-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff]"
#: Signs without a glyph that shape what is seen: joiners and selectors of emoji, and of key caps.
_SHAPING = re.compile(f"((?<={_EMOJI})\ufe0f?\u200d(?={_EMOJI})|(?<={_EMOJI})[\ufe0e\ufe0f]|(?<=[0-9#*])\ufe0f(?=\u20e3))")
#: Selectors of variants and fillers, which have no glyph by themselves.
_UNSEEN = "\u115f\u1160\u3164\uffa0\u034f\u180b\u180c\u180d\u180f"


def _fold(ch: str, alike: dict[str, str]) -> str | None:
    """What the form makes of a character by itself, before NFC; None if it is left as it is."""
    if ch in alike:
        return alike[ch]
    if ch in _BLANKS:
        return " "
    category = unicodedata.category(ch)
    if category == "Cf" and ch not in _VISIBLE_FORMAT or category == "Cc" and ch not in "\t\n\r":
        return ""
    if ch in _UNSEEN or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    mapping = unicodedata.decomposition(ch)
    if mapping.startswith(_SAME_LOOK):
        plain = unicodedata.normalize("NFKC", ch)
        # spacing accents and fraction parts would fall apart into a blank and a mark
        if not plain.startswith(" ") and "⁄" not in plain and unicodedata.category(plain[0])[0] in "LNPS":
            return plain
    return None


def read_confusables(path: str) -> dict[str, str]:
    """Letters of other scripts that a public table of confusables (`code ; code ; type` lines) maps to one Latin letter."""
    alike = {}
    with open(path, encoding="utf-8-sig") as file:
        for line in file:
            fields = line.split("#")[0].split(";")
            if len(fields) >= 2:
                source, target = ("".join(chr(int(code, 16)) for code in field.split()) for field in fields[:2])
                if len(source) == len(target) == 1 and source.isalpha() and target.isascii() and target.isalpha() and not source.isascii():
                    if not unicodedata.decomposition(source):
                        alike[source] = target
    return alike


def _settled(ch: str, alike: dict[str, str]) -> str:
    """`_fold` until nothing changes, so that the form of a form is itself."""
    while True:
        folded = "".join(c if (f := _fold(c, alike)) is None else f for c in ch)
        parts = unicodedata.normalize("NFD", folded)
        plain = [p if (f := _fold(p, alike)) is None else f for p in parts]
        if plain != list(parts):  # an accented look-alike, such as the Cyrillic io
            folded = unicodedata.normalize("NFC", "".join(plain))
        if folded == ch:
            return ch
        ch = folded


@lru_cache(maxsize=4)
def _tables(confusables: str | None = None) -> tuple[re.Pattern, dict[int, str], re.Pattern]:
    """Pattern and table of the foldings, which need no context, and the pattern of segments whose NFC depends on what
    stands before them: the quick check is "no" for what NFC changes, and "maybe" for marks and for whatever comes
    second in a canonical decomposition, starters of some scripts among them."""
    alike = LOOKALIKES | (read_confusables(confusables) if confusables else {})
    codes = [*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]
    folds, unstable = {}, set(range(0x1161, 0x11C3))  # vowels and finals of Korean syllables, which are composed by rule
    for code in codes:
        ch = chr(code)
        if unicodedata.combining(ch) or unicodedata.normalize("NFC", ch) != ch:
            unstable.add(code)
        unstable.update(map(ord, unicodedata.normalize("NFD", ch)[1:]))
        if (folded := _settled(ch, alike)) != ch and code >= 0x80 or code < 0x80 and _fold(ch, alike) == "":
            folds[code] = folded
    for code in [c for c in folds if unicodedata.normalize("NFC", chr(c)) == folds[c]]:
        del folds[code]  # NFC does these
    return re.compile(f"[{_ranges(folds)}]"), folds, re.compile(f"[{_ranges(unstable - set(folds))}]+")


def _ranges(codes) -> str:
    """The body of a character class of these code points."""
    spans: list[list[int]] = []
    for code in sorted(codes):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if a < b else "") for a, b in spans)


def _segment(segment: str) -> str:
    return _remembered(segment) if len(segment) <= 8 else unicodedata.normalize("NFC", segment)


@lru_cache(maxsize=50_000)
def _remembered(segment: str) -> str:
    return unicodedata.normalize("NFC", segment)


def canonical(text: str | None, confusables: str | None = None) -> str | None:
    """The consistent form of a text; null for null. `canonical(canonical(t)) == canonical(t)`.

    confusables: path of a public table of confusables, whose letters are added to `LOOKALIKES`."""
    if text is None:
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    foldable, folds, unstable = _tables(confusables)
    if foldable.search(text):
        # what shapes an emoji is kept: every second part
        parts = _SHAPING.split(text)
        text = "".join(part if n % 2 else part.translate(folds) for n, part in enumerate(parts)) if len(parts) > 1 else text.translate(folds)
    if unicodedata.is_normalized("NFC", text):
        return text
    out, done = [], 0
    for found in unstable.finditer(text):
        start = max(done, found.start() - 1)  # the starter before it may be joined by a mark
        out += (text[done:start], _segment(text[start : found.end()]))
        done = found.end()
    return "".join([*out, text[done:]])


def canonical_column(df: DataFrame, column: str | Column, confusables: str | None = None) -> Column:
    """`canonical` as a column expression, in Arrow batches."""
    ensure_shipped(df.sparkSession)

    @F.pandas_udf(StringType())
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([canonical(t, confusables) for t in batch], dtype=object)

    return form(F.col(column).cast("string") if isinstance(column, str) else column)


def normalize_documents(df: DataFrame, text: str = "text", alias: str = "canonical_text", confusables: str | None = None) -> DataFrame:
    """`df` with the consistent form of `text` as a further column. Narrow. Null stays null."""
    return df.withColumn(alias, canonical_column(df, text, confusables))


def _printed(df: DataFrame, key: str, text: str, confusables: str | None) -> DataFrame:
    """`(k, f1, f2, t1, t2)`: fingerprints of the form and of the string of each text with a visible character."""
    printed = (
        df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
        .filter(F.col("k").isNotNull() & F.col("t").isNotNull())
        .withColumn("f", canonical_column(df, F.col("t"), confusables))
        .filter(F.col("f").rlike(r"[^\s\x{3000}]"))
        .select(
            "k",
            F.xxhash64("f").alias("f1"),
            F.xxhash64("f", F.lit(7)).alias("f2"),
            F.xxhash64("t").alias("t1"),
            F.xxhash64("t", F.lit(7)).alias("t2"),
        )
    )
    return materialise(printed, "lookalike")


def lookalike_classes(df: DataFrame, key: str = "doc_id", text: str = "text", confusables: str | None = None) -> DataFrame:
    """`(key, class_id, spellings)` of each text with a visible character: the least key of those that look the same,
    and how many different strings there are among them. One row a key, however large a class is."""
    printed = _printed(df, key, text, confusables).distinct()
    classes = printed.groupBy("f1", "f2").agg(F.min("k").alias("class_id"), F.count_distinct("t1", "t2").alias("spellings"))
    return printed.join(classes, ["f1", "f2"]).groupBy("k").agg(F.min("class_id").alias("class_id"), F.max("spellings").alias("spellings")).withColumnRenamed("k", key)


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", confusables: str | None = None) -> DataFrame:
    """Pairs `(key_a, key_b)`, key_a < key_b, of texts that look the same but aren't the same string.

    Rows with null texts or keys, and texts without a visible character, are in no pair; exact copies are
    no pair. Only 128-bit fingerprints of the form and of the string are shuffled. A class of one string
    only is dropped after a map-side aggregate, so that exact copies, however many, are never paired;
    what remains is paired by class, and one pair comes out for each of the pairs asked for.
    `lookalike_classes` gives the same as one row a text.
    """
    printed = _printed(df, key, text, confusables)
    varied = (
        printed.groupBy("f1", "f2")
        .agg(F.min(F.struct("t1", "t2")).alias("least"), F.max(F.struct("t1", "t2")).alias("most"))
        .filter(F.col("least") != F.col("most"))
        .select("f1", "f2")
    )
    members = printed.join(varied, ["f1", "f2"], "left_semi").distinct()
    other = members.select("f1", "f2", *(F.col(c).alias(f"{c}_b") for c in ("k", "t1", "t2")))
    return (
        members.join(other, ["f1", "f2"])
        .filter((F.col("k") < F.col("k_b")) & ((F.col("t1") != F.col("t1_b")) | (F.col("t2") != F.col("t2_b"))))
        .select(F.col("k").alias(f"{key}_a"), F.col("k_b").alias(f"{key}_b"))
        .distinct()
    )

