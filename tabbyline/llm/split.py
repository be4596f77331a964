"""Problem 1: cutting oversized texts at natural boundaries, with overlap.

Method: pointer doubling. Every boundary of a text (a seam of the tokenizer's pre-tokens) is joined to
the start of the piece after the one that starts there: the piece ends at the farthest legal natural
boundary, and the next one starts at the earliest natural boundary of at most `overlap` tokens before
that end, if the piece from there reaches beyond it. The table of successors is then squared again and again: after k rounds each text's first
2^k cuts are known at once, so all greedy cuts of all texts of a batch come out in a logarithmic
number of array operations, not by a walk along each text.

Costs are exact. Any run of consecutive tokens of a pre-token is the encoding of its own bytes (each two
neighbours are compatible), so besides the seams of pre-tokens those of tokens inside of a long one are
boundaries, where they are seams of characters. A piece ends in white space only inside of a run of it, where
the same holds. The tokens of a piece are thus the sum over its parts, and no limit is ever lowered to be safe.
Only where a part of several characters exceeds the limit by itself (a limit of a few tokens) it is cut into
characters, whose sums are estimates, and the pieces of that text are counted and mended one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tabbyline.llm.bpe import DEFAULT_VOCABULARY, BpeEncoder, encoder, pretokens, units
from tabbyline.llm.encode import slices
from tabbyline.session import ensure_shipped, materialise

PARAGRAPH, LINE, SENTENCE, WORD, ANY = 4, 3, 2, 1, 0
#: Units of more tokens than this, or than an eighth of the limit, are given boundaries inside.
_ATOM = 24
_NEWLINE = 10
#: Tables over code points up to the ideographic blank and marks.
_TABLE_SIZE = 0x10000


def _table(test) -> np.ndarray:
    return np.array([test(chr(code)) for code in range(_TABLE_SIZE)], bool)


_SPACE = _table(lambda ch: ch.isspace() and not "\x1c" <= ch <= "\x1f")  # as the tokenizer has it
_CLOSER = _table("\"'”’»)]」』".__contains__)
_SENTENCE_END = _table(".!?…。！？".__contains__)
_WIDE_END = _table("。！？".__contains__)


def levels(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of a text how natural a cut there is, and whether white space stands before and behind it.

    A cut falls before a run of white space: a paragraph if the run has two newlines, a line if it has one,
    a sentence if what stands before it is closed, else a word. Wide full stops need no white space."""
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _TABLE_SIZE - 1)
    n = len(codes)
    space = _SPACE[codes]
    level = np.zeros(n + 1, np.int8)
    before = np.concatenate([[False], space])  # the character before each place is white space
    start = np.flatnonzero(space & ~before[:n])
    end = np.flatnonzero(before & ~np.concatenate([space, [False]]))
    newlines = np.concatenate([[0], np.cumsum(codes == _NEWLINE)])
    lines = newlines[end] - newlines[start]
    last = np.maximum(start - 1, 0)
    for _ in range(3):
        last = np.where(_CLOSER[codes[last]] & (last > 0), last - 1, last)
    closed = _SENTENCE_END[codes[last]] & (start > 0)
    level[start] = np.where(lines > 1, PARAGRAPH, np.where(lines == 1, LINE, np.where(closed, SENTENCE, WORD)))
    after = np.flatnonzero(_WIDE_END[codes]) + 1
    for _ in range(2):
        inside = after < n
        after[inside] += _CLOSER[codes[after[inside]]]
    level[after] = np.maximum(level[after], SENTENCE)
    level[0] = level[n] = PARAGRAPH
    before[n] = False
    return level, before, np.concatenate([space, [False]])


def _parts(word: str, enc: BpeEncoder) -> list[tuple[str, int]]:
    """Consecutive parts `(text, tokens)` of a pre-token: cut at seams of its tokens that are seams of characters."""
    ids, sizes = enc.ids[word], enc.length
    if len(ids) < 2 or len(word) < 2:
        return [(word, len(ids))]
    if word.isascii():
        seams = list(accumulate(map(sizes.__getitem__, ids)))
    else:
        place = {0: 0} | {at: n for n, at in enumerate(accumulate(len(ch.encode("utf-8", "surrogatepass")) for ch in word), 1)}
        seams = [place.get(at, -1) for at in accumulate(map(sizes.__getitem__, ids))]
    out, start, tokens = [], 0, 0
    for end in seams:
        tokens += 1
        # not before a last apostrophe, which letters after it would turn into a contraction
        if end > start and (end == len(word) or word[end:] != "'"):
            out.append((word[start:end], tokens))
            start, tokens = end, 0
    return out


class Boundaries:
    """Boundaries of one text: character offsets, tokens before each, and their levels."""

    def __init__(self, text: str, enc: BpeEncoder, limit: int):
        # The seams of units are enough where units are small; a large one has those of its pre-tokens,
        # and a long pre-token those of its tokens.
        atom = max(1, min(_ATOM, limit // 8))
        words = units(text)
        counts = list(map(enc.unit_count.__getitem__, words))
        if max(counts, default=0) > atom:
            fine: list[tuple[str, int]] = []
            for unit, size in zip(words, counts):
                if size <= atom:
                    fine.append((unit, size))
                else:
                    for word in pretokens(unit):
                        n = len(enc.ids[word])
                        fine += _parts(word, enc) if n > atom else [(word, n)]
            words, counts = [w for w, _ in fine], [n for _, n in fine]
        offset = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        tokens = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
        level, behind_space, space = levels(text)
        keep = ~behind_space[offset]
        # a run of white space of many tokens can be cut inside
        kept = np.flatnonzero(keep)
        for n in np.flatnonzero((np.diff(tokens[kept]) > atom) & (np.diff(kept) > 1)):
            inside = slice(kept[n] + 1, kept[n + 1])
            keep[inside] = space[offset[inside]]
        offset, tokens = offset[keep], tokens[keep]
        #: whether sums over the boundaries are estimates
        self.estimated = bool(((np.diff(tokens) > limit) & (np.diff(offset) > 1)).any())
        if self.estimated:
            offset, tokens = _by_character(text, offset, tokens, enc, limit)
        self.offset, self.tokens = offset, tokens
        self.level = level[offset]


def _by_character(text: str, offset: np.ndarray, tokens: np.ndarray, enc: BpeEncoder, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries with each part of more than `limit` tokens cut into its characters."""
    places, sizes = [0], []
    for a, b, n in zip(offset[:-1].tolist(), offset[1:].tolist(), np.diff(tokens).tolist()):
        if n > limit and b - a > 1:
            places += range(a + 1, b + 1)
            sizes += map(enc.count, text[a:b])
        else:
            places.append(b)
            sizes.append(n)
    return np.array(places), np.concatenate([[0], np.cumsum(sizes)])


def _mended(text: str, spans: list[tuple[int, int, int]], enc: BpeEncoder, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces counted one by one: those over the limit are cut on, overlaps that are too large are left out."""
    out: list[tuple[int, int, int]] = []
    for a, b, _ in spans:
        if out and a < out[-1][1] and enc.count(text[a : out[-1][1]]) > overlap:
            a = out[-1][1]
        while a < b:
            low, high = a + 1, b  # the farthest end of a piece of at most `limit` tokens, one character at least
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if enc.count(text[a:middle]) <= limit else (low, middle - 1)
            out.append((a, low, enc.count(text[a:low])))
            a = low
    return out


def _last_at_level(level: np.ndarray, at_least: int) -> np.ndarray:
    """For each boundary the last one up to it whose level is `at_least`, or -1."""
    return np.maximum.accumulate(np.where(level >= at_least, np.arange(len(level)), -1))


def _next_at_level(level: np.ndarray, at_least: int) -> np.ndarray:
    """For each boundary the first one from it on whose level is `at_least`, or its number."""
    n = len(level)
    return np.minimum.accumulate(np.where(level >= at_least, np.arange(n), n)[::-1])[::-1]


def successors(
    tokens: np.ndarray, level: np.ndarray, final: np.ndarray, limit: int, overlap: int, fill: float
) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary of all texts: the end of the piece that starts there, and the start after it.

    tokens: increasing over all texts, a gap of more than any limit between texts. final: the last boundary
    of each boundary's text. A boundary of a higher level is preferred if the piece is filled to `fill` by it.
    The last piece's successor is its text's final boundary, which is its own successor.
    """
    here = np.arange(len(tokens))
    reach = np.minimum(np.searchsorted(tokens, tokens + limit, "right") - 1, final)
    end = np.where(reach == final, final, -1)
    for wanted in (PARAGRAPH, LINE, SENTENCE, WORD):
        candidate = _last_at_level(level, wanted)[reach]
        filled = tokens[np.maximum(candidate, 0)] - tokens >= limit * (fill if wanted > WORD else 0)
        end = np.where((end < 0) & (candidate > here) & filled, candidate, end)
    end = np.where(end < 0, np.maximum(reach, np.minimum(here + 1, final)), end)
    back = np.searchsorted(tokens, tokens[end] - overlap, "left")
    after = end.copy()
    for wanted in (WORD, SENTENCE):
        candidate = np.minimum(_next_at_level(level, wanted)[np.minimum(back, len(level) - 1)], len(level) - 1)
        advances = (candidate > here) & (candidate < end) & (end[candidate] > end)
        after = np.where(advances, candidate, after)
    return end, np.where(end == final, final, after)


def walk(after: np.ndarray, starts: np.ndarray, final: np.ndarray) -> np.ndarray:
    """Starts of all pieces of each text (rows; padded with the text's final boundary): the table of
    successors is squared until every text has reached its final boundary."""
    paths, jump = starts[:, None], after
    while (paths[:, -1] != final).any():
        paths = np.hstack([paths, jump[paths]])
        jump = jump[jump]
    return paths


def cut_texts(
    texts: list[str], enc: BpeEncoder, limit: int = 512, overlap: int = 50, fill: float = 0.5
) -> list[list[tuple[int, int, int]]]:
    """Spans `(start, end, tokens)` of the pieces of each text, each of more than `limit` tokens."""
    if not texts:
        return []
    marks = [Boundaries(t, enc, limit) for t in texts]
    sizes = np.array([len(m.offset) for m in marks])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    final = first + sizes - 1
    totals = np.array([m.tokens[-1] for m in marks])
    base = np.concatenate([[0], np.cumsum(totals + limit + 1)[:-1]])
    tokens = np.concatenate([m.tokens + b for m, b in zip(marks, base)])
    level = np.concatenate([m.level for m in marks])
    end, after = successors(tokens, level, np.repeat(final, sizes), limit, overlap, fill)
    paths = walk(after, first, final)
    out = []
    for k, mark in enumerate(marks):
        start = paths[k][paths[k] != final[k]]
        stop = end[start]
        spans = zip(mark.offset[start - first[k]].tolist(), mark.offset[stop - first[k]].tolist(), (tokens[stop] - tokens[start]).tolist())
        out.append(_mended(texts[k], list(spans), enc, limit, overlap) if mark.estimated else list(spans))
    return out


def split_spans(
    df: DataFrame,
    key: str = "id",
    text: str = "content",
    limit: int = 512,
    overlap: int = 50,
    fill: float = 0.5,
    vocabulary: str = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Pieces of each row's `text` as `(key, chunk_index, start, end, token_count)`, character offsets.

    Narrow; only the two columns are read. A text of at most `limit` tokens is one piece; null texts
    and texts of white space alone that aren't over the limit have none; rows repeated under one key are cut alike, once each.
    A character of more tokens than `limit` is a piece of its own.
    """
    if overlap >= limit:
        raise ValueError("overlap must be less than limit")
    ensure_shipped(df.sparkSession)
    schema = StructType(
        [StructField("k", df.schema[key].dataType)]
        + [StructField(n, IntegerType()) for n in ("chunk_index", "start", "end", "token_count")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole, 1, 4_000_000):
                texts = batch.column(1).to_pylist()
                row, spans, long = [], [], []
                for n, t in enumerate(texts):
                    if t:
                        count = enc.count(t)
                        if count > limit:
                            long.append(n)
                        elif not t.isspace():
                            row.append(n)
                            spans.append((0, 0, len(t), count))
                for n, pieces in zip(long, cut_texts([texts[n] for n in long], enc, limit, overlap, fill)):
                    row += [n] * len(pieces)
                    spans += [(i, *piece) for i, piece in enumerate(pieces)]
                keys = batch.column(0).take(pa.array(row, pa.int32()))
                table = np.array(spans, np.int32).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(table[:, c]) for c in range(4))], schema.names)

    out = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)
    return out.withColumnRenamed("k", key)


def split_documents(df: DataFrame, key: str = "id", text: str = "content", **options) -> DataFrame:
    """Pieces as `(key, chunk_index, token_count, text)`; options as in `split_spans`.

    Rows repeated under one key count once: the first of them by text is cut. Which keys are repeated is found
    from the keys alone; the texts of all others stay where they are, and the planner may broadcast the keys while
    they are few.
    """
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    repeated = materialise(rows.groupBy("k").count().filter("count > 1").select("k"), "repeated-keys")
    chosen = rows.join(repeated, "k", "left_semi").groupBy("k").agg(F.min("t").alias("t"))
    one = rows.join(repeated, "k", "left_anti").unionByName(chosen)
    ensure_shipped(df.sparkSession)
    limit, overlap, fill = (options.get(n, d) for n, d in (("limit", 512), ("overlap", 50), ("fill", 0.5)))
    vocabulary = options.get("vocabulary", DEFAULT_VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole, 1, 4_000_000):
                texts = batch.column(1).to_pylist()
                counts = [enc.count(t) if t else 0 for t in texts]
                long = [n for n, c in enumerate(counts) if c > limit]
                cuts = dict(zip(long, cut_texts([texts[n] for n in long], enc, limit, overlap, fill)))
                row, index, tokens, piece = [], [], [], []
                for n, t in enumerate(texts):
                    for i, (a, b, c) in enumerate(cuts.get(n, [(0, len(t), counts[n])] if counts[n] and not t.isspace() else [])):
                        row.append(n)
                        index.append(i)
                        tokens.append(c)
                        piece.append(t[a:b])
                keys = batch.column(0).take(pa.array(row, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(index, pa.int32()), pa.array(tokens, pa.int32()), pa.array(piece, pa.string())],
                    ["k", "chunk_index", "token_count", "t"],
                )

    schema = StructType(
        [
            StructField("k", df.schema[key].dataType),
            StructField("chunk_index", IntegerType()),
            StructField("token_count", IntegerType()),
            StructField("t", df.select(F.col(text).cast("string")).schema[0].dataType),
        ]
    )
    return one.mapInArrow(run, schema).withColumnsRenamed({"k": key, "t": text})


def oversized(df: DataFrame, key: str = "id", text: str = "content", **options) -> DataFrame:
    """Keys of the texts that were cut, each once."""
    spans = split_spans(df, key, text, **options)
    return spans.filter((F.col("chunk_index") == 1) & F.col(key).isNotNull()).select(key).distinct()
