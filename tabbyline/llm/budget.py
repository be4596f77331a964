"""Problem 4: tokens per source, language, content type and host.

Method: a trie of the vocabulary with failure links and precomputed token emissions gives the
longest-match cutting of a word in one pass over its bytes: where the trie can't go on, the tokens to emit
for what it has read are looked up at the node, and the failure link leads on with the rest. That is exact
by itself for longest-match vocabularies (`MatchTrie`). The tokenizer of this project is byte-pair encoding,
of which longest match is mostly but not always the result. A sequence of tokens is the encoding if and
only if all its neighbours are compatible, so each cutting is tested for that, and the few words that fail
are encoded by the per-prefix tables of `bpe`. Counts are thus exact. Words repeat, so workers remember
them; totals are plain aggregates, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tabbyline.llm.bpe import DEFAULT_VOCABULARY, BpeEncoder, _Memo, encoder, pretokens, resolve, units
from tabbyline.session import ensure_shipped


class MatchTrie:
    """Longest-match cutting in time linear in the word.

    vocabulary: spelling to id. Every single symbol of a word must be in it. Failure links and emissions
    of a node are computed when it is first left without a match, and kept.
    """

    def __init__(self, vocabulary: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.token = [-1]
        self.parent = [(0, "")]
        for spelling, token in vocabulary.items():
            node = 0
            for symbol in spelling:
                child = self.next[node].get(symbol)
                if child is None:
                    child = len(self.next)
                    self.next[node][symbol] = child
                    self.next.append({})
                    self.token.append(-1)
                    self.parent.append((node, symbol))
                node = child
            self.token[node] = token
        self.failure: dict[int, tuple[int, tuple[int, ...]]] = {}

    def fail(self, node: int) -> tuple[int, tuple[int, ...]]:
        """Where to go on after reading this node's string without a longer match, and what to emit."""
        known = self.failure.get(node)
        if known is None:
            if self.token[node] >= 0:
                known = (0, (self.token[node],))
            else:
                parent, symbol = self.parent[node]
                at, emitted = self.fail(parent)
                while symbol not in self.next[at]:
                    if not at:
                        raise KeyError(symbol)
                    at, more = self.fail(at)
                    emitted += more
                known = (self.next[at][symbol], emitted)
            self.failure[node] = known
        return known

    def cut(self, word: str) -> list[int]:
        """Ids of the longest-match cutting of `word`."""
        node, out, step = 0, [], self.next
        for symbol in word:
            child = step[node].get(symbol)
            while child is None:
                if not node:
                    raise KeyError(symbol)
                node, emitted = self.fail(node)
                out += emitted
                child = step[node].get(symbol)
            node = child
        while node:
            node, emitted = self.fail(node)
            out += emitted
        return out


class TokenCounter:
    """Exact counts by longest match where it is the encoding, else by the encoder."""

    def __init__(self, enc: BpeEncoder):
        self.encoder = enc
        self.trie = MatchTrie({spelling: token for token, spelling in enc.bytes_of.items()})
        self.words = _Memo(self._word)
        self.units = _Memo(self._unit)

    def _word(self, word: str) -> int:
        tokens = self.trie.cut(word.encode("utf-8", "surrogatepass").decode("latin-1"))
        compatible = self.encoder.compatible
        if all(map(compatible, tokens, tokens[1:])):
            return len(tokens)
        return len(self.encoder.ids[word])

    def _unit(self, unit: str) -> int:
        return sum(map(self.words.__getitem__, pretokens(unit)))

    def count(self, text: str | None) -> int:
        return sum(map(self.units.__getitem__, units(text))) if text else 0


_counters: dict[str, TokenCounter] = {}


def counter(vocabulary: str = DEFAULT_VOCABULARY) -> TokenCounter:
    """The counter of this process for `vocabulary`; built once per worker."""
    path = resolve(vocabulary)
    if path not in _counters:
        _counters[path] = TokenCounter(encoder(path))
    return _counters[path]


def with_token_counts(
    df: DataFrame, columns: list[str | Column], text: str = "content", alias: str = "tokens", vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """The `columns` and the exact number of tokens of `text` (0 for null and empty texts). Narrow."""
    ensure_shipped(df.sparkSession)
    chosen = df.select(*columns, F.col(text).cast("string").alias("__text"))
    schema = StructType([*chosen.schema.fields[:-1], StructField(alias, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            counts = [count(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], schema.names)

    return chosen.mapInArrow(run, schema)


def once_per_id(df: DataFrame, key: str = "id") -> DataFrame:
    """One of the rows of each non-null key, the least by all columns (repeated rows are alike)."""
    rest = [c for c in df.columns if c != key]
    one = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("__one"))
    return one.select(key, *(F.col("__one")[c].alias(c) for c in rest))


def host_of(url: Column) -> Column:
    """The host of a url in lower case, without user, port or trailing dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


#: Other spellings of language codes (fixed values).
_LANGUAGES = {"eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "rus": "ru", "jpn": "ja", "jp": "ja"}


def language_of(code: Column) -> Column:
    """A language code as its first subtag in lower case, other spellings brought to two letters."""
    first = F.lower(F.regexp_extract(code, r"^\s*([A-Za-z]+)", 1))
    out = F
    for other, usual in _LANGUAGES.items():
        out = out.when(first == other, usual)
    return F.nullif(out.otherwise(first), F.lit(""))


def token_budget(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Chunks, tokens and stored counts by source, language, content type and host of `metadata.url`.

    Each id counts once. A null in any of the four is a slice of its own; languages are
    taken as in `language_of`. Null contents count no tokens.
    """
    columns = [
        F.col("id"),
        F.col("source"),
        language_of(F.col("lang")).alias("lang"),
        F.col("content_type"),
        host_of(F.col("metadata.url")).alias("host"),
        F.col("token_count").cast("bigint").alias("stored"),
    ]
    counted = once_per_id(with_token_counts(df, columns, "content", "tokens", vocabulary))
    return counted.groupBy("source", "lang", "content_type", "host").agg(
        F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.sum("stored").alias("stored_tokens")
    )


def miscounted(df: DataFrame, factor: float = 2.0, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Ids whose stored count is null, not positive, or off by more than `factor` either way.

    Null contents are no case. Of rows repeated under an id one is enough.
    """
    kept = df.filter(F.col("content").isNotNull() & F.col("id").isNotNull())
    counted = with_token_counts(kept, [F.col("id"), F.col("token_count").cast("bigint").alias("stored")], "content", "tokens", vocabulary)
    wrong = F.col("stored").isNull() | (F.col("stored") <= 0)
    wrong |= (F.col("stored") > factor * F.col("tokens")) | (F.col("stored") * factor < F.col("tokens"))
    return counted.filter(wrong).select("id").distinct()
