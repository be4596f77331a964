"""Exact byte-pair encoding in time linear in the text, with a public tokenizer's files.

Method: per-prefix dynamic programming. For a pre-token of n bytes the table `last[i]` holds the last
token of the encoding of its first i bytes. That token is unique: among the vocabulary entries that end
at i (found by a suffix automaton, all positions in one pass) it is the only one that is *compatible*
with `last[i - len]`, two tokens being compatible if encoding their concatenation gives the two back.
Following back-pointers from n emits the ids. No priority queue and no rescans: a pre-token of a
million bytes costs a million steps.

Pre-tokens repeat heavily in natural text, so each worker keeps a bounded memo of encoded pre-tokens.
Null and empty texts have no tokens. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import ahocorasick
import regex

#: Default vocabulary; a path may be given instead, the file is never copied.
DEFAULT_VOCABULARY = "byte_bpe_50k.json"
DEFAULT_FOLDER = "/opt/tokenizers"

#: Pre-tokenisation of byte-level BPE vocabularies of this family (fixed values of the public format).
_PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same on ASCII text, for the faster engine of the standard library.
_ASCII_PATTERN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
)
#: Runs without white space, each with the one blank before it, and the white space between them. No
#: pre-token crosses the seams of these units, so whole units can be remembered.
_UNITS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space to `re` but not to the tokenizer's pattern.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_MEMO_LIMIT = 200_000
_MEMO_KEY_LIMIT = 48


def pretokens(text: str) -> list[str]:
    """The pre-tokens of `text`, in order; their concatenation is `text`."""
    return (_ASCII_PATTERN if text.isascii() else _PATTERN).findall(text)


def units(text: str) -> list[str]:
    """A coarser cutting of `text` of which every pre-token lies in one unit."""
    return _UNITS.findall(text) if not _ODD_SPACE.search(text) else pretokens(text)


def resolve(vocabulary: str) -> str:
    """The path of a vocabulary file given by path or by name in the default folder."""
    return vocabulary if os.path.sep in vocabulary else os.path.join(DEFAULT_FOLDER, vocabulary)


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the JSON file, to the byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + n): b for n, b in enumerate(moved)}


class _Memo(dict):
    """Encodings by pre-token; missing ones are computed and, if short, kept."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str):
        value = self.compute(key)
        if len(key) <= _MEMO_KEY_LIMIT:
            if len(self) >= _MEMO_LIMIT:
                self.clear()
            self[key] = value
        return value


class BpeEncoder:
    """Encoder over one vocabulary; use `encoder()` to share one in each worker."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        with open(resolve(vocabulary), encoding="utf-8") as file:
            model = json.load(file)["model"]
        symbols, vocab = _byte_symbols(), model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: rank of a token: 0 for bytes, else the position of the merge that makes it.
        self.rank, self.parts, self.joined = {}, {}, {}
        spelled: dict[str, int] = {}
        for symbol in symbols:
            spelled[symbol] = vocab[symbol]
            self.rank[vocab[symbol]] = 0
        for position, (left, right) in enumerate(merges, 1):
            token, a, b = vocab[left + right], vocab[left], vocab[right]
            spelled[left + right] = token
            self.rank.setdefault(token, position)
            self.parts.setdefault(token, (a, b))
            self.joined[a, b] = token
        self.bytes_of = {t: "".join(map(chr, map(symbols.__getitem__, s))) for s, t in spelled.items()}
        self.length = {t: len(b) for t, b in self.bytes_of.items()}
        self._automaton = None
        self._pairs: dict[tuple[int, int], bool] = {}
        self.ids = _Memo(self._encode)
        self.unit_ids = _Memo(self._encode_unit)
        self.unit_count = _Memo(lambda unit: len(self.unit_ids[unit]))

    @property
    def automaton(self):
        """Suffix automaton of the vocabulary: at each position it lists the tokens that end there."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for token, spelling in self.bytes_of.items():
                self._automaton.add_word(spelling, token)
            self._automaton.make_automaton()
        return self._automaton

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of the two tokens gives these two tokens."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= 4 * _MEMO_LIMIT:
                self._pairs.clear()
            known = self._pairs[left, right] = self._test_pair(left, right)
        return known

    def _test_pair(self, left: int, right: int) -> bool:
        # Undo the merges of both tokens, latest first. The seam would have been merged if, at some
        # moment, its two neighbours form a token whose merge comes before the one undone last: on
        # equal ranks the leftmost merge comes first.
        rank, parts, joined = self.rank, self.parts, self.joined
        bound_left = bound_right = 1 << 60  # ranks of the merges that consume each neighbour
        while True:
            across = joined.get((left, right))
            if across is not None:
                r = rank[across]
                if r < bound_left and r <= bound_right:
                    return False
            a, b = rank[left], rank[right]
            if not a and not b:
                return True
            if a > b or (a == b and a):
                bound_left, left = a, parts[left][1]
            else:
                bound_right, right = b, parts[right][0]

    def last_tokens(self, data: str) -> list[int]:
        """`last[i]`: last token of the encoding of the first i bytes (`data`: bytes as Latin-1)."""
        length, known, test = self.length, self._pairs.get, self.compatible
        last = [-1] * (len(data) + 1)
        for end, token in self.automaton.iter(data):
            end += 1
            if last[end] < 0:
                start = end - length[token]
                if not start:
                    last[end] = token
                elif (before := last[start]) >= 0:
                    fits = known((before, token))
                    if fits or fits is None and test(before, token):
                        last[end] = token
        return last

    def _encode(self, pretoken: str) -> tuple[int, ...]:
        data = pretoken.encode("utf-8", "surrogatepass").decode("latin-1")
        last = self.last_tokens(data)
        out, at = [], len(data)
        while at:
            token = last[at]
            out.append(token)
            at -= self.length[token]
        return tuple(reversed(out))

    def _encode_unit(self, unit: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.ids.__getitem__, pretokens(unit))))

    def encode(self, text: str | None) -> list[int]:
        """Ids of `text` without special tokens; empty for null and empty texts."""
        return list(chain.from_iterable(map(self.unit_ids.__getitem__, units(text)))) if text else []

    def count(self, text: str | None) -> int:
        """Number of tokens of `text`."""
        return sum(map(self.unit_count.__getitem__, units(text))) if text else 0


_encoders: dict[str, BpeEncoder] = {}


def encoder(vocabulary: str = DEFAULT_VOCABULARY) -> BpeEncoder:
    """The encoder of this process for `vocabulary`; built once per worker."""
    path = resolve(vocabulary)
    if path not in _encoders:
        _encoders[path] = BpeEncoder(path)
    return _encoders[path]
