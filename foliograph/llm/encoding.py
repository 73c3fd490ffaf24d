"""Problem 7: ids of a whole corpus by a public byte-level BPE vocabulary.

Method: dynamic programming over prefixes. For every prefix of a piece there is exactly one token the
merges can end it with. An automaton over the vocabulary lists the tokens that end at a position; the one
whose left neighbour (the stored last token of the remaining prefix) is compatible with it is kept, and the
ids are read by following the back-pointers. Two tokens are compatible if no merge across their border would
have happened before the merges that built them.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how text is split before the merges, the pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same split for the standard library, which is several times faster. Its classes are those of the pattern
#: as long as a text has none of the characters that ``_UNLIKE`` lists.
_SIMPLE = (
    r""" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"""
)
_SIMPLE_ASCII = (
    r""" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
)

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a rank file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for text, rank in pairs:
        tokens[int(rank)] = base64.b64decode(text)
    return tokens


class PrefixEncoder:
    """Exact BPE ids by one pass over the prefixes of a piece."""

    def __init__(self, tokens: list[bytes], cache_entries: int = 500_000):
        self.lengths = [len(t) for t in tokens]
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.merged: dict[tuple[int, int], int] = {}
        self.left = list(range(len(tokens)))
        self.right = list(range(len(tokens)))
        self._split_all(tokens)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.cache_entries = cache_entries
        self.known_pairs: dict[int, bool] = {}
        self.pieces = _Pieces(self.piece)

    def _split_all(self, tokens: list[bytes]) -> None:
        """The two tokens each token is merged from: the only split that is compatible before its own merge."""
        for i, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = self.whole.get(t[:cut]), self.whole.get(t[cut:])
                if a is not None and b is not None and a < i and b < i and self.compatible(a, b):
                    self.left[i], self.right[i] = a, b
                    self.merged[a, b] = i
                    break

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side.

        The later of the two merges is undone, again and again, down the border. A merge across the border
        that comes before the merge just undone would have been done first, so the pair can't stand.
        """
        undone = len(self.left)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < undone:
                return False
            a_whole, b_whole = self.right[a] == a, self.left[b] == b
            if a_whole and b_whole:
                return True
            if b_whole or (not a_whole and a > b):
                undone, a = a, self.right[a]
            else:
                # A tie in rank goes to the merge further left, which is the one across the border.
                undone, b = b + 1, self.left[b]

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece of the split text."""
        data = text.encode("utf-8", "surrogatepass")
        known = self.whole.get(data)
        if known is not None:
            return (known,)
        last = [-1] * (len(data) + 1)
        lengths, known_pairs = self.lengths, self.known_pairs
        for end, token in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - lengths[token]
            if start:
                before = last[start]
                if before < 0:
                    continue
                pair = before << 32 | token
                fits = known_pairs.get(pair)
                if fits is None:
                    fits = known_pairs[pair] = self.compatible(before, token)
                if not fits:
                    continue
            last[end] = token
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= lengths[last[at]]
        return tuple(reversed(ids))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one."""
        return list(chain.from_iterable(map(self.pieces.__getitem__, split(text)))) if text else []

    def encode_batch(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of many texts as one Arrow list column."""
        values: list[int] = []
        offsets = np.zeros(len(texts) + 1, dtype=np.int32)
        lookup = self.pieces.__getitem__
        for k, text in enumerate(texts):
            if text:
                values.extend(chain.from_iterable(map(lookup, split(text))))
            offsets[k + 1] = len(values)
        if len(self.pieces) > self.cache_entries:
            self.pieces.clear()
        if len(self.known_pairs) > self.cache_entries:
            self.known_pairs.clear()
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(values, dtype=np.int32)))


class _Pieces(dict):
    """Ids of the pieces met so far."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        self[piece] = ids = self.encode(piece)
        return ids


def _unlike() -> str:
    """A class of the characters that the two split patterns sort differently: numbers that aren't digits, separators."""
    odd = [c for c in range(0x110000) if unicodedata.category(chr(c)) in ("No", "Nl")] + list(range(0x1C, 0x20))
    runs: list[list[int]] = []
    for c in sorted(odd):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


_split_any = regex.compile(PATTERN).findall
_split_simple = re.compile(_SIMPLE).findall
_split_ascii = re.compile(_SIMPLE_ASCII, re.ASCII).findall
_has_unlike = re.compile(_unlike()).search


def split(text: str) -> list[str]:
    """Pieces of a text, within which merges happen."""
    if text.isascii():
        return _split_ascii(text)
    return _split_any(text) if _has_unlike(text) else _split_simple(text)


_encoders: dict[int, PrefixEncoder] = {}


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array of int) for every row of ``docs``.

    Null and empty texts have an empty list of ids. Strings that look like special tokens are ordinary text.
    Repeated rows come out as often as they come in. A narrow transformation: no shuffle; what is broadcast is
    the vocabulary, whose size is fixed by its file and doesn't depend on the corpus.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    token = hash((vocabulary, len(shared.value)))
    kind = docs.schema[key].dataType
    schema = f"{key} {kind.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(token)
        if encoder is None:
            encoder = _encoders[token] = PrefixEncoder(shared.value)
        for batch in batches:
            ids = encoder.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
