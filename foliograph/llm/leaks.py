"""Problem 8: passages of held-out test items inside the corpus.

Method: every task indexes its documents in shards. A shard is a sequence of word ids with an FM-index over
it: the Burrows-Wheeler transform in a wavelet matrix, and suffix array entries sampled by text position. All
phrases of the test items (runs of ``min_words`` words) are searched backwards at once through the ranks;
the rows found are located by walking to the next sample, and overlapping spans of an item are merged.

Words that no item has end a run, and so do two words that never follow each other in an item: no phrase can
run across them, so only stretches that could hold a phrase are indexed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_words = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters or digits."""
    return _words(text.lower()) if text else []


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many symbols and positions at once."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.levels: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            self.levels.append(bit)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.concatenate((seq[~bit], seq[bit]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``at``, less a start that is the same for every position."""
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one = self.ones[level][at]
            at = np.where((symbol >> b) & 1, self.zeros[level] + one, at - one)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions, and where the walk down the levels ends for each."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for level in range(self.bits):
            bit = self.levels[level][at]
            one = self.ones[level][at]
            symbol = symbol << 1 | bit
            at = np.where(bit, self.zeros[level] + one, at - one)
        return symbol, at


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the length compared."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        if step < n:
            after[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FmIndex:
    """Exact occurrences of phrases in a sequence of positive word ids, 0 being the separator."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 8):
        order = suffix_array(seq)
        self.n = len(seq)
        bwt = seq[order - 1]
        self.tree = WaveletMatrix(bwt, sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma))))[:sigma]
        symbols = np.arange(sigma, dtype=np.int64)
        self.base = self.first - self.tree.rank(symbols, np.zeros(sigma, dtype=np.int64))
        self.marked = order % sample == 0
        self.sampled = order[self.marked]
        self.before_mark = np.concatenate(([0], np.cumsum(self.marked)))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases of one length (rows), those that occur, with the first and last row of the index for each."""
        alive = np.arange(len(phrases))
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k]
            base = self.base[symbol]
            low, high = base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)
            some = high > low
            alive, low, high = alive[some], low[some], high[some]
            if not len(alive):
                break
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence, by walking back to the next sampled one."""
        out = np.empty(len(rows), dtype=np.int64)
        todo, at = np.arange(len(rows)), rows
        steps = 0
        while len(todo):
            done = self.marked[at]
            out[todo[done]] = (self.sampled[self.before_mark[at[done]]] + steps) % self.n
            todo, at = todo[~done], at[~done]
            if len(todo):
                symbol, end = self.tree.access(at)
                at = self.base[symbol] + end
            steps += 1
        return out


class Phrases:
    """The phrases of a block of test items, with the words and word pairs they are made of."""

    def __init__(self, items: list[tuple[int, str | None]], min_words: int):
        self.size = min_words
        self.ids: dict[str, int] = {}
        rows: list[list[int]] = []
        owners: list[int] = []
        for item, text in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            for k in range(len(seq) - min_words + 1):
                rows.append(seq[k : k + min_words])
                owners.append(item)
        self.sigma = len(self.ids) + 1
        table = np.array(rows, dtype=np.int64).reshape(-1, min_words)
        self.rows, of = np.unique(table, axis=0, return_inverse=True) if rows else (table, np.zeros(0, dtype=np.int64))
        by = np.argsort(of, kind="stable")
        self.owners = np.array(owners, dtype=np.int64)[by]
        self.owner_start = np.searchsorted(of.ravel()[by], np.arange(len(self.rows) + 1))
        self.pairs = np.unique(self.rows[:, :-1] * self.sigma + self.rows[:, 1:])

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Begin and end of the stretches of a document that could hold a phrase."""
        if len(ids) < self.size or not len(self.pairs):
            return []
        pair = ids[:-1] * self.sigma + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        linked = (self.pairs[at] == pair) & (ids[:-1] > 0)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], linked.view(np.int8), [0]))))
        return [(a, b + 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a + 1 >= self.size]


class _Shard:
    """Stretches of documents until they are indexed together."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.clear()

    def clear(self) -> None:
        self.parts: list[np.ndarray] = []
        self.start: list[int] = []
        self.doc: list[object] = []
        self.offset: list[int] = []
        self.size = 1

    def add(self, doc: object, found: list[str]) -> None:
        get = self.phrases.ids.get
        ids = np.array([get(w, 0) for w in found], dtype=np.int64)
        for a, b in self.phrases.stretches(ids):
            self.parts += [ids[a:b], np.zeros(1, dtype=np.int64)]
            self.start.append(self.size)
            self.doc.append(doc)
            self.offset.append(a)
            self.size += b - a + 1

    def spans(self) -> list[tuple[object, int, int, int]]:
        """(document, item, first word, last word), overlapping spans of a document and item merged."""
        if not self.parts:
            return []
        seq = np.concatenate([np.zeros(1, dtype=np.int64), *self.parts])
        index = FmIndex(seq, self.phrases.sigma)
        hit, low, high = index.search(self.phrases.rows)
        count = high - low
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        at = index.locate(rows)
        phrase = np.repeat(hit, count)
        part = np.searchsorted(np.array(self.start), at, side="right") - 1
        first = at - np.array(self.start, dtype=np.int64)[part] + np.array(self.offset, dtype=np.int64)[part] if len(at) else at
        found = []
        for p, q, word in zip(phrase.tolist(), part.tolist(), first.tolist()):
            for item in self.phrases.owners[self.phrases.owner_start[p] : self.phrases.owner_start[p + 1]].tolist():
                found.append((q, self.doc[q], item, word))
        # Parts of one document stand in order, so sorting by part keeps a document together.
        merged: dict[tuple[object, int], list[list[int]]] = {}
        for _, doc, item, word in sorted(found, key=lambda x: (x[0], x[2], x[3])):
            spans = merged.setdefault((doc, item), [])
            if spans and word <= spans[-1][1] + 1:
                spans[-1][1] = max(spans[-1][1], word + self.phrases.size - 1)
            else:
                spans.append([word, word + self.phrases.size - 1])
        return [(doc, item, a, b) for (doc, item), spans in merged.items() for a, b in spans]


def _item_blocks(items: DataFrame, item_key: str, text: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of bounded size, so that what a task holds doesn't grow with their number."""
    block, size = [], 0
    for row in items.select(F.col(item_key), F.col(text)).filter(F.col(item_key).isNotNull()).toLocalIterator():
        if row[1]:
            block.append((row[0], row[1]))
            size += row[1].count(" ") + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_spans(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    min_words: int = 12,
    shard_words: int = 1_000_000,
    block_words: int = 500_000,
    blocks_at_once: int = 8,
) -> DataFrame:
    """(``doc_id``, ``item_id``, ``first_word``, ``last_word``): every span of a document that repeats an item.

    A span is a run of at least ``min_words`` words that stands in the item too; spans of one item that overlap
    or touch come out as one. Word numbers start at 0. Case and everything between words don't count. Null,
    empty and shorter texts give nothing; rows without a key are left out; repeated documents repeat their
    spans; an empty table on either side gives an empty result.

    No shuffle: a task indexes its own documents, ``shard_words`` words at a time. The items are the stated
    query set; they are sent to the tasks in blocks of ``block_words`` words. A scan of the corpus serves
    ``blocks_at_once`` blocks, which bounds what a task holds: items of up to 4 million words cost one scan, in which
    each document is split into words once.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {item_key} bigint, first_word bigint, last_word bigint"
    rows = docs.select(F.col(key), F.col(text)).filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def search(blocks: list[list[tuple[int, str]]]) -> DataFrame:
        shared = [spark.sparkContext.broadcast(block) for block in blocks]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards = [_Shard(Phrases(x.value, min_words)) for x in shared]

            def done() -> Iterator[pa.RecordBatch]:
                spans = [x for shard in shards for x in shard.spans()]
                for shard in shards:
                    shard.clear()
                if spans:
                    doc, item, a, b = zip(*spans)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, key_type), pa.array(item, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                        names=[key, item_key, "first_word", "last_word"],
                    )

            for batch in batches:
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = words(body)
                    if len(found) >= min_words:
                        for shard in shards:
                            shard.add(doc, found)
                        if sum(shard.size for shard in shards) >= shard_words:
                            yield from done()
            yield from done()

        return rows.mapInArrow(run, schema)

    blocks = _item_blocks(items, item_key, item_text, block_words)
    parts = [search(group) for group in iter(lambda: list(islice(blocks, blocks_at_once)), [])]
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", **options) -> DataFrame:
    """(``doc_id``, ``item_id``): each document with each item it shares a run of words with, once."""
    return leaked_spans(docs, items, key=key, item_key=item_key, **options).select(key, item_key).distinct()
