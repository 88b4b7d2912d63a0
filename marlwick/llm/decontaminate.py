"""Benchmark decontamination by greedy string tiling.

Documents and test items that share a seed (MIN_MATCH words in a row) are tiled: the longest common runs of words that are not
yet covered are marked again and again, longest first, until no run of MIN_MATCH words is left.  A search length is tried by
running Karp-Rabin: the hashes of all unmarked windows of that length, each rolled on from its neighbour by prefix sums, are
matched between item and document; the length is halved or raised until the longest that matches is found, and its words are
compared before they are marked.  The share of the item that tiles cover, in whatever order its passages come, is its
coverage; at THRESHOLD or more the document is contaminated.

Defined cases: words are lower-cased runs between white space.  An item of fewer than MIN_MATCH words is matched as one run of
all its words.  Items and documents with null or empty text match nothing.  Repeated item rows of one item_id and text count
once; one item_id with several texts takes its best coverage.  Null ids are carried along as null.  Columns other than
doc_id, item_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ngram_hashes, slices, words_of

MIN_MATCH, THRESHOLD = 5, 0.5
#: Words of test items that one pass over the documents carries (some 100 MB a worker at most); more items take more passes.
PASS_WORDS = 1_000_000


class _Rolling:
    """Karp-Rabin hashes of the windows of a sequence of numbers, of any length, and which of them are unmarked."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        power, self.back = np.full(n + 1, self.BASE, np.uint64), np.full(n + 1, pow(self.BASE, -1, 1 << 64), np.uint64)
        power[0] = self.back[0] = 1
        power, self.back = np.cumprod(power, dtype=np.uint64), np.cumprod(self.back, dtype=np.uint64)
        value = (numbers + 2).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[:n], dtype=np.uint64)])
        self.marked = np.zeros(n, bool)
        self.marked[numbers < 0] = True
        self.settle()

    def settle(self) -> None:
        self.taken = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.marked)])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of each unmarked window of k numbers."""
        at = np.flatnonzero(self.taken[k:] == self.taken[:-k])
        return at, (self.sums[at + k] - self.sums[at]) * self.back[at]


def tiles(doc: list[int], item: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (doc start, item start, length) of non-overlapping maximal matches, longest first; of equal
    length, the first in the document, then in the item.  -1 in doc is a word that no item has."""
    d, w = np.array(doc, np.int64), np.array(item, np.int64)
    out: list[tuple[int, int, int]] = []
    most = min(len(d), len(w))
    if most < min_match:
        return out
    left, right = _Rolling(d), _Rolling(w)
    while most >= min_match:
        # a common window of some length has common windows of all lesser ones, so the longest is found by halving
        low, high = min_match - 1, most
        while low < high:
            k = (low + high + 1) // 2
            if np.isin(left.windows(k)[1], right.windows(k)[1]).any():
                low = k
            else:
                high = k - 1
        if low < min_match:
            return out
        (i, h), (j, g) = left.windows(low), right.windows(low)
        free: dict[int, list[int]] = {}
        for place, value in zip(j[::-1].tolist(), g[::-1].tolist()):
            free.setdefault(value, []).append(place)  # the first is the last of its list
        match, end, more = np.isin(h, g), 0, False
        for a, value in zip(i[match].tolist(), h[match].tolist()):
            if a < end:
                continue
            places = free[value]
            while places and right.marked[places[-1] : places[-1] + low].any():
                places.pop()
            if places and (d[a : a + low] == w[places[-1] : places[-1] + low]).all():
                b, end, more = places.pop(), a + low, True
                left.marked[a:end] = right.marked[b : b + low] = True
                out.append((a, b, low))
        left.settle(), right.settle()
        most = low if more else low - 1  # else hashes agreed and words did not
    return out


class Index:
    """Test items as word numbers, with the hashes of their seeds.  Built once a worker from the broadcast texts."""

    def __init__(self, items: list[tuple[int | None, str]], min_match: int):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int | None, list[int], int]] = []
        grams: dict[int, dict[int, set[int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            k = min(min_match, len(numbers))
            for h in self._hashes(np.array(numbers), k).tolist():
                grams.setdefault(k, {}).setdefault(h, set()).add(len(self.items))
            self.items.append((item_id, numbers, k))
        # one table of seeds for each seed length in use: min_match, and the lengths of the items shorter than that
        self.seeds = {k: (np.array(sorted(g), np.uint64), g) for k, g in grams.items()}

    @staticmethod
    def _hashes(numbers: np.ndarray, k: int) -> np.ndarray:
        return ngram_hashes((numbers + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), k)

    def candidates(self, numbers: np.ndarray) -> dict[int, np.ndarray]:
        """Item -> the places in the document where a seed of it starts."""
        found: dict[int, list[int]] = {}
        known = numbers >= 0
        for k, (table, owners) in self.seeds.items():
            if len(numbers) < k:
                continue
            # only where k words in a row are known to some item
            run = np.cumsum(np.concatenate([[0], known]))
            at = np.flatnonzero(run[k:] - run[:-k] == k)
            if not len(at):
                continue
            h = self._hashes(numbers, k)[at]
            place = np.minimum(np.searchsorted(table, h), len(table) - 1)
            for i in np.flatnonzero(table[place] == h):
                for x in owners[int(h[i])]:
                    found.setdefault(x, []).append(int(at[i]))
        return found


def neighbourhood(numbers: np.ndarray, starts: list[int], k: int) -> list[int]:
    """The parts of a document that can hold tiles of an item: its seeds, with a -1 wherever something else lies between."""
    out: list[int] = []
    end = 0
    for s in starts:
        if out and s > end:
            out.append(-1)
        out += numbers[max(s, end) : s + k].tolist()
        end = s + k
    return out


def _passes(items: DataFrame) -> list[list[tuple[int | None, str]]]:
    """The test items, in passes of PASS_WORDS.  They stream to the driver a part at a time; what one broadcast carries is
    bounded, and all items get their pass."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    passes, held, size = [], [], 0
    for r in rows.toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(r.text.split())
        if size >= PASS_WORDS:
            passes.append(held)
            held, size = [], 0
    return [*passes, held]


def _tiled(index: Index, text: str | None, threshold: float) -> Iterator[tuple[int | None, int, int, int]]:
    """(item_id, tiles, matched words, words) of each item that a text holds at the threshold."""
    words = words_of(text)
    if words:
        number = index.vocabulary.get
        numbers = np.array([number(w, -1) for w in words], np.int64)
        for x, starts in index.candidates(numbers).items():
            item_id, item, k = index.items[x]
            got = tiles(neighbourhood(numbers, sorted(starts), k), item, k)
            matched = sum(length for _, _, length in got)
            if matched >= threshold * len(item):
                yield item_id, len(got), matched, len(item)


def contaminated(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, item_id, n_tiles, matched_words, item_words, coverage) for each document and item at the threshold."""
    found = None
    texts = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    schema = "doc_id long, item_id long, n_tiles int, matched_words int, item_words int, coverage double"
    for chunk in _passes(items):
        shared = docs.sparkSession.sparkContext.broadcast(chunk)

        def tile(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, names = Index(shared.value, min_match), schema.replace(",", "").split()[::2]
            for part in slices(batches):
                out = [(doc_id, *got, got[2] / got[3]) for doc_id, text in zip(part["doc_id"], part["text"]) for got in _tiled(index, text, threshold)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

        one = texts.mapInArrow(tile, schema)
        found = one if found is None else found.union(one)
    best = F.max(F.struct("coverage", "matched_words", "n_tiles", "item_words")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.n_tiles", "m.matched_words", "m.item_words", "m.coverage")


def drop_contaminated(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those whose text holds a test item.  Each row is judged by itself, also without doc_id."""
    place = docs.columns.index("text")
    for chunk in _passes(items):
        shared = docs.sparkSession.sparkContext.broadcast(chunk)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, min_match)
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    yield part.filter(pa.array([next(_tiled(index, text, threshold), None) is None for text in part.column(place).to_pylist()], pa.bool_()))

        docs = lean(docs).mapInArrow(clean, docs.schema)
    return docs
