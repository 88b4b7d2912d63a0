"""Suffix-array deduplication: passages of MIN_WORDS words or more that stand in more than one document.

A suffix is a place in a document with at least MIN_WORDS words ahead.  Two suffixes with that many words in common have the
same least GRAM-gram among those words, so suffixes are spread over the cluster by that least gram, and only the places whose
gram occurs in two documents are looked at again.  There, the suffixes of each gram are sorted by a mergesort that compares by
prefix polynomial hashes: binary search over the hashes finds the common extension of two suffixes in a logarithmic number of
steps, and the word after it decides.  The common extensions of neighbours in that order, after their words are compared one
by one, which catches collisions of the hashes, cut the order into runs of suffixes with MIN_WORDS words in common; a run
that has two documents is a repeated passage.

The grams that two documents have are sent to all workers while they are few (EXACT); beyond that as a Bloom filter of a fixed
size.  What it lets pass in vain is sorted too and found to repeat nothing, so texts are never shuffled, and nothing is lost.
Grams of more than HOT documents (a licence that millions carry) don't go to one task to be sorted: their suffixes are told
apart by the hash of their first MIN_WORDS words, which is aggregated before it is shuffled.

A word is repeated if it lies in MIN_WORDS words in a row that also stand in a document of another doc_id; the result is
the maximal runs of such words.  Every such run is found; the only approximation is that words are told apart by 64-bit hashes.

Defined cases: words are runs between white space, in lower case.  Null texts, texts of fewer than MIN_WORDS words and rows
without doc_id have no passages.  Repetition within one document, or among rows of one doc_id, does not count; for each of
those rows the same places are found, and given once.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hashed, lean, mixed, ngram_hashes, shuffle_width, slices, word_hashes, words_of

MIN_WORDS = 50
#: Shared grams that are sent to all workers as they are (32 MB); more become a Bloom filter of BLOOM bytes.
EXACT, BLOOM = 4_000_000, 64 << 20
#: Documents of a gram, beyond which its suffixes aren't sorted in one task.
HOT = 100_000
#: Words whose suffixes a task sorts at once, those of a gram together.
SORTED = 1 << 18


class Grams:
    """A set of grams: sorted, or a Bloom filter that may hold more."""

    def __init__(self, grams: np.ndarray | None = None, size: int = 0):
        self.sorted, self.bits, self.size = grams, np.zeros(size, np.uint8) if grams is None else None, size

    def _places(self, g: np.ndarray) -> Iterator[np.ndarray]:
        h = mixed(g)
        for _ in range(3):
            yield h % np.uint64(self.size * 8)
            h = mixed(h + np.uint64(0x9E3779B97F4A7C15))

    def add(self, g: np.ndarray) -> None:
        for p in self._places(g):
            np.bitwise_or.at(self.bits, p >> np.uint64(3), (np.uint64(1) << (p & np.uint64(7))).astype(np.uint8))

    def has(self, g: np.ndarray) -> np.ndarray:
        if self.sorted is not None:
            return self.sorted[np.minimum(np.searchsorted(self.sorted, g), len(self.sorted) - 1)] == g if len(self.sorted) else np.zeros(len(g), bool)
        found = np.ones(len(g), bool)
        for p in self._places(g):
            found &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def least_grams(h: np.ndarray, size: int, gram: int) -> np.ndarray:
    """For every suffix of at least size words, the least hash of the grams within its first size words."""
    g, span = ngram_hashes(h, gram), size - gram + 1
    have = 1
    while have * 2 <= span:
        g, have = np.minimum(g[:-have], g[have:]), have * 2
    return np.minimum(g[: len(g) - (span - have)], g[span - have :]) if span > have else g


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1]))


class Suffixes:
    """Suffixes of a sequence of words, compared by prefix polynomial hashes modulo 2 ** 64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = words
        power = np.full(n + 1, self.BASE, np.uint64)
        power[0] = 1
        self.back = np.full(n + 1, pow(self.BASE, -1, 1 << 64), np.uint64)
        self.back[0] = 1
        power, self.back = np.cumprod(power, dtype=np.uint64), np.cumprod(self.back, dtype=np.uint64)
        value = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
        self.sums = np.append(np.uint64(0), np.cumsum(value * power[:n], dtype=np.uint64))

    def hash(self, at: np.ndarray, length) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.back[at]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, least: int) -> np.ndarray:
        """Length of the common extension of suffixes a and b, known to be at least least and at most most: binary search."""
        low, high = np.full(len(a), least, np.int64), most.copy()
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = np.where(open_, (low + high + 1) // 2, low)
            same = self.hash(a, mid) == self.hash(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))

    def less(self, a: np.ndarray, b: np.ndarray, room_a: np.ndarray, room_b: np.ndarray, least: int) -> np.ndarray:
        """Whether suffix a, of room_a words, sorts before b; where one is the other's start, the shorter first."""
        most = np.minimum(room_a, room_b)
        k = self.common(a, b, most, least)
        end = len(self.words) - 1
        return np.where(k < most, self.words[np.minimum(a + k, end)] < self.words[np.minimum(b + k, end)], room_a < room_b)

    def sort(self, at: np.ndarray, room: np.ndarray, group: np.ndarray, least: int) -> np.ndarray:
        """Order of the suffixes at the given places, a group after another (group is sorted; its members share least words):
        bottom-up mergesort, in which each suffix finds its place in the neighbouring run by binary search."""
        order, first = np.arange(len(at)), np.searchsorted(group, group)
        size = np.searchsorted(group, group, side="right") - first
        width = 1
        while width < (size.max() if len(size) else 0):
            place = np.arange(len(at)) - first
            own = place // width  # number of the run within the group
            other = first + (own ^ 1) * width
            end = np.minimum(other + width, first + size)
            low, high = np.minimum(other, end), end.copy()
            left = own % 2 == 0
            mine = order
            while (live := low < high).any():
                i = np.flatnonzero(live)
                mid = (low[i] + high[i]) // 2
                x, y = mine[i], mine[mid]
                # equal suffixes of the left run stay before those of the right
                before = np.empty(len(i), bool)
                l, r = left[i], ~left[i]
                before[l] = self.less(at[y[l]], at[x[l]], room[y[l]], room[x[l]], least)
                before[r] = ~self.less(at[x[r]], at[y[r]], room[x[r]], room[y[r]], least)
                low[i], high[i] = np.where(before, mid + 1, low[i]), np.where(before, high[i], mid)
            target = np.where(left, np.arange(len(at)) + (low - np.minimum(other, end)), np.arange(len(at)) - width + (low - other))
            moved = np.empty_like(order)
            moved[target] = mine
            order, width = moved, width * 2
        return order

    def verified(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Common lengths by comparing the words themselves, as far as length."""
        if not len(a):
            return length
        out = np.empty(len(a), np.int64)
        for at in range(0, len(a), 20_000):
            x, y, n = a[at : at + 20_000], b[at : at + 20_000], length[at : at + 20_000]
            starts = np.append(0, np.cumsum(n)[:-1])
            step = np.arange(n.sum()) - np.repeat(starts, n)
            wrong = np.where(self.words[np.repeat(x, n) + step] != self.words[np.repeat(y, n) + step], step, 1 << 40)
            out[at : at + 20_000] = np.minimum(n, np.minimum.reduceat(wrong, starts))
        return out


def repeated(words: np.ndarray, at: np.ndarray, room: np.ndarray, doc: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes at the given places: whether the first size words of each stand in another document too, and the least
    document in which they stand.  Suffixes with so many words in common are of one group."""
    s = Suffixes(words)
    by = np.argsort(group, kind="stable")
    sorted_ = by[s.sort(at[by], room[by], group[by], 0)]
    a, b = sorted_[:-1], sorted_[1:]
    together = group[a] == group[b]
    length = np.where(together, np.minimum(room[a], room[b]), 0)
    length[together] = s.common(at[a[together]], at[b[together]], length[together], 0)
    # no more than the first size words of neighbours decide
    long = length >= size
    length[long] = s.verified(at[a[long]], at[b[long]], np.full(long.sum(), size))
    # the order is cut wherever neighbours have fewer than size words in common
    part = np.append(0, np.cumsum(length < size))
    starts = runs(part)
    low, high = np.minimum.reduceat(doc[sorted_], starts), np.maximum.reduceat(doc[sorted_], starts)
    flag, least = np.zeros(len(at), bool), doc.copy()
    flag[sorted_] = (low < high)[part]
    least[sorted_] = low[part]
    return flag, least


def _texts(docs: DataFrame) -> DataFrame:
    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")


def repeated_passages(docs: DataFrame, size: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, start_word, end_word, first_doc_id): words start_word up to, not with, end_word (from 0) are a passage
    that stands in other documents too; first_doc_id is the least doc_id that has some of it."""
    if size < 4:
        raise ValueError("a passage has at least 4 words")
    width, gram = shuffle_width(docs), max(2, size * 2 // 5)
    # sorting holds a partition's words at once, so there are more and smaller of those
    fine = 4 * width

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pid, grams, lows, highs, times): the least grams, the least and greatest document that has each, and how many have."""
        memo, held, ids, seen = word_hashes(150_000), [], [], 0

        def flush():
            g, d = np.concatenate(held), np.repeat(np.array(ids, np.int64), [len(x) for x in held])
            order = np.lexsort((d, g))
            g, d = g[order], d[order]
            first = runs(g)
            last = np.append(first[1:], len(g)) - 1
            g, low, high, times = g[first], d[first], d[last], (last - first + 1).astype(np.int64)
            pid = (g % np.uint64(width)).astype(np.int64)
            order = np.argsort(pid, kind="stable")
            cuts = np.searchsorted(pid[order], np.arange(width + 1))
            some = [p for p in range(width) if cuts[p + 1] > cuts[p]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([x[order][cuts[p] : cuts[p + 1]].tobytes() for p in some], pa.binary()) for x in (g, low, high, times))], ["pid", "grams", "lows", "highs", "times"])

        for part in slices(batches):
            for doc, text in zip(part["doc_id"], part["text"]):
                w = words_of(text)
                if len(w) >= size:
                    g = least_grams(hashed(w, memo), size, gram)
                    held.append(np.unique(g[runs(g)])), ids.append(doc)
                    seen += len(held[-1])
            if seen > 1_000_000:
                yield flush()
                held, ids, seen = [], [], 0
        if held:
            yield flush()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(grams, hot, n): grams of this partition that two documents have, packed by the million, and the hot ones of them."""
        columns: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in (np.uint64, np.int64, np.int64, np.int64)]
        for b in batches:
            for i, into in enumerate(columns, 1):
                into += [np.frombuffer(x, into[0].dtype) for x in b.column(i).to_pylist()]
        g, low, high, times = map(np.concatenate, columns)
        if not len(g):
            return
        order = np.argsort(g, kind="stable")
        g = g[order]
        first = runs(g)
        low, high, times = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), np.add.reduceat(times[order], first)
        keep = low < high
        g, times = g[first][keep], times[keep]
        for at in range(0, len(g), 1_000_000):
            x, t = g[at : at + 1_000_000], times[at : at + 1_000_000]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([x[t > HOT].tobytes()], pa.binary()), pa.array([len(x)], pa.int64())], ["grams", "hot", "n"])

    found = cut(_texts(docs).mapInArrow(places, "pid int, grams binary, lows binary, highs binary, times binary").repartitionById(width, "pid").mapInArrow(shared, "grams binary, hot binary, n long"))
    total = found.agg(F.sum("n")).first()[0] or 0
    # grams of more than HOT documents are no more than the documents' least grams over HOT
    hot = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["hot"], np.uint64) for r in found.where("octet_length(hot) > 0").select("hot").toLocalIterator())]))
    chunks = (np.frombuffer(r["grams"], np.uint64) for r in found.select("grams").toLocalIterator())
    if total <= EXACT:
        grams = Grams(np.sort(np.concatenate([np.zeros(0, np.uint64), *chunks])))
    else:
        grams = Grams(size=BLOOM)
        for chunk in chunks:
            grams.add(chunk)
    told = docs.sparkSession.sparkContext.broadcast((grams, Grams(hot)))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pid, docs, starts, counts, grams, words): stretches of words whose first counts suffixes are to be sorted."""
        memo, rows, seen, (wanted, apart) = word_hashes(150_000), [], 0, told.value

        def flush():
            by: dict[int, list] = {}
            for r in rows:
                by.setdefault(r[0], []).append(r)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(by), pa.int32()), *(pa.array([np.array([r[i] for r in x], kind).tobytes() for x in by.values()], pa.binary()) for i, kind in ((1, np.int64), (2, np.int32), (3, np.int32), (4, np.uint64))), pa.array([np.concatenate([r[5] for r in x]).tobytes() for x in by.values()], pa.binary())],
                ["pid", "docs", "starts", "counts", "grams", "words"],
            )

        for part in slices(batches, 128):
            for doc, text in zip(part["doc_id"], part["text"]):
                w = words_of(text)
                if len(w) < size:
                    continue
                h = hashed(w, memo)
                g = least_grams(h, size, gram)
                starts = runs(g)
                own = g[starts]
                for i in np.flatnonzero(wanted.has(own) & ~apart.has(own)).tolist():
                    s, e = int(starts[i]), int(starts[i + 1]) if i + 1 < len(starts) else len(g)
                    rows.append((int(own[i] // np.uint64(1 << 20) % np.uint64(fine)), doc, s, e - s, own[i], h[s : e + size - 1]))
                    seen += e - s + size
            if seen > 1_000_000:
                yield flush()
                rows, seen = [], 0
        if rows:
            yield flush()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in (np.int64, np.int32, np.int32, np.uint64, np.uint64)]
        for b in batches:
            for i, into in enumerate(columns, 1):
                into += [np.frombuffer(x, into[0].dtype) for x in b.column(i).to_pylist()]
        d, s, n, g, w = map(np.concatenate, columns)
        del columns
        if not len(d):
            return
        s, n = s.astype(np.int64), n.astype(np.int64)
        base = np.append(0, np.cumsum(n + size - 1)[:-1])
        # groups of one gram are sorted a number at a time, so that only those take memory
        order = np.argsort(g, kind="stable")
        ends = np.append(runs(g[order])[1:], len(order))
        block = np.cumsum(n[order] + size - 1)[ends - 1] // SORTED
        begin = 0
        for stop in ends[np.append(block[1:] != block[:-1], True)].tolist():
            i, begin = order[begin:stop], stop
            long = n[i] + size - 1
            step = np.arange(long.sum()) - np.repeat(np.append(0, np.cumsum(long)[:-1]), long)
            yield from passages(d[i], s[i], n[i], g[i], w[np.repeat(base[i], long) + step])

    def passages(d: np.ndarray, s: np.ndarray, n: np.ndarray, g: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        base = np.append(0, np.cumsum(n + size - 1)[:-1])
        seg = np.repeat(np.arange(len(d)), n)
        inside = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
        flag, least = repeated(w, base[seg] + inside, n[seg] - inside + size - 1, d[seg], g[seg], size)
        i = np.flatnonzero(flag)
        if not len(i):
            return
        first = np.flatnonzero(np.append(True, (np.diff(i) > 1) | (np.diff(seg[i]) > 0)))
        last = np.append(first[1:], len(i)) - 1
        a, b = i[first], i[last]
        low = np.minimum.reduceat(least[i], first)
        for at in range(0, len(a), 500_000):
            x, y = a[at : at + 500_000], b[at : at + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(d[seg[x]]), pa.array((s[seg[x]] + inside[x]).astype(np.int32)), pa.array((s[seg[y]] + inside[y] + size).astype(np.int32)), pa.array(low[at : at + 500_000])], ["doc_id", "start_word", "end_word", "first_doc_id"])

    def hot_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(passage, doc_id, start_word): the suffixes of hot grams, with the hash of their first size words."""
        memo, (_, apart) = word_hashes(150_000), told.value
        for part in slices(batches, 128):
            out = []
            for doc, text in zip(part["doc_id"], part["text"]):
                w = words_of(text)
                if len(w) >= size:
                    h = hashed(w, memo)
                    at = np.flatnonzero(apart.has(least_grams(h, size, gram)))
                    out.append((Suffixes(h).hash(at, size).view(np.int64), np.full(len(at), doc, np.int64), at.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(3)], ["passage", "doc_id", "start_word"])

    laid = _texts(docs).mapInArrow(segments, "pid int, docs binary, starts binary, counts binary, grams binary, words binary").repartitionById(fine, "pid")
    spans = laid.mapInArrow(sort, "doc_id long, start_word int, end_word int, first_doc_id long")
    if len(hot):
        each = _texts(docs).mapInArrow(hot_suffixes, "passage long, doc_id long, start_word int")
        twice = each.groupBy("passage").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("_last")).where("first_doc_id < _last").drop("_last")
        spans = spans.union(each.join(twice, "passage").select("doc_id", "start_word", (F.col("start_word") + size).alias("end_word"), "first_doc_id"))
    # join what overlaps or touches, in each document
    w = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    fresh = F.coalesce((F.col("start_word") > F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    numbered = spans.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("first_doc_id").alias("first_doc_id")).drop("island")
