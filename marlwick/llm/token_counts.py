"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each place of the text; a dynamic programme over the places carries
the best score and the number of pieces that give it, and nothing else: no path is kept.  Ties are settled as the tokenizer
settles them: of equally good last pieces the longest stands, for a later candidate must be strictly better.  A character that
no piece covers costs the least score less 10 and counts as its UTF-8 bytes (byte fallback).

The pieces and scores of a model file are taken as the unigram vocabulary, whatever the kind of the model.  Scores below LOWEST
are placeholders that single precision can't add to others; they are raised to one below the least other score.  With those
scores the counts are those of the tokenizer library's unigram encoder, on whole texts (the tests compare them).

No piece reaches across the start of a word or a line feed, so the best segmentation of a text is composed of those of its
words, and each worker remembers the counts of words.

Defined cases: null text has a null count, empty text none (0).  A space stands before the first word.  Runs of spaces and
texts that hold the meta symbol are counted by whole runs.  Rows are independent, and columns besides doc_id and text ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, lean, slices
from .wfst_tokenizer import MODEL, NORMAL, SPACE, Vocabulary


#: Scores below this are placeholders.
LOWEST = -1e8


def unigram_scores(v: Vocabulary) -> list[float]:
    """The scores of the vocabulary, with placeholders raised."""
    least = min(s for s, k in zip(v.scores, v.kinds) if k == NORMAL and s >= LOWEST)
    return [max(s, least - 1) if k == NORMAL else s for s, k in zip(v.scores, v.kinds)]


class Counter:
    """Counts the pieces of the best segmentation of a text."""

    def __init__(self, path: str = MODEL):
        v = Vocabulary(path)
        scores = unigram_scores(v)
        self.unknown = min(s for s, k in zip(scores, v.kinds) if k == NORMAL) - 10
        self.automaton = ahocorasick.Automaton()
        for p, i in v.ids.items():
            self.automaton.add_word(p, (len(p), scores[i]))
        self.automaton.make_automaton()
        self.prefix, self.breaks = v.prefix, not any("\n" in p for p in v.ids)
        self.runs = re.compile(f"{SPACE}*[^{SPACE}]*")
        self.words, self.bare = Memo(lambda w: self.best(SPACE + w), 500_000), Memo(lambda w: self.best(w), 200_000)
        self.feed = self.best("\n")

    def best(self, text: str) -> int:
        """Pieces of the best segmentation of a text with spaces as meta symbols."""
        low, unknown = float("-inf"), self.unknown
        score, count, at, single, top, pieces = [0.0], [0], 0, False, low, 0
        for end, (k, s) in self.automaton.iter(text):
            while at < end:  # the place after the character at is done; if no piece is that character alone, it may be unknown
                if not single and score[at] + unknown > top:
                    top, pieces = score[at] + unknown, count[at] + len(text[at].encode("utf-8", "replace"))
                score.append(top), count.append(pieces)
                at, top, single = at + 1, low, False
            # the matches at one end come longest first
            x = score[end + 1 - k] + s
            if x > top:
                top, pieces = x, count[end + 1 - k] + 1
            if k == 1:
                single = True
        while at < len(text):
            if not single and score[at] + unknown > top:
                top, pieces = score[at] + unknown, count[at] + len(text[at].encode("utf-8", "replace"))
            score.append(top), count.append(pieces)
            at, top, single = at + 1, low, False
        return count[-1]

    def _line(self, text: str, space: bool) -> int:
        parts = text.split(" ")
        if "" in parts or SPACE in text:
            return sum(self.best(x) for x in self.runs.findall(SPACE * space + text.replace(" ", SPACE)) if x)
        if space:
            return sum(map(self.words.__getitem__, parts))
        return self.bare[parts[0]] + sum(map(self.words.__getitem__, parts[1:]))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.breaks or "\n" not in text:
            return self._line(text, self.prefix)
        lines = text.split("\n")
        total = self.feed * (len(lines) - 1)
        for k, line in enumerate(lines):
            if line or k == 0 and self.prefix:
                total += self._line(line, self.prefix and k == 0)
        return total


@functools.lru_cache(1)
def counter(path: str) -> Counter:
    """One for a worker process, with what it remembers of words."""
    return Counter(path)


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows (doc_id, n_tokens) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array([None if x is None else c.count(x) for x in part["text"]], pa.int32())], ["doc_id", "n_tokens"])

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens int")
