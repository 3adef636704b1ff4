"""Evaluation passages in a corpus (problem 9), by suffix arrays over shards of the corpus.

Words of a shard are numbered by the vocabulary of the evaluation items; a suffix that meets a word outside it within
RUN words can't match and isn't sorted in. The suffixes of a shard are sorted by their first RUN words, and every suffix
of every item is looked up by binary search. Matches that follow each other give the longest verbatim passage.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm import textcodes as tc

#: Words in a row that make a leak.
RUN = 12
#: Most characters of items whose suffixes are sent to all executors at once; more items are taken part by part.
PART_CHARS = 20_000_000
#: Labels at the start of lines, which a passage may have lost.
LABEL = re.compile(r"^[\W_]*(?:caller|receiver|scammer|victim|customer|agent|callee|narrator|speaker[ _-]?\d+)\s*[:>\])\-]+", re.I)


def item_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of an item's words, and whether each belongs to a label at the start of a line."""
    hashes, label = [], []
    for line in text.split("\n"):
        n = 0
        if m := LABEL.match(line):
            n = len(tc.words_of([m.group()]).hash)
        h = tc.words_of([line]).hash
        hashes.append(h)
        label.append(np.arange(len(h)) < n)
    return np.concatenate(hashes), np.concatenate(label)


def item_suffixes(text: str, run: int = RUN) -> list[tuple[int, ...]]:
    """The first `run` words of every suffix of an item, each label kept or left out.

    A line with a label and no words gives nothing unless all labels are kept, so that every label left out stands
    before a word and the ways to leave labels out stay few.
    """
    h, label = item_words(text)
    out = {tuple(map(int, h[i : i + run])) for i in range(len(h) - run + 1)}
    bare = _line_ends(text)
    h, label = h[~bare], label[~bare]
    n = len(h)
    for i in range(n):
        states = {(i, ())}
        while states:
            grown = set()
            for at, got in states:
                if len(got) == run:
                    out.add(got)
                elif at < n:
                    grown.add((at + 1, (*got, int(h[at]))))
                    if label[at] and got:
                        grown.add((at + 1, got))
            states = grown
    return sorted(out)


def _line_ends(text: str) -> np.ndarray:
    """Whether each word of an item is of a line that holds nothing but its label."""
    out = []
    for line in text.split("\n"):
        n = len(tc.words_of([line]).hash)
        m = LABEL.match(line)
        out.append(np.full(n, bool(m) and len(tc.words_of([m.group()]).hash) == n))
    return np.concatenate(out)


class Items:
    """The suffixes of all items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        pairs = [(s, i) for i, t in items for s in item_suffixes(t, run)]
        self.run = run
        self.vocabulary = np.unique(np.array([s for s, _ in pairs], np.uint64).ravel())
        ids = np.searchsorted(self.vocabulary, np.array([s for s, _ in pairs], np.uint64).reshape(-1, run)) + 1
        order = np.lexsort([ids[:, k] for k in range(run - 1, -1, -1)]) if len(ids) else np.zeros(0, np.int64)
        self.keys, self.item = ids[order], np.array([i for _, i in pairs], np.int64)[order]

    def search(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk of texts: text, item, first word of the text, words in a row, for each longest passage."""
        w = tc.words_of(texts)
        none = np.zeros(0, np.int64)
        n, run = len(w.hash), self.run
        if n < run or not len(self.keys):
            return none, none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == w.hash, at + 1, 0)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        start = np.flatnonzero((unknown[run:] == unknown[: n - run + 1]) & (w.doc[run - 1 :] == w.doc[: n - run + 1]))
        if not len(start):
            return none, none, none, none
        shard = ids[start[:, None] + np.arange(run)]
        order = np.lexsort([shard[:, k] for k in range(run - 1, -1, -1)])
        suffixes, start = shard[order], start[order]
        # only item suffixes that begin with a word with which some suffix here begins
        there = np.zeros(len(self.vocabulary) + 2, bool)
        there[suffixes[:, 0]] = True
        own = np.flatnonzero(there[self.keys[:, 0]])
        lo, hi = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
        lo[own] = self._bound(suffixes, self.keys[own], right=False)
        hi[own] = self._bound(suffixes, self.keys[own], right=True)
        hit = np.flatnonzero(hi > lo)
        many = hi[hit] - lo[hit]
        pick = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        pos, item = start[pick], np.repeat(self.item[hit], many)
        order = np.lexsort((pos, item))
        pos, item = pos[order], item[order]
        keep = np.concatenate(([True], (pos[1:] != pos[:-1]) | (item[1:] != item[:-1]))) if len(pos) else np.zeros(0, bool)
        pos, item = pos[keep], item[keep]
        if not len(pos):
            return none, none, none, none
        new = np.concatenate(([True], (item[1:] != item[:-1]) | (pos[1:] != pos[:-1] + 1) | (w.doc[pos[1:]] != w.doc[pos[:-1]])))
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(pos))) + run - 1
        docs = w.doc[pos[first]]
        base = np.searchsorted(w.doc, docs)
        return docs, item[first], pos[first] - base, length

    @staticmethod
    def _bound(suffixes: np.ndarray, keys: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of all keys at once in the sorted suffixes of a shard."""
        lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(suffixes), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            seen = suffixes[np.minimum(mid, len(suffixes) - 1)]
            differs = seen != keys
            k = np.argmax(differs, 1)
            rows = np.arange(len(k))
            same = ~differs[rows, k]
            less = (seen[rows, k] < keys[rows, k]) | (same & right)
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, item_id, n_passages, longest_words, at_word) of documents that hold `run` words in a row of an item.

    docs: (doc_id, text); items: (item_id, text). Null and short texts on either side match nothing; items with equal
    passages all count; a doc_id that stands several times is one document. Items go to all executors in parts of
    PART_CHARS characters each; the documents are read once for every part.
    """
    asked = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    n_parts = max(1, -(-chars // part_chars))
    out = None
    for k in range(n_parts):
        mine = asked if n_parts == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_parts)) == k)
        part = _found(docs, [(r.item_id, r.text) for r in mine.collect()], run)
        out = part if out is None else out.union(part)
    best = F.max(F.struct("words", (-F.col("at_word")).alias("at"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_passages"), best).select("doc_id", "item_id", "n_passages", F.col("best.words").alias("longest_words"), (-F.col("best.at")).alias("at_word"))


def _found(docs: DataFrame, items: list[tuple[int, str]], run: int) -> DataFrame:
    """(doc_id, item_id, at_word, words) of all passages of these items."""
    index = docs.sparkSession.sparkContext.broadcast(Items(items, run))

    def find(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, part in tc.chunks(batch.column(1).to_pylist()):
                d, i, at, n = index.value.search(part)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + d].astype(np.int64)), pa.array(i), pa.array(at), pa.array(n)], ["doc_id", "item_id", "at_word", "words"])

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(find, "doc_id bigint, item_id bigint, at_word bigint, words bigint")


def leak_report(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """Of each leaked item: in how many documents it stands and the longest passage found."""
    return leaks(docs, items, run).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("longest_words").alias("longest_words"))


def without_leaks(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """The documents without any passage of an item; documents with a null id or text stay."""
    return docs.join(leaks(docs, items, run).select("doc_id").distinct(), "doc_id", "left_anti")
