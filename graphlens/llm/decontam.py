"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment.

A document is contaminated by a test item if the two align word by word with at
least THRESHOLD of the item's best possible score, and no less than FEWEST words
in a row (all, of an item of fewer) score. Such an alignment matches so many of
the item's words (need of n) inside so short a stretch of the document (span words)
that, whichever n - need + t of the item's words are taken as seeds, t of them stand in
that stretch. The rarest ones are taken, by the number of documents that hold a word;
stretches with t seeds are aligned if enough of all the item's words stand in them.
So seeds lose nothing that reaches the threshold: a copy with every third word
replaced, or a word put in after every second, is found though no two or three of its
words stand in a row.

Test items go to the executors in slices of bounded size, one slice at a time:
a pass over the documents counts its words, another finds its copies. Nothing
of the documents is shuffled but the counts of a slice's words.

Defined cases: words are compared lower-cased (A-Z) and without ASCII marks at
either end; items without words match nothing, those of one to three words match
where all of them stand in a row; null and empty texts are clean; very long
texts are searched a bounded stretch at a time; repeated rows are each answered;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm import common, textkit

MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's best possible alignment score from which a document is contaminated.
THRESHOLD = 0.5
#: Words whose score in a row is the least that counts, for short items.
FEWEST = 4
#: Bytes of item texts that go to the executors at once.
SLICE_BYTES = 32 << 20
#: Seeds of an item that stand together before they are looked at; words of a stretch, and hits of seeds, that are listed at once.
TOGETHER, STRETCH, HITS = 4, 1 << 18, 1 << 20
#: Bytes of text that one vectorised step handles (a longer text is a step of its own).
STEP = 1 << 20

_MARK = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])


def plain_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of words without marks at either end; words of marks alone stay as they are."""
    starts, ends, first = textkit.words(buf, offs)
    lo, hi = starts.copy(), ends.copy()
    for _ in range(4):
        lo += _MARK[buf[lo]] & (lo < hi - 1) if len(lo) else 0
        hi -= _MARK[buf[hi - 1]] & (lo < hi - 1) if len(lo) else 0
    return textkit.word_hashes(buf, lo, hi), first


def align(item: np.ndarray, window: np.ndarray, least: float = 0) -> tuple[int, int]:
    """(best local score, last word of it in window) of two word sequences; a search that can't come to the least score any more ends."""
    step = np.arange(len(window)) * -GAP
    above, best, where = np.zeros(len(window) + 1, np.int64), 0, 0
    for left, word in zip(range(len(item) - 1, -1, -1), item):
        row = np.maximum(above[:-1] + np.where(window == word, MATCH, MISMATCH), above[1:] + GAP)
        row = np.maximum.accumulate(np.maximum(row, 0) + step) - step
        above[1:] = row
        k = int(row.argmax())
        if row[k] > best:
            best, where = int(row[k]), k
        if max(best, int(row[k]) + MATCH * left) < least:
            break
    return best, where


class Items:
    """A slice of the test items as word hashes, with their seeds."""

    def __init__(self, ids: list, texts: list):
        buf, offs = textkit.flat(pa.array(texts, pa.string()))
        self.ids = ids
        self.words, self.first = plain_words(buf, offs)
        self.vocabulary, self.word = np.unique(self.words, return_inverse=True)
        item = np.repeat(np.arange(len(ids)), np.diff(self.first))
        pairs, self.counts = np.unique(item * max(len(self.vocabulary), 1) + self.word, return_counts=True)
        self.bags, self.bag = pairs % max(len(self.vocabulary), 1), np.searchsorted(pairs, np.arange(len(ids) + 1) * max(len(self.vocabulary), 1))  # each item's distinct words
        self.present, self.often = np.zeros(len(self.vocabulary) + 1, bool), np.zeros(len(self.vocabulary) + 1, np.int64)  # scratch of likely(); the last is for other words

    def rare(self, held: np.ndarray, threshold: float) -> None:
        """Choose the seeds of longer items. held: documents that hold each word of the vocabulary."""
        size = np.diff(self.first)
        item = np.repeat(np.arange(len(size)), size)
        self.least = np.maximum(threshold, np.minimum(size, FEWEST) / np.maximum(size, 1))  # share of the best score
        need = np.maximum(np.ceil(self.least * size - 1e-9).astype(np.int64), 1)  # words that an alignment matches at least
        self.span = np.floor(size * (3 - 2 * self.least) + 1e-9).astype(np.int64)  # words of a text that it spans at most
        self.together = np.minimum(TOGETHER, need)
        order = np.lexsort((self.word, held[self.word], item))  # each item's words, the rarest first
        place = np.arange(len(order)) - self.first[item]
        own = order[place < (size - need + self.together)[item]]
        self.stride = max(len(size), 1)
        self.pairs = np.unique(self.word[own] * self.stride + item[own])  # (word, item)
        self.margin = int(self.span.max(initial=0))

    def near(self, known: np.ndarray, text: np.ndarray, lo: int, hi: int, a: int = 0, b: int | None = None):
        """(item, first word, last word + 1, hits) of the stretches of known[lo:hi] that items a to b have enough seeds in, a bounded number of hits at a time."""
        b = self.stride if b is None else b
        own = known[lo:hi] * self.stride
        left, right = np.searchsorted(self.pairs, own + a), np.searchsorted(self.pairs, own + b)
        found = right - left
        if found.sum() > HITS and (hi - lo > 4 * self.margin + 4 or b - a > 1):
            if hi - lo > 4 * self.margin + 4:
                middle = (lo + hi) // 2
                yield from self.near(known, text, lo, middle + self.margin, a, b)
                yield from self.near(known, text, middle - self.margin, hi, a, b)
            else:
                yield from self.near(known, text, lo, hi, a, (a + b) // 2)
                yield from self.near(known, text, lo, hi, (a + b) // 2, b)
            return
        which = np.flatnonzero(found)
        found, left = found[which], left[which]
        item = self.pairs[np.repeat(left - np.cumsum(found) + found, found) + np.arange(found.sum())] % self.stride
        at = np.repeat(which + lo, found)
        order = np.lexsort((at, item))
        item, at = item[order], at[order]
        for t in np.unique(self.together[item]).tolist():
            head = np.arange(len(at) - t + 1)
            last = head + t - 1
            head = head[(self.together[item[head]] == t) & (item[head] == item[last]) & (text[at[head]] == text[at[last]]) & (at[last] - at[head] < self.span[item[head]])]
            if not len(head):
                continue
            m, begin, end = item[head], at[head + t - 1] - self.span[item[head]] + 1, at[head] + self.span[item[head]]
            fresh = np.ones(len(head), bool)  # stretches that meet are one
            fresh[1:] = (m[1:] != m[:-1]) | (text[at[head[1:]]] != text[at[head[:-1]]]) | (begin[1:] > end[:-1])
            first = np.flatnonzero(fresh)
            until = np.append(first[1:], len(head)) - 1
            yield from zip(m[first].tolist(), text[at[head[first]]].tolist(), begin[first].tolist(), end[until].tolist(), (head[until] - head[first] + t).tolist())

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the vocabulary of each word, or its length."""
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), max(len(self.vocabulary) - 1, 0))
        return np.where(self.vocabulary[place] == hashes, place, len(self.vocabulary)) if len(self.vocabulary) else place

    def likely(self, m: int, known: np.ndarray) -> bool:
        """Whether item m could reach its least score by the words of a stretch: no alignment matches a word oftener than both sides hold it, or more words than stand in its span."""
        need = math.ceil(self.least[m] * (self.first[m + 1] - self.first[m]) - 1e-9)
        own = self.bags[self.bag[m] : self.bag[m + 1]]
        counts = self.counts[self.bag[m] : self.bag[m + 1]]
        self.present[known] = True
        fits = int(counts[self.present[own]].sum()) >= need
        self.present[known] = False
        if not fits:
            return False
        self.often[own] = counts
        held = self.often[known]
        inside = known[held > 0]
        fits = len(inside) >= need
        if fits and len(known) > self.span[m]:
            total = np.concatenate([[0], np.cumsum(held > 0)])
            fits = int((total[self.span[m] :] - total[: -self.span[m]]).max()) >= need
        if fits:
            words, often = np.unique(inside, return_counts=True)
            fits = int(np.minimum(often, self.often[words]).sum()) >= need
        self.often[own] = 0
        return fits


def _aligner(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = textkit.flat(batch.column(1))
            best: dict[tuple[int, int], tuple[int, int, int]] = {}  # (row, item): score, last word, seeds

            def met(row: int, m: int, found: tuple[int, int, int]) -> None:
                have = best.get((row, m), (0, 0, 0))
                best[row, m] = (*max(have[:2], found[:2], key=lambda x: (x[0], -x[1])), max(have[2], found[2]))

            for i, j in textkit.chunks(offs, STEP):
                hashes, first = plain_words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                known = items.known(hashes)
                text = np.repeat(np.arange(j - i), np.diff(first))
                for lo in range(0, len(known), STRETCH):  # an alignment lies in one stretch or its margin
                    for m, t, a, b, seeds in items.near(known, text, lo, min(lo + STRETCH + items.margin, len(known))):
                        a, b = max(a, int(first[t])), min(b, int(first[t + 1]))
                        if items.likely(m, known[a:b]):
                            own = items.words[items.first[m] : items.first[m + 1]]
                            score, at = align(own, hashes[a:b], MATCH * len(own) * items.least[m] - 1e-9)
                            met(i + t, m, (score, a + at - int(first[t]), seeds))
            kept = []
            for (row, m), (found, where, seeds) in best.items():
                score = found / (MATCH * int(items.first[m + 1] - items.first[m]))
                if score >= items.least[m] - 1e-9:
                    kept.append((row, items.ids[m], score, seeds, where))
            row, item, score, seeds, where = zip(*sorted(kept, key=lambda r: (r[0], r[1] is None, r[1] or 0))) if kept else ((),) * 5
            docs = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(seeds, pa.int64()), pa.array(where, pa.int64())], ["doc_id", "item_id", "score", "n_seeds", "last_word"])
        pa.default_memory_pool().release_unused()  # the worker stays for other stages

    return run


def _counter(vocabulary: np.ndarray):
    """(word, documents that hold it) of a batch, for words of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            buf, offs = textkit.flat(batch.column(0))
            for i, j in textkit.chunks(offs, STEP):
                hashes, first = plain_words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                place = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                own = np.flatnonzero(vocabulary[place] == hashes) if len(vocabulary) else place[:0]
                text = np.repeat(np.arange(j - i), np.diff(first))[own]
                once = np.unique(text * max(len(vocabulary), 1) + place[own])
                held += np.bincount(once % max(len(vocabulary), 1), minlength=len(vocabulary))
        pa.default_memory_pool().release_unused()
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["word", "held"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text), (item_id, text) -> doc_id, item_id, score, n_seeds (most in one stretch), last_word of every contaminated document and its item."""
    rows = docs.select("doc_id", "text")
    test = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = test.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = size // SLICE_BYTES + 1
    out = None
    for k in range(slices):
        part = test.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()
        items = Items([r["item_id"] for r in part], [r["text"] for r in part])
        held = np.zeros(len(items.vocabulary), np.int64)
        counts = rows.select("text").mapInArrow(_counter(items.vocabulary), "word long, held long").groupBy("word").agg(F.sum("held").alias("held")).toArrow()
        held[counts.column("word").to_numpy()] = counts.column("held").to_numpy()
        items.rare(held, threshold)
        found = rows.mapInArrow(_aligner(items), "doc_id long, item_id long, score double, n_seeds long, last_word long")
        if slices > 1:  # the driver holds one slice at a time
            found = common.stored(found, "contaminated")
        out = found if out is None else out.unionByName(found)
    return out


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
