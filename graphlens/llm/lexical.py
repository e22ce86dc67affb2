"""Ranked lexical search: compressed postings per shard, merged document at a time.

Documents are cut into shards of about SHARD_BYTES of text where they lie. A
shard's documents are numbered in order of doc_id; each of its terms has one row of
postings, the gaps between document numbers and the term's occurrences as variable
bytes, and one more row holds the documents' ids and lengths. The index is a table;
no posting is shuffled to build it.

A search sends each shard the postings of the items' terms and the items. There
the cursors of an item's terms stand in a heap by their next document: the least
one opens a window of documents, all cursors that enter the window are taken from
the heap, advanced to its end and put back. A window whose terms cannot beat the
worst kept result even at their largest gains isn't scored. Results are a heap
of at most TOP, the lesser score first and then the greater doc_id; a second,
ranked merge takes the best of all shards.

Items meet shards in a grid of groups of shards and blocks of items, so neither
side is ever held whole. Terms are told apart by 64-bit hashes inside a shard and by
their bytes elsewhere.

Defined cases: null texts and texts without terms are no document of N, and nobody's
result; a null doc_id comes last among equal scores; rows that share a doc_id are
documents of their own; items with null or term-free texts have no result; items
equal in item_id and text are one, and items of one item_id with different texts
are ranked each by itself; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm import common, textkit

TOP = 20
#: Bytes of text of a shard (or one document), items of a block, documents of a window.
SHARD_BYTES, ITEM_BLOCK, SPAN = 16 << 20, 4096, 1024
#: The score's constants: scale of weights, of gains, of occurrences; saturation; share of the length.
WEIGHT, GAIN, OFTEN, SATURATE, LENGTH = 1000, 1_000_000_000, 1000, 12, 25

INDEX = "shard long, term binary, n_docs long, n_terms long, postings binary"
_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def term_runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of the terms of texts, and the index of each text's first one, with the total last."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1 : n + 1] = _TERM[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(inside[1 : n + 1] & (~inside[:n] | edge[:n]))
    ends = np.flatnonzero(inside[1 : n + 1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def gathered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges, A-Z lower-cased, as a binary column."""
    size = ends - starts
    offs = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(textkit.LOWER[buf[at]])]).cast(pa.binary())


def varbytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each value): seven bits a byte, the least first; the last byte of a value has its high bit set."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >= (1 << bits)
    starts = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for j in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > j)
        out[starts[own] + j] = ((values[own] >> (7 * j)) & 127) | np.where(size[own] == j + 1, 128, 0)
    return out, size


def values_of(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw & 128) + 1
    starts = np.concatenate([[0], ends[:-1]])
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, ends - starts))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts) if len(ends) else np.zeros(0, np.int64)


def _occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(hash, text) of each term in order, terms of each text, and for hashes their spelling: [(hashes, binary column)]."""
    buf, offs = textkit.flat(texts)
    hashes, owner, spelled, sizes = [], [], [], []
    for i, j in textkit.chunks(offs):
        own = buf[offs[i] : offs[j]]
        starts, ends, first = term_runs(own, offs[i : j + 1] - offs[i])
        h = textkit.word_hashes(own, starts, ends)
        once, at = np.unique(h, return_index=True)
        spelled.append((once, gathered(own, starts[at], ends[at])))
        hashes.append(h)
        size = np.diff(first)
        sizes.append(size)
        owner.append(np.repeat(np.arange(i, j), size))
    none = np.zeros(0, np.int64)
    return np.concatenate(hashes or [none.astype(np.uint64)]), np.concatenate(owner or [none]), np.concatenate(sizes or [none]), spelled


def _shard(number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    order = pa.compute.sort_indices(ids, null_placement="at_end")
    ids, texts = ids.take(order), texts.take(order)
    hashes, owner, sizes, spelled = _occurrences(texts)
    by = np.argsort(hashes, kind="stable")  # documents stay in order within a term
    hashes, owner = hashes[by], owner[by]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    often = np.diff(np.append(at, len(hashes)))
    hashes, owner = hashes[at], owner[at]
    head = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    gaps = np.diff(owner, prepend=0)
    gaps[head] = owner[head]
    data, size = varbytes(np.stack([gaps, often], 1).ravel())
    held = np.diff(np.append(head, len(hashes)))
    offs = np.concatenate([[0], np.cumsum(size)])[np.append(2 * head, 2 * len(hashes))]
    names, texts_of = np.concatenate([s[0] for s in spelled] or [np.zeros(0, np.uint64)]), pa.chunked_array([s[1] for s in spelled], pa.binary())
    _, place = np.unique(names, return_index=True)  # sorted as the heads are
    terms = texts_of.take(pa.array(place)).combine_chunks()
    postings = pa.Array.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
    known = len(ids) - ids.null_count
    about = np.concatenate([[known], ids.fill_null(0).to_numpy(), sizes]).astype("<i8").tobytes()
    n = len(head)
    columns = [
        pa.array([number] * (n + 1), pa.int64()), pa.concat_arrays([pa.array([None], pa.binary()), terms]),
        pa.array(np.concatenate([[int((sizes > 0).sum())], held])), pa.array(np.concatenate([[int(sizes.sum())], np.add.reduceat(often, head) if n else held])),
        pa.concat_arrays([pa.array([about], pa.binary()), postings]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["shard", "term", "n_docs", "n_terms", "postings"])


def _indexer(limit: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, weight = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, texts = (pa.concat_arrays(whole.column(k).chunks) for k in (0, 1))
            return _shard(number, ids, texts)

        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.large_binary())], ["doc_id", "text"])
            _, offs = textkit.flat(batch.column(1))
            for i, j in textkit.chunks(offs, limit):
                size = int(offs[j] - offs[i])
                if held and weight + size > limit:
                    yield flush()
                    number, held, weight = number + 1, [], 0
                held.append(batch.slice(i, j - i))
                weight += size
        if held:
            yield flush()

    return index


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, text) -> the written index: a row of postings for each shard and term, and for each shard a row with a null term that holds its documents."""
    return common.stored(docs.select("doc_id", "text").mapInArrow(_indexer(shard_bytes), INDEX), "postings")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) -> (item, term, often)."""
    for batch in batches:
        hashes, owner, _, spelled = _occurrences(batch.column(1))
        names, terms = np.concatenate([s[0] for s in spelled] or [np.zeros(0, np.uint64)]), pa.chunked_array([s[1] for s in spelled], pa.binary())
        _, place = np.unique(names, return_index=True)
        once, at = np.unique(hashes, return_inverse=True)
        pairs, often = np.unique(owner * max(len(once), 1) + at, return_counts=True)
        item, term = (pairs // max(len(once), 1), pairs % max(len(once), 1)) if len(pairs) else (pairs, pairs)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item)), terms.take(pa.array(place[term])).combine_chunks(), pa.array(often)], ["item", "term", "often"])


def merged(lists: list[tuple[np.ndarray, np.ndarray]], top: int, span: int = SPAN) -> list[tuple[int, int]]:
    """(score, document) of the top documents by score, then document, from one (documents, gains) list for each term, documents ascending.

    Cursors stand in a heap by their next document; each step merges the window of documents that the least one opens.
    """
    most = [int(gains.max()) for _, gains in lists]
    heads = [(int(docs[0]), k) for k, (docs, _) in enumerate(lists)]
    heapq.heapify(heads)
    at = [0] * len(lists)
    best: list[tuple[int, int]] = []  # (score, -document), the worst first
    while heads:
        first = heads[0][0]
        runs = []
        while heads and heads[0][0] < first + span:
            k = heapq.heappop(heads)[1]
            docs = lists[k][0]
            end = int(np.searchsorted(docs, first + span))
            runs.append((k, at[k], end))
            at[k] = end
            if end < len(docs):
                heapq.heappush(heads, (int(docs[end]), k))
        floor = best[0][0] if len(best) == top else 0
        if sum(most[k] for k, _, _ in runs) <= floor:  # no document of the window can enter
            continue
        score = np.zeros(span, np.int64)
        for k, a, b in runs:
            docs, gains = lists[k]
            score[docs[a:b] - first] += gains[a:b]
        fit = np.flatnonzero(score > floor)
        if len(fit) > top:
            fit = np.sort(fit[np.argsort(-score[fit], kind="stable")[:top]])
        for doc, value in zip(fit.tolist(), score[fit].tolist()):
            if len(best) < top:
                heapq.heappush(best, (value, -(first + doc)))
            elif value > best[0][0]:  # of equal scores the earlier document stays
                heapq.heapreplace(best, (value, -(first + doc)))
    return [(value, -doc) for value, doc in sorted(best, reverse=True)]


def _searcher(n_docs: int, n_terms: int, top: int):
    def gains(data: bytes, damp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = values_of(data).reshape(-1, 2)
        docs, often = np.cumsum(pairs[:, 0]), pairs[:, 1]
        return docs, (GAIN * often) // (OFTEN * often + SATURATE * damp[docs])

    def search(postings: pa.Table, items: pa.Table) -> pa.Table:
        out: dict[str, list] = {"item": [], "doc_id": [], "score": []}
        asked = items.to_pylist()
        shards = postings.column("shard").to_numpy()
        for shard in np.unique(shards).tolist() if asked else []:
            own = postings.take(pa.array(np.flatnonzero(shards == shard)))
            rows = dict(zip(own.column("term").to_pylist(), own.column("postings").to_pylist()))
            about = np.frombuffer(rows.pop(None), "<i8")
            known, ids, sizes = int(about[0]), about[1 : 1 + len(about) // 2], about[1 + len(about) // 2 :]
            exact = sizes if not len(sizes) or int(sizes.max()) * LENGTH * n_docs < 1 << 63 else sizes.astype(object)
            damp = (100 - LENGTH + (LENGTH * exact * n_docs) // max(n_terms, 1)).astype(np.int64)
            lists = {term: gains(data, damp) for term, data in rows.items()}
            for item in asked:
                own_lists = []
                for t in item["terms"]:
                    if t["weight"] > 0 and t["term"] in lists:
                        docs, gain = lists[t["term"]]
                        own_lists.append((docs, gain * (t["weight"] * t["often"])))
                for value, doc in merged(own_lists, top):
                    out["item"].append(item["item"])
                    out["doc_id"].append(int(ids[doc]) if doc < known else None)
                    out["score"].append(value)
        return pa.table({"item": pa.array(out["item"], pa.int64()), "doc_id": pa.array(out["doc_id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    return search


def ranked(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """index of build_index(), (item_id, text) -> item_id, rank, doc_id, score of each item's top documents."""
    spark = index.sparkSession
    distinct = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    keyed = common.stored(distinct.withColumn("item", F.monotonically_increasing_id()), "items")
    terms = common.stored(keyed.select("item", "text").mapInArrow(_item_terms, "item long, term binary, often long"), "item-terms")
    whole = index.where("term IS NULL").agg(F.sum("n_docs"), F.sum("n_terms"), F.sum(F.octet_length("postings")), F.count("*")).first()
    n_docs, n_terms, n_shards = whole[0] or 0, whole[1] or 0, whole[3]
    n_items = keyed.count()
    if not n_docs or not n_items:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    wanted = common.stored(terms.select("term").distinct(), "wanted-terms")
    found = common.stored(common.matched(index.where("term IS NOT NULL"), wanted, ["term"], "shard"), "wanted-postings")
    weight = F.floor(F.lit(WEIGHT) * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = common.stored(found.groupBy("term").agg(F.sum("n_docs").alias("df")).select("term", weight.alias("weight")), "weights")
    blocks = -(-n_items // ITEM_BLOCK)
    deal = lambda column, k: F.pmod(F.xxhash64(column), F.lit(k)).cast("int")
    asked = common.matched(terms, weights, ["term"], "item").groupBy("item").agg(F.collect_list(F.struct("term", "weight", "often")).alias("terms"))
    asked = common.stored(asked.withColumn("block", deal("item", blocks)), "asked")
    uses = common.stored(terms.select("term", deal("item", blocks).alias("block")).distinct(), "block-terms") if blocks > 1 else None
    every = found.drop("n_docs", "n_terms").withColumn("block", F.lit(0)) if uses is None else found.drop("n_docs", "n_terms").join(common.small(uses), "term")
    about = index.where("term IS NULL").select("shard", "term", "postings").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = every.select("shard", "term", "postings", "block").unionByName(about).withColumn("cell", deal("shard", n_shards))
    right = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    best = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(_searcher(n_docs, n_terms, top), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    first = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(common.small(keyed.select("item", "item_id"), n_items), "item").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked(build_index(common.table(spark, sf_dir, "documents")), common.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
sized AS (SELECT r, doc_id, len(w)::BIGINT AS n, w FROM docs WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS cn, sum(n)::BIGINT AS cl FROM sized),
asked AS (
  SELECT row_number() OVER () AS item, item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
terms AS (SELECT item, item_id, t, count(*) AS often FROM (SELECT item, item_id, unnest(w) AS t FROM asked) GROUP BY ALL),
held AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM sized) WHERE t IN (SELECT t FROM terms) GROUP BY r, t),
weights AS (SELECT t, floor(1000 * ln((2 * cn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM held, whole GROUP BY t, cn),
gains AS (
  SELECT r, t, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * cn) // cl))) AS g
  FROM held JOIN sized USING (r) JOIN weights USING (t), whole),
scores AS (SELECT item, any_value(item_id) AS item_id, r, sum(often * g)::BIGINT AS score FROM terms JOIN gains USING (t) GROUP BY item, r),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
           FROM scores JOIN (SELECT r, doc_id FROM sized) USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
