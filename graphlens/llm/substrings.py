"""Exact removal of repeated 100-byte strings by prefix-free parsing.

A window is WIDTH bytes inside one text. Rolling-hash triggers cut texts into
phrases; a window belongs to the first trigger that it holds far enough from
its end (a dense second kind of trigger serves stretches without the first,
and windows without either stand for themselves). Equal windows hold equal
triggers, so each meets its equals at its trigger. A boundary is a trigger
occurrence with the run of window starts that belong to it.

1. Parse: every boundary sends two fingerprints to the partition of its core
   (the bytes after the trigger): that of the core and that of its context (all
   bytes of its windows). A core that occurs once has no repeated window. Of
   boundaries of one context all but the first are repeats as a whole. What
   remains are first occurrences whose core recurs in another context: edges of
   repeated passages.
2. These send their contexts to the partition of their core. There the
   dictionary (phrases before the triggers, sorted from their ends, so all
   suffixes are in order) and the parse (texts after the triggers, sorted) are
   suffix-sorted with their common prefixes; a window's place in corpus order
   is its suffix's rank and its right side's rank, and windows that agree on
   WIDTH bytes are neighbours. All but the earliest are repeats.
3. Every text is covered by its repeats; what is left is hashed.

Contexts are compared by 96-bit fingerprints, edges by their bytes. Boundaries
of one context inside a batch are folded before they are sent, so a passage
that is everywhere costs one record a batch.

Memory: fingerprints and contexts are grouped by slices of the hashes' space,
which hold about SLICE_BYTES of text however large the corpus is; a partition is
sorted by slice and worked through a slice at a time. A core may still stand in
very many different contexts (the edge of a passage that a third of all texts
hold). Its windows part company: each goes, as a 128-bit fingerprint of its WIDTH
bytes, to a partition of its own, and equal ones of a batch are folded into the
first. Such cores are found by a sample ahead of the parse, so their fingerprints
don't meet either, and for certain by step 1's counts. Which way a core takes
changes no result.

Defined cases: null texts are empty; texts shorter than a window lose nothing;
rows that share a doc_id come one after another, ordered by a hash of the text; a null
doc_id comes first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm import common, textkit

WIDTH = 100
GRAM, CORE = 8, 32
#: One in so many places is a trigger of the first and of the second kind.
RARE, DENSE = 40, 12
#: Contexts that are sorted at once (more only where one core has more).
SORTED = 1 << 13
#: Bytes of text that are parsed at once, that one batch of records is made from, and one of contexts (a longer text is one of its own).
STEP, RECORDS, CONTEXTS = 1 << 19, 1 << 26, 1 << 23

#: Bytes of text whose records one slice of a partition holds, about.
SLICE_BYTES = 1 << 26
#: Contexts of a core from which its windows go apart; share (or bytes) of the text in which such cores are looked for, and how often a core must be found there.
HOT = SORTED
SAMPLE_SHARE, SAMPLE_BYTES, SAMPLE_HITS, MOST_HOT = 1e-4, 1 << 26, 64, 100_000

RECORD = "part int, slice int, data binary"

_BYTE_TWO = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_ONE, _TWO = 65536 // RARE, 65536 // RARE + 65536 // DENSE


class Parse:
    """Boundaries of a chunk of texts in order: text, lo, hi (first and last window start), at (the trigger), core, context, k (number in its text)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, width: int = WIDTH):
        n, reach = len(buf), width - CORE
        h = textkit.prefix(buf)
        ends, begins = offs[1:], offs[:-1]
        if n >= GRAM:
            gram = np.ndarray((n - GRAM + 1,), "<u8", buffer=np.ascontiguousarray(buf), strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
            gram ^= gram >> np.uint64(32)
            gram *= np.uint64(0xD6E8FEB86659FD93)
            gram >>= np.uint64(48)
            found = np.flatnonzero(gram < _TWO)
            first = gram[found] < _ONE
        else:
            found, first = np.zeros(0, np.int64), np.zeros(0, bool)
        text = np.searchsorted(offs, found, "right") - 1
        inside = found + GRAM <= ends[text] if len(found) else np.zeros(0, bool)
        found, first, text = found[inside], first[inside], text[inside]
        far = n + 2 * width

        def before(at, own, pick, of):
            """For positions at the last of pick that is smaller and of the same text, or the byte before the text."""
            k = np.searchsorted(pick, at) - 1
            ok = k >= 0
            ok &= of[np.maximum(k, 0)] == own if len(of) else False
            return np.where(ok, pick[np.maximum(k, 0)] if len(pick) else 0, begins[own] - 1)

        t1, x1, t2, x2 = found[first], text[first], found[~first], text[~first]
        lo1 = np.maximum(np.maximum(before(t1, x1, t1, x1) + 1, t1 - reach), begins[x1])
        hi1 = np.minimum(t1, ends[x1] - width)
        k = np.searchsorted(t1, t2)
        after = np.where((k < len(t1)) & (x1[np.minimum(k, len(t1) - 1)] == x2 if len(t1) else False), t1[np.minimum(k, len(t1) - 1)] if len(t1) else far, far)
        lo2 = np.maximum(np.maximum(before(t2, x2, t2, x2), before(t2, x2, t1, x1)) + 1, np.maximum(t2 - reach, begins[x2]))
        hi2 = np.minimum(np.minimum(t2, after - reach - 1), ends[x2] - width)
        at, text = np.concatenate([t1, t2]), np.concatenate([x1, x2])
        lo, hi = np.concatenate([lo1, lo2]), np.concatenate([hi1, hi2])
        kind = np.repeat(np.array([1, 2], np.uint64), [len(t1), len(t2)])
        some = lo <= hi
        at, text, lo, hi, kind = at[some], text[some], lo[some], hi[some], kind[some]
        # windows that no trigger has
        cover = np.zeros(n + 1, np.int32)
        np.add.at(cover, lo, 1)
        np.add.at(cover, hi + 1, -1)
        long = ends - begins >= width
        np.add.at(cover, begins[~long], 1)
        np.add.at(cover, ends[~long], -1)
        np.add.at(cover, ends[long] - width + 1, 1)
        np.add.at(cover, ends[long], -1)
        bare = np.flatnonzero(np.cumsum(cover[:n]) == 0)
        core = textkit.mix(textkit.spans(h, at, at + CORE) + kind)
        context = textkit.mix(textkit.spans(h, lo, hi + width) + (at - lo).astype(np.uint64) * np.uint64(1000003) + kind)
        own = textkit.mix(textkit.spans(h, bare, bare + width) + np.uint64(3))
        order = np.argsort(np.concatenate([lo, bare]), kind="stable")
        join = lambda a, b: np.concatenate([a, b])[order]
        self.lo, self.hi, self.at = join(lo, bare), join(hi, bare), join(at, bare)
        self.text = join(text, np.searchsorted(offs, bare, "right") - 1)
        self.core, self.context = join(core, own), join(context, own)
        self.k = np.arange(len(order)) - np.searchsorted(self.text, self.text)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(struct.pack("<q", a.nbytes) + a.tobytes() for a in arrays)


def _unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        (size,) = struct.unpack_from("<q", raw, at)
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def _six(x: np.ndarray) -> np.ndarray:
    """The upper six bytes of 64-bit values."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])


def _from_six(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = raw.reshape(-1, 6)
    return out.view("<u8").ravel()


def _places(doc: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """doc ids in order of records, as (distinct ids' differences, records of each), for records sorted by doc."""
    ids, count = np.unique(doc, return_counts=True)
    return np.diff(ids, prepend=0), count.astype("<u4")


def _lists(doc: np.ndarray, *marked: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
    """Distinct docs, and for each pair (rows' doc, value) a list of values."""
    out: list[pa.Array] = [pa.array(doc)]
    for own, value in marked:
        order = np.argsort(own, kind="stable")
        cuts = np.append(np.searchsorted(own[order], doc), len(own)).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(value[order].astype(np.int32))))
    return out


class _Routes:
    """Where records go: the hashes' space in equal groups, several slices of each partition."""

    def __init__(self, spark, partitions: int, slices: int):
        self.partitions, self.slices, self.hot = partitions, slices, HOT
        rows = spark.range(40 * partitions + 200).select(F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(partitions)).alias("to")).groupBy("to").agg(F.min("key").alias("key")).collect()
        self.key = np.zeros(partitions, np.int32)  # for each partition a value that hash partitioning sends there
        for r in rows:
            self.key[r["to"]] = r["key"]

    def groups(self, hashes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(partition's key, slice, rows in order) of each group that has rows. The lower 24 bits of the hashes decide."""
        n = self.partitions * self.slices
        where = (hashes & np.uint64(0xFFFFFF)).astype(np.int64) * n >> 24
        by = np.argsort(where, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(where[by], prepend=-1)), len(by))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            group = int(where[by[a]])
            yield int(self.key[group // self.slices]), group % self.slices, by[a:b]

    def exchanged(self, records: DataFrame) -> DataFrame:
        out = records.repartition(self.partitions, "part")
        return out.sortWithinPartitions("slice") if self.slices > 1 else out


def _records(parts: list[int], slices: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(slices, pa.int32()), pa.array(data, pa.binary())], ["part", "slice", "data"])


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The records of each slice of a partition."""
    held: list[bytes] = []
    now = None
    for batch in batches:
        for which, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if held and which != now:
                yield held
                held = []
            now = which
            held.append(raw)
    if held:
        yield held


def _in_batches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches whose texts (second column) have at most limit bytes together, or one text, sorted by their first column."""
    for batch in batches:
        _, offs = textkit.flat(batch.column(1))
        for i, j in textkit.chunks(offs, limit):
            part = batch.slice(i, j - i)
            yield part.take(pa.array(np.argsort(part.column(0).to_numpy(), kind="stable")))


def _folded(core: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a first context, rows of its repeats), both in order."""
    order = np.lexsort((context, core))  # stable: the first of equals is the earliest
    same = np.zeros(len(order), bool)
    same[1:] = (core[order[1:]] == core[order[:-1]]) & (context[order[1:]] == context[order[:-1]])
    return np.sort(order[~same]), np.sort(order[same])


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (core, n): different contexts of each core in a batch."""
    for batch in _in_batches(batches, RECORDS):
        buf, offs = textkit.flat(batch.column(1))
        held = [Parse(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in textkit.chunks(offs, STEP)]
        core, context = (np.concatenate([getattr(p, name) for p in held]) for name in ("core", "context"))
        first, _ = _folded(core, context)
        found, n = np.unique(core[first], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["core", "n"])


def hot_cores(rows: DataFrame, size: int) -> np.ndarray:
    """Cores that a sample of the texts shows in very many contexts, sorted; at most MOST_HOT."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_BYTES / max(size, 1)))
    picked = rows.where(common.hash_key(F.col("doc_id"), "hot") < int(share * 2**60))
    counted = picked.mapInArrow(_cores, "core long, n long").groupBy("core").agg(F.sum("n").alias("n")).where(F.col("n") >= max(SAMPLE_HITS, int(HOT * share)))
    return np.sort(np.array([r["core"] for r in counted.orderBy(F.desc("n"), "core").limit(MOST_HOT).collect()], np.int64).view(np.uint64))


#: What a flagged boundary is: a repeat as a whole, one to be solved with its core, one whose windows go apart.
_REPEAT, _SOLVE, _APART = 0, 1, 2


def _parser(routes: _Routes, hot: np.ndarray):
    """(doc_id, text) -> records: fingerprints (first byte 0) or boundaries flagged already (1)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_batches(batches, RECORDS):
            ids = batch.column(0).to_numpy()
            buf, offs = textkit.flat(batch.column(1))
            held = []
            for i, j in textkit.chunks(offs, STEP):
                p = Parse(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                held.append((p.core, p.context, ids[i + p.text], p.k.astype(np.int32)))
            core, context, doc, k = (np.concatenate(x) for x in zip(*held))
            sent, again = _folded(core, context)
            apart = np.isin(core[sent], hot, kind="sort") if len(hot) else np.zeros(len(sent), bool)
            known = [(again, _REPEAT), (sent[apart], _APART)]
            sent = sent[~apart]
            parts, slices, data = [], [], []
            for part, which, own in routes.groups(core[sent]):
                parts.append(part)
                slices.append(which)
                data.append(b"\0" + _pack(_six(core[sent[own]]), _six(context[sent[own]]), *_places(doc[sent[own]], k), k[sent[own]]))
            for own, flag in known:
                if len(own):
                    parts.append(int(routes.key[int(ids[0]) % routes.partitions]))
                    slices.append(0)
                    data.append(b"\1" + zlib.compress(_pack(*_places(doc[own], k), (k[own].astype(np.int64) * 4 + flag).astype("<i4")), 1))
            yield _records(parts, slices, data)

    return parse


def _dealt(doc: np.ndarray, flagged: np.ndarray, routes: _Routes) -> pa.RecordBatch:
    """Flagged boundaries (number * 4 + flag) -> a record for each group of documents."""
    order = np.lexsort((flagged, doc))
    doc, flagged = doc[order], flagged[order]
    parts, slices, data = [], [], []
    for part, which, own in routes.groups(textkit.mix(doc.astype(np.uint64))):
        parts.append(part)
        slices.append(which)
        data.append(_pack(*_places(doc[own], own), flagged[own].astype("<i4")))
    return _records(parts, slices, data)


def _judge(routes: _Routes):
    """Records of fingerprints -> boundaries that are repeats, and those to be solved, dealt by document."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_slice(batches):
            cores, contexts, docs, ks = [], [], [], []
            for raw in held:
                if raw[0]:
                    step, count, flagged = _unpack(zlib.decompress(raw[1:]), "<i8", "<u4", "<i4")
                    yield _dealt(np.repeat(np.cumsum(step), count), flagged, routes)
                else:
                    core, context, step, count, k = _unpack(raw[1:], "u1", "u1", "<i8", "<u4", "<i4")
                    cores.append(_from_six(core)), contexts.append(_from_six(context))
                    docs.append(np.repeat(np.cumsum(step), count)), ks.append(k)
            if not cores:
                continue
            core, context, doc, k = (np.concatenate(x) for x in (cores, contexts, docs, ks))
            del held, cores, contexts, docs, ks
            order = np.lexsort((k, doc, context, core))
            core, context, doc, k = core[order], context[order], doc[order], k[order]
            new_core = np.ones(len(core), bool)
            new_core[1:] = core[1:] != core[:-1]
            new_context = new_core.copy()
            new_context[1:] |= context[1:] != context[:-1]
            several = np.add.reduceat(new_context, np.flatnonzero(new_core))[np.cumsum(new_core) - 1]
            flagged = ~new_context | (several > 1)
            flag = np.where(new_context, np.where(several > routes.hot, _APART, _SOLVE), _REPEAT)
            yield _dealt(doc[flagged], k[flagged].astype(np.int64) * 4 + flag[flagged], routes)

    return judge


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flagged boundaries of documents -> (doc_id, full, solve): numbers of repeats; of those to be solved, twice their number and whether their windows go apart."""
    for held in _by_slice(batches):
        docs, flags = [], []
        for raw in held:
            step, count, flagged = _unpack(raw, "<i8", "<u4", "<i4")
            docs.append(np.repeat(np.cumsum(step), count)), flags.append(flagged)
        doc, flagged = np.concatenate(docs), np.concatenate(flags)
        order = np.lexsort((flagged, doc))
        doc, k, flag = doc[order], flagged[order] >> 2, flagged[order] & 3
        solve = flag > 0
        ids = np.unique(doc)
        for a in range(0, len(ids), 10_000):
            part = ids[a : a + 10_000]
            own = slice(np.searchsorted(doc, part[0]), np.searchsorted(doc, part[-1], "right"))
            d, x, s = doc[own], k[own], solve[own]
            yield pa.RecordBatch.from_arrays(_lists(part, (d[~s], x[~s]), (d[s], x[s] * 2 + (flag[own][s] == _APART))), ["doc_id", "full", "solve"])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each) of a list column; null counts as empty."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), sizes)


def _windows(buf: np.ndarray, p: Parse, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two fingerprints, start, text) of every window of some boundaries."""
    n = p.hi[pick] - p.lo[pick] + 1
    at = np.repeat(p.lo[pick] - np.cumsum(n) + n, n) + np.arange(n.sum())
    one, two = (textkit.spans(textkit.prefix(buf, table), at, at + WIDTH) for table in (textkit._BYTE, _BYTE_TWO))
    return one, two, at, np.repeat(p.text[pick], n)


def _contexts(routes: _Routes):
    """(doc_id, text, solve) -> records: contexts of boundaries to be solved (first byte 0), windows that go apart (1), windows that are repeats (2)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_batches(batches, CONTEXTS):
            ids = batch.column(0).to_numpy()
            buf, offs = textkit.flat(batch.column(1))
            k, row = _numbers(batch.column(2))
            k, far = k >> 1, (k & 1).astype(bool)
            core, doc, at, lo, hi, start = ([] for _ in range(6))
            loose: list[tuple] = []
            for i, j in textkit.chunks(offs, STEP):
                part = buf[offs[i] : offs[j]]
                p = Parse(part, offs[i : j + 1] - offs[i])
                mine = (row >= i) & (row < j)
                place = np.searchsorted(p.text, row[mine] - i) + k[mine]
                pick = np.sort(place[~far[mine]])
                core.append(p.core[pick]), doc.append(ids[i + p.text[pick]])
                for out, x in ((at, p.at), (lo, p.lo), (hi, p.hi)):
                    out.append(x[pick] + offs[i])
                start.append(offs[i + p.text[pick]])
                if far[mine].any():
                    one, two, first, text = _windows(part, p, np.sort(place[far[mine]]))
                    loose.append((one, two, ids[i + text], first - (offs[i + text] - offs[i])))
            parts, slices, data = [], [], []
            if loose:
                one, two, own_doc, first = (np.concatenate(x) for x in zip(*loose))
                sent, again = _folded(one, two)
                for part, which, own in routes.groups(one[sent]):
                    parts.append(part)
                    slices.append(which)
                    data.append(b"\1" + _pack(one[sent[own]], two[sent[own]], own_doc[sent[own]], first[sent[own]].astype("<i4")))
                if len(again):
                    parts.append(int(routes.key[int(ids[0]) % routes.partitions]))
                    slices.append(0)
                    data.append(b"\2" + zlib.compress(_pack(own_doc[again], first[again].astype("<i4")), 1))
            core, doc, at, lo, hi, start = (np.concatenate(x) for x in (core, doc, at, lo, hi, start))
            for part, which, own in routes.groups(core):
                size = hi[own] + WIDTH - lo[own]
                ends = np.cumsum(size)
                text = buf[np.repeat(lo[own] - ends + size, size) + np.arange(ends[-1])]
                parts.append(part)
                slices.append(which)
                small = _pack((at - lo)[own].astype(np.uint8), (at - hi)[own].astype(np.int16), *_places(doc[own], own), (at - start)[own].astype("<i4"))
                data.append(b"\0" + _pack(np.frombuffer(zlib.compress(text.tobytes(), 1), np.uint8), np.frombuffer(small, np.uint8), _six(core[own])))
            yield _records(parts, slices, data)

    return send


def _ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte rows -> (each row's rank among the distinct ones, common prefix of each rank with the one before)."""
    wide = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
    distinct, rank = np.unique(wide, return_inverse=True)
    table = distinct.view(np.uint8).reshape(len(distinct), -1)
    differ = table[1:] != table[:-1]
    common_ = np.zeros(len(distinct), np.int64)
    common_[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return rank, common_


def solve_windows(text: np.ndarray, size: np.ndarray, left: np.ndarray, most: np.ndarray, least: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in corpus order -> (context, a): windows that an earlier context holds too, by their distance a to the trigger.

    text: all contexts in a row; left: bytes before the trigger; windows have a from least to most.
    """
    start = np.cumsum(size) - size
    reach = max(1, int(most.max()))
    phrase = np.zeros((len(size), reach), np.uint8)
    after = np.zeros((len(size), width), np.uint8)
    for k in range(0, len(size), 2048):  # a block of rows at a time, as indices take eight times the bytes
        own = slice(k, k + 2048)
        trigger, room = (start + left)[own, None], (size - left)[own, None]
        step = np.arange(reach)
        phrase[own] = np.where(step < left[own, None], text[np.maximum(trigger - 1 - step, 0)], 0)
        step = np.arange(width)
        after[own] = np.where(step < room, text[np.minimum(trigger + step, len(text) - 1)], 0)
    phrase_rank, phrase_common = _ranked(phrase)
    after_rank, after_common = _ranked(after)
    found_row, found_a = [], []
    for a in range(int(least.min()), int(most.max()) + 1):
        rows = np.flatnonzero((least <= a) & (a <= most))
        if len(rows) < 2:
            continue
        suffix = np.cumsum(phrase_common < a)[phrase_rank[rows]]
        follow = np.cumsum(after_common < width - a)[after_rank[rows]]
        key = suffix * (len(after_common) + 1) + follow
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(order), bool)
        again[1:] = key[order[1:]] == key[order[:-1]]
        # a context may hold a window of the same key only once, so ties are ordered by context
        hit = rows[order[again]]
        found_row.append(hit)
        found_a.append(np.full(len(hit), a))
    if not found_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_row), np.concatenate(found_a)


def _runs(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Windows that are repeats -> (doc_id, first, last): runs of their starts."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1))
    first, last = np.flatnonzero(fresh), np.append(np.flatnonzero(fresh)[1:], len(start)) - 1
    return pa.RecordBatch.from_arrays(_lists(np.unique(doc), (doc[first], start[first]), (doc[first], start[last])), ["doc_id", "first", "last"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts and loose windows -> (doc_id, first, last): runs of window starts that are repeats."""
    for held in _by_slice(batches):
        got: list[list] = [[] for _ in range(7)]
        loose: list[list] = []
        for raw in held:
            if raw[0] == 2:
                doc, start = _unpack(zlib.decompress(raw[1:]), "<i8", "<i4")
                yield _runs(doc, start.astype(np.int64))
                continue
            if raw[0] == 1:
                loose.append(_unpack(raw[1:], "<u8", "<u8", "<i8", "<i4"))
                continue
            packed, small, core = _unpack(raw[1:], "u1", "u1", "u1")
            left, least, step, count, at = _unpack(small.tobytes(), "u1", "<i2", "<i8", "<u4", "<i4")
            doc = np.repeat(np.cumsum(step), count)
            left, least = left.astype(np.int64), least.astype(np.int64)
            size = left - least + WIDTH
            for out, x in zip(got, (np.frombuffer(zlib.decompress(packed.tobytes()), np.uint8), _from_six(core), doc, at.astype(np.int64), left, least, size)):
                out.append(x)
        del held
        if loose:
            one, two, doc, start = (np.concatenate(x) for x in zip(*loose))
            order = np.lexsort((start, doc, two, one))
            one, two, doc, start = one[order], two[order], doc[order], start[order].astype(np.int64)
            again = np.zeros(len(one), bool)
            again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            if again.any():
                yield _runs(doc[again], start[again])
        if got[0]:
            yield from _solved(*(np.concatenate(x) for x in got))


def _solved(text, core, doc, at, left, least, size) -> Iterator[pa.RecordBatch]:
    """The contexts of a slice, some cores at a time."""
    start = np.cumsum(size) - size
    order = np.lexsort((at, doc, core))
    cuts = np.flatnonzero(np.append(True, core[order[1:]] != core[order[:-1]]))
    a = 0
    while a < len(order):
        k = max(np.searchsorted(cuts, a + SORTED, "right") - 1, np.searchsorted(cuts, a) + 1)
        b = int(cuts[k]) if k < len(cuts) and cuts[k] > a else len(order)
        own = order[a:b]
        own = own[np.lexsort((at[own], doc[own]))]
        ends = np.cumsum(size[own])
        piece = text[np.repeat(start[own] - ends + size[own], size[own]) + np.arange(ends[-1])]
        row, back = solve_windows(piece, size[own], left[own], left[own], least[own])
        if len(row):
            yield _runs(doc[own[row]], at[own[row]] - back)
        a = b


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, full, first, last) -> (doc_id, n_bytes, spans, kept)."""
    for whole in batches:
        _, cuts = textkit.flat(whole.column(1))
        for a, b in textkit.chunks(cuts, STEP):
            batch = whole.slice(a, b - a)
            buf, offs = textkit.flat(batch.column(1))
            k, row = _numbers(batch.column(2))
            first, of = _numbers(batch.column(3))
            last, _ = _numbers(batch.column(4))
            cover = np.zeros(len(buf) + 1, np.int32)
            np.add.at(cover, first + offs[of], 1)
            np.add.at(cover, last + offs[of] + WIDTH, -1)
            if len(k):
                p = Parse(buf, offs)
                pick = np.searchsorted(p.text, row) + k
                np.add.at(cover, p.lo[pick], 1)
                np.add.at(cover, p.hi[pick] + WIDTH, -1)
            gone = np.cumsum(cover[:-1]) > 0
            edge = np.zeros(len(buf) + 2, bool)
            edge[1:-1] = gone
            starts = np.flatnonzero(edge[1:-1] & ~edge[:-2])
            ends = np.flatnonzero(edge[1:-1] & ~edge[2:]) + 1
            inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(buf))]
            inner = np.unique(inner[gone[inner] & gone[inner - 1]]) if len(inner) else inner
            starts, ends = np.sort(np.append(starts, inner)), np.sort(np.append(ends, inner))
            text = np.searchsorted(offs, starts, "right") - 1
            sizes = np.diff(offs)
            listed = np.searchsorted(text, np.arange(len(sizes) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array((starts - offs[text]).astype(np.int32)), pa.array((ends - offs[text]).astype(np.int32))], ["start", "end"])
            kept = [buf[i:j][~gone[i:j]].tobytes() for i, j in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(listed), spans), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def _unique_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows with an id of their own that keeps the order, and the doc_id of each such id if they differ."""
    rows = docs.select("doc_id", "text")
    if rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL OR doc_id < 0").isEmpty():
        return rows, None
    # ranges in order, each sorted, are numbered upwards by a partition's number and a row's place; written once, so numbers stand
    spread = rows.repartitionByRange(common.partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    numbered = common.stored(spread.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
    return numbered.select(F.col("row").alias("doc_id"), "text"), numbered.select("row", "doc_id")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, spans (removed byte ranges), kept (the rest, binary)."""
    spark = docs.sparkSession
    rows, names = _unique_ids(docs)
    n = common.partitions(spark)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = _Routes(spark, n, max(1, -(-size // (n * SLICE_BYTES))))
    hot = hot_cores(rows, size)
    sent = rows.mapInArrow(_parser(routes, hot), RECORD)
    judged = routes.exchanged(sent).mapInArrow(_judge(routes), RECORD)
    flags = routes.exchanged(judged).mapInArrow(_gather, "doc_id long, full array<int>, solve array<int>")
    flags = common.stored(flags, "repeat-flags")
    texts = rows.where("doc_id IS NOT NULL").repartition(n, "doc_id")  # one exchange, read by both joins
    edges = texts.join(flags.where(F.size("solve") > 0).select("doc_id", "solve"), "doc_id").select("doc_id", "text", "solve")
    solved = routes.exchanged(edges.mapInArrow(_contexts(routes), RECORD)).mapInArrow(_solve, "doc_id long, first array<int>, last array<int>")
    runs = solved.groupBy("doc_id").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("last")).alias("last"))
    both = texts.join(flags.select("doc_id", "full"), "doc_id", "left").join(runs, "doc_id", "left")
    out = both.select("doc_id", "text", "full", "first", "last").mapInArrow(_finish, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    if names is None:
        return out
    return out.withColumnRenamed("doc_id", "row").join(names, "row").select("doc_id", "n_bytes", "spans", "kept")


def op7_repeated_substrings(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: All windows (two hex digits a byte, cut from pieces as a cut reads its text from the start), the first of each aside; what they cover.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT r, doc_id, h, (len(h) // 2)::BIGINT AS n FROM docs),
parts AS (SELECT r, n, q, substr(h, 2 * q + 1, 600) AS part FROM (SELECT r, n, h, unnest(range(0, n - 99, 200)) AS q FROM sized WHERE n >= 100)),
starts AS (SELECT r, q + p AS p, substr(part, 2 * p + 1, 200) AS s FROM (SELECT r, q, part, unnest(range(least(200, n - 99 - q))) AS p FROM parts)),
seen AS (SELECT r, p FROM starts QUALIFY row_number() OVER (PARTITION BY s ORDER BY r, p) > 1),
marked AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM seen),
numbered AS (SELECT r, p, sum((before IS NULL OR p > before + 100)::INT) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT r, run, min(p) AS lo, max(p) + 100 AS hi FROM numbered GROUP BY r, run),
gaps AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since FROM runs),
cut AS (SELECT r, count(*) AS spans, sum(hi - lo) AS removed, max(hi) AS last FROM runs GROUP BY r),
left_ AS (SELECT r, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS head FROM gaps JOIN sized USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE coalesce(head, '') || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM sized LEFT JOIN cut USING (r) LEFT JOIN left_ USING (r)
"""
