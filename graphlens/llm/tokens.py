"""Whole-text tokenizing with a cache of pieces, token attribution, and token shards.

The byte-level tokenizer splits a text into pre-tokens and encodes each on its
own. pieces() cuts texts only where the tokenizer surely starts a new
pre-token, so encoding the distinct pieces of many texts once and putting
their ids back in place gives the ids of the whole texts.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm import common, textkit
from graphlens.llm.wavelet import WaveletMatrix

END_ID = 2
#: Tokens after which a shard is closed (a document is never cut).
SHARD_TOKENS = 1 << 22
#: Distinct pieces that a worker remembers before it starts over.
CACHE_PIECES = 1_500_000
#: Distinct pieces that are given to the library as one text.
JOINED = 64
STEP = 1 << 22

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 blank, 2 letter, 3 digit, 4 mark; ASCII alone
_KIND[[0x20, 9, 10, 11, 12, 13]] = 1
for _b in range(0x21, 0x7F):
    _KIND[_b] = 2 if chr(_b).isalpha() else 3 if chr(_b).isdigit() else 4


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def literals(buf: np.ndarray, offs: np.ndarray, added: list[bytes]) -> np.ndarray:
    """(start, end) of each literal of added tokens in the texts, leftmost first and then longest."""
    raw = buf.tobytes()
    if not any(x in raw for x in added):
        return np.zeros((0, 2), np.int64)
    either = b"|".join(re.escape(x) for x in sorted(added, key=len, reverse=True))
    at = np.array([m.start() for m in re.finditer(b"(?=" + either + b")", raw)], np.int64)
    found = []
    for k in np.unique(np.searchsorted(offs, at, "right") - 1).tolist():
        lo = int(offs[k])
        found += [(lo + m.start(), lo + m.end()) for m in re.finditer(either, raw[lo : offs[k + 1]])]
    return np.array(found, np.int64).reshape(-1, 2)


def pieces(buf: np.ndarray, offs: np.ndarray, added: list[bytes] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(starts, first): where pieces start, and for each text the index of its first piece, with the total last.

    Cuts stand before a space that is followed by an ASCII non-blank, after an
    ASCII non-blank before an ASCII blank, after a letter before a digit or
    mark, and after a mark (not an apostrophe) before a letter or digit. A
    literal of an added token is one piece, and what stands on either side of it
    is cut as if it were a text of its own.
    """
    n = len(buf)
    held = literals(buf, offs, added)
    kind = _KIND[buf]
    cut = np.zeros(n + 1, bool)
    cut[:-1][1:] |= (kind[:-1] >= 2) & (kind[1:] == 1)
    cut[:-1][1:] |= (kind[:-1] == 2) & (kind[1:] >= 3)
    cut[:-1][1:] |= (kind[:-1] == 4) & (buf[:-1] != 0x27) & ((kind[1:] == 2) | (kind[1:] == 3))
    ahead = (buf[:-1] == 0x20) & (kind[1:] >= 2)
    ends = np.concatenate([offs, held[:, 0]])
    ahead[ends[(ends > 0) & (ends < n)] - 1] = False  # a text's last blanks have nothing behind them
    cut[: n - 1] |= ahead
    for a, b in held.tolist():
        cut[a:b] = False
    cut[held.ravel()] = True
    cut[offs] = True
    starts = np.flatnonzero(cut[:n])
    return starts, np.searchsorted(starts, offs)


def _overlap(a: bytes, b: bytes) -> bool:
    """Whether b can begin inside an occurrence of a, past its first byte."""
    return any(b.startswith(a[k:]) or a[k:].startswith(b) for k in range(1, len(a)))


class Encoder:
    """Encodes batches of whole texts; one for each worker and vocabulary."""

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = {i: x.content.encode() for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        if any(x.lstrip or x.rstrip or x.single_word for x in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that depend on what stands beside them are not supported")
        self.mark = next((i for i, x in self.added.items() if not any(_overlap(x, y) or _overlap(y, x) for y in self.added.values())), None)
        self.forget()

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.entry = np.zeros(0, np.int64)  # of each key
        self.begin = np.zeros(1, np.int64)  # of each entry's ids, with the total last
        self.ids = np.zeros(0, np.uint32)

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id stands for."""
        out = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = len(self.added.get(i, token))
        return out

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids, sizes = self._encoded(texts)
        entry = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(sizes))
        self.begin = np.concatenate([self.begin, np.cumsum(sizes) + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys = np.concatenate([self.keys, keys])[order]
        self.entry = np.concatenate([self.entry, entry])[order]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each).

        The library cuts a text at an added token's literal, so texts are encoded
        a few at a time with that literal between them; its id tells them apart.
        """
        if self.mark is not None:
            own, between = self.mark, self.added[self.mark].decode()
            some = self.tokenizer.encode_batch_fast([between.join(texts[k : k + JOINED]) + between for k in range(0, len(texts), JOINED)], add_special_tokens=False)
            ids = np.array(list(chain.from_iterable(e.ids for e in some)), np.uint32)
            ends = np.flatnonzero(ids == own)
            if len(ends) == len(texts):  # else a text holds that literal
                return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
        each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(each)), np.uint32), np.array([len(x) for x in each], np.int64)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        starts, first = pieces(buf, offs, list(self.added.values()))
        ends = np.append(starts[1:], len(buf))
        keys, at, which = np.unique(textkit.spans(textkit.prefix(buf), starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self.forget()
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw = buf.tobytes()
            self._learn(keys[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
        entry = self.entry[np.searchsorted(self.keys, keys)][which]
        sizes = (self.begin[1:] - self.begin[:-1])[entry]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.begin[entry] - total[:-1], sizes) + np.arange(total[-1])]
        return ids, np.diff(total[first])


def _steps(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offs = textkit.flat(column)
    for i, j in textkit.chunks(offs, STEP):
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


# --- attribution of tokens to sections ---


def attribute_tokens(docs: DataFrame, spans: str | None = None, rule: str = "first", path: str | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, section, start_char, end_char, n_tokens, n_crossing, share.

    A section is a half-open range of characters. spans names a column
    array<struct<start:int,end:int>> of them (they may overlap or leave gaps);
    by default each line, with its line feed, is a section. Texts are encoded
    whole, once; a token's characters come from the bytes that its id stands
    for. A token that crosses a section's border counts for the section of its
    first character (rule "first"), of its last character ("last"), or for
    each section ("all"); share adds up the parts of tokens by bytes, whatever
    the rule, and n_crossing counts the section's tokens that stick out of it.

    Null and empty texts have no sections (their given spans have 0 tokens);
    null spans count as none; repeated rows are each answered; an empty table
    gives no rows; other columns are ignored.
    """
    path = path or default_path()
    if rule not in ("first", "last", "all"):
        raise ValueError("rule is first, last or all")

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        width = encoder.byte_lengths()
        for batch in batches:
            given = batch.column(2).to_pylist() if spans else None
            for i, j, buf, offs in _steps(batch.column(1)):
                ids, count = encoder.encode(buf, offs)
                cuts = np.concatenate([[0], np.cumsum(width[ids])])  # token borders: the texts are covered exactly
                lead = np.flatnonzero((buf & 0xC0) != 0x80)  # byte of each character
                first_char = np.searchsorted(lead, offs)
                if spans:
                    of, lo, hi = [], [], []
                    for k in range(i, j):
                        size = first_char[k - i + 1] - first_char[k - i]
                        for s in given[k] or []:
                            a = min(max(0, s["start"]), size)
                            of.append(k - i), lo.append(a), hi.append(max(a, min(s["end"], size)))
                    of, lo, hi = (np.array(x, np.int64) for x in (of, lo, hi))
                    lead_ = np.append(lead, len(buf))
                    b_lo, b_hi = lead_[first_char[of] + lo], lead_[first_char[of] + hi]
                else:
                    line = np.zeros(len(buf) + 1, bool)
                    line[1:] = buf == 10
                    line[offs] = True
                    b_lo = np.flatnonzero(line[: len(buf)])
                    b_hi = np.append(b_lo[1:], len(buf))
                    of = np.searchsorted(offs, b_lo, "right") - 1
                    lo, hi = (np.searchsorted(lead, b) - first_char[of] for b in (b_lo, b_hi))
                a, b = np.searchsorted(cuts, b_lo, "right") - 1, np.searchsorted(cuts, b_hi, "left")  # tokens that touch: a to b
                some = b_hi > b_lo
                a, b = np.where(some, a, 0), np.where(some, b, 0)
                cross_lo, cross_hi = some & (cuts[a] < b_lo), some & (cuts[b] > b_hi)
                # borders inside a character: the token begins in the section that holds the character
                n = {"first": b - a - cross_lo, "last": b - a - cross_hi, "all": b - a}[rule]
                crossing = np.where(b - a == 1, cross_lo | cross_hi, cross_lo.astype(int) + cross_hi)
                whole = np.maximum(np.diff(cuts), 1)
                share = (b - a).astype(float)
                one = len(whole) - 1
                share -= np.where(cross_lo, (b_lo - cuts[a]) / whole[np.minimum(a, one)], 0) if one >= 0 else 0
                share -= np.where(cross_hi, (cuts[b] - b_hi) / whole[np.maximum(b - 1, 0)], 0) if one >= 0 else 0
                section = np.arange(len(of)) - np.searchsorted(of, of)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of + i)), pa.array(section.astype(np.int32)), pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(crossing.astype(np.int64)), pa.array(share)],
                    ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "share"],
                )

    columns = ["doc_id", "text", spans] if spans else ["doc_id", "text"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*columns).mapInArrow(attribute, f"doc_id {kind}, section int, start_char long, end_char long, n_tokens long, n_crossing long, share double")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return attribute_tokens(common.table(spark, sf_dir, "documents"))


# --- token shards ---

SHARD_SCHEMA = "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<long>, planes binary"


def _writer(path: str, end_id: int, limit: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = Encoder.at(path), TaskContext.get().partitionId(), 0
        ids, lengths, held, total = [], [], [], 0

        def shard() -> pa.RecordBatch:
            planes = WaveletMatrix.build(np.concatenate(held)).to_bytes()
            arrays = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([total], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([planes], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["part", "seq", "n_tokens", "doc_ids", "lengths", "planes"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, buf, offs in _steps(batch.column(1)):
                found, count = encoder.encode(buf, offs)
                ends = np.cumsum(count)
                held.append(np.insert(found.astype(np.uint16 if encoder.tokenizer.get_vocab_size() <= 65536 else np.uint32), ends, end_id))
                ids += names[i:j]
                lengths += (count + 1).tolist()
                total += int(ends[-1]) + len(count)
                if total >= limit:
                    yield shard()
                    ids, lengths, held, total, seq = [], [], [], 0, seq + 1
        if held:
            yield shard()

    return write


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID, limit: int = SHARD_TOKENS) -> DataFrame:
    """Encode whole texts, each followed by end_id, into shards in ascending doc_id order, written as files; returns them as read back.

    A row is a shard: its documents' ids and lengths, and the wavelet matrix of
    its tokens. Order: part, then seq. Null texts count as empty; a null doc_id
    comes first; rows of one doc_id are ordered by size, then text; an empty table gives
    no shards; other columns are ignored.
    """
    # rows of one doc_id (or of none) are dealt by their text's size too, so they fill several partitions
    order = ["doc_id", F.octet_length("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(common.partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text")
    return common.stored(ordered.mapInArrow(_writer(path or default_path(), end_id, limit), SHARD_SCHEMA), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """shards -> doc_id, start, n_tokens, ids_crc32, from the shards' tokens."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = WaveletMatrix.from_bytes(batch.column(5)[k].as_buffer()).tokens().astype("<u4")
                docs, lengths = batch.column(3)[k].values, np.asarray(batch.column(4)[k].values)
                ends = np.cumsum(lengths)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column(0)[k], len(crc)), pa.repeat(batch.column(1)[k], len(crc)), docs, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    found = shards.mapInArrow(read, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # tokens of the parts before (a row for each part), then of the part's shards before
    before = lambda order, *by: F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before("part", F.lit(0)).alias("lead"))
    bases = shards.select("part", "seq", before("seq", "part").alias("inside_part")).join(parts, "part").select("part", "seq", (F.col("lead") + F.col("inside_part")).alias("base"))
    return found.join(common.small(bases), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def count_tokens(shards: DataFrame, ids: list[int]) -> DataFrame:
    """(token, n): occurrences of some ids in all shards, by rank alone; an id that occurs nowhere has 0. No shards, no rows."""
    ids = sorted(set(ids))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                matrix = WaveletMatrix.from_bytes(batch.column(0)[k].as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([matrix.count(t) for t in ids], pa.int64())], ["token", "n"])

    return shards.select("planes").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """(doc_id, at): every place where an id stands, counted from its document's first token."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at = WaveletMatrix.from_bytes(batch.column(2)[k].as_buffer()).occurrences(token)
                ends = np.cumsum(np.asarray(batch.column(1)[k].values))
                which = np.searchsorted(ends, at, "right")
                begin = np.concatenate([[0], ends])[which]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values.take(pa.array(which)), pa.array(at - begin)], ["doc_id", "at"])

    return shards.select("doc_ids", "lengths", "planes").mapInArrow(find, "doc_id long, at long")


def op8_token_shards(spark, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(common.table(spark, sf_dir, "documents")))
