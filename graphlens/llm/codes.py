"""Vector code compression: product codes whose codebooks come from exact k-means by exponion search.

Components become integers (floor of SCALE times the component), vectors are cut
into PARTS equal parts, and each part position has a codebook of ENTRIES entries.
A round assigns every part to its nearest entry and replaces each entry by the
floored mean of its parts. All distances are exact integers.

A part's search starts at the entry it had before. With D its distance to that
entry a, any entry farther than 2 D from a is farther from the part than a is, so
only the head of a's list of entries, sorted by distance from a, is scanned: those
with squared distance of at most 4 D^2. An equal distance passes that test, so ties
go to the lower index exactly.

Each round is one pass that reads the rows' integers and codes, and writes the new
codes with the sums of each Arrow batch; the sums are added up by slot and only
PARTS x ENTRIES entries reach the driver.

Defined cases: rows whose vector is null, empty or holds null or non-finite
components take no part and are not returned; neither are vectors of another
length than most (the greater length among equally many), or all of them if that
length isn't divisible by PARTS; of rows with equal vec_id the lesser vector comes first where
the first entries are chosen, and a null vec_id comes last; with fewer rows than
ENTRIES there are so many entries; a component of a magnitude over 2**14 raises an
error, as its distances would leave 64 bits; null labels count as one label; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm import common

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Integers of at most this magnitude keep squared distances of parts, and their sums, in 64 bits.
LARGEST = SCALE << 14
ROW = "vec_id long, label string, ints binary, codes binary, sums array<long>"


def exponion(x: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entry, squared distance, distances computed) of integer rows, each searched from its start entry; ties go to the lower index."""
    best = start.astype(np.int64)
    error = ((x - book[best]) ** 2).sum(1)
    between = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    done = len(x)
    for a in np.unique(start).tolist():
        others = np.argsort(between[a], kind="stable")
        others = others[others != a]
        rows = np.flatnonzero(start == a)
        reach = np.searchsorted(between[a][others], 4 * error[rows], "right")  # entries of the list inside the radius
        order = np.argsort(-reach, kind="stable")
        rows, reach = rows[order], -reach[order]
        for k, entry in enumerate(others.tolist()):
            own = rows[: np.searchsorted(reach, -k, "left")]  # the rows that scan beyond k entries
            if not len(own):
                break
            done += len(own)
            far = ((x[own] - book[entry]) ** 2).sum(1)
            nearer = (far < error[own]) | ((far == error[own]) & (entry < best[own]))
            best[own[nearer]], error[own[nearer]] = entry, far[nearer]
    return best, error, done


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, integer vectors) of a list column: those of length dim with finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1)
    rows = np.flatnonzero(sizes == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.int64)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(1)
    x = np.floor(SCALE * x[good])
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component's magnitude is over {LARGEST // SCALE}; exact distances would leave 64 bits")
    return rows[good], x.astype(np.int64)


def _reader(dim: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column(2), dim)
            take = pa.array(rows, pa.int64())
            ints = pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())
            codes = pa.array([bytes(PARTS)] * len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), ints, codes, pa.nulls(len(rows), pa.list_(pa.int64()))], ["vec_id", "label", "ints", "codes", "sums"])

    return read


def _parts(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, PARTS, width) integers and (rows, PARTS) codes of a batch."""
    n = batch.num_rows
    ints = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").astype(np.int64).reshape(n, PARTS, width)
    return ints, np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, PARTS)


def _round(books: np.ndarray):
    """Rows with the codes of this round; the first row of a batch carries the batch's count and sums of each entry."""
    parts, entries, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, before = _parts(batch, width)
            codes = np.empty_like(before)
            sums = np.zeros((parts, entries, 1 + width), np.int64)
            for p in range(parts):
                own, _, _ = exponion(x[:, p], books[p], before[:, p])
                codes[:, p] = own
                sums[p, :, 0] = np.bincount(own, minlength=entries)
                order = np.argsort(own, kind="stable")
                used = np.flatnonzero(sums[p, :, 0])
                sums[p, used, 1:] = np.add.reduceat(x[order, p], (np.cumsum(sums[p, :, 0]) - sums[p, :, 0])[used])
            carried = pa.array([sums.ravel().tolist()] + [None] * (batch.num_rows - 1), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()), carried], ["vec_id", "label", "ints", "codes", "sums"])

    return assign


def _coder(books: np.ndarray):
    """(vec_id, label, code, error) by the final books."""
    width = books.shape[2]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, before = _parts(batch, width)
            found = [exponion(x[:, p], books[p], before[:, p]) for p in range(PARTS)]
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([c.tobytes().hex() for c in codes]), pa.array(sum(f[1] for f in found))], ["vec_id", "label", "code", "error"])

    return code


def fingerprint(books: np.ndarray) -> str:
    """sha256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame | None, np.ndarray]:
    """(vec_id, embedding, label) -> (the written rows with their last codes, books (PARTS, entries, width)); None where no row is usable."""
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").where("size(embedding) > 0")
    finite = rows.where(F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))))
    most = finite.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None or most["dim"] % PARTS:
        return None, np.zeros((PARTS, 0, 0), np.int64)
    dim = most["dim"]
    now = common.stored(rows.mapInArrow(_reader(dim), ROW), "vector-codes")
    first = finite.where(F.size("embedding") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").toArrow()
    _, x = integers(first.column(0), dim)
    books = x.reshape(len(x), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        old, now = now, common.stored(now.mapInArrow(_round(books), ROW), "vector-codes")
        common.dropped(old)
        slots = now.where("sums IS NOT NULL").select(F.posexplode("sums").alias("slot", "held")).groupBy("slot").agg(F.sum("held").alias("held"))
        sums = np.zeros(books.shape[0] * books.shape[1] * (books.shape[2] + 1), np.int64)
        for slot, held in slots.collect():  # one for each component of each entry
            sums[slot] = held
        sums = sums.reshape(*books.shape[:2], -1)
        count = sums[:, :, :1]
        books = np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)  # // goes down
    return now, books


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, embedding, label) -> (vec_id, label, code, error of every usable row; the books)."""
    rows, books = train(vectors, rounds)
    if rows is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, label string, code string, error long"), books
    return rows.mapInArrow(_coder(books), "vec_id long, label string, code string, error long"), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(common.table(spark, sf_dir, "embeddings"))
    coded = common.stored(coded.select("vec_id", "code", "error", F.coalesce("label", F.lit("")).alias("label"), F.col("label").isNull().alias("none")), "vector-codes")
    sums = common.stored(coded.groupBy("label", "none").agg(F.sum("error").alias("label_error")), "label-errors")
    rows = common.matched(coded, sums, ["label", "none"], "code")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Plain k-means over all entries, a chain of steps for each round."""
    size = f"CAST(len(embedding) / {PARTS} AS BIGINT)"
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v::DOUBLE))) = 0),
parts AS MATERIALIZED (SELECT r, p, x[p * w + 1 : (p + 1) * w] AS x FROM (SELECT r, x, {size.replace("embedding", "x")} AS w FROM kept), range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES})"""
    ]
    near = """near{k} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := d, e := e)) AS m FROM (
    SELECT r, parts.p AS p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN book{k} b ON b.p = parts.p)
  GROUP BY r, p)"""
    for k in range(ROUNDS):
        steps.append(near.format(k=k))
        steps.append(
            f"""sums{k} AS MATERIALIZED (
  SELECT p, e, i, sum(v)::BIGINT AS s, count(*) AS n FROM (
    SELECT p, m.e AS e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM near{k} JOIN parts USING (r, p)) GROUP BY p, e, i),
means{k} AS MATERIALIZED (SELECT p, e, list((s - (((s % n) + n) % n)) // n ORDER BY i) AS c FROM sums{k} GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m ON m.p = b.p AND m.e = b.e)"""
        )
    steps.append(near.format(k=ROUNDS))
    steps.append(
        f"""coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r),
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), sha"""
    )
    return ",\n".join(steps)


ORACLE = _oracle()
