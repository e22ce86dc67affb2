"""Nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one from each of
several codebooks. Codebooks start as residual k-means on a bounded sample and
are refined by least squares on beam-searched codes. Every vector is encoded by
beam search; the index holds its codes, the norm of its reconstruction and
itself.

1. Queries and codes meet in a grid of blocks, dealt by a hash of vec_id. A query
   scores all codes by lookup tables (with the stored norms, for cosine and
   euclidean nearness) and each block gives its best, the smaller vec_id first
   among equals. No vector of the base is moved here.
2. The best of all blocks are the query's shortlist. They meet the base's vectors
   in blocks again, each query's vector going once to every block that has some of
   its shortlist, and are reranked by the exact measure in double precision.

Of vectors that are equal only the TOP + 1 of the smallest ids are searched, as no
other can be in a result; so a vector that a third of the rows hold neither fills
a shortlist nor a block.

Defined cases: vectors that are null, empty, zero, of another length than most, or
hold null or non-finite components take no part; rows of one vec_id are never
each other's neighbours, and a repeated neighbour counts once; ties go to the
smaller vec_id; rows with a null vec_id take no part; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm import common

TOP = 20
BOOKS, WORDS, BEAM = 16, 256, 4
#: Rows that codebooks are trained on, about.
TRAIN_ROWS = 12288
#: Candidates that are reranked exactly, for each query.
SHORTLIST = 1024
#: Rows of a block of codes or vectors; blocks at least; queries of a block; shortlist rows of a block.
BLOCK, LEAST_BLOCKS, QUERY_BLOCK, PAIR_BLOCK = 65536, 12, 4096, 1 << 18
METRICS = ("inner", "cosine", "euclidean")
INDEX = "vec_id long, codes binary, norm double, vector binary"


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): the usable vectors of a list column, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1)
    rows = np.flatnonzero(sizes == dim)
    if not len(rows) or not dim:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


class Quantizer:
    """books: (books, words, dim)."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.single = books.astype(np.float32)
        self.norms = (self.single**2).sum(2)

    def __reduce__(self):
        return Quantizer, (self.books,)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (rows, books) by beam search over the books in order."""
        return np.concatenate([self._encode(x[k : k + 1024], beam) for k in range(0, len(x), 1024)]) if len(x) else np.zeros((0, len(self.books)), np.uint8)

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        books, words, dim = self.books.shape
        n = len(x)
        rest = x.astype(np.float32)[:, None, :]  # what each kept sum leaves of its vector
        error = np.zeros((n, 1), np.float32)  # squared error less |x|^2
        codes = np.zeros((n, 1, 0), np.uint8)
        own = np.arange(n)
        for book, norm in zip(self.single, self.norms):
            cost = (rest.reshape(-1, dim) @ book.T).reshape(n, -1, words)
            cost *= -2
            cost += norm
            cost += error[:, :, None]
            flat = cost.reshape(n, -1)
            pick = np.empty((n, min(beam, flat.shape[1])), np.int64)
            error = np.empty(pick.shape, np.float32)
            for k in range(pick.shape[1]):  # a few passes for the least are faster than a partition
                pick[:, k] = flat.argmin(1)
                error[:, k] = flat[own, pick[:, k]]
                flat[own, pick[:, k]] = np.inf
            parent, word = pick // words, pick % words
            codes = np.concatenate([codes[own[:, None], parent], word[:, :, None].astype(np.uint8)], 2)
            rest = rest[own[:, None], parent] - book[word]
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 4) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        near = ((centers**2).sum(1) - 2 * (x @ centers.T)).argmin(1)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        total = np.zeros_like(centers)
        some = np.flatnonzero(count)
        total[some] = np.add.reduceat(x[order], (np.cumsum(count) - count)[some])
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centers


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 1, seed: int = 1) -> Quantizer:
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(x) // 8))
    rest, found = x.copy(), []
    for _ in range(books):
        centers = _kmeans(rest, words, rng)
        found.append(centers)
        rest = rest - centers[((centers**2).sum(1) - 2 * (rest @ centers.T)).argmin(1)]
    out = Quantizer(np.array(found))
    for _ in range(rounds):  # least squares over all codewords for the codes as they are
        codes = out.encode(x) + np.arange(books) * words
        flat = codes.astype(np.int64)
        pairs = (flat[:, :, None] * (books * words) + flat[:, None, :]).ravel()
        normal = np.bincount(pairs, minlength=(books * words) ** 2).astype(np.float32).reshape(books * words, -1)
        right = np.stack([np.bincount(flat.ravel(), np.repeat(x[:, d], books), books * words) for d in range(x.shape[1])], 1)
        before = out.books.reshape(books * words, -1)
        ridge = 0.1
        normal[np.diag_indices(len(normal))] += ridge
        solved = np.linalg.solve(normal, (right + ridge * before).astype(np.float32)).astype(np.float64)
        out = Quantizer(solved.reshape(books, words, -1))
    return out


def _encoder(model: Quantizer, dim: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = matrix(batch.column(1), dim)
            codes = model.encode(x)
            norms = (model.decode(codes) ** 2).sum(1) if len(rows) else np.zeros(0)
            wide = [r.tobytes() for r in x + 0.0]  # -0.0 becomes 0.0, so equal vectors have equal bytes
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(wide, pa.binary())], ["vec_id", "codes", "norm", "vector"])

    return encode


def build_index(vectors: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, Quantizer | None]:
    """(vec_id, embedding) -> the written index (vec_id, codes, norm, vector) of every usable row and its quantizer."""
    empty = vectors.sparkSession.createDataFrame([], INDEX), None
    usable = vectors.select("vec_id", "embedding").where("vec_id IS NOT NULL AND size(embedding) > 0")
    sizes = usable.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return empty
    dim, n = sizes["dim"], sizes["count"]
    share = min(1.0, train_rows / n)
    got = usable.where(common.hash_key(F.col("vec_id"), "train") < int(share * 2**60)).select("embedding").toArrow()
    _, x = matrix(got.column(0), dim)
    if not len(x):
        return empty
    model = train(x)
    return common.stored(usable.mapInArrow(_encoder(model, dim), INDEX), "aq-index"), model


def _wide(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _searcher(model: Quantizer, best: int, metric: str):
    books, words, dim = model.books.shape

    def search(base: pa.Table, queries: pa.Table) -> pa.Table:
        if not base.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "near": pa.array([], pa.float32())})
        base = base.sort_by("vec_id")  # so that a stable order prefers smaller ids
        ids, asked = base.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        q = _wide(queries.column("vector"), dim)
        codes = np.frombuffer(b"".join(base.column("codes").to_pylist()), np.uint8).reshape(-1, books).T.copy()
        norm = base.column("norm").to_numpy().astype(np.float32)
        out = []
        for k in range(0, len(q), 128):
            part, names = q[k : k + 128], asked[k : k + 128]
            luts = np.einsum("qd,mwd->mqw", part, model.books, optimize=True).astype(np.float32)
            near = luts[0][:, codes[0]]
            for m in range(1, books):
                near += luts[m][:, codes[m]]
            if metric == "cosine":
                near /= np.sqrt(np.maximum(norm, 1e-30))
            elif metric == "euclidean":
                near = 2 * near - norm
            near[names[:, None] == ids[None, :]] = -np.inf
            if len(ids) > best:  # all above the best-th score, then of its equals the smallest ids
                edge = -np.partition(-near, best - 1, 1)[:, best - 1 : best]
                above = near > edge
                equal = near == edge
                take = above | (equal & (np.cumsum(equal, 1) <= best - above.sum(1, keepdims=True)))
            else:
                take = np.ones(near.shape, bool)
            row, at = np.nonzero(take & np.isfinite(near))
            out.append((names[row], ids[at], near[row, at]))
        return pa.table(dict(zip(("query_id", "vec_id", "near"), map(np.concatenate, zip(*out)))))

    return search


def _reranker(dim: int, top: int, metric: str):
    def rerank(base: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not base.num_rows or not asked.num_rows:
            return empty
        ids = base.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x, q = ids[order], _wide(base.column("vector"), dim)[order], _wide(asked.column("vector"), dim)
        names, wanted = asked.column("query_id").to_numpy(), pa.concat_arrays(asked.column("wanted").chunks)
        size = wanted.value_lengths().to_numpy()
        row, want = np.repeat(np.arange(len(q)), size), wanted.flatten().to_numpy()
        lo, n = np.searchsorted(ids, want, "left"), np.searchsorted(ids, want, "right") - np.searchsorted(ids, want, "left")
        row, at = np.repeat(row, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())  # a vec_id's every row
        score = np.empty(len(row))
        for k in range(0, len(row), 65536):
            a, b = q[row[k : k + 65536]], x[at[k : k + 65536]]
            dots = np.einsum("ij,ij->i", a, b)
            if metric == "cosine":
                dots /= np.sqrt((a**2).sum(1) * (b**2).sum(1))
            score[k : k + 65536] = -((a - b) ** 2).sum(1) if metric == "euclidean" else dots
        best = np.lexsort((ids[at], -score, row))
        row, at, score = row[best], at[best], score[best]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < top
        if (ids[1:] == ids[:-1]).any():  # rows of one vec_id count once, which the caller sees to
            keep[:] = True
        return pa.table({"query_id": names[row[keep]], "vec_id": ids[at[keep]], "score": score[keep]})

    return rerank


def nearest(index: DataFrame, model: Quantizer | None, queries: DataFrame, top: int = TOP, shortlist: int = SHORTLIST, metric: str = "inner") -> DataFrame:
    """The top nearest of index to each row of queries (rows of an index): query_id, rank, vec_id, score.

    metric: the inner product, the cosine, or minus the squared distance.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    if model is None:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = model.books.shape[2]
    # of equal vectors the smallest ids alone
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    codes = index.select("vec_id", "codes", "norm", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")).distinct()
    codes = common.stored(codes.withColumn("r", F.row_number().over(same)).where(F.col("r") <= top + 1).select("vec_id", "codes", "norm"), "aq-codes")
    wide = common.stored(queries.select("vec_id", "vector").distinct(), "aq-queries")
    n, asked = codes.count(), wide.count()
    blocks, parts = max(LEAST_BLOCKS, -(-n // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    best = min(shortlist, int(shortlist / blocks + 6 * (shortlist / blocks) ** 0.5) + top + 1)  # blocks are random, so a block has hardly ever more of a shortlist
    deal = lambda column, k: F.pmod(F.xxhash64(column), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    base = codes.withColumn("block", deal("vec_id", blocks)).withColumn("part", every(parts))
    grid = wide.withColumn("part", deal("vec_id", parts)).withColumn("block", every(blocks))
    found = base.groupBy("block", "part").cogroup(grid.groupBy("block", "part")).applyInArrow(_searcher(model, best, metric), "query_id long, vec_id long, near float")
    if codes.select("vec_id").distinct().count() < n:  # a vec_id of several vectors takes one place
        found = found.groupBy("query_id", "vec_id").agg(F.max("near").alias("near"))
    listed = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id"))).where(F.col("r") <= shortlist)
    # exact reranking: each query goes with its part of the shortlist to the blocks that hold it
    groups = max(1, -(-asked * shortlist // (blocks * PAIR_BLOCK)))
    wanted = listed.select("query_id", "vec_id", deal("vec_id", blocks).alias("block")).groupBy("query_id", "block").agg(F.collect_list("vec_id").alias("wanted"))
    wanted = wanted.join(wide.withColumnRenamed("vec_id", "query_id"), "query_id").withColumn("part", deal("query_id", groups))
    vectors = index.select("vec_id", "vector").withColumn("block", deal("vec_id", blocks)).withColumn("part", every(groups))
    exact = vectors.groupBy("block", "part").cogroup(wanted.groupBy("block", "part")).applyInArrow(_reranker(dim, top, metric), "query_id long, vec_id long, score double")
    once = exact.where("query_id != vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    index, model = build_index(common.table(spark, sf_dir, "embeddings"))
    return nearest(index, model, index.where("vec_id % 20 = 0"))
