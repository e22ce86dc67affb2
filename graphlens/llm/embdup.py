"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets a key of concatenated random hashes (the signed
index of the largest of some random projections) and all vectors are sorted by it. A
vector is compared with its WINDOW neighbours in that order and, so that no group
is too dense for a window, with every vector whose key has the same first hashes. The
number of such hashes follows from the number of vectors (about WINDOW random
vectors share them), and the number of passes from them: a pair right at the
threshold is met in some pass with probability RECALL, a closer one more surely.

Rank in a pass is known to every task: the sort is written with a position, and
positions become ranks by prefix sums of the partitions. A vector carries its ranks and
keys of earlier passes, so a pair met again is known as such and counted once without
pairs ever being listed: tiles give a count of links for each vector and one link
to the least vector of its piece, which star contraction joins to components.

Groups of thousands of near copies need no comparison of all pairs: where many share
their first hashes, the mean direction of a few of them is a pivot. All vectors
within half the threshold's angle of one pivot are links of each other by the
triangle inequality, so they are counted by the core's size; only pairs that no core
holds are compared. Cores spare work and decide nothing: what no pivot covers is
compared tile by tile, a streamed row at a time.

Vectors that are equal are one unit with a multiplicity. A unit's core, links and
component are those of all its rows.

Defined cases: vectors that are null, empty, zero, of another length than most or hold
null or non-finite components, and rows with a null vec_id, link with nothing and are
their own component; rows that share a vec_id are vectors of their own, linked only
by their vectors, and may differ in component; ties of copies go to the smaller
vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.llm import common
from graphlens.llm.ann import matrix
from graphlens.llm.neardup import components

THRESHOLD, RECALL = 0.9, 0.99
#: Neighbours of a vector that are compared on either side; vectors of a segment of the order.
WINDOW, SEGMENT = 256, 1024
#: Random projections of a hash at most; hashes of a key beyond those that a dense run shares.
DIRECTIONS, DEEPER = 64, 2
#: Pivots at most, and the vectors of a run that make one.
PIVOTS, SAMPLED = 256, 32
TILE = "uid long, links long, root long"


class Hashes:
    """The keys of all passes for vectors of a length."""

    def __init__(self, dim: int, n: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 11):
        self.dim, self.seed, self.directions = dim, seed, min(DIRECTIONS, dim)
        self.bits = max(1, math.ceil(math.log2(2 * self.directions)))
        rng = np.random.default_rng(seed)
        x, z = rng.normal(size=(2, 4096, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
        y = threshold * x + math.sqrt(1 - threshold**2) * z if dim > 1 else x
        books = self.books(64)
        met = float(np.mean([(self._code(x, b) == self._code(y, b)).mean() for b in books]))  # of a pair at the threshold by one hash
        self.depth = min(max(1, math.ceil(math.log(max(n / WINDOW, 1.0)) / math.log(2 * self.directions))), 62 // self.bits)
        self.length = min(self.depth + DEEPER, 62 // self.bits)
        chance = met**self.depth
        self.passes = 1 if chance >= recall else math.ceil(math.log(1 - recall) / math.log(1 - chance))
        self.shift = self.bits * (self.length - self.depth)

    def books(self, n: int) -> np.ndarray:
        return np.random.default_rng(self.seed + 1).normal(size=(n, self.dim, self.directions))

    @staticmethod
    def _code(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        along = x @ book
        best = np.abs(along).argmax(1)
        return 2 * best + (along[np.arange(len(x)), best] < 0)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, passes) keys of unit vectors."""
        out = np.zeros((len(x), self.passes), np.int64)
        for k, book in enumerate(self.books(self.passes * self.length)):
            out[:, k // self.length] = (out[:, k // self.length] << self.bits) | self._code(x, book)
        return out


def units_of(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    """Unit vectors, in double precision, of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x  # so that no square leaves the doubles
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _reader(dim: int, kind: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = matrix(batch.column(1), dim)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            out: list[bytes | None] = [None] * batch.num_rows
            for r, v in zip(rows.tolist(), (x + 0.0).astype(kind)):  # -0.0 becomes 0.0, so equal vectors have equal bytes
                if known[r]:
                    out[r] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vector"])

    return read


def _keyed(hashes: Hashes, kind: str):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = hashes.keys(units_of(batch.column(1), kind, hashes.dim))
            ends = np.arange(0, keys.size + 1, hashes.passes, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], ["uid", "keys"])

    return keyed


def _cored(pivots: np.ndarray, least: float, kind: str):
    """The first pivot within half the threshold's angle, or null."""

    def cored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = units_of(batch.column(1), kind, pivots.shape[1]) @ pivots.T >= least
            some = near.any(1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), pa.array(near.argmax(1)[some].astype(np.int32))], ["uid", "core"])

    return cored


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links a-b join it to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root


class _Rows:
    """Some rows of a pass as arrays."""

    def __init__(self, table: pa.Table, kind: str, dim: int):
        column = lambda c: table.column(c).to_numpy()
        self.uid, self.rank, self.bucket, self.mult = (column(c) for c in ("uid", "rank", "bucket", "mult"))
        self.core, self.lead = (table.column(c).fill_null(-1).to_numpy() for c in ("core", "lead"))
        n = table.num_rows
        self.x = units_of(table.column("vector"), kind, dim)
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        self.ranks, self.buckets = (flat(c) if n else np.zeros((0, 0), np.int64) for c in ("ranks", "buckets"))


def _tiles(kind: str, dim: int, threshold: float, window: int):
    """Rows sorted by segment, role (0: its own, 1: from the window ahead of it, 2: visitors of a dense run) and rank -> links of each row here."""

    def counted(a: _Rows, b: _Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the linked pairs a[i], b[j] are counted here: not in one core, not met in an earlier pass."""
        new = ~((a.core[i] >= 0) & (a.core[i] == b.core[j]))
        for q in range(a.ranks.shape[1] if len(i) else 0):
            new &= (np.abs(a.ranks[i, q] - b.ranks[j, q]) > window) & (a.buckets[i, q] != b.buckets[j, q])
        return new

    def summed(rows: list[_Rows], pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
        """pairs: (i, j, whether counted) over the rows of all of rows."""
        i, j, new = (np.concatenate(c) for c in zip(*pairs))
        if not len(i):
            return None
        uid, mult = np.concatenate([r.uid for r in rows]), np.concatenate([r.mult for r in rows])
        links = np.zeros(len(uid), np.int64)
        np.add.at(links, i[new], mult[j[new]])
        np.add.at(links, j[new], mult[i[new]])
        root = _roots(len(uid), i, j)
        own = np.flatnonzero((links > 0) | (root != np.arange(len(uid))))
        return pa.RecordBatch.from_arrays([pa.array(uid[own]), pa.array(links[own]), pa.array(uid[root[own]])], ["uid", "links", "root"])

    def tile(own: _Rows, halo: _Rows) -> pa.RecordBatch | None:
        i, j = np.nonzero(np.triu(own.x @ own.x.T >= threshold, 1))
        met = (np.abs(own.rank[i] - own.rank[j]) <= window) | (own.bucket[i] == own.bucket[j])
        i, j = i[met], j[met]
        pairs = [(i, j, counted(own, own, i, j))]
        if len(halo.uid):
            i, j = np.nonzero(halo.x @ own.x.T >= threshold)
            met = np.abs(halo.rank[i] - own.rank[j]) <= window
            i, j = i[met], j[met]
            pairs.append((i + len(own.uid), j, counted(halo, own, i, j)))
        return summed([own, halo], pairs)

    def visited(own: _Rows, guests: _Rows) -> pa.RecordBatch | None:
        i, j = np.nonzero(guests.x @ own.x.T >= threshold)
        met = (guests.bucket[i] == own.bucket[j]) & (np.abs(guests.rank[i] - own.rank[j]) > window)
        met &= (guests.rank[i] < own.rank[j]) | ((own.core[j] >= 0) & (own.core[j] == own.lead[j]))  # of two guests of each other, once
        i, j = i[met], j[met]
        return summed([own, guests], [(i + len(own.uid), j, counted(guests, own, i, j))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the rows and the window of the segment that is being read
        own, now = None, None

        def closed() -> tuple[_Rows, pa.RecordBatch | None]:
            whole = pa.concat_tables(held)
            role = whole.column("role").to_numpy()
            rows = _Rows(whole.filter(pa.array(role == 0)), kind, dim)
            return rows, tile(rows, _Rows(whole.filter(pa.array(role == 1)), kind, dim))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            segment, role = table.column("segment").to_numpy(), table.column("role").to_numpy() == 2
            cuts = np.concatenate([[0], np.flatnonzero((segment[1:] != segment[:-1]) | (role[1:] != role[:-1])) + 1, [len(segment)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                if segment[a] != now:
                    if held:
                        _, out = closed()
                        if out is not None:
                            yield out
                    held, own, now = [], None, segment[a]
                if not role[a]:
                    held.append(table.slice(a, b - a))
                    continue
                if own is None:
                    own, out = closed()
                    held = []
                    if out is not None:
                        yield out
                for k in range(a, b, 4096):
                    out = visited(own, _Rows(table.slice(k, min(4096, b - k)), kind, dim))
                    if out is not None:
                        yield out
        if held:
            _, out = closed()
            if out is not None:
                yield out

    return run


def _ranked(keys: DataFrame, parts: int) -> DataFrame:
    """(uid, keys) -> pass, key, uid, rank: the rank of each vector in the order of pass, key and uid."""
    rows = keys.select(F.posexplode("keys").alias("pass", "key"), "uid")
    placed = rows.repartitionByRange(parts, "pass", "key", "uid").sortWithinPartitions("pass", "key", "uid").withColumn("at", F.monotonically_increasing_id())
    placed = common.stored(placed, "sorted-passes")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).count()  # a row for each partition
    base = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(sizes.select("part", base.alias("base")))
    return placed.withColumn("part", part).join(bases, "part").select("pass", "key", "uid", (F.col("base") + within).alias("rank"))


def _pivots(runs: DataFrame, ranked: DataFrame, units: DataFrame, kind: str, dim: int, least: float) -> np.ndarray:
    """Mean directions of the largest dense runs, those that hold most of their sample and no other pivot's."""
    most = runs.where(F.col("n") > WINDOW).orderBy(F.desc("n"), "lo").limit(PIVOTS).collect()
    if not most:
        return np.zeros((0, dim))
    wanted = [(k, r["lo"] + i * (r["n"] - 1) // (SAMPLED - 1)) for k, r in enumerate(most) for i in range(SAMPLED)]
    asked = units.sparkSession.createDataFrame(wanted, "run int, rank long")
    chosen = ranked.select("uid", "rank").join(F.broadcast(asked), "rank").join(units.select("uid", "vector"), "uid").orderBy("run", "rank").select("run", "vector").toArrow()
    run, x = chosen.column("run").to_numpy(), units_of(chosen.column("vector"), kind, dim)
    out: list[np.ndarray] = []
    for k in range(len(most)):
        own = x[run == k]
        mean = own.sum(0)
        size = np.linalg.norm(mean)
        if size > 0 and (own @ (mean / size) >= least).mean() >= 0.5 and not any(mean @ p >= 0.995 * size for p in out):
            out.append(mean / size)
    return np.array(out).reshape(-1, dim)


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, embedding) -> vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    sizes = vectors.where("vec_id IS NOT NULL AND size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = sizes["dim"] if sizes else 0
    rows = common.stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_reader(dim, kind), "vec_id long, vector binary"), "vectors")
    alone = rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    usable = rows.where("vector IS NOT NULL")
    units = usable.groupBy("vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("mult")).withColumn("uid", F.monotonically_increasing_id())
    units = common.stored(units, "units")
    n = units.count()
    if not n:
        return alone
    hashes = Hashes(dim, n, threshold, recall)
    keys = common.stored(units.select("uid", "vector").mapInArrow(_keyed(hashes, kind), "uid long, keys array<long>"), "projections")
    parts = max(common.partitions(spark), -(-n * hashes.passes // (1 << 22)))
    ranked = common.stored(_ranked(keys, parts), "ranks")
    runs = ranked.groupBy("pass", F.shiftright("key", hashes.shift).alias("bucket")).agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n"))
    runs = common.stored(runs.where((F.col("n") > WINDOW) | (F.expr(f"lo div {SEGMENT}") < F.expr(f"hi div {SEGMENT}"))), "runs")
    # cores
    least = math.cos(math.acos(threshold) / 2) + 1e-9  # cosine of half the threshold's angle
    pivots = _pivots(runs, ranked, units, kind, dim, least)
    cores = common.stored(units.select("uid", "vector").mapInArrow(_cored(pivots, least, kind), "uid long, core int"), "cores") if len(pivots) else spark.createDataFrame([], "uid long, core int")
    of = common.stored(cores.join(units.select("uid", "mult"), "uid").groupBy("core").agg(F.sum("mult").alias("members"), F.min("uid").alias("first")), "core-sizes")
    # every unit with its ranks, dealt to the segments of each pass
    placed = ranked.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "rank"))), lambda s: s["rank"]).alias("all_ranks"))
    held = units.select("uid", "vector", "mult").join(keys, "uid").join(placed, "uid").join(cores, "uid", "left")
    held = held.withColumn("all_buckets", F.transform("keys", lambda k: F.shiftright(k, hashes.shift))).drop("keys")
    held = common.stored(held, "placed-units")
    each = held.select("uid", "vector", "mult", "core", "all_ranks", "all_buckets", F.posexplode("all_ranks").alias("pass", "rank"))
    each = each.withColumn("bucket", F.get("all_buckets", F.col("pass")))
    wide = runs.where(F.expr(f"lo div {SEGMENT}") < F.expr(f"hi div {SEGMENT}"))
    members = each.where("core IS NOT NULL").select("pass", "bucket", "core").join(common.small(wide.select("pass", "bucket")), ["pass", "bucket"], "left_semi")
    lead = members.groupBy("pass", "bucket", "core").count().groupBy("pass", "bucket").agg(F.max_by("core", F.struct("count", -F.col("core"))).alias("lead"))
    wide = common.stored(wide.join(lead, ["pass", "bucket"], "left").select("pass", "bucket", F.expr(f"lo div {SEGMENT}").alias("from"), F.expr(f"hi div {SEGMENT}").alias("to"), "lead"), "wide-runs")
    each = each.join(common.small(wide), ["pass", "bucket"], "left").withColumn("home", F.expr(f"rank div {SEGMENT}"))
    guest = F.col("from").isNotNull() & ~F.coalesce(F.col("core") == F.col("lead"), F.lit(False))
    ahead = F.when(F.col("rank") % SEGMENT >= SEGMENT - WINDOW, F.array(F.struct((F.col("home") + 1).alias("segment"), F.lit(1).alias("role")))).otherwise(F.expr("array()"))
    visits = F.when(guest, F.transform(F.array_except(F.sequence("from", "to"), F.array("home")), lambda s: F.struct(s.alias("segment"), F.lit(2).alias("role")))).otherwise(F.expr("array()"))
    places = F.concat(F.array(F.struct(F.col("home").alias("segment"), F.lit(0).alias("role"))), ahead, visits)
    dealt = each.withColumn("place", F.explode(places)).select(
        "place.segment", "place.role", "rank", "uid", "bucket", "mult", "core", "lead", "vector",
        F.slice("all_ranks", F.lit(1), F.col("pass")).alias("ranks"), F.slice("all_buckets", F.lit(1), F.col("pass")).alias("buckets"), "pass",
    )
    # a segment at the border of two passes is two
    dealt = dealt.repartition("pass", "segment").sortWithinPartitions("pass", "segment", "role", "rank")
    met = common.stored(dealt.withColumn("segment", F.col("segment") * (hashes.passes + 1) + F.col("pass")).drop("pass").mapInArrow(_tiles(kind, dim, threshold, WINDOW), TILE), "tile-links")
    links = met.groupBy("uid").agg(F.sum("links").alias("links"))
    edges = met.where("root != uid").select(F.col("uid").alias("a"), F.col("root").alias("b"))
    edges = edges.union(cores.join(common.small(of.select("core", "first")), "core").where("uid != first").select("uid", "first"))
    label = common.stored(components(edges), "components")
    named = units.select("uid", "vector", "mult", "low").join(label, F.col("uid") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "uid"))
    named = common.stored(named.drop("node").join(cores, "uid", "left").join(links, "uid", "left").join(common.small(of.drop("first")), "core", "left"), "named-units")
    lows = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    counted = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("members") - F.col("mult"), F.lit(0)) + F.col("mult") - 1
    two = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")]
    result = common.stored(named.select("comp", counted.alias("n_links"), *two).join(lows, "comp").drop("comp"), "unit-results")
    found = common.matched(usable.select("vec_id", *two), result, ["h1", "h2"], "vec_id")
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)


def op11_embedding_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_embeddings(common.table(spark, sf_dir, "embeddings"))


#: All pairs.
ORACLE = f"""
WITH RECURSIVE vecs AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v::DOUBLE))) = 0 AND len(list_filter(embedding, lambda v: v != 0)) > 0),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM vecs a JOIN vecs b ON a.r != b.r AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
reach AS (SELECT r, r AS met FROM vecs UNION SELECT reach.r, b FROM reach JOIN links ON a = met),
comp AS (SELECT reach.r AS r, min(vec_id) AS component_id FROM reach JOIN vecs ON vecs.r = met GROUP BY reach.r),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a),
linked AS (SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id FROM vecs JOIN comp USING (r) LEFT JOIN counts USING (r))
SELECT *, vec_id = component_id AS kept FROM linked
UNION ALL
SELECT vec_id, 0::BIGINT, vec_id, true FROM embeddings
WHERE NOT coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v::DOUBLE))) = 0 AND len(list_filter(embedding, lambda v: v != 0)) > 0, false)
"""
