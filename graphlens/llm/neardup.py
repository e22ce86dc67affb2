"""MinHash near-duplicates with odd sketches.

Every text becomes the set of its distinct five-word shingles (64-bit hashes),
512 MinHash samples of it, 32 bands of four of them, and an odd sketch: the
samples folded into a parity bitmap, so that the population count of two
bitmaps' XOR estimates high similarities. Texts of equal sets form a class
with one representative. Representatives that share a band's bucket are
candidates; the sketch drops those that are clearly below the threshold, and
the rest are confirmed on full sets from the texts.

Only components are asked for, so candidates inside a component need no test.
The first round tests each representative against its best bucket minimum.
Later rounds take the buckets that still hold several components, in blocks
of bounded size: first the best few partners of each, then all that pass the
sketch. So no group of near copies is expanded into all its pairs, and no
candidate between different components goes untested.

A pair of similarity 0.75 shares no bucket with probability 5e-6, and the
sketch's margin is over four standard errors.

Defined cases: null, empty and blank texts have 0 shingles and are linked with
nothing; rows with a null doc_id are returned with a null component and kept;
rows that share a doc_id are one node, so all of them get the component that any
of their texts reaches; ties of copies go to the smaller doc_id; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm import common, textkit

WORDS, PERCENT = 5, 75
#: MinHash samples of the sketch, the first of which make the bands; bits of the sketch.
SAMPLES, BANDS, ROWS, BITS = 512, 32, 4, 4096
#: Estimated similarity below which a candidate is dropped.
MARGIN = 0.66
#: Members of a bucket that are compared in one block.
BLOCK = 1024
#: Bytes of text that one vectorised step handles; a worker keeps what its largest step took.
STEP = 1 << 19

_random = np.random.Generator(np.random.PCG64(75))
_XOR = _random.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_ODD = _random.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    starts, ends, first = textkit.words(buf, offs)
    hashes, _, cuts = textkit.ngrams(textkit.word_hashes(buf, starts, ends), first, WORDS)
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def samples(own: np.ndarray) -> np.ndarray:
    """SAMPLES MinHash values of a set of 64-bit hashes."""
    own = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, np.uint32(2**32 - 1))
    for k in range(0, len(own), 512):
        np.minimum(out, ((own[k : k + 512] ^ _XOR[:, None]) * _ODD[:, None]).min(1), out=out)
    return out


def odd_sketches(sampled: np.ndarray) -> np.ndarray:
    """(texts, SAMPLES) -> (texts, BITS / 8) parity bitmaps."""
    bit = textkit.mix(sampled.astype(np.uint64) * np.uint64(SAMPLES) + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(BITS)
    flat = (bit.astype(np.int64) + np.arange(len(sampled))[:, None] * BITS).ravel()
    return np.packbits((np.bincount(flat, minlength=len(sampled) * BITS) & 1).astype(np.uint8).reshape(-1, BITS), axis=1)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the population count of two sketches' XOR."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * differing / BITS, 1e-9))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = textkit.flat(batch.column(1))
        for i, j in textkit.chunks(offs, STEP):
            sets = shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            sampled = np.array([samples(s) for s in sets], np.uint32).reshape(j - i, SAMPLES)
            mixed = [textkit.mix(s) for s in sets]
            keys = np.array([(s.sum(dtype=np.uint64), np.bitwise_xor.reduce(m) if len(m) else 0) for s, m in zip(sets, mixed)], np.uint64).reshape(j - i, 2).view(np.int64)
            rows = sampled[:, : BANDS * ROWS].astype(np.uint64).reshape(j - i, BANDS, ROWS)
            band = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], j - i, 0)
            for r in range(ROWS):
                band = textkit.mix(band * np.uint64(0x9FB21C651E98DF25) + rows[:, :, r])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                    pa.array([x.tobytes() for x in odd_sketches(sampled)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(band.view(np.int64).ravel())),
                ],
                ["doc_id", "n_shingles", "k1", "k2", "sketch", "bands"],
            )
    pa.default_memory_pool().release_unused()  # the worker stays for other stages


def signatures(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_sign, "doc_id long, n_shingles long, k1 long, k2 long, sketch binary, bands array<long>")


def _bitmaps(column: pa.Array) -> np.ndarray:
    return textkit.flat(column)[0].reshape(-1, BITS // 8).view(np.uint64)


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sketch, sketch) -> (a, b, near) above the margin."""
    for batch in batches:
        near = estimate(np.bitwise_count(_bitmaps(batch.column(2)) ^ _bitmaps(batch.column(3))).sum(1, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], ["a", "b", "near"]).filter(pa.array(near >= MARGIN))
    pa.default_memory_pool().release_unused()


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text, text) -> (a, b) whose full sets are similar enough."""
    for batch in batches:
        keep = []
        left, lo = textkit.flat(batch.column(2))
        right, ro = textkit.flat(batch.column(3))
        bounds = np.maximum.reduce([lo, ro])
        for i, j in textkit.chunks(bounds, STEP):
            one = shingle_sets(left[lo[i] : lo[j]], lo[i : j + 1] - lo[i])
            two = shingle_sets(right[ro[i] : ro[j]], ro[i : j + 1] - ro[i])
            for x, y in zip(one, two):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    pa.default_memory_pool().release_unused()


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts are similar enough."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    ids = common.stored(ids, "pair-ids")
    texts = docs.select("doc_id", "text").join(common.small(ids), "doc_id", "left_semi")
    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a")
    both = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(_confirmed, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp): the smallest node reachable, for nodes with an edge.

    Alternating large and small stars; each round is written, and ends when a
    round changes nothing.
    """
    now = common.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "stars")
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select("v", "v").distinct())
        mark = new
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = common.stored(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        old, now = now, common.stored(small, "stars")
        common.dropped(old)
        common.dropped(large)


def _block_pairs(best: int | None, low: float, high: float):
    """Rows (key, i, j, side, rep, comp, sketch, bands), sorted by block -> pairs of different components by estimated similarity."""

    def pairs(rows: pa.Table) -> pa.RecordBatch | None:
        rep, comp, side = (rows.column(c).to_numpy() for c in ("rep", "comp", "side"))
        own, lone = rows.column("i")[0].as_py() == rows.column("j")[0].as_py(), comp.min() == comp.max()
        if lone or len(rep) < 2:
            return None
        maps, key = _bitmaps(rows.column("sketch")), rows.column("key")[0].as_py()
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        every = np.arange(len(rep))
        out_a, out_b, out_n = [], [], []
        for k in every.tolist():
            others = every if own else np.flatnonzero(side != side[k])
            others = others[comp[others] < comp[k]]  # each pair of components from one side
            if len(others):
                near = estimate(np.bitwise_count(maps[others] ^ maps[k]).sum(1, dtype=np.int64))
                fit = np.flatnonzero((near >= low) & (near < high))
                alike = bands[others[fit]] == bands[k]
                fit = fit[bands[k][alike.argmax(1)] == key]  # a pair belongs to the first bucket that it shares
                if best is not None and len(fit) > best:
                    fit = fit[np.argsort(-near[fit], kind="stable")[:best]]
                out_a.append(np.full(len(fit), rep[k]))
                out_b.append(rep[others[fit]])
                out_n.append(near[fit])
        if not out_a:
            return None
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(np.concatenate(out_n))], ["a", "b", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            names = np.stack([held.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            cuts = np.concatenate([[0], np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1]) if held.num_rows else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if (out := pairs(held.slice(a, b - a).combine_chunks())) is not None:
                    yield out
            held = held.slice(cuts[-1])
        if held is not None and held.num_rows and (out := pairs(held.combine_chunks())) is not None:
            yield out
        pa.default_memory_pool().release_unused()

    return run


def _mixed_pairs(buckets: DataFrame, sketches: DataFrame, label: DataFrame, best: int | None, low: float, high: float) -> DataFrame:
    """Candidates between the components that share a bucket."""
    known = buckets.join(label, buckets["rep"] == label["node"], "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    known = common.stored(known, "bucket-members")
    held = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    mixed = known.join(held, "key").join(sketches, "rep")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = mixed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "comp", "sketch", "bands")
    sorted_ = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    return sorted_.mapInArrow(_block_pairs(best, low, high), "a long, b long, near double").select("a", "b").distinct()


def _homes(signed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(doc_id, rep, home) for every class of a doc_id with several rows, home being its first class' rep; None if ids are unique."""
    known = signed.where("doc_id IS NOT NULL")
    several = common.stored(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared-ids")
    n = several.count()
    if not n:
        return None
    rows = known.where("n_shingles > 0").select("doc_id", "n_shingles", "k1", "k2").join(common.small(several, n), "doc_id", "left_semi").distinct()
    reps = rows.join(classes, ["n_shingles", "k1", "k2"]).select("doc_id", "rep").distinct()
    home = reps.groupBy("doc_id").agg(F.min("rep").alias("home"))
    return common.stored(reps.join(home, "doc_id"), "homes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    signed = common.stored(signatures(docs), "signatures")
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = common.stored(known.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    homes = _homes(signed, classes)
    reps = known.join(classes.select(F.col("rep").alias("doc_id"), "n_shingles", "k1", "k2"), ["doc_id", "n_shingles", "k1", "k2"]).dropDuplicates(["doc_id", "k1"])
    reps = common.stored(reps.select(F.col("doc_id").alias("rep"), "sketch", "bands"), "representatives")
    sketches = reps.select("rep", "sketch")
    banded = reps.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").select("key", "pivot")
    buckets = common.stored(banded.join(shared, "key"), "buckets")

    tried = buckets.where("rep > pivot").select("rep", "pivot").distinct()
    tried = tried.join(sketches, "rep").join(sketches.select(F.col("rep").alias("pivot"), F.col("sketch").alias("other")), "pivot")
    near = tried.select("rep", "pivot", "sketch", "other").mapInArrow(_estimated, "a long, b long, near double")
    pairs = near.groupBy("a").agg(F.max_by("b", F.struct("near", -F.col("b"))).alias("b"))
    label = None
    for best, low, high in ((0, 0, 0), (3, MARGIN, 9.0), (None, 0.72, 9.0), (None, MARGIN, 0.72)):
        if label is not None:
            pairs = _mixed_pairs(buckets, reps, label, best, low, high)
        pairs = common.stored(pairs, "pairs")
        if label is not None and pairs.isEmpty():
            continue
        links = confirm(pairs, docs)
        if label is None:
            if homes is not None:  # the classes of one doc_id are linked by it
                links = links.union(homes.where("rep > home").select("rep", "home").distinct())
            label = common.stored(components(links), "components")
            continue
        by = label.select("node", "comp")
        met = links.join(by.toDF("a", "ca"), "a", "left").join(by.toDF("b", "cb"), "b", "left")
        met = met.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        moved = common.stored(components(met), "merged")
        old = label.join(moved.toDF("comp", "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        fresh = moved.join(label.select("node"), "node", "left_anti").select("node", "comp")
        label = common.stored(old.unionByName(fresh), "components")
    rows = signed.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["n_shingles", "k1", "k2"], "left")
    if homes is not None:  # a blank row of a shared doc_id goes with its node
        home = homes.select(F.col("doc_id").alias("of"), "home").distinct()
        rows = rows.join(home, rows["doc_id"] == home["of"], "left").withColumn("rep", F.coalesce("rep", "home"))
    rows = rows.join(label, rows["rep"] == label["node"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


#: Sets compared in full: pairs by shared shingles, then reachability.
ORACLE = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
words AS (SELECT r, len(w) AS m, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM docs),
runs AS (
  SELECT r, m, i, concat_ws(' ', w1, lead(w1) OVER o, lead(w1, 2) OVER o, lead(w1, 3) OVER o, lead(w1, 4) OVER o) AS g
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
sets AS (SELECT r, list_sort(list(DISTINCT g)) AS s FROM runs WHERE i = 1 OR i <= m - 4 GROUP BY r),
sized AS (SELECT r, doc_id, coalesce(len(s), 0)::BIGINT AS n, s FROM docs LEFT JOIN sets USING (r)),
classes AS (SELECT min(r) AS r, any_value(n) AS n, s FROM sized WHERE n > 0 GROUP BY s),
grams AS (SELECT r, n, unnest(s) AS g FROM classes),
inter AS (
  SELECT a.r AS a, b.r AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL),
same AS (SELECT c.r AS rep, sized.doc_id FROM sized JOIN classes c ON c.s = sized.s WHERE sized.n > 0 AND sized.doc_id IS NOT NULL),
links AS (SELECT a, b FROM inter WHERE 100 * i >= 75 * (na + nb - i)),
edges AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links UNION ALL SELECT rep, rep FROM same) l
  JOIN (SELECT rep, min(doc_id) AS doc_id FROM same GROUP BY rep) x ON x.rep = l.a JOIN (SELECT rep, min(doc_id) AS doc_id FROM same GROUP BY rep) y ON y.rep = l.b
  UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY rep) FROM same UNION SELECT min(doc_id) OVER (PARTITION BY rep), doc_id FROM same),
reach AS (SELECT DISTINCT doc_id, doc_id AS met FROM same UNION SELECT doc_id, b FROM reach JOIN edges ON a = met),
comp AS (SELECT doc_id, min(met) AS component_id FROM reach GROUP BY doc_id)
SELECT sized.doc_id, n AS n_shingles, CASE WHEN sized.doc_id IS NOT NULL THEN coalesce(component_id, sized.doc_id) END AS component_id,
       coalesce(sized.doc_id = coalesce(component_id, sized.doc_id), true) AS kept
FROM sized LEFT JOIN comp ON comp.doc_id = sized.doc_id
"""
