"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts become sets of hashed 4- and 5-byte n-grams (A-Z lower-cased, other ASCII
than letters and digits read as blanks). Document counts of every n-gram by
class come from all training rows, distributed. They give the log-count ratios
and a score of evidence, by which a bounded number of n-grams is kept. A
logistic regression over these binary features, each times its ratio, is
fitted on a bounded sample of the training rows. Scoring reads whole texts and
is a table lookup.

Defined cases: null and empty texts have no features and score the
classifier's intercept; rows with a null doc_id or null label are not learned
from; repeated label rows weigh as often as they occur; without a training row
of either class every score is the prior (0 with no rows); other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.llm import common, textkit

SIZES = (4, 5)
BITS = 22
#: At most so many n-grams are features.
MAX_FEATURES = 4096
#: Least evidence (a two-sample z) and documents of a feature, with fewer than FEW training rows and with more.
FEW, FLOORS = 500, ((4.0, 3), (5.0, 5))
#: At most about so many training rows are used to fit the regression.
FIT_ROWS = 16384
ALPHA, L2, STEPS = 1.0, 1.0, 30
THRESHOLD = 0.3
#: Bytes of text that one vectorised step handles; a longer text takes several.
STEP = 1 << 19

_FOLD = textkit.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def grams(buf: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each n the bucket of the n-gram at every byte."""
    b = _FOLD[buf]
    out = []
    if len(b) >= 4:
        w = b[:-3].astype(np.uint64)
        for k in (1, 2, 3):
            w |= b[k : len(b) - 3 + k].astype(np.uint64) << np.uint64(8 * k)
        for n in SIZES:
            if n == 5:
                w = w[:-1] | (b[4:].astype(np.uint64) << np.uint64(32))
            if len(w):
                x = (w + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(29)
                x *= np.uint64(0xBF58476D1CE4E5B9)
                out.append((n, (x >> np.uint64(64 - BITS)).astype(np.int32)))
    return out


def _pieces(start: int, end: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most about STEP that hold every n-gram of [start, end); an n-gram at a seam may be in two."""
    for a in range(start, end, STEP):
        yield a, min(a + STEP + max(SIZES) - 1, end)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (bucket, ones, zeros) of a task, with bucket -1 for the rows themselves."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        buf, offs = textkit.flat(batch.column(0))
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        rows += np.bincount(label, minlength=2)[:2]
        for i, j in textkit.chunks(offs, STEP):
            if j == i + 1:
                found = [np.unique(x) for a, b in _pieces(offs[i], offs[j]) for _, x in grams(buf[a:b])]
                if found:
                    counts[label[i], np.unique(np.concatenate(found))] += 1
                continue
            base = offs[i]
            found = grams(buf[base : offs[j]])
            for d in range(i, j):
                own = [x[offs[d] - base : max(offs[d] - base, offs[d + 1] - base - n + 1)] for n, x in found]
                if own:
                    counts[label[d], np.unique(np.concatenate(own))] += 1
    at = np.flatnonzero(counts.any(0)).astype(np.int32)
    step = 100_000
    yield _counted(np.array([-1], np.int32), rows[1:].astype(np.int32), rows[:1].astype(np.int32))
    for k in range(0, len(at), step):
        part = at[k : k + step]
        yield _counted(part, counts[1, part], counts[0, part])


def _counted(bucket, ones, zeros) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ones), pa.array(zeros)], ["bucket", "ones", "zeros"])


def _presence(buf: np.ndarray, offs: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of a batch, each once. slot: bucket -> feature, -1 for none."""
    width = max(int(slot.max()) + 1, 1)
    pairs = [np.zeros(0, np.int64)]
    for i, j in textkit.chunks(offs, STEP):
        found = []
        for base, end in _pieces(offs[i], offs[j]):
            for n, x in grams(buf[base:end]):
                f = slot[x]
                at = np.flatnonzero(f >= 0)
                text = np.searchsorted(offs, at + base, "right") - 1
                whole = at + base + n <= offs[text + 1]
                found.append(np.unique(text[whole] * width + f[at[whole]]))
        if found:
            pairs.append(np.unique(np.concatenate(found)))
    pair = np.concatenate(pairs)
    return pair // width, pair % width


class Model:
    """Buckets, their weights (log-count ratio times coefficient) and the intercept."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float):
        self.buckets, self.weights, self.intercept = buckets, weights, intercept
        self._slot: np.ndarray | None = None

    def __getstate__(self):
        return self.buckets, self.weights, self.intercept

    def __setstate__(self, state):
        self.__init__(*state)

    def slot(self) -> np.ndarray:
        if self._slot is None:
            self._slot = np.full(1 << BITS, -1, np.int16)
            self._slot[self.buckets] = np.arange(len(self.buckets))
        return self._slot

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = np.full(len(offs) - 1, self.intercept)
        text, feature = _presence(buf, offs, self.slot())
        if len(text):
            z += np.bincount(text, self.weights[feature], len(z))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(rows: list[np.ndarray], label: np.ndarray, scale: np.ndarray, l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """L2 logistic regression by Newton steps, each solved by conjugate gradients, on sparse rows of features scaled by scale."""
    lengths = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), lengths)
    col = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    value = scale[col]
    n, d = len(rows), len(scale)
    w, b = np.zeros(d), math.log((label.sum() + 1) / (n - label.sum() + 1))
    forward = lambda v: np.bincount(row, value * v[col], n)
    back = lambda g: np.bincount(col, value * g[row], d)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(w) + b, -500, 500)))
        gw, gb = back(p - label) + l2 * w, float((p - label).sum())
        if np.sqrt(gw @ gw + gb * gb) < 1e-4 * max(1, n) ** 0.5:
            break
        s = np.maximum(p * (1 - p), 1e-6)

        def curve(vw, vb, s=s):
            u = s * (forward(vw) + vb)
            return back(u) + l2 * vw, float(u.sum()) + 1e-6 * vb

        xw, xb = np.zeros(d), 0.0
        rw, rb = -gw, -gb
        pw, pb = rw.copy(), rb
        rr = rw @ rw + rb * rb
        first = rr
        for _ in range(40):
            cw, cb = curve(pw, pb)
            a = rr / (pw @ cw + pb * cb)
            xw, xb = xw + a * pw, xb + a * pb
            rw, rb = rw - a * cw, rb - a * cb
            new = rw @ rw + rb * rb
            if new < 1e-4 * first:
                break
            pw, pb, rr = rw + new / rr * pw, rb + new / rr * pb, new
        loss = lambda w, b: np.logaddexp(0, -(2 * label - 1) * (forward(w) + b)).sum() + l2 / 2 * w @ w
        step, now = 1.0, loss(w, b)
        while step > 1e-3 and loss(w + step * xw, b + step * xb) > now:
            step /= 2
        w, b = w + step * xw, b + step * xb
    return w, b


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Learn labels.toxic from the rows of docs that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    labelled = known.count()
    texts = docs.select("doc_id", "text").join(common.small(known, labelled), "doc_id")
    counted = texts.select("text", "toxic").mapInArrow(_counter, "bucket int, ones int, zeros int")
    counts = counted.groupBy("bucket").agg(F.sum("ones").cast("double").alias("ones"), F.sum("zeros").cast("double").alias("zeros"))
    least_z, least_docs = FLOORS[labelled >= FEW]
    counts = common.stored(counts.where(F.expr("bucket = -1") | (F.col("ones") + F.col("zeros") >= least_docs)), "toxic-counts")
    total = counts.where("bucket = -1").first()
    n1, n0 = (total["ones"], total["zeros"]) if total else (0.0, 0.0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.int64), np.zeros(0), 40.0 if n1 else -40.0)
    pooled = (F.col("ones") + F.col("zeros")) / (n1 + n0)
    z = F.abs(F.col("ones") / n1 - F.col("zeros") / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    best = counts.where("bucket >= 0").withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "bucket").limit(max_features).collect()
    buckets = np.array([r["bucket"] for r in best], np.int64)
    ones, zeros = (np.array([r[c] for r in best]) for c in ("ones", "zeros"))
    ratio = np.log((ones + ALPHA) / (n1 + 2 * ALPHA)) - np.log((zeros + ALPHA) / (n0 + 2 * ALPHA)) if len(best) else np.zeros(0)
    model = Model(buckets, ratio, math.log(n1 / n0))
    if not len(best):
        return model
    share = min(1.0, fit_rows / labelled)
    picked = texts.where(common.hash_key(F.col("doc_id"), "fit") < int(share * 2**60)).select("text", "toxic")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = textkit.flat(batch.column(0))
            text, feature = _presence(buf, offs, model.slot())
            cuts = np.searchsorted(text, np.arange(len(offs))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.astype(np.int16))), batch.column(1)], ["features", "toxic"])

    got = picked.mapInArrow(features, "features array<smallint>, toxic int").toArrow()
    rows = [np.asarray(x, np.int64) for x in got.column(0).to_pylist()]
    weights, intercept = fit_logistic(rows, got.column(1).to_numpy().astype(float), ratio)
    return Model(buckets, weights * ratio, intercept)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus score (double); a column of that name is replaced. Python sees the texts alone and returns the scores alone."""
    keep = [c for c in docs.columns if c != "score"]

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(model.score(*textkit.flat(text)))

    return docs.select(*keep, scored(F.col("text")).alias("score"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
