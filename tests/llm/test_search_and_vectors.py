"""Operators 11 to 13 on small tables with nulls, ties, repeats, dense groups and clashing columns, against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphlens.llm import codes, embdup, lexical, registry
from tests.llm.test_oracles import compare

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors_df(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x], k) for i, x, k in rows], VECTORS)


def odd_rows(dim):
    one = [1.0] + [0.0] * (dim - 1)
    return [(9001, None, 1), (9002, [], 1), (9003, [0.0] * dim, None), (9004, [math.nan] * dim, 2), (9005, [math.inf] + one[1:], 2), (9006, [None] + one[1:], 2), (9007, one[1:], 0), (None, one, 0)]


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def brute_links(rows, dim):
    """(vec_ids of usable rows, matrix of links, least vec_id reachable)."""
    usable = [(i, np.array(x, np.float32).astype(float)) for i, x, _ in rows if i is not None and x is not None and len(x) == dim and None not in x and np.isfinite(x).all() and np.any(x)]
    if not usable:
        return np.zeros(0, int), np.zeros((0, 0), bool), np.zeros(0, int)
    ids, x = np.array([i for i, _ in usable]), unit(np.array([v for _, v in usable]))
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    least = ids.copy()
    while True:
        new = np.minimum(least, np.where(near, least[None, :], least.max()).min(1))
        if (new == least).all():
            return ids, near, least
        least = new


def checked_links(spark, rows, dim, recall=1.0):
    got = embdup.near_embeddings(vectors_df(spark, rows).withColumns({"rank": F.lit("x"), "uid": F.lit(1), "core": F.lit(2)})).collect()
    assert len(got) == len(rows)
    ids, near, least = brute_links(rows, dim)
    assert sorted(r["vec_id"] or -1 for r in got) == sorted(i or -1 for i, _, _ in rows)
    have, want = {}, {}
    for r in got:
        have.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    for i, n, c in zip(ids.tolist(), near.sum(1).tolist(), least.tolist()):
        want.setdefault(i, []).append((n, c, i == c))
    for i, _, _ in rows:
        if i not in want:
            assert have[i] == [(0, i, True)]
    if recall == 1.0:
        assert {i: sorted(have[i]) for i in want} == {i: sorted(v) for i, v in want.items()}
    else:
        found, all_links = sum(r["n_links"] for r in got), int(near.sum())
        assert recall * all_links <= found <= all_links
        assert all(sum(h[0] for h in have[i]) <= sum(w[0] for w in want[i]) for i in want)
        assert np.mean([sorted(h[1] for h in have[i]) == sorted(w[1] for w in want[i]) for i in want]) > 0.97


def test_near_embeddings_with_copies_chains_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(embdup, "WINDOW", 16)
    monkeypatch.setattr(embdup, "SEGMENT", 64)
    rng, dim = np.random.default_rng(5), 24
    base = unit(rng.normal(size=(60, dim)))
    rows = [(k, v, 0) for k, v in enumerate(base)]
    rows += [(100 + k, base[0] * s, None) for k, s in enumerate([1.0, 1.0, 2.0, 0.5, 1.0] * 30)]  # equal and scaled copies, a third of the rows
    near = unit(base[1] + 0.02 * rng.normal(size=(150, dim)))
    rows += [(1000 + int(k), v, 1) for k, v in enumerate(near)]  # a dense group that one core holds
    a, b = base[2], unit(base[3] - (base[3] @ base[2]) * base[2])
    rows += [(2000 + k, math.cos(0.3 * k) * a + math.sin(0.3 * k) * b, 1) for k in range(5)]  # each near the next alone
    rows += [(0, base[5] * 3, 1), (0, base[6], 1), (100, base[7], 1)]  # shared ids
    checked_links(spark, rows + odd_rows(dim), dim)


def test_near_embeddings_in_a_wide_group_without_cores(spark, monkeypatch):
    monkeypatch.setattr(embdup, "WINDOW", 8)
    monkeypatch.setattr(embdup, "SEGMENT", 32)
    rng, dim = np.random.default_rng(6), 12
    rows = [(k, v, 0) for k, v in enumerate(rng.normal(size=(300, dim)))]
    for c in range(3):  # similarities on both sides of the threshold, two groups that a pivot half covers
        rows += [(1000 * (c + 1) + k, v, 0) for k, v in enumerate(unit(rng.normal(size=dim)) + (0.08, 0.12, 0.05)[c] * rng.normal(size=(200, dim)))]
    checked_links(spark, rows, dim, 0.985)


def test_near_embeddings_of_empty_tables(spark):
    assert embdup.near_embeddings(vectors_df(spark, [])).collect() == []
    checked_links(spark, odd_rows(4)[:-2], 4)


def test_hash_passes_follow_from_the_number_of_vectors():
    small, large = embdup.Hashes(64, 1000), embdup.Hashes(64, 10**9)
    assert (small.depth, large.depth) == (1, 4) and small.passes < 10 < large.passes
    x = unit(np.random.default_rng(0).normal(size=(50, 64)))
    assert (small.keys(x) == small.keys(x.copy())).all() and small.keys(x).shape == (50, small.passes)
    line = embdup.Hashes(1, 10**6)
    assert line.keys(np.array([[1.0], [-1.0]]))[0, 0] != line.keys(np.array([[1.0], [-1.0]]))[1, 0]


# ranked lexical search


def brute_ranks(docs, items):
    terms = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    sized = [(i, terms(t)) for i, t in docs]
    sized = [(i, w) for i, w in sized if w]
    n, total = len(sized), sum(len(w) for _, w in sized)
    df = {}
    for _, w in sized:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in set(items):
        found = []
        for i, w in sized:
            m, score = 75 + (25 * len(w) * n) // total, 0
            for t in terms(text):
                if t in df:
                    tf = w.count(t)
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                found.append((-score, math.inf if i is None else i))
        out += [(item, k + 1, None if i == math.inf else i, -s) for k, (s, i) in enumerate(sorted(found)[:20])]
    return sorted(out, key=str)


@pytest.mark.parametrize("way", ["", "shards", "blocks", "windows"])
def test_lexical_search(spark, monkeypatch, way):
    if way == "blocks":
        monkeypatch.setattr(lexical, "ITEM_BLOCK", 3)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)] + ["été", "Ünï", "x2", "2", "IT'S", "a-b"]
    docs = [(k, " ".join(rng.choice(words[: rng.randint(2, 46)]) for _ in range(rng.randint(1, 60)))) for k in range(300)]
    docs += [(500 + k, docs[3][1]) for k in range(30)]  # ties
    docs += [(7, "w1 w2"), (7, "w1 w2"), (None, "w30 w31"), (None, "w30 w31"), (900, None), (901, ""), (902, "-- !"), (903, "w1 " * 20000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(8))) for k in range(12)]
    items += [(50, "w1 W1 w1"), (50, "w1 W1 w1"), (50, "w2"), (None, "w3"), (51, None), (52, ""), (53, "unknown words"), (54, docs[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"shard": F.lit("s"), "term": F.lit(1), "score": F.lit(0)}).repartition(3, F.xxhash64("doc_id"))
    index = lexical.build_index(frame, 2000 if way == "shards" else lexical.SHARD_BYTES)
    if way == "windows":
        monkeypatch.setattr(lexical.merged, "__defaults__", (4,))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("r"))
    got = sorted((tuple(r) for r in lexical.ranked(index, asked).collect()), key=str)
    assert got == brute_ranks(docs, items)
    if way == "shards":
        assert index.select("shard").distinct().count() > 10
        none = index.limit(0)
        assert lexical.ranked(none, asked).collect() == [] and lexical.ranked(index, asked.limit(0)).collect() == []
        assert lexical.ranked(lexical.build_index(frame.limit(0)), asked).collect() == []


def test_merge_and_compressed_postings():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**40, 5])
    data, size = lexical.varbytes(values)
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 6, 1] and (lexical.values_of(data.tobytes()) == values).all()
    rng = np.random.default_rng(2)
    for span in (1, 7, 1000):
        lists = []
        for n in (1, 5, 200, 900):
            docs = np.sort(rng.choice(1000, n, replace=False))
            lists.append((docs, rng.integers(1, 5, n)))
        total = np.zeros(1000, np.int64)
        for docs, gains in lists:
            total[docs] += gains
        want = sorted(((int(s), -d) for d, s in enumerate(total) if s), reverse=True)[:20]
        assert lexical.merged(lists, 20, span) == [(s, -d) for s, d in want]


# vector codes


def brute_codes(rows, dim):
    kept = [(i, [math.floor(4096 * float(np.float32(v))) for v in x], k) for i, x, k in rows if x is not None and len(x) == dim and None not in x and np.isfinite(x).all()]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = dim // 8
    part = lambda x, p: x[p * w : (p + 1) * w]
    books = [[part(x, p) for _, x, _ in kept[:16]] for p in range(8)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(6):
        for p in range(8):
            own = {}
            for _, x, _ in kept:
                own.setdefault(nearest(part(x, p), books[p])[1], []).append(part(x, p))
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by = [], {}
    for i, x, k in kept:
        found = [nearest(part(x, p), books[p]) for p in range(8)]
        error = sum(f[0] for f in found)
        by[k] = by.get(k, 0) + error
        out.append((i, "".join(f"{f[1]:02x}" for f in found), error, k))
    return sorted(((i, c, e, by[k]) for i, c, e, k in out), key=str), ",".join(str(v) for b in books for c in b for v in c)


def test_vector_codes(spark, tmp_path):
    rng, dim = np.random.default_rng(8), 16
    rows = [(int(i), np.round(v, 2), [None, 0, 1][i % 3]) for i, v in enumerate(rng.normal(size=(150, dim)))]  # rounded: ties
    rows += [(200 + k, rows[40][1], 7) for k in range(80)] + [(3, rows[9][1], 1), (3, rows[9][1], 1), (300, [0.0] * dim, None), (301, [-3.9] * dim, None)]
    rows += [r for r in odd_rows(dim) if r[0] not in (9003,)]
    import hashlib

    path = str(tmp_path / "embeddings.parquet")
    vectors_df(spark, rows).withColumns({"code": F.lit("x"), "error": F.lit(1), "sums": F.lit(2)}).coalesce(1).write.parquet(path)
    got = registry.queries()["op13_vector_codes"](spark, str(tmp_path)).collect()
    want, plain = brute_codes(rows, dim)
    assert sorted((tuple(r)[:4] for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(plain.encode()).hexdigest()}


def test_vector_codes_of_few_rows_and_of_lengths_that_do_not_divide(spark):
    few = vectors_df(spark, [(1, [0.5] * 8, 1), (2, [0.25] * 8, 1)])
    coded, books = codes.compress(few)
    assert books.shape == (8, 2, 1) and sorted((r["vec_id"], r["code"], r["error"]) for r in coded.collect()) == [(1, "00" * 8, 0), (2, "01" * 8, 0)]
    assert codes.compress(vectors_df(spark, [(1, [0.5] * 7, 1)]))[0].collect() == [] and codes.compress(few.limit(0))[0].collect() == []
    with pytest.raises(Exception, match="magnitude"):
        codes.compress(vectors_df(spark, [(1, [1e20] * 8, 1)]))[0].collect()


def test_exponion_scans_less_and_finds_the_same():
    rng = np.random.default_rng(4)
    book = rng.integers(-4096, 4096, (16, 8))
    x = book[rng.integers(0, 16, 4000)] + rng.integers(-300, 300, (4000, 8))
    start = np.zeros(4000, np.int64)
    for _ in range(2):  # from one entry, then from where each was
        best, error, done = codes.exponion(x, book, start)
        all_errors = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (best == all_errors.argmin(1)).all() and (error == all_errors.min(1)).all()
        start = best
    assert done < 4000 * 16 / 2
    same = np.zeros((3, 8), np.int64)  # equal entries: the first
    assert codes.exponion(x[:5], same, np.array([2, 1, 0, 2, 1]))[0].tolist() == [0] * 5


def test_near_embeddings_oracle(spark, tmp_path):
    rng, dim = np.random.default_rng(9), 16
    base = unit(rng.normal(size=(20, dim)))
    rows = [(k, base[k % 20] + (0.03 if k > 20 else 0) * rng.normal(size=dim), 0) for k in range(120)] + [r for r in odd_rows(dim) if r[0] not in (None, 9007)]
    path = str(tmp_path / "embeddings.parquet")
    vectors_df(spark, rows).coalesce(1).write.parquet(path)
    name = "op11_embedding_duplicates"
    assert len(compare(registry.queries()[name](spark, str(tmp_path)), registry.oracle_sql()[name], {"embeddings": path + "/*.parquet"})) == len(rows)
