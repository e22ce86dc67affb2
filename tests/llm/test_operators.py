"""Corpus operators on small tables with nulls, blanks, ties, repeats and clashing columns, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphlens.llm import ann, decontam, linededup, mixing, neardup, sharding, substrings, textkit, tokens, toxicity
from graphlens.llm.wavelet import WaveletMatrix

random.seed(11)


def docs_df(spark, rows, more=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({"score": F.lit("mine"), "shard": F.lit("s"), "taken": F.lit(1), "size": F.lit("x"), "at": F.lit(0)}) if more else df


ODD = [(1, None, "a"), (2, "", None), (4, " \n\t", "a"), (5, "a b", "b"), (6, "A  b", "b"), (None, "zz top", "a"), (9, "x " * 5000, "c"), (10, "x " * 5000, "c")]


def test_words_and_hashes():
    texts = ["Ab  c\td", None, "", "é x y", "ab", "AB c"]
    buf, offs = textkit.flat(pa.array(texts))
    starts, ends, first = textkit.words(buf, offs)
    found = [bytes(buf[a:b]).decode() for a, b in zip(starts, ends)]
    assert found == ["Ab", "c", "d", "é x", "y", "ab", "AB", "c"] and np.diff(first).tolist() == [3, 0, 0, 2, 1, 2]
    h = textkit.word_hashes(buf, starts, ends)
    assert h[0] == h[5] == h[6] and h[1] == h[7] and len(set(h.tolist())) == 5
    grams, _, cuts = textkit.ngrams(h, first, 2)
    assert np.diff(cuts).tolist() == [2, 0, 0, 1, 1, 1] and grams[0] == grams[-1]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    base, rows = [f"w{i}" for i in range(120)], list(ODD)
    for i in range(60):
        w = list(base)
        for _ in range(random.choice([0, 1, 2, 3, 4, 6, 8])):
            w[random.randrange(120)] = f"x{random.randrange(10**6)}"
        rows.append((100 + i, " ".join(w), "n"))
    rows.append(rows[-1])
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs_df(spark, rows, True)).collect()}
    sets, up = {}, {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        if i is not None:
            sets[i], up[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset(), i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), root(i), root(i) == i)
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_odd_sketch_estimates():
    for share in (0.6, 0.75, 0.9):
        n = int(2000 * 2 * share / (1 + share))
        h = textkit.mix(np.arange(4000, dtype=np.uint64))
        a, b = np.unique(h[:2000]), np.unique(np.concatenate([h[:n], h[2000 : 4000 - n]]))
        maps = neardup.odd_sketches(np.array([neardup.samples(a), neardup.samples(b)])).view(np.uint64)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(neardup.estimate(np.bitwise_count(maps[0] ^ maps[1]).sum()) - true) < 0.09


def brute_removal(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for q in range(len(b) - 99):
            w = b[q : q + 100]
            if w in seen:
                gone[q : q + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("way", ["", "slices", "apart", "sampled"])
def test_repeated_substrings(spark, monkeypatch, way):
    if way == "slices":
        monkeypatch.setattr(substrings, "SLICE_BYTES", 1000)
    if way in ("apart", "sampled"):
        monkeypatch.setattr(substrings, "HOT", 2)
    monkeypatch.setattr(substrings, "SAMPLE_HITS", 2 if way == "sampled" else 10**9)
    base = ["".join(random.choice("abcdefgh ") for _ in range(400)) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "a" * 99), (4, "a" * 350), (5, "xyz" * 90)]
    for i in range(80):
        t = ""
        for _ in range(random.randint(1, 4)):
            b, a = random.choice(base), random.randint(0, 300)
            t += b[a : a + random.randint(50, 350)] + random.choice(["", "é", "\x00", "q"])
        rows.append((10 + i, t))
    rows.append((1000, rows[-1][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert (len(substrings.hot_cores(df, 1)) > 5) == (way == "sampled")
    got = {}
    for r in substrings.remove_repeats(df).collect():
        got[r["doc_id"]] = (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
    assert got == brute_removal(rows)
    twice = spark.createDataFrame([(7, base[0]), (7, base[0]), (None, base[0])], "doc_id long, text string")
    kept = sorted((str(r["doc_id"]), len(r["kept"])) for r in substrings.remove_repeats(twice).collect())
    assert kept == [("7", 0), ("7", 0), ("None", 400)]


def test_repeats_across_the_steps_of_long_texts(spark):
    rng = np.random.default_rng(8)
    long = bytes(rng.integers(97, 123, 1_300_000, dtype=np.uint8)).decode()
    rows = [(3, long + long[1000:1400] + "!" + long[524200:524400]), (1, "x" + long[500_000:900_000]), (2, long[5:700]), (9, "short")]
    got = {}
    for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]] = (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
    assert got == brute_removal(rows)


def test_long_texts_cross_every_step(spark):
    """One text of 5 MB beside short ones: near duplicates, toxicity's n-grams, tokens and their shards."""
    rng = np.random.default_rng(9)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(3000)]
    words = [vocabulary[i] for i in rng.integers(0, 3000, 900_000)]
    long = " ".join(words)
    near = " ".join([*words[:-50_000], *(w + "q" for w in words[-50_000:])])
    rows = [(1, long, "a"), (2, near, "a"), (3, " ".join(words[:400_000]), "b"), (4, "a few words", "b")]
    df = docs_df(spark, rows)
    assert len(long) > 5_000_000
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t, _ in rows)}
    assert got == {1: (len(sets[1]), 1), 2: (len(sets[2]), 1), 3: (len(sets[3]), 3), 4: (1, 4)} and len(sets[1] & sets[2]) / len(sets[1] | sets[2]) >= 0.75
    tok, start = plain_tokenizer(), 0
    by = {r["doc_id"]: r for r in tokens.read_shards(tokens.write_shards(df)).collect()}
    for i, t, _ in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert (by[i]["start"], by[i]["n_tokens"], by[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    raw = long.encode()
    slot = np.full(1 << toxicity.BITS, -1, np.int16)
    slot[rng.integers(0, 1 << toxicity.BITS, 4000)] = np.arange(4000)
    folded = toxicity._FOLD[np.frombuffer(raw, np.uint8)]
    whole = set()
    for _, x in toxicity.grams(folded):
        whole |= set(slot[x].tolist())
    text, feature = toxicity._presence(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), slot)
    assert set(feature.tolist()) == whole - {-1} and len(feature) == len(set(feature.tolist())) > 100 and not text.any()


def test_pieces_encode_as_whole_texts():
    encoder = tokens.Encoder(tokens.default_path())
    alphabet = ["a", "Bc", " ", "  ", "\n", "\t", "'s", "'", "’", ".", "...", "12", "é", " ", "　", "日本", "<|endoftext|>", "🙂", "\r\n", "don't", "_"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 30))) for _ in range(1500)] + [None, ""]
    for _ in range(2):  # with a cold and a warm cache
        buf, offs = textkit.flat(pa.array(texts))
        ids, count = encoder.encode(buf, offs)
        at = np.cumsum(count) - count
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k] + count[k]].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_added_tokens_encode_as_by_the_library(spark):
    end, tok = "<|endoftext|>", plain_tokenizer()
    bits = [end, end, "<|", "|>", "endoftext", " ", "  ", "   ", "a", "Bc", "'s", "12", "\n", "é", "🙂", "<|endoftext", end[5:]]
    texts = [f"a{end}b", end, f"{end}{end}", f"x  {end}  y", f"{end[:7]}", f"{end[7:]} z", "".join(["one ", end, "\nIt's "] * 3)]
    texts += ["".join(random.choice(bits) for _ in range(random.randint(0, 20))) for _ in range(800)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 50256, 65]
    encoder = tokens.Encoder(tokens.default_path())
    for _ in range(2):
        buf, offs = textkit.flat(pa.array(texts))
        ids, count = encoder.encode(buf, offs)
        assert np.split(ids, np.cumsum(count)[:-1])[0].tolist() == want[0]
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == want
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    lines = {}
    for r in tokens.attribute_tokens(docs_df(spark, rows)).collect():
        lines.setdefault(r["doc_id"], []).append(r["n_tokens"])
    assert all(sum(lines.get(k, [])) == len(w) for k, w in enumerate(want))
    start = 0
    by = {r["doc_id"]: r for r in tokens.read_shards(tokens.write_shards(docs_df(spark, rows))).collect()}
    for k, w in enumerate(want):
        assert (by[k]["start"], by[k]["n_tokens"], by[k]["ids_crc32"]) == (start, len(w) + 1, zlib.crc32(np.array([*w, 2], "<u4").tobytes()))
        start += len(w) + 1


def test_attribution(spark):
    rows = ODD + [(20, "Über añ\nlines\n\n日本 x", "d")]
    got = tokens.attribute_tokens(docs_df(spark, rows, True)).collect()
    tok = tokens.Encoder.at(tokens.default_path()).tokenizer
    for i, t, _ in rows:
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["section"])
        assert sum(r["n_tokens"] for r in own) == len(tok.encode(t or "", add_special_tokens=False).ids)
        assert "".join((t or "")[r["start_char"] : r["end_char"]] for r in own) == (t or "")
    spans = spark.createDataFrame([(1, "hello worlds", [(0, 8), (8, 12), (3, 3), (50, 60)]), (2, None, [(0, 4)]), (3, "x", None)], "doc_id long, text string, s array<struct<start:int,end:int>>")
    cut = {(r["doc_id"], r["section"]): r for r in tokens.attribute_tokens(spans, "s").collect()}  # hello| worlds
    assert (cut[1, 0]["n_tokens"], cut[1, 0]["n_crossing"], cut[1, 1]["n_tokens"], cut[1, 1]["n_crossing"]) == (2, 1, 0, 1)
    assert abs(cut[1, 0]["share"] + cut[1, 1]["share"] - 2) < 1e-9 and cut[1, 2]["n_tokens"] == cut[1, 3]["n_tokens"] == cut[2, 0]["n_tokens"] == 0
    both = {(r["doc_id"], r["section"]): r["n_tokens"] for r in tokens.attribute_tokens(spans, "s", "all").collect()}
    assert both[1, 0] == 2 and both[1, 1] == 1


@pytest.mark.parametrize("rule", ["first", "last", "all"])
def test_lines_tokens_one_by_one(spark, rule):
    bits = ["a", "Bc ", "  ", "\n", "\n\n", "12", "don't", "\t\n x", "end.\n", "é", "日本", "<|endoftext|>"]
    rows = [(k, "".join(random.choice(bits) for _ in range(random.randint(0, 25))), "s") for k in range(150)]
    tok = plain_tokenizer()
    want = []
    for i, t, _ in rows:
        raw, at, spans = t.encode(), 0, []
        for x in tok.encode(t, add_special_tokens=False).ids:
            size = len(tok.decode([x], skip_special_tokens=False).encode()) if x == 50256 else len(tok.id_to_token(x))
            spans.append((at, at + size))
            at += size
        assert at == len(raw)
        begin = 0
        for n, line in enumerate(raw.splitlines(keepends=True) if b"\r" not in raw else []):
            a, b = begin, begin + len(line)
            touch = [(p, q) for p, q in spans if p < b and q > a]
            own = [(p, q) for p, q in touch if (rule == "all") or (rule == "first" and p >= a) or (rule == "last" and q <= b)]
            share = sum((min(q, b) - max(p, a)) / (q - p) for p, q in touch)
            want.append((i, n, len(own), sum(p < a or q > b for p, q in touch), round(share, 6)))
            begin = b
    got = tokens.attribute_tokens(docs_df(spark, rows), rule=rule).collect()
    assert sorted((r["doc_id"], r["section"], r["n_tokens"], r["n_crossing"], round(r["share"], 6)) for r in got) == sorted(want) and len(want) > 300


def test_token_shards(spark):
    rows = ODD + [(k, f"text number {k} " * 20, "e") for k in range(100, 160)]
    shards = tokens.write_shards(docs_df(spark, rows), limit=500)
    got = tokens.read_shards(shards).collect()
    tok, start = tokens.Encoder.at(tokens.default_path()).tokenizer, 0
    assert shards.count() > 3 and len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (by[i]["start"], by[i]["n_tokens"], by[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.read_shards(tokens.write_shards(docs_df(spark, []))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_wavelet_matrix(n):
    x = np.random.default_rng(n).integers(0, 300, n).astype(np.uint16)
    w = WaveletMatrix.from_bytes(WaveletMatrix.build(x).to_bytes())
    assert (w.tokens() == x).all()
    for i in range(0, n, 611):
        t = int(x[i])
        at = np.flatnonzero(x == t)
        assert w.access(i) == t and w.count(t) == len(at) and w.count(t, i) == (x[:i] == t).sum() and w.select(t, len(at) - 1) == at[-1]
        assert w.occurrences(t).tolist() == at.tolist()
    assert w.count(70_000) == 0 and not len(w.occurrences(70_000))


def test_tokens_are_counted_and_found_in_shards(spark):
    rows = [(k, f"text number {k % 7} <|endoftext|> " * (k % 4), "e") for k in range(60)] + [(None, "number", "e"), (None, "text", "e"), (5, "number", "e")]
    shards = tokens.write_shards(docs_df(spark, rows), limit=300)
    tok = plain_tokenizer()
    want, count = [], {}
    for i, t, _ in rows:
        for at, x in enumerate([*tok.encode(t, add_special_tokens=False).ids, 2]):
            count[x] = count.get(x, 0) + 1
            want.append((x, i, at))
    ids = [*list(count)[:5], 2, 50256, 49999]
    assert {r["token"]: r["n"] for r in tokens.count_tokens(shards, ids).collect()} == {t: count.get(t, 0) for t in ids}
    for t in (50256, ids[1], 49999):
        assert sorted(map(str, map(tuple, tokens.find_token(shards, t).collect()))) == sorted(str((i, at)) for x, i, at in want if x == t)


def test_toxicity(spark):
    word = lambda: "".join(random.choice("etaoinsh") for _ in range(random.randint(2, 7)))
    rows, labels = list(ODD), []
    for k in range(100, 700):
        w = [word() for _ in range(random.randint(5, 60))]
        bad = k % 5 == 0
        if bad:
            w[random.randrange(len(w))] = random.choice(["Stupid", "worthless", "moron!"])
        rows.append((k, " ".join(w), "s"))
        labels.append((k, int(bad)))
    labels += [(None, 1), (5, None), (100, 1)]
    docs, known = docs_df(spark, rows, True), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    out = toxicity.score(docs, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["h"] and (r["doc_id"] or 0) >= 100]
    assert len(held) > 80 and all((r["score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in held)
    same = toxicity.train(docs, known)
    assert (same.buckets == model.buckets).all() and np.allclose(same.weights, model.weights)
    assert toxicity.train(docs, known.where("toxic = 0")).intercept == -40


def plain_grams(text):
    """An independent statement of a text's hashed n-grams."""
    raw = [32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
    out, full = set(), 2**64 - 1
    for n in (4, 5):
        for a in range(len(raw) - n + 1):
            x = (int.from_bytes(bytes(raw[a : a + n]), "little") + n) * 0x9E3779B97F4A7C15 & full
            x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & full
            out.add(x >> 42)
    return out


def test_toxicity_equals_a_plain_fit(spark):
    words = ["calm", "river", "stone", "light", "paper", "green", "idiot", "trash", "scum"]
    rows = [(None, "x", "s"), (1, None, "s")]
    for k in range(10, 310):
        w = [random.choice(words[:6]) + random.choice("abcdefgh") for _ in range(12)]
        if k % 4 == 0:
            w[random.randrange(12)] = words[6 + k % 3]
        rows.append((k, " ".join(w), "s"))
    labels = [(k, int(k % 4 == 0)) for k in range(10, 310)]
    docs, known = docs_df(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    texts = {i: plain_grams(t) for i, t, _ in rows if i is not None and i >= 10}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    y = np.array([float(i % 4 == 0) for i in train])
    n1, n0 = y.sum(), len(y) - y.sum()
    ones, zeros = {}, {}
    for i in train:
        for g in texts[i]:
            side = ones if i % 4 == 0 else zeros
            side[g] = side.get(g, 0) + 1
    keep = {}
    for g in {*ones, *zeros}:
        a, b = ones.get(g, 0), zeros.get(g, 0)
        pooled = (a + b) / (n1 + n0)
        z = abs(a / n1 - b / n0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
        if a + b >= 3 and z >= 4:
            keep[g] = np.log((a + 1) / (n1 + 2)) - np.log((b + 1) / (n0 + 2))
    assert set(model.buckets.tolist()) == set(keep) and len(keep) >= 6
    ratio = np.array([keep[g] for g in model.buckets.tolist()])
    x = np.array([[g in texts[i] for g in model.buckets.tolist()] for i in train]) * ratio
    w = model.weights / ratio
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))  # the fit's own conditions: gradients vanish
    assert np.abs(x.T @ (p - y) + toxicity.L2 * w).max() < 0.02 * len(y) ** 0.5 and abs((p - y).sum()) < 0.02 * len(y) ** 0.5
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, grams in texts.items():
        z = model.intercept + sum(v for g, v in zip(model.buckets.tolist(), model.weights) if g in grams)
        assert abs(scores[i] - 1 / (1 + np.exp(-z))) < 1e-9 and (scores[i] >= toxicity.THRESHOLD) == (i % 4 == 0)


def test_decontamination(spark):
    words = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(random.sample(words, 30))) for k in range(20)] + [(98, None), (99, "")]
    rows = list(ODD)
    for k in range(20):
        w = items[k][1].split()
        edited = [x if random.random() > 0.12 else "edit" for x in w]
        del edited[random.randrange(len(edited))]
        noise = [random.choice(words) for _ in range(100)]
        rows += [(100 + k, " ".join(noise + [f"({x.upper()}," for x in w] + noise), "s"), (200 + k, " ".join(noise + edited), "s"), (300 + k, " ".join(random.choice(words) for _ in range(300)), "s")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(docs_df(spark, rows, True), bench).collect()}
    assert set(got) == {(100 + k, k) for k in range(20)} | {(200 + k, k) for k in range(20)}
    assert all(got[100 + k, k] == 1.0 for k in range(20))
    assert decontam.contaminated(docs_df(spark, []), bench).count() == 0


def test_decontamination_keeps_common_and_lone_seeds(spark):
    base = [f"b{i}" for i in range(30)]
    edited = [x if i % 6 != 5 or i == 29 else f"e{i}" for i, x in enumerate(base)]  # 4 edits: 11 of 27 seeds left
    phrase = ["c1", "c2", "c3", "c4"]
    hot, lone = [*phrase, *(f"x{i}" for i in range(6))], [*phrase, "e", "x1", "x2", "x3", "e", "x5"]  # only the common seed is left
    bench = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(hot))], "item_id int, text string")
    for size in (5, 12000):
        for copies in (1, 1000):
            if copies > size:
                continue
            texts = [[f"n{k}", *phrase, f"m{k}"] for k in range(size)] + [["o", *edited, "o"]] * copies + [["o", *base[:16], "o"], ["o", *lone, "o"]]
            rows = [(k, " ".join(t), "s") for k, t in enumerate(texts)]
            got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(docs_df(spark, rows), bench).collect()}
            assert set(got) == {(size + k, 1) for k in range(copies + 1)} | {(size + copies + 1, 2)}
            assert abs(got[size, 1] - 0.8) < 1e-9 and abs(got[size + copies, 1] - 16 / 30) < 1e-9


def edited_copies(rng, item, words):
    """Copies without rows of seeds: every fourth or third word replaced, a word put in after every third or second, halves swapped, words dropped."""
    other = lambda: rng.choice(words)
    yield [other() if k % 4 == 3 else x for k, x in enumerate(item)]
    yield [other() if k % 3 == 2 else x for k, x in enumerate(item)]
    yield [y for k, x in enumerate(item) for y in ([x, other()] if k % 3 == 2 else [x])]
    yield [y for k, x in enumerate(item) for y in ([x, other()] if k % 2 else [x])]
    yield [*item[len(item) // 2 :], *item[: len(item) // 2]]
    yield [x for k, x in enumerate(item) if k % 3]


@pytest.mark.parametrize("way", ["", "stretches", "few hits", "slices"])
def test_decontamination_equals_alignment_of_all_pairs(spark, monkeypatch, way):
    if way == "stretches":
        monkeypatch.setattr(decontam, "STRETCH", 16)
    if way == "few hits":
        monkeypatch.setattr(decontam, "HITS", 8)
    if way == "slices":
        monkeypatch.setattr(decontam, "SLICE_BYTES", 300)
    rng = random.Random(17)
    lots, few = [f"w{i}" for i in range(400)], [f"w{i}" for i in range(8)]
    items = [[rng.choice(lots) for _ in range(rng.randint(1, 40))] for _ in range(16)] + [[rng.choice(few) for _ in range(rng.randint(4, 14))] for _ in range(10)]
    texts = [[rng.choice([*few, "other"]) for _ in range(rng.randint(0, 20))] for _ in range(20)]
    for n, item in enumerate(items):
        for copy in edited_copies(rng, item, lots if n < 16 else few):
            noise = [rng.choice(lots) for _ in range(rng.choice([0, 3, 90]))]
            texts.append([*noise, *copy, *noise])
    texts.append([x for item in items for x in item] * 4)  # many items in one text
    want = {}
    for i, t in enumerate(texts):
        for m, item in enumerate(items):
            score = decontam.align(*(np.array([hash(x) for x in side], np.int64) for side in (item, t)))[0] / (decontam.MATCH * len(item)) if t else 0
            want |= {(i, m): score} if score >= max(decontam.THRESHOLD, min(4, len(item)) / len(item)) else {}
    bench = spark.createDataFrame([(m, " ".join(x)) for m, x in enumerate(items)], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(docs_df(spark, [(i, " ".join(t), "s") for i, t in enumerate(texts)]), bench).collect()}
    assert got == want and len(want) > 100


def test_decontamination_of_a_long_text_of_one_phrase(spark):
    bench = spark.createDataFrame([(m, f"of the end of the {m} day of the year") for m in range(40)], "item_id int, text string")
    rows = [(0, "of the " * 60000, "s"), (1, "of the " * 30000 + "end of the 7 day of the year", "s")]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(docs_df(spark, rows), bench).collect()}
    assert got[1, 7] == 1.0 and all(got[1, m] == (1.0 if m == 7 else 17 / 20) for m in range(40))
    of = [decontam.align(np.array([hash(x) for x in f"of the end of the {m} day of the year".split()]), np.array([hash(x) for x in ["of", "the"] * 40]))[0] / 20 for m in range(40)]
    assert {m for i, m in got if i == 0} == {m for m in range(40) if of[m] >= decontam.THRESHOLD}


def test_alignment_equals_a_table():
    for _ in range(50):
        a, b = (np.array([random.randrange(5) for _ in range(random.randint(1, 12))]) for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontam.align(a, b)[0] == h.max()


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    rows = [(k, [float(v) for v in x[k]]) for k in range(400)] + [(401, None), (420, [0.0] * 16), (440, [float("nan")] + [1.0] * 15), (460, [1.0]), (480, [None] + [1.0] * 15), (399, [float(v) for v in x[399]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index, model = ann.build_index(df)
    got = {}
    for r in ann.nearest(index, model, index.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 400, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(400), -s))[:20]
        assert sorted(found) == list(range(1, 21)) and [found[r][1] for r in sorted(found)] == sorted((v[1] for v in found.values()), reverse=True)
        hit += len(set(best) & {v[0] for v in found.values()})
    assert hit / (20 * len(got)) >= 0.9
    for rows in (df.where("vec_id > 9999"), df.where("vec_id IN (401, 420, 440)"), df.select("vec_id", F.lit(None).cast("array<double>").alias("embedding"))):
        empty, none = ann.build_index(rows)
        assert ann.nearest(empty, none, empty).count() == 0
    few, own = ann.build_index(spark.createDataFrame([(20, [1.0, 2.0]), (7, [2.0, 1.0]), (8, []), (9, []), (10, [])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in ann.nearest(few, own, few.where("vec_id % 20 = 0")).collect()] == [(20, 1, 7, 4.0)]


def test_codes_find_the_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(21000, 32)) * 0.5 + rng.normal(size=(300, 32))[rng.integers(0, 300, 21000)]
    x = x.astype(np.float32)
    x[rng.permutation(21000)[:7000]] = x[0]  # a third of all rows is one vector
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(21000), "embedding": pa.array(list(x))})).repartition(8)
    index, model = ann.build_index(df)
    assert index.count() == 21000
    asked = np.arange(0, 21000, 60)
    wide, length = x.astype(np.float64), np.linalg.norm(x.astype(np.float64), axis=1)
    for metric in ann.METRICS:
        got = ann.nearest(index, model, index.where(F.col("vec_id") % 60 == 0), shortlist=1024, metric=metric).toPandas()  # under a twentieth is reranked
        s = wide[asked] @ wide.T
        s = s / length / length[asked][:, None] if metric == "cosine" else 2 * s - length**2 - (length**2)[asked][:, None] if metric == "euclidean" else s
        s[np.arange(len(asked)), asked] = -np.inf
        hit = 0
        for k, q in enumerate(asked):
            best = np.lexsort((np.arange(21000), -s[k].round(9)))[:20]
            mine = got[got.query_id == q].sort_values("rank")
            assert list(mine["rank"]) == list(range(1, 21)) and np.allclose(mine.score, s[k][mine.vec_id], atol=1e-6)
            hit += len(set(best) & set(mine.vec_id))
        assert hit / (20 * len(asked)) >= 0.9, metric


def test_mixing(spark):
    rows = [(k, "w " * random.randint(0, 9), random.choice(["a", "b", "c", None])) for k in range(300)] + ODD[:6] + [(3, "w w", "a"), (3, "w w", "a")]
    docs = docs_df(spark, rows, True)
    out = mixing.mix_sources(docs)
    got = out.collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, out.collect()))
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by.setdefault(r["source"], [0, r["source_size"], r["target"]])
        s[0] += r["taken"]
    assert all(s[0] == int(s[2]) and s[2] <= 2 * s[1] + 1e-9 for s in by.values()) and abs(sum(s[2] for s in by.values()) - 1.5 * total) < 1e-6
    # the mix itself: rows that share an id, equal rows and rows without an id, on both sides of the cut
    for more in ([], [(None, "n m", "a")] * 400, [(3, "w w w", "b")] * 300 + [(3, "v w w", "b")] * 50 + [(None, f"t{k} u", None) for k in range(100)]):
        own = docs_df(spark, rows + more)
        mixed = mixing.mixed_documents(own).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
        want = {r["source"]: 0 for r in mixed}
        for r in mixing.mix_sources(own).collect():
            if r["source"] in want:
                want[r["source"]] += r["taken"]
        assert {r["source"]: r["n"] for r in mixed} == want
    assert mixing._mixed(own, "mix").where("doc_id IS NULL").select("mark").distinct().count() > 100  # no one key for rows without an id
    assert mixing.mix_sources(docs_df(spark, [])).count() == 0


def test_sharding(spark):
    table = sharding.fill_table(sharding.shard_names(7), 701)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    less = sharding.fill_table([n for n in sharding.shard_names(7) if n != "shard-00003"], 701)
    names = [n for n in range(7) if n != 3]
    moved = sum(a != 3 and names[b] != a for a, b in zip(table, less))
    assert moved < 0.25 * 701
    got = sharding.assign_shards(docs_df(spark, ODD, True)).collect()
    assert len(got) == len(ODD) and all(isinstance(r["shard"], int) for r in got)


def test_line_dedup(spark):
    rows = [(k, f"unique {k}\n  Boiler  \n\nshared {k // 2}", f"s{k % 8}") for k in range(40)] + [(50, None, "x"), (51, "", None), (52, "Boiler", None), (52, "Boiler", None)]
    rows += [(60 + k, "five sites", f"s{k}") for k in range(5)] + [(70 + k, "six sites", f"s{k}") for k in range(6)]
    got = sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in linededup.dedup_lines(docs_df(spark, rows, True)).collect())
    want = []
    for i, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if x.strip(" ") not in ("Boiler", "six sites")]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert got == sorted(want)


def test_decontamination_short_items(spark):
    bench = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "solo"), (3, "two words"), (4, "..."), (5, "alpha beta gamma delta")], "item_id int, text string")
    rows = [(1, "foo bar alpha beta gamma delta baz", "s"), (2, "alpha, beta", "s"), (3, "x solo. y", "s"), (4, "words two words", "s"), (5, "solos", "s"), (6, "a ... b", "s"), (7, None, "s")]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(docs_df(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (1, 5), (3, 2), (4, 3), (6, 4)} and set(got.values()) == {1.0}


def test_near_duplicates_shared_ids(spark):
    text = lambda n: " ".join(f"t{n}w{i}" for i in range(40))
    near = text(3).replace("t3w39", "other")
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (3, text(2)), (4, text(3)), (5, near), (5, ""), (6, None), (6, ""), (7, text(4)), (7, near), (8, text(4)), (None, text(1)), (2, text(1)), (9, text(5)), (9, text(5))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets, up = {}, {i: i for i, _ in rows if i is not None}
    for i, t in rows:
        w = (t or "").split()
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in up:
        for b in up:
            if any(x & y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got) == sorted((str(i), None if i is None else root(i), i is None or root(i) == i) for i, _ in rows)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_of_the_operators_own_names(spark):
    names = "left_ slot_ shard_ id_ words_ rid gone row whole take target key range of base taken n_chars comp rep sketch".split()
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d e f", "y"), (3, None, None)], "doc_id long, text string, source string").withColumns({n: F.lit(7) for n in names})
    for out in (sharding.assign_shards(docs), mixing.mixed_documents(docs)):
        rows = out.collect()
        assert rows and all(r[n] == (7 if n != "n_chars" else r[n]) for r in rows for n in names)
    assert neardup.near_duplicates(docs).count() == linededup.dedup_lines(docs).count() == tokens.read_shards(tokens.write_shards(docs)).count() == substrings.remove_repeats(docs).count() == 3
    assert len(mixing.mix_sources(docs).collect()) == 3 and tokens.attribute_tokens(docs).count() == 2
    vectors = spark.createDataFrame([(k, [float(k + 1), 1.0]) for k in range(30)], "vec_id long, embedding array<float>").withColumns({n: F.lit(7) for n in ("codes", "norm", "vector", "block", "asked", "score", "query_id", "rank")})
    index, model = ann.build_index(vectors)
    assert ann.nearest(index, model, index.where("vec_id % 20 = 0")).count() == 40


def test_empty_tables(spark):
    docs, labels = docs_df(spark, [], True), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    empty = [toxicity.score(docs, model), neardup.near_duplicates(docs), tokens.attribute_tokens(docs), substrings.remove_repeats(docs), sharding.assign_shards(docs), linededup.dedup_lines(docs), mixing.mixed_documents(docs)]
    assert all(df.count() == 0 for df in empty)
    bench = spark.createDataFrame([], "item_id int, text string")
    assert decontam.contaminated(docs_df(spark, ODD), bench).count() == 0


def test_very_long_lines_and_texts_keep_their_lines(spark):
    lines = [f"line {i}" if i % 2 else "\tBoiler \r" for i in range(20000)]
    rows = [(k, "\n".join([*lines, f"own {k}"]), f"s{k}") for k in range(7)] + [(9, "Boiler\nx", "s1")]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs_df(spark, rows)).collect()}
    assert all((got[k]["n_lines"], got[k]["n_removed"], got[k]["text"]) == (20001, 20000, f"own {k}") for k in range(7)) and got[9]["text"] == "x"


def test_hot_keys_meet_in_several_tasks(spark, monkeypatch):
    from graphlens.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    side = spark.range(2000).select(F.col("id").alias("k"), F.lit(1).alias("salt"))
    assert common.matched(rows, side, ["k"], "id").count() == rows.where("k < 2000").count()
    rows = [(k, f"unique {k}\nBoiler\nfive", f"s{k % 8}") for k in range(40)] + [(100 + k, "six", f"s{k}") for k in range(6)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs_df(spark, rows)).collect()}
    assert got == {k: f"unique {k}" for k in range(40)} | {100 + k: "" for k in range(6)}


def test_near_duplicate_workers_take_small_steps():
    """A pipeline's executor ended over its memory, part of it what workers kept from steps of 2 MB."""
    import tracemalloc

    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 50000, 40000)) for _ in range(16)])
    ids = pa.array(range(16), pa.int64())
    for run, columns in ((neardup._sign, [ids, texts]), (neardup._confirmed, [ids, ids, texts, texts])):
        batch = pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])
        tracemalloc.start()
        assert sum(b.num_rows for b in run(iter([batch]))) == 16
        assert tracemalloc.get_traced_memory()[1] < 32e6
        tracemalloc.stop()
