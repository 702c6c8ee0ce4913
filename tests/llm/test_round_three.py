"""SimHash, whitening and collocations against brute force on small frames."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash

from probegrid.llm import collocations, simhash, whitening


def components(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


# --- SimHash ---------------------------------------------------------------------

def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    pieces = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_of_documents(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(400)]
    texts = ["", None, " \t\n", "One", "one two", "ONE two", "a b c", "a b c a b c", "\x1c x\x85y z w", "é É ß"]
    for i in range(30):
        near = list(base)
        near[r.randrange(400)] = f"edit{i}"
        texts.append(" ".join(near))
    texts.append(" ".join(f"v{r.randrange(90)}" for _ in range(70_000)))
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(7, "one two"), (None, "one two"), (None, "alone"), (7, texts[12])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp long, anchor int").repartition(4)
    fps = {t: slow_fingerprint(t) for _, t in rows}
    distinct = sorted(set(fps.values()))
    group = components(distinct, [(a, b) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 3])
    least = {}
    for i, t in rows:
        if i is not None:
            least[group[fps[t]]] = min(i, least.get(group[fps[t]], i))
    got = collections.Counter(tuple(r) for r in simhash.simhash_duplicates(df).collect())
    assert got == collections.Counter((i, f"{fps[t]:016x}", least.get(group[fps[t]])) for i, t in rows)
    assert simhash.simhash_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [(1024, 16384), (3, 7)])
def test_links_of_fingerprints(spark, monkeypatch, parts):
    """A ball of very close fingerprints, chains of exactly three bits, and random ones; also with anchors split."""
    monkeypatch.setattr(simhash, "HOMES", parts[0])
    monkeypatch.setattr(simhash, "REPLICAS", parts[1])
    r = random.Random(9)
    found = {r.getrandbits(64) for _ in range(300)}
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(25):
            for b in r.sample(range(64), 3):
                x ^= 1 << b
            found.add(x)
    centre = r.getrandbits(64)
    found |= {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a, 64, 5)}
    distinct = sorted(found)
    want = components(distinct, [(a, b) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 3])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links_of(spark.createDataFrame([(signed(x),) for x in distinct], "fp long").repartition(3)).collect()
    edges = [(e.a % (1 << 64), e.b % (1 << 64)) for e in edges]
    assert len(edges) < 40 * len(distinct)
    assert components(distinct, edges) == want


# --- whitening ---------------------------------------------------------------------

def test_whitening(spark):
    rng = np.random.default_rng(3)
    good = [[float(v) for v in row] for row in (rng.standard_normal((300, 12)) * np.linspace(3, 1, 12)).astype(np.float32)]
    good += good[:5]
    bad = [None, [], [1.0] * 11, [None] + [0.5] * 11, [float("nan")] + [0.5] * 11, [float("inf")] * 12, [3e38] * 12]
    rows = [(i, v, "s", 0) for i, v in enumerate(good)] + [(None, good[0], "s", 0), (3, good[9], "s", 0)] + [(900 + i, v, "s", 0) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids string, dim int").repartition(3)
    got = whitening.whiten(df).collect()
    kept = [(i, v) for i, v, _, _ in rows if i is None or i < 900]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array(x, dtype=float) - np.array(sums) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    want = centred @ vectors / np.sqrt(values)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    for k in range(8):
        mine = {(r.vec_id, r.deviation): r for r in got if r.component == k + 1}
        signs = set()
        for (i, _), row, w in zip(kept, x, want[:, k], strict=True):
            r = mine[i, sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True))]
            assert int(r.deviation_exact) == r.deviation
            assert abs(abs(r.whitened) - abs(w)) < 1e-9
            if abs(w) > 1e-6:
                signs.add(np.sign(r.whitened * w))
            assert r.explained == pytest.approx(values[k] / np.trace(cov), rel=1e-12)
        assert len(signs) == 1
    w = np.array([[r.whitened for r in got if r.component == k] for k in range(1, 9)])
    assert max(r.identity_error for r in got) < 1e-9
    assert w.shape == (8, n)


def test_whitening_of_degenerate_tables(spark):
    ddl = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], ddl)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], ddl)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], ddl)).count() == 0
    # variance in one direction only: one component
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(40)], ddl)
    assert {r.component for r in whitening.whiten(line).collect()} == {1}
    # entries far beyond 32 bits stay exact in the decimal column; the long is null where it does not fit
    large = spark.createDataFrame([(0, [1e12, 0.0]), (1, [-1e12, 1.0]), (2, [3.0, 7.0])], ddl)
    rows = {r.vec_id: r for r in whitening.whiten(large).collect()}
    x = {0: [1024 * 10 ** 12 + 100000, 100000], 1: [-1024 * 10 ** 12 + 100000, 101024], 2: [103072, 107168]}
    sums = [sum(v[i] for v in x.values()) for i in range(2)]
    for i, v in x.items():
        exact = sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        assert int(rows[i].deviation_exact) == exact
        assert rows[i].deviation == (exact if exact < 2 ** 63 else None)


def test_filter_damps_a_flat_spectrum():
    """Eigenvalues close to each other, none of them known beforehand."""
    rng = np.random.default_rng(1)
    d = 80
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = np.sort(np.concatenate([[50.0, 30.0], rng.uniform(15, 17, d - 2)]))[::-1]
    v = (q * values) @ q.T
    passes = []
    found, vectors = whitening.leading_pairs(lambda y: passes.append(1) or v @ y, d, 8)
    assert np.abs(found - values[:8]).max() < 1e-10
    assert np.abs(np.abs((vectors * q[:, :8]).sum(axis=0)) - 1).max() < 1e-9
    assert len(passes) < 120


# --- collocations -------------------------------------------------------------------

def slow_phrases(rows, least, top):
    f = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        listed = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and v >= least and p in (q[:2], q[1:]) and 100 * v >= 50 * a for q, v in c.items()):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            listed.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(listed)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("counted", [400_000, 5])
def test_collocations(spark, monkeypatch, counted):
    monkeypatch.setattr(collocations, "COUNTED", counted)
    monkeypatch.setattr(collocations, "SEGMENT", 3)
    r = random.Random(2)
    vocabulary = [*"abcdefgh", "É", "\x85", "x y"]
    rows = [("".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\x0b", "! "]) for _ in range(60)), r.choice(["en", "de", None, ""])) for _ in range(60)]
    rows += [("once upon a time there was a king who had three sons; Once upon", "en")] * 12
    rows += [("ha ha ha ha ha", "en"), ("ping pong ping pong ping pong", "xx")] * 4 + [(None, "en"), ("", None), (" ", "qq"), ("...", "en"), ("solo", "qq")]
    df = spark.createDataFrame([(t, lang, "n", 1) for t, lang in rows], "text string, lang string, phrase string, n int").repartition(4)
    got = sorted(tuple(x) for x in collocations.mine_phrases(df, 5, 40).collect())
    assert got == slow_phrases(rows, 5, 40)
    assert collocations.mine_phrases(df.limit(0)).count() == 0


def test_unary_paths(spark):
    """A chain is one path (over rows of SEGMENT edges), branches and rings end paths, every edge is in one path."""
    edges = ["a b c", "b c d", "c d e", "d e f", "d e g", "p q p", "q p q", "z z z", "s t u"]
    df = spark.createDataFrame([(i, "l", p, 10 + i) for i, p in enumerate(edges)], "edge long, lang string, phrase string, a long")
    paths = [[s.phrase for s in r.steps] for r in collocations.compact_paths(df).collect()]
    assert sorted(paths) == sorted([["a b c", "b c d", "c d e"], ["d e f"], ["d e g"], ["p q p"], ["q p q"], ["z z z"], ["s t u"]])
