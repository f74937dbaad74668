"""SimHash, repeated passages and embeddings against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridlark.llm import embedding, graph, simhash, substring

from .conftest import ROWS


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    draw = random.Random(4)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(0, 0)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    want = union(500, pairs)
    assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_masks_cover_the_radius():
    for radius in (1, 2, 3):
        masks = simhash.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        draw = random.Random(radius)
        for _ in range(500):
            difference = sum(1 << i for i in draw.sample(range(64), radius))
            assert any(difference & m == 0 for m in masks)


def slow_fingerprint(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(docs, no_docs):
    got = simhash.classes(docs).collect()
    prints = [slow_fingerprint(t) for _, t, _ in ROWS]
    assert sorted((str(r.doc_id), r.fp % 2**64) for r in got) == sorted((str(k), p) for (k, *_), p in zip(ROWS, prints))
    n = len(ROWS)
    roots = union(n, [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {r: min((ROWS[i][0] for i in range(n) if roots[i] == r and ROWS[i][0] is not None), default=None) for r in roots}
    assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted((str(ROWS[i][0]), least[roots[i]]) for i in range(n))
    assert simhash.classes(no_docs).count() == 0


@pytest.mark.parametrize("array", [4096, 2])
def test_simhash_links_lose_nothing(spark, array):
    draw = random.Random(8)
    values = {0}
    while len(values) < 400:
        x = draw.choice(sorted(values)) if draw.random() < 0.7 else draw.getrandbits(64)
        values.add(x ^ sum(1 << i for i in draw.sample(range(64), draw.randint(0, 3))))
    values = sorted(v - 2**64 if v >> 63 else v for v in values)
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = [tuple(r) for r in simhash.links(distinct, array=array).collect()]
    at = {v: i for i, v in enumerate(values)}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 64 for a, b in edges)
    near = [(i, j) for i in range(len(values)) for j in range(i) if ((values[i] ^ values[j]) & (2**64 - 1)).bit_count() <= 2]
    assert union(len(values), [(at[a], at[b]) for a, b in edges]) == union(len(values), near)


def slow_strip(rows):
    owner = {}
    words = [(k, (t or "").encode().split()) for k, t, *_ in rows]
    for k, w in words:
        for i in range(len(w) - 49):
            if k is not None:
                owner[tuple(w[i : i + 50])] = min(owner.get(tuple(w[i : i + 50]), k), k)
    out = []
    for k, w in words:
        gone = {j for i in range(len(w) - 49) if k is not None and owner[tuple(w[i : i + 50])] < k for j in range(i, i + 50)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((str(k), len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def passages(seed, n=60):
    draw = random.Random(seed)
    pool = [[f"p{i}w{draw.randrange(40)}" for _ in range(draw.randint(45, 140))] for i in range(6)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(draw.randint(1, 3)):
            words += [f"u{k}v{draw.randrange(9)}" for _ in range(draw.randint(0, 30))]
            part = draw.choice(pool)
            a = draw.randrange(0, 20)
            words += part[a : a + draw.randint(30, 120)]
        rows.append((k, " ".join(words), "en"))
    return [*rows, (n, "same " * 200, "en"), (n + 1, "other " + "same " * 150, "en")]


def stripped(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.strip(df, digest=True).collect())


@pytest.mark.parametrize("group", [20_000, 8, 2, 0])
def test_repeated_passages(spark, docs, monkeypatch, group):
    """Also where prefixes are made longer, up to whole windows."""
    monkeypatch.setattr(substring.lost_windows, "__defaults__", (group,))
    monkeypatch.setattr(substring.repeats, "__defaults__", (group,))
    passage = [f"s{i}" for i in range(66)]
    spread = [(1000 + k, " ".join([f"a{k}x{i}" for i in range(k % 60)] + passage[k % 9 :] + [f"b{k}x{i}" for i in range(40)]), "en") for k in range(80)]
    assert stripped(docs) == slow_strip(ROWS)
    for rows in (passages(3), spread):
        assert stripped(spark.createDataFrame(rows, "doc_id long, text string, lang string")) == slow_strip(rows)


def test_repeated_keys_lose_their_own_words_only(spark):
    p = " ".join(f"p{i}" for i in range(60))
    own = " ".join(f"u{i}" for i in range(80))
    rows = [(1, p), (5, p + " x y z"), (5, own), (5, own), (6, own), (5, own + " " + p), (2, p), (2, p)]
    assert stripped(spark.createDataFrame(rows, "doc_id long, text string")) == slow_strip(rows)


def test_a_very_long_text(spark):
    """Longer than a step's characters, with a passage at its end that a smaller key has."""
    draw = random.Random(1)
    words = [f"w{draw.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(words[-70:])), (2, " ".join(words)), (3, " ".join(words[1000:1100]))]
    assert len(rows[1][1]) > 1 << 20
    got = {r[0]: r[1:3] for r in stripped(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {"1": (70, 0), "2": (200_000, 70), "3": (100, 100)}


def test_strip(docs, no_docs):
    assert stripped(docs) == slow_strip(ROWS)
    changed = substring.strip(docs)
    assert changed.columns == docs.columns and changed.count() == len(ROWS)
    assert substring.strip(no_docs, digest=True).count() == 0


def test_strip_keeps_columns_of_any_name(docs):
    names = ["spans", "key", "hash", "c1", "__spans"]
    more = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    got = substring.strip(more)
    assert got.columns == more.columns and {tuple(r[-5:]) for r in got.collect()} == {(0, 1, 2, 3, 4)}


def cloud(seed, n, dims=8):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n, dims))
    near = base[draw.integers(0, n // 4, n)] + draw.normal(size=(n, dims)) * 0.05
    return np.where(draw.random((n, 1)) < 0.6, near, base).astype(np.float32)


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding, "CELL", 64)
    points = cloud(5, 300)
    rows = [(i, points[i].tolist(), i % 3) for i in range(300)] + [(300 + i, points[i].tolist(), i % 3) for i in range(40)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] + [1.0] * 7, 1), (403, [None] + [1.0] * 7, 1), (404, points[0].tolist(), None), (405, [], 1), (406, [1.0, 0.0], 1), (407, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.classes(df).collect()}
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and x == x for x in r[1]) and any(r[1])]
    pairs, links = [], {r[0]: 0 for r in rows}
    for i, a in enumerate(good):
        for j in range(i):
            b = good[j]
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    pairs.append((a[0], b[0]))
                    links[a[0]] += 1
                    links[b[0]] += 1
    roots = union(500, pairs)
    assert got == {r[0]: (links[r[0]], roots[r[0]], roots[r[0]] == r[0]) for r in rows}
    assert embedding.classes(df.where("1 = 0")).count() == 0


def test_vectors_of_one_direction(spark, monkeypatch):
    """More multiples of one vector, and more vectors in a tiny ball, than a cell holds; rows without a key."""
    monkeypatch.setattr(embedding, "CELL", 64)
    draw = np.random.default_rng(3)
    rows = [(k, [float(k + 1), 0.0, 0.0], "x") for k in range(300)] + [(300 + k, [0.0, 3.0 * (k + 1), 7.0 * (k + 1)], "x") for k in range(200)]
    rows += [(500 + k, (np.array([1.0, 1.0, -1.0]) + draw.normal(size=3) * 1e-9).tolist(), "x") for k in range(300)]
    rows += [(None, [0.0, 0.0, 1.0], "y"), (None, [0.0, 0.0, 2.0], "y"), (None, None, "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding.classes(df).collect())
    want = [(str(k), n - 1, a, k == a) for a, n in ((0, 300), (300, 200), (500, 300)) for k in range(a, a + n)]
    assert got == sorted([*want, ("None", 1, None, True), ("None", 1, None, True), ("None", 0, None, True)])


def test_pairs_at_the_bound(spark, monkeypatch):
    """Links at cosines within some 1e-9 of the bound on either side, each decided by its dot product."""
    monkeypatch.setattr(embedding, "CELL", 32)
    draw, rows = np.random.default_rng(9), []
    for i in range(150):
        a = embedding.unit(draw.normal(size=(1, 16)))[0]
        b = draw.normal(size=16)
        b -= (a @ b) * a
        c = 0.98 + draw.choice([-1, 1]) * 10.0 ** draw.uniform(-12, -8)
        rows += [(2 * i, a.tolist(), "x"), (2 * i + 1, (c * a + (1 - c * c) ** 0.5 * b / np.linalg.norm(b)).tolist(), "x")]
    points = embedding.unit(np.array([r[1] for r in rows]))
    want = ((points @ points.T) >= 0.98).sum(1) - 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert {r.vec_id: r.n_links for r in embedding.classes(df).collect()} == dict(enumerate(want.tolist()))


def test_cover_tree_covers():
    points = embedding.unit(cloud(6, 500))
    tree = embedding.CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(500))
    for i, children in enumerate(tree.children):
        members = tree.order[tree.first[i] : tree.last[i]]
        assert (np.linalg.norm(points[members] - points[tree.center[i]], axis=1) <= tree.radius[i] + 1e-6).all()
        assert all(tree.radius[c] <= tree.radius[i] / 2 + 1e-9 for c in children)
