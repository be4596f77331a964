"""Problems 5 and 9 against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabbyline.llm import pack, similar


def vectors(seed, n, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    near = x[: n // 4] + rng.normal(scale=0.2, size=(n // 4, dim)).astype(np.float32)
    return np.concatenate([x, near, x[:20] * 3])


def frame(spark, x, extra=()):
    rows = [(f"v{n:04d}", v.tolist()) for n, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id string, embedding array<float>").withColumns({"h": F.lit(1), "v": F.lit(2), "cell": F.lit(3)})


BAD = [("n", None), ("e", []), ("z", [0.0] * 64), ("s", [1.0] * 3), ("i", [float("inf")] * 64), ("q", [float("nan")] * 64), ("m", [None] + [1.0] * 63), (None, [1.0] * 64)]


def test_pairs(spark):
    x = vectors(1, 900)
    df = frame(spark, x, [*BAD, ("v0000", x[0].tolist()), ("copy", x[1].tolist())])
    ids = [f"v{n:04d}" for n in range(len(x))] + ["copy"]
    u = np.concatenate([x, x[1:2]]).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    wanted = {tuple(sorted((ids[i], ids[j]))) for i, j in zip(a, b)}
    got = [(r["id_a"], r["id_b"]) for r in similar.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= wanted and len(set(got)) >= 0.99 * len(wanted)
    assert ("copy", "v0001") in got


def test_classes(spark):
    x = vectors(6, 400)
    df = frame(spark, x, [*BAD, ("a_copy", x[3].tolist()), ("z_copy", x[3].tolist()), ("v0003", x[3].tolist())])
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    rows = {r["k"]: (r["class_id"], r["copies"], r["links"]) for r in similar.SimilarityIndex(df).classes().collect()}
    assert len(rows) == len(x) + 2 and rows["a_copy"] == rows["z_copy"] == rows["v0003"] == ("a_copy", 3, int(close[3].sum()) - 1)
    wrong = [n for n in range(len(x)) if n != 3 and rows[f"v{n:04d}"] != (f"v{n:04d}", 1, int(close[n].sum()) - 1)]
    assert len(wrong) <= 0.01 * len(x)


def test_nearest(spark):
    x = vectors(2, 800)
    df = frame(spark, x, BAD)
    rows = similar.SimilarityIndex(df).nearest(F.col("k") < "v0060", k=5).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    found = collections.defaultdict(list)
    for r in rows:
        found[r["k_a"]].append((r["rank"], r["k_b"], r["cosine"]))
    for n in range(60):
        s = u @ u[n]
        s[n] = -9
        best = {f"v{i:04d}" for i in np.argsort(-s)[:5]}
        mine = sorted(found[f"v{n:04d}"])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(p[2] >= q[2] for p, q in zip(mine, mine[1:]))
        hit += len(best & {m[1] for m in mine})
    assert hit / 300 >= 0.9


def test_empty(spark):
    df = frame(spark, vectors(3, 4)[:0], BAD)
    assert similar.similar_pairs(df).count() == 0 and similar.SimilarityIndex(df).nearest(F.lit(True)).count() == 0
    one = frame(spark, vectors(3, 8)[:1])
    assert similar.similar_pairs(one).count() == 0
    assert similar.SimilarityIndex(df).classes().count() == 0 and similar.SimilarityIndex(one).classes().count() == 1
    with pytest.raises(ValueError):
        similar.SimilarityIndex(df, dim=63)


def test_blocks_of_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(similar, "QUERY_BLOCK", 32)
    monkeypatch.setattr(similar, "CODE_BLOCK", 64)
    x = vectors(4, 300)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert similar.similar_pairs(frame(spark, x)).count() == int(np.triu(u @ u.T >= 0.9, 1).sum())


def test_scan_is_the_product_with_the_codes():
    x = similar.unit(vectors(5, 200))
    q = similar.Quantiser(x, 4)
    codes = similar.encode(x, q.books)
    rebuilt = np.concatenate([q.books[g][codes[:, g]] for g in range(codes.shape[1])], axis=1)
    for at, scores in similar.scan(x[:70], similar.pack_codes(codes), q.books, block=32):
        assert np.allclose(scores, rebuilt @ x[at : at + scores.shape[1]].T, atol=1e-4)
    along = np.abs(1 - (rebuilt * x).sum(1)).mean()
    assert along < 0.1  # the parallel residual is what the loss keeps small


@pytest.mark.parametrize("seed, n, most, capacity", [(1, 0, 9, 10), (2, 1, 10, 10), (3, 60, 30, 60), (4, 3000, 900, 1000)])
def test_plan(seed, n, most, capacity):
    rng = random.Random(seed)
    sizes = collections.Counter(rng.randint(1, most) for _ in range(n))
    used = collections.Counter()
    bins = 0
    for pattern, times in pack.plan(sizes, capacity):
        assert times > 0 and sum(s * k for s, k in pattern.items()) <= capacity
        bins += times
        for s, k in pattern.items():
            used[s] += k * times
    assert used == sizes
    least = -(-sum(s * k for s, k in sizes.items()) // capacity)
    assert bins <= max(least + 2, 1.05 * least)


def test_best_pair():
    rng = random.Random(7)
    for _ in range(300):
        counts = np.array([0] + [rng.choice([0, 0, 1, 2]) for _ in range(20)])
        gap = rng.randint(1, 20)
        items = [s for s in range(1, 21) for _ in range(counts[s])]
        best = max((a + b for i, a in enumerate(items) for b in items[i + 1 :] if a + b <= gap), default=0)
        assert sum(pack._best_pair(counts, gap)) == best


def test_pack(spark):
    rng = random.Random(8)
    rows = [(n, rng.choice([None, 0, 5, 5, 5, 17, 40, 64, 65, 128, 400])) for n in range(500)] + [(None, 5), (1, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint").withColumns({"k": F.lit(1), "class": F.lit(2), "part": F.lit(3), "place": F.lit(4)}).repartition(3)
    packed = pack.pack(df, "doc_id", "n", 64)
    got = packed.collect()
    assert collections.Counter((r["doc_id"], r["parts"]) for r in got if r["part"] == 0) == collections.Counter((k, max(1, -(-(n or 0) // 64))) for k, n in rows)
    sizes = collections.Counter()
    for r in got:
        assert (r["container"] is None) == (not r["n"]) and 0 <= r["part"] < r["parts"] and (r["n"] or 0) <= 64
        sizes[r["doc_id"]] += r["n"] or 0
    assert sizes == collections.Counter({k: sum(n or 0 for i, n in rows if i == k) for k, _ in rows})
    held = pack.fills(packed, "n", 64).collect()
    assert all(0 <= r["room"] < 64 and r["room"] + r["n"] == 64 and r["items"] > 0 for r in held)
    least = -(-sum(n or 0 for _, n in rows) // 64)
    assert least <= len(held) <= 1.03 * least + 1
    assert pack.pack(df.limit(0), "doc_id", "n", 64).count() == 0


def test_packed_texts(spark):
    from tabbyline.llm.bpe import encoder

    long, count = "One cat sleeps here. " * 40 + "\n\n" + "Two dogs run there. " * 40, encoder().count
    df = spark.createDataFrame([(1, long), (2, "cat"), (3, None), (4, ""), (1, long), (None, long), (5, " ")], "doc_id bigint, text string").withColumns({"part": F.lit(1), "n": F.lit("x")})
    packed = pack.pack_documents(df, capacity=60).collect()
    assert all((r["tokens"] or 0) <= 60 for r in packed)
    by = collections.Counter()
    for r in packed:
        by[r["doc_id"]] += r["tokens"]
    assert by == {1: 2 * count(long), None: count(long), 2: count("cat"), 3: 0, 4: 0, 5: count(" ")}
    assert [r["doc_id"] for r in pack.too_large(df, capacity=60).collect()] == [1]
    fill = collections.Counter()
    for r in packed:
        fill[r["container"]] += r["tokens"]
    assert max(v for k, v in fill.items() if k is not None) <= 60
    assert pack.too_large(df, capacity=10**6).count() == 0 == pack.pack_documents(df.limit(0)).count()
