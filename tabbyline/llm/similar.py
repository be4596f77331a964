"""Problem 5: the most similar vectors for every vector.

Method: score-aware (anisotropic) product quantisation. Unit vectors are coded with four bits for each
group of two dimensions, by codebooks whose loss weighs the part of the residual that is parallel to the
vector, which changes inner products, above the part across it, which hardly does. A search sends each
query to cells of a coarse clustering, scans the codes there with tables of partial inner products, two
codes to a look-up, and reranks what passes by exact cosines.

Clustering and codebooks are fitted on a bounded sample (`SAMPLE_ROWS`), every usable row is indexed.
Exact copies of a vector, however many, are one entry of the index and are put back at the end. Cells over
a block's size are searched block against block, so that no task holds an unbounded cell.

A vector is usable if it has `dim` finite values, not all zero. Null keys and unusable vectors are left out;
rows repeated under one key count once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabbyline.session import ensure_shipped, materialise

SAMPLE_ROWS = 32_768
#: Aimed-at rows per cell, and the most cells.
CELL_ROWS, MOST_CELLS = 1_024, 4_096
QUERY_BLOCK, CODE_BLOCK = 8_192, 32_768
#: Queries of a block where each keeps its best candidates.
NEAREST_BLOCK = 2_048
SUB, CENTERS = 2, 16
#: Weight of the parallel part of the residual against the part across.
PARALLEL = 4.0


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float32)
    return rows / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[at : at + 8192] @ centers.T, axis=1) for at in range(0, len(x), 8192)])


def _cluster(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 1e-6, sums / np.maximum(norms, 1e-6), centers)
    return centers.astype(np.float32)


class Quantiser:
    """Cells and codebooks, fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 7):
        roots = max(1, int(np.sqrt(cells)))
        top = _cluster(sample, roots, seed)
        own = _nearest(sample, top)
        parts = []
        for n in range(len(top)):
            members = sample[own == n]
            if len(members):
                share = max(1, round(cells * len(members) / len(sample)))
                parts.append(_cluster(members, share, seed + n))
        self.cells = np.concatenate(parts)
        self.books = self._fit_books(sample[: 1 << 13], seed)

    def _fit_books(self, x: np.ndarray, seed: int, rounds: int = 6) -> np.ndarray:
        """Codebooks `(groups, CENTERS, SUB)`: codes and a joint least-squares fit in turns."""
        rng = np.random.default_rng(seed)
        groups = x.shape[1] // SUB
        books = x.reshape(len(x), groups, SUB)[rng.choice(len(x), CENTERS, replace=len(x) < CENTERS)].transpose(1, 0, 2).copy()
        books += rng.normal(0, 1e-3, books.shape).astype(np.float32)
        size = groups * CENTERS * SUB
        for _ in range(rounds):
            codes = encode(x, books)
            # Minimise sum |r|^2 + (PARALLEL - 1) (r.x)^2 over all centers at once: normal equations.
            flat = (np.arange(groups) * CENTERS + codes)[:, :, None] * SUB + np.arange(SUB)
            spread = np.zeros((len(x), size), np.float32)
            np.put_along_axis(spread, flat.reshape(len(x), -1), x, axis=1)
            counts = np.repeat(np.bincount((np.arange(groups) * CENTERS + codes).ravel(), minlength=groups * CENTERS), SUB)
            normal = (PARALLEL - 1) * (spread.T @ spread) + np.diag(counts + 1e-3).astype(np.float32)
            books = np.linalg.solve(normal, PARALLEL * spread.sum(0)).reshape(groups, CENTERS, SUB).astype(np.float32)
        return books


def encode(x: np.ndarray, books: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Codes of unit vectors under the anisotropic loss, by coordinate descent over the groups."""
    groups = len(books)
    parts = x.reshape(len(x), groups, SUB)
    apart = np.stack([((parts[:, g, None, :] - books[g]) ** 2).sum(2) for g in range(groups)], 1)
    along = np.stack([parts[:, g] @ books[g].T for g in range(groups)], 1)  # parallel part of each choice
    codes = apart.argmin(2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(rounds):
        for g in range(groups):
            rest = total - along[rows, g, codes[:, g]]
            loss = apart[:, g] + (PARALLEL - 1) * (1 - rest[:, None] - along[:, g]) ** 2
            codes[:, g] = loss.argmin(1)
            total = rest + along[rows, g, codes[:, g]]
    return codes


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    return (codes[:, 0::2] * CENTERS + codes[:, 1::2]).astype(np.uint8)


def scan(queries: np.ndarray, packed: np.ndarray, books: np.ndarray, block: int = 64):
    """Approximate inner products, as blocks `(first query, array of codes by queries)`, from look-up tables."""
    pairs = packed.shape[1]
    for at in range(0, len(queries), block):
        q = queries[at : at + block]
        single = np.einsum("qgs,gcs->gcq", q.reshape(len(q), 2 * pairs, SUB), books)
        double = single[0::2, :, None] + single[1::2, None, :]
        tables = double.reshape(pairs, CENTERS * CENTERS, len(q))
        scores = tables[0].take(packed[:, 0], axis=0)
        for j in range(1, pairs):
            scores += tables[j].take(packed[:, j], axis=0)
        yield at, scores


def usable(column: str, dim: int) -> Column:
    """Whether a vector has `dim` finite values, not all zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)


def cosine(a: str, b: str) -> Column:
    """Exact cosine in double precision."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return dot(F.col(a), F.col(b)) / F.sqrt(dot(F.col(a), F.col(a)) * dot(F.col(b), F.col(b)))


class SimilarityIndex:
    """The index over one table: fit, code every distinct vector, search."""

    def __init__(self, df: DataFrame, key: str = "id", vector: str = "embedding", dim: int = 64, sample_rows: int = SAMPLE_ROWS):
        if dim % (2 * SUB):
            raise ValueError(f"dim must be a multiple of {2 * SUB}")
        ensure_shipped(df.sparkSession)
        rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).filter(F.col("k").isNotNull() & usable("v", dim))
        rows = rows.withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(7))})
        #: keys of each distinct vector
        self.keyed = rows.select("h", "h2", "k")
        self.members = self.keyed.distinct()
        self.vectors = materialise(rows.groupBy("h", "h2").agg(F.first("v").alias("v")), "vectors")
        # the fingerprint draws rows at random, and alike on every run; no more leave the executors than wanted
        self.rows = self.vectors.count()
        near = F.pmod("h", F.lit(1 << 31)) < int(min(1.0, 1.2 * sample_rows / max(1, self.rows)) * (1 << 31))
        drawn = self.vectors.select("h", "v").filter(near).orderBy("h").limit(sample_rows).toPandas()
        if not len(drawn):
            self.quantiser = None
            return
        sample = unit(np.stack(drawn["v"].to_numpy()))
        self.quantiser = Quantiser(sample, int(np.clip(self.rows // CELL_ROWS, 1, MOST_CELLS)))

    def coded(self, probes: int, vectors: DataFrame | None = None) -> DataFrame:
        """`(h, q, code, cells)` of these vectors (default: all): the half-precision unit vector, its code, its `probes`
        nearest cells."""
        cells, books = self.quantiser.cells, self.quantiser.books
        probes = min(probes, len(cells))

        def code(batches):
            for batch in batches:
                if not len(batch):
                    continue
                x = unit(np.stack(batch["v"].to_numpy()))
                score = x @ cells.T
                near = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
                order = np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable")
                near = np.take_along_axis(near, order, 1).astype(np.int32)
                packed = pack_codes(encode(x, books))
                yield pd.DataFrame(
                    {
                        "h": batch["h"],
                        "q": [r.tobytes() for r in x.astype(np.float16)],
                        "code": [r.tobytes() for r in packed],
                        "cells": list(near),
                    }
                )

        return (self.vectors if vectors is None else vectors).select("h", "v").mapInPandas(code, "h bigint, q binary, code binary, cells array<int>")

    def _meet(self, queries: DataFrame, codes: DataFrame, find, schema: str, query_block: int | None = None) -> DataFrame:
        """Apply `find(query keys, queries, their cells, code keys, codes, their cells)` to each group, block by block.

        queries: `(h, q, group)`; codes: `(h, code, group)`; with `cells` and `cell` if a group is several cells. The table of
        their sizes has at most `MOST_CELLS` rows. Both sides of a hot group are cut into blocks.
        """
        dim = self.quantiser.cells.shape[1]
        sizes = codes.groupBy("group").agg(F.count("*").alias("codes"))
        asked = queries.groupBy("group").agg(F.count("*").alias("queries"))
        blocks = asked.join(sizes, "group").select(
            "group", F.ceil(F.col("queries") / (query_block or QUERY_BLOCK)).cast("int").alias("qn"), F.ceil(F.col("codes") / CODE_BLOCK).cast("int").alias("cn")
        )
        blocks = F.broadcast(blocks)

        def sides(df, own, other, payload):
            spread = df.join(blocks, "group").withColumn("own", F.pmod("h", F.col(own)).cast("int"))
            spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            qb, cb = ("own", "other") if own == "qn" else ("other", "own")
            return spread.select("group", F.col(qb).alias("qb"), F.col(cb).alias("cb"), "h", *payload)

        null = F.lit(None).cast("binary")
        several = "cells" in queries.columns  # of a group that is one cell nobody needs to know it
        ask, held = ["q", null.alias("code")], [null.alias("q"), "code"]
        if several:
            ask += ["cells", F.lit(None).cast("int").alias("cell")]
            held += [F.lit(None).cast("array<int>").alias("cells"), "cell"]
        both = sides(queries, "qn", "cn", ask).unionByName(sides(codes, "cn", "qn", held))

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            asks = pdf["q"].notna().to_numpy()
            h = pdf["h"].to_numpy()
            if asks.all() or not asks.any():
                return find(None, None, None, None, None, None)
            q = np.frombuffer(b"".join(pdf["q"][asks]), np.float16).reshape(-1, dim).astype(np.float32)
            c = np.frombuffer(b"".join(pdf["code"][~asks]), np.uint8).reshape(int((~asks).sum()), -1)
            return find(h[asks], q, pdf["cells"][asks].tolist() if several else None, h[~asks], c, pdf["cell"][~asks].to_numpy() if several else None)

        return both.groupBy("group", "qb", "cb").applyInPandas(block, schema)

    def close(self, least: float = 0.9, probes: int = 8, slack: float = 0.2) -> DataFrame:
        """`(a, a2, b, b2, cosine)`: fingerprints of different vectors whose cosine is at least `least`, as far as found.

        Each vector asks in its nearest cell and is found in its `probes` nearest ones, so that a pair
        has two chances to meet. `slack`: how far under `least` an approximate score is still reranked.
        """
        if self.quantiser is None:
            return self.members.sparkSession.createDataFrame([], "a bigint, a2 bigint, b bigint, b2 bigint, cosine double")
        books = self.quantiser.books
        index = materialise(self.coded(probes), "codes")
        queries = index.select("h", "q", F.col("cells")[0].alias("group"))
        codes = index.select("h", "code", F.explode("cells").alias("group"))

        def find(qh, q, _, ch, c, __) -> pd.DataFrame:
            left, right = [], []
            if qh is not None:
                for at, scores in scan(q, c, books):
                    row, col = np.nonzero(scores >= least - slack)
                    left.append(qh[at + col])
                    right.append(ch[row])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            keep = a != b
            a, b = a[keep], b[keep]
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

        near = materialise(self._meet(queries, codes, find, "a bigint, b bigint").distinct(), "near")
        wanted = near.select(F.col("a").alias("h")).union(near.select(F.col("b").alias("h"))).distinct()
        exact = self.vectors.join(wanted, "h", "left_semi")
        one = exact.select(F.col("h").alias("a"), F.col("h2").alias("a2"), F.col("v").alias("va"))
        two = exact.select(F.col("h").alias("b"), F.col("h2").alias("b2"), F.col("v").alias("vb"))
        close = near.join(one, "a").join(two, "b").withColumn("cosine", cosine("va", "vb")).filter(F.col("cosine") >= least)
        return close.select("a", "a2", "b", "b2", "cosine")

    def classes(self, least: float = 0.9) -> DataFrame:
        """`(k, class_id, copies, links)`: one row a key, however many copies its vector has. Keys of one vector are a class,
        named by the least of them; links are the other classes whose cosine is at least `least`."""
        close = self.close(least)
        ends = close.select(F.col("a").alias("h"), F.col("a2").alias("h2")).unionAll(close.select(F.col("b").alias("h"), F.col("b2").alias("h2")))
        links = ends.groupBy("h", "h2").agg(F.count("*").alias("links"))
        # a key with several vectors is told by one of them
        own = self.keyed.groupBy("k").agg(F.min(F.struct("h", "h2")).alias("v")).select("k", "v.h", "v.h2")
        named = own.groupBy("h", "h2").agg(F.min("k").alias("class_id"), F.count("*").alias("copies"))
        named = named.join(links, ["h", "h2"], "left").withColumn("links", F.coalesce("links", F.lit(0).cast("bigint")))
        return own.join(named, ["h", "h2"]).select("k", "class_id", "copies", "links")

    def pairs(self, least: float = 0.9, probes: int = 8, slack: float = 0.2) -> DataFrame:
        """`(k_a, k_b, cosine)`, k_a < k_b, of all keys whose cosine is at least `least`, as far as found; `classes` gives the
        same without pairs of copies."""
        close = self.close(least, probes, slack)
        # copies of one vector meet too
        copied = self.members.groupBy("h", "h2").agg(F.count("*").alias("n")).filter("n > 1")
        copies = copied.select(F.col("h").alias("a"), F.col("h2").alias("a2"), F.col("h").alias("b"), F.col("h2").alias("b2"), F.lit(1.0).alias("cosine"))
        left = self.members.select(F.col("h").alias("a"), F.col("h2").alias("a2"), F.col("k").alias("k_a"))
        right = self.members.select(F.col("h").alias("b"), F.col("h2").alias("b2"), F.col("k").alias("k_b"))
        met = close.unionByName(copies).join(left, ["a", "a2"]).join(right, ["b", "b2"])
        met = met.filter(F.col("k_a") != F.col("k_b"))
        return met.groupBy(F.least("k_a", "k_b").alias("k_a"), F.greatest("k_a", "k_b").alias("k_b")).agg(F.max("cosine").alias("cosine"))

    def nearest(self, queries: Column, k: int = 10, share: float = 0.1, least: int = 10, keep: int = 16) -> DataFrame:
        """`(k_a, k_b, rank, cosine)`: the `k` keys most similar to each key for which `queries` (over `k`) holds.

        share: of the cells in which each query is asked, `least` of them at least. keep: `keep * k` candidates by approximate score are reranked.
        Cells are searched in groups of about a block of codes, and a group keeps no more candidates for a query than
        can matter (all of them where there is one group, four times k at least where there are many), so that little
        is shuffled. Ties of the cosine are broken by key.
        """
        kinds = self.members.schema["k"].dataType.simpleString()
        if self.quantiser is None:
            return self.members.sparkSession.createDataFrame([], f"k_a {kinds}, k_b {kinds}, rank int, cosine double")
        books, cells = self.quantiser.books, len(self.quantiser.cells)
        groups = int(max(1, -(-self.rows // CODE_BLOCK)))
        most = keep * k
        local = max(4 * k, -(-2 * most // groups))
        asking = self.members.filter(queries)
        index = materialise(self.coded(1).select("h", "code", F.col("cells")[0].alias("cell")), "codes")
        chosen = self.vectors.join(asking.select("h").distinct(), "h", "left_semi")
        # a query goes once to each group, with those of its cells that are in it
        ask = self.coded(max(least, round(share * cells)), chosen).select("h", "q", "cells")
        ask = ask.withColumn("group", F.explode(F.array_distinct(F.transform("cells", lambda c: c % groups))))
        ask = ask.withColumn("cells", F.filter("cells", lambda c: c % groups == F.col("group")))
        codes = index.withColumn("group", F.col("cell") % groups)

        def find(qh, q, probed, ch, c, own) -> pd.DataFrame:
            a, b, s = [], [], []
            if qh is not None:
                asks = pd.DataFrame({"n": np.repeat(np.arange(len(qh)), list(map(len, probed))), "cell": np.concatenate(probed)})
                asks = {cell: rows.to_numpy() for cell, rows in asks.groupby("cell")["n"]}
                for cell in np.unique(own):
                    who, here = asks.get(cell), np.flatnonzero(own == cell)
                    if who is None:
                        continue
                    n = min(local, len(here))
                    for at, scores in scan(q[who], c[here], books):
                        best = np.argpartition(-scores, n - 1, axis=0)[:n]
                        a.append(np.repeat(who[at : at + scores.shape[1]], n))
                        b.append(here[best.T.ravel()])
                        s.append(np.take_along_axis(scores, best, 0).T.ravel())
            if not a:
                return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "s": np.zeros(0, np.float32)})
            a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
            order = np.lexsort((ch[b], -s, a))  # of each query the best of all its cells here
            a, b, s = a[order], b[order], s[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            kept = place < local
            return pd.DataFrame({"a": qh[a[kept]], "b": ch[b[kept]], "s": s[kept]})

        found = self._meet(ask, codes, find, "a bigint, b bigint, s float", NEAREST_BLOCK)
        by_score = Window.partitionBy("a").orderBy(F.desc("s"), "b")
        few = found.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= most).select("a", "b")
        one = self.vectors.select(F.col("h").alias("a"), F.col("h2").alias("a2"), F.col("v").alias("va"))
        two = self.vectors.select(F.col("h").alias("b"), F.col("h2").alias("b2"), F.col("v").alias("vb"))
        scored = few.join(one, "a").join(two, "b").withColumn("cosine", cosine("va", "vb"))
        left = asking.select(F.col("h").alias("a"), F.col("h2").alias("a2"), F.col("k").alias("k_a"))
        right = self.members.select(F.col("h").alias("b"), F.col("h2").alias("b2"), F.col("k").alias("k_b"))
        # of a vector with many copies no more than k can be wanted, and one more that is the key itself
        by_key = Window.partitionBy("b", "b2").orderBy("k_b")
        right = right.withColumn("n", F.row_number().over(by_key)).filter(F.col("n") <= k + 1).drop("n")
        met = scored.join(left, ["a", "a2"]).join(right, ["b", "b2"]).filter(F.col("k_a") != F.col("k_b"))
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("k_a").orderBy(F.desc("cosine"), "k_b")))
        return ranked.filter(F.col("rank") <= k).select("k_a", "k_b", "rank", "cosine")


def similar_pairs(df: DataFrame, least: float = 0.9, key: str = "id", vector: str = "embedding", dim: int = 64) -> DataFrame:
    """`(key_a, key_b)`, key_a < key_b, with a cosine of at least `least`."""
    found = SimilarityIndex(df, key, vector, dim).pairs(least)
    return found.select(F.col("k_a").alias(f"{key}_a"), F.col("k_b").alias(f"{key}_b"))
