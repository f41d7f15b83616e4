"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors are centred, rotated so that signs lose little (iterative quantisation), and coded by their signs. A
code is cut into substrings, and each block of the index has one table per substring. Two codes within Hamming
distance r agree in some substring up to r // m of its bits, so probing every table with all values that near
finds every code within r. What is found is ranked by the distance of the vectors themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refledger.sources.workspace import cut

_WIDTH = 16
_COUNT = np.array([bin(v).count("1") for v in range(1 << _WIDTH)], dtype=np.uint8)


@dataclass(frozen=True)
class Model:
    """Mean, projection to `bits` signs, and the radius that the sample's neighbours asked for."""

    mean: np.ndarray
    projection: np.ndarray
    radius: int

    @property
    def dimension(self) -> int:
        return len(self.mean)

    @property
    def bits(self) -> int:
        return self.projection.shape[1]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        signs = (vectors - self.mean) @ self.projection > 0
        wide = np.zeros((len(signs), -(-self.bits // _WIDTH) * _WIDTH), dtype=bool)
        wide[:, : self.bits] = signs
        return (wide.reshape(len(signs), -1, _WIDTH) << np.arange(_WIDTH)).sum(axis=2).astype(np.uint16)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return _COUNT[codes ^ code].sum(axis=1, dtype=np.int64)


def _rotation(projected: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """The rotation under which signs lie nearest to the values, by alternating between both."""
    n = projected.shape[1]
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0]
    for _ in range(rounds):
        signs = np.where(projected @ turn > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(projected.T @ signs)
        turn = u @ v
    return turn


def learn(sample: np.ndarray, *, bits: int = 64, recall: float = 0.99, neighbours: int = 10, probes: int = 256, rounds: int = 30) -> Model:
    """A model of sampled vectors. The radius reaches `recall` of the probes' neighbours within the sample.

    In the whole table neighbours are nearer than in a sample of it, so the radius errs on the wide side.
    """
    mean = sample.mean(axis=0)
    centred = sample - mean
    axes = np.linalg.svd(centred.T @ centred)[0][:, :bits]
    projection = axes @ _rotation(centred @ axes, rounds, 0)
    model = Model(mean, projection, 0)
    codes = model.codes(sample)
    far = []
    for i in range(0, len(sample), max(1, len(sample) // probes)):
        distance = np.square(sample - sample[i]).sum(axis=1)
        distance[i] = np.inf
        near = np.argsort(distance, kind="stable")[: min(neighbours, len(sample) - 1)]
        far += hamming(codes[near], codes[i]).tolist()
    radius = int(np.quantile(far, recall, method="higher")) if far else bits
    return Model(mean, projection, radius)


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit(vectors: DataFrame, key: str, vector: str, *, sample_rows: int = 8192, **options) -> Model | None:
    """Learns from about `sample_rows` usable vectors, chosen by a hash of their key; never more than twice as many.

    The most frequent dimension is the model's; None without a usable vector.
    """
    sizes = vectors.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return None
    d, n = sizes[0]
    share = min(1.0, sample_rows / n)
    own = vectors.where(F.col(key).isNotNull() & (F.size(vector) == d) & (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share * (1 << 30)))
    rows = own.select(key, F.col(vector).cast("array<double>").alias("v")).limit(2 * sample_rows).collect()
    if not rows:
        return None
    return learn(np.array([r["v"] for r in sorted(rows, key=lambda r: (r[0], r["v"]))]), **options)


class Tables:
    """One table per substring over a block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.sorted = [c[o] for c, o in zip(codes.T, self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all codes within the radius."""
        m = self.codes.shape[1]
        each = radius // m
        if each >= _WIDTH:
            found = np.arange(len(self.codes))
        else:
            marks = np.zeros(len(self.codes), dtype=bool)
            for order, values, own in zip(self.order, self.sorted, code):
                marks[self._probe(order, values, int(own), each)] = True
            found = np.flatnonzero(marks)
        return found[hamming(self.codes[found], code) <= radius]

    @staticmethod
    def _probe(order: np.ndarray, values: np.ndarray, own: int, each: int) -> np.ndarray:
        masks = _masks(each)
        if len(masks) > len(values):
            # More values to ask for than are in the table: ask the table's own values instead.
            return order[_COUNT[values ^ np.uint16(own)] <= each]
        asked = masks ^ np.uint16(own)
        lo, hi = np.searchsorted(values, asked, "left"), np.searchsorted(values, asked, "right")
        hit = np.flatnonzero(hi > lo)
        return np.concatenate([order[lo[i] : hi[i]] for i in hit]) if len(hit) else np.empty(0, dtype=np.int64)


_MASKS: dict[int, np.ndarray] = {}


def _masks(each: int) -> np.ndarray:
    if each not in _MASKS:
        made = [sum(1 << b for b in bits) for r in range(each + 1) for bits in combinations(range(_WIDTH), r)]
        _MASKS[each] = np.array(made, dtype=np.uint16)
    return _MASKS[each]


def _search_block(model: Model, k: int, extra: int):
    columns = ["query_id", "vec_id", "score"]

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ids = rows["id"].to_numpy()
        vectors = np.stack(rows["v"].to_numpy()).astype(np.float64)
        tables = Tables(model.codes(vectors))
        asked = np.stack(queries["v"].to_numpy()).astype(np.float64)
        out = []
        for q, vector, code in zip(queries["id"].to_numpy(), asked, model.codes(asked)):
            found = tables.within(code, model.radius + extra)
            found = found[ids[found] != q]
            score = np.sqrt(np.square(vectors[found] - vector).sum(axis=1))
            if len(found) > k:
                # Ties with the k-th stay in until ids decide.
                some = score <= np.partition(score, k - 1)[k - 1]
                found, score = found[some], score[some]
            best = np.lexsort((ids[found], score))[:k]
            out += [(q, ids[found[i]], score[i]) for i in best]
        return pd.DataFrame(out, columns=columns).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def search(
    vectors: DataFrame,
    queries: DataFrame,
    model: Model | None,
    key: str = "vec_id",
    vector: str = "embedding",
    *,
    k: int = 10,
    index_rows: int = 16_384,
    query_rows: int = 4_096,
    least_blocks: int = 24,
    step: int = 8,
) -> DataFrame:
    """The k nearest vectors of each query: `query_id`, `rank`, `vec_id`, `score`, by distance and then by id.

    Rows of a query's own id are no candidates for it. Vectors that are null, zero, of another dimension than
    the model's, or hold null or non-finite components take no part, nor do rows without an id; equal
    vectors and repeated rows are candidates each. Query rows that share an id are one query, with the smallest
    of their vectors. Empty tables give no rows.

    The query set meets all rows block by block: a task holds one block of either. A query that finds fewer than k
    neighbours within the radius is asked again with a wider one, at last with one that takes in every code.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if model is None:
        return empty

    def valid(rows: DataFrame) -> DataFrame:
        named = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
        return named.where(F.col("id").isNotNull() & usable(F.col("v")) & (F.size("v") == model.dimension))

    index = cut(valid(vectors), "ann-index")
    asked = cut(valid(queries).groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
    n = index.count()
    parts = max(least_blocks, -(-n // index_rows))
    spread = lambda of, by: F.pmod(F.xxhash64(F.lit("block"), of), F.lit(by)).cast("int")
    rows = index.select("id", "v", spread(F.col("id"), parts).alias("ib"))
    done, extra = None, 0
    while True:
        groups = max(1, -(-asked.count() // query_rows))
        many = lambda by: F.explode(F.sequence(F.lit(0), F.lit(by - 1)))
        left = asked.select("id", "v", spread(F.col("id"), groups).alias("qb")).withColumn("ib", many(parts))
        right = rows.withColumn("qb", many(groups))
        near = left.groupBy("ib", "qb").cogroup(right.groupBy("ib", "qb")).applyInPandas(
            _search_block(model, k, extra), "query_id long, vec_id long, score double"
        )
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        near = cut(near.withColumn("rank", rank).where(F.col("rank") <= k), "ann-found")
        enough = near.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
        short = cut(asked.join(enough, "id", "left_anti"), "ann-queries")
        last = model.radius + extra >= model.bits or short.isEmpty()
        kept = near if last else near.join(enough.select(F.col("id").alias("query_id")), "query_id", "left_semi")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done.select("query_id", "rank", "vec_id", "score")
        asked, extra, step = short, extra + step, 2 * step
