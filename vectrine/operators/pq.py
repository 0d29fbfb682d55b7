"""Product quantization: codebooks per subspace, codes, and asymmetric distances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that codebooks are trained on at most, rounds, and relative improvement that ends the training.
TRAINING_ROWS, ROUNDS, ENOUGH = 65_536, 50, 1e-6


@dataclass
class Codebook:
    """Centroids ``(subspaces, centroids, width)`` and the mean squared distance of the training rows."""

    centroids: np.ndarray
    distortion: float

    @property
    def dimension(self) -> int:
        return self.centroids.shape[0] * self.centroids.shape[2]


def check_shape(dimension: int, subspaces: int) -> int:
    """Width of a subspace; an error unless all subspaces are equally wide."""
    if subspaces < 1 or dimension % subspaces:
        raise ValueError(f"{dimension} dimensions can't be divided into {subspaces} equal subspaces")
    return dimension // subspaces


def _k_means(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, float]:
    rng = np.random.default_rng(seed)
    first = [int(rng.integers(len(x)))]
    near = ((x - x[first[0]]) ** 2).sum(1)
    while len(first) < k:
        total = near.sum()
        pick = int(rng.integers(len(x))) if total <= 0 else int(np.searchsorted(np.cumsum(near), rng.random() * total).clip(0, len(x) - 1))
        first.append(pick)
        near = np.minimum(near, ((x - x[pick]) ** 2).sum(1))
    c, last = x[first].copy(), np.inf
    for _ in range(ROUNDS):
        d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T
        own = d.argmin(1)
        now = float(np.maximum(d[np.arange(len(x)), own], 0).mean())
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)  # an empty one stays where it was
        if last - now <= ENOUGH * max(last if np.isfinite(last) else now, 1e-300) and np.isfinite(last):
            break
        last = now
    d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T
    return c, float(np.maximum(d.min(1), 0).mean())


def train(df: DataFrame, subspaces: int = 8, centroids: int = 256, vector: str = "vector", key: str = "id", seed: int = 42, most: int = TRAINING_ROWS) -> Codebook:
    """Codebook of at most ``most`` rows, chosen by a hash of the key; each subspace is a task of its own.

    Fewer rows than centroids are an error. A group holds one subspace of the
    bounded sample.
    """
    rows = df.where(F.col(vector).isNotNull())
    n, width = rows.count(), rows.select(F.max(F.size(vector))).first()[0]
    if n < centroids:
        raise ValueError(f"{n} rows are too few for {centroids} centroids")
    part = check_shape(width, subspaces)
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(1_000_000 * most / n))
    cut = rows.select(F.col(key).alias("k"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(subspaces - 1)), lambda m: F.struct(m.alias("m"), F.slice(vector, m * part + 1, F.lit(part)).alias("x")))).alias("s"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group.sort_values("k")["x"].to_list()).astype(np.float64)
        m = int(group["m"].iloc[0])
        c, loss = _k_means(x, centroids, seed + m)
        return pd.DataFrame({"m": [m], "c": [c.tobytes()], "loss": [loss]})

    made = cut.select("k", "s.m", "s.x").groupBy("m").applyInPandas(run, "m int, c binary, loss double").orderBy("m").collect()
    return Codebook(np.stack([np.frombuffer(r.c).reshape(centroids, part) for r in made]), sum(r.loss for r in made))


def encode(df: DataFrame, book: Codebook, vector: str = "vector", key: str = "id") -> DataFrame:
    """``(key, codes)``: the nearest centroid of each subspace, the first among equals."""
    shared = df.sparkSession.sparkContext.broadcast(book.centroids)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_list()).astype(np.float64).reshape(len(b), c.shape[0], c.shape[2])
                codes = np.stack([((c[m] ** 2).sum(1)[None] - 2 * x[:, m] @ c[m].T).argmin(1) for m in range(c.shape[0])], 1).astype(np.int32)
                yield pd.DataFrame({"k": b["k"], "codes": list(codes)})

    made = df.where(F.size(vector) == book.dimension).select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(run, f"k {kind}, codes array<int>")
    return made.select(F.col("k").alias(key), "codes")


def decode(codes: DataFrame, book: Codebook, key: str = "id") -> DataFrame:
    """``(key, vector)`` of the centroids that the codes name."""
    shared = codes.sparkSession.sparkContext.broadcast(book.centroids)
    kind = dict(codes.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for b in batches:
            if len(b):
                x = np.stack(b["codes"].to_list())
                out = np.concatenate([c[m][x[:, m]] for m in range(c.shape[0])], 1).astype(np.float32)
                yield pd.DataFrame({"k": b["k"], "vector": list(out)})

    return codes.select(F.col(key).alias("k"), "codes").mapInPandas(run, f"k {kind}, vector array<float>").withColumnRenamed("k", key)


def asymmetric(codes: DataFrame, book: Codebook, query: list[float], metric: str = "euclidean", key: str = "id") -> DataFrame:
    """``(key, distance)`` of a query to coded vectors: sums of a table looked up by code.

    'euclidean' is the root of the summed squares, 'cosine' the sum of the
    subspaces' cosine distances, 1 where a part is zero.
    """
    q = np.asarray(query, np.float64).reshape(book.centroids.shape[0], -1)
    if metric == "euclidean":
        table = ((book.centroids - q[:, None]) ** 2).sum(2)
    elif metric == "cosine":
        scale = np.sqrt((book.centroids**2).sum(2)) * np.sqrt((q**2).sum(1))[:, None]
        table = np.where(scale == 0, 1.0, 1 - np.einsum("mkd,md->mk", book.centroids, q) / np.where(scale == 0, 1, scale))
    else:
        raise ValueError(f"no asymmetric distance for {metric!r}")
    parts = [F.element_at(F.array(*[F.lit(float(x)) for x in row]), F.element_at("codes", m + 1) + 1) for m, row in enumerate(table)]
    total = sum(parts[1:], parts[0])
    return codes.select(key, (F.sqrt(total) if metric == "euclidean" else total).alias("distance"))


def statistics(dimension: int, subspaces: int = 8, centroids: int = 256) -> dict[str, float]:
    """Bits of a code, bytes of a codebook, and the ratio that codes alone reach."""
    bits = int(np.ceil(np.log2(centroids)))
    return {"bits": subspaces * bits, "codebook_bytes": centroids * dimension * 4, "ratio": dimension * 32 / (subspaces * bits)}
