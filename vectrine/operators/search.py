"""Exact search: nearest neighbours, ranges, batches, streams of results.

Results are ordered by ``(distance, id)``. Distances are ranked after rounding
to ``RANK`` places, so that the order doesn't hang on the last bit of a sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions.metrics import distance, score

RANK = 9
#: Queries and bytes of queries that may be sent to every executor, and most results of a search.
MOST_QUERIES, MOST_K, MOST_RESULTS = 10_000, 10_000, 50_000


def _vector(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def _check_k(k: int, most: int = MOST_K) -> None:
    if not isinstance(k, int) or isinstance(k, bool) or not 1 <= k <= most:
        raise ValueError(f"k must be a whole number from 1 to {most}, not {k!r}")


def check_query(query: list[float], dimension: int | None = None) -> list[float]:
    """The query as floats; an error if it is empty, not finite or of another dimension."""
    values = [float(x) for x in query]
    if not values or not all(np.isfinite(values)):
        raise ValueError("a query vector has finite elements, at least one")
    if dimension is not None and len(values) != dimension:
        raise ValueError(f"the query has {len(values)} elements, the collection {dimension}")
    return values


def order(d: str = "distance", key: str = "id") -> list[Column]:
    """Order of results."""
    return [F.round(F.col(d), RANK), F.col(key)]


def with_distance(df: DataFrame, query: list[float] | Column, name: str = "cosine", vector: str = "vector") -> DataFrame:
    """Adds ``distance`` and ``score``; rows whose vector has another length are left out."""
    q = query if isinstance(query, Column) else _vector(check_query(query))
    dim = None if isinstance(query, Column) else len(query)
    d = distance(F.col(vector), q, name)
    return df.withColumn("distance", d).where(F.col("distance").isNotNull()).withColumn("score", score(F.col("distance"), name, dim))


def knn(df: DataFrame, query: list[float], k: int = 10, name: str = "cosine", where: Column | None = None, key: str = "id", vector: str = "vector", include: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` nearest rows: a filter, a projection and a distributed top-k.

    ``include`` names further columns of the result; the scan reads no others.
    """
    _check_k(k)
    rows = df.where(where) if where is not None else df
    found = with_distance(rows.withColumnRenamed(key, "id"), query, name, vector)
    return found.select("id", "distance", "score", *include).orderBy(*order()).limit(k)


def search_range(df: DataFrame, query: list[float], most: float, name: str = "cosine", limit: int | None = None, where: Column | None = None, key: str = "id", vector: str = "vector", include: tuple[str, ...] = ()) -> DataFrame:
    """All rows at a distance of ``most`` or less, the nearest first; ``limit`` keeps the first of them."""
    if most != most:
        raise ValueError("the distance is no number")
    rows = df.where(where) if where is not None else df
    found = with_distance(rows.withColumnRenamed(key, "id"), query, name, vector).where(F.round("distance", RANK) <= most).select("id", "distance", "score", *include)
    if limit is None:
        return found.orderBy(*order())
    _check_k(limit, MOST_RESULTS)
    return found.orderBy(*order()).limit(limit)


def search_in(df: DataFrame, candidates: DataFrame, query: list[float], k: int, name: str = "cosine", key: str = "id", vector: str = "vector") -> DataFrame:
    """The nearest of given candidates (a column ``id``)."""
    return knn(df.join(candidates.select(F.col("id").alias(key)), key, "left_semi"), query, k, name, key=key, vector=vector)


def numbered(found: DataFrame) -> DataFrame:
    """Adds ``place``, from 1, to a bounded result."""
    return found.withColumn("place", F.row_number().over(Window.orderBy(*order())))


def search_stream(df: DataFrame, query: list[float], name: str = "cosine", batch: int = 10, most: int = MOST_RESULTS, **options) -> DataFrame:
    """Results in batches: the first ``most`` of them with ``batch_no`` from 0."""
    _check_k(batch, MOST_RESULTS)
    _check_k(most, MOST_RESULTS)
    found = search_range(df, query, float("inf"), name, limit=most, **options)
    return numbered(found).withColumn("batch_no", F.floor((F.col("place") - 1) / batch).cast("int"))


def stream_batches(found: DataFrame) -> Iterator[list]:
    """Pulls the batches of :func:`search_stream` one after the other."""
    batch, number = [], None
    for row in found.orderBy("place").toLocalIterator():
        if batch and row.batch_no != number:
            yield batch
            batch = []
        batch.append(row)
        number = row.batch_no
    if batch:
        yield batch


def progressive(df: DataFrame, query: list[float], name: str = "cosine", batch: int = 10, most: int = 50, stages: tuple[int, ...] = (100, 1000, 10_000), key: str = "id", vector: str = "vector") -> DataFrame:
    """``(stage, id, distance, score)``: first results from growing prefixes of the collection in the order of ids.

    A stage looks at the ``min(2 * batch, what is left)`` best rows of its
    prefix, marks those not seen before as seen and gives the first ``batch`` of
    them; the rest of them is never given. The last stage is the whole
    collection. The prefixes are found by one distributed top-k on the key.
    """
    source = with_distance(df.withColumnRenamed(key, "id"), query, name, vector).select("id", "distance", "score")
    n = source.count()
    seen: list = []
    given, out = 0, None
    for stage, size in enumerate([*[s for s in stages if s < n], n]):
        if given >= most or not n:
            break
        prefix = source if size == n else source.orderBy("id").limit(size)
        look = min(2 * batch, most - given)
        best = prefix.orderBy(*order()).limit(look).collect()  # at most 2 * batch rows
        new = [r for r in best if r.id not in seen]
        seen += [r.id for r in new]
        rows = [(stage, *r) for r in new[:batch]]
        given += len(rows)
        out = (out or []) + rows
    return df.sparkSession.createDataFrame(out or [], f"stage int, id {dict(source.dtypes)['id']}, distance double, score double")


# many queries

#: Elements of a block of distances that a task holds at once.
CELLS = 4_000_000


def _sums(q: np.ndarray, x: np.ndarray, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the elements of ``f`` for each pair, one element after the other."""
    out = np.zeros((len(q), len(x)))
    for i in range(q.shape[1]):
        out += f(q[:, i, None], x[None, :, i])
    return out


def _euclidean(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    square = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :]
    scale = square * 1e-6
    square -= 2 * (q @ x.T)
    i, j = np.nonzero(~(square > scale))  # near ones and not finite ones: the difference itself
    square[i, j] = ((q[i] - x[j]) ** 2).sum(1)
    return np.sqrt(square)


def _cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    n = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
    return np.where(n == 0, 1.0, 1 - (q @ x.T) / np.where(n == 0, 1.0, n))


def _hamming(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b = (q > 0).astype(float), (x > 0).astype(float)
    return a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * (a @ b.T)


def _jaccard(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b = (q > 0).astype(float), (x > 0).astype(float)
    both = a @ b.T
    some = a.sum(1)[:, None] + b.sum(1)[None, :] - both
    return np.where(some == 0, 0.0, 1 - both / np.where(some == 0, 1.0, some))


def _weighted_jaccard(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    high = _sums(q, x, np.maximum)
    return np.where(high == 0, 0.0, 1 - _sums(q, x, np.minimum) / np.where(high == 0, 1.0, high))


#: Metrics of which all distances of a block are computed together; the others go pair by pair.
_KERNELS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "cosine": _cosine, "euclidean": _euclidean, "dot": lambda q, x: -(q @ x.T), "manhattan": lambda q, x: _sums(q, x, lambda a, b: np.abs(a - b)), "hamming": _hamming, "jaccard": _jaccard,
    "weighted_jaccard": _weighted_jaccard, "hamming_exact_frac": lambda q, x: _sums(q, x, np.not_equal) / max(q.shape[1], 1),
}


def _kernel(name: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):  # of elements that are not finite comes a distance that is no number
        return _KERNELS[name](q, x)


def _blocks(queries: DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """The different queries (qid, qvec), a block of ``most`` or fewer at a time."""
    asked = queries.select("qid", "qvec").where(F.col("qvec").isNotNull() & F.forall("qvec", lambda e: e.isNotNull()))
    some = asked.limit(most + 1).toPandas()
    if len(some) <= most:
        same = [(n, tuple(v)) for n, v in zip(some["qid"], some["qvec"])]
        yield some[~pd.Series(same, index=some.index, dtype=object).duplicated()]
        return
    asked = asked.distinct()
    count = -(-2 * asked.count() // most)
    for b in range(count):
        part = asked.where(F.pmod(F.xxhash64("qid", "qvec"), F.lit(count)) == b).toPandas()
        for a in range(0, len(part), most):
            yield part.iloc[a : a + most]


def collect_queries(queries: DataFrame, most: int = MOST_QUERIES) -> pd.DataFrame | None:
    """The queries, or None if there are more than ``most``."""
    some = queries.select("qid", "qvec").limit(most + 1).toPandas()
    return None if len(some) > most else some


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    return np.array(vectors.to_list(), np.float64).reshape(len(vectors), width)


def _by_width(some: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Matrix and names of the queries of each length."""
    size = some["qvec"].map(len).to_numpy()
    return {int(w): (_matrix(some["qvec"][size == w], int(w)), some["qid"][size == w].to_numpy()) for w in np.unique(size)}


def _pieces(b: pd.DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(queries, their names, rows, their ids)`` of equal length, as many rows as a block of distances may have."""
    size = b["vector"].map(len).to_numpy()
    for w, (q, names) in asked.items():
        rows = b[size == w]
        step = max(1, CELLS // len(q))
        for a in range(0, len(rows), step):
            some = rows.iloc[a : a + step]
            yield q, names, _matrix(some["vector"], w), some["id"].to_numpy()


def _whole(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, vector)`` of rows with a vector that has no null in it."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda e: e.isNotNull()))


def batch_search(df: DataFrame, queries: DataFrame, k: int, name: str = "cosine", key: str = "id", vector: str = "vector", exclude_self: bool = False, most: int = MOST_QUERIES) -> DataFrame:
    """``(qid, id, distance, score, place)``: the ``k`` nearest rows of each query (qid, qvec).

    Queries go to all executors in blocks of at most ``most``. A task computes
    the distances of a block and its rows together and keeps its own ``k`` best
    of each query, so the shuffle holds ``k`` rows for each query and task. A
    repeated query counts once; of null vectors, and against rows of another
    length, there is nothing. Registered metrics go pair by pair.
    """
    _check_k(k)
    best = Window.partitionBy("qid").orderBy(*order())
    if name not in _KERNELS:
        pairs = all_distances(df.select(F.col(key).alias("id"), F.col(vector).alias("vector")), queries, name, most)
        pairs = pairs.where(F.col("qid") != F.col("id")) if exclude_self else pairs
        return pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    rows, spark = _whole(df, key, vector), df.sparkSession
    kinds = dict(queries.dtypes)["qid"], dict(rows.dtypes)["id"]
    found = None
    for some in _blocks(queries, most):
        shared = spark.sparkContext.broadcast(_by_width(some))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held: dict[int, pd.DataFrame] = {}
            asked = shared.value
            for b in batches:
                for q, names, x, ids in _pieces(b, asked) if len(b) else ():
                    d = _kernel(name, q, x)
                    rank = np.round(d, RANK)
                    keep = min(k + exclude_self, d.shape[1])
                    cut = np.partition(rank, keep - 1, axis=1)[:, keep - 1, None]
                    i, j = np.nonzero(rank <= cut)
                    new = pd.DataFrame({"i": i, "id": ids[j], "distance": d[i, j], "r": rank[i, j]})
                    w = q.shape[1]
                    new = pd.concat([held[w], new]) if w in held else new
                    if exclude_self:
                        new = new[new["id"].to_numpy() != names[new["i"].to_numpy()]]
                    held[w] = new.sort_values(["i", "r", "id"]).groupby("i").head(k)
            for w, best_ in held.items():
                yield pd.DataFrame({"qid": asked[w][1][best_["i"].to_numpy()], "id": best_["id"], "distance": best_["distance"], "width": w})

        one = rows.mapInPandas(run, f"qid {kinds[0]}, id {kinds[1]}, distance double, width int")
        found = one if found is None else found.unionByName(one)
    found = found.withColumn("distance", F.coalesce("distance", F.lit(float("nan"))))  # pandas has null for it
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return top.select("qid", "id", "distance", _score(name).alias("score"), "place")


def _score(name: str) -> Column:
    """Score of the columns ``distance`` and ``width``."""
    return 1 - F.col("distance") / F.nullif(F.col("width"), F.lit(0)) if name == "hamming" else score(F.col("distance"), name)


def all_distances(rows: DataFrame, queries: DataFrame, name: str = "cosine", most: int = MOST_QUERIES) -> DataFrame:
    """``(qid, id, distance, score)`` of a stated set of queries against all rows (id, vector), in blocks of at most ``most`` queries."""
    if name not in _KERNELS:
        asked = queries.select("qid", "qvec").distinct()
        blocks = max(1, -(-2 * asked.count() // most))
        found = None
        for b in range(blocks):
            block = F.broadcast(asked.where(F.pmod(F.xxhash64("qid", "qvec"), F.lit(blocks)) == b))
            met = rows.join(block).withColumn("distance", distance(F.col("vector"), F.col("qvec"), name)).where(F.col("distance").isNotNull()).withColumn("width", F.size("qvec"))
            found = met if found is None else found.unionByName(met)
        return found.select("qid", "id", "distance", _score(name).alias("score"))
    whole, spark = _whole(rows, "id", "vector"), rows.sparkSession
    kinds = dict(queries.dtypes)["qid"], dict(whole.dtypes)["id"]
    found = None
    for some in _blocks(queries, most):
        shared = spark.sparkContext.broadcast(_by_width(some))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                for q, names, x, ids in _pieces(b, shared.value) if len(b) else ():
                    d = _kernel(name, q, x)
                    yield pd.DataFrame({"qid": np.repeat(names, len(ids)), "id": np.tile(ids, len(names)), "distance": d.ravel(), "width": q.shape[1]})

        one = whole.mapInPandas(run, f"qid {kinds[0]}, id {kinds[1]}, distance double, width int")
        found = one if found is None else found.unionByName(one)
    found = found.withColumn("distance", F.coalesce("distance", F.lit(float("nan"))))
    return found.select("qid", "id", "distance", _score(name).alias("score"))


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """``(qid, recall)``: share of the exact ``k`` nearest that a search found."""
    hit = exact.select("qid", "id").join(found.select("qid", "id").distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hit.groupBy("qid").agg((F.count("hit") / k).alias("recall"))


def with_timeout(df: DataFrame, seconds: float) -> list:
    """Collects a bounded result, or cancels its jobs after ``seconds`` with a TimeoutError."""
    import threading
    import uuid

    sc, group, late = df.sparkSession.sparkContext, f"search-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "search", interruptOnCancel=True)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the search took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)

