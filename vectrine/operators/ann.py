"""Approximate index: sharded navigable small-world graphs, kept as a table of nodes.

Rows are spread over shards of bounded size by a hash of their id; each shard's
graph is built and searched on its own, and the shards' results are merged. A
search therefore differs from that of one large graph; what is promised is its
recall. A delete rebuilds the shards that hold the ids, a new metric all of
them, and a search without a matching index is exact.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrine.functions.metrics import score
from vectrine.operators.search import RANK, batch_search
from vectrine.session import drop, materialize

VERSION = "1.0.0"
METRICS = ("cosine", "euclidean", "manhattan", "dot")
SHARD = "shard int, nodes bigint, top int, links bigint, graph string, vectors binary"


@dataclass(frozen=True)
class Parameters:
    """Links of a node (twice as many at level 0), breadth of build, chance of a further level, seed and rows of a shard."""

    metric: str = "cosine"
    m: int = 16
    breadth: int = 100
    chance: float = 0.5
    top: int = 5
    seed: int = 42
    shard_rows: int = 2_000


def _far(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "euclidean":
        return np.sqrt(((x - q) ** 2).sum(-1))
    if metric == "manhattan":
        return np.abs(x - q).sum(-1)
    return -(x @ q) if metric == "dot" else 1 - x @ q


class Graph:
    """Graph over one shard. Vectors are scaled to length 1 for cosine; a zero vector stays zero, at distance 1."""

    def __init__(self, ids: list, x: np.ndarray, p: Parameters):
        self.ids, self.p, self.x = ids, p, self.prepared(x, p.metric)
        rng = np.random.default_rng(p.seed)
        self.level = np.minimum(rng.geometric(1 - p.chance, len(x)) - 1, p.top)
        self.links: list[list[list[int]]] = [[[] for _ in range(n + 1)] for n in self.level]
        self.entry = -1
        for i in range(len(x)):
            self._insert(i)

    @staticmethod
    def prepared(x: np.ndarray, metric: str) -> np.ndarray:
        if metric != "cosine":
            return x
        n = np.sqrt((x * x).sum(-1, keepdims=True))
        return x / np.where(n == 0, 1, n)

    def _walk(self, q: np.ndarray, start: int, breadth: int, level: int) -> list[tuple[float, int]]:
        """The ``breadth`` nearest nodes met by best-first search, the nearest first."""
        d = float(_far(self.p.metric, q, self.x[start]))
        seen, todo, best = {start}, [(d, start)], [(-d, start)]
        while todo:
            d, i = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= breadth:
                break
            new = [j for j in self.links[i][level] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for dj, j in zip(_far(self.p.metric, q, self.x[new]).tolist(), new):
                if len(best) < breadth or dj < -best[0][0]:
                    heapq.heappush(todo, (dj, j))
                    heapq.heappush(best, (-dj, j))
                    if len(best) > breadth:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def _insert(self, i: int) -> None:
        if self.entry < 0:
            self.entry = i
            return
        at, q = self.entry, self.x[i]
        for level in range(int(self.level[self.entry]), int(self.level[i]), -1):
            at = self._walk(q, at, 1, level)[0][1]
        for level in range(min(int(self.level[i]), int(self.level[self.entry])), -1, -1):
            found = self._walk(q, at, self.p.breadth, level)
            at, most = found[0][1], self.p.m * (2 if level == 0 else 1)
            self.links[i][level] = [j for _, j in found[: self.p.m]]
            for j in self.links[i][level]:
                theirs = self.links[j][level]
                theirs.append(i)
                if len(theirs) > most:
                    d = _far(self.p.metric, self.x[j], self.x[theirs])
                    self.links[j][level] = [theirs[k] for k in np.argsort(d, kind="stable")[:most]]
        if self.level[i] > self.level[self.entry]:
            self.entry = i

    def dump(self) -> tuple[str, bytes]:
        """Nodes and links as JSON, vectors as bytes."""
        return json.dumps({"ids": self.ids, "links": self.links, "level": self.level.tolist(), "entry": self.entry, "p": asdict(self.p), "shape": list(self.x.shape)}), self.x.tobytes()

    @classmethod
    def restore(cls, graph: str, vectors: bytes) -> Graph:
        g, about = cls.__new__(cls), json.loads(graph)
        g.ids, g.links, g.entry, g.p = about["ids"], about["links"], about["entry"], Parameters(**about["p"])
        g.level, g.x = np.array(about["level"]), np.frombuffer(vectors).reshape(about["shape"])
        return g

    def search(self, q: np.ndarray, k: int, breadth: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        q, at = self.prepared(q, self.p.metric), self.entry
        for level in range(int(self.level[self.entry]), 0, -1):
            at = self._walk(q, at, 1, level)[0][1]
        return self._walk(q, at, max(breadth, k), 0)[:k]


def build(df: DataFrame, p: Parameters = Parameters(), key: str = "id", vector: str = "vector") -> DataFrame:
    """``(shard, nodes, top, links, graph, vectors)``: one row for each shard. Rows without a vector are left out.

    The number of shards follows the number of rows, so no task holds more than about ``shard_rows``.
    """
    if p.metric not in METRICS:
        raise ValueError(f"no graph for the metric {p.metric!r}")
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    shards = max(1, -(-rows.count() // p.shard_rows))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        return _shard(Graph(group["id"].to_list(), np.stack(group["v"].to_list()).astype(np.float64), p), int(group["shard"].iloc[0]))

    placed = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return placed.groupBy("shard").applyInPandas(run, SHARD)


def _shard(g: Graph, shard: int) -> pd.DataFrame:
    links = sum(len(n) for node in g.links for n in node)
    graph, vectors = g.dump()
    return pd.DataFrame({"shard": [shard], "nodes": [len(g.ids)], "top": [int(g.level.max()) if len(g.ids) else 0], "links": [links], "graph": [graph], "vectors": [vectors]})


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without the ``ids`` (a column ``id``): only shards that hold one of them are built anew, from their own vectors."""
    shards = index.count()
    gone = ids.where(F.col("id").isNotNull()).select("id").distinct().withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    hit = index.join(gone.select("shard").distinct(), "shard", "left_semi")

    def run(parts: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        out = []
        for shard, graph, vectors in zip(parts["shard"], parts["graph"], parts["vectors"]):
            g, lost = Graph.restore(graph, bytes(vectors)), set(names["id"].tolist())
            keep = [i for i, name in enumerate(g.ids) if name not in lost]
            out.append(_shard(g if len(keep) == len(g.ids) else Graph([g.ids[i] for i in keep], g.x[keep], g.p), int(shard)))
        return pd.concat(out) if out else pd.DataFrame(columns=parts.columns)

    again = hit.groupBy("shard").cogroup(gone.groupBy("shard")).applyInPandas(run, SHARD)
    return index.join(gone.select("shard").distinct(), "shard", "left_anti").select(*[c.split()[0] for c in SHARD.split(", ")]).unionByName(again)


def search(index: DataFrame, queries: DataFrame, k: int, p: Parameters = Parameters(), breadth: int | None = None, id_type: str = "bigint") -> DataFrame:
    """``(qid, id, distance, score, place)`` from all shards; ``breadth`` defaults to that of the build."""
    from vectrine.operators.search import MOST_QUERIES, collect_queries

    some = collect_queries(queries)
    if some is None:
        raise ValueError(f"more than {MOST_QUERIES} queries; search in blocks")
    shared = index.sparkSession.sparkContext.broadcast(some)
    kind, wide = dict(queries.dtypes)["qid"], breadth or p.breadth

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for graph, vectors in zip(b["graph"], b["vectors"]):
                g = Graph.restore(graph, bytes(vectors))
                out = [(qid, g.ids[i], d) for qid, q in zip(shared.value["qid"], shared.value["qvec"]) for d, i in g.search(np.asarray(q, np.float64), k, wide)]
                yield pd.DataFrame(out, columns=["qid", "id", "distance"])

    found = index.select("graph", "vectors").mapInPandas(run, f"qid {kind}, id {id_type}, distance double")
    best = Window.partitionBy("qid").orderBy(F.round("distance", RANK), "id")
    return found.withColumn("score", score(F.col("distance"), p.metric)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def statistics(index: DataFrame) -> DataFrame:
    """One row: nodes, greatest level, mean links of a node over all levels."""
    return index.agg(F.sum("nodes").alias("nodes"), F.max("top").alias("top"), (F.sum("links") / F.sum("nodes")).alias("mean_links"))


def save(index: DataFrame, path: str, p: Parameters, rows: int, at: int | None = None) -> None:
    """Writes the shards, and beside them what a reader has to know; ``at`` is the version of the collection that they are made of."""
    index.write.mode("overwrite").parquet(f"{path}/shards")
    about = json.dumps({"version": VERSION, "rows": rows, "at": at, **asdict(p)})
    index.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict] | None:
    """The shards and their description, or None where nothing is saved."""
    try:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return spark.read.parquet(f"{path}/shards"), about
    except Exception:  # noqa: BLE001  Spark has no narrower error for a missing path
        return None


def saved(spark: SparkSession, root: str) -> list[str]:
    """Names of the indexes below a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(f.getPath().getName()) for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a saved index; no error if there is none."""
    drop(spark, path)


def health(about: dict | None, rows: int, metric: str, dirty: bool = False, at: int | None = None) -> str:
    """missing, incompatible, stale (made of other rows, or of another version ``at`` of the collection), dirty or healthy."""
    if about is None:
        return "missing"
    if about.get("version") != VERSION or about.get("metric") != metric:
        return "incompatible"
    if about.get("rows") != rows or (at is not None and about.get("at") != at):
        return "stale"
    return "dirty" if dirty else "healthy"


def indexed_search(df: DataFrame, path: str, queries: DataFrame, k: int, metric: str = "cosine", key: str = "id", vector: str = "vector") -> DataFrame:
    """Through the index if it fits the collection, else exact."""
    found = load(df.sparkSession, path)
    if found is None or health(found[1], df.count(), metric) != "healthy":
        return batch_search(df, queries, k, metric, key, vector)
    p = Parameters(**{f: found[1][f] for f in Parameters.__dataclass_fields__})
    return search(found[0], queries, k, p, id_type=dict(df.dtypes)[key])


class IndexCache:
    """Keeps the latest used indexes in memory; the oldest leaves first. Changed ones are saved when they leave, and by ``flush``."""

    def __init__(self, spark: SparkSession, most: int = 5):
        self.spark, self.most, self.held, self.changed = spark, most, {}, set()

    def put(self, path: str, index: DataFrame, about: dict) -> None:
        """A changed index, saved later."""
        self.held.pop(path, None)
        self.held[path] = materialize(index, "index"), about
        self.changed.add(path)
        self._shrink()

    def flush(self) -> int:
        """Saves all changed indexes and returns their number."""
        todo = sorted(self.changed & self.held.keys())
        for path in todo:
            self._save(path, *self.held[path])
        return len(todo)

    def _save(self, path: str, index: DataFrame, about: dict) -> None:
        save(index, path, Parameters(**{f: about[f] for f in Parameters.__dataclass_fields__}), about["rows"], about.get("at"))
        self.changed.discard(path)

    def _shrink(self) -> None:
        while len(self.held) > self.most:
            path, (index, about) = next(iter(self.held.items()))
            if path in self.changed:
                self._save(path, index, about)
            self.held.pop(path)[0].unpersist()

    def get(self, path: str) -> tuple[DataFrame, dict] | None:
        found = self.held.pop(path, None) or load(self.spark, path)
        if found is None:
            return None
        found[0].persist()
        self.held[path] = found
        self._shrink()
        return found
