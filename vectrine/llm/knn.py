"""The k most similar vectors of every query, by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is put into a leaf of it. A
query visits leaves best-bin-first. How many, is found by widening the visits
until the recall of a calibration set, measured against brute force over all
rows, reaches the target. Rows and visiting queries meet by shelf: a run of
neighbouring leaves of bounded size. A leaf that holds too many rows is spread
over several shelves, all of which its queries visit, so nothing is lost and no
task holds an unbounded group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrine.llm.tree import PIECE, Tree, k_means, unit, unit64
from vectrine.session import materialize, release

#: Rows that the tree is fitted on: an eighth of all, but no fewer and no more than these; rows of the calibration set, and its recall.
LEAST_SAMPLE, MOST_SAMPLE, CALIBRATION, TARGET = 24_000, 100_000, 256, 0.999
#: Rows of a shelf, queries that meet it in a task, and that are searched for at once.
SHELF_ROWS, SHELF_QUERIES, QUERY_BLOCK = 8_192, 16_384, 2_048
#: Queries that are routed at once, and copies of queries that a task gives back at once.
ROUTE_BLOCK, ROUTE_ROWS = 64, 8_192
BASE = "id string, raw binary, leaf int"


def matrix(raw: pd.Series, width: int) -> np.ndarray:
    """Vectors of a column of float32 bytes."""
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), width)


def stacked(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors of an array column."""
    return np.stack(vectors.to_list()).astype(np.float32) if len(vectors) else np.empty((0, width), np.float32)


def raw_bytes(vector: str):
    """Column of the float32 bytes of an array column, for queries."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, np.float32).tobytes())

    return pack(F.col(vector))


@dataclass
class Index:
    """Tree, width of the vectors, number of rows, and the shelves of each leaf."""

    tree: Tree
    width: int
    rows: int
    first: np.ndarray
    salts: np.ndarray

    @property
    def shelves(self) -> int:
        return int((self.first + self.salts).max()) if len(self.first) else 1


def sample_of(usable: DataFrame, rows: int, most: int, seed: int = 0) -> DataFrame:
    """A little less than ``most`` of the rows, and never more, chosen by a hash of the id: the same ones each time."""
    if rows > most:
        cut = int(2**32 * most / rows * (1 - 4 / most**0.5))
        usable = usable.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**32)) < cut)
    return usable.limit(most)


def fit(usable: DataFrame, width: int, seed: int = 7, leaf_rows: int = 48, alike: float = 2.0) -> tuple[Tree, int]:
    """Tree over ``(id, vector)`` rows, fitted on a bounded sample of them, and their number."""
    rows = usable.count()
    picked = sample_of(usable, rows, min(MOST_SAMPLE, max(LEAST_SAMPLE, rows // 8))).select("id", raw_bytes("vector").alias("raw")).toPandas().sort_values("id")
    x = unit(matrix(picked["raw"], width)) if len(picked) else np.zeros((1, width), np.float32)
    return Tree(x, leaf_rows, seed=seed, alike=alike), rows


def placed(usable: DataFrame, tree: Tree, width: int) -> DataFrame:
    """``(id, raw, leaf)`` of every row."""
    shared = usable.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = stacked(b["vector"], width)
                yield pd.DataFrame({"id": b["id"], "raw": [r.tobytes() for r in x], "leaf": shared.value.assign(unit(x))})

    return usable.select("id", "vector").mapInPandas(run, BASE)


def build(base: DataFrame, tree: Tree, width: int, rows: int, shelf_rows: int = SHELF_ROWS) -> Index:
    """Shelves by the number of rows of each leaf."""
    count = np.zeros(tree.leaves, np.int64)
    for leaf, n in base.groupBy("leaf").count().collect():  # bounded by the leaves of a tree
        count[leaf] = n
    return Index(tree, width, rows, *shelves_by(count, shelf_rows))


def shelves_by(count: np.ndarray, shelf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First shelf and number of shelves of each leaf, by its number of rows."""
    first, salts, shelf, held = np.zeros(len(count), np.int64), np.ones(len(count), np.int64), 0, 0
    for leaf, n in enumerate(count):
        if n > shelf_rows:
            shelf += held > 0
            first[leaf], salts[leaf] = shelf, -(-n // shelf_rows)
            shelf, held = shelf + salts[leaf], 0
            continue
        if held and held + n > shelf_rows:
            shelf, held = shelf + 1, 0
        first[leaf], held = shelf, held + n
    return first, salts


def on_shelves(base: DataFrame, index: Index) -> DataFrame:
    """Adds ``shelf`` to the placed rows."""
    spark = base.sparkSession
    first = F.array(*[F.lit(int(x)) for x in index.first]) if len(index.first) <= 64 else None
    if first is not None:
        salts = F.array(*[F.lit(int(x)) for x in index.salts])
        return base.withColumn("shelf", (F.get(first, "leaf") + F.pmod(F.xxhash64("id"), F.get(salts, "leaf"))).cast("int"))
    where = spark.createDataFrame([(i, int(a), int(s)) for i, (a, s) in enumerate(zip(index.first, index.salts))], "leaf int, first int, salts int")
    return base.join(F.broadcast(where), "leaf").withColumn("shelf", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int")).drop("first", "salts")


def by_shelf(shelved: DataFrame, index: Index) -> DataFrame:
    """Rows of a shelf in one partition, seldom with those of another: three partitions for each shelf."""
    return shelved.repartition(3 * index.shelves, "shelf")


def top_of(s: np.ndarray, k: int) -> np.ndarray:
    """Mask of the ``k`` greatest of each row; among equals the first."""
    if s.shape[1] <= k:
        return np.ones(s.shape, bool)
    out, step = np.empty(s.shape, bool), max(1, PIECE // s.shape[1])
    for a in range(0, len(s), step):
        some = s[a : a + step]
        cut = np.partition(some, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None].copy()
        out[a : a + step] = some >= cut
        tied = np.flatnonzero(out[a : a + step].sum(1) > k)
        if len(tied):
            above, equal = some[tied] > cut[tied], some[tied] == cut[tied]
            out[a + tied] = above | (equal & (np.cumsum(equal, 1) <= k - above.sum(1, keepdims=True)))
    return out


def top_pairs(q: np.ndarray, x: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q`` and of ``x`` of the ``k`` greatest products of each row of ``q``, and these products.

    No more than ``PIECE`` products are held at once, however large a leaf or
    a shelf is. ``own``: row i of ``q`` is row ``own + i`` of ``x`` and isn't paired with it, unless ``x`` has no more than ``k`` rows.
    """
    found, step = [], max(1, PIECE // max(len(x), 1))
    for a in range(0, len(q), step):
        s = q[a : a + step] @ x.T
        if own is not None:
            s[np.arange(len(s)), np.arange(own + a, own + a + len(s))] = -2
        i, j = np.nonzero(top_of(s, k))
        found.append((i + a, j, s[i, j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    i, j, s = map(np.concatenate, zip(*found))
    return i, j, s


def routed(b: pd.DataFrame, index: Index, visits: int, blocks: np.ndarray) -> Iterator[pd.DataFrame]:
    """Queries (query, own, k, raw), once for each shelf that they visit, with ``shelf``, ``block`` and the ``leaves`` there.

    A query visits more shelves the more rows there are, so these copies come in frames of ``ROUTE_ROWS`` at most.
    """
    for t in range(0, len(b), ROUTE_BLOCK):
        some = b.iloc[t : t + ROUTE_BLOCK]
        at, shelf, leaves = [], [], []
        for i, visited in enumerate(index.tree.best_bins(unit(matrix(some["raw"], index.width)), visits)):
            here: dict[int, list[int]] = {}
            for leaf in visited:
                for s in range(index.salts[leaf]):
                    here.setdefault(int(index.first[leaf]) + s, []).append(leaf)
            at += [i] * len(here)
            shelf += here.keys()
            leaves += here.values()
        mark = np.array([zlib.crc32(o.encode()) for o in some["own"].fillna("")])
        for a in range(0, len(at), ROUTE_ROWS):
            rows, there = at[a : a + ROUTE_ROWS], np.array(shelf[a : a + ROUTE_ROWS])
            yield some.iloc[rows].reset_index(drop=True).assign(shelf=there, block=(mark[rows] % blocks[there]).astype(np.int32), leaves=leaves[a : a + ROUTE_ROWS])


def query_blocks(index: Index, sample: np.ndarray, visits: int, asked: int) -> np.ndarray:
    """For each shelf the number of tasks that share its queries, by the part of a sample of vectors that visit it."""
    count = np.zeros(index.shelves, np.int64)
    for leaves in index.tree.best_bins(sample, visits):
        seen = {int(index.first[leaf]) + s for leaf in leaves for s in range(index.salts[leaf])}
        count[list(seen)] += 1
    return np.maximum(1, np.ceil(count / max(len(sample), 1) * asked / SHELF_QUERIES)).astype(np.int64)


def calibrate(base: DataFrame, usable: DataFrame, index: Index, k: int, target: float = TARGET, most: int = CALIBRATION) -> int:
    """Fewest leaf visits at which a calibration set of at most ``most`` rows reaches the recall ``target``.

    Its true neighbours come from brute force over all rows; the result, at
    most ``most * k`` rows, says for each in which leaf it is.
    """
    if index.rows < 2 or index.tree.leaves < 2:
        return 1
    chosen = sample_of(usable, index.rows, most, seed=1).select("id", "vector").toPandas().sort_values("id")
    x, ids, width = unit(stacked(chosen["vector"], index.width)), chosen["id"].to_numpy(), index.width
    shared = base.sparkSession.sparkContext.broadcast((x, ids))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, names = shared.value
        held = None
        for b in batches:
            if not len(b):
                continue
            s = q @ unit(matrix(b["raw"], width)).T
            s[names[:, None] == b["id"].to_numpy()[None, :]] = -2
            i, j = np.nonzero(top_of(s, k))
            new = pd.DataFrame({"q": i.astype(np.int32), "s": s[i, j], "leaf": b["leaf"].to_numpy()[j]})
            held = new if held is None else pd.concat([held, new])
            held = held.sort_values(["q", "s"], ascending=[True, False]).groupby("q").head(k)
        if held is not None:
            yield held

    best = Window.partitionBy("q").orderBy(F.desc("s"), "leaf")
    true = base.mapInPandas(exact, "q int, s float, leaf int").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).where(F.col("s") > -2).toPandas()
    order = index.tree.best_bins(x, index.tree.leaves)
    rank = [{leaf: i + 1 for i, leaf in enumerate(o)} for o in order]
    needed = np.sort([rank[int(q)][int(leaf)] for q, leaf in zip(true["q"], true["leaf"])])
    return int(needed[max(0, int(np.ceil(target * len(needed))) - 1)]) if len(needed) else 1


def search(base: DataFrame, queries: DataFrame, index: Index, visits: int, keep: int | None = None, blocks: np.ndarray | None = None) -> DataFrame:
    """``(query, id, similarity, n)``: for each query its ``k`` most similar rows other than its own id.

    ``queries`` are ``(query, own, k, raw)``; ``own`` is the id left out. A
    repeated query counts once, with its greatest ``k``; a null one is left out. Rows
    of equal similarity are taken by id, the smallest first. Similarities are
    cosines in double precision of the stored vectors. ``keep`` is the ``k`` of
    all queries, if they have the same. ``blocks`` says in how many tasks the
    queries of a shelf meet it.
    """
    spark = base.sparkSession
    blocks = np.ones(index.shelves, np.int64) if blocks is None else blocks
    shared, width = spark.sparkContext.broadcast((index, blocks)), index.width
    kind = dict(queries.dtypes)["query"]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix, many = shared.value
        for b in batches:
            yield from routed(b, ix, visits, many)

    queries = queries.where(F.col("query").isNotNull())
    sent = queries.select("query", "own", "k", "raw").mapInPandas(route, f"query {kind}, own string, k int, raw binary, shelf int, block int, leaves array<int>")
    parts = spark.createDataFrame([(i, int(n)) for i, n in enumerate(blocks)], "shelf int, blocks int")
    shelved = on_shelves(base, index).join(F.broadcast(parts), "shelf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": [], "id": [], "similarity": []})
        if not len(rows) or not len(asked):
            return none
        rows = rows.sort_values(["leaf", "id"], ignore_index=True)
        raw = matrix(rows["raw"], width)
        x, x64 = unit(raw), unit64(raw)
        leaf, ids = rows["leaf"].to_numpy(), rows["id"].to_numpy()
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        some = (among(asked.iloc[t : t + QUERY_BLOCK], x, x64, leaf, ids, rank) for t in range(0, len(asked), QUERY_BLOCK))
        found_ = [f for f in some if len(f)]
        return pd.concat(found_) if found_ else none

    def among(asked: pd.DataFrame, x: np.ndarray, x64: np.ndarray, leaf: np.ndarray, ids: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
        """The best rows of one shelf for a block of queries."""
        q_raw = matrix(asked["raw"], width)
        q, own, ks = unit(q_raw), asked["own"].to_numpy(), asked["k"].to_numpy()
        wide = int(ks.max()) + 4
        by: dict[int, list[int]] = {}
        for i, some in enumerate(asked["leaves"]):
            for one in some:
                by.setdefault(int(one), []).append(i)
        found_q, found_x, found_s = [], [], []
        for one, who in by.items():
            a, z = np.searchsorted(leaf, [one, one + 1])
            if a < z:
                w = np.array(who)
                i, j, s = top_pairs(q[w], x[a:z], wide)
                found_q.append(w[i])
                found_x.append(j + a)
                found_s.append(s)
        if not found_q:
            return pd.DataFrame()
        fq, fx, fs = map(np.concatenate, (found_q, found_x, found_s))

        def first(order: np.ndarray, most: np.ndarray) -> np.ndarray:
            """The leading rows of each query in this order."""
            g = fq[order]
            start = np.r_[True, g[1:] != g[:-1]]
            place = np.arange(len(g)) - np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))
            return order[place < most[g]]

        keep_ = first(np.lexsort((rank[fx], -fs, fq)), ks + 4)
        keep_ = keep_[ids[fx[keep_]] != own[fq[keep_]]]
        fq, fx = fq[keep_], fx[keep_]
        exact = np.einsum("ij,ij->i", unit64(q_raw)[fq], x64[fx])
        last = first(np.lexsort((rank[fx], -exact, fq)), ks)
        return pd.DataFrame({"query": asked["query"].to_numpy()[fq[last]], "id": ids[fx[last]], "similarity": exact[last]})

    found = shelved.groupBy("shelf", "block").cogroup(sent.groupBy("shelf", "block")).applyInPandas(meet, f"query {kind}, id string, similarity double")
    limits = queries.groupBy("query").agg(F.max("k").alias("k"))
    found = found.groupBy("query", "id").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    ranked = found.withColumn("n", F.row_number().over(best))
    if keep is not None:  # one k for all queries
        return ranked.where(F.col("n") <= keep)
    return ranked.join(limits, "query").where(F.col("n") <= F.col("k")).drop("k")


def nearest(usable: DataFrame, queries: DataFrame, width: int, k: int, target: float = TARGET, keep: int | None = None) -> DataFrame:
    """Index ``usable`` (id, vector) and search it for ``queries`` (query, own, k, raw); ``k`` is the largest asked for."""
    tree, rows = fit(usable, width)
    base = placed(usable, tree, width)
    index = build(base, tree, width, rows)
    visits = calibrate(base, usable, index, k, target)
    sample = queries.select("raw").limit(CALIBRATION).toPandas()
    blocks = query_blocks(index, unit(matrix(sample["raw"], width)), visits, queries.count()) if len(sample) else None
    return search(base, queries, index, visits, keep, blocks)


# every row


#: Copies of a vector that are told apart in a result go by salts of this many rows; rows of a bin of a second level, and bins of all second levels at most.
COPIES, BIN_ROWS, MOST_BINS = 16_384, 1_024, 65_536
#: Leaves that are all visited if there are no more.
ALL_LEAVES = 64
#: Angle from the direction of its bin beyond which a row lies in its shell, what is added to a calibrated angle, in radians; places to which similarities are ranked.
CORE, SLACK, RANK = 0.6, 0.02, 9


@dataclass
class Bins:
    """Leaves of a tree, the large ones divided again, with their shelves.

    ``start`` is the first bin of each leaf, ``directions`` the mean directions
    of the bins. Rows far from theirs lie in the shell of the bin, which is
    numbered after all bins and has shelves apart: so a bin is known to hold
    nothing for a row that is far enough away, and the few strays are together.
    ``radius`` is the greatest angle of the rows of each bin and shell, 0 where
    there are none; ``held`` says where there are some.
    """

    index: Index
    start: np.ndarray
    directions: np.ndarray
    held: np.ndarray
    radius: np.ndarray

    def place(self, x: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin or shell of each row, in a divided leaf the nearest, and the angle from the bin's direction."""
        out, n = self.start[leaf], len(self.directions)
        for one in np.unique(leaf[(self.start[1:] - self.start[:-1])[leaf] > 1]):
            rows, a, z = np.flatnonzero(leaf == one), self.start[one], self.start[one + 1]
            out[rows] = a + (x[rows] @ self.directions[a:z].T).argmax(1)
        angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, self.directions[out]), -1, 1))
        return np.where(angle > CORE, out + n, out).astype(np.int32), angle.astype(np.float32)

    def near_others(self, x: np.ndarray, reach: np.ndarray, angle: np.ndarray, excess: tuple[float, float], visits: int, shelf: int) -> list[np.ndarray]:
        """For each row the bins and shells it has to look at, of the first ``visits`` leaves in best-bin-first order.

        ``reach`` is the angle of what it has found so far, ``angle`` that from
        its own bin. A bin further away than ``reach`` and its radius can't hold
        anything nearer. Rows lie in the leaf that is nearest to them, or nearly
        so: one within reach is no further from its own than twice the reach
        and the angle, and what was calibrated as ``excess``, for bins and for
        shells. None for rows that are that near to nothing on another shelf
        than ``shelf``.
        """
        n = len(self.directions)
        other = self.held & ((self.index.first != shelf) | (self.index.salts > 1))
        out, step = [np.empty(0, np.int64)] * len(x), max(1, 4_000_000 // max(n, 1))
        for a in range(0, len(x), step):
            away = np.arccos(np.clip(x[a : a + step] @ self.directions.T, -1, 1))
            far = (2 * reach + angle)[a : a + step, None]
            core = away <= np.minimum(far + excess[0], reach[a : a + step, None] + self.radius[None, :n] + 1e-3)
            ok = np.concatenate([core, away <= far + excess[1]], 1) & self.held
            some = np.flatnonzero(ok[:, other].any(1))
            for i, leaves in zip(some, self.index.tree.best_bins(x[a + some], visits) if len(some) else ()):
                bins = np.concatenate([np.arange(self.start[leaf], self.start[leaf + 1]) for leaf in leaves])
                bins = np.concatenate([bins, bins + n])
                out[a + i] = bins[ok[i, bins]]
        return out

    def shelves_of(self, bins: np.ndarray) -> np.ndarray:
        first, salts = self.index.first[bins], self.index.salts[bins]
        return np.unique(np.repeat(first, salts) + np.arange(salts.sum()) - np.repeat(np.cumsum(salts) - salts, salts))


def divided(base: DataFrame, tree: Tree, width: int, rows: int, shelf_rows: int) -> Bins:
    """Divides the leaves that hold more than a shelf, each by a k-means of its own on a bounded sample of its rows, made in a task."""
    spark = base.sparkSession
    count = np.zeros(tree.leaves, np.int64)
    for leaf, n in base.groupBy("leaf").count().collect():  # bounded by the leaves of a tree
        count[leaf] = n
    large = np.flatnonzero(count > shelf_rows)
    wanted = -(-count[large] // BIN_ROWS)
    wanted = np.maximum(2, np.minimum(wanted, wanted * MOST_BINS // max(wanted.sum(), 1)))
    centres: dict[int, np.ndarray] = {}
    if len(large):
        plan = spark.createDataFrame([(int(a), int(w), min(1.0, 32.0 * int(w) / int(count[a]))) for a, w in zip(large, wanted)], "leaf int, wanted int, share double")

        def split(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("id")
            x = unit(matrix(group["raw"], width))
            c = unit(k_means(x, min(int(group["wanted"].iloc[0]), len(x)), np.random.default_rng(7), 4)[0])
            return pd.DataFrame({"leaf": [int(group["leaf"].iloc[0])], "c": [c.tobytes()]})

        picked = base.join(F.broadcast(plan), "leaf").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= F.col("share") * (1 << 20))
        for leaf, c in picked.groupBy("leaf").applyInPandas(split, "leaf int, c binary").collect():  # bounded by MOST_BINS
            centres[leaf] = np.frombuffer(c, np.float32).reshape(-1, width)
    own = tree.directions().astype(np.float32)
    parts = [centres.get(i, own[i : i + 1]) for i in range(tree.leaves)]
    start = np.cumsum([0, *map(len, parts)])
    none = np.zeros(0, np.int64)
    return Bins(Index(tree, width, rows, none, none), start, np.concatenate(parts), none, none)


def binned(base: DataFrame, bins: Bins, shelf_rows: int) -> DataFrame:
    """``(id, raw, leaf, angle, shelf)`` with the bin as ``leaf``; sets the shelves of the bins."""
    spark, width = base.sparkSession, bins.index.width
    shared = spark.sparkContext.broadcast(bins)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                leaf, angle = shared.value.place(unit(matrix(b["raw"], width)), b["leaf"].to_numpy())
                yield b.assign(leaf=leaf, angle=angle)

    base, n = materialize(base.mapInPandas(run, f"{BASE}, angle float"), "binned"), len(bins.directions)
    count, bins.radius = np.zeros(2 * n, np.int64), np.zeros(2 * n)
    for leaf, c, r in base.groupBy("leaf").agg(F.count(F.lit(1)), F.max("angle")).collect():  # bounded by the bins
        count[leaf], bins.radius[leaf] = c, r
    cores, shells = shelves_by(count[:n], shelf_rows), shelves_by(count[n:], shelf_rows)
    bins.index.first = np.concatenate([cores[0], shells[0] + (cores[0] + cores[1]).max()])
    bins.index.salts, bins.held = np.concatenate([cores[1], shells[1]]), count > 0
    return on_shelves(base, bins.index)


def calibrate_all(shelved: DataFrame, bins: Bins, k: int, target: float, most: int = CALIBRATION) -> tuple[int, tuple[float, float]]:
    """Leaf visits that a calibration set needs for the recall ``target``, and the ``excess`` of :meth:`Bins.near_others`.

    The true neighbours of the set come from brute force over all rows, and so
    do the best ones on its own shelves. For bins the excess is the greatest
    that the set needs, for shells half of what the target allows is given up.
    """
    every, wide = bins.index.tree.leaves, (np.pi, np.pi)
    if bins.index.rows < 2:
        return every, wide
    chosen = sample_of(shelved, bins.index.rows, most, seed=1).select("id", "raw", "shelf", "angle").toPandas().sort_values("id")
    width = bins.index.width
    x, ids, home = unit(matrix(chosen["raw"], width)), chosen["id"].to_numpy(), chosen["shelf"].to_numpy()
    shared = shelved.sparkSession.sparkContext.broadcast((x, ids, home))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, names, at = shared.value
        held = None
        for b in batches:
            if not len(b):
                continue
            s = q @ unit(matrix(b["raw"], width)).T
            s[names[:, None] == b["id"].to_numpy()[None, :]] = -2
            same = at[:, None] == b["shelf"].to_numpy()[None, :]
            for own, values in ((False, s), (True, np.where(same, s, -2))):
                i, j = np.nonzero(top_of(values, k) & (values > -2))
                new = pd.DataFrame({"q": i.astype(np.int32), "own": own, "s": values[i, j], "leaf": b["leaf"].to_numpy()[j], "same": same[i, j]})
                held = new if held is None else pd.concat([held, new])
            held = held.sort_values(["q", "own", "s"], ascending=[True, True, False]).groupby(["q", "own"]).head(k)
        if held is not None:
            yield held

    best = Window.partitionBy("q", "own").orderBy(F.desc("s"), "leaf")
    found = shelved.mapInPandas(exact, "q int, own boolean, s float, leaf int, same boolean").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).toPandas()
    own = found[found["own"]].groupby("q")["s"].agg(["min", "size"])
    reach = np.full(len(x), np.pi)
    full = own.index[own["size"] >= k].to_numpy()
    reach[full] = np.arccos(np.clip(own.loc[full, "min"].to_numpy(), -1, 1))
    true = found[~found["own"]]
    if not len(true) or every <= ALL_LEAVES:
        return every, wide
    n = len(bins.directions)
    leaf_of = np.searchsorted(bins.start, true["leaf"].to_numpy() % n, side="right") - 1
    rank = [{leaf: i + 1 for i, leaf in enumerate(o)} for o in bins.index.tree.best_bins(x, bins.index.tree.leaves)]
    needed = np.sort([1 if same else rank[q][int(leaf)] for q, leaf, same in zip(true["q"], leaf_of, true["same"])])
    visits = int(needed[max(0, int(np.ceil(target * len(needed))) - 1)])
    away = true[~true["same"]]
    q, leaf = away["q"].to_numpy(), away["leaf"].to_numpy()
    far = np.arccos(np.clip(np.einsum("ij,ij->i", x[q], bins.directions[leaf % n]), -1, 1)) - 2 * reach[q] - chosen["angle"].to_numpy()[q]
    core, shell = np.sort(far[leaf < n]), np.sort(far[leaf >= n])
    lost = int((1 - target) / 2 * len(true))
    return visits, (float(core[-1]) + SLACK if len(core) else 0.0, float(shell[-1 - min(lost, len(shell) - 1)]) + SLACK if len(shell) else 0.0)


HOME = "id string, raw binary, leaf int, shelf int, least float, near array<string>, closeness array<double>, shelves array<int>, bins array<int>"


def at_home(shelved: DataFrame, bins: Bins, k: int, visits: int, excess: tuple[float, float]) -> DataFrame:
    """Each row with its ``k`` best on its own shelf, and the other shelves and bins it has to look at."""
    shared, width = shelved.sparkSession.sparkContext.broadcast(bins), bins.index.width

    def run(group: pd.DataFrame) -> pd.DataFrame:
        b = shared.value
        group = group.sort_values("id", ignore_index=True)
        raw, ids, shelf = matrix(group["raw"], width), group["id"].to_numpy(), int(group["shelf"].iloc[0])
        x, x64 = unit(raw), unit64(raw)
        out = {"least": [], "near": [], "closeness": [], "shelves": [], "bins": []}
        for a in range(0, len(x), QUERY_BLOCK):
            q = x[a : a + QUERY_BLOCK]
            i, j, _ = top_pairs(q, x, k + 4, own=a)
            exact = np.einsum("ij,ij->i", x64[i + a], x64[j])
            ok = j != i + a
            i, j, exact = i[ok], j[ok], exact[ok]
            order = np.lexsort((j, -np.round(exact, RANK), i))
            i, j, exact = i[order], j[order], exact[order]
            cut = np.searchsorted(i, np.arange(len(q) + 1))
            reach = np.full(len(q), np.pi)
            for row, (c, d) in enumerate(zip(cut, cut[1:])):
                d = min(d, c + k)
                full = d - c == k
                out["least"].append(float(exact[d - 1]) - 1e-6 if full else -2.0)
                out["near"].append(ids[j[c:d]])
                out["closeness"].append(exact[c:d])
                if full:
                    reach[row] = np.arccos(np.clip(exact[d - 1], -1, 1)) + 1e-3
            for some in b.near_others(q, reach, group["angle"].to_numpy()[a : a + QUERY_BLOCK], excess, visits, shelf):
                there = b.shelves_of(some) if len(some) else some
                there = there[there != shelf]
                out["shelves"].append(there.astype(np.int32))
                out["bins"].append((some if len(there) else some[:0]).astype(np.int32))
        return group.assign(**{name: pd.Series(v, index=group.index) for name, v in out.items()})[[c.split()[0] for c in HOME.split(", ")]]

    return by_shelf(shelved.select("id", "raw", "leaf", "angle", "shelf"), bins.index).groupBy("shelf").applyInPandas(run, HOME)


def elsewhere(home: DataFrame, index: Index, k: int) -> DataFrame:
    """``(query, id, similarity)``: rows of other shelves that are as similar as a row's k-th best at home, k of a shelf at most."""
    spark, width = home.sparkSession, index.width
    asked = home.where(F.size("shelves") > 0)
    sent = asked.select(F.explode("shelves").alias("shelf")).groupBy("shelf").count().collect()  # bounded by the shelves
    blocks = spark.createDataFrame([(r.shelf, -(-r["count"] // SHELF_QUERIES)) for r in sent], "shelf int, blocks bigint")
    routed = asked.select(F.explode("shelves").alias("shelf"), F.col("id").alias("query"), "raw", "least", "bins").join(F.broadcast(blocks), "shelf").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")))
    rows = home.select("id", "raw", "leaf", "shelf").join(F.broadcast(blocks), "shelf").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))

    def meet(rows_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(rows_) and len(asked_):
            rows_ = rows_.sort_values(["leaf", "id"], ignore_index=True)
            raw, ids, leaf = matrix(rows_["raw"], width), rows_["id"].to_numpy(), rows_["leaf"].to_numpy()
            x, x64 = unit(raw), unit64(raw)
            here, from_ = np.unique(leaf, return_index=True)
            to = np.append(from_[1:], len(leaf))
            for t in range(0, len(asked_), QUERY_BLOCK):
                some = asked_.iloc[t : t + QUERY_BLOCK]
                q_raw = matrix(some["raw"], width)
                q, q64, least, names = unit(q_raw), unit64(q_raw), some["least"].to_numpy(), some["query"].to_numpy()
                by: dict[int, list[int]] = {}
                for i, wanted in enumerate(some["bins"]):
                    for one in wanted:
                        by.setdefault(int(one), []).append(i)
                fq, fx = [], []
                for n, one in enumerate(here):
                    if who := by.get(int(one)):
                        step = max(1, PIECE // int(to[n] - from_[n]))
                        for a in range(0, len(who), step):
                            w = np.array(who[a : a + step])
                            i, j = np.nonzero(q[w] @ x[from_[n] : to[n]].T >= least[w, None] - 1e-5)
                            fq.append(w[i])
                            fx.append(j + from_[n])
                if fq:
                    i, j = np.concatenate(fq), np.concatenate(fx)
                    found = pd.DataFrame({"query": names[i], "id": ids[j], "similarity": np.einsum("ij,ij->i", q64[i], x64[j])})
                    found["r"] = found["similarity"].round(RANK)
                    out.append(found.sort_values(["query", "r", "id"], ascending=[True, False, True]).groupby("query").head(k)[["query", "id", "similarity"]])
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "similarity": []})

    rows = rows.select(*[F.col(c).alias(c) for c in ("shelf", "block", "id", "raw", "leaf")])
    routed = routed.select(*[F.col(c).alias(c) for c in ("shelf", "block", "query", "raw", "least", "bins")])
    return rows.groupBy("shelf", "block").cogroup(routed.groupBy("shelf", "block")).applyInPandas(meet, "query string, id string, similarity double")


def neighbours_of_different(vectors: DataFrame, width: int, k: int, target: float = TARGET, shelf_rows: int = SHELF_ROWS) -> DataFrame:
    """``(query, id, similarity)``: the ``k`` most similar rows of every row (id, vector); no two vectors should be equal.

    A row meets its own shelf first. How similar its k-th best is there says
    how far away a leaf may be that holds a better one: most rows of a dense
    place look nowhere else, and only those that do are sent on.
    """
    tree, rows = fit(vectors, width)
    base = materialize(placed(vectors, tree, width), "base")
    bins = divided(base, tree, width, rows, shelf_rows)
    shelved = binned(base, bins, shelf_rows)
    release(base)
    visits, excess = calibrate_all(shelved, bins, k, target)
    home = materialize(at_home(shelved, bins, k, visits, excess), "home")
    near = home.select(F.col("id").alias("query"), F.explode(F.arrays_zip("near", "closeness")).alias("x")).select("query", F.col("x.near").alias("id"), F.col("x.closeness").alias("similarity"))
    best = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", RANK)), "id")
    found = near.unionByName(elsewhere(home, bins.index, k))
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def neighbours_of_all(usable: DataFrame, width: int, k: int, target: float = TARGET) -> DataFrame:
    """``(query, id, similarity, n)``: the ``k`` most similar other rows of every row of ``usable`` (id, vector).

    Equal vectors are searched for once, under their smallest id; of each, only
    the ``k + 1`` smallest ids can be among the nearest, so that a vector that a
    third of all rows have makes no pairs. Among equals the smaller id comes
    first. Fewer than ``k`` other rows give as many as there are.
    """
    from vectrine.llm.ballhash import keyed

    records = materialize(keyed(usable, width).select("id", "key"), "keyed")
    counted = records.groupBy("key").agg(F.min("id").alias("name"), F.count(F.lit(1)).alias("copies"))
    several = materialize(counted.where("copies > 1"), "several")
    members = materialize(records.join(several, "key"), "members")
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    few = members.select("key", "name", "copies", "id").withColumn("place", place).where(F.col("place") <= k + 1)
    copied = materialize(few.groupBy("key", "name", "copies").agg(F.sort_array(F.collect_list("id")).alias("ids")), "copied")
    vectors = usable.select("id", "vector").join(members.where("id <> name").select("id"), "id", "left_anti")
    met = neighbours_of_different(vectors, width, k, target)
    best = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", RANK)), "id")
    # the k best of each different vector, with the copies of the others
    spread = met.join(copied.select(F.col("name").alias("id"), "ids"), "id", "left").select("query", F.explode(F.coalesce("ids", F.array("id"))).alias("id"), "similarity")
    others = materialize(spread.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k), "others")
    # a row of several copies has those beside the others of its vector
    names = copied.select("key", "name", "ids", F.floor(F.col("copies") / COPIES).alias("most"))
    lists = others.join(names.select(F.col("name").alias("query")), "query").groupBy(F.col("query").alias("name")).agg(F.sort_array(F.collect_list(F.struct("n", "id", "similarity"))).alias("others"))
    known = names.join(lists, "name", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("most")))).drop("name", "most")
    rows = members.select("key", F.col("id").alias("query"), F.pmod(F.xxhash64("id"), F.floor(F.col("copies") / COPIES) + 1).alias("salt"))
    own = F.transform(F.filter("ids", lambda x: x != F.col("query")), lambda x: F.struct(F.lit(-1.0).alias("order"), x.alias("id"), F.lit(1.0).alias("similarity")))
    rest = F.transform(F.coalesce("others", F.array().cast("array<struct<n:int,id:string,similarity:double>>")), lambda x: F.struct((-F.round(x["similarity"], RANK)).alias("order"), x["id"].alias("id"), x["similarity"].alias("similarity")))
    told = rows.join(known, ["key", "salt"]).select("query", F.posexplode(F.slice(F.array_sort(F.concat(own, rest)), 1, k)).alias("at", "x")).select("query", "x.id", "x.similarity", (F.col("at") + 1).alias("n"))
    single = others.join(names.select(F.col("name").alias("query")), "query", "left_anti")
    return single.select("query", "id", "similarity", "n").unionByName(told)
