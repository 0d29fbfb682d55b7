"""Clusters of similar vectors by reciprocal-nearest-neighbour average linkage.

Rows lie on shelves: runs of neighbouring leaves of a k-means tree, of bounded
size. On each shelf all mutual best pairs are merged in parallel, round by
round, until no average similarity reaches the threshold; the average of two
clusters is the inner product of their mean vectors. That gives parts. An
average that reaches the threshold needs one between two parts that does, so
the linkage goes on over the parts whose means are that close.

Single links between parts of different shelves are found exactly: a point is
sent to all parts that can hold a similar enough one, by the triangle
inequality on the angles from the part's mean direction. Pairs of parts that
are known to be connected need no look.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrine.llm.components import components
from vectrine.llm.knn import build, by_shelf, fit, matrix, on_shelves, placed
from vectrine.llm.tree import unit, unit64
from vectrine.session import materialize

#: Rows of a shelf, parts that are sent to all executors at once.
SHELF, BLOCK = 8_192, 16_384
#: Parts of a size that get a block of their own if they outnumber all larger ones.
LEAD = 64
#: Rounding error of a float32 cosine at most, and of an angle taken from one.
COSINE_ERROR, ANGLE_ERROR = 1e-5, 1e-3


def merge_rounds(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster number of each row, and the clusters' sums and sizes.

    Among equal averages the pair of the lowest numbers counts as the best, so
    each round has a mutual pair as long as one reaches ``least``.
    """
    total, n = x.astype(np.float64), np.ones(len(x), np.int64)
    label = np.arange(len(x))
    while len(n) > 1:
        mean = (total / n[:, None]).astype(np.float32)
        best, how = np.empty(len(n), np.int64), np.empty(len(n), np.float32)
        for a in range(0, len(n), 1024):
            g = mean[a : a + 1024] @ mean.T
            g[np.arange(len(g)), np.arange(a, a + len(g))] = -2
            best[a : a + 1024] = g.argmax(1)
            how[a : a + 1024] = g.max(1)
        me = np.arange(len(n))
        give = (best[best] == me) & (how >= least) & (best < me)  # the greater number goes
        if not give.any():
            break
        to = np.where(give, best, me)
        kept = np.cumsum(~give) - 1
        np.add.at(total, best[give], total[give])
        np.add.at(n, best[give], n[give])
        total, n, label = total[~give], n[~give], kept[to[label]]
    return label, total, n


PARTS = "kind string, a string, b string, raw binary, shelf int, n bigint, radius double"


def shelf_clusters(shelved: DataFrame, width: int, least: float) -> DataFrame:
    """Per shelf: members ('m': id, part, vector, part's size), parts ('s': part, sum, size, radius) and links between parts ('l').

    A part is named by its smallest id. Its radius is the greatest angle of a
    member from the mean direction.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        raw, ids, shelf = matrix(group["raw"], width), group["id"].to_numpy(), int(group["shelf"].iloc[0])
        x = unit(raw)
        label, total, n = merge_rounds(x, least)
        _, first = np.unique(label, return_index=True)
        name = ids[first]
        seen = [np.empty((0, 2), np.int64)]
        for a in range(0, len(x), 1024):
            i, j = np.nonzero(x[a : a + 1024] @ x.T >= least)
            p, q = label[i + a], label[j]
            seen.append(np.unique(np.stack([p, q], 1)[p < q], axis=0))
        links = np.unique(np.concatenate(seen), axis=0)
        cosine = np.ones(len(n))
        np.minimum.at(cosine, label, np.einsum("ij,ij->i", x.astype(np.float64), unit64(total)[label]))
        out = pd.DataFrame({"kind": "m", "a": ids, "b": name[label], "raw": group["raw"], "shelf": shelf, "n": n[label], "radius": 0.0})
        sums = pd.DataFrame({"kind": "s", "a": name, "b": None, "raw": [t.tobytes() for t in total], "shelf": shelf, "n": n, "radius": np.arccos(np.clip(cosine, -1, 1))})
        pairs = pd.DataFrame({"kind": "l", "a": name[links[:, 0]], "b": name[links[:, 1]], "raw": None, "shelf": shelf, "n": 0, "radius": 0.0})
        return pd.concat([x for x in (out, sums, pairs) if len(x)])

    return shelved.groupBy("shelf").applyInPandas(run, PARTS)


def totals(column: pd.Series) -> np.ndarray:
    """Sums of vectors of a column of float64 bytes."""
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)


def blocks(sums: DataFrame, most: int = BLOCK) -> list[tuple[int, int, int, int]]:
    """``(least, greatest, salt, salts)`` of disjoint blocks of about ``most`` parts or fewer: a range of sizes, and its share by a hash of the name."""
    out, low, high, held = [], 0, 0, 0
    for n, many in sorted(((r.n, r.m) for r in sums.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True):  # bounded by the rows of a shelf
        if held and (held + many > most or many > max(held, LEAD)):  # the many small parts don't meet the rows of large ones
            out.append((low, high, 0, 1))
            held = 0
        if many > most:
            salts = -(-many // most)
            out += [(n, n, i, salts) for i in range(salts)]
            continue
        low, high, held = n, n if not held else high, held + many
    return out + ([(low, high, 0, 1)] if held else [])


def against_parts(rows: DataFrame, sums: DataFrame, compare, schema: str, label: str, most: int = BLOCK) -> DataFrame:
    """``compare(batch, block)`` of all batches of ``rows`` with each block of parts; ``rows`` have ``n``, the size of their part.

    A block is sent to all executors, one after the other. A pair of parts is
    looked at from the smaller one (see :func:`after`), so most rows meet the
    few blocks of large parts only.
    """
    spark, found = rows.sparkSession, None
    for low, high, salt, salts in blocks(sums, most):
        block = sums.where(F.col("n").between(low, high) & (F.pmod(F.xxhash64("cluster"), F.lit(salts)) == salt)).toPandas()
        shared = spark.sparkContext.broadcast({c: block[c].to_numpy() for c in block if c != "sum"} | {"mean": totals(block["sum"]) / block["n"].to_numpy()[:, None]})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = shared.value | {"direction": unit(shared.value["mean"])}
            for b in batches:
                for a in range(0, len(b), 1024):
                    yield compare(b.iloc[a : a + 1024], parts)

        one = materialize(rows.where(F.col("n") <= high).mapInPandas(run, schema), label)
        found = one if found is None else found.unionByName(one)
        shared.destroy()
    return spark.createDataFrame([], schema) if found is None else found


def after(b: pd.DataFrame, block: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """True for pairs of a row and a part that is larger than the row's, or as large and of a smaller name."""
    n, m = b["n"].to_numpy()[i], block["n"][j]
    return (m > n) | ((m == n) & (block["cluster"][j] < b["cluster"].to_numpy()[i]))


def near_parts(sums: DataFrame, least: float) -> DataFrame:
    """``(a, b, average)``: all pairs of parts whose average similarity is ``least`` or more."""

    def compare(b: pd.DataFrame, block: dict[str, np.ndarray]) -> pd.DataFrame:
        mine, theirs = totals(b["sum"]) / b["n"].to_numpy()[:, None], block["mean"]
        i, j = np.nonzero(mine.astype(np.float32) @ theirs.astype(np.float32).T >= least - COSINE_ERROR)
        ok = after(b, block, i, j)
        i, j = i[ok], j[ok]
        average = np.einsum("ij,ij->i", mine[i], theirs[j])
        found = pd.DataFrame({"a": b["cluster"].to_numpy()[i], "b": block["cluster"][j], "average": average})
        return found[average >= least]

    return against_parts(sums, sums, compare, "a string, b string, average double", "near")


def border_links(members: DataFrame, sums: DataFrame, known: DataFrame, width: int, least: float) -> DataFrame:
    """``(a, b)``: parts of different shelves with a pair of points of similarity ``least`` or more, as far as ``known`` links don't connect them.

    ``members`` are ``(id, cluster, raw, shelf, n)``, ``sums`` ``(cluster, sum, n,
    shelf, radius)``. No pair of points is left out that the bound allows:
    with p the angle of a point from a part's mean direction, none of its
    members is nearer than p less the part's radius.
    """
    joined = materialize(components(known).select(F.col("node").alias("cluster"), F.col("label").alias("component")), "joined")

    def with_component(df: DataFrame) -> DataFrame:
        return df.join(joined, "cluster", "left").withColumn("component", F.coalesce("component", "cluster"))

    def compare(b: pd.DataFrame, block: dict[str, np.ndarray]) -> pd.DataFrame:
        limit = np.cos(np.minimum(block["radius"] + np.arccos(np.clip(least, -1, 1)) + ANGLE_ERROR, np.pi))
        i, j = np.nonzero(unit(matrix(b["raw"], width)) @ block["direction"].T >= limit.astype(np.float32) - np.float32(COSINE_ERROR))
        ok = after(b, block, i, j)
        i, j = i[ok], j[ok]
        shelf = block["shelf"][j]
        ok = (b["component"].to_numpy()[i] != block["component"][j]) & (b["shelf"].to_numpy()[i] != shelf)
        asked = pd.DataFrame({"i": i[ok], "shelf": shelf[ok], "parts": block["cluster"][j[ok]]}).groupby(["i", "shelf"])["parts"].agg(list).reset_index()
        at = asked["i"].to_numpy(np.int64)
        return pd.DataFrame({"cluster": b["cluster"].to_numpy()[at], "raw": b["raw"].to_numpy()[at], "shelf": asked["shelf"], "parts": asked["parts"]})

    points = materialize(with_component(members.select("cluster", "raw", "shelf", "n")), "points")
    sent = against_parts(points, with_component(sums), compare, "cluster string, raw binary, shelf int, parts array<string>", "sent")

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[str, str]] = set()
        if len(rows) and len(asked):
            rows = rows.sort_values("cluster", ignore_index=True)
            raw, q_raw = matrix(rows["raw"], width), matrix(asked["raw"], width)
            x, q, part, theirs = unit(raw), unit(q_raw), rows["cluster"].to_numpy(), asked["cluster"].to_numpy()
            by: dict[str, list[int]] = {}
            for i, some in enumerate(asked["parts"]):
                for one in some:
                    by.setdefault(one, []).append(i)
            for one, who in by.items():
                a, z = np.searchsorted(part, one), np.searchsorted(part, one, side="right")
                for t in range(0, len(who), 2048):
                    w = np.array(who[t : t + 2048])
                    s = q[w] @ x[a:z].T
                    i, j = np.nonzero(s >= least - COSINE_ERROR)
                    close = s[i, j] < least + COSINE_ERROR
                    if close.any():  # decided in double precision
                        exact = np.einsum("ij,ij->i", unit64(q_raw[w[i[close]]]), unit64(raw[j[close] + a]))
                        i = np.delete(i, np.flatnonzero(close)[exact < least])
                    found |= {(min(one, p), max(one, p)) for p in set(theirs[w[i]])}
        return pd.DataFrame(sorted(found), columns=["a", "b"])

    rows = points.select("cluster", "raw", "shelf")
    return rows.groupBy("shelf").cogroup(sent.groupBy("shelf")).applyInPandas(meet, "a string, b string").distinct()


def chain_merges(total: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Cluster number of each part after all merges of average ``least`` or more, by chains of nearest neighbours.

    A merged cluster is as similar to a third one as its halves on average, so
    no merge brings a better partner to a pair of mutual best ones: the chain
    makes the same merges as rounds of all mutual best pairs, each of them once,
    whatever their number. Averages are over all pairs of members, by the sums
    and sizes of the clusters. A cluster without a partner is done.
    """
    total, n = total.copy(), n.astype(np.float64)
    mean, label, alive = total / n[:, None], np.arange(len(n)), np.ones(len(n), bool)
    chain: list[int] = []
    for first in range(len(n)):
        while alive[first] or chain:
            if not chain:
                chain.append(first)
            me = chain[-1]
            s = np.where(alive, mean @ mean[me], -2.0)
            s[me] = -2.0
            best = int(s.argmax())
            if len(chain) > 1 and s[chain[-2]] >= s[best] - 1e-12:
                best = chain[-2]  # ties, up to rounding, end the chain
            if s[best] < least:
                alive[me] = False
                chain.pop()
            elif len(chain) > 1 and best == chain[-2]:
                keep, gone = min(me, best), max(me, best)
                total[keep] += total[gone]
                n[keep] += n[gone]
                mean[keep] = total[keep] / n[keep]
                label[gone], alive[gone] = keep, False
                chain = chain[:-2]
            else:
                chain.append(best)
    while (label[label] != label).any():
        label = label[label]
    return label


def average_merges(near: DataFrame, sums: DataFrame, least: float) -> DataFrame:
    """``(a, b)``: parts and the smallest part of their cluster by average linkage, for all in a cluster of several.

    ``near`` are all pairs of parts whose average reaches ``least``. A merge
    needs such a pair in it, so each of their components is a task of its own.
    """
    group = components(near).select(F.col("node").alias("cluster"), F.col("label").alias("component"))

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("cluster", ignore_index=True)
        label = chain_merges(totals(parts["sum"]), parts["n"].to_numpy(), least)
        name = parts["cluster"].to_numpy()
        return pd.DataFrame({"a": name[label], "b": name})[label != np.arange(len(label))]

    return materialize(sums.join(group, "cluster").select("component", "cluster", "sum", "n").groupBy("component").applyInPandas(run, "a string, b string"), "merges")


class Clusters:
    """Result of the linkage: ``members`` (id, part, raw), ``sums`` of the parts and ``near`` pairs of them."""

    def __init__(self, usable: DataFrame, width: int, least: float, shelf_rows: int = SHELF):
        self.width, self.least = width, least
        tree, rows = fit(usable, width)
        base = placed(usable, tree, width)
        index = build(base, tree, width, rows, shelf_rows)
        self.parts = materialize(shelf_clusters(by_shelf(on_shelves(base, index), index), width, least), "parts")
        self.members = self.parts.where("kind = 'm'").select(F.col("a").alias("id"), F.col("b").alias("cluster"), "raw", "shelf", "n")
        self.sums = self.parts.where("kind = 's'").select(F.col("a").alias("cluster"), F.col("raw").alias("sum"), "n", "shelf", "radius")
        self.near = near_parts(self.sums, least)

    def links(self) -> DataFrame:
        """``(a, b)``: links between parts that connect all that single links do. An average beyond the threshold has a link in it."""
        known = self.parts.where("kind = 'l'").select("a", "b").unionByName(self.near.where(F.col("average") >= self.least + COSINE_ERROR).select("a", "b"))
        return known.unionByName(materialize(border_links(self.members, self.sums, known, self.width, self.least), "links"))

    def merges(self) -> DataFrame:
        """``(a, b)``: the parts that the linkage merges."""
        return average_merges(self.near, self.sums, self.least)

    def labels(self, connected: bool = False) -> DataFrame:
        """``(cluster, cluster_id)`` of each part: by average linkage, or connected by single links.

        The name of a cluster is its smallest id, since that of a part is.
        """
        found = components(self.links() if connected else self.merges()).select(F.col("node").alias("cluster"), F.col("label").alias("cluster_id"))
        return self.sums.select("cluster").join(found, "cluster", "left").select("cluster", F.coalesce("cluster_id", "cluster").alias("cluster_id"))

    def assigned(self, connected: bool = False) -> DataFrame:
        """``(cluster_id, id)`` of every record."""
        return self.members.select("id", "cluster").join(self.labels(connected), "cluster").select("cluster_id", "id")


def linked_clusters(usable: DataFrame, width: int = 128, least: float = 0.74) -> DataFrame:
    """``(cluster_id, id)`` of records that belong together with another: linkage, then single links between its clusters.

    A record that is like no other has no row; no rows give none.
    """
    every = materialize(Clusters(usable, width, least).assigned(connected=True), "assigned")
    large = every.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster_id")
    return every.join(large, "cluster_id", "left_semi").select("cluster_id", "id")


def described_clusters(usable: DataFrame, width: int = 128, least: float = 0.74, typical: int = 3) -> DataFrame:
    """``(cluster_id, size, place, id, metadata, closeness)``: each cluster's most typical members.

    ``usable`` has ``metadata`` beside id and vector. ``closeness`` is a
    member's mean similarity to all members; ties go to the smaller id.
    """
    made = Clusters(usable, width, least)
    labels = materialize(made.labels(), "labels")

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n"].sum())
        total = np.frombuffer(b"".join(group["sum"])).reshape(len(group), -1).sum(0)
        return pd.DataFrame({"cluster_id": [group["cluster_id"].iloc[0]], "mean": [(total / n).tobytes()], "size": [n]})

    means = labels.join(made.sums, "cluster").groupBy("cluster_id").applyInPandas(mean, "cluster_id string, mean binary, size bigint")
    # a part lies on one shelf, so no part is hot however large its cluster
    per_part = labels.join(means.where("size > 1"), "cluster_id")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = np.frombuffer(b"".join(b["mean"])).reshape(len(b), -1)
                yield b[["cluster_id", "size", "id"]].assign(closeness=np.einsum("ij,ij->i", unit64(matrix(b["raw"], width)), m))

    met = made.members.select("id", "cluster", "raw").join(per_part, "cluster").select("cluster_id", "size", "id", "raw", "mean")
    near = met.mapInPandas(close, "cluster_id string, size bigint, id string, closeness double")
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("closeness"), "id"))
    top = near.withColumn("place", place).where(F.col("place") <= typical)
    return top.join(usable.select("id", "metadata"), "id").select("cluster_id", "size", "place", "id", "metadata", "closeness")
