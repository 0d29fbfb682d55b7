"""A varied subset of given size by concave feature coverage.

Each record has mass on three features: its leaf of a k-means tree, whose leaves
hold alike records in any number, the part of the leaf on whose side it lies,
and, as far as it is like no leaf, a hash bucket of its direction, which rare
kinds share with few others. A feature weighs the eighth root of its mass in the
whole collection, and a subset is worth the weighted sum of the square roots of
its masses. A group therefore gets picks about as the fourth root of its size:
large ones far less than in proportion, and rare kinds have their place. Rounds
with a descending threshold add every record whose marginal gain reaches it.

Records of the same main feature lie in the same pack, in a fixed order, where
they see each other's gains fall; packs are of bounded size. A round reads the
features of the packs and gives the masses that it adds. What a pack took before
follows from the masses at the start of each round, so it is computed again and
nothing is rewritten. Masses are whole numbers and sums of them are exact: the
result doesn't hang on how the data are spread over files and tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.llm.knn import fit, stacked
from vectrine.llm.tree import Tree, unit
from vectrine.session import materialize, release

#: Sample rows of a leaf at least, mean similarity at which a leaf isn't divided, bits of a leaf's parts and of a bucket.
LEAF_ROWS, ALIKE, PART_BITS, BITS = 2, 0.88, 3, 12
#: Similarities to the nearest leaf at which a record is no novelty, and nothing else.
KNOWN, NOVEL = 0.85, 0.35
#: Factor of the threshold from round to round, power of a feature's mass that is its weight.
FACTOR, POWER = 0.8, 0.125
#: Rows of a pack, bins of a histogram, rows that are sorted in one task, parts of a unit of mass.
PACK_ROWS, BINS, FEW, UNIT = 16_384, 4_096, 10_000, 1 << 20


class Features:
    """Feature numbers and masses, in parts of ``UNIT``, of unit vectors."""

    def __init__(self, tree: Tree, width: int, seed: int = 5):
        leaf = np.array([i for i, x in sorted(((i, x) for i, x in enumerate(tree.leaf) if x >= 0), key=lambda p: p[1])])
        self.c = tree.c[leaf]
        rng = np.random.default_rng(seed)
        self.sides = rng.standard_normal((width, PART_BITS)).astype(np.float32)
        self.planes = rng.standard_normal((width, BITS)).astype(np.float32)
        self.count = len(self.c) * (1 + 2**PART_BITS) + 2**BITS

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, c = len(self.c), self.c.astype(np.float64)
        length = np.sqrt((c * c).sum(1))
        s = np.round((x.astype(np.float64) @ c.T) / np.where(length > 0, length, 1), 9)  # equal whatever rows are multiplied together
        leaf = s.argmax(1)
        novelty = np.clip((KNOWN - s.max(1)) / (KNOWN - NOVEL), 0, 1)
        side = (((x - self.c[leaf]) @ self.sides) > 0) @ (1 << np.arange(PART_BITS))
        bucket = ((x @ self.planes) > 0) @ (1 << np.arange(BITS))
        feature = np.stack([leaf, n + leaf * 2**PART_BITS + side, n * (1 + 2**PART_BITS) + bucket], 1)
        mass = np.stack([(1 - novelty) * 0.8, (1 - novelty) * 0.2, novelty], 1)
        return feature.astype(np.int32), np.round(mass * UNIT).astype(np.int32)


def gains(weight: np.ndarray, state: np.ndarray, feature: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Marginal gain of each row."""
    held = state[feature]
    return (weight[feature] * (np.sqrt(held + mass) - np.sqrt(held))).sum(-1)


def replay(feature: np.ndarray, mass: np.ndarray, weight: np.ndarray, rounds: list[tuple[np.ndarray, float]], salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """What a pack takes: for each row the round (-1: none) and the gain, and the greatest gain of the rest after the last round.

    Rows are sorted by their main feature. Of each, the first row that reaches
    the threshold is taken, and the next one on the gains that are left. A pack
    that holds one of several salts of a feature counts what it takes of it
    for each of them: the others are taking alike ones at the same time.
    """
    main = np.where(mass[:, 2] > mass[:, 0], feature[:, 2], feature[:, 0])
    counted = np.where(feature == main[:, None], salts[main][:, None], 1) * mass / UNIT
    known, at = np.unique(feature, return_inverse=True)
    at, own_weight, plain = at.reshape(feature.shape), weight[known], mass / UNIT
    took, gain = np.full(len(main), -1, np.int32), np.zeros(len(main))
    state = np.zeros(len(known))
    for r, (masses, least) in enumerate(rounds):
        state = masses[known].copy()
        open_ = np.flatnonzero(took < 0)
        now = gains(own_weight, state, at[open_], plain[open_])
        ok = now >= least
        open_, now = open_[ok], now[ok]
        while len(open_):
            first = np.flatnonzero(np.r_[True, main[open_][1:] != main[open_][:-1]])
            some = open_[first]
            took[some], gain[some] = r, now[first]
            np.add.at(state, at[some], counted[some])
            open_ = np.delete(open_, first)
            now = gains(own_weight, state, at[open_], plain[open_])
            ok = now >= least
            open_, now = open_[ok], now[ok]
    left = took < 0
    return took, gain, float(gains(own_weight, state, at[left], plain[left]).max()) if left.any() else 0.0


def _sums(totals: DataFrame) -> tuple[dict[int, int], float]:
    """Sums by feature, and the greatest gain; what the driver gets is bounded by the number of features."""
    rows = totals.groupBy("f").agg(F.sum("q").alias("q"), F.max("g").alias("g")).collect()
    return {r.f: r.q for r in rows}, max((r.g for r in rows), default=0.0)


def _unpacked(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for f, m in zip(b["feature"], b["mass"]):
        yield np.frombuffer(f, np.int32).reshape(-1, 3), np.frombuffer(m, np.int32).reshape(-1, 3)


def _by_feature(feature: np.ndarray, mass: np.ndarray, greatest: float = 0.0) -> pd.DataFrame:
    """Masses by feature; the number of rows as that of a feature -1."""
    f, at = np.unique(feature, return_inverse=True)
    q = np.bincount(at.ravel(), mass.ravel().astype(np.float64), len(f)).astype(np.int64)  # below 2**53, so exact
    return pd.DataFrame({"f": np.append(f, -1), "q": np.append(q, len(feature)), "g": greatest})


TOTALS = "f int, q bigint, g double"


def packs(made: DataFrame, salts: np.ndarray, pack: np.ndarray) -> DataFrame:
    """``(pack, ids, feature, mass)``: the rows of each pack, by main feature and a hash of the id; ``made`` are ``(id, main, feature, mass)``."""
    spark = made.sparkSession
    some = np.flatnonzero(pack >= 0)
    where = spark.createDataFrame(pd.DataFrame({"main": some.astype(np.int32), "first": pack[some].astype(np.int32), "salts": salts[some].astype(np.int32)}), "main int, first int, salts int")

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["main", "hash", "id"])
        return pd.DataFrame({"pack": rows["pack"].iloc[:1], "ids": [rows["id"].to_list()], "feature": [b"".join(rows["feature"])], "mass": [b"".join(rows["mass"])]})

    placed = made.withColumn("hash", F.xxhash64("id")).join(F.broadcast(where), "main").withColumn("pack", (F.col("first") + F.pmod("hash", "salts")).cast("int")).drop("first", "salts")
    return placed.groupBy("pack").applyInPandas(together, "pack int, ids array<string>, feature binary, mass binary")


def _packing(count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Salts and first pack of each feature, by its number of rows: features side by side in packs of ``most`` rows, larger ones over packs of their own."""
    salts, first, pack, held = np.ones(len(count), np.int64), np.full(len(count), -1, np.int64), 0, 0
    for f in np.flatnonzero(count):
        n = int(count[f])
        if held and held + n > most:
            pack, held = pack + 1, 0
        salts[f], first[f] = -(-n // most), pack
        if n > most:
            pack, held = pack + int(salts[f]), 0
        else:
            held += n
    return salts, first


def varied_subset(usable: DataFrame, size: int, width: int = 128, pack_rows: int = PACK_ROWS) -> DataFrame:
    """``(id, gain)`` of ``size`` records, or of all if there are no more; ``gain`` is the gain at which a record was taken.

    Only the mass of each feature, a bounded number, goes to the driver. The
    last round's surplus is cut by gain, then a hash of the id.
    """
    spark = usable.sparkSession
    if size <= 0:
        return spark.createDataFrame([], "id string, gain float")
    tree, rows = fit(usable, width, leaf_rows=LEAF_ROWS, alike=ALIKE)
    if size >= rows:
        return usable.select("id", F.lit(0.0).cast("float").alias("gain"))
    make = spark.sparkContext.broadcast(Features(tree, width))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                f, m = make.value(unit(stacked(b["vector"], width)))
                main = np.where(m[:, 2] > m[:, 0], f[:, 2], f[:, 0])
                yield pd.DataFrame({"id": b["id"], "main": main, "feature": [x.tobytes() for x in f], "mass": [x.tobytes() for x in m]})

    made = materialize(usable.select("id", "vector").mapInPandas(features, "id string, main int, feature binary, mass binary"), "features")
    count = np.zeros(make.value.count, np.int64)
    for f, n in made.groupBy("main").count().collect():  # bounded by the number of features
        count[f] = n
    salts, first = _packing(count, pack_rows)
    packed = materialize(packs(made, salts, first), "packs")
    release(made)

    def masses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, m in _unpacked(b):
                yield _by_feature(f, m)

    numbers = packed.select("feature", "mass")
    total, _ = _sums(numbers.mapInPandas(masses, TOTALS))
    weight = np.array([total.get(f, 0) / UNIT for f in range(make.value.count)]) ** POWER
    fixed = spark.sparkContext.broadcast((weight, salts))
    state, threshold, taken, rounds = np.zeros(len(weight), np.int64), float(weight.max()) * 1.5, 0, []
    while taken < size:
        rounds.append((spark.sparkContext.broadcast(state / UNIT), threshold))

        def take(batches: Iterator[pd.DataFrame], rounds=tuple(rounds)) -> Iterator[pd.DataFrame]:
            (w, many), past = fixed.value, [(s.value, least) for s, least in rounds]
            for b in batches:
                for f, m in _unpacked(b):
                    took, _, left = replay(f, m, w, past, many)
                    new = took == len(past) - 1
                    yield _by_feature(f[new], m[new], left)

        added, left = _sums(numbers.mapInPandas(take, TOTALS))
        new = added.pop(-1, 0)
        for f, q in added.items():
            state[f] += q
        taken += new
        threshold = min(threshold * FACTOR, left) if not new else threshold * FACTOR  # no round without a record
    history = tuple(rounds)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (w, many), past = fixed.value, [(s.value, least) for s, least in history]
        for b in batches:
            for ids, (f, m) in zip(b["ids"], _unpacked(b)):
                took, gain, _ = replay(f, m, w, past, many)
                some = np.flatnonzero(took >= 0)
                yield pd.DataFrame({"id": np.asarray(ids, object)[some], "gain": gain[some].astype(np.float32), "round": took[some]})

    chosen = materialize(packed.mapInPandas(tell, "id string, gain float, round int"), "chosen")
    last = F.col("round") == len(history) - 1
    before = chosen.where(~last).select("id", "gain")
    return before.unionByName(_cut(chosen.where(last).select("id", "gain"), size - before.count()))


def _cut(rows: DataFrame, most: int, few: int = FEW) -> DataFrame:
    """``most`` of the rows, by gain, then a hash of the id.

    The range in which the border lies is narrowed by histograms, of the gain
    and among equal gains of the hash, until few rows are in it; only these are
    sorted.
    """
    rest, kept = rows.withColumn("hash", F.xxhash64("id")), []
    for key in (-F.col("gain").cast("double"), F.col("hash").cast("double")):
        while True:
            low, high, n = rest.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
            if n <= most:
                return _all([*kept, rest])
            if n <= few or low == high:
                break
            inside = F.least(F.lit(BINS - 1), F.floor((key - low) / ((high - low) / BINS)).cast("int"))
            held = 0
            for b, c in sorted(tuple(r) for r in rest.groupBy(inside.alias("b")).count().collect()):
                if held + c > most:
                    break
                held += c
            kept.append(rest.where(inside < b))
            rest, most = rest.where(inside == b), most - held
        if n <= few:
            break
    return _all([*kept, rest.orderBy(F.desc("gain"), "hash", "id").limit(most)])


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select("id", "gain")
    for p in parts[1:]:
        out = out.unionByName(p.select("id", "gain"))
    return out
