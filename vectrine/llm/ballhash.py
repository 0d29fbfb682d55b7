"""Pairs of nearly equal vectors by meet-in-the-middle ball hashing.

Fingerprint. Each bit is the parity of the cell in which a random projection of
the unit vector falls. For close vectors a bit differs with a probability in
proportion to their distance; for others with about one half. The fingerprint
has ``BANDS`` bands of ``bits`` bits and a longer sketch.

Ball hashing. In each band a vector emits all variants within half the radius 2,
itself and every flip of one bit. Two vectors within the radius share a
variant, so they meet. The leading bits of a variant name its bucket; within a
bucket the flips of the other bits are made where they are compared, so that
what is shuffled are a few packed codes for each vector and band. A bucket that
holds too many codes is cut into parts, and each two parts meet in a task.

Vectors that meet are compared by their sketches, remaining pairs are
deduplicated and verified on the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.llm.knn import matrix, stacked
from vectrine.llm.tree import unit, unit64
from vectrine.session import materialize

#: Bands, products of frequency and distance at the similarity limit for bands and sketch, bits of the sketch, rows of a bucket.
BANDS, STEP, SKETCH_STEP, SKETCH, BUCKET_ROWS = 12, 0.424, 0.7, 128, 98_304
#: Copies of a vector that are paired with all others in a task.
COPIES = 16_384
CODE = np.dtype([("key", "<i8"), ("band", "<u4"), ("own", "<u4"), ("sketch", "<u8", (SKETCH // 64,))])


def band_bits(rows: int) -> int:
    """Bits of a band: enough that unlike vectors rarely meet, whatever their number."""
    return int(np.clip(np.ceil(np.log2(max(rows, 2))) + 7, 18, 31))


def frequency(least: float, step: float = STEP) -> float:
    """Frequency of the projections at which one bit in nine differs between vectors of similarity ``least``.

    With 12 bands, 1 pair in 10,000 at the very limit meets in none of them, and
    fewer above it. The sketch's frequency is higher: it has bits enough to tell
    vectors just below the limit from those above it.
    """
    return step / max(np.sqrt(max(0.0, 2 - 2 * least)), 1e-4)


def flip_probability(distance: float, least: float, step: float = STEP) -> float:
    """Probability that a bit differs between unit vectors at this distance."""
    t = frequency(least, step) * distance / np.pi
    return 0.5 * (1 - 8 / np.pi**2 * sum(np.exp(-((m * np.pi * t) ** 2) / 2) / m**2 for m in range(1, 200, 2)))


def sketch_limit(least: float) -> int:
    """Differing bits of the sketch that a pair of similarity ``least`` exceeds about once in 30,000 times."""
    p = flip_probability(np.sqrt(max(0.0, 2 - 2 * least)), least, SKETCH_STEP)
    return int(np.ceil(SKETCH * p + 4 * np.sqrt(SKETCH * p * (1 - p)) + 1))


class Fingerprints:
    """Random projections for vectors of ``width`` elements; equal for equal seeds."""

    def __init__(self, width: int, bits: int, least: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = BANDS * bits + SKETCH
        self.bits, self.width = bits, width
        step = np.where(np.arange(n) < BANDS * bits, frequency(least), frequency(least, SKETCH_STEP))
        self.w = (rng.standard_normal((width, n)) * (step / np.pi)).astype(np.float32)
        self.shift = rng.random(n).astype(np.float32)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band codes (rows, BANDS) and sketches (rows, words) of unit vectors."""
        cell = np.floor(x @ self.w + self.shift).astype(np.int32) & 1
        power = (1 << np.arange(self.bits, dtype=np.int64))
        bands = (cell[:, : BANDS * self.bits].reshape(len(x), BANDS, self.bits) @ power).astype(np.uint32)
        sketch = np.packbits(cell[:, BANDS * self.bits :].astype(np.uint8), axis=1).view("<u8")
        return bands, sketch


def runs(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of equal values of a sorted array, in blocks of bounded size."""
    n = len(key)
    if not n:
        return
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, n])
    end = np.repeat(start + size, size)
    ahead = end - np.arange(n) - 1  # partners after each position
    todo = np.flatnonzero(ahead)
    total = np.cumsum(ahead[todo])
    a, block = 0, 4_000_000
    while a < len(todo):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + block, side="right")))
        some = todo[a:z]
        n_each = ahead[some]
        i = np.repeat(some, n_each)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n_each) - n_each, n_each)
        yield i, j
        a = z


def pairs_of_parts(codes: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(pair, codes)``: the codes for each two of ``count`` parts, by a hash of the key; one pair if there is one part."""
    if count == 1:
        yield 0, codes
        return
    part = (codes["key"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % count
    for p in np.unique(part):
        some = codes[part == p]
        for q in range(count):
            yield (min(int(p), q) << 16) | max(int(p), q), some


def candidates(vectors: DataFrame, width: int, rows: int, least: float, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(a, b)`` with a < b: keys of distinct vectors that meet in some band and whose sketches agree.

    ``vectors`` are ``(key, raw)``; equal vectors have equal keys and count once.
    """
    spark, bits, limit = vectors.sparkSession, band_bits(rows), sketch_limit(least)
    lead = 0
    while rows * (1 + lead) / 2**lead > 2 * bucket_rows and lead < bits - 8:
        lead += 1
    tail = bits - lead
    shared = spark.sparkContext.broadcast(Fingerprints(width, bits, least))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BANDS << lead, np.int64)
        for batch in batches:
            if len(batch):
                band = (shared.value(unit(matrix(batch["raw"], width)))[0] >> tail).astype(np.int64)
                total += np.bincount(((np.arange(BANDS) << lead) + band).ravel(), minlength=len(total))
        yield pd.DataFrame({"bucket": np.arange(len(total)), "n": total})[total > 0]

    parts_of = np.ones(BANDS << lead, np.int64)
    if rows > bucket_rows:
        own = np.zeros(BANDS << lead, np.int64)
        for b, n in vectors.mapInPandas(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():  # bounded by the buckets
            own[b] = n
        held = own + sum((own[np.arange(len(own)) ^ (1 << i)] for i in range(lead)), np.zeros_like(own))
        parts_of = np.where(held > 4 * bucket_rows, -(-held // bucket_rows), 1)
    cut_into = spark.sparkContext.broadcast(parts_of)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            key, at = np.unique(batch["key"].to_numpy(np.int64), return_index=True)
            band, sketch = shared.value(unit(matrix(batch["raw"].iloc[at], width)))
            parts: dict[int, list[bytes]] = {}
            for t in range(BANDS):
                code = band[:, t]
                prefix = (code >> tail).astype(np.int64)
                one = np.empty(len(key), CODE)
                one["key"], one["band"], one["sketch"] = key, code & np.uint32((1 << tail) - 1), sketch
                for flip in (-1, *range(lead)):
                    to = prefix if flip < 0 else prefix ^ (1 << flip)
                    one["own"] = flip < 0
                    order = np.argsort(to, kind="stable")
                    cut = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0])
                    for a, z in zip(cut, np.r_[cut[1:], len(to)]):
                        bucket, codes = (t << lead) | int(to[order[a]]), one[order[a:z]]
                        for pair, some in pairs_of_parts(codes, int(cut_into.value[bucket])):
                            parts.setdefault((bucket << 32) | pair, []).append(some.tobytes())
            yield pd.DataFrame({"bucket": parts.keys(), "codes": [b"".join(x) for x in parts.values()]})

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        codes = np.frombuffer(b"".join(group["codes"]), CODE)
        _, at = np.unique(codes[["key", "own"]], return_index=True)
        codes = codes[at]
        own = np.flatnonzero(codes["own"])
        band = codes["band"]
        variant = np.concatenate([band] + [band[own] ^ np.uint32(1 << i) for i in range(tail)])
        row = np.concatenate([np.arange(len(codes))] + [own] * tail)
        order = np.argsort(variant, kind="stable")
        variant, row = variant[order], row[order]
        sketch, key = codes["sketch"], codes["key"]
        found = [np.empty((0, 2), np.int64)]
        for i, j in runs(variant):
            x, y = row[i], row[j]
            near = np.bitwise_count(sketch[x, 0] ^ sketch[y, 0]).astype(np.int32)
            for w in range(1, sketch.shape[1]):
                near += np.bitwise_count(sketch[x, w] ^ sketch[y, w])
            ok = (near <= limit) & (key[x] != key[y])
            a, b = key[x[ok]], key[y[ok]]
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    packed = vectors.mapInPandas(emit, "bucket bigint, codes binary")
    return packed.groupBy("bucket").applyInPandas(meet, "a bigint, b bigint").distinct()


def keyed(usable: DataFrame, width: int) -> DataFrame:
    """``(id, key, raw)``: a 64-bit hash of each vector, equal for equal vectors (0.0 and -0.0 are equal)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            raw = [r.tobytes() for r in stacked(b["vector"], width) + np.float32(0)]
            key = np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "key": key, "raw": raw})

    return usable.select("id", "vector").mapInPandas(run, "id string, key bigint, raw binary")


def near_vectors(records: DataFrame, width: int, rows: int, least: float) -> DataFrame:
    """``(a, b, similarity)`` of keys of distinct vectors of similarity ``least`` or more; ``records`` as of :func:`keyed`."""
    met = candidates(records.select("key", "raw"), width, rows, least)
    met = materialize(met, "candidates")
    ends = met.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    vectors = records.select("key", "raw").join(ends, "key", "left_semi").dropDuplicates(["key"])
    vectors = materialize(vectors, "met")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = np.einsum("ij,ij->i", unit64(matrix(b["x"], width)), unit64(matrix(b["y"], width)))
                yield pd.DataFrame({"a": b["a"], "b": b["b"], "similarity": s})[s >= least]

    both = met.join(vectors.select(F.col("key").alias("a"), F.col("raw").alias("x")), "a").join(vectors.select(F.col("key").alias("b"), F.col("raw").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(verify, "a bigint, b bigint, similarity double")


def near_pairs(usable: DataFrame, width: int = 128, least: float = 0.99) -> DataFrame:
    """``(id_a, id_b)`` with id_a < id_b for each pair of ids whose vectors' cosine is ``least`` or more.

    ``usable`` are ``(id, vector)`` rows of usable vectors, one for each id. Equal
    vectors are found by their key and expanded only into the result, which
    lists every pair. Fewer than two rows give none.
    """
    records = materialize(keyed(usable, width), "keyed")
    linked = near_vectors(records, width, records.count(), least)
    of = records.select("id", "key")
    x, y = of.select(F.col("key").alias("a"), F.col("id").alias("x")), of.select(F.col("key").alias("b"), F.col("id").alias("y"))
    across = linked.join(x, "a").join(y, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    many = of.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = of.join(many, "key")
    # the pairs of a vector that many rows have are made in several tasks
    salts = F.floor(F.col("n") / COPIES) + 1
    c = copies.select("key", F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), salts).alias("salt"))
    d = copies.select("key", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
    return across.unionByName(c.join(d, ["key", "salt"]).where("id_a < id_b").select("id_a", "id_b"))


def near_groups(usable: DataFrame, width: int = 128, least: float = 0.99) -> DataFrame:
    """``(id, group_id, links)``: for each id the smallest id of its group and its number of links to different vectors.

    Groups are connected by pairs of similarity ``least`` or more, and equal
    vectors; copies are never expanded into pairs. An id that is like no other
    is a group of its own.
    """
    from vectrine.llm.components import components
    records = materialize(keyed(usable, width), "keyed")
    linked = materialize(near_vectors(records, width, records.count(), least), "linked")
    label = components(linked.select("a", "b"))
    links = linked.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("links"))
    per = records.groupBy("key").agg(F.min("id").alias("first"))
    named = per.join(label.withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("label", "key").alias("label"))
    group = named.groupBy("label").agg(F.min("first").alias("group_id"))
    known = named.join(group, "label").join(links, "key", "left").select("key", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
    return records.select("id", "key").join(known, "key").select("id", "group_id", "links")
